"""Words, word hashes and word n-grams of Arrow text columns, on whole byte buffers with numpy.

A word is a run of bytes of one class. Both classes used here are defined on single bytes, and bytes of
a multi-byte UTF-8 character are word bytes in both, so splitting bytes equals splitting characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from xxhash import xxh3_128_digest

SLICE_BYTES = 2 << 20  # of text handled at once
LANES = 3  # integers of eight bytes that a word may have to be hashed without the library
WORD_SEED = 0x5DEECE66D  # of the library hash of longer words
WORD_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
HASH_BYTES = 1 << 20  # of bytes hashed at once: eight bytes of scratch each

_BYTE = np.arange(256)
#: Everything but white space.
NON_SPACE = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))
#: Digits, small letters and all beyond ASCII (the text is lower-cased first).
ALNUM = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers whose outputs look random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SEED = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _SEED)
_R = 0xD1342543DE82EF95
_R_INV = pow(_R, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


class Text(NamedTuple):
    """Texts of one slice: their ids, the joined bytes and each text's place in them."""

    ids: pa.Array
    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray


def plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, null as empty, and the n + 1 offsets into them."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", doc_id: str = "doc_id", limit: int = SLICE_BYTES) -> Iterator[Text]:
    """The rows of all batches in slices of at most ``limit`` bytes of text, or of one longer text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        data, offsets = plain(batch.column(text))
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            part = batch.slice(lo, hi - lo)
            yield Text(part.column(doc_id), part, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lo = hi


class Words(NamedTuple):
    """starts, ends: of each word in the bytes; bounds: n + 1 places of the texts among the words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def stop(self) -> np.ndarray:
        """For each word, the place where its text's words end."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds))


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | fresh[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | fresh[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def word_hashes(w: Words) -> np.ndarray:
    """A quick 64-bit hash of each word's bytes, for features and for places that are compared word by word after: words
    of a thousand letters and more can be made so that their hashes are equal."""
    n, out, lo = len(w.starts), np.empty(len(w.starts), np.uint64), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(w.ends, w.starts[lo] + HASH_BYTES, "right")))
        base = int(w.starts[lo])
        size = int(w.ends[hi - 1]) - base
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[w.data[base : base + size]] * _powers(_R, size), out=total[1:])
        s, e = w.starts[lo:hi] - base, w.ends[lo:hi] - base
        out[lo:hi] = (total[e] - total[s]) * _powers(_R_INV, size + 1)[s]
        lo = hi
    return mix(out)


def word_digests(w: Words) -> np.ndarray:
    """Two independent 64-bit hashes of each word's bytes, one a column.

    Words of up to 8 * LANES bytes are read as 64-bit integers, which are mixed in one after another from two seeds and
    the length: words of one length that differ in one integer never have equal hashes. Longer words get both halves of
    a seeded 128-bit library hash."""
    n, size = len(w.data), w.ends - w.starts
    padded = np.zeros(n + 8 * LANES, np.uint8)
    padded[:n] = w.data
    at = np.ndarray(n + 8 * LANES - 7, "<u8", padded, 0, (1,))  # the eight bytes from each place on
    out = np.empty((len(size), 2), np.uint64)
    for k in (0, 1):
        out[:, k] = mix(size.astype(np.uint64) * np.uint64(_R) + WORD_SEEDS[k])
    rows = np.arange(len(size))
    for lane in range(LANES):
        rows = rows[size[rows] > 8 * lane]
        left = np.minimum(size[rows] - 8 * lane, 8).astype(np.uint64)
        value = at[w.starts[rows] + 8 * lane] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left))
        for k in (0, 1):
            out[rows, k] = mix(out[rows, k] ^ value)
    long = np.flatnonzero(size > 8 * LANES)
    if len(long):
        out[long] = np.frombuffer(b"".join([xxh3_128_digest(w.word(i), WORD_SEED) for i in long.tolist()]), "<u8").reshape(-1, 2)
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive items; ``len(h) - k + 1`` of them, none if that is below one."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc *= np.uint64(0x2545F4914F6CDD1D)
        acc += h[j : j + n]
    return mix(acc)


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """For each ``w`` consecutive hashes, the place of the smallest, the last of equals."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        x = g[j : j + n]
        less = x <= best
        best[less] = x[less]
        at[less] = j
    return at + np.arange(n)
