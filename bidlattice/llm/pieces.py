"""Cuts texts at spaces that no tokenizer token crosses, and encodes each distinct piece once.

A cut stands before a space (or line end) that has a non-space character on both sides, or before a mark
that follows an ASCII letter. The byte-level and word BPE
files here split words by a pattern of which no alternative matches a non-space character followed by
white space, and the sentencepiece file has no piece with a space marker after another character, so
pieces are encoded independently of each other in all three.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

CACHE_PIECES = 700_000  # distinct pieces of one generation of a worker's table

_BYTE = np.arange(256)
#: Bytes that may end a white-space character, or begin one; a cut next to them is left out, which is always safe.
_BEFORE = (_BYTE > 0x20) & (_BYTE < 0x7F)
_LETTER = ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
_AFTER = _BEFORE | ((_BYTE >= 0xC3) & (_BYTE != 0xE1) & (_BYTE != 0xE2) & (_BYTE != 0xE3))


def cuts(data: np.ndarray, offsets: np.ndarray, breaks: bytes = b" ", marks: bytes = b"") -> np.ndarray:
    """Places that begin a new piece: a byte of ``breaks`` between two non-space characters, or one of ``marks`` after an ASCII letter."""
    kind = np.zeros(256, np.uint8)
    kind[list(breaks)] = 1
    kind[list(marks)] = 2
    of = kind[data]
    of[offsets[offsets < len(data)]] = 0  # neither the first nor the last byte of a text
    of[offsets[offsets > 0] - 1] = 0
    at = np.flatnonzero(of)
    if not len(at):
        return at
    before = data[at - 1]
    ok = _BEFORE[before]
    wide = before >= 0x80
    if wide.any():
        two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        space = (two == 0xC2) | (((three == 0xE1) | (three == 0xE2) | (three == 0xE3)) & (two >= 0x80))
        ok |= wide & ~space
    return at[np.where(of[at] == 1, ok & _AFTER[data[at + 1]], _LETTER[before])]


def split(data: np.ndarray, offsets: np.ndarray, breaks: bytes = b" ", marks: bytes = b"") -> tuple[pa.Array, np.ndarray]:
    """All pieces in order, and for each text the place of its first piece (n + 1 places)."""
    mark = np.zeros(len(data) + 1, bool)
    mark[cuts(data, offsets, breaks, marks)] = True
    mark[offsets] = True
    at = np.flatnonzero(mark)
    n = len(at) - 1
    array = pa.LargeStringArray.from_buffers(n, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))) if n > 0 else pa.array([], pa.large_string())
    return array, np.searchsorted(at, offsets)


class Table:
    """The distinct-piece table of one worker: piece to what ``encode`` gives for it.

    Two generations of at most ``most`` pieces: when the young one is full it becomes the old one, and pieces met
    again move back to the young one, so memory is bounded and frequent pieces stay."""

    def __init__(self, encode: Callable[[list[str]], list], most: int = CACHE_PIECES):
        self.encode, self.most, self.young, self.old = encode, most, {}, {}

    def look_up(self, pieces: pa.Array) -> tuple[list, np.ndarray]:
        """The values of the distinct pieces, and each piece's place among them."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.young) + len(distinct) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        again = [x for x in distinct if x not in young and x in old] if old else []
        young.update((x, old[x]) for x in again)
        new = [x for x in distinct if x not in young]
        young.update(zip(new, self.encode(new), strict=True))
        return [young[x] for x in distinct], coded.indices.to_numpy(zero_copy_only=False)


def gather(values: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The joined 32-bit ids ``values[p]`` for each p of ``places``, and the n + 1 offsets of each in them."""
    if not len(places):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    begins = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(values), "<u4")
    n = sizes[places]
    offsets = np.zeros(len(places) + 1, np.int64)
    np.cumsum(n, out=offsets[1:])
    return flat[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - begins[places], n)], offsets


def encoder(tokenizer, separator: str, separator_id: int, word_ends: np.ndarray | None = None) -> Callable[[list[str]], list[bytes]]:
    """Encodes many short pieces in one call of a tokenizers library object: a special token, of which the library
    encodes both sides apart, stands between them. Pieces that could hold part of a special token go one by one.

    ``word_ends``: for models that drop white space and mark the last token of each word, which ids are marked. Runs
    of Latin letters are then one word each and need only spaces between them, if as many marks come back."""

    def special(pieces: list[str]) -> list[bytes]:
        return cut(tokenizer.encode(separator.join(pieces), add_special_tokens=False).ids, lambda ids: np.append(np.flatnonzero(ids == separator_id), len(ids)), 1)

    def cut(ids: list[int], ends, skip: int) -> list[bytes]:
        ids = np.array(ids, "<u4")
        ends = ends(ids)
        begins = np.append(0, ends[:-1] + skip)
        raw = ids.tobytes()
        return [raw[b:e] for b, e in zip((begins * 4).tolist(), (ends * 4).tolist(), strict=True)]

    def spaced(pieces: list[str]) -> list[bytes]:
        found = cut(tokenizer.encode(" ".join(pieces), add_special_tokens=False).ids, lambda ids: np.flatnonzero(word_ends[ids]) + 1, 0)
        return found if len(found) == len(pieces) else special(pieces)

    def encode(pieces: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        latin, easy = [], []
        for i, x in enumerate(pieces):
            if word_ends is not None and x.strip(" \n").isalpha() and max(x) < "\u0250":
                latin.append(i)
            elif "<|" in x or "|>" in x:
                out[i] = np.array(tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                easy.append(i)
        for places, joined in ((latin, spaced), (easy, special)):
            for lo in range(0, len(places), 4096):
                some = places[lo : lo + 4096]
                for i, b in zip(some, joined([pieces[i] for i in some]), strict=True):
                    out[i] = b
        return out

    return encode
