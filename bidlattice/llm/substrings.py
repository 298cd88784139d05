"""Substring dedup: blocks cut by content, equal blocks joined with an index of reference blocks, and other blocks of a
shared anchor compared window by window. Stands in for greedy factoring, which needs a product of two hot groups."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dropped, prepare, stored
from . import words

WINDOW = 20  # consecutive words that count as a duplicate
GRAM = 4  # words of an anchor
_LAST = np.iinfo(np.int64).max


def _place(start: np.ndarray, tag: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A block's first window, its text's 16-bit tag and its number of windows in one integer."""
    return (start.astype(np.int64) << 24) | (tag.astype(np.int64) << 8) | n.astype(np.int64)


class _Slice:
    """Word and window hashes of one slice of texts."""

    def __init__(self, s: words.Text):
        self.words = words.words(s.data, s.offsets, words.NON_SPACE)
        self.bounds = self.words.bounds
        self.hashes, others = words.word_digests(self.words).T  # anchors are made of the first, blocks and windows of the second
        n = len(self.hashes)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(others * words._powers(words._R, n), out=self.total[1:])
        self.back = words._powers(words._R_INV, n + 1)
        sums = self.total[self.bounds[1:]] - self.total[self.bounds[:-1]]
        self.tags = (words.mix(sums * self.back[self.bounds[:-1]]) & np.uint64(0xFFFF)).astype(np.int64)

    def span(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """A hash of the words from start to stop and of their number."""
        return words.mix((self.total[stop] - self.total[start]) * self.back[start] + (stop - start).astype(np.uint64))

    def blocks(self):
        """(text, first window, number of windows, anchor hash) of each block.

        Each window has an anchor: the smallest hash of GRAM consecutive words in it, the last of equals. A block is a
        run of windows with one anchor, so equal windows have equal anchors, wherever they stand."""
        g = words.grams(self.hashes, GRAM)
        at = words.winnow(g, WINDOW - GRAM + 1)
        n = len(at)
        windows = np.flatnonzero(np.arange(n) + WINDOW <= self.words.stop()[:n])
        anchor = at[windows]
        text = np.searchsorted(self.bounds, windows, "right") - 1
        fresh = np.ones(len(windows), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(windows)))
        return text[first], windows[first], size, g[anchor[first]]


def _keys(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(_LAST).to_numpy(zero_copy_only=False)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _first_of_text(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of each text's first occurrence of each key, in order."""
    order = np.lexsort((np.arange(len(key)), key, text))
    t, k = text[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
    return np.sort(order[new])


def _all_blocks(batches):
    """(anchor, block, doc, place): each text's blocks, each once where it first stands in the text."""
    for s in words.slices(batches):
        x = _Slice(s)
        text, start, size, anchor = x.blocks()
        block = x.span(start, start + size + WINDOW - 1)
        use = _first_of_text(text, block)
        text, start = text[use], start[use]
        place = _place(start - x.bounds[text], x.tags[text], size[use])
        yield pa.RecordBatch.from_arrays([_signed(anchor[use]), _signed(block[use]), pa.array(_keys(s.ids)[text]), pa.array(place)], ["anchor", "block", "doc", "place"])


def _listed(column, k: int, tag: int) -> np.ndarray:
    """The places of row ``k``'s list that belong to the text with this tag."""
    value = column[k]
    if not value.is_valid:
        return np.zeros(0, np.int64)
    places = value.values.to_numpy(zero_copy_only=False)
    return places[((places >> 8) & 0xFFFF) == tag]


def _windows(batches):
    """(anchor, window, doc, place): windows of the listed blocks, each once where it first stands among them in the text."""
    for s in words.slices(batches):
        x = _Slice(s)
        text, start, size, anchor = x.blocks()
        places = _place(start - x.bounds[text], x.tags[text], size)
        column, wanted = s.rows.column("places"), np.zeros(len(places), bool)
        ends = np.searchsorted(text, np.arange(len(s.ids) + 1))
        for k in range(len(s.ids)):
            wanted[ends[k] : ends[k + 1]] = np.isin(places[ends[k] : ends[k + 1]], _listed(column, k, int(x.tags[k])))
        text, start, size, anchor = text[wanted], start[wanted], size[wanted], anchor[wanted]
        if not len(text):
            continue
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text, anchor, at = np.repeat(text, size), np.repeat(anchor, size), np.repeat(start, size) + inner
        window = x.span(at, at + WINDOW)
        use = _first_of_text(text, window)
        text, at = text[use], at[use]
        place = _place(at - x.bounds[text], x.tags[text], np.ones(len(at)))
        yield pa.RecordBatch.from_arrays([_signed(anchor[use]), _signed(window[use]), pa.array(_keys(s.ids)[text]), pa.array(place)], ["anchor", "block", "doc", "place"])


def _removed(x: _Slice, column, k: int) -> np.ndarray:
    """Which words of text ``k`` go: those in listed windows, and in windows that stand earlier in the text itself."""
    a, b = int(x.bounds[k]), int(x.bounds[k + 1])
    n = b - a - WINDOW + 1
    out = np.zeros(b - a, bool)
    if n <= 0:
        return out
    hit = np.ones(n, bool)
    at = np.arange(a, a + n)
    hit[np.unique(x.span(at, at + WINDOW), return_index=True)[1]] = False
    depth = np.zeros(b - a + 1, np.int64)
    places = _listed(column, k, int(x.tags[k]))
    start, size = places >> 24, places & 0xFF
    inside = start + size <= n
    np.add.at(depth, start[inside], 1)
    np.add.at(depth, start[inside] + size[inside] + WINDOW - 1, -1)
    own = np.flatnonzero(hit)
    np.add.at(depth, own, 1)
    np.add.at(depth, own + WINDOW, -1)
    return np.cumsum(depth)[:-1] > 0


def _repeats(found: DataFrame, name: str) -> DataFrame:
    """``found`` (anchor, block, doc, place, more) where several have the block, with ``first``, the smallest doc of them."""
    many = found.groupBy("anchor", "block").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return found.join(stored(many, name), ["anchor", "block"])


_BLOCK = "anchor long, block long, doc long, place long"


def repeated_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, places) of each document with windows that an earlier document has.

    Documents are cut into blocks by content. The first document with a block holds the reference copy, and the index
    of references is the table of distinct blocks. A later document's equal blocks are found by equality; where an anchor
    stands in several different blocks, those and their reference copies are compared window by window. Counts combine
    before shuffles, and a block that very many documents share meets the index in joins that split skew."""
    texts = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(int(_LAST))).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = texts.mapInArrow(_all_blocks, _BLOCK)
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("block").alias("a"), F.max("block").alias("b"))
    shared = stored(anchors.filter("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("several")), "anchors")
    some = stored(found.join(shared, "anchor"), "blocks")
    first = some.groupBy("anchor", "block").agg(F.min("doc").alias("first"))
    judged = some.join(stored(first, "references"), ["anchor", "block"])
    judged = stored(judged.filter("doc > first or several").select("doc", "place", (F.col("doc") > F.col("first")).alias("factor")), "factors")
    dropped(some)
    bounds = judged.filter("not factor").groupBy("doc").agg(F.collect_list("place").alias("places"))  # a document's own blocks
    windows = stored(texts.join(bounds.withColumnRenamed("doc", "doc_id"), "doc_id").mapInArrow(_windows, _BLOCK), "windows")
    late = _repeats(windows, "window-references").filter("doc > first").select("doc", "place")
    return judged.filter("factor").select("doc", "place").unionByName(late).groupBy("doc").agg(F.collect_list("place").alias("places"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """``docs`` with n_words, n_removed and kept: the words that stay, joined by one space; or, with ``digest``, only
    (doc_id, n_words, n_removed, kept_sha256).

    Words are runs of anything but white space, unchanged. A window is WINDOW consecutive words; every word covered by
    a window that also starts earlier, in a document of smaller id or before in the same one, is removed. Windows are
    judged on the input. Null and empty texts have no words and keep the empty text. Null ids count as larger than all
    others; of rows that share an id none is earlier than another, each is only compared with other ids and itself.
    Extra columns stay, but for those named like the new ones."""
    prepare(docs.sparkSession)
    places = stored(repeated_places(docs, doc_id, text), "places")
    mine = docs.drop("n_words", "n_removed", "kept", "_doc", "places")
    id_type = docs.schema[doc_id].dataType.simpleString()
    if digest:
        mine = mine.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
        doc_id, text = "doc_id", "text"
    both = mine.withColumn("_doc", F.coalesce(F.col(doc_id).cast("long"), F.lit(int(_LAST)))).join(places.withColumnRenamed("doc", "_doc"), "_doc", "left")
    names = mine.columns

    def run(batches):
        for s in words.slices(batches, text, doc_id):
            x = _Slice(s)
            column, gone, kept = s.rows.column("places"), [], []
            for k in range(len(s.ids)):
                mask = _removed(x, column, k)
                a = int(x.bounds[k])
                gone.append(int(mask.sum()))
                keep = (a + np.flatnonzero(~mask)).tolist()
                data, starts, ends = x.words.data, x.words.starts, x.words.ends
                raw = data[starts[keep[0]] : ends[keep[-1]]].tobytes() if keep else b""
                kept.append(b" ".join(raw.split()) if len(keep) == len(mask) else b" ".join([data[starts[i] : ends[i]].tobytes() for i in keep]))
            n = pa.array(np.diff(x.bounds), pa.int64())
            if digest:
                yield pa.RecordBatch.from_arrays([s.ids, n, pa.array(gone, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                out = [s.rows.column(c) for c in names] + [n, pa.array(gone, pa.int64()), pa.array([t.decode() for t in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(out, [*names, "n_words", "n_removed", "kept"])

    if digest:
        return both.mapInArrow(run, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string")
    empty = mine.withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept": F.lit("").cast("string")})
    return both.mapInArrow(run, empty.schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digest=True)


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i : i + 19], ' ') as t from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d)),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by t order by doc_id, i) as k from win) where k > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from late),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, string_agg(word, ' ' order by p) as s, count(*) as n from words anti join gone using (doc_id, p) group by 1)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256 from d left join kept on kept.doc_id = d.doc_id
"""
