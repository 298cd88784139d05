"""Benchmark decontamination by winnowed fingerprints whose hits are extended on the words themselves."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import prepare
from . import words

SPAN = 10  # shared words that count, or a whole shorter item
GRAM = 5  # words in a fingerprint
BLOCK_BYTES = 8 << 20  # of item texts in one block


class Index:
    """Fingerprints of a block of items.

    A group for each length that must be found: SPAN, and each shorter item length. Keeping the smallest k-gram hash
    of every w consecutive ones with k + w - 1 = length puts a kept fingerprint in each shared span of that length."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        data, offsets = words.plain(pa.array([t for _, t in items], pa.large_string()))
        found = words.words(data, offsets, words.ALNUM, lower=True)
        hashes = words.word_hashes(found)
        self.words: list[list[bytes]] = []
        self.need: list[int] = []
        postings: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (a, b) in enumerate(zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True)):
            self.words.append([found.word(i) for i in range(a, b)])
            need = min(SPAN, b - a)
            self.need.append(need)
            if need:
                g = words.grams(hashes[a:b], min(GRAM, need))
                for p in np.unique(words.winnow(g, need - min(GRAM, need) + 1)).tolist():
                    postings[need][int(g[p])].append((k, p))
        self.groups = {n: (np.array(sorted(x), np.uint64), dict(x)) for n, x in postings.items()}


def _extend(index: Index, doc: words.Words, a: int, b: int, need: int, hits: list[tuple[int, int]], spans: list, items: set) -> None:
    """Extends each hit (fingerprint, place) of the text with words a to b along its diagonal as far as words agree."""
    _, postings = index.groups[need]
    done: dict[tuple[int, int], int] = {}
    text: dict[int, bytes] = {}

    def word(i: int) -> bytes:
        if i not in text:
            text[i] = doc.word(i)
        return text[i]

    for f, p in hits:
        for k, q in postings[f]:
            diagonal = (k, p - q)
            if done.get(diagonal, -1) > p:
                continue
            item = index.words[k]
            left, right = 0, 0
            while p - left > a and q - left > 0 and word(p - left - 1) == item[q - left - 1]:
                left += 1
            while p + right < b and q + right < len(item) and word(p + right) == item[q + right]:
                right += 1
            done[diagonal] = p + max(right, 1)
            if left + right >= need:
                spans.append((p - left - a, p + right - a))
                items.add(index.ids[k])


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _probe(index: Index, s: words.Text):
    """Number of words, merged hit spans and hit item ids of each text of a slice."""
    doc = words.words(s.data, s.offsets, words.ALNUM, lower=True)
    hashes, stop = words.word_hashes(doc), doc.stop()
    spans: dict[int, list] = defaultdict(list)
    items: dict[int, set] = defaultdict(set)
    for need, (fingerprints, _) in index.groups.items():
        k = min(GRAM, need)
        g = words.grams(hashes, k)
        at = words.winnow(g, need - k + 1)
        at = np.unique(at[np.arange(len(at)) + need <= stop[: len(at)]])
        if not len(at):
            continue
        mine = g[at]
        place = np.minimum(np.searchsorted(fingerprints, mine), len(fingerprints) - 1)
        at = at[fingerprints[place] == mine]
        text = np.searchsorted(doc.bounds, at, "right") - 1
        for t in np.unique(text).tolist():
            some = at[text == t] if len(at) < 64 else at[np.searchsorted(text, t) : np.searchsorted(text, t, "right")]
            _extend(index, doc, int(doc.bounds[t]), int(doc.bounds[t + 1]), need, [(int(g[p]), p) for p in some.tolist()], spans[t], items[t])
    return np.diff(doc.bounds), spans, items


def blocks(items: DataFrame, item_id: str, text: str):
    """The items in blocks of at most BLOCK_BYTES of text (or of one longer item), in the order of their ids."""
    block, size = [], 0
    for r in items.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).filter("i is not null and t is not null").orderBy("i", "t").toLocalIterator():
        if block and size + len(r.t) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    if block:
        yield block


def hit_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, hit_spans (array of word places [start, stop), merged) and hit_items (sorted item ids).

    Words are runs of a-z, 0-9 and all beyond ASCII, after lower-casing A-Z. A shared span is SPAN consecutive words of
    an item, or a whole shorter item; hit_spans cover every word of ``docs`` inside one.
    Texts and items are winnowed alike, and equal fingerprints are joined and extended word by word, so nothing hangs
    on a hash alone. Items are the stated query set: they go out in blocks of at most BLOCK_BYTES, one pass over
    ``docs`` for each block and no shuffle for any. Null or empty texts, and no items, give no words or no hits;
    items with null id or text are left out; extra columns stay, but for those named like the three new ones."""
    spark = docs.sparkSession
    prepare(spark)
    out = docs.drop("n_words", "hit_spans", "hit_items")
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.lit(None).cast("array<struct<start:int,stop:int>>"), "hit_items": F.lit(None).cast("array<long>")})
    schema = out.schema

    def one(index, names):
        def run(batches):
            for s in words.slices(batches, text, doc_id):
                n, spans, found = _probe(index.value, s)
                old_spans, old_items = s.rows.column("hit_spans"), s.rows.column("hit_items")
                new_spans, new_items = [], []
                for t in range(len(n)):
                    a, b = old_spans[t].as_py() if old_spans[t].is_valid else [], old_items[t].as_py() if old_items[t].is_valid else []
                    if t in spans:
                        a = [{"start": x, "stop": y} for x, y in _merge([*((r["start"], r["stop"]) for r in a), *spans[t]])]
                        b = sorted({*b, *found[t]})
                    new_spans.append(a)
                    new_items.append(b)
                values = {"n_words": pa.array(n, pa.int64()), "hit_spans": pa.array(new_spans, old_spans.type), "hit_items": pa.array(new_items, old_items.type)}
                yield pa.RecordBatch.from_arrays([values[c] if c in values else s.rows.column(c) for c in names], names=names)

        return run

    waiting = None  # the last pass alone may leave the text out
    for block in blocks(items, item_id, item_text):
        if waiting is not None:
            out = out.mapInArrow(one(waiting, schema.names), schema)
        waiting = spark.sparkContext.broadcast(Index(block))
    names = [c for c in schema.names if keep_text or c != text]
    last = spark.sparkContext.broadcast(Index([])) if waiting is None else waiting
    return out.mapInArrow(one(last, names), StructType([schema[c] for c in names]))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hit = hit_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda t, x: t + (x.stop - x.start).cast("long"))
    names = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    out = hit.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select distinct item_id, k, array_to_string(w[i : i + k - 1], ' ') as t from (select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
dw as (select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as t from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from iw))),
hit as (select doc_id, i, dw.k, item_id from dw join iw on dw.k = iw.k and dw.t = iw.t),
pos as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(i, i + k)) as p from hit) group by 1),
its as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as s from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(pos.n, 0)::bigint as n_hit, coalesce(its.n, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(pos.n, 0) > 0 as contaminated
from d left join pos on pos.doc_id = d.doc_id left join its on its.doc_id = d.doc_id
"""
