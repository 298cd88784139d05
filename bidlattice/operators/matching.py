"""Matching of company names across registers: folded keys, candidates by blocks that stay small, and merged groups.

Two names match if their keys are equal, or if their keys differ in one word alone, a word of letters only, by one
letter left out, put in or exchanged. A name's key has its words in order, without marks, legal forms and what stands
before a trade-name clause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import stored

#: Words that say what legal form a company has, and words that join others.
FORMS = ("ltd", "limited", "inc", "incorporated", "corp", "corporation", "co", "company", "llc", "ulc", "lp", "llp", "ltee", "enr", "the", "and")
#: What opens a trade name; the name is what comes after the last of them.
CLAUSES = r"^.*\b(?:dba|d/b/a|o/a|doing business as|operating as|trading as)\b[:\s]*"
SHORT = 4  # letters of a word that may differ, at least


def key(name) -> Column:
    """The sorted distinct words of a name that tell it from others; all of its words where that leaves none."""
    text = X.canonical(name)
    trade = F.regexp_replace(text, CLAUSES, "")
    text = F.when(trade != "", trade).otherwise(text)
    words = lambda t: F.filter(F.split(F.regexp_replace(t, r"(?<=\p{L})[.'’](?=\p{L}\b)", ""), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    own = F.filter(words(text), lambda w: ~w.isin(*FORMS))
    return F.array_sort(F.array_distinct(F.when(F.size(own) > 0, own).otherwise(words(text))))


def _variants(word: Column) -> Column:
    """The word, and the word without each of its letters: words one edit apart share one of these."""
    gone = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), gone))


def similar_keys(keys: DataFrame) -> DataFrame:
    """(a, b): pairs a < b of ``keys`` (id, words) that differ in one word by one letter.

    A key is blocked by the rest of its words and a variant of the word left out. However many keys share the rest, a
    block holds only words that come from one variant by putting one letter in, so pairs are few for each of them."""
    each = keys.select("id", "words", F.explode("words").alias("word")).filter(F.col("word").rlike(r"^\p{L}+$") & (F.length("word") >= SHORT))
    blocks = each.select("id", "word", F.array_join(F.array_remove("words", F.col("word")), " ").alias("rest"), F.explode(_variants(F.col("word"))).alias("variant")).filter("rest <> ''")
    a, b = (blocks.select("rest", "variant", F.col("id").alias(i), F.col("word").alias(f"{i}_word")) for i in ("a", "b"))
    return a.join(b, ["rest", "variant"]).filter("a < b").filter(F.levenshtein("a_word", "b_word") == 1).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of the ids of ``edges`` (a, b): root is the smallest id that is reached.

    Every round an id takes the smallest root among its neighbours', and then that root's root, so rounds grow with the
    logarithm of the longest chain; roots of neighbours combine before the shuffle."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(roots.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = stored(roots.join(near, "id").select("id", "root", F.least("root", "near").alias("new")), "roots")
        jump = step.join(step.select(F.col("id").alias("new"), F.col("new").alias("far")), "new", "left")
        jump = stored(jump.select("id", "root", F.least("new", F.coalesce("far", "new")).alias("new")), "roots")
        moved = jump.filter("new <> root").limit(1).count()
        roots = jump.select("id", F.col("new").alias("root"))
        if not moved:
            return roots


def matched(names: DataFrame) -> DataFrame:
    """(id, name, register, match) of ``names`` (id, name, register): match is the smallest id of those that are the same company.

    Equal keys are one key before anything else, so a name that very many rows have is compared once. A row whose name
    is null or without words matches none but itself. Ids must be unique."""
    rows = names.select("id", "name", "register", key("name").alias("words"))
    keyed = stored(rows.filter("size(words) > 0").groupBy("words").agg(F.min("id").alias("id")), "keys")
    groups = components(similar_keys(keyed))
    heads = stored(keyed.join(groups, "id", "left").select("words", F.coalesce("root", "id").alias("match")), "heads")
    return rows.join(heads, "words", "left").select("id", "name", "register", F.coalesce("match", "id").alias("match"))


def merged(names: DataFrame) -> DataFrame:
    """(match, name, aliases, registers, rows) of each company: the name of its smallest id, its other names and its registers in
    order, and how many rows it has. Names and registers are distinct before they are put together."""
    m = stored(matched(names), "matched")
    some = m.select("match", F.explode(F.array(F.struct(F.lit(0).alias("what"), F.col("name").alias("text")), F.struct(F.lit(1).alias("what"), F.col("register").alias("text")))).alias("x")).select("match", "x.*").distinct()
    lists = some.groupBy("match").agg(F.array_sort(F.collect_list(F.when(F.col("what") == 0, F.col("text")))).alias("names"), F.array_sort(F.collect_list(F.when(F.col("what") == 1, F.col("text")))).alias("registers"))
    heads = m.groupBy("match").agg(F.min_by("name", "id").alias("name"), F.count("*").alias("rows"))
    return heads.join(lists, "match").select("match", "name", F.filter("names", lambda x: ~x.eqNullSafe(F.col("name"))).alias("aliases"), "registers", "rows")
