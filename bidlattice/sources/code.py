"""Indexing of source trees into a code graph, and queries on it."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..operators.search import bm25
from ..plans import schema
from ..session import prepare, stored
from ..streaming import versions
from . import parsers


def _hidden(spark: SparkSession, root: str) -> list[tuple[str, bytearray]]:
    """Dot files and files under dot folders, which Spark's readers pass over: settings and workflows, a few small files."""
    jvm, out = spark._jvm, []
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    todo = [(top, "", False)]
    while todo:
        at, name, inside = todo.pop()
        for s in fs.listStatus(at):
            own = s.getPath().getName()
            dotted = inside or own.startswith(".")
            if s.isDirectory():
                if own not in parsers.IGNORED and not own.endswith(parsers.IGNORED_SUFFIX):
                    todo.append((s.getPath(), f"{name}{own}/", dotted))
            elif dotted and s.getLen() <= parsers.MOST_BYTES and parsers.language(own):
                stream = fs.open(s.getPath())
                out.append((f"{name}{own}", bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
                stream.close()
    return sorted(out)


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(regular expression, whether it ignores) of each line of an ignore file, in order; the last that fits a path decides.

    A pattern with a slash that isn't its last character is bound to the root, others fit at any depth; a last slash
    fits folders alone. ``*`` and ``?`` stay in one folder, ``**`` doesn't."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
        folder, bound = line.endswith("/"), "/" in line.rstrip("/")
        parts = []
        for m in re.finditer(r"\*\*/|/\*\*$|\*\*|\*|\?|\[!?[^\]]*\]|\\?(.)", line.strip("/"), re.S):
            parts.append({"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m[0]) or (re.escape(m[1]) if m[1] else m[0].replace("[!", "[^", 1)))
        out.append((("^" if bound else "(?:^|/)") + "".join(parts) + ("/" if folder else "(?:/|$)"), not back))
    return out


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, hash) of all files of known kinds up to 512 KB outside ignored folders and those that the root's
    ignore file leaves out; paths are relative to ``root``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= parsers.MOST_BYTES)
    base = root.rstrip("/").removeprefix("file:").rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^/*" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base.lstrip("/")) + "/", "")
    hidden = spark.createDataFrame(_hidden(spark, root), "path string, content binary")
    out = found.select(path.alias("path"), "content").unionByName(hidden).withColumn("hash", F.md5("content"))
    skip = "(^|/)(" + "|".join(re.escape(x) for x in parsers.IGNORED) + "|[^/]*" + re.escape(parsers.IGNORED_SUFFIX) + ")/"
    known = r"(?i)(\.(" + "|".join(parsers.LANGUAGES) + r")|(^|/)\.env[^/]*)$"
    ignored = F.lit(False)
    for rule, ignores in ignore_rules(_text(spark, f"{root.rstrip('/')}/.gitignore")):
        ignored = F.when(F.col("path").rlike(rule), ignores).otherwise(ignored)
    return out.filter(~F.col("path").rlike(skip) & F.col("path").rlike(known) & ~ignored)


def _text(spark: SparkSession, path: str) -> str:
    """A small text file, empty if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return ""
    stream = fs.open(at)
    out = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    stream.close()
    return out


_PARSED = "file_path string, hash string, entities array<struct<kind:string,name:string,qualified_name:string,line_start:int,line_end:int,signature:string,docstring:string>>, relations array<struct<source:string,kind:string,target:string,line:int,resolved:boolean>>"


def parsed_files(found: DataFrame) -> DataFrame:
    """(file_path, hash, entities, relations) of ``found`` (path, content, hash): whole files, in Python workers."""
    prepare(found.sparkSession)

    def run(batches):
        for b in batches:
            rows = [parsers.parse(p, c.decode("utf-8", "replace")) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)]
            e = [[dict(zip(("kind", "name", "qualified_name", "line_start", "line_end", "signature", "docstring"), x, strict=True)) for x in es] for es, _ in rows]
            r = [[dict(zip(("source", "kind", "target", "line", "resolved"), x, strict=True)) for x in rs] for _, rs in rows]
            entity = pa.struct([("kind", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("signature", pa.string()), ("docstring", pa.string())])
            relation = pa.struct([("source", pa.string()), ("kind", pa.string()), ("target", pa.string()), ("line", pa.int32()), ("resolved", pa.bool_())])
            yield pa.RecordBatch.from_arrays([b.column("path").cast(pa.string()), b.column("hash").cast(pa.string()), pa.array(e, pa.list_(entity)), pa.array(r, pa.list_(relation))], ["file_path", "hash", "entities", "relations"])

    return found.mapInArrow(run, _PARSED)


def index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of a source tree: parsed by whole files, references resolved by joins."""
    return resolved(stored(parsed_files(files(spark, root)), "parsed"))


def refresh(spark: SparkSession, root: str, folder: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """``index`` of a tree whose parsed files are kept in ``folder``, and how many files were parsed, kept and dropped.

    Only files whose content is not known by its hash are parsed; references are resolved anew over all of them, so an
    edge to what another file gained or lost is right. A new version is written beside the old one and named last."""
    kept = versions.read(spark, folder)
    known = spark.read.parquet(kept["parsed"]) if kept else spark.createDataFrame([], _PARSED)
    now = stored(files(spark, root), "files")
    same = known.join(now.select(F.col("path").alias("file_path"), "hash"), ["file_path", "hash"], "left_semi")
    fresh = parsed_files(now.join(known.select(F.col("file_path").alias("path"), "hash"), ["path", "hash"], "left_anti").select("path", "content", "hash"))
    number, at = (kept["version"] if kept else 0) + 1, f"{folder}/parsed-{uuid.uuid4().hex}"
    same.select(known.columns).unionByName(fresh).write.parquet(at)
    versions.commit(spark, folder, number, {"parsed": at})
    parsed = spark.read.parquet(at)
    again = parsed.join(known.select("file_path", "hash"), ["file_path", "hash"], "left_semi").count()
    counts = {"parsed": parsed.count() - again, "kept": again, "dropped": known.join(now.select(F.col("path").alias("file_path")), "file_path", "left_anti").count()}
    return *resolved(parsed), counts


def resolved(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of parsed files.

    A reference finds the entity of its qualified name, else, of entities whose name is its last part, the one of smallest
    qualified name; what stays unknown keeps the name as its target."""
    none = F.create_map().cast("map<string,string>")
    e = parsed.select("file_path", F.explode("entities").alias("e")).select("file_path", "e.*")
    language = F.create_map(*[F.lit(x) for k, v in parsers.LANGUAGES.items() for x in (k, v)])
    e = e.withColumn("id", F.substring(F.sha2(F.concat_ws(":", "kind", "qualified_name"), 256), 1, 16)).withColumn("language", F.try_element_at(language, F.lower(F.substring_index("file_path", ".", -1))))
    w = Window.partitionBy("id").orderBy("file_path", "line_start")
    e = e.withColumn("_r", F.row_number().over(w)).filter("_r = 1").withColumn("extra", none)
    entities = stored(e.select([c.split()[0] for c in schema.CODE_ENTITY.replace("map<string,string>", "map").split(", ")]), "code")
    r = parsed.select("file_path", F.explode("relations").alias("r")).select("file_path", "r.*")
    exact = entities.groupBy(F.col("qualified_name").alias("q")).agg(F.min("id").alias("exact_id"))
    last = entities.groupBy(F.col("name").alias("n")).agg(F.min_by("id", "qualified_name").alias("last_id"))
    sources = exact.select(F.col("q").alias("source"), F.col("exact_id").alias("source_id"))
    r = r.join(sources, "source").join(exact, F.col("target") == F.col("q"), "left").join(last, F.substring_index("target", ".", -1) == F.col("n"), "left")
    target = F.coalesce("exact_id", "last_id", F.concat(F.lit("?"), F.col("target")))
    r = r.withColumn("target_id", target).withColumn("id", F.substring(F.sha2(F.concat_ws(":", "source_id", "kind", target), 256), 1, 16))
    r = r.groupBy("id", "source_id", "target_id", "kind").agg(F.min("file_path").alias("file_path"), F.min("line").alias("line"), F.count("*").cast("double").alias("weight")).withColumn("extra", none)
    return entities, stored(r.select("id", "source_id", "target_id", "kind", "file_path", "line", "weight", "extra"), "code-relations")


def reindex(entities: DataFrame, relations: DataFrame, new_entities: DataFrame, new_relations: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after the files ``paths`` (file_path) were parsed again: their old rows go, and edges to what went with them."""
    gone = entities.join(paths, "file_path", "left_semi").select("id").join(new_entities.select("id"), "id", "left_anti")
    e = entities.join(paths, "file_path", "left_anti").unionByName(new_entities)
    r = relations.join(paths, "file_path", "left_anti").unionByName(new_relations)
    for end in ("source_id", "target_id"):
        r = r.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return e, r.dropDuplicates(["id"])


class CodeGraph:
    """Queries on code entities and relations."""

    def __init__(self, entities: DataFrame, relations: DataFrame):
        self.entities, self.relations = entities, relations

    def find(self, name_glob: str | None = None, kind: str | None = None, path_glob: str | None = None, language: str | None = None) -> DataFrame:
        out = self.entities
        for column, pattern in (("name", name_glob), ("file_path", path_glob)):
            if pattern:
                out = out.filter(F.col(column).rlike(X.glob_regex(pattern)))
        for column, value in (("kind", kind), ("language", language)):
            if value:
                out = out.filter(F.col(column) == value)
        return out.orderBy("qualified_name", "id")

    def search(self, query: str, kinds: list[str] | None = None, limit: int = 20) -> DataFrame:
        text = self.entities.select("id", F.concat_ws(" ", "name", F.regexp_replace("qualified_name", r"[._:/#]", " "), "docstring").alias("t"))
        hits = bm25(text, "id", "t", query).withColumnRenamed("key", "id")
        names = self.entities.filter(F.col("name").contains(query)).select("id", F.lit(0.0).alias("score"))
        best = hits.unionByName(names).groupBy("id").agg(F.max("score").alias("score")).join(self.entities, "id").orderBy(F.desc("score"), "qualified_name").limit(limit)
        return best.filter(F.col("kind").isin(*kinds)) if kinds else best

    def outline(self, path: str) -> DataFrame:
        """(file_path, entities): of files whose path holds ``path``, in the order of lines."""
        rows = self.entities.filter(F.col("file_path").contains(path))
        return rows.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("line_start", "kind", "name", "qualified_name", "signature"))).alias("entities"))

    def walk(self, qualified_name: str, kind: str, backwards: bool = False, depth: int = 10) -> DataFrame:
        """(id, depth): what is reached from a name by edges of one kind, each entity once with its first depth."""
        a, b = ("target_id", "source_id") if backwards else ("source_id", "target_id")
        edges = self.relations.filter(F.col("kind") == kind).select(F.col(a).alias("id"), F.col(b).alias("next")).distinct()
        front = seen = stored(self.entities.filter(F.col("qualified_name") == qualified_name).select("id", F.lit(0).alias("depth")), "walk")
        for d in range(1, depth + 1):
            near = front.join(edges, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti")
            front = stored(near.withColumn("depth", F.lit(d)), "walk")
            if not front.limit(1).count():
                break
            seen = seen.unionByName(front)
        return seen.filter("depth > 0").join(self.entities, "id")

    def callers(self, qualified_name: str, depth: int = 1) -> DataFrame:
        return self.walk(qualified_name, "calls", True, depth)

    def callees(self, qualified_name: str, depth: int = 1) -> DataFrame:
        return self.walk(qualified_name, "calls", False, depth)

    def inheritance(self, qualified_name: str) -> tuple[DataFrame, DataFrame]:
        """Ancestors and descendants."""
        return self.walk(qualified_name, "inherits"), self.walk(qualified_name, "inherits", True)

    def imports(self, path: str) -> DataFrame:
        r = self.relations.filter(F.col("file_path").contains(path) & F.col("kind").isin("imports", "re_exports"))
        return r.select("kind", "target_id", F.coalesce("line", F.lit(0)).alias("line")).orderBy("line", "target_id")

    def tables(self) -> DataFrame:
        """(table, columns)."""
        t = self.entities.filter("kind = 'sql_table'").select(F.col("id").alias("source_id"), F.col("name").alias("table"))
        c = self.relations.filter("kind = 'contains'").join(self.entities.filter("kind = 'sql_column'").select(F.col("id").alias("target_id"), F.col("name").alias("column")), "target_id")
        return t.join(c.select("source_id", "column"), "source_id", "left").groupBy("table").agg(F.array_sort(F.collect_list("column")).alias("columns"))

    def table_usage(self, table: str) -> DataFrame:
        t = self.entities.filter((F.col("kind") == "sql_table") & (F.col("name") == table)).select(F.col("id").alias("target_id"))
        use = self.relations.filter(F.col("kind").isin("uses_table", "writes_column", "reads_column")).join(t, "target_id", "left_semi")
        return use.join(self.entities.select(F.col("id").alias("source_id"), "qualified_name"), "source_id").select("qualified_name", F.col("kind").alias("usage"), "line")

    def routes(self) -> DataFrame:
        return self.entities.filter("kind = 'api_route'").select("name", "file_path", "line_start").orderBy("name", "file_path")

    def subgraph(self, qualified_name: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        """Entities expanded within ``depth`` rounds, and all edges at them, each once."""
        r = self.relations
        both = r.select(F.col("source_id").alias("id"), F.col("target_id").alias("next")).unionByName(r.select(F.col("target_id").alias("id"), F.col("source_id").alias("next")))
        seen = stored(self.entities.filter(F.col("qualified_name") == qualified_name).select("id"), "subgraph")
        for _ in range(depth - 1):
            seen = stored(seen.unionByName(seen.join(both, "id").select(F.col("next").alias("id"))).distinct(), "subgraph")
        edges = r.join(seen.withColumnRenamed("id", "source_id"), "source_id", "left_semi").unionByName(r.join(seen.withColumnRenamed("id", "target_id"), "target_id", "left_semi"))
        return self.entities.join(seen, "id", "left_semi"), edges.dropDuplicates(["id"])

    def context_pack(self, task: str, budget: int = 4000) -> DataFrame:
        """(rank, qualified_name, text, tokens): entities that suit a task, best first, as long as their tokens fit the budget."""
        words = [w for w in {x.lower() for x in task.replace("_", " ").split()} if len(w) > 2]
        e = self.entities
        over = lambda c: sum([F.coalesce(F.lower(c).contains(w), F.lit(False)).cast("int") for w in words], F.lit(0))
        bonus = F.when(F.col("kind").isin("function", "method"), 2.0).when(F.col("kind") == "class", 1.5).otherwise(0.0)
        hit = 3 * over(F.col("name")) + over(F.col("docstring"))
        text = F.concat_ws(" ", "kind", "qualified_name", "signature", F.substring("docstring", 1, 80))
        best = e.withColumn("hit", hit).filter("hit > 0").select("qualified_name", "id", (F.col("hit") + bonus).alias("score"), text.alias("text"), F.floor(F.length(text) / 4).alias("tokens"))
        w = Window.orderBy(F.desc("score"), "qualified_name", "id")
        best = best.orderBy(F.desc("score"), "qualified_name", "id").limit(budget)  # no more entities can fit
        return best.withColumn("rank", F.row_number().over(w)).withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("used") <= budget).select("rank", "qualified_name", "text", "tokens")

    def statistics(self) -> DataFrame:
        return self.entities.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("entities"), F.count_distinct("file_path").alias("files"))
