"""Stored graphs under several sources and writers, and what a load costs."""

import pytest
from pyspark.sql import functions as F

from bidlattice.operators import store
from bidlattice.operators.views import Graph
from bidlattice.sources import files
from bidlattice.streaming import incremental, versions

from .test_store import NONE, entities, relations, table


def companies(spark, *names, **attributes):
    return files.Delta(entities(spark, *[("company", n, attributes or NONE, "x", 1.0) for n in names]), relations(spark), relations(spark))


def edge(kind, source, relation, target_kind, target, confidence=1.0):
    return (kind, source, relation, target_kind, target, NONE, "x", confidence, None, None)


def size(spark, path):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def test_two_sources_a_new_checkpoint_and_a_vacuum_between(spark, tmp_path):
    target, schema = f"file://{tmp_path}/graph", "name string"
    to_delta = lambda batch: companies(spark, *[r.name for r in batch.collect()])
    put = lambda source, *names: spark.createDataFrame([(n,) for n in names], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{source}")
    run = lambda source, check: incremental.import_files(spark, f"file://{tmp_path}/{source}", schema, target, f"file://{tmp_path}/{check}", to_delta, "2024-01-01")
    put("a", "Alpha")
    put("b", "Beta")
    assert run("a", "check-a") == 1 and run("b", "check-b") == 2
    put("a", "Gamma")
    assert run("a", "check-a") == 3 and run("a", "check-a") == 3  # nothing new
    incremental.vacuum(spark, target, 1)
    put("b", "Delta")
    assert run("b", "check-new") == 4
    found = table(incremental.current(spark, target).entities, "uid", "name")
    assert [n for _, n in found] == ["Alpha", "Beta", "Gamma", "Delta"] and len({u for u, _ in found}) == 4
    assert len(versions.read(spark, target)["sources"]) == 3


def test_a_batch_whose_load_was_committed_is_not_loaded_again(spark, tmp_path, monkeypatch):
    target, source, check = (f"file://{tmp_path}/{x}" for x in ("graph", "in", "check"))
    spark.createDataFrame([("A",)], "name string").write.parquet(source)
    done = incremental.append

    def crash(*a, **k):
        done(*a, **k)
        raise OSError("after the commit")

    with monkeypatch.context() as m, pytest.raises(Exception, match="after the commit"):
        m.setattr(incremental, "append", crash)
        incremental.import_files(spark, source, "name string", target, check, lambda b: companies(spark, "A"), "2024-01-01")
    assert incremental.import_files(spark, source, "name string", target, check, lambda b: companies(spark, "A"), "2024-01-02") == 1
    assert incremental.history(spark, target).count() == 1


def test_writers_at_once(spark, tmp_path):
    target = f"file://{tmp_path}/graph"
    incremental.append(spark, target, companies(spark, "Old"), "2024-01-01")
    one = incremental.prepare(spark, target, companies(spark, "New one", "Old", a="1"), "2024-01-02")
    two = incremental.prepare(spark, target, companies(spark, "Other"), "2024-01-02")
    three = incremental.prepare(spark, target, companies(spark, "Old", "Third", a="3", b="3"), "2024-01-03")
    assert incremental.commit(spark, target, one)["version"] == 2
    assert incremental.commit(spark, target, two)["version"] == 3  # other keys: side by side
    assert incremental.commit(spark, target, three) is None  # Old has changed: it is merged again, after that
    assert incremental.append(spark, target, companies(spark, "Old", "Third", a="3", b="3"), "2024-01-03")["version"] == 4
    g = incremental.current(spark, target)
    rows = {r.name: r for r in g.entities.collect()}
    assert len({r.uid for r in rows.values()}) == len(rows) == g.entities.count() == 4
    assert rows["Old"].uid == "CMP-00000001" and rows["Old"].attributes == {"a": "3", "b": "3"} and rows["Old"].created_at == "2024-01-01"
    seq = [r.seq for r in incremental.history(spark, target).orderBy("seq").collect()]
    assert seq == list(range(1, 7))
    with pytest.raises(FileExistsError):
        versions.commit(spark, target, 4, {})
    assert versions.lease(spark, target, "n/x", 5) == 1 and versions.lease(spark, target, "n/x", 2) == 6 and versions.lease(spark, target, "n/x", 1, 20) == 21


def test_a_load_that_rests_on_aliases_is_made_anew(spark, tmp_path):
    target = f"file://{tmp_path}/graph"
    incremental.append(spark, target, companies(spark, "Acme"), "2024-01-01")
    d = files.Delta(entities(spark, ("tender", "Road", NONE, "x", 1.0)), relations(spark, edge("company", "Acme Old", "awarded_to", "tender", "Road")), relations(spark))
    p = incremental.prepare(spark, target, d, "2024-01-02")
    alias = files.Delta(entities(spark, ("company_alias", "Acme Old", NONE, "x", 1.0)), relations(spark, edge("company_alias", "Acme Old", "alias_of", "company", "Acme")), relations(spark))
    incremental.append(spark, target, alias, "2024-01-02")
    assert incremental.commit(spark, target, p) is None
    assert incremental.append(spark, target, d, "2024-01-02")["load"]["rejected"] == 0
    assert table(incremental.current(spark, target).edges("awarded_to"), "source_uid", "target_uid") == [("CMP-00000001", "TEN-00000002")]


def _mixed(spark, lo, hi):
    """Companies by name and by scraper id, aliases, tenders and edges, in chunks that meet those before."""
    e, r = [], []
    for i in range(lo, hi):
        e += [("company", f"C{i % 40}", {"k": str(i)}, "x", (i % 7) / 7), ("tender", f"T{i}", {"v": str(i)}, None, 1.0), ("company", f"S{i}", {"scraper_id": str(i % 25)}, "y", 0.5)]
        r += [edge("company", f"c{(i * 3) % 40}", "awarded_to", "tender", f"t{i}", (i % 5) / 5), edge("company", f"A{i % 9}", "submitted_bid", "tender", f"T{i // 2}")]
        if i % 5 == 0:
            e.append(("company_alias", f"A{i % 9}", {"scraper_id": f"a{i % 9}"}, "x", 1.0))
            r.append(edge("company_alias", f"A{i % 9}", "alias_of", "company_alias" if i % 10 else "company", f"A{(i + 1) % 9}" if i % 10 else f"C{i % 40}"))
    return files.Delta(entities(spark, *e), relations(spark, *r), relations(spark))


def test_loads_by_parts_equal_merges_of_the_whole_graph(spark, tmp_path):
    target = f"file://{tmp_path}/graph"
    incremental.create(spark, target, 3)
    g, cuts = store.empty(spark), [0, 30, 34, 60]
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        d, day = _mixed(spark, lo, hi), f"2024-01-0{k + 1}"
        m = store.load(g, d.entities, d.relations, day)
        g = Graph(m.entities, m.relations, day)
        names = incremental.append(spark, target, d, day)
        assert names["load"]["rejected"] == m.rejected.count()
        if k == 1:
            assert incremental.compact(spark, target, 0.0) > 0
    now = incremental.current(spark, target)
    for mine, theirs in ((now.entities, g.entities), (now.relations, g.relations)):
        columns = [F.col(c) if c != "attributes" else F.to_json(F.array_sort(F.map_entries(c))).alias(c) for c in theirs.columns]
        assert table(mine.select(columns), *theirs.columns) == table(theirs.select(columns), *theirs.columns)
    before = incremental.history(spark, target).count()
    assert incremental.compact(spark, target, 0.0, 2) > 0 and incremental.history(spark, target).count() == before
    assert [r.seq for r in incremental.history(spark, target).orderBy("seq").collect()] == list(range(1, before + 1))
    assert incremental.vacuum(spark, target, 1) > 0
    assert table(incremental.current(spark, target).entities, "uid", "name") == table(g.entities, "uid", "name")
    parts = versions.read(spark, target)["entities"]
    assert all(len(loads) == 1 for loads in parts.values())


def test_a_page_writes_what_it_changes_whatever_the_graph_holds(spark, tmp_path):
    written = []
    for n in (50, 5000):
        target = f"file://{tmp_path}/graph{n}"
        rows = spark.range(n).select("id", F.lit("company").alias("kind"), F.concat(F.lit("Company "), "id").alias("name"), F.create_map().cast("map<string,string>").alias("attributes"), F.lit("x").alias("source"), F.lit(1.0).alias("confidence")).withColumnRenamed("id", "seq")
        incremental.append(spark, target, files.Delta(rows, relations(spark), relations(spark)), "2024-01-01")
        before = size(spark, target)
        page = files.Delta(entities(spark, *[("company", f"Company {i}", {"k": "v"}, "x", 1.0) for i in range(5)]), relations(spark, edge("company", "Company 1", "works_with", "company", "Company 2")), relations(spark))
        assert incremental.append(spark, target, page, "2024-01-02")["load"] == {"entities_created": 0, "entities_updated": 5, "relations_created": 1, "rejected": 0}
        written.append(size(spark, target) - before)
        assert incremental.current(spark, target).nodes("company").filter("attributes['k'] = 'v'").count() == 5
    assert written[1] < 1.25 * written[0]
