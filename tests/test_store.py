from pyspark.sql import functions as F

from bidlattice.operators import search, store, traverse
from bidlattice.operators.views import Graph
from bidlattice.session import scratch
from bidlattice.sources import files
from bidlattice.streaming import incremental

NONE = {}


def entities(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], store.ENTITY_DELTA)


def relations(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], store.RELATION_DELTA)


def table(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_upsert_merges_by_canonical_name_and_allocates_uids(spark):
    g = store.empty(spark)
    d = entities(spark, ("company", " Acme  Ltd ", {"a": "1", "b": "1"}, "x", 0.4), ("company", "ACME ltd", {"b": "2"}, None, 0.9), ("tender", "Road", NONE, "x", 1.0), ("company", "Beta", NONE, "x", 1.0), ("planet", "Mars", NONE, "x", 1.0), ("company", "  ", NONE, "x", 1.0))
    r = relations(spark, ("company", "acme LTD", "awarded_to", "tender", "road", {"contract_value": "5"}, "x", 0.5, "2020-01-01", "2021-01-01"), ("company", "acme ltd", "awarded_to", "tender", "Road", {"contract_value": "9"}, None, 0.7, "2022-01-01", None), ("company", "Nobody", "awarded_to", "tender", "Road", NONE, "x", 1.0, None, None))
    m = store.load(g, d, r, "2024-01-01")
    assert table(m.entities, "uid", "name", "attributes", "source", "confidence") == [("CMP-00000001", "ACME ltd", {"a": "1", "b": "2"}, "x", 0.9), ("CMP-00000002", "Beta", {}, "x", 1.0), ("TEN-00000001", "Road", {}, "x", 1.0)]
    assert table(m.relations, "source_uid", "target_uid", "attributes", "confidence", "source", "valid_from", "valid_to") == [("CMP-00000001", "TEN-00000001", {"contract_value": "5"}, 0.7, "x", "2020-01-01", None)]
    assert m.rejected.count() == 3 and m.history.count() == 3
    again = store.load(Graph(m.entities, m.relations, ""), d, r, "2024-01-02")
    keep = ("uid", "kind", "name", "attributes", "confidence", "created_at")
    assert table(again.entities, *keep) == table(m.entities, *keep) and table(again.relations, "id", "confidence") == table(m.relations, "id", "confidence")
    more = store.load(Graph(m.entities, m.relations, ""), entities(spark, ("company", "Zeta", NONE, "y", 1.0), ("company", "Alpha", NONE, "y", 1.0)), relations(spark), "2024-01-03")
    assert {r.name: r.uid for r in more.entities.collect()}["Zeta"] == "CMP-00000003" and store.uid_changes(m.entities, more.entities).count() == 2


def test_scraper_id_is_the_key_of_companies_that_have_one(spark):
    e = store.merge_entities(store.empty(spark).entities, entities(spark, ("company", "Same", {"scraper_id": "7"}, "x", 1.0), ("company", "Same", {"scraper_id": "8"}, "x", 1.0)), "t")
    assert e.count() == 2 and store.duplicate_keys(Graph(e, e, "")).first().n == 2
    e = store.merge_entities(e, entities(spark, ("company", "Renamed", {"scraper_id": "8", "k": "v"}, "x", 1.0)), "t2")
    assert table(e, "uid", "name") == [("CMP-00000001", "Same"), ("CMP-00000002", "Renamed")]


def graph(spark):
    d = entities(spark, ("company", "Acme", {"id_duns": "1", "city": "V"}, "x", 1.0), ("company", "Beta", NONE, "x", 1.0), ("company", "Lone", NONE, "x", 1.0), ("company_alias", "Acme Holdings", NONE, "x", 1.0), ("company_alias", "Acme Old", NONE, "x", 1.0), ("tender", "Road works", NONE, "x", 1.0))
    rel = lambda a, b, k, c, e: (a, b, k, c, e, NONE, "x", 1.0, None, None)
    r = relations(spark, rel("company", "Acme", "awarded_to", "tender", "Road works"), rel("company", "Beta", "submitted_bid", "tender", "Road works"), rel("company_alias", "Acme Old", "alias_of", "company_alias", "Acme Holdings"), rel("company_alias", "Acme Holdings", "alias_of", "company", "Acme"), rel("company", "Beta", "same_as", "company", "Acme"))
    m = store.load(store.empty(spark), d, r, "2024-01-01")
    return Graph(m.entities, m.relations, "2024-01-01")


def test_aliases_identity_paths_and_search(spark):
    g = graph(spark)
    assert {r.canonical_uid for r in store.alias_map(g).collect()} == {"CMP-00000001"}
    who = {r.uid: r for r in store.company_identity(g).collect()}["CMP-00000001"]
    assert who.external_ids == {"id_duns": "1"} and who.aliases == ["Acme Holdings"] and who.merge_candidates == ["CMP-00000002"]
    pairs = spark.createDataFrame([("CMP-00000001", "CMP-00000001"), ("CMP-00000001", "TEN-00000001"), ("ALI-00000002", "TEN-00000001"), ("CMP-00000001", "CMP-00000003")], "start string, goal string")
    assert {(r.start, r.goal): r.hops for r in traverse.paths(g, pairs).collect()} == {("CMP-00000001", "CMP-00000001"): 0, ("CMP-00000001", "TEN-00000001"): 1, ("ALI-00000002", "TEN-00000001"): 3, ("CMP-00000001", "CMP-00000003"): None}
    assert traverse.paths(g, pairs, 2).filter("goal = 'TEN-00000001' and hops is null").count() == 1
    assert {r.other for r in traverse.related_companies(g).filter("uid = 'CMP-00000001'").collect()} == {"CMP-00000002"}
    assert traverse.neighbors(g, direction="in", kinds=["alias_of"], active_only=True).count() == 2
    assert traverse.neighbors(g, limit=1).filter("uid = 'TEN-00000001'").count() == 1
    assert search.entities(g, "holding").first().uid == "CMP-00000001"
    assert [r.uid for r in search.find_companies(g, "beta").collect()] == ["CMP-00000002"]
    assert search.by_glob(g, "Acme*", "company").count() == 1 and search.by_glob(g, "acme*").count() == 0
    assert [r.name for r in store.find(g, "company", "e").collect()] == ["Acme", "Beta", "Lone"]
    assert store.find_by_attribute(g, "id_duns", 1).count() == 1 and store.find_by_attribute(g, "city", "V", "tender").count() == 0
    assert store.alias_integrity(g).collect()[0].problem == "bad_target"
    assert store.attach_identifier(g, "CMP-00000003", "id_lei", "9", "t").filter("attributes['id_lei'] = '9'").first().uid == "CMP-00000003"
    folder = scratch(spark, "graph")
    store.save(g, folder)
    assert table(store.read(spark, folder, "x").entities, "uid", "name") == table(g.entities, "uid", "name")


def test_importers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return f"{tmp_path}/{name}"

    d = files.csv(spark, put("a.csv", "﻿company_name,city,phone,parent\nAcme,Victoria,1,Big Co\n ,X,2,\n"), {"kind": "company", "name": "company_name", "attributes": {"phone": "phone"}, "relations": [{"column": "parent", "kind": "subsidiary_of", "target_kind": "company"}]})
    m = store.load(store.empty(spark), d.entities, d.relations, "t")
    assert table(m.entities, "name") == [("Acme",), ("Big Co",)] and m.relations.first().kind == "subsidiary_of" and d.skipped.count() == 1
    d = files.json(spark, put("a.json", '[{"kind": "COMPANY", "name": "A", "attrs": {"x": "1"}}, {"kind": "tender", "name": "T"}]'))
    assert table(d.entities, "kind", "name") == [("company", "A"), ("tender", "T")]
    d = files.json(spark, put("b.json", '{"entities": [{"kind": "company", "name": "A"}, {"kind": "tender", "name": "T  x"}], "relations": [{"source_kind": "company", "source_name": "a", "target_kind": "tender", "target_name": "t x", "kind": "awarded_to"}]}'))
    assert store.load(store.empty(spark), d.entities, d.relations, "t").relations.count() == 1
    for header, row, kind in (("tender_title,region,closing_at", "Bridge,\"Victoria, BC\",2024-01-01", "tenders"), ("company_name,city,province", "A,V,BC", "companies"), ("vendor_name,tender_title,contract_value", "A,Bridge,\"$1,000\"", "awards"), ("permit_number,address,applicant", "P1,1 Road,X DBA: Real Name", "permits")):
        assert files.sniff(header.split(",")) == kind
        d = files.sniffed(spark, put("s.csv", f"{header}\n{row}\n"))
        m = store.load(store.empty(spark), d.entities, d.relations, "t")
        names = {r.name for r in m.entities.collect()}
        assert {"tenders": {"Bridge", "Victoria", "British Columbia"}, "companies": {"A", "V", "BC"}, "awards": {"A", "Bridge"}, "permits": {"P1", "Real Name"}}[kind] <= names and m.relations.count() >= 1
    put("contract_awards.csv", "winner_company,contract_value,date,tender_title,url\nA,5,2020-01-01,T,u\n")
    put("building_permits.csv", "external_id,applicant,contractor,city\nP,A,B,V\n")
    d, missing = files.dataset(spark, str(tmp_path))
    m = store.load(store.empty(spark), d.entities, d.relations, "t")
    assert "federal_tenders.csv" in missing and {r.kind for r in m.relations.collect()} == {"awarded_to", "awarded_by", "applied_for", "contracted_for", "in_city"}
    t = spark.createDataFrame([(1, "Acme", "canonical", None), (2, "Acme Inc", "applicant_alias", 1), (3, "Lost", "applicant_alias", 9), (4, "Jo", "probable_person", None), (5, "Solo", "", None)], "id long, display_name string, entity_role string, canonical_company_id long").withColumn("name", F.col("display_name"))
    d = files.companies_table(spark, t)
    m = store.load(store.empty(spark), d.entities, d.relations, "t")
    assert table(m.entities, "kind", "name") == [("company", "Acme"), ("company", "Solo"), ("company_alias", "Acme Inc")] and m.relations.count() == 1 and d.skipped.count() == 2
    rows, state = files.page(t, "id", 1, 2)
    assert [r.id for r in rows.collect()] == [2, 3] and tuple(state.first()) == (3, True)


def test_incremental_import_resumes_and_event_stream_equals_the_batch(spark, tmp_path):
    source, target, check = (f"file://{tmp_path}/{x}" for x in ("in", "graph", "check"))
    schema = "vendor_name string, tender_title string, contract_value string"
    to_delta = lambda batch: files._awards(files.Build(spark, "s"), batch.withColumn("seq", F.monotonically_increasing_id()))
    for k, rows in enumerate(([("A", "T", "1"), ("B", "U", "2")], [("A", "T", "1"), ("C", "T", "3")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        assert incremental.import_files(spark, source, schema, target, check, to_delta, f"2024-01-0{k + 1}") == k + 1
    g = incremental.current(spark, target)
    assert table(g.entities, "kind", "name") == [("company", "A"), ("company", "B"), ("company", "C"), ("tender", "T"), ("tender", "U")] and g.edges("awarded_to").count() == 3
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(f"{source}-events")
    stream = spark.readStream.schema(events.schema).parquet(f"{source}-events")
    query = incremental.event_counts(stream, lateness="1000 days").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert table(spark.table("counts"), "window_start", "event_type", "events") == table(incremental.event_counts(events), "window_start", "event_type", "events")
    known = spark.createDataFrame([("a", "1")], "path string, hash string")
    assert [r.path for r in incremental.changed(spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string"), known).collect()] == ["b"]


def test_a_load_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    from bidlattice.streaming import versions

    target = f"file://{tmp_path}/graph"
    none = relations(spark)
    delta = lambda *names: files.Delta(entities(spark, *[("company", n, NONE, "x", 1.0) for n in names]), none, none)
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        for _ in range(2):
            try:
                incremental.append(spark, target, delta("A"), "2024-01-01")
            except OSError:
                pass
    assert incremental.version(spark, target) == 0 and incremental.current(spark, target).entities.count() == 0
    assert incremental.append(spark, target, delta("A", " "), "2024-01-01")["load"] == {"entities_created": 1, "entities_updated": 0, "relations_created": 0, "rejected": 1}
    again = incremental.append(spark, target, delta("A", "B"), "2024-01-02")
    assert again["version"] == 2 and again["load"]["entities_created"] == again["load"]["entities_updated"] == 1
    one, same, other = incremental.history(spark, target).orderBy("seq").collect()  # numbers that crashed loads had leased are not used again
    assert [one.seq, same.seq, other.seq] == [1, 2, 3] and one.uid == same.uid < other.uid
    assert incremental.rejected(spark, target).count() == 1 and incremental.vacuum(spark, target, 1) == 2
    assert table(incremental.current(spark, target).entities, "name") == [("A",), ("B",)]


def test_names_of_aliases_are_their_company(spark):
    g = graph(spark)
    won = ("company", "ACME old", "awarded_to", "tender", "road works", NONE, "x", 1.0, None, None)
    m = store.load(g, entities(spark, ("company", "Acme Holdings", {"k": "v"}, "x", 1.0), ("company", "Acme", {"k": "w"}, "x", 1.0)), relations(spark, won, ("company_alias", "Acme Old", "has_permit", "tender", "Road works", NONE, "x", 1.0, None, None)), "2024-02-01")
    assert m.entities.filter("kind = 'company'").count() == 3 and m.rejected.count() == 0
    assert table(m.relations.filter("kind in ('awarded_to', 'has_permit')"), "kind", "source_uid") == [("awarded_to", "CMP-00000001"), ("has_permit", "CMP-00000001")]
    assert store.company_by_id(g, "cmp-00000002").first().name == "Beta" and store.company_by_id(g, "5").count() == 0


def test_relational_pages_go_on_where_they_stopped(spark, tmp_path):
    target = f"file://{tmp_path}/graph"
    companies = spark.createDataFrame([(1, "Acme", "canonical", None), (2, "Acme Inc", "applicant_alias", 1)], "id long, display_name string, entity_role string, canonical_company_id long").withColumn("name", F.col("display_name"))
    permits = spark.createDataFrame([(k, f"P{k}", None, 1 + k % 2) for k in range(1, 6)], "id long, external_id string, address string, company_id long")
    one = incremental.import_tables(spark, target, {"companies": companies, "permits": permits.filter("id < 4")}, "2024-01-01", 2)
    assert one["permits"]["entities_created"] == 3 and incremental.version(spark, target) == 3
    two = incremental.import_tables(spark, target, {"companies": companies, "permits": permits}, "2024-01-02", 2)
    g = incremental.current(spark, target)
    assert two["permits"]["entities_created"] == 2 and g.nodes("permit").count() == 5
    assert {r.source_uid for r in g.edges("has_permit").collect()} == {"CMP-00000001"} and g.edges("has_permit").count() == 5
    assert files.missing_columns({"permits": permits.drop("address")}) == {"permits": ["address"]}
