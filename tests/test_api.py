from bidlattice import api
from bidlattice.sources import star

from .test_analytics import graph

DATA = "/root/testdata/sf0.001"


def test_tools_of_one_entity_and_error_records(spark):
    e = api.Engine(star.graph(spark, DATA))
    assert e.call("nothing")["error"] and e.call("cie_summary", uid="CMP-99999999")["error"] == "no entity CMP-99999999"
    assert "not company" in e.call("cie_summary", uid="ORG-00000001")["error"] and e.call("kg_stats")["error"]
    assert e.call("bie_award_concentration", uid="ORG-00000002")["rows"][0]["uid"] == "ORG-00000002"
    assert e.call("cei_direct_competitors", uid="CMP-00000001", limit=3)["count"] == 3
    assert e.call("rie_strength", uid_a="CMP-00000003", uid_b="CMP-00000001")["count"] == 1
    assert e.call("oie_opportunity_timeline", company_uid="CMP-00000001", tender_uid="TEN-00000001")["count"] == 1
    assert e.call("biz_neighbors", uid="TEN-00000001", direction="out")["count"] == 1


def test_confidence_scores(spark):
    g = graph(spark, [("ALI-1", "alias_of", "CMP-1")], {"CMP-1": {"id_duns": "1"}, "CMP-2": {}})
    scores = api.confidence_scores(g)
    assert {r.uid: r.score for r in scores.collect()} == {"CMP-1": 0.395, "CMP-2": 0.15}
    assert sum(r.n for r in api.score_histogram(scores).collect()) == 2 and api.percentiles(scores).first().p50 == 0.2725
    assert api.counts_by_source(g).count() == 2 and "score" in api.report(scores)
