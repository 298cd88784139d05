import json

import pytest
from pyspark.sql import functions as F

from bidlattice.operators import nested
from bidlattice.session import scratch

VALUES = [
    {"city": "V", "n": 1, "tags": ["a", "b"], "buyer": {"name": "X", "sizes": [1, 2.5], "more": {"k": None}}}, {"city": "V", "n": "1", "tags": []}, {"city": ["V"], "n": 1.0}, {"city": None, "n": True, "it's": 1, "a.b": {"c d": 2}},
    {}, [1, 2], "V", 5, None, {"tags": [{"x": 1, "y": 2}, {"x": 3}], "n": 12345678901}, {"n": 0.1, "tags": [["a"], "b"]},
]


def holds(v, w):
    if isinstance(w, dict):
        return isinstance(v, dict) and all(k in v and holds(v[k], x) for k, x in w.items())
    if isinstance(w, list):
        return isinstance(v, list) and all(any(holds(e, x) for e in v) for x in w)
    if isinstance(w, bool) or isinstance(v, bool) or w is None or isinstance(w, str) or not isinstance(v, (int, float)):
        return type(v) is type(w) and v == w
    return isinstance(w, (int, float)) and v == w


@pytest.mark.parametrize("wanted", [{"city": "V"}, {"n": 1}, {"n": "1"}, {"n": True}, {"city": None}, {"city": ["V"]}, {"tags": ["b"]}, {"tags": []}, {"tags": [{"x": 1}]}, {"tags": [["a"], "b"]}, {"buyer": {"sizes": [2.5]}}, {"buyer": {"more": {"k": None}}}, {}, {"nothing": 1}, {"a.b": {"c d": 2}}, {"n": 12345678901}, {"n": 0.1}, {"city": "V", "n": 1}])
def test_containment(spark, stored_rows, wanted):
    want = [i for i, v in enumerate(VALUES) if holds(v, wanted)]
    assert sorted(r.id for r in nested.find(stored_rows, wanted).collect()) == want
    plain = stored_rows.drop("attr_city", "attr_n")
    assert sorted(r.id for r in nested.find(plain, wanted).collect()) == want


@pytest.fixture(scope="module")
def stored_rows(spark):
    rows = [(i, json.dumps(v)) for i, v in enumerate(VALUES)] + [(98, "no json {"), (99, None)]
    folder = scratch(spark, "nested")
    nested.write(spark.createDataFrame(rows, "id long, attributes string"), folder, {"city": "string", "n": "double"})
    return nested.read(spark, folder)


def test_paths_and_pushed_filters(spark, stored_rows):
    got = stored_rows.filter("id = 0").select(nested.at(F.col("attributes"), "buyer", "sizes", 1, as_="double").alias("a"), nested.at(F.col("attributes"), "tags", 5, as_="string").alias("b"), nested.at(F.col("attributes"), "buyer", as_="int").alias("c")).first()
    assert tuple(got) == (2.5, None, None)
    found = nested.find(stored_rows, {"city": "V", "tags": ["a"]})
    assert "EqualTo(attr_city,V)" in found._jdf.queryExecution().executedPlan().toString() and found.columns == ["id", "attributes"]
