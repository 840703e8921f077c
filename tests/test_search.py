"""Vector index: whole, filtered, and by ids, against plain numpy."""
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import search


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    """Clustered vectors, a crowd of equal ones, and rows without a valid vector."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.6 * rng.normal(size=16)).astype(float).tolist(), json.dumps({"kind": "abc"[i % 3], "n": i, "deep": {"x": i / 4}, "flag": i % 2 == 0})) for i in range(900)]
    rows += [(1000 + i, [1.0] * 16, json.dumps({"kind": "hot", "n": i})) for i in range(300)]
    rows += [(2000, None, "{}"), (2001, [0.0] * 16, None), (2002, [1.0], '{"kind": "a"}'), (2003, [float("nan")] * 16, "not json")]
    df = spark.createDataFrame(rows, "id long, vector array<double>, payload string").withColumn("vector", F.col("vector").cast("array<float>"))
    index = search.build(spark, df, str(tmp_path_factory.mktemp("index") / "i"), fields={"kind": "keyword", "n": "integer"}, lists=20)
    return rows, df, index


def brute(rows, asked, k, keep=lambda p: True):
    out = {}
    unit = lambda v: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float))
    good = [(i, unit(v), json.loads(p)) for i, v, p in rows if v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    for q, v in asked:
        scored = sorted((-round(float(np.clip(unit(v) @ u, 0, 1)), 6), i) for i, u, p in good if keep(p))
        out[q] = [-s for s, _ in scored[:k]]
    return out


def scores(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(round(r.score, 6))
    return out


def asked(spark, rows):
    q = [(i, v) for i, v, _ in rows if v and len(v) == 16 and np.isfinite(v).all() and any(v) and i % 90 == 10]
    return q, spark.createDataFrame([*q, (-1, [0.0] * 16)], "query_id long, query_vec array<double>")


def test_exact_and_recall(spark, held):
    rows, df, index = held
    q, queries = asked(spark, rows)
    exact = search.search(index, queries, 7, exact=True)
    assert scores(exact) == brute(rows, q, 7)
    assert index.table.read().count() == len(rows) and 1 <= index.probes <= len(index.centres)
    got = search.recall(search.search(index, queries, 7), exact).first()
    assert got.n_queries == len(q) and got.n_hits == 7 * len(q) and got.recall >= 0.9
    # ties go to the smaller id
    hot = search.search(index, spark.createDataFrame([(1, [2.0] * 16)], "query_id long, query_vec array<double>"), 5)
    assert [r.id for r in hot.orderBy("rank").collect()] == [1000, 1001, 1002, 1003, 1004]


def test_tiles(spark, held, monkeypatch):
    """Lists and crowds of queries beyond a tile are dealt out and give the same."""
    rows, _, index = held
    q, queries = asked(spark, rows)
    monkeypatch.setattr(search, "TILE_POINTS", 16)
    monkeypatch.setattr(search, "TILE_QUERIES", 2)
    assert scores(search.search(index, queries, 7, exact=True)) == brute(rows, q, 7)


FILTERS = [
    ({"kind": "a"}, lambda p: p.get("kind") == "a"),
    ({"kind": ["a", "hot"], "n": {"gte": 5, "lt": 200}}, lambda p: p.get("kind") in ("a", "hot") and 5 <= p.get("n", -1) < 200),
    ({"deep.x": {"gt": 100.0}}, lambda p: p.get("deep", {}).get("x", 0) > 100),
    ({"kind": {"not": ["a", "b"]}, "flag": True}, lambda p: p.get("kind") not in ("a", "b") and p.get("flag") is True),
    ({"kind": []}, lambda p: False),
    ({}, lambda p: True),
]


@pytest.mark.parametrize("filters,keep", FILTERS)
def test_filters(spark, held, filters, keep):
    rows, _, index = held
    q, queries = asked(spark, rows)
    got = scores(search.search(index, queries, 5, exact=True, filters=filters))
    assert got == {i: s for i, s in brute(rows, q, 5, keep).items() if s}


def test_filter_reaches_the_scan(spark, held):
    rows, _, index = held
    _, queries = asked(spark, rows)
    df = search.search(index, queries, 5, filters={"n": {"gte": 5}, "kind": "a"})
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(payload_n,5)" in plan and "EqualTo(payload_kind,a)" in plan
    with pytest.raises(ValueError):
        search.conditions({"n": {"near": 1}}, {})
    with pytest.raises(ValueError):
        search.shredded(index.table.read(), {"n": "number"})


def test_lookup_and_reopen(spark, held):
    _, df, index = held
    again = search.opened(spark, index.table.path)
    assert (again.probes, again.fields) == (index.probes, index.fields) and np.array_equal(again.centres, index.centres)
    points = again.table.read()
    assert sorted(r.id for r in search.by_ids(points, [3, 1005, 9999]).collect()) == [3, 1005]
    assert search.by_ids(points, spark.createDataFrame([(3,), (3,), (2000,)], "id long")).count() == 2 and search.by_ids(points, []).count() == 0


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "id long, vector array<float>, payload string")
    index = search.build(spark, none, f"{tmp_path}/i")
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query_vec array<double>")
    assert search.search(index, queries, 3).count() == 0
    with pytest.raises(LookupError):
        search.opened(spark, f"{tmp_path}/none")
