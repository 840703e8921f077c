"""As-of and interval joins against loops over all rows."""
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import timejoin

SECOND = 1_000_000


def table(rng, n, keys, tie=False):
    rows = [(rng.choice(keys), None if rng.random() < 0.04 else rng.randrange(60 if tie else 5000), i) for i in range(n)]
    return rows + rows[:3]


@pytest.mark.parametrize("strict,within,slice_rows,tie", [(False, None, 10**6, False), (True, None, 16, True), (False, 40, 16, True), (True, 700, 5, False)])
def test_as_of(spark, strict, within, slice_rows, tie):
    """Ties of time, repeated rows, null keys and times, keys without a match, slices of a busy key."""
    rng = random.Random(7)
    left, right = (table(rng, n, ["a", "a", "a", "b", None, only], tie) for n, only in ((220, "l"), (180, "r")))
    frame = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], "k string, at long, id long, last long")
    got = timejoin.as_of(frame(left), frame(right), left_ts="at", right_ts="at", keys=["k"], within=within, strict=strict, order=["id"], slice_rows=slice_rows)
    assert got.columns == ["k", "at", "id", "last", "right_at", "right_id", "right_last"]
    want = []
    for k, at, i in left:
        fits = [(t, j) for c, t, j in right if c == k and None not in (at, t) and (t < at if strict else t <= at)]
        t, j = max(fits, default=(None, None))
        if t is not None and within is not None and at - t > within:
            t = j = None
        want.append((k, at, i, t, j))
    assert sorted(((r.k, r["at"], r.id, r.right_at, r.right_id) for r in got.collect()), key=str) == sorted(want, key=str)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("base", [None, 1, 64, 10**6])
@pytest.mark.parametrize("closed,open_start", [(False, False), (True, True)])
def test_within(spark, base, closed, open_start):
    """Intervals of all lengths, empty and backward ones, nulls, negative times."""
    rng = random.Random(5)
    spans = [(rng.choice([1, 1, 2, None]), a, a + rng.choice([-1, 0, 1, 7, 100, 3000, 10_000]), n) for n, a in enumerate(rng.randrange(-4000, 4000) for _ in range(90))] + [(1, None, 5, 900), (1, 3, None, 901)]
    points = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(-4000, 4000)]), n) for n in range(150)]
    iv = spark.createDataFrame(spans, "k long, a long, z long, n long")
    pt = spark.createDataFrame(points, "k long, at long, n long")
    got = timejoin.within(pt, iv, at="at", start="a", end="z", keys=["k"], closed=closed, open_start=open_start, base=base)
    want = [(p, s) for k, t, p in points for c, a, z, s in spans if k is not None and k == c and None not in (t, a, z) and (a < t if open_start else a <= t) and (t <= z if closed else t < z) and a <= z]
    assert sorted((r.n, r.interval_n) for r in got.collect()) == sorted(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_overlapping(spark):
    rng = random.Random(6)
    made = lambda n: [(i, a, a + rng.choice([0, 1, 20, 500])) for i, a in enumerate(rng.randrange(1500) for _ in range(n))]
    left, right = made(70), made(60)
    frame = lambda rows: spark.createDataFrame(rows, "i long, a long, z long")
    got = timejoin.overlapping(frame(left), frame(right), start="a", end="z")
    want = [(i, j) for i, a, z in left for j, b, y in right if a < z and b < y and a < y and b < z]
    assert sorted((r.i, r.right_i) for r in got.collect()) == sorted(want) and got.columns == ["i", "a", "z", "right_i", "right_a", "right_z"]


@pytest.mark.parametrize("slice_ends", [10**6, 40, 8])
def test_overlap_summary(spark, slice_ends):
    """Counts and smallest others, of one slice and of many: repeated ids and rows, equal starts, spans over all slices, empty ones, nulls."""
    rng = random.Random(12)
    spans = [(rng.choice([i, i, 5, 9]), a, a + rng.choice([-2, 0, 1, 20, 300, 4000])) for i, a in enumerate(rng.choice([700, 701, rng.randrange(6000)]) for _ in range(150))]
    spans += [*spans[:4], (None, 1, 9000), (3, None, 5), (7, 3, None), (400, 20_000, 20_001), (401, 30_000, 30_005), (401, 30_001, 30_002)]
    got = timejoin.overlap_summary(spark.createDataFrame(spans, "i long, a long, z long"), start="a", end="z", id_="i", slice_ends=slice_ends)
    want = {}
    whole = [s for s in spans if None not in s and s[1] < s[2]]
    for i, a, z in whole:
        others = [j for j, b, y in whole if j != i and a < y and b < z]
        if others:
            n, least = want.get(i, (0, 10**6))
            want[i] = n + len(others), min(least, *others)
    assert {r.i: (r.n_overlaps, r.first_other) for r in got.collect()} == want and got.columns == ["i", "n_overlaps", "first_other"]


def test_overlaps_of_a_crowd(spark):
    """30,000 spans that all overlap: 900 million pairs are counted, not made."""
    crowd = spark.range(30_000).select("id", F.lit(0).cast("long").alias("a"), (F.col("id") + 1).alias("z"))
    row = timejoin.overlap_summary(crowd, start="a", end="z", id_="id").agg(F.count("*"), F.sum("n_overlaps"), F.sum("first_other")).first()
    assert tuple(row) == (30_000, 30_000 * 29_999, 1)


def test_empty_and_timestamps(spark):
    e = spark.createDataFrame([(1, 10)], "k long, s long").withColumn("ts", F.timestamp_micros(F.col("s") * SECOND))
    none = e.where("false")
    args = dict(left_ts="ts", right_ts="ts", keys=["k"])
    assert timejoin.as_of(none, e, **args).count() == 0 and timejoin.as_of(e, none, **args).first().right_s is None
    later = e.withColumn("ts", F.timestamp_micros(F.col("s") * SECOND + 1))
    assert timejoin.as_of(later, e, within=1, **args).first().right_s == 10 and timejoin.as_of(e, later, **args).first().right_s is None
    spans = e.withColumn("z", F.timestamp_micros(F.col("s") * SECOND + 2))
    assert timejoin.within(later, spans, at="ts", start="ts", end="z").count() == 1 and timejoin.within(later, spans.where("false"), at="ts", start="ts", end="z").count() == 0
    assert timejoin.overlap_summary(spans, start="ts", end="z", id_="k").count() == 0 and timejoin.overlap_summary(spans.where("false"), start="ts", end="z", id_="k").count() == 0
