"""Stateful near-duplicate marks on a stream of files."""
import random

import pytest

from quillspark.operators import dedup
from quillspark.streaming import events, neardup

SCHEMA = "i long, b string, t string"


def texts():
    """Rows of three buckets (one of them null): families of near texts, short ones, and nulls."""
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(4000)}" for _ in range(300)) for _ in range(5)]
    rows = []
    for i in range(60):
        t = base[rng.randrange(5)] + (f" tail{i}" if i % 3 == 0 else "")
        rows.append((i, [f"b{i % 2}", None][i % 7 == 0], None if i == 11 else "short" if i % 10 == 9 else t))
    return rows


def marks(df):
    return {r.i: (r.b, r.is_dup) for r in df.collect()}


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    """Three runs, the middle one of which fails, over files in order: the marks of one walk over all rows."""
    rows = texts()
    df = spark.createDataFrame(rows, SCHEMA)
    whole = marks(dedup.sequential_near_dup(df, bucket="b", order="i", text="t"))
    assert any(d for _, d in whole.values()) and not all(d for _, d in whole.values())
    src, out, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    run = lambda: neardup.stream_near_dup(spark, src, out, ck, schema=SCHEMA, bucket="b", order="i", text="t", partitions=3, max_files=2)
    add = lambda lo, hi: [df.where(f"i >= {x} and i < {min(hi, x + 8)}").coalesce(1).write.mode("append").parquet(src) for x in range(lo, hi, 8)]
    add(0, 24)
    assert marks(run()) == {i: m for i, m in whole.items() if i < 24}
    add(24, 48)
    broken = tmp_path / "in" / "part-zz.snappy.parquet"
    broken.write_bytes(b"not parquet")
    with pytest.raises(Exception):
        run()
    broken.unlink()
    df.where("false").coalesce(1).write.parquet(f"{tmp_path}/empty")
    next((tmp_path / "empty").glob("part-*.parquet")).rename(broken)
    assert marks(run()) == {i: m for i, m in whole.items() if i < 48}
    add(48, 60)
    assert marks(run()) == whole
    # nothing new: nothing changes
    assert marks(run()) == whole


def at(hours):
    import datetime

    return None if hours is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def feed(spark, path, *batches):
    for rows in batches:
        spark.createDataFrame([(at(h), k) for h, k in rows], "ts timestamp, k string").coalesce(1).write.mode("append").parquet(path)


def shown(df):
    return sorted(((r.start, r.k, r.n) for r in df.collect()), key=str)


def test_late_rows_are_counted(spark, tmp_path):
    """Windows close once the mark is beyond them; what comes later is late, also in a later run."""
    src, out, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    run = lambda: events.stream_windows(spark, src, out, ck, schema="ts timestamp, k string", ts="ts", kind="k", every="1 hour", late="2 hours", max_files=1, partitions=2)
    feed(spark, src, [(0.5, "a"), (1.5, "a"), (1.6, None)], [(5.5, "a"), (0.1, "a")])
    first = run()
    # the mark stands at 3.5 hours: both first windows are closed
    assert shown(first.closed) == sorted([(at(0), "a", 2), (at(1), "a", 1), (at(1), None, 1)], key=str)
    assert shown(first.open) == [(at(5), "a", 1)] and (first.rows, first.late) == (5, 0)
    feed(spark, src, [(0.2, "a"), (0.3, "b"), (4.2, "b"), (9.5, "a")])
    second = run()
    assert (second.rows, second.late) == (4, 2)
    assert shown(second.open) == [(at(9), "a", 1)] and {(at(4), "b", 1), (at(5), "a", 1)} <= set(shown(second.closed))
    third = run()
    assert (third.rows, third.late) == (0, 0) and shown(third.open) == [(at(9), "a", 1)]


def test_sliding_windows(spark, tmp_path):
    src = f"{tmp_path}/in"
    feed(spark, src, [(0.5, "a"), (1.5, "a")], [(20.0, "a")])
    got = events.stream_windows(spark, src, f"{tmp_path}/out", f"{tmp_path}/ck", schema="ts timestamp, k string", ts="ts", kind="k", every="2 hours", slide="1 hour", overlaps=2, late="1 hour", max_files=1, partitions=2)
    assert shown(got.closed) == sorted([(at(-1), "a", 1), (at(0), "a", 2), (at(1), "a", 1)], key=str) and shown(got.open) == [(at(19), "a", 1), (at(20), "a", 1)]
    assert (got.rows, got.late) == (3, 0)


def test_sessions_join(spark, tmp_path):
    """A row between two open sessions makes them one."""
    src = f"{tmp_path}/in"
    feed(spark, src, [(0, "a"), (3, "a"), (0, "b")], [(1.5, "a"), (4.0, "b")], [(30, "c")])
    got = events.stream_sessions(spark, src, f"{tmp_path}/out", f"{tmp_path}/ck", schema="ts timestamp, k string", ts="ts", key="k", gap="2 hours", late="5 hours", max_files=1, partitions=2)
    assert shown(got.closed) == [(at(0), "a", 3), (at(0), "b", 1), (at(4), "b", 1)] and shown(got.open) == [(at(30), "c", 1)] and got.late == 0
