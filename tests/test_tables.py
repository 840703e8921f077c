"""Versioned tables: commits, snapshots, and runs that end between any two steps."""
import pytest
from pyspark.sql import functions as F

from quillspark import jobs
from quillspark.operators import dedup, store
from quillspark.sources.tables import Conflict, Table
from quillspark.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t")
    assert t.version().number == -1 and t.versions() == []
    with pytest.raises(LookupError):
        t.read()
    assert t.read(schema="k long").count() == 0
    for n in range(4):
        df = spark.range(n + 1).withColumn("n", F.lit(n))
        t.commit(t.version(), t.put(df), df.schema, last=n)
    assert t.versions() == [0, 1, 2, 3] and t.read().count() == 4 and t.read(1).count() == 2 and t.version().notes == {"last": 3}
    old = t.version(2)
    held = t.read(old)
    gone = t.vacuum(2)
    assert len(gone) == 2 and t.versions() == [2, 3] and held.count() == 3
    with pytest.raises(LookupError):
        t.version(1)


def test_one_writer_wins(spark, tmp_path):
    t, other = Table(spark, f"{tmp_path}/t"), Table(spark, f"{tmp_path}/t")
    base = t.version()
    df = spark.range(3)
    t.commit(base, t.put(df), df.schema)
    with pytest.raises(Conflict):
        other.commit(base, other.put(spark.range(9)), df.schema)
    assert t.versions() == [0] and t.read().count() == 3 and len(t.orphans(0)) == 1
    # change() is made anew from the newer version
    tried = []

    def add(last):
        tried.append(1)
        if len(tried) == 1:
            d = t.read().union(spark.range(100, 101))
            t.commit(t.version(), t.put(d), d.schema)
        return last.union(spark.range(200, 201))

    assert other.change(add).number == 2 and rows(t.read()) == [(0,), (1,), (2,), (100,), (200,)] and len(tried) == 2
    assert len(t.orphans(0, delete=True)) == 2 and t.orphans(0) == [] and t.read().count() == 5


STEPS = ["put", "commit", "vacuum"]


class Died(Exception):
    pass


def dying(monkeypatch, step, when):
    """The next call of a step of any table ends the run, before or after it is done."""
    real = getattr(Table, step)

    def f(self, *a, **k):
        monkeypatch.setattr(Table, step, real)
        if when == "before":
            raise Died
        real(self, *a, **k)
        raise Died

    monkeypatch.setattr(Table, step, f)


@pytest.mark.parametrize("when", ["before", "after"])
@pytest.mark.parametrize("step", STEPS)
def test_points_survive(spark, tmp_path, monkeypatch, step, when):
    """An upsert of points that ends at any step leaves the old or the new table; run again it gives the new one."""
    t = store.ensure(spark, f"{tmp_path}/points")
    frame = lambda ids, p: spark.createDataFrame([(i, [1.0, 2.0], p) for i in ids], store.POINT)
    t.change(lambda base: store.upsert_points(base, frame("abcd", "old"), 2))
    run = lambda: t.change(lambda base: store.upsert_points(base, frame("de", "new"), 2))
    dying(monkeypatch, step, when)
    with pytest.raises(Died):
        run()
    new = [("a", "old"), ("b", "old"), ("c", "old"), ("d", "new"), ("e", "new")]
    seen = rows(t.read().select("id", "payload"))
    assert seen in (new, [("a", "old"), ("b", "old"), ("c", "old"), ("d", "old")])
    run()
    assert rows(t.read().select("id", "payload")) == new


@pytest.mark.parametrize("step,when", [("put", "after"), ("commit", "before"), ("commit", "after"), ("vacuum", "before")])
def test_streams_survive(spark, tmp_path, monkeypatch, step, when):
    src, out, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    args = dict(schema="k long, v long", key=["k"], version=["v"], buckets=4)
    spark.createDataFrame([(k, 1) for k in range(9)], "k long, v long").coalesce(1).write.parquet(src)
    ingest.stream_upsert(spark, src, out, ck, **args)
    spark.createDataFrame([(1, 5), (50, 1)], "k long, v long").coalesce(1).write.mode("append").parquet(src)
    dying(monkeypatch, step, when)
    with pytest.raises(Exception, match="Died"):
        ingest.stream_upsert(spark, src, out, ck, **args)
    want = sorted([(k, 5 if k == 1 else 1) for k in range(9)] + [(50, 1)])
    assert rows(ingest.current(spark, out, args["schema"])) in (want, [(k, 1) for k in range(9)])
    assert rows(ingest.stream_upsert(spark, src, out, ck, **args)) == want
    # what is repeated after its commit makes no version
    assert Table(spark, out).version().number == 1


def test_new_checkpoint_and_other_buckets(spark, tmp_path):
    """A new checkpoint on an old table loses no update; another number of buckets leaves each key in one."""
    out = f"{tmp_path}/out"
    args = dict(schema="k long, v long", key=["k"], version=["v"])
    write = lambda name, data: spark.createDataFrame(data, "k long, v long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    for n in range(3):
        write("a", [(1, n), (2, n), (10 + n, 0)])
        ingest.stream_upsert(spark, f"{tmp_path}/a", out, f"{tmp_path}/ck-a", buckets=8, **args)
    write("b", [(1, 9), (2, 1)])
    got = ingest.stream_upsert(spark, f"{tmp_path}/b", out, f"{tmp_path}/ck-b", buckets=3, **args)
    want = [(1, 9), (2, 2), (10, 0), (11, 0), (12, 0)]
    assert rows(got) == want
    table = Table(spark, out)
    assert table.version().notes["buckets"] == 8 and len(table.version().notes["streams"]) == 2
    ingest.rebucket(table, ["k"], 3)
    assert rows(table.read()) == want and len(table.version().parts) <= 3
    write("b", [(1, 10), (77, 1)])
    assert rows(ingest.stream_upsert(spark, f"{tmp_path}/b", out, f"{tmp_path}/ck-b", **args)) == [(1, 10), *want[1:], (77, 1)]


def test_clashing_names(spark, tmp_path):
    """Columns that are named like inner ones stay."""
    schema = "key0 long, _last long, bucket long, row long"
    spark.createDataFrame([(1, 1, 5, 6), (1, 2, 7, 8), (2, 1, 9, 9)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = ingest.stream_upsert(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", schema=schema, key=["key0"], version=["_last"], buckets=4)
    assert rows(got) == [(1, 2, 7, 8), (2, 1, 9, 9)]
    assert rows(dedup.upsert(got, got, ["key0"], ["_last"])) == rows(got)


def test_ingest_state_survives(spark, tmp_path, monkeypatch):
    """A run that ends before it commits its state is run again from the state before."""
    (tmp_path / "src").mkdir()
    body = " ".join(f"Sentence number {j} tells about something at length." for j in range(40))
    for name in ("a", "b"):
        (tmp_path / "src" / f"{name}.md").write_text(f"# {name}\n\n{body}")
    run = lambda: jobs.ingest(spark, f"{tmp_path}/src", f"{tmp_path}/processed", "P", "v", "en", state=f"{tmp_path}/state")
    dying(monkeypatch, "commit", "before")
    with pytest.raises(Died):
        run()
    assert Table(spark, f"{tmp_path}/state").versions() == []
    assert run() == {"total": 2, "n_parsed": 2, "n_dup": 1, "n_ok": 1, "n_error": 0}
    assert Table(spark, f"{tmp_path}/state").read().count() == 1 and run()["n_dup"] == 2
