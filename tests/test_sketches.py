"""Mergeable sketches, and the chunker as a table function."""
import random
import statistics
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunking, sketches
from quillspark.sources.tables import Table


def test_increments_are_one_whole(spark, tmp_path):
    """Three increments by day, merged to kinds: counts exact, distinct counts and quantiles within their bounds; nulls and missing keys."""
    rng = random.Random(2)
    rows = [(f"d{i % 5}", "abc"[i % 3], rng.randrange(3000), rng.gauss(0, 10), i % 4) for i in range(20_000)] + [("d0", "z", None, None, None), (None, "z", None, None, None)]
    df = spark.createDataFrame(rows, "day string, kind string, user long, value double, step int")
    table = Table(spark, f"{tmp_path}/s")
    part = F.pmod(F.xxhash64("user", "value"), F.lit(3))
    args = {"distinct": ["user"], "quantiles": ["value", "step"]}
    for n in range(3):
        last = sketches.add(table, df.where(F.coalesce(part, F.lit(0)) == n), ["day", "kind"], **args)
    kinds = last.notes["kinds"]
    assert kinds == {"value": "double", "step": "bigint"} and table.read().count() == 17
    got = {r.kind: r for r in sketches.estimates(sketches.merged(table.read().drop("day"), ["kind"], kinds), kinds, [0.1, 0.5, 0.9]).collect()}
    assert set(got) == {"a", "b", "c", "z"} and (got["z"].n, got["z"].n_user, got["z"].q_value, got["z"].q_step) == (2, 0, None, None)
    for k in "abc":
        users = {r[2] for r in rows if r[1] == k}
        values = sorted(r[3] for r in rows if r[1] == k)
        assert got[k].n == len(values) and abs(got[k].n_user - len(users)) <= 0.05 * len(users)
        for q, v in zip((0.1, 0.5, 0.9), got[k].q_value):
            assert abs(sum(x <= v for x in values) / len(values) - q) <= 0.03
        assert got[k].q_step[1] in (1, 2) and abs(got[k].q_value[1] - statistics.median(values)) < 2
    whole = sketches.estimates(sketches.sketched(df, ["kind"], **args), kinds).where("kind = 'a'").first()
    assert whole.n == got["a"].n and abs(whole.n_user - got["a"].n_user) <= 0.05 * whole.n_user
    with pytest.raises(ValueError):
        sketches.sketched(df, ["day"], quantiles=["kind"])


def test_chunks_in_sql(spark):
    texts = ["## Part\n\n" + " ".join(f"Sentence {i} of a text that is long enough to be cut." for i in range(60)), "short", None, "```py\n" + "x = 1\n" * 80 + "```"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    budget = chunking.Budget(max_tokens=60, min_chars=20)
    chunking.register(spark, "cut_up", budget)
    df.createOrReplaceTempView("some_texts")
    got = spark.sql("select d.id, c.* from some_texts d, lateral cut_up(d.text) c")
    want = chunking.chunk_documents(df, doc="id", text="text", budget=budget)
    plain = lambda df, key: sorted((str(r[key]), r.seq, r.text, r.has_code, r.char_start) for r in df.collect())
    assert plain(got, "id") == plain(want, "document_id") and got.where("has_code").count() > 0
    titled = spark.sql("select c.h_path from some_texts d, lateral cut_up(d.text, 'Title') c where d.id = 0").first()
    assert "Title" in titled.h_path
    # the parts of a document, in order, give what the whole gives
    pieces = df.where("id = 0").select("id", F.posexplode(F.split("text", "\n\n")).alias("n", "text"))
    pieces.repartition(4).createOrReplaceTempView("some_parts")
    whole = spark.sql("select * from cut_up_parts(table(select cast(id as string) as id, text, n from some_parts) partition by id order by n)")
    assert plain(whole, "document_id") == [x for x in plain(want, "document_id") if x[0] == "0"]


def test_jobs_start_as_a_file(tmp_path):
    """The jobs' file runs from any folder."""
    jobs = Path(__file__).resolve().parent.parent / "quillspark" / "jobs.py"
    out = subprocess.run([sys.executable, str(jobs), "--help"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and "ingest" in out.stdout
