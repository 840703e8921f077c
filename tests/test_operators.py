"""Hand-written cases of the operators."""
import random
import uuid

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import ids, text
from quillspark.functions import vectors as V
from quillspark.operators import chunking, dedup, retrieval, routing, sqlqa, stats
from quillspark.sources import documents
from quillspark.streaming import ingest


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).first()[0]


def test_ids(spark):
    assert one(spark, ids.uuid5(F.col("x")), x="a/ß") == str(uuid.uuid5(uuid.NAMESPACE_URL, "a/ß"))
    # only slashes go: blanks are a value, as they are where the id is stored
    assert one(spark, ids.document_id(F.col("a"), F.col("b")), a="/", b="\\x\\y/") == "x/y"
    assert one(spark, ids.document_id(F.col("a"), F.col("b")), a=" ", b="z") == " "
    assert one(spark, ids.first_filled(F.col("a"), F.col("b")), a=" ", b="z") == "z"


@pytest.mark.parametrize("given_, want", [
    ("We saw Dr. Smith. Then 3.14 came.", ["We saw Dr. Smith.", "Then 3.14 came."]),
    ("One!  Two? (three) done", ["One!", "Two?", "(three) done"]),
    ("Intro\n• first\n• second", ["Intro", "first", "second"]),
    ("a\n\nb", ["a", "b"]),
    ("no end", ["no end"]),
])
def test_sentences(spark, given_, want):
    assert one(spark, text.sentences(F.col("x")), x=given_) == want
    assert chunking.sentence_list(given_) == want


@pytest.mark.parametrize("path, title, section", [
    ("docs/guide/model_card.md", "Model card", "/guide/"),
    ("docs/en/api/index.mdx", "Api", "/api/"),
    ("README.md", "README", "/"),
    ("a/b/c/x-y.md", "X y", "/a/b/"),
])
def test_paths(spark, path, title, section):
    assert one(spark, text.title_from_path(F.col("x")), x=path) == title
    assert one(spark, text.section_from_path(F.col("x")), x=path) == section


def test_markdown(spark):
    t = "---\ntitle: \"T\"\n---\n# The `big` <b>one</b>\n\nimport x\n<Tip>Look</Tip>\n```py\n<keep>  \n```\nend   \n\n\n\nlast"
    assert one(spark, text.first_h1(F.col("x")), x=t) == "The big one"
    assert one(spark, text.front_matter_title(F.col("x")), x=t) == "T"
    out = one(spark, text.normalize_markdown(text.without_front_matter(F.col("x"))), x=t)
    assert "<keep>  \n" in out and "import" not in out and "**Tip:** Look" in out and out.endswith("end\n\nlast")
    assert one(spark, text.preprocess(F.col("x")), x="<!-- lic -->\n# H\n\na-\nb 😀\n- item") == "ab\n\n• item\n"
    assert one(spark, text.clean_text(text.clean_text(F.col("x"))), x=" a \t b\n\n\n\nc ") == "a b\n\nc"


def test_blocks():
    t = "intro\n\n## H\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx\n\ny\n```\n\ntail"
    got = [(k, t[a:b]) for a, b, k, _ in chunking.blocks(t) if k != "empty"]
    assert [k for k, _ in got] == ["p", "h2", "table", "code", "p"]
    assert got[2][1] == "| a | b |\n|---|---|\n| 1 | 2 |" and got[3][1].startswith("```py")
    literal = [(k, t[a:b]) for a, b, k, _ in chunking.blocks(t, compat=True) if k == "table"]
    assert literal[0][1] == "| a | b |\n|---|---|"
    first = chunking.blocks("| a | b |\n|---|---|\n| 1 | 2 |")
    assert first[0][2] == "table" and first[0][0] == 0


def test_chunks():
    s = "Sentence number {} has some words in it."
    body = "## One\n\n" + " ".join(s.format(i) for i in range(20)) + "\n\n### Two\n\n" + " ".join(s.format(i) for i in range(30, 36))
    got = chunking.split_document(body, title="T", section="/a/b/", budget=chunking.Budget(min_chars=20))
    assert all(c[1] <= 420 and len(c[-1]) >= 20 for c in got)
    assert got[0][4] == ["b", "T", "One"] and got[0][-1].count("Sentence") == 8
    assert [c[0] for c in got] == list(range(1, len(got) + 1))
    root = chunking.split_document(body, budget=chunking.Budget(min_chars=20))
    assert root[-1][4] == ["One", "Two"] and root[-1][-1].startswith("Sentence number 1")  # what waited overlaps
    assert chunking.split_document("") == []
    long = "Long " + ", ".join(f"word{i}" for i in range(1000)) + "."
    parts = chunking.split_document("Short one. " + long, budget=chunking.Budget(min_chars=1))
    assert parts[0][-1] == "Short one." and len(parts) == 60 and parts[1][-1].startswith("Long word0 word1")
    assert len(chunking.split_document(long)) == 1  # a long first sentence stays whole


def test_token_set_ratio():
    r = dedup.token_set_ratio
    assert r("a b c", "c b a a") == 100 and r("a b", "a b c d") == 100 and r("", "a") == 0
    assert r("abc", "xyz") == 0 and 0 < r("red fox", "red box") < 100
    assert r("red fox", "red box") == pytest.approx(100 * (1 - 2 / 14))


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
@settings(max_examples=60, deadline=None)
def test_common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    assert dedup.common_length(a, b) == row[-1]


def test_sequential(spark):
    a, b = "x " * 10 + "alpha beta gamma delta", "completely other words here"
    df = spark.createDataFrame([(1, "k", a), (2, "k", a + " beta"), (3, "k", b), (4, "k", a), (5, "m", a), (6, "k", "short")], "i int, b string, t string")
    got = dict(dedup.sequential_near_dup(df, bucket="b", order="i", text="t", threshold=90, min_chars=10).select("i", "is_dup").collect())
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_growth(spark):
    rows = [(1, "s", i, t, len(t)) for i, t in enumerate(["aaa bbb", "aaa bbb", "ccc ddd eee fff", "zzz yyy"])]
    df = spark.createDataFrame(rows, "d int, s string, q int, t string, n int")
    keep = lambda c: [r.q for r in dedup.keep_if_grown(df, doc="d", section=["s"], seq="q", text="t", tokens="n", compat=c).orderBy("q").collect()]
    assert keep(False) == [0, 2, 3] and keep(True) == [0, 2]


def test_upsert_and_insert(spark):
    df = lambda *rows: spark.createDataFrame(rows, "k int, v int, x string")
    got = dedup.upsert(df((1, 1, "a"), (2, 5, "b")), df((1, 2, "c"), (2, 4, "d"), (3, 1, None)), ["k"], ["v"])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 2, "c"), (2, 5, "b"), (3, 1, None)]
    assert dedup.insert_absent(df((1, 1, "a")), df((1, 9, "z"), (2, 2, "b"), (2, 2, "b")), ["k"]).count() == 2


def test_vectors(spark):
    v = F.array(*map(F.lit, (3.0, 4.0)))
    assert one(spark, V.norm(v)) == 5 and one(spark, V.norm(V.unit(v))) == pytest.approx(1)
    assert one(spark, V.clamp01(F.lit(float("nan")))) == 0 and one(spark, V.clamp01(F.lit(1.5))) == 1
    assert one(spark, V.rescored(F.lit(0.5), F.lit(1.0))) == pytest.approx(0.85)


@pytest.mark.parametrize("sql", ["select * from parquet.`/etc`", "select reflect('java.lang.Math', 'abs', -1)", "select * from secret", "insert into team values (1)", "select 1; select 2", "drop table team", "with a as (select 1) select * from a"])
def test_guard_refuses(spark, sql):
    with pytest.raises(Exception):
        sqlqa.ask(spark, sql, {"team"}).collect()


def test_guard_limits(spark):
    spark.range(500).createOrReplaceTempView("many")
    assert sqlqa.ask(spark, "select id from many", {"many"}).count() == 100
    assert sqlqa.ask(spark, "select id from many\nLIMIT 7", {"many"}).count() == 7
    assert len(sqlqa.within(spark, sqlqa.ask(spark, "select id from many", {"many"}))) == 100


def test_answers(spark):
    assert sqlqa.phrase([], ["a"]).startswith("Данные") and sqlqa.phrase([(3,)], ["a"]).endswith("3")
    level = lambda rows, limited=False: sqlqa.confidence(spark.createDataFrame(rows, "a string, b int"), limited).first().confidence
    assert [level([]), level([("x", 1), (None, 2)]), level([("x", 0)]), level([("n/a", 1)]), level([("x", 1)]), level([("x", 1)] * 100, True)] == [0.1, 0.3, 0.3, 0.3, 0.9, 0.7]


def test_routing(spark):
    df = spark.createDataFrame([("Сколько людей в команде?",), ("How to use the tokenizer pipeline",), ("latest google issue #12",), ("zzz",)], "t string")
    got = [r.route for r in routing.pick(routing.scored(df, "t")).collect()]
    assert got == ["sql", "docs", "web", ""]
    steps = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.9), (1, 3, 0.95)], "g int, o int, s double")
    assert routing.run_until(steps, "g", "o", "s", F.lit(0.8)).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "src" / "guide").mkdir(parents=True)
    (tmp_path / "src" / "guide" / "a.md").write_text("# Hello\n\nSome text   here.\n\n## Part")
    (tmp_path / "src" / "guide" / "skip.md").write_text("no")
    files = documents.read_files(spark, str(tmp_path / "src"), exclude="skip").withColumn("path", F.regexp_extract("path", "src/.*", 0))
    docs = documents.parse(files, product="P", product_code="p", version="v1", lang="en", commit="c0")
    out = str(tmp_path / "processed")
    documents.write_documents(docs, out)
    row = spark.read.parquet(out).first()
    assert (row.meta.title, row.meta.section, row.meta.anchor, row.product_code) == ("Hello", "/guide/", "part", "p")
    docs.drop("x").write.json(str(tmp_path / "lines"))
    assert documents.read_documents(spark, str(tmp_path / "lines")).first().meta.title == "Hello"
    documents.reset(spark, out)
    with pytest.raises(ValueError):
        documents.reset(spark, str(tmp_path / "src"))


def test_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = lambda lo: spark.createDataFrame([(i % 3, i) for i in range(lo, lo + 6)], "k int, v int")
    schema = rows(0).schema
    rows(0).write.parquet(src)
    ingest.stream_upsert(spark, src, out, cp, schema=schema, key=["k"], version=["v"])
    rows(6).write.mode("append").parquet(src)
    merged = ingest.stream_upsert(spark, src, out, cp, schema=schema, key=["k"], version=["v"])
    assert sorted(map(tuple, merged.collect())) == [(0, 9), (1, 10), (2, 11)]


def test_stats(spark):
    df = spark.createDataFrame([(0,)], "x int").where("x > 0")
    assert stats.ingest_stats(df, F.col("x") > 0, F.col("x") < 0).first().success_rate == 0


def test_top_k_of_more_queries_than_a_block(spark, monkeypatch):
    """Queries beyond a block are searched like those of one."""
    from quillspark.operators import retrieval

    points = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(12)], "point_id long, vec array<double>")
    queries = spark.createDataFrame([(i, [1.0, i / 25]) for i in range(25)], "query_id long, query_vec array<double>")
    parents = points.selectExpr("point_id as parent_id", "vec as parent_vec")
    children = points.selectExpr("point_id % 3 as parent_id", "point_id", "vec")
    search = lambda: (sorted(map(str, retrieval.top_k(queries, points, 2).collect())), sorted(map(str, retrieval.retrieve(queries, parents, children).collect())))
    want = search()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 10)
    assert search() == want and len(want[0]) == 50


def test_modules_beyond_the_default_limit(spark, tmp_path):
    """The registered question has no limit in its SQL, so more than 100 modules come back."""
    from quillspark.plans.catalogue import QUERIES

    spark.createDataFrame([(1, "PERU", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(f"m{i}", 1) for i in range(150)], "s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    assert QUERIES["nlsql_modules"](spark, str(tmp_path)).count() == 150


@pytest.mark.parametrize("tile", [8192, 9])
def test_children_by_tiles(spark, monkeypatch, tile):
    """The k best children by products against all pairs scored by Spark: copies, ties, opposite and orthogonal vectors, odd ones; rows in proportion to hits."""
    rng = random.Random(3)
    vec = lambda: [float(rng.choice([-1, 0, 0, 1, rng.gauss(0, 1)])) for _ in range(4)]
    copies = vec()
    rows = [(rng.choice(["a", "b"]), i, rng.choice([vec(), vec(), copies, [0.0] * 4, [1.0, 0.0, 0.0, 0.0], [0.0, -1.0, 0.0, 0.0]])) for i in range(120)]
    rows += [("a", 200, None), ("a", 201, [1.0]), ("b", 202, []), ("b", 203, [float("nan")] * 4), ("a", 5, copies), ("a", None, copies), ("none", 300, copies)]
    asked = [(i, vec()) for i in range(30)] + [(50, [0.0] * 4), (51, [-x for x in copies]), (52, [1.0, 0.0, 0.0, 0.0]), (53, None)]
    children = spark.createDataFrame(rows, "parent_id string, point_id long, vec array<float>")
    queries = spark.createDataFrame(asked, "query_id long, query_vec array<double>")
    monkeypatch.setattr(retrieval, "TILE_CHILDREN", tile)
    monkeypatch.setattr(retrieval, "TILE_ASKED", tile)
    hits = queries.join(spark.createDataFrame([("a",), ("b",)], "parent_id string"), F.lit(True))
    got = retrieval.children_of(hits, children, 3, query_vec="query_vec")
    scored = hits.join(children, "parent_id").withColumn("child_score", V.clamp01(V.cosine(V.doubles(F.col("vec")), F.col("query_vec"))))
    w = Window.partitionBy("query_id", "parent_id").orderBy(F.desc("child_score"), "point_id")
    want = scored.withColumn("child_rank", F.row_number().over(w)).where("child_rank <= 3")
    cols = ["query_id", "parent_id", "point_id", "child_score", "child_rank"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def test_tile_keeps_few_of_a_crowd():
    """Of 20,000 equal vectors and as many near ones a tile gives k pairs for each query."""
    many = np.random.default_rng(1).normal(size=(5, 8))
    points = pa.array([*([many[0].tolist()] * 20_000), *np.random.default_rng(2).normal(size=(5000, 8)).tolist()], pa.list_(pa.float64()))
    i, j = retrieval._best_of_tile(points, pa.array(many.tolist(), pa.list_(pa.float64())), 4)
    assert len(i) == 20 and j[i == 0].tolist() == [0, 1, 2, 3]
