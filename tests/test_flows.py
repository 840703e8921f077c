"""Sources, payloads, stores, routing entry, near-duplicate state and streams."""
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import ids, text, vectors
from quillspark.operators import dedup, payloads, routing, sqlqa, store
from quillspark.sources import documents
from quillspark.sources.tables import Table
from quillspark.streaming import ingest


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).first()[0]


def test_globs(spark, tmp_path):
    for name in ("a.md", "sub/b.md", "sub/deep/c.mdx", "drafts/d.md", "e.txt"):
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    found = lambda *a, **k: [r.text for r in documents.read_files(spark, f"{tmp_path}/root", *a, **k).orderBy("path").collect()]
    assert found(["*.md", "sub/**/*.mdx"], ["drafts/*"]) == ["a.md", "sub/b.md", "sub/deep/c.mdx"]
    assert found(["sub/*.md"]) == ["sub/b.md"]
    assert found("*.txt") == ["e.txt"]
    assert found(["*.md", "a.*"], "draft") == ["a.md", "sub/b.md"]
    import hashlib

    got = {os.path.basename(r.path): r.digest for r in documents.file_hashes(spark, f"{tmp_path}/root").collect()}
    assert got["e.txt"] == hashlib.sha256(b"e.txt").hexdigest()


def test_stored_rows(spark, tmp_path):
    def write(name, *lines):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))

    write("docs/a.jsonl", {"text": "first", "source_ref": "a"}, {"text": "second"})
    write("docs/b.jsonl", "{broken", {"text": "late"})
    assert [r.text for r in documents.read_documents(spark, f"{tmp_path}/docs").collect()] == ["first"]
    write("chunks/x.jsonl", {"text": "one", "seq": 1, "meta": {"extra": {"chunk_id": "E"}}}, "", {"text": "two", "chunk_id": "T"}, {"text": "three", "seq": 3})
    write("chunks/_parents/p.jsonl", {"type": "parent", "parent_id": "p", "text": "t", "meta": {"title": "Title", "document_id": "d"}}, {"type": "other", "parent_id": "q"})
    got = sorted((r.text, r.chunk_id) for r in documents.read_chunks(spark, f"{tmp_path}/chunks").collect())
    import hashlib

    assert got == [("one", "E"), ("three", f"x__seq3__{hashlib.sha1(b'three').hexdigest()[:8]}"), ("two", "T")]
    (p,) = documents.read_parents(spark, f"{tmp_path}/chunks/_parents").collect()
    assert (p.parent_id, p.document_id, p.title, p.child_ids, p.token_count) == ("p", "d", "Title", [], 0)


def test_reset_state(spark, tmp_path):
    path = f"{tmp_path}/state"
    assert not documents.reset_state(spark, path)
    for n in (1, 2):
        spark.range(n).write.parquet(path)
        assert documents.reset_state(spark, path) and not os.path.exists(path)
    assert spark.read.parquet(f"{path}.backup").count() == 2


def test_required_and_cited(spark):
    rows = spark.createDataFrame([(1, " a ", "b"), (2, "", "b"), (3, None, " ")], "n int, x string, y string")
    good, bad = payloads.required(rows, "x", "y")
    assert [tuple(r) for r in good.collect()] == [(1, "a", "b")]
    assert {r.n: r.error for r in bad.collect()} == {2: "x", 3: "x,y"}
    c = spark.createDataFrame([(1, 1, "t", None), (1, 2, " ", "k"), (1, 3, "u", "k")], "q int, n int, t string, i string")
    assert sorted((r.n, r.i) for r in payloads.cited(c, query="q", n="n", text="t", id_="i").collect()) == [(1, "citation_1"), (3, "k")]
    assert one(spark, payloads.prompt_fits(F.col("x"), 3), x="abc") and not one(spark, payloads.prompt_fits(F.col("x"), 3), x="abcd")


def test_store(spark, tmp_path):
    path = f"{tmp_path}/points"
    with pytest.raises(LookupError):
        store.ensure(spark, path, missing="error")
    base = store.ensure(spark, path).read()
    new = spark.createDataFrame([("a", [1.0, 2.0], "x"), ("b", [0.0, 1.0], "y"), ("a", [3.0, 4.0], "z")], store.POINT)
    merged = store.upsert_points(base, new)
    assert {r.id: r.payload for r in merged.collect()} == {"a": "z", "b": "y"}
    assert tuple(store.stats(merged).first()) == (2, 2, 2, 2, 0)
    with pytest.raises(Exception, match="differ in length"):
        store.upsert_points(merged, spark.createDataFrame([("c", [1.0], "x")], store.POINT)).collect()
    assert store.drop(spark, path) and not store.drop(spark, path)
    assert store.index_fields(["a", {"name": "b", "schema": "Integer"}]) == {"a": "keyword", "b": "integer"}
    for bad in ({"schema": "text"}, {"name": "x", "schema": "vector"}):
        with pytest.raises(ValueError):
            store.index_fields([bad])
    assert [store.distance(x) for x in ("COS", "ip", "l2")] == ["cosine", "dot", "euclid"]
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(6.0))
    assert one(spark, vectors.dot(a, b)) == 16 and one(spark, vectors.euclid(a, b)) == 5


def test_near_dup_state(spark):
    """Two runs with the state between them give what one run gives."""
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(300)) for _ in range(4)]
    rows = [(i, f"b{i % 2}", base[i // 6] + (f" tail{i}" if i % 3 == 0 else "")) for i in range(24)]
    df = spark.createDataFrame(rows, "i long, b string, t string")
    args = {"bucket": "b", "order": "i", "text": "t"}
    whole = {r.i: r.is_dup for r in dedup.sequential_near_dup(df, **args).collect()}
    first = dedup.sequential_near_dup(df.where("i < 11"), **args)
    state = dedup.near_dup_state(first, **args)
    second = dedup.sequential_near_dup(df.where("i >= 11"), state=state, **args)
    parts = {r.i: r.is_dup for r in first.unionByName(second).collect()}
    assert parts == whole and any(whole.values()) and not all(whole.values())
    again = dedup.near_dup_state(second, state=state, **args)
    assert {r.bucket for r in again.collect()} == {"b0", "b1"}


def test_order_free_near_dup(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    near = list(base)
    near[50] = "other"
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(rng.sample(base, 200))), (4, "a b"), (5, None), (6, " ".join(base))], "k long, t string")
    got = {r.k: r.is_dup for r in dedup.order_free_near_dup(df, key="k", text="t").collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False, 6: True}
    assert got == {r.k: r.is_dup for r in dedup.order_free_near_dup(df.repartition(5), key="k", text="t").collect()}


def test_routing_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([("how to load a model", 7, 8)], "_q string, q long, _docs long")
    got = routing.scored(df, "_q").first()
    assert (got["_q"], got.q, got["_docs"], got.docs) == ("how to load a model", 7, 8, 1.0)
    r = routing.routed(df, "_q").first()
    assert (r.route, r.q) == (["docs"], 7)


def test_labels_of_replies(spark):
    said = lambda x: tuple(one(spark, routing.parsed_labels(F.col("x")), x=x))
    assert said('```json\n{"route": ["SQL", "x"], "confidence": 2}\n```') == (["sql"], 1.0)
    assert said("nothing") == (["docs"], 0.6) and said('{"route": [], "confidence": 0.9}') == (["docs"], 0.6)


def test_negative_answers(spark):
    rows = spark.createDataFrame([("fine",)], "v string")
    assert sqlqa.confidence(rows, False).first().confidence == 0.9
    assert sqlqa.confidence(rows, False, said="Ничего нет").first().confidence == 0.2


def test_text_rules(spark):
    assert one(spark, text.normalize_query(F.col("x")), x="  Кафей  ") == "кафей"
    tildes = "a   \n~~~\nx   \n~~~\nb"
    assert one(spark, text.preprocess(F.col("x")), x=tildes) == "a\n~~~\nx   \n~~~\nb\n"
    before = "~~~\nx   \n~~~\n```\ny   \n```\n"
    assert one(spark, text.preprocess(F.col("x")), x=before) == "~~~\nx\n~~~\n```\ny   \n```\n"
    assert one(spark, ids.composite_id(F.col("a"), F.col("b")), a="x", b=3) == "x_3"


def test_tabs(spark):
    chosen = lambda x: one(spark, text.chosen_tabs(F.col("x")), x=x)
    item = lambda v, b: f'<TabItem label="l" value="{v}" x>{b}</TabItem>'
    assert chosen(f"a <Tabs>{item('npm', 'x')}\n{item('conda', ' y ')}{item('bash', 'z' * 200_000)}</Tabs> b") == f"a {'z' * 200_000} b"
    assert chosen(f"<tabs a='b'>{item('npm', 'first')}{item('yarn', 'second')}</tabs>") == "first"
    assert chosen("<Tabs> no <i>tabs</i> </Tabs>|<Tabs></Tabs>|") == " no <i>tabs</i> ||"
    deep = f"<Tabs>{item('x', 'no')}{item('pip', 'in ' + '<Tabs>' + item('pt', '1') + item('python', '2') + '</Tabs>')}</Tabs>"
    assert chosen(deep) == "in 2" and chosen("<Tabs>open " + deep) == "<Tabs>open in 2" and chosen("plain < text") == "plain < text" and chosen("") == ""
    assert chosen("```\n<Tabs>\n" + item("pip", "```py\nx\n```") + "</Tabs>") == "```\n```py\nx\n```"


def test_stream_survives_a_lost_write(spark, tmp_path, monkeypatch):
    """A batch that fails while it writes leaves the last version; the next run repeats it."""
    src, out, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    frame = lambda rows: spark.createDataFrame(rows, "k long, v long")
    frame([(1, 1), (2, 1), *[(k, 1) for k in range(10, 30)]]).coalesce(1).write.parquet(src)
    args = dict(schema="k long, v long", key=["k"], version=["v"])
    got = lambda df: {r.k: r.v for r in df.collect()}
    assert len(got(ingest.stream_upsert(spark, src, out, ck, **args))) == 22
    frame([(2, 5), (3, 1)]).coalesce(1).write.mode("append").parquet(src)
    real = ingest.upsert
    monkeypatch.setattr(ingest, "upsert", lambda *a: real(*a).withColumn("v", F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        ingest.stream_upsert(spark, src, out, ck, **args)
    table = Table(spark, out)
    first = table.version()
    assert first.number == 0 and len(got(ingest.current(spark, out, "k long, v long"))) == 22
    monkeypatch.setattr(ingest, "upsert", real)
    rows = got(ingest.stream_upsert(spark, src, out, ck, **args))
    assert len(rows) == 23 and (rows[1], rows[2], rows[3]) == (1, 5, 1)
    # only the buckets of keys 2 and 3 were written again
    second = table.version()
    assert second.number == 1 and 1 <= sum(first.parts.get(b) != f for b, f in second.parts.items()) <= 2
    for n in (6, 7):
        frame([(2, n)]).coalesce(1).write.mode("append").parquet(src)
        assert got(ingest.stream_upsert(spark, src, out, ck, **args))[2] == n
    assert table.versions() == [2, 3] and got(table.read(2))[2] == 6


def test_tokens_by_a_tokenizer(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no tokenizer here")
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",)], "x string")
    got = [r[0] for r in df.select(text.n_tokens_by(F.col("x"), path)).collect()]
    assert got[:3] == [2, 0, 0] and got[3] > 1
