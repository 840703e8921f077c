"""Jobs, embeddings and answers end to end."""
import json

import pytest
from pyspark.sql import functions as F

from quillspark import config, jobs
from quillspark.operators import answers, embedding, retrieval, sqlqa, store
from quillspark.sources import documents
from quillspark.sources.tables import Table


def test_jobs(spark, tmp_path):
    src = tmp_path / "src" / "guide"
    src.mkdir(parents=True)
    part = lambda i: f"## Part {i}\n\n" + " ".join(f"Sentence {i} {j} tells about topic{i} at length." for j in range(12))
    body = "\n\n".join(part(i) for i in range(3))
    (src / "a.md").write_text("# A title\n\n" + body)
    (src / "b.md").write_text("# B title\n\n" + body + "\n\nOne more paragraph that ends it.")
    (src / "blank.md").write_text("  \n")
    out = str(tmp_path)
    counts = jobs.ingest(spark, str(tmp_path / "src"), f"{out}/processed", "My Product", "v1", "en", state=f"{out}/state")
    assert counts == {"total": 3, "n_parsed": 2, "n_dup": 1, "n_ok": 1, "n_error": 1}
    assert documents.read_partition(spark, f"{out}/processed", "my-product", "v1", "en").count() == 1
    assert documents.read_partition(spark, f"{out}/processed", "my-product", "v2", "en").count() == 0
    assert Table(spark, f"{out}/state").read().count() == 1
    # with the state, all that is seen again is near what was kept
    again = jobs.ingest(spark, str(tmp_path / "src"), f"{out}/again", "My Product", "v1", "en", state=f"{out}/state")
    assert again["n_dup"] == 2 and Table(spark, f"{out}/state").versions() == [0, 1]
    report = jobs.chunk(spark, f"{out}/processed", f"{out}/chunked")
    linked = spark.read.parquet(f"{out}/chunked/linked")
    assert report["n_chunks"] == linked.count() > 3 and linked.where("prev_id is not null").count() > 0
    fields = linked.first().extra
    assert fields["product"] == "My Product" and fields["document_id"] == linked.first().document_id
    assert spark.read.parquet(f"{out}/chunked/parents").where("token_count > 1200").count() == 0
    for _ in range(2):  # the second run replaces what the first wrote
        got = jobs.embed(spark, f"{out}/chunked", f"{out}/points")
        assert got["child"]["n_points"] == got["child"]["n_ids"] == linked.count() and got["parent"]["n_points"] > 0
    checked = jobs.verify(spark, f"{out}/chunked", f"{out}/points")
    assert all(c["n_missing"] == c["n_stray"] == 0 and c["unit"] and c["n"] == c["n_valid"] for c in checked.values())
    hits = answers_of(spark, f"{out}/points/child")
    assert {r.n_hits for r in hits} == {2, 0}


def answers_of(spark, path):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    found = Table(spark, path).read().limit(2).select(F.lit(1).alias("query_id"), F.rand(1).alias("score"))
    return store.sanity(queries, found).collect()


def test_settings(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nSome text that is long enough.")
    file = tmp_path / "s.json"
    file.write_text(json.dumps({"dim": 32, "provider": "", "target": "t", "sources": [{"product": "P", "root": str(tmp_path), "include": ["*.md"]}, {"product": "Q", "root": f"{tmp_path}/none"}]}))
    got = config.load(str(file), env={"QUILLSPARK_DIM": "16", "QUILLSPARK_TARGET": ""})
    assert (got.dim, got.provider, got.target, got.max_tokens) == (16, "hashing", "t", 420)
    ran = jobs.ingest_all(spark, f"{tmp_path}/processed", got)
    assert ran["counts"]["P"]["n_ok"] == 1 and list(ran["failed"]) == ["Q"]
    for bad in ({"nope": 1}, {"sources": [{"root": "x"}]}):
        file.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            config.load(str(file))


def test_messages_of_a_model():
    got = sqlqa.messages("How many?", "team(id int)")
    assert got[0]["role"] == "system" and "team(id int)" in got[0]["content"] and got[-1]["content"] == "How many?"
    assert [m["role"] for m in got[1:3]] == ["user", "assistant"] and "'maintainer'" in got[2]["content"]


def test_answers_from_documents(spark):
    texts = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(["red apples grow on trees", "blue whales swim in seas", "red apples are sweet", "whales are mammals"])], "point_id int, parent_id int, text string")
    children = embedding.embedded(texts, "text").select("point_id", "parent_id", "text", "vec")
    parents = retrieval.centroids(children, "parent_id", "vec", "point_id")
    ask = embedding.embedded(spark.createDataFrame([(1, "red apples"), (2, "whales")], "query_id int, question string"), "question", "query_vec", task="query")
    got = answers.from_documents(ask, parents, children, top_parents=1, top_children=2, min_score=0.05)
    by = {r["query_id"]: r for r in got}
    assert {c["id"] for c in by[1]["citations"]} <= {0, 2} and {c["id"] for c in by[2]["citations"]} <= {1, 3}
    assert by[1]["prompt"].startswith(answers.INTRO) and "[Source 1] Reference 1\nred apples" in by[1]["prompt"]
    assert by[1]["answer"].startswith("Echo response")
    none = answers.from_documents(ask, parents, children, min_score=2.0)
    assert all(answers.NONE in r["prompt"] and r["citations"] == [] for r in none)
    assert "Additional policy: be kind" in answers.system_prompt("be kind")


def test_answers_from_tables(spark):
    spark.createDataFrame([(1, "Ann", "maintainer"), (2, "Bob", "core-dev")], "id int, name string, role string").createOrReplaceTempView("team")
    spark.createDataFrame([("tokenizer", 1), ("vision", 1)], "name string, owner_id int").createOrReplaceTempView("modules")
    tables = {"team", "modules"}
    ask = lambda q, **k: answers.from_tables(spark, q, tables, **k)
    assert ask("кто тимлид?")["answer"].endswith("Ann")
    owned = ask("какие модули у maintainer Ann?")
    assert [r["name"] for r in owned["data"]] == ["tokenizer", "vision"] and owned["confidence"] == 0.9
    assert owned["citations"][0] == "name: tokenizer" and owned["answer"].endswith("name")
    assert ask("token", dry_run=True)["data"] == []
    assert ask("x", to_sql=lambda q: ("drop table team", {}))["guarded"]
    assert answers.render_schema(spark, ["team"]) == "team(id int, name string, role string)"
    assert answers.inner_for_relations("select 1 left outer join x", "чей модуль") == "select 1 INNER JOIN x"


def test_labels(spark):
    label = answers.source_label(F.col("a"), F.col("b"), F.col("c"), F.lit(3))
    got = spark.createDataFrame([("t", None, "s"), (None, None, "")], "a string, b string, c string").select(label.alias("l")).collect()
    assert [r.l for r in got] == ["Source: t | Section: s", "Reference 3"]
