import random

import corpus_pipeline
from llm_fixtures import sentence

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        n.append(docs.count())
        if name != "mixing":
            assert docs.columns == COLUMNS
    assert n == sorted(n, reverse=True) and n[-1] > 0.5 * n[0]
    assert docs.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]


def test_decisions(spark, tmp_path, make):
    """Planted rows: copies, near copies, repeated lines, benchmark text, and clean rows."""
    rng = random.Random(6)
    clean = [(i, sentence(rng, 60, 5000)) for i in range(12)]
    passage = sentence(rng, 30, 9999)
    base = sentence(rng, 200, 5000)
    rows = clean + [(50, base), (51, base), (52, base.replace(" ", "  ", 1)), (60, clean[0][1] + "\n" + sentence(rng, 40, 5000)), (70, sentence(rng, 50, 5000) + "\n" + passage + " end"), (80, None), (81, "")]
    df = make(rows).select(*COLUMNS)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = str(tmp_path)
    assert corpus_pipeline.drop_toxic(spark, df, d).count() == len(rows)
    lines = {r.doc_id: r for r in corpus_pipeline.dedup_lines(spark, df, d).collect()}
    assert 51 not in lines and 52 not in lines and clean[0][1] not in lines[60].text
    assert all(lines[i].text == t for i, t in clean) and lines[60].n_chars == len(lines[60].text)
    near = {r.doc_id for r in corpus_pipeline.dedup_documents(spark, df, d).collect()}
    assert {50, *(i for i, _ in clean)} <= near and not {51, 52} & near and len({80, 81} & near) == 1
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_benchmark(spark, df, d).collect()}
    assert passage not in left[70] and left[70].endswith(" end") and all(left[i] == t for i, t in clean)


def test_repeated_ids(spark, make):
    """Two texts under one id: the copy goes, the other stays; equal rows of the id that stays are all there."""
    rng = random.Random(7)
    a, b, c = (sentence(rng, 80, 5000) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (2, c), (2, c), (None, a), (9, None), (9, "")]
    left = corpus_pipeline.dedup_documents(spark, make(rows).select(*COLUMNS), "").collect()
    got = sorted(((r.doc_id, r.text) for r in left), key=str)
    assert [x for x in got if x[0] != 9] == sorted([(1, a), (5, b), (2, c), (2, c), (None, a)], key=str)
    assert len(got) == 6


def test_empty(spark, sf, make):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, make([]).select(*COLUMNS), sf).count() == 0


def test_run_leaves_only_what_is_read(spark, tmp_path):
    """run() gives the rows of its stages applied one after the other, and deletes each stage's rows once they are read."""
    import glob

    from quillspark.llm.session import shared_folder

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/cut-*"))
    got = corpus_pipeline.run(spark, sf)
    rows = sorted(map(tuple, got.collect()))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert rows == sorted(map(tuple, docs.select(*got.columns).collect()))
    made = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/cut-*")) - before
    texts = [p for p in made if {"text", "lang"} <= set(spark.read.parquet(p).columns)]
    assert not texts
