"""A training corpus from `documents` in five stages.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again as
the next one's docs. The stages learn from and compare the rows that they get:

toxicity      documents that the classifier scores at 0.5 or more go
line_dedup    fuzzy repeats of a line go, the first occurrence stays; a document without a line left goes
near_dedup    of each SimHash component the document with the smallest id stays
decontaminate benchmark passages are cut out; a document that is mostly benchmark text goes
mixing        one row per document: the words that a mix to the target weights takes of it

Defined cases, by stage: a null or empty text has the classifier's intercept as
score and stays; it has no lines, and stays; all such texts are one SimHash
component, of which the smallest id stays (rows without an id stay, and repeated
rows that are equal in id and text to the one that stays); it has no benchmark words; it has size 0 and is never
taken. Repeated rows: each is scored alike; equal in id and text they are one
document to the line dedup. Texts of any length are taken whole. Empty tables give
empty stages; an empty `labels` rejects nothing, an empty `benchmark` cuts nothing.
Columns beyond those of documents are left out by the first stage.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, lines, mixing, simhash, toxicity
from quillspark.llm.q_toxicity import held_out
from quillspark.llm.session import cut, drop_cut, free_shuffles

#: Components and trained models cannot be told in SQL; the stages are tested against brute force.
ORACLE_SQL = None
_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _measured(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*_COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a classifier of the rows labelled in `labels` (the held-out fold excepted)."""
    labels = _table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    model = toxicity.learn(docs, labels)
    return toxicity.score(docs.select(*_COLUMNS), model, out_col="toxicity").where("toxicity < 0.5").select(*_COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines. A text that had words and has none left goes with its document."""
    out = lines.dedup_lines(docs.select(*_COLUMNS), report=True)
    return _measured(out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest id; rows without an id stay.

    A row is told by its id and its text: of two texts under one id each is judged by itself.
    """
    # the many plans of the line dedup are garbage by now
    free_shuffles(spark)
    held = docs.select(*_COLUMNS, F.xxhash64("text").alias("mark"))
    # ids come first, nulls last
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    found = simhash.near_duplicates(held.select(key.alias("key"), "text"), id_col="key")
    gone = found.where("key <> component_id and not key.none").select("key.doc_id", "key.mark").distinct()
    return held.join(gone, ["doc_id", "mark"], "left_anti").select(*_COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return _measured(decontaminate.remove_overlap(docs.select(*_COLUMNS), _table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each document that is left.

    The mix itself, each drawn block with its shard, its slot and its words, is
    written below the shared folder by mixing.mix(); what is taken is counted there.
    """
    return mixing.mix(docs)[1]


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontaminate", drop_benchmark),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again; a stage's rows go once the next one's are written."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        done = cut(stage(spark, docs, sf_dir))
        drop_cut(docs)
        docs = done
        # a stage's plans and shuffles are garbage now: the driver's memory need not hold those of all stages
        free_shuffles(spark)
    return docs
