"""Query op8_toxicity. A trained model has no SQL; tests measure it on held-out rows."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.toxicity import learn, score

#: Rows whose crc32 of the id as text leaves 0 modulo FOLDS are held out.
FOLDS = 5


def held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its score by a model that never saw held-out labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    scored = score(docs, learn(docs, labels), out_col="score")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
