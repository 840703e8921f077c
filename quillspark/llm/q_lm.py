"""Query op4_lm. A trained model has no SQL; tests check the base against brute force and the model on held-out rows."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.lm import score

#: Rows whose crc32 of the id as text leaves HELD modulo FOLDS are held out.
FOLDS, HELD = 7, 2


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its tokens, unigram base and model score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD)
