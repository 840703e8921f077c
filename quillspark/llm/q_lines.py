"""Query op2_lines. Components of links have no SQL; tests compare with brute force."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.lines import dedup_lines


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its lines, those removed as repeats, and a digest of the text left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, report=True).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
