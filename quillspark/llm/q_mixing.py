"""Query op6_mixing. Draws have no SQL; tests check targets by plain Python and the draws' sums."""
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.mixing import mix


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words that the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs)[1].select("doc_id", "size", "source_size", "target", "taken")
