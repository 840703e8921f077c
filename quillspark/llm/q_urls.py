"""Query op10_urls. The model's verdicts have no SQL; tests check rules and scores against plain Python."""
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.urls import judge, labelled_urls, train

#: Verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: host, path, the rule that fits and the verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES, train(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict", "block_score")
