"""Counters and reports."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole; 0 of nothing."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def ingest_stats(rows: DataFrame, ok: Column, error: Column) -> DataFrame:
    """One row of counts and the success rate; partial sums merge before the shuffle."""
    got = rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("n_ok"), F.count_if(error).alias("n_error"))
    return got.withColumn("success_rate", share(F.col("n_ok"), F.col("n_ok") + F.col("n_error")))


def merged(*parts: DataFrame) -> DataFrame:
    """Sums of several rows of counts, the rate taken anew."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    got = every.agg(*[F.sum(c).alias(c) for c in ("total", "n_ok", "n_error")])
    return got.withColumn("success_rate", share(F.col("n_ok"), F.col("n_ok") + F.col("n_error")))


def store_rollup(docs: DataFrame, levels: list[str], size: Column) -> DataFrame:
    """Counts and sizes at each level with subtotals; `level` tells how many of the levels are summed over."""
    return docs.rollup(*levels).agg(F.count("*").alias("n_docs"), F.sum(size).alias("total_size"), F.grouping_id().alias("level"))


def chunk_report(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row: chunks, those with code and tables, mean characters and the shares."""
    got = chunks.agg(F.count("*").alias("n_chunks"), F.count_if("has_code").alias("n_code"), F.count_if("has_table").alias("n_table"), F.avg(F.char_length(text)).alias("avg_chars"))
    return got.withColumn("code_share", share(F.col("n_code"), F.col("n_chunks"))).withColumn("table_share", share(F.col("n_table"), F.col("n_chunks")))
