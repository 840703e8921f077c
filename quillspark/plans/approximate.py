"""Queries by mergeable sketches, checked against exact bounds."""
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import sketches
from quillspark.plans.registry import query, scratch
from quillspark.sources.documents import read_table
from quillspark.sources.tables import Table


@query("select event_type, count(*) as n, true as users_close, true as median_close, true as tail_close from events group by event_type")
def event_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users and quantiles of values by kind, from daily sketches of two increments; whether they lie within the bounds (5 % of the users, 3 % of the ranks)."""
    e = read_table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    table = Table(spark, f"{scratch(spark)}/sketches-{uuid.uuid4().hex}")
    for part in (F.col("event_id") % 3 == 0, F.col("event_id") % 3 != 0):
        sketches.add(table, e.where(part), ["day", "event_type"], distinct=["user_id"], quantiles=["value"])
    kinds = table.version().notes["kinds"]
    got = sketches.estimates(sketches.merged(table.read().drop("day"), ["event_type"], kinds), kinds, [0.5, 0.95])
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    rank = F.percent_rank().over(Window.partitionBy("event_type").orderBy("value"))
    ranked = e.select("event_type", "value", rank.alias("rank")).join(got.select("event_type", F.col("q_value")[0].alias("median"), F.col("q_value")[1].alias("tail")), "event_type")
    # the exact ranks that hold the estimates
    held = ranked.groupBy("event_type").agg(*[F.max(F.when(F.col("value") <= F.col(c), F.col("rank"))).alias(c) for c in ("median", "tail")])
    near = lambda c, r: F.abs(F.col(c) - r) <= 0.03
    return got.join(exact, "event_type").join(held, "event_type").select("event_type", "n", (F.abs(F.col("n_user_id") - F.col("users")) <= F.greatest(F.lit(1), 0.05 * F.col("users"))).alias("users_close"), near("median", 0.5).alias("median_close"), near("tail", 0.95).alias("tail_close"))
