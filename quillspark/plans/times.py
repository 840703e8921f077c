"""Queries that join by time."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import timejoin
from quillspark.plans.registry import query
from quillspark.sources.documents import read_table

DAY = 86_400_000_000


@query("""select e.event_id, e.user_id, v.event_id as view_id, round(cast(v.value as double), 2) as view_value
from (select * from events where event_type = 'error') e asof left join (select * from events where event_type = 'view') v on e.user_id = v.user_id and e.ts >= v.ts""")
def last_view_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error the user's last view before it."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    found = timejoin.as_of(e.where("event_type = 'error'"), e.where("event_type = 'view'"), left_ts="ts", right_ts="ts", keys=["user_id"], order=["event_id"], prefix="view_")
    return found.select("event_id", "user_id", F.col("view_event_id").alias("view_id"), F.round("view_value", 2).alias("view_value"))


@query("""select e.event_id, e.user_id, (select max(event_id) from events v where v.event_type = 'click' and v.user_id = e.user_id and v.ts < e.ts and v.ts >= e.ts - interval 1 day
 and v.ts = (select max(ts) from events u where u.event_type = 'click' and u.user_id = e.user_id and u.ts < e.ts)) as click_id from events e where event_type = 'purchase'""")
def click_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the user's last click, if it was within a day before; busy users cut into slices of time."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    found = timejoin.as_of(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), left_ts="ts", right_ts="ts", keys=["user_id"], within=DAY, strict=True, order=["event_id"], prefix="click_", slice_rows=64)
    return found.select("event_id", "user_id", F.col("click_event_id").alias("click_id"))


_SPANS = "s as (select event_id as span_id, user_id, ts as a, ts + to_minutes(cast(event_id % 11 * event_id % 1500 + 1 as bigint)) as z from events where event_type = 'signup')"


@query(f"with {_SPANS} select span_id, count(*) as n, min(event_id) as first_event, max(event_id) as last_event from s join events e on e.user_id = s.user_id and e.ts >= a and e.ts < z group by span_id")
def events_within_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user within spans of a minute to a day that begin with a signup."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    found = timejoin.within(e.select("event_id", "user_id", "ts"), _spans(e), at="ts", start="a", end="z", keys=["user_id"])
    return found.groupBy(F.col("interval_span_id").alias("span_id")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def _spans(e: DataFrame) -> DataFrame:
    z = F.timestamp_micros(timejoin.micros(F.col("ts")) + (F.col("event_id") % 11 * F.col("event_id") % 1500 + 1) * 60_000_000)
    return e.where("event_type = 'signup'").select(F.col("event_id").alias("span_id"), "user_id", F.col("ts").alias("a"), z.alias("z"))


@query(f"with {_SPANS} select x.span_id, count(*) as n_overlaps, min(y.span_id) as first_other from s x join s y on x.a < y.z and y.a < x.z and x.span_id <> y.span_id group by x.span_id")
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each span how many of all users overlap it, and the first of these: by time alone, without a row for each pair."""
    s = _spans(read_table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")).select("span_id", "a", "z")
    return timejoin.overlap_summary(s, start="a", end="z", id_="span_id")
