"""Queries over streams, and their batch forms."""
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import dedup
from quillspark.plans.registry import query, scratch
from quillspark.sources.documents import read_table
from quillspark.streaming import events, neardup


def bucket():
    return F.concat_ws(":", "lang", "source", text.length_bucket(F.char_length("text")))


_TOKENS = r"list_sort(list_distinct(regexp_extract_all({0}, '\S+')))"
#: Prefix maxima of each row's candidates give the next row of the longest common subsequence.
_COMMON = """coalesce(list_reduce([[ord(c)] for c in string_split(lhs, '')], lambda row, c: list_transform(range(1, len(row) + 1), lambda j: list_max(list_transform(row[1:j], lambda v, i: case when i > 1 and ord(rhs[i - 1]) = c[1] then greatest(v, row[i - 1] + 1) else v end))), [0 for i in range(length(rhs) + 1)])[-1], 0)"""
#: Both lengths, and how far letters' counts alone hold the longest common subsequence below either.
_NEAR_DUP = rf"""
with recursive d as (select doc_id, text, concat_ws(':', lang, source, cast(length(text) // 1000 * 1000 as varchar) || '-' || cast(length(text) // 1000 * 1000 + 1000 as varchar)) as bucket from documents),
long as (select doc_id, bucket, text, {_TOKENS.format('text')} as x, row_number() over (partition by bucket order by doc_id) as n from d where length(text) >= 1200),
walk as (
 select bucket, n, doc_id, left(text, 2000) as rep, false as is_dup from long where n = 1
 union all
 select bucket, n, doc_id, case when is_dup then rep else left(text, 2000) end, is_dup from (
  select *, case when len(x) = 0 or len(y) = 0 then false
   when len(shared) > 0 and (lhs = '' or rhs = '') then true
   when gap = 1 and (100 * (1 - (1 + length(lhs)) / (length(s) + n_left)) >= 97 or 100 * (1 - (1 + length(rhs)) / (length(s) + n_right)) >= 97) then true
   when apart_at_least > 0.03 * (n_left + n_right) + 0.001 then false
   else 100 * (1 - (length(lhs) + length(rhs) - 2 * {_COMMON}) / (n_left + n_right)) >= 97 end as is_dup
  from (
   select *, length(s) + gap + length(lhs) as n_left, length(s) + gap + length(rhs) as n_right,
    list_sum([abs(length(lhs) - length(replace(lhs, c, '')) - length(rhs) + length(replace(rhs, c, ''))) for c in list_distinct(string_split(lhs || rhs, ''))]) as apart_at_least
   from (
    select bucket, n, doc_id, text, rep, x, y, shared, array_to_string(shared, ' ') as s, case when len(shared) > 0 then 1 else 0 end as gap,
     array_to_string(list_filter(x, lambda v: not list_contains(y, v)), ' ') as lhs, array_to_string(list_filter(y, lambda v: not list_contains(x, v)), ' ') as rhs
    from (select l.bucket, l.n, l.doc_id, l.text, w.rep, l.x, y, list_filter(l.x, lambda v: list_contains(y, v)) as shared from (select *, {_TOKENS.format('rep')} as y from walk) w join long l on l.bucket = w.bucket and l.n = w.n + 1)))))
select d.doc_id, d.bucket, coalesce(w.is_dup, false) as is_dup from d left join walk w using (doc_id)
"""


@query(_NEAR_DUP)
def near_dup_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against their bucket's last kept text, in order of id."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", bucket().alias("bucket"), "text")
    return dedup.sequential_near_dup(d, bucket="bucket", order="doc_id", text="text").select("doc_id", "bucket", "is_dup")


@query(_NEAR_DUP)
def near_dup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by two runs of a stream over the lower and the upper half of the ids, with state between them."""
    base = f"{scratch(spark)}/near-{uuid.uuid4().hex}"
    d = read_table(spark, sf_dir, "documents").select("doc_id", bucket().alias("bucket"), "text")
    half = F.lit(d.agg(F.expr("percentile_approx(doc_id, 0.5)")).first()[0])
    out = None
    for part in (F.col("doc_id") <= half, F.col("doc_id") > half):
        # files of ascending ids, one after the other
        d.where(part).repartitionByRange(4, "doc_id").write.mode("append").parquet(f"{base}/in")
        out = neardup.stream_near_dup(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", schema=d.schema, bucket="bucket", order="doc_id", text="text", partitions=8)
    return out.select("doc_id", "bucket", "is_dup")


#: Six days of events a batch; a tenth of them come one batch late, another tenth two.
_BATCH = "cast(datediff(cast(ts as date), date '2024-01-01') as int) div 6 + case when event_id % 10 = 7 then 2 when event_id % 10 = 3 then 1 else 0 end"
_LATE_SQL = """
with e as (select ts, event_type, user_id, date_diff('day', timestamp '2024-01-01', ts) // 6 + case when event_id % 10 = 7 then 2 when event_id % 10 = 3 then 1 else 0 end as batch from events),
seen as (select batch, max(max(ts)) over (order by batch rows between unbounded preceding and 2 preceding) - interval 2 days as mark from e group by batch),
w as (select date_trunc('day', ts) as start, event_type, date_trunc('day', ts) + interval 1 day > coalesce(mark, timestamp '1970-01-01') as in_time from e join seen using (batch))
select case when not in_time then 'late' when start + interval 1 day <= (select max(ts) - interval 2 days from e) then 'closed' else 'open' end as status, case when in_time then cast(start as timestamp) end as start, case when in_time then event_type end as event_type, count(*) as n from w group by all
"""


def _in_batches(spark: SparkSession, sf_dir: str, base: str, batch: str, columns: list[str]) -> DataFrame:
    """The events' files, one written after the other, in order of `batch`."""
    e = read_table(spark, sf_dir, "events").withColumn("batch", F.expr(batch))
    top = e.agg(F.max("batch")).first()[0]
    for n in range(top + 1):
        e.where(F.col("batch") == n).select(*columns).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return e.select(*columns)


@query(_LATE_SQL)
def event_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by kind of a stream whose rows come up to two batches late: closed and open windows, and how many rows came too late."""
    base = f"{scratch(spark)}/windows-{uuid.uuid4().hex}"
    e = _in_batches(spark, sf_dir, base, _BATCH, ["ts", "event_type"])
    run = events.stream_windows(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", schema=e.schema, ts="ts", kind="event_type", every="1 day", late="2 days", max_files=1, partitions=4)
    told = lambda df, status: df.select(F.lit(status).alias("status"), "start", "event_type", "n")
    late = spark.range(1).select(F.lit("late").alias("status"), F.lit(None).cast("timestamp").alias("start"), F.lit(None).cast("string").alias("event_type"), F.lit(run.late).cast("long").alias("n")).where("n > 0")
    return told(run.closed, "closed").unionByName(told(run.open, "open")).unionByName(late)


@query("""with e as (select user_id, ts, case when ts > lag(ts) over (partition by user_id order by ts) + interval 6 hours then 1 else 0 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as k from e), t as (select user_id, min(ts) as start, max(ts) + interval 6 hours as end, count(*) as n from s group by user_id, k)
select user_id, start, "end", n, "end" <= (select max(ts) - interval 1 hour from events) as closed from t""")
def event_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with six hours between them, from a stream in order; whether they are closed."""
    base = f"{scratch(spark)}/sessions-{uuid.uuid4().hex}"
    e = _in_batches(spark, sf_dir, base, "cast(datediff(cast(ts as date), date '2024-01-01') as int) div 10", ["ts", "user_id"])
    run = events.stream_sessions(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", schema=e.schema, ts="ts", key="user_id", gap="6 hours", late="1 hour", max_files=1, partitions=4)
    return run.closed.withColumn("closed", F.lit(True)).unionByName(run.open.withColumn("closed", F.lit(False)))
