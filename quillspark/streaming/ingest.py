"""Incremental ingest: file streams into keyed tables and windows over events."""
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.dedup import upsert
from quillspark.sources.tables import Table, Version

#: Buckets of keys that a new streamed table is kept in; a batch rewrites only those that it touches.
BUCKETS = 64


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream of a checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def merge_batch(table: Table, batch: DataFrame, key: list[str], version: list[str], *, stream: str, n: int, buckets: int = BUCKETS, keep: int = 2) -> Version:
    """Merge a batch into the buckets that it touches, in one commit that also notes the stream's batch; a batch that is noted already changes nothing."""
    last = table.version()
    seen = dict(last.notes.get("streams", {}))
    if seen.get(stream, -1) >= n:
        return last
    # a table keeps the number of buckets that it was made with
    buckets = last.notes.get("buckets", buckets)
    bucket = _bucket(key, buckets)
    touched = [str(r[0]) for r in batch.select(bucket.alias("bucket")).distinct().collect()]
    parts = dict(last.parts)
    if touched:
        names = batch.schema.names
        merged = upsert(table.read(last, parts=touched, schema=batch.schema).select(*names), batch, key, version)
        tag = next(f"bucket{'_' * i}" for i in range(len(names) + 1) if f"bucket{'_' * i}" not in {x.lower() for x in names})
        parts |= table.put(merged.withColumn(tag, bucket).repartition(tag), tag)
    made = table.commit(last, parts, batch.schema, streams={**seen, stream: n}, buckets=buckets)
    table.vacuum(keep)
    return made


def rebucket(table: Table, key: list[str], buckets: int) -> Version:
    """Deal a table out to another number of buckets, in one commit: for one that has outgrown its buckets."""
    last = table.version()
    rows = table.read(last)
    tag = next(f"bucket{'_' * i}" for i in range(len(rows.columns) + 1) if f"bucket{'_' * i}" not in {x.lower() for x in rows.columns})
    return table.commit(last, table.put(rows.withColumn(tag, _bucket(key, buckets)).repartition(buckets, tag), tag), rows.schema, buckets=buckets)


def current(spark: SparkSession, target: str, schema) -> DataFrame:
    """The merged table."""
    return Table(spark, target).read(schema=schema)


def stream_upsert(spark: SparkSession, source: str, target: str, checkpoint: str, *, schema, key: list[str], version: list[str], columns: list[str] | None = None, keep: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """Read what is new at source once and merge it into target; the merged table.

    The table lies in buckets of keys, and its versions are numbered by the table
    itself: streams come and go, each notes its last batch in the version that holds
    it. A batch that fails leaves everything as it was, one that is repeated after it
    was committed changes nothing. buckets count when the table is made; a later
    run keeps to those (rebucket() changes them). Of two rows of a key the greater
    by `version` stays, whichever stream brought it. The last `keep` versions stay.
    """
    table = Table(spark, target)
    rows = spark.readStream.schema(schema).parquet(source)
    rows = rows.select(*columns) if columns else rows

    def merge(batch: DataFrame, n: int) -> None:
        merge_batch(table, batch, key, version, stream=_stream_id(spark, checkpoint), n=n, buckets=buckets, keep=keep)

    rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.read(schema=rows.schema)


def windowed_counts(events: DataFrame, *, ts: str, kind: str, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by kind and tumbling window, with a watermark on streams."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, every).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def sessions(events: DataFrame, *, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after a gap."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
