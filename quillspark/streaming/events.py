"""Windows and sessions over event streams that come out of order: late rows are left out and counted."""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Progress reports that a run keeps; each tells the rows of a micro-batch.
REPORTS = 100_000


@dataclass(frozen=True)
class Run:
    """What a stream has given so far (closed), what is still in its state (open), rows that the last run read, and those of them that came too late."""

    closed: DataFrame
    open: DataFrame
    rows: int
    late: int


def _held(spark: SparkSession, checkpoint: str) -> DataFrame | None:
    """The state of a stream's aggregation, as last committed; None before the first batch."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(p) or not any(str(x.getPath().getName()).isdigit() for x in fs.listStatus(p)):
        return None
    return spark.read.format("statestore").load(checkpoint)


def _run(spark: SparkSession, source: str, target: str, checkpoint: str, schema, ts: str, late: str, max_files: int, grouped, opened, partitions: int | None, each: int) -> Run:
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.numRecentProgressUpdates", str(REPORTS))
    if partitions:
        own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    rows = own.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    # times without a zone are those of the session
    counted = grouped(rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late))
    out = counted.schema

    def seen() -> int:
        state = _held(spark, checkpoint)
        there = spark.read.schema(out).parquet(target).agg(F.sum("n")).first()[0] if state is not None else 0
        return (there or 0) + ((opened(state).agg(F.sum("n")).first()[0] or 0) if state is not None else 0)

    before = seen()
    q = counted.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    n = sum(p["numInputRows"] for p in q.recentProgress)
    state = _held(spark, checkpoint)
    left = opened(state) if state is not None else spark.createDataFrame([], out)
    return Run(spark.read.schema(out).parquet(target), left, n, n * each - (seen() - before))


def stream_windows(spark: SparkSession, source: str, target: str, checkpoint: str, *, schema, ts: str, kind: str, every: str, late: str, slide: str | None = None, overlaps: int = 1, max_files: int = 64, partitions: int | None = None) -> Run:
    """Read what is new at source once; counts (start, end, kind, n) of windows by kind, appended to target once they are closed.

    A window closes when the greatest time that earlier batches held is `late`
    beyond its end; rows that come after that are left out and counted, so closed
    windows never change and state holds open ones alone. slide: windows that
    overlap, `overlaps` of them over each row; `late` of the run then counts a row
    once for each window that it missed. Rows without a time are late; those without a
    kind are a kind of their own.
    """
    cols = ["start", "end", kind, "n"]
    shaped = lambda df, w, k: df.select(w["start"].alias("start"), w["end"].alias("end"), k.alias(kind), F.col("n"))

    def grouped(rows: DataFrame) -> DataFrame:
        window = F.window(ts, every, slide) if slide else F.window(ts, every)
        return shaped(rows.groupBy(window.alias("w"), F.col(kind)).agg(F.count("*").alias("n")), F.col("w"), F.col(kind)).select(*cols)

    def opened(state: DataFrame) -> DataFrame:
        key = state.schema["key"].dataType.names
        return state.select(F.col("key")[key[0]].alias("w"), F.col("key")[key[1]].alias(kind), F.col("value")["count"].alias("n")).transform(lambda df: shaped(df, F.col("w"), F.col(kind)))

    return _run(spark, source, target, checkpoint, schema, ts, late, max_files, grouped, opened, partitions, overlaps)


def stream_sessions(spark: SparkSession, source: str, target: str, checkpoint: str, *, schema, ts: str, key: str, gap: str, late: str, max_files: int = 64, partitions: int | None = None) -> Run:
    """Sessions (key, start, end, n) that end after a gap, appended to target once they are closed; as stream_windows().

    Rows that come out of order join sessions that are open, and may join two of them.
    """

    def grouped(rows: DataFrame) -> DataFrame:
        w = F.session_window(ts, gap)
        return rows.groupBy(w.alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col(key), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

    def opened(state: DataFrame) -> DataFrame:
        value: Column = F.col("value")
        names = state.schema["value"].dataType.names
        return state.select(value[key].alias(key) if key in names else F.col("key")[key].alias(key), value["session_window"]["start"].alias("start"), value["session_window"]["end"].alias("end"), value["count"].alias("n"))

    return _run(spark, source, target, checkpoint, schema, ts, late, max_files, grouped, opened, partitions, 1)
