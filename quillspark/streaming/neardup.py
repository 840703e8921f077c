"""Near duplicates of a document stream, against the last kept text of their bucket."""
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.operators.dedup import SAMPLE, token_set_ratio

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastKept(StatefulProcessor):
    """One value of state a bucket: the first characters of the text that was kept last."""

    def __init__(self, kind: T.DataType, threshold: float, min_chars: int):
        self.kind, self.threshold, self.min_chars = kind, threshold, min_chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", T.StructType([T.StructField("text", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a bucket's rows of one micro-batch come in no order; the batch's files bound them
        now = pd.concat(rows).sort_values("at", kind="stable", na_position="first")
        kept = self.kept.get()[0] if self.kept.exists() else None
        before, found = kept, []
        for text in now["text"]:
            dup = False
            if text and len(text) >= self.min_chars:
                dup = kept is not None and token_set_ratio(text, kept) >= self.threshold
                kept = kept if dup else text[:SAMPLE]
            found.append(dup)
        if kept != before:
            self.kept.update((kept,))
        yield pd.DataFrame({"bucket": key[0], "at": now["at"].array, "is_dup": found})

    def close(self) -> None:
        pass


def stream_near_dup(spark: SparkSession, source: str, target: str, checkpoint: str, *, schema, bucket: str, order: str, text: str, threshold: float = 97, min_chars: int = 1200, max_files: int = 64, partitions: int | None = None) -> DataFrame:
    """Read what is new at source once, mark each row against its bucket's last kept text, append to target; all rows marked so far.

    What `sequential_near_dup` gives over rows in order of arrival: by micro-batch,
    within one by `order`. State is a text of at most 2,000 characters for each
    bucket, in RocksDB with the checkpoint, so a run that ends or fails goes on where
    it was, and the file sink counts a repeated batch once. A task holds a bucket's
    rows of one micro-batch, which max_files bounds. partitions (of the state) count
    at the first run alone; the checkpoint keeps them.

    Null texts are no duplicates; null buckets are a bucket of their own; an empty
    source gives no rows.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    if partitions:
        own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    rows = own.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    rows = rows.select(F.col(bucket).cast("string").alias("bucket"), F.col(order).alias("at"), F.col(text).alias("text"))
    out = T.StructType([T.StructField("bucket", T.StringType()), T.StructField("at", rows.schema["at"].dataType), T.StructField("is_dup", T.BooleanType())])
    marked = rows.groupBy("bucket").transformWithStateInPandas(LastKept(rows.schema["at"].dataType, threshold, min_chars), out, "Append", "None")
    marked.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(out).parquet(target)
    return found.select(F.col("bucket").alias(bucket), F.col("at").alias(order), "is_dup")
