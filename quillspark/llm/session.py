"""Shared plumbing: the shared folder, cutting lineage, sizes, Arrow maps."""
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset (a local session, as in tests) a folder of the local
    machine is made and set.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: short lineage that survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    (df.coalesce(parts) if parts else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps deleted: that happens once the driver has collected the garbage that refers to them, so it is asked to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_cut(df: DataFrame) -> None:
    """Delete the files of cut(), once nothing reads them any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def input_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of the bytes that df reads; None if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def parts_for(df: DataFrame, each: int, least: int = 12) -> int:
    """How many partitions hold about `each` bytes of df's input; where that is unknown, spark.sql.shuffle.partitions."""
    size = input_bytes(df)
    if size is None:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(min(200_000, max(least, -(-size // each))))
