"""The table of registered queries and of their SQL."""
from pyspark.sql import SparkSession

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a function by its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="quillspark-")
    return folder.rstrip("/")
