"""Vector tables: create, check, upsert, drop, count."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.dedup import upsert
from quillspark.sources.tables import Conflict, Table

POINT = "id string, vector array<float>, payload string"
# Names that stand for a distance, kinds of a payload index.
DISTANCES = {"cosine": "cosine", "cos": "cosine", "dot": "dot", "ip": "dot", "inner": "dot", "euclid": "euclid", "l2": "euclid", "euclidean": "euclid"}
INDEX_KINDS = ("keyword", "integer", "float", "bool", "geo", "datetime", "text", "uuid")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def ensure(spark: SparkSession, path: str, missing: str = "create") -> Table:
    """The vector table at path, made empty where there is none; missing="error" raises instead. Versions: an older one can be read on while a new one is written."""
    table = Table(spark, path)
    last = table.version()
    if last.schema:
        return table
    if missing != "create":
        raise LookupError(f"no vector table at {path}")
    try:
        table.commit(last, {}, spark.createDataFrame([], POINT).schema)
    except Conflict:  # another has made it
        pass
    return table


def drop(spark: SparkSession, path: str) -> bool:
    """Delete a vector table; whether there was one."""
    p, fs = _fs(spark, path)
    return bool(fs.delete(p, True))


def index_fields(specs: list[str | dict]) -> dict[str, str]:
    """Field and kind of payload indexes told as a name or {name, schema}; bad ones raise. Parquet prunes by statistics, so there is nothing to build."""
    out = {}
    for spec in specs:
        name, kind = (spec, "keyword") if isinstance(spec, str) else (spec.get("name"), str(spec.get("schema", "keyword")).lower())
        if not name or kind not in INDEX_KINDS:
            raise ValueError(f"bad index: {spec}")
        out[name] = kind
    return out


def distance(name: str) -> str:
    """cosine, dot or euclid for any of its names."""
    key = str(name).strip().lower()
    if key not in DISTANCES:
        raise ValueError(f"unknown distance: {name}")
    return DISTANCES[key]


def upsert_points(base: DataFrame, new: DataFrame, dim: int | None = None) -> DataFrame:
    """base with the points of new by id; new ones win, the last by payload if an id comes twice. Vectors of different lengths raise while the rows are made."""
    size = F.size("vector")
    want = F.lit(dim) if dim else F.lit(None).cast("int")
    if dim is None:
        first = base.select(size).unionByName(new.select(size)).first()
        want = F.lit(first[0] if first else 0)
    checked = new.withColumn("vector", F.when(size == want, F.col("vector")).otherwise(F.raise_error(F.lit("vectors differ in length"))))
    both = lambda df, n: df.select(*base.columns, F.lit(n).alias("batch"))
    return upsert(both(base, 0), both(checked, 1), ["id"], ["batch", "payload"]).drop("batch")


def stats(points: DataFrame) -> DataFrame:
    """One row: points, distinct ids, least and greatest length of a vector, points without a payload."""
    return points.agg(F.count("*").alias("n_points"), F.count_distinct("id").alias("n_ids"), F.min(F.size("vector")).alias("least_dim"), F.max(F.size("vector")).alias("most_dim"), F.count_if(F.col("payload").isNull()).alias("n_bare"))


def verified(points: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """One row: keys expected, those without a point, points that no key expects."""
    from quillspark.functions import ids

    want = expected.select(ids.uuid5(F.col(key).cast("string")).alias("id")).distinct()
    both = want.withColumn("w", F.lit(1)).join(points.select("id").distinct().withColumn("p", F.lit(1)), "id", "full")
    return both.agg(F.count("w").alias("n_expected"), F.count_if(F.col("p").isNull()).alias("n_missing"), F.count_if(F.col("w").isNull()).alias("n_stray"))


def sanity(queries: DataFrame, found: DataFrame, *, query: str = "query_id", score: str = "score") -> DataFrame:
    """For each query its hits, best and mean score; queries without hits have none."""
    per = found.groupBy(query).agg(F.count("*").alias("n_hits"), F.max(score).alias("best"), F.avg(score).alias("mean"))
    return queries.select(query).distinct().join(per, query, "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))


def collection_report(parts: dict[str, DataFrame]) -> DataFrame:
    """Name and points of each collection, and whether it has any."""
    rows = [df.agg(F.count("*").alias("n_points")).select(F.lit(name).alias("collection"), "n_points", (F.col("n_points") > 0).alias("healthy")) for name, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
