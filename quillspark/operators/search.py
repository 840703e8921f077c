"""Vector search over inverted lists, with filters on payloads below the scores.

A point is (id, vector, payload). The payload is a VARIANT; fields that searches
filter by are declared, and lie beside it as typed columns of their own (shredded),
so that a filter on them is decided by Parquet statistics at the scan. Filters on
other fields read the variant, still before any score.

The index: centroids are fitted on a bounded sample, each point goes to the list
of its nearest centroid, and each list is a folder of a versioned table. A search
reads the lists nearest to its queries (or all of them: exact), dealt out in tiles
of bounded numbers of points and queries, so neither a list with a third of all
points nor a crowd of queries at one list meets in one task. A tile is a matrix
product; k rows of each query leave it.
"""
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.store import INDEX_KINDS
from quillspark.sources.tables import Conflict, Table, Version

#: Points that centroids are fitted on at most, the first by a hash of their id; most lists; rounds of fitting; queries that probes are measured with.
SAMPLE, MOST_LISTS, ROUNDS, TRIED = 20_000, 4096, 12, 200
#: Points and queries of a tile, on average.
TILE_POINTS, TILE_QUERIES = 8192, 1024
#: Types of shredded columns by kind of payload index.
TYPES = {"keyword": "string", "text": "string", "uuid": "string", "geo": "string", "integer": "bigint", "float": "double", "bool": "boolean", "datetime": "timestamp"}
_RANGES = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def column_of(field: str) -> str:
    """The shredded column of a payload field."""
    return f"payload_{field}"


def shredded(points: DataFrame, fields: dict[str, str], payload: str = "payload") -> DataFrame:
    """points with the payload (JSON text or a variant) as a variant, and each field of `fields` (name: kind) as a typed column; a value of another type is null there."""
    unknown = set(fields.values()) - set(INDEX_KINDS)
    if unknown:
        raise ValueError(f"unknown kinds of index: {sorted(unknown)}")
    held = points if points.schema[payload].dataType == T.VariantType() else points.withColumn(payload, F.try_parse_json(payload))
    return held.withColumns({column_of(f): F.try_variant_get(payload, _path(f), TYPES[kind]) for f, kind in fields.items()})


def _path(field: str) -> str:
    return "$" + "".join(f"[{json.dumps(x)}]" for x in field.split("."))


def _typed(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    return "bigint" if isinstance(value, int) else "double" if isinstance(value, float) else "string"


def conditions(filters: dict | None, fields: dict[str, str], payload: str = "payload") -> Column:
    """All of: field = value; field in a list of values; field within {gt, gte, lt, lte}; field not {"not": value or list}.

    A point that lacks the field (or holds null, or another type) meets no condition
    on it but "not". Dots step into objects. No filters: every point.
    """
    out = F.lit(True)
    for field, want in (filters or {}).items():

        def of(value, field=field) -> Column:
            return F.col(column_of(field)) if field in fields else F.try_variant_get(payload, _path(field), _typed(value))

        def among(values: list, of=of) -> Column:
            found = F.lit(False)
            for kind in sorted({_typed(v) for v in values}):
                some = [v for v in values if _typed(v) == kind]
                found = found | F.coalesce(of(some[0]).isin(some) if len(some) > 1 else of(some[0]) == F.lit(some[0]), F.lit(False))
            return found if len({_typed(v) for v in values}) != 1 else (of(values[0]).isin(values) if len(values) > 1 else of(values[0]) == F.lit(values[0]))

        if isinstance(want, dict) and "not" in want:
            held = want["not"] if isinstance(want["not"], list) else [want["not"]]
            out = out & ~F.coalesce(among(held), F.lit(False))
        elif isinstance(want, dict):
            if not want or set(want) - set(_RANGES):
                raise ValueError(f"bad range: {want}")
            for name, bound in want.items():
                out = out & getattr(of(bound), _RANGES[name])(F.lit(bound))
        elif isinstance(want, (list, tuple)):
            out = out & (among(list(want)) if want else F.lit(False))
        else:
            out = out & among([want])
    return out


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, and which are valid: of dim finite numbers, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    good = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    if good.any():
        flat = column.filter(pa.array(good)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[good] = flat.reshape(-1, dim)
    norm = np.sqrt((out * out).sum(axis=1))
    good &= np.isfinite(norm) & (norm > 0)
    out[~good] = 0
    out[good] /= norm[good, None]
    return out, good


def fit(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors, by k-means on cosines; fewer where there are fewer distinct vectors."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:lists]]
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1)[:, None], centres)
    return centres


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, target: float) -> int:
    """How many lists must be read for `target` of the k nearest of a sample's points to be found, on average, within the sample."""
    asked = sample[: min(TRIED, len(sample))]
    k = min(k, len(sample))
    if not k:
        return 1
    near = np.argpartition(-(asked @ sample.T), k - 1, axis=1)[:, :k]
    at = np.argmax(sample @ centres.T, axis=1)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, at[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


@dataclass(frozen=True)
class Index:
    """A table of points by list, its centroids, and how many lists a search reads unless it is told."""

    table: Table
    centres: np.ndarray
    probes: int
    fields: dict[str, str]


def build(spark: SparkSession, points: DataFrame, path: str, *, fields: dict[str, str] | None = None, lists: int | None = None, k: int = 10, recall: float = 0.97, sample: int = SAMPLE) -> Index:
    """Index every row of points (id, vector, payload) at path, in one commit; searches of older versions go on.

    The square root of the points is the number of lists (4,096 at most). Centroids,
    and the probes that find `recall` of the k nearest, come from at most `sample`
    points. Points without a valid vector (null, another length, zero, not a number)
    are kept in a list of their own and found by no search.
    """
    fields = fields or {}
    held = shredded(points, fields)
    n = held.count()
    dims = held.where(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = dims.d if dims else 0
    drawn = held.where(F.size("vector") == dim).select(F.xxhash64("id").alias("h"), "vector").orderBy("h").limit(sample).toArrow()
    some, good = _matrix(drawn.column("vector"), dim)
    some = some[good]
    centres = fit(some, lists or int(min(MOST_LISTS, max(1, round(n**0.5))))) if len(some) else np.zeros((0, dim))
    probes = _probes(some, centres, k, recall) if len(some) else 1
    # the variant does not pass through Python: only numbers of lists come back, beside the row's columns
    placed = held.withColumn("list", _nearest(dim, centres)("vector"))
    deal = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // (TILE_POINTS * 64)))))
    table = Table(spark, path)
    while True:
        last = table.version()
        parts = table.put(placed.repartition("list", deal), "list")
        sizes = {str(r[0]): r[1] for r in table.read(Version(-1, parts, held.schema.json())).groupBy(_list().alias("l")).count().collect()} if parts else {}
        try:
            table.commit(last, parts, held.schema, centres=centres.tolist(), probes=probes, fields=fields, sizes=sizes, dim=dim)
        except Conflict:
            continue
        table.vacuum()
        return Index(table, centres, probes, fields)


def _list() -> Column:
    """The list that a row of an index lies in, from its file's folder."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"list=(-?\d+)/", 1).cast("int")


def opened(spark: SparkSession, path: str) -> Index:
    """The index at path, as last committed."""
    table = Table(spark, path)
    notes = table.version().notes
    if "centres" not in notes:
        raise LookupError(f"no vector index at {path}")
    return Index(table, np.array(notes["centres"]).reshape(-1, notes["dim"]), notes["probes"], notes["fields"])


def _nearest(dim: int, centres: np.ndarray):
    """A function of a vector column: the nearest centroid's number, -1 for vectors that are not valid. centres: 4,096 at most."""

    @F.arrow_udf("int")
    def near(vectors: pa.Array) -> pa.Array:
        out = np.full(len(vectors), -1, np.int32)
        for lo in range(0, len(vectors), 4096):
            m, good = _matrix(vectors.slice(lo, 4096), dim)
            if good.any():
                out[lo : lo + len(m)][good] = np.argmax(m[good] @ centres.T, axis=1)
        return pa.array(out)

    return near


def search(index: Index, queries: DataFrame, k: int, *, probes: int | None = None, exact: bool = False, filters: dict | None = None, query: str = "query_id", query_vec: str = "query_vec") -> DataFrame:
    """query, id, score (clamped cosine) and rank of the k best points of each query among those that meet the filters; ties by id.

    Reads the `probes` lists nearest to each query; exact reads all. Queries without a
    valid vector have no hits; equal query ids are one query with several vectors.
    """
    version = index.table.version()
    notes, dim, centres = version.notes, version.notes["dim"], index.centres
    many = len(centres) if exact else min(len(centres), probes or index.probes)
    points = index.table.read(version)
    id_kind, query_kind = points.schema["id"].dataType, queries.schema[query].dataType
    out = T.StructType([T.StructField("q", query_kind), T.StructField("id", id_kind), T.StructField("score", T.DoubleType())])
    if not many:
        return index.table.spark.createDataFrame([], out).select(F.col("q").alias(query), "id", "score", F.lit(0).alias("rank"))

    @F.arrow_udf("array<int>")
    def nearest(vectors: pa.Array) -> pa.Array:
        m, good = _matrix(vectors, dim)
        scores = m @ centres.T
        best = np.argpartition(-scores, many - 1, axis=1)[:, :many] if many < len(centres) else np.tile(np.arange(len(centres)), (len(m), 1))
        return pa.array([row.tolist() if ok else [] for row, ok in zip(best, good)], pa.list_(pa.int32()))

    asked = queries.select(F.col(query).alias("q"), F.col(query_vec).cast("array<float>").alias("v"))
    probed = asked.select("q", "v", F.explode(nearest("v")).alias("list"))
    # a number for each list, 4,096 at most
    crowd = {r["list"]: r["count"] for r in probed.groupBy("list").count().collect()}
    wanted = [x for x in crowd if str(x) in version.parts]
    if not wanted:
        return index.table.spark.createDataFrame([], out).select(F.col("q").alias(query), "id", "score", F.lit(0).alias("rank"))
    spark = index.table.spark
    tiles = F.broadcast(spark.createDataFrame([(x, -(-notes["sizes"][str(x)] // TILE_POINTS), -(-crowd[x] // TILE_QUERIES)) for x in wanted], "list int, n_points int, n_queries int"))
    some = index.table.read(version, parts=[str(x) for x in wanted]).where(conditions(filters, index.fields))
    some = some.select("id", "vector", _list().alias("list")).join(tiles, "list")
    left = some.select("id", "vector", "list", F.pmod(F.xxhash64("id"), "n_points").cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("n_queries") - 1)).alias("r"))
    right = probed.join(tiles, "list").select("q", "v", "list", F.explode(F.sequence(F.lit(0), F.col("n_points") - 1)).alias("p"), F.pmod(F.xxhash64("q"), "n_queries").cast("int").alias("r"))

    def tile(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        a, good_a = _matrix(mine.column("vector"), dim)
        b, good_b = _matrix(theirs.column("v"), dim)
        ids, q = mine.column("id").combine_chunks().filter(pa.array(good_a)), theirs.column("q").combine_chunks().filter(pa.array(good_b))
        a, b = a[good_a], b[good_b]
        rows, cols, found = [], [], []
        order = pc.array_sort_indices(ids).to_numpy()
        for lo in range(0, len(b) if len(a) else 0, 256):
            scores = np.clip(b[lo : lo + 256] @ a[order].T, 0, 1)
            # ids in order and a stable sort: ties go to the smaller id
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            rows.append(np.repeat(np.arange(lo, lo + len(scores)), best.shape[1]))
            cols.append(order[best.ravel()])
            found.append(np.take_along_axis(scores, best, axis=1).ravel())
        at = (lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind))
        return pa.table([q.take(pa.array(at(rows, np.int64))), ids.take(pa.array(at(cols, np.int64))), pa.array(at(found, float))], ["q", "id", "score"])

    keys = ["list", "p", "r"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, out)
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("id"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("q").alias(query), "id", "score", "rank")


def recall(found: DataFrame, right: DataFrame, query: str = "query_id") -> DataFrame:
    """One row: queries, hits that an exact search gives, and the share of them that were found."""
    hit = right.select(query, "id").join(found.select(query, "id", F.lit(1).alias("hit")), [query, "id"], "left")
    return hit.agg(F.count_distinct(query).alias("n_queries"), F.count("*").alias("n_hits"), F.coalesce(F.sum("hit") / F.count("*"), F.lit(1.0)).alias("recall"))


def by_ids(points: DataFrame, ids: DataFrame | list, key: str = "id") -> DataFrame:
    """The points of some ids: a list is a filter at the scan, a table of ids a semi join."""
    if isinstance(ids, list):
        return points.where(F.col(key).isin(ids)) if ids else points.limit(0)
    return points.join(ids.select(key).distinct(), key, "left_semi")
