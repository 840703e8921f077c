"""Queries over vector indexes."""
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import search
from quillspark.plans.registry import query, scratch
from quillspark.sources.documents import read_table

_K = 10
_FIELDS = {"label": "integer", "half": "keyword"}


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a JSON payload: their label, which half of the ids they are of, and a nested number."""
    e = read_table(spark, sf_dir, "embeddings")
    half = F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd")
    payload = F.to_json(F.struct("label", half.alias("half"), F.struct((F.col("vec_id") % 7).alias("week")).alias("more")))
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("vector"), payload.alias("payload"))


def _index(spark: SparkSession, sf_dir: str) -> search.Index:
    return search.build(spark, _points(spark, sf_dir), f"{scratch(spark)}/index-{uuid.uuid4().hex}", fields=_FIELDS, k=_K)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


_SCORED = "v as (select vec_id, label, cast(embedding as double[]) as e from embeddings), s as (select q.vec_id as query_id, p.vec_id as id, p.label, greatest(0.0, least(1.0, list_dot_product(q.e, p.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(p.e, p.e))))) as score from v q, v p where q.vec_id % 100 = 0)"


@query(f"with {_SCORED} select query_id, id, round(score, 6) as score from s qualify row_number() over (partition by query_id order by score desc, id) <= 10")
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest points of every hundredth vector, by all lists of the index."""
    return search.search(_index(spark, sf_dir), _asked(spark, sf_dir), _K, exact=True).select("query_id", "id", F.round("score", 6).alias("score"))


@query("select (select count(*) from embeddings) as n_indexed, count(*) as n_queries, 10 * count(*) as n_hits, true as found_enough from embeddings where vec_id % 100 = 0")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the probed lists hold nine tenths of the nearest points that all lists hold."""
    index, asked = _index(spark, sf_dir), _asked(spark, sf_dir)
    got = search.recall(search.search(index, asked, _K), search.search(index, asked, _K, exact=True))
    n = index.table.read().agg(F.count("*").alias("n_indexed"))
    return got.join(F.broadcast(n)).select("n_indexed", "n_queries", "n_hits", (F.col("recall") >= 0.9).alias("found_enough"))


@query(f"with {_SCORED} select query_id, id, round(score, 6) as score from s where label in (1, 3, 5, 7) and id % 2 = 0 and id % 7 >= 2 and id % 7 < 6 qualify row_number() over (partition by query_id order by score desc, id) <= 10")
def filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest points among those that meet filters on shredded fields and on the variant."""
    found = search.search(_index(spark, sf_dir), _asked(spark, sf_dir), _K, exact=True, filters={"label": [1, 3, 5, 7], "half": "even", "more.week": {"gte": 2, "lt": 6}})
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


@query("select vec_id as id, label from embeddings where vec_id in (select doc_id from labels where quality = 1) and label <> 2")
def points_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points looked up by the ids of a table, with what their payload says."""
    points = search.shredded(_points(spark, sf_dir), _FIELDS)
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return search.by_ids(points, good).where(search.conditions({"label": {"not": 2}}, _FIELDS)).select("id", F.col(search.column_of("label")).cast("int").alias("label"))
