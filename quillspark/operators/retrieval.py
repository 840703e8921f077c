"""Two-stage vector retrieval for batches of queries."""
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import vectors as V
from quillspark.functions.text import n_tokens

#: Query tables up to so many rows are broadcast; larger ones go in blocks of about as many.
QUERY_BLOCK = 1000
#: Children and queries in a tile of their products, on average, and queries in a step of it.
TILE_CHILDREN, TILE_ASKED, STEP = 8192, 4096, 256
#: By how much two cosines may differ by the order of their sums; pairs so near to the k-th are scored exactly.
SLACK = 1e-9


def _in_blocks(queries: DataFrame, query: str, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a search gives for all queries, from blocks of about QUERY_BLOCK queries, dealt by a hash of their id."""
    n = -(-queries.count() // QUERY_BLOCK)
    if n <= 1:
        return search(queries)
    block = F.pmod(F.xxhash64(query), F.lit(n))
    return reduce(DataFrame.unionByName, [search(queries.where(block == b)) for b in range(n)])


def top_k(queries: DataFrame, points: DataFrame, k: int, *, query_vec: str = "query_vec", vec: str = "vec", id_: str = "point_id", query: str = "query_id", score: str = "score") -> DataFrame:
    """The k best points of each query by clamped cosine, ties by id.

    Each block of queries is broadcast against all points; each partition
    keeps k rows for each query before the shuffle.
    """
    names = {"query_vec": query_vec, "vec": vec, "id_": id_, "query": query, "score": score}
    return _in_blocks(queries, query, lambda some: _block_top_k(some, points, k, **names))


def _block_top_k(queries: DataFrame, points: DataFrame, k: int, *, query_vec: str, vec: str, id_: str, query: str, score: str) -> DataFrame:
    held = F.broadcast(queries.select(F.col(query), F.col(query_vec).alias("_q")))
    scored = points.join(held, F.lit(True)).withColumn(score, V.clamp01(V.cosine(V.doubles(F.col(vec)), V.doubles(F.col("_q"))))).drop("_q")
    w = Window.partitionBy(query).orderBy(F.desc(score), F.col(id_))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centroids(points: DataFrame, group: str, vec: str, member: str) -> DataFrame:
    """One unit vector for each group, the mean of its members, with child_ids. Sums run by dimension and are partial before the shuffle."""
    dims = points.select(group, F.posexplode(V.doubles(F.col(vec))).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("m"))
    mean = dims.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    return mean.select(group, V.unit(F.col("mean")).alias("parent_vec"))


def children_of(hits: DataFrame, children: DataFrame, k: int, *, query_vec: str, parent: str = "parent_id", vec: str = "vec", id_: str = "point_id", query: str = "query_id") -> DataFrame:
    """The k best children of each hit parent: products of tiles choose the candidates, which are scored exactly; one window in place of a call for each parent."""
    some = _candidates(hits, children, k, query_vec=query_vec, parent=parent, vec=vec, id_=id_, query=query)
    scored = some.withColumn("child_score", V.clamp01(V.cosine(V.doubles(F.col(vec)), V.doubles(F.col(query_vec)))))
    w = Window.partitionBy(query, parent).orderBy(F.desc("child_score"), F.col(id_))
    return scored.withColumn("child_rank", F.row_number().over(w)).where(F.col("child_rank") <= k)


def _candidates(hits: DataFrame, children: DataFrame, k: int, *, query_vec: str, parent: str, vec: str, id_: str, query: str) -> DataFrame:
    """hits with children of their parent, the k best of each among them and few others.

    A tile holds some children of a parent and some of the queries that hit it. Of
    each query a product in doubles tells the k best and all within SLACK of these;
    they are scored again, sums in the order of V.dot, and k stay, ties by id. Pairs
    without a plain cosine (null, empty, of another length, zero, not finite) all
    stay, but of equal vectors k.
    """
    deal = lambda n, each: F.greatest(F.lit(1), F.ceil(F.col(n) / each)).cast("int")
    asked = hits.groupBy(parent).agg(F.count("*").alias("n")).select(parent, deal("n", TILE_ASKED).alias("n_asked"))
    held = children.groupBy(parent).agg(F.count("*").alias("n")).select(parent, deal("n", TILE_CHILDREN).alias("n_held"))
    tiles = asked.join(held, parent)
    mine = children.select(parent, F.col(id_).alias("id"), V.doubles(F.col(vec)).alias("v")).join(tiles, parent)
    left = mine.select(F.col(parent).alias("held"), "id", "v", F.pmod(F.xxhash64("id"), "n_held").cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("n_asked") - 1)).alias("r"))
    theirs = hits.select(parent, F.col(query).alias("q"), V.doubles(F.col(query_vec)).alias("v")).join(tiles, parent)
    right = theirs.select(F.col(parent).alias("hit"), "q", "v", F.explode(F.sequence(F.lit(0), F.col("n_held") - 1)).alias("p"), F.pmod(F.xxhash64("q"), "n_asked").cast("int").alias("r"))
    out = T.StructType([T.StructField(parent, children.schema[parent].dataType), T.StructField(query, hits.schema[query].dataType), T.StructField(id_, children.schema[id_].dataType)])

    def tile(points: pa.Table, queries: pa.Table) -> pa.Table:
        points = points.take(pc.sort_indices(points, [("id", "ascending")], null_placement="at_start"))
        i, j = _best_of_tile(points.column("v").combine_chunks(), queries.column("v").combine_chunks(), k)
        at, of = pa.array(j), pa.array(i)
        return pa.table([points.column("held").take(at), queries.column("q").take(of), points.column("id").take(at)], out.names)

    # parents may come from children: names of their own keep the sides apart
    pairs = left.groupBy("held", "p", "r").cogroup(right.groupBy("hit", "p", "r")).applyInArrow(tile, out).distinct()
    found = pairs.toDF("_p", "_q", "_i").join(hits.withColumnsRenamed({parent: "_hp", query: "_hq"}), (F.col("_p") == F.col("_hp")) & F.col("_q").eqNullSafe(F.col("_hq"))).drop("_hp", "_hq")
    both = found.join(children, (F.col("_p") == F.col(parent)) & F.col("_i").eqNullSafe(F.col(id_)))
    return both.drop("_p", "_i").withColumnRenamed("_q", query)


def _plain(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length the places of vectors whose cosines are plain, and these vectors."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    out = {}
    for dim in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == dim)
        m = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        with np.errstate(all="ignore"):
            norm = np.sqrt((m * m).sum(axis=1))
            # squares far from the ends of a double's range, so that sums of either order are as near as SLACK
            good = np.isfinite(norm) & (norm > 1e-100) & (norm < 1e100)
        out[int(dim)] = at[good], m[good]
    return out


def _few(rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of equal rows, in order."""
    order = np.lexsort(rows.T[::-1]) if rows.shape[1] else np.arange(len(rows))
    new = np.ones(len(rows), bool)
    new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    place = np.arange(len(rows)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(rows) else order
    return np.sort(order[place < k])


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Clamped cosines of rows i of a and j of b, summed from the first place to the last as V.dot does."""
    dot = lambda x, y: np.cumsum(x * y, axis=1)[:, -1]
    na, nb = np.sqrt(dot(a, a)), np.sqrt(dot(b, b))
    out = [dot(a[i[lo : lo + 8192]], b[j[lo : lo + 8192]]) for lo in range(0, len(i), 8192)]
    return np.clip(np.concatenate([np.zeros(0), *out]) / (na[i] * nb[j]), 0, 1)


def _best_of_tile(points: pa.Array, queries: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) places of a tile that may be among the k best; points come in order of their ids."""
    held, asked = _plain(points), _plain(queries)
    none = np.zeros(0, np.int64)
    rows, cols = [none], [none]
    odd = np.setdiff1d(np.arange(len(points)), np.concatenate([none, *(at for at, _ in held.values())]))
    told: dict[str, int] = {}
    for x in odd:
        same = str(points[int(x)].as_py())
        told[same] = told.get(same, 0) + 1
        if told[same] > k:
            odd = odd[odd != x]
    held = {d: (at[few], m[few]) for d, (at, m) in held.items() for few in (_few(m, k),)}
    for dim, (q_at, q) in asked.items():
        at, m = held.get(dim, (none, np.zeros((0, dim))))
        others = np.concatenate([odd, *(x for d, (x, _) in held.items() if d != dim)])
        rows.append(np.repeat(q_at, len(others)))
        cols.append(np.tile(others, len(q_at)))
        uq, um = (x / np.sqrt((x * x).sum(axis=1))[:, None] for x in (q, m))
        for lo in range(0, len(q) if len(at) else 0, STEP):
            near = uq[lo : lo + STEP] @ um.T
            kth = np.partition(near, len(at) - k, axis=1)[:, len(at) - k] if len(at) > k else np.full(len(near), -2.0)
            good = near >= np.maximum(kth, 0)[:, None] - SLACK
            # scores below zero are zero, and of these the first ids count
            good[:, :k] |= kth[:, None] <= SLACK
            i, j = np.nonzero(good)
            score = _exact(q[lo : lo + STEP], m, i, j)
            order = np.lexsort((j, -score, i))
            i, j = i[order], j[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            rows.append(q_at[lo + i[best]])
            cols.append(at[j[best]])
    left = np.setdiff1d(np.arange(len(queries)), np.concatenate([none, *(at for at, _ in asked.values())]))
    rows.append(np.repeat(left, len(points)))
    cols.append(np.tile(np.arange(len(points)), len(left)))
    return np.concatenate(rows), np.concatenate(cols)


def children_of_all(queries: DataFrame, parents: DataFrame, children: DataFrame, k: int, *, query_vec: str = "query_vec", parent: str = "parent_id", vec: str = "vec", id_: str = "point_id", query: str = "query_id") -> DataFrame:
    """The k best children of every parent for each query."""
    hits = queries.select(query, F.col(query_vec).alias("asked")).join(F.broadcast(parents.select(parent).distinct()), F.lit(True))
    return children_of(hits, children, k, query_vec="asked", parent=parent, vec=vec, id_=id_, query=query).drop("asked")


def retrieve(queries: DataFrame, parents: DataFrame, children: DataFrame, *, top_parents: int = 3, top_children: int = 4, min_score: float = 0.3, alpha: float = 0.7) -> DataFrame:
    """Evidence of each query: parents, their children above min_score, rescored."""
    names = {"query_vec": "query_vec", "vec": "parent_vec", "id_": "parent_id", "query": "query_id", "score": "parent_score"}
    if parents.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK:
        # few parents go to all queries
        scored = queries.select("query_id", F.col("query_vec").alias("_q")).join(F.broadcast(parents), F.lit(True))
        scored = scored.withColumn("parent_score", V.clamp01(V.cosine(V.doubles(F.col("parent_vec")), V.doubles(F.col("_q")))))
        w = Window.partitionBy("query_id").orderBy(F.desc("parent_score"), "parent_id")
        hits = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_parents)
    else:
        hits = top_k(queries, parents, top_parents, **names)
    hits = hits.select("query_id", "parent_id", "parent_score").join(queries.select("query_id", "query_vec"), "query_id")
    found = children_of(hits, children, top_children, query_vec="query_vec").where(F.col("child_score") >= min_score)
    return found.withColumn("score", V.rescored(F.col("child_score"), F.col("parent_score"), alpha))


def distinct_evidence(hits: DataFrame, *, query: str, text: str, score: str, id_: str, prefix: int = 500) -> DataFrame:
    """The best hit of each text prefix of a query."""
    w = Window.partitionBy(query, F.left(F.col(text), F.lit(prefix))).orderBy(F.desc(score), F.col(id_))
    names = hits.columns
    return hits.select(F.struct(*names).alias("row"), F.row_number().over(w).alias("n")).where("n = 1").select("row.*")


def within_budget(hits: DataFrame, *, query: str, question_tokens: int, text: str, score: str, id_: str, tokens: int = 4000, margin: int = 256) -> DataFrame:
    """Hits in order of score while the running token sum fits; as every hit has a token, this stops at the first that does not."""
    most = max(128, tokens - margin)
    w = Window.partitionBy(query).orderBy(F.desc(score), F.col(id_))
    # each hit has a token, so no more than `most` fit: others go before the shuffle
    held = hits.select(F.struct(*hits.columns).alias("row"), F.row_number().over(w).alias("n"), n_tokens(F.col(text), empty=1).alias("size")).where(F.col("n") <= most)
    run = F.lit(1 + question_tokens) + F.sum("size").over(Window.partitionBy(f"row.{query}").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return held.select("row.*", run.alias("run_tokens")).where(F.col("run_tokens") <= most)


def citations(hits: DataFrame, *, query: str, text: str, score: str, id_: str) -> DataFrame:
    """query, n, preview (200 characters) and score (3 digits, half to even) of each hit, in order."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.col(id_))
    preview = F.when(F.char_length(text) > 200, F.concat(F.left(F.col(text), F.lit(200)), F.lit("..."))).otherwise(F.col(text))
    return hits.select(query, id_, F.row_number().over(w).alias("n"), preview.alias("preview"), F.bround(score, 3).alias("score"))
