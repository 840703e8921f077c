"""Approximate aggregates that merge: distinct counts and quantiles kept by part, added to by increments, read at any level."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.tables import Table, Version

#: Registers of a distinct count are 2**LG_K (a relative error of about 1.04 / sqrt of that); size of a quantile sketch (rank error about 1.3 %).
LG_K, KLL_K = 12, 200
_KINDS = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint", "float": "float", "double": "double"}


def _kind(df: DataFrame, c: str) -> str:
    name = df.schema[c].dataType.simpleString()
    if name not in _KINDS:
        raise ValueError(f"no quantiles of {c}: {name}")
    return _KINDS[name]


def sketched(df: DataFrame, by: list[str], *, distinct: list[str] = (), quantiles: list[str] = (), lg_k: int = LG_K, kll_k: int = KLL_K) -> DataFrame:
    """One row by `by`: n, and for each column its sketch (distinct_<c>, quantile_<c>; nulls are left out, a sketch of nothing is null).

    Sums up within tasks before the shuffle, so a busy key costs one sketch a task.
    """
    aggs = [F.count("*").alias("n")]
    aggs += [F.when(F.count(c) > 0, F.hll_sketch_agg(_hashable(df, c), lg_k)).alias(f"distinct_{c}") for c in distinct]
    aggs += [F.when(F.count(c) > 0, getattr(F, f"kll_sketch_agg_{_kind(df, c)}")(c, kll_k)).alias(f"quantile_{c}") for c in quantiles]
    return df.groupBy(*by).agg(*aggs)


def _hashable(df: DataFrame, c: str) -> Column:
    """A column as a type that distinct counts take."""
    return F.col(c) if df.schema[c].dataType.simpleString() in ("int", "bigint", "string", "binary") else F.col(c).cast("string")


def merged(parts: DataFrame, by: list[str], kinds: dict[str, str]) -> DataFrame:
    """Sketches of finer keys or of several increments, put together by `by`. kinds: the type (bigint, float, double) of each quantile column."""
    aggs = [F.sum("n").alias("n")]
    for c in parts.columns:
        if c.startswith("distinct_"):
            aggs.append(F.hll_union_agg(c, True).alias(c))
        elif c.startswith("quantile_"):
            aggs.append(getattr(F, f"kll_merge_agg_{kinds[c.removeprefix('quantile_')]}")(c).alias(c))
    # a sketch of nothing stays null
    out = parts.groupBy(*by).agg(*aggs, *[F.count(c).alias(f"has_{c}") for c in parts.columns if c.startswith(("distinct_", "quantile_"))])
    return out.select(*[F.when(F.col(f"has_{c}") > 0, F.col(c)).alias(c) if f"has_{c}" in out.columns else F.col(c) for c in out.columns if not (c.startswith("has_") and c.removeprefix("has_") in out.columns)])


def add(table: Table, df: DataFrame, by: list[str], **columns) -> Version:
    """Add rows to a table of sketches by `by`: the increment alone is read, and merged into what is held, in one commit."""
    quantiles = columns.get("quantiles", ())
    kinds = {c: _kind(df, c) for c in quantiles}
    new = sketched(df, by, **columns)
    return table.change(lambda held: merged(new if held is None else held.unionByName(new), by, kinds), kinds=kinds, by=by)


def estimates(sketches: DataFrame, kinds: dict[str, str], ranks: list[float] = (0.5,)) -> DataFrame:
    """The keys and n of rows of sketches, n_<c> of each distinct count, and q_<c> (an array, one value a rank) of each quantile sketch."""
    out = []
    for c in sketches.columns:
        name = c.partition("_")[2]
        if c.startswith("distinct_"):
            out.append(F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).alias(f"n_{name}"))
        elif c.startswith("quantile_"):
            get = getattr(F, f"kll_sketch_get_quantile_{kinds[name]}")
            out.append(F.when(F.col(c).isNotNull(), F.array(*[get(c, F.lit(float(r))) for r in ranks])).alias(f"q_{name}"))
        else:
            out.append(F.col(c))
    return sketches.select(*out)
