"""Embedding of text columns by pluggable providers, and vector tables."""
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import ids
from quillspark.functions import vectors as V

#: Texts that a provider gets at once, and prefixes by task.
BATCH = 64
PREFIX = {"passage": "passage: ", "query": "query: "}
PROVIDERS: dict[str, Callable[[int], Callable[[list[str]], np.ndarray]]] = {}


def provider(name: str):
    """Register a factory dim -> (texts -> matrix). A factory runs once in each Python worker that uses it."""

    def add(factory):
        PROVIDERS[name] = factory
        return factory

    return add


@provider("hashing")
def hashing(dim: int):
    """Signed feature hashing of lower-cased words: deterministic, needs no model."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, t in zip(out, texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % dim] += 1 if h >> 63 else -1
        return out

    return embed


def embedded(df: DataFrame, text: str, out: str = "vec", *, name: str = "hashing", dim: int = 64, task: str = "passage") -> DataFrame:
    """df with unit vectors of a text column; a null text is an empty one."""
    factory, prefix = PROVIDERS[name], PREFIX[task]

    @F.pandas_udf("array<float>")
    def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = factory(dim)
        for texts in series:
            full = [prefix + (t or "") for t in texts]
            rows = np.vstack([run(full[i : i + BATCH]) for i in range(0, len(full), BATCH)]) if full else np.zeros((0, dim), np.float32)
            rows = rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-12)
            yield pd.Series(list(rows.astype(np.float32)))

    return df.withColumn(out, embed(F.col(text)))


def points(df: DataFrame, key: str, vec: str, text: str) -> DataFrame:
    """Rows as points: a version-5 UUID of the key, the vector, and the rest as payload with a preview."""
    rest = [c for c in df.columns if c not in (vec, text) and not c.startswith("_")]
    return df.select(ids.uuid5(F.col(key).cast("string")).alias("id"), F.col(vec).alias("vector"), F.to_json(F.struct(*rest, F.left(F.col(text), F.lit(1000)).alias("_preview"))).alias("payload"))


def checked(df: DataFrame, vec: str, tolerance: float = 1e-3) -> DataFrame:
    """One row: points, valid ones, and whether all have length one."""
    v = V.doubles(F.col(vec))
    return df.agg(F.count("*").alias("n"), F.count_if(V.valid(v)).alias("n_valid"), F.coalesce(F.every(F.abs(V.norm(v) - 1) <= tolerance), F.lit(True)).alias("unit"))


def payload_filter(**equal) -> Column:
    """All of key = value."""
    out = F.lit(True)
    for k, v in equal.items():
        out = out & (F.col(k) == F.lit(v))
    return out
