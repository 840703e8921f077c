"""Operator 8: toxicity by FTRL-proximal logistic regression.

Features are the distinct hashed (BITS bits) word unigrams, bigrams and
skip-bigrams (one word left out) of a text. The learner keeps a rate for each
coordinate and L1 drives most weights to exact zero, so what is broadcast is a
short sorted list of (hash, weight).

The learner sees a bounded sample: the `max_rows` labelled rows that come first
by a hash of their id. Scoring is one narrow map over all whole texts.

Words: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, so marks around
a word do not hide it. Defined cases: a null or empty text has the intercept's
score; labels that are null or lack a document teach nothing; several labels of
a document count as toxic if any is; without both classes the score is the
share of toxic rows (0 if there are none); repeated rows are scored one by one,
and each labelled copy teaches; texts of any length are taken whole; an empty
table gives no rows; further columns stay. Only the text enters a score.
"""
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.textnum import U, Words, mixed, plain_words, text_slices, trimmed

#: Labelled rows that the learner reads at most.
MAX_ROWS = 8_000
#: Bits of a feature's hash; the learner's state is two floats for each of so many places.
BITS = 23
#: Learning rate, its damping, L1 and L2 strength, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 4.0, 0.3, 8


def _features(w: Words) -> list[np.ndarray]:
    """Distinct hashed features of each text of a slice."""
    h = w.hashes(lower=True)
    n = len(h)
    row = w.row_of()
    kinds = [(h, row)]
    for gap, salt in ((1, 0xA5A5A5A5A5A5A5A5), (2, 0x3C6EF372FE94F82B)):
        if n > gap:
            same = row[:-gap] == row[gap:]
            kinds.append((mixed(h[:-gap] * U(0x9E3779B97F4A7C15) + h[gap:] + U(salt))[same], row[:-gap][same]))
    keys = np.concatenate([k >> U(64 - BITS) for k, _ in kinds]) | (np.concatenate([r for _, r in kinds]).astype(U) << U(32))
    keys = np.unique(keys)
    cut = np.searchsorted(keys, np.arange(len(w.first)).astype(U) << U(32))
    low = (keys & U(0xFFFFFFFF)).astype(np.uint32)
    return [low[a:b] for a, b in zip(cut[:-1], cut[1:])]


def train(rows: list[tuple[int, np.ndarray]], *, alpha=ALPHA, beta=BETA, l1=L1, l2=L2, epochs=EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, sorted feature hashes, their weights) from (label, features) rows."""
    toxic = sum(y for y, _ in rows)
    empty = np.zeros(0, np.uint32), np.zeros(0, np.float64)
    if not toxic or toxic == len(rows):
        return (40.0 if toxic else -40.0), *empty
    # the state has places for the features that occur, not for all hashes
    seen = np.zeros(1 << BITS, bool)
    for _, at in rows:
        seen[at] = True
    names = np.flatnonzero(seen).astype(np.uint32)
    place = np.zeros(1 << BITS, np.uint32)
    place[names] = np.arange(len(names), dtype=np.uint32)
    rows = [(y, place[at]) for y, at in rows]
    del seen, place
    z, n = np.zeros(len(names), np.float32), np.zeros(len(names), np.float32)
    bias = np.zeros(2)

    def weight(zi, ni):
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        return w

    def free() -> float:  # the intercept is not penalised
        return -bias[0] * alpha / (beta + np.sqrt(bias[1]))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            y, at = rows[i]
            zi, ni = z[at].astype(np.float64), n[at].astype(np.float64)
            w, own = weight(zi, ni), free()
            g = 1 / (1 + np.exp(-np.clip(w.sum() + own, -35, 35))) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
            bias += g - (np.sqrt(bias[1] + g * g) - np.sqrt(bias[1])) / alpha * own, g * g
    kept = np.flatnonzero(np.abs(z) > l1)
    return float(free()), names[kept], weight(z[kept].astype(np.float64), n[kept].astype(np.float64))


def sample_features(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, max_rows: int) -> list[tuple[int, np.ndarray]]:
    """(label, features) of the sampled rows, in the order of the ids' hashes."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max((F.col("y") > 0).cast("int")).alias("y"))
    few = known.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_rows)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(few), "id").select(F.xxhash64("id").alias("o"), "y", "text")

    def each(batches):
        table = plain_words()
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch.column(2)):
                got = _features(Words(buf, offs, table))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([x.tobytes() for x in got], pa.binary())], names=["o", "y", "x"])

    # one buffer for all features, which goes as a whole: many small ones leave the driver's memory in pieces
    held, rows = array("I"), []
    for o, y, x in picked.mapInArrow(trimmed(each), "o long, y int, x binary").toLocalIterator():
        rows.append((o, y, len(held), len(x) // 4))
        held.frombytes(x)
    held = np.frombuffer(held, np.uint32)
    # rows of one id go by their features, as bytes
    rows.sort(key=lambda r: (*r[:2], held[r[2] : r[2] + r[3]].tobytes()))
    return [(y, held[a : a + n]) for _, y, a, n in rows]


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], *, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """docs with a score in a last column; input columns of any name stay."""
    names, at = docs.schema.names, docs.schema.names.index(text_col)
    k = len(names)
    held = docs.sparkSession.sparkContext.broadcast(model)
    inner = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)), T.StructField(f"c{k}", T.DoubleType(), False)])

    def each(batches):
        (bias, keys, weights), table = held.value, plain_words()
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch.column(at)):
                total = np.full(hi - lo, bias)
                if len(keys):
                    got = _features(Words(buf, offs, table))
                    x = np.concatenate(got)
                    row = np.repeat(np.arange(hi - lo), [len(g) for g in got])
                    spot = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                    hit = keys[spot] == x
                    total += np.bincount(row[hit], weights[spot[hit]], hi - lo)
                p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(p)], names=[f"c{i}" for i in range(k + 1)])

    return docs.toDF(*[f"c{i}" for i in range(k)]).mapInArrow(trimmed(each), inner).toDF(*names, out_col)


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    """A model for score() from labelled documents."""
    return train(sample_features(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows))
