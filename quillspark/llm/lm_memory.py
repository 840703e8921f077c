"""The phrase memory of operator 4: how often phrases occur in the training corpus, and mixing that with a model's scores.

A phrase is told by a 64-bit hash and routed, with the model's log10 probability
of it, to the partition of its hash, where its count is known; there both are
mixed and each document's part goes back. Counts cover all training texts and
grow with them. Phrases that make up more than one in SHARE occurrences (so at
most SHARE of them) are counted first and broadcast, so no partition gets a
common phrase's records.

A document's own occurrences are no evidence for it: a phrase of a training text
counts what the other texts hold (rows are told apart by id and text).
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.lm_base import ROUTED, bucket_of, columns, common_items, count_blobs
from quillspark.llm.substring import _pack, _rows, _runs
from quillspark.llm.textnum import mixed, trimmed

SHARE, LEAST_COMMON = 100_000, 200
#: Phrases that a map task gathers before it sums them up and sends them on.
GATHER = 1_000_000
#: Bounds of the mixing weight.
LOW, HIGH = 0.02, 0.9


def counts(toks: DataFrame, n_phrases: int, parts: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(hashes of common phrases, sorted, their counts, the mixing weight: the share of occurrences whose phrase occurs again) of training rows' `phrases`."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, held = [], 0
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            lot.append(h)
            held += len(h)
            if held >= GATHER:
                yield from _rows(count_blobs(np.concatenate(lot), parts))
                lot, held = [], 0
        if held:
            yield from _rows(count_blobs(np.concatenate(lot), parts))

    keys, often, _, again = common_items(toks.where("train").select("phrases").mapInArrow(trimmed(counted), ROUTED), max(LEAST_COMMON, n_phrases // SHARE), parts)
    return keys, often, min(HIGH, max(LOW, again / n_phrases)) if n_phrases else 0.0


def blended(lp: np.ndarray, count: np.ndarray, weight: float, total: int) -> np.ndarray:
    """log10 of weight * count / total + (1 - weight) * 10 ** lp."""
    if not total:
        return lp
    with np.errstate(divide="ignore"):
        memory = np.log(weight * np.maximum(count, 0) / total)
    return np.logaddexp(memory, lp * np.log(10) + np.log1p(-weight)) / np.log(10)


def partials(ids: np.ndarray, ths: np.ndarray, score: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Documents' parts of the score, for the partitions of their documents."""
    dest = (mixed(ids.view(np.uint64) ^ ths.view(np.uint64)) >> np.uint64(40)).astype(np.int64) % parts
    order = np.argsort(dest, kind="stable")
    first = _runs(dest[order]) if len(dest) else []
    return [(-1 - int(dest[order[lo]]), _pack(*(x[order[lo:hi]] for x in (ids, ths, score)))) for lo, hi in zip(first, np.append(first[1:], len(dest)))]


def routed(ids, ths, train, row, h, lp, held, parts: int) -> list[tuple[int, bytes]]:
    """Blobs of a lot of rows' phrases (row, h, lp): common ones are settled, all others go to the partition of their hash."""
    keys, often, weight, total = held
    order = np.lexsort((h, row))
    row, h, lp = row[order], h[order], lp[order]
    at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
    known = keys[at] == h if len(keys) else np.zeros(len(h), bool)
    runs = _runs(row, h) if len(h) else np.zeros(0, np.int64)
    n = np.diff(np.append(runs, len(h)))
    own = np.repeat(n, n) * train[row]
    score = np.bincount(row[known], blended(lp[known], (often[at[known]] if len(keys) else own[known]) - own[known], weight, total), len(ids))
    out = partials(ids, ths, score, parts)
    row, h, lp = row[~known], h[~known], lp[~known].astype(np.float32)
    b = bucket_of(h, parts)
    order = np.lexsort((h, row, b))
    row, h, lp, b = row[order], h[order], lp[order], b[order]
    begin = _runs(b) if len(b) else []
    for lo, hi in zip(begin, np.append(begin[1:], len(b))):
        first = _runs(row[lo:hi])
        o = row[lo:hi][first]
        out.append((int(b[lo]), _pack(ids[o], ths[o], train[o].astype(np.uint8), np.diff(np.append(first, hi - lo)).astype(np.uint32), h[lo:hi], lp[lo:hi])))
    return out


def summed_scores(blobs: DataFrame, weight: float, total: int, parts: int) -> DataFrame:
    """(id, th, score) of routed blobs; r rows equal in id and text have an r-fold score."""

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = []
        for batch in batches:
            done = []
            for bucket, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket < 0:
                    done.append((-1 - bucket, x.as_py()))
                else:
                    lot.append(columns(x.as_py(), np.int64, np.int64, np.uint8, np.uint32, np.uint64, np.float32))
            yield from _rows(done)
        if not lot:
            return
        base = np.concatenate(([0], np.cumsum([len(x[0]) for x in lot])[:-1]))
        owner = np.concatenate([np.repeat(np.arange(len(x[0]), dtype=np.int64) + b, x[3]) for x, b in zip(lot, base)])
        ids, ths, train = (np.concatenate([x[i] for x in lot]) for i in range(3))
        h, lp = np.concatenate([x[4] for x in lot]), np.concatenate([x[5] for x in lot]).astype(np.float64)
        lot.clear()
        order = np.lexsort((owner, h))
        h, lp, owner = h[order], lp[order], owner[order]
        first, mine = _runs(h), _runs(h, owner)
        learned = train[owner].astype(np.int64)
        all_ = np.repeat(np.add.reduceat(learned, first), np.diff(np.append(first, len(h))))
        own = np.repeat(np.add.reduceat(learned, mine), np.diff(np.append(mine, len(h))))
        score = np.bincount(owner, blended(lp, all_ - own, weight, total), len(ids))
        yield from _rows([(-1 - b, x) for b, x in partials(ids, ths, score, parts)])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = [columns(x.as_py(), np.int64, np.int64, np.float64) for batch in batches for x in batch.column(1)]
        if not lot:
            return
        ids, ths, score = (np.concatenate([x[i] for x in lot]) for i in range(3))
        order = np.lexsort((score, ths, ids))
        first = _runs(ids[order], ths[order])
        yield pa.RecordBatch.from_arrays([pa.array(ids[order][first]), pa.array(ths[order][first]), pa.array(np.add.reduceat(score[order], first))], names=["id", "th", "part"])

    out = blobs.repartition(parts, "bucket").mapInArrow(trimmed(settled), ROUTED).repartition(parts, F.col("bucket"))
    return out.mapInArrow(merged, "id long, th long, part double")
