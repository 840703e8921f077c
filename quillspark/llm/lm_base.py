"""The unigram base of operator 4: log10 probabilities of word tokens with add-one smoothing.

Token counts cover all words of all training documents. Words are told apart by
a 64-bit hash. Words that make up more than one in SHARE training tokens (so at
most SHARE of them) are counted first and broadcast. All other words travel
once, as one record for each document and word in column blobs, to the partition
of their hash, which sums their count and sends each document's part back. So no
partition gets more than a sliver of all records for one word.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.substring import _pack, _rows, _runs, _unpack
from quillspark.llm.textnum import Words, mixed, space_words, text_slices, trimmed

SHARE, LEAST_COMMON = 100_000, 200
#: Words that a map task gathers before it sums them up and sends them on.
GATHER = 1_000_000
ROUTED = "bucket int, blob binary"


def bucket_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(h) >> np.uint64(33)).astype(np.int64) % parts


def _lots(batches):
    """Lots of (hash, row) of words, with ids, text hashes and training flags of rows, of about GATHER words."""
    lot, held, rows = [], 0, 0
    for batch in batches:
        ids, ths, train = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
        for lo, hi, buf, offs in text_slices(batch.column(2)):
            w = Words(buf, offs, space_words())
            lot.append((w.hashes(lower=True), w.row_of() + rows, ids[lo:hi], ths[lo:hi], train[lo:hi]))
            held, rows = held + len(w.starts), rows + hi - lo
            if held >= GATHER:
                yield [np.concatenate(x) for x in zip(*lot)]
                lot, held, rows = [], 0, 0
    if lot:
        yield [np.concatenate(x) for x in zip(*lot)]


def _narrow(n: np.ndarray) -> np.ndarray:
    return n.astype(np.uint16 if not len(n) or n.max() < 1 << 16 else np.uint32)


def columns(blob: bytes, *kinds) -> list[np.ndarray]:
    """Columns of the given kinds of a packed blob."""
    out, at = [], 8
    for kind in kinds:
        size = int(np.frombuffer(blob, np.int64, 1, at)[0])
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def count_blobs(h: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """Counts of distinct hashes, one blob for each partition of hashes."""
    h, n = np.unique(h, return_counts=True)
    b = bucket_of(h, parts)
    order = np.argsort(b, kind="stable")
    h, n, b = h[order], n[order], b[order]
    first = _runs(b) if len(b) else []
    return [(int(b[lo]), _pack(h[lo:hi], _narrow(n[lo:hi]))) for lo, hi in zip(first, np.append(first[1:], len(b)))]


def common_items(blobs: DataFrame, least: int, parts: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(sorted hashes that occur more than `least` times, their counts, distinct hashes, occurrences of hashes that occur twice or more) of counts' blobs."""

    def common(batches):
        lot = [_unpack(x.as_py(), np.uint64) for batch in batches for x in batch.column(1)]
        if not lot:
            return
        h, k = np.unique(np.concatenate([x[0] for x in lot]), return_inverse=True)
        c = np.bincount(k, np.concatenate([x[1] for x in lot]).astype(float)).astype(np.int64)
        often = c > least
        yield pa.RecordBatch.from_arrays([pa.array([h[often].tobytes()], pa.binary()), pa.array([c[often].tobytes()], pa.binary()), pa.array([len(h)], pa.int64()), pa.array([int(c[c > 1].sum())], pa.int64())], names=["h", "c", "v", "again"])

    found = blobs.repartition(parts, "bucket").mapInArrow(common, "h binary, c binary, v long, again long").collect()
    keys = np.concatenate([np.frombuffer(r.h, np.uint64) for r in found] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([np.frombuffer(r.c, np.int64) for r in found] or [np.zeros(0, np.int64)])
    order = np.argsort(keys)
    return keys[order], counts[order], sum(r.v for r in found), sum(r.again for r in found)


def base_scores(src: DataFrame, train_tokens: int, parts: int) -> tuple[DataFrame, int]:
    """(id, th, part_known, part_score) of each id and text, and the number of distinct training words.

    src: id (long), th, text, train, none null. part_score adds up log10(c + 1)
    over a document's words, without ends; for r equal rows both are r-fold.
    """

    def counted(batches):
        for h, row, _, _, train in _lots(batches):
            yield from _rows(count_blobs(h[train[row]], parts))

    keys, counts, distinct, _ = common_items(src.mapInArrow(trimmed(counted), ROUTED), max(LEAST_COMMON, train_tokens // SHARE), parts)
    held = src.sparkSession.sparkContext.broadcast((keys, counts))

    def parts_of(ids, ths, known, score):
        dest = (mixed(ids.view(np.uint64) ^ ths.view(np.uint64)) >> np.uint64(40)).astype(np.int64) % parts
        order = np.argsort(dest, kind="stable")
        first = _runs(dest[order]) if len(dest) else []
        return [(-1 - int(dest[order[lo]]), _pack(*(x[order[lo:hi]] for x in (ids, ths, known, score)))) for lo, hi in zip(first, np.append(first[1:], len(dest)))]

    def dealt(batches):
        keys, counts = held.value
        for h, row, ids, ths, train in _lots(batches):
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            if not len(h):
                yield from _rows(parts_of(ids, ths, np.zeros(len(ids), np.int64), np.zeros(len(ids))))
                continue
            first = _runs(h, row)
            n = np.diff(np.append(first, len(h)))
            h, row = h[first], row[first]
            at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            often = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            known = np.bincount(row[often], n[often], len(ids)).astype(np.int64)
            score = np.bincount(row[often], n[often] * np.log10(counts[at[often]] + 1.0), len(ids))
            out = parts_of(ids, ths, known, score)
            h, row, n = h[~often], row[~often], n[~often]
            b = bucket_of(h, parts)
            order = np.lexsort((h, row, b))
            h, row, n, b = h[order], row[order], n[order], b[order]
            begin = _runs(b) if len(b) else []
            for lo, hi in zip(begin, np.append(begin[1:], len(b))):
                runs = _runs(row[lo:hi])
                o = row[lo:hi][runs]
                out.append((int(b[lo]), _pack(ids[o], ths[o], train[o].astype(np.uint8), np.diff(np.append(runs, hi - lo)).astype(np.uint32), h[lo:hi], _narrow(n[lo:hi]))))
            yield from _rows(out)

    def summed(batches):
        lot = []
        for batch in batches:
            done = []
            for bucket, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket < 0:
                    done.append((-1 - bucket, x.as_py()))
                else:
                    lot.append(_unpack(x.as_py(), np.int64, np.int64, np.uint8, np.uint32, np.uint64))
            yield from _rows(done)
        if not lot:
            return
        base = np.concatenate(([0], np.cumsum([len(x[0]) for x in lot])[:-1]))
        owner = np.concatenate([np.repeat(np.arange(len(x[0]), dtype=np.int64) + b, x[3]) for x, b in zip(lot, base)])
        ids, ths, train = (np.concatenate([x[i] for x in lot]) for i in range(3))
        h, n = np.concatenate([x[4] for x in lot]), np.concatenate([x[5] for x in lot]).astype(np.float64)
        lot.clear()
        order = np.argsort(h)
        first = _runs(h[order])
        nth = np.empty(len(h), np.int64)
        nth[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        c = np.bincount(nth, n * train[owner], len(first))[nth]
        known = np.bincount(owner, n * (c > 0), len(ids)).astype(np.int64)
        score = np.bincount(owner, n * np.log10(c + 1), len(ids))
        yield from _rows([(-1 - b, x) for b, x in parts_of(ids, ths, known, score)])

    def merged(batches):
        lot = []
        for batch in batches:
            for x in batch.column(1):
                cols = columns(x.as_py(), np.int64, np.int64, np.int64, np.float64)
                lot.append(cols)
        if not lot:
            return
        ids, ths, known, score = (np.concatenate([x[i] for x in lot]) for i in range(4))
        order = np.lexsort((ths, ids))
        first = _runs(ids[order], ths[order])
        yield pa.RecordBatch.from_arrays([pa.array(ids[order][first]), pa.array(ths[order][first]), pa.array(np.add.reduceat(known[order], first)), pa.array(np.add.reduceat(score[order], first))], names=["id", "th", "part_known", "part_score"])

    out = src.mapInArrow(trimmed(dealt), ROUTED).repartition(parts, "bucket").mapInArrow(trimmed(summed), ROUTED).repartition(parts, "bucket")
    return out.mapInArrow(merged, "id long, th long, part_known long, part_score double"), distinct
