"""Operator 7: removal of word passages that repeat across documents.

A word goes if a window of `window` words covers it whose word sequence also
starts in a document with a smaller id. Three passes:

1. Anchors. With a difference cover D of `PERIOD`, any two places p, q have a
   shift d < PERIOD for which p + d and q + d both lie in D modulo PERIOD. So
   only windows of `window - PERIOD + 1` words at cover positions are hashed,
   and two equal long windows share an aligned anchor.
2. Extension. Around anchors that stand in two documents or more, the full
   windows are hashed with 96 bits and each finds its smallest document.
3. Removal. Each document's windows that have a smaller owner are cut out.

No pairs are made. Before each shuffle, every map task keeps one document for
each hash: what occurs in several of its documents is settled in the task and
only one representative travels, so a passage that a third of all documents
share costs one record a task. Records travel as column blobs.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Defined cases: a null or empty text
has no words; a row with a null id neither removes nor loses words; rows that
share an id are one document; rows are told apart by id and text, so each gets
its own result; ties of the smallest id are one document; texts of any length
are taken whole; an empty table gives no rows; ids are integers, as their order
decides which passage stays (others are refused); further columns are passed over.
"""
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.session import parts_for
from quillspark.llm.textnum import Words, covered, mixed, space_words, span_hash, text_slices

WINDOW = 13
#: A difference cover: every residue of PERIOD is a difference of two members.
PERIOD, COVER = 7, (0, 1, 3)
#: Records that a map task gathers before it sums them up and sends them on.
GATHER = 500_000
#: Compressed input bytes behind one partition.
EACH = 4 << 20

_ROUTED = T.StructType([T.StructField("bucket", T.IntegerType(), False), T.StructField("blob", T.BinaryType(), False)])
_PLACES = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("th", T.LongType(), False), T.StructField("at", T.BinaryType(), False)])


def _runs(*cols: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _pack(*cols: np.ndarray) -> bytes:
    return b"".join([np.int64(len(cols)).tobytes(), *(np.int64(len(c.tobytes())).tobytes() + c.tobytes() for c in cols)])


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    """Columns of the given kinds, and the places: two or four bytes each, as many as the column before has."""
    out, at = [], 8
    for kind in (*kinds, None):
        n = int(np.frombuffer(blob, np.int64, 1, at)[0])
        kind = kind or (np.uint16 if n == 2 * len(out[-1]) else np.uint32)
        out.append(np.frombuffer(blob, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _routed(keys: np.ndarray, low: np.ndarray, owner: np.ndarray, ids: np.ndarray, ths: np.ndarray, at: np.ndarray, buckets: int, keep_least: bool) -> list[tuple[int, bytes]]:
    """Blobs of a gathered lot of records, one for each bucket.

    keys, low: a record's hash; owner: index into ids and ths; at: the place.
    A hash's records of its smallest document travel, marked if the lot has the
    hash in other documents too. The other documents' records are settled here:
    they have another document (keep_least: a smaller one).
    """
    if not len(keys):
        return []
    own_id = ids[owner]
    order = np.lexsort((at, owner, own_id, low, keys))
    keys, low, owner, own_id, at = keys[order], low[order], owner[order], own_id[order], at[order]
    first = _runs(keys, low)
    size = np.diff(np.append(first, len(keys)))
    least = np.repeat(own_id[first], size)
    mine = own_id == least
    many = np.repeat(np.add.reduceat((~mine).astype(np.int64), first) > 0, size)
    if keep_least:
        done, sent = ~mine, mine
    else:
        # a shared anchor: all its places are settled, and one representative tells other tasks
        done = many
        sent = ~many
        sent[first] = True
    bucket = (mixed(keys) >> np.uint64(40)).astype(np.int64) % buckets
    out = []
    # order of travel: bucket, then document, so that documents are runs
    idx = np.flatnonzero(sent)
    idx = idx[np.lexsort((at[idx], owner[idx], bucket[idx]))]
    gone = np.flatnonzero(done)
    b = bucket[idx]
    begin = _runs(b) if len(b) else np.zeros(0, np.int64)
    for i, (lo, hi) in enumerate(zip(begin, np.append(begin[1:], len(idx)))):
        part = idx[lo:hi]
        runs = _runs(owner[part])
        o = owner[part[runs]]
        n = np.diff(np.append(runs, len(part))).astype(np.uint32)
        k = keys[part]
        spots = at[part]
        narrow = np.uint16 if spots.max() < 1 << 16 else np.uint32
        wide = (k, (low[part] >> np.uint64(32)).astype(np.uint32)) if keep_least else _six(k)
        out.append((int(b[lo]), _pack(ids[o], ths[o], n, np.packbits(many[part]), *wide, spots.astype(narrow))))
    out += [(-1 - dest, blob) for dest, blob in _by_document(owner[gone], at[gone], ids, ths, buckets)]
    return out


def _by_document(owner: np.ndarray, at: np.ndarray, ids: np.ndarray, ths: np.ndarray, dests: int) -> list[tuple[int, bytes]]:
    """Blobs of places by the partition of their document."""
    if not len(owner):
        return []
    dest = (mixed(ids.view(np.uint64) ^ ths.view(np.uint64)) >> np.uint64(40)).astype(np.int64)[owner] % dests
    order = np.lexsort((at, owner, dest))
    owner, at, dest = owner[order], at[order].astype(np.uint32), dest[order]
    out = []
    begin = _runs(dest)
    for lo, hi in zip(begin.tolist(), np.append(begin[1:], len(dest)).tolist()):
        runs = _runs(owner[lo:hi])
        o = owner[lo:hi][runs]
        out.append((int(dest[lo]), _pack(ids[o], ths[o], np.diff(np.append(runs, hi - lo)).astype(np.uint32), at[lo:hi])))
    return out


def _six(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48 bits of each hash in two columns; with the bucket they tell anchors apart well enough, as full windows follow."""
    return (k >> np.uint64(32)).astype(np.uint32), (k >> np.uint64(16)).astype(np.uint16)


def _gathered(select: Callable, buckets: int, keep_least: bool, text_at: int) -> Callable:
    """A map over batches (id, th, text, known, ...): select gives (row, word place, hash, second hash) of records of a slice."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = space_words()
        lot, held = [], 0

        def flush():
            cols = [np.concatenate(c) for c in zip(*(x[:4] for x in lot))]
            base = np.concatenate(([0], np.cumsum([len(x[4]) for x in lot])[:-1]))
            owner = np.concatenate([x[0] + b for x, b in zip(lot, base)])
            ids, ths = np.concatenate([x[4] for x in lot]), np.concatenate([x[5] for x in lot])
            yield from _rows(_routed(cols[2], cols[3], owner, ids, ths, cols[1], buckets, keep_least))

        for batch in batches:
            ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            known = batch.column(3).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in text_slices(batch.column(text_at)):
                w = Words(buf, offs, table)
                row, at, k, k2 = select(w, batch, lo, hi)
                ok = known[lo:hi][row]
                lot.append((row[ok], at[ok], k[ok], k2[ok], ids[lo:hi], ths[lo:hi]))
                held += len(row)
                if held >= GATHER:
                    yield from flush()
                    lot, held = [], 0
        if lot:
            yield from flush()

    return each


def _anchors(window: int) -> Callable:
    size = window - PERIOD + 1

    def select(w: Words, batch, lo, hi):
        at = w.windows(size)
        place, row = w.place(), w.row_of()
        at = at[np.isin(place[at] % PERIOD, COVER) & (w.counts[row[at]] >= window)]
        h = span_hash(w.hashes(), at, at + size)
        return row[at], place[at], h, np.zeros(len(at), np.uint64)

    return select


def _extended(window: int) -> Callable:
    def select(w: Words, batch, lo, hi):
        starts = np.zeros(len(w.starts) + 1, bool)
        for r, blob in enumerate(batch.column(4).slice(lo, hi - lo).to_pylist()):
            first, end = int(w.first[r]), int(w.first[r + 1])
            spots = np.frombuffer(blob, np.uint32).astype(np.int64)
            s = (spots[:, None] - np.arange(PERIOD)[None, :]).ravel()
            starts[first + s[(s >= 0) & (s + window <= end - first)]] = True
        at = np.flatnonzero(starts)
        h = [span_hash(w.hashes(i), at, at + window, i) for i in (0, 1)]
        return w.row_of()[at], w.place()[at], *h

    return select


def _rows(pairs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(pairs), 4096):
        some = pairs[lo : lo + 4096]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], names=["bucket", "blob"])


def _settled(keep_least: bool, dests: int) -> Callable:
    """A map over a bucket's blobs: by document, places of hashes that stand in another (keep_least: a smaller) document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = []
        for batch in batches:
            done = []
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = blob.as_py()
                if bucket < 0:
                    done.append((-1 - bucket, raw))
                    continue
                if keep_least:
                    ids, ths, n, flags, k, k2, at = _unpack(raw, np.int64, np.int64, np.uint32, np.uint8, np.uint64, np.uint32)
                else:
                    ids, ths, n, flags, hi, mid, at = _unpack(raw, np.int64, np.int64, np.uint32, np.uint8, np.uint32, np.uint16)
                    k, k2 = (hi.astype(np.uint64) << np.uint64(16)) | mid, np.full(len(at), bucket, np.uint32)
                lot.append((ids, ths, n, at, np.unpackbits(flags, count=len(at)).astype(bool), k, k2))
            yield from _rows(done)
        if not lot:
            return
        base = np.concatenate(([0], np.cumsum([len(x[0]) for x in lot])[:-1]))
        owner = np.concatenate([np.repeat(np.arange(len(x[0]), dtype=np.int32) + np.int32(b), x[2]) for x, b in zip(lot, base)])
        ids, ths, _, at, many, k, k2 = (np.concatenate([x[i] for x in lot]) for i in range(7))
        lot.clear()
        own_id = ids[owner]
        order = np.lexsort((own_id, k2, k))
        k, k2, own_id, owner, at, many = k[order], k2[order], own_id[order], owner[order], at[order], many[order]
        first = _runs(k, k2)
        size = np.diff(np.append(first, len(k)))
        if keep_least:
            hit = own_id > np.repeat(own_id[first], size)
        else:
            last = np.append(first[1:], len(k)) - 1
            hit = np.repeat((own_id[first] != own_id[last]) | np.logical_or.reduceat(many, first), size)
        yield from _rows(_by_document(owner[hit], at[hit], ids, ths, dests))

    return each


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document from the blobs of its partition."""
    lot = [_unpack(blob.as_py(), np.int64, np.int64, np.uint32) for batch in batches for blob in batch.column(1)]
    if not lot:
        return
    n = np.concatenate([x[2] for x in lot])
    ids, ths = (np.repeat(np.concatenate([x[i] for x in lot]), n) for i in (0, 1))
    at = np.concatenate([x[3] for x in lot])
    lot.clear()
    order = np.lexsort((at, ths, ids))
    ids, ths, at = ids[order], ths[order], at[order]
    first = _runs(ids, ths)
    end = np.append(first[1:], len(at))
    for lo in range(0, len(first), 1024):
        part = first[lo : lo + 1024]
        spots = [np.unique(at[a:b]).tobytes() for a, b in zip(part.tolist(), end[lo : lo + 1024].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(ths[part]), pa.array(spots, pa.binary())], names=["id", "th", "at"])


def repeated_places(docs: DataFrame, *, window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """Start places (uint32 as bytes) of the windows that also start in a document with a smaller id: id, th, at.

    docs: columns id (long), th (hash of the text), text, and known (false: the
    row takes no part); id, th and known are never null. So a join by id and th
    adds no filter, and Spark deals the texts out once for all joins.
    """
    parts = parts or parts_for(docs, EACH)

    def settle(records: DataFrame, keep_least: bool) -> DataFrame:
        by_document = records.repartition(parts, "bucket").mapInArrow(_settled(keep_least, parts), _ROUTED)
        return by_document.repartition(parts, "bucket").mapInArrow(_merged, _PLACES)

    shared = settle(docs.mapInArrow(_gathered(_anchors(window), parts, False, 2), _ROUTED), False)
    around = docs.join(shared, ["id", "th"]).select("id", "th", "text", "known", "at")
    return settle(around.mapInArrow(_gathered(_extended(window), parts, True, 2), _ROUTED), True)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed and kept (the words left, joined by one space) of each row."""
    if window < 2 * PERIOD - 1 - max(COVER):
        raise ValueError(f"a window needs {2 * PERIOD - 1 - max(COVER)} words or more")
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold integers: their order decides which passage stays")
    parts = parts_for(docs.select(id_col, text_col), EACH)
    key = F.col(id_col).cast("long")
    src = docs.select(F.coalesce(key, F.lit(0).cast("long")).alias("id"), F.xxhash64(F.col(text_col), key.isNull()).alias("th"), F.col(text_col).cast("string").alias("text"), key.isNotNull().alias("known"))
    gone = repeated_places(src, window=window, parts=parts)
    both = src.join(gone, ["id", "th"], "left").select(F.when(F.col("known"), F.col("id")).alias("id"), "text", "at")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType(), False), T.StructField("n_removed", T.LongType(), False), T.StructField("kept", T.StringType(), False)])

    def each(batches):
        table = space_words()
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch.column(1)):
                w, raw = Words(buf, offs, table), buf.tobytes()
                marks = [np.zeros(0, np.int64)]
                for r, blob in enumerate(batch.column(2).slice(lo, hi - lo).to_pylist()):
                    if blob:
                        marks.append(np.frombuffer(blob, np.uint32).astype(np.int64) + w.first[r])
                gone = covered(len(w.starts), np.concatenate(marks), window)
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[w.first])
                texts = []
                for r in range(hi - lo):
                    a, b = int(w.first[r]), int(w.first[r + 1])
                    words = raw[int(offs[r]) : int(offs[r + 1])].split()
                    texts.append(b" ".join(words if not removed[r] else [x for x, g in zip(words, gone[a:b].tolist()) if not g]).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(w.counts, pa.int64()), pa.array(removed if hi > lo else [], pa.int64()), pa.array(texts, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(each, schema).withColumnRenamed("id", id_col)
