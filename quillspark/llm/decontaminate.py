"""Operator 1: benchmark decontamination.

The benchmark is read in blocks of bounded size. Each block's windows of
`window` normalised words are broadcast as a sorted array of hashes; the
documents are scanned by a narrow map with no shuffle, and each hash hit is
verified against the window's bytes. Where the benchmark has more than one block,
what is marked is written to the shared folder between two blocks' scans, so a
task never holds more than one block's index.

Words: A-Z lower-cased, then `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. An item of
fewer words than a window, but not none, is one window.

Defined cases: a null or empty text has no words; a null item text has no
windows; a null item id marks words but is not listed; repeated rows are judged
one by one; an item that is repeated is listed once; texts of any length are
scanned whole; an empty benchmark marks nothing, an empty table gives no rows;
further columns of the inputs are passed over by `find_overlap` and kept by
`remove_overlap`, whatever their names.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.session import cut
from quillspark.llm.textnum import Words, covered, lowered, plain_words, span_hash, text_slices, trimmed

WINDOW = 10
#: Words of the benchmark in one broadcast; an index of such a block takes some 100 MB at most.
BLOCK_WORDS = 200_000


def window_index(items: list[tuple[str | None, str]], window: int) -> dict[int, tuple]:
    """Windows of some benchmark items: by length, sorted hashes, a sieve of their low bits, and by hash the windows with their items."""
    windows: dict[int, dict[bytes, set]] = {}
    for _, _, buf, offs in text_slices(pa.array([t for _, t in items], pa.string()), 1 << 62):
        low = lowered(buf).tobytes()
        w = Words(buf, offs, plain_words())
        for row, (item, _) in enumerate(items):
            a, b = int(w.first[row]), int(w.first[row + 1])
            size = min(window, b - a)
            words = [low[s:e] for s, e in zip(w.starts[a:b], w.ends[a:b])]
            for i in range(b - a - size + 1 if size else 0):
                windows.setdefault(size, {}).setdefault(b" ".join(words[i : i + size]), set()).add(item)
    by_size = {}
    for size, found in windows.items():
        hashes: dict[int, list] = {}
        texts = list(found)
        for _, _, buf, offs in text_slices(pa.array([x.decode() for x in texts], pa.string()), 1 << 62):
            w = Words(buf, offs, plain_words())
            for h, x in zip(window_hashes(w, w.hashes(lower=True), w.windows(size), size).tolist(), texts):
                hashes.setdefault(h, []).append((x, sorted(i for i in found[x] if i is not None)))
        keys = np.array(sorted(hashes), np.uint64)
        sieve = np.zeros(1 << 20, bool)
        sieve[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        by_size[size] = (keys, sieve, hashes)
    return by_size


def window_hashes(w: Words, word_hash: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return span_hash(word_hash, at, at + size)


def _scan(w: Words, index: dict[int, tuple]) -> tuple[np.ndarray, list[set]]:
    """Which words of a slice lie in a window, and the items by row."""
    n = len(w.starts)
    hit = np.zeros(n, bool)
    items: list[set] = [set() for _ in range(len(w.first) - 1)]
    if not n:
        return hit, items
    word_hash, low, rows = w.hashes(lower=True), None, None
    for size, (keys, sieve, windows) in index.items():
        at = w.windows(size)
        h = window_hashes(w, word_hash, at, size)
        maybe = sieve[(h & np.uint64(len(sieve) - 1)).astype(np.int64)]
        at, h = at[maybe], h[maybe]
        k = np.searchsorted(keys, h)
        same = keys[np.minimum(k, len(keys) - 1)] == h
        at, h = at[same], h[same]
        if not len(at):
            continue
        if low is None:
            low, rows = lowered(w.buf).tobytes(), w.row_of()
        good = []
        for i, x in zip(at.tolist(), h.tolist()):
            mine = b" ".join([low[s:e] for s, e in zip(w.starts[i : i + size].tolist(), w.ends[i : i + size].tolist())])
            for text, ids in windows[x]:
                if text == mine:
                    good.append(i)
                    items[rows[i]].update(ids)
        hit |= covered(n, np.array(good, np.int64), size)
    return hit, items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list]:
    """The benchmark in lists of (item, text) of at most so many words, or of one item."""
    block, words = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        n = len(text or "") // 2 + 1
        if block and words + n > block_words:
            yield block
            block, words = [], 0
        block.append((item, text))
        words += n
    if block:
        yield block


def _mark(df: DataFrame, at: int, benchmark: DataFrame, item_col: str, bench_text: str, window: int, block_words: int) -> DataFrame:
    """df, whose text is column number `at`, with three more columns at its end: n words, hit words (int32 places as bytes), items."""
    sc = df.sparkSession.sparkContext
    names = df.schema.names
    kinds = [*df.schema.fields, T.StructField("n", T.LongType()), T.StructField("hits", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))]
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kinds)])
    k = len(names)
    df = df.toDF(*[f"c{i}" for i in range(k)]).select("*", F.lit(0).cast("long").alias(f"c{k}"), F.lit(b"").alias(f"c{k + 1}"), F.array().cast("array<string>").alias(f"c{k + 2}"))

    def scan(held):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, table = held.value, plain_words()
            for batch in batches:
                for lo, hi, buf, offs in text_slices(batch.column(at)):
                    part = batch.slice(lo, hi - lo)
                    w = Words(buf, offs, table)
                    hit, items = _scan(w, index)
                    spots, old_hits, old_items = [], part.column(k + 1).to_pylist(), part.column(k + 2).to_pylist()
                    marks = np.flatnonzero(hit)
                    bounds = np.searchsorted(marks, w.first)
                    for r in range(hi - lo):
                        own = (marks[bounds[r] : bounds[r + 1]] - w.first[r]).astype(np.int32)
                        spots.append((np.union1d(np.frombuffer(old_hits[r], np.int32), own).astype(np.int32) if old_hits[r] else own).tobytes())
                        items[r].update(old_items[r])
                    yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(w.counts, pa.int64()), pa.array(spots, pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=[f"c{i}" for i in range(k + 3)])

        return each

    marked = None
    for block in _blocks(benchmark, item_col, bench_text, block_words) if benchmark.take(1) else [[]]:
        # what an earlier block marked is written first, so a task holds the index of one block
        marked = (df if marked is None else cut(marked)).mapInArrow(trimmed(scan(sc.broadcast(window_index(block, window)))), inner)
    return marked


def find_overlap(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each document: id, n_words, hit_places (int32 places of hit words, as bytes), n_hit, items (sorted ids of items with occurring windows, as strings)."""
    marked = _mark(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), 1, benchmark, item_col, bench_text, window, block_words)
    return marked.select(F.col("c0").alias(id_col), F.col("c2").alias("n_words"), F.col("c3").alias("hit_places"), (F.octet_length("c3") / 4).cast("long").alias("n_hit"), F.col("c4").alias("items"))


def remove_overlap(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", window: int = WINDOW, max_share: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without benchmark passages, in the same columns.

    Each run of hit words goes, with what stands between them, and a line feed
    takes its place. A document of which more than max_share of the words are
    hit goes as a whole. Documents without hits are unchanged.
    """
    names = docs.schema.names
    at = names.index(text_col)
    marked = _mark(docs, at, benchmark, item_col, bench_text, window, block_words)
    k = len(names)
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])

    def each(batches):
        table = plain_words()
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                hits = part.column(k + 1).to_pylist()
                if not any(hits):
                    yield pa.RecordBatch.from_arrays(part.columns[:k], names=[f"c{i}" for i in range(k)])
                    continue
                w, raw = Words(buf, offs, table), buf.tobytes()
                texts, stay = part.column(at).to_pylist(), []
                for r, spots in enumerate(hits):
                    stay.append(len(spots) // 4 <= max_share * (w.first[r + 1] - w.first[r]))
                    if spots and stay[-1]:
                        own = np.frombuffer(spots, np.int32) + w.first[r]
                        ends = np.flatnonzero(np.diff(own) > 1)
                        out, upto = [], int(offs[r])
                        for a, b in zip(own[np.r_[0, ends + 1]].tolist(), own[np.r_[ends, len(own) - 1]].tolist()):
                            out.append(raw[upto : int(w.starts[a])])
                            upto = int(w.ends[b])
                        texts[r] = b"\n".join([*out, raw[upto : int(offs[r + 1])]]).decode()
                kept = [x if i != at else pa.array(texts, x.type) for i, x in enumerate(part.columns[:k])]
                yield pa.RecordBatch.from_arrays(kept, names=[f"c{i}" for i in range(k)]).filter(pa.array(stay))

    return marked.mapInArrow(trimmed(each), inner).toDF(*names)
