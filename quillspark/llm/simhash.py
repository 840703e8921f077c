"""Operator 5: SimHash near-duplicates by tiled exact comparison.

A fingerprint's bit is 1 if it is set in over half of the XXH64 hashes (seed
42) of the text's shingles of `width` lower-cased words `[^\\x20\\x09-\\x0D]+`.
Equal fingerprints collapse into one row. Distinct fingerprints go to tiles by
the population counts of their two halves; tiles are cut to a bounded size by a
hash. Tile pairs whose counts differ by more than the radius are skipped; all
others are compared exactly in numpy (exclusive-or and bit counts), and a tile
pair gives a spanning forest of its links, never all pairs. Components come
from the links by distributed min-label contraction.

Defined cases: a null or empty text has fingerprint zero and is linked like any
other; fewer words than a shingle are one shingle; a null doc_id keeps its row
and takes part in links, but is never a component's smallest id unless all ids
of the component are null; repeated rows stay rows of their own; ids may be of
any type; texts of any length are hashed whole, a slice at a time; an empty table
gives no rows; further columns are passed over.

What grows faster than the table: tile pairs within the radius of each other's
counts, and with them the copies of a fingerprint that travel, grow with the
number of tiles, so the comparison is quadratic in distinct fingerprints, at
eight bytes and some nanoseconds each.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.components import components
from quillspark.llm.session import cut, parts_for
from quillspark.llm.textnum import Words, lowered, space_words, text_slices, trimmed

WIDTH, RADIUS, SEED = 3, 3, 42
#: Fingerprints in one tile at most, on average.
TILE = 8192
#: Bytes of the exclusive-or table that is in memory at once.
TABLE = 1 << 21


def _fingerprints(w: Words, width: int) -> np.ndarray:
    """Fingerprints of a slice's texts."""
    import xxhash

    low = lowered(w.buf).tobytes()
    digest = xxhash.xxh64_intdigest
    rows = len(w.first) - 1
    counts = w.counts
    starts, ends = w.starts.tolist(), w.ends.tolist()
    words = [low[s:e] for s, e in zip(starts, ends)]
    joined = [b"%b %b %b" % t for t in zip(words, words[1:], words[2:])] if width == 3 else [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    whole = w.windows(width)
    grams = np.maximum(counts - width + 1, (counts > 0).astype(np.int64))
    bound = np.concatenate(([0], np.cumsum(grams)))
    h = np.empty(bound[-1], np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    long_ = np.ones(len(h), bool)
    long_[bound[short]] = False
    h[long_] = np.fromiter((digest(joined[i], SEED) for i in whole.tolist()), np.uint64, len(whole))
    for r in short.tolist():
        h[bound[r]] = digest(b" ".join(words[w.first[r] : w.first[r + 1]]), SEED)
    out = np.zeros(rows, np.uint64)
    full = np.flatnonzero(grams)
    if not len(full):
        return out
    # counters of eight bits side by side, summed over pieces of at most 255 hashes
    pieces = -(-grams[full] // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(pieces)[:-1])), pieces)
    at = bound[full][owner] + 255 * nth
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    got = np.zeros(len(full), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), at)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits = (2 * sums > grams[full][:, None]).astype(np.uint64)
        for byte in range(8):
            got |= bits[:, byte] << np.uint64(8 * byte + k)
    out[full] = got
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of each row; a narrow map over the scan."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", src.schema[0].dataType), T.StructField("fp", T.LongType(), False)])

    def each(batches):
        table = space_words()
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch.column(1)):
                fp = _fingerprints(Words(buf, offs, table), width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return src.mapInArrow(trimmed(each), schema)


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all links within a, or between a and b, do; fewer than there are fingerprints."""
    rows, cols = (a, a) if b is None else (a, b)
    step = max(1, TABLE // 8 // max(1, len(cols)))
    names = a if b is None else np.concatenate((a, b))
    up = np.arange(len(names))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out, shift = [], 0 if b is None else len(a)
    for lo in range(0, len(rows), step):
        near = np.bitwise_count(rows[lo : lo + step, None] ^ cols[None, :]) <= radius
        if b is None:
            near &= np.arange(len(cols))[None, :] > np.arange(lo, min(lo + step, len(rows)))[:, None]
        i, j = np.nonzero(near)
        for x, y in zip((i + lo).tolist(), (j + shift).tolist()):
            p, q = root(x), root(y)
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((int(names[x]), int(names[y])))
    return out


def links(distinct: DataFrame, *, radius: int = RADIUS, tile: int = TILE, parts: int) -> DataFrame:
    """Links (a, b) of a spanning forest for each pair of tiles. distinct: fp, each once."""
    half = (1 << 32) - 1
    pc = distinct.select("fp", F.bit_count(F.col("fp").bitwiseAND(F.lit(half))).alias("x"), F.bit_count(F.shiftrightunsigned("fp", 32)).alias("y"))
    # at most 33 * 33 rows: the population counts of two halves of 32 bits
    sizes = pc.groupBy("x", "y").agg(F.ceil(F.count("*") / tile).alias("cuts"))
    near = F.explode(F.expr(f"flatten(transform(sequence(-{radius}, {radius}), i -> transform(sequence(abs(i) - {radius}, {radius} - abs(i)), j -> struct(i, j))))"))
    other = sizes.select(F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("cuts").alias("ocuts"))
    reach = sizes.select("*", near.alias("d")).select("x", "y", "cuts", (F.col("x") + F.col("d.i")).alias("ox"), (F.col("y") + F.col("d.j")).alias("oy")).join(F.broadcast(other), ["ox", "oy"])
    mine = pc.join(F.broadcast(sizes), ["x", "y"]).select("fp", "x", "y", F.pmod(F.xxhash64("fp"), "cuts").alias("cut"))
    # a tile is (x, y, cut); the smaller of a pair's two names stands first
    dealt = (
        mine.join(F.broadcast(reach), ["x", "y"])
        .select("fp", F.struct("x", "y", "cut").alias("own"), F.explode(F.expr("transform(sequence(0L, ocuts - 1), c -> struct(ox as x, oy as y, c as cut))")).alias("far"))
        .select("fp", F.xxhash64(F.least("own", "far"), F.greatest("own", "far")).alias("pair"), F.when(F.col("own") == F.col("far"), 0).when(F.col("own") < F.col("far"), 1).otherwise(2).cast("byte").alias("side"))
    )

    def compare(key, table):
        fp, side = table.column("fp").to_numpy().view(np.uint64), table.column("side").to_numpy()
        one, a, b = fp[side == 0], fp[side == 1], fp[side == 2]
        found = (forest(one, None, radius) if len(one) else []) + (forest(a, b, radius) if len(a) and len(b) else [])
        ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return dealt.repartition(parts, "pair").groupBy("pair").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """id, fp and component_id (the smallest id reachable) of each row."""
    parts = parts_for(docs, 16 << 20)
    fps = cut(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    distinct = fps.groupBy("fp").agg(F.min("id").alias("least"))
    edges = cut(links(distinct.select("fp"), radius=radius, tile=tile, parts=parts))
    member = components(edges)
    labelled = distinct.join(member.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(smallest, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
