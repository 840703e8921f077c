"""Exact and order-dependent near-duplicate removal, upserts and conditional inserts."""
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a representative that later texts are compared with.
SAMPLE = 2000


def first_by_hash(df: DataFrame, text: str, order: str, within: list[str] | None = None) -> DataFrame:
    """The first row, by order, of each distinct text (of each `within` group)."""
    digest = F.sha2(text, 256)
    w = Window.partitionBy(*(within or []), digest).orderBy(order)
    return df.select(F.struct(*df.columns).alias("row"), F.row_number().over(w).alias("n")).where("n = 1").select("row.*")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit for each character of a."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def token_set_ratio(a: str, b: str) -> float:
    """Similarity 0..100 of two texts' sets of blank-separated tokens; 100 if one set holds the other and they meet."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = x & y, x - y, y - x
    if both and (not only_x or not only_y):
        return 100.0
    shared, left, right = (" ".join(sorted(s)) for s in (both, only_x, only_y))
    gap = 1 if both else 0
    n_left, n_right = len(shared) + gap + len(left), len(shared) + gap + len(right)
    apart = len(left) + len(right) - 2 * common_length(left, right)
    best = 100 * (1 - apart / (n_left + n_right)) if n_left + n_right else 0.0
    if both:
        best = max(best, *(100 * (1 - (gap + len(s)) / (len(shared) + n)) for s, n in ((left, n_left), (right, n_right))))
    return best


def sequential_near_dup(df: DataFrame, *, bucket: str, order: str, text: str, threshold: float = 97, min_chars: int = 1200, state: DataFrame | None = None) -> DataFrame:
    """df with is_dup: each text against its bucket's representative, the last text that was kept.

    Texts are walked in `order` within a bucket; shorter ones are never compared
    and never represent. A partition is sorted and streamed, so a task holds one
    representative at a time, however large its bucket; but the walk depends on the
    order, so a bucket is one task (`order_free_near_dup` has no such limit).
    state: bucket and representative where an earlier run ended (near_dup_state).
    """
    names = df.columns
    walked = df.select(F.col(bucket).cast("string").alias("bucket"), F.lit(1).alias("turn"), F.col(order).alias("at"), F.col(text).alias("text"), F.struct(*names).alias("row"))
    if state is not None:
        none = F.lit(None)
        walked = walked.unionByName(state.select(F.col("bucket").cast("string").alias("bucket"), F.lit(0).alias("turn"), none.cast(df.schema[order].dataType).alias("at"), F.col("representative").alias("text"), none.cast(walked.schema["row"].dataType).alias("row")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, first = None, None, True
        for batch in batches:
            out, seeds = [], batch.column(1).to_pylist()
            for b, turn, t in zip(batch.column(0).to_pylist(), seeds, batch.column(3).to_pylist()):
                if first or b != now:
                    now, kept, first = b, None, False
                dup = False
                if not turn:
                    kept = t
                elif t and len(t) >= min_chars:
                    dup = kept is not None and token_set_ratio(t, kept) >= threshold
                    kept = kept if dup else t[:SAMPLE]
                out.append(dup)
            made = pa.RecordBatch.from_arrays([batch.column(4), pa.array(out, pa.bool_())], names=["row", "is_dup"])
            yield made.filter(pa.array([bool(x) for x in seeds]))

    schema = T.StructType([walked.schema["row"], T.StructField("is_dup", T.BooleanType())])
    return walked.repartition("bucket").sortWithinPartitions("bucket", "turn", "at").mapInArrow(walk, schema).select("row.*", "is_dup")


def near_dup_state(marked: DataFrame, *, bucket: str, order: str, text: str, min_chars: int = 1200, state: DataFrame | None = None) -> DataFrame:
    """bucket, representative of each bucket after sequential_near_dup(): its last kept text, else what the state had."""
    kept = marked.where(~F.col("is_dup") & (F.char_length(text) >= min_chars))
    now = kept.groupBy(F.col(bucket).cast("string").alias("bucket")).agg(F.max_by(F.left(F.col(text), F.lit(SAMPLE)), order).alias("representative"))
    return now if state is None else now.unionByName(state.select("bucket", "representative").join(now.select("bucket"), "bucket", "left_anti"))


def order_free_near_dup(df: DataFrame, *, key: str, text: str, words: int = 5, least: float = 0.8, parts: int = 16) -> DataFrame:
    """df with is_dup: whether a text whose shingles are at least `least` alike stands under a smaller key. Independent of rows' order.

    Candidates agree in one of `parts` least hashes of shingles taken over disjoint
    ranges; each bucket's rows meet the bucket's smallest key alone, so a crowd of
    copies costs one row each.
    """
    tokens = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " ")), " ")
    held = df.select(F.col(key).alias("key"), tokens.alias("w")).where(F.size("w") >= words)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (words - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " "))))
    shingled = held.select("key", grams.alias("g"))
    of_part = lambda p: F.array_min(F.filter("g", lambda h: F.pmod(h, F.lit(parts)) == p))
    sketch = F.array(*[of_part(p) for p in range(parts)])
    each = shingled.select("key", "g", F.posexplode(sketch).alias("part", "h")).where("h is not null")
    first = each.groupBy("part", "h").agg(F.min("key").alias("first"))
    pairs = each.select("key", "part", "h").join(first, ["part", "h"]).where("first < key").select("first", "key").distinct()
    left, right = shingled.select(F.col("key").alias("first"), F.col("g").alias("a")), shingled.select("key", F.col("g").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    alike = pairs.join(left, "first").join(right, "key").where(both >= least * (F.size("a") + F.size("b") - both)).select("key").distinct()
    return df.join(alike.select(F.col("key").alias(key), F.lit(True).alias("is_dup")), key, "left").withColumn("is_dup", F.coalesce("is_dup", F.lit(False)))


def keep_if_grown(df: DataFrame, *, doc: str, section: list[str], seq: str, text: str, tokens: str, near: float = 95, novelty: float = 0.10, compat: bool = False) -> DataFrame:
    """Drops a chunk that is near its section's last kept one; compat: also one that has not grown by `novelty` in tokens."""
    keys = [doc, *section]

    def walk(frames):
        now, last = None, None
        for frame in frames:
            keep = []
            for *key, t, n in frame[[*keys, text, tokens]].itertuples(index=False):
                key = tuple(map(str, key))
                if key != now:
                    now, last = key, None
                good = bool(t and t.strip())
                if good and last is not None:
                    good = token_set_ratio(last[0], t) < near and (not compat or max(0, n - min(last[1], n)) / max(1, n) >= novelty)
                if good:
                    last = (t, n)
                keep.append(good)
            yield frame[keep]

    return df.repartition(doc).sortWithinPartitions(*keys, seq).mapInPandas(walk, df.schema)


def grown(df: DataFrame, *, group: str, seq: str, size: str, novelty: float = 0.10) -> DataFrame:
    """group, seq of rows whose size is at least 1 / (1 - novelty) times that of the last kept row of the group, in seq order.

    The rule looks back at what was kept, so sorted rows are streamed: a task holds
    one number at a time, however large a group is.
    """
    rows = df.select(F.col(group).alias("group"), F.col(seq).alias("seq"), F.col(size).cast("double").alias("size"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, first = None, None, True
        for batch in batches:
            keep = []
            for g, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if first or g != now:
                    now, last, first = g, None, False
                good = n is not None and (last is None or max(0.0, n - last) >= novelty * max(1.0, n))
                last = n if good else last
                keep.append(good)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["group", "seq"])

    schema = T.StructType([rows.schema["group"], rows.schema["seq"]])
    return rows.repartition("group").sortWithinPartitions("group", "seq").mapInArrow(walk, schema).toDF(group, seq)


def upsert(base: DataFrame, new: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """Rows of both, the latest version of each key. max_by sums up before the shuffle, so a hot key costs one row a task."""
    both = base.unionByName(new)
    last = both.groupBy(*[F.col(k).alias(f"key{i}") for i, k in enumerate(key)]).agg(F.max_by(F.struct(*both.columns), F.struct(*version)).alias("row"))
    return last.select("row.*")


def insert_absent(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """base and the rows of new whose key it lacks; of equal new keys one."""
    return base.unionByName(new.dropDuplicates(key).join(base.select(*key), key, "left_anti").select(*base.columns))
