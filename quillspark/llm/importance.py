"""Operator 11: importance resampling towards a target distribution.

Documents are drawn by hashed n-gram features, so that the drawn ones look like
a target corpus. Words are mapped to integers by a dictionary of the distinct
words of both corpora; n-grams are tuples of those integers. A block (some MB of
whole texts) is encoded once: its own distinct words, what they count, and the
texts as places in that list, packed. The blocks' words meet in the dictionary, so a
word travels once a block however often it occurs. Each distinct tuple is spelled
out once from its words and hashed once; counts come back by tuple. A bucket's
gain is the floor of 1000 * ln of its smoothed share in the target over that in
the documents. A document's weight is the sum of its features' gains, its score
adds Gumbel noise that follows from its id, so the highest scores are a draw
without replacement. Ranks come from a range partitioning by score and id, and
the partitions' counts.

Words: A-Z lower-cased, then `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.

Defined cases: a null or empty text has no words, no features and weight 0; it
has a score and is drawn only where min_words is 0; a null id is hashed as the
empty string and stands behind all ids in ties; repeated rows are scored and drawn
one by one (their noise is the same), ties among them in no fixed order; texts of
any length are taken whole; empty documents give no rows; an empty target has
T = 0, and the gains follow; further columns are passed over.
"""
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.session import cut, drop_cut, parts_for
from quillspark.llm.textnum import Words, lowered, plain_words, text_slices, trimmed

BUCKETS, SEED, SHARE, MIN_WORDS = 10_000, 2024, 10, 20
#: Bytes of text in one block.
BLOCK = 8 << 20


def _vocabulary(w: Words, table: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each word as its place in the list of distinct words, the most frequent first, and that list."""
    data = lowered(w.buf)[table[w.buf]]
    offs = np.zeros(len(w.starts) + 1, np.int64)
    np.cumsum(w.ends - w.starts, out=offs[1:])
    coded = pa.Array.from_buffers(pa.large_string(), len(w.starts), [None, pa.py_buffer(offs), pa.py_buffer(data)]).dictionary_encode()
    places = coded.indices.to_numpy()
    order = np.argsort(-np.bincount(places, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[places], coded.dictionary.take(pa.array(order)).cast(pa.string())


def _packed(seq: np.ndarray) -> bytes:
    """Places below 2**32 by byte planes, compressed: the places of common words are small, so the high planes are almost all zero."""
    planes = np.ascontiguousarray(seq.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.uint32).reshape(n)


def _tuples(w: Words, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tuples of n (two or more) consecutive words of one text, and each run's place among them."""
    at = w.windows(n)
    if not len(at):
        return np.zeros((0, n), np.int64), np.zeros(0, np.int64)
    code, first = ids[at], None
    for j in range(1, n):
        # pairs of (what stands so far, next word) are numbered anew, so codes stay small
        _, first, code = np.unique(code * (int(ids.max()) + 1) + ids[at + j], return_index=True, return_inverse=True)
    return ids[at[first][:, None] + np.arange(n)], code


def encoded(docs: DataFrame, side: int, least: int, most: int, block_bytes: int) -> DataFrame:
    """Blocks of (id, text) rows: block, side, ids, n_words, vocab, times (of each word), seq (places in vocab), grams (of more than one word)."""
    kind = docs.schema["id"].dataType
    gram = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("tuples", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("times", T.ArrayType(T.LongType())), T.StructField("seq", T.BinaryType())])
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("side", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("n_words", T.BinaryType()), T.StructField("vocab", T.ArrayType(T.StringType())), T.StructField("times", T.ArrayType(T.LongType())), T.StructField("seq", T.BinaryType()), T.StructField("grams", T.ArrayType(gram))])
    arrow_gram = pa.struct([("n", pa.int32()), ("tuples", pa.list_(pa.list_(pa.int32()))), ("times", pa.list_(pa.int64())), ("seq", pa.binary())])

    def each(batches):
        table, block = plain_words(), (TaskContext.get().partitionId() << 34) + side  # even numbers are documents'
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch.column(1), block_bytes):
                w = Words(buf, offs, table)
                ids, vocab = _vocabulary(w, table)
                grams = []
                for n in range(max(2, least), most + 1):
                    tuples, seq = _tuples(w, ids, n)
                    grams.append({"n": n, "tuples": tuples.tolist(), "times": np.bincount(seq, minlength=len(tuples)).tolist(), "seq": _packed(seq)})
                one = lambda values, t: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(t))
                own = batch.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()), pa.array([side], pa.int32()), one(own, own.type), pa.array([w.counts.astype(np.int32).tobytes()], pa.binary()),
                        one(vocab, pa.string()), one(pa.array(np.bincount(ids, minlength=len(vocab))), pa.int64()), pa.array([_packed(ids)], pa.binary()), pa.array([grams], pa.list_(arrow_gram)),
                    ],
                    names=schema.names,
                )
                block += 2

    return docs.mapInArrow(trimmed(each), schema)


def _sides(df: DataFrame, key: list[str]) -> DataFrame:
    """Counts by key in the documents (s) and in the target (t)."""
    return df.groupBy(*key).agg(*[F.sum(F.when(F.col("side") == i, F.col("times")).otherwise(0)).alias(c) for i, c in ((0, "s"), (1, "t"))])


def dictionary(blocks: DataFrame) -> DataFrame:
    """word, s, t, word_id of each distinct word; written."""
    words = blocks.select("side", F.explode(F.arrays_zip("vocab", "times")).alias("x")).select("side", F.col("x.vocab").alias("word"), F.col("x.times").alias("times"))
    return cut(_sides(words, ["word"]).withColumn("word_id", F.monotonically_increasing_id()))


def _by_block(rows: DataFrame, what: str, key: list[str]) -> DataFrame:
    """`what` of each place, in order, as one array by block."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", what))).alias("x")).select(*key, F.col(f"x.{what}").alias(what))


def _placed(blocks: DataFrame, words: DataFrame, what: str) -> DataFrame:
    """block and an array of what `words` holds of each of its words."""
    return _by_block(blocks.select("block", F.posexplode("vocab").alias("pos", "word")).join(words, "word"), what, ["block"])


def _long_tuples(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """block, n, pos, side, times, ids of each block's distinct tuples of more than one word; written."""
    numbered = _placed(blocks, words.select("word", "word_id"), "word_id")
    grams = blocks.select("block", "side", F.explode("grams").alias("g")).select("block", "side", "g.n", F.posexplode(F.arrays_zip("g.tuples", "g.times")).alias("pos", "x"))
    return cut(grams.join(numbered, "block").select("block", "n", "pos", "side", F.col("x.times").alias("times"), F.transform("x.tuples", lambda i: F.col("word_id")[i]).alias("ids")))


def spelled(tuples: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """ids, s, t, text and bucket: each distinct tuple's words put together once and hashed once."""
    ones = tuples.where(F.size("ids") == 1).select("ids", "s", "t", F.col("ids")[0].alias("word_id")).join(words.select("word_id", F.col("word").alias("text")), "word_id").select("ids", "s", "t", "text")
    more = tuples.where(F.size("ids") > 1).select("ids", "s", "t", F.posexplode("ids").alias("pos", "word_id")).join(words.select("word_id", "word"), "word_id")
    more = more.groupBy("ids").agg(F.first("s").alias("s"), F.first("t").alias("t"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("x")).select("ids", "s", "t", F.array_join(F.col("x.word"), " ").alias("text"))
    return ones.union(more).withColumn("bucket", (F.crc32(F.col("text").cast("binary")) % buckets).cast("int"))


def gains(hashed: DataFrame, buckets: int) -> DataFrame:
    """bucket and gain of each bucket in use: at most `buckets` rows."""
    by = hashed.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    sums = by.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    num = lambda c, k: F.col(c).cast("double") + k
    return by.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(num("t", 1) * num("all_s", buckets) / (num("s", 1) * num("all_t", buckets)))).alias("gain"))


def weights(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS, block_bytes: int = BLOCK) -> DataFrame:
    """id, n_words, n_features and weight of each document, written; features are runs of least to most consecutive words."""
    if not 1 <= least <= most:
        raise ValueError("runs have from 1 to any number of words")
    mine = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    theirs = target.select(F.lit(None).cast(mine.schema["id"].dataType).alias("id"), F.col(target_text).cast("string").alias("text"))
    own = cut(encoded(mine, 0, least, most, block_bytes))
    blocks = own.union(encoded(theirs, 1, least, most, block_bytes))
    words = dictionary(blocks)
    ones = words.select(F.array("word_id").alias("ids"), "s", "t") if least == 1 else None
    runs = _long_tuples(blocks, words) if most > 1 else None
    long_ = _sides(runs, ["ids"]) if runs is not None else None
    tuples = ones if long_ is None else long_ if ones is None else ones.union(long_)
    hashed = cut(spelled(tuples, words, buckets))
    gain = cut(gains(hashed, buckets).coalesce(1))
    by_tuple = hashed.join(F.broadcast(gain), "bucket")
    out = own.select("block", "ids", "n_words", "seq", *([] if runs is None else ["grams.seq", "grams.n"])).toDF("block", "ids", "n_words", "seq", *([] if runs is None else ["long_seq", "long_n"]))
    if least == 1:
        out = out.join(_placed(own, by_tuple.where(F.size("ids") == 1).select(F.col("text").alias("word"), "gain"), "gain"), "block", "left")
    else:
        out = out.withColumn("gain", F.lit(None).cast("array<long>"))
    if runs is not None:
        back = runs.where("side = 0").join(by_tuple.select("ids", "gain"), "ids")
        sized = _by_block(back, "gain", ["block", "n"]).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("n", "gain"))).alias("long_gain"))
        out = out.join(sized, "block", "left")
    else:
        out = out.select("*", F.lit(None).cast("array<binary>").alias("long_seq"), F.lit(None).cast("array<int>").alias("long_n"), F.lit(None).cast("array<struct<n:int,gain:array<long>>>").alias("long_gain"))
    schema = T.StructType([T.StructField("id", mine.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])

    def each(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                at = {n: batch.column(n)[r] for n in ("ids", "n_words", "seq", "gain", "long_seq", "long_n", "long_gain")}
                counts = np.frombuffer(at["n_words"].as_py(), np.int32).astype(np.int64)
                n_features, weight = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
                parts = [(1, at["seq"], at["gain"].values)] if at["gain"].is_valid and least == 1 else []
                if at["long_n"].is_valid and at["long_gain"].is_valid:
                    gained = {x["n"].as_py(): x["gain"].values for x in at["long_gain"]}
                    parts += [(n.as_py(), s, gained[n.as_py()]) for n, s in zip(at["long_n"], at["long_seq"]) if n.as_py() in gained]
                for n, seq, gain in parts:
                    runs_of = np.maximum(counts - n + 1, 0)
                    end = np.cumsum(runs_of)
                    total = np.concatenate(([0], np.cumsum(gain.to_numpy()[_unpacked(seq.as_py(), int(runs_of.sum()))])))
                    n_features += runs_of
                    weight += total[end] - total[end - runs_of]
                yield pa.RecordBatch.from_arrays([at["ids"].values, pa.array(counts), pa.array(n_features), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    done = cut(out.select("ids", "n_words", "seq", "gain", "long_seq", "long_n", "long_gain").mapInArrow(trimmed(each), schema).withColumnRenamed("id", id_col))
    for x in (own, words, hashed, gain, *([] if runs is None else [runs])):
        drop_cut(x)
    return done


def ranked(rows: DataFrame, by: list, *, name: str = "rank") -> DataFrame:
    """rows with their place (1, 2, ...) in the order `by`: a range partitioning, numbers within partitions, and the partitions' counts."""
    parts = parts_for(rows, 32 << 20)
    placed = cut(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))
    # a row for each partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", min_words: int = MIN_WORDS, share: int = SHARE, seed: int = SEED, **more) -> DataFrame:
    """id, n_features, weight, score and rank of each document; share percent of those of min_words or more words have a rank, the highest scores first."""
    w = weights(docs, target, id_col=id_col, **more)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    # each row has a key of its own, so repeated ids keep apart
    scored = w.withColumn("score", F.col("weight") + noise).withColumn("_row", F.monotonically_increasing_id())
    can = scored.where(F.col("n_words") >= min_words)
    n = can.count() * share // 100
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last()]
    least = least_score(can, n)
    drawn = ranked(can.where(F.col("score") >= least).select("_row", "score", id_col), order).where(F.col("rank") <= n).select("_row", "rank")
    return scored.join(drawn, "_row", "left").select(id_col, "n_features", "weight", "score", "rank")


def least_score(rows: DataFrame, n: int) -> int:
    """A score that at least n rows reach, and not many more, if so many rows there are: from the counts of some 4,000 steps of scores."""
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    if low is None or n <= 0:
        return 0 if low is None else high + 1
    step = max(1, (high - low) // 4096)
    steps = rows.groupBy(F.floor((F.col("score") - low) / step).alias("k")).count().orderBy(F.col("k").desc()).collect()
    have = 0
    for k, m in steps:
        have += m
        if have >= n:
            return low + k * step
    return low
