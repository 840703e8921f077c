"""Operator 6 [native]: mixing sources to target weights.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share
all words; a target stops at MOST times its source's size and the excess is
shared again by weight until none is above.

Each source's documents are dealt to chunks by a hash, and those of a chunk are
packed, one after the other in the order of the id, into blocks of `block_words`
words (a chunk's last block may be shorter), so a block's words lie together. A source's quota of draws
is its target in blocks. Slots of all sources are dealt to output shards by a
pseudorandom permutation of all slots, so a shard's source counts are
multinomial draws given each source's total (free draws would overshoot the cap
and miss small targets). Within a source, draw m takes block perm(m) of its
epoch; each epoch permutes the blocks anew, so no block is drawn twice before
all were drawn once. Draws join the blocks' contents by (source, index) and are
written to the shared folder: each drawn row has its shard, its slot and its
pieces of documents with their words, and what a document gives to the mix is
summed over the pieces of the written rows.

Running offsets are summed in bounded hash chunks, blocks then counted over
chunks, and slots unfold from ranges of 4096, so a source that holds a third of
all rows spreads over all tasks. Texts are dealt out once, by chunk; draws follow
them there. Defined cases: null texts have size 0 and are never
drawn; null sources are one source; repeated rows are rows of their own; ids
may repeat or be null; a text of any length is cut into blocks whole; an empty
table gives no rows; further columns are passed over, whatever their names.
"""
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.session import cut, parts_for
from quillspark.llm.texts import n_space_words, space_words

#: Weights by a source's rank, most times a source is repeated.
WEIGHTS, MOST = (5, 2, 1), 3
#: Words of a block, slots of an output shard, documents of a chunk, slots that unfold from one row, seed.
BLOCK_WORDS, SHARD_SLOTS, CHUNK, RANGE, SEED = 64, 65_536, 1000, 4096, 20_240
ROUNDS = 8
#: Whether a join deals out both sides anew unless they lie by all of its keys.
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, rank (from 1), source_size, target of each source of (source, size) rows. One window row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("rank", F.row_number().over(order)).withColumn("w", F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights)))).cast("double"))
    per = per.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # by cap / weight, a source is capped if it is below the level that those before it leave
    before = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_ = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumn("level", left / open_).withColumn("capped", F.col("cap") / F.col("w") < F.col("level"))
    spent = lambda c: F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(everything), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - spent("cap")) / F.greatest(F.sum("w").over(everything) - spent("w"), F.lit(1e-300))
    return per.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * level)).select("source", "rank", "source_size", "target")


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1 (swap or not) at x; key picks it."""

    def step(acc, j):
        other = F.pmod(F.pmod(F.xxhash64(key, j), n) + n - acc, n)
        swap = F.xxhash64(j, key, F.greatest(acc, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def plan(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources, with their blocks (n), with quota (q) and the first slot of each."""
    out = sources.withColumn("q", F.coalesce(F.least(most * F.col("n"), F.round(F.try_divide(F.col("target") * F.col("n"), "source_size")).cast("long")), F.lit(0)).cast("long"))
    upto = F.sum("q").over(Window.orderBy("rank"))
    return out.withColumn("slots", F.sum("q").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("first_slot", upto - F.col("q"))


def draws(planned: DataFrame, seed: int = SEED, shard_slots: int = SHARD_SLOTS, parts: int = 200) -> DataFrame:
    """rank, block, shard, slot: every drawn block and its place in the output. Slots unfold in `parts` partitions."""
    ranges = planned.where("q > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("q") - 1) / RANGE))).alias("hi"))
    each = ranges.repartition(parts, "rank", "hi").select("*", F.explode(F.sequence(F.col("hi") * RANGE, F.least(F.col("q"), (F.col("hi") + 1) * RANGE) - 1)).alias("m"))
    epoch = F.floor(F.col("m") / F.col("n"))
    block = permuted(F.pmod("m", "n"), F.col("n"), F.xxhash64(F.lit(seed), F.col("rank"), epoch))
    at = permuted(F.col("first_slot") + F.col("m"), F.col("slots"), F.xxhash64(F.lit(seed)))
    return each.select("rank", block.alias("block"), at.alias("at")).select("rank", "block", F.floor(F.col("at") / shard_slots).alias("shard"), F.pmod("at", F.lit(shard_slots)).alias("slot"))


def in_chunks(ranked: DataFrame, chunks: int) -> DataFrame:
    """ranked (rank, id, size, th, ...) with chunk, row in the chunk and start, the offset of its words in the chunk."""
    dealt = ranked.withColumn("chunk", F.pmod(F.xxhash64("id", "size"), F.lit(chunks)))
    order = Window.partitionBy("rank", "chunk").orderBy("id", "size", "th")
    run = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("row", F.row_number().over(order)).withColumn("start", run - F.col("size"))


def chunk_blocks(chunked: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """rank, chunk, first (the number of its first block in the source), blocks."""
    totals = chunked.groupBy("rank", "chunk").agg(F.ceil(F.sum("size") / block_words).cast("long").alias("blocks"))
    upto = F.sum("blocks").over(Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0))
    return totals.select("rank", "chunk", (upto - F.col("blocks")).alias("first"), "blocks")


def contents(chunked: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """rank, chunk, block (from 0 in its chunk), pieces of each block: at (offset in the block), row, id, first (word of the document), words, text, in order.

    Of rows in chunks with their words in one string, `all`. A block has at most block_words pieces.
    """
    last = F.col("start") + F.col("size") - 1
    low = lambda b: F.greatest(F.col("start"), b * block_words)
    size = lambda b: F.least(last + 1, (b + 1) * block_words) - low(b)
    text = lambda all_, b: F.array_join(F.slice(all_, (low(b) - F.col("start") + 1).cast("int"), size(b).cast("int")), " ")
    piece = lambda all_, b: F.struct((low(b) - b * block_words).alias("at"), "row", "id", (low(b) - F.col("start")).alias("first"), size(b).alias("words"), text(all_, b).alias("text"))
    numbers = F.sequence(F.floor(F.col("start") / block_words), F.floor(last / block_words))
    # an array of one, so that a text is cut into words once and not for each block
    cuts = F.transform(F.array(F.split("all", " ")), lambda all_: F.transform(numbers, lambda b: F.struct(b.alias("block"), piece(all_, b).alias("piece"))))
    each = chunked.where("size > 0").select("rank", "chunk", F.explode(F.get(cuts, F.lit(0))).alias("x"))
    return each.groupBy("rank", "chunk", "x.block").agg(F.sort_array(F.collect_list("x.piece")).alias("pieces"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(the mix: rank, chunk, block, shard, slot, pieces of each draw; one row per document). Documents: id, source, size, source_size, target, taken."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    own = [F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_space_words(text).alias("size"), F.xxhash64(text).alias("th")]
    sizes = cut(docs.select(*own))
    chunks = max(1, math.ceil(sizes.count() / CHUNK))
    ranked = cut(targets(sizes), 1)
    keys = ranked.select(F.col("source").alias("s"), "rank", "source_size", "target")
    small = keys.count() <= 50_000

    def spread(rows: DataFrame) -> DataFrame:
        return in_chunks(rows.join(F.broadcast(keys) if small else keys, F.col("source").eqNullSafe(F.col("s"))).drop("s"), chunks)

    placed = cut(spread(sizes))
    per_chunk = cut(chunk_blocks(placed, block_words))
    sources = cut(plan(ranked.join(per_chunk.groupBy("rank").agg(F.sum("blocks").alias("n")), "rank", "left").withColumn("n", F.coalesce("n", F.lit(0)))), 1)
    # rows equal in id, size and text are alike, so both scans place them alike
    blocks = contents(spread(docs.select(*own, F.array_join(space_words(text), " ").alias("all"))), block_words)
    homes = per_chunk.where("blocks > 0").select("rank", "chunk", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("number"), "first")
    drawn = draws(sources, seed, parts=parts_for(docs.select(text_col), 8 << 20)).withColumnRenamed("block", "number")
    # slots unfold from a few rows, so Spark would take the draws for small and broadcast them
    wanted = homes.join(drawn.hint("merge"), ["rank", "number"]).select("rank", "chunk", (F.col("number") - F.col("first")).alias("block"), "shard", "slot")
    # blocks lie by chunk already: draws may follow them, so texts are not dealt out again
    held = spark.conf.get(_ALL_KEYS, "true")
    spark.conf.set(_ALL_KEYS, "false")
    try:
        made = cut(blocks.join(wanted.hint("merge"), ["rank", "chunk", "block"]).select("rank", "chunk", "block", "shard", "slot", "pieces"))
    finally:
        spark.conf.set(_ALL_KEYS, held)
    got = made.select("rank", "chunk", F.explode("pieces").alias("x")).groupBy("rank", "chunk", "x.row").agg(F.sum("x.words").alias("got"))
    taken = placed.join(got.hint("merge"), ["rank", "chunk", "row"], "left").withColumn("taken", F.coalesce("got", F.lit(0)).cast("long"))
    return made, taken.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken")
