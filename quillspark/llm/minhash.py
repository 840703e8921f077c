"""Operator 13: near-duplicates by bottom-k MinHash sketches and exact Jaccard similarity.

A document's set holds its distinct shingles of `width` lower-cased words
`[^\\x20\\x09-\\x0D]+`, each told by one 64-bit hash. Its sketch keeps the k
smallest hashes, in order. Equal sets collapse into one class first.

Inverted lists: the entries are runs of neighbours in the sketch. Differences of
two sets cut the order of their union into runs that both share; where the
similarity is t or more there are few cuts, so that some run has the length that
`run_lengths` proves, by the pigeonhole principle. A class is thus listed under
each of its runs of so many hashes (three; two for sets of four or five shingles
at t = 0.8). For whole sets that loses no pair. For sets that are larger than the
sketch the hashes choose the order at random, and a pair at exactly 0.8 is missed
with a chance below 1e-10 (k = 64; smaller still for more similar ones). A
list's key is several hashes, so unrelated texts that have common word pairs do
not meet. Similar sets share several runs (`least_runs`), so a class leaves as many
of its longest lists but one: passages that many texts hold make no candidates.
Among whole sets that loses nothing either; a pair at exactly 0.8 of larger ones is
lost with a chance below 1e-6.

Lists give pairs in turns, not all pairs of a group: each class with few of the
classes in its longest lists, twice; then, of members that are in different components even so,
those pairs whose sizes allow the similarity and whose bitmaps do (bits that
differ are elements that differ, so this loses nothing), compared tile by tile in
numpy: a pair that falls short becomes no row. A pair's sketches give the k smallest
hashes of the union; the share of these that both hold estimates the similarity,
and pairs that fall short of it by seven standard deviations go. Others are
decided on their full sets, which are made anew from the texts, once for each
class in a list.
Components come from the links by distributed contraction.

Defined cases: fewer words than a shingle are one shingle; a null, empty or blank
text has an empty set, is linked with nothing and is its own component; a null
doc_id keeps its row and takes part in links, but is never a component's smallest
id unless all its ids are null (its rows are kept then); repeated rows stay rows of
their own; ids may be of any type; texts of any length are taken whole; an empty
table gives no rows; further columns are passed over.
"""
import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.components import components
from quillspark.llm.session import cut, drop_cut
from quillspark.llm.texts import join_small
from quillspark.llm.textnum import Words, mixed, space_words, span_hash, text_slices, trimmed

WIDTH, PERCENT, K, RUN = 2, 80, 64, 3
#: Rows of (id) that are broadcast at most, some 20 MB; more are joined by a shuffle.
IDS = 500_000
#: Classes of a list that others meet in a turn, such turns, and the lists (its longest) in which a class meets them.
LEADERS, TURNS, MEETS = 4, 2, 4
#: Words of 64 bits in the bitmap of a set, by which classes are compared where a list's members meet one another.
WORDS = 32
#: Members of a list in a tile, on average, by which such lists are compared in full, and pairs in a step of that.
TILE, STEP = 4096, 100_000


def _sets(w: Words, width: int) -> tuple[np.ndarray, ...]:
    """For a slice's texts: the distinct hashes in order, where each text's begin, and two sums that tell sets apart."""
    counts = w.counts
    at = w.windows(width)
    row = w.row_of()[at]
    short = np.flatnonzero((counts > 0) & (counts < width))
    starts = np.concatenate((at, w.first[short]))
    ends = np.concatenate((at + width, w.first[short + 1]))
    row = np.concatenate((row, short))
    h = [span_hash(w.hashes(which, lower=True), starts, ends, which) for which in (0, 1)]
    key = h[0].view(np.int64)
    order = np.lexsort((key, row))
    key, row, other = key[order], row[order], h[1][order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row, other = key[new], row[new], other[new]
    first = np.searchsorted(row, np.arange(len(counts) + 1))
    sums = []
    for x in (key.view(np.uint64), other):
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(mixed(x), out=total[1:])
        sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return key, first, *sums


def _hashed(src: DataFrame, width: int, keep: int | None) -> DataFrame:
    """id, n (size of the set), d1, d2 (its digest), bits (its bitmap) and its smallest hashes in order, `keep` at most (None: all, without bitmaps)."""
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), *[T.StructField(c, T.LongType()) for c in ("n", "d1", "d2")], T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("hashes", T.ArrayType(T.LongType()))])

    def each(batches):
        table = space_words()
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch.column(1)):
                key, first, d1, d2 = _sets(Words(buf, offs, table), width)
                n = np.diff(first)
                bits = pa.nulls(len(n), pa.list_(pa.int64()))
                if keep is not None:
                    place = key.view(np.uint64) % np.uint64(64 * WORDS)
                    words = np.zeros(len(n) * WORDS, np.uint64)
                    np.bitwise_or.at(words, np.repeat(np.arange(len(n)) * WORDS, n) + (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
                    bits = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * WORDS, pa.int32()), pa.array(words.view(np.int64)))
                    key = key[np.arange(len(key)) - np.repeat(first[:-1], n) < keep]
                ends = np.concatenate(([0], np.cumsum(n if keep is None else np.minimum(n, keep))))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(d1), pa.array(d2), bits, lists], names=schema.names)

    return src.mapInArrow(trimmed(each), schema)


def guaranteed(u: int, percent: int) -> int:
    """Length of the longest shared run, at least, in the order of a union of u that holds percent of it in common; 0 if both sets must be equal."""
    common = -(-percent * u // 100)
    cuts = u - common
    return (common - 1) // (cuts + 1) + 1 if cuts else 0


def run_lengths(n: int, percent: int, run: int = RUN) -> list[int]:
    """The run lengths under which a set of n must be listed to meet each set that is as similar but not equal."""
    unions = range(n, n * 100 // percent + 1)
    return sorted({min(run, r) for r in (guaranteed(u, percent) for u in unions) if r})


def _keys(sketch: Column, n: Column, percent: int, run: int) -> Column:
    """Keys of the runs of a sketch. Beyond a few dozens of shingles all sets have the same run lengths."""
    lengths = [run_lengths(i, percent, run) for i in range(1, 201)]
    last = lengths[-1]
    settled = max([i for i, x in enumerate(lengths, 1) if x != last], default=0)

    none = F.array().cast("array<long>")

    def runs(r: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(sketch) - r + 1), lambda i: F.xxhash64(F.lit(r), F.slice(sketch, i, r)))
        return F.when(F.size(sketch) >= r, each).otherwise(none)

    def of(rs: list[int]) -> Column:
        return F.concat(*map(runs, rs)) if rs else none

    out = of(last)
    for rs in {tuple(x) for x in lengths[:settled] if x != last}:
        out = F.when(n.isin([i for i, x in enumerate(lengths[:settled], 1) if tuple(x) == rs]), of(list(rs))).otherwise(out)
    return F.array_distinct(out)


def least_runs(n: int, percent: int, k: int, run: int) -> int:
    """How many listed runs a set of n shares, at least, with each set that is as similar but not equal: for sure where the sketches are whole sets, else with a chance of 1 - 1e-6."""
    unions = [u for u in range(n, n * 100 // percent + 1) if guaranteed(u, percent)]
    if unions and unions[-1] > k:
        return max(1, _likely_runs(k, percent / 100, run, 1e-6))
    sure = [-(-percent * u // 100) - (min(run, guaranteed(u, percent)) - 1) * (u + percent * -u // 100 + 1) for u in unions]
    return max(1, min(sure, default=1))


def _likely_runs(n: int, p: float, run: int, chance: float, most: int = 64) -> int:
    """The greatest m so that n draws hold fewer than m runs of `run` successes at a chance below `chance`."""
    state = {(0, 0): 1.0}
    for _ in range(n):
        after: dict[tuple[int, int], float] = {}
        for (length, found), q in state.items():
            longer = min(length + 1, run)
            for to, share in (((0, found), 1 - p), ((longer, min(most, found + (longer == run))), p)):
                after[to] = after.get(to, 0.0) + q * share
        state = after
    below = 0.0
    for m in range(most):
        below += sum(q for (_, found), q in state.items() if found == m)
        if below > chance:
            return m
    return most


def _by_size(n: Column, of, last_at: int) -> Column:
    """of(n) as a column, for a function that is constant from last_at on."""
    values = [of(i) for i in range(1, last_at + 1)]
    out = F.lit(values[-1])
    for v in sorted(set(values[:-1]) - {values[-1]}):
        out = F.when(n.isin([i for i, x in enumerate(values, 1) if x == v]), v).otherwise(out)
    return out


def least_shared(k: int, percent: int) -> int:
    """The most hashes of k that a pair at the threshold shares with a chance of at least 1 - 1e-12."""
    p, tail, x = percent / 100, 0.0, 0
    while x < k and tail + math.comb(k, x) * p**x * (1 - p) ** (k - x) <= 1e-12:
        tail += math.comb(k, x) * p**x * (1 - p) ** (k - x)
        x += 1
    return x


def _similar(both: Column, size: Column, percent: int) -> Column:
    return 100 * both >= percent * (size - both)


def _tiles(rest: DataFrame, classes: DataFrame, tile: int) -> DataFrame:
    """key, p, q, part, cls, n, root, keys, bits: the members of lists by tiles, each of two parts of a list (p and q may be one), with all keys of a class and its bitmap."""
    sized = rest.select("key", "cls", "n", "root", F.ceil(F.count("*").over(Window.partitionBy("key")) / tile).cast("int").alias("parts"))
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("cls"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = dealt.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "cls", "n", "root")
    keys = rest.groupBy("cls").agg(F.collect_list("key").alias("keys"))
    return placed.join(keys.join(classes.select("cls", "bits"), "cls"), "cls").select("key", "p", "q", "part", "cls", "n", "root", "keys", "bits")


def _met(percent: int):
    """An Arrow map over the rows of whole tiles, in order: the pairs (a, b) of different components whose sizes and bitmaps allow the similarity.

    Each bit in which two bitmaps differ is an element that one set lacks, so this
    loses nothing. A pair is told in the first of the lists that it shares.
    """

    def pairs(t: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        key, part, cls, n, root = (t.column(c).to_numpy() for c in ("key", "part", "cls", "n", "root"))
        cross = (t.column("p").to_numpy() != t.column("q").to_numpy())
        bits = t.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
        lists = t.column("keys").combine_chunks()
        many = lists.value_lengths().to_numpy()
        keys = np.zeros((len(key), int(many.max(initial=0))), np.int64)
        held = np.arange(keys.shape[1]) < many[:, None]
        keys[held] = lists.flatten().to_numpy()
        ends = np.append(np.flatnonzero(new)[1:], len(key))[np.cumsum(new) - 1]
        after = ends - np.arange(len(key)) - 1
        upto = np.cumsum(after)
        found, lo = [], 0
        while lo < len(key):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + STEP, "right")))
            i = np.repeat(np.arange(lo, hi), after[lo:hi])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[lo:hi]) - after[lo:hi], after[lo:hi])
            lo = hi
            ok = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (~cross[i] | (part[i] != part[j]))
            i, j = i[ok], j[ok]
            differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            ok = (100 + percent) * differ <= (100 - percent) * (n[i] + n[j])
            i, j = i[ok], j[ok]
            for w in range(keys.shape[1]):
                before = held[i, w] & (keys[i, w] < key[i])
                before[before] = ((keys[j[before]] == keys[i[before], w][:, None]) & held[j[before]]).any(axis=1)
                i, j = i[~before], j[~before]
            found.append((np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])))
        at = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ()))]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in at], names=["a", "b"])

    def each(batches):
        rest = None
        for batch in chain(batches, (None,)):
            t = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if t is None or not len(t):
                continue
            new = np.ones(len(t), bool)
            new[1:] = np.any([np.diff(t.column(c).to_numpy()) != 0 for c in ("key", "p", "q")], axis=0)
            # the last tile may go on in the next batch
            whole = len(t) if batch is None else int(np.flatnonzero(new)[-1])
            rest = t.slice(whole)
            if whole:
                yield pairs(t.slice(0, whole), new[:whole])

    return each


def full_sets(listed: DataFrame, classes: DataFrame, src: DataFrame, *, width: int, k: int) -> DataFrame:
    """cls and whole set of the listed classes whose sketch is not the whole set, made anew from one text of each; written."""
    wanted = cut(listed.where(F.col("n") > k).select("cls").distinct().join(classes.select("cls", "d1", "d2", "least"), "cls"))
    ids = wanted.select(F.col("least").alias("id")).distinct()
    few = ids.count() <= IDS
    again = _hashed(src.alias("x").join((F.broadcast(ids) if few else ids).alias("y"), F.col("x.id").eqNullSafe(F.col("y.id")), "left_semi"), width, None)
    full = cut(again.select("d1", "d2", "hashes").join(wanted.select("cls", "d1", "d2"), ["d1", "d2"]).select("cls", "hashes").dropDuplicates(["cls"]))
    drop_cut(wanted)
    return full


def links(pairs: DataFrame, classes: DataFrame, full: DataFrame, *, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar: by their sketches where these are whole sets, else estimated by them and decided on full sets; written."""
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("hashes").alias(f"h_{c}"))
    both = F.array_intersect("h_a", "h_b")
    least = F.slice(F.array_sort(F.array_union("h_a", "h_b")), 1, k)
    whole = (F.col("n_a") <= k) & (F.col("n_b") <= k)
    estimate = F.size(F.array_intersect(least, both)) * k >= F.size(least) * least_shared(k, percent)
    near = cut(pairs.join(side("a"), "a").join(side("b"), "b").where(F.when(whole, _similar(F.size(both), F.col("n_a") + F.col("n_b"), percent)).otherwise(estimate)).select("a", "b", "n_a", "n_b", whole.alias("whole")))
    # a class of k shingles or fewer may stand against a larger one
    mixed_pairs = near.where(~F.col("whole") & (F.least("n_a", "n_b") <= k))
    small = mixed_pairs.select(F.when(F.col("n_a") <= k, F.col("a")).otherwise(F.col("b")).alias("cls")).distinct()
    sets = full.union(classes.join(small, "cls", "left_semi").select("cls", "hashes"))
    of = lambda c: sets.select(F.col("cls").alias(c), F.col("hashes").alias(f"h_{c}"))
    sure = near.where(~F.col("whole")).join(of("b"), "b").join(of("a"), "a").where(_similar(F.size(both), F.col("n_a") + F.col("n_b"), percent))
    out = cut(near.where("whole").select("a", "b").union(sure.select("a", "b")))
    drop_cut(near)
    return out


def similar_classes(classes: DataFrame, src: DataFrame, *, width: int, percent: int, k: int, run: int, tile: int = TILE) -> DataFrame:
    """(node, root) of the classes with links."""
    entries = classes.select("cls", "n", F.explode(_keys(F.col("hashes"), F.col("n"), percent, run)).alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    # a class leaves its longest lists, so many that each similar class still meets it in another: the prefix filter
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("m"), "key"))
    left = rank - _by_size(F.col("n"), lambda i: least_runs(i, percent, k, run), k + 1) + 1
    some = cut(entries.join(sizes, "key").select("key", "cls", "n", left.alias("r")).where("r > 0"))
    listed = cut(some.join(some.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "key"))
    drop_cut(some)
    full = full_sets(listed, classes, src, width=width, k=k)
    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    rest = listed.withColumn("root", F.col("cls"))
    edges, made, held, member = None, [], [], None
    for turn in range(TURNS + 1):
        if turn < TURNS:
            # few of a list's classes, the same ones in as many lists as can be
            first = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("cls", F.lit(turn)), "cls"))
            x = rest.where(F.col("r") <= MEETS).alias("x")
            y = rest.withColumn("lead", first).where(F.col("lead") <= LEADERS).alias("y")
            apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & fits(F.col("x.n"), F.col("y.n"))
            pairs = x.join(y, apart).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
        else:
            # all that is left: sizes and bitmaps decide before a pair becomes a row
            pairs = _tiles(rest, classes, tile).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_met(percent), "a long, b long")
        new = links(pairs, classes, full, percent=percent, k=k)
        made.append(new)
        edges = new if edges is None else edges.union(new)
        if member is not None:
            drop_cut(member)
        member = cut(components(edges))
        if turn < TURNS:
            # lists whose classes are in different components still
            now = (listed if turn == 0 else rest).select("key", "cls", "n", "r").join(member.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "n", "r", F.coalesce("root", "cls").alias("root"))
            split = now.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
            rest = cut(now.join(split, "key"))
            held.append(rest)
    for df in (listed, full, *made, *held):
        drop_cut(df)
    return member


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, k: int = K, run: int = RUN, tile: int = TILE) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable) and kept (whether that is the row's own) of each row."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(_hashed(src, width, k))
    by_set = rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("least"), F.first("hashes").alias("hashes"), F.first("bits").alias("bits"))
    classes = cut(by_set.withColumn("cls", F.monotonically_increasing_id()))
    member = similar_classes(classes, src, width=width, percent=percent, k=k, run=run, tile=tile)
    named = classes.select("cls", "n", "d1", "d2", "least").join(member.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = named.join(smallest, "root").select("n", "d1", "d2", "component_id")
    full = rows.select("id", "n", "d1", "d2").where("n > 0").join(by_class, ["n", "d1", "d2"]).select("id", "n", "component_id")
    out = full.union(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
