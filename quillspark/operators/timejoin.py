"""Joins by time: the last row before another (as-of), rows within intervals, intervals that overlap.

None of them compares all rows of a key with all others: as-of joins are one
window over both sides, interval joins meet in bins. Where only counts and the
smallest partner of overlapping intervals are asked for, no pair is made at all.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key in one slice of time, on average over its busiest key.
SLICE_ROWS = 500_000
#: Least width of a bin, in microseconds.
LEAST_BIN = 1
#: Ends of intervals in a slice of time, on average, and slices at most.
SLICE_ENDS, MOST_SLICES = 200_000, 1_000
_FIRST, _LAST = -(1 << 63), (1 << 63) - 1


def micros(c: Column) -> Column:
    """A time as microseconds; numbers stay as they are."""
    return F.unix_micros(c.cast("timestamp"))


def _at(df: DataFrame, c: str) -> Column:
    return micros(F.col(c)) if df.schema[c].dataType.typeName().startswith("timestamp") else F.col(c).cast("long")


def _slice_width(left: DataFrame, slice_rows: int) -> int:
    """A width of time slices that leaves the busiest key about slice_rows in one: from one count by key. 0: no slices."""
    most = left.groupBy("key").agg(F.count("*").alias("n"), (F.max("at") - F.min("at")).alias("span")).orderBy(F.desc("n")).first()
    if most is None or most.n <= slice_rows or not most.span:
        return 0
    return max(1, -(-most.span // -(-most.n // slice_rows)))


def as_of(left: DataFrame, right: DataFrame, *, left_ts: str, right_ts: str, keys: list[str], within: int | None = None, strict: bool = False, order: list[str] | None = None, prefix: str = "right_", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """left with the columns of the last row of right of the same keys at or before it (strict: before it), under `prefix`; nulls where there is none.

    within: rows that lie more microseconds (or units, of numbers) back do not count.
    Of right rows at one time the greatest by `order` counts (all other columns if
    none is told). Both sides become one table that a window walks through in order of
    time; a busy key is cut into slices of time, each of which takes over what the
    slices before it ended with, so no task holds more than a slice of a key.
    Null keys are keys like others; rows without a time have no match and are none.
    """
    lnames, rnames = left.columns, right.columns
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("key")
    a = left.select(key, _at(left, left_ts).alias("at"), F.lit(0 if strict else 1).alias("side"), F.struct(*lnames).alias("l"), F.lit(None).alias("r"))
    rank = F.struct(*[F.col(c) for c in (order or [c for c in rnames if c not in keys and right.schema[c].dataType.typeName() not in ("map", "variant")])])
    b = right.select(key, _at(right, right_ts).alias("at"), F.struct(*rnames).alias("r"), rank.alias("o")).where(F.col("at").isNotNull())
    # one right row for each key and time
    b = b.groupBy("key", "at").agg(F.max_by("r", "o").alias("r"))
    b = b.select("key", "at", F.lit(1 if strict else 0).alias("side"), F.lit(None).cast(a.schema["l"].dataType).alias("l"), "r")
    both = a.where(F.col("at").isNotNull()).select("key", "at", "side", "l", F.lit(None).cast(b.schema["r"].dataType).alias("r")).unionByName(b)
    width = _slice_width(both.select("key", "at"), slice_rows)
    cut = F.floor(F.col("at") / width) if width else F.lit(0).cast("long")
    sliced = both.withColumn("slice", cut).withColumn("seen", F.when(F.col("r").isNotNull(), F.struct("at", "r")))
    upto = Window.partitionBy("key", "slice").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    walked = sliced.withColumn("last", F.last("seen", ignorenulls=True).over(upto)).where(F.col("l").isNotNull())
    if width:
        ends = sliced.where(F.col("seen").isNotNull()).groupBy("key", "slice").agg(F.max_by("seen", "at").alias("end"))
        # a row for each slice of a key
        before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        starts = sliced.select("key", "slice").distinct().join(ends, ["key", "slice"], "left").withColumn("start", F.last("end", ignorenulls=True).over(before)).select("key", "slice", "start")
        walked = walked.join(starts, ["key", "slice"]).withColumn("last", F.coalesce("last", "start"))
    good = F.col("at") - F.col("last.at") <= within if within is not None else F.lit(True)
    found = walked.select("l", F.when(good, F.col("last.r")).alias("r"))
    missed = a.where(F.col("at").isNull()).select("l", F.lit(None).cast(b.schema["r"].dataType).alias("r"))
    return found.unionByName(missed).select(*[F.col("l")[c].alias(c) for c in lnames], *[F.col("r")[c].alias(f"{prefix}{c}") for c in rnames if c not in keys])


def _levels(length: Column, base: int) -> Column:
    """The level of an interval: bins of level n are base * 2**n wide, and the interval is no longer than one."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1)) / base))).cast("int")


def within(points: DataFrame, intervals: DataFrame, *, at: str, start: str, end: str, keys: list[str] | None = None, closed: bool = False, open_start: bool = False, prefix: str = "interval_", base: int | None = None) -> DataFrame:
    """Each point with each interval that holds it (start <= at < end; closed: at <= end; open_start: start < at), the interval's columns under `prefix`.

    Intervals lie in bins as wide as themselves, by powers of two, so each is in two
    bins at most, however long; a point asks one bin of each level that occurs (some
    forty at most). Rows meet by keys and bin in an equi-join that adaptive execution
    splits where a bin is crowded. Null times and intervals that end before they
    start match nothing; null keys match nothing.
    """
    keys = keys or []
    pnames, inames = points.columns, intervals.columns
    iv = intervals.select(F.struct(*inames).alias("i"), *[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)], _at(intervals, start).alias("a"), _at(intervals, end).alias("z")).where("a <= z")
    if base is None:
        # the least power of two that a good part of the intervals fit in
        typical = iv.agg(F.percentile_approx(F.col("z") - F.col("a"), 0.25)).first()[0]
        base = max(LEAST_BIN, int(typical or 1))
    level = _levels(F.col("z") - F.col("a") + 1, base)
    leveled = iv.withColumn("level", level).withColumn("w", (F.lit(base) * F.pow(F.lit(2.0), "level")).cast("long"))
    binned = leveled.withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / F.col("w")), F.floor(F.col("z") / F.col("w")))))
    used = [r[0] for r in leveled.select("level").distinct().collect()]
    asks = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.floor(F.col("t") / (base * 2**n)).alias("bin")) for n in sorted(used)]) if used else F.array().cast("array<struct<level:int,bin:bigint>>"))
    pt = points.select(F.struct(*pnames).alias("p"), *[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)], _at(points, at).alias("t")).where("t is not null").withColumn("ask", asks)
    pt = pt.select("*", "ask.level", "ask.bin").drop("ask")
    both = pt.join(binned, [*[f"k{n}" for n in range(len(keys))], "level", "bin"])
    inside = (F.col("a") < F.col("t") if open_start else F.col("a") <= F.col("t")) & (F.col("t") <= F.col("z") if closed else F.col("t") < F.col("z"))
    return both.where(inside).select(*[F.col("p")[c].alias(c) for c in pnames], *[F.col("i")[c].alias(f"{prefix}{c}") for c in inames if c not in keys])


def overlapping(left: DataFrame, right: DataFrame, *, start: str, end: str, keys: list[str] | None = None, prefix: str = "right_") -> DataFrame:
    """Pairs of intervals [start, end) that share a moment, each once: those of right that begin within one of left, and those of left that begin later, within one of right."""
    keys = keys or []
    nonempty = lambda df: df.where(_at(df, start) < _at(df, end))
    left, right = nonempty(left), nonempty(right)
    names = [*left.columns, *[f"{prefix}{c}" for c in right.columns if c not in keys]]
    inner = within(right.toDF(*[c if c in keys else f"{prefix}{c}" for c in right.columns]), left, at=f"{prefix}{start}", start=start, end=end, keys=keys, prefix="")
    outer = within(left, right, at=start, start=start, end=end, keys=keys, open_start=True, prefix=prefix)
    return inner.select(*names).unionByName(outer.select(*names))


def overlap_summary(spans: DataFrame, *, start: str, end: str, id_: str, slice_ends: int = SLICE_ENDS) -> DataFrame:
    """id, n_overlaps and first_other of each id with intervals [start, end) that share a moment with an interval of another id.

    n_overlaps counts the pairs of rows that overlapping() gives, first_other is the
    smallest other id; ids are whole numbers. No pair is made. Overlapping intervals
    are those that begin before the end, but for those that end by the start. The
    smallest other id comes from the starts within an interval and from the intervals
    that hold its start: time is cut into slices of about slice_ends ends, and a
    slice's task gets the distinct pieces of intervals that begin or end in it; whole
    slices within intervals are told by the slices that these begin and end in.
    Null ids and times and empty intervals overlap nothing.
    """
    s = spans.select(F.col(id_).cast("long").alias("id"), _at(spans, start).alias("a"), _at(spans, end).alias("z")).where("id is not null and a < z")
    n = s.count()
    parts = max(1, min(MOST_SLICES, -(-2 * n // slice_ends)))
    ends = s.select(F.explode(F.array("a", "z")).alias("t"))
    fences = np.unique(np.array(ends.agg(F.percentile_approx("t", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if n and parts > 1 else [], np.int64))

    @F.arrow_udf("int")
    def slice_of(t: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(fences, t.to_numpy(zero_copy_only=False), "right").astype(np.int32))

    counts = _overlap_counts(s, slice_of)
    # intervals of one id that meet become one, so that none overlaps another of its id
    before = Window.partitionBy("id").orderBy("a", "z")
    new = F.coalesce(F.col("a") > F.max("z").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    isles = s.withColumn("isle", new.cast("int")).withColumn("isle", F.sum("isle").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    isles = isles.groupBy("id", "isle").agg(F.min("a").alias("a"), F.max("z").alias("z"))
    placed = isles.select("id", "a", "z", slice_of("a").alias("i"), slice_of(F.col("z") - 1).alias("j"))
    one = F.array(F.struct(F.col("i").alias("slice"), F.col("a").alias("lo"), F.col("z").alias("hi")))
    two = F.array(F.struct(F.col("i").alias("slice"), F.col("a").alias("lo"), F.lit(_LAST).alias("hi")), F.struct(F.col("j").alias("slice"), F.lit(_FIRST).alias("lo"), F.col("z").alias("hi")))
    pieces = placed.select("id", F.inline(F.when(F.col("i") == F.col("j"), one).otherwise(two)))
    told = pieces.groupBy("slice", "lo", "hi").agg(F.min("id").alias("id")).groupBy("slice").applyInArrow(_least_partners, "slice int, lo long, hi long, best long")
    within_slices = pieces.join(told, ["slice", "lo", "hi"]).select("id", "best")
    # of those that begin at one moment the smallest and the next
    least = isles.groupBy("a").agg(F.min("id").alias("m"))
    next_ = isles.join(least, "a").where("id <> m").groupBy("a").agg(F.min("id").alias("m2"))
    peers = isles.join(least.join(next_, "a"), "a").select("id", F.when(F.col("id") == F.col("m"), F.col("m2")).otherwise(F.col("m")).alias("best"))
    # whole slices: a row for each two slices that intervals begin and end in
    spanned = placed.where("j - i > 1").groupBy("i", "j").agg(F.min("id").alias("id"))
    each = spanned.select("i", "j", "id", F.explode(F.sequence(F.col("i") + 1, F.col("j") - 1)).alias("slice"))
    covers = each.groupBy("slice").agg(F.min("id").alias("best"))
    covered = placed.join(F.broadcast(covers.withColumnRenamed("slice", "i")), "i").select("id", "best")
    begun = placed.groupBy(F.col("i").alias("slice")).agg(F.min("id").alias("best"))
    between = each.join(F.broadcast(begun), "slice").groupBy("i", "j").agg(F.min("best").alias("best"))
    inside = placed.join(between, ["i", "j"]).select("id", "best")
    bests = within_slices.unionByName(peers).unionByName(covered).unionByName(inside)
    both = counts.select("id", "n", F.lit(None).cast("long").alias("best")).unionByName(bests.select("id", F.lit(0).cast("long").alias("n"), "best"))
    found = both.groupBy("id").agg(F.sum("n").alias("n_overlaps"), F.min("best").alias("first_other")).where("n_overlaps > 0")
    return found.select(F.col("id").alias(id_), "n_overlaps", "first_other")


def _overlap_counts(s: DataFrame, slice_of) -> DataFrame:
    """id, n: parts of the number of pairs of overlapping rows of the id with rows of others."""
    moments = s.select("id", F.inline(F.array(F.struct(F.col("a").alias("t"), F.lit(1).alias("b")), F.struct(F.col("z").alias("t"), F.lit(0).alias("b")))))

    def run(rows: DataFrame, key: list[str]) -> DataFrame:
        """Starts before each moment and ends up to it, among those of its key."""
        at = rows.groupBy(*key, "t").agg(F.sum("b").alias("begun"), F.sum(1 - F.col("b")).alias("ended"))
        w = Window.partitionBy(*key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        return at.select(*key, "t", (F.sum("begun").over(w) - F.col("begun")).alias("begun"), F.sum("ended").over(w).alias("ended"))

    count = F.when(F.col("b") == 1, -F.col("ended")).otherwise(F.col("begun"))
    sliced = moments.withColumn("slice", slice_of("t"))
    # a row for each slice
    upto = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy("slice").agg(F.sum("b").alias("sb"), F.sum(1 - F.col("b")).alias("se"))
    sums = sums.select("slice", F.coalesce(F.sum("sb").over(upto), F.lit(0)).alias("sb"), F.coalesce(F.sum("se").over(upto), F.lit(0)).alias("se"))
    ranked = run(sliced, ["slice"]).join(F.broadcast(sums), "slice").select("t", (F.col("begun") + F.col("sb")).alias("begun"), (F.col("ended") + F.col("se")).alias("ended"))
    all_ = moments.join(ranked, "t").select("id", count.alias("n"))
    # each row overlaps itself and others of its id
    many = moments.join(s.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "id")
    own = many.join(run(many, ["id"]), ["id", "t"]).select("id", (-count).alias("n"))
    single = s.groupBy("id").agg(F.count("*").alias("rows")).where("rows = 1").select("id", F.lit(-1).cast("long").alias("n"))
    return all_.unionByName(own).unionByName(single)


def _least_partners(table: pa.Table) -> pa.Table:
    """For pieces (lo, hi, smallest id) of a slice the smallest id among the starts within each and the pieces that hold its start.

    A piece without a start of its own holds the slice's first moment; one with a
    start holds the moments after it.
    """
    lo, hi, least = (table.column(c).to_numpy() for c in ("lo", "hi", "id"))
    own = lo != _FIRST
    at, place = np.unique(lo[own], return_inverse=True)
    first = np.full(len(at), _LAST)
    np.minimum.at(first, place, least[own])
    left, right = np.searchsorted(at, lo, "right"), np.searchsorted(at, hi, "left")
    some = np.flatnonzero(left < right)
    level = np.zeros(len(lo), np.int64)
    level[some] = np.frexp((right - left)[some])[1] - 1
    best = np.full(len(lo), _LAST)
    # starts by runs of 2 ** n: two runs make up a piece
    over, tops = first, []
    for n in range(int(level.max(initial=0)) + 1):
        if n:
            over = np.minimum(over[: -(1 << (n - 1))], over[1 << (n - 1) :])
        mine = some[level[some] == n]
        a, b = left[mine], right[mine] - (1 << n)
        best[mine] = np.minimum(over[a], over[b]) if len(mine) else best[mine]
        top = np.full(len(over), _LAST)
        np.minimum.at(top, a, least[mine])
        np.minimum.at(top, b, least[mine])
        tops.append(top)
    # and pieces by the runs that they hold, handed down to their starts
    for n in range(len(tops) - 1, 0, -1):
        half = 1 << (n - 1)
        tops[n - 1][:-half] = np.minimum(tops[n - 1][:-half], tops[n])
        tops[n - 1][half:] = np.minimum(tops[n - 1][half:], tops[n])
    best[own] = np.minimum(best[own], tops[0][place])
    return pa.table({"slice": table.column("slice"), "lo": lo, "hi": hi, "best": pa.array(best, mask=best == _LAST)})
