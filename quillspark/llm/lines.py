"""Operator 2 [native]: fuzzy line dedup.

Lines (cut at line feeds) are normalised: lower-cased, each run of ASCII
characters other than letters and digits becomes one space, trimmed. Equal
normal forms collapse by a 128-bit key.

A form's features are its pairs of neighbouring words, with an edge at either
end. Features are dealt to PARTS = 12 parts by their hash, and each part is hashed
by itself. An edit touches the parts of the few features that it changes and
leaves the others as they are, so by the pigeonhole principle two forms with
fewer changed features than parts agree in a block:

* a block of a form of LONG words or more is one part;
* a block of a form of up to SHORT words is two of the six pairs of parts.

A block must hold CHARS bytes or more (all of the form, if it has fewer) and
one in SHARE of the form's, so that a few common words are no block. A SimHash in the plain sense, bits by the
majority of all features of a line, cut into blocks of bits, misses nine of ten
lines of edit similarity 0.8 at three bits, as each feature moves every bit. Here
each block has features of its own, and all but the touched ones stay equal.

Forms that agree in a block are candidates, verified by edit similarity of the
normal forms (LEAST = 0.8 or more, by characters, whatever their length).
Verified links make components, and of each component the first occurrence (by
id, then line) stays.

In a bucket (the forms of one block) all are compared with the form that occurs
most often; then only forms outside of the bucket's largest component with those
of other components, so a crowd of near copies costs rows in proportion to it.
Forms of a crowd that are not similar to each other share no block unless they
share runs of words.

Texts are dealt out once by document, so that words unfold and are summed up in
place; the search itself shuffles keys only. Texts of candidates and the lines to
remove come back to one more scan, broadcast if their counted places are few, by
a shuffle join beyond that.

Defined cases: a null text has no lines and stays null; lines without letters or
digits always stay; rows equal in id and text are one document; a null id sorts
first; of ties (equal ids) the smaller text hash is first; an empty table gives
no rows; a text or line of any length is treated alike; further columns stay,
whatever their names.
"""
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.session import cut, drop_cut, free_shuffles, parts_for

LEAST = 0.8
#: Parts of a form's features; words from which one part is a block, and up to which two pairs of parts are.
PARTS, LONG, SHORT = 12, 16, 20
#: Bytes that a block's features have at least (all of the form, if it has fewer), and their least share: one in SHARE.
CHARS, SHARE = 14, 30
#: Bits of a feature's hash: sums of 2 ** 27 of them fit into a long, more than a string of 2 GB has.
HASH_BITS = 36
#: Characters of the pieces whose distances bound that of two forms.
PIECE = 64
#: Line places that a broadcast may have.
FEW = 1_000_000


#: What separates words: ASCII characters other than letters and digits.
SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def line_words(line: Column) -> Column:
    """The words of a line's normal form; one empty word if it has none."""
    return F.split(F.btrim(F.lower(line), F.lit(SEPARATORS)), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def normal(line: Column) -> Column:
    return F.array_join(line_words(line), " ")


def _parts(forms: DataFrame, keys: list[str], n_words: str) -> DataFrame:
    """keys, p0.. and c0.. of rows (keys, words) dealt by some of the keys: for each part the sum of its features' hashes, and for each two parts their bytes.

    Features unfold and are summed where they are.
    """
    edge = F.array(F.lit(""))
    both = forms.select(*keys, F.concat(edge, "words").alias("a"), F.concat("words", edge).alias("b"))
    # an outer explode, as a plain one makes Spark cut the texts once more for a filter
    pairs = both.select(*keys, F.explode_outer(F.arrays_zip("a", "b")).alias("x")).where("x is not null and (x.a <> '' or x.b <> '')")
    hashed = pairs.select(*keys, F.xxhash64("x.a", "x.b").alias("h"), (F.octet_length("x.a") + F.octet_length("x.b")).alias("chars"))
    dealt = hashed.select(*keys, F.pmod(F.shiftrightunsigned("h", 44), F.lit(PARTS)).cast("int").alias("part"), F.col("h").bitwiseAND(F.lit((1 << HASH_BITS) - 1)).alias("h"), "chars")
    none = F.lit(0).cast("long")
    mine = [F.sum(F.when(F.col("part") == p, F.col("h")).otherwise(none)).alias(f"p{p}") for p in range(PARTS)]
    # a long sums the bytes of two parts, 32 bits apart
    wide = F.when(F.col("part") % 2 == 0, F.col("chars").cast("long")).otherwise(F.shiftleft(F.col("chars").cast("long"), 32))
    both = [F.sum(F.when(F.shiftright("part", 1) == c, F.col("wide")).otherwise(none)).alias(f"c{c}") for c in range(PARTS // 2)]
    summed = dealt.select("*", wide.alias("wide")).groupBy(*keys).agg(*mine, *both, F.count("*").alias("n"))
    # rows equal in id and text are one document, so each sum is as many times too large
    copies = f"(n div ({n_words} + 1))"
    return summed.select(*keys, *[F.expr(f"{c} div {copies}").alias(c) for c in summed.columns if c not in keys and c != "n"])


def _block_keys(parts: DataFrame, keys: list[str], n_words: str) -> DataFrame:
    """keys and the keys of the blocks of each form, of the columns of its parts."""
    part = [F.col(f"p{p}") for p in range(PARTS)]
    chars = [F.shiftrightunsigned(f"c{p // 2}", 32 * (p % 2)).bitwiseAND(F.lit((1 << 32) - 1)) for p in range(PARTS)]
    known = parts.select(*keys, n_words, *part, *[c.alias(f"n{p}") for p, c in enumerate(chars)], sum(chars, F.lit(0).cast("long")).alias("all"))
    known = known.withColumn("least", F.greatest(F.least(F.lit(CHARS), "all"), F.ceil(F.col("all") / SHARE)))
    n = [F.col(f"n{p}") for p in range(PARTS)]
    one = [F.when(n[p] >= F.col("least"), F.xxhash64(F.lit(p), part[p], n[p])) for p in range(PARTS)]
    two = []
    for i, j in combinations(range(0, PARTS, 2), 2):
        four = (i, i + 1, j, j + 1)
        two.append(F.when(sum((n[p] for p in four), F.lit(0)) >= F.col("least"), F.xxhash64(F.lit(i), F.lit(j), *[c for p in four for c in (part[p], n[p])])))
    words = F.col(n_words)
    return known.select(*keys, F.array_compact(F.when(words < LONG, F.array(*two)).when(words > SHORT, F.array(*one)).otherwise(F.array(*two, *one))).alias("keys"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = F.col(text_col).cast("string")
    return [F.col(id_col).alias("id"), F.xxhash64(text, F.col(id_col).isNull()).alias("th"), text.alias("text")]


def occurrences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2 (key of the normal form), id, th (hash of the text), line (from 0), keys (of its blocks) of each line with letters or digits."""
    dealt = docs.select(*_keyed(docs, id_col, text_col)).repartition(parts_for(docs, 4 << 20), "id", "th")
    lines = dealt.select("id", "th", F.posexplode_outer(F.split("text", "\n")).alias("line", "raw")).where("raw is not null")
    forms = lines.select("id", "th", "line", line_words(F.col("raw")).alias("words"))
    keys = ["id", "th", "line", "k1", "k2", "words_n"]
    keyed = forms.select("id", "th", "line", F.xxhash64("words").alias("k1"), F.xxhash64(F.lit("second"), "words").alias("k2"), F.size("words").alias("words_n"), "words")
    return _block_keys(_parts(keyed, keys, "words_n"), ["k1", "k2", "id", "th", "line"], "words_n")


def buckets(forms: DataFrame, parts: int) -> DataFrame:
    """key, form, pivot (the bucket's form that occurs most often) of blocks that two forms or more share. Rows are dealt by key once, for the pivots and the join."""
    dealt = forms.select(F.explode("keys").alias("key"), F.col("k1").alias("form"), F.least("n", F.lit(1 << 20)).cast("int").alias("n")).repartition(parts, "key")
    order = F.shiftleft(F.col("n").cast("long"), 40).bitwiseOR(F.col("form").bitwiseAND(F.lit((1 << 40) - 1)))
    shared = dealt.groupBy("key").agg(F.max_by("form", order).alias("pivot"), F.count("*").alias("all")).where("all > 1")
    return dealt.select("key", "form").join(shared.select("key", "pivot").hint("shuffle_hash"), "key")


def similar(a: str, b: str, least: float = LEAST, likely: bool = True) -> Column:
    """Whether the edit similarity 1 - distance / longer length of two columns of normal forms is at least `least`.

    Spark's levenshtein walks along the whole of one form for each character of
    the other, however narrow its band is. So it gets what is left without the
    words that both forms begin and end with (each word with the space after it;
    the distance is the same), and only what two bounds leave open: the distances
    of pieces cut at equal places add up to no less than that of the whole, and
    the first halves of two texts are apart by no more than the whole and the
    difference in length. That pays where most pairs are similar; with likely off
    the distance of the whole forms is computed at once, with the same verdict.
    """
    long = f"greatest(char_length({a}), char_length({b}))"
    most = f"cast(floor((1 - {least}) * {long} + 1e-9) as int)"
    # replacing words place by place is one way to edit, so it bounds the distance from above
    word = "if(x <=> y, 0, greatest(coalesce(char_length(x), 0), coalesce(char_length(y), 0)) + if(x is null or y is null, 1, 0))"
    placed = f"aggregate(zip_with(split({a}, ' '), split({b}, ' '), (x, y) -> {word}), 0, (n, k) -> n + k) <= {most}"
    sized = f"abs(char_length({a}) - char_length({b})) <= {most}"
    if not likely:
        return F.expr(f"{sized} and ({placed} or levenshtein({a}, {b}, least({most}, 16)) >= 0 or ({most} > 16 and levenshtein({a}, {b}, {most}) >= 0))")
    # an array of one struct and a lambda name a value that is computed once
    same = lambda x, y: f"array_position(zip_with({x}, {y}, (p, q) -> p <=> q), false) - 1"
    words = f"array(struct(split({a}, ' ') as x, split({b}, ' ') as y, {most} as k))"
    fewer = "least(size(w.x), size(w.y))"
    ends = f"transform({words}, w -> struct(w.x as x, w.y as y, w.k as k, cast({same('w.x', 'w.y')} as int) as i, cast(least({same('reverse(w.x)', 'reverse(w.y)')}, {fewer} - ({same('w.x', 'w.y')})) as int) as j))"
    left = lambda x: f"array_join(transform(slice({x}, v.i + 1, size({x}) - v.i - v.j), p -> concat(p, ' ')), '')"
    cores = f"transform({ends}, v -> struct({left('v.x')} as x, {left('v.y')} as y, v.k as k))"
    more, fewer = "greatest(char_length(c.x), char_length(c.y))", "least(char_length(c.x), char_length(c.y))"
    piece = lambda x: f"substring({x}, i * {PIECE} + 1, {PIECE})"
    pieces = f"aggregate(sequence(0, {more} div {PIECE}), 0, (n, i) -> n + levenshtein({piece('c.x')}, {piece('c.y')})) <= c.k"
    half = f"cast({fewer} div 2 as int)"
    reach = f"c.k + {more} - {fewer}"
    halves = f"({half} <= {reach} or levenshtein(left(c.x, {half}), left(c.y, {half}), {reach}) >= 0)"
    near = lambda band: f"levenshtein(c.x, c.y, {band}) >= 0"
    full = f"({near('least(c.k, 16)')} or (c.k > 16 and {near('c.k')}))"
    core = f"{more} <= c.k or ({more} > {2 * PIECE} and {pieces}) or ({halves} and {full})"
    return F.expr(f"{a} <=> {b} or ({sized} and ({placed} or exists({cores}, c -> {core})))")


def _join_few(big: DataFrame, small: DataFrame, places: str, how: str) -> DataFrame:
    """big joined by `key` with a written table, which is broadcast if the lengths of its arrays `places` are few in all."""
    n = small.agg(F.coalesce(F.sum(F.size(places) + 1), F.lit(0))).first()[0]
    return big.join(F.broadcast(small) if n <= FEW else small, ["key"], how)


def _texts(docs: DataFrame, forms: DataFrame, shared: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """k, form of all forms that share a block."""
    wanted = shared.select(F.col("form").alias("k1")).distinct()
    found = forms.join(wanted, "k1", "left_semi")
    places = cut(found.groupBy(F.struct("at.id", "at.th").alias("key")).agg(F.collect_list(F.struct(F.col("at.line").alias("line"), F.col("k1").alias("k"))).alias("want")))
    src = docs.select(*_keyed(docs, id_col, text_col)).select(F.struct("id", "th").alias("key"), "text")
    got = _join_few(src, places, "want", "inner").select(F.split("text", "\n").alias("ls"), F.explode("want").alias("w"))
    # rows equal in id and text give the same lines: any one of them will do
    out = cut(got.select(F.col("w.k").alias("k"), normal(F.get("ls", F.col("w.line"))).alias("form")).dropDuplicates(["k"]))
    drop_cut(places)
    return out


def _sizes_near(a: str, b: str, least: float) -> Column:
    """Whether lengths of two forms leave room for an edit similarity of `least`; lossless, as each character more is an edit."""
    return F.expr(f"abs({a} - {b}) <= cast(floor((1 - {least}) * greatest({a}, {b}) + 1e-9) as int)")


def mixed_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, form, size, comp, main (the bucket's largest component) of members (key, form, size) of buckets with several components."""
    placed = members.join(roots.select(F.col("node").alias("form"), "root"), "form", "left").select("key", "form", "size", F.coalesce("root", "form").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("comp", "n").alias("main"), F.count("*").alias("comps")).where("comps > 1")
    return placed.join(sizes.select("key", "main"), "key")


def beside(mixed: DataFrame, least: float = LEAST) -> DataFrame:
    """a, b: each member of a mixed bucket with those before it by length: the nearest, and the nearest of the largest component or (for its members) outside of it.

    Two pairs for each member at most, whatever the bucket's size.
    """
    w = Window.partitionBy("key").orderBy("size", "form").rowsBetween(Window.unboundedPreceding, -1)
    me = F.struct("form", "size", "comp")
    inner, outer = (F.last(F.when(c, me), ignorenulls=True).over(w) for c in (F.col("comp") == F.col("main"), F.col("comp") != F.col("main")))
    near = mixed.select("form", "size", "comp", "main", inner.alias("inner"), outer.alias("outer"))
    ends = F.when(F.col("comp") == F.col("main"), F.array("outer")).otherwise(F.array("inner", "outer"))
    pairs = near.select("form", "size", "comp", F.explode(ends).alias("x")).where("x is not null and comp <> x.comp")
    return pairs.where(_sizes_near("size", "x.size", least)).select(F.col("x.form").alias("a"), F.col("form").alias("b"))


def apart(mixed: DataFrame, least: float = LEAST) -> DataFrame:
    """a, b: all members of mixed buckets that are in different components and near enough in length, each pair once."""
    out = mixed.where("comp <> main").select("key", F.col("form").alias("o"), F.col("comp").alias("oc"), F.col("size").alias("os"))
    once = (F.col("comp") != F.col("oc")) & ((F.col("comp") == F.col("main")) | (F.col("o") < F.col("form")))
    return out.join(mixed, "key").where(once & _sizes_near("os", "size", least)).select(F.col("o").alias("a"), F.col("form").alias("b"))


def links(docs: DataFrame, forms: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(node, root) of forms (k1) that links join, as written tables. forms: k1, at, n, keys.

    First each bucket's members are compared with its pivot alone, and the links
    found make components. In buckets of several components members are then
    compared with those next to them by length (`beside`). Only what is in
    different components even then, and near enough in length, is compared in all
    pairs (`apart`).
    """
    parts = parts_for(docs, 8 << 20)
    shared = cut(buckets(forms, parts))
    free_shuffles(docs.sparkSession)
    texts = _texts(docs, forms, shared, id_col=id_col, text_col=text_col)

    def verified(pairs: DataFrame, likely: bool = True) -> DataFrame:
        # edit distances are dealt by b: a form is in few buckets, while one pivot may be that of many rows; the count keeps small rows from meeting in few tasks
        side = lambda k, x: texts.select(F.col("k").alias(k), F.col("form").alias(x))
        both = pairs.where("a <> b").distinct().join(side("a", "x"), "a").repartition(parts, "b").join(side("b", "y"), "b")
        return cut(both.where(similar("x", "y", least, likely)).select("a", "b"))

    found = verified(shared.select(F.col("pivot").alias("a"), F.col("form").alias("b")))
    member = cut(components(found))
    # the pivot was compared with all of its bucket; a bucket of two is done
    size = texts.select(F.col("k").alias("form"), F.char_length("form").alias("size"))
    root = member.select(F.col("node").alias("form"), "root")
    others = shared.where("form <> pivot").join(root, "form", "left").withColumn("comp", F.coalesce("root", "form"))
    open_ = others.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    members = cut(others.select("key", "form").join(open_, "key").join(size, "form").select("key", "form", "size"))
    done = [shared, texts, found, members]
    for pairs in (beside, apart):
        mixed = cut(mixed_buckets(members, member))
        more = verified(pairs(mixed, least), likely=False)
        done += [mixed, more, member]
        if not more.isEmpty():
            # a component's nodes and its root stand for all of its links
            member = cut(components(more.union(member.select("node", "root"))))
    for t in done:
        if t is not member:
            drop_cut(t)
    return member


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """key (id, th), gone: the lines (from 0) of each document that repeat an earlier line; documents without any are left out."""
    occ = cut(occurrences(docs, id_col=id_col, text_col=text_col))
    free_shuffles(docs.sparkSession)
    place = F.struct("id", "th", "line")
    forms = cut(occ.groupBy("k1", "k2").agg(F.min(place).alias("at"), F.count("*").alias("n"), F.first("keys").alias("keys")))
    free_shuffles(docs.sparkSession)
    # the forms have the blocks' keys now: places alone stay beside them, so keys lie on disk once while buckets are made
    keyed, occ = occ, cut(occ.select("k1", "k2", "id", "th", "line"))
    drop_cut(keyed)
    member = links(docs, forms, id_col=id_col, text_col=text_col, least=least)
    linked = forms.join(member.select(F.col("node").alias("k1"), "root"), "k1", "left").where("n > 1 or root is not null")
    linked = linked.select("k1", "k2", "at", F.coalesce("root", "k1").alias("r1"), F.when(F.col("root").isNull(), F.col("k2")).otherwise(0).alias("r2"))
    owner = linked.groupBy("r1", "r2").agg(F.min("at").alias("keep"))
    known = linked.join(owner, ["r1", "r2"]).select("k1", "k2", "keep")
    drop = occ.join(known, ["k1", "k2"]).where(place != F.col("keep")).select("id", "th", "line")
    out = cut(drop.groupBy(F.struct("id", "th").alias("key")).agg(F.sort_array(F.collect_set("line")).alias("gone")))
    for t in (occ, forms, member):
        drop_cut(t)
    return out


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, report: bool = False) -> DataFrame:
    """docs with repeated lines cut out of the text; report: with columns n_lines and n_removed at the end."""
    gone = repeats(docs, id_col=id_col, text_col=text_col, least=least)
    names = docs.schema.names
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    i, t = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    keyed = inner.withColumn("key", F.struct(F.col(i).alias("id"), F.xxhash64(F.col(t).cast("string"), F.col(i).isNull()).alias("th")))
    both = _join_few(keyed, gone, "gone", "left")
    both = both.withColumn("lines", F.split(F.col(t).cast("string"), "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(left, lambda n: F.get("lines", n)), "\n")
    out = [F.when(F.col("gone").isNull(), F.col(t)).otherwise(kept).alias(t) if c == t else F.col(c) for c in inner.columns]
    extra = [F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("_n"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("_g")] if report else []
    return both.select(*out, *extra).toDF(*names, *(["n_lines", "n_removed"] if report else []))
