import random
import re
import time
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import lines
from quillspark.llm.lines import CHARS, LEAST, LONG, PARTS, SHARE, SHORT, dedup_lines


def form(line):
    return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", line.lower()).strip(" ")


def chained(*values):
    """Spark's xxhash64 of strings and longs."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little"), h)
    return h


def blocks(f):
    """Blocks by their features, in place of hashes of them."""
    w, out = f.split(" "), set()
    got, chars = [[] for _ in range(PARTS)], [0] * PARTS
    for a, b in zip(["", *w], [*w, ""]):
        p = (chained(a, b) >> 44) % PARTS
        got[p].append((a, b))
        chars[p] += len(a.encode()) + len(b.encode())
    least = max(min(CHARS, sum(chars)), -(-sum(chars) // SHARE))
    if len(w) <= SHORT:
        for i, j in combinations(range(0, PARTS, 2), 2):
            four = (i, i + 1, j, j + 1)
            if sum(chars[p] for p in four) >= least:
                out.add((i, j, *(tuple(sorted(got[p])) for p in four)))
    if len(w) >= LONG:
        out |= {(p, tuple(sorted(got[p]))) for p in range(PARTS) if chars[p] >= least}
    return out


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def alike(a, b):
    return abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) + 1e-9 and edit(a, b) <= (1 - LEAST) * max(len(a), len(b)) + 1e-9


def brute(rows, pairs=None):
    """Text left of each (id, text) row, rows equal in both being one document, with all pairs or those that share a block."""
    docs = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda d: (d[:2], th(d)))
    at = [(d, n, form(x)) for d in docs for n, x in enumerate(d[2].split("\n"))]
    forms = sorted({f for *_, f in at if f})
    up = {f: f for f in forms}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    if pairs is None:
        met = {}
        for f in forms:
            for k in blocks(f):
                met.setdefault(k, []).append(f)
        pairs = {p for fs in met.values() for p in combinations(fs, 2)}
    for a, b in pairs:
        if root(a) != root(b) and alike(a, b):
            up[root(a)] = root(b)
    first = {}
    for d, n, f in at:
        if f:
            first.setdefault(root(f), (d, n))
    return {d: "\n".join(x for n, x in enumerate(d[2].split("\n")) if not form(x) or first[root(form(x))] == (d, n)) for d in docs}


def th(d):
    """Spark's hash of a text and whether its id is null, signed."""
    h = xxhash.xxh64_intdigest((0 if d[0] else 1).to_bytes(4, "little"), xxhash.xxh64_intdigest(d[2].encode(), 42))
    return h - (h >> 63 << 64)


def check(df, rows):
    got = dedup_lines(df).select("doc_id", "text").collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for i, t in rows:
        if t is None:
            assert any(r.doc_id == i and r.text is None for r in got)
    left = sorted((str(r.doc_id), r.text) for r in got if r.text is not None)
    assert left == sorted((str(i), want[i is not None, i or 0, t]) for i, t in rows if t is not None)
    return left


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    check(df, [(r.doc_id, r.text) for r in df.collect()])


def grouped(spark, df):
    """The root of each form that has a link."""
    forms = lines.occurrences(df).groupBy("k1", "k2").agg(F.min(F.struct("id", "th", "line")).alias("at"), F.count("*").alias("n"), F.first("keys").alias("keys")).cache()
    member = lines.links(df, forms)
    return {r.node: r.root for r in member.collect()}


def test_recall_against_all_pairs(spark):
    """Of all pairs of edit similarity 0.8 or more in 1,000 documents (forms up to 200 characters), nine of ten or more are in one group."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    root = grouped(spark, df)
    fs = df.select(F.explode(F.split("text", "\n")).alias("x")).select(lines.line_words(F.col("x")).alias("w")).where("w[0] <> ''").select(F.array_join("w", " ").alias("f"), F.xxhash64("w").alias("k")).distinct().where("length(f) <= 200")
    import numpy as np

    rows = sorted((len(r.f), r.f, r.k) for r in fs.collect())
    size = np.array([r[0] for r in rows])
    alphabet = sorted(set("".join(r[1] for r in rows)))
    bags = np.array([[r[1].count(c) for c in alphabet] for r in rows], np.int16)
    near = []
    for i in range(len(rows)):
        end = np.searchsorted(size, size[i] / 0.8 + 1e-9, "right")
        d = bags[i + 1 : end] - bags[i]  # unequal characters bound the distance from below
        apart = np.maximum(np.where(d > 0, d, 0).sum(1), np.where(d < 0, -d, 0).sum(1))
        near += [(i, i + 1 + j) for j in np.flatnonzero(apart <= 0.2 * size[i + 1 : end] + 1e-9).tolist()]
    pairs = spark.createDataFrame([(rows[i][1], rows[j][1], rows[i][2], rows[j][2]) for i, j in near], "a string, b string, ka long, kb long")
    true = pairs.where("levenshtein(a, b) <= 0.2 * greatest(length(a), length(b)) + 1e-9").collect()
    found = sum(root.get(r.ka, 0) == root.get(r.kb, 1) for r in true)
    assert len(true) > 50 and found >= 0.9 * len(true)


@pytest.mark.parametrize("n", [300, 1500])
def test_reordered_lines_are_no_crowd(spark, n):
    """Reorderings of one line agree in few blocks: members of shared buckets grow in proportion."""
    rng = random.Random(2)
    words = [f"word{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join(rng.sample(words, 12))) for i in range(n)], "doc_id long, text string")
    forms = lines.occurrences(docs).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.first("keys").alias("keys"))
    shared = lines.buckets(forms, 4)
    assert shared.count() < 3 * n
    assert shared.groupBy("key").count().agg(F.max("count")).first()[0] < max(16, n // 60)


def test_near_lines(make):
    base = " ".join(f"word{i}" for i in range(60))
    near = [base.replace(f"word{k} ", f"other{k} ") for k in range(12)]
    rows = [(1, "Top line!\n" + base), (2, "top   LINE\n--\n" + near[0]), (3, "\n".join(near[1:])), (4, "top line\nsomething else"), (5, ""), (6, "a b c d e f\n" * 3)]
    rng = random.Random(1)
    many = base.split(" ")
    for k in range(60):  # a crowd of near copies, most of them linked through others only
        w = list(many)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(60)] = f"new{rng.randrange(5)}"
        rows.append((100 + k, " ".join(w) + "\n" + " ".join(rng.sample(w[:5], 5))))
    left = check(make(rows), rows)
    assert ("4", "something else") in left


def test_repeated_words_are_no_crowd(spark):
    """Lines that say each word an even number of times share no block."""
    docs = spark.createDataFrame([(i, " ".join([f"word{i}"] * 40)) for i in range(200)], "doc_id long, text string")
    forms = lines.occurrences(docs).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.first("keys").alias("keys"))
    assert lines.buckets(forms, 4).count() == 0


def test_long_lines(make):
    """One line of 100,000 characters and its copy with some words changed."""
    rng = random.Random(9)
    w = [f"w{rng.randrange(5000)}" for _ in range(18_000)]
    other = list(w)
    for k in range(0, 18_000, 4000):
        other[k] = "new"
    got = {r.doc_id: r.text for r in dedup_lines(make([(1, " ".join(w)), (2, "head line\n" + " ".join(other)), (3, " ".join(rng.sample(w, 18_000)))])).collect()}
    assert got[1] == " ".join(w) and got[2] == "head line" and len(got[3]) > 90_000


def test_odd(make, odd_rows):
    rows = [(i, t) for i, t, *_ in odd_rows if t is None or len(t) < 100_000]
    out = dedup_lines(make(odd_rows))
    assert out.columns == make(odd_rows).columns
    assert out.count() == len(odd_rows)
    check(make(rows), rows)


def test_text_ids_and_empty(spark, make):
    docs = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four\nfive")], "doc_id string, text string")
    assert {r.doc_id: r.text for r in dedup_lines(docs).collect()} == {"a": "one two three four\nfive", "b": ""}
    assert dedup_lines(make([])).count() == 0


def test_crowd_of_many_lengths_makes_few_pairs(spark):
    """Members of one bucket of too different lengths make no pairs, and a chain of near lengths two for each member at most, not all."""
    n = 300
    far = spark.createDataFrame([(1, i, 1000 + 300 * i, i if i % 2 else 0, 0) for i in range(n)], "key long, form long, size int, comp long, main long")
    assert lines.apart(far).count() < n * n / 8  # 22,500 outsiders and members of the largest component
    near = spark.createDataFrame([(1, i, 1000 + i, i if i % 2 else 0, 0) for i in range(n)], "key long, form long, size int, comp long, main long")
    met = {(r.a, r.b) for r in lines.beside(near).collect()}
    assert len(met) <= 2 * n and {(i - 1, i) for i in range(1, n)} <= met


def test_pairs_compared_in_a_crowd(spark, monkeypatch):
    """A line whose ends move on a word at a time: each is near the next ones only, and all are one component."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    core = " ".join(words[:24])
    rows = [(i, core + " " + " ".join(words[24 : 24 + i])) for i in range(1, 120)]
    made = []
    for name in ("beside", "apart"):
        monkeypatch.setattr(lines, name, lambda mixed, least, real=getattr(lines, name): made.append(real(mixed, least)) or made[-1])
    monkeypatch.setattr(lines, "drop_cut", lambda t: None)
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == {d[1]: t for d, t in brute(rows).items()}
    assert sum(p.distinct().count() for p in made) < len(rows) * 8


def test_similar_is_the_edit_distance(spark):
    """Equal beginnings and ends, pieces and halves leave the verdict as the distance has it, on both sides of the limit."""
    rng = random.Random(6)
    words = ["a", "bc", "des", "ünd", "house", "running", "ab", "bca"]
    rows = []
    for n in range(700):
        a = [rng.choice(words) for _ in range(rng.choice((1, 2, 5, 12, 30, 60)))]
        b = list(a)
        for _ in range(rng.randrange(0, 1 + len(a) // 2)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(([], ["house"], ["a", "bc"], [rng.choice(words)]))
        rows.append((" ".join(a), " ".join(b) or "x") if n % 9 else (" ".join(a), " ".join(rng.sample(a, len(a)))))
    pairs = spark.createDataFrame(rows, "x string, y string").cache()
    want = [alike(a, b) for a, b in rows]
    for likely in (True, False):
        assert [bool(r[0]) for r in pairs.select(lines.similar("x", "y", likely=likely)).collect()] == want
    assert 100 < sum(want) < 600


def test_similar_compares_what_differs(spark):
    """Of a pair of long forms that differ at one place, with words put in there, only that place is compared."""
    rng = random.Random(3)
    w = [f"w{rng.randrange(9999)}" for _ in range(60_000)]
    x, y = " ".join(w), " ".join([*w[:30_000], "put", "in", "here", *w[30_000:]])
    at = time.monotonic()
    assert spark.createDataFrame([(x, y)], "x string, y string").select(lines.similar("x", "y")).first()[0]
    assert time.monotonic() - at < 60


def test_keys_of_blocks_lie_on_disk_once(spark, sf, monkeypatch):
    """While buckets are made, no other written table than that of the forms holds the keys of blocks."""
    there, seen = {}, []
    real_cut, real_drop, real_buckets = lines.cut, lines.drop_cut, lines.buckets

    def cut(df, parts=None):
        out = real_cut(df, parts)
        there[out._cut_path] = out.columns
        return out

    def drop(df):
        there.pop(getattr(df, "_cut_path", None), None)
        real_drop(df)

    def buckets(forms, parts):
        seen.append(sum("keys" in c for c in there.values()))
        return real_buckets(forms, parts)

    monkeypatch.setattr(lines, "cut", cut)
    monkeypatch.setattr(lines, "drop_cut", drop)
    monkeypatch.setattr(lines, "buckets", buckets)
    lines.dedup_lines(spark.read.parquet(f"{sf}/documents.parquet")).count()
    assert seen == [1]
