import hashlib
import re

import pytest
from compare import same_rows

from quillspark.llm import q_decontaminate
from quillspark.llm.decontaminate import find_overlap, remove_overlap


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[a : a + k]), set()).add(i)
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (g := tuple(w[a : a + k])) in wins:
                    hit |= set(range(a, a + k))
                    found |= wins[g]
        out.append((d, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def test_query(spark, sf):
    same_rows(q_decontaminate.op1_decontaminate(spark, sf), q_decontaminate.SQL)


@pytest.mark.parametrize("block_words", [10, 200_000])
def test_odd(spark, make, odd_rows, block_words):
    items = [(1, "Alpha, beta gamma"), (2, " ".join(f"w{i}" for i in range(12))), (None, "é 😀 a"), (4, None), (5, ""), (2, odd_rows[3][1]), (6, "alpha beta GAMMA")]
    rows = [*odd_rows, (20, "see ALPHA beta-gamma! " + " ".join(f"w{i}" for i in range(11)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_overlap(make(rows), bench, block_words=block_words).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == brute([r[:2] for r in rows], items)


def test_empty(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_overlap(make([]), none).count() == 0
    r = find_overlap(make([(1, "a b")]), none).first()
    assert (r.n_words, r.n_hit, list(r["items"])) == (2, 0, [])
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_remove(spark, make):
    passage = " ".join(f"p{i}" for i in range(12))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    clean = "x y z " * 10
    df = make([(1, clean + passage.upper() + ". tail"), (2, passage), (3, clean), (4, None)])
    got = {r.doc_id: r for r in remove_overlap(df, bench).collect()}
    assert set(got) == {1, 3, 4} and got[3].text == clean and got[4].text is None
    assert got[1].text == clean + "\n. tail" and got[1].id == 7
    assert remove_overlap(df, bench).columns == df.columns
