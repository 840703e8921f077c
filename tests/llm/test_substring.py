import pytest
from compare import same_rows

from quillspark.llm import q_substring
from quillspark.llm.substring import COVER, PERIOD, remove_repeats


def split(t):
    return [x.decode() for x in (t or "").encode().split()]


def brute(rows, size=13):
    least = {}
    for d, t in rows:
        w = split(t)
        for a in range(len(w) - size + 1 if d is not None else 0):
            g = tuple(w[a : a + size])
            least[g] = min(d, least.get(g, d))
    out = []
    for d, t in rows:
        w, gone = split(t), set()
        for a in range(len(w) - size + 1 if d is not None else 0):
            if least[tuple(w[a : a + size])] < d:
                gone |= set(range(a, a + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_query(spark, sf):
    same_rows(q_substring.op7_substring(spark, sf), q_substring.SQL)


def test_odd(make, odd_rows):
    passage = " ".join(f"p{i}" for i in range(14))
    rows = [*odd_rows, (30, "a b c " + passage), (31, passage + " d"), (32, "e\t" + passage.replace(" ", "\n", 3)), (33, passage.replace("p13", "q")), (30, passage + " other text of the same id"), (34, (passage + " ") * 400)]
    got = remove_repeats(make(rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute([r[:2] for r in rows])


def test_text_ids_are_refused(spark):
    with pytest.raises(TypeError):
        remove_repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_empty_and_short(make):
    assert remove_repeats(make([])).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(make([]), window=8)
