import random

import pytest

from compare import same_rows
from llm_fixtures import sentence

from quillspark.llm import minhash, q_minhash


def brute(rows, width=2, percent=80):
    sets = []
    for _, t in rows:
        w = [x for x in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\f\r", "abcdefghijklmnopqrstuvwxyz     ")).split(" ") if x]
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), d if not s else least.get(root(i)), d == (d if not s else least.get(root(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def found(df, **more):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, **more).collect()), key=str)


def test_query(spark, sf):
    same_rows(q_minhash.op13_minhash(spark, sf), q_minhash.SQL)


def edited(rng, text, share):
    return " ".join(f"z{rng.randrange(10**9)}" if rng.random() < share else w for w in text.split())


def test_planted_near_the_threshold(make, odd_rows):
    """Groups whose members differ by about as much as the threshold allows, of all lengths, and boilerplate shared by unlike texts."""
    rng = random.Random(8)
    rows = [r[:2] for r in odd_rows if r[0] != 7]
    boiler = sentence(rng, 60, 9999)
    for g in range(60):
        base = sentence(rng, rng.choice([3, 5, 6, 7, 11, 20, 40, 90, 250, 900]), 99999)
        rows += [(1000 + 10 * g + k, edited(rng, base, rng.choice([0, 0.02, 0.05, 0.08]))) for k in range(5)]
    rows += [(5000 + k, sentence(rng, 40, 99999) + " " + boiler + " " + sentence(rng, 20, 99999)) for k in range(40)]
    rows += [(6000 + k, edited(rng, boiler, 0.04)) for k in range(60)]
    assert found(make(rows)) == brute(rows)


@pytest.mark.parametrize("tile", [4096, 7])
def test_crowd_below_the_threshold(make, monkeypatch, tile):
    """A crowd of texts near one another but mostly less than similar, whose lists are compared in full, in one tile and in many; no pair is told twice."""
    rng = random.Random(10)
    base = sentence(rng, 120, 99999)
    rows = [(k, edited(rng, base, rng.choice([0.04, 0.06, 0.08, 0.1]))) for k in range(150)]
    seen = []

    def counted(spark_links):
        def links(pairs, *args, **more):
            seen.append([tuple(r) for r in pairs.select("a", "b").collect()])
            return spark_links(pairs, *args, **more)

        return links

    monkeypatch.setattr(minhash, "links", counted(minhash.links))
    assert found(make(rows), tile=tile) == brute(rows)
    assert len(seen) == 3 and seen[2] and len(seen[2]) == len(set(seen[2]))


def test_other_thresholds(make):
    rng = random.Random(9)
    rows = []
    for g in range(40):
        base = sentence(rng, rng.choice([2, 3, 4, 6, 9, 14, 30]), 99999)
        rows += [(10 * g + k, edited(rng, base, rng.choice([0, 0.1, 0.2]))) for k in range(6)]
    for width, percent in ((1, 50), (2, 90)):
        assert found(make(rows), width=width, percent=percent) == brute(rows, width, percent)


def test_run_lengths_hold():
    """No two sets as similar as asked lack a shared run of the length: all ways to differ, for small unions."""
    import itertools

    for percent in (50, 60, 80):
        for u in range(1, 12):
            cuts = u - -(-percent * u // 100)
            worst = min((max(b - a - 1 for a, b in zip((-1, *c), (*c, u))) for c in itertools.combinations(range(u), cuts)), default=u)
            assert not cuts or minhash.guaranteed(u, percent) <= worst
    assert minhash.run_lengths(3, 80) == [] and minhash.run_lengths(4, 80) == [2] and minhash.run_lengths(5, 80) == [2, 3] and all(minhash.run_lengths(n, 80) == [3] for n in range(6, 400))
    assert 20 < minhash.least_shared(64, 80) < 35


def test_all_empty(make):
    assert minhash.near_duplicates(make([])).count() == 0
    assert found(make([(1, None), (2, ""), (None, " ")])) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]
    assert found(make([(None, "a b"), (None, "a b")])) == [(None, 1, None, True)] * 2
