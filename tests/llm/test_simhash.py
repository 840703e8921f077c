import random
import re

import numpy as np
import xxhash

from quillspark.llm.simhash import forest, near_duplicates
from llm_fixtures import sentence


def fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fp = [fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f, least.get(root(i))) for i, ((d, _), f) in enumerate(zip(rows, fp))), key=str)


def check(df, rows, **more):
    got = near_duplicates(df, **more).collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == brute(rows)


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    check(df, [(r.doc_id, r.text) for r in df.collect()])


def test_odd_in_small_tiles(make, odd_rows):
    rng = random.Random(3)
    base = sentence(rng, 300)
    near = [(100 + k, base.replace(f"w{k} ", f"v{k} ", 1)) for k in range(40)]
    rows = [r[:2] for r in odd_rows] + near
    check(make(rows), rows, tile=8)


def test_forest_joins_what_all_links_join():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 12, 300, dtype=np.uint64)
    a = np.unique(a)
    got = forest(a, None, 2)
    up = {int(x): int(x) for x in a}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in got:
        assert (x ^ y).bit_count() <= 2
        up[root(x)] = root(y)
    roots = {x: root(x) for x in up}
    for x in up:
        for y in up:
            if (x ^ y).bit_count() <= 2:
                assert roots[x] == roots[y]
    assert len(got) < len(a)


def test_empty(make):
    assert near_duplicates(make([])).count() == 0
