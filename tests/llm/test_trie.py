import hashlib
import random
import zlib

import pytest
from compare import same_rows

from quillspark.llm import q_trie, trie


def brute(rows):
    """Nodes of the trie of rebuilt conversations, from (conv_id, turn, role, text) rows."""
    own = {}
    for c, *turn in rows:
        if c is not None:
            own.setdefault(c, []).append(turn)
    for c, turns in own.items():
        d = lambda r, t: hashlib.sha256((f"{len((r or '').encode())}:{r or ''}{t or ''}").encode()).hexdigest()[:32]
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, d(*x[1:])))
        own[c] = [(r or "", t or "") for _, r, t in turns]
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = {p: m for p, m in nodes.items() if p[: len(path)] == path}
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[:-1] == p for q in below if len(q) == len(p) + 1) for p in below)
        saved = sum((len(m) - 1) * len(p[-1][1].encode()) for p, m in below.items() if p)
        ends = ",".join(str(c) for c in sorted(c for c in members if full[c] == path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, key string, seq int")
    return sorted((tuple(r) for r in trie.prefix_trie(trie.rebuilt(trie.sequences(df)), **more).collect()), key=str)


def test_query(spark, sf):
    same_rows(q_trie.op12_trie(spark, sf), q_trie.SQL)


def planted(seed, n, alphabet):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        same = rng.random() < 0.4
        for t in range(rng.randrange(1, 14)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if not same else "user", f"text é {t if same else rng.randrange(alphabet)}"))
    return rows


@pytest.mark.parametrize("seed,range_bytes", [(1, 4 << 20), (2, 200), (3, 1)])
def test_brute_force(spark, seed, range_bytes):
    rows = planted(seed, 150, 2)
    assert found(spark, rows, range_bytes=range_bytes) == brute(rows)


def test_equal_conversations_over_many_ranges(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(120) for t in range(10)] + [(c, 0, "system", "hot") for c in range(200, 290)] + [(c, 1, "user", str(c)) for c in range(200, 290)]
    assert found(spark, rows, range_bytes=50) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 5, None, "é😀"), (2, 5, "user", "b"), (2, None, "a", "z"), (3, 1, "user", "x" * 100_000), (10, 1, "user", "only"), (-4, 1, "", "neg"), (6, 0, "r1", "2"), (7, 0, "r", "12")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "lost")]) == []


def test_loser_tree_gives_order_and_common_turns():
    rng = random.Random(4)
    rows = sorted((b"".join(bytes([rng.randrange(2)]) * trie.TURN for _ in range(rng.randrange(9))), i) for i in range(300))
    common = lambda a, b: next((i for i in range(min(len(a), len(b)) // trie.TURN) if a[i * trie.TURN] != b[i * trie.TURN]), min(len(a), len(b)) // trie.TURN)
    runs = [[] for _ in range(7)]
    for row in rows:
        own = runs[rng.randrange(6)]
        own.append((*row, common(own[-1][0], row[0]) if own else 0))
    got = list(trie.merged(runs))
    assert [r[:2] for _, r in got] == rows
    assert [n for n, _ in got] == [0, *[common(a[0], b[0]) for a, b in zip(rows, rows[1:])]]
