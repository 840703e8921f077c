import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import sentence
from quillspark.llm import lm


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def base(rows):
    toks = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None] for _, t in rows]
    c = Counter(x for (i, _), w in zip(rows, toks) if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    return sorted(((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for (i, _), w in zip(rows, toks)), key=str)


def run(df):
    return lm.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).collect()


def test_base_and_odd_rows(make, odd_rows):
    rng = random.Random(8)
    rows = [(i, t[:60_000] if t else t) for i, t, *_ in odd_rows] + [(100 + i, sentence(rng, 60, 50)) for i in range(60)]
    got = run(make(rows))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == base(rows)
    assert all(r.score < 0 for r in got)


def test_model_learns(make):
    """Held-out texts of a regular language are likelier under the model than at random order of words."""
    rng = random.Random(4)
    words = ["red", "green", "blue", "stone", "water", "light"]
    rows = []
    for i in range(400):
        k = rng.randrange(6)
        rows.append((i, " ".join(words[(k + j) % 6] for j in range(40))))
    got = run(make(rows))
    out = [r for r in got if r.held_out]
    assert out and np.mean([r.score for r in out]) > np.mean([r.base_score for r in out]) + 5


def test_empty(make):
    assert run(make([])) == []


def small(seed=0):
    rng = np.random.default_rng(seed)
    pairs = rng.integers(0, 3, (lm.PIECES, lm.GROUPS)).astype(np.float32) * (np.arange(lm.PIECES) < 300)[:, None]
    return lm.vocabulary(pairs, np.arange(lm.PIECES) % lm.GROUPS), rng


def test_windows_score_each_place_once():
    for context in (lm.CONTEXT, 0):
        for sizes in ([1], [24], [25], [24, 1, 100, 33]):
            bound = np.concatenate(([0], np.cumsum(sizes)))
            places, before, scored = lm.windows(bound, context)
            assert sorted(places[scored].tolist()) == list(range(bound[-1]))
            starts = set(bound[:-1].tolist())
            assert all((b == -1) == (p in starts) and (b == -1 or b == p - 1) for p, b in zip(places[scored].tolist(), before[scored].tolist()))


def test_attention_is_causal_and_shares_sum_to_one():
    vocab, rng = small()
    p = lm.start(vocab)
    x = rng.integers(0, lm.PIECES, (2, lm.WINDOW))
    a, _ = lm.forward(p, x)
    y = x.copy()
    y[:, 20:] = 0
    b, _ = lm.forward(p, y)
    assert np.allclose(a[:, :20], b[:, :20], atol=1e-5)
    for g in (0, 5):
        total = np.bincount(vocab["kind"], 10.0 ** vocab["cond"][:, g].astype(float), lm.CLASSES)
        assert np.allclose(total[np.unique(vocab["kind"])], 1, atol=1e-3)


def test_scores_are_the_forward_pass():
    vocab, rng = small(5)
    p = lm.start(vocab)
    x, y, ok = rng.integers(0, lm.PIECES, (4, lm.WINDOW)), rng.integers(0, lm.CLASSES, (4, lm.WINDOW)), rng.random((4, lm.WINDOW)) < 0.7
    logits, _ = lm.forward(p, x)
    full = (logits - np.log(np.exp(logits).sum(-1, keepdims=True))) / np.log(10)
    assert np.allclose(lm.class_scores(p, x, y[ok], ok), full[ok, y[ok]], atol=1e-4)


@pytest.mark.parametrize("key", ["E", "R", "Q", "K", "V", "O", "C", "b"])
def test_gradient(key):
    vocab, rng = small(3)
    p = {k: v.astype(np.float64) for k, v in lm.start(vocab).items()}
    p["R"] = rng.normal(0, 0.3, lm.WINDOW)
    x, y = rng.integers(0, 30, (3, lm.WINDOW)), rng.integers(0, lm.CLASSES, (3, lm.WINDOW))
    scored = rng.random((3, lm.WINDOW)) < 0.6
    _, g = lm.gradient(p, x, y, scored)
    rows, values = g["E"]
    g["E"] = np.zeros_like(p["E"])
    g["E"][rows] = values
    at = tuple(int(rng.integers(min(n, 30))) for n in p[key].shape) if key != "E" else (int(x[0, 0]), 3)
    up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
    up[key][at] += 1e-3
    down[key][at] -= 1e-3
    slope = (lm.gradient(up, x, y, scored)[0] - lm.gradient(down, x, y, scored)[0]) / 2e-3
    assert abs(slope - g[key][at]) < 2e-3 * max(1, abs(slope)) + 2e-4


def test_each_window_is_learned_from():
    """Windows of every text are seen once, however few they are and however texts are handed over."""
    vocab, rng = small(7)
    p = lm.start(vocab)
    for n in (1, 11, 260, 700):
        learner = lm.Learner(p)
        texts = [rng.integers(3, 300, int(rng.integers(1, 100))).astype(np.uint16) for _ in range(n)]
        for t in texts:
            learner.take(vocab, t.tobytes())
        learner.take(vocab, None)
        assert learner.seen == sum(-(-len(t) // lm.WINDOW) for t in texts)
        assert learner.step == -(-learner.seen // lm.STEP_WINDOWS)
        assert np.abs(learner.p["b"] - p["b"]).max() > 0.5 * lm.RATE


def test_pieces_and_phrases():
    """Subwords are those of sentencepiece, word by word; phrases follow each other and end where a word's hash says so."""
    import sentencepiece

    from quillspark.llm.textnum import text_slices
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["", "  ", "One two", sentence(rng, 500), "x " * 700, "ß É 😀 " * 30, sentence(rng, 40)]
    with open(f"{lm.TOKENIZERS}/{lm.MODEL_FILE}", "rb") as f:
        model = f.read()
    sp, pieces = sentencepiece.SentencePieceProcessor(model_proto=model), lm.Pieces(model)
    ((_, _, buf, offs),) = text_slices(pa.array(texts))
    counts, ids, phrases, sizes = lm.cut_slice(buf, offs, pieces)
    for t, n, i, h, s in zip(texts, counts, ids, phrases, sizes):
        words = [w.decode() for w in t.encode().lower().split()]
        assert n == len(words) and np.frombuffer(i, np.uint16).tolist() == [p for w in words for p in sp.encode(w)] + [lm.END]
        assert len(h) // 8 == len(s) // 4 >= 1 and np.frombuffer(s, np.uint32).sum() == len(i) // 2
    again = lm.cut_slice(*next((b, o) for _, _, b, o in text_slices(pa.array([texts[3], texts[6]]))), pieces)
    assert again[2] == [phrases[3], phrases[6]]


def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def test_scores_do_not_depend_on_partitions(spark, sf):
    a, b = ({r.doc_id: r.score for r in run(table(spark, sf).repartition(n))} for n in (2, 9))
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) / abs(a[i]) for i in a) < 1e-6


def test_held_out_beats_the_base(spark):
    """On 1,000 documents the model is likelier than the unigram base, over all words of held-out texts."""
    out = [r for r in run(table(spark, "/root/testdata/sf0.01")) if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)


def test_memory_counts_other_texts_only(make):
    """A text that occurs twice is likelier than one that occurs once, and a held-out one teaches nothing."""
    rng = random.Random(12)
    rows = [(i, sentence(rng, 80, 3000)) for i in range(60)]
    free = [i for i in range(1000, 1100) if not held(i)]
    twice, hidden = sentence(rng, 80, 3000), sentence(rng, 80, 3000)
    silent = [i for i in range(2000, 2100) if held(i)]
    rows += [(free[0], twice), (free[1], twice), (silent[0], hidden), (silent[1], hidden)]
    got = {r.doc_id: r.score for r in run(make(rows))}
    once = [got[i] for i in range(60)]
    assert got[free[0]] > max(once) + 50 and got[free[0]] == pytest.approx(got[free[1]])
    assert got[silent[0]] < max(once) + 50


def test_text_ids(spark):
    got = run(spark.createDataFrame([("a1", "red green"), ("b2", None), (None, "red")], "doc_id string, text string"))
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("None", 2), ("a1", 3), ("b2", 1)]
