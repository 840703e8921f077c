import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from compare import same_rows
from pyspark.sql import functions as F

from quillspark.llm import importance, q_importance


def words(t):
    low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(t, least, most):
    w = words(t)
    return [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, least, most, buckets, min_words, share):
    """(id, n_features, weight, score) of each row, and the scores drawn."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(bucket, features(x, least, most)))
    for x in target:
        t.update(map(bucket, features(x, least, most)))
    all_s, all_t = sum(s.values()), sum(t.values())
    out, can = [], []
    for i, x in rows:
        f = features(x, least, most)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, f))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(f), weight, score))
        if len(words(x)) >= min_words:
            can.append((-score, math.inf if i is None else i))
    return out, sorted(can)[: len(can) * share // 100]


def test_query(spark, sf):
    same_rows(q_importance.op11_importance(spark, sf), q_importance.SQL)


@pytest.mark.parametrize("least,most", [(1, 1), (1, 3), (2, 2)])
def test_brute_force(spark, make, odd_rows, least, most):
    rows = [r[:2] for r in odd_rows] + [(100 + k, f"Common words {k} and others é {k * k}") for k in range(60)]
    target = ["common words and more", None, "", "w1 w2 w3 w4"]
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(make(rows), bench, least=least, most=most, buckets=97, min_words=5, share=40, block_bytes=2000).collect()
    want, drawn = brute(rows, target, least, most, 97, 5, 40)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=str) == sorted(want, key=str)
    picked = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in picked] == list(range(1, len(drawn) + 1))
    assert [(-r.score, math.inf if r.doc_id is None else r.doc_id) for r in picked] == drawn


def test_empty(spark, make):
    bench = spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(make([]), bench).count() == 0
    rows = [(k, f"some text {k} " * 10) for k in range(20)]
    got = importance.resample(make(rows), bench.where("false")).collect()
    want, drawn = brute(rows, [], 1, 1, 10_000, 20, 10)
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in got) == sorted(want) and sum(r.rank is not None for r in got) == len(drawn) == 2
    assert all(r.rank is None and r.score is not None for r in importance.resample(make([(1, None), (None, "")]), bench).collect())


def test_ranks_over_many_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("score"), F.col("id").alias("doc_id"))
    got = importance.ranked(rows, [F.col("score").desc(), F.col("doc_id").asc()]).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: (-r.score, r.doc_id))] == list(range(1, 5001))
    assert importance.least_score(rows, 1000) == 5 and importance.least_score(rows, 0) == 7
