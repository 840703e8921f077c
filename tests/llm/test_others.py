"""Licences, URL filters, quality rules, mixing and toxicity on small fixtures."""
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from compare import same_rows, views
from pyspark.sql import functions as F

from quillspark.llm import licenses, mixing, q_licenses, q_quality, q_urls, quality, toxicity, urls


# ---------------------------------------------------------------- op3


def test_licences_query(spark, sf):
    same_rows(q_licenses.op3_licenses(spark, sf), q_licenses.SQL)


def test_licences_rules(make, odd_rows):
    import textwrap

    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    bsd = "All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at x."
    wrap = lambda t, w, mark="": "\n".join(mark + x for x in textwrap.wrap(t, w))
    rows = [
        (50, mit),
        (51, "Intro without an end\nRELEASED under the   MIT License!\nLicensed under CC BY-NC 4.0."),
        (52, "Some title\n\n" + wrap(mit, 72, "// ")),
        (53, wrap(gpl, 40, " * ")),
        (54, bsd),
        (55, "All rights reserved."),
        (56, wrap(mpl, 60)),
        (57, "Permission is hereby granted to nobody."),
    ]
    got = {r.doc_id: r for r in licenses.scan(make([*odd_rows, *rows])).collect()}
    assert (got[50].licence, got[50].sentence_ids) == ("mit", ",10,11,")
    assert got[51].licences == "mit;cc-by-nc-4.0" and got[51].n_known == 2
    assert got[52].licence == "mit" and got[52].n_known == 0 and ",10,11," in got[52].wrapped_ids
    assert (got[53].licence, got[53].kind) == ("gpl-3.0-or-later", "copyleft")
    assert got[54].licences == "bsd;proprietary" and got[55].licence == "proprietary" and got[56].licence == "mpl-2.0"
    assert got[57].licence is None
    for i in (1, 2, 3):
        assert (got[i].n_sentences, got[i].licence, got[i].licences) == (0, None, "")
    assert got[7].n_sentences == 1 and len(got) == len({i for i, *_ in odd_rows}) + len(rows)
    assert licenses.scan(make([])).count() == 0


# ---------------------------------------------------------------- op10


def parts(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fits = [(h + p, v) for v, h, p in q_urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, None)


def test_urls(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/en/1?x", "http://a.example.org/en/2", "http://notexample.org/es/", "ftp://x.com/de/#f", "http://x.com?/de/", "http://com/fr/", "http://org", "a://b://c/d", "http://é.org/ß", "http://x.net/" + "y" * 200_000]
    odd += ["http://x.net/a", "http://x.net/a"]
    pages = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(odd)], "page_id long, url string, host string, path string, rule string")
    model = urls.train(urls.labelled_urls(spark))
    got = {r.page_id: r for r in urls.judge(pages, q_urls.RULES, model).collect()}
    assert len(got) == len(odd)
    for i, u in enumerate(odd):
        host, path = parts(u)
        rule, verdict = ruled(host, path)
        assert (got[i].input_host, got[i].input_path, got[i].input_rule) == ("h", "p", "r")
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if got[i].block_score >= 0.5 else "allow"))
    assert urls.judge(pages.limit(0), q_urls.RULES, model).count() == 0


def features(host, path):
    """Scaled hash buckets of n-grams, one by one."""
    x = np.zeros(urls.BUCKETS)
    for mark, part, scale in (("h", host, urls.SCALE[0]), ("p", path, urls.SCALE[1])):
        t, out = f"^{part}$", set()
        for n in urls.SIZES:
            for i in range(len(t) - n + 1):
                h = 42
                for y in (mark, t[i : i + n]):
                    h = xxhash.xxh64_intdigest(y.encode(), h)
                out.add((h - (h >> 63 << 64)) % urls.BUCKETS)
        x[sorted(out)] += scale / np.sqrt(max(1, len(out)))
    return x


def test_url_scores_by_brute_force(spark):
    """Weights by a plain descent over all rows, scores by a plain sum."""
    rows = [(r.url, r.block) for r in urls.labelled_urls(spark).collect()]
    bias, weights = urls.train(urls.labelled_urls(spark))
    x = np.array([features(*parts(u)) for u, _ in rows])
    y, w, b = np.array([t for _, t in rows]), np.zeros(urls.BUCKETS), 0.0
    v, p = np.zeros(urls.BUCKETS), 0.0
    for _ in range(urls.STEPS):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(rows)
        v, p = urls.MOMENTUM * v - urls.RATE * (x.T @ e + urls.L2 * w), urls.MOMENTUM * p - urls.RATE * e.sum()
        w, b = w + v, b + p
    assert abs(b - bias) < 1e-6 and np.abs(w - np.array(weights)).max() < 1e-6
    asked = [*[u for u, _ in rows[::9]], "http://casino.example/x", "https://a.org/en/1?q#f", "none", "http://É.org/ß"]
    got = urls.judge(spark.createDataFrame([(i, u) for i, u in enumerate(asked)], "page_id int, url string"), [], (bias, weights)).collect()
    for r in got:
        want = 1 / (1 + np.exp(-(b + features(*parts(r.url)) @ w)))
        assert abs(r.block_score - want) < 1e-6 and r.verdict == ("block" if want >= 0.5 else "allow")


def test_url_model_on_pages(spark):
    """Pages of the tables: hosts of a kind to block against all others, of urls that no rule decides."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    out = urls.judge(pages, q_urls.RULES, urls.train(urls.labelled_urls(spark))).where("rule is null").collect()
    kind = "casino|pills|adult|bets|ads-|spam"
    bad = [r.verdict == "block" for r in out if re.search(kind, r.host)]
    rest = [r.verdict == "block" for r in out if not re.search(kind, r.host)]
    assert len(bad) > 40 and np.mean(bad) >= 0.9 and np.mean(rest) <= 0.01
    asked = {"https://online-pharmacy24.com/": 1, "https://freegambling.biz/a/b": 1, "http://poker-slots.net/en/story": 1, "https://github.com/a/b": 0, "https://www.weather.gov/": 0, "http://en.wikipedia.org/wiki/Poker": 0}
    got = urls.judge(spark.createDataFrame(list(asked.items()), "url string, want int"), [], urls.train(urls.labelled_urls(spark))).collect()
    assert all((r.verdict == "block") == bool(r.want) for r in got)


def test_url_model_on_unseen_hosts(spark):
    """Hosts of the test rows are none of the training rows'."""
    table = urls.labelled_urls(spark)
    host = F.crc32(urls.host_of(F.col("url")).cast("binary")) % 4
    fit = urls.train(table.where(host != 0))
    out = urls.judge(table.where(host == 0), [], fit).collect()
    assert len(out) > 40 and np.mean([(r.verdict == "block") == bool(r.block) for r in out]) >= 0.9


def test_url_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "mine")], "page_id int, url string, grams string")
    assert urls.judge(pages, [], (0.0, [0.0] * urls.BUCKETS)).first().grams == "mine"


# ---------------------------------------------------------------- op9


def test_quality_base(spark, sf):
    cols = [c[0] for c in views().execute(q_quality.BASE_SQL).description]
    same_rows(q_quality.op9_quality(spark, sf).select(*cols), q_quality.BASE_SQL)


def repeated(words):
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(wins)
    return len({p for i, w in enumerate(wins) if n[w] > 1 for p in range(i, i + 5)})


def test_quality_odd(make, odd_rows):
    rows = [*odd_rows, (60, "a b c d e f a b c d e g"), (61, "a a a a a a a"), (62, "one two\none two\n\n \none two ### $x"), (63, None, None, None)]
    got = sorted(quality.judge(make(rows)).collect(), key=str)
    assert len(got) == len(rows)
    for r, t in [(next(x for x in got if x.doc_id == i), t) for i, t, *_ in rows if i is not None]:
        w = [x.decode() for x in (t or "").encode().split()]
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), repeated(w))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(w) < 10 or 100 * r.n_repeat_words > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judge(make([])).count() == 0


def test_quality_verdict(make):
    """Sketches give the exact quartiles within their error, and an outlier of its own group fails."""
    text = lambda k, n: " ".join(["ab" * k] * 1 + [f"{'x' * k}{i}" for i in range(n)])
    rows = [(i, text(4 + i % 3, 40 + i), "en", "big") for i in range(300)]
    rows += [(1000 + i, text(30 + i % 3, 40), "de", "long") for i in range(300)]
    rows += [(2000, text(30, 40), "en", "big"), (2001, " ".join(f"$$$$w{i}%%%%" for i in range(60)), "en", "big"), (2002, text(5, 40), "en", "rare"), (2003, text(30, 40), "fr", "new")]
    got = {r.doc_id: r for r in quality.judge(make(rows)).collect()}
    assert all(got[i].kept for i, *_ in rows if i < 2000)
    assert got[2000].failed == "word_length" and "symbols" in got[2001].failed
    assert got[2002].kept and got[2003].kept


def test_quality_verdicts_by_brute_force(spark, sf):
    """kept of every document by plain Python over the measured columns: bins, quartiles, fences."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality.judge(docs).collect()
    gamma = math.log(quality.GAMMA)
    value = {"symbols": lambda r: (r.n_symbols, r.word_chars), "dup_lines": lambda r: (r.n_dup_lines, r.n_lines), "word_length": lambda r: (r.word_chars, r.n_words)}
    of = lambda r, m: (lambda a, b: a / b if b else None)(*value[m](r))

    def quartile(vs, q):
        bins = sorted(-math.inf if v <= 0 else math.ceil(math.log(v) / gamma) for v in vs)
        b = bins[math.ceil(q * len(bins)) - 1]
        return 0.0 if b == -math.inf else 2 * quality.GAMMA**b / (1 + quality.GAMMA)

    def fences(m, r):
        groups = ([x for x in rows], [x for x in rows if x.lang == r.lang], [x for x in rows if x.lang == r.lang and x.source == r.source])
        qs = None
        for g in groups:
            vs = [of(x, m) for x in g if of(x, m) is not None]
            own = [quartile(vs, q) for q in (0.25, 0.75)]
            qs = own if qs is None else [(len(vs) * a + quality.SHRINK * b) / (len(vs) + quality.SHRINK) for a, b in zip(own, qs)]
        least, two = quality.MEASURES[m]
        reach = quality.REACH * max(qs[1] - qs[0], least)
        return (qs[0] - reach if two else -1.0), qs[1] + reach

    known, kept = {}, 0
    for r in rows:
        wrong = []
        for m in quality.MEASURES:
            v = of(r, m)
            if v is not None:
                key = (r.lang, r.source, m)
                low, high = known.setdefault(key, known.get(key) or fences(m, r))
                if v > high or v < low:
                    wrong.append(m)
        assert r.failed == ",".join(wrong) and r.kept == (not r.base_failed and not wrong)
        kept += r.kept
    assert 0 < kept < len(rows) and len({k[:2] for k in known}) > 20


# ---------------------------------------------------------------- op6


def filled(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, cap = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in cap]
        level = (total - sum(cap.values())) / sum(w[s] for s in free) if free else 0
        over = {s: most * sizes[s] for s in free if w[s] * level > most * sizes[s]}
        if not over:
            return {s: cap.get(s, w[s] * level) for s in order}
        cap |= over


@pytest.mark.parametrize("case", ["plain", "small source", "nulls"])
def test_mixing(make, odd_rows, case):
    n = {"plain": (30, 30, 30), "small source": (2, 60, 40), "nulls": (5, 20, 9)}[case]
    rows = [(k * 100 + i, "w " * (20 + i), "en", s) for k, (s, m) in enumerate(zip(("a", "b", None if case == "nulls" else "é"), n)) for i in range(m)]
    rows += [(i, t, "en", "odd") for i, t, *_ in odd_rows if t is None or len(t) < 10_000] if case == "nulls" else []
    df = make(rows)
    draws, docs = mixing.mix(df, block_words=8)
    got = docs.collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").encode().split())
    want = filled(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(24, 0.03 * want[s])
    again = mixing.mix(df.repartition(5), block_words=8)[1]
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    slots = [(r.shard, r.slot) for r in draws.collect()]
    assert len(set(slots)) == len(slots) and sorted(s for _, s in slots) == list(range(len(slots)))


def test_mix_holds_the_words(make, odd_rows):
    """Every drawn block has the words of its pieces, each slot one block, and documents give what the pieces hold."""
    rows = [*odd_rows, *[(100 + i, " ".join(f"d{i}w{j}" for j in range(1 + 7 * i % 50)), "en", f"s{i % 3}") for i in range(60)]]
    draws, docs = mixing.mix(make(rows), block_words=8)
    mixed = draws.collect()
    assert mixed and len({(r.shard, r.slot) for r in mixed}) == len(mixed)
    texts, given = {}, Counter()
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(re.sub("[ \t\n\x0b\x0c\r]+", " ", t or "").strip(" ").split(" "))
    for r in mixed:
        assert sum(p.words for p in r.pieces) <= 8 and [p["at"] for p in r.pieces] == np.cumsum([0, *[p.words for p in r.pieces]])[:-1].tolist()
        for p in r.pieces:
            assert any(t[p.first : p.first + p.words] == p.text.split(" ") for t in texts[p.id])
            given[p.id] += p.words
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += r.taken
    assert +given == +want


def test_mixing_empty(make):
    assert mixing.mix(make([]))[1].count() == 0
    assert [r.taken for r in mixing.mix(make([(1, None), (2, "")]))[1].collect()] == [0, 0]


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long"))).collect()]
        assert sorted(got) == list(range(n))


# ---------------------------------------------------------------- op8


def test_toxicity_learns(spark, make):
    rng = np.random.default_rng(2)
    rows, marks = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = [f"w{k}" for k in rng.integers(0, 300, 40)]
        if bad:
            w[int(rng.integers(40))] = "NASTY!"
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.learn(make(rows), labels.where("doc_id % 7 <> 0"))
    got = toxicity.score(make(rows), model).where("doc_id % 7 = 0").collect()
    assert np.mean([(r.toxicity >= 0.5) == (r.doc_id % 5 == 0) for r in got]) >= 0.97
    assert len(model[1]) < 2000


def test_toxicity_by_brute_force(spark, make):
    """The learner with a plain table of named features, one row at a time, gives the same scores."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        w = [f"w{k}" for k in rng.integers(0, 60, int(rng.integers(1, 25)))]
        if i % 4 == 0:
            w.insert(int(rng.integers(len(w))), "Bad!")
        rows.append((i, " ".join(w)))
    marks = [(i, int(i % 4 == 0)) for i, _ in rows]
    df = make(rows)
    model = toxicity.learn(df, spark.createDataFrame(marks, "doc_id long, toxic int"))
    got = {r.doc_id: r.toxicity for r in toxicity.score(df, model).collect()}

    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        return sorted({(x,) for x in w} | set(zip(w, w[1:])) | {(a, "", b) for a, b in zip(w, w[2:])})

    def hashed(i):
        h = xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42)
        return h - (h >> 63 << 64)

    order = sorted(range(len(rows)), key=lambda i: hashed(rows[i][0]))
    seen = [(marks[i][1], features(rows[i][1])) for i in order]
    z, n, bias = {}, {}, [0.0, 0.0]
    A, B, L1, L2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    weight = lambda f: 0.0 if abs(z.get(f, 0)) <= L1 else -(z[f] - math.copysign(L1, z[f])) / ((B + math.sqrt(n[f])) / A + L2)
    free = lambda: -bias[0] * A / (B + math.sqrt(bias[1]))
    for epoch in range(toxicity.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(seen)):
            y, fs = seen[i]
            w, own = {f: weight(f) for f in fs}, free()
            g = 1 / (1 + math.exp(-(sum(w.values()) + own))) - y
            for f in fs:
                m = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(m + g * g) - math.sqrt(m)) / A * w[f]
                n[f] = m + g * g
            bias[0] += g - (math.sqrt(bias[1] + g * g) - math.sqrt(bias[1])) / A * own
            bias[1] += g * g
    for i, t in rows:
        want = 1 / (1 + math.exp(-(sum(weight(f) for f in features(t)) + free())))
        assert abs(got[i] - want) < 2e-3


def test_rare_features_are_learned(spark, make):
    """A feature in four toxic rows alone outgrows L1."""
    rows = [(i, f"plain w{i} text" if i >= 4 else f"rareword w{i} text") for i in range(404)]
    labels = spark.createDataFrame([(i, int(i < 4)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.learn(make(rows), labels)
    scores = {r.doc_id: r.toxicity for r in toxicity.score(make(rows), model).collect()}
    assert min(scores[i] for i in range(4)) > 10 * max(scores[i] for i in range(4, 404))


def test_toxicity_odd(spark, make, odd_rows):
    labels = spark.createDataFrame([(1, 1), (4, None), (5, 0), (5, 1), (None, 1), (99, 0), (6, 0)], "doc_id long, toxic int")
    df = make(odd_rows)
    got = toxicity.score(df, toxicity.learn(df, labels))
    assert got.columns == [*df.columns, "toxicity"] and got.count() == len(odd_rows)
    assert all(0 <= r.toxicity <= 1 for r in got.collect())
    none = toxicity.learn(df, labels.limit(0))
    assert max(r.toxicity for r in toxicity.score(df, none).collect()) < 1e-9
    assert toxicity.score(make([]), none).count() == 0


def test_training_takes_memory_by_what_occurs():
    """The learner's state grows with the features that occur, and its weights are those of a state for all hashes."""
    import tracemalloc

    from quillspark.llm import toxicity

    rng = np.random.default_rng(3)
    rows = [(int(i % 3 == 0), np.unique(np.append(rng.integers(0, 1 << toxicity.BITS, 20), [7, 99] if i % 3 == 0 else [11])).astype(np.uint32)) for i in range(300)]
    tracemalloc.start()
    bias, keys, weights = toxicity.train(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 << 20 and (np.diff(keys.astype(np.int64)) > 0).all() and {7, 99, 11} <= set(keys.tolist())
    assert weights[keys == 7][0] > 0 > weights[keys == 11][0] and len(weights) == len(keys) and np.isfinite(bias)
