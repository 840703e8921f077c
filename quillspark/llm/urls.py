"""Operator 10 [native]: URL filters by rules and a logistic regression.

Explicit rules come first: a rule is (verdict, host, path); it fits a url whose
host is the rule's or a subdomain of it and whose path starts with the rule's;
the longest fitting rule wins. All other urls are judged by a logistic
regression on the distinct hashed character n-grams of host and path, trained
from a small labelled table. Host and path are scaled each by itself, and the
host counts for more, so that a long path does not drown its host. Scoring is a chain of column expressions over one
scan; the weights are an array literal of fixed size.

Defined cases: a null url or one without `://` has an empty host and path, fits
no rule and gets the model's verdict for them (its intercept); long urls are
taken whole (n-grams come from one linear pass); repeated rows are judged one by
one; an empty table gives no rows, an empty labelled table a score of a half;
further columns stay; those that are named like a column of the result (host, path,
rule, block_score, verdict) stay under `input_` and their name.
"""
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.texts import ascii_lower

#: Buckets of the feature hash, lengths of n-grams, most labelled rows.
BUCKETS, SIZES, MOST_ROWS = 2048, (3, 4), 5000
#: Full-batch descent: steps, rate, momentum, L2 strength; how much host and path count.
STEPS, RATE, MOMENTUM, L2, SCALE = 150, 3.0, 0.95, 1e-4, (1.0, 0.3)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({_sql(url)}, instr({_sql(url)}, '://') + 3)")).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({_sql(url)}, instr({_sql(url)}, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _sql(c: Column) -> str:
    return f"`{c._jc.toString()}`"


def grams(part: Column, mark: str) -> Column:
    """Distinct hash buckets of the n-grams of a host (mark h) or a path (p)."""

    def hashed(n: int) -> Column:
        each = F.regexp_extract_all(F.concat(F.lit("^"), part, F.lit("$")), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        # of one argument: a second one would be the place of the n-gram
        return F.transform(each, lambda g: F.pmod(F.xxhash64(F.lit(mark), g), F.lit(BUCKETS)).cast("int"))

    return F.array_distinct(F.concat(*map(hashed, SIZES)))


def train(labelled: DataFrame, *, url_col: str = "url", label_col: str = "block") -> tuple[float, list[float]]:
    """Intercept and bucket weights from labelled urls (block: 0 or 1), the first MOST_ROWS of them by a hash."""
    u = labelled.select(F.col(url_col).alias("u"), F.col(label_col).cast("int").alias("y")).where("y is not null")
    rows = u.select("y", grams(host_of(F.col("u")), "h").alias("h"), grams(path_of(F.col("u")), "p").alias("p"), F.xxhash64("u").alias("o"), "u").orderBy("o", "u", "y").limit(MOST_ROWS).collect()
    data = []
    for y, h, p in sorted((r.y, tuple(sorted(r.h)), tuple(sorted(r.p))) for r in rows):
        data.append((y, [(i, c / math.sqrt(max(1, len(g)))) for g, c in zip((h, p), SCALE) for i in g]))
    w, bias = [0.0] * BUCKETS, 0.0
    speed, push = [0.0] * BUCKETS, 0.0
    for _ in range(STEPS if data else 0):
        slope, drift = [L2 * x for x in w], 0.0
        for y, g in data:
            e = (1 / (1 + math.exp(-max(-35.0, min(35.0, bias + sum(w[i] * x for i, x in g))))) - y) / len(data)
            drift += e
            for i, x in g:
                slope[i] += e * x
        push = MOMENTUM * push - RATE * drift
        speed = [MOMENTUM * v - RATE * b for v, b in zip(speed, slope)]
        bias += push
        w = [a + v for a, v in zip(w, speed)]
    return bias, w


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: tuple[float, list[float]], *, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, block_score and verdict at the end; columns of pages that are so named stay under `input_` and their name."""
    bias, weights = model
    held = F.array(*[F.lit(float(x)) for x in weights])
    names = pages.schema.names
    out = pages.toDF(*[f"c{i}" for i in range(len(names))])
    url = F.col(f"c{names.index(url_col)}")
    out = out.withColumn("host", F.coalesce(host_of(url), F.lit(""))).withColumn("path", F.coalesce(path_of(url), F.lit("")))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    part = lambda c: F.aggregate(c, F.lit(0.0), lambda a, g: a + F.get(held, g)) / F.sqrt(F.greatest(F.size(c), F.lit(1)))
    out = out.withColumn("h", grams(F.col("host"), "h")).withColumn("p", grams(F.col("path"), "p"))
    margin = F.lit(bias) + SCALE[0] * part("h") + SCALE[1] * part("p")
    out = out.withColumn("rule", rule).withColumn("block_score", 1 / (1 + F.exp(-margin)))
    out = out.withColumn("verdict", F.coalesce(ruled, F.when(F.col("block_score") >= threshold, "block").otherwise("allow")))
    new = ["host", "path", "rule", "block_score", "verdict"]
    return out.select(*[F.col(f"c{i}").alias(f"input_{c}" if c in new else c) for i, c in enumerate(names)], *new)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A small labelled table: addresses of a kind to block, and of a kind to keep. Both have the same ends, subdomains and, mostly, paths, so what tells them apart is their names."""
    # fixed values
    bad = "casino poker slots gambling betting jackpot roulette lottery bingo viagra pills pharma meds adult porn xxx sex cams escort hentai nude dating loans payday crack keygen warez torrent spam prize bonus winner replica cheap".split()
    good = "docs library college news journal wiki archive science forum museum shop city maps music garden school weather recipes travel books history health sport open data code photo art radio film family bank market office garage farm river mountain studio design energy law".split()
    extra_bad, extra_good = "win free online hot best live x 24 now club".split(), "guide home world center group lab team daily hub project".split()
    shared = ("/", "/about", "/en/{}", "/fr/{}.html", "/de/{}", "/es/{}", "/en/25930", "/2024/05/{}", "/page/{}.html", "/articles/25930", "/index.php")
    own = {1: ("/win/{}-now", "/buy-{}", "/free/{}.exe"), 0: ("/research/{}.html", "/guide/{}", "/wiki/{}")}
    ends = ("com", "net", "org", "info", "example.com", "example.org", "example.net", "co.uk", "biz", "tv")
    subs = ("", "", "www.", "m.", "blog.", "en.")
    neutral = ("index", "item", "story", "part", "view", "list", "entry")
    rows = []
    for words, extra, block in ((bad, extra_bad, 1), (good, extra_good, 0)):
        for i, a in enumerate(words):
            for k in range((24, 12)[block]):  # most addresses are of the kind to keep
                n = i * 37 + k * 11
                b = words[(i + 3 * k + 1) % len(words)] if k % 3 == 0 else extra[n % len(extra)]
                host = (f"{a}-{b}", f"{b}{a}", f"{a}{b}", a)[k % 4]
                if k >= 12:  # names that mean nothing
                    c = words[(i * 5 + k * 7) % len(words)]
                    host = (a[:3] + c[-3:], c[-3:] + a[:2], a[-4:] + c[:3], a[:2] + c[:2] + b[-2:])[k % 4]
                path = (own[block] if k % 5 == 4 else shared)[n % (len(own[block]) if k % 5 == 4 else len(shared))]
                rows.append((f"http{'s' * (n % 2)}://{subs[(n // 3) % len(subs)]}{host}.{ends[(n // 2) % len(ends)]}{path.format(neutral[n % len(neutral)])}", block))
    return spark.createDataFrame(sorted(set(rows)), "url string, block int")
