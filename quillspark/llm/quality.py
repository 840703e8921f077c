"""Operator 9 [native]: quality rules with adaptive thresholds.

Each text is measured in one pass of column expressions. Fixed base rules fail
a document first. The verdict on the rest comes from thresholds that adapt to
each language and source: a log-binned quantile sketch of every measure
(relative error 1 %; bins merge by adding counts, so map-side sums are small
whatever a source's share) gives quartiles, and the fences are the quartiles
plus or minus REACH times their distance, of which a least width is assumed.
Quartiles of every language and source come from its own sketch, drawn towards
those of its language by SHRINK documents' weight, and a language's are drawn
towards those of all documents alike; so a group of any size has thresholds of
its own, and the fewer documents it has, the nearer they are to its parent's. The
wider sketches are merged from the same bins. Fences are joined back to the
measures.

Words are `[^\\x20\\x09-\\x0D]+`. Defined cases: a null or empty text has no
words and fails the base rules; null languages and sources are groups of their
own; repeated rows count each time; texts of any length are measured whole; an
empty table gives no rows; further columns are passed over.
"""
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.session import cut
from quillspark.llm.texts import SPACE_CHARS, join_small, space_words

#: Characters that count as symbols, and words of the window that may repeat.
SYMBOLS, RUN = "#*$%&|<>", 5
#: Base rules: least words, most percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Ratio of a sketch's neighbouring bins, distance of the fences, documents that a wider sketch counts for.
GAMMA, REACH, SHRINK = 1.02, 3.0, 50
#: Measures: least quartile distance, whether low values fail too.
MEASURES = {"symbols": (0.05, False), "dup_lines": (0.15, False), "word_length": (0.75, True)}
_ZERO = -1_000_000
_NONE = "\x00none"


def repeat_words(words: Column, run: int = RUN) -> Column:
    """Words of an array (a plain column) that lie in windows of `run` words found twice or more in it."""
    at = F.sequence(F.lit(0), F.size(words) - run)
    hashed = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(run)])
    hashes = F.transform(at, hashed)
    # only where a hash occurs twice: sort (hash, place), keep places that equal a neighbour, add up their cover
    pairs = F.sort_array(F.transform(at, lambda i: F.struct(hashed(i).alias("h"), i.alias("p"))))
    kept = lambda q: F.transform(q, lambda x, i: F.when((x["h"] == F.get(q, i - 1)["h"]) | (x["h"] == F.get(q, i + 1)["h"]), x["p"]))
    places = F.sort_array(F.get(F.transform(F.array(pairs), lambda q: F.filter(kept(q), lambda p: p.isNotNull())), F.lit(0)))
    total = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-run).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(run), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total).otherwise(0)


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, lang, source and the measures of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit(_NONE)).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit(_NONE)).alias("source"), text.alias("t"), space_words(text).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    chars = F.char_length("t")
    out = out.withColumn("lines", lines)
    out = out.select(
        "id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.translate("t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (chars - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.size("w") > RUN, repeat_words(F.col("w"))).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def _values() -> dict[str, Column]:
    """A document's value of each measure; null without words."""
    return {"symbols": F.try_divide("n_symbols", "word_chars"), "dup_lines": F.try_divide("n_dup_lines", "n_lines"), "word_length": F.try_divide("word_chars", "n_words")}


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: the sketch of each language and source. Adding n over a key merges sketches."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("double").alias("v")) for k, v in _values().items()])).alias("m")
    bin_ = F.when(F.col("m.v") <= 0, _ZERO).otherwise(F.ceil(F.log("m.v") / math.log(GAMMA))).cast("int")
    return measured.select("lang", "source", pairs).where("m.v is not null").groupBy("lang", "source", F.col("m.measure").alias("measure"), bin_.alias("bin")).agg(F.count("*").alias("n"))


def fences(bins: DataFrame) -> DataFrame:
    """low and high of each measure for each language and source."""
    from pyspark.sql import Window

    def quartiles(keys: list[str]) -> DataFrame:
        merged = bins.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
        # at most some thousand bins in a window: values of doubles at this ratio
        ahead = Window.partitionBy(*keys, "measure").orderBy("bin")
        total = Window.partitionBy(*keys, "measure")
        run = merged.select("*", F.sum("n").over(ahead).alias("upto"), F.sum("n").over(total).alias("rows"))
        value = F.when(F.col("bin") == _ZERO, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), "bin") / (1 + GAMMA))
        at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), value))
        return run.groupBy(*keys, "measure").agg(F.first("rows").alias("rows"), at(0.25).alias("q1"), at(0.75).alias("q3"))

    own = quartiles(["lang", "source"])
    wider = quartiles(["lang"]).select("lang", "measure", *[F.col(c).alias(f"l_{c}") for c in ("rows", "q1", "q3")])
    widest = quartiles([]).select("measure", *[F.col(c).alias(f"g_{c}") for c in ("q1", "q3")])
    both = own.join(wider, ["lang", "measure"]).join(F.broadcast(widest), "measure")  # a row for each measure
    drawn = lambda n, near, far: (F.col(n) * F.col(near) + SHRINK * far) / (F.col(n) + SHRINK)
    pick = lambda c: drawn("rows", c, drawn("l_rows", f"l_{c}", F.col(f"g_{c}"))).alias(c)
    both = both.select("lang", "source", "measure", pick("q1"), pick("q3"))
    out = []
    for k, (least, two) in MEASURES.items():
        reach = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        mine = F.col("measure") == k
        out += [F.max(F.when(mine, F.col("q3") + reach)).alias(f"{k}_high"), F.max(F.when(mine, F.col("q1") - reach if two else F.lit(-1.0))).alias(f"{k}_low")]
    return both.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, measures, base_failed, failed (the measures out of their fences, joined by `,`) and kept of each row."""
    measured = cut(measure(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col))
    limits = cut(fences(sketches(measured)), 4)
    both = join_small(measured, limits, ["lang", "source"], "left")
    wrong = F.concat_ws(",", *[F.when((v > F.col(f"{k}_high")) | (v < F.col(f"{k}_low")), F.lit(k)) for k, v in _values().items()])
    out = both.withColumn("failed", wrong)
    back = lambda c: F.nullif(F.col(c), F.lit(_NONE)).alias(c)
    return out.select(F.col("id").alias(id_col), back("lang"), back("source"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed", "failed", (~F.col("base_failed") & (F.col("failed") == "")).alias("kept"))
