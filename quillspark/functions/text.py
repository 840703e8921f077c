"""Markdown, URL and sentence rules as column expressions.

Patterns use explicit classes, so that Unicode words and white space mean the
same in every regex engine.
"""
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]"
#: Fences of backticks, and those of tildes after the last of them.
FENCE = r"(?s)```.*?```|(?=~~~)(?!.*```.*?```)~~~.*?~~~"
_TICKS = "`" * 3

# Documentation directory names, index file names, admonition tags and their labels, abbreviations.
DOC_DIRS = ("docs", "site", "content", "src", "source", "en")
INDEX_NAMES = ("index", "readme", "_index")
ADMONITIONS = {"Tip": "**Tip:**", "Note": "**Note:**", "Warning": "**Warning:**"}
ABBREVIATIONS = ("Mr.", "Ms.", "Mrs.", "Dr.", "Prof.", "Fig.", "Eq.", "vs.", "No.", "e.g.", "i.e.", "cf.", "etc.")


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c) with c worked out once, however often body uses it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Composed Unicode (NFC); Spark has no function for it."""
    return F.pandas_udf(_composed, T.StringType())(c)


def strip(c: Column) -> Column:
    """White space off both ends, line feeds too."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Runs of blanks to one, three line feeds or more to two, ends stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD + "+")).cast("long")


def has_code(c: Column) -> Column:
    return c.contains(_TICKS)


def has_table(c: Column) -> Column:
    """Whether a header separator row occurs."""
    return c.rlike(r"(?m)^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$")


def front_matter(c: Column) -> Column:
    """What stands between the leading dashes; empty without."""
    return F.regexp_extract(c, r"(?s)^\s*---[ \t]*\n(.*?)\n---[ \t]*(\n|$)", 1)


def without_front_matter(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\A\s*---[ \t]*\n.*?\n---[ \t]*(\n|\z)", "")


def first_h1(c: Column) -> Column:
    """The first level-one heading without tags and backticks; null if none or blank."""
    raw = F.regexp_extract(c, r"(?m)^[ \t]*#[ \t]+(.+?)[ \t]*$", 1)
    return F.nullif(strip(F.replace(F.regexp_replace(raw, r"<[^>]+>", ""), F.lit("`"), F.lit(""))), F.lit(""))


def front_matter_title(c: Column) -> Column:
    """The title of the front matter, else its sidebar label; quotes off."""
    found = lambda key: F.nullif(strip(F.regexp_extract(front_matter(c), rf"(?m)^{key}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)), F.lit(""))
    return F.coalesce(found("title"), found("sidebar_label"))


def title_from_path(path: Column) -> Column:
    """File name, or its directory's for index files, with blanks for `_` and `-`, first letter raised."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(.)\.[^.]*$", "$1")
    name = F.when(F.lower(stem).isin(*INDEX_NAMES) & (F.size(parts) > 1), F.element_at(parts, F.when(F.size(parts) > 1, -2).otherwise(-1))).otherwise(stem)
    plain = strip(F.regexp_replace(F.regexp_replace(name, "[_-]", " "), r"\s+", " "))
    return F.when(F.coalesce(plain, F.lit("")) == "", F.lit("Document")).otherwise(F.concat(F.upper(F.left(plain, F.lit(1))), F.substring(plain, 2, 1_000_000)))


def section_from_path(path: Column) -> Column:
    """`/a/b/` of the first two directories, documentation roots left out."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~F.lower(x).isin(*DOC_DIRS))
    dirs = F.slice(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), 1, 2)
    return F.when(F.size(dirs) > 0, F.concat(F.lit("/"), F.array_join(dirs, "/"), F.lit("/"))).otherwise("/")


def strip_markup(c: Column) -> Column:
    """Admonition tags become bold labels; import and export lines and other tags go."""
    out = c
    for tag, label in ADMONITIONS.items():
        out = F.regexp_replace(F.regexp_replace(out, f"(?i)<{tag}[^>]*>", f"\n{label} "), f"(?i)</{tag}>", "\n")
    out = F.regexp_replace(out, r"(?m)^[ \t]*(import|export)\b.*$", "")
    return F.regexp_replace(out, r"</?[A-Za-z][A-Za-z0-9_.-]*(\s+[^<>]*)?/?>", "")


def outside_code(c: Column, rule) -> Column:
    """A rule applied to what stands outside of fences; fences stay as they are."""

    def joined(whole: Column) -> Column:
        plain = F.transform(F.split(whole, FENCE), rule)
        fences = F.regexp_extract_all(whole, F.lit(FENCE), F.lit(0))
        return F.array_join(F.flatten(F.zip_with(plain, fences, lambda p, f: F.array(F.coalesce(p, F.lit("")), F.coalesce(f, F.lit(""))))), "")

    return let(c, joined)


# Values of tabs, the preferred first.
TAB_VALUES = ("pip", "python", "pt", "bash", "conda", "source")
_TABS = r"(?i)<Tabs[^>]*>([^<]*+(?:<(?!/?Tabs[\s>/])[^<]*+)*+)</Tabs>"
_TAB = r"(?is)<TabItem[^>]*\bvalue=[\"']([^\"']+)[\"'][^>]*>(.*?)</TabItem>"


def chosen_tabs(c: Column, depth: int = 3) -> Column:
    """Each block of tabs replaced by the stripped body of one: that of the most preferred value, the first of equals; a block without tabs by what it holds.

    Innermost blocks are decided first, so tabs within tabs are whole; blocks deeper than `depth` stay.
    """

    def best(inner: Column) -> Column:
        values, bodies = F.regexp_extract_all(inner, F.lit(_TAB), F.lit(1)), F.regexp_extract_all(inner, F.lit(_TAB), F.lit(2))
        place = lambda v: F.array_position(F.array(*map(F.lit, TAB_VALUES)), v)
        rank = F.transform(values, lambda v, i: F.struct(F.when(place(v) > 0, place(v)).otherwise(999).alias("p"), i.alias("i")))
        return F.when(F.size(values) > 0, strip(F.get(bodies, F.array_min(rank)["i"]))).otherwise(inner)

    def once(whole: Column) -> Column:
        plain, blocks = F.split(whole, _TABS), F.transform(F.regexp_extract_all(whole, F.lit(_TABS), F.lit(1)), best)
        return F.array_join(F.flatten(F.zip_with(plain, blocks, lambda p, b: F.array(F.coalesce(p, F.lit("")), F.coalesce(b, F.lit(""))))), "")

    out = c
    for _ in range(depth):
        out = F.when(out.rlike(_TABS), let(out, once)).otherwise(out)
    return out


def normalize_markdown(c: Column) -> Column:
    """Markup stripped and white space tidied outside of fences."""
    tidy = lambda p: F.regexp_replace(F.regexp_replace(strip_markup(p), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return strip(outside_code(c, tidy))


EMOJI = r"[\x{1F1E6}-\x{1FAFF}\x{2700}-\x{27BF}\x{2600}-\x{26FF}\x{FE0F}\x{200D}\x{1F3FB}-\x{1F3FF}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def preprocess(c: Column) -> Column:
    """Text ready for cutting into chunks: no licence comment, no leading heading, emoji or control characters; joined hyphenation; `•` bullets; one line feed at the end."""

    def headless(head: Column) -> Column:
        # the first heading goes only from what stands before the first fence
        def without(first: Column) -> Column:
            return F.concat(F.regexp_replace(first, r"(?m)(?s:\A((?:(?!^[ \t]*#[ \t]).)*?))^[ \t]*#[ \t]+.+\n+", "$1"), F.substring(head, F.char_length(first) + 1, F.char_length(head)))

        return let(F.element_at(F.split(head, FENCE, 2), 1), without)

    def tidy(p):
        p = F.regexp_replace(F.regexp_replace(p, EMOJI, ""), CONTROL, "")
        p = F.regexp_replace(F.regexp_replace(F.replace(p, F.lit("\u00a0"), F.lit(" ")), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
        p = F.regexp_replace(p, rf"({WORD}+)-\n({WORD}+)", "$1$2")
        return F.regexp_replace(p, r"(?m)^\s*([-*]|\d+\.)\s+", "\n• ")

    body = let(F.regexp_replace(c, r"(?s)\A\s*<!--.*?-->[ \t]*\n?", ""), headless)
    out = let(strip(outside_code(body, tidy)), lambda t: F.when(t == "", "").otherwise(F.concat(t, F.lit("\n"))))
    return F.when(c.rlike(r"\S"), out).otherwise(c)


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits, all else as single dashes."""
    flat = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(flat, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def last_heading_anchor(c: Column) -> Column:
    """Slug of the last heading of level two or three; null if none."""
    found = F.regexp_extract_all(c, F.lit(r"(?m)^[ \t]*#{2,3}[ \t]+(.+?)[ \t]*$"), F.lit(1))
    return F.when(F.size(found) > 0, slug(F.element_at(found, -1)))


def sentences(c: Column) -> Column:
    """Sentences: cut after `.!?` before a blank run and an ASCII capital, quote or bracket, at blank lines and at `•` items; abbreviations do not end one."""
    hold, cut = "\u222f", "\u241e"
    safe = c
    for a in ABBREVIATIONS:
        safe = F.replace(safe, F.lit(a), F.lit(a.replace(".", hold)))
    safe = F.regexp_replace(safe, r"([.!?]) *([A-Z\"'(\[])", f"$1{cut}$2")
    safe = F.regexp_replace(F.regexp_replace(safe, r"\n\n+", cut), r"(^|\n|" + cut + ")• ?", f"$1{cut}")
    return F.filter(F.transform(F.split(safe, cut), lambda s: strip(F.replace(s, F.lit(hold), F.lit(".")))), lambda s: s != "")


def length_bucket(n: Column, width: int = 1000) -> Column:
    """`a-b` of the width that holds n."""
    low = F.floor(n / width) * width
    return F.concat(low.cast("string"), F.lit("-"), (low + width).cast("string"))


def section_key(section: Column, url: Column, product: Column) -> Column:
    """First part of the section, else the url's authority, else the product, else root."""
    part = F.when(section != "", F.element_at(F.split(F.trim(section, F.lit("/")), "/"), 1))
    return F.coalesce(part, F.nullif(F.regexp_extract(url, r"^\w+://([^/]+)/", 1), F.lit("")), F.nullif(product, F.lit("")), F.lit("root"))


def normalize_query(c: Column) -> Column:
    """Composed Unicode, lower-case, white space collapsed and stripped."""
    return strip(F.regexp_replace(F.lower(nfc(c)), r"\s+", " "))


def shortened(c: Column, n: int, mark: str = "...") -> Column:
    """At most n characters, the mark included."""
    return F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n - len(mark))), F.lit(mark))).otherwise(c)


def n_tokens(c: Column, empty: int = 0) -> Column:
    """Estimated tokens: a quarter of the characters, at least one; an empty text has `empty`."""
    return F.when(F.char_length(c) == 0, F.lit(empty)).otherwise(F.greatest(F.lit(1), F.floor(F.char_length(c) / 4))).cast("long")


def n_tokens_by(c: Column, tokenizer: str) -> Column:
    """Tokens of a text by a public tokenizer's file (JSON); 0 of null or empty. The estimate of n_tokens() needs no Python."""
    with open(tokenizer, encoding="utf-8") as f:
        raw = f.read()

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        held = Tokenizer.from_str(raw)
        held.encode_special_tokens = True  # their names in a text are text
        for texts in batches:
            yield pd.Series([len(e.ids) for e in held.encode_batch([t or "" for t in texts], add_special_tokens=False)], dtype="int64")

    return F.pandas_udf(counted, T.LongType())(c)
