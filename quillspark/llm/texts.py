"""Column expressions shared by the native operators."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of whitespace words, as characters and as a pattern.
SPACE_CHARS, SPACE = " \t\n\x0b\f\r", r"[\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(c, UPPER, LOWER)


def space_words(c: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; empty for null."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE), "")


def n_space_words(c: Column) -> Column:
    return F.size(space_words(c)).cast("long")


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most_rows: int = 50_000) -> DataFrame:
    """big joined with a written table; broadcast only after counting it, a shuffle join beyond most_rows."""
    return big.join(F.broadcast(small) if small.count() <= most_rows else small, on, how)
