"""Hashes and identifiers as column expressions."""
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The RFC 4122 namespace of URLs, as hex.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def text_hash(text: Column) -> Column:
    """SHA-256 hex of a text."""
    return F.sha2(text, 256)


def short_hash(text: Column, n: int = 8) -> Column:
    return F.left(F.sha2(text, 256), F.lit(n))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def document_id(*candidates: Column) -> Column:
    """The first candidate that is not empty with forward slashes and none at its ends. Blanks count as text."""
    return F.coalesce(*[F.nullif(F.trim(F.replace(c, F.lit("\\"), F.lit("/")), F.lit("/")), F.lit("")) for c in candidates])


def composite_id(*parts: Column) -> Column:
    """Parts joined by `_`; those without a value are passed over."""
    return F.concat_ws("_", *[F.nullif(p.cast("string"), F.lit("")) for p in parts])


def resolved_chunk_id(extra: Column, own: Column, seq: Column, text: Column, prefix: Column) -> Column:
    """The chunk id of the extra fields, else the row's own, else `prefix__seqN__digest` (without the number where there is none), with 8 hex digits of the text's SHA-1."""
    digest = F.left(F.sha1(F.coalesce(text, F.lit(""))), F.lit(8))
    made = F.concat_ws("__", prefix, F.concat(F.lit("seq"), seq.cast("string")), digest)
    return F.coalesce(F.nullif(extra, F.lit("")), F.nullif(own, F.lit("")), made)


def uuid5_of_parts(parts: list[Column], seq: Column, text: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version-5 UUID of parts joined by `|`, with the sequence number, or 16 hex digits of the text's SHA-256 where there is none."""
    tail = F.coalesce(seq.cast("string"), F.left(F.sha2(F.coalesce(text, F.lit("")), 256), F.lit(16)))
    return uuid5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], tail), namespace)


def text_mark(text: Column) -> Column:
    """16 hex digits of a text's SHA-1."""
    return F.left(F.sha1(text), F.lit(16))


def chunk_id(document: Column, seq: Column, text: Column | None = None, mark: Column | None = None) -> Column:
    """document_seq_mark, with the mark of a text, or a mark taken before (so that texts need not be sorted for seq)."""
    return F.concat_ws("_", document, seq.cast("string"), text_mark(text) if mark is None else mark)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based UUID (version 5) of a UTF-8 string."""
    hexes = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    at = lambda start, n: F.substring(hexes, start, n)
    # the variant bits replace the two high bits of this digit
    top = F.get(F.array(*[F.lit("89ab"[i % 4]) for i in range(16)]), F.conv(at(17, 1), 16, 10).cast("int"))
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-"), top, at(18, 3), F.lit("-"), at(21, 12))
