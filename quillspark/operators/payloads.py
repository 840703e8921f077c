"""Payloads of chunks, parents and points: texts, metadata, defaults, and checks of rows."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import ids
from quillspark.functions.text import strip

# Fields that may hold a point's text, in order; fields that are no metadata; fields of a document that its chunks take over.
TEXT_FIELDS = ("_preview", "text", "content", "chunk_text", "body", "description", "summary", "title")
INNER_FIELDS = ("vector", "embedding", "_preview")
DOCUMENT_FIELDS = ("product", "product_code", "version", "lang", "title", "section", "repo_path", "url", "canonical_url")
#: Characters of a preview, and of a parent that is worth a vector at least.
PREVIEW, LEAST_PARENT = 1000, 80
#: Characters of a system prompt, of a user's prompt, of a question to tables and to documents at most.
SYSTEM_PROMPT, USER_PROMPT, TABLE_QUESTION, DOCUMENT_QUESTION = 10_000, 50_000, 1000, 2000


def filled(c: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(c.rlike(r"\S"), F.lit(False))


def point_text(payload: Column) -> Column:
    """The first filled text field of a payload map, stripped; empty if none."""
    return F.coalesce(*[F.when(filled(payload[k]), strip(payload[k])) for k in TEXT_FIELDS], F.lit(""))


def point_metadata(payload: Column, extra: Column) -> Column:
    """A payload map without vectors and inner fields, `extra` (a map, or null) flat over it."""
    more = F.coalesce(extra, F.create_map().cast("map<string,string>"))
    own = F.map_filter(payload, lambda k, _: ~k.isin(*INNER_FIELDS, "extra") & ~k.startswith("_") & ~F.map_contains_key(more, k))
    return F.map_concat(own, more)


def meta_field(meta: Column, extra: Column, name: str) -> Column:
    """A field of a metadata map, else of its extra map; `h_path` and `heading_path` are one field."""
    names = ("h_path", "heading_path") if name in ("h_path", "heading_path") else (name,)
    return F.coalesce(*[m[n] for m in (meta, extra) for n in names])


def with_document_fields(chunks: DataFrame, docs: DataFrame, *, document: str = "document_id", key: str = "document_id") -> DataFrame:
    """chunks with extra, a map of their document's filled fields and its id. One join by document."""
    have = [c for c in DOCUMENT_FIELDS if c in docs.columns]
    fields = F.map_from_entries(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c), F.col(c).cast("string"))) for c in have], F.struct(F.lit("document_id"), F.col(key).cast("string")))))
    side = docs.select(F.col(key).cast("string").alias("own_document"), fields.alias("extra"))
    return chunks.join(side, chunks[document].cast("string") == F.col("own_document"), "left").drop("own_document")


def point_payload(rows: DataFrame, text: str, *, kind: str, key: str, prefix: Column) -> DataFrame:
    """rows with _preview, kind, and the key column (chunk_id or parent_id) filled where it is missing."""
    seq = F.col("seq") if "seq" in rows.columns else F.lit(None).cast("int")
    own = F.col(key) if key in rows.columns else F.lit(None).cast("string")
    known = F.col("kind") if "kind" in rows.columns else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    return rows.withColumns({key: ids.resolved_chunk_id(none, own, seq, F.col(text), prefix), "kind": F.coalesce(known, F.lit(kind)), "_preview": F.left(F.coalesce(F.col(text), F.lit("")), F.lit(PREVIEW))})


def long_parents(parents: DataFrame, text: str = "text") -> DataFrame:
    """Parents of LEAST_PARENT characters or more."""
    return parents.where(F.char_length(strip(F.col(text))) >= LEAST_PARENT)


def required(rows: DataFrame, *fields: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose fields are all filled, trimmed; the others with error, the names of the fields that are not)."""
    missing = F.concat_ws(",", *[F.when(~filled(F.col(c)), F.lit(c)) for c in fields])
    good = rows.where(missing == "").select(*[strip(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])
    return good, rows.select("*", missing.alias("error")).where("error <> ''")


def cited(citations: DataFrame, *, query: str, n: str, text: str, id_: str) -> DataFrame:
    """Citations with a text; those without an id are `citation_n`."""
    return citations.where(filled(F.col(text))).withColumn(id_, F.coalesce(F.nullif(F.col(id_).cast("string"), F.lit("")), F.concat(F.lit("citation_"), F.col(n).cast("string"))))


def prompt_fits(prompt: Column, most: int) -> Column:
    """Whether a prompt is filled and not longer than `most` characters."""
    return filled(prompt) & (F.char_length(prompt) <= most)


def person_errors(name: Column, role: Column, email: Column, years: Column) -> Column:
    """What is wrong with a person's row, joined by `;`: name of 1..100 characters, role of 1..50, an e-mail with a dotted domain, no negative years. Null e-mail and years are right."""
    domain = F.substring_index(F.lower(strip(email)), "@", -1)
    checks = {
        "name": filled(name) & (F.char_length(strip(name)) <= 100),
        "role": filled(role) & (F.char_length(strip(role)) <= 50),
        "email": email.isNull() | (email.contains("@") & domain.contains(".")),
        "years": years.isNull() | (years >= 0),
    }
    return F.concat_ws(";", *[F.when(~ok, F.lit(k)) for k, ok in checks.items()])
