"""Readers and writers of documents, chunks and points."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import ids, text

DOCUMENT = """text string, source_ref string, meta struct<product:string, product_code:string, version:string, lang:string, url:string,
  canonical_url:string, title:string, section:string, anchor:string, content_type:string, source_format:string, source_kind:string,
  repo_remote:string, repo_commit:string, repo_path:string, hash_raw:string, hash_text:string, content_length_chars:int, content_words:int,
  has_tables:boolean, has_code_blocks:boolean, extra:map<string,string>>"""
LEAST_CHARS = 10


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def glob_pattern(glob: str) -> str:
    """A regular expression for a path below the root: `**/` any directories, `*` and `?` inside of one."""
    import re

    out = ""
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def read_files(spark: SparkSession, root: str, include: str | list[str] = "*.md*", exclude: str | list[str] | None = None, content: bool = False) -> DataFrame:
    """path, text and size of each file below root that one of the globs includes and none excludes.

    Globs are those of paths below root; one without a slash is of a file's name.
    A string as exclude is a regular expression over the whole path. content:
    with content, the file's bytes.
    """
    df = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    names = [include] if isinstance(include, str) else list(include)
    if len(names) == 1 and "/" not in names[0]:
        df = df.option("pathGlobFilter", names[0])
    held = df.load(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("size"))
    below = F.regexp_replace(F.col("path"), rf"^.*?{_quoted(root.rstrip('/'))}/", "")
    fits = lambda globs: [below.rlike(glob_pattern(g if "/" in g else f"**/{g}")) for g in globs]
    keep = F.lit(False)
    for f in fits(names):
        keep = keep | f
    held = held.where(keep)
    if isinstance(exclude, str):
        held = held.where(~F.col("path").rlike(exclude))
    for f in fits(exclude or []) if not isinstance(exclude, str) else []:
        held = held.where(~f)
    if not content:
        return held.select("path", "text")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    return held.join(raw, "path")


def _quoted(text_: str) -> str:
    import re

    return re.escape(text_)


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """path and SHA-256 of the bytes of each file below root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select("path", F.sha2("content", 256).alias("digest"))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents of JSON lines files, the first line of each; files whose first line is broken go."""
    whole = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").load(root)
    first = whole.select(F.regexp_extract("value", r"\A\s*([^\n]*)", 1).alias("line"))
    return first.select(F.from_json("line", DOCUMENT, {"mode": "PERMISSIVE"}).alias("d")).where("d.text is not null").select("d.*")


def read_partition(spark: SparkSession, root: str, product_code: str, version: str, lang: str) -> DataFrame:
    """Stored documents of one product, version and language; other partitions are not listed as input."""
    where = (F.col("product_code") == product_code) & (F.col("version") == version) & (F.col("lang") == lang)
    return spark.read.parquet(root).where(where)


def read_jsonl(spark: SparkSession, root: str, schema: str, kind: str | None = None, leave_out: str | None = None) -> DataFrame:
    """Rows of JSON lines, of one `type` if told, without files below a directory of that name. Blank lines are no rows."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).json(root)
    if leave_out:
        df = df.where(~F.col("_metadata.file_path").contains(f"/{leave_out}/"))
    return df.where(F.col("type") == kind) if kind else df


CHUNK_ROW = "text string, seq int, chunk_id string, meta struct<chunk_id:string, seq:int, extra:map<string,string>>"
PARENT_ROW = "type string, parent_id string, text string, document_id string, child_ids array<string>, token_count int, meta map<string,string>"


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    """text, chunk_id, seq and file of stored chunks outside of `_parents`; a missing id is made of the file's name."""
    df = spark.read.schema(CHUNK_ROW).option("recursiveFileLookup", True).json(root)
    df = df.where(~F.col("_metadata.file_path").contains("/_parents/")).select("*", F.col("_metadata.file_path").alias("file"))
    prefix = F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1)
    seq = F.coalesce("meta.seq", "seq")
    own = F.coalesce(F.nullif("meta.chunk_id", F.lit("")), F.col("chunk_id"))
    return df.select("text", ids.resolved_chunk_id(F.col("meta.extra")["chunk_id"], own, seq, F.col("text"), prefix).alias("chunk_id"), seq.alias("seq"), "file")


def read_parents(spark: SparkSession, root: str) -> DataFrame:
    """Stored parents with their defaults: no children, no tokens, and the document's fields of meta lifted."""
    df = read_jsonl(spark, root, PARENT_ROW, "parent")
    lifted = [F.col("meta")[c].alias(c) for c in ("product", "version", "lang", "title", "section")]
    return df.select("parent_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("document_id", F.col("meta")["document_id"]).alias("document_id"), F.coalesce("child_ids", F.array().cast("array<string>")).alias("child_ids"), F.coalesce("token_count", F.lit(0)).alias("token_count"), *lifted)


def parse(files: DataFrame, *, product: str, product_code: str, version: str, lang: str, commit: str | None = None, blanks: bool = False) -> DataFrame:
    """Documents in the columns of DOCUMENT from path and text; blank texts are left out, or with `blanks` kept as empty ones."""
    body = text.normalize_markdown(text.chosen_tabs(text.without_front_matter(F.col("text"))))
    stored = files.select("path", F.sha2("text", 256).alias("hash_raw"), F.coalesce(text.first_h1(text.without_front_matter(F.col("text"))), text.front_matter_title(F.col("text")), text.title_from_path(F.col("path"))).alias("title"), text.clean_text(body).alias("t"), text.last_heading_anchor(body).alias("anchor"))
    stored = stored.withColumn("t", F.coalesce("t", F.lit(""))) if blanks else stored.where("t <> ''")
    url = F.concat_ws("/", F.lit(f"repo://{product_code}"), F.lit(commit), F.col("path"))
    none = F.lit(None).cast("string")
    meta = F.struct(
        F.lit(product).alias("product"), F.lit(product_code).alias("product_code"), F.lit(version).alias("version"), F.lit(lang).alias("lang"), url.alias("url"), url.alias("canonical_url"), "title",
        text.section_from_path(F.col("path")).alias("section"), "anchor", F.lit("text/markdown").alias("content_type"), F.lit("markdown").alias("source_format"), F.lit("repo").alias("source_kind"), none.alias("repo_remote"), F.lit(commit).cast("string").alias("repo_commit"),
        F.col("path").alias("repo_path"), "hash_raw", ids.text_hash(F.col("t")).alias("hash_text"), F.char_length("t").alias("content_length_chars"), text.n_words(F.col("t")).cast("int").alias("content_words"), text.has_table(F.col("t")).alias("has_tables"), text.has_code(F.col("t")).alias("has_code_blocks"), F.create_map().cast("map<string,string>").alias("extra"),
    )
    return stored.select(F.col("t").alias("text"), F.col("path").alias("source_ref"), meta.alias("meta"))


def write_documents(docs: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Documents of ten characters or more, by product, version and language."""
    kept = docs.where(F.char_length(text.strip(F.col("text"))) >= LEAST_CHARS)
    keyed = kept.select("*", *[F.col(f"meta.{c}").alias(c) for c in ("product_code", "version", "lang")], F.concat_ws("-", F.left(text.slug(F.coalesce("meta.title", "meta.repo_path", F.lit("document"))), F.lit(120)), F.left("meta.hash_text", F.lit(8))).alias("name"))
    keyed.write.mode(mode).partitionBy("product_code", "version", "lang").parquet(root)


def reset_state(spark: SparkSession, path: str) -> bool:
    """Move a state table aside to `path.backup`, over an older one; whether there was one."""
    jvm = spark.sparkContext._jvm
    p, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.backup")
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(p):
        return False
    fs.delete(aside, True)
    return bool(fs.rename(p, aside))


def reset(spark: SparkSession, root: str) -> None:
    """Delete a processed directory; the path must say that it is one."""
    if "processed" not in root:
        raise ValueError("only a path that holds 'processed' may be reset")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def payload(meta: DataFrame, body: str, *drop: str) -> DataFrame:
    """Point rows with a preview of 1000 characters; vector and inner columns left out."""
    keep = [c for c in meta.columns if c not in {"vector", "embedding", *drop} and not c.startswith("_")]
    return meta.select(*keep, F.left(F.col(body), F.lit(1000)).alias("_preview"))
