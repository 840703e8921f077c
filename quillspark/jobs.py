"""spark-submit entry points: ingest, chunk, embed, verify.

    spark-submit quillspark/jobs.py ingest SOURCE TARGET --product P --version V --lang L [--config FILE]
    spark-submit quillspark/jobs.py chunk SOURCE TARGET
    spark-submit quillspark/jobs.py embed SOURCE TARGET
    spark-submit quillspark/jobs.py verify SOURCE TARGET
"""
import argparse
import os
import sys

if __package__ in (None, ""):  # started as a file
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark import config
from quillspark.functions import text
from quillspark.operators import chunking, dedup, embedding, payloads, stats, store
from quillspark.sources import documents
from quillspark.sources.tables import Table


def text_code(product: str) -> str:
    return "".join(c if c.isalnum() else "-" for c in product.lower())


def ingest(spark: SparkSession, source: str, target: str, product: str, version: str, lang: str, *, include: str | list[str] = "*.md*", exclude: list[str] | None = None, state: str | None = None, settings: config.Settings = config.Settings()) -> dict:
    """Markdown files to documents; the counters of the run.

    Files without a text are errors: they go to `target_errors` with the reason
    and stop nothing. Near duplicates of a bucket are left out; with `state` the
    buckets' representatives are read from there, and the new ones are committed when
    all else is written: a run that ends before is run again from the old ones.
    """
    # the files are read once: parsed rows lie beside the target while the run lasts, and writes count what they write
    files = documents.read_files(spark, source, include, exclude)
    parsed = documents.parse(files, product=product, product_code=text_code(product), version=version, lang=lang, blanks=True)
    parsed.write.mode("overwrite").parquet(f"{target}_parsed")
    parsed = spark.read.schema(parsed.schema).parquet(f"{target}_parsed")
    docs, lacking = payloads.required(parsed.where("text <> ''"), "text", "source_ref")
    bucket = F.concat_ws(":", "meta.product_code", text.section_key(F.col("meta.section"), F.col("meta.url"), F.col("meta.product_code")), text.length_bucket(F.char_length("text")))
    rows = docs.select("text", "source_ref", bucket.alias("bucket"))
    args = {"bucket": "bucket", "order": "source_ref", "text": "text", "min_chars": settings.near_min_chars}
    held = Table(spark, state) if state else None
    then = held.version() if held else None
    before = held.read(then) if held and then.schema else None
    seen, failed = Observation(), Observation()
    marked = dedup.sequential_near_dup(rows, threshold=settings.near_threshold, state=before, **args)
    marked.observe(seen, F.count("*").alias("n_parsed"), F.coalesce(F.count_if("is_dup"), F.lit(0)).alias("n_dup")).write.mode("overwrite").parquet(f"{target}_marked")
    marked = spark.read.schema(marked.schema).parquet(f"{target}_marked")
    documents.write_documents(docs.join(marked.where("is_dup").select("source_ref"), "source_ref", "left_anti"), target)
    blank = parsed.where("text = ''").select(F.col("source_ref").alias("path"), F.lit("no text").alias("error"))
    errors = blank.unionByName(lacking.select(F.col("source_ref").alias("path"), "error"))
    errors.observe(failed, F.count("*").alias("n")).write.mode("overwrite").json(f"{target}_errors")
    if held:
        # last, so that a run that ends before leaves the state of the documents that are there
        after = dedup.near_dup_state(marked, state=before, **args)
        held.commit(then, held.put(after), after.schema)
        held.vacuum()
    store.drop(spark, f"{target}_parsed")
    n, n_error = seen.get, failed.get["n"]
    return {"total": n["n_parsed"] + n_error, "n_parsed": n["n_parsed"], "n_dup": n["n_dup"], "n_ok": n["n_parsed"] - n["n_dup"], "n_error": n_error}


def ingest_all(spark: SparkSession, target: str, settings: config.Settings) -> dict:
    """All sources of the settings, one after the other; a source that fails is counted and told, and stops no other."""
    out = {"sources": 0, "failed": {}, "counts": {}}
    for s in settings.sources:
        out["sources"] += 1
        try:
            out["counts"][s.product] = ingest(spark, s.root, f"{target}/{text_code(s.product)}", s.product, s.version, s.lang, include=list(s.include), exclude=list(s.exclude), settings=settings)
        except Exception as e:  # what broke is in the report
            out["failed"][s.product] = f"{type(e).__name__}: {e}"[:2000]
    return out


def chunked(docs: DataFrame, settings: config.Settings = config.Settings(), compat: bool = False) -> DataFrame:
    """Documents (source_ref, text, meta) to chunks: preprocessed, cut, equal and near ones of a section dropped, with their document's fields."""
    d = docs.select("source_ref", text.preprocess(F.col("text")).alias("text"), "meta.*").drop("anchor")
    budget = chunking.Budget(max_tokens=settings.max_tokens, max_sentences=settings.max_sentences, min_chars=settings.min_chars, max_chunks=settings.max_chunks or None, compat=compat)
    made = chunking.chunk_documents(d, doc="source_ref", text="text", title="title", section="section", budget=budget)
    made = made.withColumn("group", F.array_join(chunking.group_key(F.col("h_path"), F.lit(None)), "__"))
    once = dedup.first_by_hash(made, "text", "seq", within=["document_id"])
    kept = dedup.keep_if_grown(once, doc="document_id", section=["group"], seq="seq", text="text", tokens="chunk_size", compat=compat)
    return payloads.with_document_fields(kept, d.withColumn("document_id", F.col("source_ref")))


def chunk(spark: SparkSession, source: str, target: str, settings: config.Settings = config.Settings()) -> dict:
    """Documents to preprocessed texts, linked chunks, parents and a report."""
    docs = spark.read.parquet(source)
    docs.select("source_ref", text.preprocess(F.col("text")).alias("text")).write.mode("overwrite").parquet(f"{target}/preprocessed")
    chunked(docs, settings).write.mode("overwrite").parquet(f"{target}/chunks")
    held = spark.read.parquet(f"{target}/chunks")
    chunking.neighbours(held, group=["document_id", "group"], seq="seq", chunk="chunk_id").write.mode("overwrite").parquet(f"{target}/linked")
    made = chunking.parents(held, group=["document_id", "group"], seq="seq", chunk="chunk_id", text="text")
    made = made.withColumn("parent_id", F.concat_ws("__", "document_id", "group", F.col("ordinal").cast("string")))
    made.write.mode("overwrite").parquet(f"{target}/parents")
    report = stats.chunk_report(held)
    report.write.mode("overwrite").json(f"{target}/report")
    return report.first().asDict()


def embed(spark: SparkSession, source: str, target: str, settings: config.Settings = config.Settings()) -> dict:
    """Chunks, then parents that are long enough, to points; points that are there already are replaced, in one commit for each table. The counts of both tables."""
    out = {}
    linked = spark.read.parquet(f"{source}/linked").drop("extra")
    parents = payloads.long_parents(spark.read.parquet(f"{source}/parents")).select("document_id", "parent_id", "child_ids", "token_count", "text")
    for kind, key, rows in (("child", "chunk_id", linked), ("parent", "parent_id", parents)):
        rows = payloads.point_payload(rows, "text", kind=kind, key=key, prefix=F.col("document_id")).drop("_preview")
        new = embedding.points(embedding.embedded(rows, "text", name=settings.provider, dim=settings.dim), key, "vec", "text")
        table = store.ensure(spark, f"{target}/{kind}")
        table.change(lambda base, new=new: store.upsert_points(base, new, settings.dim))
        out[kind] = store.stats(table.read()).first().asDict()
    return out


def verify(spark: SparkSession, source: str, target: str) -> dict:
    """Chunks and parents without a point, points that none expects, and whether vectors have length one."""
    out = {}
    parents = payloads.long_parents(spark.read.parquet(f"{source}/parents"))
    for kind, key, rows in (("child", "chunk_id", spark.read.parquet(f"{source}/linked")), ("parent", "parent_id", parents)):
        held = Table(spark, f"{target}/{kind}").read()
        out[kind] = store.verified(held, rows, key).first().asDict() | embedding.checked(held, "vector").first().asDict()
    return out


def main() -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=("ingest", "chunk", "embed", "verify"))
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--config")
    for name in ("product", "version", "lang"):
        p.add_argument(f"--{name}", default="default")
    a = p.parse_args()
    spark = SparkSession.builder.appName(f"quillspark {a.job}").getOrCreate()
    settings = config.load(a.config)
    if a.job == "ingest" and settings.sources:
        got = ingest_all(spark, a.target, settings)
    elif a.job == "ingest":
        got = ingest(spark, a.source, a.target, a.product, a.version, a.lang, settings=settings)
    elif a.job == "verify":
        got = verify(spark, a.source, a.target)
    else:
        got = {"chunk": chunk, "embed": embed}[a.job](spark, a.source, a.target, settings)
    print(got)
    return 1 if got.get("failed") or got.get("n_error") or any(c["n_error"] for c in got.get("counts", {}).values()) else 0


if __name__ == "__main__":
    raise SystemExit(main())
