"""Query op1_decontaminate and its SQL."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.decontaminate import find_overlap


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its words, those inside benchmark windows, and the items found."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_overlap(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
with bw as (select item_id, {_WORDS} as w from benchmark),
bs as (select item_id, w, least(10, len(w)) as k from bw where len(w) > 0),
win as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as g
        from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from bs)),
dw as (select doc_id, {_WORDS} as w from documents),
pos as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from dw),
hit as (select a.doc_id, a.i, s.k, array_to_string(a.w[a.i:a.i + s.k - 1], ' ') as g
        from pos a cross join (select distinct k from win) s where a.i + s.k - 1 <= len(a.w)),
found as (select h.doc_id, h.i, h.k, win.item_id from hit h join win on h.k = win.k and h.g = win.g),
spots as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from (select distinct doc_id, i, k from found)) group by doc_id),
ids as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as s from (select distinct doc_id, cast(item_id as varchar) as x from found) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join spots using (doc_id) left join ids using (doc_id)
"""
