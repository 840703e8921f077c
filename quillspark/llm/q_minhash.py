"""Query op13_minhash and its SQL."""
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.minhash import near_duplicates


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the size of its set, the smallest doc_id of its component, and whether it is kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
with recursive dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, s from (select doc_id, case when len(w) = 1 then unnest([w[1]]) else unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) end as s from dw)),
sizes as (select doc_id, count(*) as n from sh group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as n from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
linked as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * pairs.n >= 80 * (x.n + y.n - pairs.n)),
reach as (select doc_id, doc_id as other from documents union select r.doc_id, l.b from reach r join linked l on l.a = r.other),
least as (select doc_id, min(other) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from least left join sizes using (doc_id)
"""
