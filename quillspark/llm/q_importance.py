"""Query op11_importance and its SQL."""
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.importance import resample


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its features, weight, score, and its rank if it is drawn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


#: CRC-32 of a string's UTF-8 bytes, as SQL: eight shifts a byte.
CRC = "xor(list_reduce([cast('0x' || substr(hex(encode({0})), cast(2 * i + 1 as int), 2) as ubigint) for i in range(octet_length(encode({0})))], lambda c, b: list_reduce(cast(range(8) as ubigint[]), lambda d, e: case when d & 1 = 1 then xor(d >> 1, 3988292384::ubigint) else d >> 1 end, xor(c, b)), 4294967295::ubigint), 4294967295::ubigint)"

SQL = rf"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
dc as (select doc_id, word, count(*) as n from (select doc_id, unnest(w) as word from dw) group by all),
bw as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
counts as (select word, sum(s) as s, sum(t) as t from (select word, n as s, 0 as t from dc union all select word, 0, 1 from bw) group by word),
hashed as (select word, s, t, {CRC.format('word')} % 10000 as bucket from counts),
by_bucket as (select bucket, cast(sum(s) as double) as s, cast(sum(t) as double) as t from hashed group by bucket),
sums as (select coalesce(sum(s), 0) as all_s, coalesce(sum(t), 0) as all_t from by_bucket),
gains as (select bucket, cast(floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) as bigint) as gain from by_bucket, sums),
weights as (select doc_id, sum(n * gain) as weight from dc join hashed using (word) join gains using (bucket) group by doc_id),
scored as (select doc_id, cast(len(w) as bigint) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
 cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast(cast('0x' || substr(sha256('2024:' || cast(doc_id as varchar)), 1, 8) as ubigint) as double) + 0.5) / 4294967296))) as bigint) as score
 from dw left join weights using (doc_id)),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from scored where n_features >= 20)
select s.doc_id, n_features, weight, score, case when r <= 10 * n // 100 then r end as rank from scored s left join placed using (doc_id)
"""
