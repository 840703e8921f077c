"""Query op3_licenses and its SQL."""
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.licenses import RULES, SENTENCES, plain, scan


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its sentences, the known ones, and the licences that rules find."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_KNOWN = ", ".join(f"('{plain(s)}', {i})" for i, s in SENTENCES.items())
_RULES = ", ".join(f"({n}, '{lic}', '{kind}', ',{','.join(map(str, seq))},')" for n, (lic, kind, seq) in enumerate(RULES))
_ENDS = r"[.!?;:]+[\x20\x09-\x0D]+"
SQL = rf"""
with known(form, id) as (values {_KNOWN}),
rules(n, licence, kind, seq) as (values {_RULES}),
cuts as (select doc_id, 1 as way, string_split_regex(coalesce(text, ''), '{_ENDS}|\n') as s from documents
         union all select doc_id, 2, string_split_regex(coalesce(text, ''), '{_ENDS}|\n[\x20\x09\x0B-\x0D]*\n') from documents),
flat as (select doc_id, way, unnest(s) as s, unnest(range(len(s))) as p from cuts),
forms as (select doc_id, way, p, trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' ') as form from flat),
ids as (select doc_id, way, p, coalesce(id, 0) as id from forms left join known using (form) where form <> ''),
seqs as (select doc_id, way, count(*) as n_sentences, count(*) filter (id > 0) as n_known, ',' || string_agg(id, ',' order by p) || ',' as sentence_ids from ids group by doc_id, way),
hits as (select distinct doc_id, n, licence, kind from seqs join rules on contains(sentence_ids, seq)),
firsts as (select doc_id, arg_min(licence, n) as licence, arg_min(kind, n) as kind from hits group by doc_id),
lists as (select doc_id, string_agg(licence, ';' order by n) as licences from (select doc_id, licence, min(n) as n from hits group by doc_id, licence) group by doc_id)
select doc_id, coalesce(a.n_sentences, 0) as n_sentences, coalesce(a.n_known, 0) as n_known, coalesce(a.sentence_ids, '') as sentence_ids,
 coalesce(b.sentence_ids, '') as wrapped_ids, licence, kind, coalesce(licences, '') as licences
from documents left join (select * from seqs where way = 1) a using (doc_id) left join (select * from seqs where way = 2) b using (doc_id)
 left join firsts using (doc_id) left join lists using (doc_id)
"""
