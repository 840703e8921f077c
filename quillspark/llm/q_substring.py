"""Query op7_substring and its SQL."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.substring import remove_repeats


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its words, those removed, and a digest of those kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
with dw as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from dw where len(w) >= 13)),
least_doc as (select g, min(doc_id) as first_doc from win group by g),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 13)) as p from win join least_doc using (g) where first_doc < doc_id)),
flat as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from dw),
kept as (select f.doc_id, count(*) as n, string_agg(f.word, ' ' order by f.p) as s from flat f anti join gone g on f.doc_id = g.doc_id and f.p = g.p group by f.doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) as bigint) - coalesce(n, 0) as n_removed, sha256(coalesce(s, '')) as kept_sha256
from dw left join kept using (doc_id)
"""
