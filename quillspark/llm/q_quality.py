"""Query op9_quality. SQL covers the base rules in the tests; the verdict is tested against plain Python."""
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.quality import judge


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: base measures, base verdict, and the adaptive verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


#: The base columns alone.
BASE_SQL = r"""
with dw as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
lines as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from dw),
win as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from dw where len(w) >= 5)),
twice as (select doc_id, g from win group by all having count(*) > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from win join twice using (doc_id, g)) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
  cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
  coalesce(n, 0) as n_repeat_words, (len(w) < 10 or 100 * coalesce(n, 0) > 20 * len(w)) as base_failed
from dw join lines using (doc_id) left join rep using (doc_id)
"""
