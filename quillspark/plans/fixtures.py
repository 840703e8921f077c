"""Inputs derived from the driver's tables, by SQL that Spark and DuckDB both run."""
from pyspark.sql import DataFrame, SparkSession

from quillspark.sources.documents import read_table

TICKS = "`" * 3
MD_SQL = f"""select doc_id, lang, source,
 '---' || chr(10) || 'title: Doc ' || cast(doc_id as string) || chr(10) || '---' || chr(10)
 || case when doc_id % 3 = 0 then '' else '# Head `' || source || '` <b>x</b>' || chr(10) || chr(10) end
 || '## Part   One' || chr(10) || chr(10) || text || '   ' || chr(10) || chr(10) || chr(10) || chr(10)
 || '- item one' || chr(10) || '- item two' || chr(10) || chr(10)
 || '{TICKS}py' || chr(10) || 'x  =  1' || chr(10) || '{TICKS}' || chr(10) || chr(10)
 || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10) || chr(10)
 || '### Sub é' || chr(10) || chr(10) || 'hyphen-' || chr(10) || 'ated 😀 <Tip>note</Tip> end.' as text
from documents"""


def md_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and a Markdown text with every construct that the cleaning rules know."""
    return spark.sql(MD_SQL.replace("from documents", "from {docs}"), docs=read_table(spark, sf_dir, "documents"))
