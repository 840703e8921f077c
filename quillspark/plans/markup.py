"""Queries over composed markup."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.plans.registry import query
from quillspark.sources.documents import read_table

_VALUES = [*text.TAB_VALUES, "npm", "other"]
_RANK = f"coalesce(list_position({list(text.TAB_VALUES)}, {_VALUES}[doc_id // {{0}} % 8 + 1]), 999)"


def _tabbed() -> Column:
    """A block of two tabs, the first of which holds a block of two; values follow from the id."""
    value = lambda n: F.element_at(F.array(*map(F.lit, _VALUES)), (F.floor(F.col("doc_id") / n) % 8 + 1).cast("int"))
    words = F.regexp_replace(F.left("text", F.lit(60)), "[^A-Za-z]", "")
    parts = [
        F.lit("Before "), F.col("source"), F.lit('\n<Tabs groupId="g">\n<TabItem value="'), value(1), F.lit('" default> one <tabs><TabItem value="'), value(8), F.lit('">'), F.col("lang"),
        F.lit(' three</TabItem>\n <TabItem value="'), value(3), F.lit("\">four</TabItem></tabs> </TabItem>\n<TabItem label=\"x\" value='"), value(5), F.lit("'>\n\ntwo <b>"), words, F.lit("</b>\n</TabItem>\n</Tabs>\nafter <Tabs>plain</Tabs>"),
    ]
    return F.concat(*parts)


@query(f"""select doc_id, 'Before ' || source || chr(10) || case when {_RANK.format(1)} <= {_RANK.format(5)} then 'one ' || case when {_RANK.format(8)} <= {_RANK.format(3)} then lang || ' three' else 'four' end
 else 'two <b>' || regexp_replace(left(text, 60), '[^A-Za-z]', '', 'g') || '</b>' end || chr(10) || 'after plain' as chosen from documents""")
def tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tab of each block, by preference; tabs within tabs."""
    return read_table(spark, sf_dir, "documents").select("doc_id", text.chosen_tabs(_tabbed()).alias("chosen"))
