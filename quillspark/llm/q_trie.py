"""Query op12_trie and its SQL."""
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.q_importance import CRC
from quillspark.llm.trie import prefix_trie, rebuilt, sequences


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations."""
    return prefix_trie(rebuilt(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


SQL = f"""
with orig as (select conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} order by turn nulls first) as l, cast({CRC.format('cast(conv_id as varchar)')} % 9 as int) as h from conversations where conv_id is not null group by conv_id),
conv as (select c.conv_id, coalesce(b.l[1:c.h], []) || c.l[c.h + 1:] as l from orig c left join orig b on b.conv_id = c.conv_id - c.conv_id % 5),
steps as (select conv_id, d, l[1:d] as path, len(l) = d as ends from (select conv_id, l, unnest(range(len(l) + 1)) as d from conv)),
nodes as (select d, path, min(conv_id) as conv_id, count(*) as n, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as ends_sha256 from steps group by d, path),
kids as (select d - 1 as d, path[1:d - 1] as path, count(*) as n_children from nodes where d > 0 group by all),
sized as (select d, path, case when kids.n_children is null then 1 else 0 end as leaf, case when d = 0 then 0 else (n - 1) * octet_length(encode(path[d].t)) end as saved from nodes left join kids using (d, path)),
sums as (select ad as d, path[1:ad] as path, sum(leaf) as n_leaves, sum(saved) as saved_tokens from (select *, unnest(range(d + 1)) as ad from sized) group by all)
select n.conv_id, n.d as depth, p.conv_id as parent_conv_id, n.n as n_convs, coalesce(n_children, 0) as n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, n.ends_sha256
from nodes n left join kids k on k.d = n.d and k.path = n.path join sums s on s.d = n.d and s.path = n.path left join nodes p on p.d = n.d - 1 and p.path = n.path[1:n.d - 1]
"""
