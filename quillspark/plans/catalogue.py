"""Queries over the driver's tables, with the SQL that gives the same rows."""
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import ids, text
from quillspark.functions import vectors as V
from quillspark.operators import chunking, dedup, embedding, payloads, retrieval, routing, search, sqlqa, stats, store
from quillspark.plans import approximate, markup, searches, streams, times  # noqa: F401
from quillspark.plans.fixtures import MD_SQL, md_documents
from quillspark.plans.registry import ORACLES, QUERIES, query, scratch
from quillspark.sources.documents import read_table
from quillspark.streaming import ingest

MD = f"md as ({MD_SQL})"
_STRIP = r"'^\s+|\s+$', '', 'g'"

# ---------------------------------------------------------------- cleaning


@query(rf"""with {MD}, c as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {_STRIP}) as t from md)
select doc_id, cast(length(t) as bigint) as n_chars, cast(len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+')) as bigint) as n_words, sha256(t) as digest,
 contains(t, '```') as has_code, regexp_matches(t, '(?m)^\s*\|?\s*:?-{{3,}}:?\s*(\|\s*:?-{{3,}}:?\s*)+\|?\s*$') as has_table from c""")
def normalize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space rules, counts and flags."""
    c = md_documents(spark, sf_dir).select("doc_id", text.clean_text(F.col("text")).alias("t"))
    return c.select("doc_id", F.char_length("t").cast("long").alias("n_chars"), text.n_words(F.col("t")).alias("n_words"), ids.text_hash(F.col("t")).alias("digest"), text.has_code(F.col("t")).alias("has_code"), text.has_table(F.col("t")).alias("has_table"))


@query(rf"""with {MD}, f as (select doc_id, regexp_extract(text, '(?s)^\s*---[ \t]*\n(.*?)\n---[ \t]*(\n|$)', 1) as fm, regexp_replace(text, '(?s)^\s*---[ \t]*\n.*?\n---[ \t]*\n', '') as body from md),
h as (select doc_id, regexp_extract(fm, '(?m)^title:[ \t]*["'']?(.*?)["'']?[ \t]*$', 1) as ft, nullif(trim(replace(regexp_replace(regexp_extract(body, '(?m)^[ \t]*#[ \t]+(.+?)[ \t]*$', 1), '<[^>]+>', '', 'g'), '`', '')), '') as h1,
 list_last(regexp_extract_all(body, '(?m)^[ \t]*#{{2,3}}[ \t]+(.+?)[ \t]*$', 1)) as last_h, sha256(body) as body_digest from f)
select doc_id, h1, coalesce(h1, nullif(ft, ''), 'Document') as title, trim(regexp_replace(translate(lower(last_h), 'é', 'e'), '[^a-z0-9]+', '-', 'g'), '-') as anchor, body_digest from h""")
def front_matter_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter, headings and titles."""
    md = md_documents(spark, sf_dir).select("doc_id", "text", text.without_front_matter(F.col("text")).alias("body"))
    h1 = text.first_h1(F.col("body"))
    return md.select("doc_id", h1.alias("h1"), F.coalesce(h1, text.front_matter_title(F.col("text")), text.title_from_path(F.lit(""))).alias("title"), text.last_heading_anchor(F.col("body")).alias("anchor"), F.sha2("body", 256).alias("body_digest"))


_TIDY = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(x, '[\x{1F1E6}-\x{1FAFF}\x{2700}-\x{27BF}\x{2600}-\x{26FF}\x{FE0F}\x{200D}\x{1F3FB}-\x{1F3FF}\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)', '\1\2', 'g'), '(?m)^\s*([-*]|\d+\.)\s+', chr(10) || '• ', 'g'), '$^', '')"""


@query(rf"""with {MD}, parts as (select doc_id, string_split_regex(text, '(?s)```.*?```') as p, regexp_extract_all(text, '(?s)```.*?```') as f from md),
first as (select doc_id, list_concat([regexp_replace(p[1], '(?m)^[ \t]*#[ \t]+.+\n+', '')], p[2:]) as p, f from parts),
flat as (select doc_id, unnest(range(1, len(p) + 1)) as i, unnest(p) as x, f from first),
done as (select doc_id, i, {_TIDY} || coalesce(f[i], '') as x from flat),
whole as (select doc_id, regexp_replace(string_agg(x, '' order by i), {_STRIP}) || chr(10) as t from done group by doc_id)
select doc_id, cast(length(t) as bigint) as n_chars, sha256(t) as digest from whole""")
def preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts ready for chunking, fences untouched."""
    c = md_documents(spark, sf_dir).select("doc_id", text.preprocess(F.col("text")).alias("t"))
    return c.select("doc_id", F.char_length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("digest"))


@query(r"""with s as (select doc_id, string_split(regexp_replace(replace(replace(text, 'Dr.', 'Dr∯'), 'No.', 'No∯'), '([.!?]) *([A-Z"''(\[])', '\1␞\2', 'g'), '␞') as l from documents),
f as (select doc_id, trim(replace(unnest(l), '∯', '.'), ' ' || chr(10)) as x from s)
select doc_id, count(*) as n_sentences, cast(max(length(x)) as bigint) as longest from f where x <> '' group by doc_id""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document."""
    s = read_table(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", lambda x: F.char_length(x))).cast("long").alias("longest")).where("n_sentences > 0")


@query(r"""select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) as title, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) as h1,
 cast(length(trim(regexp_replace(regexp_replace(html, '</?[A-Za-z][^<>]*>', ' ', 'g'), '\s+', ' ', 'g'))) as bigint) as n_text from pages""")
def html_strip_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, first heading and text length of pages without tags."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", flat(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), flat(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", "")).alias("h1"), F.char_length(flat(F.regexp_replace("html", r"</?[A-Za-z][^<>]*>", " "))).cast("long").alias("n_text"))


@query(r"""with p as (select page_id, url, list_filter(string_split(regexp_extract(url, '^\w+://[^/]+/(.*)$', 1), '/'), lambda x: not list_contains(['docs','site','content','src','source','en'], lower(x))) as parts from pages)
select page_id, coalesce(nullif(regexp_extract(url, '^\w+://([^/]+)/', 1), ''), 'root') as section_key, case when len(parts) > 1 then '/' || array_to_string(parts[1:least(2, len(parts) - 1)], '/') || '/' else '/' end as section from p""")
def url_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authority and path section of page urls."""
    p = read_table(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")
    return p.select("page_id", text.section_key(none, F.col("url"), none).alias("section_key"), text.section_from_path(F.regexp_extract("url", r"^\w+://[^/]+/(.*)$", 1)).alias("section"))


# ---------------------------------------------------------------- identifiers and dedup


@query(r"""with n as (select doc_id, lang, source, text, row_number() over (partition by source order by doc_id) as seq from documents),
c as (select doc_id, source || '_' || cast(seq as varchar) || '_' || left(sha1(text), 16) as chunk_id from n),
u as (select doc_id, chunk_id, left(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id)), 32) as x from c)
select doc_id, chunk_id, x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || substr('89ab', (instr('0123456789abcdef', x[17:17]) - 1) % 4 + 1, 1) || x[18:20] || '-' || x[21:32] as point_id from u""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence numbers, chunk ids and their version-5 UUIDs."""
    marked = read_table(spark, sf_dir, "documents").select("doc_id", "source", ids.text_mark(F.col("text")).alias("mark"))
    n = marked.withColumn("seq", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    c = n.select("doc_id", ids.chunk_id(F.col("source"), F.col("seq"), mark=F.col("mark")).alias("chunk_id"))
    return c.select("doc_id", "chunk_id", ids.uuid5(F.col("chunk_id")).alias("point_id"))


@query("select doc_id, sha256(text) as digest from documents qualify row_number() over (partition by sha256(text) order by doc_id) = 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document of each text. min() sums up before the shuffle, so a large group of copies costs one row a task."""
    d = read_table(spark, sf_dir, "documents")
    return d.groupBy(ids.text_hash(F.col("text")).alias("digest")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest")


@query("""select lang || ':' || source || ':' || cast(length(text) // 1000 * 1000 as varchar) || '-' || cast(length(text) // 1000 * 1000 + 1000 as varchar) as bucket, count(*) as n, min(doc_id) as first_doc
from documents where length(text) >= 600 group by 1""")
def near_dup_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of near-duplicate search and their sizes."""
    d = read_table(spark, sf_dir, "documents").where(F.char_length("text") >= 600)
    return d.groupBy(streams.bucket().alias("bucket")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("""select user_id, event_id, cast(value as double) as value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event, as two batches merged by key."""
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts")
    return dedup.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query()
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a file stream: a directory's files once, merged by micro-batches."""
    import uuid

    base = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts")
    e.write.parquet(f"{base}/in")
    merged = ingest.stream_upsert(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", schema=e.schema, key=["user_id"], version=["ts", "event_id"])
    return merged.select("user_id", "event_id", "value")


ORACLES["stream_ingest"] = ORACLES["upsert_last_wins"]


@query("select s_suppkey, s_name from supplier union all select n_nationkey * 3, 'Nation ' || n_name from nation where n_nationkey * 3 not in (select s_suppkey from supplier)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is not there yet."""
    base = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    new = read_table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 3).cast("long").alias("s_suppkey"), F.concat(F.lit("Nation "), "n_name").alias("s_name"))
    return dedup.insert_absent(base, new, ["s_suppkey"])


# ---------------------------------------------------------------- chunks


@query()
def chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of Markdown documents: counts by kind."""
    md = md_documents(spark, sf_dir).select("doc_id", text.preprocess(text.without_front_matter(F.col("text"))).alias("text"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"))
    c = chunking.chunk_documents(md, doc="doc_id", text="text", title="title", budget=chunking.Budget(min_chars=5))
    return c.select("document_id", "seq", "chunk_id", "chunk_size", F.array_join("h_path", "/").alias("h_path"), "has_code", "has_table", "code_lang")


_PROTECT = "text"
for _abbreviation in text.ABBREVIATIONS:
    _PROTECT = f"replace({_PROTECT}, '{_abbreviation}', '{_abbreviation.replace('.', '∯')}')"
_EST = lambda x: f"greatest(1, length({x}) // 4)"
_HELD, _JOINED = "list_append(r.wait, t.txt)", "array_to_string(list_append(r.wait, t.txt), ' ')"
_FULL = f"({_EST(_JOINED)} > 420 or len(r.wait) >= 8)"
#: Sentences in order; one that is too long for a chunk is followed by its parts. Each step holds what waits for a chunk and gives at most one chunk.
_CHUNKS = rf"""cut as (select doc_id, string_split(regexp_replace({_PROTECT}, '([.!?]) *([A-Z"''(\[])', '\1␞\2', 'g'), '␞') as l from documents),
flat as (select doc_id, unnest(l) as raw, unnest(range(len(l))) as i from cut),
sent as (select doc_id, i, regexp_replace(replace(raw, '∯', '.'), {_STRIP}) as txt from flat),
long as (select doc_id, i, txt, {_EST('txt')} > 420 as long from sent where txt <> ''),
parts as (select doc_id, i, unnest(range(len(p))) as j, regexp_replace(unnest(p), {_STRIP}) as txt from (select doc_id, i, string_split_regex(txt, '[;•—,](\s+|$)') as p from long where long)),
items as (select doc_id, i, -1 as j, txt, long from long union all select doc_id, i, j, txt, false from parts where txt <> ''),
t as (select doc_id, j, txt, long, row_number() over (partition by doc_id order by i, j) as n from items),
r as (select distinct doc_id, cast(0 as bigint) as n, cast([] as varchar[]) as wait, false as split, cast(null as varchar) as made from t
 union all select r.doc_id, t.n,
  case when t.j < 0 then case when len(r.wait) = 0 or not {_FULL} then {_HELD} when t.long then [] else [t.txt] end
   when not r.split or {_EST('t.txt')} > 420 then r.wait when {_FULL} then [] else {_HELD} end,
  case when t.j < 0 then len(r.wait) > 0 and t.long else r.split end,
  case when t.j < 0 then case when len(r.wait) > 0 and {_FULL} then array_to_string(r.wait, ' ') end
   when not r.split then null when {_EST('t.txt')} > 420 then t.txt when {_FULL} then {_JOINED} end
 from r join t on t.doc_id = r.doc_id and t.n = r.n + 1),
made as (select doc_id, n, made from r where made is not null
 union all select doc_id, max(n) + 1, array_to_string(arg_max(wait, n), ' ') from r group by doc_id having len(arg_max(wait, n)) > 0),
once as (select doc_id, made, min(n) as n from made where length(made) >= 180 group by doc_id, made)"""


@query(f"with recursive {_CHUNKS} select cast(doc_id as varchar) as document_id, row_number() over (partition by doc_id order by n) as seq, doc_id || '_' || row_number() over (partition by doc_id order by n) || '_' || left(sha1(made), 16) as chunk_id, {_EST('made')} as chunk_size, sha256(made) as digest from once")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of all documents."""
    c = chunking.chunk_documents(read_table(spark, sf_dir, "documents"), doc="doc_id", text="text", budget=chunking.Budget(max_chunks=None))
    return c.select("document_id", "seq", "chunk_id", "chunk_size", F.sha2("text", 256).alias("digest"))


@query(f"with recursive {_CHUNKS} select cast(doc_id as varchar) as document_id, row_number() over (partition by doc_id order by n) as seq, {_EST('made')} as chunk_size, sha256(made) as digest from once")
def chunk_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in SQL, by the chunker as a lateral table function."""
    chunking.register(spark, "quill_chunk", chunking.Budget(max_chunks=None))
    read_table(spark, sf_dir, "documents").createOrReplaceTempView("quill_documents")
    return spark.sql("select cast(d.doc_id as string) as document_id, c.seq, c.chunk_size, sha2(c.text, 256) as digest from quill_documents d, lateral quill_chunk(d.text) c")


@query(f"with recursive {_CHUNKS} select count(*) as n_chunks, cast(0 as bigint) as n_code, cast(0 as bigint) as n_table, round(avg(length(made)), 4) as avg_chars, cast(0.0 as double) as code_share, cast(0.0 as double) as table_share from once")
def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over all chunks; texts without code and tables."""
    made = chunking.chunk_documents(read_table(spark, sf_dir, "documents"), doc="doc_id", text="text", budget=chunking.Budget(max_chunks=None))
    return stats.chunk_report(made).withColumn("avg_chars", F.round("avg_chars", 4))


@query("select conv_id, turn, lag(turn) over w as prev_id, lead(turn) over w as next_id from conversations window w as (partition by conv_id order by turn)")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns."""
    c = read_table(spark, sf_dir, "conversations")
    return chunking.neighbours(c, group=["conv_id"], seq="turn", chunk="turn").select("conv_id", "turn", "prev_id", "next_id")


@query("""with recursive t as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as i from conversations),
r as (select conv_id, i, text as acc, 1 as ordinal, 1 as members from t where i = 1
 union all select t.conv_id, t.i, case when length(r.acc || chr(10) || chr(10) || t.text) // 4 > 60 then t.text else r.acc || chr(10) || chr(10) || t.text end,
  case when length(r.acc || chr(10) || chr(10) || t.text) // 4 > 60 then r.ordinal + 1 else r.ordinal end,
  case when length(r.acc || chr(10) || chr(10) || t.text) // 4 > 60 then 1 else r.members + 1 end
 from r join t on t.conv_id = r.conv_id and t.i = r.i + 1)
select conv_id, ordinal, cast(max(members) as bigint) as n_children, cast(max(length(acc)) as bigint) as n_chars from r group by conv_id, ordinal""")
def parent_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns packed in order into parents of at most 60 tokens."""
    p = chunking.parents(read_table(spark, sf_dir, "conversations"), group=["conv_id"], seq="turn", chunk="turn", text="text", target=60)
    return p.select("conv_id", "ordinal", F.size("child_ids").cast("long").alias("n_children"), F.char_length("text").cast("long").alias("n_chars"))


@query("""with recursive t as (select conv_id, turn, greatest(1, length(text) // 4) as n, row_number() over (partition by conv_id order by turn) as i from conversations),
r as (select conv_id, turn, i, n as last, true as keep from t where i = 1
 union all select t.conv_id, t.turn, t.i, case when greatest(0, t.n - least(r.last, t.n)) >= 0.1 * t.n then t.n else r.last end, greatest(0, t.n - least(r.last, t.n)) >= 0.1 * t.n from r join t on t.conv_id = r.conv_id and t.i = r.i + 1)
select conv_id, turn from r where keep""")
def growth_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that grow by a tenth over the last kept one."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", text.n_tokens(F.col("text")).alias("n"))
    return dedup.grown(c, group="conv_id", seq="turn", size="n")


# ---------------------------------------------------------------- vectors

_VEC = "v as (select vec_id, label, cast(embedding as double[]) as e from embeddings), d as (select label, i, avg(x) as m from (select label, unnest(e) as x, unnest(range(1, len(e) + 1)) as i from v) group by all), c as (select label, list(m order by i) as m from d group by label), q as (select vec_id as query_id, e as qv from v where vec_id % 100 = 0)"
_COS = "least(1.0, greatest(0.0, list_cosine_similarity({}, {})))"


@query("select label, count(*) as n, bool_and(abs(sqrt(list_dot_product(e, e)) - 1) <= 0.001) as unit, round(sum(sqrt(list_dot_product(e, e))), 4) as total_norm from (select label, cast(embedding as double[]) as e from embeddings) group by label")
def l2_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether vectors have length one."""
    v = read_table(spark, sf_dir, "embeddings").select("label", V.norm(V.doubles(F.col("embedding"))).alias("n"))
    return v.groupBy("label").agg(F.count("*").alias("n"), F.every(F.abs(F.col("n") - 1) <= 1e-3).alias("unit"), F.round(F.sum("n"), 4).alias("total_norm"))


def _vectors(spark, sf_dir):
    """Every hundredth vector as a query, labels' centroids as parents, all vectors as children."""
    e = read_table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), V.doubles(F.col("embedding")).alias("query_vec"))
    parents = retrieval.centroids(e, "label", "embedding", "vec_id").withColumnRenamed("label", "parent_id")
    children = e.select(F.col("label").alias("parent_id"), F.col("vec_id").alias("point_id"), F.col("embedding").alias("vec"))
    return q, parents, children


@query(f"with {_VEC} select query_id, label as parent_id, round({_COS.format('m', 'qv')}, 6) as score from c, q qualify row_number() over (partition by query_id order by {_COS.format('m', 'qv')} desc, label) <= 3")
def topk_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest centroids of each query."""
    q, parents, _ = _vectors(spark, sf_dir)
    return retrieval.top_k(q, parents, 3, vec="parent_vec", id_="parent_id").select("query_id", "parent_id", F.round("score", 6).alias("score"))


@query(f"with {_VEC}, s as (select query_id, label as parent_id, vec_id, {_COS.format('e', 'qv')} as s from v, q) select query_id, parent_id, vec_id, round(s, 6) as score from s qualify row_number() over (partition by query_id, parent_id order by s desc, vec_id) <= 4")
def topk_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nearest vectors of each label for each query."""
    q, parents, children = _vectors(spark, sf_dir)
    found = retrieval.children_of_all(q, parents.select("parent_id"), children, 4)
    return found.select("query_id", "parent_id", F.col("point_id").alias("vec_id"), F.round("child_score", 6).alias("score"))


_RAG = f"""{_VEC}, p as (select query_id, qv, label as parent_id, {_COS.format('m', 'qv')} as ps from c, q qualify row_number() over (partition by query_id order by ps desc, label) <= 3),
k as (select query_id, p.parent_id, ps, vec_id, {_COS.format('e', 'qv')} as cs from v join p on v.label = p.parent_id qualify row_number() over (partition by query_id, p.parent_id order by cs desc, vec_id) <= 4),
r as (select query_id, parent_id, vec_id, 0.7 * ps + 0.3 * cs as s, cs from k where cs >= 0.05)"""


@query(f"with {_RAG} select query_id, parent_id, vec_id, round(cs, 6) as child_score, round(s, 6) as score from r")
def rag_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage retrieval: parents, children, threshold, rescoring."""
    found = retrieval.retrieve(*_vectors(spark, sf_dir), min_score=0.05)
    return found.select("query_id", "parent_id", F.col("point_id").alias("vec_id"), F.round("child_score", 6).alias("child_score"), F.round("score", 6).alias("score"))


@query(f"""with {_RAG} select query_id, vec_id, row_number() over (partition by query_id order by s desc, vec_id) as n, case when length(text) > 200 then left(text, 200) || '...' else text end as preview, round_even(s, 3) as score from r join documents on doc_id = vec_id""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered citations of the retrieved evidence."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"), "text")
    found = retrieval.retrieve(*_vectors(spark, sf_dir), min_score=0.05).join(docs, "point_id")
    c = retrieval.citations(found, query="query_id", text="text", score="score", id_="point_id")
    return c.select("query_id", F.col("point_id").alias("vec_id"), F.col("n").cast("long").alias("n"), "preview", "score")


@query("""with s as (select doc_id, lang, n_chars, sum(greatest(1, length(text) // 4)) over (partition by lang order by n_chars desc, doc_id rows unbounded preceding) + 11 as run from documents) select lang, doc_id, cast(run as bigint) as run_tokens from s where run <= 3744 * 10""")
def budget_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest documents of each language while a token budget lasts."""
    d = read_table(spark, sf_dir, "documents")
    return retrieval.within_budget(d, query="lang", question_tokens=10, text="text", score="n_chars", id_="doc_id", tokens=37_696, margin=256).select("lang", "doc_id", "run_tokens")


@query("select vec_id, label from embeddings where label = 3 and vec_id in (select doc_id from labels where quality = 1)")
def payload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality and membership filters before any scoring."""
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return search.by_ids(read_table(spark, sf_dir, "embeddings").where(embedding.payload_filter(label=3)), good, "vec_id").select("vec_id", "label")


@query("select doc_id, source, text_sha from (select doc_id, source, sha256(text) as text_sha, row_number() over (partition by left(text, 500) order by n_chars desc, doc_id) as n from documents) where n = 1")
def evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document of each 500-character prefix."""
    d = read_table(spark, sf_dir, "documents").withColumn("all", F.lit(1))
    return retrieval.distinct_evidence(d, query="all", text="text", score="n_chars", id_="doc_id").select("doc_id", "source", F.sha2("text", 256).alias("text_sha"))


@query("""select conv_id, string_agg('[Source ' || cast(i as varchar) || ']' || chr(10) || text, chr(10) || chr(10) order by i) as prompt from (select conv_id, text, row_number() over (partition by conv_id order by turn) as i from conversations where role <> 'system') group by conv_id""")
def prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered source blocks of each conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read_table(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("i", F.row_number().over(w))
    block = F.concat(F.lit("[Source "), F.col("i").cast("string"), F.lit("]\n"), "text")
    folded = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", block.alias("b")))).alias("bs"))
    return folded.select("conv_id", F.array_join(F.transform("bs", lambda s: s["b"]), "\n\n").alias("prompt"))


# ---------------------------------------------------------------- routing


def _literal(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _raw(route: str) -> str:
    words, patterns = routing.RULES[route]
    w, p = routing.WEIGHTS[route]
    found = " + ".join(["0"] + [f"cast(regexp_matches(q, '(?i){x.replace(chr(39), chr(39) * 2)}') as int)" for x in patterns])
    return f"{w} * len(list_filter({_literal(words)}, lambda k: contains(q, k))) + {p} * ({found})"


_SCORES = rf"""t as (select conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as q from conversations),
w as (select conv_id, turn, {', '.join(f'cast({_raw(r)} as double) as {r}_w' for r in routing.RULES)} from t),
s as (select conv_id, turn, {', '.join(f'case when greatest(docs_w, sql_w, web_w) > 0 then {r}_w / greatest(docs_w, sql_w, web_w) else 0.0 end as {r}' for r in routing.RULES)} from w)"""


@query(f"with {_SCORES} select conv_id, turn, round(docs, 6) as docs, round(sql, 6) as sql, round(web, 6) as web from s")
def route_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword scores of each turn."""
    s = routing.scored(read_table(spark, sf_dir, "conversations"), "text")
    return s.select("conv_id", "turn", *[F.round(r, 6).alias(r) for r in routing.RULES])


@query(f"with {_SCORES} select conv_id, turn, case when docs >= 0.6 then 'docs' when sql >= 0.6 then 'sql' when web >= 0.6 then 'web' else '' end as route from s")
def route_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first route by priority that scores enough."""
    return routing.pick(routing.scored(read_table(spark, sf_dir, "conversations"), "text")).select("conv_id", "turn", "route")


@query("select conv_id, arg_max(text, (length(text), text)) as answer, cast(max(length(text)) as double) as score from conversations group by conv_id")
def best_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best answer of each conversation."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("text").alias("answer"), F.char_length("text").cast("double").alias("score"))
    return routing.best(c, "conv_id", "answer", "score")


_BEST = "case when greatest(docs, sql, web) >= 0.6 then case when docs >= 0.6 then 'docs' when sql >= 0.6 then 'sql' else 'web' end else 'docs' end"


@query(f"with {_SCORES} select conv_id, turn, {_BEST} as route, round(greatest(docs, sql, web), 6) as route_confidence from s")
def route_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The router's entry with rules alone: one route of each turn, docs where none is sure."""
    c = routing.routed(read_table(spark, sf_dir, "conversations"), "text")
    return c.select("conv_id", "turn", F.array_join("route", ",").alias("route"), F.round("route_confidence", 6).alias("route_confidence"))


_REPLY = "case turn % 4 when 0 then '{\"route\": [\"web\", \"nowhere\"], \"confidence\": 0.9}' when 1 then 'Sure: {\"route\": [\"SQL \"], \"confidence\": 0.7, \"rationale\": \"x\"}' when 2 then 'no idea' else '{\"route\": [\"docs\"], \"confidence\": 0.2}' end"
_TOLD = "case turn % 4 when 0 then 'web' when 1 then 'sql' else 'docs' end as r, case turn % 4 when 0 then 0.9 when 1 then 0.7 when 2 then 0.6 else 0.2 end as c"


@query(f"""with {_SCORES}, m as (select *, {_TOLD} from s),
h as (select conv_id, turn, r, c, greatest(docs, case when r = 'docs' then c * 0.8 else 0 end) as docs, greatest(sql, case when r = 'sql' then c * 0.8 else 0 end) as sql, greatest(web, case when r = 'web' then c * 0.8 else 0 end, case when turn % 8 = 3 then 1.0 else 0 end) as web from m)
select conv_id, turn, case when c >= 0.6 then r else 'docs' end as llm_route, cast(c as double) as llm_confidence,
 coalesce(nullif(array_to_string(list_filter([case when docs >= 0.6 then 'docs' end, case when sql >= 0.6 then 'sql' end, case when web >= 0.6 then 'web' end], lambda x: x is not null), ','), ''), 'docs') as hybrid_route, round(greatest(docs, sql, web), 6) as hybrid_confidence from h""")
def route_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes by a model's replies alone, and by the best of rules, replies and hints, all that are sure."""
    c = read_table(spark, sf_dir, "conversations").withColumn("reply", F.expr(_REPLY))
    llm = routing.routed(c, "text", mode="llm", reply="reply").select("conv_id", "turn", "text", "reply", F.array_join("route", ",").alias("llm_route"), F.col("route_confidence").alias("llm_confidence"))
    both = routing.routed(llm, "text", mode="hybrid", reply="reply", combine=True, boosts={"web": F.when(F.col("turn") % 8 == 3, 1.0)})
    return both.select("conv_id", "turn", "llm_route", "llm_confidence", F.array_join("route", ",").alias("hybrid_route"), F.round("route_confidence", 6).alias("hybrid_confidence"))


@query("""with o as (select conv_id, role as tool, case when turn % 3 = 0 then ' ' else text end as answer, (turn % 10) / 10.0 as confidence from conversations),
n as (select conv_id, tool, case when trim(answer) = '' then 'Инструмент ' || tool || ' не вернул содержательного ответа.' else answer end as answer, case when trim(answer) = '' then greatest(0.3, confidence * 0.7) else confidence end as confidence from o)
select conv_id, max(confidence) as confidence, count(distinct tool) as n_tools, count(*) filter (starts_with(answer, 'Инструмент ')) as n_blank from n group by conv_id""")
def tool_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool outputs normalised: blank answers say so, at a lower confidence; the best of each conversation."""
    o = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("tool"), F.when(F.col("turn") % 3 == 0, " ").otherwise(F.col("text")).alias("answer"), (F.col("turn") % 10 / 10).alias("confidence"))
    best_ = routing.synthesized(o, "conv_id").select("conv_id", "confidence")
    n = o.select("conv_id", "tool", routing.tool_output(F.col("answer"), F.col("confidence"), F.col("tool"))["answer"].alias("a"))
    return n.groupBy("conv_id").agg(F.count_distinct("tool").alias("n_tools"), F.count_if(F.col("a").startswith("Инструмент ")).alias("n_blank")).join(best_, "conv_id")


@query("select event_type as tool, cast(user_id as varchar) as user_id, round(sum(value * case when event_type = 'click' then 0.5 else 1.0 end), 4) as score from events group by all")
def combined_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sums of several score tables."""
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("tool"), F.col("value").alias("score"), F.when(F.col("event_type") == "click", 0.5).otherwise(1.0).alias("w"))
    return routing.combined(e, "user_id", "tool", "score", "w").withColumn("score", F.round("score", 4))


# ---------------------------------------------------------------- payloads and identifiers


@query(r"""with d as (select *, case doc_id % 4 when 0 then chr(92) || 'a' || chr(92) || source || '/' when 1 then '' when 2 then null else '/x//' end as p, case when doc_id % 5 = 0 then 'https://h/' || lang || '/' end as u from documents)
select doc_id, coalesce(nullif(trim(replace(p, chr(92), '/'), '/'), ''), nullif(trim(replace(u, chr(92), '/'), '/'), ''), 'doc' || doc_id) as document_id,
 case doc_id % 3 when 0 then 'extra' || doc_id when 1 then 'own' || doc_id else 'f__' || case when doc_id % 2 = 0 then 'seq' || doc_id || '__' else '' end || left(sha1(text), 8) end as chunk_id,
 concat_ws('_', nullif(lang, ''), nullif(p, ''), doc_id) as composite from d""")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents and chunks from what is known of them."""
    d = read_table(spark, sf_dir, "documents")
    i, id_ = F.col("doc_id"), F.col("doc_id").cast("string")
    p = F.when(i % 4 == 0, F.concat(F.lit("\\a\\"), "source", F.lit("/"))).when(i % 4 == 1, "").when(i % 4 == 3, "/x//")
    u = F.when(i % 5 == 0, F.concat(F.lit("https://h/"), "lang", F.lit("/")))
    chunk = ids.resolved_chunk_id(F.when(i % 3 == 0, F.concat(F.lit("extra"), id_)), F.when(i % 3 == 1, F.concat(F.lit("own"), id_)), F.when(i % 2 == 0, i), F.col("text"), F.lit("f"))
    return d.select("doc_id", ids.document_id(p, u, F.concat(F.lit("doc"), id_)).alias("document_id"), chunk.alias("chunk_id"), ids.composite_id(F.col("lang"), p, i).alias("composite"))


@query(r"""with p as (select doc_id, lang, source, n_chars, case when doc_id % 3 = 0 then '  ' else left(text, 300) end as prev, case when doc_id % 2 = 0 then text end as body from documents)
select doc_id, sha256(case when trim(prev, ' ' || chr(10)) <> '' then trim(prev, ' ' || chr(10)) when body is not null and trim(body, ' ' || chr(10)) <> '' then trim(body, ' ' || chr(10)) else lang end) as digest, case when doc_id % 5 = 0 then 'other' else lang end as lang, source from p""")
def point_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point's text and metadata from its payload."""
    i = F.col("doc_id")
    held = F.create_map(F.lit("_preview"), F.when(i % 3 == 0, "  ").otherwise(F.left("text", F.lit(300))), F.lit("body"), F.when(i % 2 == 0, F.col("text")), F.lit("title"), F.col("lang"), F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("_inner"), F.lit("x"), F.lit("vector"), F.lit("1,2"))
    d = read_table(spark, sf_dir, "documents").select("doc_id", held.alias("payload"), F.when(i % 5 == 0, F.create_map(F.lit("lang"), F.lit("other"))).alias("extra"))
    meta = payloads.point_metadata(F.col("payload"), F.col("extra"))
    return d.select("doc_id", F.sha2(payloads.point_text(F.col("payload")), 256).alias("digest"), meta["lang"].alias("lang"), payloads.meta_field(meta, F.col("extra"), "source").alias("source"))


@query("select conv_id, turn, lang, 'doc' || conv_id as document_id, case when turn % 2 = 0 then 'c' || turn else 'p__seq' || turn || '__' || left(sha1(text), 8) end as chunk_id, 'child' as kind, sha256(left(text, 1000)) as preview from (select c.conv_id, c.turn, c.text, d.lang from conversations c left join documents d on d.doc_id = c.conv_id)")
def chunk_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their document's fields and the defaults of a point's payload."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("seq"), "text", F.concat(F.lit("doc"), F.col("conv_id").cast("string")).alias("document_id"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("c"), F.col("turn").cast("string"))).alias("chunk_id"))
    d = read_table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("document_id"), "lang")
    made = payloads.point_payload(payloads.with_document_fields(c, d), "text", kind="child", key="chunk_id", prefix=F.lit("p"))
    return made.select("conv_id", "turn", F.col("extra")["lang"].alias("lang"), "document_id", "chunk_id", "kind", F.sha2("_preview", 256).alias("preview"))


@query(r"select c_custkey, concat_ws(';', case when length(c_name) > 18 then 'name' end, case when c_mktsegment = 'MACHINERY' then 'role' end, case when c_custkey % 3 = 0 then 'email' end, case when c_acctbal < 0 then 'years' end) as errors from customer where length(c_name) > 18 or c_mktsegment = 'MACHINERY' or c_custkey % 3 = 0 or c_acctbal < 0")
def row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of people that break a rule, and which."""
    c = read_table(spark, sf_dir, "customer")
    name = F.when(F.char_length("c_name") > 18, F.repeat("c_name", F.lit(10))).otherwise(F.col("c_name"))
    role = F.when(F.col("c_mktsegment") == "MACHINERY", "  ").otherwise(F.col("c_mktsegment"))
    email = F.when(F.col("c_custkey") % 3 == 0, "a@host").when(F.col("c_custkey") % 3 == 1, "A@host.Example")
    return c.select("c_custkey", payloads.person_errors(name, role, email, F.col("c_acctbal")).alias("errors")).where("errors <> ''")


@query("select 'team' as collection, count(*) as n_points, count(*) > 0 as healthy from nation union all select 'modules', count(*), count(*) > 0 from supplier union all select 'none', 0, false")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table and whether it has any."""
    n = read_table(spark, sf_dir, "nation")
    return store.collection_report({"team": n, "modules": read_table(spark, sf_dir, "supplier"), "none": n.limit(0)})


@query("with p as (select vec_id from embeddings where vec_id % 10 <> 0), e as (select vec_id from embeddings where vec_id % 7 <> 0) select (select count(*) from e) as n_expected, (select count(*) from e where vec_id not in (select vec_id from p)) as n_missing, (select count(*) from p where vec_id not in (select vec_id from e)) as n_stray")
def index_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without a point and points without a chunk."""
    e = read_table(spark, sf_dir, "embeddings")
    points = e.where("vec_id % 10 <> 0").select(ids.uuid5(F.col("vec_id").cast("string")).alias("id"))
    return store.verified(points, e.where("vec_id % 7 <> 0"), "vec_id")


@query("""with e as (select label, vec_id, len(embedding) as dim, vec_id % 2 = 1 and label % 2 = 0 and vec_id < (select max(vec_id) / 2 from embeddings) as later from embeddings)
select label, count(*) as n_points, cast(min(dim) as bigint) as least_dim, coalesce(max(vec_id) filter (later), max(vec_id) filter (vec_id % 2 = 0)) as newest from e group by label having count(*) filter (later or vec_id % 2 = 0) > 0""")
def points_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of labels: those written later stay, though most of them have the smaller payload; labels that are not written again stay as they were."""
    e = read_table(spark, sf_dir, "embeddings")
    later = (F.col("vec_id") % 2 == 1) & (F.col("label") % 2 == 0) & (F.col("vec_id") < F.lit(e.agg(F.max("vec_id") / 2).first()[0]))
    point = lambda df: df.select(F.col("label").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("vector"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("payload"))
    base = store.upsert_points(point(e.limit(0)), point(e.where("vec_id % 2 = 0")))
    merged = store.upsert_points(base, point(e.where(later)))
    counts = e.groupBy(F.col("label").cast("string").alias("id")).agg(F.count("*").alias("n_points"))
    return merged.join(counts, "id").select(F.col("id").cast("long").alias("label"), "n_points", F.size("vector").cast("long").alias("least_dim"), F.col("payload").cast("long").alias("newest"))


# ---------------------------------------------------------------- questions over tables

#: Statements that the guard lets through or not; # stands for a word of a document, @ for its source.
_STATEMENTS = ["select #", "SELECT # FROM t;", "with x as (select #) select * from x", "select replace(#, 'b', 'c') from t", "select # -- drop it", "select x from # limit\n5", "delete from # where s = '@'", "", "select /* insert */ # from t", "SELECT updated FROM # where s = '@'", "select # from t where b = 'set'"]
_STATEMENT = "replace(replace({0}, '#', coalesce(nullif(regexp_extract(text, '[a-z]+', 0), ''), 'x')), '@', source)"
_FORBID = " ".join(f"when regexp_matches(n, '\\b{w}\\b') then 'Forbidden keyword detected: {w}'" for w in sqlqa.FORBIDDEN)


@query(rf"""with s as (select doc_id, {_STATEMENT.format(f'{_literal(_STATEMENTS)}[doc_id % {len(_STATEMENTS)} + 1]')} as sql from documents), n as (select doc_id, sql, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(sql, '(?s)/\*.*?\*/', '', 'g'), '--[^\n]*', '', 'g'), '^[\s;]+|[\s;]+$', '', 'g'), '\s+', ' ', 'g')) as n from s)
select doc_id, sha256(sql) as digest, case when sql = '' then 'Empty SQL query' when contains(sql, ';') then 'Only one statement is allowed (no semicolons).' when not starts_with(n, 'select ') then 'Only SELECT statements are allowed.' {_FORBID} else '' end as verdict from n""")
def sql_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the text guard on a statement for each document, made with its words."""
    held = F.element_at(F.array(*map(F.lit, _STATEMENTS)), (F.col("doc_id") % len(_STATEMENTS) + 1).cast("int"))
    s = read_table(spark, sf_dir, "documents").withColumn("statement", held).select("doc_id", F.expr(_STATEMENT.format("statement")).alias("sql"))
    return s.select("doc_id", F.sha2("sql", 256).alias("digest"), sqlqa.verdict(F.col("sql")).alias("verdict"))


def _team(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 1, "maintainer").otherwise("core-dev").alias("role")).createOrReplaceTempView("team")
    read_table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("owner_id")).createOrReplaceTempView("modules")


_TEAM = "team as (select n_nationkey as id, n_name as name, case when n_regionkey = 1 then 'maintainer' else 'core-dev' end as role from nation), modules as (select s_name as name, s_nationkey as owner_id from supplier)"


def _asked(spark, sf_dir, question, limit=sqlqa.LIMIT):
    _team(spark, sf_dir)
    sql, args = sqlqa.template(question)
    return sqlqa.ask(spark, sql, {"team", "modules"}, limit=limit, args=args)


@query(f"with {_TEAM} select name from team where role = 'maintainer' order by id limit 1")
def nlsql_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question after the lead."""
    return _asked(spark, sf_dir, "Who is the team lead?")


@query(f"with {_TEAM} select count(*) as count from team where role = 'core-dev'")
def nlsql_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counting question."""
    return _asked(spark, sf_dir, "Сколько core разработчиков?")


@query(f"with {_TEAM} select m.name from modules m join team t on m.owner_id = t.id where t.role = 'maintainer' and t.name = (select name from team where role = 'maintainer' order by id limit 1)")
def nlsql_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question after an owner's modules, the name as a parameter."""
    _team(spark, sf_dir)
    name = spark.sql("select name from team where role = 'maintainer' order by id limit 1").first()[0]
    return _asked(spark, sf_dir, f"Какие модули у maintainer {name}?", limit=None)


@query(f"with {_TEAM}, r as (select count(*) as n from team where role = 'core-dev') select 1::bigint as n_rows, cast(case when n = 0 then 0.3 else 0.9 end as double) as confidence from r")
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far an answer may be trusted."""
    return sqlqa.confidence(_asked(spark, sf_dir, "core-dev count"), limited=False)


#: Questions of one row, of as many rows as follow from the id, and (a user's number) of none; cells are numbers, zeros and words for nothing.
_CELL = "case when event_id % 50 = 0 then 'n/a' when event_id % 41 = 0 then '0' when event_id % 47 = 0 then 'Not found here' else event_type end"
_QUESTION = "case when event_id % 3 = 0 then 'one ' || cast(event_id as {0}) when event_id % 9 = 1 then 'all ' || event_type else 'some ' || cast(cast(floor(sqrt(event_id)) as bigint) as {0}) end"
_SAYS_NOTHING = " or ".join(f"contains(said, '{w}')" for w in sqlqa.NEGATIVE)


@query(f"""with a as (select {_QUESTION.format('varchar')} as question, {_CELL} as value from events),
g as (select question, count(*) as n_rows, bool_or(lower(trim(value)) in ('', 'none', 'null', 'n/a') or value = '0') as bad, case when count(*) = 1 then lower('{sqlqa.FOUND}' || max(value)) else '' end as said from a group by question),
q as (select question from g union select distinct 'user ' || cast(user_id as varchar) from events)
select question, coalesce(n_rows, 0) as n_rows, cast(case when n_rows is null then 0.1 when {_SAYS_NOTHING} then 0.2 when bad then 0.3 when n_rows >= 100 then 0.7 else 0.9 end as double) as confidence from q left join g using (question)""")
def confidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far many answers may be trusted, each by its rows: none, one, few or as many as a limit lets through."""
    e = read_table(spark, sf_dir, "events")
    rows = e.select(F.expr(_QUESTION.format("string")).alias("question"), F.expr(_CELL).alias("value"))
    got = sqlqa.confidence(rows, limited=True, by=["question"])
    none = e.select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("question")).distinct().join(got, "question", "left_anti")
    return got.unionByName(none.select("question", F.lit(0).cast("long").alias("n_rows"), F.lit(0.1).alias("confidence")))


# ---------------------------------------------------------------- reports


@query("select lang, source, count(*) as n_docs, cast(sum(n_chars) as bigint) as total_size, grouping_id(lang, source) as level from documents group by rollup (lang, source)")
def store_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sizes by language and source with subtotals."""
    return stats.store_rollup(read_table(spark, sf_dir, "documents"), ["lang", "source"], F.col("n_chars"))


@query("select count(*) as total, count(*) filter (n_chars >= 600) as n_ok, count(*) filter (n_chars < 100) as n_error, round(count(*) filter (n_chars >= 600) / (count(*) filter (n_chars >= 600) + count(*) filter (n_chars < 100)), 6) as success_rate from documents")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest counters and success rate, from two merged parts."""
    d = read_table(spark, sf_dir, "documents")
    part = lambda rows: stats.ingest_stats(rows, F.col("n_chars") >= 600, F.col("n_chars") < 100)
    return stats.merged(part(d.where("doc_id % 2 = 0")), part(d.where("doc_id % 2 = 1"))).withColumn("success_rate", F.round("success_rate", 6))


@query("select cast(date_trunc('day', ts) as timestamp) as start, event_type, count(*) as n from events group by all")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by kind of event."""
    return ingest.windowed_counts(read_table(spark, sf_dir, "events"), ts="ts", kind="event_type")


# ---------------------------------------------------------------- delegated SQL: the same text in both engines

_SHARED = {
    "sql_pricing": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus",
    "sql_join_revenue": "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(distinct o_orderkey) as n_orders from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey group by n_name having count(*) > 10",
    "sql_window": "select c_custkey, c_nationkey, rank() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as r, ntile(4) over (partition by c_nationkey order by c_acctbal, c_custkey) as quartile, dense_rank() over (order by c_mktsegment) as d from customer",
    "sql_cube": "select c_mktsegment, c_nationkey, count(*) as n, round(sum(c_acctbal), 2) as total from customer group by cube (c_mktsegment, c_nationkey)",
    "sql_grouping_sets": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())",
    "sql_set_ops": "select c_nationkey as k from customer except select s_nationkey from supplier union all (select p_size as k from part intersect select n_nationkey from nation)",
    "sql_semi_anti": "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000) and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')",
    "sql_outer": "select coalesce(c_nationkey, s_nationkey) as k, n_c, n_s from (select c_nationkey, count(*) as n_c from customer where c_acctbal > 5000 group by c_nationkey) c full outer join (select s_nationkey, count(*) as n_s from supplier where s_acctbal > 5000 group by s_nationkey) s on c_nationkey = s_nationkey",
    "sql_lateral": "select n_name, t.c_name, t.c_acctbal from nation, lateral (select c_name, c_acctbal, c_custkey from customer where c_nationkey = n_nationkey order by c_acctbal desc, c_custkey limit 2) t",
    "sql_theta": "select r_name, count(*) as n from region join nation on n_regionkey < r_regionkey group by r_name",
}


def _delegated(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem") if t in sql]
        return spark.sql(_braced(sql, names), **{t: read_table(spark, sf_dir, t) for t in names})

    return run


def _braced(sql: str, names: list[str]) -> str:
    import re

    return re.sub(rf"\b(from|join|,)\s+({'|'.join(names)})\b", r"\1 {\2}", sql)


for _name, _text in _SHARED.items():
    QUERIES[_name] = _delegated(_text)
    ORACLES[_name] = _text
