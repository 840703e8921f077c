"""Prompts and answers from retrieved evidence or tables, with an injectable generator."""
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import retrieval, sqlqa

# The parts of a prompt.
INTRO = "Based on the following documents, please answer the question."
OUTRO = "Please provide a comprehensive answer with citations where appropriate."
NONE = "No relevant context found. Please respond accordingly."
SYSTEM = """You are a helpful AI assistant that answers questions based on the provided context documents.

Instructions:
1. Answer the question using ONLY the provided context
2. If the context doesn't contain relevant information, say so
3. Be precise and factual
4. Cite sources using [number] notation where number corresponds to the source reference
5. If multiple sources support your answer, cite all relevant ones [1][2]
6. Don't make up information or use external knowledge"""


def echo(prompt: str) -> str:
    """The generator that stands in where none is set."""
    return f"Echo response (LLM not configured): {prompt[:100]}..."


def system_prompt(policy: str | None = None) -> str:
    return SYSTEM + (f"\nAdditional policy: {policy}" if policy else "")


def source_label(title: Column, page: Column, section: Column, n: Column) -> Column:
    """`Source: … | Page: … | Section: …` of what is known, else `Reference n`."""
    parts = F.concat_ws(" | ", *[F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{k}: "), c)) for k, c in (("Source", title), ("Page", page), ("Section", section))])
    return F.when(parts == "", F.concat(F.lit("Reference "), n.cast("string"))).otherwise(parts)


def user_prompts(questions: DataFrame, evidence: DataFrame, *, query: str = "query_id", question: str = "question", text: str = "text", score: str = "score", id_: str = "point_id", label: Column | None = None) -> DataFrame:
    """query_id and prompt of each question; evidence in order of score, bounded by the token budget before."""
    from pyspark.sql import Window

    w = Window.partitionBy(query).orderBy(F.desc(score), F.col(id_))
    numbered = evidence.withColumn("_i", F.row_number().over(w))
    head = F.concat(F.lit("[Source "), F.col("_i").cast("string"), F.lit("] "), label if label is not None else F.concat(F.lit("Reference "), F.col("_i").cast("string")), F.lit("\n"), F.col(text))
    folded = numbered.groupBy(query).agg(F.sort_array(F.collect_list(F.struct("_i", head.alias("b")))).alias("bs"))
    ask = F.concat(F.lit("QUESTION: "), F.col(question))
    context = F.concat(F.lit("CONTEXT DOCUMENTS:\n"), F.array_join(F.transform("bs", lambda s: s["b"]), "\n\n"))
    full = F.concat_ws("\n\n", F.lit(INTRO), context, ask, F.lit(OUTRO))
    return questions.join(folded, query, "left").select(query, F.when(F.col("bs").isNull(), F.concat(ask, F.lit("\n\n" + NONE))).otherwise(full).alias("prompt"))


def from_documents(questions: DataFrame, parents: DataFrame, children: DataFrame, *, generate: Callable[[str], str] = echo, tokens: int = 4000, **settings) -> list[dict]:
    """Answers of a bounded list of questions (query_id, question, query_vec) with prompt and citations; the settings reach the retriever."""
    found = retrieval.retrieve(questions.select("query_id", "query_vec"), parents, children, **settings)
    best = retrieval.distinct_evidence(found, query="query_id", text="text", score="score", id_="point_id")
    best = retrieval.within_budget(best, query="query_id", question_tokens=0, text="text", score="score", id_="point_id", tokens=tokens)
    cited = retrieval.citations(best, query="query_id", text="text", score="score", id_="point_id").collect()
    out = []
    for r in user_prompts(questions, best).collect():
        refs = [{"id": c.point_id, "text": c.preview, "score": c.score} for c in cited if c.query_id == r.query_id]
        out.append({"query_id": r.query_id, "prompt": r.prompt, "answer": generate(r.prompt), "citations": refs})
    return out


def from_tables(spark: SparkSession, question: str, tables: set[str], *, to_sql: Callable[[str], tuple[str, dict]] = sqlqa.template, dry_run: bool = False) -> dict:
    """Query, phrase, rows, confidence and citations of a question; a refused query gives its reason."""
    sql, args = to_sql(question)
    try:
        df = sqlqa.ask(spark, sql, tables, args=args)
    except sqlqa.Refused as e:
        return {"sql": sql, "guarded": True, "answer": str(e), "data": [], "confidence": 0.1, "citations": []}
    if dry_run:
        return {"sql": sql, "guarded": False, "answer": "", "data": [], "confidence": 0.1, "citations": []}
    rows = sqlqa.within(spark, df)
    held = spark.createDataFrame(rows, df.schema)
    level = sqlqa.confidence(held, "limit" in sql.lower()).first().confidence
    cited = [r[0] for r in held.select(sqlqa.cells(held)).collect()]
    return {"sql": sql, "guarded": False, "answer": sqlqa.phrase(rows, df.columns), "data": [r.asDict() for r in rows], "confidence": level, "citations": cited}


def render_schema(spark: SparkSession, tables: list[str]) -> str:
    """`table(column type, …)` of each table, one a line."""
    return "\n".join(f"{t}({', '.join(f'{n} {k}' for n, k in spark.table(t).dtypes)})" for t in sorted(tables))


def inner_for_relations(sql: str, question: str) -> str:
    """Left joins made inner where the question is about relations."""
    import re

    # fixed values: stems that tell such a question
    asks = any(k in question.lower() for k in ("модул", "владел", "отвеча", "связ", "отношен"))
    return re.sub(r"(?i)\bleft\s+(outer\s+)?join\b", "INNER JOIN", sql) if asks else sql
