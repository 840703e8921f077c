"""Questions over tables: templates, a guard, limits, answers and their confidence."""
import re
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that a guarded query may not have, and words of an answer that stand for none.
FORBIDDEN = ("insert", "update", "delete", "alter", "drop", "create", "truncate", "vacc?uum", "pragma", "attach", "detach", "grant", "revoke", "set", "replace")
EMPTY_VALUES = ("", "none", "null", "n/a")
LIMIT, TIMEOUT_S = 100, 5
# What an answer says that found nothing.
NEGATIVE = ("не найд", "нет данных", "не существует", "отсутств", "no data", "not found", "does not exist", "empty", "unknown", "ничего", "nothing")
# The phrases of answers.
NO_DATA, ONE_ROW, FOUND, ROWS, COLUMNS = "Данные не найдены.", "Найдена 1 запись.", "Найдено: ", "Найдено записей: ", " Колонки: "


def normalized(sql: Column) -> Column:
    """Comments out, blanks collapsed, no semicolon at the ends."""
    c = F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", ""), r"--[^\n]*", "")
    return F.regexp_replace(F.regexp_replace(c, r"^[\s;]+|[\s;]+$", ""), r"\s+", " ")


def verdict(sql: Column) -> Column:
    """Why a query is refused; empty if it is not."""
    low = F.lower(normalized(sql))
    out = F.lit("")
    for word in reversed(FORBIDDEN):
        out = F.when(low.rlike(rf"\b{word}\b"), f"Forbidden keyword detected: {word}").otherwise(out)
    out = F.when(~low.startswith("select "), "Only SELECT statements are allowed.").otherwise(out)
    out = F.when(sql.contains(";"), "Only one statement is allowed (no semicolons).").otherwise(out)
    return F.when(F.coalesce(sql, F.lit("")) == "", "Empty SQL query").otherwise(out)


class Refused(ValueError):
    """A query that the guard does not let through."""


def guard(spark: SparkSession, sql: str, tables: set[str]) -> bool:
    """Checks a query's text and its parsed plan; whether it has a limit at its root.

    Beyond the text rules, the plan may hold no command, read only the given
    tables (no files by path), and call no JVM method.
    """
    why = spark.range(1).select(verdict(F.lit(sql))).first()[0]
    if why:
        raise Refused(why)
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    shape = plan.toString()
    root = plan.nodeName()
    if root not in ("Project", "GlobalLimit", "Aggregate", "Sort", "Distinct", "Filter", "Union", "Intersect", "Except", "WithCTE", "UnresolvedWith", "UnresolvedHaving", "Except All", "Intersect All") and "Unresolved" not in root:
        raise Refused(f"Only queries are allowed, not {root}.")
    if re.search(r"'?(reflect|java_method|try_reflect)\(", shape, re.I):
        raise Refused("Calls into the JVM are not allowed.")
    for name in re.findall(r"UnresolvedRelation \[([^\]]*)\]", shape):
        if name.replace(", ", ".").lower() not in tables:
            raise Refused(f"Unknown table: {name}")
    return root == "GlobalLimit"


def ask(spark: SparkSession, sql: str, tables: set[str], *, limit: int | None = LIMIT, args: dict | None = None) -> DataFrame:
    """A guarded query, limited unless it limits itself or limit is None."""
    limited = guard(spark, sql, tables)
    df = spark.sql(sql, args=args) if args else spark.sql(sql)
    return df if limited or limit is None else df.limit(limit)


def within(spark: SparkSession, df: DataFrame, seconds: float = TIMEOUT_S) -> list:
    """Rows of a limited answer, or an error once the time is over."""
    tag = f"ask-{id(df)}"
    spark.addTag(tag)
    timer = threading.Timer(seconds, lambda: spark.interruptTag(tag))
    timer.start()
    try:
        return df.collect()
    finally:
        timer.cancel()
        spark.removeTag(tag)


# The questions that rules know and their queries.
def template(question: str) -> tuple[str, dict]:
    """The query of a question's first matching rule over team(id, name, role) and modules(name, owner_id), with its named parameters."""
    q = question.lower().strip()
    if "тимлид" in q or "team lead" in q:
        return "SELECT t.name FROM team AS t WHERE t.role = :role ORDER BY t.id ASC LIMIT 1", {"role": "maintainer"}
    if ("сколько" in q and "core" in q) or "core-dev" in q:
        return "SELECT COUNT(*) AS count FROM team AS t WHERE t.role = :role", {"role": "core-dev"}
    if "какие модули у" in q and "maintainer" in q:
        name = q.split("maintainer", 1)[1].strip().strip("?").strip()
        return "SELECT m.name FROM modules AS m JOIN team AS t ON m.owner_id = t.id WHERE lower(t.name) = :name AND t.role = :role ORDER BY m.name ASC", {"name": name, "role": "maintainer"}
    if "токенизац" in q or "token" in q:
        return "SELECT m.name FROM modules AS m WHERE lower(m.name) LIKE :like LIMIT 100", {"like": "%token%"}
    if "trainer" in q:
        return "SELECT t.name, t.role FROM team AS t JOIN modules AS m ON m.owner_id = t.id WHERE m.name = :name LIMIT 100", {"name": "transformers.trainer"}
    return "SELECT name, role FROM team LIMIT 10", {}


#: Questions that show a model what is wanted; their queries are those of the rules.
EXAMPLES = ("Who is the team lead?", "How many core-dev are there?", "Which modules are about token?", "Who owns trainer?")


def messages(question: str, schema: str, examples: tuple[str, ...] = EXAMPLES) -> list[dict[str, str]]:
    """Messages for a model that writes the query: rules and schema, worked examples, the question."""
    rules = f"Answer with one {'SELECT'} statement and nothing else. Use only the tables below, no comments, no semicolon, at most {LIMIT} rows. Forbidden: {', '.join(FORBIDDEN)}."
    out = [{"role": "system", "content": f"{rules}\n\nTables:\n{schema}"}]
    for q in examples:
        sql, args = template(q)
        for k, v in args.items():
            sql = sql.replace(f":{k}", "'" + str(v).replace("'", "''") + "'")
        out += [{"role": "user", "content": q}, {"role": "assistant", "content": sql}]
    return [*out, {"role": "user", "content": question}]


def phrase(rows: list, columns: list[str]) -> str:
    """An answer's sentence by the shape of its rows."""
    if not rows:
        return NO_DATA
    if len(rows) == 1:
        return f"{FOUND}{rows[0][0]}" if len(columns) == 1 else ONE_ROW
    return f"{ROWS}{len(rows)}." + (f"{COLUMNS}{', '.join(columns)}" if columns and len(columns) <= 5 else "")


def empty_cell(c: Column) -> Column:
    """Null, zero (false too) or a word for none."""
    s = c.cast("string")
    return F.coalesce(F.lower(F.trim(s)).isin(*EMPTY_VALUES) | (s == "false") | s.rlike(r"^-?0(\.0+)?$"), F.lit(True))


def phrased(answer: DataFrame) -> Column:
    """phrase() of an answer's rows, as an aggregate."""
    n, names = F.count("*"), answer.columns
    one = F.concat(F.lit(FOUND), F.coalesce(F.max(F.col(names[0]).cast("string")), F.lit("None"))) if len(names) == 1 else F.lit(ONE_ROW)
    many = F.concat(F.lit(ROWS), n.cast("string"), F.lit("." + (f"{COLUMNS}{', '.join(names)}" if len(names) <= 5 else "")))
    return F.when(n == 0, NO_DATA).when(n == 1, one).otherwise(many)


def confidence(answer: DataFrame, limited: bool, said: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Rows and confidence of an answer: 0.1 without rows, 0.2 if what is said (by default its phrase) tells that nothing was found, 0.3 with an empty cell, 0.7 if a limit may have cut it, else 0.9.

    One row; by: a row for each answer that the rows of these columns make up (one
    without rows has none).
    """
    by = by or []
    rows = answer.select(*[F.col(c) for c in answer.columns if c not in by])
    bad = F.lit(False)
    for c in rows.columns:
        bad = bad | empty_cell(F.col(c))
    text = phrased(rows) if said is None else F.lit(said)
    got = answer.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad"), F.lower(text).alias("said"))
    negative = F.lit(False)
    for word in NEGATIVE:
        negative = negative | F.col("said").contains(word)
    level = F.when(F.col("n") == 0, 0.1).when(negative, 0.2).when(F.col("bad"), 0.3).when(F.lit(limited) & (F.col("n") >= LIMIT), 0.7).otherwise(0.9)
    return got.select(*by, F.col("n").alias("n_rows"), level.alias("confidence"))


def cells(df: DataFrame) -> Column:
    """A row as `k: v, k: v`."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in df.columns])
