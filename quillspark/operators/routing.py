"""Routing of questions by keyword and pattern scores."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import normalize_query

# Keywords of each route.
DOCS = (
    "transformers", "huggingface", "hugging face", "pipeline", "tokenizer",
    "model", "bert", "gpt", "transformer", "attention", "fine-tuning",
    "fine-tune", "pre-training", "dataset", "datasets", "trainer", "training",
    "inference", "pipelines",
    "auto", "config", "configuration", "tokenization", "vocab", "weights",
    "checkpoint", "hub", "repository", "repo", "github", "documentation",
    "example", "tutorial", "guide", "how to", "usage", "using", "apply",
    "application", "implement", "implementation", "class", "function", "method",
    "parameter", "argument", "return", "code", "source code", "api", "reference",
    "whisper", "clip", "blip", "detr", "yolos", "perceiver", "vision", "text",
    "multimodal", "encoder", "decoder", "seq2seq", "encoder-decoder", "causal",
    "autoregressive", "masked", "language", "audio", "image",
    "embedding", "layer", "head", "pooler", "activation", "normalization",
    "dropout", "optimizer", "scheduler", "loss", "metric", "evaluation",
    "validation", "callback", "utility", "processor", "feature extractor",
    "model card", "model_card", "readme", "license", "tokenizer.json",
    "config.json", "pytorch_model.bin", "tf_model.h5", "flax_model.msgpack",
    "safetensors", "generation", "utils", "processing",
)
SQL = (
    "сколько", "count",
    "кто", "команда", "сотрудник", "тимлид", "разработчик", "опыт", "лет",
    "team", "employee", "staff", "member", "lead", "manager",
    "модуль", "владелец", "отвечает", "ответственный", "роль", "должность",
    "стаж", "опыт работы", "состав", "команды", "участник", "член команды",
    "контакт", "почта", "email", "город", "локация",
    "core-dev", "maintainer", "инфра", "docs", "vision", "nlp", "audio", "training",
)
WEB = (
    "в интернете", "гугл", "google", "поиск", "twitter", "reddit", "hn",
    "stack overflow", "stackoverflow", "форум", "github issue",
    "актуальные новости", "последн", "релиз сегодня", "новост", "пресс-релиз",
    "за пределами документации", "за пределами", "обсуждение", "issue", "bug",
    "problem", "error",
)
# Patterns of docs and web.
DOCS_PATTERNS = (
    r"\b(CVE-\d{4}-\d{4,7})\b",
    r"\b(XSpider|MaxPatrol)\b",
    r"\b(BERT|GPT-2|GPT-3|RoBERTa|DistilBERT|Transformer|T5|BART|XLNet)\b",
    r"\b(AutoModel|AutoTokenizer|AutoConfig|BertModel|BertTokenizer|GPT2Model|GPT2Tokenizer)\b",
    r"\b(pipeline|Pipeline)\s+[\"']([^\"']+)[\"']",
    r"from_pretrained\([\"']([^\"']+)[\"']\)",
    r"\.from_pretrained\([\"']([^\"']+)[\"']\)",
    r"transformers\.\w+\.\w+",
)
WEB_PATTERNS = (
    r"\b(в\s+интернете|в\s+сети)\b",
    r"\b(последн(ий|яя|ее)\s+релиз)\b",
    r"\b(stack\s+overflow|stackoverflow)\b",
    r"\b(github\s+issue|issue\s+#\d+)\b",
)
#: Weights of a keyword and of a pattern by route.
WEIGHTS = {"docs": (1.0, 1.5), "sql": (1.0, 1.5), "web": (1.2, 1.5)}
RULES = {"docs": (DOCS, DOCS_PATTERNS), "sql": (SQL, ()), "web": (WEB, WEB_PATTERNS)}
PRIORITY, LEAST = ("docs", "sql", "web"), 0.6


def raw_score(q: Column, route: str) -> Column:
    """Weighted hits of a route's keywords (as substrings) and patterns in a normal question."""
    words, patterns = RULES[route]
    w, p = WEIGHTS[route]
    hits = F.size(F.filter(F.array(*map(F.lit, words)), lambda k: q.contains(k)))
    found = F.lit(0)
    for x in patterns:
        found = found + q.rlike(f"(?iU){x}").cast("int")
    return (w * hits + p * found).cast("double")


def scored(df: DataFrame, text: str) -> DataFrame:
    """df with docs, sql and web scores over the highest, 0 without hits; columns of these names are replaced."""
    raw = df.select(F.struct(*df.columns).alias("row"), normalize_query(F.col(text)).alias("q"))
    raw = raw.select("row", *[raw_score(F.col("q"), r).alias(r) for r in RULES])
    top = F.greatest(*RULES)
    return raw.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in RULES], *[F.when(top > 0, F.col(r) / top).otherwise(0.0).alias(r) for r in RULES])


def pick(df: DataFrame, least: float = LEAST, priority: tuple = PRIORITY, combine: bool = False) -> DataFrame:
    """df with route: the routes that score at least `least` in order of priority; the first alone unless combined."""
    good = F.filter(F.array(*[F.when(F.col(r) >= least, F.lit(r)) for r in priority]), lambda x: x.isNotNull())
    return df.withColumn("route", F.array_join(good if combine else F.slice(good, 1, 1), ","))


def ranked(least: float = LEAST) -> Column:
    """The routes that score at least `least`, best first, ties by priority."""
    each = F.array(*[F.when(F.col(r) >= least, F.struct((-F.col(r)).alias("s"), F.lit(i).alias("i"), F.lit(r).alias("r"))) for i, r in enumerate(PRIORITY)])
    return F.transform(F.array_sort(F.array_compact(each)), lambda x: x["r"])


def known_routes(labels: Column) -> Column:
    """Labels (trimmed, lower-cased) that are routes, each once."""
    return F.array_intersect(F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), F.array(*map(F.lit, PRIORITY)))


def parsed_labels(reply: Column) -> Column:
    """struct(route, confidence) of a model's JSON reply, which may stand in a fence; docs at 0.6 if it tells no known route."""
    got = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "route array<string>, confidence double, rationale string")
    routes = known_routes(got["route"])
    good = F.size(routes) > 0
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(got["confidence"], F.lit(0.6))))
    return F.struct(F.when(good, routes).otherwise(F.array(F.lit("docs"))).alias("route"), F.when(good, sure).otherwise(0.6).alias("confidence"))


def routed(df: DataFrame, text: str, *, mode: str = "rules", reply: str | None = None, boosts: dict[str, Column] | None = None, least: float = LEAST, priority: tuple = PRIORITY, combine: bool = False) -> DataFrame:
    """df with route (array) and route_confidence of each question.

    rules: keyword scores; llm: a column with a model's reply; hybrid: the best of
    both (the model's confidence times 0.8) and of boosts. Without a route that
    is sure enough it is docs.
    """
    held = scored(df.select(F.struct(*df.columns).alias("row"), F.col(text).alias("question"), (F.col(reply) if reply else F.lit(None).cast("string")).alias("reply"), *[c.alias(f"boost_{r}") for r, c in (boosts or {}).items()]), "question")
    told = parsed_labels(F.col("reply"))
    if mode == "llm":
        sure = told["confidence"]
        routes = F.when(sure >= least, told["route"]).otherwise(F.array(F.lit("docs")))
    else:
        if mode == "hybrid":
            held = held.withColumn("told", told)
            for r in PRIORITY:
                said = F.when(F.array_contains("told.route", r), F.col("told.confidence")).otherwise(0.0)
                held = held.withColumn(r, hybrid(F.col(r), said, F.coalesce(F.col(f"boost_{r}").cast("double"), F.lit(0.0)) if boosts and r in boosts else F.lit(0.0)))
        best_first = ranked(least)
        routes = F.when(F.size(best_first) > 0, best_first).otherwise(F.array(F.lit("docs")))
        sure = F.greatest(*PRIORITY)
    in_order = F.filter(F.array(*map(F.lit, priority)), lambda p: F.array_contains(routes, p))
    return held.select("row.*", (in_order if combine else F.slice(in_order, 1, 1)).alias("route"), sure.alias("route_confidence"))


def combined(scores: DataFrame, group: str, label: str, score: str, weight: str | None = None) -> DataFrame:
    """group, label, score: weighted sums of the rows of several score tables; sums are partial before the shuffle."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return scores.groupBy(group, label).agg(F.sum(F.col(score) * w).alias(score))


def tool_output(answer: Column, confidence: Column, tool: Column) -> Column:
    """struct(answer, confidence) of a tool: a blank answer says so, at seven tenths of its confidence but 0.3 at least."""
    text_, sure = F.coalesce(answer, F.lit("")), F.coalesce(confidence.cast("double"), F.lit(0.5))
    blank = ~text_.rlike(r"\S")
    # fixed value: what stands for an empty answer
    none = F.concat(F.lit("Инструмент "), tool, F.lit(" не вернул содержательного ответа."))
    return F.struct(F.when(blank, none).otherwise(text_).alias("answer"), F.when(blank, F.greatest(F.lit(0.3), sure * 0.7)).otherwise(sure).alias("confidence"))


def synthesized(outputs: DataFrame, group: str, *, tool: str = "tool", answer: str = "answer", confidence: str = "confidence") -> DataFrame:
    """Each group's best tool output, normalised; ties by tool."""
    held = outputs.select(group, F.col(tool).alias("tool"), tool_output(F.col(answer), F.col(confidence), F.col(tool)).alias("o"))
    got = held.groupBy(group).agg(F.max_by(F.struct("tool", "o"), F.struct("o.confidence", "tool")).alias("x"))
    return got.select(group, F.col("x.tool").alias("tool"), F.col("x.o.answer").alias("answer"), F.col("x.o.confidence").alias("confidence"))


def hybrid(rule: Column, model: Column, hint: Column) -> Column:
    """The highest of the rule's score, 0.8 of the model's, and a hint's boost."""
    return F.greatest(rule, model * 0.8, hint)


def best(df: DataFrame, group: str, answer: str, score: str) -> DataFrame:
    """Each group's answer of the highest score, ties by the answer."""
    return df.groupBy(group).agg(F.max_by(answer, F.struct(F.col(score), F.col(answer))).alias(answer), F.max(score).alias(score))


def run_until(df: DataFrame, group: str, order: str, score: str, enough: Column) -> DataFrame:
    """Rows of a group up to and with the first whose score is enough."""
    from pyspark.sql import Window

    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max((F.col(score) >= enough).cast("int")).over(before), F.lit(0))
    return df.select(F.struct(*df.columns).alias("row"), done.alias("done")).where("done = 0").select("row.*")
