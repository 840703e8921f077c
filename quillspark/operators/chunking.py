"""Markdown blocks, chunks with budgets, neighbours and parents."""
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.functions import ids
from quillspark.functions.text import ABBREVIATIONS, n_tokens

# Names of code languages.
LANGUAGES = {"py": "python", "sh": "bash", "md": "markdown", "txt": "text"}
CHUNK = "seq int, chunk_size int, char_start int, char_end int, h_path array<string>, has_code boolean, has_table boolean, code_lang string, text string"


@dataclass(frozen=True)
class Budget:
    """Limits of a chunk; a document has at most max_chunks (None: as many as it gives)."""

    max_tokens: int = 420
    max_sentences: int = 8
    overlap: int = 2
    min_chars: int = 180
    max_chunks: int | None = 60
    code_tokens: int = 300
    code_chars: int = 1600
    #: Literal behaviour at tables (header and separator only) and at paragraphs glued to code (told twice).
    compat: bool = False


def estimate(text: str) -> int:
    """Estimated tokens of a text."""
    return max(1, len(text) // 4) if text else 0


_FENCE = re.compile(r"(?P<mark>```|~~~)(?P<lang>[\w+\-]*)\n.*?(?P=mark)", re.S | re.A)
_HEADING = re.compile(r"^[ \t]*(?P<level>##|###)[ \t]+(?P<title>.+)$", re.M)
_ROW = re.compile(r"\|.+\|")
_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$", re.M)
_BLANK = re.compile(r"\n\n")
_PROTECTED = re.compile("|".join(map(re.escape, ABBREVIATIONS)))
_END = re.compile(r"[.!?] *(?=[A-Z\"'(\[])|\n\n+|(?:(?<=\n)|\A)• ?")
_SOFT = re.compile(r"[;•—,](?:\s+|$)")


def sentence_list(text: str) -> list[str]:
    """Sentences of a paragraph, by the rules of quillspark.functions.text.sentences."""
    safe = _PROTECTED.sub(lambda m: m[0].replace(".", "∯"), text)
    out, at = [], 0
    for m in _END.finditer(safe):
        out.append(safe[at : m.start() + (m[0][0] in ".!?")])
        at = m.end()
    return [s for s in (x.replace("∯", ".").strip() for x in [*out, safe[at:]]) if s]


def blocks(text: str, compat: bool = False) -> list[tuple[int, int, str, str | None]]:
    """(start, end, kind, language) of code, table, h2, h3, p and empty blocks, in order."""
    taken: list[tuple[int, int, str, str | None]] = [(m.start(), m.end(), "code", (m["lang"] or "").lower() or None) for m in _FENCE.finditer(text)]
    free = lambda a: all(not s <= a < e for s, e, *_ in taken)
    for m in _RULE.finditer(text):
        if not free(m.start()):
            continue
        head = text.rfind("\n", 0, max(0, m.start() - 1)) + 1
        start = head if m.start() and _ROW.fullmatch(text[head : m.start() - 1].strip()) else m.start()
        end = m.end()
        while not compat and end < len(text):
            stop = text.find("\n", end + 1)
            stop = len(text) if stop < 0 else stop
            if not _ROW.fullmatch(text[end + 1 : stop].strip()):
                break
            end = stop
        taken.append((start, end, "table", None))
    for m in _HEADING.finditer(text):
        if free(m.start()):
            taken.append((m.start(), m.end(), "h2" if m["level"] == "##" else "h3", None))
    taken.sort()
    out, at = list(taken), 0
    for start, end, *_ in [*taken, (len(text), len(text), "", None)]:
        piece_at = at
        for piece in _BLANK.split(text[at:start]) if at < start else []:
            if piece:
                out.append((piece_at, piece_at + len(piece), "p" if piece.strip() else "empty", None))
            piece_at += len(piece) + 2
        if compat and at < start and text[at:start].strip() and not text[at:start].endswith("\n\n") and end > start:
            # literal: a paragraph runs on to the next blank line, over what it is glued to
            stop = text.find("\n\n", start)
            last = max(i for i, b in enumerate(out) if b[2] in ("p", "empty"))
            out[last] = (out[last][0], len(text) if stop < 0 else stop, out[last][2], None)
        at = max(at, end)
    return sorted(out, key=lambda b: b[0])


@dataclass
class _Packer:
    """Sentences waiting for a chunk, and the chunks made."""

    budget: Budget
    title: str | None
    section: str | None
    wait: list = field(default_factory=list)
    made: list = field(default_factory=list)
    seen: set = field(default_factory=set)
    h2: str | None = None
    h3: str | None = None

    def path(self) -> list[str]:
        tail = self.section.strip("/").split("/")[-1] if self.section else None
        return [x for x in (tail, self.title, self.h2, self.h3) if x][:3]

    def add(self, text: str, start: int, end: int, kind: str = "p", lang: str | None = None) -> None:
        if len(text) >= self.budget.min_chars and text not in self.seen:
            self.seen.add(text)
            self.made.append((len(self.made) + 1, estimate(text), start, end, self.path(), kind == "code", kind == "table", LANGUAGES.get(lang, lang), text))

    def flush(self, keep: bool = True) -> None:
        if self.wait:
            self.add(" ".join(s for s, *_ in self.wait).strip(), self.wait[0][1], self.wait[-1][2])
            self.wait = self.wait[-self.budget.overlap :] if keep and self.budget.overlap else []

    def full(self, extra: list) -> bool:
        held = [*self.wait, *extra]
        return estimate(" ".join(s for s, *_ in held)) > self.budget.max_tokens or len(held) > self.budget.max_sentences

    def sentence(self, s: str, start: int, end: int) -> None:
        long = estimate(s) > self.budget.max_tokens
        if not self.wait or not self.full([(s, start, end)]):
            self.wait.append((s, start, end))
            return
        self.flush(keep=False)
        if not long:
            self.wait.append((s, start, end))
            return
        for part in filter(None, map(str.strip, _SOFT.split(s))):
            if estimate(part) > self.budget.max_tokens:
                self.add(part, start, end)
            else:
                self.wait.append((part, start, end))
                if self.full([]):
                    self.flush(keep=False)


def _pieces(body: str, budget: Budget) -> list[str]:
    """A long code block or table, cut at blank lines to the budget."""
    fits = lambda x: estimate(x) <= budget.code_tokens and len(x) <= budget.code_chars
    out, acc = [], ""
    for part in [body] if fits(body) else re.split(r"\n{2,}", body):
        both = f"{acc}\n\n{part}".strip()
        if acc and not fits(both):
            out.append(acc.strip())
            acc = part
        else:
            acc = both
    return [x for x in [*out, acc.strip()] if x]


def split_document(text: str, title: str | None = None, section: str | None = None, budget: Budget = Budget()) -> list[tuple]:
    """Chunks of a document, in the columns of CHUNK."""
    p = _Packer(budget, title, section)
    for start, end, kind, lang in blocks(text or "", budget.compat):
        body = text[start:end]
        if kind != "p":
            p.flush()
        if kind in ("h2", "h3"):
            name = re.sub(r"^\s*#{1,6}\s*", "", body).strip()
            p.h2, p.h3 = (name, None) if kind == "h2" else (p.h2, name)
        elif kind in ("code", "table"):
            for piece in _pieces(body.strip(), budget):
                p.add(piece, start, end, kind, lang)
        elif kind == "p":
            at = 0
            for s in sentence_list(body):
                found = body.find(s, at)
                at = found if found >= 0 else at
                p.sentence(s, start + at, start + at + len(s))
                at += len(s)
    p.flush()
    return p.made[: budget.max_chunks]


def chunk_documents(docs: DataFrame, *, doc: str, text: str, title: str | None = None, section: str | None = None, budget: Budget = Budget()) -> DataFrame:
    """One row per chunk: the document's id (as a string), chunk_id, and CHUNK. A narrow map; a task holds one Arrow batch."""
    src = docs.select(F.col(doc).cast("string").alias("document_id"), F.col(text).alias("t"), (F.col(title) if title else F.lit(None)).cast("string").alias("ti"), (F.col(section) if section else F.lit(None)).cast("string").alias("se"))
    names = [f.strip().split(" ")[0] for f in CHUNK.split(",")]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, *c) for d, t, ti, se in frame.itertuples(index=False) for c in split_document(t or "", ti, se, budget)]
            yield pd.DataFrame(rows, columns=["document_id", *names])

    out = src.mapInPandas(each, f"document_id string, {CHUNK}")
    return out.withColumn("chunk_id", ids.chunk_id(F.col("document_id"), F.col("seq"), F.col("text")))


def register(spark: SparkSession, name: str = "chunk", budget: Budget = Budget()) -> None:
    """Make the chunker a table function of SQL: `SELECT d.id, c.* FROM docs d, LATERAL chunk(d.text) c`, with title and section as further arguments.

    Its rows are those of CHUNK; a null or empty text has none. By TABLE(docs PARTITION
    BY id ORDER BY part) the function `<name>_parts` chunks texts that lie in several
    rows: those of a partition, in order, joined by blank lines.
    """

    class Chunk:
        def eval(self, text: str, title: str | None = None, section: str | None = None):
            yield from split_document(text or "", title, section, budget)

    class Parts:
        def __init__(self):
            self.key, self.parts = None, []

        def eval(self, row):
            self.key = str(row[0])
            self.parts.append(row[1] or "")

        def terminate(self):
            for c in split_document("\n\n".join(self.parts), None, None, budget):
                yield (self.key, *c)

    spark.udtf.register(name, F.udtf(Chunk, returnType=CHUNK))
    spark.udtf.register(f"{name}_parts", F.udtf(Parts, returnType=f"document_id string, {CHUNK}"))


def group_key(h_path: Column, title: Column) -> Column:
    """The first two headings of a path, else the title, else root."""
    return F.when(F.size(h_path) > 0, F.slice(h_path, 1, 2)).otherwise(F.array(F.coalesce(title, F.lit("root"))))


def neighbours(chunks: DataFrame, *, group: list[str], seq: str, chunk: str) -> DataFrame:
    """chunks with prev_id and next_id inside their group."""
    w = Window.partitionBy(*group).orderBy(seq)
    return chunks.withColumn("prev_id", F.lag(chunk).over(w)).withColumn("next_id", F.lead(chunk).over(w))


def parents(chunks: DataFrame, *, group: list[str], seq: str, chunk: str, text: str, target: int = 1200) -> DataFrame:
    """group, ordinal (from 1), child_ids, text, token_count: chunks of a group packed in order up to the target.

    Sorted rows are streamed: a task holds the parent that is being packed.
    """
    rows = chunks.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], F.col(seq).alias("s"), F.col(chunk).cast("string").alias("c"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    keys = [f"g{i}" for i in range(len(group))]
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("ordinal", T.IntegerType()), T.StructField("child_ids", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ordinal, ids_, body = None, 0, [], ""
        for batch in batches:
            made = []
            cols = [c.to_pylist() for c in batch.columns]
            for key, c, t in zip(zip(*cols[: len(keys)]), cols[-2], cols[-1]):
                if key != now:
                    if ids_ and body:
                        made.append((*now, ordinal + 1, ids_, body))
                    now, ordinal, ids_, body = key, 0, [], ""
                both = f"{body}\n\n{t}" if body else t
                if body and estimate(both) > target:
                    made.append((*now, ordinal + 1, ids_, body))
                    ordinal, ids_, body = ordinal + 1, [c], t
                else:
                    ids_.append(c)
                    body = both
            yield from rows_of(made)
        if ids_ and body:
            yield from rows_of([(*now, ordinal + 1, ids_, body)])

    def rows_of(made: list[tuple]) -> Iterator[pa.RecordBatch]:
        if made:
            yield pa.RecordBatch.from_pydict({f.name: [m[i] for m in made] for i, f in enumerate(schema.fields)}, schema=to_arrow_schema(schema))

    packed = rows.repartition(*keys).sortWithinPartitions(*keys, "s").mapInArrow(pack, schema)
    return packed.select(*[F.col(k).alias(g) for k, g in zip(keys, group)], "ordinal", "child_ids", "text", n_tokens(F.col("text")).alias("token_count"))
