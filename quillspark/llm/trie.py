"""Operator 12: the prefix trie of conversations, by an LCP-aware external mergesort.

A conversation is a sequence of turns, a turn 16 bytes of a digest of role and
text, so sequences compare as bytes and a prefix sorts next to what it begins.
Tasks sort their rows into runs that carry LCPs (turns in common with the row
before) and write them to the shared folder. The rows are dealt out by ranges of
(sequence, id), ids included so that thousands of equal conversations spread.
Each range merges its part of the runs by a loser tree: contenders know their LCP
with the last winner, the longer one wins outright, and only equal ones compare
turns, from the LCP onwards. The merged stream keeps a stack of open nodes; a node
is finished when the stream leaves its prefix.

A range's first and last paths may go on in its neighbours. Their nodes (two paths
a range) are put together by the same stack over the ranges' paths in order, in one
task; members that end there are hashed by node in streams of sorted ids. Nothing
else leaves its range.

Order of turns: by `turn`, null first; equal ones by a digest of role and text.

Defined cases: null role or text is empty; rows with a null conv_id belong to no
conversation and are left out; repeated rows are turns of their own; a conversation
of any length is one array of 24 bytes a turn in the task that owns it, its texts
do not travel; an empty table has no nodes; further columns are passed over.
"""
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.session import cut, drop_cut, parts_for
from quillspark.llm.texts import join_small
from quillspark.llm.textnum import trimmed

#: Bytes of a turn's digest; most turns that a rebuilt conversation takes from another's head, plus one; conversations that share a head.
TURN, HEADS, FAMILY = 16, 9, 5
#: Bytes of written runs in one range.
RANGE_BYTES = 4 << 20


def sequences(convs: DataFrame) -> DataFrame:
    """conv_id and turns (in order: hex digest, bytes of text) of each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TURN)
    turn = F.struct(F.col("turn").isNotNull().alias("has"), "turn", digest.alias("d"), F.octet_length(text).cast("long").alias("n"))
    by = convs.where(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return by.select("conv_id", F.transform("t", lambda t: F.struct(t["d"].alias("d"), t["n"].alias("n"))).alias("turns"))


def head_length(conv_id: Column, heads: int = HEADS) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % heads).cast("int")


def rebuilt(seqs: DataFrame, *, heads: int = HEADS, family: int = FAMILY) -> DataFrame:
    """Each conversation with its first turns replaced by those of the family's first conversation."""
    base = F.col("conv_id") - F.col("conv_id") % family
    first = seqs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    own = seqs.where(F.col("conv_id") % family != 0).withColumn("base", base).join(first, "base", "left")
    h = head_length(F.col("conv_id"), heads)
    none = F.array().cast(seqs.schema["turns"].dataType)
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    return seqs.where(F.col("conv_id") % family == 0).union(own.select("conv_id", turns.alias("turns")))


def _common(a: bytes, b: bytes, at: int) -> int:
    """Turns that a and b have in common, known to be at least `at`."""
    most = min(len(a), len(b)) // TURN
    if a[at * TURN : most * TURN] == b[at * TURN : most * TURN]:
        return most
    while a[at * TURN : at * TURN + TURN] == b[at * TURN : at * TURN + TURN]:
        at += 1
    return at


def sorted_runs(seqs: DataFrame) -> DataFrame:
    """run, pos, lcp, conv_id, seq, sizes: the rows of each batch in order, each with the turns it shares with the one before."""
    flat = seqs.select("conv_id", F.unhex(F.array_join(F.col("turns.d"), "")).alias("seq"), F.col("turns.n").alias("sizes"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, seq = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (seq[i], ids[i]))
            lcp = [0] + [_common(seq[i], seq[j], 0) for i, j in zip(order, order[1:])]
            own = batch.take(pa.array(order, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([run] * len(order), pa.int64()), pa.array(range(len(order)), pa.int64()), pa.array(lcp[: len(order)], pa.int64()), *own.columns], names=["run", "pos", "lcp", "conv_id", "seq", "sizes"])
            run += 1

    return flat.mapInArrow(trimmed(each), "run long, pos long, lcp long, conv_id long, seq binary, sizes array<long>")


def merged(runs: list[list[tuple]]) -> Iterator[tuple[int, tuple]]:
    """(LCP with the row before, row) of all rows (seq, conv_id, lcp within the run, ...) in order, by a loser tree."""
    k = 1
    while k < len(runs):
        k *= 2
    runs = [*runs, *[[] for _ in range(k - len(runs))]]
    at = [0] * k
    now = [r[0] if r else None for r in runs]
    known = [0] * k  # turns in common with the last winner

    def match(i: int, j: int) -> tuple[int, int]:
        """Winner and loser; the loser's LCP becomes that with the winner."""
        a, b = now[i], now[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        same = _common(a[0], b[0], known[i])
        win, lose = (i, j) if (a[0][same * TURN : same * TURN + TURN], len(a[0]), a[1]) < (b[0][same * TURN : same * TURN + TURN], len(b[0]), b[1]) else (j, i)
        known[lose] = same
        return win, lose

    losers = [0] * k
    up = list(range(k))
    level = k
    while level > 1:
        level //= 2
        played = [match(up[2 * i], up[2 * i + 1]) for i in range(level)]
        losers[level : 2 * level] = [lose for _, lose in played]
        up = [win for win, _ in played]
    win = up[0]
    while now[win] is not None:
        yield known[win], now[win]
        at[win] += 1
        now[win] = runs[win][at[win]] if at[win] < len(runs[win]) else None
        if now[win] is not None:
            known[win] = now[win][2]
        node = (win + k) // 2
        while node:
            win, losers[node] = match(win, losers[node])
            node //= 2


class _Node:
    __slots__ = ("depth", "key", "size", "n", "least", "children", "leaves", "saved", "ends", "edge", "kids")

    def __init__(self, depth: int, key: bytes, size: int, edge: bool):
        self.depth, self.key, self.size, self.edge = depth, key, size, edge
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.ends, self.kids = None, [], []

    def took(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


def _key(above: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(above + turn, digest_size=16).digest()


def _sha(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


FINISHED, UNDER_EDGE, EDGE, END = 0, 1, 2, 3
_SCHEMA = "kind int, place long, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends_sha256 string"
_ARROW = pa.schema([("kind", pa.int32()), ("place", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size")], ("ends_sha256", pa.string())])


def trie_rows(stream: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
    """Rows of _SCHEMA of a range's nodes, from its merged stream of (seq, conv_id, _, sizes).

    A finished node waits for its parent's smallest member, so a range holds the
    nodes below its open ones at most. Nodes of the first path and of those open at
    the end are edges: their sums hold what lies below them but for other edges.
    """
    stack: list[_Node] = []
    first: list[_Node] = []

    def close() -> Iterator[tuple]:
        node = stack.pop()
        above = stack[-1] if stack else None
        if node.edge:
            for row in node.kids:
                yield (UNDER_EDGE, None, None, node.key, *row)
            for i in node.ends:
                yield (END, None, node.key, None, i, *[None] * 8)
            if above:
                above.took(node.n, node.least)
            return
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
        for row in node.kids:
            yield (FINISHED, None, None, None, row[0], row[1], node.least, *row[3:])
        above.took(node.n, node.least)
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        row = (node.least, node.depth, None, node.n, node.children, leaves, saved, None, _sha(node.ends))
        if above.edge:
            yield (UNDER_EDGE, None, None, above.key, *row)
        else:
            above.kids.append(row)

    for lcp, (seq, conv_id, _, sizes) in stream:
        if not stack:
            stack.append(_Node(0, b"", 0, True))
            first.append(stack[0])
        while len(stack) > lcp + 1:
            yield from close()
        while len(stack) <= len(sizes):
            d = len(stack)
            stack.append(_Node(d, _key(stack[-1].key, seq[(d - 1) * TURN : d * TURN]), sizes[d - 1], len(first) == d and first[-1] is stack[-1] and not first[-1].n and not first[-1].ends))
            if stack[-1].edge:
                first.append(stack[-1])
        stack[-1].took(1, conv_id)
        stack[-1].ends.append(conv_id)
    path = list(stack)
    last = [x for x in path if not x.edge]
    for x in last:
        x.edge = True
    while stack:
        yield from close()
    for place, (x, way) in enumerate([*((x, first) for x in first), *((x, path) for x in last)]):
        yield (EDGE, place, x.key, way[x.depth - 1].key if x.depth else None, x.least, x.depth, None, x.n, x.children, x.leaves, x.saved, x.size, None)


def _arrow(rows: Iterator[tuple], schema: pa.Schema, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[int, list[tuple]] = {}
    last: dict[int, int] = {}
    for batch in batches:
        run, pos, lcp, conv_id, seq, sizes = (batch.column(c).to_pylist() for c in ("run", "pos", "lcp", "conv_id", "seq", "sizes"))
        for r, p, n, c, s, z in zip(run, pos, lcp, conv_id, seq, sizes):
            own = runs.setdefault(r, [])
            # an LCP holds against the row before in the run; ranges cut runs in pieces that stay whole
            own.append((s, c, n if last.get(r) == p - 1 else _common(own[-1][0], s, 0) if own else 0, z))
            last[r] = p
    part = TaskContext.get().partitionId() << 33
    placed = ((row[0], row[1] + part, *row[2:]) if row[0] == EDGE else row for row in trie_rows(merged(list(runs.values()))))
    yield from _arrow(placed, _ARROW)


_JOINED = pa.schema([("key", pa.binary()), ("parent_key", pa.binary()), *[(c, pa.int64()) for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")]])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edge nodes of all ranges, in order, to whole nodes: the same open-path stack, over paths."""
    stack: list[_Node] = []
    above_key: dict[bytes, bytes | None] = {}

    def close() -> tuple:
        node = stack.pop()
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
        if stack:
            stack[-1].children += 1
            stack[-1].leaves += leaves
            stack[-1].saved += saved
        return (node.key, above_key.pop(node.key), node.least, node.depth, node.n, node.children, leaves, saved)

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for key, above, least, depth, n, children, leaves, saved, size in zip(*(batch.column(c).to_pylist() for c in ("key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "size"))):
                if len(stack) <= depth or stack[depth].key != key:
                    while len(stack) > depth:
                        yield close()
                    stack.append(_Node(depth, key, size, True))
                    above_key[key] = above
                node = stack[depth]
                node.took(n, least)
                node.children += children
                node.leaves += leaves
                node.saved += saved
        while stack:
            yield close()

    yield from _arrow(rows(), _JOINED)


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's ids, from rows in order of (key, conv_id); an id at a time."""

    def rows() -> Iterator[tuple]:
        now, sha = None, None
        for batch in batches:
            for key, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now:
                    if sha:
                        yield now, sha.hexdigest()
                    now, sha = key, hashlib.sha256(str(i).encode())
                else:
                    sha.update(b",%d" % i)
        if sha:
            yield now, sha.hexdigest()

    yield from _arrow(rows(), pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())]))


def prefix_trie(seqs: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per node of the trie of `seqs` (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    runs = cut(sorted_runs(seqs))
    parts = parts_for(runs, range_bytes)
    rows = cut(runs.repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("run", "pos").mapInArrow(trimmed(_ranges), _SCHEMA))
    # two paths a range
    edges = rows.where(F.col("kind") == EDGE).repartition(1).sortWithinPartitions("place").mapInArrow(_joined, "key binary, parent_key binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    ends = rows.where(F.col("kind") == END).select("key", "conv_id").repartition(F.col("key")).sortWithinPartitions("key", "conv_id").mapInArrow(_hashed_ends, "key binary, ends_sha256 string")
    whole = cut(edges.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))))
    drop_cut(runs)
    parent = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inside = rows.where(F.col("kind") == FINISHED).select(*names)
    under = join_small(rows.where(F.col("kind") == UNDER_EDGE).drop("parent_conv_id"), parent, ["parent_key"]).withColumnRenamed("_parent", "parent_conv_id").select(*names)
    edge = join_small(whole, parent, ["parent_key"], "left").withColumnRenamed("_parent", "parent_conv_id").select(*names)
    return inside.union(under).union(edge)
