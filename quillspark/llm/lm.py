"""Operator 4: scoring texts with a causal self-attention language model in numpy.

Texts are lower-cased (A-Z) whitespace words, each cut into subwords by a public
sentencepiece vocabulary (a path; its bytes are broadcast and it is never
trained), and one end. The attention model gives each subword's probability as
that of its class times that of the subword in its class:

* counts of all subwords after groups of preceding subwords (the commonest are
  groups of their own, the others share some) cover the whole training corpus
  and are summed in Spark; from them come the classes (k-means) and the subwords'
  shares in their classes after each group (add-one over the vocabulary, then
  smoothed by the shares after any group);
* the class comes from one layer of causal self-attention with relative position
  biases over all subwords, trained by Adam in numpy. Training documents are
  dealt to shards by a hash of id and text and sorted by it, so what is learned
  does not depend on how the table is partitioned. The first shard is learned
  first; then every shard learns from all its windows from there, and parameters
  are averaged by windows. No window is left out, at any size of the corpus; a
  shard's last step may be short.

A phrase memory (`lm_memory`) counts all phrases of the training corpus: words up
to one whose hash ends a phrase (one in PHRASE). A phrase's probability is a mix of
its share in the memory and of the attention model's, weighed by the share of
phrases that occur again. A document's own occurrences do not count for it.

Scoring cuts each text into windows of WINDOW positions that overlap by CONTEXT:
each position is scored once, with at least CONTEXT positions before it where
the text has them. Windows go through masked attention in batches.

Defined cases: a null or empty text is one end; a null id is not held out; ids
may be of any type; repeated rows are rows of their own, each counted; texts of
any length are scored whole, a slice at a time; an empty table gives no rows, one
without training rows has scores of the untrained model; further columns are
passed over, whatever their names.
"""
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import lm_memory
from quillspark.llm.lm_base import ROUTED, base_scores
from quillspark.llm.session import cut, parts_for
from quillspark.llm.substring import _rows
from quillspark.llm.textnum import U, Words, _process_cache, mixed, one_blas_thread, space_words, span_hash, text_slices, trimmed

#: Directory and name of the subword vocabulary; pieces, end and start.
TOKENIZERS, MODEL_FILE = "/opt/tokenizers", "piece_bpe_32k.model"
PIECES, END, START = 32_000, 2, 1
WINDOW, CONTEXT, WIDTH, CLASSES = 32, 6, 16, 64
#: Groups of preceding subwords, those of one subword each.
GROUPS, OWN_GROUPS = 256, 224
#: Weight, in counts, of a subword's share over all predecessors against its share after the group before it.
PRIOR = 6.0
#: Windows in a step, rate, steps after which the rate has fallen by the square root of two, texts that are shuffled together.
STEP_WINDOWS, RATE, SLOWER, TEXTS = 48, 0.015, 400, 256
#: One word in PHRASE ends a phrase, of at most MOST_WORDS words.
PHRASE, MOST_WORDS = 8, 256
#: Windows in one batch of scoring, words kept with their pieces in a process, subwords of texts scored at once, compressed input bytes of a partition and of a shard.
BATCH, CACHED, AT_ONCE, EACH, SHARD = 64, 300_000, 200_000, 8 << 20, 4 << 20


class Pieces:
    """Subwords of words, kept by the words' hashes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.clear()

    def clear(self) -> None:
        self.place, self.flat = {}, np.zeros(0, np.uint16)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, hashes: np.ndarray, word) -> np.ndarray:
        """Places (in start and size) of distinct words by their hashes; word(i) gives the bytes of the i-th."""
        if len(self.place) + len(hashes) > CACHED:
            self.clear()
        keys = hashes.tolist()
        at = [self.place.get(k, -1) for k in keys]
        new = [i for i, k in enumerate(at) if k < 0]
        if new:
            got = self.sp.encode([word(i).decode() for i in new], num_threads=1)
            first, size = len(self.start), np.array([len(x) for x in got], np.int64)
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.flat = np.concatenate((self.flat, np.fromiter((p for x in got for p in x), np.uint16, size.sum())))
            for n, i in enumerate(new):
                at[i] = self.place[keys[i]] = first + n
        return np.array(at, np.int64)


def _ramp(size: np.ndarray) -> np.ndarray:
    """0..size-1 of each size, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def cut_slice(buf: np.ndarray, offs: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, list[bytes], list[bytes], list[bytes]]:
    """Of each text of a slice: words, subwords with the end, phrases' hashes, subwords of phrases."""
    w = Words(buf, offs, space_words())
    h, counts, rows = w.hashes(lower=True), w.counts, len(w.first) - 1
    distinct, at, nth = np.unique(h, return_index=True, return_inverse=True)
    low = buf.tobytes().lower()  # of bytes: A-Z alone
    known = pieces.of(distinct, lambda i: low[w.starts[at[i]] : w.ends[at[i]]])[nth] if len(h) else np.zeros(0, np.int64)
    size = pieces.size[known]
    row = w.row_of()
    total = np.bincount(row, size, rows).astype(np.int64) + 1
    ids = np.full(total.sum(), END, np.uint16)
    # a text's subwords move on by one place for each end before it
    ids[np.arange(size.sum()) + np.repeat(row, size)] = pieces.flat[np.repeat(pieces.start[known], size) + _ramp(size)]
    ends = (mixed(h) >> U(13)) % U(PHRASE) == 0
    ends |= w.place() % MOST_WORDS == MOST_WORDS - 1
    last = w.first[1:][counts > 0] - 1
    ends[last] = True
    stop = np.flatnonzero(ends) + 1
    begin = np.concatenate(([0], stop[:-1])) if len(stop) else stop
    phrase = span_hash(h, begin, stop) if len(h) else np.zeros(0, U)
    long_ = np.add.reduceat(size, begin) if len(stop) else np.zeros(0, np.int64)
    of = row[stop - 1] if len(stop) else np.zeros(0, np.int64)
    final = np.isin(stop - 1, last)
    phrase[final] = mixed(phrase[final] + U(1))  # the last one holds the end
    long_ = long_ + final
    # a text without words is one phrase, its end
    empty = np.flatnonzero(counts == 0)
    where = np.searchsorted(of, empty)
    phrase, long_, of = np.insert(phrase, where, mixed(np.full(len(empty), 7, U))), np.insert(long_, where, 1), np.insert(of, where, empty)
    bound, cuts = np.concatenate(([0], np.cumsum(total))), np.searchsorted(of, np.arange(rows + 1))
    each = lambda x, b: [x[lo:hi].tobytes() for lo, hi in zip(b[:-1], b[1:])]
    return counts, each(ids, bound), each(phrase, cuts), each(long_.astype(np.uint32), cuts)


def tokens(src: DataFrame, model: bytes) -> DataFrame:
    """src (id, key, th, train, text) with n_tokens (words and the end), n_phrases, ids (subwords, uint16), phrases (uint64), sizes (uint32) in place of text."""
    held = src.sparkSession.sparkContext.broadcast(model)
    names = ["id", "key", "th", "train", "n_tokens", "n_phrases", "ids", "phrases", "sizes"]
    kinds = [T.LongType(), T.LongType(), T.BinaryType(), T.BinaryType(), T.BinaryType()]
    schema = T.StructType([*src.schema.fields[:4], *(T.StructField(n, k, False) for n, k in zip(names[4:], kinds))])

    def each(batches):
        cache = _process_cache()
        if cache.get("sp_pieces") is None:
            cache["sp_pieces"] = Pieces(held.value)
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch.column(4)):
                n, ids, phrases, sizes = cut_slice(buf, offs, cache["sp_pieces"])
                many = [len(x) // 8 for x in phrases]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:4], pa.array(n + 1, pa.int64()), pa.array(many, pa.int64()), pa.array(ids, pa.binary()), pa.array(phrases, pa.binary()), pa.array(sizes, pa.binary())], names=names)

    return src.mapInArrow(trimmed(each), schema)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column one after the other, and where each text begins and ends."""
    blobs = column.to_pylist()
    sizes = np.array([len(b) // 2 for b in blobs], np.int64)
    return np.frombuffer(b"".join(blobs), np.uint16).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))


def _summed(vectors: DataFrame, parts: int) -> np.ndarray | None:
    """The sum of rows of a binary column (doubles), in levels, so that few rows reach the driver."""

    def added(batches):
        total = None
        for batch in batches:
            for x in batch.column(0):
                v = np.frombuffer(x.as_py(), np.float64)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    while parts > 8:
        parts = -(-parts // 32)
        vectors = vectors.repartition(parts).mapInArrow(added, "v binary")
    got = [np.frombuffer(r.v, np.float64) for r in vectors.collect()]
    return sum(got[1:], got[0]) if got else None


def piece_groups(toks: DataFrame, parts: int) -> np.ndarray:
    """The group of each preceding subword: the OWN_GROUPS commonest have one each, the others share the rest by their rank."""

    def each(batches):
        total = np.zeros(PIECES, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), np.uint16), minlength=PIECES)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], names=["v"])

    n = _summed(toks.where("train").select("ids").mapInArrow(trimmed(each), "v binary"), parts)
    rank = np.empty(PIECES, np.int64)
    rank[np.argsort(-(n if n is not None else np.zeros(PIECES)), kind="stable")] = np.arange(PIECES)
    return np.where(rank < OWN_GROUPS, rank, OWN_GROUPS + rank % (GROUPS - OWN_GROUPS))


def pair_counts(toks: DataFrame, group: np.ndarray, parts: int) -> np.ndarray:
    """Counts of subwords (rows) after groups of preceding subwords, over all training texts. At most PIECES * GROUPS counts reach the driver."""
    held = toks.sparkSession.sparkContext.broadcast(group)
    block = 1 << 15

    def each(batches):
        group, total, lot, waiting = held.value, np.zeros(PIECES * GROUPS, np.int64), [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                ids, bound = _flat(batch.column(0).slice(lo, 512))
                before = np.concatenate(([START], ids[:-1]))
                before[bound[:-1]] = START
                lot.append(ids * GROUPS + group[before])
                waiting += len(ids)
                if waiting > 4_000_000:
                    total += np.bincount(np.concatenate(lot), minlength=len(total))
                    lot, waiting = [], 0
        if lot:
            total += np.bincount(np.concatenate(lot), minlength=len(total))
        k = np.flatnonzero(total)
        for lo, hi in zip(*(np.searchsorted(k, np.arange(0, len(total), block) + d) for d in (0, block))):
            if hi > lo:
                yield from _rows([(int(k[lo]) // block, np.stack((k[lo:hi] % block, total[k[lo:hi]])).tobytes())])

    def added(batches):
        total = {}
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                k, n = np.frombuffer(x.as_py(), np.int64).reshape(2, -1)
                total.setdefault(b, np.zeros(block, np.int64))[k] += n
        yield from _rows([(b, n.tobytes()) for b, n in total.items()])

    out = np.zeros(PIECES * GROUPS, np.float32)
    got = toks.where("train").select("ids").mapInArrow(trimmed(each), ROUTED).repartition(max(1, min(parts, PIECES * GROUPS // block)), "bucket").mapInArrow(added, ROUTED)
    for r in got.toLocalIterator():
        n = np.frombuffer(r.blob, np.int64)[: len(out) - r.bucket * block]
        out[r.bucket * block : r.bucket * block + len(n)] = n
    return out.reshape(PIECES, GROUPS)


def vocabulary(pairs: np.ndarray, group: np.ndarray) -> dict[str, np.ndarray]:
    """For each subword: class, group as a predecessor, log10 of its share in the class after each group; and the classes' log shares."""
    n = pairs.sum(1)
    order = np.argsort(-n, kind="stable")
    seen = order[: max(CLASSES, int((n > 0).sum()))]
    x = np.sqrt((pairs[seen] + pairs.sum(0) / max(1, pairs.sum()) * 4) / (n[seen] + 4)[:, None])
    weight = n[seen] + 0.01
    centres = x[:CLASSES].copy()
    for _ in range(12):
        near = np.argmax(x @ centres.T - (centres**2).sum(1) / 2, 1)
        for c in range(CLASSES):
            mine = near == c
            if mine.any():
                centres[c] = np.average(x[mine], axis=0, weights=weight[mine])
    kind = np.full(PIECES, CLASSES - 1, np.int64)
    kind[seen] = near
    total = np.bincount(kind, n + 1.0, CLASSES)
    share = np.bincount(kind, n + 1.0, CLASSES) / (n + 1.0).sum()
    alone = ((n + 1.0) / total[kind]).astype(np.float32)
    after = np.zeros((CLASSES, GROUPS), np.float32)
    for c in range(CLASSES):
        after[c] = pairs[kind == c].sum(0)
    cond = np.log10((pairs + np.float32(PRIOR) * alone[:, None]) / (after[kind] + np.float32(PRIOR))).astype(np.float32)
    return {"kind": kind, "group": group, "cond": cond, "prior": np.log(np.maximum(share, 1e-9))}


def start(vocab: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    p = {"E": rng.normal(0, 0.5, (PIECES, WIDTH)), "R": np.zeros(WINDOW)}
    p |= {k: rng.normal(0, WIDTH**-0.5, (WIDTH, WIDTH)) for k in ("Q", "K", "V", "O")}
    p |= {"C": rng.normal(0, 0.1, (WIDTH, CLASSES)), "b": vocab["prior"].copy()}
    return {k: v.astype(np.float32) for k, v in p.items()}


_BACK = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
_SEEN = (_BACK >= 0).astype(np.float32)
#: Bound of exponents; far beyond what is learned.
_MOST = np.float32(50)


def _exp(x: np.ndarray) -> np.ndarray:
    np.clip(x, -_MOST, _MOST, out=x)
    return np.exp(x, out=x)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums along the last axis, kept; a product with ones is faster than a reduction for short rows."""
    return x @ np.ones((x.shape[-1], 1), x.dtype)


def _attention(p: dict, q: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Weights of each position on those up to it; q is scaled. Masked: no position sees a later one."""
    a = _exp(q @ k.transpose(0, 2, 1))
    a *= _exp(p["R"][np.abs(_BACK)]) * _SEEN.astype(a.dtype)
    a /= _sums(a)
    return a


def _projections(p: dict) -> np.ndarray:
    """Q (scaled), K and V side by side: one product with all rows of a batch costs less than three by window."""
    return np.concatenate((p["Q"] * np.float32(WIDTH**-0.5), p["K"], p["V"]), 1)


def _projected(flat: np.ndarray, p: dict, shape: tuple) -> list[np.ndarray]:
    """q, k and v of rows of E."""
    three = flat @ _projections(p)
    return [three[:, i * WIDTH : (i + 1) * WIDTH].reshape(shape) for i in range(3)]


def forward(p: dict, inputs: np.ndarray) -> tuple:
    """Class logits of each position of (windows, WINDOW) inputs, and what the gradient needs."""
    x = p["E"][inputs]
    flat = x.reshape(-1, WIDTH)
    q, k, v = _projected(flat, p, x.shape)
    a = _attention(p, q, k)
    o = a @ v
    z = flat + o.reshape(-1, WIDTH) @ p["O"]
    logits = z @ p["C"]
    logits += p["b"]
    return logits.reshape(*inputs.shape, CLASSES), (x, q, k, v, a, o, z.reshape(x.shape))


def class_scores(p: dict, inputs: np.ndarray, kinds: np.ndarray, scored: np.ndarray) -> np.ndarray:
    """log10 probability of the class of each scored place, in their order; the forward pass without what the gradient needs."""
    x = p["E"][inputs]
    q, k, v = _projected(x.reshape(-1, WIDTH), p, x.shape)
    o = _attention(p, q, k) @ v
    logits = (x[scored] + o[scored] @ p["O"]) @ p["C"]
    logits += p["b"]
    np.clip(logits, -_MOST, _MOST, out=logits)
    own = logits[np.arange(len(logits)), kinds]
    return (own - np.log(_sums(np.exp(logits, out=logits))[:, 0])) / np.float32(np.log(10))


def gradient(p: dict, inputs: np.ndarray, kinds: np.ndarray, scored: np.ndarray) -> tuple[float, dict]:
    """Mean loss over scored positions and its gradient; that of E as (rows, their gradients)."""
    logits, (x, q, k, v, a, o, z) = forward(p, inputs)
    flat = lambda m: m.reshape(-1, m.shape[-1])
    at, want = np.flatnonzero(scored), kinds.ravel()
    n = max(1, len(at))
    d = flat(_exp(logits))
    d /= _sums(d)
    loss = -np.log(d[at, want[at]] + 1e-12).sum() / n
    d[at, want[at]] -= 1
    d *= (scored.reshape(-1, 1) / n).astype(d.dtype)
    g = {"C": flat(z).T @ d, "b": d.sum(0)}
    dz = d @ p["C"].T
    g["O"] = flat(o).T @ dz
    do = (dz @ p["O"].T).reshape(z.shape)
    da = do @ v.transpose(0, 2, 1)
    dv = a.transpose(0, 2, 1) @ do
    da -= _sums(da * a)
    da *= a
    per = da.sum(0)
    g["R"] = np.bincount(np.abs(_BACK).ravel(), (per * _SEEN).ravel(), WINDOW).astype(per.dtype)
    three = np.concatenate((flat(da @ k), flat(da.transpose(0, 2, 1) @ q), flat(dv)), 1)
    each = np.split(flat(x).T @ three, 3, 1)
    g |= {"Q": each[0] * np.float32(WIDTH**-0.5), "K": each[1], "V": each[2]}
    dx = dz + three @ _projections(p).T
    order = np.argsort(inputs, axis=None, kind="stable")
    rows = inputs.ravel()[order]
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    g["E"] = rows[first], np.add.reduceat(dx[order], first, axis=0)
    return float(loss), g


def windows(bound: np.ndarray, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, places before them, scored) of windows over texts that lie one after the other: each place is scored once.

    A place before of -1 stands for the start; places past a text's end are not scored.
    """
    fresh = WINDOW - context
    size = np.diff(bound)
    many = -(-size // fresh)
    text = np.repeat(np.arange(len(size)), many)
    nth = _ramp(many)
    first = np.where(nth == 0, 0, nth * fresh - context)  # the first window has no context before it
    new = np.where(nth == 0, 0, context)
    place = first[:, None] + np.arange(WINDOW)[None, :]
    scored = (np.arange(WINDOW)[None, :] >= new[:, None]) & (place < np.minimum((nth + 1) * fresh, size[text])[:, None])
    inside = np.minimum(place, size[text][:, None] - 1) + bound[text][:, None]
    return inside, np.where(place == 0, -1, inside - 1), scored


class Learner:
    """Adam over the windows of one shard; rows of E that a step does not touch stay."""

    def __init__(self, p: dict):
        self.p = {k: v.copy() for k, v in p.items()}
        self.m, self.s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        self.step = self.seen = 0
        self.wait, self.texts = [], []

    def learn(self, inputs, kinds, scored) -> None:
        self.step += 1
        self.seen += len(inputs)
        _, g = gradient(self.p, inputs, kinds, scored)
        rate = RATE / np.sqrt(1 + self.step / SLOWER) / (1 - 0.9**self.step)
        lift = 1 / (1 - 0.99**self.step)
        for key, v in g.items():
            at = slice(None)
            if key == "E":
                at, v = v
            m, s = self.m[key][at], self.s[key][at]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            self.m[key][at], self.s[key][at] = m, s
            self.p[key][at] -= (rate * m / (np.sqrt(s * lift) + 1e-8)).astype(np.float32)

    def take(self, vocab: dict, blob: bytes | None) -> None:
        """One more text, or none after the last: full steps are learned, the rest waits until then."""
        if blob is not None:
            self.texts.append(np.frombuffer(blob, np.uint16).astype(np.int64))
        if self.texts and (blob is None or len(self.texts) == TEXTS):
            ids = np.concatenate(self.texts)
            places, before, scored = windows(np.concatenate(([0], np.cumsum([len(x) for x in self.texts]))), 0)
            self.texts = []
            order = np.random.default_rng(len(places)).permutation(len(places))
            self.wait.append((np.where(before < 0, START, ids[before])[order], vocab["kind"][ids[places]][order], scored[order]))
        elif blob is not None:
            return
        if not self.wait:
            return
        full = [np.concatenate(c) for c in zip(*self.wait)]
        end = len(full[0]) if blob is None else len(full[0]) // STEP_WINDOWS * STEP_WINDOWS
        for a in range(0, end, STEP_WINDOWS):
            self.learn(*(c[a : min(end, a + STEP_WINDOWS)] for c in full))
        self.wait = [tuple(c[end:] for c in full)] if end < len(full[0]) else []


def trained(toks: DataFrame, vocab: dict, p: dict, shards: int, parts: int, only: int | None = None) -> dict:
    """The mean, by windows, of the parameters that each shard (or one) learned from all its windows, starting at p."""
    held = toks.sparkSession.sparkContext.broadcast(({"kind": vocab["kind"]}, p))
    shard = F.pmod(F.xxhash64("th", "key"), F.lit(shards))
    src = toks.where("train").select(shard.alias("shard"), "th", "key", "ids")
    src = src.where(F.col("shard") == only).repartition(1) if only is not None else src.repartition(shards, "shard")

    def each(batches):
        one_blas_thread()
        vocab, p = held.value
        now, learner = None, None

        def done():
            learner.take(vocab, None)
            flat = np.concatenate([learner.p[k].ravel() for k in sorted(p)]).astype(np.float64)
            v = np.append(flat * learner.seen, learner.seen)
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary())], names=["v"])

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(3)):
                if k != now:
                    if learner:
                        yield done()
                    now, learner = k, Learner(p)
                learner.take(vocab, x.as_py())
        if learner:
            yield done()

    flat = _summed(src.sortWithinPartitions("shard", "th", "key").mapInArrow(trimmed(each), "v binary"), 1 if only is not None else shards)
    if flat is None:
        return p
    out, at = {}, 0
    for k in sorted(p):
        out[k] = (flat[at : at + p[k].size] / flat[-1]).reshape(p[k].shape).astype(np.float32)
        at += p[k].size
    return out


def score_texts(ids: np.ndarray, bound: np.ndarray, vocab: dict, p: dict) -> np.ndarray:
    """log10 probability of each subword of texts that lie one after the other, by the attention model."""
    places, _, scored = windows(bound)
    got = np.zeros(len(ids))
    kinds = vocab["kind"][ids]
    last = np.concatenate(([START], ids[:-1]))
    last[bound[:-1]] = START
    for a in range(0, len(places), BATCH):
        own, ok = places[a : a + BATCH], scored[a : a + BATCH]
        at = own[ok]
        got[at] = class_scores(p, last[own], kinds[at], ok)
    return got + vocab["cond"][ids, vocab["group"][last]]


def score_phrases(toks: DataFrame, vocab: dict, p: dict, memory: tuple, parts: int) -> DataFrame:
    """Routed blobs of all phrases with the attention model's log10 probability."""
    held = toks.sparkSession.sparkContext.broadcast((vocab, p, memory))

    def each(batches):
        one_blas_thread()
        vocab, p, memory = held.value
        for batch in batches:
            key, th, train = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            sizes = pc.binary_length(batch.column(3)).to_numpy() // 2
            upto, lo = np.concatenate(([0], np.cumsum(sizes))), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + AT_ONCE, "right")) - 1)
                part = batch.slice(lo, hi - lo)
                ids, bound = _flat(part.column(3))
                h = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint64)
                long_ = np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint32).astype(np.int64)
                row = np.repeat(np.arange(hi - lo), pc.binary_length(part.column(4)).to_numpy() // 8)
                lp = np.add.reduceat(score_texts(ids, bound, vocab, p), np.cumsum(long_) - long_)
                yield from _rows(lm_memory.routed(key[lo:hi], th[lo:hi], train[lo:hi], row, h, lp, memory, parts))
                lo = hi

    return toks.select("key", "th", "train", "ids", "phrases", "sizes").mapInArrow(trimmed(each), ROUTED)


def score(docs: DataFrame, held_out, *, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; rows where held_out holds teach nothing."""
    with open(os.path.join(tokenizers, MODEL_FILE), "rb") as f:
        model = f.read()
    narrow = docs.select(id_col, text_col)
    parts, shards = parts_for(narrow, EACH), parts_for(narrow, SHARD, 1)
    text = F.col(text_col).cast("string")
    src = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(id_col).alias("key"),
        F.xxhash64(text, F.col(id_col).isNull()).alias("th"),
        (~F.coalesce(held_out, F.lit(False))).alias("train"),
        text.alias("text"),
    )
    toks = cut(tokens(src, model))
    sums = toks.where("train").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_phrases"), F.lit(0)).alias("phrases"), F.count("*").alias("docs")).first()
    base, words = base_scores(src.select(F.col("key").alias("id"), "th", "text", "train"), sums.n, parts)
    group = piece_groups(toks, parts)
    vocab = vocabulary(pair_counts(toks, group, parts), group)
    p = trained(toks, vocab, start(vocab), shards, parts, only=0)
    p = trained(toks, vocab, p, shards, parts)
    common, often, weight = lm_memory.counts(toks, sums.phrases, parts)
    memory = (common, often, weight, sums.phrases)
    model_scores = lm_memory.summed_scores(score_phrases(toks, vocab, p, memory, parts), weight, sums.phrases, parts)
    # rows equal in id and text have one result, of which each has its part
    both = base.join(model_scores, ["id", "th"]).join(toks.groupBy(F.col("key").alias("id"), "th").agg(F.count("*").alias("copies")), ["id", "th"])
    share = lambda c: F.col(c) / F.col("copies")
    each = both.select(F.col("id").alias("key"), "th", share("part_known").cast("long").alias("known"), share("part_score").alias("sum"), share("part").alias("score"))
    ends = 1 if sums.docs else 0
    end, all_ = float(np.log10(sums.docs + 1.0)), float(np.log10(float(sums.n + words + ends + 1)))
    return toks.select("id", "key", "th", "train", "n_tokens").join(each, ["key", "th"]).select(
        F.col("id").alias(id_col),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("known") + ends).alias("n_known"),
        F.lit(int(sums.n)).cast("long").alias("train_tokens"),
        (F.col("sum") + end - F.col("n_tokens") * all_).alias("base_score"),
        "score",
    )
