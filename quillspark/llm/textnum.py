"""Whole-batch tokenisation and rolling hashes over Arrow text, in numpy.

Text columns arrive as Arrow batches. They are cut into slices of a few MB (a
longer text is a slice by itself), so memory follows the slice and the longest
single text, never the partition. All hashes are polynomials modulo 2**64 over
random byte codes, finished by a 64-bit mixer.
"""
import ctypes
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U = np.uint64
#: Odd multipliers of the polynomials, one for each independent hash.
BASES = (0x9E3779B97F4A7C15 | 3, 0xD1B54A32D192ED03)
#: Separators of whitespace words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def space_words() -> np.ndarray:
    """Table of the bytes of `[^\\x20\\x09-\\x0D]+`."""
    t = np.ones(256, bool)
    t[list(SPACES)] = False
    return t


def plain_words() -> np.ndarray:
    """Table of the bytes of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`: digits, a-z, and all beyond ASCII. A-Z count, as texts are lower-cased."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x41:0x5B] = t[0x80:] = True
    return t


def lowered(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return np.where((buf >= 0x41) & (buf <= 0x5A), buf | 0x20, buf).astype(np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _process_cache() -> dict:
    """A dict that lives as long as the Python process and is never pickled."""
    return sys.modules.setdefault("_quillspark_cache", types.ModuleType("_quillspark_cache")).__dict__


def one_blas_thread() -> None:
    """Keep numpy's matrix products to one thread in this process: tasks fill the cores already. Does nothing where the library is not known."""
    cache = _process_cache()
    if cache.get("one_thread"):
        return
    cache["one_thread"] = True
    try:
        with open("/proc/self/maps") as f:
            libs = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:
        return
    for lib in libs:
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            call = getattr(ctypes.CDLL(lib), name, None)
            if call:
                call(1)


def trimmed(each):
    """A map over batches that gives its free memory back to the system when it ends: workers stay for later tasks, their caches need not."""

    def run(*batches):
        try:
            yield from each(*batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    return run


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of a base and of its inverse, modulo 2**64."""
    cache = _process_cache()
    have = cache.get(("powers", which))
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        base = BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U))
        have = tuple(out)
        if n <= SLICE_BYTES + 1:
            cache["powers", which] = have
    return have


def _codes(which: int) -> np.ndarray:
    return np.random.default_rng(7919 + which).integers(1, 1 << 64, 256, dtype=U) | U(1)


def span_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of codes[s:e] for each span."""
    n = len(codes)
    power, inverse = _powers(n + 1, which)
    total = np.zeros(n + 1, U)
    np.cumsum(codes * power[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mixed(h + (ends - starts).astype(U) * U(0x632BE59BD9B4E019))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first row, end row, bytes, offsets) of slices of a text column. Null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """The words of a slice: byte spans, and where each text's words begin."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, table: np.ndarray):
        self.buf, self.offs = buf, offs
        inside = table[buf]
        before = np.empty(len(buf), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        firsts = offs[:-1][offs[:-1] < len(buf)]
        before[firsts] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(buf), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[offs[1:][offs[1:] > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: Index of each text's first word; one more at the end.
        self.first = np.searchsorted(self.starts, offs)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, which: int = 0, lower: bool = False) -> np.ndarray:
        buf = lowered(self.buf) if lower else self.buf
        return span_hash(_codes(which)[buf], self.starts, self.ends, which)

    def row_of(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def place(self) -> np.ndarray:
        """Place of each word in its text, from 0."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)

    def windows(self, size: int) -> np.ndarray:
        """Indices of words at which `size` words of one text begin."""
        if not len(self.starts):
            return np.zeros(0, np.int64)
        room = np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))
        return np.flatnonzero(room >= size)


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n words lie in [s, s + size) of some start; spans must end by n."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:n]) > 0
