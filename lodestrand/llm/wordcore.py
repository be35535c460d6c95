"""Vectorised words, word hashes and word n-gram hashes over Arrow string columns.

A word is a run of bytes other than space and \\x09-\\x0D in the UTF-8 text. Hashes
are polynomial sums modulo 2**64 over a random byte table, finished with an
avalanche step, so equal byte sequences always agree whatever batch they sit in.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
TOP = U(2**64 - 1)
_rng = np.random.default_rng(20_261_126)
_TABLE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII lower case with everything but letters and digits as a space; other bytes stay.
PLAIN = np.where((np.arange(256) < 128) & ~np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)]), 32, _LOWER).astype(np.uint8)
#: Bytes of a text that are hashed at a time.
PART = 8 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 21)
        for at, base in enumerate((_BASE, _INVERSE)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[at] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche step on 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Words:
    """Words of consecutive rows. ptr[i]:ptr[i+1] are the words of row i."""

    __slots__ = ("buf", "starts", "ends", "ptr", "first_row", "rows", "_prefix")

    def __init__(self, buf: np.ndarray, offs: np.ndarray, first_row: int, lower: bool = False, table: np.ndarray | None = None):
        if lower or table is not None:
            buf = (_LOWER if table is None else table)[buf]
        self.buf, self.first_row, self.rows = buf, first_row, len(offs) - 1
        space = _SPACE[buf]
        n = len(buf)
        change = np.empty(n + 1, dtype=bool)
        if n:
            np.not_equal(space[1:], space[:-1], out=change[1:n])
            change[0], change[n] = not space[0], not space[-1]
        else:
            change[0] = False
        edge = np.flatnonzero(change)
        del change
        # A row border inside a run of word bytes ends one word and begins another.
        inner = offs[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        inner = np.unique(inner)
        cut = inner[~space[inner - 1] & ~space[inner]] if len(inner) else inner
        if len(cut):
            edge = np.sort(np.concatenate([edge, cut, cut]), kind="stable")
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.ptr = np.searchsorted(self.starts, offs).astype(np.int64)
        self._prefix = None

    def __len__(self) -> int:
        return len(self.starts)

    def slices(self, wanted: list[tuple]) -> list[np.ndarray]:
        """64-bit hashes of bytes s..e-1 for each (s, e, salt) of arrays s and e within words; salt is a value or one for each.

        Long texts are hashed in parts that end where words do, so what is held besides the text is bounded.
        """
        out = [np.empty(len(s), np.uint64) for s, _, _ in wanted]
        lo, n = 0, len(self.buf)
        while lo < n:
            hi = n
            if n - lo > PART and len(self.ends):
                i = int(np.searchsorted(self.ends, lo + PART, side="right")) - 1
                i = max(i, min(int(np.searchsorted(self.starts, lo)), len(self.ends) - 1))  # one word at least
                hi = int(self.ends[i]) if self.ends[i] > lo else n
            p, q = powers(hi - lo)
            c = np.empty(hi - lo + 1, np.uint64)
            c[0] = 0
            np.cumsum(_TABLE[self.buf[lo:hi]] * p[: hi - lo], out=c[1:])
            for x, (s, e, _) in zip(out, wanted):
                if lo == 0 and hi == n:
                    x[:] = (c[e] - c[s]) * q[s]
                else:
                    on = np.flatnonzero((s >= lo) & (s < hi))
                    x[on] = (c[e[on] - lo] - c[s[on] - lo]) * q[s[on] - lo]
            lo = hi
        return [mix(x + salt) for x, (_, _, salt) in zip(out, wanted)]

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        return self.slices([(self.starts, self.ends, (self.ends - self.starts).astype(np.uint64))])[0]

    def row_of(self) -> np.ndarray:
        """Row (within these rows) of each word."""
        return np.repeat(np.arange(self.rows), np.diff(self.ptr))

    def text(self, i: int, j: int) -> bytes:
        """Words i..j-1 joined by one space."""
        part = self.buf[self.starts[i] : self.ends[j - 1]].tobytes()
        return b" ".join(part.split())


class Grams:
    """Hashes of runs of k words for any k, from one prefix sum over word hashes."""

    __slots__ = ("prefix", "inverse", "n")

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        p, self.inverse = powers(self.n)
        self.prefix = np.empty(self.n + 1, np.uint64)
        self.prefix[0] = 0
        np.cumsum(hashes * p[: self.n], out=self.prefix[1:])

    def of(self, k: int) -> np.ndarray:
        """Hash of words i..i+k-1 for i in 0..n-k; runs over row borders are the caller's to mask."""
        if self.n < k:
            return np.empty(0, np.uint64)
        return mix((self.prefix[k:] - self.prefix[:-k]) * self.inverse[: self.n - k + 1])

    def spans(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hash of words i..j-1 for arrays i and j, with the length mixed in."""
        h = mix((self.prefix[j] - self.prefix[i]) * self.inverse[i])
        return mix(h + (j - i).astype(np.uint64))


def inside(ptr: np.ndarray, n: int, k: int) -> np.ndarray:
    """For i in 0..n-k: whether words i..i+k-1 lie in one row."""
    if n < k:
        return np.empty(0, dtype=bool)
    ok = np.ones(n - k + 1, dtype=bool)
    if k > 1:
        borders = ptr[1:-1]
        borders = borders[(borders > 0) & (borders < n)]
        marks = np.zeros(n + 2, dtype=np.int64)
        lo = np.maximum(borders - k + 1, 0)
        np.add.at(marks, lo, 1)
        np.add.at(marks, borders, -1)
        ok = np.cumsum(marks)[: n - k + 1] == 0
    return ok


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each run of w values (op is np.minimum or np.maximum)."""
    if len(x) < w:
        return x[:0]
    step = 1
    while step * 2 <= w:
        x = op(x[:-step], x[step:])
        step *= 2
    if step < w:
        rest = w - step
        x = op(x[: len(x) - rest], x[rest:])
    return x


def leftmost_least(x: np.ndarray, w: int) -> np.ndarray:
    """Where each run of w values has its least, the leftmost of equal ones."""
    if len(x) < w:
        return np.empty(0, np.int64)
    at = np.arange(len(x))
    step, rest = 1, w
    while rest > 1:
        step = min(step, rest - 1)
        right = x[step:] < x[:-step]
        x = np.where(right, x[step:], x[:-step])
        at = np.where(right, at[step:], at[:-step])
        rest -= step
        step *= 2
    return at


def settle() -> None:
    """Give freed memory back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same stage, after which the worker keeps no freed memory: workers wait for the next task beside the executor."""

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            settle()

    return settled


def binary(column: pa.Array) -> pa.Array:
    """A string column as large_binary; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.large_binary())


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a large_binary column."""
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf, offs


def pieces(offs: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes each; a longer row stands alone."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def word_batches(column: pa.Array, lower: bool = False, size: int = 1 << 20, table: np.ndarray | None = None) -> Iterator[Words]:
    """Words of a text column in pieces that fit the processor's cache."""
    buf, offs = raw(binary(column))
    for lo, hi in pieces(offs, size):
        yield Words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lo, lower, table)


def lower_batches(column: pa.Array, size: int = 1 << 20, table: np.ndarray | None = None) -> Iterator[Words]:
    """As word_batches, over the texts in lower case, which is done piece by piece."""
    texts = binary(column)
    _, offs = raw(texts)
    for lo, hi in pieces(offs, size):
        low = pa.array([x.as_py().decode().lower() for x in texts.slice(lo, hi - lo)], pa.large_string()).cast(pa.large_binary())
        buf, o = raw(low)
        yield Words(buf[o[0] : o[-1]], o - o[0], lo, table=table)
