"""Token counts by heap-and-linked-list byte-pair merging, without emitting identifiers.

A pretoken starts as a doubly linked list of byte symbols. A heap holds the adjacent
pairs that can merge, by (rank, position); the lowest is popped again and again, its
two links become one, and its new neighbours are pushed. Tokens = initial symbols less
merges. Counts of pretokens are kept in a bounded table, since most recur.
"""

from __future__ import annotations

import os
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import vocab, wordcore
from lodestrand.runtime import ship

CACHE_ENTRIES = 600_000
#: Bytes from which a pretoken's symbols and links are arrays of numbers.
LONG_WORD = 1 << 16


class HeapCounter(dict):
    """Tokens of a pretoken (its characters as text); counts are remembered up to a bound."""

    def __init__(self, path: str, limit: int = CACHE_ENTRIES):
        super().__init__()
        spec = vocab.load(path)
        self.limit, symbols, suffix = limit, vocab.byte_symbols(), spec["suffix"]
        ids = spec["vocab"]
        self.first = [ids[s] for s in symbols]
        self.last = [ids[s + suffix] for s in symbols]
        self.pairs = {}
        for rank, (a, b) in enumerate(spec["merges"]):
            self.pairs.setdefault((ids[a] << 20) | ids[b], (rank << 20) | ids[a + b])

    def __missing__(self, word: str) -> int:
        n = self.merged(word.encode())
        if len(self) >= self.limit:
            self.clear()
        if len(word) < LONG_WORD:
            self[word] = n
        return n

    def merged(self, data: bytes) -> int:
        """Initial symbols minus merges."""
        n = len(data)
        if n < 2:
            return n
        if n > LONG_WORD:
            return self.merged_long(data)
        first, get = self.first, self.pairs.get
        ids = [first[b] for b in data]
        ids[-1] = self.last[data[-1]]
        heap, i, a = [], 0, ids[0]
        for b in ids[1:]:
            if (m := get(a << 20 | b)) is not None:
                heap.append(m >> 20 << 32 | i)  # rank, then position
            a = b
            i += 1
        if not heap:
            return n
        heapify(heap)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            key = heappop(heap)
            i = key & 0xFFFFFFFF
            if (j := following[i]) >= n:
                continue
            m = get(ids[i] << 20 | ids[j])
            if m is None or m >> 20 != key >> 32:
                continue  # one of the two has merged since
            left -= 1
            new = ids[i] = m & 0xFFFFF
            k = following[i] = following[j]
            following[j] = n  # pairs that begin at a merged-away symbol are void
            if k < n:
                before[k] = i
                if (m := get(new << 20 | ids[k])) is not None:
                    heappush(heap, m >> 20 << 32 | i)
            if (h := before[i]) >= 0 and (m := get(ids[h] << 20 | new)) is not None:
                heappush(heap, m >> 20 << 32 | h)
        return left

    def merged_long(self, data: bytes) -> int:
        """The same for a very long word, in arrays of numbers: the first pairs lie sorted beside the heap of those that merges make."""
        n, get = len(data), self.pairs.get
        ids = array("i", np.array(self.first, np.int32)[np.frombuffer(data, np.uint8)].tobytes())
        ids[-1] = self.last[data[-1]]
        pairs = (get(a << 20 | b) for a, b in zip(ids, islice(ids, 1, None)))
        start = array("Q", (m >> 20 << 32 | i for i, m in enumerate(pairs) if m is not None))
        np.frombuffer(start, np.uint64).sort()
        following, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        heap: list[int] = []
        left, at, size = n, 0, len(start)
        while heap or at < size:
            if at < size and (not heap or start[at] < heap[0]):
                key, at = start[at], at + 1
            else:
                key = heappop(heap)
            i = key & 0xFFFFFFFF
            if (j := following[i]) >= n:
                continue
            m = get(ids[i] << 20 | ids[j])
            if m is None or m >> 20 != key >> 32:
                continue  # one of the two has merged since
            left -= 1
            new = ids[i] = m & 0xFFFFF
            k = following[i] = following[j]
            following[j] = n
            if k < n:
                before[k] = i
                if (m := get(new << 20 | ids[k])) is not None:
                    heappush(heap, m >> 20 << 32 | i)
            if (h := before[i]) >= 0 and (m := get(ids[h] << 20 | new)) is not None:
                heappush(heap, m >> 20 << 32 | h)
        return left


class Pretokens:
    """Normalisation and pretokens of the lower-case word vocabulary."""

    def __init__(self, path: str):
        self.find = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{vocab.SPACE}\p{{L}}\p{{N}}]+").findall
        added = list(vocab.load(path)["added"])
        self.cut = vocab.splitter(added)
        self.mark = os.path.commonprefix(added)  # what every special string begins with, if anything

    @staticmethod
    def normalize(text: str) -> str:
        """NFC, then lower case by single characters; white space only separates pretokens."""
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def count(self, text: str, table: HeapCounter) -> int:
        special = 0
        parts = [text]
        if self.cut is not None and self.mark in text:
            parts = self.cut.split(text)
            special = len(parts) // 2
            parts = parts[::2]
        return special + sum(sum(map(table.__getitem__, self.find(self.normalize(p)))) for p in parts)


_tables: dict[str, tuple[Pretokens, HeapCounter]] = {}


def tools(path: str) -> tuple[Pretokens, HeapCounter]:
    """Made once in each worker process."""
    if path not in _tables:
        _tables[path] = Pretokens(path), HeapCounter(path)
    return _tables[path]


def _counter(path: str, limit: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens, table = tools(path)
        for b in batches:
            text = wordcore.binary(b.column(1))
            _, offs = wordcore.raw(text)
            n = np.fromiter((pretokens.count(x.decode(), table) for x in (v.as_py() for v in text)), np.int64, len(text))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], schema=schema)

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; null text counts as empty (0 tokens).

    Counts equal the tokenizer library's without begin, end or added special tokens; special
    strings inside a text count one each, as the library's default takes them. Repeated rows
    give repeated rows, and an empty table none; other columns are not read.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(wordcore.tidy(_counter(tokenizer_path, limit)), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
