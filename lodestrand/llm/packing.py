"""Cost-balanced packing of token sequences.

A document's cost is linear in its tokens plus quadratic, for attention. Within a
bounded block of documents, whole sequences are cut from long documents first; the rests,
in descending order, each go to the lowest-cost open sequence with room for them, and
are cut only where no open sequence has room. All open sequences end up full; what is
left, less than one sequence in a block, goes to sequences of a power of two, which need
no padding. Blocks are packed where their rows lie, so nothing is shuffled.
"""

from __future__ import annotations

import heapq
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrand.llm import vocab, wordcore
from lodestrand.runtime import ship

CACHE_ENTRIES = 200_000
#: Characters of a text from which its ids are not held as a list.
LONG_TEXT = 1 << 20


class ByteBpe(dict):
    """Identifiers of a text as little-endian 32-bit bytes, as the tokenizers library gives them.

    Where a vocabulary's ids are in order of its merges, the tiktoken library gives the same
    for whole texts in less time. Otherwise, and where its pattern gives up on a very long run
    of white space, each distinct pretoken is encoded once: byte-level pretokens are encoded
    independently of each other, so joining them gives what the whole text gives.
    """

    def __init__(self, path: str, limit: int = CACHE_ENTRIES):
        super().__init__()
        self.path, self.limit = path, limit
        self.whole = Tokenizer.from_file(path)
        self.fast = self._by_ranks(vocab.load(path))
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in vocab.load(path)["added"].items()}
        self.cut = vocab.splitter(list(self.special))
        white = vocab.SPACE
        self.find = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{white}\p{{L}}\p{{N}}]+|[{white}]+(?![^{white}])|[{white}]+"
        ).findall

    @staticmethod
    def _by_ranks(spec: dict) -> tiktoken.Encoding | None:
        """An encoder by the same vocabulary, if its ids are in order of its merges."""
        byte_of = {c: b for b, c in enumerate(vocab.byte_symbols())}
        ids = {k: v for k, v in spec["vocab"].items() if k not in spec["added"]}
        made = [ids[a + b] for a, b in spec["merges"]]
        if spec["suffix"] or made != sorted(set(made)) or any(c not in byte_of for k in ids for c in k):
            return None
        ranks = {bytes(byte_of[c] for c in k): v for k, v in ids.items()}
        pattern = r"'(?:[stmd]|re|ve|ll)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s+"
        return tiktoken.Encoding("texts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.whole.encode(word, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        if len(self) >= self.limit:
            self.clear()
        self[word] = ids.tobytes()
        return self[word]

    def pretokens(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def plain(self, text: str) -> bytes:
        """A text without special strings."""
        if self.fast is None:
            return self.pretokens(text)
        try:
            if len(text) > LONG_TEXT:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            ids = array("I", self.fast.encode_ordinary(text))
        except BaseException as e:  # the library's own kind of error for its pattern's limit is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return self.pretokens(text)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(self.special[part] if i % 2 else self.plain(part) for i, part in enumerate(self.cut.split(text)))


_encoders: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """Made once in each worker process."""
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for document lengths of one block."""
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    rests: list[tuple[int, int, int]] = []  # length, document, start
    for doc, n in enumerate(lengths):
        whole = n // capacity
        for i in range(whole):
            out.append((doc, i * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rests.append((n % capacity, doc, whole * capacity))
    rests.sort(key=lambda r: (-r[0], r[1]))
    total = sum(r[0] for r in rests)
    opened = total // capacity
    first_open = sequence
    room = [capacity] * opened
    cost = [0.0] * opened
    by_cost = [(0.0, s) for s in range(opened)]  # sequences that may have room for the length at hand
    waiting: list[tuple[int, int]] = []  # (-room, sequence) of those found too full for it
    tail: list[tuple[int, int, int]] = []

    def put(s: int, doc: int, start: int, n: int) -> None:
        out.append((doc, start, n, first_open + s, capacity - room[s]))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for n, doc, start in rests:
        while waiting and -waiting[0][0] >= n:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(by_cost, (cost[s], s))
        placed = False
        while by_cost:
            _, s = heapq.heappop(by_cost)
            if room[s] >= n:
                put(s, doc, start, n)
                if room[s]:
                    heapq.heappush(by_cost, (cost[s], s))
                placed = True
                break
            heapq.heappush(waiting, (-room[s], s))
        while not placed and n:
            if not waiting:
                tail.append((n, doc, start))
                break
            s = heapq.heappop(waiting)[1]
            part = min(n, room[s])
            put(s, doc, start, part)
            start, n = start + part, n - part
            if room[s]:
                heapq.heappush(by_cost, (cost[s], s))
    sequence += opened
    left = sum(t[0] for t in tail)
    size = 1
    while size * 2 <= left:
        size *= 2
    used = 0
    for n, doc, start in tail:
        while n:
            while size > left:
                size //= 2
            part = min(n, size - used)
            out.append((doc, start, part, sequence, used))
            used, start, n = used + part, start + part, n - part
            if used == size:
                left, used, sequence = left - size, 0, sequence + 1
    return out


_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in _PIECES.split(", ")])


def _packer(path: str, capacity: int, block_tokens: int):
    def flush(ids: list[bytes], doc_ids: list, base: int) -> tuple[pa.RecordBatch, int]:
        lengths = [len(x) // 4 for x in ids]
        pieces = assign(lengths, capacity)
        rows = [
            (doc_ids[d], start, n, zlib.crc32(memoryview(ids[d])[4 * start : 4 * (start + n)]), lengths[d], base + s, off)
            for d, start, n, s, off in pieces
        ]
        rows.sort(key=lambda r: (r[5], r[6]))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_SCHEMA), rows[-1][5] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        ids, doc_ids, held = [], [], 0
        end = b"\0\0\0\0"
        for b in batches:
            for doc_id, text in zip(b.column(0), wordcore.binary(b.column(1))):
                x = enc.encode(text.as_py().decode()) + end
                ids.append(x)
                doc_ids.append(doc_id.as_py())
                held += len(x) // 4
                if held >= block_tokens:
                    batch, base = flush(ids, doc_ids, base)
                    yield batch
                    ids, doc_ids, held = [], [], 0
        if ids:
            yield flush(ids, doc_ids, base)[0]

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, block_tokens: int = 4_000_000) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its identifiers and then one 0; null text is the empty one, so every row
    gives at least one piece. Repeated rows are packed each; an empty table gives no rows.
    A null id is kept as null. sequence_id is unique over tasks (partition number, count).
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(wordcore.tidy(_packer(tokenizer_path, capacity, block_tokens)), _PIECES)
