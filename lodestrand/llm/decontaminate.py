"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The n-grams of test items are counted over all documents; those that are rare for their
item are its seeds. A passage that holds a seed is aligned with the item around it, word
by word, so that edited copies score by what they kept. A copy that recurs makes its own
n-grams common, so a passage that holds only common ones is aligned as well, unless the
words that it shares with the item bound its score below the limit. Items travel to the
documents in blocks of bounded size, each broadcast in turn and gone before the next;
alignment never moves a document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestrand.llm import wordcore
from lodestrand.llm.rows import own, private, text_key
from lodestrand.runtime import materialize, ship

SEED_WORDS = 3
BLOCK_BYTES = 8 << 20
MATCH, MISMATCH, GAP = 2, -1, -1


@dataclass
class Items:
    """A block of items: their words as hashes, and sorted n-grams with where they are."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray
    gram_of: np.ndarray  # index into grams of each (item, position)
    item: np.ndarray
    position: np.ndarray
    rare: np.ndarray  # by (item, position)

    @classmethod
    def of(cls, ids: list, texts: list[str], n: int) -> Items:
        words, flat, item, position = [], [], [], []
        for w in wordcore.lower_batches(pa.array(texts, pa.large_string()), table=wordcore.PLAIN):
            h = w.hashes()
            g = wordcore.Grams(h).of(n)
            for i in range(w.rows):
                a, b = int(w.ptr[i]), int(w.ptr[i + 1])
                words.append(h[a:b])
                if b - a >= n:
                    m = b - a - n + 1
                    flat.append(g[a : a + m])
                    item.append(np.full(m, w.first_row + i))
                    position.append(np.arange(m))
        every = np.concatenate(flat) if flat else np.empty(0, np.uint64)
        grams, of = np.unique(every, return_inverse=True)
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return cls(ids, words, grams, of, join(item), join(position), np.ones(len(every), bool))

    def mark_rare(self, frequency: np.ndarray) -> None:
        """Rare are the n-grams in at most four times as many documents, and 16, as the item's lower quartile."""
        if not len(self.item):
            return
        f = frequency[self.gram_of]
        order = np.lexsort((f, self.item))
        begin = np.flatnonzero(np.diff(self.item[order], prepend=-1))
        size = np.diff(np.append(begin, len(order)))
        self.rare[order] = f[order] <= np.repeat(4 * f[order[begin + (size - 1) // 4]] + 16, size)

    def index(self) -> None:
        """Order places by n-gram, for lookups."""
        order = np.argsort(self.gram_of, kind="stable")
        self.item, self.position, self.rare, of = self.item[order], self.position[order], self.rare[order], self.gram_of[order]
        used, first = np.unique(of, return_index=True)
        self.grams = self.grams[used]
        self.first = np.append(first, len(of))


def found(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in x of values among the keys, and which key each is; a bit table spares most searches."""
    if not len(sorted_keys) or not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = max(16, min(24, int(len(sorted_keys)).bit_length() + 4))
    table = np.zeros(1 << bits, bool)
    shift = np.uint64(64 - bits)
    table[sorted_keys >> shift] = True
    maybe = np.flatnonzero(table[x >> shift])
    at = np.searchsorted(sorted_keys, x[maybe])
    at[at == len(sorted_keys)] = 0
    ok = sorted_keys[at] == x[maybe]
    return maybe[ok], at[ok]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of word hashes, and where in the passage it ends (exclusive)."""
    j = np.arange(1, len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for x in item:
        diagonal = row[:-1] + np.where(passage == x, MATCH, MISMATCH)
        t = np.maximum(np.maximum(diagonal, row[1:] + GAP), 0)
        # Gaps along the passage: the best of t[k] + GAP * (j - k) over k <= j.
        row[1:] = np.maximum.accumulate(t - GAP * j) + GAP * j
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def in_common(item: np.ndarray, passage: np.ndarray) -> int:
    """How many words the two have in common, repeats counted: no alignment matches more."""
    words, n = np.unique(item, return_counts=True)
    there, k = np.unique(passage[np.isin(passage, words)], return_counts=True)
    return int(np.minimum(n[np.searchsorted(words, there)], k).sum())


def matches(items: Items, w: wordcore.Words, n: int, min_score: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, score, from, to) of the best passage of each row and item that reaches min_score."""
    h = w.hashes()
    g = wordcore.Grams(h).of(n)
    at, gram = found(items.grams, g)
    if not len(at):
        return
    ok = wordcore.inside(w.ptr, len(w), n)[at]
    at, gram = at[ok], gram[ok]
    size = items.first[gram + 1] - items.first[gram]
    place = np.repeat(items.first[gram] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    at = np.repeat(at, size)
    item, position, rare = items.item[place], items.position[place], items.rare[place]
    row = np.searchsorted(w.ptr, at, side="right") - 1
    order = np.lexsort((at - position, item, row))
    row, item, start, rare = row[order], item[order], (at - position)[order], rare[order]
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))) if len(row) else []
    for a, b in zip(new, [*new[1:], len(row)]):
        r, i = int(row[a]), int(item[a])
        words = items.words[i]
        m = len(words)
        pad = m // 2 + 1
        lo_row, hi_row = int(w.ptr[r]), int(w.ptr[r + 1])
        best = (0, 0, 0)
        lo = hi = None
        seeded = False
        for s, seed in [*zip(start[a:b].tolist(), rare[a:b].tolist()), (None, False)]:
            if s is not None and hi is not None and s - pad <= hi:
                hi, seeded = s + m + pad, seeded or seed
                continue
            if hi is not None:
                x, y = max(lo, lo_row), min(hi, hi_row)
                passage = h[x:y]
                # No alignment can match more words than the two have in common.
                if np.isin(words, passage).sum() >= min_score * m and (seeded or in_common(words, passage) >= min_score * m):
                    score, end = align(words, passage)
                    if score > best[0]:
                        best = (score, x, x + end)
            if s is not None:
                lo, hi, seeded = s - pad, s + m + pad, seed
        score = best[0] / (MATCH * m)
        if score >= min_score:
            yield r, i, score, max(best[1], best[2] - m) - lo_row, best[2] - lo_row


def blocks(docs: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", doc_text: str = "text", n: int = SEED_WORDS, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[bool, Broadcast]]:
    """The items as broadcast blocks of about block_bytes of text each, with their rare n-grams marked over all documents,
    and whether a block is the only one.

    One block is alive at a time: the caller destroys it before it asks for the next.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // block_bytes) or 1
    for i in range(count):
        part = slim.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == i).collect() if count > 1 else slim.collect()
        block = Items.of([r["id"] for r in part], [r["text"] for r in part], n)
        value = spark.sparkContext.broadcast(block.grams)

        def count_grams(batches: Iterator[pa.RecordBatch], value=value) -> Iterator[pa.RecordBatch]:
            grams = value.value
            seen = np.zeros(len(grams), np.int64)
            for b in batches:
                for w in wordcore.lower_batches(b.column(0), table=wordcore.PLAIN):
                    at, gram = found(grams, wordcore.Grams(w.hashes()).of(n))
                    ok = wordcore.inside(w.ptr, len(w), n)[at]
                    row = np.searchsorted(w.ptr, at[ok], side="right") - 1
                    seen += np.bincount(np.unique(row * len(grams) + gram[ok]) % max(len(grams), 1), minlength=len(grams))
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["gram", "n"])

        text = docs.select(F.col(doc_text).cast("string").alias("text"))
        sums = text.mapInArrow(wordcore.tidy(count_grams), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        value.destroy()
        frequency = np.zeros(len(block.grams), np.int64)
        frequency[sums["gram"].to_numpy()] = sums["n"].to_numpy()
        block.mark_rare(frequency)
        block.index()
        yield count == 1, spark.sparkContext.broadcast(block)


def _over_blocks(docs: DataFrame, items: DataFrame, found_by: Callable[[Broadcast], DataFrame], item_id: str, item_text: str, text_col: str, block_bytes: int) -> DataFrame:
    """What found_by gives for every block; with more than one, each block's rows are written before the next is made."""
    out = None
    for only, value in blocks(docs, items, item_id, item_text, text_col, block_bytes=block_bytes):
        part = found_by(value)
        if only:
            return part
        part = materialize(part, "contaminated")
        value.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(docs: DataFrame, items: DataFrame, min_score: float = 0.4, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word: each document's best passage for each item it copies.

    score is the alignment's score over that of the item with itself, from min_score to 1.
    Words are lower-cased runs of letters and digits. Items of fewer than three words, or
    null, are no evidence and match nothing; null and empty texts hold nothing. Item ids keep
    their type; items that repeat are reported each, as are repeated rows. Other columns are
    not read. Without items or documents there are no rows.
    """
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = items.schema[item_id].dataType
    fields = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", kind), T.StructField("score", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType())])
    schema = to_arrow_schema(fields)

    def found_by(value: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = value.value
            for b in batches:
                ids = b.column(0)
                rows = []
                for w in wordcore.lower_batches(b.column(1), table=wordcore.PLAIN):
                    for r, i, score, lo, hi in matches(block, w, SEED_WORDS, min_score):
                        rows.append((ids[w.first_row + r].as_py(), block.ids[i], round(score, 6), lo, hi))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        return slim.mapInArrow(wordcore.tidy(run), fields)

    return _over_blocks(docs, items, found_by, item_id, item_text, text_col, block_bytes)


def clean(docs: DataFrame, items: DataFrame, min_score: float = 0.4, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, that copy no item.

    Null and empty texts copy nothing and stay; repeated rows are judged each, by their text
    alone. Without items all stay; an empty table gives no rows. Other columns may have any
    names.
    """
    at = docs.columns.index(text_col)
    name = text_col

    def kept_by(value: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = value.value
            for b in batches:
                yield b.filter(pa.array(~_holds(block, b.column(at), min_score)))

        return docs.mapInArrow(wordcore.tidy(run), docs.schema)

    def texts_by(value: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = value.value
            for b in batches:
                hit = pa.array(_holds(block, b.column(1), min_score))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(hit)], names=["key"])

        return docs.select(text_key(F.col(name)).alias("key"), F.col(name).cast("string").alias("text")).mapInArrow(wordcore.tidy(run), "key binary")

    total = items.agg(F.sum(F.octet_length(F.col(item_text).cast("string")))).first()[0] or 0
    if total <= block_bytes:
        return _over_blocks(docs, items, kept_by, item_id, item_text, text_col, block_bytes)
    key, gone = private(docs, "key", "gone")
    texts = _over_blocks(docs, items, texts_by, item_id, item_text, text_col, block_bytes).distinct().toDF(gone)
    rows = docs.select(*own(docs), text_key(F.col(name)).alias(key))
    return rows.join(texts.hint("shuffle_hash"), F.col(key) == F.col(gone), "left_anti").select(*own(docs))


def _holds(block: Items, texts: pa.Array, min_score: float) -> np.ndarray:
    """Whether each text copies an item of the block."""
    hit = np.zeros(len(texts), bool)
    for w in wordcore.lower_batches(texts, table=wordcore.PLAIN):
        for r, *_ in matches(block, w, SEED_WORDS, min_score):
            hit[w.first_row + r] = True
    return hit
