"""Substring deduplication with suffix automata of reference shards.

A shard holds the text that can recur at one anchor (see repeats), split by content where
an anchor has more than a shard may hold, so it is bounded. Its
suffix automaton, over words, knows how often each of its substrings occurs; the shard's
documents are then streamed through it for matching statistics, and every match of at
least the threshold that occurs twice or more is marked. What the marks cover is removed.
Shards go to the documents that can match them by key, not by broadcast of every shard
to every document, which would cost the corpus squared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import repeats, wordcore


class SuffixAutomaton:
    """Suffix automaton of several sequences; count[s] is how often the substrings of state s occur, by weight."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def _clone(self, p: int, c, q: int) -> int:
        clone = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.count.append(0)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence: Sequence, weight: int = 1) -> None:
        """Add a sequence that occurs weight times."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
            else:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                count.append(0)
                p = last
                while p >= 0 and (q := nxt[p].get(c)) is None:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                last = cur
            count[last] += weight

    def finish(self) -> None:
        """Carry the counts up the suffix links; once, after the last add."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def stream(self, sequence: Sequence, least: int) -> Iterator[tuple[int, int]]:
        """(position, occurrences) where the match that ends at the position has least symbols or more.

        Occurrences are those of the match's last `least` symbols.
        """
        nxt, link, length = self.next, self.link, self.length
        s = n = 0
        for i, c in enumerate(sequence):
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            q = nxt[s].get(c)
            if q is None:
                s = n = 0
                continue
            s, n = q, n + 1
            while length[link[s]] >= least:
                s = link[s]
                n = length[s]
            if n >= least:
                yield i, self.count[s]


def automaton_marks(segments: list[tuple[list[bytes], int, int]], window: int) -> list[int]:
    """Marks of a shard's segments: bit i where the window at word i occurs twice or more."""
    counts = repeats.word_counts(segments)
    masks = [0] * len(segments)
    runs = repeats.recurring(counts, segments, window)
    if not runs:
        return masks
    weight: dict[tuple, int] = {}
    where: dict[tuple, list[tuple[int, int]]] = {}
    for i, lo, hi in runs:
        piece = tuple(segments[i][0][lo:hi])
        weight[piece] = weight.get(piece, 0) + segments[i][2]
        where.setdefault(piece, []).append((i, lo))
    sam = SuffixAutomaton()
    for piece, n in weight.items():
        sam.add(piece, n)
    sam.finish()
    for piece, places in where.items():
        mask = 0
        for end, n in sam.stream(piece, window):
            if n > 1:
                mask |= 1 << (end - window + 1)
        for i, lo in places:
            masks[i] |= mask << lo
    return masks


_CUT = "key binary, n_words bigint, n_removed bigint, kept_sha256 string"


def _cleaned(window: int):
    schema = pa.schema([("key", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, text, whole, marks in repeats.once(batches):
            words = text.split()
            kept = words
            if whole or marks:
                gone = repeats.covered(len(words), whole, marks, window)
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            out.append((key, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if len(out) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", k: int = 12, shard: int = repeats.SHARD) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row.

    Each word covered by a run of `window` words that also starts anywhere else in the
    input, the same row included, counts as removed; runs are judged on the input. A null
    text has no words; repeated rows are copies of each other, so both lose their runs.
    Rows shorter than the window keep all. Other columns are not read. An empty table gives
    no rows.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    cut = repeats.marked_texts(rows, window, k, automaton_marks, shard, all_texts=True).mapInArrow(wordcore.tidy(_cleaned(window)), _CUT)
    joined = rows.select("doc_id", F.col("key").alias("own")).join(cut, F.col("own") == F.col("key"))
    return joined.select("doc_id", "n_words", "n_removed", "kept_sha256")
