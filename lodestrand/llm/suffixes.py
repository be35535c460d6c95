"""Repeated spans by sparse suffix arrays.

Suffixes are kept only where minimisers choose a place from the content (see repeats), so
two copies of a span keep suffixes at the same places of it. The suffixes of one minimiser
are sorted, and so are the reversed prefixes before them; comparing neighbours gives, for
every depth, the intervals of suffixes that agree so far to the right and to the left. A
window that begins o words before its minimiser and has r words from there on occurs
twice exactly where two suffixes share an interval of depth r to the right and one of depth
o to the left, so matches are extended both ways without looking at windows one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import repeats, wordcore


def _common(a: list, b: list) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] agree, a[:hi] don't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _intervals(keys: list[list[bytes]], depths: np.ndarray) -> np.ndarray:
    """For each sequence and depth the interval of sequences, in sorted order, that agree with it so far."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    alike = np.array([_common(keys[i], keys[j]) for i, j in zip(order, order[1:])])
    out = np.zeros((len(keys), len(depths)), np.int64)
    out[order[1:]] = np.cumsum(alike[:, None] < depths[None, :], axis=0)
    return out


def suffix_marks(segments: list[tuple[list[bytes], int, int]], window: int) -> list[int]:
    """Marks of a shard's segments: bit i where the window at word i occurs twice or more.

    Segments are distinct, and equal windows have the anchor at the same place of them.
    """
    full = [(1 << (len(words) - window + 1)) - 1 for words, _, _ in segments]
    masks = [f if n > 1 else 0 for f, (_, _, n) in zip(full, segments)]
    if masks == full or len(segments) < 2:
        return masks
    right = [words[a:] for words, a, _ in segments]
    left = [words[:a][::-1] for words, a, _ in segments]
    if len(segments) == 2:
        r, l = _common(*right), _common(*left)
        if r + l >= window:
            bits = (1 << (r + l - window + 1)) - 1
            for x in (0, 1):
                masks[x] |= bits << (segments[x][1] - l)
        return masks
    anchor = np.array([a for _, a, _ in segments])
    windows = np.array([len(words) - window + 1 for words, _, _ in segments])
    before = np.arange(min(int(anchor.max()) + 1, window))  # words of a window before its anchor
    both = _intervals(right, window - before) * len(segments) + _intervals(left, before)
    at = anchor[:, None] - before[None, :]
    both[(at < 0) | (at >= windows[:, None])] = -1
    order = np.argsort(both, axis=0)
    ranked = np.take_along_axis(both, order, axis=0)
    twice = (ranked[1:] == ranked[:-1]) & (ranked[1:] >= 0)
    hit = np.zeros(both.shape, bool)
    np.put_along_axis(hit, order, np.pad(twice, ((1, 0), (0, 0))) | np.pad(twice, ((0, 1), (0, 0))), axis=0)
    for x, o in zip(*(i.tolist() for i in np.nonzero(hit))):
        masks[x] |= 1 << (segments[x][1] - o)
    return masks


_SPAN = "key binary, start_word bigint, span_words bigint, doc_words bigint, span_sha256 string"


def _spans(window: int):
    schema = pa.schema([("key", pa.binary()), ("start_word", pa.int64()), ("span_words", pa.int64()), ("doc_words", pa.int64()), ("span_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

        for key, text, whole, marks in repeats.once(batches):
            words = text.split()
            hit = np.concatenate([[False], repeats.covered(len(words), whole, marks, window), [False]])
            edge = np.flatnonzero(hit[1:] != hit[:-1])
            for lo, hi in edge.reshape(-1, 2).tolist():
                out.append((key, lo, hi - lo, len(words), hashlib.sha256(b" ".join(words[lo:hi])).hexdigest()))
            if len(out) > 20_000:
                yield batch()
                out = []
        if out:
            yield batch()

    return run


def repeated_spans(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", k: int = 16, shard: int = repeats.SHARD) -> DataFrame:
    """A row for each span: doc_id, start_word, span_words, doc_words, span_sha256.

    A span is a longest run of words each covered by min_words words in a row that also
    occur elsewhere in the input (another row, or another place of the row). Rows without
    a span, among them null, empty and shorter texts, give none; repeated rows are copies
    of each other and give their spans each. Other columns are not read. An empty table
    gives no rows.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    spans = repeats.marked_texts(rows, min_words, k, suffix_marks, shard).mapInArrow(wordcore.tidy(_spans(min_words)), _SPAN)
    joined = rows.select("doc_id", F.col("key").alias("own")).join(spans, F.col("own") == F.col("key"))
    return joined.select("doc_id", "start_word", "span_words", "doc_words", "span_sha256")
