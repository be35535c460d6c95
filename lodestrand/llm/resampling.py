"""Importance resampling towards a target: hashed n-gram buckets, log-ratio gains, Gumbel top-k.

Two passes over Arrow batches. The first counts each task's features with np.bincount into
one vector of all buckets, and treeReduce adds the vectors. The gains of the buckets, a vector
of fixed length, are broadcast; the second pass gathers them by bucket and sums them per
document with weighted bincounts. Rows then carry a few numbers only, and the draw is a range
sort of those: no task holds all of them.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import wordcore
from lodestrand.operators.numbering import numbered
from lodestrand.runtime import lifetime, materialize, ship

#: Text that is cut into words at a time, and the length from which a word's checksum is taken alone.
PIECE, LONG = 1 << 20, 48
#: Letters, digits and all bytes beyond ASCII stay, A-Z in lower case; anything else is a space.
_WORD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def _crc_table() -> np.ndarray:
    """Checksum step of one byte, for the reflected polynomial of CRC-32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_STEP = _crc_table()


def checksums(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of buf[start : start + length] for each row, going on from a checksum state; all short rows step together."""
    out = state.copy()
    short = np.flatnonzero(lengths <= LONG)
    order = short[np.argsort(lengths[short], kind="stable")[::-1]]
    c, at, size = ~out[order], starts[order], lengths[order]
    ends = np.searchsorted(-size, -np.arange(LONG + 1), side="left")  # how many rows are longer than k
    for k in range(int(size[0]) if len(size) else 0):
        n = int(ends[k])
        c[:n] = _STEP[(c[:n] ^ buf[at[:n] + k]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    out[order] = ~c
    for i in np.flatnonzero(lengths > LONG):
        out[i] = zlib.crc32(buf[starts[i] : starts[i] + lengths[i]], int(state[i]))
    return out


def _parts(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first row, row after the last, bytes, offsets, whether the row goes on from the part before).

    A row longer than PIECE comes in several parts, cut between words.
    """
    for lo, hi in wordcore.pieces(offs, PIECE):
        a, z = int(offs[lo]), int(offs[hi])
        if hi - lo > 1 or z - a <= PIECE:
            yield lo, hi, _WORD[buf[a:z]], offs[lo : hi + 1] - a, False
            continue
        at = a
        while at < z:
            end = min(at + PIECE, z)
            while end < z and (gap := np.flatnonzero(_WORD[buf[end : end + PIECE]] == 32)).size == 0:
                end = min(end + PIECE, z)
            if end < z:
                end += int(gap[0])
            yield lo, hi, _WORD[buf[at:end]], np.array([0, end - at]), at > a
            at = end


def buckets(texts: pa.Array, n_buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row of each feature from there, bucket of each feature, words of each row), part by part.

    A long text comes in several parts, so a row may be met again.
    """
    buf, offs = wordcore.raw(texts)
    last = b""
    for lo, hi, part, at, goes_on in _parts(buf, offs):
        words = wordcore.Words(part, at, lo)
        rows, n = words.row_of(), len(words)
        counts = np.diff(words.ptr)
        if n:
            lengths = words.ends - words.starts
            one = checksums(part, words.starts, lengths, np.zeros(n, np.uint32))
            spaced = _STEP[(~one ^ np.uint32(32)) & np.uint32(255)] ^ (~one >> np.uint32(8))
            second = np.flatnonzero(rows[1:] == rows[:-1]) + 1
            two = checksums(part, words.starts[second], lengths[second], ~spaced[second - 1])
            found, of = np.concatenate([one, two]), np.concatenate([rows, rows[second]])
            if goes_on and last:
                word = part[words.starts[0] : words.ends[0]].tobytes()
                found = np.append(found, np.uint32(zlib.crc32(last + b" " + word)))
                of = np.append(of, 0)
            last = part[words.starts[-1] : words.ends[-1]].tobytes()
            yield lo, hi, of, (found % np.uint32(n_buckets)).astype(np.int64), counts
        else:
            last = last if goes_on else b""
            yield lo, hi, rows, np.empty(0, np.int64), counts


def bucket_counts(rows: DataFrame, text: Column, n_buckets: int = 10_000, depth: int = 2) -> np.ndarray:
    """Features of all rows by bucket: one vector a task, added up in a tree."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for b in batches:
            for _, _, _, found, _ in buckets(wordcore.binary(b.column(0)), n_buckets):
                total += np.bincount(found, minlength=n_buckets)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    vectors = rows.select(text.cast("string").alias("text")).mapInArrow(wordcore.tidy(counted), "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    if not vectors.getNumPartitions():  # else every task gives a vector, though of zeros
        return np.zeros(n_buckets, np.int64)
    return vectors.treeReduce(lambda a, b: a + b, depth)


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1_000) -> np.ndarray:
    """floor(scale * ln(target share / source share)) of each bucket, every bucket counted once more."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n))
    return np.array([math.floor(scale * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int, scale: int = 1_000) -> int:
    """Noise of a row by its id: floor(-scale * ln(-ln(u))), u from 32 bits of a hash."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


_WEIGHED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in _WEIGHED.split(", ")])


def _weigher(gain, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket = gain.value
        for b in batches:
            size = b.num_rows
            words, sums, features = np.zeros(size, np.int64), np.zeros(size), np.zeros(size, np.int64)
            for lo, hi, of, found, counts in buckets(wordcore.binary(b.column(1)), len(of_bucket)):
                words[lo:hi] += counts
                features[lo:hi] += np.bincount(of, minlength=hi - lo)
                sums[lo:hi] += np.bincount(of, weights=of_bucket[found], minlength=hi - lo)  # whole numbers below 2**53
            weight = sums.astype(np.int64) // np.maximum(features, 1)
            noise = np.array([gumbel(i, seed) for i in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, features, weight, weight + noise))], schema=_SCHEMA)

    return run


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    least_words: int = 20,
    n_buckets: int = 10_000,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """Every document with its weight towards the target, its noisy score and its rank if drawn.

    Returns doc_id, n_features, weight, score, rank (bigint). Features are words and pairs of
    neighbouring words, each in the bucket of its CRC-32. A weight is the mean gain of a
    document's features, floored; without features it is 0. Of the documents with at least
    least_words words, percent in a hundred (floored) of the highest scores are drawn, without
    replacement and alike at every run; ties go to the smaller id, a null id before all others,
    then to more features and greater weight. Null text has no words; a null id is hashed as
    the empty text. Repeated rows are each a document; other columns are not read. An empty
    table gives no rows, an empty target counts as evenly spread.
    """
    spark = docs.sparkSession
    ship(spark)
    with lifetime(spark) as keep:
        source = bucket_counts(docs, F.col(text_col), n_buckets)
        gain = spark.sparkContext.broadcast(gains(source, bucket_counts(target, F.col(target_text_col), n_buckets)))  # n_buckets numbers
        slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        weighed = materialize(slim.mapInArrow(wordcore.tidy(_weigher(gain, seed)), _WEIGHED), "weighed")
        gain.destroy()
        eligible = F.col("n_words") >= least_words
        drawn = weighed.where(eligible).count() * percent // 100
        placed = weighed.withColumn("few", ~eligible).withColumn("read", F.monotonically_increasing_id())
        ranked = materialize(numbered(placed, "few", F.desc("score"), "doc_id", F.desc("n_features"), F.desc("weight"), "read", name="rank"), "ranked")
        keep(ranked)
    rank = F.when(F.col("rank") <= drawn, F.col("rank").cast("bigint"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
