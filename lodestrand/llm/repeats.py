"""Repeated windows of words across a corpus: the routing that suffix structures work on.

Equal texts are folded first, to one text and whether more rows hold it, so a group of
copies weighs as much as one document. Every window of L words has an anchor, the leftmost
of its least-hashed runs of k words, which equal windows share at the same place. A window
can recur only if its anchor occurs at two places, so anchors are counted over all texts,
and only windows of recurring anchors go on. They travel as segments (the windows in a row
with one anchor), equal segments of a task as one, to the shard of their anchor, where a
suffix structure decides which of their windows occur twice or more. An anchor with more
places than a shard may hold is split by content: its windows go one by one to a shard of
the anchor and the window's fingerprint, where the same structure decides.

Texts cross the network once: the exchange that deals them by key serves the search for
segments and the final cut (Spark reuses it), and only anchors, segments and marks move
besides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm import wordcore
from lodestrand.llm.wordcore import TOP
from lodestrand.runtime import materialize, release, ship

#: Places of an anchor that one shard may hold; anchors with more are split by content.
SHARD = 4_000
#: Keys of texts that a task remembers in order to fold equal ones.
REMEMBERED = 500_000
#: Bytes of distinct segments that a task holds before it sends them.
HELD = 16 << 20
#: Places of a settled window that travel together.
SETTLED = 10_000
MEMBER = np.dtype([("key", "V16"), ("start", "<i4")])

#: Distinct segments of a shard, each (words, anchor offset, places that have it), to the marks of each.
Marker = Callable[[list[tuple[list[bytes], int, int]], int], list[int]]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (null as empty) and key, 128 bits of the text; equal texts share it."""
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return slim.select("doc_id", "text", F.unhex(F.md5("text")).alias("key"))


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) of a task, equal ones once as far as the memory of keys reaches."""
    seen: set[bytes] = set()
    for b in batches:
        keep = np.zeros(b.num_rows, bool)
        for i, key in enumerate(b.column(0).to_pylist()):
            if key not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                keep[i] = True
        yield b.filter(pa.array(keep))


_TEXT = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("text", T.StringType(), False)])


def texts_of(rows: DataFrame) -> DataFrame:
    """key and text of the rows, equal ones of a task once."""
    return rows.select("key", "text").mapInArrow(wordcore.tidy(_first_seen), _TEXT)


def _anchors(w: wordcore.Words, grams: wordcore.Grams, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of k words, the windows that lie in one row, and where each has its anchor."""
    g = grams.of(k)
    g[~wordcore.inside(w.ptr, len(w), k)] = TOP
    at = np.flatnonzero(wordcore.inside(w.ptr, len(w), window))
    return g, at, wordcore.leftmost_least(g, window - k + 1)[at]


def _selected(window: int, k: int):
    """A row for each anchor of a text: its hash, the text's key, and at how many places of the text it is one."""
    schema = pa.schema([("v", pa.int64()), ("key", pa.binary()), ("c", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _first_seen(batches):  # in this worker, as a second one would hold as much again
            for w in wordcore.word_batches(b.column(1)):
                if len(w) < window:
                    continue
                g, _, place = _anchors(w, wordcore.Grams(w.hashes()), window, k)
                place = np.unique(place)
                v, row = g[place], np.searchsorted(w.ptr, place, side="right") - 1
                order = np.lexsort((v, row))
                v, row = v[order], row[order]
                first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (row[1:] != row[:-1]))) if len(v) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[first].view(np.int64)), b.column(0).take(pa.array(w.first_row + row[first])), pa.array(np.diff(np.append(first, len(v))).astype(np.int32))], schema=schema
                )

    return run


_SEGMENT = "v bigint, part int, sid binary, body binary, anchor int, members binary"


class _Held:
    """Distinct segments of a task with the places that have them.

    Where an anchor is split, a segment is one window, so two places of it settle each other:
    two go to the shard, for the sake of other tasks, and the rest are marked as they are and
    dealt evenly (part -1). A shard so gets two places of a window from a task at most.
    """

    schema = pa.schema([("v", pa.int64()), ("part", pa.int32()), ("sid", pa.binary()), ("body", pa.binary()), ("anchor", pa.int32()), ("members", pa.binary())])

    def __init__(self) -> None:
        self.rows: dict[bytes, list] = {}
        self.bytes = 0

    def add(self, v: int, part: int, anchor: int, body: bytes, key: bytes, start: int, alone: bool) -> None:
        sid = hashlib.md5(b"%d %d " % (v, anchor) + body, usedforsecurity=False).digest()
        e = self.rows.get(sid)
        if e is None:
            e = self.rows[sid] = [v, part, body, anchor, bytearray(), alone]
            self.bytes += len(body) + 200
        e[4] += key + start.to_bytes(4, "little")
        self.bytes += 20

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows, two = [], 2 * MEMBER.itemsize
        for sid, e in self.rows.items():
            settled = e[5] and len(e[4]) > two
            rows.append((e[0], e[1], sid, e[2], e[3], bytes(e[4][:two] if settled else e[4])))
            for lo in range(two, len(e[4]) if settled else 0, SETTLED * MEMBER.itemsize):
                members = bytes(e[4][lo : lo + SETTLED * MEMBER.itemsize])
                rows.append((int.from_bytes(members[:8], "little", signed=True), -1, b"", b"", 0, members))
        self.rows, self.bytes = {}, 0
        for lo in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 20_000]), self.schema.types)], schema=self.schema)


def _segments(window: int, k: int):
    """Segments of the windows whose anchors are among those listed for their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for b in batches:
            keys, listed, cuts = b.column(0), b.column(2), b.column(3)
            for w in wordcore.word_batches(b.column(1)):
                known, parts = _row_keys(listed.slice(w.first_row, w.rows), cuts.slice(w.first_row, w.rows))
                grams = wordcore.Grams(w.hashes())
                g, at, place = _anchors(w, grams, window, k)
                if not len(at) or not len(known):
                    continue
                row = np.searchsorted(w.ptr, at, side="right") - 1
                found = np.searchsorted(known, own := _row_key(g[place], row))
                found[found == len(known)] = 0
                there = known[found] == own
                at, row, place, split = at[there], row[there], place[there], parts[found[there]]
                if not len(at):
                    continue
                v = g[place].view(np.int64)
                name = [keys[w.first_row + r].as_py() for r in range(w.rows)]
                # Windows of split anchors are segments of their own.
                new = np.append(True, (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1]) | (split[1:] > 1))
                begin = np.flatnonzero(new)
                length = np.diff(np.append(begin, len(at)))
                s, r, a, cut = at[begin], row[begin], place[begin] - at[begin], split[begin]
                part = np.where(cut > 1, (grams.spans(s, s + window) % cut.astype(np.uint64)).astype(np.int64), 0)
                start = s - w.ptr[r]
                for x in zip(v[begin].tolist(), part.tolist(), a.tolist(), s.tolist(), length.tolist(), r.tolist(), start.tolist(), (cut > 1).tolist()):
                    held.add(x[0], x[1], x[2], w.text(x[3], x[3] + x[4] + window - 1), name[x[5]], x[6], x[7])
                if held.bytes > HELD:
                    yield from held.flush()
        yield from held.flush()

    return run


def _row_key(v: np.ndarray, row: np.ndarray) -> np.ndarray:
    return wordcore.mix(v + wordcore.mix(row.astype(np.uint64) + wordcore.U(1)))


def _row_keys(listed: pa.Array, cuts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of (row, anchor) for the lists of some rows, and the parts of each anchor."""
    sizes = np.diff(listed.offsets.to_numpy())
    keys = _row_key(listed.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(sizes)), sizes))
    order = np.argsort(keys)
    return keys[order], cuts.flatten().to_numpy()[order]


def _shards(window: int, marker: Marker):
    """Marks (key, start, mask) of the members of each shard's segments."""
    schema = pa.schema([("key", pa.binary()), ("start", pa.int32()), ("mask", pa.int64())])

    def marked(group: dict[bytes, list]) -> list[tuple[bytes, int]]:
        if len(group) == 1 and len(next(iter(group.values()))[2]) == MEMBER.itemsize:
            return []
        masks = marker([(words, anchor, len(members) // MEMBER.itemsize) for words, anchor, members in group.values()], window)
        return [(e[2], m - (1 << 64) if m >> 63 else m) for e, m in zip(group.values(), masks) if m]

    def batch(out: list[tuple[bytes, int]]) -> pa.RecordBatch:
        members = np.frombuffer(b"".join(x for x, _ in out), MEMBER)
        masks = np.repeat(np.array([m for _, m in out], np.int64), [len(x) // MEMBER.itemsize for x, _ in out])
        keys = pa.Array.from_buffers(pa.binary(16), len(members), [None, pa.py_buffer(np.ascontiguousarray(members["key"]).tobytes())]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([keys, pa.array(np.ascontiguousarray(members["start"])), pa.array(masks)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, group, now = [], 0, {}, None
        for b in batches:
            for v, part, sid, body, anchor, members in zip(*(c.to_pylist() for c in b.columns)):
                if part < 0:
                    out.append((members, 1))
                    size += len(members)
                    continue
                if (v, part) != now:
                    found = marked(group) if group else []
                    out += found
                    size += sum(len(x) for x, _ in found)
                    group, now = {}, (v, part)
                    if size > 1 << 20:
                        yield batch(out)
                        out, size = [], 0
                e = group.get(sid)
                if e is None:
                    group[sid] = [body.split(b" "), anchor, bytearray(members)]
                else:
                    e[2] += members
        if group:
            out += marked(group)
        if out:
            yield batch(out)

    return run


def recurring(counts: dict, segments: list[tuple[list[bytes], int, int]], window: int) -> list[tuple[int, int, int]]:
    """Runs (segment, from, to) of words that all occur twice or more in the shard, of window words at least.

    A window with a word that the shard holds once can't recur, so suffix structures need
    only these runs.
    """
    runs = []
    for i, (words, _, _) in enumerate(segments):
        lo = 0
        for j, x in enumerate(words):
            if counts[x] < 2:
                if j - lo >= window:
                    runs.append((i, lo, j))
                lo = j + 1
        if len(words) - lo >= window:
            runs.append((i, lo, len(words)))
    return runs


def word_counts(segments: list[tuple[list[bytes], int, int]]) -> dict[bytes, int]:
    """How often the rows of a shard hold each word."""
    counts: dict[bytes, int] = {}
    get = counts.get
    for words, _, n in segments:
        for x in words:
            counts[x] = get(x, 0) + n
    return counts


def marked_texts(rows: DataFrame, window: int, k: int, marker: Marker, shard: int = SHARD, all_texts: bool = False) -> DataFrame:
    """key, text, whole, marks of each text (a text of several rows at least once, all of them in one task).

    rows: from keyed(). marks is an array of (start, mask): bit i of mask says that the window at word
    start + i occurs elsewhere; whole says that more than one row has the text. Texts without either
    are returned only with all_texts.
    """
    ship(rows.sparkSession)
    rows = rows if all_texts else rows.where(F.octet_length("text") >= 2 * window - 1)
    texts = texts_of(rows)
    places = materialize(rows.select("key", "text").mapInArrow(wordcore.tidy(_selected(window, k)), "v bigint, key binary, c int"), "anchors")
    # Copies that tasks could not fold are one text: an anchor recurs if two texts, or two places of one, have it.
    counted = places.groupBy("v").agg(F.sum("c").alias("n"), F.max("c").alias("c"), F.min(F.xxhash64("key")).alias("lo"), F.max(F.xxhash64("key")).alias("hi"))
    # A place has at most window - k + 1 windows, each a segment where the anchor is split; small parts spread evenly.
    parts = F.when(F.col("n") > shard, F.ceil(4 * F.col("n") * (window - k + 1) / shard)).otherwise(1).cast("int")
    many = counted.where("n > 1 AND (c > 1 OR lo <> hi)").select(F.col("v").alias("w"), parts.alias("part"))
    there = places.select("v", "key").join(many, F.col("v") == F.col("w")).groupBy("key").agg(F.collect_list(F.struct("v", "part")).alias("known"))
    listed = materialize(there.select(F.col("key").alias("k1"), F.col("known.v").alias("vs"), F.col("known.part").alias("parts")), "known-anchors")
    release(places)
    dealt = texts.repartition("key")
    # Texts are streamed past the smaller side's hash table rather than sorted.
    found = dealt.join(listed.hint("shuffle_hash"), F.col("key") == F.col("k1")).select("key", "text", "vs", "parts")
    segments = found.mapInArrow(wordcore.tidy(_segments(window, k)), _SEGMENT)
    shards = segments.repartition("v", "part").sortWithinPartitions("v", "part")
    marks = shards.mapInArrow(wordcore.tidy(_shards(window, marker)), "key binary, start int, mask bigint").select("key", F.struct("start", "mask").alias("mark"), F.lit(False).alias("whole"))
    copies = rows.groupBy("key").count().where("count > 1").select("key", F.lit(None).cast("struct<start:int,mask:bigint>").alias("mark"), F.lit(True).alias("whole"))
    by_text = marks.unionByName(copies).groupBy(F.col("key").alias("k2")).agg(F.collect_list("mark").alias("marks"), F.max("whole").alias("whole"))
    joined = dealt.join(by_text.hint("shuffle_hash"), F.col("key") == F.col("k2"), "left" if all_texts else "inner")
    return joined.select("key", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "marks")


def covered(n_words: int, whole: bool, marks: list[dict] | None, window: int) -> np.ndarray:
    """Which words of a text lie in a recurring window."""
    if whole and n_words >= window:
        return np.ones(n_words, bool)
    edge = np.zeros(n_words + 1, np.int64)
    for m in marks or ():
        mask, s = m["mask"] & (2**64 - 1), m["start"]
        while mask:
            low = mask & -mask
            i = s + low.bit_length() - 1
            edge[i] += 1
            edge[i + window] -= 1
            mask ^= low
    return np.cumsum(edge[:-1]) > 0


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes, bool, list[dict] | None]]:
    """key, text, whole, marks of batches of marked_texts, each text once."""
    seen: set[bytes] = set()
    for b in batches:
        for row in zip(b.column(0).to_pylist(), wordcore.binary(b.column(1)), b.column(2).to_pylist(), b.column(3)):
            if row[0] not in seen:
                seen.add(row[0])
                yield row[0], row[1].as_py(), row[2], row[3].as_py()
