"""Token ids of a corpus in compact files: canonical length-limited Huffman codes in independent blocks.

Files of a folder, all Parquet, so that Spark commits them and any store can hold them:

* `codebook`: id, bits. One row for each id that occurs; codes are canonical, that is given
  out in order of (bits, id), so the lengths alone tell them.
* `blocks`: part, first, n_ids, docs, checkpoints, payload. Parts follow each other in order of
  document ids and lie in a file each; `first` counts the ids of the part before the block.
  docs lists the pieces of documents in the block (doc_id, n, before and after it in its
  document). The payload is the codes, most significant bit first; checkpoints are unsigned
  32-bit bit offsets of every RUN-th id in it, little-endian.

A block is decoded without any other, and from any checkpoint. Decoding looks up the next
max_bits bits of a run in one table, which gives the id and how many bits to go on; all runs
of several blocks take their steps together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.llm import wordcore
from lodestrand.llm.packing import encoder
from lodestrand.operators.bm25 import small
from lodestrand.runtime import lifetime, materialize, ship, work_path

#: Ids from one checkpoint to the next, ids from which a block is closed, and ids decoded together.
RUN, BLOCK_IDS, GROUP_IDS = 128, 1 << 16, 1 << 20
#: Longest code, where the number of different ids allows it.
MAX_BITS = 18


# ---- codes ----


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol's code, at most max_bits, with the least sum of count * bits (package-merge); 0 where the count is.

    max_bits is raised to what the number of symbols needs.
    """
    bits = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        bits[used] = 1
        return bits
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    n, limit = len(used), max(max_bits, int(len(used) - 1).bit_length())
    merged, kinds = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        kinds.append(order < n)
    take = 2 * n - 2
    for is_leaf in reversed(kinds):
        chosen = int(is_leaf[:take].sum())
        bits[used[:chosen]] += 1
        take = 2 * (take - chosen)
    return bits


def canonical(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with a code in order of (bits, symbol), and their codes."""
    symbols = np.flatnonzero(bits)
    symbols = symbols[np.argsort(bits[symbols], kind="stable")]
    lengths = bits[symbols]
    longest = int(lengths[-1]) if len(lengths) else 0
    spans = np.int64(1) << (longest - lengths)  # of the codes, as ranges of the longest
    starts = np.cumsum(spans) - spans
    return symbols, starts >> (longest - lengths)


class Coder:
    """Codes of a codebook (ids and their bits), and the table that reads them."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        lengths = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
        lengths[ids] = bits
        symbols, codes = canonical(lengths)
        self.bits = lengths.astype(np.uint8)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[symbols] = codes.astype(np.uint64)
        self.longest = int(lengths.max())
        if self.longest > 24:
            raise ValueError("codes of more than 24 bits: too many different ids")
        entries = symbols.astype(np.uint32) << np.uint32(5) | lengths[symbols].astype(np.uint32)
        table = np.repeat(entries, 1 << (self.longest - lengths[symbols]))
        # One symbol alone leaves half of the table without a code.
        self.table = np.concatenate([table, np.full((1 << self.longest) - len(table), table[0] if len(table) else 0, np.uint32)])

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(checkpoints, payload) of a block's ids."""
        lengths = self.bits[ids].astype(np.int64)
        ends = np.cumsum(lengths)
        at = ends - lengths
        # Each code within the 64 bits from its 32-bit word; codes are shorter than a word, so every word begins one.
        wide = self.codes[ids] << (64 - lengths - (at & 31)).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words = np.zeros(len(first) + 1, np.uint64)
        words[:-1] = np.add.reduceat(wide >> np.uint64(32), first)
        words[1:] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
        return at[::RUN].astype("<u4").tobytes(), words.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8]

    def decode(self, payloads: list[bytes], starts: list[np.ndarray], n_steps: int) -> np.ndarray:
        """Symbols by step and run; starts are the bit offsets of each payload's runs. Runs that end before n_steps go on with what follows."""
        sizes = np.array([len(p) for p in payloads])
        base = np.repeat((np.cumsum(sizes) - sizes) * 8, [len(s) for s in starts])
        at = np.concatenate(starts).astype(np.int64) + base
        buf = np.frombuffer(b"".join(payloads) + bytes(n_steps * self.longest // 8 + 8), np.uint8).astype(np.uint32)
        window = buf[:-3] << np.uint32(24) | buf[1:-2] << np.uint32(16) | buf[2:-1] << np.uint32(8) | buf[3:]
        out = np.empty((n_steps, len(at)), np.uint32)
        drop, five, low = np.uint32(32 - self.longest), np.uint32(5), np.uint32(31)
        for step in range(n_steps):
            found = self.table[(window[at >> 3] << (at & 7).astype(np.uint32)) >> drop]
            np.right_shift(found, five, out=out[step])
            at += found & low
        return out


# ---- checksums of pieces ----


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, bits reflected."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        b = b << 1 & 0xFFFFFFFF
        a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
    return out


def shifted(crc: int, n_bytes: int) -> int:
    """What a checksum adds to that of a text that goes on for n_bytes after it; the sum of all pieces' is the whole's."""
    power, square = 0x80000000, 0x00800000  # 1, and x to the 8th
    while n_bytes:
        if n_bytes & 1:
            power = _times(power, square)
        square, n_bytes = _times(square, square), n_bytes >> 1
    return _times(crc, power)


# ---- writing ----

_TOKENS = "doc_id bigint, ids binary, counts binary"
_TOKEN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
_PIECES = pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("before", pa.int64()), ("after", pa.int64())]))
_BLOCKS = "part int, first bigint, n_ids bigint, docs array<struct<doc_id: bigint, n: bigint, before: bigint, after: bigint>>, checkpoints binary, payload binary"
_BLOCK_SCHEMA = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("docs", _PIECES), ("checkpoints", pa.binary()), ("payload", pa.binary())])


def _tokenizer(path: str, n_ids: int, end_id: int):
    """Documents as ids, two bytes each where that is enough, and at a task's end a row with how often it met each id."""
    kind = "<u2" if n_ids <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, counts = encoder(path), np.zeros(n_ids, np.int64)
        end = np.array([end_id], "<u4").tobytes()

        ids, texts, held = [], [], 0

        def batch() -> pa.RecordBatch:
            nonlocal ids, texts, held, counts
            counts += np.bincount(np.concatenate(texts), minlength=n_ids)
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in texts], pa.binary()), pa.nulls(len(ids), pa.binary())], schema=_TOKEN_SCHEMA)
            ids, texts, held = [], [], 0
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0), wordcore.binary(b.column(1))):
                ids.append(doc_id.as_py())
                texts.append(np.frombuffer(enc.encode(text.as_py().decode()) + end, "<u4").astype(kind))
                held += len(texts[-1])
                if held > 2 << 20:
                    yield batch()
        if ids:
            yield batch()
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], schema=_TOKEN_SCHEMA)

    return run


def _writer(book, kind: str):
    """Blocks of a part's documents, which come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = Coder(*book.value), TaskContext.get().partitionId()
        pieces: list[tuple[int | None, int, int, int]] = []
        texts: list[np.ndarray] = []
        first, held, done = 0, 0, []

        def close() -> None:
            nonlocal pieces, texts, first, held
            docs = [dict(zip(("doc_id", "n", "before", "after"), p)) for p in pieces]
            done.append((part, first, held, docs, *coder.encode(np.concatenate(texts))))
            pieces, texts, first, held = [], [], first + held, 0

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _BLOCK_SCHEMA)], schema=_BLOCK_SCHEMA)
            done.clear()
            return out

        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(raw.as_buffer(), kind)
                if held and len(ids) > BLOCK_IDS:
                    close()
                for at in range(0, len(ids), BLOCK_IDS):
                    x = ids[at : at + BLOCK_IDS]
                    pieces.append((doc_id, len(x), at, len(ids) - at - len(x)))
                    texts.append(x)
                    held += len(x)
                    if held >= BLOCK_IDS:
                        close()
                if len(done) >= 32:
                    yield flushed()
        if held:
            close()
        if done:
            yield flushed()

    return run


def write(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, max_bits: int = MAX_BITS) -> None:
    """Write the ids of all documents, each with end_id after it, in ascending order of document ids.

    Null text is the empty one, so every row gives an id at least. A null id comes first;
    repeated ids are ordered by their documents' ids and all are written. Other columns are
    not read. An empty table gives a folder without blocks.
    """
    spark = docs.sparkSession
    ship(spark)
    vocabulary = encoder(tokenizer_path).whole.get_vocab_size(with_added_tokens=True)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    with lifetime(spark):
        slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        tokens = materialize(slim.mapInArrow(wordcore.tidy(_tokenizer(tokenizer_path, vocabulary, end_id)), _TOKENS), "tokens", "zstd")
        zero = np.zeros(vocabulary, np.int64)
        counts = tokens.where("counts IS NOT NULL").select("counts").rdd.map(lambda r: np.frombuffer(r[0], np.int64)).treeAggregate(zero, lambda a, b: a + b, lambda a, b: a + b)
        bits = code_lengths(counts, max_bits)
        ids = np.flatnonzero(bits)
        spark.createDataFrame([(int(i), int(bits[i])) for i in ids], "id int, bits int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/codebook")
        book = spark.sparkContext.broadcast((ids, bits[ids]))  # a row for each id of the vocabulary at most
        # Equal ids are told apart by content, and equal rows, which may be many, by where they lie.
        rows = tokens.where("counts IS NULL").select("doc_id", "ids", F.xxhash64("ids").alias("content"), F.monotonically_increasing_id().alias("read"))
        order = ("doc_id", "content", "read")
        dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
        dealt.mapInArrow(wordcore.tidy(_writer(book, kind)), _BLOCKS).write.mode("overwrite").parquet(f"{folder}/blocks")
        book.destroy()


# ---- reading ----


def _book(spark: SparkSession, folder: str):
    """The codebook, broadcast: a row for each id of the vocabulary at most."""
    rows = spark.read.parquet(f"{folder}/codebook").toPandas()
    return spark.sparkContext.broadcast((rows["id"].to_numpy(np.int64), rows["bits"].to_numpy(np.int64)))


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks with `start`, the ids of all blocks before them; a row for each part is what gives it."""
    found = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    sizes = found.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("offset"))
    return found.join(small(offsets), F.col("part") == F.col("p")).select("*", (F.col("offset") + F.col("first")).alias("start")).drop("p", "offset")


def _decoded(coder: Coder, checkpoints: pa.Array, payloads: pa.Array, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of whole blocks; as many at a time as hold about GROUP_IDS ids."""
    lo, n = 0, len(sizes)
    while lo < n:
        hi, held = lo, 0
        while hi < n and (hi == lo or held + sizes[hi] <= GROUP_IDS):
            held += sizes[hi]
            hi += 1
        starts = [np.frombuffer(checkpoints[i].as_buffer(), "<u4") for i in range(lo, hi)]
        steps = coder.decode([payloads[i].as_py() for i in range(lo, hi)], starts, RUN)
        at = 0
        for i, s in zip(range(lo, hi), starts):
            yield i, np.ascontiguousarray(steps[:, at : at + len(s)].T).reshape(-1)[: sizes[i]]
            at += len(s)
        lo = hi


_DIGEST = "part int, doc_id bigint, at bigint, n bigint, before bigint, after bigint, crc bigint"
_DIGEST_SCHEMA = pa.schema([("part", pa.int32()), *[(c, pa.int64()) for c in ("doc_id", "at", "n", "before", "after", "crc")]])


def _digester(book):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*book.value)
        for b in batches:
            part, start, docs = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()
            rows = []
            for i, ids in _decoded(coder, b.column(4), b.column(5), b.column(2).to_pylist()):
                ids, at = ids.astype("<u4", copy=False), 0
                for d in docs[i]:
                    crc = zlib.crc32(ids[at : at + d["n"]])
                    rows.append((part[i], d["doc_id"], start[i] + at, d["n"], d["before"], d["after"], shifted(crc, 4 * d["after"]) if d["after"] else crc))
                    at += d["n"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DIGEST_SCHEMA)], schema=_DIGEST_SCHEMA)

    return run


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of a folder as its files have it: doc_id, start (ids before it), n_tokens, ids_crc32.

    Documents longer than a block lie in several; their pieces' checksums add up. An empty
    folder gives no rows.
    """
    ship(spark)
    columns = ("part", "start", "n_ids", "docs", "checkpoints", "payload")
    found = blocks(spark, folder).select(*columns).mapInArrow(wordcore.tidy(_digester(_book(spark, folder))), _DIGEST)
    found = materialize(found, "token-documents")  # read twice below
    whole = found.where("before = 0 AND after = 0").select("doc_id", F.col("at").alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut = found.where("before > 0 OR after > 0").groupBy(F.col("doc_id"), (F.col("at") - F.col("before")).alias("start")).agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return whole.unionByName(cut)


_RANGE = "start bigint, ids array<int>"


def _ranger(book, start: int, stop: int):
    schema = pa.schema([("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*book.value)
        for b in batches:
            for begin, n, checkpoints, payload in zip(*(c.to_pylist() for c in b.columns)):
                lo, hi = max(start - begin, 0), min(stop - begin, n)
                if lo >= hi:
                    continue
                run_of = lo // RUN
                at = np.frombuffer(checkpoints, "<u4")[run_of : (hi - 1) // RUN + 1]
                ids = coder.decode([payload], [at], RUN).T.reshape(-1)[lo - run_of * RUN : hi - run_of * RUN]
                yield pa.RecordBatch.from_arrays([pa.array([begin + lo], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], schema=schema)

    return run


def id_range(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """Ids number start to stop - 1 of all, as pieces in blocks (start, ids); only the runs that hold them are decoded."""
    ship(spark)
    near = blocks(spark, folder).where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    return near.select("start", "n_ids", "checkpoints", "payload").mapInArrow(wordcore.tidy(_ranger(_book(spark, folder), start, stop)), _RANGE)


def round_trip(docs: DataFrame, tokenizer_path: str, **how) -> DataFrame:
    """documents() of a folder written for the purpose, which goes once its documents are read."""
    spark = docs.sparkSession
    with lifetime(spark) as keep:
        folder = work_path(spark, "token-ids")
        write(docs, tokenizer_path, folder, **how)
        found = materialize(documents(spark, folder), "token-index")
        keep(found)
    return found
