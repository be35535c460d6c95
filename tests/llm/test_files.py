"""Token-id files, hash trees and resampling against plain code."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestrand.llm import huffman, merkle, queries, resampling
from lodestrand.runtime import lifetime

PATH = public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"

# ---- token-id files ----


def plain_huffman_cost(counts):
    """Cost of codes without a limit, by merging the two least."""
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


def least_cost(counts, limit):
    """Least cost of limited lengths, over all non-decreasing sequences of lengths."""
    counts = sorted((c for c in counts if c), reverse=True)
    best = {(0, 0): 0}  # (symbols placed, codes taken in units of the longest) -> cost
    for c in counts:
        new = {}
        for (n, used), cost in best.items():
            for bits in range(1, limit + 1):
                key, to = (n + 1, used + 2 ** (limit - bits)), cost + c * bits
                if key[1] <= 2**limit and to < new.get(key, math.inf):
                    new[key] = to
        best = new
    return min(best.values())


def test_code_lengths_are_least():
    r = random.Random(4)
    for _ in range(60):
        counts = np.array([r.choice([0, 1, 2, 5, 50, 900]) for _ in range(r.randint(2, 9))])
        if (counts > 0).sum() < 2:
            continue
        for limit in (4, 5, 9):
            bits = huffman.code_lengths(counts, limit)
            assert ((bits > 0) == (counts > 0)).all() and bits.max() <= limit
            assert sum(2.0 ** -b for b in bits if b) == 1
            assert (bits * counts).sum() == least_cost(counts.tolist(), limit)
    many = np.array([r.randrange(1, 10**6) for _ in range(3000)])
    assert (huffman.code_lengths(many, 40) * many).sum() == plain_huffman_cost(many.tolist())
    assert huffman.code_lengths(many, 3).max() == 12
    assert huffman.code_lengths(np.array([0, 7])).tolist() == [0, 1] and huffman.code_lengths(np.zeros(3, int)).tolist() == [0, 0, 0]


def test_canonical_codes_are_prefix_free():
    bits = huffman.code_lengths(np.array([9, 1, 1, 4, 0, 30]), 8)
    symbols, codes = huffman.canonical(bits)
    text = [format(c, f"0{bits[s]}b") for s, c in zip(symbols, codes)]
    assert text == sorted(text) and [(bits[s], s) for s in symbols] == sorted((bits[s], s) for s in symbols)
    assert not any(a != b and b.startswith(a) for a in text for b in text)


def test_blocks_decode_from_any_checkpoint():
    r = np.random.default_rng(3)
    for top in (1, 2, 3000):
        ids = np.minimum(r.geometric(0.01, 5000), top) - 1
        bits = huffman.code_lengths(np.bincount(ids), 14)
        coder = huffman.Coder(np.flatnonzero(bits), bits[bits > 0])
        checkpoints, payload = coder.encode(ids.astype("<u2"))
        want = "".join(format(int(coder.codes[i]), f"0{coder.bits[i]}b") for i in ids)
        assert payload == int(want.ljust(-(-len(want) // 8) * 8, "0"), 2).to_bytes(-(-len(want) // 8), "big")
        starts = np.frombuffer(checkpoints, "<u4")
        assert len(starts) == -(-len(ids) // huffman.RUN)
        for k in range(0, len(starts), 7):
            assert (coder.decode([payload], [starts[k : k + 1]], huffman.RUN)[: len(ids) - k * huffman.RUN, 0] == ids[k * huffman.RUN : (k + 1) * huffman.RUN]).all()


def test_checksums_of_pieces_add_up():
    data = bytes(random.Random(1).randrange(256) for _ in range(999))
    for a, b in ((0, 10), (500, 501), (999, 999), (3, 700)):
        parts = (data[:a], data[a:b], data[b:])
        assert huffman.shifted(zlib.crc32(parts[0]), 999 - a) ^ huffman.shifted(zlib.crc32(parts[1]), 999 - b) ^ zlib.crc32(parts[2]) == zlib.crc32(data)


def test_id_files_equal_the_library(spark, docs, odd, monkeypatch, tmp_path):
    library = Tokenizer.from_file(PATH)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, (_, t) in enumerate(odd)] + [(9_999_999, "<|endoftext|> a  b \n\n c" + " " * 300 + "é" * 5), (-5, "below zero"), (None, "no id")]
    rows.append((20_000, " ".join(str(i) for i in range(90_000))))  # longer than a block
    texts = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in texts]
    at = np.cumsum([0, *map(len, ids)])
    want = [(d, int(a), len(x), zlib.crc32(x.tobytes())) for (d, _), a, x in zip(texts, at, ids)]
    with lifetime(spark):
        got = huffman.round_trip(docs(rows, 5), PATH)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    folder = str(tmp_path / "ids")
    huffman.write(docs(rows, 4), PATH, folder)
    every = np.concatenate(ids)
    for lo, hi in ((0, 1), (100, 5000), (int(at[-4]) - 70_000, int(at[-4]) + 10), (len(every) - 3, len(every) + 50)):
        pieces = sorted(huffman.id_range(spark, folder, lo, hi).collect())
        assert pieces[0].start == lo and np.array_equal(np.concatenate([p.ids for p in pieces]), every[lo:hi])
    book = spark.read.parquet(f"{folder}/codebook").collect()
    assert {r.id for r in book} == set(every.tolist()) and max(r.bits for r in book) <= huffman.MAX_BITS


def test_id_files_of_repeated_rows_and_of_none(spark, docs):
    rows = [(3, "b b"), (3, "b b"), (3, "a"), (1, None), (1, "")] * 2
    with lifetime(spark):
        got = sorted(huffman.round_trip(docs(rows), PATH).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == [1] * 4 + [3] * 6 and sum(r.n_tokens for r in got) == 4 + 3 * 4 + 2 * 2
        assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
        clash = docs([(1, "x")]).selectExpr("*", "1 AS ids", "2 AS counts", "3 AS content")
        assert huffman.round_trip(clash, PATH).count() == 1
        assert huffman.round_trip(docs([]), PATH).count() == 0


# ---- hash trees ----


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def coded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(nodes, fan_out):
    """(root, path of each node) level by level."""
    paths, owners, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        above, of = [], []
        for i in range(0, len(level), fan_out):
            run = level[i : i + fan_out]
            for j in range(len(run)):
                for leaf in owners[i + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(h(*run))
            of.append(sum(owners[i : i + fan_out], []))
        level, owners = above, of
    return level[0], paths


def plain_manifest(rows, fan_out=2):
    leaf = lambda r, more=0: h(*map(coded, (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)))
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    trees = []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(groups[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees.append((own, *plain_tree([leaf(r) for r in own], fan_out)))
    root, tops = plain_tree([t[1] for t in trees], fan_out)
    out = []
    for (own, sub, paths), top in zip(trees, tops):
        for r, path in zip(own, paths):
            acc = leaf(r, int(zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 0))
            for before, after in path + top:
                acc = h(before, acc, after)
            out.append((r.doc_id, leaf(r), sub, root, h(*[b + a for b, a in path + top]), acc, acc == root))
    return sorted(out, key=repr)


def test_manifest_query_equals_plain_trees(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert sorted(map(tuple, queries.op12_merkle(spark, FOLDER).collect()), key=repr) == plain_manifest(rows)


@pytest.mark.parametrize(("fan_out", "block"), [(2, 2), (2, 4), (3, 9), (4, 1024)])
def test_manifest_of_odd_rows(spark, docs, odd, fan_out, block):
    """Small blocks, so that trees have several heights; nulls, repeated rows and ids, clashing names."""
    rows = [(i, f"t{i}", None if i % 5 == 0 else f"l{i % 3}") for i in range(40)] + [(i, t, "ö" if i else None) for i, t in odd] + [(7, "another of that id", "l1")] * 2
    table = docs(rows).selectExpr("*", "1 AS leaf_", "'x' AS path", "2 AS pos", "'y' AS ROOT")
    bad = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 0
    with lifetime(spark):
        got = merkle.audited(table, bad, ("n_chars", (F.col("n_chars") + 1).cast("string")), fan_out=fan_out, block=block)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(table.collect(), fan_out)
        whole = merkle.manifest(table, F.col("lang"), F.col("doc_id"), merkle.leaf(F.col("text")), fan_out, block)
        assert whole.columns == ["doc_id", "text", "lang", "source", "n_chars", "leaf_", "pos", "leaf", "subroot", "root", "path"] and whole.count() == len(rows)
        assert merkle.audited(docs([]), F.lit(True), ("n_chars", F.lit("1"))).count() == 0
        assert merkle.audited(docs([(2**62, "one", "x")]), F.lit(False), ("n_chars", F.lit("1"))).first().verified


# ---- resampling ----

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_draw(rows, targets):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    found = [(d, *features(t)) for d, t in rows]
    s, t = Counter(bucket(f) for _, _, fs in found for f in fs), Counter(bucket(f) for x in targets for f in features(x)[1])
    sa, ta = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sa + 10_000) / ((s[b] + 1) * (ta + 10_000))))
    out = []
    for d, n, fs in found:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        u = (int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None, n])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, -r[1], -r[2]))
    for i, r in enumerate(fit[: 25 * len(fit) // 100]):
        r[4] = i + 1
    return sorted([tuple(r[:5]) for r in out], key=repr)


def test_resampling_query_equals_plain_code(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    targets = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op13_resampling(spark, FOLDER).collect()), key=repr) == plain_draw(rows, targets)


def test_resampling_of_odd_rows(spark, docs, odd, monkeypatch):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcXYZ019éß日") for _ in range(r.choice([1, 3, 9, 200])))
    rows = odd + [(20 + i, " ".join(word() for _ in range(r.randrange(60)))) for i in range(60)] + [(90, "a b c " * 9)] * 3
    targets = ["one word here", None, "", "a b c", "é日 é日"]
    table = docs(rows).selectExpr("*", "1 AS rank", "2 AS weight", "3 AS n_words")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id int, text string")
    want = plain_draw(rows, targets)
    with lifetime(spark):
        for piece in (1 << 20, 64):  # long texts in many parts
            monkeypatch.setattr(resampling, "PIECE", piece)
            assert sorted(map(tuple, resampling.resample(table, bench).collect()), key=repr) == want
        assert resampling.resample(docs([]), bench).count() == 0
        alone = resampling.resample(docs([(1, "a b " * 30)]), bench.where("false"), percent=100)
        assert [x.rank for x in alone.collect()] == [1]


def test_parts_of_a_long_text_give_the_same_features():
    import pyarrow as pa

    r = random.Random(8)
    text = "".join(r.choice("ab Zé9.\n-") for _ in range(3000)) + "x" * 500 + " end"
    texts = pa.array(["one two", text, None, "", text + "q"], pa.large_string()).fill_null("").cast(pa.large_binary())
    def found(piece):
        resampling.PIECE, old = piece, resampling.PIECE
        try:
            out = Counter()
            for lo, _, of, b, _ in resampling.buckets(texts, 10_000):
                out.update(zip((lo + of).tolist(), b.tolist()))
            return out
        finally:
            resampling.PIECE = old
    want = Counter((i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(["one two", text, "", "", text + "q"]) for f in features(t)[1])
    assert found(1 << 20) == found(40) == found(7) == want
