import hashlib
import os
import random
from collections import Counter

import pytest

from lodestrand.llm import exact, minhash, repeats, substring, suffixes
from lodestrand.llm.components import connected_components


def corpus(seed=1, n=60):
    """Texts with shared passages, whole copies, near copies and repeats within a text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    shared = [[word() for _ in range(r.randint(30, 90))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.randint(0, 120))]
        if r.random() < 0.5:
            at = r.randint(0, len(words))
            words[at:at] = r.choice(shared)
        if r.random() < 0.1:
            words += words[-60:]
        if r.random() < 0.05:
            words += ["la"] * 80
        rows.append((i, " ".join(words)))
    for i in range(n, n + 20):
        text = r.choice(rows)[1]
        words = text.split()
        if words and r.random() < 0.6:
            for _ in range(max(1, len(words) // 30)):
                words[r.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    return rows


# ---- exact ----


def test_exact_matches_brute_force(docs, odd):
    rows = corpus() + [(100 + (i or 0), t) for i, t in odd] + odd
    for budget in (48 << 20, 3000):
        got = exact.exact_dedup(docs(rows), task_bytes=budget).collect()
        groups = Counter(t or "" for _, t in rows)
        top = {}
        for i, t in rows:
            top[t or ""] = max(top.get(t or "", -1), -1 if i is None else i)
        assert len(got) == len(rows)
        for x in got:
            t = x.text or ""
            best = None if top[t] < 0 else top[t]
            assert (x.group_size, x.keep_id, x.kept) == (groups[t], best, x.doc_id == best)
            assert x.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_grace_spills_recursively_and_cleans_up(tmp_path):
    rows = [(hashlib.sha256(t := str(i % 700).encode() * 20).digest(), t, i, 1, None) for i in range(3000)]
    got = list(exact.grace(iter(rows), 4000, str(tmp_path)))
    assert {(c, n) for _, c, _, n, _ in got} == {(str(i).encode() * 20, len(range(i, 3000, 700))) for i in range(700)}
    assert os.listdir(tmp_path) == []


def test_open_table_compares_contents_not_digests():
    t = exact.OpenTable()
    assert t.add(b"d" * 32, b"a", 1, 1, "x") and t.add(b"d" * 32, b"b", 2, 1, "y") and not t.add(b"d" * 32, b"a", 5, 1, "z")
    assert not t.add(b"d" * 32, b"b", None, 1, "a") and not t.add(b"d" * 32, b"b", 2, 3, "w") and not t.add(b"d" * 32, b"b", 2, 1, "x")
    assert [e[1:] for e in t.entries] == [[b"a", 5, 2, "z"], [b"b", 2, 6, "w"]]


def test_exact_with_clashing_columns_and_empty_table(spark, docs):
    d = docs([(1, "a"), (2, "a")]).selectExpr("*", "1 AS keep_id", "'x' AS kept", "5 AS digest")
    assert sorted((r.doc_id, r.keep_id, r.digest) for r in exact.exact_dedup(d).collect()) == [(1, 2, 5), (2, 2, 5)]
    d = docs([(1, "a"), (2, "a"), (2, "a"), (None, "b"), (None, "b")]).selectExpr("*", "7 AS __n", "8 AS __sha", "9 AS __top", "'y' AS KEPT", "1.5 AS `a.b`")
    got = exact.exact_dedup(d)
    assert sorted((r.doc_id or 0, r.keep_id or 0, r["__n"], r.kept) for r in got.collect()) == [(0, 0, 7, True), (0, 0, 7, True), (1, 2, 7, False), (2, 2, 7, True), (2, 2, 7, True)]
    typed = d.selectExpr("*", "array(1, null) AS list", "map('k', doc_id) AS m", "timestamp'2024-01-02 03:04:05' AS ts", "cast(1.25 AS decimal(10, 2)) AS dec", "struct(text AS t) AS s")
    assert sorted(map(repr, exact.unlike_rows(typed).collect())) == sorted({repr(r) for r in typed.where("doc_id = 2 OR doc_id IS NULL").collect()})
    once = exact.unlike_rows(d)
    assert once.columns == d.columns and sorted((r.doc_id or 0, r.text, r.KEPT, r["a.b"]) for r in once.collect()) == [(0, "b", "y", 1.5), (2, "a", "y", 1.5)]
    assert exact.exact_dedup(docs([])).count() == 0 and exact.unlike_rows(docs([])).count() == 0


def test_unlike_rows_keeps_what_shares_only_an_id(docs, odd):
    rows = [(3, "A"), (7, "A"), (7, "B"), (None, "A"), (7, "A"), (5, ""), (6, None), *odd]
    got = [(r.doc_id, r.text or "") for r in exact.unlike_rows(docs(rows)).collect()]
    want = {}
    for i, t in rows:
        want[t or ""] = max(want.get(t or "", -1), -1 if i is None else i)
    assert Counter((-1 if i is None else i, t) for i, t in got) == Counter((i, t) for t, i in want.items())


# ---- repeated windows ----


def covered_words(rows, window):
    count = Counter()
    for _, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            count[tuple(w[i : i + window])] += 1
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, w, gone))
    return out


@pytest.mark.parametrize("shard", [repeats.SHARD, 2])
def test_substring_matches_brute_force(docs, odd, shard):
    rows = corpus(2) + odd
    got = substring.substring_dedup(docs(rows), shard=shard).collect()
    want = [(d, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest()) for d, w, g in covered_words(rows, 35)]
    assert Counter(map(tuple, got)) == Counter(want)


@pytest.mark.parametrize("shard", [repeats.SHARD, 2])
def test_suffix_spans_match_brute_force(docs, odd, shard):
    rows = corpus(3) + odd
    got = suffixes.repeated_spans(docs(rows), shard=shard).collect()
    want = Counter()
    for d, w, g in covered_words(rows, 50):
        lo = None
        for i, h in enumerate([*g, False]):
            if h and lo is None:
                lo = i
            elif not h and lo is not None:
                want[d, lo, i - lo, len(w)] += 1
                lo = None
    assert Counter((r.doc_id, r.start_word, r.span_words, r.doc_words) for r in got) == want


def test_repeats_of_empty_tables(docs):
    assert substring.substring_dedup(docs([])).count() == 0
    assert suffixes.repeated_spans(docs([])).count() == 0


@pytest.mark.parametrize("marker", [substring.automaton_marks, suffixes.suffix_marks])
def test_markers_on_random_shards(marker):
    """Segments as routing makes them: distinct, windows with one anchor, which equal windows have at the same place."""
    r = random.Random(7)
    for _ in range(400):
        window, k = r.choice([(4, 2), (6, 2), (5, 3)])
        rank = {}
        shards = {}
        for _ in range(r.randint(1, 8)):
            words = [r.choice([b"a", b"b", b"c"]) for _ in range(window + r.randint(0, 12))]
            run = [rank.setdefault(tuple(words[i : i + k]), r.random()) for i in range(len(words) - k + 1)]
            anchors = [min(range(i, i + window - k + 1), key=lambda p: (run[p], p)) for i in range(len(words) - window + 1)]
            for p in sorted(set(anchors)):
                at = [i for i, x in enumerate(anchors) if x == p]
                segment = (tuple(words[at[0] : at[-1] + window]), p - at[0])
                shard = shards.setdefault(run[p], {})
                shard[segment] = shard.get(segment, 0) + 1
        for shard in shards.values():
            segments = [(list(words), a, n) for (words, a), n in shard.items()]
            count = Counter()
            for words, _, n in segments:
                for i in range(len(words) - window + 1):
                    count[tuple(words[i : i + window])] += n
            want = [sum(1 << i for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1) for w, _, _ in segments]
            assert marker(segments, window) == want


def test_repeats_with_other_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", 0, 1), (1, text, "b", 0, 1), (None, text + " more", "c", 0, 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, key string, marks int, n_words int")
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.substring_dedup(d).collect()) == [(0, 61, 60), (1, 60, 60), (1, 60, 60)]
    assert sorted((r.doc_id or 0, r.start_word, r.span_words) for r in suffixes.repeated_spans(d).collect()) == [(0, 0, 60), (1, 0, 60), (1, 0, 60)]


def test_automaton_counts_and_streams():
    sam = substring.SuffixAutomaton()
    for text, n in (("abcabx", 1), ("zabc", 2)):
        sam.add(text, n)
    sam.finish()
    assert dict(sam.stream("qabcz", 2)) == {2: 4, 3: 3}  # ab twice and twice, bc once and twice
    assert list(sam.stream("qq", 1)) == []


# ---- near duplicates ----


def brute_components(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("words,block", [(2, minhash.BLOCK), (2, 2), (5, minhash.BLOCK)])
def test_near_duplicates_match_brute_force(docs, odd, words, block):
    rows = corpus(4) + odd
    got = minhash.near_duplicates(docs(rows), words=words, block=block).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, words, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_stay_small_where_nothing_is_linked(spark):
    rows = [(b"k", f"{i:02}".encode(), 1, hashlib.sha512(b"%d" % i).digest() + bytes(32), f"{i:08}".encode()) for i in range(30)]
    table = spark.createDataFrame(rows, "key binary, set_id binary, n bigint, sig binary, body binary")
    spread, links, _ = minhash.dealt(table, 80, 0.15, 5, "test")
    blocks = {}
    for x in spread.collect():
        blocks.setdefault(x.block, set()).add(bytes(x.set_id))
    assert links.count() == 0 and max(map(len, blocks.values())) < 25
    pairs = {(a, b) for members in blocks.values() for a in members for b in members if a < b}
    assert len(pairs) == 30 * 29 // 2


def test_no_link_of_the_table_is_lost(spark):
    """All pairs of the table at hand, by five and by two words."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    for words in (2, 5):
        got = minhash.near_duplicates(table, words=words).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, words, 80)


def test_near_duplicates_with_other_columns_and_extreme_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    ids = [2**63 - 1, -(2**63), None, None, 5, 5]
    texts = [text, text + " x", text, "alone here", "two copies of it", "two copies of it"]
    rows = [(i, t, "a", "b", 1) for i, t in zip(ids, texts)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, set_id string, label string, component_id int")
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(d).collect()]
    low = -(2**63)
    assert sorted(got, key=repr) == sorted([(2**63 - 1, low, False), (low, low, True), (None, low, False), (None, None, True), (5, 5, True), (5, 5, True)], key=repr)


def test_unlike_rows_keeps_one_of_each_group(spark, docs):
    words = [f"w{i}" for i in range(60)]
    a, a2, b = " ".join(words), " ".join([*words[:-1], "x"]), "quite another text that is like no other at all here"
    rows = [(7, a), (7, b), (3, a2), (3, a2), (None, a + " y"), (9, None), (9, ""), (9, ""), (4, b + " z"), (4, b.upper() + " z")]
    d = docs(rows).selectExpr("*", "1 AS __gone", "2 AS __set", "'k' AS kept", "'c' AS component", "'f' AS first")
    got = minhash.unlike_rows(d)
    assert got.columns == d.columns
    left = Counter((r.doc_id, r.text) for r in got.collect())
    # b with id 7 stays apart from a with id 7; b + z differs in one of 8 shingles more: 6 of 7, linked.
    assert left[(3, a2)] == 1 and left[(7, a)] == left[(None, a + " y")] == 0
    assert left[(9, None)] == 1 and left[(9, "")] == 2
    assert sum(n for (_, t), n in left.items() if t and t.lower().startswith("quite")) == 1
    assert sum(left.values()) == 5
    assert minhash.unlike_rows(docs([])).count() == 0


def test_near_duplicates_of_an_empty_table(docs):
    assert minhash.near_duplicates(docs([])).count() == 0


def test_estimates_are_near_the_truth():
    import numpy as np

    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 1200, dtype=np.uint64)
    errors = []
    for share in (100, 400, 800, 1000):
        a, b = np.unique(base[:1000]), np.unique(base[1000 - share : 2000 - share])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sig = minhash.pack(minhash.signatures([a, b]))
        words = np.ascontiguousarray(sig).view(np.uint64)
        errors.append(abs(float(minhash.estimate(minhash.agreeing(words[0], words[1:]))[0]) - true))
    assert max(errors) < 0.15


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(24)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame([(f"{a:04}", f"{b:04}") for a, b in path + star + [(500, 500)]], "u string, v string")
    few = edges.where("u < '0006' OR u >= '0100'")
    hubs = {r.node: r.label for r in connected_components(few, degree=4).collect()}
    assert hubs == {f"{i:04}": "0000" for i in range(7)} | {f"{i:04}": "0100" for i in range(100, 160)}
    got = {r.node: r.label for r in connected_components(edges).collect()}
    assert got == {f"{i:04}": "0000" for i in range(25)} | {f"{i:04}": "0100" for i in range(100, 160)}


def test_one_window_of_many_texts_is_settled_where_it_lies():
    """A shard gets two places of a window from each task at most; the others are marked and dealt evenly."""
    held = repeats._Held()
    for i in range(50_000):
        held.add(5, 3, 0, b"same words", hashlib.md5(str(i).encode()).digest(), 7, True)
    held.add(5, 3, 0, b"other words", b"k" * 16, 9, True)
    held.add(6, 0, 1, b"a longer segment", b"j" * 16, 2, False)
    held.add(6, 0, 1, b"a longer segment", b"i" * 16, 4, False)
    held.add(6, 0, 1, b"a longer segment", b"h" * 16, 6, False)
    rows = [r for b in held.flush() for r in b.to_pylist()]
    size = repeats.MEMBER.itemsize
    shard = {r["body"]: len(r["members"]) // size for r in rows if r["part"] >= 0}
    assert shard == {b"same words": 2, b"other words": 1, b"a longer segment": 3}
    rest = [r for r in rows if r["part"] < 0]
    assert sum(len(r["members"]) // size for r in rest) == 49_998 and max(len(r["members"]) // size for r in rest) <= repeats.SETTLED
    assert len({r["v"] for r in rest}) == len(rest)


def test_a_window_shared_by_many_texts(spark, docs):
    """One licence line in 3,000 different texts, with anchors split from 100 places on."""
    line = " ".join(f"lic{i}" for i in range(40))
    rows = [(i, f"head{i} a{i} b{i} {line} tail{i} c{i}") for i in range(3_000)] + [(9_000, " ".join(f"u{i}" for i in range(60)))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.substring_dedup(docs(rows, 6), shard=100).collect()}
    assert got == {i: (45, 40) for i in range(3_000)} | {9_000: (60, 0)}


def test_near_duplicates_leave_nothing_behind(spark, docs, tmp_path):
    from pyspark.sql import SparkSession  # noqa: F401

    from lodestrand import runtime

    folder = runtime.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    text = " ".join(f"w{i}" for i in range(50))
    with runtime.lifetime(spark):
        got = minhash.near_duplicates(docs([(1, text), (2, text + " more"), (3, "unlike words here now then")]))
        assert {(r.doc_id, r.component_id) for r in got.collect()} == {(1, 1), (2, 1), (3, 3)}
        assert len({x.split("-")[0] for x in set(os.listdir(folder)) - before}) == 2  # what the result reads
    assert set(os.listdir(folder)) == before
