import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestrand.llm import bpe_count, decontaminate, dom, folds, html_text, langid, packing, toxicity

ODD_TEXTS = [
    "",
    "Σας ΟΔΟΣ <|endoftext|>İx<|startoftext|>\x1c a\x85b c",
    "é ① ² Ⅷ don't I'LL _x__ 日本語 emoji 😀👩‍👩‍👧 zz",
    "ẞ ǅ ﬁ 　​ x" * 3,
    "a" * 3000,
    "<|endoftext|",
    "a  b\n\n c \t\x1f\x1e    x   ",
]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


# ---- tokens ----


def test_token_counts_equal_the_library(spark, docs, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    sf = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = sf + odd + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    got = bpe_count.token_counts(docs(rows), path).collect()
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_bounded_cache_gives_the_same_counts():
    path = public_tokenizers.path("word_bpe_49k.json")
    words = bpe_count.Pretokens(path), bpe_count.HeapCounter(path, limit=3)
    free = bpe_count.Pretokens(path), bpe_count.HeapCounter(path)
    text = "unbelievable tokenization of internationally renowned antidisestablishmentarianism " * 3
    assert words[0].count(text, words[1]) == free[0].count(text, free[1])
    assert len(words[1]) <= 3


def test_packing_round_trip(spark, docs, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    sf = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = sf + [(10_000 + i, t) for i, t in enumerate([x for _, x in odd] + ODD_TEXTS)]
    got = packing.pack(docs(rows), path, block_tokens=20_000).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces.pop(d), key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    padding = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0


def test_packing_spreads_cost():
    r = random.Random(3)
    lengths = [r.randint(1, 1500) for _ in range(2000)]
    pieces = packing.assign(lengths, 1024)
    cost = defaultdict(float)
    whole = {s for d, start, n, s, o in pieces if n == 1024}
    for _, _, n, s, _ in pieces:
        if s not in whole:
            cost[s] += n + n * n / 1024
    shuffled = sorted(cost.values())[20:-20]
    assert sum(n for _, _, n, _, _ in pieces) == sum(lengths)
    assert np.std(shuffled) < 0.35 * np.mean(shuffled)
    assert packing.assign([], 1024) == [] and packing.assign([0], 1024) == []


# ---- language ----

WORDS = {"en": "the of and to in that was for with his on be at by this had not are but from or have an they which".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split()}


def test_language_by_rank_order(docs, odd):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(WORDS[lang]) for _ in range(60)), lang) for i in range(10, 200) for lang in [r.choice(list(WORDS))]]
    rows += [(i, t, None) for i, t in odd] + [(900, "1234 !!!", "en")]
    got = {(r.doc_id, r.lang_pred, r.held_out) for r in langid.identify(docs(rows)).collect()}
    for d, t, lang in rows[:190]:
        assert (d, lang, held_out(d)) in got
    assert {p for d, p, _ in got if d in (1, 2, 3, 900)} == {"und"}
    assert {p for d, p, _ in got if d in (4, 6, 7)} <= {"en", "de"}


def test_language_without_labels(docs):
    got = langid.identify(docs([(1, "hello there", None), (2, None, "en")])).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in got} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert langid.identify(docs([])).count() == 0


def plain_grams(text):
    """n-grams of one to three letters with word borders, counted one by one."""
    got = Counter()
    for word in "".join(ch if ch.isalpha() else " " for ch in text.lower()).split():
        p = f"_{word}_"
        got.update(word)
        got.update(p[j : j + 2] for j in range(len(p) - 1))
        got.update(p[j : j + 3] for j in range(len(p) - 2))
    return got


def plain_ranks(grams, length):
    point = lambda g: [0 if ch == "_" else ord(ch) for ch in g]
    return {g: i for i, g in enumerate(sorted(grams, key=lambda g: (-grams[g], len(g), point(g)))[:length])}


def test_known_rows_keep_their_columns(docs, odd):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(WORDS[lang]) for _ in range(60)), lang) for i in range(10, 80) for lang in [r.choice(list(WORDS))]]
    rows += [(i, t, None) for i, t in odd] + [(900, "1234 !!!", "en")]
    d = docs(rows).selectExpr("*", "'mine' AS score", "'too' AS lang_pred", "1 AS held_out")
    got = langid.known_rows(d)
    assert got.columns == d.columns and {(x.score, x.lang_pred) for x in got.collect()} == {("mine", "too")}
    assert Counter(repr(x.doc_id) for x in got.collect()) == Counter(repr(i) for i, t, *_ in rows if any(ch.isalpha() for ch in t or ""))
    assert {x.doc_id for x in langid.known_rows(docs([(1, "a b", None), (2, "12", None), (3, None, None)])).collect()} == {1}


def test_languages_equal_plain_out_of_place_distance(spark):
    """Profiles, distances and choices over the whole table, by dictionaries."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in table.collect()]
    profiles = defaultdict(Counter)
    for i, t, lang in rows:
        if lang is not None and t is not None and not held_out(i):
            profiles[lang].update(plain_grams(t))
    profiles = {lang: plain_ranks(g, 300) for lang, g in sorted(profiles.items())}
    want = {}
    for i, t, _ in rows:
        mine = plain_ranks(plain_grams(t or ""), 300)
        d = {lang: sum(abs(p[g] - r) if g in p else 300 for g, r in mine.items()) for lang, p in profiles.items()}
        want[i] = min(d, key=lambda lang: (d[lang], lang)) if mine else "und"
    got = {r.doc_id: r.lang_pred for r in langid.identify(table).collect()}
    assert got == want


def test_draws_hold_at_any_size(spark):
    """Shares as small as a large table needs are not rounded to nothing."""
    share = 2000 / 1e10
    assert folds.threshold(share) + 2**63 == pytest.approx(share * 2**64, rel=1e-3)
    assert folds.threshold(0) == -(2**63) and folds.threshold(1) == 2**63 - 1
    ids = spark.range(200_000)
    n = ids.where(folds.drawn(toxicity.F.col("id"), toxicity.F.lit(folds.threshold(0.01)), 3)).count()
    assert 1800 < n < 2200


def test_ngrams_match_a_plain_count():
    texts = ["ab,b", "", "é", "x1y"]
    rows, codes, counts, alphabet, _ = langid.ngrams(texts)
    got = defaultdict(int)
    for r, c, n in zip(rows, langid.spelled(codes, alphabet).tolist(), counts):
        order = c >> 60
        got[int(r), "".join(chr(p) if (p := (c >> s) & 0xFFFFF) else "_" for s in ((0,), (20, 0), (40, 20, 0))[order])] += int(n)
    want = defaultdict(int)
    for i, t in enumerate(texts):
        for w in "".join(ch if ch.isalpha() else " " for ch in t).split():
            p = f"_{w}_"
            for ch in w:
                want[i, ch] += 1
            for j in range(len(p) - 1):
                want[i, p[j : j + 2]] += 1
            for j in range(len(p) - 2):
                want[i, p[j : j + 3]] += 1
    assert got == want


# ---- toxicity ----


def test_toxicity_learns_held_out(spark, docs, odd):
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeioubcdfg") for _ in range(r.randint(2, 6)))
    rows, labels = [], []
    for i in range(20, 420):
        words = [word() for _ in range(r.randint(20, 80))]
        toxic = int(r.random() < 0.3)
        for _ in range(4 * toxic):
            words[r.randrange(len(words))] = r.choice(["vilexx", "rottenq", "scumzz"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    table = spark.createDataFrame(labels + [(1, 1, None), (999, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(docs(rows + odd), table).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: t for i, _, t in labels}
    tested = [x for x in got if x.held_out and x.doc_id in truth]
    assert sum(x.predicted == truth[x.doc_id] for x in tested) / len(tested) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)


def plain_model(rows, corpus, order=3, d=toxicity.DISCOUNT):
    """Kneser-Ney by dictionaries: rows of one class, the corpus for the shared counts; returns the probability function."""
    grams = Counter()
    for words in rows:
        u = v = None
        for x in words:
            grams[u, v, x] += 1
            u, v = v, x
    pairs = Counter((v, x) for _, v, x in grams)
    single = Counter(x for _, x in pairs)
    chain = lambda x: [x.encode()[:n] for n in toxicity.LEVELS if n <= len(x.encode())] + [("whole", x)]
    types, nodes = Counter(), Counter()
    for x in set(corpus):
        types.update([(), *chain(x)])
    for x, n in single.items():
        for node in [(), *chain(x)]:
            nodes[node] += n
    children = defaultdict(set)
    for x in single:
        path = [(), *chain(x)]
        for a, b in zip(path, path[1:]):
            children[a].add(b)

    def alone(x):
        p, path = 1.0, [(), *chain(x)]
        for a, b in zip(path, path[1:]):
            low = max(types[b], 1) / max(types[a], 1)
            p *= low if not nodes[a] else max(nodes[b] - d, 0) / nodes[a] + d * len(children[a]) / nodes[a] * low
        return p

    def seen(counts, key, context, low):
        inside = [n for k, n in counts.items() if k[:-1] == context]
        return low if not inside else max(counts[key] - d, 0) / sum(inside) + d * len(inside) / sum(inside) * low

    return alone, lambda u, v, x: seen(grams, (u, v, x), (u, v), seen(pairs, (v, x), (v,), alone(x)))


def test_ratios_equal_plain_kneser_ney():
    r = random.Random(21)
    words = ["idiot", "idiots", "idle", "the", "a", "clown", "clownish-lie", "ünder", "unter", "x"]
    texts = [[r.choice(words[: 6 + 4 * (i % 2)]) for _ in range(r.randint(0, 25))] for i in range(30)]
    toxic = [i % 3 == 0 for i in range(30)]
    corpus = [x for t in texts for x in t] + ["idioms", "undone", "zz"]
    sample = toxicity.Sample.of(pa.array([" ".join(t) for t in texts]))
    types = np.zeros(len(sample.up) + 1, np.int64)
    w = next(toxicity.wordcore.lower_batches(pa.array([" ".join(sorted(set(corpus)))])))
    np.add.at(types, toxicity.last_nodes(sample.nodes, toxicity.chains(w, np.arange(len(w)))), 1)
    shared = toxicity.shares(sample.up, toxicity.rolled_up(sample.up, types[:-1]), float(types.sum()))
    kind = np.array(toxic)[sample.row]
    model = toxicity.Model.fit(sample, np.flatnonzero(kind), np.flatnonzero(~kind), shared)
    (alone_t, full_t), (alone_o, full_o) = (plain_model([t for t, k in zip(texts, toxic) if k == c], corpus) for c in (True, False))
    for t in [*texts, ["the", "idiot", "the", "a", "x", "clown", "idiot"], ["x"], ["idiots", "x", "idiots"]]:
        w = next(toxicity.wordcore.lower_batches(pa.array([" ".join(t)])))
        f = model.features(w, toxicity.Memory())[0]
        history = list(zip([None, None, *t], [None, *t], t))
        want = [np.mean([np.log(p(x) / q(x)) for x in t]) if t else 0.0 for p, q in [(alone_t, alone_o)]]
        want += [np.mean([np.log(full_t(*h) / full_o(*h)) for h in history]) if t else 0.0]
        assert np.allclose([f[1], f[3 + len(toxicity.WINDOWS)]], want, atol=1e-4)


def test_shared_counts_are_of_different_words_of_the_whole_corpus(spark, docs):
    rows = [(i, f"plain text goes on here {'x' * (i % 14)} w{i}") for i in range(60)] + [(99, "vilexxpression once"), (98, "vilexxpressive here"), (97, None), (96, "a a a")]
    labels = spark.createDataFrame([(i, 1, int(i >= 96)) for i, _ in rows if i % 3 == 0], "doc_id bigint, quality int, toxic int")
    called = []
    real = toxicity.shares

    def keep(up, types, all_types):
        called.append((types, all_types))
        return real(up, types, all_types)

    toxicity.shares = keep
    try:
        scorer = toxicity.train(docs(rows), labels)
    finally:
        toxicity.shares = real
    (types, every), nodes = called[-1], scorer.model.nodes
    vocabulary = sorted({x for _, t in rows for x in (t or "").split()})
    want = Counter()
    for x in vocabulary:
        w = next(toxicity.wordcore.lower_batches(pa.array([x])))
        want.update({int(h[0]) for h in toxicity.chains(w, np.arange(1))} - {0})
    got = dict(zip(nodes.keys.tolist(), types.tolist()))
    assert every == len(vocabulary) and all(want[h] == n for h, n in got.items())
    # Every prefix of every labelled word outside the held-out fold is in the model.
    learned = {x for i, t in rows if i % 3 == 0 and not held_out(i) for x in (t or "").split()}
    for x in learned:
        w = next(toxicity.wordcore.lower_batches(pa.array([x])))
        assert {int(h[0]) for h in toxicity.chains(w, np.arange(1))} - {0} <= got.keys()


def test_toxicity_without_labels(spark, docs):
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(docs([(1, "a b"), (2, None)]), empty).collect()
    assert [x.predicted for x in got] == [0, 0]
    assert toxicity.toxicity(docs([]), empty).count() == 0


# ---- decontamination ----


def items(spark, n=12):
    r = random.Random(11)
    word = lambda: "".join(r.choice("klmnopqrst") for _ in range(r.randint(2, 7)))
    texts = [" ".join(word() for _ in range(r.randint(15, 40))) for _ in range(n)]
    return texts, spark.createDataFrame([*enumerate(texts), (90, None), (91, "too short")], "item_id bigint, text string")


@pytest.mark.parametrize("block_bytes", [8 << 20, 500])
def test_decontamination_finds_edited_copies(spark, docs, odd, block_bytes):
    texts, table = items(spark)
    r = random.Random(12)
    rows, planted = [], set()
    for i in range(100, 160):
        noise = " ".join(random.Random(i).choice(["some", "plain", "words", "about", "nothing", "too", "short"]) for _ in range(50))
        if r.random() < 0.5:
            k = r.randrange(len(texts))
            words = [w.upper() for w in texts[k].split()]
            for _ in range(len(words) // 8):
                words[r.randrange(len(words))] = "edited"
            noise += " " + ", ".join(words) + ". " + noise
            planted.add((i, k))
        rows.append((i, noise))
    got = decontaminate.contaminated(docs(rows + odd), table, block_bytes=block_bytes).collect()
    assert {(x.doc_id, x.item_id) for x in got} == planted
    kept = decontaminate.clean(docs(rows + odd), table, block_bytes=block_bytes)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.count() == len(rows) + len(odd) - len(planted)


def test_decontamination_finds_a_repeated_edited_copy(spark, docs):
    r = random.Random(13)
    item = ["".join(r.choice("klmnopqrst") for _ in range(7)) for _ in range(40)]
    edited = list(item)
    for at in (5, 14, 23, 32):
        edited[at] = "edited"
    table = spark.createDataFrame([(0, " ".join(item))], "item_id bigint, text string")
    rows = [(i, f"plain words {i} before " + " ".join(edited) + f" and after {i}") for i in range(50)]
    # A part shared by many documents that is too short for a match.
    rows += [(i, f"other words {i} before " + " ".join(item[6:14]) + f" and after {i}") for i in range(100, 150)]
    got = decontaminate.contaminated(docs(rows), table).collect()
    assert {(x.doc_id, x.score) for x in got} == {(i, 0.85) for i in range(50)}
    kept = decontaminate.clean(docs(rows), table)
    assert sorted(x.doc_id for x in kept.collect()) == list(range(100, 150))


def plain_matches(rows, items, limit=0.4, n=3):
    """Every document against every item with which it shares three words in a row, by a full Smith-Waterman table."""
    split = lambda t: "".join(ch if ch.isascii() and ch.isalnum() or not ch.isascii() else " " for ch in (t or "").lower()).split()
    out = {}
    for d, t in rows:
        words = split(t)
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        for i, x in items:
            item = split(x)
            if len(item) < n or not any(tuple(item[j : j + n]) in grams for j in range(len(item) - n + 1)):
                continue
            best, above = 0, [0] * (len(words) + 1)
            for w in item:
                row = [0]
                for j, y in enumerate(words, 1):
                    row.append(max(0, above[j - 1] + (2 if w == y else -1), above[j] - 1, row[-1] - 1))
                best, above = max(best, max(row)), row
            if best / (2 * len(item)) >= limit:
                out[d, i] = round(best / (2 * len(item)), 6)
    return out


@pytest.mark.parametrize("block_bytes", [8 << 20, 700])
def test_decontamination_equals_all_pairs(spark, docs, odd, block_bytes):
    texts, _ = items(spark)
    table = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(texts)] + [("none", None), ("short", "too short"), ("i0", texts[0])], "item_id string, text string")
    r = random.Random(31)
    rows = list(odd)
    for i in range(100, 170):
        words = [r.choice(["some", "plain", "words", "about", "nothing"]) for _ in range(30)]
        for _ in range(r.randint(0, 2)):
            part = r.choice(texts).split()
            lo = r.randint(0, len(part) // 2)
            part = part[lo : lo + r.randint(4, len(part))]
            for _ in range(r.randint(0, len(part) // 3)):
                part[r.randrange(len(part))] = r.choice(["edited", "words"])
            at = r.randint(0, len(words))
            words[at:at] = part
        rows.append((i, " ".join(words)))
    want = plain_matches(rows, [(f"i{i}", t) for i, t in enumerate(texts)])
    got = decontaminate.contaminated(docs(rows), table, block_bytes=block_bytes).collect()
    assert {(x.doc_id, x.item_id): x.score for x in got} == want and len(want) > 20
    assert len(got) == len(want) + sum(i == "i0" for _, i in want)
    d = docs(rows).selectExpr("*", "1 AS key", "2 AS gone")
    kept = decontaminate.clean(d, table, block_bytes=block_bytes)
    assert kept.columns == d.columns
    assert Counter(repr(x.doc_id) for x in kept.collect()) == Counter(repr(i) for i, _ in rows if all((i, f"i{k}") not in want for k in range(len(texts))))


def test_common_words_bound_the_alignment():
    r = random.Random(3)
    for _ in range(200):
        a, b = (np.array([r.randrange(5) for _ in range(r.randint(1, 12))]) for _ in range(2))
        assert decontaminate.in_common(a, b) == sum(min((a == x).sum(), (b == x).sum()) for x in range(5))
        assert decontaminate.align(a, b)[0] <= 2 * decontaminate.in_common(a, b)


def test_alignment_matches_a_plain_table():
    r = random.Random(2)
    for _ in range(100):
        a, b = ([r.randrange(4) for _ in range(r.randint(1, 12))] for _ in range(2))
        best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        assert decontaminate.align(np.array(a), np.array(b))[0] == best


def test_decontamination_of_nothing(spark, docs):
    _, table = items(spark)
    assert decontaminate.contaminated(docs([]), table).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(docs([(1, "a b c d")]), none).count() == 0


# ---- pages ----


def test_parser_closes_what_browsers_close():
    nodes = dom.parse("<ul><li>a<li>b</ul><p>x<b>y<p>z<div>q</div>t<script>var a='</p>';</script>&amp;&am")
    shape = [(n.tag, n.parent.tag if n.parent else None) for n in nodes]
    assert shape == [("#root", None), ("ul", "#root"), ("li", "ul"), ("li", "ul"), ("p", "#root"), ("b", "p"), ("p", "#root"), ("div", "#root"), ("script", "#root")]
    assert nodes[0].parts[-1] == "&&am"


def test_main_text_of_pages(spark):
    page = (
        "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>More</a></li></ul></nav>"
        '<div class="ad">Buy now</div><article><h1>The  title</h1><p>First <b>bo</b>ld &amp; plain text, with words.<p>Second one here is long enough to count as prose.</p></article>'
        '<section class="comments"><p>nice post</p></section><footer>&copy; me</footer></body></html>'
    )
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (None, "u", "<p"), (1, "u", page)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    want = "The title First bold & plain text, with words. Second one here is long enough to count as prose."
    assert [x.text for x in got if x.page_id == 1] == [want, want]
    assert all(x.n_chars == len(x.text) for x in got) and len(got) == 5
    assert {x.text for x in got if x.page_id in (2, 3)} == {""}


def test_math_and_object_fallback_are_left_to_the_trees(spark):
    """Text of math and object elements inside prose is kept as that of other nodes is."""
    prose = "This sentence is long enough to count as prose in the main text of a page, and goes on."
    page = f"<html><body><article><h1>A title</h1><p>{prose} The sum <math><mi>alpha</mi><mo>=</mo><mn>42</mn></math> holds here. {prose}</p><p>{prose} <object>fallback words</object> {prose}</p></article></body></html>"
    got = html_text.main_text(spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")).first().text
    assert "alpha" in got and "42" in got and "fallback words" in got


def test_trees_separate_composed_pages():
    trees = html_text.trained()
    composer = html_text._Composer(123)
    right = total = 0
    for _ in range(60):
        nodes, labels = html_text._labelled(composer.page())
        keep = html_text.decode(nodes, trees.margin(html_text.features(nodes)))
        for x, k, label in zip(nodes, keep, labels):
            if x.tag not in html_text.SKIPPED:
                n = sum(len(p.strip()) for p in x.parts if type(p) is str)
                total += n
                right += n * (k == bool(label))
            assert not k or x.parent is None or keep[x.parent.index]
    assert right / total > 0.98


def plain_article(page):
    """Words of the one article of a page, by the library's tokenizer of tags; scripts and styles left out."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        inside, hidden, words = 0, 0, []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.hidden += tag in ("script", "style")
            if tag not in ("b", "i", "em", "strong", "a", "span", "u", "small", "code"):
                self.words.append(" ")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.hidden -= tag in ("script", "style")
            if tag not in ("b", "i", "em", "strong", "a", "span", "u", "small", "code"):
                self.words.append(" ")

        def handle_data(self, data):
            if self.inside and not self.hidden:
                self.words.append(data)

    reader = Reader(convert_charrefs=True)
    reader.words = []
    reader.feed(page or "")
    reader.close()
    return " ".join("".join(reader.words).split())


def test_main_text_equals_the_articles_of_the_table(spark):
    """Every page of the table at hand, against a plain reading of its article element."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    want = {r.page_id: plain_article(r.html) for r in pages.collect()}
    assert got.keys() == want.keys()
    wrong = [i for i in want if got[i] != want[i]]
    assert len(wrong) <= 0.01 * len(want), (len(wrong), [(got[i][:200], want[i][:200]) for i in wrong[:2]])


PROSE = [
    "The river rose for three days before the old bridge gave way, and nobody in the village was surprised by that.",
    "Engineers had warned the council twice since spring that the southern pier was undercut by the current.",
    "A ferry now takes people across every half hour, although it cannot carry carts, cattle or the daily post.",
    "Rebuilding will start in autumn if the province agrees to pay for the stone, which is far from certain today.",
]


@pytest.mark.parametrize(
    "page",
    [
        # A news page with a share bar, a related box inside the story's column, and comments.
        '<body><header class="masthead"><a href="/">Paper</a> <a href="/s">Sport</a></header><div id="wrap"><div class="story-body"><h1>Bridge gone</h1><div class="share"><a href="#">Share</a><a href="#">Mail</a></div>'
        + "".join(f"<p>{p}</p>" for p in PROSE)
        + '</div><div class="sidebar related"><h3>More</h3><ul><li><a href="/1">Other story</a></li><li><a href="/2">Next story</a></li></ul></div></div><div id="comments"><p class="comment">I told you so, said the first reader of them all.</p></div><footer>Imprint and terms</footer></body>',
        # A blog whose post is a section under main, with a search form and a cookie notice.
        '<body><div class="cookie-notice">We use cookies to improve things. <button>Accept</button></div><nav><a href="/">Home</a> | <a href="/about">About</a></nav><main><section class="post"><h1>Bridge gone</h1>'
        + "".join(f"<p>{p}</p>" for p in PROSE)
        + '</section></main><form action="/q"><input name="q"> Search this site <button>Go</button></form><div class="footer">Powered by something</div></body>',
        # An old page of bare tables and line breaks in one content element.
        '<body><table class="menu"><tr><td><a href="1">One</a></td><td><a href="2">Two</a></td><td><a href="3">Three</a></td></tr></table><div id="content"><h1>Bridge gone</h1>'
        + "<br>".join(PROSE)
        + '</div><div class="ad">Buy stone now, cheap and near you.</div></body>',
    ],
)
def test_main_text_of_pages_made_by_hand(spark, page):
    """Pages labelled by hand that no generator composed: their prose is kept whole, what surrounds it goes."""
    got = html_text.main_text(spark.createDataFrame([(1, "u", page)], "page_id bigint, url string, html string")).first().text
    assert got == " ".join(["Bridge gone", *PROSE])


def test_letters_beyond_a_chunk_index(spark, docs):
    """A text of 20,000 different letters: every n-gram of one and two, none of an order that does not exist."""
    text = "".join(chr(0x4E00 + i) for i in range(20_000))
    rows, codes, counts, alphabet, pad = langid.ngrams([text])
    grams = langid.spelled(codes, alphabet, pad)
    want = plain_grams(text)
    got = Counter()
    for g, n in zip(grams.tolist(), counts.tolist()):
        got["".join(chr(p) if p else "_" for p in ((g >> 40) & 0xFFFFF, (g >> 20) & 0xFFFFF, g & 0xFFFFF)[2 - (g >> 60) :])] += n
    assert got == want
    assert langid.ngrams([text, "a b"])[4] == 0
    both = langid.identify(docs([(i, text if i % 2 else "the of and to in that was", "zh" if i % 2 else "en") for i in range(40)])).collect()
    assert {(r.doc_id % 2, r.lang_pred) for r in both} == {(0, "en"), (1, "zh")}


def test_languages_in_blocks(spark, docs):
    """Blocks of profiles choose and score as all profiles together, whatever the number of labels."""
    r = random.Random(9)
    rows = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(8)), f"l{i % 60}") for i in range(400)] + [(900, None, "x"), (901, "12", "l1")]
    table = docs(rows)
    whole = sorted(map(tuple, langid.identify(table).collect()))
    for block in (1, 7, 59):
        assert [(*x[:3], round(x[3], 9)) for x in sorted(map(tuple, langid.identify(table, block=block).collect()))] == [(*x[:3], round(x[3], 9)) for x in whole]
    many = docs([(i, f"w{i} word", f"lang{i}") for i in range(6_000)])
    assert langid.identify(many).count() == 6_000


def test_rare_grams_of_many_items():
    r = random.Random(2)
    texts = [" ".join(str(r.randrange(3000)) for _ in range(r.randrange(2, 40))) for _ in range(300)]
    items = decontaminate.Items.of(list(range(300)), texts, 3)
    frequency = np.array([r.randrange(60) for _ in items.grams])
    items.mark_rare(frequency)
    f = frequency[items.gram_of]
    for i in np.unique(items.item):
        mine = items.item == i
        assert (items.rare[mine] == (f[mine] <= 4 * np.quantile(f[mine], 0.25, method="lower") + 16)).all()
    decontaminate.Items.of([], [], 3).mark_rare(np.empty(0, np.int64))


def test_very_long_words_count_the_same(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    table = bpe_count.HeapCounter(path)
    r = random.Random(3)
    for data in (b"a" * 5000, bytes(r.choice(b"abcdefgh") for _ in range(20_000)), "é日x".encode() * 900):
        assert table.merged_long(data) == table.merged(data)
    monkeypatch.setattr(bpe_count, "LONG_WORD", 100)
    word = "internationalization" * 50
    assert table[word] == len(Tokenizer.from_file(path).encode(word, add_special_tokens=False).ids)
    assert word not in table
