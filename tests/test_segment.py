"""CJK words by a vocabulary from the corpus: counts, the best path, and rankings that use them."""

import itertools
import math
import random
from collections import Counter

import __spark_entry__ as entry
from lodestrand.functions import segment
from lodestrand.functions.stemming import mixed_tokens
from lodestrand.operators import bm25

WORDS = ["图形", "谱聚类", "神经网络", "学习", "深度", "的", "是", "数据"]


def corpus(n=400, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(WORDS) for _ in range(r.randrange(1, 12))) + r.choice(["", " plain words", "。"]) for _ in range(n)]


def test_vocabulary_equals_plain_counting(spark):
    texts = corpus()
    got = segment.vocabulary(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"))
    grams = Counter(run[i : i + k] for t in texts for run in segment.Segmenter({}).find(t) for k in range(1, 5) for i in range(len(run) - k + 1))
    total = sum(n for g, n in grams.items() if len(g) == 1)
    want = {g: n for g, n in grams.items() if len(g) == 1 or (n >= 3 and min(n * total / (grams[g[:i]] * grams[g[i:]]) for i in range(1, len(g))) >= 8.0)}
    assert got == want | {t: max(want.get(t, 0), 3) for t in segment.DOMAIN_TERMS}
    assert segment.vocabulary(spark.createDataFrame([("no such letters",)], "text string")) == {}


def test_best_path_equals_all_paths():
    r = random.Random(5)
    counts = {"".join(p): r.randrange(1, 50) for n in (1, 2, 3) for p in itertools.product("甲乙丙", repeat=n) if n == 1 or r.random() < 0.4}
    counts.pop("丙")
    cut = segment.Segmenter(counts)
    weight = lambda w: cut.log.get(w, cut.rest if len(w) == 1 else -math.inf)
    for _ in range(150):
        run = "".join(r.choice("甲乙丙") for _ in range(r.randrange(1, 10)))
        paths = [[run[a:b] for a, b in zip((0, *c), (*c, len(run)))] for k in range(len(run)) for c in itertools.combinations(range(1, len(run)), k)]
        got = cut.cut(run)
        assert "".join(got) == run and abs(sum(map(weight, got)) - max(sum(map(weight, p)) for p in paths)) < 1e-9
    assert cut.cut("") == [] and cut.words("x 甲 y 丙") == ["甲", "丙"]


def test_rankings_use_the_words(spark, tmp_path):
    texts = corpus()
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    index = bm25.Index.stored(docs, segment=True)
    assert index.words == segment.vocabulary(docs) and bm25.Index.stored(docs, segment=True).words == index.words
    cut = segment.Segmenter(index.words)
    want = Counter(w for t in texts for w in set(mixed_tokens(t, True, cut)) | {"t"})
    assert {r.term: r.df for r in index.terms.collect()} == dict(want)
    assert "谱聚类" in want and "神经网络" in want and "聚类" not in want
    q = spark.createDataFrame([(1, "谱聚类的数据")], "item_id long, text string")
    hits = bm25.bm25(index, bm25.term_sets(q, mixed=True, words=index.words), top_k=500).collect()
    wanted = set(cut.words("谱聚类的数据"))
    assert {r.doc_id for r in hits} == {i for i, t in enumerate(texts) if wanted & set(mixed_tokens(t, True, cut))}


def test_mixed_query_equals_the_formula(spark):
    """The whole query over its table, by the formula in plain code."""
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    body = {d.doc_id: Counter(mixed_tokens(d.text, False)) for d in docs}
    title = {d.doc_id: Counter(mixed_tokens(d.source, False)) for d in docs}
    size = {d: sum(body[d].values()) + sum(title[d].values()) for d in body}
    mean = sum(size.values()) / len(size)
    df = Counter(t for d in body for t in set(body[d]) | set(title[d]))
    want = {}
    for it in items:
        scores = {}
        for term in mixed_tokens(it.text)[:8]:
            idf = math.log((len(docs) - df[term] + 0.5) / (df[term] + 0.5)) if df[term] else 0
            for d in body:
                tf = 5 * title[d][term] + body[d][term]
                if tf:
                    scores[d] = scores.get(d, 0) - (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[d] / mean))
        for rank, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (round(x[1], 9), x[0]))[:20], 1):
            want[it.item_id, rank] = d, s
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in entry.queries()["bm25_mixed_topk"](spark, folder).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in want)
