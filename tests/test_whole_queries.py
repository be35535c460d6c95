"""Queries that SQL does not express, over their whole tables, against plain code."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestrand.functions.seams import hashed_embedding
from lodestrand.functions.stemming import mixed_tokens

FOLDER = "/root/testdata/sf0.001"


def rows(spark, table):
    return spark.read.parquet(f"{FOLDER}/{table}.parquet").collect()


def query(spark, name):
    return entry.queries()[name](spark, FOLDER).collect()


def test_stems_and_embeddings(spark):
    docs = {d.doc_id: d.text for d in rows(spark, "documents")}
    assert {r.doc_id: r.tokens for r in query(spark, "stem_tokens")} == {d: mixed_tokens(t) for d, t in docs.items()}
    assert {r.doc_id: r.embedding for r in query(spark, "embed_seam")} == {d: hashed_embedding(t) for d, t in docs.items()}


def test_rows_of_words(spark):
    want = {}
    for d in rows(spark, "documents"):
        lines = (d.text or "").split("\n")
        row, start = -1, None
        for y, ord_ in sorted((ord_ % 8 * 90.0 + ord_ % 5, ord_) for ord_ in range(len(lines))):
            if start is None or y - start > 2.5:
                row, start = row + 1, y
            want[d.doc_id, ord_] = row
    assert {(r.page, r.word_id): r.row_no for r in query(spark, "row_clusters")} == want


def test_breaker_of_each_user(spark):
    hour, want = 3600e6, {}
    by = defaultdict(list)
    for e in spark.read.parquet(f"{FOLDER}/events.parquet").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).collect():
        by[e.user_id].append((float(e.t), e.event_id, e.event_type == "error"))
    for events in by.values():
        recent, open_until, trial = [], None, False
        for t, i, failed in sorted(events):
            if open_until is not None and t < open_until:
                want[i] = "rejected"
                continue
            trial = open_until is not None
            recent = [x for x in recent if x > t - 12 * hour] + ([t] if failed else [])
            if failed and (trial or len(recent) >= 3):
                want[i], open_until, recent = "opened", t + 3 * hour, []
            elif failed:
                want[i] = "failed"
            elif trial:
                want[i], open_until, recent = "closed", None, []
            else:
                want[i] = "passed"
    got = {r.event_id: r.decision for r in query(spark, "stream_breaker")}
    assert got == want and {"opened", "closed"} <= set(want.values())


def test_hybrid_with_the_full_tokenizer(spark):
    """BM25 and cosine by formula, ranks fused within and over channels, the best five."""
    docs, items, vectors = rows(spark, "documents"), rows(spark, "benchmark"), {v.vec_id: v.embedding for v in rows(spark, "embeddings")}
    field = lambda name: {d.doc_id: Counter(mixed_tokens(d[name], False)) for d in docs}
    body, title, facts = field("text"), field("source"), {d.doc_id: (d.lang, d.n_chars) for d in docs}
    size = {d: sum(body[d].values()) + sum(title[d].values()) for d in body}
    mean, df = sum(size.values()) / len(size), Counter(t for d in body for t in set(body[d]) | set(title[d]))
    unit = lambda v: [x / (math.sqrt(sum(y * y for y in v)) or 1) for x in v]
    units = {i: unit(v) for i, v in vectors.items()}
    want = {}
    for it in items:
        scores = defaultdict(float)
        for term in mixed_tokens(it.text)[:8]:
            idf = math.log((len(docs) - df[term] + 0.5) / (df[term] + 0.5)) if df[term] else 0
            for d in body:
                if tf := 5 * title[d][term] + body[d][term]:
                    scores[d] -= (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[d] / mean))
        lexical = [d for d, _ in sorted(scores.items(), key=lambda x: (round(x[1], 9), x[0]))[:20]]
        semantic = []
        if it.item_id in units:
            near = {i: round(sum(a * b for a, b in zip(units[it.item_id], u)), 9) for i, u in units.items()}
            semantic = sorted(near, key=lambda i: (-near[i], i))[:15]
        fused, first = defaultdict(float), {}
        for c, ranking in enumerate((lexical, semantic)):
            for place, d in enumerate(ranking, 1):
                fused[d] += 1 / (60 + place)
                first.setdefault(d, (c, place))
        order = sorted(fused, key=lambda d: (-round(fused[d], 12), first[d], str(d)))
        stored = [(d, i) for i, d in enumerate(order, 1) if d in facts][:20]
        for final, (d, place) in enumerate(stored[:5], 1):
            want[it.item_id, final] = (d, place, *facts[d])
    got = {(r.query_id, r.final_rank): (r.doc_id, r.fusion_rank, r.lang, r.n_chars) for r in query(spark, "hybrid_mixed")}
    assert got == want
