import math
import random
import sqlite3
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import bm25, evidence, fusion, hybrid, metrics, quality, sessions, structure, vectors


def test_bm25_agrees_with_full_text_search(spark):
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "k"]
    rows = [(i, r.choice(words), " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(40)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE d USING fts5(id UNINDEXED, title, body)")
    db.executemany("INSERT INTO d VALUES (?, ?, ?)", rows)
    want = dict(db.execute("SELECT id, bm25(d, 0, 5.0, 1.0) FROM d WHERE d MATCH '\"alpha\" OR \"gamma\"'"))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    terms = spark.createDataFrame([(1, 1, "alpha"), (1, 1, "gamma"), (1, 1, "absent")], "query_id long, set_id int, term string")
    got = {x.doc_id: x.score for x in bm25.bm25(docs, terms, top_k=100).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_bm25_scope_keeps_global_statistics(spark):
    docs = spark.createDataFrame([(i, "s", "cat dog" if i % 2 else "cat bird") for i in range(10)], "doc_id long, source string, text string")
    terms = spark.createDataFrame([(1, 1, "dog")], "query_id long, set_id int, term string")
    scope = spark.createDataFrame([(1, 3), (1, 4)], "query_id long, doc_id long")
    whole = {x.doc_id: x.score for x in bm25.bm25(docs, terms).collect()}
    part = bm25.bm25(docs, terms, scope=scope).collect()
    assert [(x.doc_id, x.score) for x in part] == [(3, whole[3])]


def plain_rrf(lists, k=60):
    score, seen = defaultdict(float), {}
    for li, keys in enumerate(lists):
        for place, key in enumerate(dict.fromkeys(keys), 1):
            score[key] += 1 / (k + place)
            seen.setdefault(key, (li, place))
    return sorted(score, key=lambda x: (-round(score[x], 12), seen[x], str(x)))


def test_rrf_on_random_lists(spark):
    r = random.Random(2)
    rows, want = [], {}
    for q in range(15):
        lists = [[r.randint(1, 12) for _ in range(r.randint(0, 10))] for _ in range(3)]
        rows += [(q, li, key, p) for li, keys in enumerate(lists) for p, key in enumerate(keys, 1)]
        want[q] = plain_rrf(lists)
    df = spark.createDataFrame(rows, "query_id long, list_id int, doc_id long, rank int")
    got = defaultdict(list)
    for x in fusion.rrf(df).orderBy("query_id", "rank").collect():
        got[x.query_id].append(x.doc_id)
    assert got == {q: w for q, w in want.items() if w}
    with pytest.raises(ValueError):
        fusion.rrf(df, k=0)


def test_hybrid_needs_a_channel_and_keeps_gaps(spark):
    lists = spark.createDataFrame([(1, 1, 10, 1), (1, 1, 11, 2), (1, 1, 12, 3)], "query_id long, list_id int, doc_id long, rank int")
    stored = spark.createDataFrame([(10,), (12,)], "doc_id long")
    out = hybrid.hybrid_search(hybrid.channels(lists, None), stored).collect()
    assert [(x.doc_id, x.fusion_rank, x.final_rank) for x in out] == [(10, 1, 1), (12, 3, 2)]
    with pytest.raises(RuntimeError):
        hybrid.channels(None, None)
    with pytest.raises(ValueError):
        hybrid.channels(lists, None, "other")


def test_ranking_metrics_against_plain_code(spark):
    r = random.Random(8)
    ranked, gold, want = [], [], defaultdict(list)
    for c in range(12):
        order = r.sample(range(30), r.randint(0, 20))
        grades = {k: r.randint(1, 3) for k in r.sample(range(30), r.randint(1, 6))}
        ranked += [(c, k, i) for i, k in enumerate(order, 1)]
        gold += [(c, k, g) for k, g in grades.items()]
        for k in metrics.KS:
            top = order[:k]
            hits = [i for i, x in enumerate(top, 1) if x in grades]
            ap = sum((n + 1) / i for n, i in enumerate(hits)) / min(len(grades), k)
            dcg = sum((2 ** grades.get(x, 0) - 1) / math.log2(i + 1) for i, x in enumerate(top, 1))
            best = sum((2**g - 1) / math.log2(i + 1) for i, g in enumerate(sorted(grades.values(), reverse=True)[:k], 1))
            want[k].append((len(hits) / len(grades), float(bool(hits)), 1 / hits[0] if hits else 0.0, ap, dcg / best))
    got = metrics.ranking_metrics(spark.createDataFrame(ranked, "case_id long, key long, rank int"), spark.createDataFrame(gold, "case_id long, key long, grade int")).collect()
    for x in got:
        mean = [sum(v) / len(v) for v in zip(*want[x.k])]
        assert [x.recall, x.hit, x.reciprocal_rank, x.average_precision, x.ndcg] == pytest.approx(mean, abs=1e-6)


def test_confusion_keeps_labels_that_never_occur(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", None), ("b", "zzz")], "expected string, predicted string")
    got = {x.expected: (x.a, x.b, x.c, x.invalid) for x in metrics.confusion(rows, ("a", "b", "c")).collect()}
    assert got == {"a": (1, 0, 0, 1), "b": (0, 0, 0, 1), "c": (0, 0, 0, 0)}
    assert {x.label: x.f1 for x in metrics.per_class(rows, ("a", "b", "c")).collect()} == {"a": pytest.approx(2 / 3, abs=1e-6), "b": 0.0, "c": 0.0}


def test_evidence_order_is_by_text(spark):
    s = spark.createDataFrame([("C1", "E10", 0.5), ("C1", "E2", 0.5), ("C2", "E3", 0.9)], "claim_id string, evidence_id string, confidence double")
    none = spark.createDataFrame([], "a string, b string")
    got = {x.evidence_id: (x.tier, x.place) for x in evidence.cover_order(s, none).collect()}
    assert got == {"E3": (1, 1), "E10": (1, 2), "E2": (3, 1)}


def test_decisions_are_all_or_nothing(spark):
    rows = [(1, 1, "keep", None, "a", 0.5), (1, 2, "merge", "E1", "", 0.9), (1, 3, "drop", None, "", 0.1), (1, 4, "conflict", "E1", "b", 0.2), (2, 1, "keep", None, "x", 0.5), (2, 2, "merge", "E7", "", 0.9)]
    d = spark.createDataFrame(rows, "pool_id long, ord long, action string, target string, statement string, confidence double")
    got = [(x.pool_id, x.evidence_id, x.confidence, x.conflicts_with) for x in evidence.apply_decisions(d).orderBy("evidence_id").collect()]
    assert got == [(1, "E1", 0.9, None), (1, "E2", 0.2, "E1")]


def test_shrinking_to_a_budget(spark):
    rows = [(1, 0, True, "a " * 400), (1, 1, False, "b " * 400), (2, 0, True, "c " * 900)]
    d = spark.createDataFrame(rows, "pack long, place long, required boolean, excerpt string")
    out = evidence.shrink_to_budget(d, 100, "pack").collect()
    by = defaultdict(list)
    for x in out:
        by[x.pack].append(x)
    assert sum(len(x.excerpt.split()) for x in by[1]) <= 100 and any(x.required for x in by[1])
    assert len(by[2]) == 1


def test_answer_faults(spark):
    d = spark.sql("SELECT 1 AS answer_id, array('a','a') AS citations, array('a') AS known, array('c') AS claims, array('c') AS required UNION ALL SELECT 2, array(), array('a'), array(), array('c')")
    got = {x.answer_id: x.faults for x in evidence.answer_faults(d).collect()}
    assert got == {1: ["repeated_citation"], 2: ["no_citation", "claim_not_answered"]}


def test_compaction_and_context(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "word " * 10) for i in range(6)] + [(2, 0, "user", None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: (x.crossing, x.first_kept, x.tokens) for x in sessions.compaction_cutoff(d, 25).collect()}
    assert got == {1: (3, 4, 60), 2: (None, None, 0)}
    assert sessions.router_context(d).where("conv_id = 2").first().context == "user: "


def test_structure_operators(spark):
    b = spark.createDataFrame([(1, 0, "A", 1), (1, 1, "x", None), (1, 2, "B", 2), (1, 3, "y", None), (1, 4, "C", 1), (1, 5, "z", None)], "doc_id long, ord int, text string, level int")
    got = {x.ord: (x.section, x.subsection) for x in structure.sections(b).collect()}
    assert got[1] == ("A", None) and got[3] == ("A", "B") and got[5] == ("C", None)
    assert {x.ord: x.path for x in structure.section_stack(b).collect()}[3] == "A > B"
    i = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 3.0), (1, 5.0, 6.0), (1, 6.0, 7.0)], "k long, lo double, hi double")
    assert sorted((x.lo, x.hi) for x in structure.merged_intervals(i, "k").collect()) == [(0.0, 3.0), (5.0, 7.0)]
    refs = spark.createDataFrame([(1, "figure", "F 1"), (2, "figure", "F 2"), (3, "figure", "F 3")], "source long, type string, label string")
    targets = spark.createDataFrame([("figure", "F 1", 7), ("figure", "F 2", 8), ("figure", "F 2", 9)], "type string, label string, target long")
    assert {x.source: (x.target, x.status) for x in structure.unique_targets(refs, targets).collect()} == {1: (7, "resolved"), 2: (None, "ambiguous"), 3: (None, "unresolved")}


def test_audit_and_replacement(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, t string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, "q")], "id long, t string")
    got = {x.id: x.fault for x in vectors.audit(vectors.fingerprints(a, "id", "t"), vectors.fingerprints(b, "id", "t")).collect()}
    assert got == {2: "changed", 3: "missing", 4: "unexpected"}
    assert sorted(x.t for x in vectors.replace_group(b, a.where("id = 2"), "id").collect()) == ["q", "x", "y"]


def test_quality_of_odd_texts(spark):
    d = spark.createDataFrame([(1, None), (2, " "), (3, "ok"), (4, "Ã©Ã¨ and � more words in a row here")], "doc_id long, text string")
    w = quality.warnings(d)
    got = defaultdict(set)
    for x in w.collect():
        got[x.id].add(x.code)
    assert got[1] == {"empty_text"} and got[3] == {"short_text"} and {"mojibake", "replacement_character"} <= got[4]
    assert {x.id: x.status for x in quality.status(w, d).collect()} == {1: "failed", 2: "failed", 3: "partial", 4: "partial"}


def test_vector_ties_and_zero_norm(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, query_vector array<double>")
    assert [(x.vec_id, x.similarity) for x in vectors.nearest(v, q).orderBy("rank").collect()] == [(1, 1.0), (3, 1.0), (2, 0.0)]


def test_memory_rank_order(spark):
    d = spark.sql("SELECT 1 AS query_id, 1 AS memory_id, timestamp'2025-01-01' AS updated_at, 0.9 AS semantic UNION ALL SELECT 1, 2, timestamp'2026-01-01', 0.9 UNION ALL SELECT 1, 3, timestamp'2026-01-01', 0.1")
    got = sessions.memory_rank(d, F.lit("2026-01-01").cast("timestamp")).orderBy("rank").collect()
    assert [x.memory_id for x in got] == [2, 1]
