"""Evidence against plain code: scores of every pair of a page, what is bound, and the sentences of prose."""

import difflib
import re
import unicodedata

import __spark_entry__ as entry
from lodestrand.operators import chunking, evals

FOLDER = "/root/testdata/sf0.001"


def norm(t):
    return " ".join(re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t or "").casefold()))


def score(a, b):
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    f1 = 2 * len(x & y) / (len(x) + len(y))
    return max(f1, difflib.SequenceMatcher(None, a, b).ratio())


def plain_binding(evidence, chunks, keywords, least):
    bound, grades = {}, {}
    for case, idx, doc, page, text in evidence:
        here = [(score(norm(text), norm(c)), i, k, norm(c)) for d, p, k, i, c in chunks if (d, p) == (doc, page)]
        named = [k for _, _, k, c in here if any(w and w in c for w in map(norm, keywords.get(case, [])))]
        here.sort(key=lambda x: (-x[0], x[1], x[2]))
        best = here[0] if here and here[0][0] >= least else None
        bound[case, idx] = (best[2], round(best[0], 9), "text") if best else (None, None, "keyword" if named else None)
        for k in named:
            grades[case, k] = max(grades.get((case, k), 0), 1)
        if best:
            grades[case, best[2]] = 3
    return bound, grades


def test_binding_equals_plain_code(spark):
    """Paraphrases that only the characters bind, ties, keywords, pages without chunks, nulls."""
    chunks = [
        ("d", 1, 10, 0, "Spectral clustering of the graph's Laplacian."), ("d", 1, 11, 1, "Spectral clustering of the graph's Laplacian."), ("d", 1, 12, 2, "An unrelated remark, ﬁnally"),
        ("d", 2, 20, 3, "preprocessing normalisation regularisation"), ("d", 2, 21, 4, "something else entirely with transport"), ("d", 3, 30, 5, None), ("e", 1, 40, 6, "zzz qqq transport"),
    ]
    evidence = [
        (1, 0, "d", 1, "spectral CLUSTERING of graph laplacians"), (1, 1, "d", 2, "preprocess normalise regularise"), (1, 2, "d", 2, "xyz"), (1, 3, "d", 9, "nothing there"),
        (2, 0, "e", 1, "kkkk"), (2, 1, "d", 3, ""), (3, 0, "d", 1, "Finally an unrelated remark"), (3, 1, "e", 1, None),
    ]
    keywords = {1: ["Transport", "--"], 2: ["QQQ"], 3: []}
    e = spark.createDataFrame(evidence, "case_id int, idx int, doc string, page int, text string")
    c = spark.createDataFrame(chunks, "doc string, page int, chunk_id int, chunk_index int, content string")
    k = spark.createDataFrame([(case, w) for case, ws in keywords.items() for w in ws], "case_id int, keyword string")
    bound, grades = evals.evidence_map(e, c, k)
    want = plain_binding(evidence, chunks, keywords, 0.35)
    assert {(r.case_id, r.idx): (r.chunk_id, None if r.score is None else round(r.score, 9), r.by) for r in bound.collect()} == want[0]
    assert {(r.case_id, r.chunk_id): r.grade for r in grades.collect()} == want[1]
    assert want[0][1, 1][2] == "text" and score(norm(evidence[1][4]), norm(chunks[3][4])) > 0.35 > 0 == len(set(norm(evidence[1][4]).split()) & set(norm(chunks[3][4]).split()))


def test_scores_of_all_pairs_of_a_page(spark):
    """The whole query: no pair is left out, and every score is the greater of the two."""
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = {}
    for d in docs:
        for i, c in enumerate(chunking.char_chunks(d.text or "", 900, 120)):
            for it in items:
                if it.item_id % 8 == (d.doc_id + 3 * (i // 4)) % 8:
                    want[it.item_id, d.doc_id * 100_000 + i] = (norm(it.text), norm(c))
    got = {(r.case_id, r.chunk_id): r.score for r in entry.queries()["match_score"](spark, FOLDER).collect()}
    assert got.keys() == want.keys() and len(got) > 1000
    some = sorted(want)[::17]
    assert all(abs(got[k] - score(*want[k])) < 1e-8 for k in some)
    best = entry.queries()["evidence_binding"](spark, FOLDER).collect()
    by_page = {}
    for (case, chunk), s in got.items():
        page = (case, chunk // 100_000 * 100_000 + chunk % 100_000 // 4)
        by_page[page] = max(by_page.get(page, 0), s)
    assert {(r.case_id, r.idx) for r in best} == by_page.keys()
    for r in best:
        assert (r.by == "text") == (by_page[r.case_id, r.idx] >= 0.35)
        assert r.by != "text" or abs(r.score - by_page[r.case_id, r.idx]) < 1e-8


def test_prose_sentences():
    split = chunking.split_prose
    assert split("See Fig. 3 of it. cf. the rest. e.g. this! Fine") == ["See Fig.", "3 of it.", "cf. the rest.", "e.g. this!", "Fine"]
    assert split("etc. etc. etc. Then") == ["etc. etc.", "etc. Then"] and split("no.") == ["no."] and split(" ") == []
    assert len(split("etc. " * 3000)) == 1500
    assert split("好。是的！對") == ["好。", "是的！", "對"]
