"""Folds and numbers that SQL does not check, against plain code."""

import math
import random
from collections import Counter, defaultdict

import pytest

from lodestrand.functions.stemming import mixed_tokens
from lodestrand.operators import agent, bm25, evals, layout, structure
from lodestrand.operators.numbering import numbered


def test_unique_sources_fold_in_order(spark):
    r = random.Random(4)
    rows = [(s, o, f"e{r.randint(0, 6)}", f"p{r.randint(0, 8)}" if r.random() < 0.7 else None) for s in range(5) for o in range(30)]
    got = {(x.session_id, x.ord) for x in agent.unique_sources(spark.createDataFrame(rows, "session_id int, ord int, entry_url string, pdf_url string")).collect()}
    want = set()
    for s in range(5):
        urls, pdfs = set(), set()
        for _, o, e, p in sorted(x for x in rows if x[0] == s):
            if e not in urls and (p is None or p not in pdfs):
                want.add((s, o))
                urls.add(e)
                pdfs |= {p} - {None}
    assert got == want


def page_boxes(seed, n=12, pages=6):
    r = random.Random(seed)
    out = []
    for page in range(pages):
        for i in range(n):
            x, y = r.randint(0, 8) * 6.0, r.randint(0, 30) * 5.0
            out.append((1, page, f"u{i}", i, f"t{i}", x, y, x + r.randint(5, 60), y + r.randint(4, 12)))
    return out


BLOCK = "doc_id long, page long, uid string, ord int, text string, x0 double, y0 double, x1 double, y1 double"


def test_expressions_merge_as_a_plain_fold(spark):
    rows = page_boxes(1)
    got = defaultdict(list)
    for x in layout.merged_expressions(spark.createDataFrame(rows, BLOCK)).collect():
        got[x.page].append((x.y0, x.x0, x.x1, x.y1, x.text))
    for page in range(6):
        kept = []
        for y0, x0, x1, y1, text in sorted((b[6], b[5], b[7], b[8], b[4]) for b in rows if b[1] == page):
            if kept and abs(kept[-1][1] - x0) <= 12 and 0 <= y0 - kept[-1][3] <= 12:
                p = kept[-1]
                kept[-1] = (min(p[0], y0), min(p[1], x0), max(p[2], x1), max(p[3], y1), p[4] + "\n" + text)
            else:
                kept.append((y0, x0, x1, y1, text))
        assert sorted(got[page]) == sorted(kept)
    assert sum(map(len, got.values())) < len(rows)


def test_figures_merge_with_the_first_that_meets(spark):
    rows = page_boxes(2)
    d = spark.createDataFrame(rows, BLOCK).selectExpr("*", "CASE WHEN ord % 2 = 0 THEN 'raster' ELSE 'vector' END AS kind", "200.0D AS side")
    got = defaultdict(list)
    for x in layout.merged_figures(d).collect():
        got[x.page].append((x.y0, x.x0, x.kind, x.x1, x.y1))
    for page in range(6):
        kept = []
        for y0, x0, kind, x1, y1 in sorted((b[6], b[5], "raster" if b[3] % 2 == 0 else "vector", b[7], b[8]) for b in rows if b[1] == page):
            for i, k in enumerate(kept):
                w, h = min(x1, k[3]) - max(x0, k[1]), min(y1, k[4]) - max(y0, k[0])
                common = max(w, 0) * max(h, 0)
                small = max(min((x1 - x0) * (y1 - y0), (k[3] - k[1]) * (k[4] - k[0])), 1)
                if common / small >= 0.55 or (common > 0 and max(-w, -h) <= 5):
                    kept[i] = (min(y0, k[0]), min(x0, k[1]), k[2], max(x1, k[3]), max(y1, k[4]))
                    break
            else:
                kept.append((y0, x0, kind, x1, y1))
        assert sorted(got[page]) == sorted(kept)


def test_labels_and_captions_are_taken_once(spark):
    rows = page_boxes(3, 20)
    d = spark.createDataFrame(rows, BLOCK)
    labelled = layout.equation_labels(d.where("ord % 2 = 0"), d.where("ord % 2 = 1")).collect()
    assert labelled and max(Counter((x.page, x.label_uid) for x in labelled).values()) == 1 == max(Counter((x.page, x.uid) for x in labelled).values())
    r = d.selectExpr("doc_id", "page", "cast(ord as long) AS id", "x0", "y0", "x1", "y1", "200.0D AS height")
    taken = structure.greedy_captions(r.where("id % 2 = 0").drop("height"), r.where("id % 2 = 1")).collect()
    assert taken and max(Counter((x.page, x.region_id) for x in taken).values()) == 1 == max(Counter((x.page, x.caption_id) for x in taken).values())


def test_captioned_table_ends_where_rows_change(spark):
    words = [["a", "b", "c"], ["1", "2", "3"], ["4", "5", "6"], ["one wide row"], ["7", "8", "9"]]
    rows = [(1, 0, f"{i}:{j}", w, j * 100.0, 50 + 20.0 * i + 0.5 * j, j * 100.0 + 60, 600.0) for i, line in enumerate(words) for j, w in enumerate(line)]
    blocks = spark.createDataFrame(rows, "doc_id long, page long, uid string, text string, x0 double, y0 double, x1 double, width double")
    caption = spark.createDataFrame([(1, 0, "cap", 40.0)], "doc_id long, page long, uid string, y1 double")
    got = layout.captioned_tables(blocks, caption).orderBy("row").collect()
    assert [x.cells for x in got] == words[:3]
    assert layout.captioned_tables(blocks.where("uid < '2'"), caption).count() == 0


@pytest.mark.parametrize("groups", [(), ("g",)])
def test_numbers_equal_a_sort(spark, groups):
    r = random.Random(6)
    rows = [(r.choice([None, "a", "b"]), i, r.randint(0, 50)) for i in range(500)]
    d = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    got = {x.i: x.n for x in numbered(d, "v", "i", groups=groups).collect()}
    count, want = Counter(), {}
    for g, i, v in sorted(rows, key=lambda x: (x[2], x[1])):
        count[g if groups else 0] += 1
        want[i] = count[g if groups else 0]
    assert got == want


def test_stored_index_ranks_as_plain_bm25(spark, tmp_path):
    """The full tokenizer, stored: stems of one word meet, and scores equal the formula."""
    texts = ["Clustering the clusters of data", "A cluster is clustered", "nothing here", "data data data １２", "谱聚类 方法", None]
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, "t", x) for i, x in enumerate(texts)], "doc_id long, source string, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    index = bm25.Index.stored(docs, mixed=True)
    queries = spark.createDataFrame([(1, "clustering data"), (2, "聚类"), (3, "12")], "item_id long, text string")
    got = {(x.query_id, x.doc_id): x.score for x in bm25.bm25(index, bm25.term_sets(queries, mixed=True)).collect()}
    body = [mixed_tokens(x, distinct=False) for x in texts]
    size = [len(b) + 1 for b in body]
    mean, want = sum(size) / len(size), {}
    for q, x in ((1, "clustering data"), (2, "聚类"), (3, "12")):
        for d, b in enumerate(body):
            score = 0.0
            for term in mixed_tokens(x)[:8]:
                df = sum(term in y for y in body)
                if tf := b.count(term):
                    idf = math.log((len(body) - df + 0.5) / (df + 0.5))
                    score += (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[d] / mean))
            if score:
                want[q, d] = -score
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    again = bm25.Index.stored(docs, mixed=True)
    assert again.postings.inputFiles() == index.postings.inputFiles()
    spark.createDataFrame([(9, "t", "clustering")], "doc_id long, source string, text string").write.mode("append").parquet(path)
    assert bm25.Index.stored(spark.read.parquet(path), mixed=True).postings.inputFiles() != index.postings.inputFiles()


def test_gold_grades_fall_back_to_keywords(spark):
    evidence = spark.createDataFrame([(1, 0, "d", 1, "alpha beta gamma delta"), (1, 1, "d", 2, "nothing alike"), (1, 2, "e", 1, "lost")], "case_id int, idx int, doc string, page int, text string")
    chunks = spark.createDataFrame([("d", 1, 10, 0, "alpha beta gamma"), ("d", 1, 11, 1, "the Keyword here"), ("d", 2, 12, 0, "a keyword too"), ("d", 2, 13, 1, "no")], "doc string, page int, chunk_id int, chunk_index int, content string")
    keywords = spark.createDataFrame([(1, "keyword")], "case_id int, keyword string")
    grades, unmapped = evals.gold_grades(evidence, chunks, keywords)
    assert {(x.chunk_id, x.grade) for x in grades.collect()} == {(10, 3), (11, 1), (12, 1)}
    assert [(x.case_id, x.idx) for x in unmapped.collect()] == [(1, 2)]


def test_research_settles_every_session(spark):
    """One question is answered by one text, one in parts, one never; none asks the same query twice or beyond its calls."""
    from lodestrand.operators import bm25 as lx
    from lodestrand.operators import loop

    texts = {1: "alpha beta gamma delta epsilon zeta eta", 2: "alpha one two three", 3: "omega alone stands here"}
    docs = spark.createDataFrame([(i, "s", t) for i, t in texts.items()], "doc_id long, source string, text string")
    rows = [(10, "alpha beta gamma delta epsilon zeta."), (20, "alpha nowhere found seen known heard told said. omega alone."), (30, "qqq www eee.")]
    claims = loop.claims_of(spark.createDataFrame(rows, "session_id long, question string"))
    asked = []
    search = loop.index_retriever(lx.Index.of(docs))

    def spy(actions):
        asked.extend((x.session_id, x.query) for x in actions.collect())
        return search(actions)

    found = loop.research(claims, spy, loop.overlap_judge(docs.select("doc_id", "text")))
    sessions = {x.session_id: x for x in found.sessions.collect()}
    assert sessions[10].status == "completed" and sessions[10].rounds == 1
    assert sessions[20].status in ("limit", "stalled") and sessions[30].status == "stalled"
    status = {(x.session_id, x.claim_id): x.status for x in found.claims.collect()}
    assert status == {(10, "C1"): "covered", (20, "C1"): "partial", (20, "C2"): "covered", (30, "C1"): "missing"}
    assert len(asked) == len(set(asked)) and max(Counter(s for s, _ in asked).values()) <= 5
    evidence = [(x.session_id, x.claim_id, x.doc_id) for x in found.evidence.collect()]
    assert len(evidence) == len(set(evidence)) and (10, "C1", 1) in evidence
    with pytest.raises(ValueError):
        loop.routed(spark.createDataFrame([(1, "x")], "id int, intent string"), {"y": lambda df: df})


FOLDER = "/root/testdata/sf0.001"


def query(spark, name):
    import __spark_entry__

    return __spark_entry__.queries()[name](spark, FOLDER).collect()


def lines_of_documents(spark):
    """The lines of every document in order, with the level that the layout queries give short ones."""
    out = {}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        out[r.doc_id] = [(i, t, i % 3 + 1 if len(t) < 30 else None) for i, t in enumerate((r.text or "").split("\n"))]
    return out


def test_section_stack_equals_a_plain_walk(spark):
    got = {(r.doc_id, r.ord): r.path for r in query(spark, "section_stack")}
    want = {}
    for d, lines in lines_of_documents(spark).items():
        above = {}
        for i, text, level in lines:
            if level is not None:
                above = {k: v for k, v in above.items() if k < level} | {level: text}
            want[d, i] = " > ".join(above[k] for k in sorted(above))
    assert got == want


def test_decisions_equal_a_plain_fold(spark):
    got = {(r.pool_id, r.evidence_id): (r.statement, r.confidence, r.conflicts_with) for r in query(spark, "judge_decisions")}
    want, pools = {}, defaultdict(list)
    for r in spark.read.parquet(f"{FOLDER}/events.parquet").collect():
        pools[r.user_id].append((r.event_id, {"error": "drop", "click": "merge", "signup": "conflict"}.get(r.event_type, "keep"), r.value or 0.0))
    for pool, rows in pools.items():
        made = []
        for i, action, confidence in sorted(rows):
            if action in ("merge", "conflict") and not made:
                made = []
                break
            if action == "merge":
                made[0][1] = max(made[0][1], confidence)
            elif action != "drop":
                made.append([f"s{i}", confidence, "E1" if action == "conflict" else None])
        want |= {(pool, f"E{n}"): tuple(x) for n, x in enumerate(made, 1)}
    assert got == want


def test_budget_shrink_equals_a_plain_loop(spark):
    got = defaultdict(dict)
    for r in query(spark, "budget_shrink"):
        got[r.pack][r.place] = r.chars
    packs = defaultdict(list)
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        packs[r.doc_id % 100].append([r.doc_id, r.doc_id % 4 == 0, r.text or ""])
    for pack, rows in packs.items():
        rows.sort()
        lost = False
        while sum(len(t.split()) for _, _, t in rows) > 800:
            long = [x for x in rows if len(x[2]) > 160]
            if long:
                long[-1][2] = long[-1][2][: max(160, len(long[-1][2]) // 2)]
                continue
            spare = [x for x in rows if not x[1]]
            if not spare:
                lost = True
                break
            rows.remove(spare[-1])
        assert got.get(pack, {}) == ({-1: 0} if lost else {d: len(t) for d, _, t in rows})


def test_offline_answers_join_the_first_sentences(spark):
    import re

    from lodestrand.functions.text import SENTENCE_PATTERN

    ranked = defaultdict(dict)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in query(spark, "bm25_topk"):
        if r["rank"] <= 3:
            ranked[r.query_id][r["rank"]] = texts[r.doc_id]
    for r in query(spark, "offline_answers"):
        firsts = [next((s.strip() for s in re.findall(SENTENCE_PATTERN, t) if s.strip()), None) for _, t in sorted(ranked[r.query_id].items())]
        assert r.answer == " ".join(" ".join((s or "").split())[:260] for s in firsts)


def test_columns_need_a_gutter_with_text_on_both_sides():
    import numpy as np

    from lodestrand.operators import columns

    two = [(40.0 + 300 * s, 60.0 + 40 * i, 280.0 + 300 * s, 90.0 + 40 * i) for i in range(15) for s in (0, 1)]
    made = lambda boxes, chars=50: columns.diagnose(np.array(boxes).reshape(-1, 4), np.full(len(boxes), chars), 620.0, 720.0)
    n, left, right, sure, why = made(two)
    assert (n, left, right, why) == (2, 280.0, 340.0, "stable_center_gap") and 0.9 < sure <= 1
    assert made([(40.0, 60.0 + 40 * i, 580.0, 90.0 + 40 * i) for i in range(15)])[4] == "no_column_candidates"
    assert made([])[4] == made(two, 0)[4] == "no_column_candidates"
    assert made([b for b in two if b[0] < 100])[4] == "no_stable_center_gap"
    # Sides that stand one below the other are no columns.
    stairs = [(40.0, 20.0 + 40 * i, 280.0, 50.0 + 40 * i) for i in range(8)] + [(340.0, 380.0 + 40 * i, 580.0, 410.0 + 40 * i) for i in range(8)]
    assert made(stairs)[4] == "insufficient_vertical_overlap"
    few = [b for b in two if b[0] < 100] + [(340.0, 60.0, 580.0, 90.0)]
    assert made(few)[0] == 1
    assert columns.diagnose(np.zeros((1, 4)), np.ones(1), float("nan"), 1.0)[4] == "invalid_page_geometry"
    spans = np.array([[3.0, 4.0], [0.0, 2.0], [1.0, 2.5], [4.0, 5.0]])
    assert columns.union(spans).tolist() == [[0.0, 2.5], [3.0, 5.0]] and columns.shared_length(columns.union(spans), np.array([[2.0, 3.5]])) == 1.0
