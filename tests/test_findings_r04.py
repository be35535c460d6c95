"""What round 4 found: each test failed before its change."""

import difflib
import random

from lodestrand.functions import seams
from lodestrand.operators import columns, evals, found_tables, segments


def test_tables_of_a_page_are_one_step(spark):
    """each strategy read all pages anew and made a frame of pandas for each."""
    pages = spark.createDataFrame([(i, 0, 600.0, 800.0) for i in range(4)] + [(4, 0, None, None)], "doc_id long, page long, width double, height double")
    body = [["Name", "Size"], ["a", "1"], ["b", "2"]]
    rows = [(d, 0, t, 60.0 + 100 * c, 100 + 30.0 * r, 120.0 + 100 * c, 112 + 30.0 * r) for d in (0, 1, 2, 4) for r, row in enumerate(body) for c, t in enumerate(row)]
    blocks = spark.createDataFrame([*rows, (1, 0, "Table 7", 50.0, 60.0, 200.0, 75.0), (3, 0, " ", None, None, None, None)], "doc_id long, page long, text string, x0 double, y0 double, x1 double, y1 double")
    at = [(50.0 + 100 * i, 95.0, 51.0 + 100 * i, 186.0) for i in range(3)] + [(50.0, 95.0 + 30 * i, 251.0, 96.0 + 30 * i) for i in range(4)]
    lines = spark.createDataFrame([(0, 0, *b) for b in at] + [(3, 0, *at[0])], "doc_id long, page long, x0 double, y0 double, x1 double, y1 double")
    found = found_tables.tables(pages, blocks, lines)
    got = sorted((r.doc_id, r.method, r.label, r.headers, r.rows) for r in found.collect())
    assert got == [(d, m, n, body[0], body[1:]) for d, m, n in ((0, "line", "Table 1"), (1, "geometric", "Table 7"), (2, "text", "Table 1"))]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan and plan.count("MapInArrow") == 1


def test_columns_are_not_a_call_for_each_page(spark):
    """F8: a frame of pandas was made for each page."""
    boxes = [(1, 0, "x" * 50, x, 90.0 * i, x + 200.0, 90.0 * i + 60, 600.0, 720.0) for i in range(5) for x in (40.0, 320.0)]
    rows = [*boxes, (1, 1, "a", 40.0, 0.0, 90.0, 9.0, None, 720.0), (2, 0, None, None, 0.0, 1.0, 1.0, 600.0, 720.0)]
    found = columns.page_columns(spark.createDataFrame(rows, "doc_id int, page int, text string, x0 double, y0 double, x1 double, y1 double, width double, height double"))
    got = {(r.doc_id, r.page): (r.columns, r.gutter_left, r.gutter_right, r.reason) for r in found.collect()}
    assert got == {(1, 0): (2, 240.0, 320.0, "stable_center_gap"), (1, 1): (1, None, None, "invalid_page_geometry"), (2, 0): (1, None, None, "no_column_candidates")}
    assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_scores_are_worked_out_once(spark):
    """the filter that posexplode() infers worked out every score of a page a second time."""
    e = spark.createDataFrame([(1, 0, "d", 1, "abc def"), (1, 1, "d", 2, None)], "case_id int, idx int, doc string, page int, text string")
    c = spark.createDataFrame([("d", 1, 7, 0, "abc def ghi"), ("d", 1, 8, 1, "abc def")], "doc string, page int, chunk_id int, chunk_index int, content string")
    for df, rows in zip(evals.evidence_map(e, c, spark.createDataFrame([(1, "ghi")], "case_id int, keyword string")), ([(1, 0, 8, 1.0, "text"), (1, 1, None, None, None)], [(1, 7, 1), (1, 8, 3)])):
        assert sorted(map(tuple, df.collect())) == rows
        assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython [match_scores") == 1


def test_scores_equal_difflib_without_its_work():
    """F1 of words or difflib's ratio for texts on both sides of 200 letters; difflib itself is asked for a chunk's index alone."""
    r = random.Random(4)
    text = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    words = [text("etaoinshrdlu", r.randrange(1, 9)) for _ in range(80)] + ["zebra", "quixotic"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    pairs = [(text("ab c", r.randrange(60)), text("abc d", r.choice((0, 1, 63, 64, 199, 200, 230)))) for _ in range(400)]
    pairs += [(prose(40), prose(r.choice((3, 30, 150)))) for _ in range(200)]
    pairs += [(x, x[3:50] + y) for x, y in pairs[-200:]]

    def plain(a, b):
        x, y = set(a.split()), set(b.split())
        return max(2 * len(x & y) / (len(x) + len(y)) if x & y else 0.0, difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0)

    want = [plain(a, b) for a, b in pairs]
    asked = difflib.SequenceMatcher.find_longest_match
    difflib.SequenceMatcher.find_longest_match = None
    try:
        assert [seams._scores(a, [b], 0.0)[0] for a, b in pairs] == want
    finally:
        difflib.SequenceMatcher.find_longest_match = asked


def test_batches_of_an_index_are_written_once(spark, tmp_path, monkeypatch):
    """texts were read for postings and for lengths, and segments of merges that follow one another were written for each."""
    docs = spark.createDataFrame([(i, "s", f"word{'abc'[i % 3]} other word{'abc'[i % 3]}") for i in range(20)] + [(7, "s", "wordb again"), (None, "s", "x")], "doc_id long, source string, text string")
    written, write = [], segments.SegmentLog._write
    monkeypatch.setattr(segments.SegmentLog, "_write", lambda self, folder, table, rows, *a: (written.append((table, rows._jdf.queryExecution().optimizedPlan().toString())), write(self, folder, table, rows, *a))[1])
    log = segments.LexicalLog(spark, str(tmp_path / "log"), fan=2)
    log.upsert(docs)
    log.upsert(docs.where("doc_id < 5").withColumn("text", docs.source))
    log.delete(docs.where("doc_id > 15").select("doc_id"))
    log.upsert(docs.where("doc_id = 3"))
    assert [t for t, _ in written].count("postings") == 5 and not any("split(" in p or "regexp_extract_all(" in p for _, p in written)
    got = {(r.term, r.doc_id, r.length, r.tf_title, r.tf_body) for r in log.index().postings.collect()}
    assert {x for x in got if x[1] in (3, 4, 7)} == {("s", 3, 4, 1, 0), ("worda", 3, 4, 0, 2), ("other", 3, 4, 0, 1), ("s", 4, 2, 1, 1), ("s", 7, 4, 1, 0), ("wordb", 7, 4, 0, 2), ("other", 7, 4, 0, 1), ("s", 7, 3, 1, 0), ("wordb", 7, 3, 0, 1), ("again", 7, 3, 0, 1)}
    assert {x[1] for x in got} == set(range(16))
