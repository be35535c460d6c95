"""Boxes of pages against brute force; figures, equations and tables against plain code."""

import random
from collections import defaultdict

import __spark_entry__ as entry
from lodestrand.operators import found_tables as ft
from lodestrand.operators import regions as rg

FOLDER = "/root/testdata/sf0.001"
BOX = "doc_id long, page long, uid string, x0 double, y0 double, x1 double, y1 double"


def boxes(r, n, name, far=900):
    out = []
    for i in range(n):
        x, y = r.uniform(-50, far), r.uniform(-50, far)
        out.append((1, i % 3, f"{name}{i}", x, y, x + r.choice([0, 1, 40, 400]), y + r.choice([0, 1, 30, 300])))
    return out


def shared(a, b, slack=0.0):
    w, h = min(a[5], b[5] + slack) - max(a[3], b[3] - slack), min(a[6], b[6] + slack) - max(a[4], b[4] - slack)
    return w * h if w >= 0 and h >= 0 else None


def area(b):
    return max((b[5] - b[3]) * (b[6] - b[4]), 1.0)


def test_spatial_joins_equal_brute_force(spark):
    r = random.Random(2)
    a, b = boxes(r, 90, "a"), boxes(r, 80, "b") + [(1, 0, "far", -1e9, 0.0, 1e9, 5.0), (1, 1, "turned", 9.0, 9.0, 1.0, 1.0), (1, 1, "none", None, 0.0, 1.0, 1.0)]
    fa, fb = spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX)
    whole = [x for x in b if None not in x and x[3] <= x[5]]
    for slack in (0.0, 2.5):
        want = {(x[2], y[2]): shared(x, y, slack) for x in a for y in whole if x[1] == y[1] and shared(x, y, slack) is not None}
        rows = rg.meeting(fa, fb, slack).collect()
        got = {(p.a_uid, p.b_uid): p.common for p in rows}
        assert len(rows) == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)
    want = {x[2] for x in a for y in whole if x[1] == y[1] and (shared(x, y) or 0) > 0 and shared(x, y) / area(x) >= 0.2}
    assert {p.uid for p in rg.within_regions(fa, fb).collect()} == want
    inside = {(x[2], y[2]) for x in a for y in whole if x[1] == y[1] and x[3] >= y[3] - 1 and x[5] <= y[5] + 1 and x[4] >= y[4] - 1 and x[6] <= y[6] + 1}
    assert {(p.a_uid, p.b_uid) for p in rg.contained(fa, fb).collect()} == inside


def naive_clusters(boxes_, tolerance):
    now = [tuple(b) for b in boxes_]
    changed = True
    while changed:
        changed = False
        for i in range(len(now)):
            for j in range(i):
                a, b = now[i], now[j]
                if a[0] - tolerance <= b[2] and b[0] - tolerance <= a[2] and a[1] - tolerance <= b[3] and b[1] - tolerance <= a[3]:
                    now[j] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                    del now[i]
                    changed = True
                    break
            if changed:
                break
    return sorted(now)


def test_clusters_equal_naive_merging(spark):
    r = random.Random(7)
    for n in (0, 1, 5, 40, 90):
        b = [x[3:] for x in boxes(r, n, "c", 1500)]
        found = rg.touching(b, 3.0)
        assert sorted(g[0] for g in found) == naive_clusters(b, 3.0)
        assert sorted(i for _, m in found for i in m) == list(range(n))
    rows = boxes(r, 60, "d", 2000)
    got = defaultdict(list)
    for c in rg.clusters(spark.createDataFrame(rows, BOX)).collect():
        got[c.page].append((c.x0, c.y0, c.x1, c.y1))
    for page in range(3):
        want = [c for c in naive_clusters([x[3:] for x in rows if x[1] == page], 3.0) if c[2] - c[0] > 3 and c[3] - c[1] > 3]
        assert sorted(got[page]) == want


def test_figures_by_every_rule(spark):
    """Each rule takes away what it is about, and nothing else."""
    images = [
        (1, 0, "i0", 0, 5, "a", 100.0, 200.0, 200.0, 300.0), (1, 0, "i1", 1, 5, "a", 300.0, 200.0, 400.0, 300.0), (1, 0, "i2", 2, 6, "logo", 10.0, 5.0, 60.0, 55.0), (1, 0, "i3", 3, 7, "logo", 500.0, 5.0, 560.0, 55.0),
        (1, 0, "i4", 4, 8, "b", 0.0, 0.0, 600.0, 800.0), (1, 0, "i5", 5, None, "c", 100.0, 600.0, 101.0, 700.0), (1, 0, "i6", 6, None, "d", 300.0, 500.0, 400.0, 600.0),
    ]
    grid = [(1, 0, f"g{i}", 420.0, 350.0 + 30 * i, 560.0, 351.0 + 30 * i) for i in range(3)] + [(1, 0, f"u{i}", 420.0 + 69 * i, 350.0, 421.0 + 69 * i, 411.0) for i in range(3)]
    drawn = [(1, 0, "d0", 60.0, 400.0, 120.0, 440.0), (1, 0, "d1", 110.0, 441.0, 160.0, 470.0), (1, 0, "t0", 200.0, 650.0, 300.0, 700.0), *grid]
    blocks = [(1, 0, "b0", "table", 310.0, 510.0, 390.0, 590.0), (1, 0, "b1", "paragraph", 200.0, 650.0, 260.0, 700.0), (1, 0, "b2", "paragraph", 60.0, 400.0, 90.0, 440.0)]
    f = lambda rows, extra: spark.createDataFrame(rows, "doc_id long, page long, uid string, " + extra + "x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(1, 0, 600.0, 800.0)], "doc_id long, page long, width double, height double")
    got = rg.figures(f(images, "ord long, xref long, signature string, "), f(drawn, ""), f(blocks, "kind string, "), pages, least=0.004).collect()
    assert {(x.kind, x.x0, x.y0, x.x1, x.y1) for x in got} == {("raster", 100.0, 200.0, 200.0, 300.0), ("raster", 10.0, 5.0, 60.0, 55.0), ("vector", 60.0, 400.0, 160.0, 470.0)}


def test_equations_are_assembled(spark):
    rows = [
        (1, 0, "a", "x = y", 50.0, 100.0, 150.0, 110.0), (1, 0, "b", "+ z?", 52.0, 115.0, 150.0, 125.0), (1, 0, "l1", "(3)", 200.0, 101.0, 215.0, 111.0),
        (1, 0, "c", "α = 2\n(7)", 50.0, 300.0, 150.0, 320.0), (1, 0, "d", "a^2 + b (12)", 50.0, 400.0, 150.0, 410.0), (1, 0, "l2", "Equation 9", 400.0, 400.0, 450.0, 410.0),
        (1, 0, "t1", "Above it.", 50.0, 60.0, 300.0, 75.0), (1, 0, "t2", "Far away.", 50.0, 700.0, 300.0, 715.0), (1, 0, "t3", "Between.", 50.0, 350.0, 300.0, 360.0), (1, 0, "f", "q = r", 50.0, 600.0, 150.0, 610.0),
    ]
    frame = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, page long, uid string, text string, x0 double, y0 double, x1 double, y1 double, section string")
    pages = spark.createDataFrame([(1, 0, 180.0)], "doc_id long, page long, width double")
    got = {r.sources[0]: r for r in rg.equations(frame.where("uid IN ('a', 'b', 'c', 'd', 'f', 'l1')"), frame, pages).collect()}
    assert got.keys() == {"a", "c", "d", "f"}
    a, c, d, f = (got[k] for k in "acdf")
    assert (a.equation_id, a.raw, a.latex, a.status, a.warnings, a.sources, a.x1) == ("Eq. 3", "x = y\n+ z?", None, "partial", ["latex_unreliable"], ["a", "b"], 215.0)
    assert (c.equation_id, c.raw, c.latex, c.x1) == ("Eq. 7", "α = 2", None, 180.0) and (d.equation_id, d.raw, d.latex, d.status) == ("Eq. 12", "a^2 + b", "a^2 + b", "success")
    assert (f.equation_id, f.x1) == (None, 150.0) and a.context == "Above it." and c.context == "Between." and d.context == "Between." and f.context == "Far away."


def test_tables_by_each_strategy():
    words = lambda top, rows: [(t, 60.0 + 100 * c, top + 30.0 * r, 120.0 + 100 * c, top + 12 + 30.0 * r) for r, row in enumerate(rows) for c, t in enumerate(row)]
    body = [["Name", "Size"], ["a", "1"], ["b", "2"]]
    lines = [(50.0 + 100 * i, 95.0, 51.0 + 100 * i, 186.0) for i in range(3)] + [(50.0, 95.0 + 30 * i, 251.0, 96.0 + 30 * i) for i in range(4)]
    found = ft.ruled(words(100.0, body) + [("Table 4. Sizes", 50.0, 60.0, 200.0, 75.0)], [*lines, (400.0, 0.0, 401.0, 500.0)], 300.0, 300.0)
    assert [(f[0], f[1], f[6], f[7], f[8]) for f in found] == [("line", "Table 4", ["Name", "Size"], [["a", "1"], ["b", "2"]], True)]
    assert ft.ruled(words(100.0, body[:2]), lines, 300.0, 300.0)[0][8:] == (False, ["table_structure_partial"])
    assert ft.ruled(words(100.0, body), lines[:2], 300.0, 300.0) == [] == ft.ruled(words(100.0, body), lines, 9e3, 9e3)
    caption = ("Table II: sizes", 50.0, 60.0, 200.0, 75.0)
    assert [(f[0], f[1], f[6], f[7]) for f in ft.anchored([caption, *words(100.0, body)], 600.0)] == [("geometric", "Table II", ["Name", "Size"], [["a", "1"], ["b", "2"]])]
    piped = [caption, ("Name | Size | Age", 60.0, 90.0, 200.0, 100.0), ("a | 1 | x\nb | 2 | y", 60.0, 110.0, 200.0, 130.0)]
    assert [(f[0], f[6], f[7]) for f in ft.anchored(piped, 600.0)] == [("pipe", ["Name", "Size", "Age"], [["a", "1", "x"], ["b", "2", "y"]])]
    assert ft.anchored([caption, *words(100.0, [["N", "N"], *body[1:]])], 600.0) == [] == ft.anchored([caption, *words(300.0, body)], 600.0)
    assert [(f[0], f[1], f[6]) for f in ft.aligned(words(400.0, body), 600.0, 800.0)] == [("text", "Table 1", ["Name", "Size"])]
    assert ft.aligned(words(400.0, body[:2]), 600.0, 800.0) == [] == ft.aligned(words(400.0, [["x" * 41, "y"], *body]), 600.0, 800.0)
    assert len(ft.aligned([("Tab. 3", 60.0, 380.0, 90.0, 390.0), *words(400.0, body[:2])], 600.0, 800.0)) == 1
    assert ft.canonical(["a", "", "a"], [["1"], ["1", "2", "3", "4"]]) == (["a", "column_2", "a_2"], [["1", "", ""], ["1", "2", "3"]], ["table_row_overflow"])


def test_cascade_over_documents(spark):
    """Every page's table comes back, by the strategy that its page calls for, and by no other."""
    got = entry.queries()["table_cascade"](spark, FOLDER).collect()
    assert len({(r.doc_id, r.page) for r in got}) == len(got) > 100
    method = {0: "line", 1: "pipe", 2: "geometric", 3: "text"}
    assert all(r.method == method[r.doc_id % 4] for r in got) and {r.method for r in got} == set(method.values())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in got:
        assert r.reliable and len(r.headers) == 3 and len(r.rows) == 3 and all(len(x) == 3 for x in r.rows)
        words = [h[:-1] for h in r.headers] + [c for x in r.rows for c in x]
        assert " ".join(words) in " ".join((docs[r.doc_id] or "").split())
        assert r.label == (f"Table {r.page + 1}" if r.doc_id % 4 in (1, 2) else "Table 1")
