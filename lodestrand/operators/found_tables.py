"""Tables of a page by a cascade of strategies: ruled lines, then captions with cells or pipes below, then aligned text.

A strategy is asked only for the pages where those before it found nothing. What a strategy
needs to see at once is a page, so a page's boxes are shuffled once and go through all of them in one step.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.folds import by_group

_PAGE = ["doc_id", "page"]
# A table's caption, how far below it a table begins, and how near lines and rows count as one.
CAPTION = re.compile(r"^\s*(?:table|tab\.?)\s*([A-Za-z]*\d+(?:\.\d+)*|[IVXLCDM]+)(?=\s|[:.)-]|$)", re.IGNORECASE)
BELOW, JOINED, SAME_ROW, NEAR_ROW, THIN = 180.0, 3.0, 2.5, 12.0, 1.5
LEAST_AREA = 0.01
SCHEMA = "doc_id long, page long, method string, place long, label string, x0 double, y0 double, x1 double, y1 double, headers array<string>, rows array<array<string>>, reliable boolean, warnings array<string>"


def canonical(headers: list[str], rows: list[list[str]]) -> tuple[list[str], list[list[str]], list[str]]:
    """Headers that are named and unlike, rows of their width, and a warning if a row was wider."""
    names, seen = [], {}
    for i, h in enumerate(headers):
        base = (h or "").strip() or f"column_{i + 1}"
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    over = any(len(r) > len(names) for r in rows)
    return names, [([c.strip() for c in r] + [""] * len(names))[: len(names)] for r in rows], ["table_row_overflow"] if over else []


def positions(values: list[float]) -> list[float]:
    """Different places of lines, those within JOINED of the one before as that one."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > JOINED:
            out.append(v)
    return out


def lattices(lines: list[tuple]) -> list[tuple[list[float], list[float]]]:
    """(xs, ys) of each net of level and upright lines (x0, y0, x1, y1) that cross or touch, of three and two places at least."""
    level = [b for b in lines if b[3] - b[1] <= THIN < b[2] - b[0]]
    upright = [b for b in lines if b[2] - b[0] <= THIN < b[3] - b[1]]
    root = list(range(len(level) + len(upright)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, h in enumerate(level):
        for j, v in enumerate(upright):
            if h[0] - JOINED <= v[0] <= h[2] + JOINED and v[1] - JOINED <= h[1] <= v[3] + JOINED:
                root[find(i)] = find(len(level) + j)
    nets: dict[int, tuple[list, list]] = {}
    for i, h in enumerate(level):
        nets.setdefault(find(i), ([], []))[1].append(h[1])
    for j, v in enumerate(upright):
        nets.setdefault(find(len(level) + j), ([], []))[0].append(v[0])
    found = [(positions(xs), positions(ys)) for xs, ys in nets.values()]
    return sorted((n for n in found if len(n[0]) >= 3 and len(n[1]) >= 2), key=lambda n: (n[1][0], n[0][0]))


def _caption(blocks: list[tuple], box: tuple) -> str | None:
    """The label of the nearest caption above or below a box, within 96 points and over its width."""
    best = None
    for text, x0, y0, x1, y1 in blocks:
        m = CAPTION.match(" ".join(text.split()))
        gap = max(box[1] - y1, y0 - box[3], 0.0)
        if m and gap <= 96 and x0 < box[2] and x1 > box[0] and (best is None or (gap, y0) < best[0]):
            best = (gap, y0), m[1]
    return best and f"Table {best[1]}"


def ruled(blocks: list[tuple], lines: list[tuple], width: float, height: float) -> list[tuple]:
    """Tables by ruled lines; a text lies in the first cell that holds its centre."""
    out = []
    for xs, ys in lattices(lines):
        box = (xs[0], ys[0], xs[-1], ys[-1])
        if (box[2] - box[0]) * (box[3] - box[1]) < LEAST_AREA * width * height:
            continue
        cells = [[[] for _ in xs[1:]] for _ in ys[1:]]
        for text, x0, y0, x1, y1 in blocks:
            cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
            if CAPTION.match(" ".join(text.split())) or not (xs[0] <= cx <= xs[-1] and ys[0] <= cy <= ys[-1]):
                continue
            r, c = (next(i for i in range(len(p) - 1) if v <= p[i + 1]) for p, v in ((ys, cy), (xs, cx)))
            cells[r][c].append(text)
        texts = [[" ".join(c) for c in r] for r in cells]
        headers, rows, warnings = canonical(texts[0], texts[1:])
        reliable = len(rows) > 0 and all(c for r in texts for c in r) and not warnings
        out.append(("line", _caption(blocks, box) or f"Table {len(out) + 1}", *box, headers, rows, reliable, warnings if reliable else [*warnings, "table_structure_partial"]))
    return out


def _rows_of(blocks: list[tuple], near: float) -> list[list[tuple]]:
    rows: list[list[tuple]] = []
    for b in sorted(blocks, key=lambda b: (b[2], b[1])):
        if rows and abs(b[2] - rows[-1][0][2]) <= near:
            rows[-1].append(b)
        else:
            rows.append([b])
    return [sorted(r, key=lambda b: b[1]) for r in rows]


def _around(boxes: list[tuple]) -> tuple:
    return min(b[1] for b in boxes), min(b[2] for b in boxes), max(b[3] for b in boxes), max(b[4] for b in boxes)


def _geometric(caption: tuple, blocks: list[tuple], width: float) -> tuple | None:
    """Rows of as many cells as the first row of 2 to 10 short texts below a caption."""
    below = [b for b in blocks if caption[4] < b[2] <= caption[4] + BELOW and not CAPTION.match(" ".join(b[0].split()))]
    groups = _rows_of(below, SAME_ROW)
    at = next((i for i, g in enumerate(groups) if 2 <= len(g) <= 10 and all(0 < len(b[0]) <= 40 for b in g)), None)
    if at is None:
        return None
    head = groups[at]
    left, right = max(0.0, head[0][1] - 0.035 * width), min(width, head[-1][3] + 0.035 * width)
    rows: list[list[tuple]] = []
    for g in groups[at + 1 :]:
        cells = [b for b in g if left <= b[1] and b[3] <= right]
        if len(cells) != len(head):
            if rows:
                break
            continue
        if any(len(b[0]) > 60 for b in cells):
            break
        rows.append(cells)
    return ([b[0] for b in head], [[b[0] for b in r] for r in rows], [caption, *head, *(b for r in rows for b in r)]) if len(rows) >= 2 else None


def _piped(caption: tuple, blocks: list[tuple], width: float) -> tuple | None:
    """Blocks of text with pipes in a caption's column, all of one number of cells; three rows at least."""
    below = [b for b in blocks if 0 < b[2] - caption[4] <= BELOW and b[1] < caption[3] + 0.12 * width and b[3] > caption[1] - 0.02 * width and not CAPTION.match(" ".join(b[0].split()))]
    taken, n = [], 0
    for b in sorted(below, key=lambda b: (b[2], b[1])):
        lines = [x for x in map(str.strip, b[0].splitlines()) if "|" in x]
        if not lines:
            if taken:
                break
            continue
        wide = max(sum(bool(c.strip()) for c in x.split("|")) for x in lines)
        if wide < 2:
            continue
        if n and wide != n:
            break
        n = wide
        taken.append(b)
    if len(taken) < 2:
        return None
    rows = []
    for b in taken:
        cells = [c for c in map(str.strip, b[0].replace("\n", "|").split("|")) if c]
        rows += [cells[i : i + n] for i in range(0, len(cells) - n + 1, n)]
    return (rows[0], rows[1:], [caption, *taken]) if len(rows) >= 3 else None


def anchored(blocks: list[tuple], width: float) -> list[tuple]:
    """Tables below captions: by cells in rows, else by pipes; their headers have to be named and unlike."""
    out = []
    for caption in blocks:
        if not (m := CAPTION.match(" ".join(caption[0].split()))):
            continue
        for method, find in (("geometric", _geometric), ("pipe", _piped)):
            if found := find(caption, blocks, width):
                headers, rows, warnings = canonical(*found[:2])
                if not warnings and headers == [h.strip() for h in found[0]]:
                    out.append((method, f"Table {m[1]}", *_around(found[2]), headers, rows, True, []))
                    break
    return out


def aligned(blocks: list[tuple], width: float, height: float) -> list[tuple]:
    """Runs of two rows or more of two cells or more whose left sides agree; without a caption three rows of short, filled cells."""
    out, run = [], []
    rows = [r for r in _rows_of([b for b in blocks if not CAPTION.match(" ".join(b[0].split()))], NEAR_ROW)]
    for r in [*rows, []]:
        if run and len(r) == len(run[0]) and all(abs(a[1] - b[1]) <= NEAR_ROW for a, b in zip(r, run[0])):
            run.append(r)
            continue
        if len(run) >= 2:
            box = _around([b for x in run for b in x])
            texts = [[b[0].strip() for b in x] for x in run]
            label = _caption(blocks, box)
            full = all(c for x in texts for c in x)
            sure = full and len(run) >= 3 and max(len(c) for x in texts for c in x) <= 40
            if (label or sure) and (box[2] - box[0]) * (box[3] - box[1]) >= LEAST_AREA * width * height:
                headers, body, warnings = canonical(texts[0], texts[1:])
                good = full and not warnings
                out.append(("text", label or f"Table {len(out) + 1}", *box, headers, body, good, warnings if good else [*warnings, "table_structure_partial"]))
        run = [r] if len(r) >= 2 else []
    return out


def tables(pages: DataFrame, blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page, method, place, label, x0, y0, x1, y1, headers, rows, reliable, warnings of the tables of pages.

    pages: doc_id, page, width, height; blocks: text and box; lines: boxes of drawn lines. Pages with a table by
    `line` have no other; of the rest, those with one below a caption (`geometric` or `pipe`) have no other; `text` is
    asked for what is left.
    """
    sides = ("x0", "y0", "x1", "y1")
    part = lambda df, kind, text: df.select(*_PAGE, F.lit(kind).alias("kind"), text.alias("text"), *(F.col(s).cast("double").alias(s) for s in sides))
    rows = part(blocks.where("trim(coalesce(text, '')) <> ''"), "block", F.col("text")).unionByName(part(lines, "line", F.lit("")))
    rows = rows.join(pages.select(*_PAGE, F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")), _PAGE)
    number = lambda x: math.nan if x is None else x

    def step(key: tuple, here: list[dict]) -> list[tuple]:
        boxes: dict[str, list[tuple]] = {"block": [], "line": []}
        for r in here:
            boxes[r["kind"]].append((r["text"], *(number(r[s]) for s in sides)))
        texts, drawn = (sorted(b, key=lambda b: (b[2], b[1], b[0])) for b in boxes.values())
        width, height = number(here[0]["width"]), number(here[0]["height"])
        found = ruled(texts, [b[1:] for b in drawn], width, height) or anchored(texts, width) or aligned(texts, width, height)
        return [(*key, f[0], i, *f[1:]) for i, f in enumerate(found)]

    return by_group(rows.withColumns({c: F.col(c).cast("long") for c in _PAGE}), tuple(_PAGE), step, SCHEMA)
