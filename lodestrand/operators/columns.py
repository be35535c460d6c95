"""One or two columns of a page, from the white space that its blocks leave around the centre.

A page is cut in bands at the edges of its blocks; in each band the free stretches between
blocks near the centre are gaps. Gaps of like position are one gutter, weighed by the height
of their bands. The best gutter makes two columns if both sides have text enough, next to
each other. A page's blocks are few, so each page is one step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.folds import by_group

# Fixed values, as shares of the page's width or height, of text, or of each other.
WIDEST_BLOCK, LEAST_GAP, OFF_CENTRE, ONE_GUTTER, EDGE = 0.65, 0.04, 0.15, 0.04, 0.01
LEAST_SUPPORT, LEAST_SHARED, LEAST_TEXT, LEAST_SIDE, WIDE_GAP, TALL_GAP = 0.03, 0.2, 0.2, 0.18, 0.12, 0.18


def _union(spans: list[tuple[float, float]]) -> list[list[float]]:
    out: list[list[float]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def union(spans: np.ndarray) -> np.ndarray:
    """Rows (lo, hi) of overlapping or touching intervals as one row each, in order."""
    return np.array(_union(spans.tolist())).reshape(-1, 2)


def shared_length(a: np.ndarray, b: np.ndarray) -> float:
    """Length that two unions of intervals have in common."""
    lo, hi = np.maximum(a[:, None, 0], b[None, :, 0]), np.minimum(a[:, None, 1], b[None, :, 1])
    return float(np.clip(hi - lo, 0, None).sum())


def gaps(boxes: np.ndarray, width: float, height: float) -> np.ndarray:
    """Rows (left, right, support) of free stretches near the centre of each band of boxes (x0, y0, x1, y1)."""
    # Plain Python: a band holds a few boxes, for which a call of numpy costs more than they do.
    inside = lambda v, most: min(max(v, 0.0), most)
    rows = [(y0, y1, inside(x0, width), inside(x1, width)) for x0, y0, x1, y1 in boxes.tolist()]
    edges = sorted({inside(y, height) for r in rows for y in r[:2]})
    out = []
    for lo, hi in zip(edges, edges[1:]):
        spans = _union([(x0, x1) for y0, y1, x0, x1 in rows if y0 < hi and y1 > lo and x0 < x1])
        for (_, left), (right, _) in zip(spans, spans[1:]):
            if right - left >= LEAST_GAP * width and abs((left + right) / 2 - width / 2) <= OFF_CENTRE * width:
                out.append((left, right, hi - lo))
    return np.array(out).reshape(-1, 3)


def gutter(samples: np.ndarray, width: float) -> tuple[float, float, float] | None:
    """left, right, support of the gutter of most support, then width, then nearness to the centre, then the left.

    A gap joins the nearest gutter whose weighted middle lies within ONE_GUTTER of its own, from left to right.
    """
    found: list[np.ndarray] = []  # sums of (left, right, 1) weighted by support
    for left, right, support in sorted(map(tuple, samples), key=lambda s: ((s[0] + s[1]) / 2, *s)):
        middle = (left + right) / 2
        apart = [abs(middle - (g[0] + g[1]) / (2 * g[2])) for g in found]
        best = min(range(len(found)), key=apart.__getitem__, default=None)
        add = np.array([left * support, right * support, support])
        if best is not None and apart[best] <= ONE_GUTTER * width:
            found[best] = found[best] + add
        else:
            found.append(add)
    if not found:
        return None
    lines = [(g[0] / g[2], g[1] / g[2], g[2]) for g in found]
    return max(lines, key=lambda g: (g[2], g[1] - g[0], -abs((g[0] + g[1]) / 2 - width / 2), -g[0]))


def diagnose(boxes: np.ndarray, chars: np.ndarray, width: float, height: float) -> tuple[int, float | None, float | None, float, str]:
    """columns, gutter's left and right, confidence, reason of a page."""
    one = lambda why: (1, None, None, 1.0, why)
    if not (np.isfinite(width) and np.isfinite(height) and width > 0 and height > 0):
        return one("invalid_page_geometry")
    size = boxes[:, 2:] - boxes[:, :2]
    use = (chars > 0) & (size > 0).all(1) & (size[:, 0] < WIDEST_BLOCK * width)
    boxes, chars = boxes[use], chars[use]
    if not len(boxes):
        return one("no_column_candidates")
    best = gutter(gaps(boxes, width, height), width)
    tall = lambda rows: union(np.clip(rows[:, [1, 3]], 0, height))
    if best is None:
        sides = [boxes[boxes[:, 2] <= width / 2], boxes[boxes[:, 0] >= width / 2]]
        apart = all(len(s) >= 2 for s in sides) and shared_length(*map(tall, sides)) < LEAST_SUPPORT * height
        return one("insufficient_vertical_overlap" if apart else "no_stable_center_gap")
    left, right, support = best
    on = [boxes[:, 2] <= left + EDGE * width, boxes[:, 0] >= right - EDGE * width]
    if not on[0].any() or not on[1].any():
        return one("insufficient_bilateral_coverage")
    if support < LEAST_SUPPORT * height:
        return one("no_stable_center_gap")
    spans = [tall(boxes[s]) for s in on]
    lengths = [float((s[:, 1] - s[:, 0]).sum()) for s in spans]
    common = shared_length(*spans)
    if common < LEAST_SUPPORT * height or min(lengths) == 0 or common < LEAST_SHARED * min(lengths):
        return one("insufficient_vertical_overlap")
    text = [int(chars[s].sum()) for s in on]
    if min(text) < LEAST_TEXT * sum(text):
        return one("insufficient_bilateral_coverage")
    if min(lengths) < LEAST_SIDE * height:
        return one("insufficient_side_coverage")
    scores = (2 * min(text) / sum(text), (right - left) / (WIDE_GAP * width), support / (TALL_GAP * height))
    return 2, left, right, round(sum(min(1.0, s) for s in scores) / 3, 3), "stable_center_gap"


def page_columns(blocks: DataFrame) -> DataFrame:
    """doc_id, page, columns, gutter_left, gutter_right, confidence, reason of pages of blocks (doc_id, page, text, x0, y0, x1, y1, width, height)."""

    def step(key: tuple, rows: list[dict]) -> list[tuple]:
        boxes = np.array([[r[c] for c in ("x0", "y0", "x1", "y1")] for r in rows], float)
        width, height = np.array([rows[0]["width"], rows[0]["height"]], float)  # null: not a number
        return [(*key, *diagnose(boxes, np.array([r["chars"] for r in rows]), width, height))]

    chars = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", ""))
    box = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "width", "height")]
    slim = blocks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), chars.alias("chars"), *box)
    return by_group(slim, ("doc_id", "page"), step, "doc_id long, page long, columns long, gutter_left double, gutter_right double, confidence double, reason string")
