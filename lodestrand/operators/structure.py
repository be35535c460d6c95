"""Page layout and document structure over block rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as tx
from lodestrand.operators.folds import by_group


def box(x0, y0, x1, y1) -> Column:
    """A bounding box as a struct of doubles."""
    return F.struct(*(c.cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))))


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared area of two boxes."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def union_box(b: Column) -> Column:
    """Smallest box around a group's boxes."""
    return F.struct(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))


def body_stats(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, font (the most characters; ties by name), median_size (weighted by characters).

    spans: key, font, size, chars. Partial sums by (key, font) and (key, size) first.
    """
    fonts = spans.groupBy(key, "font").agg(F.sum("chars").alias("n"))
    fonts = fonts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "font")).alias("f")).select(key, F.col("f.font").alias("font"))
    sizes = spans.groupBy(key, "size").agg(F.sum("chars").alias("n"))
    w = Window.partitionBy(key)
    sizes = sizes.withColumn("upto", F.sum("n").over(w.orderBy("size").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    median = sizes.where(F.col("upto") * 2 >= F.col("total")).groupBy(key).agg(F.min("size").alias("median_size"))
    return fonts.join(median, key)


def repeated_margins(lines: DataFrame, share: float = 0.6, key: str = "doc_id") -> DataFrame:
    """key, margin, pages: margin lines that stand on that share of a document's pages, and on two or more.

    lines: key, page, text of the top and bottom bands.
    """
    total = lines.groupBy(key).agg(F.count_distinct("page").alias("total"))
    by = lines.withColumn("margin", tx.margin_text(F.col("text"))).groupBy(key, "margin").agg(F.count_distinct("page").alias("pages"))
    return by.join(total, key).where((F.col("pages") > 1) & (F.col("pages") >= share * F.col("total"))).select(key, "margin", "pages")


def reading_order(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks (key, page, uid, x0, y0, x1, width) with reading_order from 0.

    Blocks over 60 % of the page's width span it and split it in bands; within a band the
    left column is read before the right one, each from top to bottom.
    """
    spanning = (F.col("x1") - F.col("x0")) > 0.6 * F.col("width")
    above = Window.partitionBy(key, "page").orderBy("y0", "uid").rowsBetween(Window.unboundedPreceding, 0)
    side = F.when(spanning, 0).when((F.col("x0") + F.col("x1")) / 2 < F.col("width") / 2, 1).otherwise(2)
    b = blocks.withColumn("band", F.sum(F.when(spanning, 1).otherwise(0)).over(above)).withColumn("side", side)
    order = Window.partitionBy(key).orderBy("page", "band", "side", "y0", "x0", "uid")
    return b.withColumn("reading_order", F.row_number().over(order) - 1).drop("band", "side")


def sections(blocks: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """Blocks (key, order, text, level) with the nearest heading of level 1 and of level 2 above; a new level 1 ends level 2."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    b = blocks.withColumn("section", F.last(F.when(F.col("level") == 1, F.col("text")), True).over(w)).withColumn("top", F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(w))
    v = Window.partitionBy(key, "top").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("subsection", F.last(F.when(F.col("level") == 2, F.col("text")), True).over(v)).drop("top")


def section_stack(blocks: DataFrame, key: str = "doc_id", order: str = "ord") -> DataFrame:
    """key, order, path: headings above each block at any depth, joined by ' > '.

    A heading closes those of its level and deeper. The stack depends on order, so a
    document, a bounded group, is one step; only its headings' texts go there.
    """

    def walk(at: tuple, rows: list[dict]) -> list[tuple]:
        stack: list[tuple[int, str]] = []
        out = []
        for r in sorted(rows, key=lambda r: r["ord"]):
            if r["level"] is not None and r["level"] == r["level"]:
                while stack and stack[-1][0] >= r["level"]:
                    stack.pop()
                stack.append((int(r["level"]), r["text"]))
            out.append((*at, r["ord"], " > ".join(t for _, t in stack)))
        return out

    slim = blocks.select(F.col(key).cast("long").alias("id"), F.col(order).cast("long").alias("ord"), F.col("level").cast("double").alias("level"), F.when(F.col("level").isNotNull(), F.col("text")).alias("text"))
    return by_group(slim, ("id",), walk, "id long, ord long, path string").select(F.col("id").alias(key), F.col("ord").alias(order), "path")


def islands(rows: DataFrame, value: str, *keys: str, order: str = "ord") -> DataFrame:
    """Runs of equal values: keys, value, island, first, last, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    r = rows.withColumn("__new", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1))
    r = r.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*keys, value, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def merged_intervals(rows: DataFrame, *keys: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Unions of overlapping or touching intervals: keys, lo, hi."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    r = rows.withColumn("__reach", F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("__i", F.sum(F.when(F.col("__reach").isNull() | (F.col(lo) > F.col("__reach")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*keys, "__i").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__i")


def neighbours(chunks: DataFrame, centres: DataFrame, before: int = 1, after: int = 1, key: str = "doc_id", order: tuple[str, ...] = ("page", "chunk_index")) -> DataFrame:
    """centre and the chunks up to so many places before and after it in its document."""
    w = Window.partitionBy(key).orderBy(*order, "chunk_id")
    placed = chunks.select(key, "chunk_id", F.row_number().over(w).alias("place"))
    mid = placed.join(centres.select(F.col("chunk_id").alias("chunk_id")).distinct(), "chunk_id", "left_semi").select(key, F.col("chunk_id").alias("centre"), F.explode(F.sequence(F.col("place") - before, F.col("place") + after)).alias("place"), F.col("place").alias("at"))
    return mid.join(placed, [key, "place"]).select("centre", "chunk_id", (F.col("place") - F.col("at")).alias("distance"))


def unique_targets(references: DataFrame, targets: DataFrame) -> DataFrame:
    """references (source, type, label) with target and status: resolved if exactly one target has the type and label."""
    one = targets.groupBy("type", "label").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"))
    j = references.join(one, ["type", "label"], "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    return j.select("source", "type", "label", F.when(n == 1, F.col("target")).alias("target"), F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved").alias("status"))


_PAGE = ("doc_id", "page")


def _near(captions_: DataFrame, regions: DataFrame, least: float) -> DataFrame:
    """Pairs of one page whose widths overlap by `least` of the narrower one: caption_id, region_id, ratio, apart, above (the region is), height."""
    c = captions_.select(*_PAGE, F.col("id").alias("caption_id"), *(F.col(k).alias(f"c{k}") for k in ("x0", "y0", "x1", "y1")))
    j = c.join(regions.withColumnRenamed("id", "region_id"), list(_PAGE))
    shared = F.least("cx1", "x1") - F.greatest("cx0", "x0")
    ratio = shared / F.least(F.col("cx1") - F.col("cx0"), F.col("x1") - F.col("x0"))
    apart = F.greatest(F.col("cy0") - F.col("y1"), F.col("y0") - F.col("cy1"), F.lit(0.0))
    return j.withColumn("ratio", ratio).withColumn("apart", apart).withColumn("above", F.col("y1") <= F.col("cy0")).where(F.col("ratio") >= least)


def captions(captions_: DataFrame, regions: DataFrame, gap: float = 96.0, least: float = 0.15) -> DataFrame:
    """doc_id, page, caption_id, region_id: for each caption the region of its page with the least vertical gap, then most overlap, then least id.

    Both: doc_id, page, id, x0, y0, x1, y1. Joined on the page; overlap is of the narrower width.
    """
    best = Window.partitionBy(*_PAGE, "caption_id").orderBy("apart", F.desc("ratio"), "region_id")
    j = _near(captions_, regions, least).where(F.col("apart") <= gap)
    return j.withColumn("n", F.row_number().over(best)).where("n = 1").select(*_PAGE, "caption_id", "region_id")


def greedy_captions(captions_: DataFrame, regions: DataFrame, gap: float = 96.0, share: float = 0.12, least: float = 0.15, bonus: float = 0.25) -> DataFrame:
    """doc_id, page, caption_id, region_id one to one: the pair of best score is taken first, then the next that is free.

    regions also have the page's height. A gap is at most `gap` and `share` of the height;
    the score is a bonus where the region stands above its caption, the overlap, less the
    gap's share of the height. Exclusive choice depends on earlier choices, so the
    candidate pairs of a page, which are few, are one call.
    """
    j = _near(captions_, regions, least).where(F.col("apart") <= F.least(F.lit(gap), share * F.col("height")))
    score = F.when(F.col("above"), bonus).otherwise(0.0) + F.col("ratio") - F.col("apart") / F.col("height")
    pairs = j.select(*_PAGE, "caption_id", "region_id", F.round(score, 9).alias("score"))

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        free, out = {"c": set(), "r": set()}, []
        for r in pdf.sort_values(["score", "caption_id", "region_id"], ascending=[False, True, True]).itertuples():
            if r.caption_id not in free["c"] and r.region_id not in free["r"]:
                free["c"].add(r.caption_id)
                free["r"].add(r.region_id)
                out.append((r.doc_id, r.page, r.caption_id, r.region_id))
        return pd.DataFrame(out, columns=["doc_id", "page", "caption_id", "region_id"])

    return pairs.groupBy(*_PAGE).applyInPandas(take, "doc_id long, page long, caption_id long, region_id long")


def cell_of(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """line_id and the first cell (page, row, col) that holds the line's centre point."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    l = lines.select("page", "line_id", cx.alias("cx"), cy.alias("cy"))
    j = l.join(cells, "page").where((F.col("cx") >= F.col("x0")) & (F.col("cx") <= F.col("x1")) & (F.col("cy") >= F.col("y0")) & (F.col("cy") <= F.col("y1")))
    return j.groupBy("page", "line_id").agg(F.min(F.struct("row", "col")).alias("c")).select("page", "line_id", "c.row", "c.col")
