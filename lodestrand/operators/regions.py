"""Boxes of pages against each other: spatial joins by grid cells, clusters of touching boxes, figures, equations.

Boxes are rows (doc_id, page, uid, x0, y0, x1, y1). A join deals both sides to the cells of a
grid that they cover and compares within a cell; a pair is taken in the one cell that holds
the top left corner of what the two share, so no pair comes twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand import runtime
from lodestrand.operators import layout as lay
from lodestrand.operators.folds import by_group

_PAGE = ("doc_id", "page")
_SIDES = ("x0", "y0", "x1", "y1")
#: Side of a grid cell, and the furthest coordinate that has cells of its own.
CELL, FAR = 128.0, 16_384.0
#: A label alone in its block, and one at the end of an expression. Fixed values.
ALONE = r"(?i)^\s*(?:(?:eq(?:uation)?\.?\s*)?\(([0-9]+)\)|(?:eq(?:uation)?\.?\s+)([0-9]+))\s*$"
AT_END = (r"(?:^|\n)\s*\(?([0-9]+)\)?\s*$", r"(?:ð|\()?([0-9]{1,3})(?:Þ|\))\s*$")


def _cell(x: Column) -> Column:
    return F.floor(F.least(F.greatest(x, F.lit(-FAR)), F.lit(FAR)) / CELL)


def _tiled(boxes: DataFrame, name: str, slack: float = 0.0) -> DataFrame:
    cols = [(F.col(s) + (slack if s[1] == "1" else -slack)).alias(f"{name}_{s}") for s in _SIDES]
    b = boxes.select(*_PAGE, F.col("uid").alias(f"{name}_uid"), *cols)
    span = lambda axis: F.explode(F.sequence(_cell(F.col(f"{name}_{axis}0")), _cell(F.col(f"{name}_{axis}1"))))
    well = (F.col(f"{name}_x0") <= F.col(f"{name}_x1")) & (F.col(f"{name}_y0") <= F.col(f"{name}_y1"))
    return b.where(well).withColumn("gx", span("x")).withColumn("gy", span("y"))


def meeting(a: DataFrame, b: DataFrame, slack: float = 0.0) -> DataFrame:
    """doc_id, page, a_uid, b_uid, common, and both boxes: pairs of a page that share a point, and the area that they share.

    slack widens the boxes of b on all sides. Boxes with a side of nothing meet others too;
    those whose sides are null or turned round meet none.
    """
    j = _tiled(a, "a").join(_tiled(b, "b", slack), [*_PAGE, "gx", "gy"])
    left, top = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    w, h = F.least("a_x1", "b_x1") - left, F.least("a_y1", "b_y1") - top
    once = (_cell(left) == F.col("gx")) & (_cell(top) == F.col("gy"))
    return j.where((w >= 0) & (h >= 0) & once).withColumn("common", w * h).drop("gx", "gy")


def _area(name: str) -> Column:
    return F.greatest((F.col(f"{name}_x1") - F.col(f"{name}_x0")) * (F.col(f"{name}_y1") - F.col(f"{name}_y0")), F.lit(1.0))


def within_regions(blocks: DataFrame, regions: DataFrame, least: float = 0.2) -> DataFrame:
    """doc_id, page, uid of the blocks of whose area a region covers at least a share."""
    found = meeting(blocks, regions).where((F.col("common") > 0) & (F.col("common") / _area("a") >= least))
    return found.select(*_PAGE, F.col("a_uid").alias("uid")).distinct()


def covered_share(boxes: DataFrame, by: DataFrame) -> DataFrame:
    """doc_id, page, uid, most, total: the greatest share of a box that one of `by` covers, and the sum of all shares."""
    share = F.col("common") / _area("a")
    return meeting(boxes, by).groupBy(*_PAGE, F.col("a_uid").alias("uid")).agg(F.max(share).alias("most"), F.sum(share).alias("total"))


def contained(inner: DataFrame, outer: DataFrame, slack: float = 1.0) -> DataFrame:
    """doc_id, page, inner_uid, outer_uid and both boxes, of boxes that lie in another, or over its edge by slack at most."""
    lies = (F.col("a_x0") >= F.col("b_x0")) & (F.col("a_x1") <= F.col("b_x1")) & (F.col("a_y0") >= F.col("b_y0")) & (F.col("a_y1") <= F.col("b_y1"))
    return meeting(inner, outer, slack).where(lies)


def touching(boxes: list[tuple], tolerance: float) -> list[tuple[tuple, list[int]]]:
    """Clusters of boxes (x0, y0, x1, y1) that touch within a tolerance, with their bounding boxes; boxes of clusters that touch are one cluster too."""
    groups = [(b, [i]) for i, b in enumerate(boxes)]
    while True:
        groups.sort(key=lambda g: g[0])
        root = list(range(len(groups)))

        def find(i: int) -> int:
            while root[i] != i:  # noqa: B023
                root[i] = i = root[root[i]]  # noqa: B023
            return i

        open_: list[int] = []
        for i, ((x0, y0, _, y1), _) in enumerate(groups):
            open_ = [j for j in open_ if groups[j][0][2] + tolerance >= x0]
            for j in open_:
                if groups[j][0][1] - tolerance <= y1 and y0 - tolerance <= groups[j][0][3]:
                    root[find(i)] = find(j)
            open_.append(i)
        made: dict[int, list] = {}
        for i, (b, members) in enumerate(groups):
            made.setdefault(find(i), []).append((b, members))
        if len(made) == len(groups):
            return groups
        groups = [(tuple(f(b[k] for b, _ in g) for k, f in enumerate((min, min, max, max))), sum((m for _, m in g), [])) for g in made.values()]


def clusters(drawings: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """doc_id, page, uid, x0, y0, x1, y1, n of clusters of touching drawings with sides over the tolerance; a page's drawings are one step."""

    def step(key: tuple, rows: list[dict]) -> list[tuple]:
        boxes = [b for b in (tuple(r[s] for s in _SIDES) for r in rows) if all(x is not None and x == x for x in b)]
        found = sorted((b, len(m)) for b, m in touching(boxes, tolerance) if b[2] - b[0] > tolerance and b[3] - b[1] > tolerance)
        return [(*key, f"v{i}", *b, n) for i, (b, n) in enumerate(found)]

    slim = drawings.select(F.col("doc_id").cast("long"), F.col("page").cast("long"), *(F.col(s).cast("double") for s in _SIDES))
    return by_group(slim, _PAGE, step, "doc_id long, page long, uid string, x0 double, y0 double, x1 double, y1 double, n long")


def gridded(boxes: DataFrame, drawings: DataFrame) -> DataFrame:
    """doc_id, page, uid of boxes that are ruled: two level and two upright lines in them, each half as long as the box and 20 points."""
    w, h = F.col("a_x1") - F.col("a_x0"), F.col("a_y1") - F.col("a_y0")
    slack = 2.0  # the outer boxes of contained() come widened by 1 on each side
    level = (w >= F.greatest(F.lit(20.0), 0.5 * (F.col("b_x1") - F.col("b_x0") - slack))) & (h <= 1.5)
    upright = (h >= F.greatest(F.lit(20.0), 0.5 * (F.col("b_y1") - F.col("b_y0") - slack))) & (w <= 1.5) & ~level
    n = contained(drawings, boxes).groupBy(*_PAGE, F.col("b_uid").alias("uid")).agg(F.count_if(level).alias("level"), F.count_if(upright).alias("upright"))
    return n.where("level >= 2 AND upright >= 2").select(*_PAGE, "uid")


def figures(images: DataFrame, drawings: DataFrame, blocks: DataFrame, pages: DataFrame, least: float = 0.01) -> DataFrame:
    """doc_id, page, place, y0, x0, x1, y1, kind of what may be figures.

    images also have ord, xref and a signature, blocks a kind, pages width and height. An
    image that a page shows twice counts once, and so does one of a signature in its top or
    bottom 12 %. Clusters of drawings count unless they are ruled. Boxes of less than `least` or
    more than 0.9 of the page, or with a side of 2 points, go; so do those of which a table
    (or its caption) covers 0.45, and clusters of which texts cover 0.55 in all. What is left is merged.
    """
    size = pages.select(*_PAGE, "width", "height")
    seen = Window.partitionBy(*_PAGE, "xref").orderBy("ord")
    i = images.withColumn("n", F.when(F.col("xref").isNull(), 1).otherwise(F.row_number().over(seen))).where("n = 1").join(size, list(_PAGE))
    edge = (F.col("y0") <= 0.12 * F.col("height")) | (F.col("y1") >= 0.88 * F.col("height"))
    signed = Window.partitionBy(*_PAGE, "edge", "signature").orderBy("ord")
    raster = i.withColumn("edge", edge).withColumn("m", F.row_number().over(signed)).where("NOT edge OR m = 1").select(*_PAGE, F.concat(F.lit("r"), "ord").alias("uid"), *_SIDES, F.lit("raster").alias("kind"))
    # Both are read several times, and each time would cluster the drawings anew.
    with runtime.lifetime(images.sparkSession) as keep:
        drawn = runtime.materialize(clusters(drawings), "drawn")
        sized = runtime.materialize(_sized(raster, drawn, drawings, size, least), "sized")
        keep(sized)
    tables = covered_share(sized, blocks.where(F.lower("kind").isin("table", "table_caption"))).where("most >= 0.45").select(*_PAGE, "uid")
    texts = covered_share(sized.where("kind = 'vector'"), blocks).where("total >= 0.55").select(*_PAGE, "uid")
    kept = sized.join(tables, [*_PAGE, "uid"], "left_anti").join(texts, [*_PAGE, "uid"], "left_anti")
    return lay.merged_figures(kept.select(*_PAGE, "y0", "x0", "kind", "x1", "y1", F.greatest("width", "height").alias("side")))


def _sized(raster: DataFrame, drawn: DataFrame, drawings: DataFrame, size: DataFrame, least: float) -> DataFrame:
    """Images and clusters of drawings that are not ruled, of a size that figures have."""
    vector = drawn.join(gridded(drawn, drawings), [*_PAGE, "uid"], "left_anti").select(*_PAGE, "uid", *_SIDES, F.lit("vector").alias("kind"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    page = F.col("width") * F.col("height")
    return raster.unionByName(vector).join(size, list(_PAGE)).where((w > 2) & (h > 2) & (w * h >= least * page) & (w * h <= 0.9 * page))


def equations(expressions: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, uid, equation_id, raw, latex, context, status, warnings, sources, x0, y0, x1, y1 of each equation.

    expressions (blocks whose text is mathematics) one below the other are one. blocks (with
    text and section) are all of the page; those that are a label alone name the nearest
    expression to their left, and an expression without one may end in its number, which then is no
    part of it. The box takes in the label, or 60 points to the right, up to the page's
    width (pages), for a number at its end. Plain ASCII without a question mark counts as
    LaTeX; anything else is partial. sources are the blocks that lie in the expression.
    """
    number = lambda c: F.coalesce(*(F.nullif(F.regexp_extract(c, ALONE, k), F.lit("")) for k in (1, 2)))
    # Both are read several times, and each time would look through all blocks anew.
    with runtime.lifetime(blocks.sparkSession) as keep:
        labels = runtime.materialize(blocks.select(*_PAGE, "uid", number(F.col("text")).alias("number"), *_SIDES).where("number IS NOT NULL"), "labels")
        e = runtime.materialize(_expressions(expressions, labels, pages), "expressions")
        keep(labels, e)
    latex = F.when(F.col("raw").rlike(r"^[\x00-\x7F]*$") & ~F.contains("raw", F.lit("?")) & (F.col("raw") != ""), F.col("raw"))
    taken = labels.select(*_PAGE, "uid").unionByName(expressions.select(*_PAGE, "uid"))
    texts = blocks.where(F.trim("text") != "").join(taken, [*_PAGE, "uid"], "left_anti")
    near = lay.equation_context(e.select(*_PAGE, "uid", "y0", "y1", F.lit(None).cast("string").alias("section")), texts)
    own = contained(blocks, e).groupBy(*_PAGE, F.col("b_uid").alias("uid")).agg(F.sort_array(F.collect_set("a_uid")).alias("sources"))
    box = {"x0": F.least("x0", "lx0"), "y0": F.least("y0", "ly0"), "y1": F.greatest("y1", "ly1"), "x1": F.when(F.col("inline").isNotNull(), F.least("width", F.col("x1") + 60)).otherwise(F.greatest("x1", "lx1"))}
    e = e.select(*_PAGE, "uid", F.concat(F.lit("Eq. "), F.coalesce("number", "inline")).alias("equation_id"), "raw", latex.alias("latex"), *(c.alias(s) for s, c in box.items()))
    out = e.join(near, [*_PAGE, "uid"], "left").join(own, [*_PAGE, "uid"], "left")
    good = F.col("latex").isNotNull()
    return out.select(
        *_PAGE, "uid", "equation_id", "raw", "latex", F.coalesce("context", F.lit("")).alias("context"), F.when(good, "success").otherwise("partial").alias("status"),
        F.when(good, F.array().cast("array<string>")).otherwise(F.array(F.lit("latex_unreliable"))).alias("warnings"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), *_SIDES,
    )


def _expressions(expressions: DataFrame, labels: DataFrame, pages: DataFrame) -> DataFrame:
    """Expressions that are no label, joined one below the other, with their label or the number at their end, and what is left of the text."""
    lone = expressions.join(labels.select(*_PAGE, "uid"), [*_PAGE, "uid"], "left_anti")
    e = lay.merged_expressions(lone.select(*_PAGE, "y0", "x0", "x1", "y1", "text")).withColumn("uid", F.format_string("e%04d", "place"))
    named = lay.equation_labels(e, labels).join(labels.select(*_PAGE, F.col("uid").alias("label_uid"), "number", *(F.col(s).alias(f"l{s}") for s in _SIDES)), [*_PAGE, "label_uid"])
    e = e.join(named, [*_PAGE, "uid"], "left").join(pages.select(*_PAGE, "width"), list(_PAGE))
    ends = [F.when(F.col("text").rlike(p), F.regexp_extract("text", p, 1)) for p in AT_END]
    inline = F.when(F.col("number").isNull(), F.coalesce(*ends))
    cut = F.when(F.col("number").isNotNull(), F.col("text")).when(ends[0].isNotNull(), F.trim(F.regexp_replace("text", AT_END[0], ""))).when(ends[1].isNotNull(), F.trim(F.regexp_replace("text", AT_END[1], ""))).otherwise(F.col("text"))
    return e.withColumn("inline", inline).withColumn("raw", F.regexp_replace(cut, r"^\s+|\s+$", ""))
