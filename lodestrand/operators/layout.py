"""Figures, equations, tables and margins from block rows of pages: (doc_id, page, uid, ord, text, x0, y0, x1, y1)."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as tx
from lodestrand.operators.folds import by_group

# Verbs that make a line with a full stop a sentence, and the label of an equation.
SENTENCE_VERBS = tuple("are be can contains demonstrates does explores has have indicates is may provides shows study studies uses was were will works".split())
LABEL_PATTERN = r"^\s*\(\s*[0-9]+(?:\.[0-9]+)*[a-z]?\s*\)\s*$"
_PAGE = ("doc_id", "page")


def sentence_like(column: Column) -> Column:
    """Whether a line reads as a sentence: it ends like one and is long or has a verb, or it is long and has a comma."""
    line = tx.squeeze(column)
    body = F.regexp_replace(line, r"^(?:[0-9]+(?:\.[0-9]+)*\.?|[IVXLCDM]+\.)\s+(?=\S)", "")
    words = F.transform(F.regexp_extract_all(body, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.lower)
    ended = body.rlike(r"[.!?。！？;；:]\s*$") & ((F.size(words) >= 5) | (F.length(body) >= 28) | F.arrays_overlap(words, F.array(*(F.lit(v) for v in SENTENCE_VERBS))))
    return F.coalesce((line != "") & (ended | ((F.size(words) >= 12) & body.rlike("[,;，；]"))), F.lit(False))


def inferred_margins(blocks: DataFrame) -> DataFrame:
    """doc_id, page, uid, kind: headers and footers by repetition alone.

    A block in the top or bottom tenth of its page, whose height is that of its lowest block,
    is one if its text stands there on 60 % of the document's pages.
    """
    height = F.max("y1").over(Window.partitionBy(*_PAGE))
    b = blocks.withColumn("height", height).withColumn("margin", tx.margin_text(F.col("text")))
    kind = F.when(F.col("y0") <= 0.1 * F.col("height"), "header").when(F.col("y1") >= 0.9 * F.col("height"), "footer")
    b = b.where("height > 0 AND margin <> ''").withColumn("kind", kind).where("kind IS NOT NULL")
    pages = blocks.groupBy("doc_id").agg(F.greatest(F.lit(1), F.ceil(0.6 * F.count_distinct("page"))).alias("least"))
    seen = b.groupBy("doc_id", "kind", "margin").agg(F.count_distinct("page").alias("pages")).join(pages, "doc_id").where(F.col("pages") >= F.col("least")).select("doc_id", "kind", "margin")
    return b.join(seen, ["doc_id", "kind", "margin"]).select(*_PAGE, "uid", "kind")


def _folded(rows: DataFrame, step, *columns: str) -> DataFrame:
    """Rows of a page, sorted by the columns, folded one after another into a list; a page's rows are few."""
    item = F.struct(*columns)
    by = rows.groupBy(*_PAGE).agg(F.sort_array(F.collect_list(item)).alias("rows"), F.slice(F.collect_list(item), 1, 0).alias("none"))
    return by.select(*_PAGE, F.posexplode(F.aggregate("rows", F.col("none"), step)).alias("place", "x")).select(*_PAGE, "place", "x.*")


def merged_expressions(blocks: DataFrame, gap: float = 12.0) -> DataFrame:
    """doc_id, page, place, y0, x0, x1, y1, text: expressions one below the other, in one column and near, as one with a line each."""

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        near = (F.abs(last["x0"] - x["x0"]) <= gap) & (x["y0"] - last["y1"]).between(0, gap)
        both = F.struct(
            F.least(last["y0"], x["y0"]).alias("y0"), F.least(last["x0"], x["x0"]).alias("x0"), F.greatest(last["x1"], x["x1"]).alias("x1"),
            F.greatest(last["y1"], x["y1"]).alias("y1"), F.concat_ws("\n", last["text"], x["text"]).alias("text"),
        )
        joined = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(both))
        return F.when((F.size(kept) > 0) & near, joined).otherwise(F.concat(kept, F.array(x)))

    return _folded(blocks, step, "y0", "x0", "x1", "y1", "text")


def merged_figures(candidates: DataFrame, share: float = 0.55, touch: float = 0.025) -> DataFrame:
    """doc_id, page, place, y0, x0, x1, y1, kind: candidates joined with the first kept one that they overlap.

    An overlap counts from `share` of the smaller area, or, with boxes that meet, within
    `touch` of the page's longer side. candidates also have kind and side, that longer side.
    Each is looked at once, from the top; a raster stays one.
    """
    area = lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])

    def meets(a: Column, b: Column) -> Column:
        w, h = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
        common = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
        smaller = F.greatest(F.least(area(a), area(b)), F.lit(1.0))
        return (common / smaller >= share) | ((common > 0) & (F.greatest(-w, -h) <= touch * a["side"]))

    def step(kept: Column, x: Column) -> Column:
        at = F.aggregate(F.transform(kept, lambda k, i: F.when(meets(x, k), i)), F.lit(None).cast("int"), lambda s, i: F.coalesce(s, i))
        both = lambda k: F.struct(
            F.least(k["y0"], x["y0"]).alias("y0"), F.least(k["x0"], x["x0"]).alias("x0"), k["kind"].alias("kind"), F.greatest(k["x1"], x["x1"]).alias("x1"), F.greatest(k["y1"], x["y1"]).alias("y1"), k["side"].alias("side")
        )
        return F.when(at.isNull(), F.concat(kept, F.array(x))).otherwise(F.transform(kept, lambda k, i: F.when(i == at, both(k)).otherwise(k)))

    return _folded(candidates, step, "y0", "x0", "kind", "x1", "y1", "side").drop("side")


def figure_candidates(regions: DataFrame, least: float = 0.01, most: float = 0.9, side: float = 2.0) -> DataFrame:
    """Image regions (doc_id, page, uid, xref, x0, y0, x1, y1, width, height) that may be figures.

    Regions of an odd share of the page or with a side of 2 points or less go, so do those
    whose image stands at the same place on three pages or more; of one image on a page the
    first stays.
    """
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    share = w * h / (F.col("width") * F.col("height"))
    kept = regions.where((w > side) & (h > side) & (share >= least) & (share <= most))
    place = [F.round(c, 0).alias(f"p{i}") for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    marked = kept.select("*", *place)
    repeated = marked.groupBy("doc_id", "xref", "p0", "p1", "p2", "p3").agg(F.count_distinct("page").alias("pages")).where("pages >= 3").drop("pages")
    own = marked.join(repeated, ["doc_id", "xref", "p0", "p1", "p2", "p3"], "left_anti")
    first = Window.partitionBy(*_PAGE, "xref").orderBy("y0", "x0", "uid")
    return own.withColumn("n", F.row_number().over(first)).where("n = 1").select(*_PAGE, "uid", "xref")


def equation_labels(expressions: DataFrame, labels: DataFrame, gap: float = 120.0) -> DataFrame:
    """doc_id, page, uid, label_uid: each expression, from the top, with the nearest free label to its right on its line.

    A label is taken once, so a page's candidate pairs, which are few, are one step.
    """
    l = labels.select(*_PAGE, F.col("uid").alias("label_uid"), *(F.col(k).alias(f"l{k}") for k in ("x0", "y0", "x1", "y1")))
    j = expressions.join(l, list(_PAGE)).where(F.col("uid") != F.col("label_uid"))
    tall = F.greatest(F.col("y1") - F.col("y0"), F.col("ly1") - F.col("ly0"))
    apart = F.greatest(F.lit(0.0), F.col("lx0") - F.col("x1"), F.col("x0") - F.col("lx1"))
    pairs = j.withColumn("apart", apart).where((F.col("lx0") >= F.col("x1") - 5) & (F.abs(F.col("ly0") - F.col("y0")) <= 1.5 * tall) & (F.col("apart") <= gap))

    def take(page: tuple, rows: list[dict]) -> list[tuple]:
        used: dict[str, tuple] = {}
        done = set()
        for r in sorted((r for r in rows if r["x0"] is not None), key=lambda r: (r["y0"], r["x0"], r["uid"], r["apart"], r["label_uid"])):
            own = (r["y0"], r["x0"], r["uid"])
            if own not in done and r["label_uid"] not in used:
                done.add(own)
                used[r["label_uid"]] = (*page, r["uid"], r["label_uid"])
        return list(used.values())

    return by_group(pairs.select(*_PAGE, "uid", "label_uid", "y0", "x0", "apart"), _PAGE, take, "doc_id long, page long, uid string, label_uid string")


def equation_context(expressions: DataFrame, texts: DataFrame, reach: float = 140.0, n: int = 2) -> DataFrame:
    """doc_id, page, uid, context: the nearest texts above or below each expression, of its section if both have one."""
    t = texts.select(*_PAGE, F.col("uid").alias("t_uid"), F.col("text").alias("t_text"), F.col("section").alias("t_section"), F.col("y0").alias("ty0"), F.col("y1").alias("ty1"))
    j = expressions.join(t, list(_PAGE)).where(F.col("uid") != F.col("t_uid")).where(F.col("section").isNull() | F.col("t_section").isNull() | (F.col("section") == F.col("t_section")))
    apart = F.when(F.col("ty1") <= F.col("y0"), F.col("y0") - F.col("ty1")).when(F.col("ty0") >= F.col("y1"), F.col("ty0") - F.col("y1"))
    near = j.withColumn("apart", apart).where((F.col("apart") <= reach) & (F.trim("t_text") != ""))
    w = Window.partitionBy(*_PAGE, "uid").orderBy("apart", "t_uid")
    best = near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "t_text"))), lambda x: x["t_text"]), " ")
    return best.groupBy(*_PAGE, "uid").agg(said.alias("context"))


def grid_bounds(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, page, table_id, xs, ys: cell borders from drawn lines inside a table's box, thin and at least half as long as it."""
    g = tables.select(*_PAGE, "table_id", *(F.col(k).alias(f"t{k}") for k in ("x0", "y0", "x1", "y1")))
    j = g.join(lines, list(_PAGE), "left")
    inside = (F.col("x0") >= F.col("tx0") - 1) & (F.col("x1") <= F.col("tx1") + 1) & (F.col("y0") >= F.col("ty0") - 1) & (F.col("y1") <= F.col("ty1") + 1)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    upright = inside & (w <= 1.5) & (h >= 0.5 * (F.col("ty1") - F.col("ty0")))
    level = inside & ~((w <= 1.5) & (h >= 0.5 * (F.col("ty1") - F.col("ty0")))) & (h <= 1.5) & (w >= 0.5 * (F.col("tx1") - F.col("tx0")))
    borders = lambda cond, at, lo, hi: F.sort_array(F.array_distinct(F.concat(F.collect_set(F.when(cond, F.round(at, 3))), F.array(F.first(lo), F.first(hi)))))
    return j.groupBy(*_PAGE, "table_id").agg(borders(upright, "x0", "tx0", "tx1").alias("xs"), borders(level, "y0", "ty0", "ty1").alias("ys"))


def reliable_grid(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """doc_id, page, table_id, reliable: a grid of two columns and two rows at least whose cells (row, col, text) are all filled."""
    filled = cells.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy(*_PAGE, "table_id").agg(F.count_distinct("row", "col").alias("filled"))
    j = bounds.join(filled, [*_PAGE, "table_id"], "left")
    columns, rows = F.size("xs") - 1, F.size("ys") - 1
    return j.select(*_PAGE, "table_id", ((columns >= 2) & (rows >= 2) & (F.coalesce("filled", F.lit(0)) == columns * rows)).alias("reliable"))


def captioned_tables(blocks: DataFrame, captions: DataFrame, reach: float = 180.0) -> DataFrame:
    """doc_id, page, caption_uid, row, cells: rows of short texts under a caption that line up with its first row of 2 to 10.

    Rows are texts whose tops lie within 2.5; the table ends at the first row, after one that
    fits, of another width or with a text over 60 characters; fewer than two rows are none.
    A caption's blocks, which are few, are one step.
    """
    c = captions.select(*_PAGE, F.col("uid").alias("caption_uid"), F.col("y1").alias("cy1"))
    j = blocks.join(c, list(_PAGE)).where((F.col("y0") > F.col("cy1")) & (F.col("y0") - F.col("cy1") <= reach))

    def read(at: tuple, found: list[dict]) -> list[tuple]:
        blocks_ = [SimpleNamespace(**r) for r in found]
        head = blocks_[0]
        lines: list[list] = []
        left = lambda r: (True, 0.0) if r.x0 != r.x0 else (False, r.x0)
        for r in sorted(blocks_, key=lambda r: (r.y0, left(r), r.uid)):
            if lines and abs(r.y0 - lines[-1][0].y0) <= 2.5:
                lines[-1].append(r)
            else:
                lines.append([r])
        lines = [sorted(x, key=lambda r: (left(r), r.uid)) for x in lines]
        first = next((i for i, x in enumerate(lines) if 2 <= len(x) <= 10 and all(0 < len(r.text) <= 40 for r in x)), None)
        rows: list[list[str]] = []
        if first is not None:
            top = lines[first]
            lo, hi = max(0.0, top[0].x0 - 0.035 * head.width), min(head.width, top[-1].x1 + 0.035 * head.width)
            for x in lines[first + 1 :]:
                cells = [r for r in x if lo <= r.x0 and r.x1 <= hi]
                if len(cells) != len(top):
                    if rows:
                        break
                    continue
                if any(len(r.text) > 60 for r in cells):
                    break
                rows.append([r.text for r in cells])
            rows = [[r.text for r in top], *rows] if len(rows) >= 2 else []
        return [(*at, i, x) for i, x in enumerate(rows)]

    slim = j.select(*_PAGE, "caption_uid", "uid", "text", "y0", *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in ("x0", "x1", "width")))
    return by_group(slim, (*_PAGE, "caption_uid"), read, "doc_id long, page long, caption_uid string, row long, cells array<string>")


def text_rows(blocks: DataFrame) -> DataFrame:
    """doc_id, page, uid, line_no, source_index, text: the lines of each block, with the block's place in its page."""
    source = F.row_number().over(Window.partitionBy(*_PAGE).orderBy("ord")) - 1
    each = blocks.withColumn("source_index", source).select(*_PAGE, "uid", "source_index", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("line_no", "text"))
    return each.where(F.trim("text") != "")


def described(column: Column, n: int = 20, chars: int = 300) -> Column:
    """A figure's descriptions: squeezed, bounded, each once, the first n."""
    short = F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: tx.bounded(x, chars))
    return F.slice(F.array_distinct(F.filter(short, lambda x: x != "")), 1, n)


def figure_warnings(figures: DataFrame) -> DataFrame:
    """uid, status, codes of figure elements (uid, caption, image_path, width, height, text_share)."""
    codes = F.filter(
        F.array(
            F.when(F.trim(F.coalesce("caption", F.lit(""))) == "", "missing_caption"), F.when(F.col("image_path").isNull(), "missing_image"),
            F.when((F.col("width") < 20) | (F.col("height") < 20), "small_figure"), F.when(F.col("text_share") > 0.6, "text_dominated"),
        ), lambda x: x.isNotNull(),
    )
    return figures.select("uid", codes.alias("codes")).select("uid", F.when(F.array_contains("codes", "missing_caption"), "partial").otherwise("success").alias("status"), "codes")


def flat_content(raw: Column) -> Column:
    """The text of a nested content item: the first of its usual keys; lists by lines, inline formulas between dollar signs."""
    item = F.try_parse_json(raw)
    of = lambda path: F.try_variant_get(item, path, "string")
    parts = F.from_json(F.get_json_object(raw, "$.content"), "array<struct<type:string,content:string>>")
    inline = F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "inline_equation", F.concat(F.lit("$"), p["content"], F.lit("$"))).otherwise(p["content"])), " ")
    listed = F.array_join(F.from_json(F.get_json_object(raw, "$.list_items"), "array<string>"), "\n")
    plain = F.when(F.schema_of_variant(F.try_variant_get(item, "$.content", "variant")) == "STRING", of("$.content"))
    return F.trim(F.coalesce(of("$.text"), of("$.latex"), plain, F.when(F.size(parts) > 0, inline), F.nullif(listed, F.lit("")), F.lit("")))


def enriched_chunks(figures: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks to update (chunk_id, content) and to add (uid, content) for described figures (uid, content)."""
    j = figures.where(F.trim("content") != "").join(chunks.select("uid", "chunk_id"), "uid", "left")
    return j.where("chunk_id IS NOT NULL").select("chunk_id", "content"), j.where("chunk_id IS NULL").select("uid", "content")


# Labels of sections without numbers, and the shapes of captions, lists, citations and formulas.
HEADING_WORDS = ("introduction", "related work", "background", "method", "methods", "methodology", "experiments", "results", "discussion", "conclusion", "conclusions", "acknowledgements", "references", "appendix")
CAPTION_SHAPE = r"(?i)^(fig(?:ure)?|tab(?:le)?)\.?\s*(?:[0-9]+|[IVXLCDM]+)"
NUMBERED_LIST_SHAPE = r"^(?:\([0-9]+\)|[0-9]+\)|[a-z]\))\s+"
BULLET_SHAPE = r"^[•\-*]\s"
CITATION_SHAPE = r"^\[[0-9]+\]\s"
AUTHOR_YEAR_SHAPE = r"\((?:19|20)[0-9]{2}[a-z]?\)"
FORMULA_SHAPE = r"[=∑∫≤≥]"
AUTHOR_SHAPE = r"^[^0-9.!?]+(?:,|\band\b)[^0-9.!?]+$"


def block_kinds(blocks: DataFrame) -> DataFrame:
    """uid, kind, confidence, reason of blocks: one of 17 kinds, by the first rule that holds.

    blocks: uid, text, size and body_size of its type, bold, lines, top and bottom as shares of
    the page, centred, margin (header, footer or null), region (figure, table, equation or
    null), first_page, title_like, author_like, in_references.
    """
    t, rank = tx.squeeze(F.col("text")), F.col("size") / F.col("body_size")
    b = blocks.withColumn("t", t).withColumn("rank", rank).withColumn("sentence", sentence_like(F.col("text"))).withColumn("depth", tx.heading_depth(F.col("text")))
    t, label, chars = F.col("t"), F.regexp_replace(F.lower("t"), r"[ :;.\-]+$", ""), F.length("t")
    plain, first = ~F.col("sentence"), F.col("first_page")
    bonus = F.when(F.col("centred"), 0.07).otherwise(0.0)
    caption = F.lower(F.regexp_extract(t, CAPTION_SHAPE, 1))
    cells = F.size(F.split(t, r"\s*\|\s*")) >= 3
    kind = lambda name, sure, why: F.struct((F.lit(name) if isinstance(name, str) else name).alias("kind"), F.round(sure if not isinstance(sure, float) else F.lit(sure), 4).alias("confidence"), F.lit(why).alias("reason"))
    rules = (
        (F.col("margin").isNotNull() & ~(first & (F.col("title_like") | F.col("author_like"))), kind(F.col("margin"), 0.98, "margin")),
        (t == "", kind("unknown", 0.05, "empty_text")),
        (F.col("region").isNotNull(), kind(F.col("region"), 0.88, "element_region")),
        (caption != "", kind(F.when(caption.startswith("fig"), "figure_caption").otherwise("table_caption"), 0.93, "caption_label")),
        (t.rlike(NUMBERED_LIST_SHAPE), kind("list", 0.9, "numbered_list_marker")),
        (t.rlike(FORMULA_SHAPE) & (chars <= 200) & plain, kind("equation", 0.84, "formula")),
        (cells & plain, kind("table", 0.82, "columns")),
        (first & F.col("title_like") & (F.col("rank") >= 1.35) & (F.col("lines") <= 3) & (chars <= 180) & plain, kind("title", F.least(F.lit(0.99), 0.78 + 0.08 * F.col("rank")), "first_page_title")),
        (first & F.col("author_like") & t.rlike(AUTHOR_SHAPE) & plain, kind("author", 0.81, "first_page_author")),
        (label.isin("abstract", "summary"), kind("abstract", 0.96, "abstract_label")),
        (F.col("depth").isNotNull() & plain & (chars <= 180), kind(F.when(F.col("depth") == 1, "heading").otherwise("subheading"), F.least(F.lit(0.95), 0.68 + 0.08 * F.greatest(F.col("rank"), F.lit(1.0)) + bonus), "numbered_heading")),
        (label.isin(*HEADING_WORDS) & (chars <= 120), kind("heading", F.least(F.lit(0.96), 0.72 + 0.08 * F.greatest(F.col("rank"), F.lit(1.0)) + bonus), "known_heading")),
        ((F.col("rank") >= 1.12) & F.col("bold") & (F.col("lines") <= 2) & (chars <= 140) & plain, kind(F.when(F.col("rank") < 1.35, "subheading").otherwise("heading"), F.least(F.lit(0.95), 0.76 + bonus), "font_rank")),
        ((F.col("rank") <= 0.85) & (F.col("bottom") >= 0.8), kind("footnote", 0.72, "small_at_the_bottom")),
        (t.rlike(BULLET_SHAPE), kind("list", 0.9, "bullet")),
        (t.rlike(CITATION_SHAPE) | (F.col("in_references") & t.rlike(AUTHOR_YEAR_SHAPE)), kind("reference", 0.84, "citation")),
        (F.col("sentence") | (chars > 90), kind("paragraph", 0.7, "sentence_or_long")),
    )
    chosen = kind("unknown", 0.35, "no_evidence")
    for holds, made in reversed(rules):
        chosen = F.when(F.coalesce(holds, F.lit(False)), made).otherwise(chosen)
    return b.select("uid", chosen.alias("k")).select("uid", "k.*")
