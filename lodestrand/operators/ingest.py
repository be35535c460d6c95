"""What happens to a parsed document before it is stored: blocks from parser output, labels, chunk texts, keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.functions import text as tx
from lodestrand.operators.numbering import numbered

# Parser item types that carry no content, and words that open special sections.
IGNORED = ("page_header", "page_footer", "page_number", "header", "footer")
REFERENCE_HEADINGS = ("references", "bibliography", "参考文献")

CONTENT_LIST = T.ArrayType(
    T.ArrayType(
        T.StructType(
            [
                T.StructField("type", T.StringType()),
                T.StructField("bbox", T.ArrayType(T.DoubleType())),
                T.StructField("content", T.StructType([T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("html", T.StringType()), T.StructField("latex", T.StringType()), T.StructField("caption", T.StringType())])),
            ]
        )
    )
)


def content_blocks(parsed: DataFrame, key: str = "doc_id", raw: str = "content_list") -> DataFrame:
    """Blocks of an external parser's pages (a JSON list of items per page): key, page, ord, type, text, level, box.

    Running headers, footers and page numbers go; malformed JSON gives no blocks.
    """
    pages = parsed.select(key, F.posexplode(F.from_json(raw, CONTENT_LIST)).alias("page", "items"))
    items = pages.select(key, (F.col("page") + 1).alias("page"), F.posexplode("items").alias("ord", "x")).where(~F.col("x.type").isin(*IGNORED))
    scaled = F.transform(F.col("x.bbox"), lambda v: F.round(v / 1000, 6))
    text = F.coalesce("x.content.text", "x.content.latex", "x.content.caption", F.lit(""))
    return items.select(key, "page", "ord", F.col("x.type").alias("type"), text.alias("text"), F.when(F.col("x.type") == "title", F.coalesce("x.content.level", F.lit(1))).alias("level"), scaled.alias("bbox"))


def page_count_faults(parsed: DataFrame, expected: DataFrame, key: str = "doc_id", raw: str = "content_list") -> DataFrame:
    """key, expected, found where the parser's pages are not as many as the file's."""
    found = parsed.select(key, F.size(F.from_json(raw, CONTENT_LIST)).alias("found"))
    return expected.join(found, key, "left").where(~F.col("expected").eqNullSafe(F.col("found"))).select(key, "expected", F.coalesce("found", F.lit(0)).alias("found"))


def in_references(blocks: DataFrame, key: str = "doc_id", order: str = "ord", text: str = "text") -> DataFrame:
    """Blocks with `in_references`: true from a references heading on."""
    head = F.lower(tx.squeeze(F.col(text))).isin(*REFERENCE_HEADINGS)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("in_references", F.max(F.when(head, 1).otherwise(0)).over(w) == 1)


def vertical_gaps(blocks: DataFrame, *keys: str) -> DataFrame:
    """Blocks with the distance to the block before and after on their page."""
    w = Window.partitionBy(*keys).orderBy("y0", "uid")
    return blocks.withColumn("gap_before", F.col("y0") - F.lag("y1").over(w)).withColumn("gap_after", F.lead("y0").over(w) - F.col("y1"))


def block_type(text: Column, in_refs: Column, size: Column, body_size: Column, first_page: Column) -> Column:
    """A block's type by the first rule that fits, with its confidence and the rule's name."""
    t = tx.squeeze(text)
    made = lambda kind, sure, why: F.struct(F.lit(kind).alias("type"), F.lit(sure).alias("confidence"), F.lit(why).alias("reason"))
    return (
        F.when(t == "", made("unknown", 0.0, "empty"))
        .when(t.rlike(r"^[0-9]+$"), made("page_number", 0.95, "lone_number"))
        .when(t.rlike(r"(?i)^(?:fig(?:ure)?\.?)\s*[0-9]+"), made("figure_caption", 0.95, "figure_label"))
        .when(t.rlike(r"(?i)^table\s*(?:[0-9]+|[IVXLCDM]+)"), made("table_caption", 0.95, "table_label"))
        .when(in_refs, made("reference", 0.9, "after_references"))
        .when(t.rlike(r"(?i)^abstract\b"), made("abstract", 0.9, "abstract_label"))
        .when(t.rlike(r"(?i)^key ?words\b"), made("keywords", 0.9, "keywords_label"))
        .when(first_page & (size >= body_size * 1.4), made("title", 0.85, "large_on_first_page"))
        .when(tx.heading_depth(text).isNotNull() & (F.length(t) <= 120) & ~t.rlike(r"[.;,]$"), made("heading", 0.85, "numbered"))
        .when(t.rlike(r"[=∑∫≤≥]") & (F.length(t) <= 200) & t.rlike(r"\([0-9]+\)$"), made("equation", 0.8, "numbered_formula"))
        .when(t.rlike(r"^[•\-*]\s"), made("list_item", 0.75, "bullet"))
        .otherwise(made("paragraph", 0.7, "default"))
    )


def row_clusters(words: DataFrame, tolerance: float = 2.5, key: str = "page") -> DataFrame:
    """Words (key, word_id, y) with `row_no`: a row holds words within tolerance of its first word's y.

    Each row starts where the one before ends, so a page, a bounded group, is one call.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "word_id"])
        out, row, start = [], -1, None
        for y in pdf["y"]:
            if start is None or y - start > tolerance:
                row, start = row + 1, y
            out.append(row)
        return pdf.assign(row_no=out)[["k", "word_id", "row_no"]]

    slim = words.select(F.col(key).cast("long").alias("k"), F.col("word_id").cast("long").alias("word_id"), F.col("y").cast("double").alias("y"))
    return slim.groupBy("k").applyInPandas(run, "k long, word_id long, row_no long").withColumnRenamed("k", key)


def numbered_headers(cells: DataFrame, *keys: str, order: str = "col", name: str = "header") -> DataFrame:
    """Repeated header names with their ordinal from the second on: a, a_2, a_3."""
    w = Window.partitionBy(*keys, name).orderBy(order)
    n = F.row_number().over(w)
    return cells.withColumn("unique_header", F.when(n == 1, F.col(name)).otherwise(F.concat_ws("_", F.col(name), n.cast("string"))))


def markdown_table(columns: Column, rows: Column) -> Column:
    """A Markdown table of string arrays; bars and line breaks in cells are escaped."""
    cell = lambda x: F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(columns, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(columns), rule), F.transform(rows, line)), "\n")


def chunk_context(title: Column, section: Column, subsection: Column) -> Column:
    """The sentence that says where a chunk comes from."""
    where = F.coalesce(F.nullif(subsection, F.lit("")), F.nullif(section, F.lit("")))
    name = F.coalesce(F.nullif(title, F.lit("")), F.lit("the paper"))
    return F.when(where.isNotNull(), F.concat(F.lit("This passage comes from the "), where, F.lit(" section of "), name, F.lit("."))).otherwise(F.concat(F.lit("This passage comes from "), name, F.lit(".")))


def grounded(prefix: Column, *sources: Column) -> Column:
    """Whether a generated prefix keeps to its sources: their numbers only, two sentences at most, a shared long word."""
    source = F.concat_ws(" ", *sources)
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"\b[0-9]+(?:\.[0-9]+)?\b"), F.lit(0))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0))
    ends = F.size(F.regexp_extract_all(prefix, F.lit(r"[.!?](?:\s|$)"), F.lit(0)))
    return (F.size(F.array_except(numbers(prefix), numbers(source))) == 0) & (ends <= 2) & F.arrays_overlap(words(prefix), words(source))


def embedding_text(*parts: Column) -> Column:
    """The non-empty parts, a line each."""
    return F.concat_ws("\n", *(F.nullif(F.trim(p), F.lit("")) for p in parts))


def surrogate_keys(rows: DataFrame, *order: str, name: str = "id", start: int = 1) -> DataFrame:
    """Rows numbered by the order columns without one global sort task."""
    return numbered(rows, *order, name=name, start=start)


def moved_assets(metadata: Column, staging: str, formal: str) -> Column:
    """A string map with paths under the staging folder put under the formal one."""
    return F.transform_values(metadata, lambda _, v: F.when(v.startswith(staging), F.concat(F.lit(formal), F.substring(v, F.lit(len(staging) + 1), F.length(v)))).otherwise(v))


def summary_sections(text: Column, headings: tuple[str, ...]) -> Column:
    """A map from heading to the text under it, for `## heading` lines; null unless every heading is there."""
    joined = F.concat(F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n## "))
    parts = F.map_from_arrays(
        F.array(*(F.lit(h) for h in headings)),
        F.array(*(F.trim(F.regexp_replace(F.regexp_extract(joined, rf"(?s)\n## {h}[ \t]*\n(.*?)(?=\n## )", 1), r"^\s+|\s+$", "")) for h in headings)),
    )
    there = F.lit(True)
    for h in headings:
        there = there & joined.rlike(rf"\n## {h}[ \t]*\n")
    return F.when(there, parts)


def offline_answer(docs: DataFrame, queries: DataFrame, n: int = 3) -> DataFrame:
    """query_id, answer: the first sentences of the best ranked rows (query_id, rank, text), joined."""
    first = tx.sentences(F.col("text"))[0]
    best = docs.where(F.col("rank") <= n).select("query_id", "rank", tx.bounded(first, 260).alias("s"))
    joined = best.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"]), " ").alias("answer"))
    return queries.select("query_id").join(joined, "query_id", "left").select("query_id", F.coalesce("answer", F.lit("")).alias("answer"))
