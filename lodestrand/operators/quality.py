"""Checks of parsed documents: warnings, coverage, duplicates, router and data-set contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import text as tx
from lodestrand.operators.bm25 import small
from lodestrand.operators.numbering import numbered


def coverage(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, pages, coverage: the share of pages with text; 0 without pages."""
    return pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg(F.when(F.trim(F.coalesce(text, F.lit(""))) != "", 1.0).otherwise(0.0)), 6).alias("coverage"))


def duplicate_content(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, first_id, digest of rows whose squeezed lower-case text an earlier id has.

    The first id of a digest is an aggregate and the rest are found by a join, so a digest
    with very many rows is no single task.
    """
    d = rows.select(F.col(id_col).alias("id"), F.sha1(F.lower(tx.squeeze(F.col(text_col))).cast("binary")).alias("digest"))
    first = d.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first_id")
    return d.join(first, "digest").where("id <> first_id").select("id", "first_id", "digest")


def warnings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, code: one row for each fault of a text, each once."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.size(tx.word_tokens(F.col(text_col)))
    checks = F.array(
        F.when(F.trim(t) == "", "empty_text"),
        F.when((F.length(t) > 0) & (F.length(t) < 20), "short_text"),
        F.when(tx.is_mojibake(t), "mojibake"),
        F.when((F.length(t) >= 20) & (words * 20 < F.length(t)), "few_words"),
        F.when(F.contains(t, F.lit("�")), "replacement_character"),
        F.when(F.length(t) > 20_000, "very_long"),
    )
    each = docs.select(F.col(id_col).alias("id"), F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("code"))
    return each.distinct()


def status(warned: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, status, warnings: failed for an empty text, partial with any other warning, else ready."""
    by = warned.groupBy("id").agg(F.count(F.lit(1)).alias("warnings"), F.bool_or(F.col("code") == "empty_text").alias("empty"))
    j = docs.select(F.col(id_col).alias("id")).join(by, "id", "left")
    return j.select("id", F.when(F.col("empty"), "failed").when(F.col("warnings") > 0, "partial").otherwise("ready").alias("status"), F.coalesce("warnings", F.lit(0)).alias("warnings"))


def quota_faults(rows: DataFrame, expected: DataFrame, *keys: str) -> DataFrame:
    """keys, expected, found where the counts of a data set differ from those it must have."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    j = expected.join(found, list(keys), "full_outer")
    return j.where(~F.col("expected").eqNullSafe(F.col("found"))).select(*keys, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))


def split(rows: DataFrame, group: str, key: str, parts: int = 3) -> DataFrame:
    """rows with `part`: test where a row's place in its group and the group's place agree modulo parts, else dev."""
    groups = numbered(rows.select(group).distinct(), group, name="g", start=0)
    placed = numbered(rows, key, groups=(group,), name="i", start=0)
    return placed.join(small(groups), group).withColumn("part", F.when(F.col("i") % parts == F.col("g") % parts, "test").otherwise("dev")).drop("g", "i")


def parse_warnings(reported: DataFrame, pages: DataFrame, blocks: DataFrame, chunks: DataFrame, elements: DataFrame, references: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """doc_id, code, page, uid of what is amiss in parsed documents, each once.

    reported: doc_id, pages, chars (of body text); pages: doc_id, page, width, height; blocks:
    doc_id, page, uid, source_index, x0, y0, x1, y1, text; chunks: doc_id, uid, text, sections;
    elements: doc_id, page, uid, type, status, caption; references: doc_id, page, uid, status.
    With images (doc_id, path of what is there), elements also have an image_path, null where they have none.
    """
    row = lambda df, code, page=F.lit(None), uid=F.lit(None): df.select("doc_id", F.lit(code).alias("code"), page.cast("int").alias("page"), uid.cast("string").alias("uid"))
    per = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("there"))
    filled = blocks.where(F.trim("text") != "").groupBy("doc_id").agg(F.count_distinct("page").alias("filled"))
    d = reported.join(per, "doc_id", "left").join(filled, "doc_id", "left").na.fill(0, ["there", "filled"])
    placed = lambda df: df.join(pages, ["doc_id", "page"]).where((F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x1") > F.col("width")) | (F.col("y1") > F.col("height")))
    twice = lambda df, *keys: df.groupBy(*keys).count().where("count > 1")
    digest = F.sha1(F.lower(tx.squeeze(F.col("text"))).cast("binary"))
    told = chunks.where(tx.squeeze(F.col("text")) != "").select("doc_id", "uid", digest.alias("digest")).distinct()
    first = told.groupBy("doc_id", "digest").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = [
        row(d.where("pages > 0 AND pages <> there"), "page_count_mismatch"),
        row(d.where("there = 0"), "no_pages"),
        row(d.where("there > 0 AND filled < 0.5 * there"), "low_text_coverage"),
        row(d.where("chars = 0"), "no_usable_text"),
        row(placed(blocks), "bbox_out_of_bounds", F.col("page"), F.col("uid")),
        row(blocks.where(tx.is_mojibake(F.col("text"))).select("doc_id").distinct(), "suspicious_characters"),
        row(twice(blocks, "doc_id", "page", "source_index").select("doc_id", "page").distinct(), "duplicate_source_index", F.col("page")),
        row(twice(chunks, "doc_id", "uid"), "duplicate_chunk", uid=F.col("uid")),
        row(told.join(first, ["doc_id", "digest"]).where("uid <> first"), "duplicate_chunk_content", uid=F.col("uid")),
        row(chunks.where(F.size(F.array_distinct("sections")) > 1), "cross_section_chunk", uid=F.col("uid")),
        row(elements.where("status <> 'success'"), "partial_element", F.col("page"), F.col("uid")),
        row(elements.where(F.col("type").isin("figure", "table") & (F.trim(F.coalesce("caption", F.lit(""))) == "")), "missing_caption", F.col("page"), F.col("uid")),
        row(references.where("status <> 'resolved'"), "unresolved_reference", F.col("page"), F.col("uid")),
    ]
    if images is not None:
        lost = elements.where("image_path IS NOT NULL").join(images.select("doc_id", F.col("path").alias("image_path")), ["doc_id", "image_path"], "left_anti")
        parts.append(row(lost, "missing_element_image", F.col("page"), F.col("uid")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def parse_status(warned: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, status, warnings: failed without usable text, success_with_warnings, or success."""
    by = warned.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("code") == "no_usable_text").alias("empty"))
    j = documents.select("doc_id").join(by, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("empty"), "failed").when(F.col("n") > 0, "success_with_warnings").otherwise("success").alias("status"), F.coalesce("n", F.lit(0)).alias("warnings"))
