"""Frozen candidates and their reranking, four arms of a comparison, and what a stored row resolves to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Arms of the comparison of rewritten questions, and the pairs of arms that are compared. Fixed names.
ARMS = ("raw_fusion", "rewrite_fusion", "raw_rerank", "rewrite_rerank")
PAIRS = (
    ("query_before_rerank", "raw_fusion", "rewrite_fusion"), ("rerank_on_raw", "raw_fusion", "raw_rerank"),
    ("rerank_on_rewrite", "rewrite_fusion", "rewrite_rerank"), ("final", "raw_rerank", "rewrite_rerank"),
)


def rerank_payloads(candidates: DataFrame) -> DataFrame:
    """Candidates (chunk_id, document_id, title, page_number, chunk_index, content, fusion_score, ...) as a reranker takes them: with score, and what names them as JSON in metadata."""
    named = F.to_json(F.struct("chunk_id", "document_id", "title", "page_number", "chunk_index"))
    return candidates.withColumn("score", F.col("fusion_score")).withColumn("metadata", named)


def reranked(items: DataFrame, original: DataFrame) -> DataFrame:
    """query_id, chunk_id, rerank_score, place: the candidates in the order of what a reranker returned, then the rest in their own order.

    items: query_id, ord, chunk_id and rerank_score as text, metadata as JSON; original: query_id, chunk_id, ord. An id
    may stand in the metadata alone; items whose id is no number or no candidate's go, of several of one
    candidate the first counts, and a score that is no number is null.
    """
    raw = F.coalesce(F.col("chunk_id"), F.get_json_object("metadata", "$.chunk_id")).try_cast("bigint")
    i = items.select("query_id", F.col("ord").alias("at"), raw.alias("chunk_id"), F.col("rerank_score").try_cast("double").alias("rerank_score"))
    i = i.where("chunk_id IS NOT NULL").groupBy("query_id", "chunk_id").agg(F.min(F.struct("at", "rerank_score")).alias("x"))
    j = original.join(i, ["query_id", "chunk_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("x.at").asc_nulls_last(), "ord", "chunk_id")
    return j.select("query_id", "chunk_id", F.col("x.rerank_score").alias("rerank_score"), F.row_number().over(order).alias("place"))


def frozen_rerank(candidates: DataFrame, chunks: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """case_id, chunk_id, document_id, page_number, rank, score, fusion_rank, fault of each case's frozen candidates.

    candidates: case_id, chunk_id, rank; chunks: chunk_id, document_id, page_number, content. score takes
    them joined and returns case_id, chunk_id, rerank_score. A case with a candidate that is not stored, or whose
    scored candidates are not the frozen ones, has one row with its fault and no ranking.
    """
    j = candidates.select("case_id", "chunk_id", F.col("rank").alias("fusion_rank")).join(chunks, "chunk_id", "left")
    absent = j.where("content IS NULL").select("case_id", F.lit("chunk_absent").alias("fault")).distinct()
    there = j.join(absent, "case_id", "left_anti")
    scored = score(there).groupBy("case_id", "chunk_id").agg(F.first("rerank_score").alias("score"), F.count(F.lit(1)).alias("n"))
    both = there.join(scored.withColumnRenamed("n", "times"), ["case_id", "chunk_id"], "full_outer")
    changed = both.where("fusion_rank IS NULL OR coalesce(times, 0) <> 1").select("case_id", F.lit("candidates_changed").alias("fault")).distinct()
    order = Window.partitionBy("case_id").orderBy(F.desc("score"), "fusion_rank", "chunk_id")
    ranked = both.join(changed, "case_id", "left_anti").withColumn("rank", F.row_number().over(order))
    out = ranked.select("case_id", "chunk_id", "document_id", "page_number", "rank", "score", "fusion_rank", F.lit(None).cast("string").alias("fault"))
    return out.unionByName(absent.unionByName(changed), allowMissingColumns=True)


def arm_hits(rankings: DataFrame, gold: DataFrame, cases: DataFrame, ks: tuple[int, ...] = (3, 5, 10, 20)) -> DataFrame:
    """arm, case_id, k, hit: whether each arm has a chunk of gold (case_id, chunk_id) among a case's first k."""
    first = rankings.join(gold.distinct(), ["case_id", "chunk_id"]).groupBy("arm", "case_id").agg(F.min("rank").alias("first"))
    arms = F.explode(F.array(*map(F.lit, ARMS))).alias("arm")
    every = cases.select("case_id").distinct().select("case_id", arms).join(first, ["arm", "case_id"], "left")
    return every.select("arm", "case_id", F.explode(F.array(*map(F.lit, ks))).alias("k"), "first").select("arm", "case_id", "k", F.coalesce(F.col("first") <= F.col("k"), F.lit(False)).alias("hit"))


def four_arms(hits: DataFrame, ks: tuple[int, ...] = (5, 20)) -> DataFrame:
    """comparison, k, gained, lost, both, neither: cases that one arm hits and its partner does not."""
    h = hits.where(F.col("k").isin(*ks)).groupBy("case_id", "k").pivot("arm", list(ARMS)).agg(F.bool_or("hit"))
    of = F.explode(F.array(*[F.struct(F.lit(n).alias("comparison"), F.col(a).alias("a"), F.col(b).alias("b")) for n, a, b in PAIRS])).alias("x")
    each = h.select("k", of).select("k", "x.*")
    n = lambda test: F.count_if(test)
    a, b = F.col("a"), F.col("b")
    return each.groupBy("comparison", "k").agg(n(~a & b).alias("gained"), n(a & ~b).alias("lost"), n(a & b).alias("both"), n(~a & ~b).alias("neither"))


def adoption(hits: DataFrame, errors: DataFrame) -> DataFrame:
    """One row of gates: final_hit5_improves, final_hit20_non_decreasing, zero_rewrite_rerank_errors, adopt (all of them).

    errors: rows of rerank failures of the rewritten arm.
    """
    rate = lambda arm, k: F.avg(F.when((F.col("arm") == arm) & (F.col("k") == k), F.col("hit").cast("int")))
    g = hits.agg(*[F.coalesce(rate(arm, k), F.lit(0.0)).alias(f"{arm}_{k}") for arm in ("raw_rerank", "rewrite_rerank") for k in (5, 20)])
    g = g.crossJoin(errors.agg(F.count(F.lit(1)).alias("errors")))  # both are one row
    gates = g.select((F.col("rewrite_rerank_5") > F.col("raw_rerank_5")).alias("final_hit5_improves"), (F.col("rewrite_rerank_20") >= F.col("raw_rerank_20")).alias("final_hit20_non_decreasing"), (F.col("errors") == 0).alias("zero_rewrite_rerank_errors"))
    return gates.withColumn("adopt", F.col("final_hit5_improves") & F.col("final_hit20_non_decreasing") & F.col("zero_rewrite_rerank_errors"))


def chunk_candidates(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored chunks (chunk_id, document_id, page_number, chunk_index, content) as candidates, with the title of their document (document_id, title); chunks without one go."""
    return chunks.join(documents.select("document_id", "title"), "document_id").select("chunk_id", "document_id", "title", "page_number", "chunk_index", "content")


def web_sources(papers: DataFrame) -> DataFrame:
    """Papers (title, authors, summary, published, entry_url, pdf_url) that can be cited: with a title and an entry URL, one row for each URL (the least title)."""
    there = papers.where("trim(coalesce(title, '')) <> '' AND trim(coalesce(entry_url, '')) <> ''")
    best = there.groupBy("entry_url").agg(F.min(F.struct(*[c for c in papers.columns if c != "entry_url"])).alias("x"))
    return best.select("entry_url", "x.*")


def resolved_keys(chunks: DataFrame, pages: DataFrame, elements: DataFrame) -> DataFrame:
    """doc_id, chunk_uid, page_id, page_start, page_end, element_id of chunks to be stored.

    chunks: doc_id, chunk_uid, page_numbers, element_uids (arrays, null as empty); pages: doc_id, page_number, page_id; elements:
    doc_id, element_uid, element_id. The page is that of the least page number, the element the first of
    the list that is stored; what is not stored is null.
    """
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    c = chunks.select("doc_id", "chunk_uid", F.array_min("page_numbers").alias("page_start"), F.array_max("page_numbers").alias("page_end"), none("element_uids", "string").alias("uids"))
    named = c.select("doc_id", "chunk_uid", F.posexplode("uids").alias("at", "element_uid")).join(elements, ["doc_id", "element_uid"])
    first = named.groupBy("doc_id", "chunk_uid").agg(F.min(F.struct("at", "element_id")).alias("x")).select("doc_id", "chunk_uid", F.col("x.element_id").alias("element_id"))
    p = pages.select("doc_id", F.col("page_number").alias("page_start"), "page_id")
    return c.join(p, ["doc_id", "page_start"], "left").join(first, ["doc_id", "chunk_uid"], "left").select("doc_id", "chunk_uid", "page_id", "page_start", "page_end", "element_id")


def page_margins(blocks: DataFrame, body: DataFrame, normal: Column, band: float = 0.12, share: float = 0.6, large: float = 1.4) -> DataFrame:
    """doc_id, page, uid, kind: headers and footers that recur.

    blocks: doc_id, page (from 1), uid, y0, y1, height, font (its largest size); body: doc_id, font (the median of its text);
    normal: the text as margins are compared. A block in the top or bottom band of its page is one if its text stands in the
    same band on that share of the document's pages with a size, and on two or more. Large text on page 1 (`large` times the body's) is a title and no margin.
    """
    b = blocks.where("height > 0").join(body.select("doc_id", F.col("font").alias("body")), "doc_id", "left").withColumn("margin", normal)
    kind = F.when(F.col("y1") <= F.col("height") * band, "header").when(F.col("y0") >= F.col("height") * (1 - band), "footer")
    title = (F.col("page") == 1) & (F.col("body") > 0) & (F.col("font") >= large * F.col("body"))
    c = b.withColumn("kind", kind).where(F.col("kind").isNotNull() & (F.col("margin") != "") & ~F.coalesce(title, F.lit(False)))
    total = b.groupBy("doc_id").agg(F.count_distinct("page").alias("total"))
    seen = c.groupBy("doc_id", "kind", "margin").agg(F.count_distinct("page").alias("pages")).join(total, "doc_id").where((F.col("pages") > 1) & (F.col("pages") >= share * F.col("total")))
    return c.join(seen.select("doc_id", "kind", "margin"), ["doc_id", "kind", "margin"]).select("doc_id", "page", "uid", "kind")


def column_order(blocks: DataFrame, columns: DataFrame) -> DataFrame:
    """Blocks (doc_id, page, uid, x0, y0, x1, y1, width) with reading_order from 0 in their document.

    columns: doc_id, page, n. On pages of one column blocks go by y0, x0, y1, x1 and uid. On
    others blocks over 60 % of the width split bands, and a band's left column comes before the right one.
    """
    b = blocks.join(columns.select("doc_id", "page", "n"), ["doc_id", "page"], "left")
    two = F.coalesce(F.col("n"), F.lit(1)) > 1
    spanning = (F.col("x1") - F.col("x0")) > 0.6 * F.col("width")
    above = Window.partitionBy("doc_id", "page").orderBy("y0", "uid").rowsBetween(Window.unboundedPreceding, 0)
    band = F.when(two, F.sum(F.when(spanning, 1).otherwise(0)).over(above)).otherwise(0)
    side = F.when(~two | spanning, 0).when((F.col("x0") + F.col("x1")) / 2 < F.col("width") / 2, 1).otherwise(2)
    order = Window.partitionBy("doc_id").orderBy("page", "band", "side", "y0", "x0", "y1", "x1", "uid")
    return b.withColumn("band", band).withColumn("side", side).withColumn("reading_order", F.row_number().over(order) - 1).drop("band", "side", "n")
