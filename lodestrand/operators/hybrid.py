"""Hybrid retrieval for a batch of query plans: two channels, two levels of fusion, late rows, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators.fusion import RRF_K, late_rows, rerank_merge, rrf
from lodestrand.runtime import materialize

MODES = ("bm25", "vector", "hybrid")


def channels(lexical: DataFrame | None, semantic: DataFrame | None, mode: str = "hybrid") -> DataFrame:
    """The requested channels' rankings as query_id, channel, list_id, doc_id, rank.

    A channel that failed is None; if all that were asked for failed, that is an error.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    asked = {"bm25": lexical, "vector": semantic}
    asked = {k: v for k, v in asked.items() if mode in (k, "hybrid")}
    there = {k: v for k, v in asked.items() if v is not None}
    if not there:
        raise RuntimeError("every requested channel failed")
    out = None
    for i, (name, df) in enumerate(there.items()):
        part = df.select("query_id", F.lit(name).alias("channel"), F.lit(i).alias("channel_no"), "list_id", "doc_id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def fuse(rankings: DataFrame, k: int = RRF_K, places: bool = False) -> DataFrame:
    """query_id, doc_id, score, fusion_rank with bm25_rank and vector_rank, the places within each channel's own fusion."""
    keyed = rankings.withColumn("query_id", F.struct("query_id", "channel", "channel_no"))
    inner = rrf(keyed, k, places=places).select("query_id.*", "doc_id", "rank")
    # A channel's fusion holds a document once, with places from 1, so they are the outer ranks as they stand.
    of = lambda name: F.min(F.when(F.col("channel") == name, F.col("rank")))
    outer = inner.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), F.min(F.struct("channel_no", "rank")).alias("first_seen"), of("bm25").alias("bm25_rank"), of("vector").alias("vector_rank")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_seen", F.col("doc_id").cast("string"))
    return outer.withColumn("fusion_rank", F.row_number().over(order)).select("query_id", "doc_id", "score", "fusion_rank", "bm25_rank", "vector_rank")


def hybrid_search(
    rankings: DataFrame, rows: DataFrame, candidates: int = 20, limit: int = 5, reranker: Callable[[DataFrame], DataFrame] | None = None, k: int = RRF_K, places: bool = False
) -> DataFrame:
    """The best rows of each query: fused, cut, joined with storage, reranked, cut.

    rows: doc_id and what to return. Text is joined only for the candidates. reranker takes
    the candidates and returns query_id, doc_id, rerank_score; without one fusion order stays.
    """
    fused = fuse(rankings, k, places)
    stored = late_rows(fused, rows)
    order = Window.partitionBy("query_id").orderBy("fusion_rank")
    cut = stored.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= candidates).drop("__n")
    if reranker is None:
        return cut.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= limit)
    cut = materialize(cut, "candidates")  # a few rows a query, which the reranker and the merge with it read
    scored = rerank_merge(cut.withColumnRenamed("fusion_rank", "rank"), reranker(cut), top_k=limit)
    return scored.withColumnRenamed("rank", "fusion_rank")


def lexical_overlap(questions: DataFrame, text_col: str = "text") -> Callable[[DataFrame], DataFrame]:
    """A reranker without a model: the share of a question's tokens (query_id, terms) that a row's text has."""
    from lodestrand.functions.text import word_tokens

    def run(cut: DataFrame) -> DataFrame:
        both = cut.join(questions, "query_id")
        share = F.size(F.array_intersect("terms", word_tokens(F.col(text_col)))) / F.greatest(F.size("terms"), F.lit(1))
        return both.select("query_id", "doc_id", F.round(share, 9).alias("rerank_score"))

    return run
