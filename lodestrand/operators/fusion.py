"""Reciprocal-rank fusion, once within a channel and again across channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators.bm25 import small
from lodestrand.runtime import materialize

RRF_K = 60


def rrf(rankings: DataFrame, k: int = RRF_K, key: str = "doc_id", places: bool = False) -> DataFrame:
    """query_id, key, score, rank from rankings (query_id, list_id, key, rank).

    A list that holds a key twice counts its best place only, and its ranks are renumbered
    after that; with `places` the lists are known to hold a key once, at ranks from 1, and
    neither needs a shuffle. Ties go by where a key was first seen (list, then place), then
    by key.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if places:
        placed = rankings.withColumn("place", F.col("rank"))
    else:
        once = rankings.groupBy("query_id", "list_id", key).agg(F.min("rank").alias("rank"))
        lists = Window.partitionBy("query_id", "list_id").orderBy("rank", key)
        placed = once.withColumn("place", F.row_number().over(lists))
    scored = placed.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (k + F.col("place"))), 12).alias("score"), F.min(F.struct("list_id", "place")).alias("first_seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_seen", F.col(key).cast("string"))
    return scored.withColumn("rank", F.row_number().over(order)).select("query_id", key, "score", "rank")


def late_rows(ranks: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ranks joined with stored rows last; keys that storage lacks go, and other ranks stay as they were.

    Ranks are a few rows a query: they are written down and, where they are few, broadcast, so that texts are not shuffled.
    """
    return rows.join(small(materialize(ranks, "ranks")), key).select(key, *(c for c in ranks.columns + rows.columns if c != key))


def rerank_merge(fused: DataFrame, reranked: DataFrame, key: str = "doc_id", top_k: int | None = None) -> DataFrame:
    """Reranked keys by score, ties in fusion order; then keys without a score in fusion order.

    fused: query_id, key, rank; reranked: query_id, key, rerank_score.
    """
    both = fused.join(reranked.select("query_id", key, "rerank_score"), ["query_id", key], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank")
    out = both.withColumn("final_rank", F.row_number().over(order))
    return out if top_k is None else out.where(F.col("final_rank") <= top_k)
