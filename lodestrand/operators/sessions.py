"""Conversations: compaction, memory recall and durable upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import numeric as nm
from lodestrand.functions import text as tx

ROUTER_MESSAGES, ROUTER_CHARS = 4, 900


def message_tokens(*parts: Column) -> Column:
    """White-space tokens of a message's parts: the count that needs no vocabulary."""
    joined = F.concat_ws(" ", *parts)
    return F.when(F.trim(joined) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(joined, r"\s+", " ")), " ")))


def compaction_cutoff(messages: DataFrame, keep_recent: int, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """session, crossing and first_kept: where the newest messages reach keep_recent tokens, and the next user message from there.

    Only messages after the first can be first_kept; null means that nothing can be cut.
    """
    back = Window.partitionBy(session).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    forward = Window.partitionBy(session).orderBy(order)
    m = messages.select(session, order, role, message_tokens(F.col(text)).alias("tokens"))
    m = m.withColumn("recent", F.sum("tokens").over(back)).withColumn("index", F.row_number().over(forward) - 1)
    m = m.withColumn("crossing", F.max(F.when(F.col("recent") >= keep_recent, F.col("index"))).over(Window.partitionBy(session)))
    return m.groupBy(session).agg(
        F.max("crossing").alias("crossing"),
        F.min(F.when((F.col(role) == "user") & (F.col("index") >= F.col("crossing")) & (F.col("index") > 0), F.col(order))).alias("first_kept"),
        F.sum("tokens").alias("tokens"),
    )


def router_context(messages: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """session, context: the last four messages as `role: text`, texts bounded, an unknown role as user."""
    last = messages.withColumn("n", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))).where(F.col("n") <= ROUTER_MESSAGES)
    line = F.concat(F.when(F.col(role).isin("user", "assistant"), F.col(role)).otherwise("user"), F.lit(": "), tx.bounded(F.col(text), ROUTER_CHARS))
    return last.groupBy(session).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def turn_sequence(messages: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """session, order, turn_id, seq, event_id: turns begin at user messages; events are numbered within them."""
    forward = Window.partitionBy(session).orderBy(order)
    m = messages.withColumn("turn_id", F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(forward.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("seq", F.row_number().over(Window.partitionBy(session, "turn_id").orderBy(order)))
    return m.select(session, order, "turn_id", "seq", F.concat_ws(":", F.col(session), F.col("turn_id"), F.col("seq")).alias("event_id"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the order columns: an aggregate of structs, so no group is gathered."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    best = rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("x"))
    return best.select(key, *(F.col(f"x.{c}").alias(c) for c in (*order, *rest)))


def memory_rank(hits: DataFrame, now: Column, least: float = 0.2, limit: int = 3, query: str = "query_id") -> DataFrame:
    """query, memory_id, score, rank: semantic candidates over the threshold by weighted score, then time, then id."""
    scored = hits.where(F.col("semantic") >= least).withColumn("score", nm.memory_score(F.col("semantic"), nm.recency(F.col("updated_at"), now)))
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.desc("updated_at"), F.desc("memory_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(query, "memory_id", "score", "rank")


def merge_refs(refs: DataFrame, *keys: str, order: str = "ord", value: str = "value") -> DataFrame:
    """References once each: the last value, at the first place."""
    return refs.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.min(order).alias(order))


def outbox_batch(operations: DataFrame, limit: int) -> DataFrame:
    """The oldest pending operations, as many as a pass may handle: a stated bound of the worker."""
    return operations.where("status = 'pending'").orderBy("id").limit(limit)


def optimistic_merge(stored: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows with the changes that still apply: the row is active and its updated_at is the one the change has seen."""
    c = changes.select(F.col(key).alias("__key"), F.col("seen_at").alias("__seen"), F.col("content").alias("__content"), F.col("new_at").alias("__new"))
    joined = stored.join(c, (F.col(key) == F.col("__key")) & (F.col("updated_at") == F.col("__seen")) & (F.col("status") == "active"), "left")
    hit = F.col("__key").isNotNull()
    replaced = {"content": F.when(hit, F.col("__content")).otherwise(F.col("content")), "updated_at": F.when(hit, F.col("__new")).otherwise(F.col("updated_at"))}
    return joined.select(*(replaced.get(x, F.col(x)).alias(x) for x in stored.columns), hit.alias("applied"))
