"""The research loop over a batch of questions: plan, search, judge, pool, until each question is settled.

Every round is DataFrame work over all open sessions at once; the driver only counts rounds.
Planner, retriever and judge are functions from DataFrame to DataFrame, so a model or a rule
plugs in alike; the defaults need no model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as tx
from lodestrand.operators import bm25 as lx
from lodestrand.operators.agent import MOST_ACTIONS, fingerprint
from lodestrand.operators.fusion import late_rows
from lodestrand.operators.numbering import numbered
from lodestrand.runtime import lifetime, materialize, release

#: Confidence from which a claim counts as covered.
COVERED = 0.6
MAX_ROUNDS = 3
_CLAIM = ("session_id", "claim_id")


def claims_of(questions: DataFrame, most: int = 8) -> DataFrame:
    """session_id, claim_id, question: a claim for each sentence of a question (session_id, question), up to the limit."""
    each = questions.select("session_id", F.posexplode(F.slice(tx.sentences(F.col("question")), 1, most)).alias("i", "question"))
    return each.select("session_id", F.concat(F.lit("C"), (F.col("i") + 1).cast("string")).alias("claim_id"), "question")


def widening_planner(open_: DataFrame, round_no: int) -> DataFrame:
    """session_id, claim_id, query for open claims: in each round five more of a claim's words."""
    words = F.array_distinct(tx.word_tokens(F.col("question")))
    return open_.select(*_CLAIM, F.array_join(F.slice(words, 1, 5 * round_no), " ").alias("query")).where("query <> ''")


def index_retriever(index: lx.Index, top_k: int = 20) -> Callable[[DataFrame], DataFrame]:
    """A retriever over a lexical index: session_id, claim_id, doc_id, rank for actions (session_id, claim_id, query)."""

    def search(actions: DataFrame) -> DataFrame:
        keyed = materialize(numbered(actions, *_CLAIM, name="n"), "actions")
        terms = keyed.select(F.col("n").alias("query_id"), F.lit(1).alias("set_id"), F.explode(F.array_distinct(tx.word_tokens(F.col("query")))).alias("term"))
        hits = lx.bm25(index, terms, top_k).select(F.col("query_id").alias("n"), "doc_id", "rank")
        return hits.join(lx.small(keyed.select("n", *_CLAIM)), "n").select(*_CLAIM, "doc_id", "rank")

    return search


def overlap_judge(texts: DataFrame) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A judge without a model: a hit's confidence is the share of its claim's words that the text (doc_id, text) has."""

    def judge(hits: DataFrame, claims: DataFrame) -> DataFrame:
        j = late_rows(hits.join(claims.select(*_CLAIM, "question"), list(_CLAIM)), texts)
        words = F.array_distinct(tx.word_tokens(F.col("question")))
        share = F.size(F.array_intersect(words, tx.word_tokens(F.col("text")))) / F.greatest(F.size(words), F.lit(1))
        return j.select(*_CLAIM, "doc_id", F.round(share, 9).alias("confidence")).where("confidence > 0")

    return judge


@dataclass
class Findings:
    sessions: DataFrame  # session_id, status, rounds, calls
    claims: DataFrame  # session_id, claim_id, status, best
    evidence: DataFrame  # session_id, claim_id, doc_id, confidence, round_added


def _statuses(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    best = evidence.groupBy(*_CLAIM).agg(F.max("confidence").alias("best"))
    j = claims.join(best, list(_CLAIM), "left")
    return j.select(*_CLAIM, "question", F.when(F.col("best") >= COVERED, "covered").when(F.col("best").isNotNull(), "partial").otherwise("missing").alias("status"), "best")


def research(
    claims: DataFrame, search: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame, DataFrame], DataFrame],
    planner: Callable[[DataFrame, int], DataFrame] = widening_planner, max_rounds: int = MAX_ROUNDS, max_calls: int = MOST_ACTIONS,
) -> Findings:
    """Settle every session of claims (session_id, claim_id, question).

    A round plans queries for claims that are not covered, drops those that the session has
    asked before and those beyond its calls, searches, judges, and adds evidence that its
    pool lacks. A session ends completed (all covered), stalled (two rounds in a row without
    new evidence), or at the limit of rounds or calls.
    """
    with lifetime(claims.sparkSession) as keep:
        sessions = claims.select("session_id").distinct().select("session_id", F.lit("open").alias("status"), F.lit(0).alias("rounds"), F.lit(0).cast("bigint").alias("calls"), F.lit(0).alias("still"))
        sessions, state = materialize(sessions, "sessions"), materialize(claims.select(*_CLAIM, "question", F.lit("missing").alias("status"), F.lit(None).cast("double").alias("best")), "claims")
        evidence = asked = None
        for n in range(1, max_rounds + 1):
            open_ = state.where("status <> 'covered'").join(sessions.where("status = 'open'").select("session_id", "calls"), "session_id")
            planned = planner(open_.select(*_CLAIM, "question"), n).withColumn("fp", fingerprint(F.col("query")))
            planned = planned.dropDuplicates(["session_id", "fp"])
            if asked is not None:
                planned = planned.join(asked.select("session_id", "fp"), ["session_id", "fp"], "left_anti")
            order = F.row_number().over(Window.partitionBy("session_id").orderBy("claim_id"))
            planned = planned.join(sessions.select("session_id", "calls"), "session_id").withColumn("n", order).where(F.col("n") + F.col("calls") <= max_calls)
            actions = materialize(planned.select(*_CLAIM, "query", "fp"), "round-actions")
            found = judge(search(actions.select(*_CLAIM, "query")), state)
            if evidence is not None:
                found = found.join(evidence.select(*_CLAIM, "doc_id"), [*_CLAIM, "doc_id"], "left_anti")
            new = materialize(found.withColumn("round_added", F.lit(n)), "round-evidence")
            keep(new)
            evidence = new if evidence is None else evidence.unionByName(new)
            asked = actions if asked is None else asked.unionByName(actions)
            old = sessions, state
            state = materialize(_statuses(claims.select(*_CLAIM, "question"), evidence), "claims")
            told = state.groupBy("session_id").agg(F.bool_and(F.col("status") == "covered").alias("done"))
            used = actions.groupBy("session_id").agg(F.count(F.lit(1)).alias("used"))
            grown = new.groupBy("session_id").agg(F.count(F.lit(1)).alias("grown"))
            s = sessions.join(told, "session_id").join(used, "session_id", "left").join(grown, "session_id", "left").na.fill(0, ["used", "grown"])
            was = F.col("status") == "open"
            calls, still = F.col("calls") + F.col("used"), F.when(F.col("grown") > 0, 0).otherwise(F.col("still") + 1)
            status = F.when(~was, F.col("status")).when(F.col("done"), "completed").when(still >= 2, "stalled").when((F.lit(n) >= max_rounds) | (calls >= max_calls), "limit").otherwise("open")
            s = s.select("session_id", status.alias("status"), F.when(was, n).otherwise(F.col("rounds")).alias("rounds"), F.when(was, calls).otherwise(F.col("calls")).alias("calls"), F.when(was, still).otherwise(F.col("still")).alias("still"))
            sessions = materialize(s, "sessions")
            release(*old)
            if sessions.where("status = 'open'").isEmpty():
                break
        keep(sessions, state)
    return Findings(sessions.drop("still"), state.select(*_CLAIM, "status", "best"), evidence)


def routed(questions: DataFrame, routes: dict[str, Callable[[DataFrame], DataFrame]], intent: str = "intent") -> DataFrame:
    """Each question answered by the function of its intent; all give the same columns. Intents without a function are an error."""
    out = None
    unknown = questions.where(~F.col(intent).isin(*routes) | F.col(intent).isNull())
    if not unknown.isEmpty():
        raise ValueError("a question has an intent without a route")
    for name, answer in routes.items():
        part = answer(questions.where(F.col(intent) == name).drop(intent)).withColumn("route", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
