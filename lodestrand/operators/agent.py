"""Research plans, tool calls, judgements and their bookkeeping as relational checks over batches of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as tx
from lodestrand.functions.contracts import is_subset, reasons

# Tools, limits of a plan and of a task board, bounds of a query plan.
TOOLS = ("hybrid_search", "get_chunk_neighbors", "inspect_document", "search_arxiv")
ENABLED_TOOLS = ("hybrid_search", "get_chunk_neighbors", "inspect_document")
MOST_CLAIMS, MOST_ACTIONS = 8, 5
MOST_TASKS, MOST_QUERIES, MOST_TASK_CHUNKS = 8, 5, 40
MOST_TERMS, MOST_SEMANTIC = 8, 3
DECISIONS = ("keep", "drop", "merge", "conflict")


def fingerprint(query: Column) -> Column:
    """A query as compared with others: squeezed, in lower case; null stays null."""
    return F.when(query.isNotNull(), F.lower(tx.squeeze(query)))


def _first_by(values: Column, key) -> Column:
    """Values whose key no earlier value has, empty ones dropped."""
    kept = F.filter(values, lambda x: x != "")
    keys = F.transform(kept, key)
    return F.filter(kept, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def clean_plan(plans: DataFrame, query_chars: int = 1000, term_chars: int = 120) -> DataFrame:
    """query_id, standalone_query, lexical_terms, synonyms, semantic_queries of raw plans, bounded and distinct.

    Plans without a standalone query go. The standalone query is the first semantic one.
    """
    line = lambda c, n: tx.bounded(c, n)
    terms = lambda c: F.slice(_first_by(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: line(x, term_chars)), F.lower), 1, MOST_TERMS)
    one = line(F.col("standalone"), query_chars)
    more = F.transform(F.coalesce("semantic", F.array().cast("array<string>")), lambda x: line(x, query_chars))
    semantic = F.slice(_first_by(F.concat(F.array(one), more), F.lower), 1, MOST_SEMANTIC)
    return plans.where(one != "").select("query_id", one.alias("standalone_query"), terms(F.col("lexical")).alias("lexical_terms"), terms(F.col("synonyms")).alias("synonyms"), semantic.alias("semantic_queries"))


def action_faults(actions: DataFrame) -> DataFrame:
    """plan_id, ord, faults of search actions (action_id, claim_ids, tool, query, chunk_id)."""
    distinct = F.size(F.array_distinct("claim_ids"))
    return actions.select(
        "plan_id", "ord",
        reasons(
            (~F.col("action_id").rlike("^A[1-9][0-9]*$"), "bad_action_id"),
            ((F.size("claim_ids") < 1) | (F.size("claim_ids") > MOST_CLAIMS), "claim_count"),
            (distinct != F.size("claim_ids"), "repeated_claim"),
            (~F.col("tool").isin(*TOOLS), "unknown_tool"),
            (F.col("tool").isin(*TOOLS) & ~F.col("tool").isin(*ENABLED_TOOLS), "tool_disabled"),
            (F.col("tool").isin("hybrid_search", "search_arxiv") & (tx.squeeze(F.col("query")) == ""), "query_required"),
            ((F.col("tool") == "get_chunk_neighbors") & F.col("chunk_id").isNull(), "chunk_required"),
        ).alias("faults"),
    )


def plan_faults(actions: DataFrame, claims: DataFrame) -> DataFrame:
    """plan_id, fault: repeated ids or queries, unknown claims, and counts beyond the limits, each once."""
    by_plan = lambda df, cond, name: df.where(cond).select("plan_id", F.lit(name).alias("fault"))
    ids = actions.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("action_id").alias("d"))
    named = claims.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("claim_id").alias("d"))
    asked = actions.where(F.col("query").isNotNull()).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(fingerprint(F.col("query"))).alias("d"))
    used = actions.select("plan_id", F.explode("claim_ids").alias("claim_id")).distinct()
    unknown = used.join(claims.select("plan_id", "claim_id").distinct(), ["plan_id", "claim_id"], "left_anti").select("plan_id", F.lit("unknown_claim").alias("fault")).distinct()
    out = by_plan(ids, "n <> d", "duplicate_action_id").unionByName(by_plan(ids, F.col("n") > MOST_ACTIONS, "action_limit"))
    out = out.unionByName(by_plan(named, "n <> d", "duplicate_claim_id")).unionByName(by_plan(named, F.col("n") > MOST_CLAIMS, "claim_limit"))
    return out.unionByName(by_plan(asked, "n <> d", "duplicate_query")).unionByName(unknown)


def scoped(actions: DataFrame, scopes: DataFrame) -> DataFrame:
    """Actions with their document forced to the plan's scope (plan_id, scope) where it has one and the tool takes a document."""
    forced = F.col("scope").isNotNull() & F.col("tool").isin("hybrid_search", "inspect_document")
    return actions.join(scopes, "plan_id", "left").withColumn("document_id", F.when(forced, F.col("scope")).otherwise(F.col("document_id"))).drop("scope")


def followup_faults(actions: DataFrame, claims: DataFrame, attempted: DataFrame, budget: Column) -> DataFrame:
    """plan_id, fault: the first reason to refuse a plan's follow-up actions, null where they are taken.

    claims: plan_id, claim_id, status; attempted: plan_id, query; budget: a column of actions.
    """
    open_ = claims.where("status IN ('missing', 'partial', 'conflicted')").groupBy("plan_id").agg(F.collect_set("claim_id").alias("open"))
    tried = attempted.select("plan_id", fingerprint(F.col("query")).alias("fp")).distinct().withColumn("tried", F.lit(True))
    a = actions.withColumn("left", budget).withColumn("fp", fingerprint(F.col("query"))).join(open_, "plan_id", "left").join(tried, ["plan_id", "fp"], "left")
    by = a.groupBy("plan_id").agg(
        (F.count(F.lit(1)) > F.max("left")).alias("over"),
        F.bool_or(~is_subset(F.col("claim_ids"), F.coalesce("open", F.array().cast("array<string>")))).alias("covered"),
        (F.bool_or(F.coalesce("tried", F.lit(False))) | (F.count("fp") != F.count_distinct("fp"))).alias("repeated"),
    )
    return by.select("plan_id", F.when(F.col("over"), "tool_budget_exceeded").when(F.col("covered"), "covered_claim_target").when(F.col("repeated"), "duplicate_query").alias("fault"))


def decision_faults(decisions: DataFrame) -> DataFrame:
    """pool_id, ord, faults of judge decisions (action, sources, target, statement, claims, confidence, reason)."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return decisions.select(
        "pool_id", "ord",
        reasons(
            (~F.col("action").isin(*DECISIONS), "unknown_action"),
            (F.size("sources") == 0, "no_source"),
            (F.col("action").isin("merge", "conflict") & F.col("target").isNull(), "target_required"),
            (F.col("action").isin("keep", "conflict") & blank("statement"), "statement_required"),
            ((F.col("action") != "drop") & (F.size("claims") == 0), "claims_required"),
            (F.size(F.array_distinct("claims")) != F.size("claims"), "repeated_claim"),
            (~F.col("confidence").between(0, 1), "confidence_range"),
            (blank("reason"), "reason_required"),
        ).alias("faults"),
    )


def judge_faults(decisions: DataFrame, claims: DataFrame, evidence: DataFrame, allowed: DataFrame, assessed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """pool_id, fault: what a judge's result says that its pool does not know, each once.

    claims: pool_id, claim_id, required; evidence: pool_id, evidence_id; allowed: pool_id,
    source_id; assessed: pool_id, claim_id, status; verdicts: pool_id, sufficient.
    """
    keys = lambda df, *c: df.select("pool_id", *c).distinct()
    fault = lambda df, name: df.select("pool_id", F.lit(name).alias("fault")).distinct()
    known, told = keys(claims, "claim_id"), keys(assessed, "claim_id")
    gaps = known.join(told, ["pool_id", "claim_id"], "left_anti").unionByName(told.join(known, ["pool_id", "claim_id"], "left_anti"))
    sources = decisions.select("pool_id", F.explode("sources").alias("source_id")).distinct().join(keys(allowed, "source_id"), ["pool_id", "source_id"], "left_anti")
    supports = decisions.select("pool_id", F.explode("claims").alias("claim_id")).distinct().join(known, ["pool_id", "claim_id"], "left_anti")
    targets = decisions.where("target IS NOT NULL").select("pool_id", F.col("target").alias("evidence_id")).distinct().join(keys(evidence, "evidence_id"), ["pool_id", "evidence_id"], "left_anti")
    open_ = claims.where("required").join(assessed.where("status = 'covered'").select("pool_id", "claim_id"), ["pool_id", "claim_id"], "left_anti")
    false = verdicts.where("sufficient").join(open_.select("pool_id").distinct(), "pool_id", "left_semi")
    parts = ((gaps, "incomplete_claim_assessment"), (sources, "unknown_source_ref"), (supports, "unknown_claim_id"), (targets, "unknown_target_evidence_id"), (false, "false_sufficiency"))
    out = None
    for df, name in parts:
        out = fault(df, name) if out is None else out.unionByName(fault(df, name))
    return out


def task_board(searches: DataFrame) -> DataFrame:
    """session_id, ord, task_id, fault of searches (session_id, ord, task_id, query) in order; null where one is taken.

    A session has 8 tasks, in order of first mention, and a task 5 different queries. A
    query that was taken before is a duplicate; one beyond the limit is refused again.
    """
    fp = fingerprint(F.col("query"))
    valid = (F.length(fp) > 0) & (F.length(fp) <= 1000)
    s = searches.withColumn("fp", F.when(F.coalesce(valid, F.lit(False)), fp))
    first_task = F.min("ord").over(Window.partitionBy("session_id", "task_id"))
    first_query = F.when(F.col("fp").isNotNull(), F.min("ord").over(Window.partitionBy("session_id", "task_id", "fp")))
    s = s.withColumn("t0", first_task).withColumn("q0", first_query)
    s = s.withColumn("task_no", F.dense_rank().over(Window.partitionBy("session_id").orderBy("t0")))
    s = s.withColumn("query_no", F.dense_rank().over(Window.partitionBy("session_id", "task_id").orderBy(F.col("q0").asc_nulls_last())))
    fault = (
        F.when(F.col("task_no") > MOST_TASKS, "task_limit_exceeded")
        .when(F.col("fp").isNull(), "invalid_task_query")
        .when(F.col("query_no") > MOST_QUERIES, "task_query_limit_exceeded")
        .when(F.col("ord") > F.col("q0"), "duplicate_task_query")
    )
    return s.select("session_id", "ord", "task_id", fault.alias("fault"))


def bounded_unique(rows: DataFrame, value: str, n: int, *keys: str, order: str = "ord") -> DataFrame:
    """keys, value, place of each group's first n different values, in order of first mention."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("__first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("__first", value))).where(F.col("place") <= n).drop("__first")


def unique_sources(sources: DataFrame) -> DataFrame:
    """session_id, ord, entry_url, pdf_url of web sources that share neither URL with one taken before them.

    What is taken depends on what was, so a session's sources, a bounded list, are folded in order.
    """
    item = F.struct("ord", "entry_url", "pdf_url")
    rows = F.sort_array(F.collect_list(item))
    none = F.slice(F.collect_list(item), 1, 0)

    def step(kept: Column, x: Column) -> Column:
        same = F.exists(kept, lambda y: (y["entry_url"] == x["entry_url"]) | F.coalesce(y["pdf_url"] == x["pdf_url"], F.lit(False)))
        return F.when(same, kept).otherwise(F.concat(kept, F.array(x)))

    by = sources.where("entry_url <> ''").groupBy("session_id").agg(rows.alias("rows"), none.alias("none"))
    return by.select("session_id", F.explode(F.aggregate("rows", F.col("none"), step)).alias("x")).select("session_id", "x.*")


def no_progress(rounds: DataFrame, limit: int = 2) -> DataFrame:
    """session_id, stalled_round: the first round at which the sources (session_id, round, sources) stood still `limit` rounds in a row; null without one."""
    w = Window.partitionBy("session_id").orderBy("round")
    same = F.coalesce((F.col("sources") == F.lag("sources").over(w)).cast("int"), (F.col("sources") == 0).cast("int"))
    r = rounds.withColumn("same", same)
    r = r.withColumn("run", F.sum("same").over(w.rowsBetween(1 - limit, 0))).withColumn("seen", F.row_number().over(w))
    return r.groupBy("session_id").agg(F.min(F.when((F.col("run") == limit) & (F.col("seen") >= limit), F.col("round"))).alias("stalled_round"))


def same_ids(before: DataFrame, after: DataFrame, key: str, *groups: str) -> DataFrame:
    """groups, missing, added, repeated: how the ids of a reranked list differ from those it was given; 0, 0, 0 if unchanged."""
    b = before.groupBy(*groups, key).agg(F.lit(1).alias("b"))
    a = after.groupBy(*groups, key).agg(F.count(F.lit(1)).alias("a"))
    j = b.join(a, [*groups, key], "full_outer")
    return j.groupBy(*groups).agg(F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a") > 1).alias("repeated"))


def decision_counts(decisions: DataFrame) -> DataFrame:
    """pool_id with the number of decisions of each kind and the sources of those that stay."""
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return decisions.groupBy("pool_id").agg(*(count(a) for a in DECISIONS), F.sum(F.when(F.col("action") != "drop", F.size("sources")).otherwise(0)).alias("active_sources"))


def selected_sources(evidence: DataFrame, ledger: DataFrame) -> DataFrame:
    """session_id, source_id, evidence_id, place: each source that the ledger has, at its first mention in the pool's order."""
    each = evidence.select("session_id", "evidence_id", "ord", F.posexplode("sources").alias("i", "source_id"))
    first = each.groupBy("session_id", "source_id").agg(F.min(F.struct("ord", "i", "evidence_id")).alias("f"))
    there = first.join(ledger.select("session_id", "source_id").distinct(), ["session_id", "source_id"], "left_semi")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("f.ord", "f.i"))
    return there.select("session_id", "source_id", F.col("f.evidence_id").alias("evidence_id"), place.alias("place"))


def synced_claims(claims: DataFrame, packed: DataFrame) -> DataFrame:
    """claims (pool_id, claim_id, evidence_ids) with only the evidence that is still packed, in its order."""
    left = packed.groupBy("pool_id").agg(F.collect_set("evidence_id").alias("packed"))
    kept = F.array_intersect("evidence_ids", F.coalesce("packed", F.array().cast("array<string>")))
    return claims.join(left, "pool_id", "left").select("pool_id", "claim_id", kept.alias("evidence_ids"))


def source_aliases(sources: DataFrame) -> DataFrame:
    """url, source_id: both URLs of each source (source_id, url, pdf_url); of sources with one URL the last id."""
    each = sources.select("source_id", F.explode(F.array_distinct(F.array("url", F.coalesce("pdf_url", "url")))).alias("url"))
    return each.groupBy("url").agg(F.max("source_id").alias("source_id"))


def retrieval_traces(ranked: DataFrame, degraded: DataFrame) -> DataFrame:
    """query_id, type, candidates, degraded: the trace rows of a retrieval, with one more where a channel failed.

    ranked: query_id, bm25_rank, vector_rank; degraded: query_id, channel.
    """
    n = ranked.groupBy("query_id").agg(F.count("bm25_rank").alias("bm25"), F.count("vector_rank").alias("vector"), F.count(F.lit(1)).alias("all"))
    lost = degraded.groupBy("query_id").agg(F.array_sort(F.collect_set("channel")).alias("lost"))
    j = n.join(lost, "query_id", "full_outer").withColumn("lost", F.coalesce("lost", F.array().cast("array<string>")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    row = lambda kind, n, bad: F.struct(F.lit(kind).alias("type"), n.cast("bigint").alias("candidates"), bad.alias("degraded"))
    has = lambda c: F.array_contains("lost", c)
    any_ = F.size("lost") > 0
    rows = F.array(row("bm25_retrieval", zero("bm25"), has("bm25")), row("vector_retrieval", zero("vector"), has("vector")), row("retrieval_fusion", zero("all"), any_))
    rows = F.when(any_, F.concat(rows, F.array(row("retrieval_degraded", F.size("lost"), any_)))).otherwise(rows)
    return j.select("query_id", F.explode(rows).alias("x")).select("query_id", "x.*")


def legacy_hits(items: DataFrame, limit: int = 5) -> DataFrame:
    """query_id, chunk_id, score, fusion_rank of loosely typed hits (query_id, ord, chunk_id, score as text).

    Scores that are no positive number go; places are those of the list as it came.
    """
    score = F.col("score").try_cast("double")
    kept = items.select("query_id", (F.col("ord") + 1).alias("fusion_rank"), F.coalesce(F.col("chunk_id").try_cast("bigint"), F.col("ord") + 1).alias("chunk_id"), score.alias("score")).where("score > 0 AND NOT isnan(score)")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("fusion_rank"))).where(F.col("n") <= limit).drop("n")


def answer_sources(sources: DataFrame, limit: int = 8) -> DataFrame:
    """session_id, ord, url: the first of each URL, without those that carry a secret, up to the limit."""
    clean = sources.where(~F.col("url").rlike(tx.SECRET_URL_PATTERN))
    first = clean.groupBy("session_id", "url").agg(F.min("ord").alias("ord"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("ord"))).where(F.col("n") <= limit).select("session_id", "ord", "url")


def cited_documents(messages: DataFrame) -> DataFrame:
    """session_id, document_id, page_number, chunk_index, title: each place cited in the messages' JSON, titles by its last mention.

    citations: JSON with a list `local`; malformed messages and entries are skipped.
    """
    entry = "struct<document_id:bigint,title:string,page_number:bigint,chunk_index:bigint>"
    listed = F.from_json("citations", f"struct<local:array<{entry}>>")
    each = messages.select("session_id", "ord", F.posexplode(listed["local"]).alias("i", "c")).select("session_id", "ord", "i", "c.*")
    full = each.dropna(subset=["document_id", "title", "page_number", "chunk_index"])
    return full.groupBy("session_id", "document_id", "page_number", "chunk_index").agg(F.max_by("title", F.struct("ord", "i")).alias("title"))


def conservative(packs: DataFrame) -> DataFrame:
    """answer_id, status, answer: what is said where no checked answer stands (answer_id, statements, failed)."""
    listed = F.array_join("statements", " ")
    return packs.select(
        "answer_id",
        F.when(F.size("statements") == 0, "insufficient").when(F.col("failed"), "verification_failed").otherwise("unverified").alias("status"),
        F.when(F.size("statements") == 0, F.lit("Evidence is insufficient.")).when(F.col("failed"), F.concat(F.lit("Evidence could not be verified. "), listed)).otherwise(F.concat(F.lit("No consistent answer. "), listed)).alias("answer"),
    )


def settle_answers(drafts: DataFrame) -> DataFrame:
    """answer_id, attempts, outcome, answer: draft, one repair, then the conservative text.

    drafts: answer_id, attempt (1 or 2), answer, faults, fallback. The first attempt without
    faults is taken; later attempts than the second are never made.
    """
    tried = drafts.where("attempt <= 2").groupBy("answer_id").agg(
        F.min(F.when(F.size("faults") == 0, F.struct("attempt", "answer"))).alias("good"), F.max("attempt").alias("attempts"), F.max("fallback").alias("fallback")
    )
    outcome = F.when(F.col("good").isNull(), "conservative").when(F.col("good.attempt") == 1, "verified").otherwise("repaired")
    return tried.select("answer_id", F.coalesce("good.attempt", "attempts").alias("attempts"), outcome.alias("outcome"), F.coalesce("good.answer", "fallback").alias("answer"))


def research_status(rounds: DataFrame, max_rounds: int = 3, max_calls: int = 5) -> DataFrame:
    """session_id, rounds, status of an agent's loop over (session_id, round, sufficient, sources, calls).

    The loop ends at the first round that is sufficient (completed), the second in a row
    without a new source (stalled), or a bound of rounds or calls (limit); rows after that
    are not counted.
    """
    w = Window.partitionBy("session_id").orderBy("round")
    before = F.coalesce(F.lag("sources").over(w), F.lit(0))
    r = rounds.withColumn("still", (F.col("sources") == before).cast("int")).withColumn("used", F.sum("calls").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("stuck", (F.sum("still").over(w.rowsBetween(-1, 0)) == 2) & (F.row_number().over(w) > 1))
    status = F.when(F.col("sufficient"), "completed").when(F.col("stuck"), "stalled").when((F.col("round") >= max_rounds) | (F.col("used") >= max_calls), "limit")
    ended = r.withColumn("status", status).groupBy("session_id").agg(F.min(F.when(F.col("status").isNotNull(), F.struct("round", "status"))).alias("end"), F.max("round").alias("last"))
    return ended.select("session_id", F.coalesce("end.round", "last").alias("rounds"), F.coalesce("end.status", F.lit("open")).alias("status"))


def suggestion_faults(suggestions: DataFrame) -> DataFrame:
    """suggestion_id, faults of memory suggestions (action, target_id, merged, reason)."""
    return suggestions.select(
        "suggestion_id",
        reasons(
            (~F.col("action").isin("ADD", "UPDATE", "MERGE", "SUPERSEDE", "IGNORE"), "unknown_action"),
            (F.col("action").isin("UPDATE", "MERGE", "SUPERSEDE") & F.col("target_id").isNull(), "target_required"),
            ((F.col("action") == "ADD") & F.col("target_id").isNotNull(), "add_cannot_target"),
            ((F.col("action") == "MERGE") != F.col("merged").isNotNull(), "merged_content_only_for_merge"),
            (F.length(F.trim(F.coalesce("reason", F.lit("")))) == 0, "reason_required"),
            (F.length("merged") > 1000, "merged_too_long"),
        ).alias("faults"),
    )


def changed_snapshots(before: DataFrame, after: DataFrame, *fields: str) -> DataFrame:
    """session_id of sessions whose projected fields differ, null as empty; findings and evidence are never compared."""
    empty = lambda side, f: F.coalesce(F.col(f"{side}.{f}"), F.lit(""))
    j = before.alias("b").join(after.alias("a"), "session_id", "full_outer")
    differ = F.lit(False)
    for f in fields:
        differ = differ | (empty("b", f) != empty("a", f))
    return j.where(differ).select("session_id")


def failure_class(kind: Column, message: Column) -> Column:
    """category, code and retryable of a failure by its kind and message."""
    # Provider codes after which a retry may help.
    transient = ("timeout", "connection_error", "rate_limited", "server_error")
    busy = F.lower(message).rlike("locked|busy")
    out = lambda category, code, again: F.struct(F.lit(category).alias("category"), code.alias("code"), F.lit(again).alias("retryable"))
    return (
        F.when(kind == "schema", out("validation", F.lit("schema_invalid"), False))
        .when((kind == "model") & message.isin(*transient), out("transient", message, True))
        .when(kind == "model", out("permanent", F.coalesce(message, F.lit("model_error")), False))
        .when(kind == "connection", out("transient", F.lit("timeout"), True))
        .when((kind == "database") & busy, out("transient", F.lit("database_busy"), True))
        .when(kind == "database", out("permanent", F.lit("database_error"), False))
        .when(kind == "value", out("validation", F.lit("invalid_argument"), False))
        .otherwise(out("permanent", F.lit("internal_error"), False))
    )


def retry_delay(index: Column, draw: Column, remaining: Column, retry_after: Column, base: float = 0.5, cap: float = 8.0) -> Column:
    """Seconds before the next attempt: what the server asked, or a share (draw in 0..1) of a doubling ceiling; null to give up."""
    wait = F.coalesce(retry_after, draw * F.least(F.lit(cap), base * F.pow(F.lit(2.0), index)))
    return F.when((remaining > 0) & (wait >= 0) & (wait < remaining), wait)


def tokens_per_second(tokens: Column, elapsed_ms: Column) -> Column:
    return F.when(elapsed_ms > 0, tokens * 1000 / elapsed_ms)


def cache_reuse(prompt: Column, prefill: Column) -> Column:
    """reused, ratio of prompt tokens that needed no prefill; null where either is unknown."""
    reused = F.when(prompt.isNotNull() & prefill.isNotNull(), F.greatest(F.lit(0).cast("bigint"), (prompt - prefill).cast("bigint")))
    return F.struct(reused.alias("reused"), F.when(prompt > 0, reused / prompt).alias("ratio"))


def parameter_billions(model: Column) -> Column:
    """Billions of parameters that a model's name tells; infinity where it tells none of the known sizes."""
    size = F.regexp_extract(F.lower(model), r"(?:^|[^0-9])(0\.6|1\.7|4)b", 1)
    return F.when(size != "", size.cast("double")).otherwise(F.lit(float("inf")))


def loose_json(raw: Column, *keys: str) -> Column:
    """Values of the keys in a model's answer: fences stripped, the outermost braces parsed, lists as dashed lines; blank ones null."""
    open_ = F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*", "")
    body = F.regexp_extract(F.regexp_replace(open_, r"\s*```$", ""), r"(?s)(\{.*\})", 1)
    parsed = F.try_parse_json(F.when(body != "", body).otherwise(open_))

    def value(key: str) -> Column:
        listed = F.try_variant_get(parsed, f"$.{key}", "array<string>")
        plain = F.when(F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant")) == "STRING", F.try_variant_get(parsed, f"$.{key}", "string"))
        text = F.coalesce(F.array_join(F.transform(listed, lambda x: F.concat(F.lit("- "), x)), "\n"), plain)
        return F.nullif(F.trim(text), F.lit(""))

    return F.struct(*(value(k).alias(k) for k in keys))


def stripped_markers(answer: Column) -> Column:
    """An answer without its evidence and document markers, and without the space before punctuation that they leave."""
    gone = F.regexp_replace(answer, r"\s*\[(?:E[0-9]+|chunk:[0-9]+|doc:[0-9]+\|page:[0-9]+)\]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(gone, r"[ \t]+([,.;:!?])", "$1"), r"[ \t]{2,}", " "))


def hint_sentences(text: Column, hints: tuple[str, ...], limit: int = 3, least: int = 13) -> Column:
    """The first sentences that hold one of the hints, in any case; a sentence has at least so many characters."""
    cut = F.split(F.regexp_replace(tx.squeeze(text), r"([.!?。！？]) ", "$1\x01"), "\x01")
    whole = F.filter(F.transform(cut, tx.trimmed), lambda s: F.length(s) >= least)
    held = lambda s: F.exists(F.array(*(F.lit(h.lower()) for h in hints)), lambda h: F.contains(tx.folded(s), h))
    return F.slice(F.filter(whole, held), 1, limit)


def mapped_terms(text: Column, terms: dict[str, str]) -> Column:
    """Names of the terms that a text holds, in the map's order, each once."""
    low = tx.folded(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.filter(F.array(*(F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in terms.items())), lambda x: x.isNotNull()))


def tool_call_faults(calls: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """call_id, fault of tool calls (call_id, tool, args as JSON): unknown tool, malformed arguments or names beyond the allow-list."""
    keys = F.json_object_keys("args")
    table = F.create_map(*(x for tool, names in allowed.items() for x in (F.lit(tool), F.array(*(F.lit(n) for n in names)))))
    names = table[F.col("tool")]
    return calls.select("call_id", F.when(names.isNull(), "unknown_tool").when(keys.isNull(), "invalid_arguments").when(~is_subset(keys, names), "argument_not_allowed").alias("fault"))
