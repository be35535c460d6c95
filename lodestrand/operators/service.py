"""Rules around the engine as a service: uploads, outbox states, progress, memory candidates, checked answers, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as tx
from lodestrand.functions.contracts import is_subset, reasons


def upload_faults(uploads: DataFrame) -> DataFrame:
    """upload_id, faults of uploads (upload_id, name, content as text of its bytes): type, magic, encryption, pages."""
    body = F.coalesce("content", F.lit(""))
    return uploads.select(
        "upload_id",
        reasons(
            (~F.lower(F.coalesce("name", F.lit(""))).endswith(".pdf"), "file_type"),
            (~body.startswith("%PDF-"), "magic"),
            (F.contains(body, F.lit("/Encrypt")), "encrypted"),
            (~body.rlike(r"/Type\s*/Page[^s]"), "no_pages"),
        ).alias("faults"),
    )


def outbox_states(log: DataFrame, most: int = 3) -> DataFrame:
    """op_id, status, attempts, last_error of a durable outbox by its log (op_id, ord, kind, error).

    kind: queued, failed, acked, applied. An operation is done when both stores have it:
    acknowledged by the index, then applied; it is dead after `most` failures without that.
    """
    n = lambda k: F.count_if(F.col("kind") == k)
    g = log.groupBy("op_id").agg(n("failed").alias("attempts"), (n("acked") > 0).alias("acked"), (n("applied") > 0).alias("applied"), F.max_by("error", F.when(F.col("kind") == "failed", F.col("ord"))).alias("last_error"))
    status = F.when(F.col("acked") & F.col("applied"), "done").when(F.col("attempts") >= most, "dead").when(F.col("acked"), "acked").otherwise("pending")
    return g.select("op_id", status.alias("status"), "attempts", "last_error")


def progress_log(events: DataFrame, beat: float = 5.0) -> DataFrame:
    """session_id, seq, kind, beats of progress events (session_id, ord, t in seconds, kind, terminal) up to the first terminal one.

    beats is how many heartbeats fall into the silence before an event.
    """
    w = Window.partitionBy("session_id").orderBy("ord")
    ended = F.coalesce(F.max(F.col("terminal").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = events.withColumn("ended", ended).withColumn("gap", F.col("t") - F.lag("t").over(w)).withColumn("seq", F.row_number().over(w))
    beats = F.greatest(F.lit(0), F.ceil(F.coalesce("gap", F.lit(0.0)) / beat) - 1).cast("bigint")
    return e.where("ended = 0").select("session_id", "seq", "kind", beats.alias("beats"))


def memory_candidates(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """candidate_id, fault of proposed memories (candidate_id, kind, content, confidence); null where one is staged.

    existing: memory_id, kind, content, status. Contents meet by their squeezed lower case; a
    kind with an operation on its way waits.
    """
    key = lambda c: F.lower(tx.squeeze(F.col(c)))
    known = existing.where("status = 'active'").select(key("content").alias("k"), F.lit(True).alias("known")).distinct()
    busy = existing.where("status = 'syncing'").select("kind", F.lit(True).alias("busy")).distinct()
    j = candidates.withColumn("k", key("content")).join(known, "k", "left").join(busy, "kind", "left")
    earlier = F.row_number().over(Window.partitionBy("k").orderBy("candidate_id")) > 1
    fault = (
        F.when(F.col("k") == "", "empty_content")
        .when(F.length("k") > 1000, "too_long")
        .when(F.col("confidence") < 0.8, "low_confidence")
        .when(F.col("content").rlike(tx.EVIDENCE_MARKER_PATTERN), "evidence_marker")
        .when(F.col("known"), "exact_duplicate")
        .when(F.col("earlier"), "repeated_candidate")
        .when(F.col("busy"), "same_type_sync_pending")
    )
    return j.withColumn("earlier", earlier).select("candidate_id", fault.alias("fault"))


def checked_answers(answers: DataFrame) -> DataFrame:
    """answer_id, faults of answers (answer_id, text, known: evidence ids, required: claims, claimed): markers in the text are its citations."""
    cited = F.transform(F.regexp_extract_all("text", F.lit(r"\[(E[0-9]+)\]"), F.lit(1)), lambda x: x)
    return answers.withColumn("cited", cited).select(
        "answer_id", F.size("cited").alias("citations"),
        reasons(
            (F.trim(F.coalesce("text", F.lit(""))) == "", "empty_answer"),
            (F.size("cited") == 0, "no_citation"),
            (~is_subset(F.col("cited"), F.col("known")), "unknown_citation"),
            (~is_subset(F.col("required"), F.col("claimed")), "claim_not_answered"),
        ).alias("faults"),
    )


def settings(lines: DataFrame) -> DataFrame:
    """name, value of `.env` lines (file_no, line_no, line): comments and malformed lines skipped, quotes taken off, the last file and line win."""
    raw = F.regexp_extract("line", r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=", 1)
    value = F.trim(F.regexp_replace("line", r"^[^=]*=", ""))
    bare = F.when(value.rlike("^(\".*\"|'.*')$"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(F.trim(F.regexp_replace(value, r"\s+#.*$", "")))
    return lines.select("file_no", "line_no", raw.alias("name"), bare.alias("value")).where("name <> ''").groupBy("name").agg(F.max_by("value", F.struct("file_no", "line_no")).alias("value"))


def settings_faults(values: dict[str, float]) -> list[str]:
    """Names of the invariants that numbers of a configuration break."""
    v = values.get
    broken = {
        "weights": abs(v("semantic_weight", 0.8) + v("recency_weight", 0.2) - 1) > 1e-9,
        "pack_budget": v("pack_tokens", 12_000) > v("judge_tokens", 24_000),
        "window": v("reserve_tokens", 16_384) + v("recent_tokens", 20_000) >= v("window_tokens", 128_000),
        "timeouts": not 0 < v("connect_seconds", 5) <= v("read_seconds", 60) <= v("total_seconds", 180),
        "candidates": v("final_evidence", 5) > v("fusion_candidates", 20),
    }
    return [name for name, bad in broken.items() if bad]


def trace_events(events: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """session_id, ord, type, payload as JSON of raw agent events (session_id, ord, kind, data as JSON); kinds not listed are dropped.

    fields: for each kind the names that may leave it; others never do.
    """
    known = events.where(F.col("kind").isin(*fields))
    payload = F.lit(None).cast("string")
    for kind, names in fields.items():
        picked = F.to_json(F.struct(*(F.get_json_object("data", f"$.{n}").alias(n) for n in names)))
        payload = F.when(F.col("kind") == kind, picked).otherwise(payload)
    return known.select("session_id", "ord", F.concat(F.lit("agent_"), F.col("kind")).alias("type"), payload.alias("payload"))


def bounded_payloads(items: DataFrame, excerpt: int = 200, total: int = 1000) -> DataFrame:
    """group_id, payload: items (group_id, ord, title, text) cut to an excerpt each, as many as fit the total, as one JSON list."""
    cut = items.select("group_id", "ord", tx.bounded(F.col("title"), 80).alias("title"), tx.bounded(F.col("text"), excerpt).alias("excerpt"))
    w = Window.partitionBy("group_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    fit = cut.withColumn("used", F.sum(F.length("excerpt")).over(w)).where(F.col("used") <= total)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ord", "title", "excerpt"))), lambda x: F.struct(x["title"].alias("title"), x["excerpt"].alias("excerpt")))
    return fit.groupBy("group_id").agg(F.to_json(listed).alias("payload"))


def metadata_answers(questions: DataFrame, facts: DataFrame, labels: dict[str, str]) -> DataFrame:
    """question_id, answer: a count or an inventory said in words (questions: question_id, operation; facts: operation, n)."""
    named = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    j = questions.join(facts, "operation", "left")
    return j.select("question_id", F.when(F.col("n").isNull(), "unknown").otherwise(F.concat_ws(" ", F.col("n").cast("string"), named[F.col("operation")])).alias("answer"))


def dev_test_k(scores: DataFrame, hit: float = 0.9, documents: float = 0.95) -> DataFrame:
    """group_id, k, test_hit: the smallest k whose development scores pass, with its score on the other part; the largest k without one.

    scores: group_id, part, k, hit, documents.
    """
    dev = scores.where("part = 'dev'").groupBy("group_id").agg(F.min(F.when((F.col("hit") >= hit) & (F.col("documents") >= documents), F.col("k"))).alias("good"), F.max("k").alias("largest"))
    chosen = dev.select("group_id", F.coalesce("good", "largest").alias("k"))
    test = scores.where("part = 'test'").select("group_id", "k", F.col("hit").alias("test_hit"))
    return chosen.join(test, ["group_id", "k"], "left")


def two_phase(log: DataFrame) -> DataFrame:
    """key, state of memory writes around a checkpoint by their log (key, ord, kind): a write counts once a checkpoint and then a commit follow it.

    kind: prepared, checkpoint, committed. prepared without a checkpoint is to be undone, one
    with a checkpoint but no commit to be finished.
    """
    first = lambda k: F.min(F.when(F.col("kind") == k, F.col("ord")))
    g = log.groupBy("key").agg(first("prepared").alias("p"), F.max(F.when(F.col("kind") == "checkpoint", F.col("ord"))).alias("c"), F.max(F.when(F.col("kind") == "committed", F.col("ord"))).alias("d"))
    saved = F.coalesce(F.col("c") > F.col("p"), F.lit(False))
    state = F.when(F.col("p").isNull(), "none").when(~saved, "undo").when(F.coalesce(F.col("d") > F.col("c"), F.lit(False)), "done").otherwise("finish")
    return g.select("key", state.alias("state"))


def overflow_outcomes(messages: DataFrame, window: int, keep: int) -> DataFrame:
    """session_id, before, after, outcome: a session over the window is compacted to its last messages within `keep` tokens and tried once more.

    messages: session_id, ord, tokens. fits, retried, or failed where what is kept is still too long.
    """
    w = Window.partitionBy("session_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    m = messages.withColumn("recent", F.sum("tokens").over(w)).withColumn("newest", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ord"))) == 1)
    kept = F.sum(F.when((F.col("recent") <= keep) | F.col("newest"), F.col("tokens")).otherwise(0))
    g = m.groupBy("session_id").agg(F.sum("tokens").alias("before"), kept.alias("kept"))
    fits = F.col("before") < window
    return g.select("session_id", "before", F.when(fits, F.col("before")).otherwise(F.col("kept")).alias("after"), F.when(fits, "fits").when(F.col("kept") < window, "retried").otherwise("failed").alias("outcome"))


def early_external(calls: DataFrame) -> DataFrame:
    """session_id, ord of external searches that no local search of their session comes before (session_id, ord, tool)."""
    local = F.min(F.when(F.col("tool") == "local", F.col("ord"))).over(Window.partitionBy("session_id"))
    return calls.withColumn("first_local", local).where((F.col("tool") == "external") & (F.col("first_local").isNull() | (F.col("ord") < F.col("first_local")))).select("session_id", "ord")


def context_faults(ranked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """case_id, chunk_id of the first k hits of each case (case_id, rank, chunk_id) that storage lacks: a run with any must not go on."""
    return ranked.where(F.col("rank") <= k).join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").select("case_id", "chunk_id").distinct()


def corpus_reuse(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """name, document_id, action: files already stored under the same path are used again, others ingested; a path stored twice is ambiguous.

    Paths are compared with forward slashes, without `.` parts and in lower case.
    """
    key = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.translate(F.col(c), "\\", "/"), r"/(?:\./)+", "/"), "/+", "/"))
    known = stored.groupBy(key("path").alias("k")).agg(F.min("document_id").alias("document_id"), F.count(F.lit(1)).alias("n"))
    j = wanted.withColumn("k", key("path")).join(known, "k", "left")
    return j.select("name", F.when(F.col("n") == 1, F.col("document_id")).alias("document_id"), F.when(F.col("n").isNull(), "ingest").when(F.col("n") == 1, "reuse").otherwise("ambiguous").alias("action"))


def loaded_rewrites(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rewrites (source, case_id, query, terms) of JSON files (source, body), and the case ids that a file repeats."""
    schema = "struct<cases:array<struct<case_id:string,english_query:string,lexical_terms:array<string>>>>"
    each = files.select("source", F.explode(F.from_json("body", schema)["cases"]).alias("c")).select("source", "c.case_id", F.col("c.english_query").alias("query"), F.col("c.lexical_terms").alias("terms"))
    return each, each.groupBy("source", "case_id").count().where("count > 1").select("source", "case_id")


def raw_spans(pages: DataFrame) -> DataFrame:
    """page_id, block_no, line_no, span_no, font, text of an extractor's nested JSON (page_id, body)."""
    schema = "struct<blocks:array<struct<type:int,lines:array<struct<spans:array<struct<font:string,text:string>>>>>>>"
    b = pages.select("page_id", F.posexplode(F.from_json("body", schema)["blocks"]).alias("block_no", "b")).where("b.type = 0")
    l = b.select("page_id", "block_no", F.posexplode("b.lines").alias("line_no", "l"))
    return l.select("page_id", "block_no", "line_no", F.posexplode("l.spans").alias("span_no", "s")).select("page_id", "block_no", "line_no", "span_no", "s.font", "s.text")


def rule_summary(flags: DataFrame) -> DataFrame:
    """doc_id, summary from what was found in a text (doc_id, topic, method, experiment, limitation): a line for each part, a stock one where nothing was."""
    part = lambda c, name, stock: F.concat(F.lit(f"{name}: "), F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(stock)))
    return flags.select("doc_id", F.concat_ws("\n", part("topic", "topic", "not stated"), part("method", "method", "not described"), part("experiment", "experiment", "not reported"), part("limitation", "limitation", "none named")).alias("summary"))
