"""Streaming queries, each run over what is there now; SQL gives the batch result they must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import seams, stemming
from lodestrand.operators import evals
from lodestrand.operators.bm25 import small
from lodestrand.operators.chunking import chunk_documents
from lodestrand.plans.registry import Tables, query
from lodestrand.runtime import shared_dir
from lodestrand.sources import writers
from lodestrand.streaming import events as sv
from lodestrand.streaming import stateful


def _events(t: Tables) -> DataFrame:
    return sv.read_stream(t.spark, f"{t.sf_dir}/events.parquet")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def stream_transcript(t: Tables) -> DataFrame:
    """Events sent twice are kept once."""
    e = _events(t)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return sv.run_available(sv.transcript(twice).select("event_id", "user_id", "event_type"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase')")
def stream_progress(t: Tables) -> DataFrame:
    return sv.run_available(sv.progress(_events(t), ("error", "purchase")).select("event_id", "event_type"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(t: Tables) -> DataFrame:
    """Daily windows in complete mode: all windows, open ones too."""
    w = _events(t).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    out = sv.run_available(w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total"), "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s),
    g AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM i GROUP BY user_id, k)
    SELECT user_id, session_start, session_end, n FROM g WHERE session_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
)
def stream_sessions(t: Tables) -> DataFrame:
    """Sessions that the watermark has closed."""
    out = sv.run_available(sv.session_windows(_events(t)))
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query()
def stream_breaker(t: Tables) -> DataFrame:
    """A circuit breaker per user over errors, with windows of hours as the log is sparse."""
    e = _events(t).select("user_id", "event_id", F.unix_micros("ts").cast("double").alias("t"), (F.col("event_type") == "error").alias("failed"))
    hour = 3600e6
    return sv.run_available(sv.circuit_breaker(e, limit=3, window=12 * hour, opened=3 * hour))


@query()
def stream_permits(t: Tables) -> DataFrame:
    """A breaker with generations per user: each event is a call that ends some minutes later, an error as a transient failure."""
    e = _events(t).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("long").alias("call_id"), "ts", "event_type")
    kind = F.when(F.col("event_type") == "error", "transient").when(F.col("event_type") == "purchase", "fatal").otherwise("success")
    ends = F.col("ts") + F.make_interval(mins=(F.col("call_id") % 240).cast("int"))
    steps = F.array(F.struct(F.lit(0).alias("seq"), F.col("ts").alias("at"), F.lit("acquire").alias("kind")), F.struct(F.lit(1).alias("seq"), ends.alias("at"), kind.alias("kind")))
    calls = e.select("key", "call_id", F.explode(steps).alias("s")).select("key", "call_id", "s.seq", F.col("s.at").alias("ts"), "s.kind").withWatermark("ts", "0 seconds")
    return sv.run_available(stateful.call_permits(calls, limit=2, window_s=48 * 3600, open_s=6 * 3600), provider=stateful.PROVIDER)


@query()
def stream_compactions(t: Tables) -> DataFrame:
    """Checkpoints of conversations whose messages outgrow a window of 120 tokens."""
    c = sv.read_stream(t.spark, f"{t.sf_dir}/conversations.parquet")
    m = c.select(F.col("conv_id").cast("long").alias("session"), F.col("turn").cast("long").alias("turn"), "role", "text", F.timestamp_seconds(F.col("turn")).alias("ts"))
    return sv.run_available(stateful.compactions(m, window=120, reserve=20, keep_recent=40), provider=stateful.PROVIDER)


@query()
def stream_retries(t: Tables) -> DataFrame:
    """Attempts of a user's calls, one for each kind of event, under a deadline of days and a shared budget."""
    e = _events(t).select(F.col("user_id").cast("string").alias("request"), F.pmod(F.xxhash64("event_type"), F.lit(1000)).alias("call_id"), "ts", F.when(F.col("event_type") == "error", "permanent").when(F.col("value") > 40, "transient").otherwise("success").alias("kind"), F.when(F.col("value") > 180, F.col("value") * 1000).alias("retry_after_ms"))
    return sv.run_available(stateful.retries(e, most=3, budget=5, timeout_s=20 * 86_400.0), provider=stateful.PROVIDER)


@query("SELECT conv_id AS request_id, CAST(count(*) AS BIGINT) AS tokens, string_agg(role, '' ORDER BY turn) AS text, CAST(min(turn) * 10.0 AS DOUBLE) AS first_token_ms, CAST(max(turn) * 10.0 + 5 AS DOUBLE) AS total_ms FROM conversations GROUP BY conv_id")
def stream_tokens(t: Tables) -> DataFrame:
    """Turns as streamed pieces, with a terminal piece after the last."""
    c = sv.read_stream(t.spark, f"{t.sf_dir}/conversations.parquet")
    last = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last"))
    j = c.join(last, "conv_id")
    pieces = F.when(F.col("turn") == F.col("last"), F.array(F.struct(F.col("turn").alias("seq"), (F.col("turn") * 10.0).alias("ms"), F.col("role").alias("piece"), F.lit(False).alias("terminal")), F.struct((F.col("turn") + 1).alias("seq"), (F.col("turn") * 10.0 + 5).alias("ms"), F.lit("").alias("piece"), F.lit(True).alias("terminal")))).otherwise(F.array(F.struct(F.col("turn").alias("seq"), (F.col("turn") * 10.0).alias("ms"), F.col("role").alias("piece"), F.lit(False).alias("terminal"))))
    e = j.select(F.col("conv_id").alias("request_id"), F.explode(pieces).alias("p")).select("request_id", "p.*")
    return sv.run_available(sv.token_stream(e))


@query("SELECT user_id AS id, max(event_id) AS version, arg_max(event_type, event_id) AS content FROM events GROUP BY user_id")
def stream_outbox(t: Tables) -> DataFrame:
    """Operations applied by an idempotent keyed sink: the newest state of each key."""
    base = f"{shared_dir(t.spark)}/outbox-{uuid.uuid4().hex}"
    ops = _events(t).select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.col("event_type").alias("content"))
    sv.outbox(ops, sv.keyed_upsert(f"{base}/rows"), f"{base}/state").awaitTermination()
    return sv.upserted(t.spark, f"{base}/rows", ["id", "version", "content"])


# ---- sinks ----


@query("SELECT doc_id, source AS bucket, CASE WHEN source = 'src3' THEN 'second' ELSE 'first' END AS written FROM documents")
def document_replace(t: Tables) -> DataFrame:
    """One bucket written anew; the others stay as they were."""
    path = f"{shared_dir(t.spark)}/replace-{uuid.uuid4().hex}"
    d = t.documents.select("doc_id", F.col("source").alias("bucket"))
    writers.replace_documents(d.withColumn("written", F.lit("first")), path)
    writers.replace_documents(d.where("bucket = 'src3'").withColumn("written", F.lit("second")), path)
    return t.spark.read.parquet(path).select("doc_id", "bucket", "written")


@query("SELECT doc_id AS case_id, source AS signature, CASE WHEN lang = 'de' THEN 2 ELSE 1 END AS attempts FROM documents")
def resumed_run(t: Tables) -> DataFrame:
    """A run in which one language's cases failed, and the run that resumes it."""
    path = f"{shared_dir(t.spark)}/resume-{uuid.uuid4().hex}"
    cases = t.documents.select(F.col("doc_id").alias("case_id"), F.col("source").alias("signature"), "lang")
    writers.resume(cases, path, lambda c: c.withColumn("error", F.when(F.col("lang") == "de", "timeout")))
    out = writers.resume(cases, path, lambda c: c.withColumn("error", F.lit(None).cast("string")))
    return out.groupBy("case_id", "signature").agg(F.count(F.lit(1)).alias("attempts"))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def cascade_delete(t: Tables) -> DataFrame:
    return writers.delete_documents(t.documents.select("doc_id"), t.labels)


# ---- seams ----


@query()
def stem_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", stemming.mixed_tokens_udf("text").alias("tokens"))


@query()
def embed_seam(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", seams.embedder()(F.col("text")).alias("embedding"))


def _evidence(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every eighth question as evidence on a page of each document of its turn, chunks four to a page, and the questions' long words."""
    chunks = chunk_documents(t.documents).withColumn("page", F.floor(F.col("chunk_index") / 4)).withColumn("chunk_id", F.col("doc_id") * 100_000 + F.col("chunk_index"))
    places = chunks.select("doc_id", "page").distinct().withColumn("turn", F.pmod(F.col("doc_id") + 3 * F.col("page"), F.lit(8)))
    items = t.benchmark.select("item_id", "text", (F.col("item_id") % 8).alias("turn"))
    e = places.join(small(items), "turn").select(F.col("item_id").alias("case_id"), (F.col("doc_id") * 100_000 + F.col("page")).alias("idx"), F.col("doc_id").alias("doc"), "page", "text")
    long = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda x: F.length(x) >= 9)
    return e, chunks.select(F.col("doc_id").alias("doc"), "page", "chunk_id", "chunk_index", "content"), t.benchmark.select(F.col("item_id").alias("case_id"), F.explode(long).alias("keyword"))


@query()
def match_score(t: Tables) -> DataFrame:
    """Every evidence against every chunk of its page: the greater of the words' F1 and the ratio of characters."""
    e, chunks, _ = _evidence(t)
    return evals.page_matches(e, chunks).select("case_id", "chunk_id", F.round("score", 9).alias("score"))


@query()
def evidence_binding(t: Tables) -> DataFrame:
    """Evidence bound to its best chunk, or to its page's chunks with a keyword."""
    e, chunks, keywords = _evidence(t)
    return evals.evidence_map(e, chunks, keywords)[0].select("case_id", "idx", "chunk_id", F.round("score", 9).alias("score"), "by")


@query()
def evidence_grades(t: Tables) -> DataFrame:
    e, chunks, keywords = _evidence(t)
    return evals.evidence_map(e, chunks, keywords)[1]


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(q, '(hello|thanks|hi\\b)') THEN 'direct_answer' WHEN regexp_matches(q, '(compare|versus|why|across)') THEN 'agentic_rag' ELSE 'simple_rag' END AS intent FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS q FROM conversations)")
def route_seam(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", seams.keyword_router(F.col("text")).alias("intent"))
