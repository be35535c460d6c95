"""Evaluation run queries: grades, judgements, gates, sweeps, candidates, reports. Questions stand for cases, events for rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators import evals
from lodestrand.plans.registry import Tables, query, same_sql

_NORM = "array_to_string(list_transform(regexp_extract_all(coalesce({c}, ''), '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)), ' ')"
_SET = "list_distinct(list_filter(string_split({c}, ' '), lambda x: x <> ''))"
_E, _C = _NORM.format(c="text"), _NORM.format(c="text")
_GRADED = f"""WITH e AS (SELECT item_id AS case_id, 0 AS idx, item_id % 8 AS doc, item_id % 5 AS page, {_E} AS e FROM benchmark),
ks AS (SELECT item_id AS case_id, list_distinct([lower(x) FOR x IN regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+') IF length(x) >= 9]) AS ks FROM benchmark),
c AS (SELECT doc_id % 8 AS doc, (doc_id // 8) % 5 AS page, doc_id AS chunk_id, doc_id AS chunk_index, {_C} AS c FROM documents),
s AS (SELECT case_id, idx, chunk_id, chunk_index, c, e, len(list_intersect({_SET.format(c='e')}, {_SET.format(c='c')})) AS both_, len({_SET.format(c='e')}) + len({_SET.format(c='c')}) AS n FROM e JOIN c USING (doc, page)),
j AS (SELECT case_id, idx, chunk_id, round(CASE WHEN length(e) > 0 AND contains(c, e) THEN 1.0 WHEN both_ > 0 THEN 2.0 * both_ / n ELSE 0.0 END, 9) AS score, len(list_filter(ks, lambda k: contains(c, k))) > 0 AS named, chunk_index FROM s JOIN ks USING (case_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, idx ORDER BY score DESC, chunk_index, chunk_id) AS n FROM j),
g AS (SELECT *, CASE WHEN n = 1 AND score >= 0.3 THEN 3 WHEN named THEN 1 END AS grade FROM r)"""


def _gold(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each question as evidence on one page of eight documents; its long words as keywords; documents as chunks."""
    evidence = t.benchmark.select(F.col("item_id").alias("case_id"), F.lit(0).alias("idx"), (F.col("item_id") % 8).alias("doc"), (F.col("item_id") % 5).alias("page"), "text")
    long = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda x: F.length(x) >= 9)
    keywords = t.benchmark.select(F.col("item_id").alias("case_id"), F.explode(long).alias("keyword"))
    chunks = t.documents.select((F.col("doc_id") % 8).alias("doc"), (F.floor(F.col("doc_id") / 8) % 5).alias("page"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("chunk_index"), F.col("text").alias("content"))
    return evals.gold_grades(evidence, chunks, keywords, 0.3)


@query(f"{_GRADED} SELECT case_id, chunk_id, max(grade) AS grade FROM g WHERE grade IS NOT NULL GROUP BY ALL")
def gold_grades(t: Tables) -> DataFrame:
    return _gold(t)[0]


@query(f"{_GRADED}, m AS (SELECT case_id, count(DISTINCT chunk_id) AS relevant, max(grade) AS best FROM g WHERE grade IS NOT NULL GROUP BY 1) SELECT item_id AS case_id, coalesce(relevant, 0) AS relevant, best, relevant IS NULL AS unmapped FROM benchmark LEFT JOIN m ON case_id = item_id")
def gold_cases(t: Tables) -> DataFrame:
    """Cases with their relevant chunks; those whose evidence maps nowhere are marked."""
    grades, unmapped = _gold(t)
    by = grades.groupBy("case_id").agg(F.count(F.lit(1)).alias("relevant"), F.max("grade").alias("best"))
    cases = t.benchmark.select(F.col("item_id").alias("case_id"))
    j = cases.join(by, "case_id", "left").join(unmapped.select("case_id", F.lit(True).alias("u")).distinct(), "case_id", "left")
    return j.select("case_id", F.coalesce("relevant", F.lit(0)).alias("relevant"), "best", F.coalesce("u", F.lit(False)).alias("unmapped"))


_MARKS = "SELECT user_id AS case_id, CASE WHEN event_type IN ('view', 'click') THEN 'context' WHEN event_type = 'error' THEN 'reference' ELSE 'claim' END AS kind, event_id AS ord, value > 80 AS a, event_id % 3 > 0 AS b FROM events"


@query(
    f"""WITH m AS (SELECT *, CAST(sum(CASE WHEN a THEN 1 ELSE 0 END) OVER w AS DOUBLE) AS hits, row_number() OVER w AS rank FROM ({_MARKS}) WINDOW w AS (PARTITION BY case_id, kind ORDER BY ord)),
    n AS (SELECT case_id, sum(CASE WHEN kind = 'context' AND a THEN hits / rank ELSE 0.0 END) AS gain, count(*) FILTER (kind = 'context' AND a) AS rel, CAST(count(*) FILTER (kind = 'claim') AS DOUBLE) AS nc, CAST(count(*) FILTER (kind = 'reference') AS DOUBLE) AS nr,
      count(*) FILTER (kind = 'claim' AND a) AS ca, count(*) FILTER (kind = 'claim' AND b) AS cb, count(*) FILTER (kind = 'reference' AND a) AS ra, count(*) FILTER (kind = 'reference' AND b) AS rb FROM m GROUP BY 1),
    r AS (SELECT case_id, CASE WHEN rel > 0 THEN gain / rel ELSE 0.0 END AS cp, CASE WHEN nr > 0 THEN rb / nr ELSE 0.0 END AS cr, CASE WHEN nc > 0 THEN ca / nc ELSE 0.0 END AS fa, CASE WHEN nc > 0 THEN cb / nc ELSE 0.0 END AS fp, CASE WHEN nr > 0 THEN ra / nr ELSE 0.0 END AS fr FROM n)
    SELECT case_id, round(cp, 6) AS context_precision, round(cr, 6) AS context_recall, round(fa, 6) AS faithfulness, round(fp, 6) AS factual_precision, round(fr, 6) AS factual_recall, round(CASE WHEN fp + fr > 0 THEN 2 * fp * fr / (fp + fr) ELSE 0.0 END, 6) AS factual_f1 FROM r"""
)
def judgement_measures(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), "context").when(F.col("event_type") == "error", "reference").otherwise("claim")
    marks = t.events.select(F.col("user_id").alias("case_id"), kind.alias("kind"), F.col("event_id").alias("ord"), (F.col("value") > 80).alias("a"), (F.col("event_id") % 3 > 0).alias("b"))
    m = evals.judgement_measures(marks)
    return m.select("case_id", *(F.round(c, 6).alias(c) for c in m.columns[1:]))


_GATE = "SELECT event_id // 10 AS run_id, event_id AS case_id, CASE WHEN value < 5 THEN 'timeout' END AS error, least(1.0, value / 20.0) AS faithfulness, 0.9 AS relevancy, CASE WHEN event_id % 23 = 0 THEN 0.5 ELSE 0.9 END AS f1, event_id % 31 > 0 AS citations_valid, event_id % 37 = 0 AS fabricated, event_id % 5 = 0 AS no_answer, event_id % 15 > 0 AS abstention_right FROM events"


@query(
    f"""WITH g AS (SELECT *, coalesce(error IS NULL AND faithfulness >= 0.9 AND relevancy >= 0.8 AND f1 >= 0.8 AND citations_valid AND NOT fabricated AND (NOT no_answer OR abstention_right), false) AS good FROM ({_GATE})),
    r AS (SELECT run_id, count(*) AS cases, count(*) FILTER (good) AS effective, count(*) FILTER (no_answer) AS expected, count(*) FILTER (no_answer AND good) AS abstained, coalesce(list(case_id ORDER BY case_id) FILTER (NOT good), []) AS failures FROM g GROUP BY 1)
    SELECT run_id, cases, effective, abstained, cases = 10 AND effective >= 8 AND expected = 2 AND abstained = 2 AS passed, failures FROM r"""
)
def generation_gate(t: Tables) -> DataFrame:
    """Runs of ten cases each."""
    e = F.col("event_id")
    rows = t.events.select(
        F.floor(e / 10).alias("run_id"), e.alias("case_id"), F.when(F.col("value") < 5, "timeout").alias("error"), F.least(F.lit(1.0), F.col("value") / 20.0).alias("faithfulness"), F.lit(0.9).alias("relevancy"),
        F.when(e % 23 == 0, 0.5).otherwise(0.9).alias("f1"), (e % 31 > 0).alias("citations_valid"), (e % 37 == 0).alias("fabricated"), (e % 5 == 0).alias("no_answer"), (e % 15 > 0).alias("abstention_right"),
    )
    return evals.generation_gate(rows)


@query("WITH w AS (SELECT c_custkey AS case_id, unnest(['bm25', 'vector', 'hybrid']) AS mode FROM customer), r AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'bm25' WHEN 1 THEN 'vector' ELSE 'hybrid' END AS mode, o_custkey AS case_id, count(*) AS hits, CASE WHEN count(*) > 12 THEN 'timeout' END AS error FROM orders GROUP BY ALL) SELECT w.mode, w.case_id, CASE WHEN r.hits IS NOT NULL AND error IS NULL THEN r.hits ELSE 0 END AS hits, CASE WHEN r.hits IS NOT NULL THEN error ELSE 'no_result' END AS error FROM w LEFT JOIN r ON w.mode = r.mode AND w.case_id = r.case_id")
def retrieval_sweep(t: Tables) -> DataFrame:
    """Customers as cases, orders as hits by mode."""
    mode = F.when(F.col("o_orderkey") % 3 == 0, "bm25").when(F.col("o_orderkey") % 3 == 1, "vector").otherwise("hybrid")
    results = t.orders.groupBy(mode.alias("mode"), F.col("o_custkey").alias("case_id")).agg(F.count(F.lit(1)).alias("hits")).withColumn("error", F.when(F.col("hits") > 12, "timeout"))
    return evals.sweep(t.customer.select(F.col("c_custkey").alias("case_id")), results)


_CAND = "SELECT user_id % 20 AS group_id, event_id AS candidate_id, value > 50 AS eligible, CASE WHEN event_type <> 'error' THEN round(value, 0) END AS p95_ms, CASE WHEN event_type <> 'view' THEN value END AS mean_ms, CASE WHEN event_type = 'click' THEN value END AS tps, CAST(NULL AS DOUBLE) AS rss_mb, props AS config FROM {events}"
same_sql(
    "candidate_order_inputs",
    f"SELECT group_id, count(*) AS candidates, count(CASE WHEN eligible THEN 1 END) AS eligible, count(p95_ms) AS timed FROM ({_CAND}) GROUP BY group_id",
    "events",
)


@query(f"SELECT group_id, candidate_id, row_number() OVER (PARTITION BY group_id ORDER BY eligible DESC, coalesce(p95_ms, 'infinity'::DOUBLE), coalesce(mean_ms, 'infinity'::DOUBLE), coalesce(tps, '-infinity'::DOUBLE) DESC, coalesce(rss_mb, 'infinity'::DOUBLE), config, candidate_id) AS place FROM ({_CAND.replace('{events}', 'events')})")
def candidate_ranking(t: Tables) -> DataFrame:
    return evals.rank_candidates(t.spark.sql(_CAND, events=t.events))


@query(
    """WITH l AS (SELECT o_orderkey AS run_id, coalesce(o_orderkey % 4 > 0 AND CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'm' END <> '', false) AS complete FROM orders),
    f AS (SELECT l_orderkey AS run_id, l_linenumber AS case_id, count(*) AS n FROM lineitem GROUP BY ALL), e AS (SELECT DISTINCT l_orderkey AS run_id, l_linenumber AS case_id FROM lineitem WHERE l_quantity < 49),
    j AS (SELECT run_id, bool_and(coalesce(n, 0) = 1 AND e.case_id IS NOT NULL) AS same FROM f FULL JOIN e USING (run_id, case_id) GROUP BY run_id)
    SELECT run_id, complete AND coalesce(same, false) AS skip FROM l LEFT JOIN j USING (run_id)"""
)
def skipped_runs(t: Tables) -> DataFrame:
    """Orders as runs, their lines as predictions; lines of large quantity were not expected."""
    o = t.orders.select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 4 > 0, "complete").otherwise("running").alias("status"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("m").alias("model"))
    found = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("case_id"))
    expected = t.lineitem.where("l_quantity < 49").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("case_id"))
    return evals.may_skip(evals.complete_lineage(o, "model"), found, expected)


@query("SELECT doc_id AS report_id, i AS case_no, 'c' || i AS case_id, r AS rank, doc_id * 10 + r AS chunk_id, round(1.0 / r, 6) AS score FROM documents, (SELECT unnest([0, 1]) AS i), (SELECT unnest([1, 2]) AS r) WHERE doc_id % 7 <> 3")
def report_cases(t: Tables) -> DataFrame:
    """Reports of two cases with two hits each; some are no JSON."""
    made = F.expr("""concat('{"hybrid": {"cases": [', concat_ws(', ', transform(array(0, 1), i -> concat('{"case_id": "c', i, '", "ranked_chunks": [{"chunk_id": ', doc_id * 10 + 1, ', "score": 1.0}, {"chunk_id": ', doc_id * 10 + 2, ', "score": 0.5}]}'))), ']}}')""")
    return evals.report_cases(t.documents.select(F.col("doc_id").alias("report_id"), F.when(F.col("doc_id") % 7 != 3, made).otherwise("{no").alias("report")))


@query("WITH m AS (SELECT user_id, CAST(event_id % 4 * 5 AS VARCHAR) AS k, max(value) AS v FROM events GROUP BY ALL) SELECT user_id AS run_id, coalesce(max(CASE WHEN k = '5' THEN v END), 0.0) AS at_5, coalesce(max(CASE WHEN k = '20' THEN v END), 0.0) AS at_20 FROM m GROUP BY 1")
def metrics_at_k(t: Tables) -> DataFrame:
    by = t.events.groupBy("user_id", (F.col("event_id") % 4 * 5).cast("string").alias("k")).agg(F.max("value").alias("v"))
    m = by.groupBy(F.col("user_id").alias("run_id")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    return m.select("run_id", evals.metric_at(F.col("m"), 5).alias("at_5"), evals.metric_at(F.col("m"), 20).alias("at_20"))


@query("SELECT user_id, list(event_type || '=' || v ORDER BY event_type) AS manifest FROM (SELECT user_id, event_type, coalesce(max(CASE WHEN event_id % 2 = 1 THEN props END), max(CASE WHEN event_id % 2 = 0 THEN props END)) AS v FROM events GROUP BY ALL) GROUP BY user_id")
def merged_manifests(t: Tables) -> DataFrame:
    """Even events wrote the old manifest, odd ones the new."""
    by = t.events.groupBy("user_id", "event_type").agg(F.max(F.when(F.col("event_id") % 2 == 0, F.col("props"))).alias("old"), F.max(F.when(F.col("event_id") % 2 == 1, F.col("props"))).alias("new"))
    pairs = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("event_type", c))))
    m = by.groupBy("user_id").agg(pairs("old").alias("old"), pairs("new").alias("new"))
    return m.select("user_id", F.transform(evals.merged_manifest(F.col("old"), F.col("new")), lambda x: F.concat_ws("=", x["key"], x["value"])).alias("manifest"))


@query("WITH s AS (SELECT event_type || user_id AS metric, max(CASE WHEN event_id % 2 = 0 THEN value END) AS before, min(CASE WHEN event_id % 3 = 0 THEN value END) AS after FROM events GROUP BY 1), r AS (SELECT metric, before, after FROM s) SELECT metric, '| | ' || metric || ' | ' || CASE WHEN before IS NULL THEN 'n/a' ELSE printf('%.4f', before) END || ' | ' || CASE WHEN after IS NULL THEN 'n/a' ELSE printf('%.4f', after) END || ' | ' || CASE WHEN before IS NULL OR after IS NULL THEN 'n/a' ELSE printf('%+.4f', after - before) END || ' | |' AS line FROM r")
def scorecard_lines(t: Tables) -> DataFrame:
    s = t.events.groupBy(F.concat("event_type", F.col("user_id").cast("string")).alias("metric")).agg(
        F.max(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("before"), F.min(F.when(F.col("event_id") % 3 == 0, F.col("value"))).alias("after")
    )
    return evals.scorecard_lines(s)


@query("SELECT 'm' || (user_id % 5) AS model_id, event_id AS case_id, event_type AS failure_code, event_type IN ('error', 'view') AS stable FROM events WHERE NOT value > 60")
def failure_rows(t: Tables) -> DataFrame:
    p = t.events.select(F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model_id"), F.col("event_id").alias("case_id"), F.col("event_type").alias("failure_code"), (F.col("value") > 60).alias("correct"))
    return evals.failure_rows(p, "error", "view")


@query("SELECT doc_id, CASE WHEN source IS NULL THEN 'audit_contract_prompt_and_labels' WHEN contains(lower(source || '-' || n_chars % 20 || 'B'), '4b') THEN 'train_smaller_keep_as_baseline' WHEN contains(lower(source || '-' || n_chars % 20 || 'B'), '1.7b') THEN 'prioritize_this_keep_smaller_as_control' ELSE 'include_both_small_candidates' END AS next FROM documents")
def recommendations(t: Tables) -> DataFrame:
    name = F.concat("source", F.lit("-"), (F.col("n_chars") % 20).cast("string"), F.lit("B"))
    return t.documents.select("doc_id", evals.recommendation(name).alias("next"))


@query(
    """WITH g AS (SELECT event_id // 3 AS set_id, count(*) AS n, count(*) FILTER (value > 150) AS paired, count(DISTINCT props) AS inputs, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b, count(*) FILTER (event_type = 'error') AS c FROM events GROUP BY 1)
    SELECT set_id, unnest(list_filter([CASE WHEN n <> 3 THEN 'case_count' END, CASE WHEN NOT (a = 1 AND b = 1 AND c = 1) THEN 'label_counts' END, CASE WHEN paired > 0 THEN 'paired_case' END, CASE WHEN inputs <> n THEN 'repeated_input' END], lambda x: x IS NOT NULL)) AS fault FROM g"""
)
def smoke_faults(t: Tables) -> DataFrame:
    """Three events in a row as a smoke set."""
    c = t.events.select(F.floor(F.col("event_id") / 3).alias("set_id"), F.col("event_type").alias("label"), F.when(F.col("value") > 150, F.col("event_id")).alias("pair_id"), F.col("props").alias("input"))
    return evals.smoke_faults(c, ("view", "click", "error"))


@query("WITH c AS (SELECT l_orderkey AS run_id, l_partkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey * 10 + l_linenumber) AS place FROM lineitem), r AS (SELECT l_orderkey AS run_id, l_linenumber AS result_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 100000 + l_partkey) AS place FROM lineitem WHERE l_quantity < 40) SELECT run_id, place, case_id, result_id FROM c JOIN r USING (run_id, place)")
def zipped_results(t: Tables) -> DataFrame:
    cases = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("case_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("o"))
    results = t.lineitem.where("l_quantity < 40").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("result_id"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("o2"))
    return evals.zipped(cases, results, "o", "o2")


@query("WITH w AS (SELECT user_id AS slice_id, list(event_id % 30 ORDER BY event_id) AS ids FROM events GROUP BY 1), e AS (SELECT slice_id, unnest(ids) AS case_id, generate_subscripts(ids, 1) - 1 AS place FROM w) SELECT slice_id, place, case_id, text FROM e JOIN benchmark ON item_id = case_id")
def case_slices(t: Tables) -> DataFrame:
    """Lists of question ids in the order of events; some name no question."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("event_id", (F.col("event_id") % 30).alias("c")))), lambda x: x["c"])
    wanted = t.events.groupBy(F.col("user_id").alias("slice_id")).agg(listed.alias("ids"))
    return evals.case_slice(t.benchmark.select(F.col("item_id").alias("case_id"), "text"), wanted)


@query("WITH h AS (SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rank, l_partkey AS chunk_id FROM lineitem WHERE l_quantity > 25), g AS (SELECT run_id, '[' || string_agg('{\"rank\":' || rank || ',\"chunk_id\":' || chunk_id || ',\"score\":0.5}', ',' ORDER BY rank) || ']' AS hits FROM h GROUP BY 1) SELECT o_orderkey AS run_id, '{\"run_id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\",\"hits\":' || coalesce(hits, '[]') || '}' AS record FROM orders LEFT JOIN g ON run_id = o_orderkey")
def run_records(t: Tables) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    hits = t.lineitem.where("l_quantity > 25").select(F.col("l_orderkey").alias("run_id"), rank.alias("rank"), F.col("l_partkey").alias("chunk_id"), F.lit(0.5).alias("score"))
    return evals.records(t.orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status")), hits)


# ---- statements that both engines run as they are ----

same_sql("document_by_id", "SELECT d.doc_id, d.source, d.lang, d.n_chars FROM {documents} d JOIN {benchmark} b ON d.doc_id = b.item_id", "documents", "benchmark")
same_sql("rows_of_a_key", "SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND o_custkey = 7", "lineitem", "orders")
same_sql("chunk_of_block", "SELECT l.l_orderkey, l.l_linenumber, coalesce(c.c_custkey, o.o_custkey) AS chunk_id FROM {lineitem} l LEFT JOIN {customer} c ON c.c_custkey = l.l_partkey LEFT JOIN {orders} o ON o.o_orderkey = l.l_orderkey", "lineitem", "customer", "orders")
same_sql("active_hits", "SELECT e.vec_id, l.quality FROM {embeddings} e JOIN {labels} l ON e.vec_id = l.doc_id WHERE l.quality = 1 AND l.toxic = 0", "embeddings", "labels")
same_sql("event_kinds", "SELECT 0 AS kind, 'message' AS name, conv_id AS owner, turn AS ord FROM {conversations} UNION ALL SELECT 1, 'event', user_id, event_id FROM {events} UNION ALL SELECT 2, 'label', doc_id, quality FROM {labels}", "conversations", "events", "labels")
same_sql("part_overlap", "SELECT d.text_hash, d.n AS dev, t.n AS test FROM (SELECT md5(text) AS text_hash, count(*) AS n FROM {documents} WHERE doc_id % 3 > 0 AND text IS NOT NULL GROUP BY md5(text)) d JOIN (SELECT md5(text) AS text_hash, count(*) AS n FROM {documents} WHERE doc_id % 3 = 0 AND text IS NOT NULL GROUP BY md5(text)) t ON d.text_hash = t.text_hash", "documents")
same_sql("hard_overflow", "SELECT conv_id, sum(length(coalesce(text, ''))) AS chars, sum(length(coalesce(text, ''))) >= 2000 AS overflow FROM {conversations} GROUP BY conv_id", "conversations", duck="SELECT conv_id, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, sum(length(coalesce(text, ''))) >= 2000 AS overflow FROM conversations GROUP BY conv_id")
same_sql("sessions_to_create", "SELECT c.user_id AS session_id, substring(min(c.props), 1, 80) AS title FROM {events} c LEFT JOIN (SELECT DISTINCT conv_id FROM {conversations}) s ON s.conv_id = c.user_id WHERE s.conv_id IS NULL GROUP BY c.user_id", "events", "conversations")
same_sql("perf_grid", "SELECT s.scenario, b.item_id AS fixture, r.repeat_no FROM (SELECT 'cold' AS scenario UNION ALL SELECT 'warm') s CROSS JOIN {benchmark} b CROSS JOIN (SELECT 1 AS repeat_no UNION ALL SELECT 2 UNION ALL SELECT 3) r", "benchmark")
same_sql("enrichment_outcomes", "SELECT source, count(CASE WHEN text IS NULL OR length(text) < 40 THEN 1 END) AS skipped, count(CASE WHEN length(text) >= 40 AND lang = 'fr' THEN 1 END) AS failed, count(CASE WHEN length(text) >= 40 AND lang <> 'fr' THEN 1 END) AS succeeded FROM {documents} GROUP BY source", "documents")
same_sql("upload_states", "SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'conflict' WHEN event_type IN ('view', 'click') THEN 'accepted' ELSE 'ready' END AS next_state FROM {events}", "events")
