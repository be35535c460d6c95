"""Evaluation queries: rankings against labels, routers, latencies, judgments, data-set contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import contracts as ct
from lodestrand.operators import metrics as mt
from lodestrand.operators import quality, vectors
from lodestrand.plans.registry import Tables, query
from lodestrand.plans.retrieval import SIM, VEC

# ---- rankings: queries are the vectors whose id is divisible by 100; relevant are those of the same label, graded by parity ----

_RANKED = f"""{VEC}, q AS (SELECT vec_id AS case_id, v, label FROM e WHERE vec_id % 100 = 0),
ranked AS (SELECT case_id, key, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY similarity DESC, key) AS rank FROM (SELECT q.case_id, e.vec_id AS key, {SIM} AS similarity FROM q, e)) WHERE rank <= 20),
gold AS (SELECT q.case_id, e.vec_id AS key, CASE WHEN e.vec_id % 2 = 0 THEN 3 ELSE 1 END AS grade FROM q JOIN e USING (label))"""
_KS = "ks AS (SELECT unnest([3, 5, 10, 20]) AS k)"
_BYCASE = f"""{_KS}, size AS (SELECT case_id, count(*) AS relevant FROM gold GROUP BY case_id),
hits AS (SELECT case_id, rank, grade, row_number() OVER (PARTITION BY case_id ORDER BY rank) AS nth FROM ranked JOIN gold USING (case_id, key)),
got AS (SELECT case_id, k, count(*) AS found, min(rank) AS first, sum(nth / rank) AS precisions, sum((pow(2.0, grade) - 1) / log2(rank + 1)) AS dcg FROM hits, ks WHERE rank <= k GROUP BY ALL),
ip AS (SELECT case_id, grade, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, key) AS place FROM gold),
ideal AS (SELECT case_id, k, sum((pow(2.0, grade) - 1) / log2(place + 1)) AS idcg FROM ip, ks WHERE place <= k GROUP BY ALL),
bycase AS (SELECT case_id, k, coalesce(found / relevant, 0) AS recall, CASE WHEN found > 0 THEN 1.0 ELSE 0.0 END AS hit, coalesce(1.0 / first, 0) AS rr, coalesce(precisions / least(relevant, k), 0) AS ap, coalesce(dcg / idcg, 0) AS ndcg
           FROM size CROSS JOIN ks LEFT JOIN got USING (case_id, k) LEFT JOIN ideal USING (case_id, k))"""


def _ranked(t: Tables) -> DataFrame:
    q = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vectors.nearest(t.embeddings, q, top_k=20).select(F.col("query_id").alias("case_id"), F.col("vec_id").alias("key"), "rank")


def _gold(t: Tables) -> DataFrame:
    q = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("case_id"), "label")
    e = t.embeddings.select(F.col("vec_id").alias("key"), "label")
    return e.join(q, "label").select("case_id", "key", F.when(F.col("key") % 2 == 0, 3).otherwise(1).alias("grade"))


@query(f"WITH {_RANKED}, {_BYCASE} SELECT k, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit, round(avg(rr), 6) AS reciprocal_rank, round(avg(ap), 6) AS average_precision, round(avg(ndcg), 6) AS ndcg FROM bycase GROUP BY k")
def ranking_metrics(t: Tables) -> DataFrame:
    return mt.ranking_metrics(_ranked(t), _gold(t))


@query(f"WITH {_RANKED}, {_BYCASE} SELECT case_id, k, round(recall, 6) AS recall, hit, round(rr, 6) AS reciprocal_rank, round(ap, 6) AS average_precision, round(ndcg, 6) AS ndcg FROM bycase")
def ranking_by_case(t: Tables) -> DataFrame:
    d = mt.ranking_by_case(_ranked(t), _gold(t))
    return d.select("case_id", "k", "hit", *(F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "average_precision", "ndcg")))


@query(
    f"""WITH {_RANKED}, {_KS}, need AS (SELECT DISTINCT case_id, key FROM gold WHERE grade = 3),
    j AS (SELECT need.case_id, k, avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END) AS share FROM need CROSS JOIN ks LEFT JOIN ranked USING (case_id, key) GROUP BY ALL)
    SELECT k, round(avg(CASE WHEN share = 1 THEN 1.0 ELSE 0.0 END), 6) AS all_found, round(avg(share), 6) AS share_found FROM j GROUP BY k"""
)
def document_recall(t: Tables) -> DataFrame:
    """All required documents or none, and the share of them: two measures, kept apart."""
    return mt.document_recall(_ranked(t), _gold(t).where("grade = 3").select("case_id", "key"))


@query(f"WITH {_RANKED}, {_BYCASE}, m AS (SELECT k, avg(hit) AS hit, avg(recall) AS recall FROM bycase GROUP BY k) SELECT min(k) FILTER (round(hit, 6) >= 0.9 AND round(recall, 6) >= 0.05) AS k FROM m")
def smallest_k(t: Tables) -> DataFrame:
    return mt.smallest_k(mt.ranking_metrics(_ranked(t), _gold(t)), F.col("hit") >= 0.9, F.col("recall") >= 0.05)


@query(f"WITH {_RANKED}, {_BYCASE} SELECT CASE WHEN a.hit = 0 AND b.hit > 0 THEN 'improved' WHEN a.hit > 0 AND b.hit = 0 THEN 'regressed' WHEN a.hit > 0 THEN 'both' ELSE 'neither' END AS outcome, count(*) AS cases FROM bycase a JOIN bycase b ON a.case_id = b.case_id AND a.k = 3 AND b.k = 10 GROUP BY ALL")
def paired_outcomes(t: Tables) -> DataFrame:
    d = mt.ranking_by_case(_ranked(t), _gold(t)).select("case_id", "k", "hit")
    return mt.paired_outcomes(d.where("k = 3"), d.where("k = 10"))


@query(f"WITH {_RANKED}, r AS (SELECT case_id, rank, gold.key IS NOT NULL AS relevant FROM ranked LEFT JOIN gold USING (case_id, key)), h AS (SELECT *, sum(CAST(relevant AS INT)) OVER (PARTITION BY case_id ORDER BY rank) AS hits FROM r) SELECT case_id, round(coalesce(sum(hits / rank) FILTER (relevant) / nullif(sum(CAST(relevant AS INT)), 0), 0), 6) AS precision FROM h GROUP BY case_id")
def context_precision(t: Tables) -> DataFrame:
    g = _gold(t).select("case_id", "key", F.lit(True).alias("g"))
    return mt.context_precision(_ranked(t).join(g, ["case_id", "key"], "left").select("case_id", "rank", F.coalesce("g", F.lit(False)).alias("relevant")))


@query(f"WITH {_RANKED} SELECT key AS chunk_id, min(rank) AS best_rank, count(*) AS queries FROM ranked GROUP BY key")
def matched_queries(t: Tables) -> DataFrame:
    return _ranked(t).groupBy(F.col("key").alias("chunk_id")).agg(F.min("rank").alias("best_rank"), F.count(F.lit(1)).alias("queries"))


# ---- routers: each event is a case; what it expects and predicts follows from its id and user ----

_CASES = """cases AS (SELECT event_id AS case_id, ['direct_answer', 'simple_rag', 'agentic_rag'][CAST(floor(value) AS BIGINT) % 3 + 1] AS expected,
 CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 11 = 0 THEN NULL ELSE ['direct_answer', 'simple_rag', 'agentic_rag'][(CAST(floor(value) AS BIGINT) + CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 25 THEN 1 ELSE 0 END) % 3 + 1] END AS predicted,
 event_type AS scenario, CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'zh' END AS language, event_id // 2 AS pair_id, value AS latency_ms FROM events)"""
_RIGHT = "coalesce(expected = predicted, false)"
LABELS = ("agentic_rag", "direct_answer", "simple_rag")


def cases(t: Tables) -> DataFrame:
    names = "array('direct_answer', 'simple_rag', 'agentic_rag')"
    return t.events.select(
        F.col("event_id").alias("case_id"),
        F.expr(f"{names}[cast(floor(value) % 3 as int)]").alias("expected"),
        F.expr(f"CASE WHEN get_json_object(props, '$.k') % 11 <> 0 THEN {names}[cast((floor(value) + CASE WHEN get_json_object(props, '$.k') < 25 THEN 1 ELSE 0 END) % 3 as int)] END").alias("predicted"),
        F.col("event_type").alias("scenario"),
        F.expr("CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'zh' END").alias("language"),
        F.expr("event_id div 2").alias("pair_id"),
        F.col("value").alias("latency_ms"),
    ).withColumn("correct", F.col("expected").eqNullSafe(F.col("predicted")))


@query(f"WITH {_CASES} SELECT l AS expected, count(*) FILTER (expected = l AND predicted = 'agentic_rag') AS agentic_rag, count(*) FILTER (expected = l AND predicted = 'direct_answer') AS direct_answer, count(*) FILTER (expected = l AND predicted = 'simple_rag') AS simple_rag, count(*) FILTER (expected = l AND predicted IS NULL) AS invalid FROM (SELECT unnest(['agentic_rag', 'direct_answer', 'simple_rag']) AS l) CROSS JOIN cases GROUP BY l")
def confusion_matrix(t: Tables) -> DataFrame:
    return mt.confusion(cases(t), LABELS)


_PRF = f"""WITH {_CASES}, c AS (SELECT l AS label, count(*) FILTER (expected = l AND predicted = l) AS tp, count(*) FILTER (expected <> l AND predicted = l) AS fp, count(*) FILTER (expected = l) AS support
    FROM (SELECT unnest(['agentic_rag', 'direct_answer', 'simple_rag']) AS l) CROSS JOIN cases GROUP BY l),
    m AS (SELECT label, support, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM c)"""


@query(f"{_PRF} SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, support FROM m")
def prf1_by_class(t: Tables) -> DataFrame:
    return mt.per_class(cases(t), LABELS)


@query(f"{_PRF} SELECT round(avg(round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6)), 6) AS macro_f1 FROM m")
def macro_f1(t: Tables) -> DataFrame:
    return mt.per_class(cases(t), LABELS).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


@query(f"WITH {_CASES} SELECT CASE WHEN grouping(scenario) = 0 THEN 'scenario' ELSE 'language' END AS slice, coalesce(scenario, language) AS value, count(*) AS support, round(avg(CAST({_RIGHT} AS INT)), 6) AS accuracy FROM cases GROUP BY GROUPING SETS ((scenario), (language))")
def slice_metrics(t: Tables) -> DataFrame:
    return mt.slices(cases(t), "scenario", "language")


@query(f"WITH {_CASES}, p AS (SELECT pair_id, min(CAST({_RIGHT} AS INT)) AS ok FROM cases GROUP BY pair_id) SELECT count(*) AS pairs, round(avg(ok), 6) AS pair_accuracy FROM p")
def pair_accuracy(t: Tables) -> DataFrame:
    return mt.pair_accuracy(cases(t))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_linear(t: Tables) -> DataFrame:
    return mt.latency(t.events, "value", "event_type")


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_nearest(t: Tables) -> DataFrame:
    return mt.latency(t.events, "value", "event_type", nearest=True)


_CODE = "CASE WHEN predicted IS NULL THEN 'invalid_json' WHEN predicted <> expected THEN split_part(expected, '_', 1) || '_as_' || split_part(predicted, '_', 1) END"


@query(f"WITH {_CASES}, f AS (SELECT case_id, {_CODE} AS code FROM cases), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY case_id) AS n FROM f WHERE code IS NOT NULL) SELECT code, count(*) AS n, string_agg(CAST(case_id AS VARCHAR), ',' ORDER BY case_id) FILTER (n <= 3) AS examples FROM r GROUP BY code")
def failure_topn(t: Tables) -> DataFrame:
    c = cases(t)
    code = ct.intent_failure(F.when(F.col("predicted").isNull(), "invalid_json"), F.col("expected"), F.col("predicted"))
    return mt.failures(c.withColumn("code", code))


@query(f"WITH {_CASES} SELECT expected, predicted, count(*) AS n, count(*) <= 100 AS within_gate FROM cases WHERE predicted IS NOT NULL AND expected <> predicted GROUP BY ALL")
def directional_errors(t: Tables) -> DataFrame:
    return cases(t).where("predicted IS NOT NULL AND expected <> predicted").groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n")).withColumn("within_gate", F.col("n") <= 100)


@query(f"WITH {_CASES}, a AS (SELECT scenario, avg(CAST({_RIGHT} AS INT)) AS acc, count(*) AS n, quantile_disc(latency_ms, 0.95) AS p95 FROM cases GROUP BY scenario) SELECT scenario, list_filter([CASE WHEN acc < 0.7 THEN 'accuracy' END, CASE WHEN n < 2000 THEN 'support' END, CASE WHEN p95 > 100 THEN 'latency' END], lambda x: x IS NOT NULL) AS reasons FROM a")
def eligibility(t: Tables) -> DataFrame:
    a = cases(t).groupBy("scenario").agg(F.avg(F.col("correct").cast("int")).alias("acc"), F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95"))
    return a.select("scenario", ct.reasons((F.col("acc") < 0.7, "accuracy"), (F.col("n") < 2000, "support"), (F.col("p95") > 100, "latency")).alias("reasons"))


@query(f"WITH {_CASES}, a AS (SELECT scenario, round(avg(CAST({_RIGHT} AS INT)), 6) AS acc, round(avg(latency_ms), 6) AS ms FROM cases GROUP BY scenario) SELECT scenario, acc, ms, row_number() OVER (ORDER BY acc DESC, ms, scenario) AS place FROM a WHERE acc >= (SELECT max(acc) FROM a) - 0.05")
def model_selection(t: Tables) -> DataFrame:
    """Candidates within a margin of the best, then by speed: one row for each candidate."""
    from pyspark.sql import Window

    a = cases(t).groupBy("scenario").agg(F.round(F.avg(F.col("correct").cast("int")), 6).alias("acc"), F.round(F.avg("latency_ms"), 6).alias("ms"))
    best = a.agg(F.max("acc").alias("best"))
    return a.crossJoin(F.broadcast(best)).where(F.col("acc") >= F.col("best") - 0.05).select("scenario", "acc", "ms", F.row_number().over(Window.orderBy(F.desc("acc"), "ms", "scenario")).alias("place"))


@query("SELECT quality, toxic, 0 AS expected, count(*) AS found FROM labels GROUP BY ALL HAVING NOT (quality = 1 AND toxic = 0) UNION ALL SELECT 1, 0, 100, count(*) FROM labels WHERE quality = 1 AND toxic = 0 HAVING count(*) <> 100")
def quota_faults(t: Tables) -> DataFrame:
    expected = t.spark.createDataFrame([(1, 0, 100)], "quality int, toxic int, expected long")
    return quality.quota_faults(t.labels.select(F.col("quality").cast("int"), F.col("toxic").cast("int")), expected, "quality", "toxic")


@query("WITH g AS (SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 AS g FROM (SELECT DISTINCT lang FROM documents)), p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents) SELECT doc_id, lang, CASE WHEN i % 3 = g % 3 THEN 'test' ELSE 'dev' END AS part FROM p JOIN g USING (lang)")
def dev_test_split(t: Tables) -> DataFrame:
    return quality.split(t.documents.select("doc_id", "lang"), "lang", "doc_id")


@query("WITH c AS (SELECT doc_id AS evidence_id, quality + 1 AS grade, toxic FROM labels), d AS (SELECT doc_id, source, lang FROM documents) SELECT d.source, count(*) AS judged, round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS faithfulness, round(avg(CASE WHEN grade = 2 THEN 1.0 ELSE 0.0 END), 6) AS relevancy, avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END) >= 0.9 AND avg(CASE WHEN grade = 2 THEN 1.0 ELSE 0.0 END) >= 0.8 AS passed FROM d JOIN c ON doc_id = evidence_id GROUP BY d.source")
def generation_scorecard(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id", "source").join(t.labels, "doc_id")
    f, r = F.avg(F.when(F.col("toxic") == 0, 1.0).otherwise(0.0)), F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0))
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("judged"), F.round(f, 6).alias("faithfulness"), F.round(r, 6).alias("relevancy"), ((f >= 0.9) & (r >= 0.8)).alias("passed"))


@query("SELECT event_type AS stage, count(*) AS n, round(avg(k), 6) AS mean, round(quantile_cont(k, 0.5), 6) AS p50, round(quantile_cont(k, 0.95), 6) AS p95 FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type")
def ingestion_timings(t: Tables) -> DataFrame:
    k = t.events.select(F.col("event_type").alias("stage"), F.explode(F.from_json("props", "map<string,bigint>")).alias("name", "k"))
    return k.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("k"), 6).alias("mean"), F.round(F.expr("percentile(k, 0.5)"), 6).alias("p50"), F.round(F.expr("percentile(k, 0.95)"), 6).alias("p95"))


@query("SELECT source, code, count(*) AS n FROM (SELECT source, unnest(list_filter([CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'unsafe' END, CASE WHEN n_chars < 100 THEN 'too_short' END], lambda x: x IS NOT NULL)) AS code FROM documents JOIN labels USING (doc_id)) GROUP BY ALL")
def failure_attribution(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id")
    codes = ct.reasons((F.col("quality") == 0, "low_quality"), (F.col("toxic") == 1, "unsafe"), (F.col("n_chars") < 100, "too_short"))
    return j.select("source", F.explode(codes).alias("code")).groupBy("source", "code").agg(F.count(F.lit(1)).alias("n"))
