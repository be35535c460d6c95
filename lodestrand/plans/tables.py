"""Table queries: look-ups, joins, upserts, sessions, memory, evidence and layout over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import numeric as nm
from lodestrand.functions import text as tx
from lodestrand.operators import evidence as ev
from lodestrand.operators import sessions as ss
from lodestrand.operators import structure as st
from lodestrand.operators.numbering import numbered
from lodestrand.plans.registry import Tables, query, same_sql
from lodestrand.sources import readers, writers

# ---- look-ups and joins ----

same_sql("orders_with_customers", "SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey", "orders", "customer")
same_sql("customers_without_orders", "SELECT c_custkey FROM {customer} LEFT ANTI JOIN {orders} ON o_custkey = c_custkey AND o_orderkey % 7 = 0", "customer", "orders", duck="SELECT c_custkey FROM {customer} ANTI JOIN {orders} ON o_custkey = c_custkey AND o_orderkey % 7 = 0")
same_sql("customers_with_orders", "SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON o_custkey = c_custkey", "customer", "orders", duck="SELECT c_custkey FROM {customer} SEMI JOIN {orders} ON o_custkey = c_custkey")
same_sql("pages_of_documents", "SELECT source, lang, count(*) AS n, sum(n_chars) AS chars FROM {documents} GROUP BY GROUPING SETS ((source), (lang), ())", "documents", duck="SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM {documents} GROUP BY GROUPING SETS ((source), (lang), ())")
same_sql("id_set_difference", "SELECT doc_id, 'unlabelled' AS side FROM (SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {labels}) UNION ALL SELECT doc_id, 'unknown' AS side FROM (SELECT doc_id FROM {labels} EXCEPT SELECT doc_id FROM {documents})", "documents", "labels")
same_sql("inventory_counts", "SELECT 'documents' AS tbl, count(*) AS n FROM {documents} UNION ALL SELECT 'pages', count(*) FROM {pages} UNION ALL SELECT 'labels', count(*) FROM {labels}", "documents", "pages", "labels")
same_sql("set_overlap", "SELECT doc_id FROM (SELECT doc_id FROM {documents} WHERE doc_id % 2 = 0 INTERSECT SELECT doc_id FROM {labels} WHERE quality = 1)", "documents", "labels")
same_sql("revenue_by_nation", "SELECT n_name, count(DISTINCT o_orderkey) AS n_orders FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name", "orders", "customer", "nation")


@query("SELECT doc_id, source, row_number() OVER (ORDER BY doc_id DESC) AS place FROM documents")
def documents_newest(t: Tables) -> DataFrame:
    return numbered(t.documents.select("doc_id", "source"), F.desc("doc_id"), name="place")


@query("SELECT l_orderkey, arg_max(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS l_partkey, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY l_orderkey")
def latest_per_key(t: Tables) -> DataFrame:
    return ss.latest(t.lineitem.select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey"), "l_orderkey", "l_shipdate", "l_linenumber").select("l_orderkey", "l_partkey", "l_shipdate")


@query("WITH last AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1), v AS (SELECT o_custkey, CASE WHEN k % 3 = 0 THEN NULL ELSE 'v' || (k % 2) END AS version FROM last) SELECT c_custkey, version FROM customer LEFT JOIN v ON c_custkey = o_custkey WHERE c_custkey % 5 = 0 OR version IS DISTINCT FROM 'v1'")
def pending_or_legacy(t: Tables) -> DataFrame:
    """Customers in a due state, or whose latest version is not the present one; null counts as differing."""
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
    v = last.select("o_custkey", F.when(F.col("k") % 3 != 0, F.concat(F.lit("v"), (F.col("k") % 2).cast("string"))).alias("version"))
    return t.customer.join(v, F.col("c_custkey") == F.col("o_custkey"), "left").where((F.col("c_custkey") % 5 == 0) | ~F.col("version").eqNullSafe(F.lit("v1"))).select("c_custkey", "version")


@query("WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place FROM lineitem), c AS (SELECT * FROM p) SELECT c.l_orderkey, c.l_linenumber AS centre, p.l_linenumber AS neighbour, p.place - c.place AS distance FROM c JOIN p ON p.l_orderkey = c.l_orderkey AND p.place BETWEEN c.place - 1 AND c.place + 1")
def neighbours_band(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    p = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).alias("place"))
    c = p.select("l_orderkey", F.col("l_linenumber").alias("centre"), F.col("place").alias("at"), F.explode(F.expr("sequence(place - 1, place + 1)")).alias("place"))
    return c.join(p.select("l_orderkey", F.col("l_linenumber").alias("neighbour"), "place"), ["l_orderkey", "place"]).select("l_orderkey", "centre", "neighbour", (F.col("place") - F.col("at")).alias("distance"))


@query("SELECT event_id, user_id, (SELECT max(ts) FROM events h WHERE h.user_id = e.user_id AND h.event_type = 'signup' AND h.ts <= e.ts) AS heading_ts FROM events e")
def asof_section(t: Tables) -> DataFrame:
    """The latest sign-up of the user at or before each event: an as-of join by a running last value."""
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", "user_id", F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).over(w).alias("heading_ts"))


@query("SELECT source_id, status FROM (SELECT doc_id AS source_id, CASE WHEN quality IS NULL THEN 'missing' ELSE 'known' END AS status FROM documents LEFT JOIN labels USING (doc_id))")
def source_completeness(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select(F.col("doc_id").alias("source_id"), F.when(F.col("quality").isNull(), "missing").otherwise("known").alias("status"))


@query("SELECT doc_id, source, CASE WHEN lang = 'en' THEN 'primary' ELSE 'fallback' END AS parser FROM documents")
def primary_fallback(t: Tables) -> DataFrame:
    """The primary parser reads English only; the fallback reads all."""
    d = t.documents.select("doc_id", "source", "lang")
    return readers.primary_with_fallback(d.where("lang = 'en'").withColumn("parser", F.lit("primary")), d.withColumn("parser", F.lit("fallback"))).drop("lang")


@query("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"source\":' || CASE WHEN source IS NULL THEN 'null' ELSE '\"' || source || '\"' END || '}') AS signature FROM documents")
def run_signatures(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", writers.signature(F.col("doc_id"), F.col("source")).alias("signature"))


@query("SELECT doc_id AS case_id, source AS signature FROM documents WHERE lang <> 'en'")
def pending_cases(t: Tables) -> DataFrame:
    """Cases not finished under their signature; those that ended in an error are due again."""
    c = t.documents.select(F.col("doc_id").alias("case_id"), F.col("source").alias("signature"), "lang")
    done = c.where("lang IN ('en', 'de')").withColumn("error", F.when(F.col("lang") == "de", "timeout"))
    return writers.pending_cases(c, done).drop("lang")


@query("SELECT c_custkey, c_name, regexp_replace(regexp_replace(regexp_extract('up/' || c_name || ' (1).pdf', '([^/\\\\]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+', '') AS safe, trim(regexp_replace(translate(c_name, '_-#', '  #'), ' +', ' ', 'g')) AS title FROM customer")
def safe_names(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name", readers.safe_name(F.concat(F.lit("up/"), "c_name", F.lit(" (1).pdf"))).alias("safe"), readers.title_of(F.concat(F.lit("up/"), "c_name", F.lit(".pdf"))).alias("title"))


@query("SELECT key, name FROM (SELECT key, min(name) AS name, count(*) AS n FROM (SELECT c_name AS name, arg_max(key, length(prefix)) AS key FROM customer JOIN (SELECT c_custkey AS key, substring(c_name, 1, length(c_name) - (c_custkey % 2)) AS prefix FROM customer) ON starts_with(c_name, prefix) GROUP BY c_name) GROUP BY key) WHERE n = 1")
def prefix_claims(t: Tables) -> DataFrame:
    p = t.customer.select(F.col("c_custkey").alias("key"), F.expr("substring(c_name, 1, cast(length(c_name) - (c_custkey % 2) as int))").alias("prefix"))
    files = t.customer.select(F.col("c_name").alias("name"))
    return writers.prefix_claims(p, files)


# ---- sessions and memory ----

_TOK = r"CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ')) END"


@query(
    f"""WITH m AS (SELECT conv_id, turn, role, {_TOK} AS tokens FROM conversations),
    r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS recent, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM m),
    c AS (SELECT *, max(CASE WHEN recent >= 60 THEN i END) OVER (PARTITION BY conv_id) AS crossing FROM r)
    SELECT conv_id, max(crossing) AS crossing, min(CASE WHEN role = 'user' AND i >= crossing AND i > 0 THEN turn END) AS first_kept, CAST(sum(tokens) AS BIGINT) AS tokens FROM c GROUP BY conv_id"""
)
def compaction_cutoff(t: Tables) -> DataFrame:
    return ss.compaction_cutoff(t.conversations, 60)


@query(f"WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, string_agg(CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'user' END || ': ' || substring(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), 1, 900), chr(10) ORDER BY turn) AS context FROM l WHERE n <= 4 GROUP BY conv_id")
def router_context(t: Tables) -> DataFrame:
    return ss.router_context(t.conversations)


@query("WITH m AS (SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_id FROM conversations) SELECT conv_id, turn, turn_id, row_number() OVER (PARTITION BY conv_id, turn_id ORDER BY turn) AS seq, conv_id || ':' || turn_id || ':' || row_number() OVER (PARTITION BY conv_id, turn_id ORDER BY turn) AS event_id FROM m")
def turn_sequence(t: Tables) -> DataFrame:
    return ss.turn_sequence(t.conversations)


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def latest_checkpoint(t: Tables) -> DataFrame:
    return ss.latest(t.events.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, min(event_id) AS ord FROM events GROUP BY ALL")
def doc_ref_merge(t: Tables) -> DataFrame:
    return ss.merge_refs(t.events.select("user_id", "event_type", "value", F.col("event_id").alias("ord")), "user_id", "event_type")


@query("SELECT event_id, round(least(greatest(pow(2.0, -greatest((epoch_us(TIMESTAMP '2026-01-01') - epoch_us(ts)) / 86400e6, 0.0) / 90.0), 0.0), 1.0), 6) AS recency FROM events")
def recency_score(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(nm.recency(F.col("ts"), F.lit("2026-01-01").cast("timestamp")), 6).alias("recency"))


@query(
    """WITH h AS (SELECT user_id AS query_id, event_id AS memory_id, ts, least(value / 250.0, 1.0) AS semantic FROM events),
    s AS (SELECT *, round(0.8 * semantic + (1 - 0.8) * least(greatest(pow(2.0, -greatest((epoch_us(TIMESTAMP '2026-01-01') - epoch_us(ts)) / 86400e6, 0.0) / 90.0), 0.0), 1.0), 4) AS score FROM h WHERE semantic >= 0.2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ts DESC, memory_id DESC) AS rank FROM s) SELECT query_id, memory_id, score, rank FROM r WHERE rank <= 3"""
)
def memory_rank(t: Tables) -> DataFrame:
    h = t.events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("memory_id"), F.col("ts").alias("updated_at"), F.least(F.col("value") / 250.0, F.lit(1.0)).alias("semantic"))
    return ss.memory_rank(h, F.lit("2026-01-01").cast("timestamp"))


@query("SELECT event_id AS id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 25")
def outbox_batch(t: Tables) -> DataFrame:
    """The oldest pending operations, up to the worker's stated bound."""
    ops = t.events.select(F.col("event_id").alias("id"), "event_type", F.when(F.col("event_type") == "error", "pending").otherwise("done").alias("status"))
    return ss.outbox_batch(ops, 25).select("id", "event_type")


@query("SELECT doc_id AS id, CASE WHEN ok THEN 'new' ELSE 'old' END AS content, CASE WHEN ok THEN doc_id + 100 ELSE doc_id % 7 END AS updated_at, ok AS applied FROM (SELECT doc_id, lang <> 'fr' AND doc_id % 2 = 0 AS ok FROM documents)")
def optimistic_merge(t: Tables) -> DataFrame:
    """Changes apply only to active rows that are as the writer saw them."""
    stored = t.documents.select(F.col("doc_id").alias("id"), F.lit("old").alias("content"), (F.col("doc_id") % 7).alias("updated_at"), F.when(F.col("lang") != "fr", "active").otherwise("superseded").alias("status"))
    changes = t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 7).otherwise(-1).alias("seen_at"), F.lit("new").alias("content"), (F.col("doc_id") + 100).alias("new_at"))
    return ss.optimistic_merge(stored, changes).drop("status")


@query("SELECT user_id, sum(new) AS sessions, max(n) AS longest FROM (SELECT user_id, s, max(new) AS new, count(*) AS n FROM (SELECT user_id, ts, new, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL) GROUP BY user_id".replace("sum(new) AS sessions", "CAST(sum(new) AS BIGINT) AS sessions"))
def sessionize_events(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.select("user_id", "ts", "event_id")
    new = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL '2' HOUR"), 0).otherwise(1)
    s = e.withColumn("new", new).withColumn("s", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "s").agg(F.max("new").alias("new"), F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.sum("new").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT event_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS failures FROM events")
def circuit_window(t: Tables) -> DataFrame:
    """Failures of a user in the window up to each event."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-6 * 3600 * 1_000_000, 0)
    return t.events.select("event_id", F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(w).alias("failures"))


@query("SELECT user_id, event_type, island, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL")
def event_islands(t: Tables) -> DataFrame:
    return st.islands(t.events.select("user_id", "event_type", "event_id"), "event_type", "user_id", order="event_id")


@query("SELECT user_id, min(event_id) AS event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = 'error' AND a = 'error' AND b = 'error' GROUP BY user_id")
def error_aborts(t: Tables) -> DataFrame:
    """Where a user's third error in a row stops the run."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = t.events.select("user_id", "event_id", "event_type", F.lag("event_type").over(w).alias("a"), F.lag("event_type", 2).over(w).alias("b"))
    return e.where("event_type = 'error' AND a = 'error' AND b = 'error'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


# ---- evidence: documents support the claim of their source, labels carry the confidence ----


def _support(t: Tables) -> DataFrame:
    return t.labels.select(F.concat(F.lit("C"), (F.col("doc_id") % 40).cast("string")).alias("claim_id"), F.concat(F.lit("E"), F.col("doc_id").cast("string")).alias("evidence_id"), ((F.col("doc_id") % 13) / 13.0 * (F.col("quality") * 0.5 + 0.5)).alias("confidence"))


def _claims(t: Tables) -> DataFrame:
    return t.benchmark.select(F.concat(F.lit("C"), F.col("item_id").cast("string")).alias("claim_id"), (F.col("item_id") % 2 == 0).alias("required"))


def _conflicts(t: Tables) -> DataFrame:
    e = t.labels.where("toxic = 1").select(F.concat(F.lit("E"), F.col("doc_id").cast("string")).alias("a"), F.concat(F.lit("E"), (F.col("doc_id") + 1).cast("string")).alias("b"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


_S = "s AS (SELECT 'C' || (doc_id % 40) AS claim_id, 'E' || doc_id AS evidence_id, (doc_id % 13) / 13.0 * (quality * 0.5 + 0.5) AS confidence FROM labels)"
_C = "cl AS (SELECT 'C' || item_id AS claim_id, item_id % 2 = 0 AS required FROM benchmark)"
_X = "x AS (SELECT DISTINCT a, b FROM (SELECT 'E' || doc_id AS a, 'E' || (doc_id + 1) AS b FROM labels WHERE toxic = 1 UNION ALL SELECT 'E' || (doc_id + 1), 'E' || doc_id FROM labels WHERE toxic = 1))"
_ST = "st AS (SELECT cl.claim_id, CASE WHEN bool_or(evidence_id IN (SELECT a FROM x)) THEN 'conflicted' WHEN count(evidence_id) = 0 THEN 'missing' WHEN max(confidence) >= 0.6 THEN 'covered' ELSE 'partial' END AS status FROM cl LEFT JOIN s USING (claim_id) GROUP BY cl.claim_id)"


@query(f"WITH {_S}, {_C}, {_X}, {_ST} SELECT claim_id, status FROM st")
def claim_status(t: Tables) -> DataFrame:
    return ev.claim_status(_claims(t), _support(t), _conflicts(t))


@query(f"WITH {_S}, {_C}, {_X}, {_ST} SELECT bool_and(status = 'covered') AND (SELECT count(*) FROM x) = 0 AS sufficient FROM st JOIN cl USING (claim_id) WHERE required")
def pool_sufficient(t: Tables) -> DataFrame:
    statuses = ev.claim_status(_claims(t), _support(t), _conflicts(t))
    return ev.pool_sufficient(_claims(t), statuses, _conflicts(t))


_COVER = f"""WITH {_S}, {_X}, b AS (SELECT DISTINCT evidence_id FROM (SELECT evidence_id, row_number() OVER (PARTITION BY claim_id ORDER BY confidence DESC, evidence_id) AS n FROM s) WHERE n = 1),
    o AS (SELECT evidence_id, max(confidence) AS confidence FROM s GROUP BY 1),
    t AS (SELECT evidence_id, confidence, CASE WHEN evidence_id IN (SELECT evidence_id FROM b) THEN 1 WHEN evidence_id IN (SELECT a FROM x) THEN 2 ELSE 3 END AS tier FROM o),
    p AS (SELECT evidence_id, tier, row_number() OVER (PARTITION BY tier ORDER BY confidence DESC, evidence_id) AS place FROM t)"""


@query(f"{_COVER} SELECT * FROM p")
def evidence_cover(t: Tables) -> DataFrame:
    return ev.cover_order(_support(t), _conflicts(t))


@query(f"WITH {_X}, u AS (SELECT 'E' || doc_id AS id FROM labels WHERE quality = 1) SELECT a, b FROM x WHERE (a IN (SELECT id FROM u)) <> (b IN (SELECT id FROM u))")
def conflict_xor(t: Tables) -> DataFrame:
    used = t.labels.where("quality = 1").select(F.concat(F.lit("E"), F.col("doc_id").cast("string")).alias("evidence_id"))
    return ev.conflict_faults(_conflicts(t), used)


@query(f"WITH {_X}, {_S}, {_C} SELECT DISTINCT 'unknown_evidence' AS fault, a AS id FROM x WHERE a NOT IN (SELECT evidence_id FROM s) UNION ALL SELECT DISTINCT 'unknown_claim', claim_id FROM s WHERE claim_id NOT IN (SELECT claim_id FROM cl)")
def evidence_integrity(t: Tables) -> DataFrame:
    s = _support(t)
    links = s.select("evidence_id", "claim_id").unionByName(_conflicts(t).select(F.col("a").alias("evidence_id"), F.lit("C0").alias("claim_id")))
    return ev.integrity(s.select("evidence_id"), links, _claims(t), _conflicts(t))


@query("WITH i AS (SELECT doc_id % 40 AS pack, doc_id AS place, n_chars FROM documents), u AS (SELECT *, sum(n_chars) OVER (PARTITION BY pack ORDER BY place ROWS UNBOUNDED PRECEDING) AS used FROM i) SELECT pack, place, CAST(used AS BIGINT) AS used FROM u WHERE used <= 12000")
def budget_prefix(t: Tables) -> DataFrame:
    i = t.documents.select((F.col("doc_id") % 40).alias("pack"), F.col("doc_id").alias("place"), F.col("n_chars").alias("tokens"))
    return ev.budget_prefix(i, 12_000, "pack").select("pack", "place", "used")


@query()
def budget_shrink(t: Tables) -> DataFrame:
    i = t.documents.select((F.col("doc_id") % 100).alias("pack"), F.col("doc_id").alias("place"), (F.col("doc_id") % 4 == 0).alias("required"), F.col("text").alias("excerpt"))
    return ev.shrink_to_budget(i, 800, "pack").select("pack", "place", "required", F.length("excerpt").alias("chars"))


@query()
def judge_decisions(t: Tables) -> DataFrame:
    """keep, drop, merge and conflict folded into pools, all or nothing for each."""
    d = t.events.select(F.col("user_id").alias("pool_id"), F.col("event_id").alias("ord"), F.expr("CASE event_type WHEN 'error' THEN 'drop' WHEN 'click' THEN 'merge' WHEN 'signup' THEN 'conflict' ELSE 'keep' END").alias("action"), F.lit("E1").alias("target"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("statement"), F.coalesce("value", F.lit(0.0)).alias("confidence"))
    return ev.apply_decisions(d)


@query("SELECT evidence_id, list_distinct(flatten(list(sources ORDER BY ord))) AS sources, max(confidence) AS confidence FROM (SELECT 'E' || (event_id % 300) AS evidence_id, event_id AS ord, ['chunk:' || (event_id % 7), 'chunk:' || (event_id % 3)] AS sources, value AS confidence FROM events) GROUP BY evidence_id".replace("list_distinct(flatten(list(sources ORDER BY ord)))", "list_sort(list_distinct(flatten(list(sources))))"))
def evidence_merge(t: Tables) -> DataFrame:
    e = t.events.select(F.concat(F.lit("E"), (F.col("event_id") % 300).cast("string")).alias("evidence_id"), F.col("event_id").alias("ord"), F.array(*(F.concat(F.lit("chunk:"), (F.col("event_id") % m).cast("string")) for m in (7, 3))).alias("sources"), F.array().cast("array<string>").alias("claims"), F.col("value").alias("confidence"))
    return ev.merge(e).select("evidence_id", F.sort_array("sources").alias("sources"), "confidence")


# ---- layout: lines of documents as blocks; every 40 lines a page, boxes from the line's number and length ----


def _blocks(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text"))
    n = F.length("text")
    left = F.when(F.col("ord") % 3 == 1, 320.0).otherwise(40.0)
    return lines.select(
        "doc_id", "ord", F.concat_ws(":", "doc_id", "ord").alias("uid"), F.floor(F.col("ord") / 8).cast("int").alias("page"), "text",
        left.alias("x0"), ((F.col("ord") % 8) * 90.0).alias("y0"), (left + F.least(n * 2.0, F.lit(520.0))).alias("x1"), ((F.col("ord") % 8) * 90.0 + 40).alias("y1"), F.lit(600.0).alias("width"),
        F.when(n < 30, F.col("ord") % 3 + 1).cast("int").alias("level"),
    )


_B = """l AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS ord FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
b AS (SELECT doc_id, ord, doc_id || ':' || ord AS uid, CAST(ord // 8 AS INT) AS page, text, CASE WHEN ord % 3 = 1 THEN 320.0::DOUBLE ELSE 40.0::DOUBLE END AS x0, (ord % 8) * 90.0::DOUBLE AS y0,
      CASE WHEN ord % 3 = 1 THEN 320.0::DOUBLE ELSE 40.0::DOUBLE END + least(length(text) * 2.0::DOUBLE, 520.0::DOUBLE) AS x1, (ord % 8) * 90.0::DOUBLE + 40 AS y1, 600.0::DOUBLE AS width,
      CASE WHEN length(text) < 30 THEN ord % 3 + 1 END AS level FROM l)"""


@query(f"WITH {_B}, s AS (SELECT *, sum(CASE WHEN x1 - x0 > 0.6 * width THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, uid ROWS UNBOUNDED PRECEDING) AS band, CASE WHEN x1 - x0 > 0.6 * width THEN 0 WHEN (x0 + x1) / 2 < width / 2 THEN 1 ELSE 2 END AS side FROM b) SELECT uid, row_number() OVER (PARTITION BY doc_id ORDER BY page, band, side, y0, x0, uid) - 1 AS reading_order FROM s")
def reading_order(t: Tables) -> DataFrame:
    return st.reading_order(_blocks(t)).select("uid", "reading_order")


@query(f"WITH {_B}, s AS (SELECT *, last_value(CASE WHEN level = 1 THEN text END IGNORE NULLS) OVER w AS section, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER w AS top FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)) SELECT doc_id, ord, section, last_value(CASE WHEN level = 2 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id, top ORDER BY ord ROWS UNBOUNDED PRECEDING) AS subsection FROM s")
def section_carry(t: Tables) -> DataFrame:
    return st.sections(_blocks(t)).select("doc_id", "ord", "section", "subsection")


@query()
def section_stack(t: Tables) -> DataFrame:
    return st.section_stack(_blocks(t))


@query(f"WITH {_B}, f AS (SELECT doc_id, 'f' || (ord % 4) AS font, 8 + ord % 3 AS size, length(text) AS chars FROM b), a AS (SELECT doc_id, font, sum(chars) AS n FROM f GROUP BY ALL), z AS (SELECT doc_id, size, sum(chars) AS n FROM f GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY size ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY doc_id) AS total FROM z), m AS (SELECT doc_id, min(size) AS median_size FROM c WHERE upto * 2 >= total GROUP BY doc_id) SELECT a.doc_id, arg_min(font, (-n, font)) AS font, any_value(median_size) AS median_size FROM a JOIN m USING (doc_id) GROUP BY a.doc_id")
def body_statistics(t: Tables) -> DataFrame:
    s = _blocks(t).select("doc_id", F.concat(F.lit("f"), (F.col("ord") % 4).cast("string")).alias("font"), (8 + F.col("ord") % 3).alias("size"), F.length("text").alias("chars"))
    return st.body_stats(s)


@query(rf"WITH {_B}, m AS (SELECT doc_id, page, CASE WHEN regexp_matches(text, '^\s*[0-9]+\s*$') THEN '<page-number>' ELSE lower(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))) END AS margin FROM b WHERE ord % 8 IN (0, 7)), t AS (SELECT doc_id, count(DISTINCT page) AS total FROM m GROUP BY 1), r AS (SELECT doc_id, margin, count(DISTINCT page) AS pages FROM m GROUP BY ALL) SELECT doc_id, margin, pages FROM r JOIN t USING (doc_id) WHERE pages > 1 AND pages >= 0.6 * total")
def repeated_margins(t: Tables) -> DataFrame:
    return st.repeated_margins(_blocks(t).where("ord % 8 IN (0, 7)").select("doc_id", "page", "text"))


@query(f"WITH {_B}, i AS (SELECT doc_id, page, x0 AS lo, x1 AS hi FROM b), r AS (SELECT *, max(hi) OVER (PARTITION BY doc_id, page ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM r) SELECT doc_id, page, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY doc_id, page, k")
def interval_merge(t: Tables) -> DataFrame:
    return st.merged_intervals(_blocks(t).select("doc_id", "page", F.col("x0").alias("lo"), F.col("x1").alias("hi")), "doc_id", "page")


@query(f"WITH {_B}, c AS (SELECT ord AS id, * EXCLUDE (ord) FROM b WHERE ord % 8 = 3), g AS (SELECT ord AS id, * EXCLUDE (ord) FROM b WHERE ord % 8 IN (2, 4, 5)), j AS (SELECT c.doc_id, c.page, c.id AS caption_id, g.id AS region_id, (least(c.x1, g.x1) - greatest(c.x0, g.x0)) / nullif(least(c.x1 - c.x0, g.x1 - g.x0), 0) AS ratio, greatest(c.y0 - g.y1, g.y0 - c.y1, 0.0) AS apart FROM c JOIN g ON c.doc_id = g.doc_id AND c.page = g.page) SELECT doc_id, page, caption_id, region_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, caption_id ORDER BY apart, ratio DESC, region_id) AS n FROM j WHERE ratio >= 0.15 AND apart <= 96) WHERE n = 1")
def caption_match(t: Tables) -> DataFrame:
    b = _blocks(t).select("doc_id", "page", F.col("ord").alias("id"), "x0", "y0", "x1", "y1").where("x1 > x0")
    return st.captions(b.where("id % 8 = 3"), b.where("id % 8 IN (2, 4, 5)"))


@query()
def caption_greedy(t: Tables) -> DataFrame:
    b = _blocks(t).select("doc_id", "page", F.col("ord").cast("long").alias("id"), "x0", "y0", "x1", "y1", F.lit(720.0).alias("height")).where("x1 > x0")
    return st.greedy_captions(b.where("id % 8 IN (3, 6)"), b.where("id % 8 IN (2, 4, 5)"))


@query(f"WITH {_B}, c AS (SELECT r, c, c * 300.0 AS x0, (c + 1) * 300.0 AS x1, r * 180.0 AS y0, (r + 1) * 180.0 AS y1 FROM (SELECT unnest(range(4)) AS r), (SELECT unnest(range(2)) AS c)) SELECT b.uid AS line_id, arg_min(r, (r, c)) AS \"row\", arg_min(c, (r, c)) AS col FROM b JOIN c ON (b.x0 + b.x1) / 2 BETWEEN c.x0 AND c.x1 AND (b.y0 + b.y1) / 2 BETWEEN c.y0 AND c.y1 GROUP BY b.uid")
def cell_join(t: Tables) -> DataFrame:
    b = _blocks(t).select(F.concat_ws("/", "doc_id", "page").alias("page"), F.col("uid").alias("line_id"), "x0", "y0", "x1", "y1")
    grid = t.spark.range(4).select(F.col("id").alias("row")).crossJoin(t.spark.range(2).select(F.col("id").alias("col")))
    grid = grid.select("row", "col", (F.col("col") * 300.0).alias("x0"), ((F.col("col") + 1) * 300.0).alias("x1"), (F.col("row") * 180.0).alias("y0"), ((F.col("row") + 1) * 180.0).alias("y1"))
    # Every page has the same grid of eight cells.
    cells = b.select("page").distinct().crossJoin(F.broadcast(grid))
    return st.cell_of(b, cells).select("line_id", "row", "col")


@query("SELECT doc_id, round(greatest(least(x1, 300.0) - greatest(x0, 100.0), 0) * greatest(least(y1, 400.0) - greatest(y0, 50.0), 0) / nullif((x1 - x0) * (y1 - y0), 0), 6) AS share FROM (SELECT doc_id, doc_id % 200 AS x0, doc_id % 90 AS y0, doc_id % 200 + n_chars % 500 AS x1, doc_id % 90 + 120 AS y1 FROM documents)")
def region_overlap(t: Tables) -> DataFrame:
    b = st.box(F.col("doc_id") % 200, F.col("doc_id") % 90, F.col("doc_id") % 200 + F.col("n_chars") % 500, F.col("doc_id") % 90 + 120)
    region = st.box(F.lit(100), F.lit(50), F.lit(300), F.lit(400))
    return t.documents.select("doc_id", F.round(F.when(st.area(b) > 0, st.overlap(b, region) / st.area(b)), 6).alias("share"))


@query("SELECT source, min(doc_id % 200) AS x0, min(doc_id % 90) AS y0, max(doc_id % 200 + n_chars % 500) AS x1, max(doc_id % 90 + 120) AS y1 FROM documents GROUP BY source")
def region_union(t: Tables) -> DataFrame:
    b = t.documents.select("source", st.box(F.col("doc_id") % 200, F.col("doc_id") % 90, F.col("doc_id") % 200 + F.col("n_chars") % 500, F.col("doc_id") % 90 + 120).alias("b"))
    return b.groupBy("source").agg(st.union_box(F.col("b")).alias("u")).select("source", *(F.col(f"u.{c}").cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("SELECT doc_id, round(CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END, 9) AS p FROM (SELECT doc_id, (doc_id % 101) - 50.0 AS x FROM documents)")
def rerank_sigmoid(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(nm.sigmoid((F.col("doc_id") % 101) - 50.0), 9).alias("p"))


_EV = r"array_to_string(list_transform(regexp_extract_all(coalesce({c}, ''), '[\p{{L}}\p{{N}}]+'), lambda x: lower(x)), ' ')"


@query(f"SELECT doc_id, {_EV.format(c='text')} AS normal, len(list_distinct(string_split({_EV.format(c='text')}, ' '))) AS kinds FROM documents")
def evidence_normal(t: Tables) -> DataFrame:
    n = tx.evidence_text(F.col("text"))
    return t.documents.select("doc_id", n.alias("normal"), F.size(F.array_distinct(F.split(n, " "))).alias("kinds"))
