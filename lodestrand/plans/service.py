"""Service queries: uploads, outbox, progress, memory candidates, answers, settings, traces; events stand for log rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import text as tx
from lodestrand.operators import service
from lodestrand.plans.agent import _reasons
from lodestrand.plans.registry import Tables, query, same_sql
from lodestrand.plans.texts import SQZ, _q
from lodestrand.runtime import shared_dir
from lodestrand.sources import files

_UP = "SELECT page_id AS upload_id, CASE WHEN page_id % 7 = 0 THEN 'a.txt' ELSE url || '.PDF' END AS name, CASE WHEN page_id % 3 = 0 THEN '' ELSE '%PDF-1.7 ' END || html || CASE page_id % 5 WHEN 0 THEN ' /Encrypt' WHEN 1 THEN ' /Type /Pages' ELSE ' /Type /Page >>' END AS content FROM pages"


@query(f"SELECT upload_id, " + _reasons(("NOT ends_with(lower(coalesce(name, '')), '.pdf')", "file_type"), ("NOT starts_with(coalesce(content, ''), '%PDF-')", "magic"), ("contains(coalesce(content, ''), '/Encrypt')", "encrypted"), (r"NOT regexp_matches(coalesce(content, ''), '/Type\s*/Page[^s]')", "no_pages")) + f" AS faults FROM ({_UP})")
def upload_faults(t: Tables) -> DataFrame:
    """Pages behind the beginnings and ends of a document file."""
    k = F.col("page_id")
    body = F.concat(F.when(k % 3 == 0, "").otherwise("%PDF-1.7 "), F.col("html"), F.when(k % 5 == 0, " /Encrypt").when(k % 5 == 1, " /Type /Pages").otherwise(" /Type /Page >>"))
    return service.upload_faults(t.pages.select(k.alias("upload_id"), F.when(k % 7 == 0, "a.txt").otherwise(F.concat("url", F.lit(".PDF"))).alias("name"), body.alias("content")))


_KIND = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'acked' WHEN 'purchase' THEN 'applied' ELSE 'queued' END"


@query(
    f"""WITH l AS (SELECT event_id % 2500 AS op_id, event_id AS ord, {_KIND} AS kind, props AS error FROM events),
    g AS (SELECT op_id, count(*) FILTER (kind = 'failed') AS attempts, count(*) FILTER (kind = 'acked') > 0 AS acked, count(*) FILTER (kind = 'applied') > 0 AS applied, arg_max(error, ord) FILTER (kind = 'failed') AS last_error FROM l GROUP BY 1)
    SELECT op_id, CASE WHEN acked AND applied THEN 'done' WHEN attempts >= 3 THEN 'dead' WHEN acked THEN 'acked' ELSE 'pending' END AS status, attempts, last_error FROM g"""
)
def outbox_states(t: Tables) -> DataFrame:
    return service.outbox_states(t.events.select((F.col("event_id") % 2500).alias("op_id"), F.col("event_id").alias("ord"), F.expr(_KIND).alias("kind"), F.col("props").alias("error")))


@query(
    """WITH w AS (SELECT user_id AS session_id, event_type AS kind, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended,
      value * 1.0 - lag(value * 1.0) OVER (PARTITION BY user_id ORDER BY event_id) AS gap, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events)
    SELECT session_id, seq, kind, CAST(greatest(0, ceil(coalesce(gap, 0.0) / 5.0) - 1) AS BIGINT) AS beats FROM w WHERE ended = 0"""
)
def progress_log(t: Tables) -> DataFrame:
    """Events up to a user's first error, the value as their clock."""
    e = t.events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), F.col("value").cast("double").alias("t"), F.col("event_type").alias("kind"), (F.col("event_type") == "error").alias("terminal"))
    return service.progress_log(e)


_KEY = "lower(" + SQZ.format(c="content") + ")"


@query(
    f"""WITH c AS (SELECT doc_id AS candidate_id, lang AS kind, text AS content, CASE WHEN n_chars % 5 = 0 THEN 0.5 ELSE 0.9 END AS confidence FROM documents), e AS (SELECT source, lang AS kind, text AS content, CASE WHEN doc_id % 9 = 0 THEN 'syncing' WHEN doc_id % 4 = 0 THEN 'active' ELSE 'gone' END AS status FROM documents WHERE source IN ('src1', 'src2')),
    k AS (SELECT *, {_KEY} AS k FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY candidate_id) AS n FROM k)
    SELECT candidate_id, CASE WHEN k = '' THEN 'empty_content' WHEN length(k) > 1000 THEN 'too_long' WHEN confidence < 0.8 THEN 'low_confidence' WHEN regexp_matches(content, '{_q(tx.EVIDENCE_MARKER_PATTERN)}') THEN 'evidence_marker'
      WHEN k IN (SELECT {_KEY} FROM e WHERE status = 'active') THEN 'exact_duplicate' WHEN n > 1 THEN 'repeated_candidate' WHEN kind IN (SELECT kind FROM e WHERE status = 'syncing') THEN 'same_type_sync_pending' END AS fault FROM n"""
)
def memory_candidates(t: Tables) -> DataFrame:
    """Documents as proposed memories, those of two sources as the store."""
    d = t.documents
    c = d.select(F.col("doc_id").alias("candidate_id"), F.col("lang").alias("kind"), F.col("text").alias("content"), F.when(F.col("n_chars") % 5 == 0, 0.5).otherwise(0.9).alias("confidence"))
    e = d.where("source IN ('src1', 'src2')").select(F.col("doc_id").alias("memory_id"), F.col("lang").alias("kind"), F.col("text").alias("content"), F.when(F.col("doc_id") % 9 == 0, "syncing").when(F.col("doc_id") % 4 == 0, "active").otherwise("gone").alias("status"))
    return service.memory_candidates(c, e)


_ANS = "SELECT conv_id * 100 + turn AS answer_id, CASE WHEN role = 'system' THEN ' ' ELSE coalesce(text, '') || CASE WHEN turn % 3 > 0 THEN ' [E' || (length(coalesce(text, '')) % 5) || '] and [E1].' ELSE '' END END AS text FROM conversations"


@query(f"WITH a AS ({_ANS}), c AS (SELECT *, regexp_extract_all(text, '\\[(E[0-9]+)\\]', 1) AS cited, ['C1', 'C' || (length(text) % 3)] AS claimed FROM a) SELECT answer_id, len(cited) AS citations, " + _reasons(("trim(text) = ''", "empty_answer"), ("len(cited) = 0", "no_citation"), ("NOT list_has_all(['E0', 'E1', 'E2', 'E3'], cited)", "unknown_citation"), ("NOT list_has_all(claimed, ['C1', 'C2'])", "claim_not_answered")) + " AS faults FROM c")
def checked_answers(t: Tables) -> DataFrame:
    """Messages as answers with markers; evidence E0 to E3 is known and claims C1 and C2 are required."""
    said = F.coalesce("text", F.lit(""))
    text = F.when(F.col("role") == "system", " ").otherwise(F.concat(said, F.when(F.col("turn") % 3 > 0, F.concat(F.lit(" [E"), (F.length(said) % 5).cast("string"), F.lit("] and [E1]."))).otherwise("")))
    lists = lambda *x: F.array(*(F.lit(i) for i in x))
    a = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), text.alias("text"))
    return service.checked_answers(a.select("answer_id", "text", lists("E0", "E1", "E2", "E3").alias("known"), lists("C1", "C2").alias("required"), F.array(F.lit("C1"), F.concat(F.lit("C"), (F.length("text") % 3).cast("string"))).alias("claimed")))


@query("WITH l AS (SELECT event_id % 3 AS f, event_id AS n, 'KEY_' || user_id AS name, CASE event_type WHEN 'click' THEN 'a b' WHEN 'view' THEN CAST(event_id AS VARCHAR) ELSE 'x' END AS value FROM events WHERE event_type NOT IN ('error', 'signup')) SELECT name, arg_max(value, (f, n)) AS value FROM l GROUP BY name")
def settings_of_lines(t: Tables) -> DataFrame:
    """Lines of three files: quoted, with a comment, exported; errors are comments and sign-ups malformed."""
    line = F.expr(
        """CASE event_type WHEN 'click' THEN concat('KEY_', user_id, ' = "a b"') WHEN 'view' THEN concat('export KEY_', user_id, '=', event_id, ' # note')
        WHEN 'error' THEN concat('# KEY_', user_id, '=no') WHEN 'signup' THEN 'no setting here' ELSE concat('KEY_', user_id, "='x'") END"""
    )
    return service.settings(t.events.select((F.col("event_id") % 3).alias("file_no"), F.col("event_id").alias("line_no"), line.alias("line")))


@query("SELECT user_id AS session_id, event_id AS ord, 'agent_' || event_type AS type, CASE event_type WHEN 'view' THEN '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' ELSE '{}' END AS payload FROM events WHERE event_type IN ('view', 'click')")
def trace_events(t: Tables) -> DataFrame:
    """Views may tell their key, clicks a field that they lack, and nothing else leaves."""
    e = t.events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("kind"), F.col("props").alias("data"))
    return service.trace_events(e, {"view": ("k",), "click": ("secret",)})


@query(
    f"""WITH c AS (SELECT doc_id % 50 AS group_id, doc_id AS ord, length(substring({SQZ.format(c='text')}, 1, 200)) AS n FROM documents), f AS (SELECT *, sum(n) OVER (PARTITION BY group_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS used FROM c)
    SELECT group_id, count(*) AS items, CAST(max(used) AS BIGINT) AS chars FROM f WHERE used <= 1000 GROUP BY group_id"""
)
def bounded_payloads(t: Tables) -> DataFrame:
    d = t.documents.select((F.col("doc_id") % 50).alias("group_id"), F.col("doc_id").alias("ord"), F.col("source").alias("title"), "text")
    items = F.from_json("payload", "array<struct<title:string,excerpt:string>>")
    each = service.bounded_payloads(d).select("group_id", items.alias("x"))
    return each.select("group_id", F.size("x").cast("bigint").alias("items"), F.aggregate("x", F.lit(0).cast("bigint"), lambda s, i: s + F.length(i["excerpt"])).alias("chars"))


@query("WITH q AS (SELECT event_id AS question_id, CASE event_type WHEN 'view' THEN 'count' WHEN 'click' THEN 'inventory' ELSE 'other' END AS op FROM events), f AS (SELECT 'count' AS op, count(*) AS n FROM documents UNION ALL SELECT 'inventory', count(DISTINCT source) FROM documents) SELECT question_id, CASE WHEN n IS NULL THEN 'unknown' ELSE n || CASE op WHEN 'count' THEN ' documents' ELSE ' sources' END END AS answer FROM q LEFT JOIN f USING (op)")
def metadata_answers(t: Tables) -> DataFrame:
    questions = t.events.select(F.col("event_id").alias("question_id"), F.when(F.col("event_type") == "view", "count").when(F.col("event_type") == "click", "inventory").otherwise("other").alias("operation"))
    facts = t.documents.agg(F.count(F.lit(1)).alias("c"), F.count_distinct("source").alias("s")).select(F.explode(F.array(F.struct(F.lit("count").alias("operation"), F.col("c").alias("n")), F.struct(F.lit("inventory").alias("operation"), F.col("s").alias("n")))).alias("x")).select("x.*")
    return service.metadata_answers(questions, facts, {"count": "documents", "inventory": "sources"})


@query(
    """WITH s AS (SELECT user_id AS group_id, CASE WHEN event_id % 2 = 0 THEN 'dev' ELSE 'test' END AS part, [3, 5, 8, 10, 15, 20][1 + event_id % 6] AS k, max(value) / 250.0 AS hit, max(value) / 200.0 AS documents FROM events GROUP BY ALL),
    d AS (SELECT group_id, min(CASE WHEN hit >= 0.5 AND documents >= 0.6 THEN k END) AS good, max(k) AS largest FROM s WHERE part = 'dev' GROUP BY 1), c AS (SELECT group_id, coalesce(good, largest) AS k FROM d)
    SELECT c.group_id, c.k, round(hit, 6) AS test_hit FROM c LEFT JOIN s ON s.group_id = c.group_id AND s.k = c.k AND part = 'test'"""
)
def dev_test_k(t: Tables) -> DataFrame:
    k = F.element_at(F.array(*(F.lit(x) for x in (3, 5, 8, 10, 15, 20))), (1 + F.col("event_id") % 6).cast("int"))
    part = F.when(F.col("event_id") % 2 == 0, "dev").otherwise("test")
    s = t.events.groupBy(F.col("user_id").alias("group_id"), part.alias("part"), k.alias("k")).agg((F.max("value") / 250.0).alias("hit"), (F.max("value") / 200.0).alias("documents"))
    return service.dev_test_k(s, 0.5, 0.6).withColumn("test_hit", F.round("test_hit", 6))


@query("SELECT doc_id, source, n_chars FROM documents WHERE text IS NOT NULL")
def json_round_trip(t: Tables) -> DataFrame:
    """Rows written as JSON lines by one atomic job, and read back strictly."""
    path = f"{shared_dir(t.spark)}/lines-{uuid.uuid4().hex}"
    d = t.documents.where("text IS NOT NULL").select("doc_id", "source", "n_chars")
    files.write_json_lines(d, path)
    return files.manifests(t.spark, path, "doc_id bigint, source string, n_chars bigint")


_PHASE = "CASE event_type WHEN 'view' THEN 'prepared' WHEN 'click' THEN 'checkpoint' WHEN 'purchase' THEN 'committed' ELSE 'other' END"


@query(
    f"""WITH l AS (SELECT event_id % 3000 AS key, event_id AS ord, {_PHASE} AS kind FROM events), g AS (SELECT key, min(CASE WHEN kind = 'prepared' THEN ord END) AS p, max(CASE WHEN kind = 'checkpoint' THEN ord END) AS c, max(CASE WHEN kind = 'committed' THEN ord END) AS d FROM l GROUP BY 1)
    SELECT key, CASE WHEN p IS NULL THEN 'none' WHEN NOT coalesce(c > p, false) THEN 'undo' WHEN coalesce(d > c, false) THEN 'done' ELSE 'finish' END AS state FROM g"""
)
def two_phase_states(t: Tables) -> DataFrame:
    return service.two_phase(t.events.select((F.col("event_id") % 3000).alias("key"), F.col("event_id").alias("ord"), F.expr(_PHASE).alias("kind")))


@query(
    """WITH m AS (SELECT conv_id AS session_id, turn AS ord, length(coalesce(text, '')) AS tokens FROM conversations), r AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY ord DESC ROWS UNBOUNDED PRECEDING) AS recent, row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) = 1 AS newest FROM m),
    g AS (SELECT session_id, CAST(sum(tokens) AS BIGINT) AS before, CAST(sum(CASE WHEN recent <= 800 OR newest THEN tokens ELSE 0 END) AS BIGINT) AS kept FROM r GROUP BY 1)
    SELECT session_id, before, CASE WHEN before < 1500 THEN before ELSE kept END AS after, CASE WHEN before < 1500 THEN 'fits' WHEN kept < 1500 THEN 'retried' ELSE 'failed' END AS outcome FROM g"""
)
def overflow_outcomes(t: Tables) -> DataFrame:
    m = t.conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), F.length(F.coalesce("text", F.lit(""))).alias("tokens"))
    return service.overflow_outcomes(m, 1500, 800)


@query("WITH c AS (SELECT user_id AS session_id, event_id AS ord, CASE event_type WHEN 'signup' THEN 'local' WHEN 'click' THEN 'external' ELSE 'other' END AS tool FROM events), f AS (SELECT *, min(CASE WHEN tool = 'local' THEN ord END) OVER (PARTITION BY session_id) AS l FROM c) SELECT session_id, ord FROM f WHERE tool = 'external' AND (l IS NULL OR ord < l)")
def early_external(t: Tables) -> DataFrame:
    tool = F.when(F.col("event_type") == "signup", "local").when(F.col("event_type") == "click", "external").otherwise("other")
    return service.early_external(t.events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), tool.alias("tool")))


@query("WITH r AS (SELECT o_custkey AS case_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, o_orderkey AS chunk_id FROM orders) SELECT DISTINCT case_id, chunk_id FROM r ANTI JOIN (SELECT DISTINCT l_orderkey AS chunk_id FROM lineitem WHERE l_quantity > 30) l USING (chunk_id) WHERE rank <= 5")
def context_faults(t: Tables) -> DataFrame:
    """Orders as ranked chunks, of which storage holds those with a large line."""
    from pyspark.sql import Window

    r = t.orders.select(F.col("o_custkey").alias("case_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"), F.col("o_orderkey").alias("chunk_id"))
    return service.context_faults(r, t.lineitem.where("l_quantity > 30").select(F.col("l_orderkey").alias("chunk_id")), 5)


@query(
    r"""WITH w AS (SELECT page_id AS name, CASE WHEN page_id % 2 = 0 THEN upper(url) ELSE replace(url, '/', chr(92)) END AS path FROM pages WHERE url IS NOT NULL), s AS (SELECT page_id AS document_id, regexp_replace(url, '/(es|de|en|fr)', '/./\1') AS path FROM pages WHERE page_id % 3 < 2 AND url IS NOT NULL UNION ALL SELECT page_id + 1000000, url FROM pages WHERE page_id % 9 = 0 AND url IS NOT NULL),
    n AS (SELECT *, lower(regexp_replace(regexp_replace(replace(path, chr(92), '/'), '/(?:\./)+', '/', 'g'), '/+', '/', 'g')) AS k FROM w), k AS (SELECT lower(regexp_replace(regexp_replace(replace(path, chr(92), '/'), '/(?:\./)+', '/', 'g'), '/+', '/', 'g')) AS k, min(document_id) AS document_id, count(*) AS n FROM s GROUP BY 1)
    SELECT name, CASE WHEN k.n = 1 THEN document_id END AS document_id, CASE WHEN k.n IS NULL THEN 'ingest' WHEN k.n = 1 THEN 'reuse' ELSE 'ambiguous' END AS action FROM n LEFT JOIN k USING (k)"""
)
def corpus_reuse(t: Tables) -> DataFrame:
    """URLs as paths: in capitals or with other slashes as wanted, with dots as stored, some stored twice."""
    p = t.pages.where("url IS NOT NULL")
    wanted = p.select(F.col("page_id").alias("name"), F.when(F.col("page_id") % 2 == 0, F.upper("url")).otherwise(F.translate("url", "/", "\\")).alias("path"))
    once = p.where("page_id % 3 < 2").select(F.col("page_id").alias("document_id"), F.regexp_replace("url", r"^(.*?)/(es|de|en|fr)", "$1/./$2").alias("path"))
    again = p.where("page_id % 9 = 0").select((F.col("page_id") + 1000000).alias("document_id"), F.col("url").alias("path"))
    return service.corpus_reuse(wanted, once.unionByName(again))


@query("SELECT source, 'c' || doc_id AS case_id, lang AS query, ['t', lang] AS terms FROM documents WHERE doc_id % 6 <> 5")
def loaded_rewrites(t: Tables) -> DataFrame:
    """A file for each document with one case, some malformed."""
    body = F.when(F.col("doc_id") % 6 == 5, "{no").otherwise(F.concat(F.lit('{"cases": [{"case_id": "c'), F.col("doc_id").cast("string"), F.lit('", "english_query": "'), "lang", F.lit('", "lexical_terms": ["t", "'), "lang", F.lit('"]}]}')))
    return service.loaded_rewrites(t.documents.select("source", body.alias("body")))[0]


@query("SELECT doc_id AS page_id, 0 AS block_no, l AS line_no, s AS span_no, 'f' || s AS font, lang || l AS text FROM documents, (SELECT unnest([0, 1]) AS l), (SELECT unnest([0, 1, 2]) AS s)")
def raw_spans(t: Tables) -> DataFrame:
    """Pages of one text block with two lines of three spans, and an image block."""
    body = F.expr("""concat('{"blocks": [{"type": 0, "lines": [', concat_ws(',', transform(array(0, 1), l -> concat('{"spans": [', concat_ws(',', transform(array(0, 1, 2), s -> concat('{"font": "f', s, '", "text": "', lang, l, '"}'))), ']}'))), ']}, {"type": 1}]}')""")
    return service.raw_spans(t.documents.select(F.col("doc_id").alias("page_id"), body.alias("body")))


@query("SELECT doc_id, 'topic: ' || coalesce(source, 'not stated') || chr(10) || 'method: ' || CASE WHEN lang = 'en' THEN 'read' ELSE 'not described' END || chr(10) || 'experiment: ' || CASE WHEN n_chars > 2000 THEN 'long' ELSE 'not reported' END || chr(10) || 'limitation: none named' AS summary FROM documents")
def rule_summaries(t: Tables) -> DataFrame:
    return service.rule_summary(t.documents.select("doc_id", F.col("source").alias("topic"), F.when(F.col("lang") == "en", "read").otherwise(" ").alias("method"), F.when(F.col("n_chars") > 2000, "long").alias("experiment"), F.lit(None).cast("string").alias("limitation")))


same_sql("blocks_in_order", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS reading_order FROM {lineitem} WHERE l_orderkey IN (SELECT o_orderkey FROM {orders} WHERE o_custkey = 10)", "lineitem", "orders")
same_sql("pending_figures", "SELECT doc_id, source FROM {documents} WHERE text IS NOT NULL AND length(text) > 500 AND lang IN ('fr', 'es')", "documents")
same_sql("peak_memory", "SELECT user_id % 10 AS run_id, event_type AS scenario, max(value) AS peak FROM {events} WHERE event_type <> 'error' GROUP BY user_id % 10, event_type", "events")
same_sql("perf_measurements", "SELECT g.scenario, g.fixture, count(e.event_id) AS runs, count(CASE WHEN e.event_type = 'error' THEN 1 END) AS errors, max(e.value) AS slowest FROM (SELECT s.scenario, s.odd, b.item_id AS fixture FROM (SELECT 'cold' AS scenario, 0 AS odd UNION ALL SELECT 'warm', 1) s CROSS JOIN {benchmark} b) g LEFT JOIN {events} e ON e.event_id % 2 = g.odd AND e.user_id = g.fixture GROUP BY g.scenario, g.fixture", "benchmark", "events")
