"""Ingestion and API queries: parser output, block types, keys, migrations, metadata answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import text as tx
from lodestrand.operators import ingest, metrics
from lodestrand.plans.registry import Tables, query, same_sql
from lodestrand.plans.tables import _B, _blocks
from lodestrand.plans.texts import SQZ

same_sql("pages_of_a_key", "SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem} WHERE l_orderkey = 7 AND l_linenumber IN (1, 2, 3)", "lineitem")
same_sql("has_parsed_text", "SELECT source, bool_or(trim(coalesce(text, '')) <> '') AS parsed FROM {documents} GROUP BY source", "documents")
same_sql("status_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM {events} GROUP BY event_type", "events")
same_sql("reset_counts", "SELECT 'events' AS tbl, count(*) AS n FROM {events} UNION ALL SELECT 'conversations', count(*) FROM {conversations} UNION ALL SELECT 'embeddings', count(*) FROM {embeddings}", "events", "conversations", "embeddings")
same_sql("orphan_guard", "SELECT o_orderkey FROM {orders} LEFT ANTI JOIN {lineitem} ON l_orderkey = o_orderkey", "orders", "lineitem", duck="SELECT o_orderkey FROM {orders} ANTI JOIN {lineitem} ON l_orderkey = o_orderkey")
same_sql("reindex_operations", "SELECT doc_id AS id, 'REINDEX' AS action, 'pending' AS status, 0 AS attempts FROM {documents} WHERE text IS NOT NULL", "documents")
same_sql("element_left_details", "SELECT d.doc_id, l.quality, l.toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id", "documents", "labels")
same_sql("page_semi_filter", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 FROM {orders})", "lineitem", "orders")
same_sql("memory_filter", "SELECT event_id, user_id FROM {events} WHERE event_type IN ('click', 'purchase') AND value IS NOT NULL", "events")
same_sql("priority_queue", "SELECT user_id, event_type, seq, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, seq) AS place FROM (SELECT user_id, event_type, min(event_id) AS seq, max(CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END) AS priority FROM {events} GROUP BY user_id, event_type) q", "events")
same_sql("evidence_stats", "SELECT source, count(*) AS items, sum(length(coalesce(text, ''))) AS chars, max(length(coalesce(text, ''))) AS longest FROM {documents} GROUP BY source", "documents", duck="SELECT source, count(*) AS items, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, max(length(coalesce(text, ''))) AS longest FROM {documents} GROUP BY source")
same_sql("next_chunk_index", "SELECT conv_id, CASE WHEN coalesce(max(turn), 0) = 0 THEN 0 ELSE max(turn) + 1 END AS next_index FROM {conversations} GROUP BY conv_id", "conversations")
same_sql("user_turns", "SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS turns FROM {conversations} GROUP BY conv_id", "conversations", duck="SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS turns FROM {conversations} GROUP BY conv_id")
same_sql("run_completeness", "SELECT event_type, count(*) AS found, count(DISTINCT user_id) AS users, count(*) = count(DISTINCT event_id) AS keys_unique FROM {events} GROUP BY event_type", "events")
same_sql("label_sets_equal", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM {labels} EXCEPT SELECT doc_id FROM {documents})) = 0 AS all_known", "labels", "documents")
same_sql("event_pivot", "SELECT user_id, count(CASE WHEN event_type = 'view' THEN 1 END) AS views, count(CASE WHEN event_type = 'click' THEN 1 END) AS clicks, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM {events} GROUP BY user_id", "events")

_JSON = "'[[{{\"type\": \"title\", \"bbox\": [10, 20, 300, 40], \"content\": {{\"text\": \"' || coalesce(source, '') || '\", \"level\": ' || (doc_id % 3 + 1) || '}}}}, {{\"type\": \"page_number\", \"content\": {{\"text\": \"1\"}}}}], [{{\"type\": \"equation\", \"bbox\": [1, 2, 3, 4], \"content\": {{\"latex\": \"x^' || doc_id || '\"}}}}]]'".replace("{{", "{").replace("}}", "}")


def _parsed(t: Tables) -> DataFrame:
    """Parser output of two pages for each document, and malformed JSON for those of one source."""
    made = F.expr(_JSON)
    return t.documents.select("doc_id", F.when(F.col("source") == "src5", "{oops").otherwise(made).alias("content_list"))


@query("SELECT doc_id, 1 AS page, 0 AS ord, 'title' AS type, coalesce(source, '') AS text, CAST(doc_id % 3 + 1 AS INT) AS level, [0.01::DOUBLE, 0.02, 0.3, 0.04] AS bbox FROM documents WHERE source <> 'src5' UNION ALL SELECT doc_id, 2, 0, 'equation', 'x^' || doc_id, NULL, [0.001::DOUBLE, 0.002, 0.003, 0.004] FROM documents WHERE source <> 'src5'")
def parser_blocks(t: Tables) -> DataFrame:
    return ingest.content_blocks(_parsed(t))


@query("SELECT doc_id, 2 + CAST(doc_id % 2 AS INT) AS expected, CASE WHEN source = 'src5' THEN 0 ELSE 2 END AS found FROM documents WHERE source = 'src5' OR doc_id % 2 = 1")
def parser_page_faults(t: Tables) -> DataFrame:
    expected = t.documents.select("doc_id", (2 + F.col("doc_id") % 2).cast("int").alias("expected"))
    return ingest.page_count_faults(_parsed(t), expected)


_LINE = "CASE ord % 9 WHEN 0 THEN (ord + 1) || ' ' || substring(text, 1, 20) WHEN 1 THEN 'Figure ' || ord || ': ' || text WHEN 2 THEN 'Table IV ' || text WHEN 3 THEN 'Abstract ' || text WHEN 4 THEN '' || ord WHEN 5 THEN '- ' || text WHEN 6 THEN 'y = x (' || ord || ')' ELSE text END"
_T = SQZ.format(c="line")
_DEPTH_SQL = rf"(regexp_matches({_T}, '^[0-9]+(?:\.[0-9]+)*\.?\s+\S') OR regexp_matches({_T}, '^[IVXLCDM]+(?:\.[0-9]+)*\.?\s+\S'))"


@query(
    rf"""WITH {_B}, c AS (SELECT *, {_LINE} AS line, CASE WHEN page = 0 THEN 14.0 ELSE 10.0 END AS size FROM b)
    SELECT uid, CASE WHEN {_T} = '' THEN 'unknown' WHEN regexp_matches({_T}, '^[0-9]+$') THEN 'page_number' WHEN regexp_matches({_T}, '(?i)^(?:fig(?:ure)?\.?)\s*[0-9]+') THEN 'figure_caption'
    WHEN regexp_matches({_T}, '(?i)^table\s*(?:[0-9]+|[IVXLCDM]+)') THEN 'table_caption' WHEN ord >= 60 THEN 'reference' WHEN regexp_matches({_T}, '(?i)^abstract\b') THEN 'abstract' WHEN regexp_matches({_T}, '(?i)^key ?words\b') THEN 'keywords'
    WHEN page = 0 AND ord % 2 = 0 THEN 'title' WHEN {_DEPTH_SQL} AND length({_T}) <= 120 AND NOT regexp_matches({_T}, '[.;,]$') THEN 'heading'
    WHEN regexp_matches({_T}, '[=∑∫≤≥]') AND length({_T}) <= 200 AND regexp_matches({_T}, '\([0-9]+\)$') THEN 'equation' WHEN regexp_matches({_T}, '^[•\-*]\s') THEN 'list_item' ELSE 'paragraph' END AS type FROM c"""
)
def block_types(t: Tables) -> DataFrame:
    b = _blocks(t).withColumn("line", F.expr(_LINE))
    first = (F.col("page") == 0) & (F.col("ord") % 2 == 0)
    kind = ingest.block_type(F.col("line"), F.col("ord") >= 60, F.lit(14.0), F.lit(10.0), first)
    return b.select("uid", kind["type"].alias("type"))


@query(f"WITH {_B}, h AS (SELECT *, CASE WHEN ord = 5 AND doc_id % 2 = 0 THEN 'References' ELSE text END AS line FROM b) SELECT uid, max(CASE WHEN lower({_T}) IN ('references', 'bibliography', '参考文献') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) = 1 AS in_references FROM h")
def reference_mode(t: Tables) -> DataFrame:
    b = _blocks(t).withColumn("text", F.when((F.col("ord") == 5) & (F.col("doc_id") % 2 == 0), "References").otherwise(F.col("text")))
    return ingest.in_references(b).select("uid", "in_references")


@query(f"WITH {_B} SELECT uid, y0 - lag(y1) OVER w AS gap_before, lead(y0) OVER w - y1 AS gap_after FROM b WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, uid)")
def block_gaps(t: Tables) -> DataFrame:
    return ingest.vertical_gaps(_blocks(t), "doc_id", "page").select("uid", "gap_before", "gap_after")


@query()
def row_clusters(t: Tables) -> DataFrame:
    w = _blocks(t).select(F.col("doc_id").alias("page"), F.col("ord").alias("word_id"), (F.col("y0") + F.col("ord") % 5).alias("y"))
    return ingest.row_clusters(w, 2.5)


@query("SELECT o_custkey, o_orderkey, h AS header, CASE WHEN n = 1 THEN h ELSE h || '_' || n END AS unique_header FROM (SELECT o_custkey, o_orderkey, h, row_number() OVER (PARTITION BY o_custkey, h ORDER BY o_orderkey) AS n FROM (SELECT o_custkey, o_orderkey, 'c' || (o_orderkey % 3) AS h FROM orders))")
def numbered_headers(t: Tables) -> DataFrame:
    c = t.orders.select("o_custkey", "o_orderkey", F.concat(F.lit("c"), (F.col("o_orderkey") % 3).cast("string")).alias("header"))
    return ingest.numbered_headers(c, "o_custkey", order="o_orderkey")


@query("SELECT c_custkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_custkey || ' | ' || replace(c_name || '|x', '|', '\\|') || ' |' AS table_text FROM customer")
def markdown_tables(t: Tables) -> DataFrame:
    rows = F.array(F.array(F.col("c_custkey").cast("string"), F.concat("c_name", F.lit("|x"))))
    return t.customer.select("c_custkey", ingest.markdown_table(F.array(F.lit("key"), F.lit("name")), rows).alias("table_text"))


@query("SELECT doc_id, CASE WHEN lang <> 'en' THEN 'This passage comes from the ' || lang || ' section of ' || source || '.' ELSE 'This passage comes from ' || source || '.' END AS context, source || CASE WHEN lang <> 'en' THEN chr(10) || lang ELSE '' END AS embedding_text FROM documents")
def chunk_contexts(t: Tables) -> DataFrame:
    section = F.when(F.col("lang") != "en", F.col("lang")).otherwise("")
    return t.documents.select("doc_id", ingest.chunk_context(F.col("source"), section, F.lit(None).cast("string")).alias("context"), ingest.embedding_text(F.col("source"), section, F.lit("  ")).alias("embedding_text"))


@query(r"SELECT doc_id, len(list_filter(regexp_extract_all(p, '\b[0-9]+(?:\.[0-9]+)?\b'), lambda x: NOT list_contains(regexp_extract_all(s, '\b[0-9]+(?:\.[0-9]+)?\b'), x))) = 0 AND len(regexp_extract_all(p, '[.!?](?:\s|$)')) <= 2 AND list_has_any(regexp_extract_all(lower(p), '[a-z]{4,}'), regexp_extract_all(lower(s), '[a-z]{4,}')) AS grounded FROM (SELECT doc_id, 'About ' || coalesce(source, '') || ' and 4 things. ' || coalesce(lang, '') AS p, coalesce(text, '') || ' ' || coalesce(source, '') AS s FROM documents)")
def grounded_prefixes(t: Tables) -> DataFrame:
    p = F.concat(F.lit("About "), F.coalesce("source", F.lit("")), F.lit(" and 4 things. "), F.coalesce("lang", F.lit("")))
    return t.documents.select("doc_id", ingest.grounded(p, F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))).alias("grounded"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS id FROM orders")
def surrogate_keys(t: Tables) -> DataFrame:
    return ingest.surrogate_keys(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey").select("o_orderkey", "id")


@query("SELECT page_id, CASE WHEN url LIKE 'https://%' THEN 'store/' || substring(url, 9) ELSE url END AS path FROM pages")
def asset_paths(t: Tables) -> DataFrame:
    m = ingest.moved_assets(F.create_map(F.lit("path"), F.col("url")), "https://", "store/")
    return t.pages.select("page_id", m["path"].alias("path"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN trim(coalesce(text, '')) END AS goal, CASE WHEN role = 'user' THEN 'open ' || turn END AS next_step FROM conversations".replace("trim(coalesce(text, ''))", r"regexp_replace(regexp_replace(coalesce(text, ''), '\n## ', ' ', 'g'), '^\s+|\s+$', '', 'g')"))
def summary_parse(t: Tables) -> DataFrame:
    """Summaries with both headings are parsed; others are rejected whole."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), "\n## ", " ")
    body = F.when(F.col("role") == "user", F.concat(F.lit("## Goal\n"), clean, F.lit("\n## Next\nopen "), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("## Goal\n"), clean))
    m = ingest.summary_sections(body, ("Goal", "Next"))
    return t.conversations.select("conv_id", "turn", m["Goal"].alias("goal"), m["Next"].alias("next_step"))


@query("SELECT source, count(*) AS pages, bool_and(trim(coalesce(text, '')) <> '') AS complete, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (n <= 3) AS first_ids FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) GROUP BY source")
def inspection(t: Tables) -> DataFrame:
    coded = t.documents.select(F.col("source").alias("code"), F.col("doc_id").alias("case_id"))
    first = metrics.failures(coded).select(F.col("code").alias("source"), F.col("n").alias("pages"), F.col("examples").alias("first_ids"))
    whole = t.documents.groupBy("source").agg(F.bool_and(F.trim(F.coalesce("text", F.lit(""))) != "").alias("complete"))
    return first.join(whole, "source")


@query()
def offline_answers(t: Tables) -> DataFrame:
    """An extractive answer to each item, where no answering model is at hand."""
    from lodestrand.operators import fusion
    from lodestrand.plans.retrieval import bm25_ranking

    ranked = fusion.late_rows(bm25_ranking(t), t.documents.select("doc_id", "text"))
    return ingest.offline_answer(ranked, t.benchmark.select(F.col("item_id").alias("query_id")))


@query("SELECT conv_id, string_agg(s, ' ' ORDER BY turn) AS joined FROM (SELECT conv_id, turn, " + SQZ.format(c="text") + " AS s FROM conversations) GROUP BY conv_id")
def page_concat(t: Tables) -> DataFrame:
    s = t.conversations.select("conv_id", "turn", tx.squeeze(F.col("text")).alias("s"))
    return s.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]), " ").alias("joined"))
