"""Research loop queries: plans, actions, judgements, ledgers, answers. Conversations stand for sessions, events for calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import text as tx
from lodestrand.operators import agent
from lodestrand.plans.registry import Tables, query
from lodestrand.plans.texts import SQZ, _q

FP = "lower(" + SQZ.format(c="{c}") + ")"


def _both(sql: str) -> tuple[str, str]:
    """SQL of a view for Spark and for DuckDB: [[a, b]] is an array, {table} a table."""
    duck = sql.replace("[[", "[").replace("]]", "]")
    for name in ("conversations", "events", "documents", "benchmark"):
        duck = duck.replace("{" + name + "}", name)
    return sql.replace("[[", "array(").replace("]]", ")"), duck


def _view(t: Tables, sql: str) -> DataFrame:
    used = [n for n in ("conversations", "events", "documents", "benchmark") if "{" + n + "}" in sql]
    return t.spark.sql(sql, **{n: getattr(t, n) for n in used})


_ACTIONS, A = _both(
    """SELECT conv_id AS plan_id, turn AS ord, CASE WHEN turn % 5 = 4 THEN 'B' ELSE 'A' END || CAST(turn % 6 AS STRING) AS action_id,
    CASE role WHEN 'user' THEN 'hybrid_search' WHEN 'assistant' THEN 'get_chunk_neighbors' ELSE 'search_arxiv' END AS tool,
    CASE WHEN role = 'assistant' THEN NULL WHEN length(coalesce(text, '')) < 60 THEN ' ' ELSE text END AS query,
    CASE WHEN role = 'assistant' AND length(coalesce(text, '')) % 2 = 0 THEN length(text) END AS chunk_id, CAST(turn AS BIGINT) AS document_id,
    [['C' || CAST(turn % 3 + 1 AS STRING), 'C' || CAST(length(coalesce(text, '')) % 4 + 1 AS STRING)]] AS claim_ids FROM {conversations}"""
)
_CLAIMS, C = _both("SELECT conv_id AS plan_id, 'C' || CAST(turn % 4 + 1 AS STRING) AS claim_id, CASE length(coalesce(text, '')) % 4 WHEN 0 THEN 'covered' WHEN 1 THEN 'missing' WHEN 2 THEN 'partial' ELSE 'conflicted' END AS status, turn % 2 = 0 AS required FROM {conversations} WHERE turn < 4")
_DECISIONS, D = _both(
    """SELECT conv_id AS pool_id, turn AS ord, CASE length(coalesce(text, '')) % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'drop' WHEN 2 THEN 'merge' WHEN 3 THEN 'conflict' ELSE 'guess' END AS action,
    CASE WHEN role = 'system' THEN slice([['s0']], 1, 0) ELSE [['s' || CAST(turn AS STRING), 's' || CAST(length(coalesce(text, '')) % 9 AS STRING)]] END AS sources,
    CASE WHEN length(coalesce(text, '')) % 3 = 0 THEN 'E' || CAST(turn AS STRING) END AS target, CASE WHEN role = 'user' THEN text ELSE ' ' END AS statement,
    [['C' || CAST(turn % 3 + 1 AS STRING), 'C' || CAST(length(coalesce(text, '')) % 6 + 1 AS STRING)]] AS claims, CAST(length(coalesce(text, '')) AS DOUBLE) / 400 AS confidence, CASE WHEN turn % 4 = 3 THEN '' ELSE role END AS reason FROM {conversations}"""
)
D = D.replace("slice(['s0'], 1, 0)", "CAST([] AS VARCHAR[])")


def _reasons(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + "], lambda x: x IS NOT NULL)"


_DUCK_STR = {"STRING": "VARCHAR"}
A, C, D = (x.replace("AS STRING)", "AS VARCHAR)") for x in (A, C, D))


@query(f"SELECT conv_id, turn, {FP.format(c='text')} AS fingerprint FROM conversations WHERE text IS NOT NULL")
def query_fingerprints(t: Tables) -> DataFrame:
    return t.conversations.where("text IS NOT NULL").select("conv_id", "turn", agent.fingerprint(F.col("text")).alias("fingerprint"))


_FIRST = "list_filter({l}, lambda x, i: x <> '' AND list_position(list_transform({l}, lambda y: lower(y)), lower(x)) = i)"
_WORDS = "string_split(" + SQZ.format(c="text") + ", ' ')"
_SENT = r"list_filter(list_transform(string_split(regexp_replace(" + SQZ.format(c="text") + r", '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: substring(trim(x), 1, 1000)), lambda x: x <> '')"


@query(
    f"""WITH p AS (SELECT item_id, substring({SQZ.format(c='text')}, 1, 1000) AS one, list_transform({_WORDS}, lambda x: substring(x, 1, 120)) AS words, [substring({SQZ.format(c='text')}, 1, 1000)] || {_SENT} AS all_ FROM benchmark)
    SELECT item_id AS query_id, one AS standalone_query, ({_FIRST.format(l='words')})[1:8] AS lexical_terms, ({_FIRST.format(l='list_reverse(words)')})[1:8] AS synonyms, ({_FIRST.format(l='all_')})[1:3] AS semantic_queries FROM p WHERE one <> ''"""
)
def clean_plans(t: Tables) -> DataFrame:
    """Words of each question as raw terms with repeats, its sentences as raw semantic queries."""
    words = F.split(tx.squeeze(F.col("text")), " ")
    sentences = F.split(F.regexp_replace(tx.squeeze(F.col("text")), "([.!?]) ", "$1\x01"), "\x01")
    raw = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("standalone"), words.alias("lexical"), F.reverse(words).alias("synonyms"), sentences.alias("semantic"))
    return agent.clean_plan(raw)


@query(
    "SELECT plan_id, ord, " + _reasons(
        ("NOT regexp_matches(action_id, '^A[1-9][0-9]*$')", "bad_action_id"), ("len(claim_ids) < 1 OR len(claim_ids) > 8", "claim_count"), ("len(list_distinct(claim_ids)) <> len(claim_ids)", "repeated_claim"),
        ("false", "unknown_tool"), ("tool = 'search_arxiv'", "tool_disabled"), (f"tool IN ('hybrid_search', 'search_arxiv') AND {SQZ.format(c='query')} = ''", "query_required"), ("tool = 'get_chunk_neighbors' AND chunk_id IS NULL", "chunk_required"),
    ) + f" AS faults FROM ({A})"
)
def action_faults(t: Tables) -> DataFrame:
    return agent.action_faults(_view(t, _ACTIONS))


_QFP = FP.format(c="query")


@query(
    f"""WITH a AS ({A}), c AS ({C}), i AS (SELECT plan_id, count(*) AS n, count(DISTINCT action_id) AS d FROM a GROUP BY 1), k AS (SELECT plan_id, count(*) AS n, count(DISTINCT claim_id) AS d FROM c GROUP BY 1),
    q AS (SELECT plan_id, count(*) AS n, count(DISTINCT {_QFP}) AS d FROM a WHERE query IS NOT NULL GROUP BY 1)
    SELECT plan_id, 'duplicate_action_id' AS fault FROM i WHERE n <> d UNION ALL SELECT plan_id, 'action_limit' FROM i WHERE n > 5 UNION ALL SELECT plan_id, 'duplicate_claim_id' FROM k WHERE n <> d UNION ALL SELECT plan_id, 'claim_limit' FROM k WHERE n > 8
    UNION ALL SELECT plan_id, 'duplicate_query' FROM q WHERE n <> d
    UNION ALL SELECT DISTINCT plan_id, 'unknown_claim' FROM (SELECT plan_id, unnest(claim_ids) AS claim_id FROM a) u ANTI JOIN c USING (plan_id, claim_id)"""
)
def plan_faults(t: Tables) -> DataFrame:
    return agent.plan_faults(_view(t, _ACTIONS), _view(t, _CLAIMS))


@query(f"SELECT plan_id, ord, tool, CASE WHEN plan_id % 2 = 0 AND tool IN ('hybrid_search', 'inspect_document') THEN plan_id ELSE document_id END AS document_id FROM ({A})")
def scoped_actions(t: Tables) -> DataFrame:
    """Every second session is bound to one document."""
    a = _view(t, _ACTIONS)
    scopes = a.where("plan_id % 2 = 0").select("plan_id", F.col("plan_id").alias("scope")).distinct()
    return agent.scoped(a, scopes).select("plan_id", "ord", "tool", "document_id")


@query(
    f"""WITH a AS (SELECT * FROM ({A}) WHERE ord >= 2), c AS ({C}), o AS (SELECT plan_id, list(DISTINCT claim_id) AS open FROM c WHERE status <> 'covered' GROUP BY 1),
    t AS (SELECT DISTINCT plan_id, {_QFP} AS fp, true AS tried FROM ({A}) WHERE ord < 2 AND query IS NOT NULL),
    j AS (SELECT a.plan_id, claim_ids, open, CASE WHEN query IS NOT NULL THEN {_QFP} END AS f FROM a LEFT JOIN o USING (plan_id)),
    b AS (SELECT j.plan_id, count(*) > 4 AS over_, bool_or(NOT list_has_all(coalesce(open, []), claim_ids)) AS covered, bool_or(coalesce(tried, false)) OR count(f) <> count(DISTINCT f) AS repeated FROM j LEFT JOIN t ON t.plan_id = j.plan_id AND t.fp = j.f GROUP BY 1)
    SELECT plan_id, CASE WHEN over_ THEN 'tool_budget_exceeded' WHEN covered THEN 'covered_claim_target' WHEN repeated THEN 'duplicate_query' END AS fault FROM b"""
)
def followup_faults(t: Tables) -> DataFrame:
    """Turns from the third on are follow-up actions, with four calls left."""
    a = _view(t, _ACTIONS)
    return agent.followup_faults(a.where("ord >= 2"), _view(t, _CLAIMS), a.where("ord < 2 AND query IS NOT NULL"), F.lit(4))


@query(
    "SELECT pool_id, ord, " + _reasons(
        ("action = 'guess'", "unknown_action"), ("len(sources) = 0", "no_source"), ("action IN ('merge', 'conflict') AND target IS NULL", "target_required"),
        ("action IN ('keep', 'conflict') AND trim(coalesce(statement, '')) = ''", "statement_required"), ("action <> 'drop' AND len(claims) = 0", "claims_required"), ("len(list_distinct(claims)) <> len(claims)", "repeated_claim"),
        ("NOT confidence BETWEEN 0 AND 1", "confidence_range"), ("trim(reason) = ''", "reason_required"),
    ) + f" AS faults FROM ({D})"
)
def decision_faults(t: Tables) -> DataFrame:
    return agent.decision_faults(_view(t, _DECISIONS))


@query(
    f"""WITH d AS ({D}), c AS (SELECT plan_id AS pool_id, * EXCLUDE (plan_id) FROM ({C})), s AS (SELECT DISTINCT pool_id, claim_id, status FROM c WHERE claim_id <> 'C2'),
    x AS (SELECT pool_id, 'incomplete_claim_assessment' AS fault FROM c WHERE claim_id = 'C2'
      UNION ALL SELECT pool_id, 'unknown_source_ref' FROM (SELECT pool_id, unnest(sources) AS source_id FROM d) WHERE source_id NOT IN ('s0', 's1', 's2', 's3', 's4', 's5')
      UNION ALL SELECT pool_id, 'unknown_claim_id' FROM (SELECT pool_id, unnest(claims) AS claim_id FROM d) u ANTI JOIN c USING (pool_id, claim_id)
      UNION ALL SELECT pool_id, 'unknown_target_evidence_id' FROM d WHERE target IS NOT NULL AND target NOT IN ('E0', 'E1')
      UNION ALL SELECT pool_id, 'false_sufficiency' FROM c ANTI JOIN (SELECT pool_id, claim_id FROM s WHERE status = 'covered') USING (pool_id, claim_id) WHERE required AND pool_id % 2 = 1)
    SELECT DISTINCT pool_id, fault FROM x"""
)
def judge_faults(t: Tables) -> DataFrame:
    """Sources s0 to s5 were shown and E0 and E1 exist; claim C2 is never assessed; odd pools claim to be sufficient."""
    claims = _view(t, _CLAIMS).withColumnRenamed("plan_id", "pool_id")
    pools = t.conversations.select(F.col("conv_id").alias("pool_id")).distinct()
    allowed = pools.select("pool_id", F.explode(F.array(*(F.lit(f"s{i}") for i in range(6)))).alias("source_id"))
    evidence = pools.select("pool_id", F.explode(F.array(F.lit("E0"), F.lit("E1"))).alias("evidence_id"))
    verdicts = pools.select("pool_id", (F.col("pool_id") % 2 == 1).alias("sufficient"))
    return agent.judge_faults(_view(t, _DECISIONS), claims, evidence, allowed, claims.where("claim_id <> 'C2'").select("pool_id", "claim_id", "status"), verdicts)


_SEARCHES, S = _both("SELECT user_id AS session_id, event_id AS ord, event_type || CAST(event_id % 3 AS STRING) AS task_id, CASE WHEN event_id % 17 = 0 THEN '  ' ELSE 'Query  ' || CAST(event_id % 7 AS STRING) END AS query FROM {events}")
S = S.replace("AS STRING)", "AS VARCHAR)")


@query(
    f"""WITH s AS (SELECT *, CASE WHEN {_QFP} <> '' THEN {_QFP} END AS fp FROM ({S})),
    m AS (SELECT *, min(ord) OVER (PARTITION BY session_id, task_id) AS t0, CASE WHEN fp IS NOT NULL THEN min(ord) OVER (PARTITION BY session_id, task_id, fp) END AS q0 FROM s),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY t0) AS task_no, dense_rank() OVER (PARTITION BY session_id, task_id ORDER BY q0 NULLS LAST) AS query_no FROM m)
    SELECT session_id, ord, task_id, CASE WHEN task_no > 8 THEN 'task_limit_exceeded' WHEN fp IS NULL THEN 'invalid_task_query' WHEN query_no > 5 THEN 'task_query_limit_exceeded' WHEN ord > q0 THEN 'duplicate_task_query' END AS fault FROM r"""
)
def task_board(t: Tables) -> DataFrame:
    return agent.task_board(_view(t, _SEARCHES))


@query(f"WITH f AS (SELECT session_id, task_id, ord % 50 AS chunk_id, min(ord) AS o FROM ({S}) GROUP BY ALL) SELECT session_id, task_id, chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY session_id, task_id ORDER BY o, chunk_id) AS place FROM f) WHERE place <= 5")
def task_chunks(t: Tables) -> DataFrame:
    """The first five different chunks bound to each task."""
    return agent.bounded_unique(_view(t, _SEARCHES).withColumn("chunk_id", F.col("ord") % 50), "chunk_id", 5, "session_id", "task_id")


@query()
def unique_sources(t: Tables) -> DataFrame:
    """Page visits as sources: a URL by kind and hour, a PDF by kind and key; a source that shares either with one taken before goes."""
    e = t.events.where("event_type IN ('view', 'click')")
    return agent.unique_sources(e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), F.concat("event_type", F.lit("/"), F.hour("ts").cast("string")).alias("entry_url"), F.when(F.col("event_id") % 3 > 0, F.get_json_object("props", "$.k")).alias("pdf_url")))


_ROUNDS = "SELECT conv_id AS session_id, turn AS round, CAST(sum(CASE WHEN length(coalesce(text, '')) % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sources, turn >= 5 AND length(coalesce(text, '')) % 2 = 0 AS sufficient, length(coalesce(text, '')) % 3 AS calls FROM {conversations}"
_R = _ROUNDS.replace("{conversations}", "conversations")


@query(f"WITH r AS (SELECT *, CASE WHEN sources = coalesce(lag(sources) OVER w, 0) THEN 1 ELSE 0 END AS same, row_number() OVER w AS n FROM ({_R}) WINDOW w AS (PARTITION BY session_id ORDER BY round)), u AS (SELECT *, sum(same) OVER (PARTITION BY session_id ORDER BY round ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS run FROM r) SELECT session_id, min(CASE WHEN run = 2 AND n >= 2 THEN round END) AS stalled_round FROM u GROUP BY session_id")
def stalled_rounds(t: Tables) -> DataFrame:
    return agent.no_progress(_view(t, _ROUNDS).select("session_id", "round", "sources"))


@query(
    f"""WITH r AS (SELECT *, CASE WHEN sources = coalesce(lag(sources) OVER w, 0) THEN 1 ELSE 0 END AS still, sum(calls) OVER (w ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER w AS n FROM ({_R}) WINDOW w AS (PARTITION BY session_id ORDER BY round)),
    u AS (SELECT *, sum(still) OVER (PARTITION BY session_id ORDER BY round ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AND n > 1 AS stuck FROM r),
    z AS (SELECT session_id, round, CASE WHEN sufficient THEN 'completed' WHEN stuck THEN 'stalled' WHEN round >= 3 OR used >= 5 THEN 'limit' END AS status FROM u)
    SELECT session_id, coalesce(min(CASE WHEN status IS NOT NULL THEN round END), max(round)) AS rounds, coalesce(arg_min(status, CASE WHEN status IS NOT NULL THEN round END), 'open') AS status FROM z GROUP BY session_id"""
)
def research_status(t: Tables) -> DataFrame:
    return agent.research_status(_view(t, _ROUNDS))


@query("WITH b AS (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY ALL), a AS (SELECT l_orderkey, CASE WHEN l_quantity > 45 THEN -l_partkey ELSE l_partkey END AS l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 3 GROUP BY ALL) SELECT l_orderkey, count(*) FILTER (a.n IS NULL) AS missing, count(*) FILTER (b.l_partkey IS NULL) AS added, count(*) FILTER (a.n > 1) AS repeated FROM b FULL JOIN a USING (l_orderkey, l_partkey) GROUP BY l_orderkey")
def rerank_invariance(t: Tables) -> DataFrame:
    """Lists that lose small quantities and rename large ones."""
    before = t.lineitem.select("l_orderkey", "l_partkey")
    after = t.lineitem.where("l_quantity > 3").select("l_orderkey", F.when(F.col("l_quantity") > 45, -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("l_partkey"))
    return agent.same_ids(before, after, "l_partkey", "l_orderkey")


@query(f"SELECT pool_id, count(*) FILTER (action = 'keep') AS keep, count(*) FILTER (action = 'drop') AS drop, count(*) FILTER (action = 'merge') AS merge, count(*) FILTER (action = 'conflict') AS conflict, CAST(sum(CASE WHEN action <> 'drop' THEN len(sources) ELSE 0 END) AS BIGINT) AS active_sources FROM ({D}) GROUP BY pool_id")
def decision_counts(t: Tables) -> DataFrame:
    return agent.decision_counts(_view(t, _DECISIONS))


@query(
    f"""WITH e AS (SELECT pool_id AS session_id, 'E' || ord AS evidence_id, ord, unnest(sources) AS source_id, generate_subscripts(sources, 1) - 1 AS i FROM ({D})),
    f AS (SELECT session_id, source_id, min({{'ord': ord, 'i': i, 'evidence_id': evidence_id}}) AS f FROM e WHERE source_id <> 's3' GROUP BY ALL)
    SELECT session_id, source_id, f.evidence_id AS evidence_id, row_number() OVER (PARTITION BY session_id ORDER BY f.ord, f.i) AS place FROM f"""
)
def selected_sources(t: Tables) -> DataFrame:
    """The ledger holds every source but s3."""
    d = _view(t, _DECISIONS).withColumnRenamed("pool_id", "session_id").withColumn("evidence_id", F.concat(F.lit("E"), F.col("ord").cast("string")))
    ledger = d.select("session_id", F.explode("sources").alias("source_id")).where("source_id <> 's3'")
    return agent.selected_sources(d, ledger)


@query(f"WITH d AS ({D}), p AS (SELECT pool_id, list(DISTINCT 'E' || ord) AS packed FROM d WHERE ord % 2 = 0 GROUP BY 1), c AS (SELECT pool_id, 'C' || (ord % 3) AS claim_id, list('E' || ord ORDER BY ord) AS ids FROM d GROUP BY ALL) SELECT pool_id, claim_id, list_filter(ids, lambda x: list_contains(coalesce(packed, []), x)) AS evidence_ids FROM c LEFT JOIN p USING (pool_id)")
def synced_claims(t: Tables) -> DataFrame:
    """Evidence of odd turns was dropped from the pack."""
    d = _view(t, _DECISIONS).withColumn("evidence_id", F.concat(F.lit("E"), F.col("ord").cast("string")))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("ord", "evidence_id"))), lambda x: x["evidence_id"])
    claims = d.groupBy("pool_id", F.concat(F.lit("C"), (F.col("ord") % 3).cast("string")).alias("claim_id")).agg(ids.alias("evidence_ids"))
    return agent.synced_claims(claims, d.where("ord % 2 = 0"))


@query("SELECT url, max(page_id) AS source_id FROM (SELECT page_id, url FROM pages WHERE url IS NOT NULL UNION ALL SELECT page_id, split_part(url, '?', 1) || '.pdf' FROM pages WHERE url IS NOT NULL) GROUP BY url")
def source_aliases(t: Tables) -> DataFrame:
    """Each page under its URL and that of its PDF."""
    s = t.pages.where("url IS NOT NULL").select(F.col("page_id").alias("source_id"), "url", F.concat(F.substring_index("url", "?", 1), F.lit(".pdf")).alias("pdf_url"))
    return agent.source_aliases(s)


@query(
    """WITH n AS (SELECT user_id AS query_id, count(CASE WHEN event_type = 'view' THEN 1 END) AS bm25, count(CASE WHEN event_type = 'click' THEN 1 END) AS vector, count(*) AS n,
      list_sort(list_filter([CASE WHEN bool_or(event_type = 'error' AND value > 200) THEN 'vector' END, CASE WHEN bool_or(event_type = 'error' AND value < 20) THEN 'bm25' END], lambda x: x IS NOT NULL)) AS lost FROM events GROUP BY 1)
    SELECT query_id, 'bm25_retrieval' AS type, bm25 AS candidates, list_contains(lost, 'bm25') AS degraded FROM n UNION ALL SELECT query_id, 'vector_retrieval', vector, list_contains(lost, 'vector') FROM n
    UNION ALL SELECT query_id, 'retrieval_fusion', n, len(lost) > 0 FROM n UNION ALL SELECT query_id, 'retrieval_degraded', len(lost), true FROM n WHERE len(lost) > 0"""
)
def retrieval_traces(t: Tables) -> DataFrame:
    """Views and clicks as the hits of either channel, extreme errors as its failures."""
    is_ = lambda k: F.when(F.col("event_type") == k, F.lit(1))
    ranked = t.events.select(F.col("user_id").alias("query_id"), is_("view").alias("bm25_rank"), is_("click").alias("vector_rank"))
    lost = t.events.where("event_type = 'error'").select(F.col("user_id").alias("query_id"), F.when(F.col("value") > 200, "vector").when(F.col("value") < 20, "bm25").alias("channel")).where("channel IS NOT NULL")
    return agent.retrieval_traces(ranked, lost)


@query(
    """WITH e AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord, CASE WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'signup' THEN '-1' ELSE CAST(value AS VARCHAR) END AS score, json_extract_string(props, '$.k') AS chunk_id FROM events),
    k AS (SELECT query_id, ord + 1 AS fusion_rank, coalesce(try_cast(chunk_id AS BIGINT), ord + 1) AS chunk_id, try_cast(score AS DOUBLE) AS score FROM e WHERE try_cast(score AS DOUBLE) > 0)
    SELECT query_id, fusion_rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_rank) AS n FROM k) WHERE n <= 5"""
)
def legacy_hits(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    score = F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") == "signup", "-1").otherwise(F.col("value").cast("string"))
    return agent.legacy_hits(t.events.select(F.col("user_id").alias("query_id"), place.alias("ord"), score.alias("score"), F.get_json_object("props", "$.k").alias("chunk_id")))


@query(f"WITH s AS (SELECT page_id % 20 AS session_id, page_id AS ord, url FROM pages WHERE url IS NOT NULL UNION ALL SELECT page_id % 20, page_id + 100000, url || CASE WHEN page_id % 2 = 0 THEN '&token=x' ELSE '' END FROM pages WHERE url IS NOT NULL), f AS (SELECT session_id, url, min(ord) AS ord FROM s WHERE NOT regexp_matches(url, '{_q(tx.SECRET_URL_PATTERN)}') GROUP BY ALL) SELECT session_id, ord, url FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS n FROM f) WHERE n <= 8")
def answer_sources(t: Tables) -> DataFrame:
    """Pages as a session's sources, each twice, once with a secret."""
    p = t.pages.where("url IS NOT NULL")
    s = p.select((F.col("page_id") % 20).alias("session_id"), F.col("page_id").alias("ord"), "url")
    again = p.select((F.col("page_id") % 20).alias("session_id"), (F.col("page_id") + 100000).alias("ord"), F.concat("url", F.when(F.col("page_id") % 2 == 0, "&token=x").otherwise("")).alias("url"))
    return agent.answer_sources(s.unionByName(again))


_CITE = """CASE WHEN event_type = 'error' THEN '{bad' WHEN event_type = 'signup' THEN '{"other": 1}' ELSE concat('{"local": [{"document_id": ', %s, ', "title": "', event_type, '", "page_number": ', CAST(event_id %% 5 AS STRING), ', "chunk_index": 0}, {"document_id": ', %s, '}]}') END"""


@query("SELECT user_id AS session_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS document_id, event_id % 5 AS page_number, CAST(0 AS BIGINT) AS chunk_index, arg_max(event_type, event_id) AS title FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY ALL")
def cited_documents(t: Tables) -> DataFrame:
    """Citations as the JSON of messages, some of it malformed, each with an entry that lacks fields."""
    k = "get_json_object(props, '$.k')"
    return agent.cited_documents(t.events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), F.expr(_CITE % (k, k)).alias("citations")))


@query(f"WITH p AS (SELECT conv_id AS answer_id, coalesce(list({SQZ.format(c='text')} ORDER BY turn) FILTER (role = 'assistant'), []) AS s, bool_or(role = 'system') AS failed FROM conversations GROUP BY 1) SELECT answer_id, CASE WHEN len(s) = 0 THEN 'insufficient' WHEN failed THEN 'verification_failed' ELSE 'unverified' END AS status, CASE WHEN len(s) = 0 THEN 'Evidence is insufficient.' WHEN failed THEN 'Evidence could not be verified. ' || array_to_string(s, ' ') ELSE 'No consistent answer. ' || array_to_string(s, ' ') END AS answer FROM p")
def conservative_answers(t: Tables) -> DataFrame:
    said = F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", tx.squeeze(F.col("text")).alias("s"))))), lambda x: x["s"])
    return agent.conservative(t.conversations.groupBy(F.col("conv_id").alias("answer_id")).agg(said.alias("statements"), F.bool_or(F.col("role") == "system").alias("failed")))


@query(
    f"""WITH d AS (SELECT conv_id AS answer_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS attempt, {SQZ.format(c='text')} AS answer, length(coalesce(text, '')) % 2 = 1 AS bad FROM conversations WHERE role = 'assistant'),
    g AS (SELECT answer_id, min(CASE WHEN NOT bad THEN attempt END) AS good, arg_min(CASE WHEN NOT bad THEN answer END, CASE WHEN NOT bad THEN attempt END) AS answer, max(attempt) AS attempts FROM d WHERE attempt <= 2 GROUP BY 1)
    SELECT answer_id, coalesce(good, attempts) AS attempts, CASE WHEN good IS NULL THEN 'conservative' WHEN good = 1 THEN 'verified' ELSE 'repaired' END AS outcome, coalesce(answer, 'none') AS answer FROM g"""
)
def settled_answers(t: Tables) -> DataFrame:
    """An assistant's turns as attempts; those of odd length are faulty."""
    from pyspark.sql import Window

    a = t.conversations.where("role = 'assistant'")
    attempt = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    faults = F.when(F.length(F.coalesce("text", F.lit(""))) % 2 == 1, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>"))
    return agent.settle_answers(a.select(F.col("conv_id").alias("answer_id"), attempt.alias("attempt"), tx.squeeze(F.col("text")).alias("answer"), faults.alias("faults"), F.lit("none").alias("fallback")))


_SUG = "CASE event_type WHEN 'view' THEN 'ADD' WHEN 'click' THEN 'UPDATE' WHEN 'purchase' THEN 'MERGE' WHEN 'signup' THEN 'IGNORE' ELSE 'WIPE' END"


@query(
    f"WITH s AS (SELECT event_id AS suggestion_id, {_SUG} AS action, CASE WHEN event_id % 3 = 0 THEN event_id END AS target_id, CASE WHEN value > 100 THEN repeat(props, CAST(event_id % 200 AS INT)) END AS merged, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE event_type END AS reason FROM events) SELECT suggestion_id, "
    + _reasons(("action = 'WIPE'", "unknown_action"), ("action IN ('UPDATE', 'MERGE', 'SUPERSEDE') AND target_id IS NULL", "target_required"), ("action = 'ADD' AND target_id IS NOT NULL", "add_cannot_target"), ("(action = 'MERGE') <> (merged IS NOT NULL)", "merged_content_only_for_merge"), ("trim(reason) = ''", "reason_required"), ("length(merged) > 1000", "merged_too_long"))
    + " AS faults FROM s"
)
def suggestion_faults(t: Tables) -> DataFrame:
    s = t.events.select(
        F.col("event_id").alias("suggestion_id"), F.expr(_SUG).alias("action"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("target_id"),
        F.when(F.col("value") > 100, F.expr("repeat(props, cast(event_id % 200 as int))")).alias("merged"), F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.col("event_type")).alias("reason"),
    )
    return agent.suggestion_faults(s)


@query(
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events), a AS (SELECT user_id, event_type, round(value, 0) AS v FROM o WHERE n = 1), b AS (SELECT user_id, event_type, round(value, 0) AS v FROM o WHERE n = 2)
    SELECT user_id AS session_id FROM a FULL JOIN b USING (user_id) WHERE coalesce(a.event_type, '') <> coalesce(b.event_type, '') OR coalesce(CAST(a.v > 100 AS VARCHAR), '') <> coalesce(CAST(b.v > 100 AS VARCHAR), '')"""
)
def changed_snapshots(t: Tables) -> DataFrame:
    """The last two events of each user as snapshots; the value's exact amount is not in the projection."""
    from pyspark.sql import Window

    o = t.events.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))))
    of = lambda n: o.where(F.col("n") == n).select(F.col("user_id").alias("session_id"), F.col("event_type").alias("kind"), (F.round("value", 0) > 100).cast("string").alias("large"))
    return agent.changed_snapshots(of(2), of(1), "kind", "large")


_KIND = "CASE event_type WHEN 'view' THEN 'model' WHEN 'click' THEN 'database' WHEN 'signup' THEN 'schema' WHEN 'error' THEN 'connection' ELSE 'value' END"
_MSG = "CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'database is Locked' WHEN 2 THEN 'rate_limited' ELSE NULL END"


@query(
    f"""WITH e AS (SELECT event_id, {_KIND} AS kind, {_MSG} AS msg FROM events), c AS (SELECT event_id, CASE WHEN kind = 'schema' THEN ['validation', 'schema_invalid', 'false'] WHEN kind = 'model' AND msg IN ('timeout', 'connection_error', 'rate_limited', 'server_error') THEN ['transient', msg, 'true'] WHEN kind = 'model' THEN ['permanent', coalesce(msg, 'model_error'), 'false']
    WHEN kind = 'connection' THEN ['transient', 'timeout', 'true'] WHEN kind = 'database' AND regexp_matches(lower(msg), 'locked|busy') THEN ['transient', 'database_busy', 'true'] WHEN kind = 'database' THEN ['permanent', 'database_error', 'false'] ELSE ['validation', 'invalid_argument', 'false'] END AS f FROM e)
    SELECT event_id, f[1] AS category, f[2] AS code, f[3] = 'true' AS retryable FROM c"""
)
def failure_classes(t: Tables) -> DataFrame:
    e = t.events.select("event_id", F.expr(_KIND).alias("kind"), F.expr(_MSG).alias("msg"))
    return e.select("event_id", agent.failure_class(F.col("kind"), F.col("msg")).alias("f")).select("event_id", "f.*")


@query(
    """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS ms, CASE WHEN event_type = 'view' THEN 3.0 END AS asked FROM events),
    w AS (SELECT *, coalesce(asked, k / 100.0 * least(8.0, 0.5 * pow(2.0, event_id % 6))) AS wait FROM e)
    SELECT event_id, round(CASE WHEN ms > 0 THEN k * 1000 / ms END, 6) AS tps, CASE WHEN ms IS NOT NULL THEN greatest(0, k - CAST(ms AS BIGINT)) END AS reused, round(CASE WHEN k > 0 AND ms IS NOT NULL THEN greatest(0, k - CAST(ms AS BIGINT)) / CAST(k AS DOUBLE) END, 6) AS ratio, round(CASE WHEN wait >= 0 AND wait < 6 THEN wait END, 6) AS delay FROM w"""
)
def call_timings(t: Tables) -> DataFrame:
    """Throughput, cache reuse and retry delays of calls: the key as tokens, the value as milliseconds."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    ms = F.when(F.col("event_type") != "error", F.col("value"))
    asked = F.when(F.col("event_type") == "view", F.lit(3.0))
    reuse = agent.cache_reuse(k, F.rint(ms).cast("bigint"))
    delay = agent.retry_delay(F.col("event_id") % 6, k / 100.0, F.lit(6.0), asked)
    return t.events.select("event_id", F.round(agent.tokens_per_second(k, ms), 6).alias("tps"), reuse["reused"].alias("reused"), F.round(reuse["ratio"], 6).alias("ratio"), F.round(delay, 6).alias("delay"))


@query(r"SELECT doc_id, model, CASE WHEN s <> '' THEN CAST(s AS DOUBLE) ELSE 'infinity'::DOUBLE END AS billions FROM (SELECT doc_id, model, regexp_extract(lower(model), '(?:^|[^0-9])(0\.6|1\.7|4)b', 1) AS s FROM (SELECT doc_id, coalesce(source, '') || '-' || CASE doc_id % 4 WHEN 0 THEN '0.6B' WHEN 1 THEN '1.7b' WHEN 2 THEN '14b' ELSE '4B-' || coalesce(lang, '') END AS model FROM documents))")
def model_sizes(t: Tables) -> DataFrame:
    name = F.concat(F.coalesce("source", F.lit("")), F.lit("-"), F.expr("CASE doc_id % 4 WHEN 0 THEN '0.6B' WHEN 1 THEN '1.7b' WHEN 2 THEN '14b' ELSE concat('4B-', coalesce(lang, '')) END"))
    return t.documents.select("doc_id", name.alias("model")).select("doc_id", "model", agent.parameter_billions(F.col("model")).alias("billions"))


_RAW = """CASE event_id % 4 WHEN 0 THEN concat('```json\n', props, '\n```') WHEN 1 THEN concat('Sure: {"k": ["', event_type, '", "b"], "note": " ', event_type, ' "} done') WHEN 2 THEN '{broken' ELSE '{"k": "  "}' END"""


@query("SELECT event_id, CASE event_id % 4 WHEN 1 THEN '- ' || event_type || chr(10) || '- b' END AS k, CASE event_id % 4 WHEN 1 THEN event_type END AS note FROM events")
def loose_json(t: Tables) -> DataFrame:
    """Answers in fences, in prose, broken and blank: lists become lines, and only texts count."""
    return t.events.select("event_id", agent.loose_json(F.expr(_RAW), "k", "note").alias("x")).select("event_id", "x.*")


@query(rf"WITH a AS (SELECT conv_id, turn, coalesce(text, '') || ' [E' || turn || '] and [doc:' || conv_id || '|page:3].  End' AS s FROM conversations) SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(s, '\s*\[(?:E[0-9]+|chunk:[0-9]+|doc:[0-9]+\|page:[0-9]+)\]', '', 'g'), '[ \t]+([,.;:!?])', '\1', 'g'), '[ \t]{{2,}}', ' ', 'g')) AS answer FROM a")
def stripped_markers(t: Tables) -> DataFrame:
    s = F.concat(F.coalesce("text", F.lit("")), F.lit(" [E"), F.col("turn").cast("string"), F.lit("] and [doc:"), F.col("conv_id").cast("string"), F.lit("|page:3].  End"))
    return t.conversations.select("conv_id", "turn", agent.stripped_markers(s).alias("answer"))


HINTS = ("Tion", "heit", "ció", "eau")
_HINTED = "(list_filter(list_filter(list_transform(string_split(regexp_replace(" + SQZ.format(c="text") + r", '([.!?。！？]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 13), lambda x: " + " OR ".join(f"contains(lower(x), '{h.lower()}')" for h in HINTS) + "))[1:3]"


@query("SELECT doc_id, " + _HINTED + " AS sentences, list_distinct(list_filter([CASE WHEN contains(lower(coalesce(text, '')), 'apache license') THEN 'licence' END, CASE WHEN contains(lower(coalesce(text, '')), 'copyright') THEN 'licence' END, CASE WHEN contains(lower(coalesce(text, '')), '@') THEN 'address' END], lambda x: x IS NOT NULL)) AS terms FROM documents")
def hinted_sentences(t: Tables) -> DataFrame:
    """The sentences that hold common endings, and the terms that a map names."""
    text = F.col("text")
    terms = agent.mapped_terms(text, {"apache license": "licence", "copyright": "licence", "@": "address"})
    return t.documents.select("doc_id", agent.hint_sentences(text, HINTS).alias("sentences"), F.sort_array(terms).alias("terms"))


@query("SELECT event_id AS call_id, CASE WHEN event_type = 'signup' THEN 'unknown_tool' WHEN event_type = 'error' THEN 'invalid_arguments' WHEN event_type = 'click' THEN 'argument_not_allowed' END AS fault FROM events")
def tool_call_faults(t: Tables) -> DataFrame:
    """Views and purchases may name k; clicks may not, errors send no JSON, sign-ups are no tool."""
    args = F.when(F.col("event_type") == "error", F.lit("{k")).otherwise(F.col("props"))
    calls = t.events.select(F.col("event_id").alias("call_id"), F.col("event_type").alias("tool"), args.alias("args"))
    return agent.tool_call_faults(calls, {"view": ("k", "limit"), "purchase": ("k",), "click": ("limit",), "error": ("k",)})


def _findings(t: Tables):
    from lodestrand.operators import bm25 as lx
    from lodestrand.operators import loop

    claims = loop.claims_of(t.benchmark.select(F.col("item_id").alias("session_id"), F.col("text").alias("question")))
    return loop.research(claims, loop.index_retriever(lx.Index.stored(t.documents)), loop.overlap_judge(t.documents.select("doc_id", "text")))


@query()
def agent_trace(t: Tables) -> DataFrame:
    """What a client is told of a user's events, as agent events of every kind in turn with fields of several kinds."""
    from lodestrand.operators import trace

    kinds = [*trace.KINDS, "model_start", "private"]
    i = F.col("event_id")
    data = F.to_json(F.struct(
        F.when(i % 4 != 1, i % 5).alias("round"), F.when(i % 3 == 0, "error").when(i % 3 == 1, "ok").alias("status"), F.col("event_type").alias("tool"), F.concat(F.lit("call-"), i).alias("call_id"), F.col("event_type").alias("error_category"),
        F.repeat(F.col("event_type"), 300).alias("query"), F.col("value").alias("timing_ms"), (i % 7).cast("string").alias("provider_attempts"), F.array(i, i % 3, i, F.lit(0)).alias("chunk_ids"), F.array(F.lit(9), i, i % 4).alias("returned_document_ids"), F.array(F.lit("c1"), F.lit("c2")).alias("claim_ids"),
        (i % 9).alias("count"), F.when(i % 2 == 0, "completed").otherwise("stalled").alias("completion_status"), F.lit("never told").alias("secret"), F.array(F.lit("finish_research"), F.lit("other")).alias("terminal_tool_names"), F.lit("no_tool_call").alias("terminal_response_category"), (i % 6).alias("terminal_tool_count"),
    ))
    e = t.events.select(F.col("user_id").alias("session_id"), i.alias("ord"), F.element_at(F.array(*map(F.lit, kinds)), (i % len(kinds) + 1).cast("int")).alias("kind"), data.alias("data"))
    return trace.told(e)


@query()
def judge_budget(t: Tables) -> DataFrame:
    """The best 20 documents of each question in three groups, the lower ten as from the web, shrunk to 900 tokens of a public vocabulary."""
    import public_tokenizers

    from lodestrand.operators import evidence, fusion
    from lodestrand.plans.retrieval import bm25_ranking

    r = fusion.late_rows(bm25_ranking(t).select(F.col("query_id").alias("case_id"), "doc_id", "rank"), t.documents.select("doc_id", "text"))
    c = r.join(t.benchmark.select(F.col("item_id").alias("case_id"), F.col("text").alias("question")), "case_id")
    rows = c.select("case_id", "question", (F.col("rank") % 3).alias("grp"), F.when(F.col("rank") <= 10, "local").otherwise("web").alias("kind"), F.col("rank").alias("ord"), F.col("doc_id").alias("source"), F.col("text").alias("content"))
    return evidence.judge_payloads(rows, 900, public_tokenizers.path("byte_bpe_50k.json"))


@query()
def research_sessions(t: Tables) -> DataFrame:
    """Each question settled in rounds of planning, searching and judging; a row for each session."""
    return _findings(t).sessions


@query()
def research_claims(t: Tables) -> DataFrame:
    """The claims of the questions with their status and best evidence after the loop."""
    return _findings(t).claims.withColumn("best", F.round("best", 6))


@query("WITH r AS (SELECT conv_id, turn, coalesce(text, '') AS text, CASE role WHEN 'user' THEN 'simple_rag' WHEN 'assistant' THEN 'direct_answer' ELSE 'agentic_rag' END AS intent FROM conversations) SELECT conv_id, turn, intent AS route, CASE intent WHEN 'simple_rag' THEN length(text) WHEN 'direct_answer' THEN 0 ELSE -1 END AS cost FROM r")
def routed_questions(t: Tables) -> DataFrame:
    """Messages by the route of their role."""
    from lodestrand.operators import loop

    intent = F.when(F.col("role") == "user", "simple_rag").when(F.col("role") == "assistant", "direct_answer").otherwise("agentic_rag")
    q = t.conversations.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), intent.alias("intent"))
    cost = lambda c: lambda df: df.select("conv_id", "turn", c.cast("int").alias("cost"))
    return loop.routed(q, {"simple_rag": cost(F.length("text")), "direct_answer": cost(F.lit(0)), "agentic_rag": cost(F.lit(-1))})
