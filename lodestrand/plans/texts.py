"""Text functions over documents, conversations and pages; quality and contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import contracts as ct
from lodestrand.functions import text as tx
from lodestrand.operators import quality, structure, vectors
from lodestrand.operators.chunking import chunk_blocks, chunk_documents
from lodestrand.operators.token_chunks import Sizes, chunk_by_tokens
from lodestrand.plans.registry import Tables, query
from lodestrand.sources import readers

SQZ = r"trim(regexp_replace(coalesce({c}, ''), '[ \t\n\r\f\x0B]+', ' ', 'g'))"
TXT = SQZ.format(c="text")


def _q(s: str) -> str:
    return s.replace("'", "''")


@query(
    f"""SELECT doc_id, pos AS sentence_no, s AS sentence FROM (
        SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS pos FROM (
            SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{_q(tx.SENTENCE_PATTERN)}'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ss FROM documents))"""
)
def sentence_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("i", "sentence")).select("doc_id", (F.col("i") + 1).alias("sentence_no"), "sentence")


@query(f"SELECT doc_id, {TXT} AS squeezed, substring({TXT}, 1, 120) AS bounded, CASE WHEN length({TXT}) <= 80 THEN {TXT} ELSE rtrim(substring({TXT}, 1, 79)) || '...' END AS short FROM documents")
def normalize_text(t: Tables) -> DataFrame:
    s = tx.squeeze(F.col("text"))
    return t.documents.select("doc_id", s.alias("squeezed"), tx.bounded(F.col("text"), 120).alias("bounded"), tx.ellipsis(s, 80).alias("short"))


# The secrets of the test texts are made from their ids: one of five shapes by id.
SHAPES = (
    "Authorization: Bearer abc{n}.def",
    "\"api_key\": \"Basic zz{n}\"",
    "use sk-live{n}_x now",
    "authorization=plain{n}; ok",
    "token = 't{n}' and api key: k{n}",
)


def _shape(doc_id):
    out = F.lit(None).cast("string")
    for i, s in enumerate(SHAPES):
        out = F.when(F.col(doc_id) % 5 == i, F.replace(F.lit(s), F.lit("{n}"), F.col(doc_id).cast("string"))).otherwise(out)
    return out


_SHAPE_SQL = "CASE " + " ".join(f"WHEN doc_id % 5 = {i} THEN replace('{_q(s)}', '{{n}}', CAST(doc_id AS VARCHAR))" for i, s in enumerate(SHAPES)) + " END"
_HEAD = "substring(" + TXT + ", 1, 60)"
_CLEAN_SQL = "CASE " + " ".join(
    f"WHEN doc_id % 5 = {i} THEN {s}"
    for i, s in enumerate(
        (
            "'Authorization: Bearer ***'",
            "'\"api_key\":\"***\"'",
            "'use sk-*** now'",
            "'authorization=***; ok'",
            "'token=''***'' and api key:***'",
        )
    )
) + " END"


@query(f"SELECT doc_id, {_CLEAN_SQL} AS redacted, false AS leaks FROM documents")
def redact_secrets(t: Tables) -> DataFrame:
    red = tx.redact(_shape("doc_id"))
    return t.documents.select("doc_id", red.alias("redacted"), F.contains(red, F.concat(F.col("doc_id").cast("string"), F.lit("!"))).alias("leaks"))


# The values to hide in each of SHAPES.
SECRETS = (("abc{n}.def",), ("zz{n}",), ("sk-live{n}_x",), ("plain{n}",), ("t{n}", "k{n}"))


def _lengths_of(secret, column):
    """Characters of a text that are occurrences of the secret."""
    return F.length(column) - F.length(F.replace(column, secret, F.lit("")))


@query()
def redact_documents(t: Tables) -> DataFrame:
    """Every whole text with its secret at the end; it leaks if its value is left more often than in the text alone."""
    own = F.coalesce("text", F.lit(""))
    d = t.documents.select("doc_id", tx.redact(own).alias("own"), tx.redact(F.concat(own, F.lit("\n"), F.coalesce(_shape("doc_id"), F.lit("")))).alias("redacted"))
    leaks = F.lit(False)
    for i, values in enumerate(SECRETS):
        for v in values:
            secret = F.replace(F.lit(v), F.lit("{n}"), F.col("doc_id").cast("string"))
            leaks = leaks | F.coalesce((F.col("doc_id") % 5 == i) & (_lengths_of(secret, F.col("redacted")) > _lengths_of(secret, F.col("own"))), F.lit(False))
    return d.select("doc_id", "redacted", leaks.alias("leaks"))


@query(r"""SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: true) AS mails,
    regexp_matches(coalesce(text, ''), '(?i)(?:[?&#]|%3f|%26)(?:api[_-]?key|token|authorization|access[_-]?token|apikey|auth)(?:=|%3d)') AS secret_url FROM documents""")
def url_filter(t: Tables) -> DataFrame:
    x = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)).alias("mails"), x.rlike(tx.SECRET_URL_PATTERN).alias("secret_url"))


@query(r"SELECT page_id, (url LIKE 'http://%' OR url LIKE 'https://%') AND position(' ' IN url) = 0 AS is_http, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def page_urls(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select("page_id", ((u.startswith("http://") | u.startswith("https://")) & ~F.contains(u, F.lit(" "))).alias("is_http"), F.regexp_extract(u, "^https?://([^/?#]+)", 1).alias("host"))


def _numbered(documents: DataFrame) -> DataFrame:
    """Headings and references made of each document's id and first words."""
    head = F.regexp_replace(F.regexp_extract(F.coalesce("text", F.lit("")), r"^(\S+)", 1), "[^A-Za-z]", "")
    number = F.when(F.col("doc_id") % 4 == 0, F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit("."), (F.col("doc_id") % 7).cast("string"))).when(F.col("doc_id") % 4 == 1, "IV").when(F.col("doc_id") % 4 == 2, "1.2.3").otherwise("")
    return documents.select("doc_id", "text", F.concat(number, F.lit(" "), head).alias("heading"))


_HEADING = "CASE doc_id % 4 WHEN 0 THEN CAST(doc_id % 9 + 1 AS VARCHAR) || '.' || CAST(doc_id % 7 AS VARCHAR) WHEN 1 THEN 'IV' WHEN 2 THEN '1.2.3' ELSE '' END || ' ' || regexp_replace(regexp_extract(coalesce(text, ''), '^(\\S+)', 1), '[^A-Za-z]', '', 'g')"


@query(rf"""SELECT doc_id, heading, CASE WHEN regexp_matches(h, '^[0-9]+(?:\.[0-9]+)*\.?\s+\S') THEN length(regexp_extract(h, '^([0-9]+(?:\.[0-9]+)*)', 1)) - length(replace(regexp_extract(h, '^([0-9]+(?:\.[0-9]+)*)', 1), '.', '')) + 1
    WHEN regexp_matches(h, '^[IVXLCDM]+(?:\.[0-9]+)*\.?\s+\S') THEN length(regexp_extract(h, '^[IVXLCDM]+((?:\.[0-9]+)*)', 1)) - length(replace(regexp_extract(h, '^[IVXLCDM]+((?:\.[0-9]+)*)', 1), '.', '')) + 1 END AS depth
    FROM (SELECT doc_id, heading, {SQZ.format(c='heading')} AS h FROM (SELECT doc_id, {_HEADING} AS heading FROM documents))""")
def heading_depth(t: Tables) -> DataFrame:
    return _numbered(t.documents).drop("text").withColumn("depth", tx.heading_depth(F.col("heading")))


@query()
def document_headings(t: Tables) -> DataFrame:
    """Every line of every text, then the numbered one made of it, with the depth of its heading number."""
    lines = _numbered(t.documents).select("doc_id", F.posexplode(F.split(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.coalesce("heading", F.lit(""))), r"\r?\n")).alias("i", "heading"))
    return lines.select("doc_id", (F.col("i") + 1).alias("line_no"), "heading", tx.heading_depth(F.col("heading")).alias("depth"))


_REF_TEXT = "'See Fig. ' || (doc_id % 12) || ' and Table ' || (doc_id % 5 + 1) || '.' || (doc_id % 3) || ', eq. (' || (doc_id % 9) || ') in Section IV; also figure ' || (doc_id % 12 + 1) || '.'"


@query(
    rf"""SELECT doc_id, pos, x AS text, CASE WHEN p LIKE 'fig%' THEN 'figure' WHEN p LIKE 'tab%' THEN 'table' WHEN p LIKE 'eq%' THEN 'equation' ELSE 'section' END AS type,
    CASE WHEN p LIKE 'fig%' THEN 'Figure ' WHEN p LIKE 'tab%' THEN 'Table ' WHEN p LIKE 'eq%' THEN 'Eq. ' ELSE 'Section ' END || regexp_extract(c, '^[A-Za-z]+\.?\s*\(?(.+?)\)?$', 1) AS label
    FROM (SELECT doc_id, pos, x, regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '[.,;: ]+$', '') AS c, lower(regexp_extract(x, '^([A-Za-z]+)', 1)) AS p FROM (
        SELECT doc_id, unnest(r) AS x, generate_subscripts(r, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all({_REF_TEXT}, '{_q(tx.CROSS_REFERENCE_PATTERN)}') AS r FROM documents)))"""
)
def cross_refs(t: Tables) -> DataFrame:
    return _references(t).select("doc_id", "pos", "text", "type", "label")


def _references(t: Tables, whole: bool = False) -> DataFrame:
    made = t.documents.select("doc_id", "text", F.expr("concat('See Fig. ', doc_id % 12, ' and Table ', doc_id % 5 + 1, '.', doc_id % 3, ', eq. (', doc_id % 9, ') in Section IV; also figure ', doc_id % 12 + 1, '.')").alias("x"))
    x = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.coalesce("x", F.lit(""))) if whole else F.col("x")
    return made.select("doc_id", F.posexplode(tx.cross_references(x)).alias("pos", "r")).select("doc_id", "pos", "r.*")


@query()
def document_refs(t: Tables) -> DataFrame:
    """References of every whole text and of the sentence made for it."""
    return _references(t, True).select("doc_id", "pos", "text", "type", "label")


@query(
    f"""WITH r AS (SELECT doc_id, 'figure' AS type, 'Figure ' || (doc_id % 12) AS label FROM documents UNION ALL SELECT doc_id, 'figure', 'Figure ' || (doc_id % 12 + 1) FROM documents
        UNION ALL SELECT doc_id, 'table', 'Table ' || (doc_id % 5 + 1) || '.' || (doc_id % 3) FROM documents UNION ALL SELECT doc_id, 'equation', 'Eq. ' || (doc_id % 9) FROM documents UNION ALL SELECT doc_id, 'section', 'Section IV' FROM documents),
    g AS (SELECT n_nationkey AS target, 'figure' AS type, 'Figure ' || (n_nationkey % 20) AS label FROM nation UNION ALL SELECT r_regionkey, 'equation', 'Eq. ' || r_regionkey FROM region),
    o AS (SELECT type, label, count(DISTINCT target) AS n, min(target) AS target FROM g GROUP BY ALL)
    SELECT doc_id AS source, r.type, r.label, CASE WHEN n = 1 THEN target END AS target, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM r LEFT JOIN o USING (type, label)"""
)
def resolve_refs(t: Tables) -> DataFrame:
    """Nations stand for the figures, some under one label, and regions for the equations."""
    return structure.unique_targets(_references(t).withColumnRenamed("doc_id", "source"), _targets(t))


@query()
def resolve_document_refs(t: Tables) -> DataFrame:
    """The references of whole texts against the same targets."""
    return structure.unique_targets(_references(t, True).withColumnRenamed("doc_id", "source"), _targets(t))


def _targets(t: Tables) -> DataFrame:
    f = t.nation.select(F.col("n_nationkey").alias("target"), F.lit("figure").alias("type"), F.expr("concat('Figure ', n_nationkey % 20)").alias("label"))
    e = t.region.select(F.col("r_regionkey").alias("target"), F.lit("equation").alias("type"), F.expr("concat('Eq. ', r_regionkey)").alias("label"))
    return f.unionByName(e)


@query(f"SELECT doc_id, regexp_matches(coalesce(text, ''), '{tx.MOJIBAKE_PATTERN}') AS mojibake, regexp_matches(coalesce(text, ''), '{tx.CJK_PATTERN}') AS cjk FROM documents")
def mojibake_and_cjk(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.is_mojibake(F.col("text")).alias("mojibake"), tx.has_cjk(F.col("text")).alias("cjk"))


_SAID = "CASE turn % 6 WHEN 0 THEN 'Please remember ' || coalesce(text, '') WHEN 1 THEN coalesce(text, '') || '. From now on be brief' WHEN 2 THEN 'how many papers are in [doc:' || conv_id || '|page:1] ' || coalesce(text, '') WHEN 3 THEN 'list papers [E' || turn || '] ' || coalesce(text, '') WHEN 4 THEN coalesce(text, '') || ' which had indexing failed' ELSE coalesce(text, '') END"
_SAID_SPARK = "CASE turn % 6 WHEN 0 THEN concat('Please remember ', coalesce(text, '')) WHEN 1 THEN concat(coalesce(text, ''), '. From now on be brief') WHEN 2 THEN concat('how many papers are in [doc:', conv_id, '|page:1] ', coalesce(text, '')) WHEN 3 THEN concat('list papers [E', turn, '] ', coalesce(text, '')) WHEN 4 THEN concat(coalesce(text, ''), ' which had indexing failed') ELSE coalesce(text, '') END"


@query(f"SELECT conv_id, turn, regexp_matches(s, '{_q(tx.EXPLICIT_MEMORY_PATTERN)}') AS explicit, regexp_matches(s, '{_q(tx.EVIDENCE_MARKER_PATTERN)}') AS has_marker FROM (SELECT conv_id, turn, {_SAID} AS s FROM conversations)")
def memory_intent(t: Tables) -> DataFrame:
    s = t.conversations.select("conv_id", "turn", F.expr(_SAID_SPARK).alias("s"))
    return s.select("conv_id", "turn", tx.has_memory_intent(F.col("s")).alias("explicit"), F.col("s").rlike(tx.EVIDENCE_MARKER_PATTERN).alias("has_marker"))


def _has(markers) -> str:
    return "(" + " OR ".join(f"contains(f, '{m}')" for m in markers) + ")"


@query(f"SELECT conv_id, turn, CASE WHEN {_has(tx.FAILED_MARKERS)} THEN 'failed_indexing' WHEN {_has(tx.COUNT_MARKERS)} THEN 'count' WHEN {_has(tx.INVENTORY_MARKERS)} THEN 'inventory' ELSE 'document_status' END AS operation FROM (SELECT conv_id, turn, lower({SQZ.format(c='s')}) AS f FROM (SELECT conv_id, turn, {_SAID} AS s FROM conversations))")
def operation_class(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", tx.operation(F.expr(_SAID_SPARK)).alias("operation"))


_PROT = f"list_distinct(list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '{_q(tx.PROTECTED_PATTERN)}'), lambda x: regexp_matches(x, '[0-9]') OR regexp_matches(x, '[A-Z].*[A-Z]')), lambda x: lower(x)))"


@query(f"SELECT doc_id, list_sort({_PROT}) AS tokens, list_sort(list_filter({_PROT}, lambda x: NOT contains(lower(substring(coalesce(text, ''), 1, 400)), x))) AS dropped FROM documents")
def protected_tokens(t: Tables) -> DataFrame:
    """What a rewrite must keep, and what a cut after 400 characters would drop."""
    p = tx.protected_tokens(F.col("text"))
    cut = F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 400))
    return t.documents.select("doc_id", F.sort_array(p).alias("tokens"), F.sort_array(F.filter(p, lambda x: ~F.contains(cut, x))).alias("dropped"))


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(source, '') || ' ' || coalesce(lang, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
    array_to_string(list_transform(regexp_extract_all(coalesce(source, '') || ' of ' || coalesce(lang, ''), '[\p{L}\p{N}_.-]+'), lambda w: 'all:"' || w || '"'), ' AND ') AS search FROM documents"""
)
def slugs_and_searches(t: Tables) -> DataFrame:
    name = F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return t.documents.select("doc_id", tx.slug(name).alias("slug"), tx.search_query(F.concat(F.coalesce("source", F.lit("")), F.lit(" of "), F.coalesce("lang", F.lit("")))).alias("search"))


@query(f"SELECT doc_id AS id, min(doc_id) OVER w AS first_id, sha1({'lower(' + TXT + ')'}) AS digest FROM documents WINDOW w AS (PARTITION BY lower({TXT})) QUALIFY doc_id <> min(doc_id) OVER w")
def duplicate_content(t: Tables) -> DataFrame:
    return quality.duplicate_content(t.documents, "doc_id", "text")


@query("SELECT source, count(*) AS pages, round(avg(CASE WHEN trim(coalesce(text, '')) <> '' THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM documents GROUP BY source")
def text_coverage(t: Tables) -> DataFrame:
    return quality.coverage(t.documents, "source", "text")


_WARN = f"""SELECT doc_id AS id, unnest(list_filter([CASE WHEN trim(t) = '' THEN 'empty_text' END, CASE WHEN length(t) > 0 AND length(t) < 20 THEN 'short_text' END,
    CASE WHEN regexp_matches(t, '{tx.MOJIBAKE_PATTERN}') THEN 'mojibake' END, CASE WHEN length(t) >= 20 AND w * 20 < length(t) THEN 'few_words' END,
    CASE WHEN contains(t, '�') THEN 'replacement_character' END, CASE WHEN length(t) > 20000 THEN 'very_long' END], lambda x: x IS NOT NULL)) AS code
    FROM (SELECT doc_id, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '{_q(tx.WORD_PATTERN)}')) AS w FROM documents)"""


@query(f"SELECT DISTINCT id, code FROM ({_WARN})")
def quality_warnings(t: Tables) -> DataFrame:
    return quality.warnings(t.documents)


@query(f"WITH w AS (SELECT DISTINCT id, code FROM ({_WARN})), b AS (SELECT id, count(*) AS n, bool_or(code = 'empty_text') AS e FROM w GROUP BY id) SELECT doc_id AS id, CASE WHEN e THEN 'failed' WHEN n > 0 THEN 'partial' ELSE 'ready' END AS status, coalesce(n, 0) AS warnings FROM documents LEFT JOIN b ON doc_id = id")
def quality_status(t: Tables) -> DataFrame:
    return quality.status(quality.warnings(t.documents), t.documents)


@query("SELECT doc_id AS id, sha256(coalesce(text, '')) AS sha FROM documents")
def content_fingerprints(t: Tables) -> DataFrame:
    return vectors.fingerprints(t.documents, "doc_id", "text")


_RAW = "CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN '{\"intent\": \"simple_rag\"}' WHEN 2 THEN '{\"intent\": \"agentic_rag\", \"why\": 1}' WHEN 3 THEN '[1, 2]' WHEN 4 THEN '{\"intent\": ' WHEN 5 THEN '{\"plan\": \"x\"}' WHEN 6 THEN '{\"intent\": \"other\"}' WHEN 7 THEN '{\"intent\": 3}' ELSE '{\"intent\": \"direct_answer\"}' END"
_FAULT = "CASE event_id % 9 WHEN 0 THEN 'empty_output' WHEN 2 THEN '{e}' WHEN 3 THEN 'not_json_object' WHEN 4 THEN 'invalid_json' WHEN 5 THEN '{m}' WHEN 6 THEN 'invalid_intent' WHEN 7 THEN 'invalid_intent' END"


@query(f"SELECT event_id, {_FAULT.format(e='extra_fields', m='missing_intent')} AS fault, {_FAULT.format(e='schema_violation', m='schema_violation')} AS one_code, CASE event_id % 9 WHEN 1 THEN 'simple_rag' WHEN 8 THEN 'direct_answer' ELSE 'agentic_rag' END AS intent FROM events")
def router_contract(t: Tables) -> DataFrame:
    raw = F.expr(_RAW)
    return t.events.select("event_id", ct.router_fault(raw).alias("fault"), ct.router_fault(raw, True).alias("one_code"), ct.router_intent(raw).alias("intent"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) AS n_keys FROM events")
def json_props(t: Tables) -> DataFrame:
    m = ct.json_map(F.col("props"))
    return t.events.select("event_id", m["k"].cast("bigint").alias("k"), F.size(m).alias("n_keys"))


@query()
def char_chunks(t: Tables) -> DataFrame:
    return chunk_documents(t.documents)


@query()
def structure_chunks(t: Tables) -> DataFrame:
    """Lines as blocks; sections change with every tenth line."""
    lines = t.documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text"))
    return chunk_blocks(lines.withColumn("section", F.concat(F.lit("part "), F.floor(F.col("ord") / 10).cast("string"))))


@query()
def token_chunks(t: Tables) -> DataFrame:
    """Chunks by a public vocabulary's tokens: lines as blocks of sections, every ninth one a reference, eight lines a page."""
    import public_tokenizers

    lines = t.documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text"))
    section = F.floor(F.col("ord") / 16).cast("string")
    b = lines.select(
        "doc_id", "ord", F.concat_ws(":", "doc_id", "ord").alias("uid"), F.when(F.col("ord") % 9 == 8, "reference").otherwise("paragraph").alias("kind"), F.concat(F.lit("s"), section).alias("section_uid"),
        F.concat(F.lit("Part "), section).alias("section"), F.lit(None).cast("string").alias("subsection"), F.floor(F.col("ord") / 8).alias("page"), "text", F.lit(0.0).alias("x0"), (F.col("ord") % 8 * 90.0).alias("y0"), F.lit(600.0).alias("x1"), (F.col("ord") % 8 * 90.0 + 40).alias("y1"),
    )
    return chunk_by_tokens(b, public_tokenizers.path("byte_bpe_50k.json"), Sizes(80, 20, 128, 0.12)).select("doc_id", "chunk_uid", "section", "content", "tokens", "block_uids", "page_start", "page_end")


@query("SELECT page_id, 0 AS table_no, ['key', 'key_2', 'url'] AS columns, [[CAST(page_id AS VARCHAR), CAST(page_id AS VARCHAR), '<' || length(url)], [CAST(page_id AS VARCHAR), 'x', '<' || length(url)]] AS rows FROM pages")
def html_tables(t: Tables) -> DataFrame:
    """Every page with a table behind its own content: a header over two columns, a cell over two columns and cells over two rows."""
    row = "<table><tr><th colspan=2>key</th><th>url</th></tr><tr></tr><tr><td rowspan=2>{k}</td><td> {k}</td><td rowspan=2>&lt;{n}</td></tr><tr><td>x</td></tr></table>"
    before, middle, again, after = row.replace("{n}", "{k}").split("{k}")
    k, n = F.col("page_id").cast("string"), F.length("url").cast("string")
    made = F.concat(F.coalesce("html", F.lit("")), F.lit(before), k, F.lit(middle), k, F.lit(again), n, F.lit(after))
    return readers.scan_tables(t.pages.select("page_id", made.alias("html")))
