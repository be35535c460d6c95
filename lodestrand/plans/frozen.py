"""Queries over frozen candidates, arms of a comparison, stored keys, margins and reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import text as tx
from lodestrand.operators import evidence
from lodestrand.operators import frozen as fz
from lodestrand.operators import gold as gd
from lodestrand.plans.layout import _MARGIN
from lodestrand.plans.registry import Tables, query
from lodestrand.plans.retrieval import RANKED, TERMS, bm25_ranking
from lodestrand.plans.tables import _B, _blocks

_CANDIDATES = f"WITH {TERMS}, {RANKED}, c AS (SELECT query_id AS case_id, doc_id AS chunk_id, rank FROM ranked WHERE rank <= 20)"


def _candidates(t: Tables) -> DataFrame:
    return bm25_ranking(t).select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("chunk_id"), "rank")


@query(
    f"""{_CANDIDATES}, j AS (SELECT c.*, d.source, d.n_chars, d.doc_id FROM c LEFT JOIN (SELECT * FROM documents WHERE doc_id % 97 <> 5) d ON d.doc_id = c.chunk_id),
    bad AS (SELECT DISTINCT case_id FROM j WHERE doc_id IS NULL)
    SELECT case_id, chunk_id, chunk_id // 10 AS document_id, chunk_id % 10 AS page_number, row_number() OVER (PARTITION BY case_id ORDER BY n_chars DESC, rank) AS rank, CAST(n_chars AS DOUBLE) AS score, rank AS fusion_rank, CAST(NULL AS VARCHAR) AS fault FROM j ANTI JOIN bad USING (case_id)
    UNION ALL SELECT case_id, NULL, NULL, NULL, NULL, NULL, NULL, 'chunk_absent' FROM bad"""
)
def frozen_rerank(t: Tables) -> DataFrame:
    """The best 20 of each question reranked by length; some documents are not stored any more."""
    d = t.documents.where("doc_id % 97 <> 5")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 10).alias("document_id"), (F.col("doc_id") % 10).alias("page_number"), F.coalesce("text", F.lit("")).alias("content"), "n_chars")
    return fz.frozen_rerank(_candidates(t), chunks, lambda j: j.select("case_id", "chunk_id", F.col("n_chars").cast("double").alias("rerank_score")))


_ITEMS = """items AS (SELECT case_id AS query_id, (rank * 7) % 20 AS ord, CASE WHEN rank % 3 = 0 THEN NULL WHEN rank % 7 = 1 THEN 'x' ELSE CAST(chunk_id AS VARCHAR) END AS chunk_id, CASE WHEN rank % 6 = 0 THEN '{"chunk_id":' || (chunk_id + 1000000) || '}' ELSE '{"chunk_id":"' || chunk_id || '"}' END AS metadata,
    CASE WHEN rank % 5 = 0 THEN 'none' ELSE CAST(rank / 2.0 AS VARCHAR) END AS rerank_score FROM c)"""


@query(
    f"""{_CANDIDATES}, {_ITEMS}, i AS (SELECT query_id, ord, TRY_CAST(coalesce(chunk_id, json_extract_string(metadata, '$.chunk_id')) AS BIGINT) AS chunk_id, TRY_CAST(rerank_score AS DOUBLE) AS s FROM items),
    f AS (SELECT query_id, chunk_id, min(ord) AS at_, arg_min(coalesce(s, -1), ord) AS s FROM i WHERE chunk_id IS NOT NULL GROUP BY ALL)
    SELECT c.case_id AS query_id, c.chunk_id, nullif(s, -1) AS rerank_score, row_number() OVER (PARTITION BY c.case_id ORDER BY at_ NULLS LAST, c.rank) AS place FROM c LEFT JOIN f ON f.query_id = c.case_id AND f.chunk_id = c.chunk_id"""
)
def reranked_rows(t: Tables) -> DataFrame:
    """A reranker's answers with ids in two places, ids that are none, and scores that are no numbers."""
    c = _candidates(t)
    r = F.col("rank")
    items = c.select(
        F.col("case_id").alias("query_id"), ((r * 7) % 20).alias("ord"), F.when(r % 3 == 0, None).when(r % 7 == 1, "x").otherwise(F.col("chunk_id").cast("string")).alias("chunk_id"),
        F.when(r % 6 == 0, F.concat(F.lit('{"chunk_id":'), F.col("chunk_id") + 1_000_000, F.lit("}"))).otherwise(F.concat(F.lit('{"chunk_id":"'), "chunk_id", F.lit('"}'))).alias("metadata"), F.when(r % 5 == 0, "none").otherwise((r / 2.0).cast("string")).alias("rerank_score"),
    )
    return fz.reranked(items, c.select(F.col("case_id").alias("query_id"), "chunk_id", r.alias("ord")))


@query("SELECT doc_id AS chunk_id, '{\"chunk_id\":' || doc_id || ',\"document_id\":' || doc_id // 10 || ',\"title\":\"' || source || '\",\"page_number\":' || doc_id % 10 || ',\"chunk_index\":' || doc_id % 100 || '}' AS metadata, n_chars / 2.0 AS score FROM documents")
def rerank_payloads(t: Tables) -> DataFrame:
    c = t.documents.select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 10).alias("document_id"), F.col("source").alias("title"), (F.col("doc_id") % 10).alias("page_number"), (F.col("doc_id") % 100).alias("chunk_index"), F.col("text").alias("content"), (F.col("n_chars") / 2.0).alias("fusion_score"))
    return fz.rerank_payloads(c).select("chunk_id", "metadata", "score")


_ARM = """arms AS (SELECT case_id, chunk_id, rank, 'raw_fusion' AS arm FROM c UNION ALL SELECT case_id, chunk_id, 21 - rank, 'rewrite_fusion' FROM c UNION ALL SELECT case_id, chunk_id, (rank * 3) % 21 + 1, 'raw_rerank' FROM c UNION ALL SELECT case_id, chunk_id, (rank * 11) % 21 + 1, 'rewrite_rerank' FROM c),
gold AS (SELECT item_id AS case_id, doc_id AS chunk_id FROM benchmark, documents WHERE doc_id % 7 = item_id % 7),
fst AS (SELECT arm, case_id, min(rank) AS first_ FROM arms JOIN gold USING (case_id, chunk_id) GROUP BY ALL),
armhits AS (SELECT arm, item_id AS case_id, k, coalesce(first_ <= k, false) AS hit FROM benchmark CROSS JOIN (SELECT unnest(['raw_fusion', 'rewrite_fusion', 'raw_rerank', 'rewrite_rerank']) AS arm) CROSS JOIN (SELECT unnest([3, 5, 10, 20]) AS k) LEFT JOIN fst ON fst.case_id = item_id AND fst.arm = arm)"""
_ARM = _ARM.replace("CROSS JOIN (SELECT unnest(['raw_fusion', 'rewrite_fusion', 'raw_rerank', 'rewrite_rerank']) AS arm)", "CROSS JOIN (SELECT unnest(['raw_fusion', 'rewrite_fusion', 'raw_rerank', 'rewrite_rerank']) AS arm) a").replace("fst.arm = arm)", "fst.arm = a.arm)").replace("SELECT arm, item_id AS case_id, k", "SELECT a.arm, item_id AS case_id, k")


def _hits(t: Tables) -> DataFrame:
    """The questions' rankings in four orders; every seventh document is right."""
    c, r = _candidates(t), F.col("rank")
    of = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), x.alias("rank")) for a, x in zip(fz.ARMS, (r, 21 - r, (r * 3) % 21 + 1, (r * 11) % 21 + 1))])).alias("x")
    arms = c.select("case_id", "chunk_id", of).select("case_id", "chunk_id", "x.*")
    gold = c.where(F.col("chunk_id") % 7 == F.col("case_id") % 7).select("case_id", "chunk_id")
    return fz.arm_hits(arms, gold, t.benchmark.select(F.col("item_id").alias("case_id")))


@query(f"{_CANDIDATES}, {_ARM}, p AS (SELECT * FROM (VALUES ('query_before_rerank', 'raw_fusion', 'rewrite_fusion'), ('rerank_on_raw', 'raw_fusion', 'raw_rerank'), ('rerank_on_rewrite', 'rewrite_fusion', 'rewrite_rerank'), ('final', 'raw_rerank', 'rewrite_rerank')) v(comparison, l, r)) SELECT comparison, x.k, count(*) FILTER (NOT x.hit AND y.hit) AS gained, count(*) FILTER (x.hit AND NOT y.hit) AS lost, count(*) FILTER (x.hit AND y.hit) AS both, count(*) FILTER (NOT x.hit AND NOT y.hit) AS neither FROM p JOIN armhits x ON x.arm = l JOIN armhits y ON y.arm = r AND y.case_id = x.case_id AND y.k = x.k WHERE x.k IN (5, 20) GROUP BY ALL")
def four_arms(t: Tables) -> DataFrame:
    return fz.four_arms(_hits(t))


@query(f"{_CANDIDATES}, {_ARM}, m AS (SELECT arm, k, avg(CAST(hit AS INT)) AS h FROM armhits GROUP BY ALL), g AS (SELECT (SELECT h FROM m WHERE arm = 'rewrite_rerank' AND k = 5) > (SELECT h FROM m WHERE arm = 'raw_rerank' AND k = 5) AS final_hit5_improves, (SELECT h FROM m WHERE arm = 'rewrite_rerank' AND k = 20) >= (SELECT h FROM m WHERE arm = 'raw_rerank' AND k = 20) AS final_hit20_non_decreasing, (SELECT count(*) = 0 FROM events WHERE event_type = 'none') AS zero_rewrite_rerank_errors) SELECT *, final_hit5_improves AND final_hit20_non_decreasing AND zero_rewrite_rerank_errors AS adopt FROM g")
def adoption_gates(t: Tables) -> DataFrame:
    return fz.adoption(_hits(t), t.events.where("event_type = 'none'"))


@query("SELECT d.doc_id AS chunk_id, d.doc_id // 3 AS document_id, p.url AS title, d.doc_id % 3 AS page_number, d.doc_id % 3 AS chunk_index, length(coalesce(d.text, '')) AS chars FROM documents d JOIN pages p ON p.page_id = d.doc_id // 3")
def chunk_candidates(t: Tables) -> DataFrame:
    """Three documents as chunks of one page's document; those whose page is not there go."""
    i = F.col("doc_id")
    chunks = t.documents.select(i.alias("chunk_id"), F.floor(i / 3).alias("document_id"), (i % 3).alias("page_number"), (i % 3).alias("chunk_index"), F.coalesce("text", F.lit("")).alias("content"))
    found = fz.chunk_candidates(chunks, t.pages.select(F.col("page_id").alias("document_id"), F.col("url").alias("title")))
    return found.withColumn("chars", F.length("content")).drop("content")


@query("SELECT url AS entry_url, min(page_id) AS page_id, min(lpad(CAST(page_id AS VARCHAR), 9, '0')) AS title FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN regexp_replace(url, '[0-9]+', '') WHEN page_id % 11 = 3 THEN ' ' ELSE url END AS url FROM pages WHERE page_id % 13 <> 2) WHERE trim(url) <> '' GROUP BY url")
def web_sources(t: Tables) -> DataFrame:
    """Pages as papers: some without a title or a URL, some of one URL."""
    p = t.pages.select("page_id", F.when(F.col("page_id") % 4 == 0, F.regexp_replace("url", "^([^0-9]*)[0-9]+", "$1")).when(F.col("page_id") % 11 == 3, " ").otherwise(F.col("url")).alias("entry_url"), F.when(F.col("page_id") % 13 != 2, F.lpad(F.col("page_id").cast("string"), 9, "0")).alias("title"))
    return fz.web_sources(p.select("title", "page_id", "entry_url")).select("entry_url", "page_id", "title")


@query("SELECT doc_id, 'c' || doc_id AS chunk_uid, CASE WHEN doc_id % 4 > 0 AND (doc_id % 4) % 3 <> 2 THEN doc_id * 10 + doc_id % 4 END AS page_id, CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 END AS page_start, CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 + 2 END AS page_end, CASE WHEN doc_id % 5 = 1 THEN doc_id * 100 + 2 WHEN doc_id % 5 IN (2, 3) THEN doc_id * 100 + 1 END AS element_id FROM documents")
def resolved_keys(t: Tables) -> DataFrame:
    """Chunks with pages, of which every third is not stored, and lists of elements, of which some are not."""
    d, i = t.documents.select("doc_id"), F.col("doc_id")
    pages = d.select("doc_id", F.explode(F.array(F.lit(1), F.lit(3))).alias("page_number")).select("doc_id", "page_number", (i * 10 + F.col("page_number")).alias("page_id"))
    elements = d.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).select("doc_id", F.concat(F.lit("e"), "n").alias("element_uid"), (i * 100 + F.col("n")).alias("element_id"))
    lists = F.when(i % 5 == 1, F.array(F.lit("gone"), F.lit("e2"), F.lit("e1"))).when(i % 5 == 2, F.array(F.lit("e1"))).when(i % 5 == 3, F.array(F.lit("e1"), F.lit("e1"))).when(i % 5 == 4, F.array(F.lit("gone")))
    chunks = d.select("doc_id", F.concat(F.lit("c"), "doc_id").alias("chunk_uid"), F.when(i % 4 > 0, F.array((i % 4 + 2).cast("int"), (i % 4).cast("int"))).otherwise(F.array().cast("array<int>")).alias("page_numbers"), lists.alias("element_uids"))
    return fz.resolved_keys(chunks, pages, elements)


@query(
    f"""WITH {_B}, m AS (SELECT doc_id, page + 1 AS page, uid, y0, y1, 720.0 AS height, CASE WHEN page = 0 AND ord % 8 = 0 THEN 18.0 ELSE 10.0 END AS font, CASE WHEN ord % 8 = 0 THEN 'running title ' || doc_id ELSE {_MARGIN} END AS margin FROM b),
    c AS (SELECT *, CASE WHEN y1 <= height * 0.12 THEN 'header' WHEN y0 >= height * (1 - 0.12) THEN 'footer' END AS kind FROM m WHERE margin <> ''), d AS (SELECT * FROM c WHERE kind IS NOT NULL AND NOT (page = 1 AND font >= 14.0)), n AS (SELECT doc_id, count(DISTINCT page) AS total FROM m GROUP BY 1),
    s AS (SELECT doc_id, kind, margin FROM (SELECT doc_id, kind, margin, count(DISTINCT page) AS pages FROM d GROUP BY ALL) JOIN n USING (doc_id) WHERE pages > 1 AND pages >= 0.6 * total) SELECT doc_id, page, uid, kind FROM d JOIN s USING (doc_id, kind, margin)"""
)
def page_margins(t: Tables) -> DataFrame:
    """A running title on each page, in large letters on the first."""
    b = _blocks(t).withColumn("page", F.col("page") + 1)
    first = F.col("ord") % 8 == 0
    b = b.select("doc_id", "page", "uid", "y0", "y1", F.lit(720.0).alias("height"), F.when((F.col("page") == 1) & first, 18.0).otherwise(10.0).alias("font"), F.when(first, F.concat(F.lit("Running  title "), "doc_id")).otherwise(F.col("text")).alias("text"))
    return fz.page_margins(b, b.select("doc_id").distinct().withColumn("font", F.lit(10.0)), tx.margin_text(F.col("text")))


@query(
    f"""WITH {_B}, n AS (SELECT *, CASE WHEN page % 2 = 0 THEN 2 ELSE 1 END AS n, (x1 - x0) > 0.6 * width AS spanning FROM b), g AS (SELECT *, CASE WHEN n > 1 THEN sum(CASE WHEN spanning THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, uid ROWS UNBOUNDED PRECEDING) ELSE 0 END AS band, CASE WHEN n = 1 OR spanning THEN 0 WHEN (x0 + x1) / 2 < width / 2 THEN 1 ELSE 2 END AS side FROM n)
    SELECT uid, row_number() OVER (PARTITION BY doc_id ORDER BY page, band, side, y0, x0, y1, x1, uid) - 1 AS reading_order FROM g"""
)
def column_order(t: Tables) -> DataFrame:
    """Even pages with two columns, odd ones with one."""
    b = _blocks(t)
    columns = b.select("doc_id", "page").distinct().withColumn("n", F.when(F.col("page") % 2 == 0, 2).otherwise(1))
    return fz.column_order(b, columns).select("uid", "reading_order")


def _gold(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Sources as papers; questions as cases over the documents that hold their number, one in three with something wrong."""
    i = F.col("item_id")
    paper = lambda n: F.concat(F.lit("src"), ((i + n) % 20).cast("string"))
    turn = i % 10
    cross = F.array(paper(0), paper(1), paper(2), paper(3))
    required = F.when(turn == 9, F.array().cast("array<string>")).when(turn < 6, F.array(paper(0))).otherwise(cross)
    seen = F.when(i % 21 == 4, F.array(F.lit("src99"))).otherwise(required)
    cases = t.benchmark.select(
        i.alias("case_id"), "text", F.when(i % 9 == 0, F.lit("the same question")).otherwise(F.col("text")).alias("question"), F.when(i % 5 < 3, "zh").otherwise("en").alias("language"),
        F.when(turn == 9, gd.NO_ANSWER).when(turn < 6, gd.SINGLE).otherwise(gd.CROSS[0]).alias("task_type"), F.when(turn == 9, "no_evidence").when(turn < 6, "any_evidence").otherwise("all_documents").alias("scoring_mode"),
        (turn == 9).alias("insufficient"), F.when((turn == 9) & (i % 4 != 3), "not in the papers").when(i % 23 == 5, "why").alias("reason"), F.when(i % 17 == 3, "draft").otherwise("verified").alias("status"),
        F.array(F.when(i % 19 == 7, " ").otherwise(F.col("text"))).alias("answer_points"), F.when(i % 13 == 2, F.array().cast("array<string>")).otherwise(F.slice(F.split("text", " "), 1, 2)).alias("keywords"), required.alias("required"),
        F.transform(seen, lambda d: F.struct(d.alias("doc"), F.array(F.lit(1), F.lit(2)).alias("pages"))).alias("gold"), F.transform(required, lambda d: F.struct(d.alias("doc"), F.when(i % 11 == 1, 3).otherwise(2).alias("page"))).alias("evidence"),
    )
    corpus = t.documents.select(F.col("source").alias("key")).distinct().select("key", F.upper("key").alias("file_prefix"))
    return corpus, cases


_GC = """g AS (SELECT item_id AS i, item_id % 10 AS turn, CAST(item_id AS VARCHAR) AS id, text FROM benchmark), x AS (SELECT id, unnest([CASE WHEN i % 17 = 3 THEN 'not_verified' END, CASE WHEN i % 19 = 7 THEN 'empty_answer_point' END, CASE WHEN turn = 9 AND i % 21 = 4 THEN 'no_answer_with_gold' END,
    CASE WHEN turn = 9 AND i % 4 = 3 AND i % 23 <> 5 THEN 'no_answer_without_reason' END, CASE WHEN turn < 9 AND i % 23 = 5 THEN 'answerable_with_reason' END, CASE WHEN turn < 9 AND i % 13 = 2 THEN 'keywords_missing' END, CASE WHEN turn < 9 AND i % 21 = 4 THEN 'gold_documents_differ' END,
    CASE WHEN turn < 9 AND (i % 11 = 1 OR i % 21 = 4) THEN 'evidence_page_not_gold' END]) AS fault FROM g)"""


@query(f"WITH {_GC} SELECT id, fault FROM x WHERE fault IS NOT NULL")
def gold_case_faults(t: Tables) -> DataFrame:
    return gd.case_faults(_gold(t)[1])


@query(
    """WITH g AS (SELECT item_id AS i, item_id % 10 AS turn, text FROM benchmark), p AS (SELECT DISTINCT source AS key FROM documents), n AS (SELECT count(*) AS n FROM g),
    r AS (SELECT i, turn, 'src' || ((i + unnest(CASE WHEN turn = 9 THEN [] WHEN turn < 6 THEN [0] ELSE [0, 1, 2, 3] END)) % 20) AS key FROM g), f AS (
    SELECT CAST(count(*) AS VARCHAR) AS id, 'corpus_size' AS fault FROM p HAVING count(*) <> 20 UNION ALL SELECT CAST(n AS VARCHAR), 'case_count' FROM n WHERE n <> 100
    UNION ALL SELECT q, 'question_repeated' FROM (SELECT lower(trim(CASE WHEN i % 9 = 0 THEN 'the same question' ELSE text END)) AS q FROM g) GROUP BY q HAVING count(*) > 1
    UNION ALL SELECT DISTINCT key, 'unknown_document' FROM (SELECT key FROM r UNION ALL SELECT 'src99' FROM g WHERE i % 21 = 4) WHERE key NOT IN (SELECT key FROM p)
    UNION ALL SELECT k, 'language_count' FROM (VALUES ('zh', 60), ('en', 40)) v(k, w) LEFT JOIN (SELECT CASE WHEN i % 5 < 3 THEN 'zh' ELSE 'en' END AS k, count(*) AS c FROM g GROUP BY 1) USING (k) WHERE coalesce(c, 0) <> w
    UNION ALL SELECT k, 'task_count' FROM (VALUES ('single', 60), ('cross', 30), ('none', 10)) v(k, w) LEFT JOIN (SELECT CASE WHEN turn = 9 THEN 'none' WHEN turn < 6 THEN 'single' ELSE 'cross' END AS k, count(*) AS c FROM g GROUP BY 1) USING (k) WHERE coalesce(c, 0) <> w
    UNION ALL SELECT k, 'breadth_count' FROM (VALUES ('2-3', 18), ('4', 8), ('5-6', 4)) v(k, w) LEFT JOIN (SELECT '4' AS k, count(*) AS c FROM g WHERE turn BETWEEN 6 AND 8) USING (k) WHERE coalesce(c, 0) <> w
    UNION ALL SELECT key, 'single_cases_of_paper' FROM p LEFT JOIN (SELECT key, count(*) AS c FROM r WHERE turn < 6 GROUP BY 1) USING (key) WHERE coalesce(c, 0) <> 3
    UNION ALL SELECT key, 'cross_cases_of_paper' FROM p LEFT JOIN (SELECT key, count(*) AS c FROM r WHERE turn BETWEEN 6 AND 8 GROUP BY 1) USING (key) WHERE coalesce(c, 0) < 3) SELECT id, fault FROM f"""
)
def gold_dataset_faults(t: Tables) -> DataFrame:
    return gd.dataset_faults(*_gold(t))


@query(
    r"""WITH s AS (SELECT source AS case_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY coalesce(CASE WHEN doc_id % 9 = 0 THEN NULL ELSE n_chars % 50 / 10.0 END, 0.0) DESC, doc_id) AS place, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS line FROM documents)
    SELECT case_id, place, doc_id AS source, substring(line, 1, 260) AS excerpt FROM s WHERE place <= 5"""
)
def compressed_evidence(t: Tables) -> DataFrame:
    """The five best documents of each source, some without a score and many with equal ones."""
    score = F.when(F.col("doc_id") % 9 != 0, (F.col("n_chars") % 50) / 10.0)
    items = t.documents.select(F.col("source").alias("case_id"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("source"), score.alias("score"), F.col("text").alias("content"))
    return evidence.compressed(items, "case_id")
