"""Retrieval queries: lexical, vector, fusion, hybrid. Items of benchmark are the questions, sources the titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import numeric as nm
from lodestrand.functions import text as tx
from lodestrand.operators import bm25 as lx
from lodestrand.operators import fusion, hybrid, segments, vectors
from lodestrand.plans.registry import Tables, query
from lodestrand.runtime import work_path

P = tx.WORD_PATTERN.replace("'", "''")
TOK = f"list_transform(regexp_extract_all(coalesce(%s, ''), '{P}'), lambda x: lower(x))"
BODY, TITLE, ITEM = TOK % "text", TOK % "source", TOK % "text"

DISTINCT8 = f"""(SELECT item_id, term, pos FROM (
    SELECT item_id, term, pos, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS n FROM (
        SELECT item_id, term, min(pos) AS pos FROM (
            SELECT item_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT item_id, {ITEM} AS t FROM benchmark)) GROUP BY ALL)) WHERE n <= %d)"""

CORE = f"""
tok AS (SELECT doc_id, source, {TITLE} AS t, {BODY} AS b FROM documents),
len AS (SELECT doc_id, len(t) + len(b) AS length FROM tok),
stats AS (SELECT count(*) AS n, avg(length) AS avgdl FROM len),
post AS (SELECT term, doc_id, sum(tt) AS ttf, sum(bb) AS btf FROM (
    SELECT doc_id, unnest(t) AS term, 1 AS tt, 0 AS bb FROM tok UNION ALL SELECT doc_id, unnest(b), 0, 1 FROM tok) GROUP BY ALL),
hits AS (SELECT post.* FROM post WHERE term IN (SELECT term FROM terms)),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
idf AS (SELECT term, avgdl, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, stats),
part AS (SELECT hits.term, hits.doc_id, idf * (5.0 * ttf + btf) * 2.2 / ((5.0 * ttf + btf) + 1.2 * (0.25 + 0.75 * length / avgdl)) AS p
         FROM hits JOIN idf USING (term) JOIN len USING (doc_id)),
scored AS (SELECT query_id, set_id, doc_id, round(-sum(p), 9) AS score FROM part JOIN terms USING (term) %s GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, set_id ORDER BY score, doc_id) AS rank FROM scored)
"""
TERMS = f"terms AS (SELECT item_id AS query_id, 1 AS set_id, term FROM {DISTINCT8 % 8})"
TERMS2 = f"terms AS (SELECT item_id AS query_id, 1 AS set_id, term FROM {DISTINCT8 % 8} UNION ALL SELECT item_id, 2, term FROM {DISTINCT8 % 12})"
RANKED = CORE % ""


def bm25_ranking(t: Tables, n: int = 8) -> DataFrame:
    return lx.bm25(lx.Index.stored(t.documents), lx.term_sets(t.benchmark, n))


def plans(t: Tables) -> DataFrame:
    """A plan for each item: its first 8 distinct tokens as lexical terms, the next 4 as synonyms."""
    words = F.array_distinct(tx.word_tokens(F.col("text")))
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.slice(words, 1, 8).alias("lexical"), F.slice(words, 9, 4).alias("synonyms"))


def vector_queries(t: Tables) -> DataFrame:
    """Vectors whose id is an item's stand for its question."""
    return t.embeddings.join(lx.small(t.benchmark.select(F.col("item_id").alias("vec_id"))), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


COS = "round(CASE WHEN {n} > 0 THEN {d} / ({n}) ELSE 0.0 END, 9)"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
_d = DOT.format(a="q.v", b="e.v")
_n = "sqrt(" + DOT.format(a="q.v", b="q.v") + ") * sqrt(" + DOT.format(a="e.v", b="e.v") + ")"
SIM = COS.format(d=_d, n=_n)
VEC = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({BODY}) AS term FROM documents) GROUP BY term")
def tokenize_terms(t: Tables) -> DataFrame:
    each = t.documents.select("doc_id", F.explode(tx.word_tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


@query(f"SELECT term, doc_id, CAST(sum(tt) AS BIGINT) AS tf_title, CAST(sum(bb) AS BIGINT) AS tf_body FROM (SELECT doc_id, unnest({TITLE}) AS term, 1 AS tt, 0 AS bb FROM documents UNION ALL SELECT doc_id, unnest({BODY}), 0, 1 FROM documents) GROUP BY ALL")
def bm25_postings(t: Tables) -> DataFrame:
    return lx.postings(t.documents)


@query(f"SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, round(avg(n), 6) AS avgdl FROM (SELECT len({TITLE}) + len({BODY}) AS n FROM documents)")
def doc_length_stats(t: Tables) -> DataFrame:
    return lx.collection_stats(t.documents).withColumn("avgdl", F.round("avgdl", 6))


@query(f"WITH {TERMS}, {RANKED} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 20")
def bm25_topk(t: Tables) -> DataFrame:
    return bm25_ranking(t).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {TERMS}, {CORE % "JOIN documents d USING (doc_id) WHERE d.source = 'src' || (query_id % 20)"} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 20")
def bm25_scoped_topk(t: Tables) -> DataFrame:
    """Each question ranks the documents of one source only; the statistics stay the collection's."""
    scope = t.documents.select("doc_id", "source").join(t.benchmark.select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source")), "source").select("query_id", "doc_id")
    return lx.bm25(lx.Index.stored(t.documents), lx.term_sets(t.benchmark), scope=scope).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TITLE}) AS term FROM documents UNION ALL SELECT doc_id, unnest({BODY}) FROM documents) GROUP BY term")
def bm25_index_build(t: Tables) -> DataFrame:
    """Every term of a stored index that is built for the purpose."""
    return lx.Index.of(t.documents).save(work_path(t.spark, "lexical-index")).terms


# An index that changed: every third document has new text, every fifth is gone, and some are there for the first time.
_CHANGED = """changed AS (
    SELECT doc_id, source, lang, n_chars, CASE WHEN doc_id % 3 = 0 THEN lang || ' revised ' || coalesce(text, '') || ' ' || lang ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0
    UNION ALL SELECT doc_id + 10000000, source, lang, n_chars, source || ' added ' || coalesce(text, '') FROM documents WHERE doc_id % 7 = 1)"""


def _changed_index(t: Tables, path: str) -> segments.LexicalLog:
    d = t.documents
    log = segments.LexicalLog(t.spark, path, fan=2)
    log.upsert(d)
    log.upsert(d.where("doc_id % 3 = 0").withColumn("text", F.concat("lang", F.lit(" revised "), F.coalesce("text", F.lit("")), F.lit(" "), "lang")))
    log.delete(d.where("doc_id % 5 = 0").select("doc_id"))
    log.upsert(d.where("doc_id % 7 = 1").withColumn("text", F.concat("source", F.lit(" added "), F.coalesce("text", F.lit("")))).withColumn("doc_id", F.col("doc_id") + 10_000_000))
    return log


@query(f"WITH {_CHANGED}, {TERMS}, {RANKED.replace('FROM documents', 'FROM changed')} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 20")
def index_upsert(t: Tables) -> DataFrame:
    """Rankings over an index after batches that replaced, deleted and added documents."""
    log = _changed_index(t, work_path(t.spark, "lexical-log"))
    return lx.bm25(log.index(), lx.term_sets(t.benchmark)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TITLE}) AS term FROM d UNION ALL SELECT doc_id, unnest({BODY}) FROM d) GROUP BY term".join(("WITH d AS (SELECT * FROM documents WHERE source <> 'src3' AND doc_id % 4 <> 0) ", "")))
def index_delete(t: Tables) -> DataFrame:
    """Terms of an index from which a source's and every fourth document were deleted."""
    log = segments.LexicalLog(t.spark, work_path(t.spark, "lexical-log"), owner="source", fan=3)
    log.upsert(t.documents)
    log.upsert(t.documents.where("false"), purge=t.spark.createDataFrame([("src3",)], "owner string"))
    log.delete(t.documents.where("doc_id % 4 = 0").select("doc_id"))
    return log.index().terms


@query("SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM embeddings WHERE label <> 1 OR vec_id % 3 = 0")
def vector_upsert(t: Tables) -> DataFrame:
    """Vectors of which every third came again; of one label only those that came again stay."""
    log = segments.VectorLog(t.spark, work_path(t.spark, "vector-log"), owner="label", fan=2)
    rows = t.embeddings.withColumn("meta", F.create_map(F.lit("state"), F.lit("old"), F.lit("note"), F.lit(None).cast("string")))
    again = rows.where("vec_id % 3 = 0").withColumn("meta", F.create_map(F.lit("state"), F.lit("new"), F.lit("note"), F.lit(None).cast("string")))
    log.upsert(rows, metadata="meta")
    log.upsert(again.where("label <> 1"), metadata="meta")
    log.upsert(again.where("label = 1"), purge=True, metadata="meta")
    return log.rows().where("size(meta) = 1").select("vec_id", "label", F.col("meta")["state"].alias("state"))


@query()
def bm25_mixed_topk(t: Tables) -> DataFrame:
    """The ranking by the full tokenizer: compatibility forms, words with their stems, CJK runs cut by the corpus's own vocabulary."""
    index = lx.Index.stored(t.documents, segment=True)
    return lx.bm25(index, lx.term_sets(t.benchmark, mixed=True, words=index.words)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query()
def hybrid_mixed(t: Tables) -> DataFrame:
    """Hybrid retrieval with the full tokenizer in the lexical channel."""
    index = lx.Index.stored(t.documents, segment=True)
    lexical = lx.bm25(index, lx.term_sets(t.benchmark, mixed=True, words=index.words)).withColumnRenamed("set_id", "list_id")
    semantic = vectors.nearest(t.embeddings, vector_queries(t)).select("query_id", F.lit(0).alias("list_id"), F.col("vec_id").alias("doc_id"), "rank")
    out = hybrid.hybrid_search(hybrid.channels(lexical, semantic), t.documents.select("doc_id", "lang", "n_chars"), places=True)
    return out.select("query_id", "doc_id", "fusion_rank", "final_rank", "lang", "n_chars")


@query(f"WITH {TERMS2}, {RANKED} SELECT query_id, set_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 20")
def bm25_synonym_pair(t: Tables) -> DataFrame:
    return lx.bm25(lx.Index.stored(t.documents), lx.synonym_sets(plans(t))).select("query_id", "set_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH p AS (SELECT item_id AS query_id, ({ITEM})[1:2] AS words FROM benchmark),
    d AS (SELECT doc_id, {BODY} AS b FROM documents),
    a AS (SELECT doc_id, b, unnest(b) AS term, generate_subscripts(b, 1) AS pos FROM d)
    SELECT query_id, doc_id, count(*) AS n FROM a JOIN p ON a.term = p.words[1] AND b[pos:pos + len(words) - 1] = words GROUP BY ALL"""
)
def phrase_match(t: Tables) -> DataFrame:
    return lx.phrase_hits(t.documents, t.benchmark.select(F.col("item_id").alias("query_id"), F.slice(tx.word_tokens(F.col("text")), 1, 2).alias("words")).where("size(words) > 0"))


@query(f"WITH {VEC}, q AS (SELECT vec_id AS query_id, v FROM e WHERE vec_id % 100 = 0) SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (SELECT q.query_id, e.vec_id, {SIM} AS similarity FROM q, e)) WHERE rank <= 15")
def vector_topk(t: Tables) -> DataFrame:
    """Queries are the vectors whose id is divisible by 100, against all."""
    q = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vectors.nearest(t.embeddings, q).withColumn("similarity", F.round("similarity", 6))


_SPOILT = """v AS (SELECT vec_id, CASE vec_id % 11 WHEN 3 THEN NULL WHEN 4 THEN e[1:5] WHEN 5 THEN list_transform(e, lambda x: 0.0) WHEN 6 THEN list_transform(e, lambda x: CASE WHEN x > 0 THEN NULL ELSE x END) ELSE e END AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
w AS (SELECT max(len(embedding)) AS w FROM embeddings)"""


@query(f"WITH {_SPOILT} SELECT vec_id, fault FROM (SELECT vec_id, CASE WHEN v IS NULL THEN 'null' WHEN len(v) <> w THEN 'width' WHEN len(list_filter(v, lambda x: x IS NULL)) > 0 THEN 'value' WHEN len(list_filter(v, lambda x: x <> 0)) = 0 THEN 'zero' END AS fault FROM v, w) WHERE fault IS NOT NULL UNION ALL SELECT vec_id, 'repeated' FROM embeddings WHERE vec_id % 17 = 2")
def vector_faults(t: Tables) -> DataFrame:
    """Vectors of which some are null, short, zero or have a hole, and some come twice."""
    e, i = t.embeddings, F.col("vec_id") % 11
    width = e.agg(F.max(F.size("embedding"))).first()[0]
    v = F.col("embedding")
    spoilt = F.when(i == 3, None).when(i == 4, F.slice(v, 1, 5)).when(i == 5, F.transform(v, lambda x: x * 0)).when(i == 6, F.transform(v, lambda x: F.when(x > 0, None).otherwise(x))).otherwise(v)
    rows = e.withColumn("embedding", spoilt)
    return vectors.faults(rows.unionByName(rows.where("vec_id % 17 = 2 AND vec_id % 11 NOT IN (3, 4, 5, 6)")).unionByName(e.where("vec_id % 17 = 2 AND vec_id % 11 IN (3, 4, 5, 6)")), width)


@query(f"WITH {VEC}, q AS (SELECT vec_id AS query_id, v, label FROM e WHERE vec_id % 100 = 0) SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (SELECT q.query_id, e.vec_id, {SIM} AS similarity FROM q JOIN e ON q.label = e.label)) WHERE rank <= 15")
def vector_scoped_topk(t: Tables) -> DataFrame:
    """As vector_topk, with the filter on the label before the ranking."""
    q = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")
    return vectors.nearest(t.embeddings, q, same="label").withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {VEC} SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 4) AS norm2, round(least(greatest(1 - (1 - v[1]) / 2, 0.0), 1.0), 6) AS l2_similarity, round(least(greatest(v[1], 0.0), 1.0), 6) AS cosine_similarity FROM e")
def distance_to_similarity(t: Tables) -> DataFrame:
    v = F.col("embedding")
    distance = 1 - v[0].cast("double")
    return t.embeddings.select("vec_id", F.round(nm.dot(v, v), 4).alias("norm2"), F.round(nm.similarity(distance, "l2"), 6).alias("l2_similarity"), F.round(nm.similarity(distance), 6).alias("cosine_similarity"))


@query(
    f"""WITH {VEC}, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
    c AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, round(avg(x), 9) AS m FROM x GROUP BY ALL) GROUP BY label)
    SELECT e.vec_id, e.label, round({COS.format(d=DOT.format(a='c.v', b='e.v'), n='sqrt(' + DOT.format(a='c.v', b='c.v') + ') * sqrt(' + DOT.format(a='e.v', b='e.v') + ')')}, 6) AS similarity FROM e JOIN c USING (label)"""
)
def centroid_similarity(t: Tables) -> DataFrame:
    x = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    c = x.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return t.embeddings.join(c, "label").select("vec_id", "label", F.round(F.round(nm.cosine(F.col("c"), F.col("embedding")), 9), 6).alias("similarity"))


RRF_IN = "(SELECT query_id, list_id, doc_id, row_number() OVER (PARTITION BY query_id, list_id ORDER BY rank, doc_id) AS place FROM (SELECT query_id, list_id, doc_id, min(rank) AS rank FROM {lists} GROUP BY ALL))"
RRF_SCORE = "(SELECT query_id, doc_id, round(sum(1.0 / (60 + place)), 12) AS score, min(list_id * 100000 + place) AS first_seen FROM " + RRF_IN + " GROUP BY ALL)"
RRF = "(SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_seen, CAST(doc_id AS VARCHAR)) AS rank FROM " + RRF_SCORE + ")"
LISTS = "lists AS (SELECT query_id, set_id AS list_id, doc_id, rank FROM ranked WHERE rank <= 20)"


@query(f"WITH {TERMS2}, {RANKED}, {LISTS} SELECT query_id, doc_id, round(score, 9) AS score, rank FROM {RRF.format(lists='lists')}")
def rrf_two_lists(t: Tables) -> DataFrame:
    """Fusion of the lexical list with the list of lexical terms and synonyms."""
    lists = lx.bm25(lx.Index.stored(t.documents), lx.synonym_sets(plans(t))).withColumnRenamed("set_id", "list_id")
    return fusion.rrf(lists).withColumn("score", F.round("score", 9))


VECQ = "vq AS (SELECT vec_id AS query_id, v FROM e WHERE vec_id IN (SELECT item_id FROM benchmark)), vhits AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (SELECT q.query_id, e.vec_id, " + SIM + " AS similarity FROM vq q, e))"
HYBRID = f"""WITH {TERMS2}, {RANKED}, {LISTS}, {VEC}, {VECQ},
b AS (SELECT query_id, 0 AS list_id, doc_id, rank FROM {RRF.format(lists='lists')}),
vl AS (SELECT query_id, 0 AS list_id, doc_id, rank FROM vhits WHERE rank <= 15),
w AS (SELECT query_id, 1 AS list_id, doc_id, rank FROM {RRF.format(lists='vl')}),
u AS (SELECT * FROM b UNION ALL SELECT * FROM w),
f AS (SELECT f.query_id, f.doc_id, f.score, f.rank AS fusion_rank, b.rank AS bm25_rank, w.rank AS vector_rank FROM {RRF.format(lists='u')} f
      LEFT JOIN b ON f.query_id = b.query_id AND f.doc_id = b.doc_id LEFT JOIN w ON f.query_id = w.query_id AND f.doc_id = w.doc_id)"""


def rankings(t: Tables) -> DataFrame:
    lexical = lx.bm25(lx.Index.stored(t.documents), lx.synonym_sets(plans(t))).withColumnRenamed("set_id", "list_id")
    semantic = vectors.nearest(t.embeddings, vector_queries(t)).select("query_id", F.lit(0).alias("list_id"), F.col("vec_id").alias("doc_id"), "rank")
    return hybrid.channels(lexical, semantic)


@query(f"{HYBRID} SELECT query_id, doc_id, round(score, 9) AS score, fusion_rank, bm25_rank, vector_rank FROM f")
def rrf_two_level(t: Tables) -> DataFrame:
    return hybrid.fuse(rankings(t), places=True).withColumn("score", F.round("score", 9))


@query(
    f"""{HYBRID}, s AS (SELECT f.*, d.lang, d.n_chars FROM f JOIN documents d USING (doc_id)),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_rank) AS final_rank FROM s)
    SELECT query_id, doc_id, fusion_rank, final_rank, lang, n_chars FROM c WHERE final_rank <= 5"""
)
def hybrid_topk(t: Tables) -> DataFrame:
    out = hybrid.hybrid_search(rankings(t), t.documents.select("doc_id", "lang", "n_chars"), places=True)
    return out.select("query_id", "doc_id", "fusion_rank", "final_rank", "lang", "n_chars")


@query(
    f"""{HYBRID}, s AS (SELECT f.*, {TOK % 'd.text'} AS words FROM f JOIN documents d USING (doc_id)),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_rank) AS n FROM s) WHERE n <= 20),
    q AS (SELECT item_id AS query_id, list_distinct({ITEM}) AS terms FROM benchmark),
    r AS (SELECT c.query_id, doc_id, fusion_rank, round(len(list_intersect(terms, words)) / greatest(len(terms), 1), 9) AS rerank_score FROM c JOIN q USING (query_id))
    SELECT query_id, doc_id, fusion_rank, round(rerank_score, 6) AS rerank_score, final_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, fusion_rank) AS final_rank FROM r) WHERE final_rank <= 5"""
)
def hybrid_reranked(t: Tables) -> DataFrame:
    questions = t.benchmark.select(F.col("item_id").alias("query_id"), F.array_distinct(tx.word_tokens(F.col("text"))).alias("terms"))
    out = hybrid.hybrid_search(rankings(t), t.documents.select("doc_id", "text"), places=True, reranker=hybrid.lexical_overlap(questions))
    return out.select("query_id", "doc_id", "fusion_rank", F.round("rerank_score", 6).alias("rerank_score"), "final_rank")


@query(f"{HYBRID} SELECT query_id, doc_id, fusion_rank, source, lang FROM f JOIN documents d USING (doc_id) WHERE d.source IS NOT NULL")
def late_materialize(t: Tables) -> DataFrame:
    """Fused ids joined with storage; missing ids go and ranks keep their gaps."""
    return fusion.late_rows(hybrid.fuse(rankings(t), places=True).select("query_id", "doc_id", "fusion_rank"), t.documents.where("source IS NOT NULL").select("doc_id", "source", "lang"))


@query(
    f"""{HYBRID}, r AS (SELECT query_id, doc_id, fusion_rank, CASE WHEN bm25_rank IS NOT NULL THEN round(least(n_chars, 20000) / 20000.0, 6) END AS rerank_score FROM f JOIN documents d USING (doc_id))
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, fusion_rank) AS final_rank FROM r"""
)
def rerank_merge(t: Tables) -> DataFrame:
    """Only what the lexical channel found is reranked, by length; the rest follows in fusion order."""
    fused = hybrid.fuse(rankings(t), places=True).join(t.documents.select("doc_id", "n_chars"), "doc_id").select("query_id", "doc_id", F.col("fusion_rank").alias("rank"), "bm25_rank", "n_chars")
    scored = fused.where("bm25_rank IS NOT NULL").select("query_id", "doc_id", F.round(F.least("n_chars", F.lit(20000)) / 20000.0, 6).alias("rerank_score"))
    return fusion.rerank_merge(fused.drop("bm25_rank", "n_chars"), scored).withColumnRenamed("rank", "fusion_rank")


@query("SELECT doc_id AS id, CASE WHEN source = 'src7' THEN 'missing' ELSE 'changed' END AS fault FROM documents WHERE source IN ('src7', 'src9') UNION ALL SELECT -doc_id - 1, 'unexpected' FROM documents WHERE source = 'src11'")
def fingerprint_audit(t: Tables) -> DataFrame:
    """An index that lacks one source, holds another changed, and holds ids that the store lacks."""
    d = t.documents.select("doc_id", "text", "source")
    stored = d.where("source <> 'src7'").withColumn("text", F.when(F.col("source") == "src9", F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    extra = d.where("source = 'src11'").withColumn("doc_id", -F.col("doc_id") - 1)
    return vectors.audit(vectors.fingerprints(d, "doc_id", "text"), vectors.fingerprints(stored.unionByName(extra), "doc_id", "text"))
