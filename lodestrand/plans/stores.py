"""Stored tables that change as one: documents with what belongs to them. Labels and pages belong to the documents of their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.segments import DocumentStore
from lodestrand.plans.registry import Tables, query
from lodestrand.runtime import work_path


def _stored(t: Tables) -> DocumentStore:
    store = DocumentStore(t.spark, work_path(t.spark, "documents"), ("documents", "labels", "pages"), fan=2)
    d = t.documents.select("doc_id", "source", F.lit("first").alias("written"))
    labels, pages = t.labels.select("doc_id", "toxic"), t.pages.select(F.col("page_id").alias("doc_id"), "url")
    store.persist({"documents": d, "labels": labels, "pages": pages})
    again = d.where("source = 'src3'").withColumn("written", F.lit("second"))
    store.persist({"documents": again, "labels": labels.withColumn("toxic", F.lit(2).cast(labels.schema["toxic"].dataType)), "pages": pages.where("false")})
    return store


_REST = "doc_id % 9 <> 4"


@query(
    f"""SELECT 'documents' AS part, doc_id, CASE WHEN source = 'src3' THEN 'second' ELSE 'first' END AS value FROM documents WHERE {_REST}
    UNION ALL SELECT 'labels', l.doc_id, CAST(CASE WHEN d.source = 'src3' THEN 2 ELSE l.toxic END AS VARCHAR) FROM labels l JOIN documents d USING (doc_id) WHERE l.{_REST}
    UNION ALL SELECT 'pages', d.doc_id, p.url FROM pages p JOIN documents d ON d.doc_id = p.page_id WHERE d.source <> 'src3' AND d.{_REST}"""
)
def document_store(t: Tables) -> DataFrame:
    """Three tables after a source's documents came again (with their labels, without pages) and some documents were deleted."""
    store = _stored(t)
    store.delete(t.documents.where("doc_id % 9 = 4").select("doc_id"))
    part = lambda name, value: store.rows(name).select(F.lit(name).alias("part"), "doc_id", F.col(value).cast("string").alias("value"))
    return part("documents", "written").unionByName(part("labels", "toxic")).unionByName(part("pages", "url"))


@query(
    """SELECT 'documents' AS "table", count(*) AS deleted FROM documents WHERE doc_id % 9 = 4
    UNION ALL SELECT 'labels', count(*) FROM labels JOIN documents USING (doc_id) WHERE doc_id % 9 = 4
    UNION ALL SELECT 'pages', count(*) FROM pages JOIN documents ON doc_id = page_id WHERE doc_id % 9 = 4 AND source <> 'src3'"""
)
def cascade_counts(t: Tables) -> DataFrame:
    """Rows of each table that go with deleted documents."""
    return _stored(t).delete(t.documents.where("doc_id % 9 = 4").select("doc_id"))
