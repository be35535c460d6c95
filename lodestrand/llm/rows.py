"""Whole rows that stay or go: names that clash with no column, and decisions by id and text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.runtime import materialize


def private(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names that no column of the frame has, in any case."""
    there = {c.lower() for c in docs.columns}
    mark = uuid.uuid4().hex[:8]
    while any(f"{n}_{mark}" in there for n in names):
        mark = uuid.uuid4().hex[:8]
    return tuple(f"{n}_{mark}" for n in names)


def own(docs: DataFrame) -> list[Column]:
    """The frame's columns, whatever they are called."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def text_key(text: Column) -> Column:
    """128 bits of a text; null is the empty one."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id and text are not in gone; of equal ones in repeated, one.

    gone and repeated have doc_id and text_key and no pair twice; null ids are equal. All
    columns of docs stay as they are.
    """
    id_, key, g_id, g_key, fate = private(docs, "id", "key", "fate_id", "fate_key", "fate")
    named = lambda df, n: df.select(F.col("doc_id").alias(g_id), F.col("text_key").alias(g_key), F.lit(n).alias(fate))
    fates = named(gone, 0) if repeated is None else named(gone, 0).unionByName(named(repeated, 1))
    rows = docs.select(*own(docs), F.col(id_col).cast("bigint").alias(id_), text_key(F.col(text_col)).alias(key))
    on = (F.col(key) == F.col(g_key)) & F.col(id_).eqNullSafe(F.col(g_id))
    if repeated is None:
        return rows.join(fates.hint("shuffle_hash"), on, "left_anti").select(*own(docs))
    joined = rows.join(fates.hint("shuffle_hash"), on, "left")
    once = joined.where(F.col(fate) == 1).dropDuplicates([id_, key])
    return joined.where(F.col(fate).isNull()).select(*own(docs)).unionByName(once.select(*own(docs)))


def one_each(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of marks, and every row that is in none.

    marks: doc_id, text_key, component (null: in no group), first (whether the row may stand
    for its group). Of several such rows the one of the least text_key stays, and of rows
    equal in id and text one.
    """
    grouped = marks.where("component IS NOT NULL")
    several = grouped.where("first").groupBy("component", "doc_id", "text_key").count()
    best = several.groupBy(F.col("component").alias("c")).agg(F.min("text_key").alias("k"), F.sum("count").alias("n")).where("n > 1")
    several = materialize(several.join(best, F.col("component") == F.col("c")).select("doc_id", "text_key", F.col("text_key") == F.col("k"), "count").toDF("doc_id", "text_key", "best", "count"), "several")
    gone = grouped.where("NOT first").select("doc_id", "text_key").distinct()
    if several.isEmpty():
        return without(docs, gone, None, id_col, text_col)
    gone = gone.unionByName(several.where("NOT best").select("doc_id", "text_key"))
    return without(docs, gone, several.where("best AND count > 1").select("doc_id", "text_key"), id_col, text_col)
