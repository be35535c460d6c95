"""Exact vector search for a bounded set of queries, and checks of a vector index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.operators.bm25 import small
from lodestrand.runtime import materialize, ship

#: Queries that are compared with a batch of vectors at a time, and that one broadcast holds.
QUERY_BLOCK, QUERY_ROWS = 512, 50_000


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column in double precision, scaled to length 1; null, empty and zero vectors are zero."""
    out = np.zeros((len(column), width))
    sizes = np.diff(column.offsets.to_numpy())
    full = np.flatnonzero(sizes == width) if width else np.empty(0, np.int64)
    flat = column.flatten().cast(pa.float64()).fill_null(0.0).to_numpy()
    starts = np.cumsum(np.concatenate([[0], sizes]))[:-1]
    out[full] = flat[starts[full][:, None] + np.arange(width)[None, :]]
    length = np.sqrt((out * out).sum(1))
    return out / np.where(length > 0, length, 1.0)[:, None]


def nearest(vectors: DataFrame, queries: DataFrame, top_k: int = 15, id_col: str = "vec_id", vector_col: str = "embedding", same: str | None = None) -> DataFrame:
    """query_id, vec_id, similarity, rank by cosine; ties go by vec_id.

    queries: query_id, query_vector (and `same`, a column that must agree before the
    ranking). The queries are a stated set against all rows: broadcast, QUERY_ROWS at most
    at a time, and multiplied with each batch of vectors in blocks. A batch passes on only
    the rows that may be among a query's best, so the shuffle is small. Null and zero
    vectors are similar to nothing (0); a vector of another width counts as zero.
    """
    ship(vectors.sparkSession)
    slim = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v"), *([F.col(same).cast("string").alias("same")] if same else []))
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("query_vector").alias("v"), *([F.col(same).cast("string").alias("same")] if same else []))
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    pairs = None
    for i in range(parts):
        table = (asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)).toArrow().combine_chunks()
        value = _Queries.of(vectors.sparkSession, table, same is not None)
        found = slim.mapInArrow(_best(value, top_k), "query_id bigint, vec_id bigint, similarity double")
        if parts > 1:  # one block of queries is alive at a time
            found = materialize(_cut(found, top_k).drop("rank"), "nearest")
            value.destroy()
        pairs = found if pairs is None else pairs.unionByName(found)
    return _cut(pairs, top_k)


def _cut(pairs: DataFrame, top_k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def faults(vectors: DataFrame, width: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, fault of vectors that a ranking can't use: `null`, `width` (another number of values), `value` (null, infinite or no number), `zero`, and `repeated` ids."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fault = F.when(v.isNull(), "null").when(F.size(v) != width, "width").when(bad, "value").when(~F.exists(v, lambda x: x != 0), "zero")
    own = vectors.select(F.col(id_col).alias("vec_id"), fault.alias("fault")).where("fault IS NOT NULL")
    return own.unionByName(vectors.groupBy(F.col(id_col).alias("vec_id")).count().where("count > 1").select("vec_id", F.lit("repeated").alias("fault")))


@dataclass
class _Queries:
    ids: np.ndarray
    matrix: np.ndarray
    same: np.ndarray | None

    @classmethod
    def of(cls, spark: SparkSession, table: pa.Table, same: bool) -> Broadcast:
        column = table["v"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64()))
        width = int(np.diff(column.offsets.to_numpy()).max(initial=0))
        ids = table["query_id"].to_numpy() if table.num_rows else np.empty(0, np.int64)
        return spark.sparkContext.broadcast(cls(ids, _matrix(column, width), np.array(table["same"].to_pylist(), object) if same else None))


def _best(value: Broadcast, top_k: int):
    """(query, vector, similarity) of the rows of a batch that a query may rank among its best, all ties included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = value.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, m = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1), q.matrix.shape[1])
            labels = np.array(b.column(2).to_pylist(), object) if q.same is not None else None
            for lo in range(0, len(q.ids), QUERY_BLOCK):
                near = np.round(m @ q.matrix[lo : lo + QUERY_BLOCK].T, 9) + 0.0
                if labels is not None:
                    mine = q.same[lo : lo + QUERY_BLOCK]
                    near[(labels[:, None] != mine[None, :]) | (labels == None)[:, None]] = -np.inf  # noqa: E711
                least = np.partition(near, -top_k, axis=0)[-top_k] if len(near) > top_k else np.full(near.shape[1], -np.inf)
                row, column = np.nonzero((near >= least[None, :]) & (near > -np.inf))
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(q.ids[lo + column]), pa.array(ids[row]), pa.array(near[row, column])], names=["query_id", "vec_id", "similarity"])

    return run


def fingerprints(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the SHA-256 of its text."""
    return rows.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("sha"))


def audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """id and fault (missing, unexpected, changed) of an index against its source; none where they agree."""
    e, a = expected.select("id", F.col("sha").alias("e")), actual.select("id", F.col("sha").alias("a"))
    both = e.join(a, "id", "full_outer")
    return both.where(~F.col("e").eqNullSafe(F.col("a"))).select("id", F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").otherwise("changed").alias("fault"))


def replace_group(stored: DataFrame, incoming: DataFrame, group: str) -> DataFrame:
    """Stored rows without the groups that arrive, and the incoming rows: an upsert that purges what is stale."""
    return stored.join(small(incoming.select(group).distinct()), group, "left_anti").unionByName(incoming)
