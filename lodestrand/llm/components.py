"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodestrand.llm import wordcore
from lodestrand.runtime import lifetime, materialize, release, ship

#: Edges of a node that one task may take; nodes with more are hubs.
DEGREE = 1_000
#: Hubs that are broadcast at most. The degree that makes a hub grows with the edges so that there are never more.
HUBS = 100_000
#: Edges that a task joins up before it hands them on.
HELD = 200_000


def _least(edges: DataFrame, degree: int) -> DataFrame:
    """Each (u, v) with m, the least of u and u's neighbours.

    A node of more than `degree` edges learns m by broadcast, so that its edges stay where they lie.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("__u"), F.least("u", "m").alias("m"), "n")
    hubs = materialize(least.where(F.col("n") > degree).select(F.col("__u").alias("__h"), "m"), "hubs")
    if hubs.isEmpty():
        release(hubs)
        return edges.join(least, F.col("u") == F.col("__u")).select("u", "v", "m")
    few = F.broadcast(hubs)  # at most edges / degree rows, which is HUBS or fewer
    of_hubs = edges.join(few, F.col("u") == F.col("__h")).select("u", "v", "m")
    rest = edges.join(few, F.col("u") == F.col("__h"), "left_anti")
    own = rest.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("__u"), F.least("u", "m").alias("m"))
    return rest.join(own, F.col("u") == F.col("__u")).select("u", "v", "m").unionByName(of_hubs)


def _large_star(edges: DataFrame, degree: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both, degree).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, degree: int) -> DataFrame:
    """edges have u > v, as large stars do."""
    stars = _least(edges, degree)
    return stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is also a u; edges are distinct."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("u"), F.lit(0).alias("v")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("u"), F.lit(1).alias("v")))
    return ends.groupBy("x").agg(F.sum("u").alias("u"), F.max("v").alias("v")).where("u > 1 OR (u = 1 AND v = 1)").isEmpty()


def _joined_up(schema: pa.Schema):
    """Edges of a task, HELD at a time, as stars: each node with the least one that they link it to."""

    def stars(edges: list[tuple]) -> pa.RecordBatch:
        root: dict = {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for u, v in edges:
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
        links = [(u, v) for u in root if (v := find(u)) != u]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*links), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple] = []
        for b in batches:
            edges += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            if len(edges) >= HELD:
                yield stars(edges)
                edges = []
        if edges:
            yield stars(edges)

    return run


def connected_components(edges: DataFrame, name: str = "components", degree: int = DEGREE) -> DataFrame:
    """node, label for each node of an undirected edge table (u, v); the label is the component's least node.

    Self-loops and repeated edges are allowed; nodes without another are not returned. Each
    task first joins up the edges it has, so that only links between tasks are left to the
    rounds. Each round is written to the shared folder and the one before it deleted; the
    number of rounds grows with the logarithm of the longest path.
    """
    ship(edges.sparkSession)
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = down.mapInArrow(wordcore.tidy(_joined_up(to_arrow_schema(down.schema))), down.schema)
    with lifetime(edges.sparkSession) as keep:
        state = materialize(stars.distinct(), name)
        while not _all_stars(state):
            hub = max(degree, 2 * state.count() // HUBS)
            large = materialize(_large_star(state, hub), name)
            release(state)
            state = materialize(_small_star(large, hub), name)
            release(large)
        keep(state)
    nodes = state.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
