"""Global and grouped row numbers without a task that holds all rows, or all of a large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators.bm25 import small
from lodestrand.runtime import materialize


def numbered(rows: DataFrame, *order: str | Column, groups: tuple[str, ...] = (), name: str = "n", start: int = 1) -> DataFrame:
    """Rows numbered in order, within groups if given.

    Rows are dealt by range over groups and order, sorted where they lie and written once,
    so that places hold when they are read again. A row's number is its place in its part,
    less where its group begins there, plus what earlier parts hold of the group; those
    counts are a row for each part and group in it, and broadcast only if they are few.
    """
    by = [*groups, *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id())
    placed = materialize(ranged, "numbered")
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part"), *groups).agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*(groups or (F.lit(0),))).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    renamed = offsets.withColumnsRenamed({g: f"__g{i}" for i, g in enumerate(groups)})
    on = F.shiftright("__m", 33) == F.col("__part")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    number = F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) - F.col("__first") + start
    return placed.join(small(renamed), on).select(*rows.columns, number.alias(name))
