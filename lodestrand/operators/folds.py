"""Folds in plain Python over many small groups, without a call of pandas for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def by_group(rows: DataFrame, keys: tuple[str, ...], step: Callable[[tuple, list[dict]], list[tuple]], schema: str) -> DataFrame:
    """The rows (of schema) that step makes of each group's key and its rows, which come in no order.

    A group is one row with a list, so a batch has thousands of groups; applyInPandas makes a
    frame for each, which costs milliseconds however small the group is.
    """
    made = to_arrow_schema(T._parse_datatype_string(schema))
    lists = rows.groupBy(*keys).agg(F.collect_list(F.struct(*(c for c in rows.columns if c not in keys))).alias("__rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            out = [r for g in batch.to_pylist() for r in step(tuple(g[k] for k in keys), g["__rows"])]
            columns = zip(*out) if out else ([] for _ in made)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made)], schema=made)

    return lists.mapInArrow(run, schema)
