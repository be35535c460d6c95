"""File sources and sinks: JSON manifests by pattern, atomic JSON lines, SQLite tables read in row ranges."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifests(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Rows of all JSON files of a pattern, one object a line or a file; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(pattern)


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines that appear at the path only when the whole job has committed."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, rows_per_task: int = 100_000) -> DataFrame:
    """A table of a SQLite file that all executors can reach, as it was committed when each task reads it.

    The file is opened read-only. Tasks read ranges of rowids, so none holds the table; rows
    written meanwhile may be seen by some tasks, so give a snapshot where that matters.
    """
    if not table.replace("_", "").isalnum():
        raise ValueError(f"no table name: {table}")
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    listed = ", ".join('"' + n.replace('"', '""') + '"' for n in names)

    def opened() -> sqlite3.Connection:
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)

    with opened() as db:
        lo, hi = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    if lo is None:
        return spark.createDataFrame([], schema)
    tasks = spark.range(0, -(-(hi - lo + 1) // rows_per_task), 1, max(1, -(-(hi - lo + 1) // rows_per_task)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with opened() as db:
            for pdf in batches:
                for i in pdf["id"]:
                    first = lo + int(i) * rows_per_task
                    cursor = db.execute(f'SELECT {listed} FROM "{table}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid', (first, first + rows_per_task - 1))
                    yield pd.DataFrame(cursor.fetchall(), columns=names)

    return tasks.select(F.col("id")).mapInPandas(read, schema)
