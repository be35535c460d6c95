"""Sinks: whole-group replacement, resumable runs, signatures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_documents(df: DataFrame, path: str, key: str = "bucket") -> None:
    """Overwrite only the partitions that df has; the job's commit makes it all or nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def delete_documents(stored: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stored rows without those of the ids."""
    return stored.join(ids.select(key).distinct(), key, "left_anti")


def signature(*columns: Column) -> Column:
    """SHA-256 of the canonical JSON of the columns, in the order given."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def pending_cases(cases: DataFrame, done: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases that no earlier run has finished under the same signature; failed ones are due again."""
    finished = done.where("error IS NULL").select(key, "signature").distinct()
    return cases.join(finished, [key, "signature"], "left_anti")


def resume(cases: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], key: str = "case_id") -> DataFrame:
    """Run `work` on pending cases, append its rows (key, signature, error, ...) to path, return all rows there.

    Cases are immutable under a signature, so appending after a lost driver repeats nothing that was committed.
    """
    spark: SparkSession = cases.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    todo = cases if done is None else pending_cases(cases, done, key)
    work(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def prefix_claims(prefixes: DataFrame, files: DataFrame) -> DataFrame:
    """key, name: each file goes to its longest matching prefix, each prefix to one file.

    A name is joined on each of its own prefixes that is as long as some prefix, so the work is that of the names' lengths.
    The join merges, as neither side is bounded. Of keys with the same prefix the least one has it.
    """
    one = prefixes.groupBy("prefix").agg(F.min("key").alias("key"))
    lengths = prefixes.agg(F.collect_set(F.length("prefix")).alias("lengths"))
    names = files.where("length(name) > 0").select("name").distinct().crossJoin(F.broadcast(lengths))
    own = F.explode(F.transform(F.filter("lengths", lambda n: (n > 0) & (n <= F.length("name"))), lambda n: F.substring(F.col("name"), F.lit(1), n)))
    j = names.select("name", own.alias("prefix")).join(one.hint("merge"), "prefix")
    best = j.groupBy("name").agg(F.max_by("key", F.length("prefix")).alias("key"))
    return best.groupBy("key").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n")).where("n = 1").select("key", "name")


def counts(**tables: DataFrame) -> DataFrame:
    """table, rows: what a reset would remove."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
