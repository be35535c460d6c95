"""Streams over event logs: transcripts, outbox, circuit breaker, windows and sessions."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrand.runtime import work_path


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet log as a stream, with ts as an event time that watermarks take."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    # A single file is found by its name in its folder, a folder of part files by itself.
    try:
        is_file = spark.read.format("binaryFile").option("pathGlobFilter", name).load(folder).select("path").limit(1).count() > 0
    except Exception:
        is_file = False
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if is_file else stream.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


@contextlib.contextmanager
def store_provider(spark: SparkSession, provider: str | None) -> Iterator[None]:
    """Queries that start inside keep their state by this provider; the session's setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    if provider:
        spark.conf.set(name, provider)
    try:
        yield
    finally:
        if provider:
            spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_available(df: DataFrame, mode: str = "append", provider: str | None = None) -> DataFrame:
    """All that is there now through the stream, as a table in the shared folder. provider: of the state, if not the session's."""
    spark = df.sparkSession
    base = work_path(spark, "stream")
    with store_provider(spark, provider):
        _ran(df, mode, base)
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def _ran(df: DataFrame, mode: str, base: str) -> None:
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    else:
        # Each batch replaces the result, as complete and update mode ask for.
        def put(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out")

        query = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def transcript(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events once each by event_id, late repeats within the watermark dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def progress(events: DataFrame, codes: tuple[str, ...], column: str = "event_type") -> DataFrame:
    """Events of the closed set of codes."""
    return events.where(F.col(column).isin(*codes))


def tumbling(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events and their value by window and type."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def session_windows(events: DataFrame, gap: str = "2 hours", delay: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Sessions of a key: start, end (last event plus gap), events."""
    s = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def breaker_steps(rows: list[tuple[float, bool]], state: tuple, limit: int, window: float, opened: float) -> tuple[list[str], tuple]:
    """Decisions of a circuit breaker on (time, failed) rows in order, from and to state (failures, open_until, half)."""
    failures, until, half = list(state[0]), state[1], state[2]
    out = []
    for t, failed in rows:
        if until and t < until:
            out.append("rejected")
            continue
        if until and not half:
            half = True
        failures = [f for f in failures if f > t - window]
        if failed:
            failures.append(t)
            if half or len(failures) >= limit:
                until, half, failures = t + opened, False, []
                out.append("opened")
            else:
                out.append("failed")
        else:
            if half:
                until, half, failures = 0.0, False, []
                out.append("closed")
            else:
                out.append("passed")
    return out, (failures, until, half)


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def circuit_breaker(events: DataFrame, key: str = "user_id", limit: int = 5, window: float = 60.0, opened: float = 30.0, idle_ms: int | None = None) -> DataFrame:
    """key, event_id, decision of a breaker per key: `limit` failures in a window open it, then one trial closes or reopens it.

    events: key, event_id, t (seconds), failed. State per key is the failures of one window.
    With idle_ms, for streams without an end, it goes when the key has had no row for so
    long, which should be much more than both times; a run over what is available must not
    set it, as Spark would wait for the timeouts.
    """
    schema = f"{key} long, event_id long, decision string"

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if idle_ms is not None and state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else ([], 0.0, False)
        pdf = pd.concat(list(batches)).sort_values(["t", "event_id"])
        out, now = breaker_steps(list(zip(pdf["t"], pdf["failed"])), now, limit, window, opened)
        state.update((list(map(float, now[0])), float(now[1]), bool(now[2])))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: k[0], "event_id": pdf["event_id"].to_numpy(), "decision": out})

    return events.groupBy(key).applyInPandasWithState(step, schema, "failures array<double>, until double, half boolean", "append", _timeout(idle_ms))


def token_stream(events: DataFrame, key: str = "request_id", idle_ms: int | None = None) -> DataFrame:
    """key, first_token_ms, total_ms, tokens, text of streamed responses, one row when the terminal piece arrives.

    events: key, seq, ms, piece, terminal. With idle_ms, for streams without an end, a
    response whose pieces stop for so long is given up: its state goes and it has no row.
    """
    schema = f"{key} long, first_token_ms double, total_ms double, tokens long, text string"

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if idle_ms is not None and state.hasTimedOut:
            state.remove()
            return
        first, n, text = state.get if state.exists else (-1.0, 0, "")
        for pdf in batches:
            for r in pdf.sort_values("seq").itertuples():
                if r.terminal:
                    state.remove()
                    yield pd.DataFrame([(k[0], first if n else None, r.ms, n, text)], columns=[c.split()[0] for c in schema.split(", ")])
                    return
                first = r.ms if n == 0 else first
                n, text = n + 1, text + r.piece
        state.update((float(first), int(n), text))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    return events.groupBy(key).applyInPandasWithState(step, schema, "first double, n long, text string", "append", _timeout(idle_ms))


def outbox(operations: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each batch of operations to an idempotent sink, keyed by operation id; a replayed batch changes nothing."""
    return operations.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keyed_upsert(path: str, key: str = "id", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the newest row of each key, by (version, key).

    Keys lie in buckets, and a batch writes a new version of the buckets that it touches
    and of no other; a replayed batch writes its own version again.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most the number of buckets
        before = newest_buckets(spark, path, number)
        old = [before[b] for b in touched if b in before]
        if old:
            rows = rows.unionByName(spark.read.option("basePath", path).parquet(*old).select(*rows.columns))
        rest = [c for c in batch.columns if c not in (key, "version")]
        newest = rows.groupBy("bucket", key).agg(F.max(F.struct("version", *rest)).alias("x")).select("bucket", key, "x.*")
        newest.select(*batch.columns, "bucket").repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def newest_buckets(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """The folder of each bucket's last version, of batches before a number if given; unfinished batches count for nothing."""
    sc = spark.sparkContext
    path_of = sc._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(sc._jsc.hadoopConfiguration())
    out: dict[int, tuple[int, str]] = {}
    if not fs.exists(path_of(path)):
        return {}
    for batch in fs.listStatus(path_of(path)):
        name = batch.getPath().getName()
        if not name.startswith("batch=") or not fs.exists(path_of(f"{path}/{name}/_SUCCESS")):
            continue
        number = int(name.split("=")[1])
        if before is not None and number >= before:
            continue
        for folder in fs.listStatus(batch.getPath()):
            part = folder.getPath().getName()
            if part.startswith("bucket="):
                bucket = int(part.split("=")[1])
                out[bucket] = max(out.get(bucket, (-1, "")), (number, f"{path}/{name}/{part}"))
    return {b: folder for b, (_, folder) in out.items()}


def upserted(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The present state of a keyed_upsert sink: the last version of every bucket."""
    return spark.read.option("basePath", path).parquet(*newest_buckets(spark, path).values()).select(*columns)
