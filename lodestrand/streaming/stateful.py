"""Stateful streams with state of their own kinds and event-time timers: call permits, session compaction, retries.

Each processor keeps its state per key in the RocksDB store, so it may outgrow memory, and
what is kept of old calls goes by time. Each access to the store is a message to the JVM, so within
a micro-batch a key's state is worked on in Python and only what has changed at its end is written. Rows of a key are taken in order of time within a
micro-batch, and a key's rows have to arrive in that order; then the decisions are the same
over one micro-batch or many. Times are in milliseconds of `ts`, an event-time column with a watermark.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MS = 1_000


_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}


def _struct(columns: str) -> T.StructType:
    """A schema from `name type, ...`; workers have no JVM that could read DDL."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> Iterable:
    pdf = pd.concat(list(rows)).sort_values(list(by))
    pdf["__ms"] = pdf["ts"].astype("datetime64[ms]").astype("int64") if pdf["ts"].dt.tz is None else pdf["ts"].dt.tz_convert("UTC").dt.tz_localize(None).astype("datetime64[ms]").astype("int64")
    return pdf.itertuples(index=False)


class _Entries:
    """A key's map state within a micro-batch: entries are read when asked for, and changes written by flush()."""

    def __init__(self, state, stored: bool):
        self.state, self.stored, self.now, self.read = state, stored, {}, {}

    def get(self, key: tuple) -> tuple | None:
        if key in self.now or not self.stored:
            return self.now.get(key)
        if key not in self.read:
            self.read[key] = self.state.getValue(key) if self.state.containsKey(key) else None
        return self.read[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        """None takes the entry away."""
        self.now[key] = value

    def flush(self) -> None:
        for key, value in self.now.items():
            if value is not None:
                self.state.updateValue(key, value)
            elif self.stored:
                self.state.removeKey(key)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


class CallPermits(StatefulProcessor):
    """A circuit breaker with generations. See call_permits()."""

    schema = "key string, call_id long, at long, decision string, generation long"

    def __init__(self, limit: int, window_s: float, open_s: float, permit_ttl_ms: int | None):
        self.limit, self.window, self.open, self.ttl = limit, int(window_s * _MS), int(open_s * _MS), permit_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", _struct("state string, opened_at long, probe boolean, generation long, told boolean"))
        self.failures = handle.getMapState("failures", _struct("at long"), _struct("n int"))
        self.permits = handle.getMapState("permits", _struct("call_id long"), _struct("generation long, probe boolean"), self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.record.get()
        state, opened_at, probe, generation, told = before or ("closed", 0, False, 0, False)
        permits = _Entries(self.permits, before is not None and self.permits.exists())
        kept = {k[0]: v[0] for k, v in self.failures.iterator()} if before is not None else {}
        failures, opened = dict(kept), False
        out: list[tuple] = []
        for r in _in_order(rows, "ts", "seq"):
            now, call = int(r[-1]), (int(r.call_id),)
            if r.kind == "acquire":
                if state == "open" and now - opened_at >= self.open:
                    if not told:
                        out.append((key[0], None, opened_at + self.open, "half_open", generation))
                    state, told = "half_open", True
                if state == "open" or (state == "half_open" and probe):
                    out.append((key[0], r.call_id, now, "refused", generation))
                    continue
                probe = state == "half_open"
                permits.put(call, (generation, probe))
                out.append((key[0], r.call_id, now, "probe" if probe else "granted", generation))
                continue
            if (permit := permits.get(call)) is None:
                out.append((key[0], r.call_id, now, "unknown", generation))
                continue
            of, was_probe = permit
            permits.put(call, None)
            if of != generation:
                out.append((key[0], r.call_id, now, "stale", generation))
            elif r.kind == "success":
                failures = {}
                out.append((key[0], r.call_id, now, "closed" if was_probe else "passed", generation))
                state, probe, generation = "closed", False, generation + int(was_probe)
            elif r.kind != "transient":
                probe = probe and not was_probe
                out.append((key[0], r.call_id, now, "ignored", generation))
            elif was_probe:
                out.append((key[0], r.call_id, now, "reopened", generation))
                state, opened_at, probe, generation, told, failures, opened = "open", now, False, generation + 1, False, {}, True
            else:
                failures = {at: n for at, n in failures.items() if at >= now - self.window}
                failures[now] = failures.get(now, 0) + 1
                if sum(failures.values()) >= self.limit:
                    out.append((key[0], r.call_id, now, "opened", generation))
                    state, opened_at, probe, generation, told, failures, opened = "open", now, False, generation + 1, False, {}, True
                else:
                    out.append((key[0], r.call_id, now, "counted", generation))
        if opened and state == "open":  # a timer of an older opening would find another state
            self.handle.registerTimer(opened_at + self.open)
        permits.flush()
        for at in kept.keys() - failures.keys():
            self.failures.removeKey((at,))
        for at, n in failures.items():
            if kept.get(at) != n:
                self.failures.updateValue((at,), (n,))
        self.record.update((state, opened_at, probe, generation, told))
        yield _frame(out, self.schema)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, opened_at, probe, generation, told = self.record.get()
        if state == "open" and not told and opened_at + self.open == expiredTimerInfo.getExpiryTimeInMs():
            self.record.update((state, opened_at, probe, generation, True))
            yield _frame([(key[0], None, opened_at + self.open, "half_open", generation)], self.schema)

    def close(self) -> None:
        pass


def call_permits(calls: DataFrame, limit: int = 5, window_s: float = 60.0, open_s: float = 30.0, permit_ttl_ms: int | None = None) -> DataFrame:
    """key, call_id, at (ms), decision, generation of a circuit breaker per key.

    calls: key (string), call_id, seq (order at one time), ts, kind: `acquire`, or how a call ended:
    `success`, `transient`, or anything else, which counts for nothing. `limit` transient failures within window_s
    open the breaker, and calls are refused for open_s; then it is half open, by a timer or
    by the next call, which is a probe: one at a time. Its success closes the breaker, its
    transient failure opens it again. Opening and closing begin a new generation, and results of
    calls that were granted in an older one are stale. `half_open` has no call. With
    permit_ttl_ms the permits of calls that never end go after so long; their results are then unknown.
    """
    step = CallPermits(limit, window_s, open_s, permit_ttl_ms)
    return calls.groupBy("key").transformWithStateInPandas(step, _struct(step.schema), "Append", "EventTime" if permit_ttl_ms is None else "ProcessingTime")


def first_words(previous: str, texts: list[str], most: int = 40) -> str:
    """A summary that needs no model: the former one and the first words of each text, bounded."""
    words = previous.split()
    for t in texts:
        words += t.split()[:4]
    return " ".join(words[-most:])


class SessionCompaction(StatefulProcessor):
    """Checkpoints of sessions that outgrow their window. See compactions()."""

    schema = "session long, version long, source_version long, first_turn long, last_turn long, first_kept long, tokens_before long, kept long, summary string"

    def __init__(self, window: int, reserve: int, keep_recent: int, summarise: Callable[[str, list[str]], str], count: Callable[[str], int]):
        self.threshold, self.keep, self.summarise, self.count = window - reserve, keep_recent, summarise, count

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", _struct("version long, summary string"))
        self.active = handle.getListState("active", _struct("turn long, role string, text string, tokens long"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, summary = self.memory.get() if self.memory.exists() else (0, "")
        active = [tuple(x) for x in self.active.get()] if self.active.exists() else []
        out: list[tuple] = []
        for m in _in_order(rows, "turn"):
            text = m.text or ""
            active.append((int(m.turn), m.role, text, self.count(text)))
            before = self.count(summary) + sum(x[3] for x in active)
            if before <= self.threshold or (cut := self._first_kept(active)) is None:
                continue
            gone, active = active[:cut], active[cut:]
            summary, version = self.summarise(summary, [x[2] for x in gone]), version + 1
            out.append((key[0], version, version - 1, gone[0][0], gone[-1][0], active[0][0], before, len(active), summary))
        self.memory.update((version, summary))
        self.active.put(active)
        yield _frame(out, self.schema)

    def _first_kept(self, active: list[tuple]) -> int | None:
        """The first user message, but not message 0, from where the newest messages reach `keep` tokens."""
        recent, at = 0, len(active)
        while at and recent < self.keep:
            at -= 1
            recent += active[at][3]
        return next((i for i in range(max(at, 1), len(active)) if active[i][1] == "user"), None) if recent >= self.keep else None

    def close(self) -> None:
        pass


def white_space_tokens(text: str) -> int:
    return len(text.split())


def compactions(messages: DataFrame, window: int, reserve: int, keep_recent: int, summarise: Callable[[str, list[str]], str] = first_words, count: Callable[[str], int] = white_space_tokens) -> DataFrame:
    """A row for each checkpoint: session, version, source_version, first_turn to last_turn summarised, first_kept, tokens_before, kept, summary.

    messages: session, turn, role, text, ts. After each message, if the summary so far and
    the active messages have more than window - reserve tokens, all before first_kept go into
    a new summary: the first user message from where the newest messages reach keep_recent
    tokens. Without such a message nothing happens. A version is one more than the one it
    was made from (0: none). State is the summary and the active messages, which are bounded
    by the window and the longest turn.
    """
    step = SessionCompaction(window, reserve, keep_recent, summarise, count)
    return messages.groupBy("session").transformWithStateInPandas(step, _struct(step.schema), "Append", "None")


class Retries(StatefulProcessor):
    """What becomes of failed attempts under a deadline and a budget of retries that calls share. See retries()."""

    schema = "request string, call_id long, attempts long, at long, outcome string, delay_ms long"

    def __init__(self, most: int, budget: int, timeout_s: float, base_ms: int, cap_ms: int):
        self.most, self.budget, self.timeout, self.base, self.cap = most, budget, int(timeout_s * _MS), base_ms, cap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.request = handle.getValueState("request", _struct("deadline long, used long"))
        self.calls = handle.getMapState("calls", _struct("call_id long"), _struct("attempts long, over boolean"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.request.get()
        deadline, used = before or (None, 0)
        calls = _Entries(self.calls, before is not None)
        out: list[tuple] = []
        for r in _in_order(rows, "ts", "call_id"):
            now, call = int(r[-1]), (int(r.call_id),)
            deadline = now + self.timeout if deadline is None else deadline
            attempts, over = calls.get(call) or (0, False)
            if over:
                continue
            delay = None
            if now >= deadline:
                outcome = "deadline"
            else:
                attempts += 1
                wait = delay_ms(r.call_id, attempts - 1, r.retry_after_ms, self.base, self.cap)
                if r.kind == "success":
                    outcome = "success"
                elif r.kind != "transient" or attempts - 1 >= self.most:
                    outcome = r.kind
                elif wait >= deadline - now:
                    outcome = "deadline"
                elif used >= self.budget:
                    outcome = "retry_budget_exhausted"
                else:
                    outcome, delay, used = "retry", wait, used + 1
            calls.put(call, (attempts, delay is None))
            out.append((key[0], r.call_id, attempts, now, outcome, delay))
        calls.flush()
        self.request.update((deadline, used))
        yield _frame(out, self.schema).astype({"delay_ms": "Int64"})

    def close(self) -> None:
        pass


def delay_ms(call_id: int, retry: int, retry_after_ms: float | None, base_ms: int, cap_ms: int) -> int:
    """What a server asks for, or a share of base * 2**retry, at most the cap; the share is a hash of the call and the retry."""
    if retry_after_ms is not None and retry_after_ms == retry_after_ms:
        return int(retry_after_ms)
    share = zlib.crc32(f"{call_id}:{retry}".encode()) / 2**32
    return int(share * min(cap_ms, base_ms * 2**retry))


def retries(attempts: DataFrame, most: int = 2, budget: int = 4, timeout_s: float = 30.0, base_ms: int = 500, cap_ms: int = 8_000) -> DataFrame:
    """request, call_id, attempts, at (ms), outcome, delay_ms for each attempt of a request's calls.

    attempts: request (string), call_id, ts, kind (`success`, `transient` or another failure), retry_after_ms
    or null. A request's deadline is timeout_s after its first attempt. A transient failure is tried
    again up to `most` times a call, if the delay ends before the deadline and the request has retries left, of
    which its calls share `budget`. Attempts of a call that is over give no row.
    """
    step = Retries(most, budget, timeout_s, base_ms, cap_ms)
    return attempts.groupBy("request").transformWithStateInPandas(step, _struct(step.schema), "Append", "None")
