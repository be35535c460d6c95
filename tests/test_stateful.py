"""Stateful streams against plain code, over one micro-batch and over many."""

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestrand.streaming import events as sv
from lodestrand.streaming import stateful as st


def streamed(spark, folder, rows, schema, batches, make):
    """The result over rows that arrive in so many files, one a micro-batch."""
    size = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).withColumn("ts", F.timestamp_millis("ms")).coalesce(1).write.parquet(f"{folder}/in", mode="append")
    read = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withWatermark("ts", "0 seconds")
    return sorted(map(tuple, sv.run_available(make(read), provider=st.PROVIDER).collect()), key=repr)


def plain_permits(rows, limit, window, open_, end):
    """The breaker as one loop over a key's rows, all times in ms; end: the last watermark."""
    out = []
    for key in {r[0] for r in rows}:
        state, failures, opened, probe, gen, permits, told = "closed", [], 0, False, 0, {}, False
        for _, call, _, now, kind in sorted((r for r in rows if r[0] == key), key=lambda r: (r[3], r[2])):
            if kind == "acquire":
                if state == "open" and now >= opened + open_:
                    state, told = "half_open", True
                    out.append((key, None, opened + open_, "half_open", gen))
                if state == "open" or (state == "half_open" and probe):
                    out.append((key, call, now, "refused", gen))
                else:
                    probe = state == "half_open"
                    permits[call] = gen, probe
                    out.append((key, call, now, "probe" if probe else "granted", gen))
            elif call not in permits:
                out.append((key, call, now, "unknown", gen))
            else:
                of, was = permits.pop(call)
                if of != gen:
                    out.append((key, call, now, "stale", gen))
                elif kind == "success":
                    out.append((key, call, now, "closed" if was else "passed", gen))
                    state, failures, probe, gen = "closed", [], False, gen + was
                elif kind == "fatal":
                    probe = probe and not was
                    out.append((key, call, now, "ignored", gen))
                else:
                    failures = [f for f in failures if f >= now - window] + [now]
                    if was or len(failures) >= limit:
                        out.append((key, call, now, "reopened" if was else "opened", gen))
                        state, failures, opened, probe, gen, told = "open", [], now, False, gen + 1, False
                    else:
                        out.append((key, call, now, "counted", gen))
        if state == "open" and not told and opened + open_ <= end:
            out.append((key, None, opened + open_, "half_open", gen))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 7])
def test_permits_equal_plain_code(spark, tmp_path, batches):
    r = random.Random(11)
    rows, call = [], 0
    for key in ("a", "b"):
        now = 1_000_000
        for _ in range(120):
            now += r.randrange(0, 4_000)
            call += 1
            kind = r.choices(["success", "transient", "fatal", None], [3, 7, 1, 1])[0]
            rows.append((key, call, 0, now, "acquire"))
            if kind:
                rows.append((key, call, 1, now + r.randrange(0, 9_000), kind))
    rows.append(("a", 99_999, 1, 1_000_500, "success"))
    rows.append(("z", 5, 0, 2_000_000, "acquire"))
    rows.sort(key=lambda x: (x[3], x[2]))
    got = streamed(spark, str(tmp_path), rows, "key string, call_id long, seq int, ms long, kind string", batches, lambda d: st.call_permits(d, 3, 20.0, 10.0))
    want = plain_permits(rows, 3, 20_000, 10_000, max(x[3] for x in rows))
    assert got == want
    assert {x[3] for x in want} == {"granted", "probe", "refused", "half_open", "opened", "reopened", "closed", "stale", "passed", "counted", "ignored", "unknown"}


@pytest.mark.parametrize("batches", [1, 5])
def test_compactions_equal_plain_code(spark, tmp_path, batches):
    r = random.Random(5)
    rows = [(s, turn, ("user", "assistant", "tool")[turn % 2 if r.random() < 0.8 else 2], " ".join(f"w{r.randrange(99)}" for _ in range(r.randrange(30))) or None, 1_000 * turn) for turn in range(40) for s in (1, 2, 3)]
    want = []
    for s in (1, 2, 3):
        version, summary, active = 0, "", []
        for _, turn, role, text, _ in (x for x in rows if x[0] == s):
            active.append((turn, role, text or "", len((text or "").split())))
            total = len(summary.split()) + sum(a[3] for a in active)
            if total <= 160:
                continue
            crossing = [i for i in range(len(active)) if sum(a[3] for a in active[i:]) >= 60]
            kept = [i for i in range(1, len(active)) if crossing and i >= crossing[-1] and active[i][1] == "user"]
            if not kept:
                continue
            gone, active = active[: kept[0]], active[kept[0] :]
            words = summary.split() + [w for g in gone for w in g[2].split()[:4]]
            summary, version = " ".join(words[-40:]), version + 1
            want.append((s, version, version - 1, gone[0][0], gone[-1][0], active[0][0], total, len(active), summary))
    got = streamed(spark, str(tmp_path), rows, "session long, turn long, role string, text string, ms long", batches, lambda d: st.compactions(d, 200, 40, 60))
    assert got == sorted(want, key=repr) and max(w[1] for w in want) > 2


@pytest.mark.parametrize(("batches", "budget"), [(1, 4), (6, 50)])
def test_retries_equal_plain_code(spark, tmp_path, batches, budget):
    r = random.Random(8)
    rows = []
    for q in ("p", "q", "s"):
        now = 50_000
        for _ in range(60):
            now += r.randrange(0, 1_500)
            rows.append((q, r.randrange(12), now, r.choice(["success", "transient", "transient", "transient", "permanent"]), r.choice([None, None, 0.0, 700.0, 90_000.0])))
    rows.sort(key=lambda x: x[2])
    want, deadline, used, calls = [], {}, defaultdict(int), {}
    for q, call, now, kind, after in sorted(rows, key=lambda x: (x[2], x[1])):
        end = deadline.setdefault(q, now + 30_000)
        n, over = calls.get((q, call), (0, False))
        if over:
            continue
        wait = int(after) if after is not None else int(zlib.crc32(f"{call}:{n}".encode()) / 2**32 * min(8_000, 500 * 2**n))
        retry = False
        if now >= end:
            outcome = "deadline"
        elif kind == "success":
            n, outcome = n + 1, "success"
        elif kind == "permanent" or n >= 2:
            n, outcome = n + 1, kind
        elif wait >= end - now:
            n, outcome = n + 1, "deadline"
        elif used[q] >= budget:
            n, outcome = n + 1, "retry_budget_exhausted"
        else:
            n, outcome, retry = n + 1, "retry", True
            used[q] += 1
        calls[q, call] = n, not retry
        want.append((q, call, n, now, outcome, wait if retry else None))
    got = streamed(spark, str(tmp_path), rows, "request string, call_id long, ms long, kind string, retry_after_ms double", batches, lambda d: st.retries(d, 2, budget))
    assert got == sorted(want, key=repr)
    assert {x[4] for x in want} == {"success", "permanent", "deadline", "retry", "retry_budget_exhausted" if budget == 4 else "transient"}


def test_queries_equal_plain_code(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{folder}/events.parquet").select("*", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).collect()
    rows = []
    for e in events:
        rows.append((str(e.user_id), e.event_id, 0, e.ms, "acquire"))
        rows.append((str(e.user_id), e.event_id, 1, e.ms + e.event_id % 240 * 60_000, {"error": "transient", "purchase": "fatal"}.get(e.event_type, "success")))
    got = sorted(map(tuple, entry.queries()["stream_permits"](spark, folder).collect()), key=repr)
    assert got == plain_permits(rows, 2, 48 * 3_600_000, 6 * 3_600_000, max(r[3] for r in rows))
    assert {"opened", "refused", "half_open"} <= {x[3] for x in got}
    made = entry.queries()["stream_compactions"](spark, folder).collect()
    said = defaultdict(list)
    for m in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        said[m.conv_id].append((m.turn, m.role, m.text or ""))
    assert made
    for r in made:
        active = sorted(x for x in said[r.session] if x[0] >= r.first_kept)
        assert active[0][0] == r.first_kept and active[0][1] == "user" and r.version == r.source_version + 1 and r.last_turn < r.first_kept
