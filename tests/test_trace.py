"""What is told of agent events, against plain code over dictionaries."""

import json

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestrand.operators import trace

FOLDER = "/root/testdata/sf0.001"


def plain(events):
    """(session, ord, type, payload) of events (session, ord, kind, dict), one after another."""
    out, current = [], {}
    for session, ord_, kind, d in sorted(events, key=lambda e: (e[0], e[1])):
        num = lambda n: int(d.get(n) or 0)  # noqa: B023, E731
        here = d["round"] if d.get("round") is not None else current.get(session)
        status = d.get("status") or "ok"
        ok = status == "ok"
        ms = d.get("timing_ms", d.get("duration_ms", d.get("elapsed_ms", 0)))
        ms = round(float(ms), 3) if isinstance(ms, (int, float)) else 0.0
        chunk = lambda n, k: list(dict.fromkeys(v for v in (d.get(n) or [])[:k] if isinstance(v, int) and v > 0))  # noqa: B023, E731
        counts = {n: num(n) for n in ("subquestion_count", "supported_count", "unsupported_count")}
        if kind == "model_start":
            current[session] = d["round"] if d.get("round") is not None else current.get(session)
            continue
        made = None
        if kind == "research_plan_created":
            made = "agent_research_plan", {"protocol_version": 2, "round": d.get("round") or 0, "status": status, "claim_ids": d.get("claim_ids") or [], "action_ids": d.get("action_ids") or [], "error_category": d.get("error_category"), "degraded": status == "error"}
        elif kind == "search_action_started":
            made = "agent_tool_call", {"protocol_version": 2, "round": d.get("round"), "tool": d.get("tool") or "unknown", "call_id": d.get("action_id"), "claim_ids": d.get("claim_ids") or [], "query": (d.get("query") or "")[:1000], "status": "ok", "executed": True, "degraded": False}
        elif kind == "search_action_result":
            made = "agent_tool_result", {"protocol_version": 2, "round": d.get("round"), "tool": d.get("tool") or "unknown", "call_id": d.get("action_id"), "status": status, "validation_error_category": d.get("error_category"), "degraded": status == "error"}
        elif kind in ("retrieval_round_started", "evidence_judge_started", "evidence_judge_result", "claim_coverage_updated"):
            made = kind, d
        elif kind in ("evidence_pool_updated", "evidence_gap_identified", "research_sufficiency_decided", "evidence_pack_built"):
            made = {"evidence_pool_updated": "agent_evidence_pool_update", "evidence_gap_identified": "agent_evidence_gap", "research_sufficiency_decided": "agent_sufficiency_decision", "evidence_pack_built": "agent_evidence_pack"}[kind], d
        elif kind == "agent_research_completed":
            made = "agent_research_finish", {**d, "status": d.get("completion_status"), "degraded": d.get("completion_status") != "completed"}
        elif kind == "model_result" and d.get("status") == "error":
            category = d.get("error_category")
            made = "agent_model_result", {"round": here, "status": "error", "error_category": category if category in trace.MODEL_ERRORS else "provider_error", "provider_attempts": max(1, min(2, num("provider_attempts"))), "degraded": True}
        elif kind == "tool_start":
            made = "agent_tool_call", {"tool": d.get("tool") or "unknown", "call_id": d.get("call_id"), "round": here, "argument_fingerprint": d.get("argument_fingerprint") or "", "timing_ms": ms, "status": status, "executed": ok, "degraded": not ok}
        elif kind == "tool_result":
            error = d.get("validation_error_category")
            made = "agent_tool_result", {"tool": d.get("tool") or "unknown", "call_id": d.get("call_id"), "round": here, "timing_ms": ms, "status": status, "result_count": num("result_count"), "evidence_delta_count": num("evidence_delta_count"), "returned_document_ids": sorted(chunk("returned_document_ids", 20)), "validation_error_category": error if error in trace.FIELD_ERRORS else None, "degraded": not ok}
        elif kind == "task_search":
            made = "agent_task_search", {"round": here, "task_id": (d.get("task_id") or "")[:32], "subquestion": (d.get("subquestion") or "")[:1000], "query": (d.get("query") or "")[:1000], "status": status, "result_count": num("result_count"), "evidence_delta_count": num("evidence_delta_count"), "task_evidence_count": num("task_evidence_count"), "degraded": not ok}
        elif kind == "degraded":
            made = "retrieval_degraded", {"degraded": True, "reason": d.get("reason") or "agent degraded", "completion_status": d.get("completion_status"), "round": here, "timing_ms": ms}
        elif kind == "research_finish_result":
            names = ["finish_research" if x == "finish_research" else "unknown" for x in (d.get("terminal_tool_names") or [])[:4]]
            said = d.get("terminal_response_category")
            made = "agent_research_finish", {"round": here, "status": d.get("status") or "error", **counts, "available_evidence_count": num("available_evidence_count"), "accepted_evidence_count": num("accepted_evidence_count"), "accepted_chunk_ids": chunk("accepted_chunk_ids", 8), "task_count": num("task_count"), "omitted_task_ids": [x[:32] for x in (d.get("omitted_task_ids") or [])[:8]], "error_category": d.get("error_category"), "normalization_categories": [x[:64] for x in (d.get("normalization_categories") or [])[:5]], "terminal_response_category": said if said in trace.TERMINAL else None, "terminal_tool_count": max(0, min(4, num("terminal_tool_count"))), "terminal_tool_names": names, "terminal_attempt": max(0, min(2, num("terminal_attempt"))), "degraded": (d.get("status") or "error") not in ("completed", "insufficient_evidence")}
        elif kind == "subquestion_coverage":
            made = "agent_subquestion_coverage", {"round": here, **counts, "degraded": False}
        elif kind in ("accepted_evidence", "fallback_selected_evidence"):
            made = f"agent_{kind}", {"round": here, "count": num("count"), "chunk_ids": chunk("chunk_ids", 8), "degraded": kind != "accepted_evidence"}
        if made:
            out.append((session, ord_, made[0], {k: v for k, v in made[1].items() if v is not None}))
    return out


def seen(df):
    return sorted(((r.session_id, r.ord, r.type, {k: v for k, v in json.loads(r.payload).items() if v is not None}) for r in df.collect()), key=lambda r: r[:2])


def test_odd_events(spark):
    events = [
        (1, 0, "model_start", {"round": 4}), (1, 1, "tool_result", {"timing_ms": "x", "returned_document_ids": [5, 3, 5, -1, 0, "no", True], "validation_error_category": "other"}), (1, 2, "tool_start", {"duration_ms": 1.23456, "status": "blocked"}),
        (1, 3, "model_result", {"status": "error", "error_category": "timeout", "provider_attempts": 9}), (1, 4, "model_result", {"status": "ok"}), (1, 5, "model_start", {}), (1, 6, "task_search", {"task_id": "t" * 50, "round": 1}), (1, 7, "private", {"a": 1}),
        (2, 0, "accepted_evidence", {"chunk_ids": list(range(12)), "count": 3}), (2, 1, "agent_research_completed", {"completion_status": "stalled", "status": "old", "n": [1, {"x": None}]}), (2, 2, "research_finish_result", {"terminal_tool_names": ["finish_research", "rm"], "terminal_tool_count": 7, "omitted_task_ids": ["x"] * 20}),
        (2, 3, "claim_coverage_updated", {"deep": {"list": [1, 2.5, "s", None]}}), (2, 4, "degraded", {}), (2, 5, "research_plan_created", {"claim_ids": ["a"]}),
    ]
    df = spark.createDataFrame([(s, o, k, json.dumps(d)) for s, o, k, d in events] + [(3, 0, "degraded", None)], "session_id long, ord long, kind string, data string")
    got = seen(trace.told(df))
    want = plain([*((s, o, k, {**d, **({"returned_document_ids": [5, 3, 5, -1, 0]} if "returned_document_ids" in d else {})}) for s, o, k, d in events), (3, 0, "degraded", {})])
    assert got == want


def test_query_over_events(spark):
    kinds = [*trace.KINDS, "model_start", "private"]
    events = []
    for e in spark.read.parquet(f"{FOLDER}/events.parquet").select("event_id", "user_id", "event_type", F.col("value").cast("double").alias("value")).collect():
        i = e.event_id
        d = {
            "round": i % 5 if i % 4 != 1 else None, "status": {0: "error", 1: "ok", 2: None}[i % 3], "tool": e.event_type, "call_id": f"call-{i}", "error_category": e.event_type, "query": e.event_type * 300, "timing_ms": e.value, "provider_attempts": str(i % 7),
            "chunk_ids": [i, i % 3, i, 0], "returned_document_ids": [9, i, i % 4], "claim_ids": ["c1", "c2"], "count": i % 9, "completion_status": "completed" if i % 2 == 0 else "stalled", "secret": "never told", "terminal_tool_names": ["finish_research", "other"],
            "terminal_response_category": "no_tool_call", "terminal_tool_count": i % 6,
        }
        events.append((e.user_id, i, kinds[i % len(kinds)], {k: v for k, v in d.items() if v is not None}))
    got, want = seen(entry.queries()["agent_trace"](spark, FOLDER)), plain(events)
    assert len(got) == len(want) > 100
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[3].keys() == b[3].keys()
        assert all(abs(a[3][k] - v) < 0.002 if isinstance(v, float) else a[3][k] == v for k, v in b[3].items())
    assert all("secret" not in x[3] for x in got if not trace.KINDS[[k for k in trace.KINDS if trace.KINDS[k].name == x[2]][0]].passed and x[2] != "agent_research_finish")
