"""What a client is told of an agent's events: one table of kinds, what each is called, and which fields leave it, in which form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Categories that may be told as they are.
MODEL_ERRORS = tuple("client_error connection_error provider_error rate_limit server_error timeout".split())
FIELD_ERRORS = (
    "missing_required_field extra_field limit_exceeded invalid_range invalid_type malformed_json invalid_value task_limit_exceeded invalid_task_query duplicate_task_query task_query_limit_exceeded unknown_task_id"
).split()
TERMINAL = ("no_tool_call", "multiple_tool_calls", "unexpected_tool_name")
FINISH = "finish_research"

Rule = Callable[[], Column]


def _raw(name: str) -> Column:
    return F.get_json_object("data", f"$.{name}")


def _list(name: str) -> Column:
    """A list of the data as texts; empty where it is none."""
    return F.coalesce(F.from_json(F.when(F.substring(_raw(name), 1, 1) == "[", _raw(name)), "array<string>"), F.array().cast("array<string>"))


def text(name: str, most: int | None = None, default: str | None = None) -> Rule:
    """A text, cut to `most` characters (then null is empty), or the default where it is missing."""
    return lambda: F.substring(F.coalesce(_raw(name), F.lit("")), 1, most) if most else F.coalesce(_raw(name), F.lit(default))


def number(name: str, low: int | None = None, high: int | None = None) -> Rule:
    """A whole number, 0 if there is none, kept within bounds."""

    def run() -> Column:
        n = F.coalesce(_raw(name).try_cast("bigint"), F.lit(0).cast("bigint"))
        return n if low is None else F.least(F.greatest(n, F.lit(low)), F.lit(high)).cast("bigint")

    return run


def whole() -> Column:
    """The round that an event names, else the one that the session's last model call began."""
    return F.coalesce(_raw("round").try_cast("bigint"), F.col("current_round"))


def round_(default: int | None = None) -> Rule:
    return lambda: F.coalesce(_raw("round").try_cast("bigint"), F.lit(default).cast("bigint"))


def texts(name: str, items: int | None = None, most: int | None = None) -> Rule:
    def run() -> Column:
        x = F.slice(_list(name), 1, items) if items else _list(name)
        return F.transform(x, lambda v: F.substring(v, 1, most)) if most else x

    return run


def ids(name: str, items: int, ordered: bool = False) -> Rule:
    """Positive whole numbers among the first items of a list, each once; in order if ordered."""

    def run() -> Column:
        first = F.slice(_list(name), 1, items)
        kept = F.array_distinct(F.filter(F.transform(F.filter(first, lambda v: v.rlike("^[0-9]+$")), lambda v: v.try_cast("bigint")), lambda v: v > 0))
        return F.array_sort(kept) if ordered else kept

    return run


def one_of(name: str, allowed: tuple[str, ...], default: str | None = None) -> Rule:
    return lambda: F.when(_raw(name).isin(*allowed), _raw(name)).otherwise(F.lit(default))


def timing() -> Column:
    """Milliseconds by the first of three names that is there, to three places; 0 where that is no number."""
    return F.round(F.coalesce(F.coalesce(_raw("timing_ms"), _raw("duration_ms"), _raw("elapsed_ms")).try_cast("double"), F.lit(0.0)), 3)


def const(value) -> Rule:  # noqa: ANN001
    return lambda: F.lit(value)


def _status() -> Column:
    return F.coalesce(_raw("status"), F.lit("ok"))


@dataclass
class Kind:
    """Name of a kind outside, and its fields; passed: all data leave as they are, with the fields over them."""

    name: str
    fields: dict[str, Rule]
    passed: bool = False
    only: Rule | None = None


_ERROR = lambda: _status() == "error"
_NOT_OK = lambda: _status() != "ok"
_COUNTS = {n: number(n) for n in ("subquestion_count", "supported_count", "unsupported_count")}
_AS_IS = ("retrieval_round_started", "evidence_judge_started", "evidence_judge_result", "claim_coverage_updated")
KINDS: dict[str, Kind] = {
    "research_plan_created": Kind("agent_research_plan", {"protocol_version": const(2), "round": round_(0), "status": text("status", None, "ok"), "claim_ids": texts("claim_ids"), "action_ids": texts("action_ids"), "error_category": text("error_category"), "degraded": _ERROR}),
    "search_action_started": Kind("agent_tool_call", {"protocol_version": const(2), "round": round_(), "tool": text("tool", None, "unknown"), "call_id": text("action_id"), "claim_ids": texts("claim_ids"), "query": text("query", 1000), "status": const("ok"), "executed": const(True), "degraded": const(False)}),
    "search_action_result": Kind("agent_tool_result", {"protocol_version": const(2), "round": round_(), "tool": text("tool", None, "unknown"), "call_id": text("action_id"), "status": text("status", None, "ok"), "validation_error_category": text("error_category"), "degraded": _ERROR}),
    **{k: Kind(k, {}, True) for k in _AS_IS},
    "evidence_pool_updated": Kind("agent_evidence_pool_update", {}, True),
    "evidence_gap_identified": Kind("agent_evidence_gap", {}, True),
    "research_sufficiency_decided": Kind("agent_sufficiency_decision", {}, True),
    "evidence_pack_built": Kind("agent_evidence_pack", {}, True),
    "agent_research_completed": Kind("agent_research_finish", {"status": text("completion_status"), "degraded": lambda: F.coalesce(_raw("completion_status"), F.lit("")) != "completed"}, True),
    "model_result": Kind("agent_model_result", {"round": whole, "status": const("error"), "error_category": one_of("error_category", MODEL_ERRORS, "provider_error"), "provider_attempts": number("provider_attempts", 1, 2), "degraded": const(True)}, only=lambda: F.coalesce(_raw("status"), F.lit("")) == "error"),
    "tool_start": Kind("agent_tool_call", {"tool": text("tool", None, "unknown"), "call_id": text("call_id"), "round": whole, "argument_fingerprint": text("argument_fingerprint", None, ""), "timing_ms": timing, "status": text("status", None, "ok"), "executed": lambda: _status() == "ok", "degraded": _NOT_OK}),
    "tool_result": Kind("agent_tool_result", {"tool": text("tool", None, "unknown"), "call_id": text("call_id"), "round": whole, "timing_ms": timing, "status": text("status", None, "ok"), "result_count": number("result_count"), "evidence_delta_count": number("evidence_delta_count"), "returned_document_ids": ids("returned_document_ids", 20, True), "validation_error_category": one_of("validation_error_category", tuple(FIELD_ERRORS)), "degraded": _NOT_OK}),
    "task_search": Kind("agent_task_search", {"round": whole, "task_id": text("task_id", 32), "subquestion": text("subquestion", 1000), "query": text("query", 1000), "status": text("status", None, "ok"), "result_count": number("result_count"), "evidence_delta_count": number("evidence_delta_count"), "task_evidence_count": number("task_evidence_count"), "degraded": _NOT_OK}),
    "degraded": Kind("retrieval_degraded", {"degraded": const(True), "reason": text("reason", None, "agent degraded"), "completion_status": text("completion_status"), "round": whole, "timing_ms": timing}),
    "research_finish_result": Kind("agent_research_finish", {"round": whole, "status": text("status", None, "error"), **_COUNTS, "available_evidence_count": number("available_evidence_count"), "accepted_evidence_count": number("accepted_evidence_count"), "accepted_chunk_ids": ids("accepted_chunk_ids", 8), "task_count": number("task_count"), "omitted_task_ids": texts("omitted_task_ids", 8, 32), "error_category": text("error_category"), "normalization_categories": texts("normalization_categories", 5, 64), "terminal_response_category": one_of("terminal_response_category", TERMINAL), "terminal_tool_count": number("terminal_tool_count", 0, 4), "terminal_tool_names": lambda: F.transform(F.slice(_list("terminal_tool_names"), 1, 4), lambda v: F.when(v == FINISH, v).otherwise("unknown")), "terminal_attempt": number("terminal_attempt", 0, 2), "degraded": lambda: ~F.coalesce(_raw("status"), F.lit("error")).isin("completed", "insufficient_evidence")}),
    "subquestion_coverage": Kind("agent_subquestion_coverage", {"round": whole, **_COUNTS, "degraded": const(False)}),
    "accepted_evidence": Kind("agent_accepted_evidence", {"round": whole, "count": number("count"), "chunk_ids": ids("chunk_ids", 8), "degraded": const(False)}),
    "fallback_selected_evidence": Kind("agent_fallback_selected_evidence", {"round": whole, "count": number("count"), "chunk_ids": ids("chunk_ids", 8), "degraded": const(True)}),
}


def told(events: DataFrame) -> DataFrame:
    """session_id, ord, type, payload (JSON) of the events that a client is told of.

    events: session_id, ord, kind, data (a JSON object). A `model_start` sets the round of the
    session's later events that name none, and is not told; so are kinds that are not in
    KINDS, and model results without an error. Fields that a kind doesn't list never leave
    it, except from kinds that pass their data on. Null fields are left out.
    """
    before = Window.partitionBy("session_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("data", F.coalesce("data", F.lit("{}")))
    e = e.withColumn("current_round", F.last(F.when(F.col("kind") == "model_start", _raw("round").try_cast("bigint")), True).over(before))
    name = payload = F.lit(None).cast("string")
    keep = F.lit(False)
    for kind, k in KINDS.items():
        of = F.col("kind") == kind
        own = F.to_json(F.struct(*[rule().alias(f) for f, rule in k.fields.items()])) if k.fields else None
        if k.passed and not k.fields:
            own = F.col("data")
        elif k.passed:
            # Values stay what they are as variants; the kind's own fields stand over those of the data.
            there, over = F.from_json("data", "map<string,variant>"), F.from_json(own, "map<string,variant>")
            own = F.to_json(F.map_concat(F.map_filter(there, lambda n, _: ~n.isin(*k.fields)), over))  # noqa: B023
        payload, name = F.when(of, own).otherwise(payload), F.when(of, k.name).otherwise(name)
        keep = keep | (of & k.only() if k.only else of)
    return e.where(keep).select("session_id", "ord", name.alias("type"), payload.alias("payload"))
