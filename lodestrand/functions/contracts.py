"""Checks of what a model or a user hands in, as columns that name the first fault."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intents and their short names.
INTENTS = ("direct_answer", "simple_rag", "agentic_rag")
SHORT = {"direct_answer": "direct", "simple_rag": "simple", "agentic_rag": "agentic"}


def _object(raw: Column) -> Column:
    return F.try_parse_json(raw)


def router_fault(raw: Column, one_code: bool = False) -> Column:
    """Why a router's output is no decision; null where it is one.

    With one_code, missing and extra fields share the code schema_violation.
    """
    text = F.coalesce(raw, F.lit(""))
    value = _object(text)
    kind = F.schema_of_variant(value)
    keys = F.json_object_keys(text)
    intent = F.get_json_object(text, "$.intent")
    missing, extra = ("schema_violation",) * 2 if one_code else ("missing_intent", "extra_fields")
    is_text = F.schema_of_variant(F.try_variant_get(value, "$.intent", "variant")) == "STRING"
    return (
        F.when(F.trim(text) == "", "empty_output")
        .when(value.isNull(), "invalid_json")
        .when(~kind.startswith("OBJECT"), "not_json_object")
        .when(~F.array_contains(keys, "intent"), missing)
        .when(F.size(keys) > 1, extra)
        .when(~F.coalesce(is_text & intent.isin(*INTENTS), F.lit(False)), "invalid_intent")
    )


def router_intent(raw: Column) -> Column:
    """The decision, or agentic_rag on any fault."""
    return F.when(router_fault(raw, True).isNull(), F.get_json_object(raw, "$.intent")).otherwise("agentic_rag")


def intent_failure(fault: Column, expected: Column, predicted: Column) -> Column:
    """The fault, or expected_as_predicted by short names; null where right."""
    short = F.create_map(*(F.lit(x) for kv in SHORT.items() for x in kv))
    return F.coalesce(fault, F.when(expected != predicted, F.concat(short[expected], F.lit("_as_"), short[predicted])))


def json_list(raw: Column) -> Column:
    """A JSON list of strings, or the empty list."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def json_map(raw: Column) -> Column:
    """A JSON object of strings, or the empty map."""
    return F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def same_set(a: Column, b: Column) -> Column:
    return is_subset(a, b) & is_subset(b, a)


def decision_fault(confidence: Column, content: Column, duplicate: Column, pending: Column, unchanged: Column) -> Column:
    """Why a memory candidate is ignored, the first reason of the ladder; null where it is staged."""
    from lodestrand.functions.text import EVIDENCE_MARKER_PATTERN

    return (
        F.when(confidence < 0.8, "low_confidence")
        .when(content.rlike(EVIDENCE_MARKER_PATTERN), "evidence_marker")
        .when(duplicate, "exact_duplicate")
        .when(pending, "same_type_sync_pending")
        .when(unchanged, "unchanged_content")
    )


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in pairs)), lambda x: x.isNotNull())
