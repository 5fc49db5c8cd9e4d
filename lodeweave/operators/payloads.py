"""Rules of event payloads and of run metadata (FLT-13, FLT-14): every rule that a row breaks comes out by name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Each event type's payload fields, what they hold, and which of them must be there.
TURN, SPAN = {"turn_index": "count"}, {"duration_ms": "duration"}
END = SPAN | {"trace_complete": "bool", "harness_budget": "object", "harness_execution": "object", "harness_context": "object", "verification": "object", "memory": "object"}
PURPOSES = "answer plan next_action summary memory_selection memory_extraction"
FIELDS: dict[str, dict[str, str]] = {
    "run_started": {"run_type": "text", "snapshot_id": "text"},
    "plan_created": {"source": "one of llm rule fallback", "fallback_used": "bool", "steps": "steps"},
    "context_updated": TURN | {"included_sections": "names", "skipped_sections": "names", "warnings": "strings", "retrieval": "object", "question_preflight": "object", "harness_budget": "object", "harness_context": "object"},
    "llm_started": TURN | {"purpose": f"one of {PURPOSES}", "model": "string"},
    "llm_finished": TURN | SPAN | {"purpose": f"one of {PURPOSES}", "success": "bool", "fallback_used": "bool", "model": "string", "usage": "object", "error": "error", "harness_context": "object"},
    "tool_started": TURN | {"arguments": "object", "reason": "string"},
    "tool_finished": SPAN | {"outcome": "one of success failed denied", "summary": "string", "result_summary": "string", "error": "error", "denied_by": "one of policy hook other", "retrieval": "object", "graph": "object", "retrieval_origin": "one of question_preflight", "initial_pack_digest": "digest", "execution": "object"},
    "run_completed": END | {"stop_reason": "text", "has_result": "bool"},
    "run_failed": END | {"stage": "one of planning context llm tool summary agent_core backend", "error": "error"},
}
REQUIRED = {
    "run_started": "run_type snapshot_id", "plan_created": "source fallback_used steps", "context_updated": "included_sections", "llm_started": "purpose", "llm_finished": "purpose success fallback_used",
    "tool_started": "", "tool_finished": "outcome", "run_completed": "stop_reason has_result trace_complete", "run_failed": "stage error trace_complete",
}
CATEGORIES = ("configuration", "authentication", "rate_limit", "timeout", "invalid_response", "schema_validation", "policy_denied", "tool_error", "agent_error", "backend_error", "worker_lost", "unknown")
SECTIONS = ("system", "project", "plan", "tool_results", "evidence", "task_state", "memory", "execution_history")
DIAGNOSTICS = ("evidence_unavailable", "evidence_empty", "evidence_invalid", "evidence_binding_mismatch", "evidence_omitted", "chunk_ids_omitted", "retrieval_degraded", "static_graph_only", "execution_failed")
MOST_BYTES = 16_384


def _at(payload: Column, path: str) -> Column:
    return F.try_variant_get(payload, path, "variant")


def _kind(payload: Column, path: str) -> Column:
    """STRING, BOOLEAN, BIGINT, DECIMAL(..), DOUBLE, ARRAY<..>, OBJECT<..>, VOID; null where there is nothing."""
    return F.schema_of_variant(_at(payload, path))


def _listed(payload: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(payload, path, f"array<{kind}>")


def _holds(payload: Column, field: str, what: str) -> Column:
    """Whether a field that is there holds what it should."""
    path = f"$.{field}"
    kind, text, number = _kind(payload, path), F.try_variant_get(payload, path, "string"), F.try_variant_get(payload, path, "double")
    is_list, is_object, is_text = kind.startswith("ARRAY<"), kind.startswith("OBJECT<"), kind == "STRING"
    if what.startswith("one of "):
        return is_text & text.isin(*what.split()[2:])
    if what == "error":
        category = F.try_variant_get(payload, f"{path}.category", "string").isin(*CATEGORIES)
        known = F.forall(F.json_object_keys(F.to_json(_at(payload, path))), lambda k: k.isin("category", "code", "message"))
        strings = [F.coalesce(_kind(payload, f"{path}.{k}") == "STRING", F.lit(True)) for k in ("code", "message")]
        return is_object & category & F.coalesce(known, F.lit(False)) & strings[0] & strings[1]
    if what == "steps":
        steps = _listed(payload, path, "struct<step_index:bigint,tool:string,reason:string,required:boolean>")
        fine = F.forall(F.transform(steps, lambda s, i: (s["step_index"] == i) & s["reason"].isNotNull() & s["required"].isNotNull()), lambda x: F.coalesce(x, F.lit(False)))
        return is_list & F.coalesce(fine, F.lit(False))
    if what == "names":
        names = _listed(payload, path, "string")
        return is_list & F.coalesce((F.size(names) == F.size(F.array_distinct(names))) & F.forall(names, lambda x: F.coalesce(x.isin(*SECTIONS), F.lit(False))), F.lit(False))
    simple = {
        "text": is_text & (F.trim(text) != ""), "string": is_text, "bool": kind == "BOOLEAN", "object": is_object,
        "count": (kind == "BIGINT") & (number >= 0), "duration": kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & (number >= 0),
        "digest": is_text & text.rlike("^[0-9a-f]{64}$"), "strings": kind.isin("ARRAY<STRING>", "ARRAY<VOID>"),
    }
    return simple[what]


def _type_rules(name: str, parsed: Column, keys: Column) -> Column:
    """The rules that a sound payload of one type breaks."""
    fields, has = FIELDS[name], lambda f: F.array_contains(keys, f)
    broken = [F.when(~has(f), F.lit(f"missing:{f}")) for f in REQUIRED[name].split()]
    broken += [F.when(has(f) & ~F.coalesce(_holds(parsed, f, what), F.lit(False)), F.lit(f"bad:{f}")) for f, what in fields.items()]
    if name == "llm_finished":
        success = F.try_variant_get(parsed, "$.success", "boolean")
        broken += [F.when(success & has("error"), F.lit("error_without_failure")), F.when(~success & ~has("error"), F.lit("failure_without_error"))]
    if name == "tool_finished":
        origin = [has(f) for f in ("retrieval_origin", "initial_pack_digest", "retrieval")]
        broken.append(F.when((origin[0] | origin[1]) & ~(origin[0] & origin[1] & origin[2]), F.lit("origin")))
    more = F.transform(F.array_except(keys, F.array(*map(F.lit, fields))), lambda x: F.concat(F.lit("unexpected:"), x))
    return F.concat(F.array_compact(F.array(*broken)), more)


def payload_rules(payload: Column, kind: Column, parsed: Column, keys: Column) -> Column:
    """FLT-13: an array of the rules that a payload (JSON text) of an event type breaks: not_json, too_large, type, missing:f, unexpected:f, bad:f, and of fields that depend on each other error_without_failure, failure_without_error, origin.

    ``parsed`` is the payload as a variant and ``keys`` its names: columns of a projection of their own, since each rule reads them. Only the rules of a row's own type are looked at.
    """
    sound = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT<"), F.lit(False))
    broken = [F.when(~sound, F.lit("not_json")), F.when(F.octet_length(payload) > MOST_BYTES, F.lit("too_large")), F.when(~F.coalesce(kind.isin(*FIELDS), F.lit(False)), F.lit("type"))]
    own = F.when(~sound, F.array().cast("array<string>"))
    for name in FIELDS:
        own = own.when(kind == name, _type_rules(name, parsed, keys))
    return F.concat(F.array_compact(F.array(*broken)), own.otherwise(F.array().cast("array<string>")))


def payload_violations(events: DataFrame, key: str, kind: str, payload: str) -> DataFrame:
    """FLT-13: key and rule of every broken rule. One pass, in which a payload is made and parsed once; a null payload isn't JSON."""
    rows = events.select(key, F.col(kind).alias("kind"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumns({"parsed": F.try_parse_json("payload"), "keys": F.json_object_keys("payload")})
    return rows.select(key, F.explode(payload_rules(F.col("payload"), F.col("kind"), F.col("parsed"), F.col("keys"))).alias("rule"))


def _named(rules: Mapping[str, Column]) -> Column:
    """The names of rules that don't hold; one that can't be told doesn't."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def _distinct(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def preflight_rules(status: Column, reasons: Column, digest: Column, selected: Column, discarded: Column, budget: Column, tokens: Column) -> Column:
    """FLT-14: the rules that a preflight's record breaks: its reasons, digest, counts and budget have to agree with its status."""
    failed = status == "failed"
    nothing = digest.isNull() & budget.isNull() & tokens.isNull() & (selected == 0) & (discarded == 0)
    return _named({
        "status": status.isin("sufficient", "insufficient", "failed"),
        "reasons_known": F.forall(reasons, lambda x: x.isin("evidence_empty", "source_unavailable", "partial_coverage", "budget_limited", "relations_unconfirmed", "preflight_failed")) & (F.size(reasons) <= 6),
        "reasons_once": _distinct(reasons),
        "sufficient_without_reasons": (status != "sufficient") | (F.size(reasons) == 0),
        "insufficient_for_reasons": (status != "insufficient") | ((F.size(reasons) > 0) & ~F.array_contains(reasons, "preflight_failed")),
        "failed_alone": ~failed | ((F.size(reasons) == 1) & F.array_contains(reasons, "preflight_failed")),
        "failed_has_nothing": ~failed | nothing,
        "digest": digest.isNull() | digest.rlike("^[0-9a-f]{64}$"),
        "counts": selected.between(0, 20) & (discarded >= 0),
        "budget": budget.isNull() | budget.between(4096, 1048576),
        "tokens": failed | (digest.isNotNull() & budget.isNotNull() & (tokens >= 0) & (tokens <= budget)),
    })


def execution_rules(strategy: Column, requirement: Column, intent: Column, reasons: Column, preflight: Column) -> Column:
    """FLT-14: the rules that a question's decision breaks; ``preflight`` is the preflight's status, or null where there was none."""
    return _named({
        "strategy": strategy.isin("fast", "agent"),
        "requirement": (strategy == "agent") == (requirement == "multi_step"),
        "intent": intent.isin("general", "explain", "impact", "onboard", "entry", "dependency"),
        "reasons": F.size(reasons).between(1, 4) & _distinct(reasons),
        "upgrade": preflight.isNull() | ((preflight == "insufficient") == (strategy == "agent")),
    })


def result_rules(outcome: Column, quality: Column, references: Column, omitted: Column, unavailable: Column, diagnostics: Column) -> Column:
    """FLT-14: the rules that a result's record breaks. ``references`` counts what it shows (8 at most), ``unavailable`` those of them without coverage."""
    has = lambda name: F.array_contains(diagnostics, name)
    return _named({
        "outcome": outcome.isin("completed", "failed"),
        "quality": quality.isin("evidence_available", "partial", "insufficient", "unavailable"),
        "references": references.between(0, 8) & (omitted >= 0),
        "diagnostics": _distinct(diagnostics) & (F.size(diagnostics) <= 16) & F.forall(diagnostics, lambda x: x.isin(*DIAGNOSTICS)),
        "nothing_shown": (references > 0) | quality.isin("insufficient", "unavailable"),
        "failed_quality": (outcome != "failed") | quality.isin("partial", "unavailable"),
        "failed_said": (outcome == "failed") == has("execution_failed"),
        "omission_said": (omitted == 0) | has("evidence_omitted"),
        "available": (quality != "evidence_available") | ((F.size(diagnostics) == 0) & (unavailable == 0)),
    })
