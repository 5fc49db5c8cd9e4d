"""Payload and metadata rules over ``events``: JSON texts and records with faults that follow from each event's number, so that SQL can tell the broken rules without reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import payloads as P
from .registry import Tables, query

_NUMBERED = "SELECT event_id, event_type, CAST({k} AS BIGINT) AS k FROM {events}"
_KIND = "CASE event_type WHEN 'view' THEN 'llm_started' WHEN 'click' THEN 'llm_finished' WHEN 'purchase' THEN 'tool_finished' WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'plan_created' ELSE 'context_updated' END ELSE CASE k % 3 WHEN 0 THEN 'run_completed' WHEN 1 THEN 'run_failed' ELSE 'guess' END END"
_PAYLOAD = """CASE event_type
    WHEN 'view' THEN concat('{"purpose":"', CASE WHEN k % 10 = 0 THEN 'guess' ELSE 'plan' END, '"', CASE k % 7 WHEN 0 THEN ',"turn_index":-1' WHEN 1 THEN ',"turn_index":"2"' ELSE ',"turn_index":3' END, CASE WHEN k % 11 = 0 THEN ',"extra":1' ELSE '' END, CASE WHEN k % 23 = 0 THEN '' ELSE '}' END)
    WHEN 'click' THEN concat('{"purpose":"summary","success":', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, CASE k % 5 WHEN 0 THEN ',"error":{"category":"timeout","code":"x"}' WHEN 1 THEN ',"error":{"category":"odd"}' WHEN 2 THEN ',"error":{"category":"unknown","why":1}' ELSE '' END, CASE WHEN k % 6 = 0 THEN '' ELSE ',"fallback_used":false' END, CASE WHEN k % 9 = 0 THEN ',"duration_ms":-2' ELSE ',"duration_ms":1.5' END, '}')
    WHEN 'purchase' THEN concat('{"outcome":"', CASE WHEN k % 4 = 0 THEN 'lost' ELSE 'success' END, '"', CASE k % 8 WHEN 1 THEN ',"retrieval_origin":"question_preflight"' WHEN 2 THEN concat(',"retrieval_origin":"question_preflight","retrieval":{},"initial_pack_digest":"', repeat('a1', 32), '"') WHEN 3 THEN ',"summary":5' WHEN 5 THEN ',"denied_by":"nobody"' ELSE '' END, '}')
    WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN concat('{"source":"llm","fallback_used":', CASE WHEN k % 3 = 0 THEN '"no"' ELSE 'true' END, ',"steps":[{"step_index":', CASE WHEN k % 5 = 0 THEN '1' ELSE '0' END, ',"tool":null,"reason":"r","required":true}]}')
        ELSE concat('{"included_sections":["plan","', CASE WHEN k % 3 = 0 THEN 'plan' WHEN k % 3 = 1 THEN 'attic' ELSE 'memory' END, '"],"warnings":', CASE WHEN k % 5 = 0 THEN '[1]' ELSE '["w"]' END, '}') END
    ELSE CASE k % 3 WHEN 0 THEN concat('{"has_result":true', CASE WHEN k % 2 = 0 THEN ',"stop_reason":" "' ELSE ',"stop_reason":"final"' END, CASE WHEN k % 5 = 0 THEN '' ELSE ',"trace_complete":true' END, '}')
        WHEN 1 THEN concat('{"stage":"', CASE WHEN k % 2 = 0 THEN 'attic' ELSE 'tool' END, '","error":"text","trace_complete":1}') ELSE '{}' END END"""
_DUCK = f"e AS (SELECT event_id, k, {_KIND} AS kind FROM ({_NUMBERED.format(k="json_extract(props, '$.k')", events="events")}))"
_BROKEN = (
    ("llm_started", "k % 23 = 0", "not_json"), ("llm_started", "k % 23 <> 0 AND k % 10 = 0", "bad:purpose"), ("llm_started", "k % 23 <> 0 AND k % 7 < 2", "bad:turn_index"), ("llm_started", "k % 23 <> 0 AND k % 11 = 0", "unexpected:extra"),
    ("llm_finished", "k % 6 = 0", "missing:fallback_used"), ("llm_finished", "k % 5 IN (1, 2)", "bad:error"), ("llm_finished", "k % 9 = 0", "bad:duration_ms"), ("llm_finished", "k % 2 = 0 AND k % 5 < 3", "error_without_failure"), ("llm_finished", "k % 2 = 1 AND k % 5 > 2", "failure_without_error"),
    ("tool_finished", "k % 4 = 0", "bad:outcome"), ("tool_finished", "k % 8 = 1", "origin"), ("tool_finished", "k % 8 = 3", "bad:summary"), ("tool_finished", "k % 8 = 5", "bad:denied_by"),
    ("plan_created", "k % 3 = 0", "bad:fallback_used"), ("plan_created", "k % 5 = 0", "bad:steps"), ("context_updated", "k % 3 < 2", "bad:included_sections"), ("context_updated", "k % 5 = 0", "bad:warnings"),
    ("run_completed", "k % 2 = 0", "bad:stop_reason"), ("run_completed", "k % 5 = 0", "missing:trace_complete"), ("run_failed", "k % 2 = 0", "bad:stage"), ("run_failed", "true", "bad:error"), ("run_failed", "true", "bad:trace_complete"), ("guess", "true", "type"),
)


def _numbered(t: Tables) -> DataFrame:
    return t.spark.sql(_NUMBERED.format(k="get_json_object(props, '$.k')", events="{rows}"), rows=t.events)


@query("payload_violations", f"WITH {_DUCK} " + " UNION ALL ".join(f"SELECT event_id, '{rule}' AS rule FROM e WHERE kind = '{kind}' AND {where}" for kind, where, rule in _BROKEN))
def payload_violations(t: Tables) -> DataFrame:
    """FLT-13: payloads as JSON texts, and every rule of their type that they break."""
    rows = _numbered(t).select("event_id", F.expr(_KIND).alias("kind"), F.expr(_PAYLOAD).alias("payload"))
    return P.payload_violations(rows, "event_id", "kind", "payload")


_RECORD = """SELECT event_id, k, CASE k % 4 WHEN 0 THEN 'sufficient' WHEN 1 THEN 'insufficient' WHEN 2 THEN 'failed' ELSE 'maybe' END AS status, CASE WHEN k % 5 = 0 THEN 0 WHEN k % 5 = 1 THEN 1 WHEN k % 5 = 2 THEN 2 ELSE 3 END AS why, k % 6 = 0 AS no_digest, CASE WHEN k % 7 = 0 THEN 25 WHEN k % 7 = 1 THEN 0 ELSE 4 END AS selected,
    CASE WHEN k % 8 = 0 THEN NULL WHEN k % 8 = 1 THEN 1000 ELSE 8192 END AS budget, CASE WHEN k % 9 = 0 THEN 9000 WHEN k % 9 = 1 THEN NULL ELSE 500 END AS tokens FROM"""


def _reasons():
    """Reasons by number: none; one; that of a failure alone; one twice."""
    lists = [[], ["evidence_empty"], ["preflight_failed"], ["partial_coverage"] * 2]
    return F.coalesce(*(F.when(F.col("why") == i, F.array(*map(F.lit, x)).cast("array<string>")) for i, x in enumerate(lists)))


_PREFLIGHT = (
    ("status", "status = 'maybe'"), ("reasons_once", "why = 3"), ("sufficient_without_reasons", "status = 'sufficient' AND why > 0"), ("insufficient_for_reasons", "status = 'insufficient' AND why IN (0, 2)"), ("failed_alone", "status = 'failed' AND why <> 2"),
    ("failed_has_nothing", "status = 'failed' AND NOT (no_digest AND budget IS NULL AND tokens IS NULL AND selected = 0)"), ("counts", "selected = 25"), ("budget", "budget = 1000"), ("tokens", "status <> 'failed' AND (no_digest OR budget IS NULL OR tokens IS NULL OR tokens > budget)"),
)


@query("preflight_violations", f"WITH {_DUCK}, r AS ({_RECORD} e) " + " UNION ALL ".join(f"SELECT event_id, '{rule}' AS rule FROM r WHERE {where}" for rule, where in _PREFLIGHT))
def preflight_violations(t: Tables) -> DataFrame:
    """FLT-14: preflight records whose status, reasons, digest, counts and budget don't agree."""
    rows = t.spark.sql(f"{_RECORD} {{rows}}", rows=_numbered(t))
    digest = F.when(~F.col("no_digest"), F.sha2(F.col("event_id").cast("string"), 256))
    rules = P.preflight_rules(F.col("status"), _reasons(), digest, F.col("selected"), F.lit(0), F.col("budget"), F.col("tokens"))
    return rows.select("event_id", F.explode(rules).alias("rule"))


_RESULT = """SELECT event_id, CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'completed' END AS outcome, CASE k % 4 WHEN 0 THEN 'evidence_available' WHEN 1 THEN 'partial' WHEN 2 THEN 'insufficient' ELSE 'unavailable' END AS quality, k % 10 AS shown, CASE WHEN k % 6 = 0 THEN 2 ELSE 0 END AS omitted, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS uncovered, k % 5 = 0 AS says_failed, k % 11 = 0 AS says_omitted FROM"""
_RESULT_RULES = (
    ("references", "shown > 8"), ("nothing_shown", "shown = 0 AND quality IN ('evidence_available', 'partial')"), ("failed_quality", "outcome = 'failed' AND quality IN ('evidence_available', 'insufficient')"), ("failed_said", "(outcome = 'failed') <> says_failed"),
    ("omission_said", "omitted > 0 AND NOT says_omitted"), ("available", "quality = 'evidence_available' AND (says_failed OR says_omitted OR uncovered > 0)"),
)


@query("result_violations", f"WITH {_DUCK}, r AS ({_RESULT} e) " + " UNION ALL ".join(f"SELECT event_id, '{rule}' AS rule FROM r WHERE {where}" for rule, where in _RESULT_RULES))
def result_violations(t: Tables) -> DataFrame:
    """FLT-14: result records whose outcome, quality, references and diagnostics don't agree."""
    rows = t.spark.sql(f"{_RESULT} {{rows}}", rows=_numbered(t))
    diagnostics = F.array_compact(F.array(F.when(F.col("says_failed"), F.lit("execution_failed")), F.when(F.col("says_omitted"), F.lit("evidence_omitted"))))
    rules = P.result_rules(F.col("outcome"), F.col("quality"), F.col("shown"), F.col("omitted"), F.col("uncovered"), diagnostics)
    return rows.select("event_id", F.explode(rules).alias("rule"))
