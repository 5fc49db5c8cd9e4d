"""Event-log queries: a user is a run; views start and clicks finish a call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import traces as T
from ..operators.selection import percentiles
from .registry import Tables, query

ORDER = ["ts", "event_id"]
_START, _FINISH = "view", "click"
_TYPES = {"view": "llm_started", "click": "llm_finished", "purchase": "tool_started", "signup": "plan_created", "error": "run_failed"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items()) + " ELSE 'unknown' END"
_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence FROM events"


def _kind(column: str = "event_type"):
    out = F.lit("unknown")
    for a, b in _TYPES.items():
        out = F.when(F.col(column) == a, b).otherwise(out)
    return out


@query("trace_normalize_sequence", f"""WITH n AS (SELECT user_id, event_id, ts, {_CASE} AS type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)
    SELECT user_id, event_id, type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence FROM n WHERE type <> 'plan_created' OR k = 1""")
def trace_normalize_sequence(t: Tables) -> DataFrame:
    """STR-01: public types, the first plan alone, contiguous sequence numbers."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(*ORDER))
    rows = t.events.select("user_id", "event_id", "ts", _kind().alias("type"), k.alias("k")).where("type <> 'plan_created' OR k = 1")
    return T.sequenced(rows, "user_id", ORDER).select("user_id", "event_id", "type", "sequence")


@query("trace_pair_lifo", """WITH s AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 END AS step FROM events WHERE event_type IN ('view', 'click')),
    d AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + CASE WHEN step = -1 THEN 1 ELSE 0 END AS depth FROM s),
    l AS (SELECT *, lead(step) OVER w AS next_step, lead(event_id) OVER w AS finish_id FROM d WINDOW w AS (PARTITION BY user_id, depth ORDER BY ts, event_id))
    SELECT user_id, event_id AS start_id, finish_id FROM l WHERE step = 1 AND next_step = -1""")
def trace_pair_lifo(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return T.paired_lifo(t.events.select("user_id", "event_id", "ts", "event_type"), "user_id", ORDER, kind == _START, kind == _FINISH, "event_id")


@query("trace_pair_fifo", f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM ({_NUMBERED}) WHERE event_type IN ('view', 'click'))
    SELECT a.user_id, a.event_id AS start_id, b.event_id AS finish_id FROM p a JOIN p b ON a.user_id = b.user_id AND a.n = b.n AND a.event_type = 'view' AND b.event_type = 'click' AND a.sequence < b.sequence""")
def trace_pair_fifo(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return T.paired_fifo(t.events.select("user_id", "event_id", "ts", "event_type"), "user_id", ORDER, kind == _START, kind == _FINISH, "event_id")


@query("trace_summary", """SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'view') AS n_started, count(*) FILTER (event_type = 'click') AS n_finished, count(*) FILTER (event_type = 'error') AS n_failed,
    CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'complete' WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'partial' ELSE 'failed' END AS outcome FROM events GROUP BY user_id""")
def trace_summary(t: Tables) -> DataFrame:
    """AGG-11, AGG-12 and AGG-15."""
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    rows = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), of("view").alias("n_started"), of("click").alias("n_finished"), of("error").alias("n_failed"))
    return rows.withColumn("outcome", F.when(F.col("n_failed") == 0, "complete").when(F.col("n_finished") > 0, "partial").otherwise("failed"))


@query("trace_gap_detect", f"""WITH k AS (SELECT * FROM ({_NUMBERED}) WHERE event_type <> 'error'), g AS (SELECT user_id, sequence, coalesce(lag(sequence) OVER (PARTITION BY user_id ORDER BY sequence), -1) + 1 AS from_sequence FROM k)
    SELECT user_id, from_sequence, sequence - 1 AS to_sequence FROM g WHERE sequence > from_sequence""")
def trace_gap_detect(t: Tables) -> DataFrame:
    """Errors are taken out after numbering, so that numbers are missing."""
    rows = T.sequenced(t.events.select("user_id", "event_id", "ts", "event_type"), "user_id", ORDER)
    return T.gaps(rows.where("event_type <> 'error'"), "user_id")


@query("latency_histogram", "SELECT event_type, le, count(*) FILTER (value <= b) AS n FROM events, (VALUES ('0.01', 0.01::DOUBLE), ('0.05', 0.05), ('0.1', 0.1), ('0.5', 0.5), ('1.0', 1.0), ('5.0', 5.0), ('30.0', 30.0), ('120.0', 120.0), ('+Inf', 'inf'::DOUBLE)) AS x(le, b) WHERE value IS NOT NULL GROUP BY event_type, le")
def latency_histogram(t: Tables) -> DataFrame:
    return T.histogram(t.events, "event_type", "value")


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, quantile_disc(value, 0.5) AS p50_nearest, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def latency_percentiles(t: Tables) -> DataFrame:
    return percentiles(t.events, "event_type", "value")


@query("task_metrics_matrix", """WITH e AS (SELECT CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'other' END AS kind, CASE WHEN value < 10 THEN 'queued' WHEN value < 50 THEN 'running' ELSE 'completed' END AS status, value FROM events),
    a AS (SELECT kind, status, count(*) AS n, round(sum(greatest(value - 5, 0)), 4) AS wait FROM e GROUP BY ALL)
    SELECT k.kind, s.status, coalesce(a.n, 0) AS n, coalesce(a.wait, 0) AS wait FROM (VALUES ('view'), ('click'), ('purchase'), ('other')) AS k(kind), (VALUES ('queued'), ('running'), ('completed'), ('failed')) AS s(status) LEFT JOIN a ON a.kind = k.kind AND a.status = s.status""")
def task_metrics_matrix(t: Tables) -> DataFrame:
    """AGG-07 and AGG-08: every type and status has a row, missing ones 0."""
    kind = F.when(F.col("event_type").isin("view", "click", "purchase"), F.col("event_type")).otherwise("other")
    status = F.when(F.col("value") < 10, "queued").when(F.col("value") < 50, "running").otherwise("completed")
    found = t.events.groupBy(kind.alias("kind"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.greatest(F.col("value") - 5, F.lit(0.0))), 4).alias("wait"))
    every = t.spark.createDataFrame([(k, s) for k in ("view", "click", "purchase", "other") for s in ("queued", "running", "completed", "failed")], "kind string, status string")
    return every.join(found, ["kind", "status"], "left").select("kind", "status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("wait", F.lit(0.0)).alias("wait"))


@query("budget_first_stop", """WITH c AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'view' AND count(*) FILTER (event_type = 'view') OVER w > 8 THEN 'budget_models' WHEN event_type = 'purchase' AND count(*) FILTER (event_type = 'purchase') OVER w > 3 THEN 'budget_tools' WHEN count(*) OVER w > 30 THEN 'budget_turns' END AS reason
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT user_id, event_id, reason FROM c WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def budget_first_stop(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    limits = [("models", kind == "view", 8, "budget_models"), ("tools", kind == "purchase", 3, "budget_tools"), ("turns", F.lit(True), 30, "budget_turns")]
    return T.first_stop(t.events.select("user_id", "event_id", "ts", "event_type"), "user_id", ORDER, limits)


_ALLOWED = [("view", "view"), ("view", "click"), ("click", "view"), ("click", "purchase"), ("purchase", "view"), ("signup", "view"), ("view", "error")]


@query("state_transition_violations", f"""WITH l AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, event_type AS now FROM events)
    SELECT * FROM l WHERE was IS NOT NULL AND concat(was, '>', now) NOT IN ({', '.join(f"'{a}>{b}'" for a, b in _ALLOWED)})""")
def state_transition_violations(t: Tables) -> DataFrame:
    return T.transitions(t.events, "user_id", ORDER, "event_type", _ALLOWED)


@query("fixed_window_limiter", """WITH RECURSIVE e AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT *, ts AS opened, 1 AS used FROM e WHERE n = 1 UNION ALL SELECT e.*, CASE WHEN e.ts >= w.opened + INTERVAL 3600 SECOND THEN e.ts ELSE w.opened END, CASE WHEN e.ts >= w.opened + INTERVAL 3600 SECOND THEN 1 ELSE w.used + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.n = w.n + 1)
    SELECT user_id, event_type, ts, event_id, used <= 2 AS admitted FROM w""")
def fixed_window_limiter(t: Tables) -> DataFrame:
    """Two events of a user and type in an hour."""
    return T.fixed_window_limit(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", 2, 3600, ["event_id"])


@query("session_gaps", """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_id FROM s GROUP BY user_id, session""")
def session_gaps(t: Tables) -> DataFrame:
    """An extension: sessions of a user that a day without events ends."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy(*ORDER)
    fresh = F.when(F.col("ts") - F.lag("ts").over(order) <= F.expr("INTERVAL 1 DAY"), 0).otherwise(1)
    rows = t.events.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("event_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def event_properties(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k IS NOT NULL")
