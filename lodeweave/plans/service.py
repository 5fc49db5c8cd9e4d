"""Service queries: customers own orders, orders and events stand for runs and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import service as S
from .registry import Tables, query


@query("owner_page", """SELECT o_orderkey, o_custkey, o_totalprice, CAST(place AS INTEGER) AS place, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') > 120 AS has_more FROM
    (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders WHERE o_orderstatus = 'O') WHERE place > 100 AND place <= 120""")
def owner_page(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderstatus = 'O'")
    return S.page(rows, [F.desc("o_orderdate"), F.desc("o_orderkey")], 20, 100).select("o_orderkey", "o_custkey", "o_totalprice", "place", "has_more")


@query("history_page_late_lookup", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 200)")
def history_page_late_lookup(t: Tables) -> DataFrame:
    keys = S.page(t.orders.select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 20, 200).select("o_orderkey")
    return S.late_lookup(keys, t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey")


@query("latest_ready", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_ready(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderstatus = 'F'")
    return S.latest(rows, "o_custkey", F.struct("o_orderdate", "o_orderkey"), ["o_orderkey", "o_totalprice"])


@query("project_current_snapshot", """WITH l AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
    SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN o_orderkey END AS current FROM customer LEFT JOIN l ON o_custkey = c_custkey""")
def project_current_snapshot(t: Tables) -> DataFrame:
    """JOI-23: null unless the owner is in credit."""
    last = S.latest(t.orders.where("o_orderstatus = 'F'"), "o_custkey", F.struct("o_orderdate", "o_orderkey"), ["o_orderkey"])
    return t.customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("o_orderkey")).alias("current"))


@query("active_quota", """SELECT c_custkey AS o_custkey, coalesce(n, 0) AS active, coalesce(n, 0) >= 8 AS exhausted FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY o_custkey) ON o_custkey = c_custkey""")
def active_quota(t: Tables) -> DataFrame:
    return S.active_counts(t.orders, t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", F.col("o_orderstatus").isin("O", "P"), 8)


@query("single_active_violations", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) > 1")
def single_active_violations(t: Tables) -> DataFrame:
    """STR-11."""
    return t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("batch_lookup_missing", "SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def batch_lookup_missing(t: Tables) -> DataFrame:
    """JOI-22: keys that the lookup doesn't find, as pending orders are left out of it."""
    return t.lineitem.select("l_orderkey").distinct().join(t.orders.where("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")


@query("idempotent_submissions", "SELECT user_id, event_type, arg_min(props, (ts, event_id)) AS kept, count(*) AS n, min(props) <> max(props) AS conflict FROM events GROUP BY user_id, event_type")
def idempotent_submissions(t: Tables) -> DataFrame:
    return S.first_submissions(t.events, ["user_id", "event_type"], ["ts", "event_id"], "props")


@query("enqueue_backoff", "SELECT event_id, least(CASE WHEN a <= 1 THEN 5.0 WHEN a = 2 THEN 15.0 WHEN a = 3 THEN 30.0 WHEN a = 4 THEN 60.0 ELSE 60.0 * pow(2.0, a - 4) END, 900.0)::DOUBLE AS seconds FROM (SELECT event_id, event_id % 12 AS a FROM events)")
def enqueue_backoff(t: Tables) -> DataFrame:
    return t.events.select("event_id", S.backoff(F.col("event_id") % 12, 900.0).alias("seconds"))


@query("due_queue", "SELECT event_id, ts FROM events WHERE event_type = 'view' ORDER BY ts, value, event_id LIMIT 50")
def due_queue(t: Tables) -> DataFrame:
    """SRT-10."""
    return t.events.where("event_type = 'view'").orderBy("ts", "value", "event_id").limit(50).select("event_id", "ts")


@query("stale_lease_decision", """WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'semantic' WHEN 'click' THEN 'repository_index' WHEN 'purchase' THEN 'agent_run' ELSE 'other' END AS kind, value < 20 AS ready, event_id % 4 AS attempts, event_id % 5 <> 0 AS token, ts FROM events)
    SELECT event_id, CASE WHEN kind = 'semantic' THEN CASE WHEN ready THEN 'complete' WHEN attempts < 2 THEN 'requeue' ELSE 'fail' END
        WHEN kind = 'repository_index' THEN CASE WHEN NOT token THEN 'fail' WHEN ready THEN 'complete' WHEN attempts < 2 THEN 'requeue' ELSE 'fail' END
        WHEN kind = 'agent_run' THEN CASE WHEN NOT token THEN 'fail' WHEN attempts < 2 THEN 'requeue' ELSE 'fail' END ELSE 'fail' END AS decision
    FROM e WHERE ts + INTERVAL 420 SECOND < (SELECT max(ts) FROM events)""")
def stale_lease_decision(t: Tables) -> DataFrame:
    """STR-06 and STR-07: leases of 420 seconds that have run out at the last event's time."""
    now = F.broadcast(t.events.agg(F.max("ts").alias("now")))
    kind = F.when(F.col("event_type") == "view", "semantic").when(F.col("event_type") == "click", "repository_index").when(F.col("event_type") == "purchase", "agent_run").otherwise("other")
    late = t.events.join(now, F.col("ts") + F.expr("INTERVAL 420 SECOND") < F.col("now"))
    return late.select("event_id", S.stale_decision(kind, F.col("value") < 20, F.col("event_id") % 4, F.col("event_id") % 5 != 0).alias("decision"))


_STALE = """SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'semantic' WHEN event_type IN ('click', 'error') THEN 'repository_index' WHEN event_type = 'purchase' THEN 'agent_run' ELSE 'other' END AS task_type, event_id % 9 <> 0 AS has_project, event_id % 8 = 3 AS locked, k % 3 AS attempts,
    CASE WHEN k % 11 <> 0 THEN 'tok' END AS token, CASE WHEN k % 13 <> 0 THEN 1 + event_id % 4 END AS snapshot_id, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 4 < 2 THEN 'ready' WHEN k % 4 = 2 THEN 'indexing' ELSE 'failed' END AS snapshot_status, user_id AS project_id,
    CASE WHEN event_id % 23 = 0 THEN user_id + 1 ELSE user_id END AS snapshot_project, CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'building' ELSE 'ready' END AS project_status, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 9 ELSE 1 + event_id % 4 END AS current_snapshot,
    k % 2 = 0 AS artifact_ready, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN 9 ELSE 1 + event_id % 4 END AS continuation, event_id % 6 = 0 AS backfill, k % 19 <> 0 AS relations_valid, k % 5 <> 4 AS metadata_valid, event_id % 4 = 1 AS core_started, event_id % 10 = 7 AS has_result, event_id % 14 = 5 AS finished, event_id % 12 // 11 AS n_traces
    FROM (SELECT *, CAST({k} AS BIGINT) AS k FROM {events})"""
_DECIDED = f"""d AS (SELECT *, snapshot_id IS NULL OR token IS NULL OR snapshot_status IS NULL OR project_status IS NULL OR snapshot_project <> project_id AS lost FROM ({_STALE.format(k="json_extract(props, '$.k')", events="events")})),
    e AS (SELECT *, CASE WHEN has_project AND locked THEN 'deferred' WHEN task_type = 'semantic' THEN CASE WHEN coalesce(snapshot_status, '') <> 'ready' THEN 'fail' WHEN artifact_ready THEN 'complete' WHEN attempts < 2 THEN 'requeue' ELSE 'fail' END
        WHEN task_type = 'repository_index' THEN CASE WHEN lost THEN 'fail' WHEN snapshot_status = 'ready' AND project_status = 'ready' AND current_snapshot IS NOT DISTINCT FROM snapshot_id THEN CASE WHEN continuation IS NOT DISTINCT FROM snapshot_id THEN 'complete' WHEN attempts < 2 THEN 'requeue' ELSE 'fail' END
            WHEN (snapshot_status = 'indexing' OR backfill) AND coalesce(current_snapshot, snapshot_id) = snapshot_id AND attempts < 2 THEN 'requeue' ELSE 'fail' END
        WHEN task_type = 'agent_run' THEN CASE WHEN token IS NOT NULL AND relations_valid AND metadata_valid AND NOT core_started AND NOT has_result AND NOT finished AND n_traces = 0 AND attempts < 2 THEN 'requeue' ELSE 'fail' END ELSE 'fail' END AS decision FROM d)"""


def _stale(t: Tables) -> DataFrame:
    text = _STALE.format(k="get_json_object(props, '$.k')", events="{rows}").replace("event_id % 12 // 11", "event_id % 12 div 11")
    return S.stale_decisions(t.spark.sql(text, rows=t.events))


@query("stale_decision_table", f"WITH {_DECIDED} SELECT id, decision, CASE WHEN decision = 'fail' THEN CASE WHEN task_type = 'agent_run' AND token IS NOT NULL AND core_started THEN 'worker_lost_after_agent_core' ELSE 'worker_execution_lost' END END AS code, decision = 'fail' AND task_type = 'repository_index' AND NOT lost AND backfill AS restores FROM e")
def stale_decision_table(t: Tables) -> DataFrame:
    """STR-07: the whole table of decisions, with deferral of locked projects."""
    return _stale(t).select("id", "decision", "code", "restores")


@query("stale_settled", f"WITH {_DECIDED} SELECT CASE WHEN id % 15 = 4 THEN 'deferred' ELSE decision END AS decision, count(*) AS n FROM e GROUP BY 1")
def stale_settled(t: Tables) -> DataFrame:
    """STR-07: what becomes of the decisions where every fifteenth task has moved on meanwhile."""
    rows = _stale(t).withColumn("version", F.col("id"))
    now = t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 15 == 4, -1).otherwise(F.col("event_id")).alias("version"))
    return S.settled(rows, now, "id", "version")
