"""Runs, sessions, records and tasks over time: users' events are runs, messages are records, orders are tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import arbitration as A
from ..operators import evidence as E
from ..operators import memory as M
from ..operators import traces as T
from .memory import _DAG, tasks
from .registry import Tables, query
from .traces import ORDER

_RUN = "PARTITION BY user_id ORDER BY ts, event_id"


@query("newly_ready", f"""WITH {_DAG}, p AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'), o AS (SELECT d.id, count(*) AS open FROM d LEFT JOIN t ON t.id = d.needs WHERE t.done IS NULL OR NOT t.done GROUP BY d.id)
    SELECT d.needs AS completed, d.id FROM d JOIN p ON p.id = d.needs JOIN t ON t.id = d.id AND NOT t.done JOIN o ON o.id = d.id WHERE o.open = 1""")
def newly_ready(t: Tables) -> DataFrame:
    """GQ-13: what each order in progress would set free."""
    rows, needs = tasks(t)
    return M.newly_ready(rows, needs, t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")))


_CHAIN = "c AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, role, text, CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 END AS parent, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)"


@query("retracted_records", f"""WITH RECURSIVE {_CHAIN}, a(node, ancestor) AS (SELECT id, parent FROM c WHERE last AND role = 'assistant' AND parent IS NOT NULL UNION ALL SELECT a.node, c.parent FROM a JOIN c ON c.id = a.ancestor WHERE c.parent IS NOT NULL),
    o AS (SELECT DISTINCT ancestor AS id FROM a JOIN c ON c.id = a.ancestor), b AS (SELECT DISTINCT role, length(text) AS n FROM c WHERE id IN (SELECT id FROM o)) SELECT c.id FROM c JOIN b ON b.role = c.role AND b.n = length(c.text) WHERE c.id NOT IN (SELECT id FROM o)""")
def retracted_records(t: Tables) -> DataFrame:
    """GQ-15: a conversation's last answer withdraws the messages before it; messages elsewhere with their target (role and length) are retracted too."""
    key = F.col("conv_id") * 100 + F.col("turn")
    ends = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = t.conversations.join(ends, "conv_id").select(key.alias("id"), "role", "text", (F.col("turn") == F.col("last")).alias("last"), F.when(F.col("turn") > 0, key - 1).alias("parent"))
    parents = rows.select(F.col("id").alias("node"), "parent").join(rows.select(F.col("id").alias("parent")), "parent", "left_semi").select("node", "parent")
    withdrawn = rows.where("last AND role = 'assistant'").select(F.col("id").alias("node"))
    target = F.concat_ws(":", "role", F.length("text").cast("string"))
    return M.retracted(rows.select("id", target.alias("target")), withdrawn, parents.withColumnRenamed("parent", "onward"), "id", "target").select("id")


@query("tool_pairs", """WITH k AS (SELECT user_id, date_trunc('day', ts) AS turn, count(*) FILTER (event_type = 'view') AS starts, count(*) FILTER (event_type = 'click') AS finishes, min(event_id) FILTER (event_type = 'view') AS start_id, min(event_id) FILTER (event_type = 'click') AS finish_id, min(ts) FILTER (event_type = 'view') AS a, min(ts) FILTER (event_type = 'click') AS b FROM events GROUP BY ALL)
    SELECT user_id, start_id, finish_id, a <= b AS in_order FROM k WHERE starts = 1 AND finishes = 1""")
def tool_pairs(t: Tables) -> DataFrame:
    """JOI-24: a user's view and click of one day are a pair if the day has one of each; of more it can't be told and none is paired. One aggregate, no self-join."""
    of = lambda kind, c: F.min(F.when(F.col("event_type") == kind, F.col(c)))
    count = lambda kind: F.count_if(F.col("event_type") == kind)
    rows = t.events.groupBy("user_id", F.date_trunc("day", "ts").alias("turn")).agg(count("view").alias("starts"), count("click").alias("finishes"), of("view", "event_id").alias("start_id"), of("click", "event_id").alias("finish_id"), of("view", "ts").alias("a"), of("click", "ts").alias("b"))
    return rows.where("starts = 1 AND finishes = 1").select("user_id", "start_id", "finish_id", (F.col("a") <= F.col("b")).alias("in_order"))


@query("tool_pairs_asof", """WITH e AS (SELECT user_id, date_trunc('day', ts) AS turn, event_type, event_id, ts FROM events), p AS (SELECT f.user_id, f.turn, s.event_id AS start_id, f.event_id AS finish_id, f.ts AS finished FROM (SELECT * FROM e WHERE event_type = 'click') f ASOF JOIN (SELECT * FROM e WHERE event_type = 'view') s ON s.user_id = f.user_id AND s.turn = f.turn AND s.ts < f.ts)
    SELECT user_id, turn, start_id, finish_id FROM p QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY finished) = 1""")
def tool_pairs_asof(t: Tables) -> DataFrame:
    """JOI-24: a user's clicks of a day, each with the last view before it that is still open, of however many."""
    rows = t.events.select("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("turn"), "event_type", "event_id", "ts")
    return A.paired_open(rows, ["user_id", "turn"], ORDER, F.col("event_type") == "view", F.col("event_type") == "click", "event_id")


_WRITES = "w AS (SELECT *, (place - 1) // 3 + k % 3 - 1 AS expected FROM (SELECT user_id, event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events))"
_WON = f"""WITH RECURSIVE {_WRITES}, c(user_id, version, place) AS (SELECT user_id, 0::BIGINT, min(place) FROM w WHERE expected = 0 GROUP BY user_id
    UNION ALL SELECT c.user_id, c.version + 1, min(w.place) FROM c JOIN w ON w.user_id = c.user_id AND w.expected = c.version + 1 AND w.place > c.place GROUP BY c.user_id, c.version)"""


def _rival_writes(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER))
    rows = t.events.select("user_id", "event_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"), place.alias("nth"))
    return rows.withColumn("expected", (F.floor((F.col("nth") - 1) / 3) + F.col("k") % 3 - 1).cast("long"))


@query("compare_and_set", f"{_WON} SELECT w.user_id, w.event_id, w.expected, c.place IS NOT NULL AS won FROM w LEFT JOIN c ON c.user_id = w.user_id AND c.place = w.place")
def compare_and_set(t: Tables) -> DataFrame:
    """STR-09: a user's events as writes that each expect a version of the user's state; which of them are done and which are noops."""
    return A.compared_and_set(_rival_writes(t), "user_id", ORDER, "expected", "event_id").select("user_id", "event_id", "expected", "won")


@query("compare_and_set_state", f"{_WON}, v AS (SELECT w.*, c.place IS NOT NULL AS won FROM w LEFT JOIN c ON c.user_id = w.user_id AND c.place = w.place) SELECT user_id, coalesce(max(expected + 1) FILTER (won), 0) AS version, arg_max(event_type, expected) FILTER (won) AS state, count(*) FILTER (NOT won) AS noops FROM v GROUP BY user_id")
def compare_and_set_state(t: Tables) -> DataFrame:
    """STR-09: the state that is left."""
    return A.final_state(A.compared_and_set(_rival_writes(t), "user_id", ORDER, "expected", "event_id"), "user_id", "expected", "event_type")


@query("stream_prefix_check", f"""WITH s AS (SELECT user_id, event_id, row_number() OVER ({_RUN}) - 1 AS sequence FROM events), r AS (SELECT user_id, event_id, row_number() OVER ({_RUN}) - 1 AS sequence FROM events WHERE event_type <> 'error'), n AS (SELECT user_id, max(sequence) AS last FROM r GROUP BY user_id)
    SELECT coalesce(s.user_id, r.user_id) AS user_id, coalesce(s.sequence, r.sequence) AS sequence, CASE WHEN s.event_id IS NULL THEN 'not_stored' WHEN r.event_id IS NULL THEN 'not_streamed' WHEN s.event_id <> r.event_id THEN 'different' ELSE 'same' END AS verdict
    FROM s FULL JOIN r ON r.user_id = s.user_id AND r.sequence = s.sequence LEFT JOIN n ON n.user_id = coalesce(s.user_id, r.user_id) WHERE coalesce(s.sequence, r.sequence) <= n.last""")
def stream_prefix_check(t: Tables) -> DataFrame:
    """JOI-30: what was streamed (errors got lost) against what is stored, number by number up to the last one streamed."""
    rows = t.events.select("user_id", "event_id", "ts", "event_type")
    stored_ = T.sequenced(rows, "user_id", ORDER).select("user_id", "sequence", F.col("event_id").alias("stored_id"))
    streamed = T.sequenced(rows.where("event_type <> 'error'"), "user_id", ORDER).select("user_id", "sequence", F.col("event_id").alias("streamed_id"))
    both = stored_.join(streamed, ["user_id", "sequence"], "full_outer").join(streamed.groupBy("user_id").agg(F.max("sequence").alias("last")), "user_id").where(F.col("sequence") <= F.col("last"))
    verdict = F.when(F.col("stored_id").isNull(), "not_stored").when(F.col("streamed_id").isNull(), "not_streamed").when(F.col("stored_id") != F.col("streamed_id"), "different").otherwise("same")
    return both.select("user_id", "sequence", verdict.alias("verdict"))


@query("no_progress", f"""WITH e AS (SELECT user_id, event_id, ts, concat(event_type, ':', CAST(json_extract(props, '$.k') AS VARCHAR)) AS call FROM events), f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, call ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS fresh FROM e),
    p AS (SELECT *, sum(fresh) OVER ({_RUN} ROWS UNBOUNDED PRECEDING) AS epoch FROM f), s AS (SELECT *, row_number() OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id) - 1 AS stagnant, row_number() OVER (PARTITION BY user_id, epoch, call ORDER BY ts, event_id) AS repeats FROM p)
    SELECT user_id, event_id, CAST(epoch AS BIGINT) AS epoch, CAST(stagnant AS INTEGER) AS stagnant, CAST(repeats AS INTEGER) AS repeats, repeats >= 2 OR stagnant >= 3 AS blocked FROM s""")
def no_progress(t: Tables) -> DataFrame:
    call = F.concat(F.col("event_type"), F.lit(":"), F.get_json_object("props", "$.k"))
    return E.no_progress(t.events.select("user_id", "event_id", "ts", call.alias("call")), "user_id", ORDER, "call").select("user_id", "event_id", "epoch", "stagnant", "repeats", "blocked")


_KIND = "CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'other' END"
_STATUS = "CASE WHEN value < 10 THEN 'queued' WHEN value < 50 THEN 'running' ELSE 'completed' END"


@query("task_metrics", f"""WITH n AS (SELECT max(ts) AS now FROM events), e AS (SELECT {_KIND} AS kind, {_STATUS} AS status, value, CASE WHEN value >= 10 THEN ts END AS started_at, date_diff('second', ts, now) AS age FROM events, n)
    SELECT kind, status, count(*) AS n, count(started_at) AS started, round(sum(greatest(value - 5, 0)), 4) AS wait, CAST(max(CASE WHEN status = 'queued' THEN greatest(age, 0) ELSE 0 END) AS BIGINT) AS oldest_age FROM e GROUP BY kind, status""")
def task_metrics(t: Tables) -> DataFrame:
    """AGG-07: by kind and status how many, how many have started, how long they waited and how old the oldest queued one is, in seconds."""
    kind = F.when(F.col("event_type").isin("view", "click", "purchase"), F.col("event_type")).otherwise("other")
    status = F.when(F.col("value") < 10, "queued").when(F.col("value") < 50, "running").otherwise("completed")
    now = F.broadcast(t.events.agg(F.max("ts").alias("now")))
    age = F.unix_timestamp(F.date_trunc("second", "now")) - F.unix_timestamp(F.date_trunc("second", "ts"))
    rows = t.events.join(now, F.lit(True)).select(kind.alias("kind"), status.alias("status"), "value", age.alias("age"))
    return rows.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 10).alias("started"), F.round(F.sum(F.greatest(F.col("value") - 5, F.lit(0.0))), 4).alias("wait"), F.max(F.when(F.col("status") == "queued", F.greatest("age", F.lit(0))).otherwise(0)).alias("oldest_age"))


@query("latency_totals", "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def latency_totals(t: Tables) -> DataFrame:
    """AGG-09: the count and sum that go with a histogram's buckets."""
    return t.events.groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("request_counters", "SELECT event_type AS route, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'GET' ELSE 'POST' END AS method, concat(CAST(least(5, 2 + floor(value / 40)) AS INTEGER), 'xx') AS status_class, count(*) AS n FROM events GROUP BY ALL")
def request_counters(t: Tables) -> DataFrame:
    """AGG-10: by route, method and class of status."""
    method = F.when(F.get_json_object("props", "$.k").isNull(), "GET").otherwise("POST")
    status = F.concat(F.least(F.lit(5), 2 + F.floor(F.col("value") / 40)).cast("string"), F.lit("xx"))
    return t.events.groupBy(F.col("event_type").alias("route"), method.alias("method"), status.alias("status_class")).agg(F.count(F.lit(1)).alias("n"))


@query("metrics_exposition", """SELECT concat('latency_bucket{type="', event_type, '",le="', le, '"} ', n) AS line FROM (SELECT event_type, le, count(*) FILTER (value <= b) AS n FROM events, (VALUES ('0.01', 0.01::DOUBLE), ('0.05', 0.05), ('0.1', 0.1), ('0.5', 0.5), ('1.0', 1.0), ('5.0', 5.0), ('30.0', 30.0), ('120.0', 120.0), ('+Inf', 'inf'::DOUBLE)) AS x(le, b) WHERE value IS NOT NULL GROUP BY event_type, le)
    UNION ALL SELECT concat('latency_count{type="', event_type, '"} ', count(value)) FROM events GROUP BY event_type UNION ALL SELECT concat('events_total{type="', event_type, '"} ', count(*)) FROM events GROUP BY event_type""")
def metrics_exposition(t: Tables) -> DataFrame:
    """SRC-32: buckets, counts and totals as lines of the text format."""
    buckets = T.histogram(t.events, "event_type", "value").select(F.format_string('latency_bucket{type="%s",le="%s"} %d', "event_type", "le", "n").alias("line"))
    each = t.events.groupBy("event_type").agg(F.count("value").alias("m"), F.count(F.lit(1)).alias("n"))
    return buckets.unionByName(each.select(F.format_string('latency_count{type="%s"} %d', "event_type", "m").alias("line"))).unionByName(each.select(F.format_string('events_total{type="%s"} %d', "event_type", "n").alias("line")))


@query("memory_run_summary", """WITH r AS (SELECT conv_id, role, CASE WHEN count(*) OVER (PARTITION BY conv_id, md5(text)) > 1 THEN 'duplicate' WHEN role = 'system' THEN 'inactive' WHEN turn >= 6 THEN 'expired' ELSE 'keyword_fallback' END AS reason FROM conversations)
    SELECT reason, role AS source, count(*) AS n, count(DISTINCT conv_id) AS runs FROM r GROUP BY reason, role""")
def memory_run_summary(t: Tables) -> DataFrame:
    """AGG-13: records by the reason they were taken or left for and where they come from."""
    copies = t.conversations.groupBy("conv_id", F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("copies"))
    rows = t.conversations.withColumn("digest", F.md5("text")).join(copies, ["conv_id", "digest"])
    reason = F.when(F.col("copies") > 1, "duplicate").when(F.col("role") == "system", "inactive").when(F.col("turn") >= 6, "expired").otherwise("keyword_fallback")
    return rows.groupBy(reason.alias("reason"), F.col("role").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("runs"))


@query("todo_summary", """SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS in_progress, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus NOT IN ('O', 'P', 'F')) AS failed,
    min(o_orderkey) FILTER (o_orderstatus = 'P') AS current FROM orders GROUP BY o_custkey""")
def todo_summary(t: Tables) -> DataFrame:
    """AGG-14: an owner's items by status, and the first in progress."""
    status = F.col("o_orderstatus")
    of = lambda s: F.count_if(status == s)
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), of("O").alias("pending"), of("P").alias("in_progress"), of("F").alias("completed"), F.count_if(~status.isin("O", "P", "F")).alias("failed"), F.min(F.when(status == "P", F.col("o_orderkey"))).alias("current"))


_PURPOSE = "CASE WHEN value < 10 THEN 'plan' WHEN value < 50 THEN 'next_action' ELSE 'summary' END"


@query("llm_observations", f"""WITH c AS (SELECT user_id, {_PURPOSE} AS purpose, count(*) FILTER (event_type = 'view') AS starts, count(*) FILTER (event_type = 'click') AS finishes, count(*) FILTER (event_type = 'signup') AS expected FROM events GROUP BY ALL)
    SELECT *, starts >= expected AND finishes >= expected AND finishes = starts AS complete FROM c""")
def llm_observations(t: Tables) -> DataFrame:
    """AGG-15: by run and purpose what was started, finished and expected."""
    purpose = F.when(F.col("value") < 10, "plan").when(F.col("value") < 50, "next_action").otherwise("summary")
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    rows = t.events.groupBy("user_id", purpose.alias("purpose")).agg(of("view").alias("starts"), of("click").alias("finishes"), of("signup").alias("expected"))
    return rows.withColumn("complete", (F.col("starts") >= F.col("expected")) & (F.col("finishes") >= F.col("expected")) & (F.col("finishes") == F.col("starts")))


@query("session_completeness", f"""WITH s AS (SELECT user_id, event_type, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) OVER ({_RUN} ROWS UNBOUNDED PRECEDING) AS open FROM events),
    a AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS starts, count(*) FILTER (event_type = 'click') AS finishes, -least(min(open), 0) AS unmatched_finishes, count(*) FILTER (event_type = 'error') AS errors FROM s GROUP BY user_id)
    SELECT user_id, starts, finishes, CAST(unmatched_finishes AS BIGINT) AS unmatched_finishes, CAST(starts - (finishes - unmatched_finishes) AS BIGINT) AS unfinished_starts, errors > 0 AS degraded, unmatched_finishes = 0 AND starts = finishes AND errors = 0 AS trace_complete FROM a""")
def session_completeness(t: Tables) -> DataFrame:
    """STR-01 and STR-02: open calls of a run as a running sum, its lowest point being the finishes that nothing had opened; whether the trace is complete."""
    run = Window.partitionBy("user_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", -1).otherwise(0)
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    rows = t.events.withColumn("open", F.sum(step).over(run)).groupBy("user_id").agg(of("view").alias("starts"), of("click").alias("finishes"), (-F.least(F.min("open"), F.lit(0))).alias("unmatched_finishes"), of("error").alias("errors"))
    rows = rows.withColumn("unfinished_starts", F.col("starts") - (F.col("finishes") - F.col("unmatched_finishes")))
    return rows.select("user_id", "starts", "finishes", "unmatched_finishes", "unfinished_starts", (F.col("errors") > 0).alias("degraded"), ((F.col("unmatched_finishes") == 0) & (F.col("starts") == F.col("finishes")) & (F.col("errors") == 0)).alias("trace_complete"))


@query("stale_lease_order", "SELECT event_id, CAST(row_number() OVER (ORDER BY lease NULLS FIRST, event_id) AS INTEGER) AS place FROM (SELECT event_id, CASE WHEN value >= 5 THEN ts END AS lease FROM events WHERE event_type = 'view') QUALIFY place <= 50")
def stale_lease_order(t: Tables) -> DataFrame:
    """SRT-09: leases that were never set come first, then the oldest; a batch of 50."""
    few = t.events.where("event_type = 'view'").select("event_id", F.when(F.col("value") >= 5, F.col("ts")).alias("lease")).orderBy(F.asc_nulls_first("lease"), "event_id").limit(50)
    return few.select("event_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_first("lease"), "event_id")).alias("place"))


@query("due_republish", """WITH n AS (SELECT max(ts) AS now FROM events), q AS (SELECT event_id, ts, json_extract(props, '$.k')::BIGINT // 20 AS attempts FROM events WHERE event_type = 'purchase'),
    b AS (SELECT *, least(CASE WHEN attempts <= 1 THEN 5.0 WHEN attempts = 2 THEN 15.0 WHEN attempts = 3 THEN 30.0 ELSE 60.0 END, 900.0)::DOUBLE AS seconds FROM q)
    SELECT event_id, attempts, seconds, ts + to_seconds(seconds) <= now AS due FROM b, n""")
def due_republish(t: Tables) -> DataFrame:
    """STR-08: queued entries, how long each waits until its next attempt, and whether that time has come at the last event's time."""
    from ..operators.service import backoff

    now = F.broadcast(t.events.agg(F.max("ts").alias("now")))
    attempts = F.floor(F.get_json_object("props", "$.k").cast("long") / 20)
    rows = t.events.where("event_type = 'purchase'").select("event_id", "ts", attempts.alias("attempts")).withColumn("seconds", backoff(F.col("attempts"), 900.0))
    return rows.join(now, F.lit(True)).select("event_id", "attempts", "seconds", (F.col("ts") + F.make_dt_interval(secs=F.col("seconds")) <= F.col("now")).alias("due"))
