"""Sessions, leases, retention and replay over ``events``: each as a batch operator and as a stream, which have the same SQL.

A run is a user's three days; its events in order are the internal events of a session, their kinds taken from type, place and the number in ``props``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sessions as S
from ..operators.store import shared_path
from ..streaming import stateful as T
from .registry import Tables, query

_INTERNAL = """
    SELECT run, position, ts, CASE WHEN position = 0 AND k % 20 <> 0 THEN 'run_started' WHEN position = n - 1 - (CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END) THEN CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'completed' END
           WHEN event_type = 'signup' THEN CASE WHEN k < 30 THEN 'plan' ELSE 'expected' END WHEN event_type = 'purchase' THEN 'context' WHEN event_type = 'view' THEN 'llm_started' WHEN event_type = 'click' THEN 'llm_finished'
           WHEN k % 2 = 0 THEN 'tool_started' ELSE 'tool_finished' END AS kind,
           CASE WHEN event_type IN ('signup', 'view', 'click') THEN concat('p', user_id % 2) END AS purpose, CAST(user_id % 3 AS BIGINT) AS turn, 't' AS tool, k % 10 <> 0 AS ok
    FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) - 1 AS position, count(*) OVER (PARTITION BY run) AS n FROM
        (SELECT user_id, event_id, ts, event_type, CAST({k} AS BIGINT) AS k, CAST(user_id * 10 + floor((day(ts) - 1) / 3) AS BIGINT) AS run FROM {events}))
"""
_DUCK = _INTERNAL.format(k="json_extract(props, '$.k')", events="events")

_SESSIONS = f"""
    WITH i AS ({_DUCK}), a AS (SELECT *, min(position) FILTER (kind IN ('completed', 'failed')) OVER (PARTITION BY run) AS fin FROM i),
    b AS (SELECT *, fin IS NULL OR position <= fin AS live FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY run, kind ORDER BY position) AS nth,
              sum(CASE WHEN live AND kind = 'llm_started' THEN 1 WHEN live AND kind = 'llm_finished' THEN -1 ELSE 0 END) OVER w AS calls, sum(CASE WHEN live AND kind = 'tool_started' THEN 1 WHEN live AND kind = 'tool_finished' THEN -1 ELSE 0 END) OVER v AS tools
          FROM b WINDOW w AS (PARTITION BY run, purpose, turn ORDER BY position), v AS (PARTITION BY run, turn, tool ORDER BY position)),
    d AS (SELECT *, least(0, coalesce(min(calls) OVER (PARTITION BY run, purpose, turn ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS calls_low,
              least(0, coalesce(min(tools) OVER (PARTITION BY run, turn, tool ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS tools_low FROM c),
    f AS (SELECT *, live AND kind = 'llm_finished' AND calls < calls_low AS no_call, live AND kind = 'tool_finished' AND tools < tools_low AS no_tool FROM d),
    g AS (SELECT *, live AND kind <> 'expected' AND NOT no_tool AND NOT (kind = 'context' AND NOT ok) AND NOT (kind IN ('plan', 'run_started') AND nth > 1) AS accepted FROM f),
    o AS (SELECT run, max(unclosed) AS unclosed FROM (SELECT run, purpose, turn, arg_max(calls, position) - least(0, min(calls)) AS unclosed FROM c WHERE live GROUP BY ALL) GROUP BY run),
    p AS (SELECT run, bool_or(expected > least(starts, finishes)) AS short FROM (SELECT run, purpose, count(*) FILTER (kind = 'expected') AS expected, count(*) FILTER (kind = 'llm_started') AS starts, count(*) FILTER (kind = 'llm_finished') AS finishes FROM b WHERE live GROUP BY ALL) GROUP BY run),
    r AS (SELECT run, bool_or(NOT live OR no_call OR no_tool OR (kind = 'context' AND NOT ok) OR (kind = 'run_started' AND nth > 1) OR (kind = 'failed' AND accepted AND NOT ok)) AS bad, min(ts) FILTER (kind = 'run_started' AND accepted) AS began FROM g GROUP BY run)
    SELECT run, row_number() OVER (PARTITION BY run ORDER BY position) - 1 AS sequence, CASE kind WHEN 'plan' THEN 'plan_created' WHEN 'context' THEN 'context_updated' WHEN 'completed' THEN 'run_completed' WHEN 'failed' THEN 'run_failed' ELSE kind END AS kind,
           position, ts, CASE WHEN kind IN ('completed', 'failed') THEN NOT bad AND NOT short AND unclosed = 0 AND began IS NOT NULL END AS trace_complete,
           CASE WHEN kind IN ('completed', 'failed') AND began IS NOT NULL THEN round(greatest(0, epoch_us(ts) - epoch_us(began)) / 1000.0, 3) END AS duration_ms
    FROM g JOIN o USING (run) JOIN p USING (run) JOIN r USING (run) WHERE accepted
"""


def _plain(df: DataFrame) -> DataFrame:
    """Times as the tables have them, without a zone."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


def _events(t: Tables) -> DataFrame:
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


def internal_events(t: Tables) -> DataFrame:
    return t.spark.sql(_INTERNAL.format(k="get_json_object(props, '$.k')", events="{rows}"), rows=t.events).select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in S.SCHEMA.split(", ")))


def fed(t: Tables, rows: DataFrame, build: Callable[[DataFrame], DataFrame], slices: int = 3, by: str | None = None) -> DataFrame:
    """What a stream over ``rows`` writes, fed in slices: each is put into the folder that the stream reads, and the stream is started again from its checkpoint. Slices follow each other by ``by``, a time, or mix all rows."""
    path, feed = shared_path(t.spark, "stream"), shared_path(t.spark, "feed")
    if by is None:
        rows = rows.withColumn("slice", F.pmod(F.xxhash64(*rows.columns), F.lit(slices)))
    else:
        low, high = rows.agg(F.min(F.unix_micros(by)), F.max(F.unix_micros(by))).first()
        rows = rows.withColumn("slice", F.floor((F.unix_micros(by) - (low or 0)) * slices / ((high or 0) - (low or 0) + 1)))
    schema, found = rows.drop("slice").schema, None
    for k in range(slices):
        rows.where(F.col("slice") == k).drop("slice").write.mode("append").parquet(feed)
        found = T.collected(t.spark, build(t.spark.readStream.schema(schema).parquet(feed)), path)
    return found


@query("session_projection", _SESSIONS)
def session_projection(t: Tables) -> DataFrame:
    """STR-01 and STR-02 on the whole table."""
    return _plain(S.sessions(internal_events(t)))


@query("session_stream", _SESSIONS)
def session_stream(t: Tables) -> DataFrame:
    """STR-02 as a stream whose slices mix all of a run's events."""
    return _plain(T.latest(fed(t, internal_events(t), T.session_stream)))


_LEASE_EVENTS = "SELECT CAST(user_id AS BIGINT) AS task, CAST(event_id AS BIGINT) AS id, ts, CASE event_type WHEN 'signup' THEN 'claim' WHEN 'purchase' THEN 'complete' ELSE 'beat' END AS kind FROM {events}"
#: Users' events are hours apart; so is a lease's term here.
_TERM = 6 * 3600
_EXPIRY = f"""
    WITH e AS ({_LEASE_EVENTS.format(events="events")}), n AS (SELECT max(ts) AS now FROM e),
    g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= {_TERM * 1000000} OR lag(kind) OVER w = 'complete' THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY task ORDER BY ts, id)),
    s AS (SELECT *, sum(cut) OVER (PARTITION BY task ORDER BY ts, id) AS stretch FROM g),
    c AS (SELECT task, stretch, arg_min(id, (ts, id)) FILTER (kind = 'claim') AS token, arg_max(kind, (ts, id)) AS last_kind, max(ts) AS beat FROM s GROUP BY task, stretch)
    SELECT task, token, beat, beat + INTERVAL {_TERM} SECOND AS expired_at FROM c, n WHERE token IS NOT NULL AND last_kind <> 'complete' AND beat + INTERVAL {_TERM} SECOND <= now
"""


def lease_events(t: Tables) -> DataFrame:
    return t.spark.sql(_LEASE_EVENTS.format(events="{rows}"), rows=_events(t))


@query("lease_expiry", _EXPIRY)
def lease_expiry(t: Tables) -> DataFrame:
    """STR-06 on the whole table."""
    return _plain(T.expired(lease_events(t), _TERM))


@query("lease_expiry_stream", _EXPIRY)
def lease_expiry_stream(t: Tables) -> DataFrame:
    """STR-06 as a stream whose timers fire as time goes on."""
    return _plain(fed(t, lease_events(t), lambda rows: T.expired_stream(rows, _TERM), by="ts"))


_KEPT, _AGE = 40, 20 * 86_400
_RETENTION = f"""
    WITH e AS (SELECT CAST(user_id AS BIGINT) AS run, CAST(event_id AS BIGINT) AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place, max(ts) OVER () AS now FROM events)
    SELECT run, id, ts FROM e WHERE place > {_KEPT} OR ts < now - INTERVAL {_AGE} SECOND
"""


def run_rows(t: Tables) -> DataFrame:
    return _events(t).select(F.col("user_id").cast("long").alias("run"), F.col("event_id").cast("long").alias("id"), "ts")


@query("retention_evicted", _RETENTION)
def retention_evicted(t: Tables) -> DataFrame:
    """STR-04 on the whole table: what a run of bounded length and age no longer holds."""
    return _plain(T.evicted(run_rows(t), _KEPT, _AGE).drop("reason"))


@query("retention_stream", _RETENTION)
def retention_stream(t: Tables) -> DataFrame:
    """STR-04 as a stream: rows go as newer ones push them out, or as they grow old."""
    return _plain(fed(t, run_rows(t), lambda rows: T.evicted_stream(rows, _KEPT, _AGE), by="ts").drop("reason"))


_NUMBERED = "SELECT CAST(user_id AS BIGINT) AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence, CASE WHEN event_type = 'purchase' AND event_id % 41 = 0 THEN 'run_completed' ELSE event_type END AS kind, CAST(event_id AS {string}) AS event, ts, {half} AS stored FROM {events}"
_REPLAY = f"""
    WITH s AS ({_NUMBERED.format(string="VARCHAR", half="ts < TIMESTAMP '2024-01-12'", events="events")}), e AS (SELECT *, min(sequence) FILTER (kind = 'run_completed' AND (stored OR CAST(event AS BIGINT) % 10 <> 3)) OVER (PARTITION BY run) AS fin FROM s WHERE stored OR CAST(event AS BIGINT) % 10 <> 3),
    d AS (SELECT *, coalesce(lag(sequence) OVER (PARTITION BY run ORDER BY sequence), CASE WHEN run % 3 = 0 THEN 5 ELSE -1 END) + 1 AS due FROM e WHERE (fin IS NULL OR sequence <= fin) AND sequence > CASE WHEN run % 3 = 0 THEN 5 ELSE -1 END)
    SELECT run, sequence, kind, event, CAST(NULL AS BIGINT) AS gap_to FROM d UNION ALL SELECT run, due, 'gap', NULL, sequence - 1 FROM d WHERE sequence > due
"""


@query("replay_resume", _REPLAY)
def replay_resume(t: Tables) -> DataFrame:
    """STR-03: users' numbered events; those before a day are stored, of the later ones a tenth got lost on the way. A third of the users have seen five, the stream goes on after what is stored."""
    rows = t.spark.sql(_NUMBERED.format(string="STRING", half="ts < TIMESTAMP '2024-01-12'", events="{rows}"), rows=_events(t))
    stored, live = rows.where("stored").drop("stored", "ts"), rows.where("NOT stored AND CAST(event AS BIGINT) % 10 <> 3").drop("stored")
    since = t.events.where("user_id % 3 = 0").select(F.col("user_id").cast("long").alias("run"), F.lit(5).cast("long").alias("sequence")).distinct()
    first = T.replayed(stored, since)
    return first.unionByName(fed(t, live, lambda s: T.resumed(s.drop("ts"), stored, since), by="ts").select(*first.columns))
