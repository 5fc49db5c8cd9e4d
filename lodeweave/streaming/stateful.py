"""Stateful stream operators: sessions, replay, retention and leases, each with state, timers and a checkpoint of its own.

They need the RocksDB state store (``state_store``). Rows of one key meet in one task, whatever order they come in; what a key holds in state is said at each operator.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import sessions as S

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start within it keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def collected(spark: SparkSession, stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into a table under ``path`` with its checkpoint beside it; a further call goes on where this one stopped."""
    with state_store(spark):
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _none(x):
    """A pandas cell as a plain value."""
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x


def _rows(batches: Iterator[pd.DataFrame]) -> list[dict]:
    return [{k: _none(v) for k, v in row.items()} for batch in batches for row in batch.to_dict("records")]


# sessions

_SESSION = "run long, sequence long, kind string, position long, ts long, trace_complete boolean, duration_ms double, revision int"


class _Session(StatefulProcessor):
    """State of a run, read and written once for all its rows of a micro-batch: its next position and number, what was seen so far, calls that are open and counts for each purpose (as JSON); events that came before their turn are appended to a list, which is read when the least of them is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "next long, sequence long, started long, planned boolean, degraded boolean, end_sequence long, end_position long, end_ts long, end_kind string, end_ok boolean, revision int, complete boolean, open string, counts string, least long")
        self.waiting = handle.getListState("waiting", "position long, ts long, kind string, purpose string, turn long, tool string, ok boolean")
        self.open: dict[str, int] = {}
        self.counts: dict[str, list[int]] = {}

    def _step(self, call: str, by: int) -> bool:
        """Opens or closes a call; False where nothing was open."""
        n = self.open.get(call, 0) + by
        if n < 0:
            return False
        self.open[call] = n
        if not n:
            del self.open[call]
        return True

    def _count(self, purpose: str, at: int) -> None:
        self.counts.setdefault(purpose, [0, 0, 0])[at] += 1

    def _complete(self, c: dict) -> bool:
        if c["degraded"] or c["started"] is None or (c["end_kind"] == "failed" and not c["end_ok"]):
            return False
        if any(call.startswith("llm") for call in self.open):
            return False
        return all(min(starts, finishes) >= expected for starts, finishes, expected in self.counts.values())

    def _end(self, run: int, c: dict) -> tuple:
        ms = None if c["started"] is None else round(max(0.0, (c["end_ts"] - c["started"]) / 1000), 3)
        return run, c["end_sequence"], S.PUBLIC[c["end_kind"]], c["end_position"], c["end_ts"], c["complete"], ms, c["revision"]

    def _take(self, run: int, e: dict, c: dict) -> Iterator[tuple]:
        kind = e["kind"]
        if c["end_kind"] is not None or e["ts"] is None:  # after the end, or at no time
            c["degraded"] |= kind in S.KEY
            if c["end_kind"] is not None and c["complete"] and c["degraded"]:  # the last event is written anew
                c["complete"], c["revision"] = False, c["revision"] + 1
                yield self._end(run, c)
            return
        accepted, call = kind in S.PUBLIC, f"{e['purpose']!r} {e['turn']}" if kind in ("llm_started", "llm_finished") else f"{e['tool']!r} {e['turn']}"
        if kind == "run_started":
            accepted = c["started"] is None
            c["degraded"] |= not accepted
            c["started"] = e["ts"] if c["started"] is None else c["started"]
        elif kind == "plan":
            accepted, c["planned"] = not c["planned"], True
        elif kind == "context":
            accepted = bool(e["ok"])
            c["degraded"] |= not accepted
        elif kind == "llm_started":
            self._step(f"llm {call}", 1)
            self._count(repr(e["purpose"]), 0)
        elif kind == "llm_finished":
            c["degraded"] |= not self._step(f"llm {call}", -1)
            self._count(repr(e["purpose"]), 1)
        elif kind == "expected":
            self._count(repr(e["purpose"]), 2)
        elif kind == "tool_started":
            self._step(f"tool {call}", 1)
        elif kind == "tool_finished":
            accepted = self._step(f"tool {call}", -1)
            c["degraded"] |= not accepted
        if not accepted:
            return
        number, c["sequence"] = c["sequence"], c["sequence"] + 1
        if kind in S.TERMINAL:
            c |= {"end_sequence": number, "end_position": e["position"], "end_ts": e["ts"], "end_kind": kind, "end_ok": bool(e["ok"])}
            c["complete"] = self._complete(c)
            yield self._end(run, c)
        else:
            yield run, number, S.PUBLIC[kind], e["position"], e["ts"], None, None, 0

    _NAMES = ("next", "sequence", "started", "planned", "degraded", "end_sequence", "end_position", "end_ts", "end_kind", "end_ok", "revision", "complete", "open", "counts", "least")

    def _turn(self, run: int, events: Iterator[dict]) -> list[tuple]:
        c = dict(zip(self._NAMES, self.cursor.get() or (0, 0, None, False, False, None, None, None, None, None, 0, None, "{}", "{}", None), strict=True))
        self.open, self.counts = json.loads(c["open"]), json.loads(c["counts"])
        fields, out = ("ts", "kind", "purpose", "turn", "tool", "ok"), []
        own: dict[int, dict] = {}
        for e in events:
            if e["position"] >= c["next"]:  # else it came before
                own.setdefault(e["position"], e)
        appended = True
        while True:
            while c["next"] in own:
                out += self._take(run, own.pop(c["next"]), c)
                c["next"] += 1
            if c["least"] is None or c["least"] > c["next"]:
                break
            for at, *event in self.waiting.get():
                if at >= c["next"]:
                    own.setdefault(at, dict(zip(fields, event, strict=True)) | {"position": at})
            self.waiting.clear()
            c["least"], appended = None, False
        early = [(at, *(e[f] for f in fields)) for at, e in own.items()]
        if early:
            self.waiting.appendList(early) if appended else self.waiting.put(early)
            c["least"] = min(own) if c["least"] is None else min(c["least"], *own)
        c |= {"open": json.dumps(self.open), "counts": json.dumps(self.counts)}
        self.cursor.update(tuple(c[n] for n in self._NAMES))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Rows as frames, for ``transformWithStateInPandas``."""
        micros = lambda ts: None if ts is None else (_utc(ts) - _EPOCH) // dt.timedelta(microseconds=1)
        events = (e | {"position": int(e["position"]), "turn": None if e["turn"] is None else int(e["turn"]), "ts": micros(e["ts"])} for e in _rows(rows))
        yield pd.DataFrame(self._turn(key[0], events), columns=[f.split()[0] for f in _SESSION.split(", ")]).astype({"trace_complete": "object"})

    def close(self) -> None:
        pass


class _RowSession(_Session):
    """The same with plain rows, as ``transformWithState`` gives them: a frame for each run costs more than its events do."""

    _ROW = Row(*(f.split()[0] for f in _SESSION.split(", ")))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from (self._ROW(*x) for x in self._turn(key[0], (r.asDict() for r in rows)))


def session_stream(events: DataFrame) -> DataFrame:
    """STR-02: ``operators.sessions.sessions`` on a stream of its events, in whatever order they come; ``revision`` counts how often a run's last event was written anew.

    An event whose predecessors haven't come waits in state, so numbers are given once and for good. An event that comes twice counts once. One that comes after
    the run's end makes the trace incomplete: the last event comes out again with the next revision.
    """
    rows = events.withColumn("ts", F.unix_micros("ts")).groupBy("run").transformWithState(_RowSession(), _SESSION, "append", "none")
    return rows.withColumn("ts", F.timestamp_micros("ts"))


def latest(rows: DataFrame) -> DataFrame:
    """Of a session stream's rows each run's and number's last revision."""
    best = rows.groupBy("run", "sequence").agg(F.max_by(F.struct(*(F.col(c) for c in rows.columns if c not in ("run", "sequence"))), "revision").alias("row"))
    return best.select("run", "sequence", "row.*").drop("revision")


# replay and resumption

_REPLAY = "run long, sequence long, kind string, event string, gap_to long"


class _Replay(StatefulProcessor):
    """State of a run: the number that is due, and whether it has ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.due = handle.getValueState("due", "due long, ended boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.due.update((int(initialState["due"].iloc[0]), bool(initialState["ended"].iloc[0])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due, ended = self.due.get() if self.due.exists() else (0, False)
        out = []
        for e in sorted(_rows(rows), key=lambda e: e["sequence"]):
            if ended or e["sequence"] < due:
                continue
            if e["sequence"] > due:
                out.append((key[0], due, "gap", None, e["sequence"] - 1))
            out.append((key[0], e["sequence"], e["kind"], e["event"], None))
            due, ended = e["sequence"] + 1, e["kind"] in ("run_completed", "run_failed")
        self.due.update((int(due), bool(ended)))
        frame = pd.DataFrame(out, columns=["run", "sequence", "kind", "event", "gap_to"])
        yield frame.astype({"gap_to": "Int64"})

    def close(self) -> None:
        pass


def replayed(stored: DataFrame, since: DataFrame) -> DataFrame:
    """STR-03: the stored events (run, sequence, kind, event) after the number each run of ``since`` (run, sequence) has seen, and a gap where numbers are missing; runs that aren't named from the start. Up to a run's end, in the rows of ``resumed``."""
    from pyspark.sql import Window

    run = Window.partitionBy("run").orderBy("sequence")
    ends = F.min(F.when(F.col("kind").isin("run_completed", "run_failed"), F.col("sequence"))).over(Window.partitionBy("run"))
    rows = stored.dropDuplicates(["run", "sequence"]).withColumn("end", ends).where("end IS NULL OR sequence <= end")
    rows = rows.join(since.select("run", F.col("sequence").alias("seen")), "run", "left").where("sequence > coalesce(seen, -1)")
    rows = rows.withColumn("due", F.coalesce(F.lag("sequence").over(run), "seen", F.lit(-1)) + 1)
    none = F.lit(None)
    gap = F.struct(F.col("due").alias("sequence"), F.lit("gap").alias("kind"), none.cast("string").alias("event"), (F.col("sequence") - 1).alias("gap_to"))
    own = F.struct("sequence", "kind", "event", none.cast("long").alias("gap_to"))
    return rows.select("run", F.explode(F.when(F.col("sequence") > F.col("due"), F.array(gap, own)).otherwise(F.array(own))).alias("x")).select("run", "x.*")


def resumed(live: DataFrame, stored: DataFrame, since: DataFrame) -> DataFrame:
    """STR-03: what a stream of a run's events (run, sequence, kind, event) brings after all that is stored or has been seen, each once and in order; where numbers are missing one row of kind gap (from sequence to gap_to), and nothing after a run's end.

    What is due in each run is taken from the stored table when the stream first starts; from then on the checkpoint has it. Together with ``replayed`` nothing comes twice and nothing is left out.
    A number that comes after a later one of its run was delivered is past: its gap has been told.
    """
    ends = stored.groupBy("run").agg((F.max("sequence") + 1).alias("after"), F.bool_or(F.col("kind").isin("run_completed", "run_failed")).alias("ended"))
    seen = since.groupBy("run").agg((F.max("sequence") + 1).alias("seen"))
    due = ends.join(seen, "run", "full_outer").select("run", F.greatest(F.coalesce("after", F.lit(0)), F.coalesce("seen", F.lit(0))).cast("long").alias("due"), F.coalesce("ended", F.lit(False)).alias("ended"))
    return live.groupBy("run").transformWithStateInPandas(_Replay(), _REPLAY, "append", "none", initialState=due.groupBy("run"))


# retention

_EVICTED = "run long, id long, ts timestamp, reason string"


class _Retention(StatefulProcessor):
    """State of a run, read and written once for all its rows of a micro-batch: its newest rows (microseconds and id, as JSON), at most as many as are kept, and the time of its timer, which moves only when its oldest row does."""

    def __init__(self, most: int, seconds: int):
        self.most, self.age = most, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "timer long, rows string")

    def _held(self) -> tuple[int | None, list[tuple[int, int]]]:
        state = self.kept.get()
        return (None, []) if state is None else (int(state[0]), [(ts, i) for ts, i in json.loads(state[1])])

    def _put(self, rows: list[tuple[int, int]], key, timer: int | None, had: bool, timerValues) -> Iterator[pd.DataFrame]:
        over, now = max(0, len(rows) - self.most), _watermark(timerValues)
        gone, rows = [(key[0], i, ts, "length") for ts, i in rows[:over]], rows[over:]
        if now is not None:
            since = (_utc(now) - _EPOCH) // dt.timedelta(microseconds=1) - self.age
            gone += [(key[0], i, ts, "age") for ts, i in rows if ts < since]
            rows = [x for x in rows if x[0] >= since]
        due = (rows[0][0] + self.age) // 1000 + 1 if rows else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if rows:
            self.kept.update((due, json.dumps(rows)))
        elif had:
            self.kept.clear()
        if gone:
            yield pd.DataFrame(gone, columns=["run", "id", "ts", "reason"]).astype({"ts": "datetime64[us]"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        timer, held = self._held()
        new = {x for batch in rows for x in zip(batch["ts"].astype("datetime64[us]").astype("int64").tolist(), batch["id"].tolist(), strict=True)}
        yield from self._put(sorted({*held, *new}), key, timer, bool(held), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The timer that went off is taken out by Spark."""
        held = self._held()[1]
        yield from self._put(held, key, None, bool(held), timerValues)

    def close(self) -> None:
        pass


_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def _utc(ts: dt.datetime) -> dt.datetime:
    return ts if ts.tzinfo else ts.replace(tzinfo=dt.timezone.utc)


def _watermark(timerValues) -> dt.datetime | None:
    """The watermark as a time without a zone, as rows have theirs; None before the first one."""
    ms = timerValues.getCurrentWatermarkInMs()
    return dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).replace(tzinfo=None) if ms > 0 else None


def evicted_stream(events: DataFrame, most: int = 512, seconds: int = 86_400, late: str = "0 seconds") -> DataFrame:
    """STR-04: the rows (run, id, ts) that a run no longer keeps: all but its ``most`` newest (by time, then id), and those older than ``seconds`` at the watermark. A timer at the oldest row's end lets rows go that no further event of the run pushes out."""
    return events.withWatermark("ts", late).select("run", "id", "ts").groupBy("run").transformWithStateInPandas(_Retention(most, seconds), _EVICTED, "append", "eventTime")


def evicted(events: DataFrame, most: int = 512, seconds: int = 86_400) -> DataFrame:
    """STR-04 on a table: run, id, ts, reason of what isn't kept at its last event's time; age counts where both hold only if a row is among its run's newest."""
    from pyspark.sql import Window

    now = F.broadcast(events.agg(F.max("ts").alias("now")))
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("ts"), F.desc("id")))
    rows = events.select("run", "id", "ts", place.alias("place")).join(now, F.lit(True))
    old = F.col("ts") < F.col("now") - F.make_dt_interval(secs=F.lit(seconds))
    return rows.withColumn("reason", F.when(F.col("place") > most, "length").when(old, "age")).where("reason IS NOT NULL").select("run", "id", "ts", "reason")


# leases

_EXPIRED = "task long, token long, beat timestamp, expired_at timestamp"


class _Leases(StatefulProcessor):
    """State of a task: the lease's token and last beat. A timer stands at the lease's end, and moves with each beat."""

    def __init__(self, seconds: int):
        self.term = dt.timedelta(seconds=seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "token long, beat timestamp")

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["task", "token", "beat", "expired_at"]).astype({"beat": "datetime64[us]", "expired_at": "datetime64[us]"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        token, beat = self.lease.get() or (None, None)
        beat, out = _none(beat), []
        held, had = token, beat
        for e in sorted(_rows(rows), key=lambda e: (e["ts"], e["id"])):
            if beat is not None and e["ts"] - beat >= self.term:
                out.append((key[0], int(token), beat, beat + self.term))
                token = beat = None
            if e["kind"] == "claim" and beat is None:
                token = int(e["id"])
            if e["kind"] == "complete":
                token = beat = None
            elif token is not None:
                beat = e["ts"]
        if beat != had:
            if had is not None:
                self.handle.deleteTimer(self._at(had))
            if beat is not None:
                self.handle.registerTimer(self._at(beat))
        if beat is None and had is not None:
            self.lease.clear()
        elif (token, beat) != (held, had):
            self.lease.update((int(token), beat))
        if out:
            yield self._frame(out)

    def _at(self, beat: dt.datetime) -> int:
        return int((_utc(beat) + self.term).timestamp() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        token, beat = self.lease.get()
        self.lease.clear()
        yield self._frame([(key[0], int(token), _none(beat), _none(beat) + self.term)])

    def close(self) -> None:
        pass


def expired_stream(events: DataFrame, seconds: int = 420, late: str = "0 seconds") -> DataFrame:
    """STR-06: leases that ran out on a stream of (task, id, ts, kind): task, token (the claim's id), beat (the last one), expired_at.

    A claim opens a lease where none is open, and it and each beat renew it for ``seconds``; complete ends it. A beat without a lease does nothing. A lease comes out once the watermark has passed its end, whether or not the task is heard of again.
    """
    return events.withWatermark("ts", late).select("task", "id", "ts", "kind").groupBy("task").transformWithStateInPandas(_Leases(seconds), _EXPIRED, "append", "eventTime")


def expired(events: DataFrame, seconds: int = 420) -> DataFrame:
    """STR-06 on a table, at its last event's time: stretches of a task's events without a pause of ``seconds`` and without a completion inside; a stretch's lease begins at its first claim and ends with its last event."""
    from pyspark.sql import Window

    task = Window.partitionBy("task").orderBy("ts", "id")
    pause = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(task)) >= seconds * 1_000_000
    rows = events.withColumn("cut", F.when(pause | (F.lag("kind").over(task) == "complete"), 1).otherwise(0))
    rows = rows.withColumn("stretch", F.sum("cut").over(task))
    first = F.min(F.when(F.col("kind") == "claim", F.struct("ts", "id")))
    ends = rows.groupBy("task", "stretch").agg(first.alias("claim"), F.max(F.struct("ts", "id", "kind")).alias("last"))
    now = F.broadcast(events.agg(F.max("ts").alias("now")))
    ends = ends.where("claim IS NOT NULL AND last.kind <> 'complete'").select("task", F.col("claim.id").alias("token"), F.col("last.ts").alias("beat"), (F.col("last.ts") + F.make_dt_interval(secs=F.lit(seconds))).alias("expired_at"))
    return ends.join(now, F.col("expired_at") <= F.col("now")).select("task", "token", "beat", "expired_at")
