"""Stateful streams over shuffled micro-batches give what the batch operators and plain versions give, after a restart from the checkpoint too."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import sessions as S
from lodeweave.streaming import stateful as T

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def feed(spark, folder, rows, schema, n):
    """Rows dealt over n files, each a micro-batch."""
    for i in range(n):
        spark.createDataFrame(rows[i::n], schema).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def make_runs(seed, n):
    rng = random.Random(seed)
    rows = []
    for run in range(n):
        events = [("run_started", None, None, None, True)] if rng.random() < 0.9 else []
        for _ in range(rng.randrange(9)):
            purpose, turn, tool = rng.choice(["plan", "act", None]), rng.choice([0, 1, None]), rng.choice("ab")
            what = rng.choice(["plan", "context", "llm", "llm", "llm", "tool", "odd", "lost"])
            if what == "llm":
                events += [("expected", purpose, None, None, None)] * (rng.random() < 0.5) + [("llm_started", purpose, turn, None, None), ("llm_finished", purpose, turn, None, True)][: 2 if rng.random() < 0.95 else 1]
            elif what == "tool":
                events += [("tool_started", None, turn, tool, None), ("tool_finished", None, turn, tool, True)][: 2 if rng.random() < 0.7 else 1]
            elif what == "lost":
                events += [(rng.choice(["llm_finished", "tool_finished", "run_started"]), purpose, turn, tool, True)] * (rng.random() < 0.15)
            else:
                events.append((what, None, None, None, rng.random() < 0.9))
        if rng.random() < 0.85:
            events.append((rng.choice(["completed", "completed", "failed"]), None, None, None, rng.random() < 0.8))
        if rng.random() < 0.15:
            events.append((rng.choice(["llm_finished", "odd", "completed"]), "act", 0, None, True))
        rows += [(run, i, None if rng.random() < 0.01 else at(run * 60 + i * 1.37), *e) for i, e in enumerate(events)]
    return rows


def plain_sessions(rows):
    """One event after the other."""
    out = []
    for run in sorted({r[0] for r in rows}):
        number, started, planned, degraded, end = 0, None, False, False, None
        calls, tools, counts = {}, {}, {}
        for _, position, ts, kind, purpose, turn, tool, ok in sorted((r for r in rows if r[0] == run), key=lambda r: r[1]):
            if ts is None or end:
                degraded |= kind in S.KEY
                continue
            c = counts.setdefault(purpose, {"llm_started": 0, "llm_finished": 0, "expected": 0})
            if kind in c:
                c[kind] += 1
            accepted = kind in S.PUBLIC
            if kind == "run_started" and started:
                accepted, degraded = False, True
            elif kind == "run_started":
                started = ts
            elif kind == "plan":
                accepted, planned = not planned, True
            elif kind == "context" and not ok:
                accepted, degraded = False, True
            elif kind in ("llm_started", "llm_finished"):
                n = calls.get((purpose, turn), 0) + (1 if kind == "llm_started" else -1)
                degraded |= n < 0
                calls[purpose, turn] = max(0, n)
            elif kind in ("tool_started", "tool_finished"):
                n = tools.get((turn, tool), 0) + (1 if kind == "tool_started" else -1)
                accepted, degraded = accepted and n >= 0, degraded or n < 0
                tools[turn, tool] = max(0, n)
            if accepted:
                row = [run, number, S.PUBLIC[kind], position, ts, None, None]
                number += 1
                out.append(row)
                if kind in S.TERMINAL:
                    end = row
                    degraded |= kind == "failed" and not ok
                    row[6] = None if started is None else round(max(0.0, (ts - started).total_seconds() * 1000), 3)
        if end:
            end[5] = not degraded and started is not None and not any(calls.values()) and all(min(c["llm_started"], c["llm_finished"]) >= c["expected"] for c in counts.values())
    return sorted(map(tuple, out), key=repr)


def got(df):
    return sorted(((r["run"], r["sequence"], r["kind"], r["position"], r["ts"], r["trace_complete"], r["duration_ms"] and round(r["duration_ms"], 3)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sessions(spark, seed):
    rows = make_runs(seed, 120)
    expected = plain_sessions(rows)
    random.Random(seed).shuffle(rows)
    assert got(S.sessions(spark.createDataFrame(rows, S.SCHEMA).repartition(3))) == expected
    assert {r[5] for r in expected} == {True, False, None}


def test_session_stream(spark, tmp_path):
    """Events in any order over several micro-batches and two runs of the query, some of them twice."""
    rows = make_runs(5, 40)
    expected = plain_sessions(rows)
    random.Random(6).shuffle(rows)
    half = len(rows) // 2
    feed(spark, tmp_path / "in", rows[:half], S.SCHEMA, 2)
    out = str(tmp_path / "out")
    T.collected(spark, T.session_stream(stream(spark, tmp_path / "in", S.SCHEMA)), out)
    feed(spark, tmp_path / "in", rows[half:] + rows[half - 20 : half], S.SCHEMA, 2)
    found = T.collected(spark, T.session_stream(stream(spark, tmp_path / "in", S.SCHEMA)), out)
    assert got(T.latest(found)) == expected
    assert found.where("revision > 0").count() > 0


# replay


EVENT = "run long, sequence long, kind string, event string"


def test_replay_and_resume(spark, tmp_path):
    """Stored rows, then the stream over two runs of the query: nothing twice, nothing lost, a gap for each hole, nothing after the end."""
    rng = random.Random(3)
    whole = {run: [(run, k, "run_completed" if k == 29 and run % 2 else "tool_started", f"{run}:{k}") for k in range(30)] for run in range(8)}
    missing = {(1, 12), (1, 13), (2, 0), (3, 29), (4, 6), (5, 20), (6, 3)}
    stored = [e for run, own in whole.items() for e in own[: 8 + run] if (run, e[1]) not in missing]
    since = {0: 4, 1: -1, 2: 2, 4: 9, 5: 25}
    live = [e for run, own in whole.items() for e in own[5 + run :] if (run, e[1]) not in missing]
    parts = [[e for e in live if lo <= e[1] < hi] for lo, hi in ((0, 12), (12, 18), (18, 26), (26, 40))]
    for p in parts:
        rng.shuffle(p)
    parts[2] += parts[0][:5]
    parts[3] += [(1, 31, "tool_started", "after the end")]
    table = lambda rows: spark.createDataFrame(rows, EVENT).repartition(2)
    seen = spark.createDataFrame(list(since.items()), "run long, sequence long")
    first = T.replayed(table(stored + stored[:3]), seen)
    out, folder = str(tmp_path / "out"), tmp_path / "in"
    for k, p in enumerate(parts):
        spark.createDataFrame(p, EVENT).coalesce(1).write.mode("append").parquet(str(folder))
        if k in (1, 3):
            found = T.collected(spark, T.resumed(stream(spark, folder, EVENT), table(stored), seen), out)
    rows = [tuple(r) for r in first.collect() + found.select(*first.columns).collect()]
    got = sorted(r for r in rows)
    for run, own in whole.items():
        due = since.get(run, -1) + 1
        expected, k = [], due
        while k < 30:
            if (run, k) in missing:
                end = k
                while (run, end + 1) in missing:
                    end += 1
                if end + 1 < 30:
                    expected.append((run, k, "gap", None, end))
                k = end + 1
            else:
                expected.append((*own[k], None))
                k += 1
        assert [r for r in got if r[0] == run] == expected


# retention and leases


ROWS = "run long, id long, ts timestamp"


def test_retention(spark, tmp_path):
    rng = random.Random(9)
    times = sorted(rng.randrange(4000) for _ in range(300))
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, at(t)) for i, t in enumerate(times)]
    out, folder = str(tmp_path / "out"), tmp_path / "in"
    for a in range(0, 300, 60):
        part = rows[a : a + 60]
        rng.shuffle(part)
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(str(folder))
        if a in (120, 240):
            found = T.collected(spark, T.evicted_stream(stream(spark, folder, ROWS), 20, 900), out)
    gone = {(r["run"], r["id"]) for r in found.collect()}
    assert found.count() == len(gone)  # nothing goes twice
    kept = [r for r in rows if (r[0], r[1]) not in gone]
    now = max(r[2] for r in rows)
    expected = []
    for run in (1, 2, 3):
        own = sorted((r for r in rows if r[0] == run), key=lambda r: (r[2], r[1]))[-20:]
        expected += [r for r in own if r[2] >= now - dt.timedelta(seconds=900)]
    assert sorted(kept) == sorted(expected)
    batch = T.evicted(spark.createDataFrame(rows, ROWS), 20, 900)
    assert {(r["run"], r["id"]) for r in batch.collect()} == gone


LEASES = "task long, id long, ts timestamp, kind string"


def plain_expired(rows, now, term):
    out = []
    for task in {r[0] for r in rows}:
        token = beat = None
        for _, i, ts, kind in sorted((r for r in rows if r[0] == task), key=lambda r: (r[2], r[1])):
            if token is not None and (ts - beat).total_seconds() >= term:
                out.append((task, token, beat, beat + dt.timedelta(seconds=term)))
                token = None
            if kind == "claim" and token is None:
                token = i
            if kind == "complete":
                token = None
            elif token is not None:
                beat = ts
        if token is not None and (now - beat).total_seconds() >= term:
            out.append((task, token, beat, beat + dt.timedelta(seconds=term)))
    return sorted(out)


def test_leases(spark, tmp_path):
    rng = random.Random(13)
    times = sorted(rng.randrange(9000) for _ in range(260))
    rows = [(rng.randrange(9), i, at(t), rng.choice(["claim", "beat", "beat", "beat", "complete"])) for i, t in enumerate(times)]
    expected = plain_expired(rows, rows[-1][2], 420)
    assert len(expected) > 10
    batch = T.expired(spark.createDataFrame(rows, LEASES).repartition(3))
    assert sorted(map(tuple, batch.collect())) == expected
    out, folder = str(tmp_path / "out"), tmp_path / "in"
    for a in range(0, 260, 65):
        part = rows[a : a + 65]
        rng.shuffle(part)
        spark.createDataFrame(part, LEASES).coalesce(1).write.mode("append").parquet(str(folder))
        if a >= 65:
            found = T.collected(spark, T.expired_stream(stream(spark, folder, LEASES)), out)
    assert sorted(map(tuple, found.collect())) == expected


def test_session_state_is_read_once_for_a_batch():
    """However many events a run has in a micro-batch, its state is read and written once, and early events in one call."""
    calls = []

    class State:
        value, rows = None, []

        def __getattr__(self, name):
            calls.append(name)
            return {"exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "appendList": self.rows.extend}[name]

    class Handle:
        getValueState = getListState = getMapState = lambda self, *a: State()

    import pandas as pd

    session = T._Session()
    session.init(Handle())
    batch = pd.DataFrame([(7, k, at(k), "llm_started" if k % 2 else "tool_started", "p", 0, "t", True) for k in range(60) if k != 50], columns=["run", "position", "ts", "kind", "purpose", "turn", "tool", "ok"])
    (rows,) = session.handleInputRows((7,), iter([batch]), None)
    assert len(rows) == 50
    assert len(calls) <= 4


def test_a_run_takes_and_gives_plain_rows():
    """No frame is made for a run: its state is read once and written once for a micro-batch, and an event that comes early waits for its turn."""
    from pyspark.sql import Row

    from lodeweave.streaming.stateful import _RowSession

    class State:
        def __init__(self):
            self.held, self.calls = None, []

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, value):
            self.calls.append("update")
            self.held = value

        def appendList(self, values):
            self.held = [*(self.held or []), *values]

        put = update

        def clear(self):
            self.held = None

    class Handle:
        def __init__(self):
            self.states = {}

        def getValueState(self, name, schema):
            return self.states.setdefault(name, State())

        getListState = getValueState

    handle, p = Handle(), _RowSession()
    p.init(handle)
    event = Row("run", "position", "ts", "kind", "purpose", "turn", "tool", "ok")
    late = list(p.handleInputRows((7,), iter([event(7, 1, 2_500, "completed", None, 0, None, True)]), None))
    assert late == [] and handle.states["cursor"].calls == ["get", "update"]
    told = list(p.handleInputRows((7,), iter([event(7, 0, 0, "run_started", None, 0, None, True)]), None))
    assert [tuple(x) for x in told] == [(7, 0, "run_started", 0, 0, None, None, 0), (7, 1, "run_completed", 1, 2_500, True, 2.5, 0)]
