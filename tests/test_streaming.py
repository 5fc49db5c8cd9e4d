"""Streams give what the batch operators give."""

import datetime as dt
import random

from lodeweave.operators import traces
from lodeweave.streaming import events as E

SCHEMA = "key string, ts timestamp, id long, kind string"


def stream(spark, tmp_path, rows, build):
    folder = tmp_path / "in"
    for i in range(0, len(rows), 40):
        spark.createDataFrame(rows[i : i + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    out = str(tmp_path / "out")
    build(E.event_stream(spark, str(folder), SCHEMA, 1000)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


def rows_of(n):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    times = sorted(rng.randrange(4000) for _ in range(n))
    return [(rng.choice("abc"), start + dt.timedelta(seconds=t), i, rng.choice(["plan_created", "tool_started"])) for i, t in enumerate(times)]


def test_limited(spark, tmp_path):
    rows = rows_of(120)
    got = {r["id"]: r["admitted"] for r in stream(spark, tmp_path, rows, lambda s: E.limited(s, "key", "ts", "id", 2, 300)).collect()}
    batch = traces.fixed_window_limit(spark.createDataFrame(rows, SCHEMA), ["key"], "ts", 2, 300, ["id"])
    assert got == {r["id"]: r["admitted"] for r in batch.collect()}


def test_normalised(spark, tmp_path):
    rows = rows_of(90)
    got = sorted((r["key"], r["sequence"], r["id"]) for r in stream(spark, tmp_path, rows, lambda s: E.normalised(s, "key", "ts", "id", "kind")).collect())
    expected = []
    for key in "abc":
        plan, k = False, 0
        for _, _, i, kind in (r for r in rows if r[0] == key):
            if kind == "plan_created" and plan:
                continue
            plan |= kind == "plan_created"
            expected.append((key, k, i))
            k += 1
    assert got == expected


class _Handle:
    """Counts what a processor asks of its state."""

    def __init__(self):
        self.calls, self.value = [], None

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, at):
        self.calls.append("register")

    def deleteTimer(self, at):
        self.calls.append("delete")

    def getCurrentWatermarkInMs(self):
        return 0


def test_state_calls_of_a_run():
    """A run's state is read and written once for a micro-batch; its timer moves only when what it waits for does."""
    import pandas as pd

    from lodeweave.streaming import stateful

    times = lambda *hours: pd.to_datetime([f"2024-01-01 {h:02d}:00:00" for h in hours])
    rows = lambda ids, *hours, **more: iter([pd.DataFrame({"ts": times(*hours), "id": ids, **more})])
    for processor, batches, expected in (
        (stateful._Retention(3, 86_400), [rows([1, 2], 1, 2), rows([3], 3), rows([4], 4)], [["get", "register", "update"], ["get", "update"], ["get", "delete", "register", "update"]]),
        (stateful._Leases(3600 * 5), [rows([1, 2], 1, 2, kind=["claim", "beat"]), rows([3], 2, kind=["claim"]), rows([4], 3, kind=["complete"])], [["get", "register", "update"], ["get"], ["get", "delete", "clear"]]),
    ):
        handle = _Handle()
        processor.init(handle)
        found = []
        for batch, calls in zip(batches, expected, strict=True):
            handle.calls.clear()
            found += [len(frame) for frame in processor.handleInputRows((7,), batch, handle)]
            assert sorted(handle.calls) == sorted(calls)
        assert found == ([1] if isinstance(processor, stateful._Retention) else [])
