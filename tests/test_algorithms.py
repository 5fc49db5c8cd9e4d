"""Range joins, order statistics, compare-and-set and chains against plain versions."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import arbitration, ranges, selection

RANGES = "key string, low long, high long, id long"


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping(spark, seed):
    rng = random.Random(seed)

    def some(n):
        out = []
        for i in range(n):
            low = rng.randrange(-300, 300)
            out.append((rng.choice(["a", "a", "b", None]), low if rng.random() < 0.95 else None, low + rng.choice([0, 1, 3, 8, 200, -5, rng.randrange(900)]) if rng.random() < 0.95 else None, i))
        return out

    a, b = some(120), some(150)
    got = ranges.overlapping(spark.createDataFrame(a, RANGES), spark.createDataFrame(b, RANGES), "key", "low", "high").collect()
    fine = lambda r: r[0] is not None and r[1] is not None and r[2] is not None and r[1] <= r[2]
    expected = [(*x, y[1], y[2]) for x in a for y in b if fine(x) and fine(y) and x[0] == y[0] and y[1] <= x[2] and y[2] >= x[1]]
    assert sorted(map(tuple, got)) == sorted(expected) and expected
    assert ranges.overlapping(spark.createDataFrame(a, RANGES).limit(0), spark.createDataFrame(b, RANGES), "key", "low", "high").count() == 0


def test_overlapping_hot_key(spark):
    """A key with 200,000 short ranges and some long ones: what is compared grows with what meets."""
    n = 200_000
    rows = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") * 10).alias("low"), (F.col("id") * 10 + F.when(F.col("id") % 50_000 == 7, 100_000).otherwise(12)).alias("high"), "id")
    found = ranges.overlapping(rows, rows.select("key", "low", "high"), "key", "low", "high")
    assert found.count() == 3 * n - 2 + 2 * sum(10_000 - 1 for i in range(7, n, 50_000))


def test_overlapping_in_pieces(spark):
    """Repeated ranges of one key meet in pieces of a bounded size, spread over tasks, and each pair comes once."""
    rows = spark.range(600).select(F.lit("k").alias("key"), (F.col("id") % 3).alias("low"), (F.col("id") % 3 + F.when(F.col("id") == 5, 900).otherwise(4)).alias("high"), "id")
    found = ranges.overlapping(rows, rows.select("key", "low", "high").unionByName(rows.select("key", "low", "high").limit(1)), "key", "low", "high", side=96)
    by_id = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("other_high") > 100).alias("long"))
    assert [(r["n"], r["long"]) for r in by_id.collect()] == [(601, 1)] * 600
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 600 * 601 and max(tasks) < 600 * 601 / 6


def test_ranked(spark):
    rng = random.Random(3)
    groups = {"ties": [rng.choice([1.0, 2.0, 2.5]) for _ in range(400)], "spread": [rng.lognormvariate(0, 12) * rng.choice([-1, 1]) for _ in range(600)], "one": [7.25], None: [rng.random() for _ in range(300)], "equal": [3.0] * 200}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("empty", None), ("ties", float("nan")), ("ties", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    for bins, few in ((64, 5), (256, 4096)):
        got = {(r["g"], r["name"]): r["value"] for r in selection.ranked(df, "g", "v", {"first": F.lit(1), "mid": F.ceil(F.col("n") / 2), "last": F.col("n"), "beyond": F.col("n") + 1}, bins, few).collect()}
        expected = {}
        for g, vs in groups.items():
            own = sorted(vs)
            expected |= {(g, "first"): own[0], (g, "mid"): own[-(-len(own) // 2) - 1], (g, "last"): own[-1]}
        assert got == expected


def test_percentiles(spark):
    rng = random.Random(4)
    groups = {"a": [rng.gauss(0, 5) for _ in range(501)], "b": [rng.gauss(0, 5) for _ in range(500)], "c": [1.5]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("d", None)], "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in selection.percentiles(df, "g", "v").collect()}
    for g, vs in groups.items():
        own = sorted(vs)
        expected = (round(statistics.median(own), 6), own[-(-len(own) // 2) - 1], own[-(-len(own) * 95 // 100) - 1], round(statistics.fmean(own), 6))
        assert got[g] == pytest.approx(expected, abs=2e-6)
    assert got["d"] == (None, None, None, None)


def test_marked(spark):
    """A chain of 10,000, a ring, a chain that runs into the ring, and starts without an edge."""
    chain = [(i, i + 1) for i in range(10_000)]
    ring = [(20_000 + i, 20_000 + (i + 1) % 500) for i in range(500)]
    into = [(30_000, 30_001), (30_001, 20_250)]
    jumps = spark.createDataFrame([*chain, *ring, *into, (40_000, None)], "node long, onward long")
    starts = lambda *x: spark.createDataFrame([(i,) for i in x], "node long")
    got = {r["node"] for r in arbitration.marked(starts(3, 30_000, 40_000, 77_777), jumps).collect()}
    assert got == {*range(3, 10_001), 30_000, 30_001, *range(20_000, 20_500), 40_000, 77_777}
    assert arbitration.marked(starts(), jumps).count() == 0


WRITES = "key string, at long, id long, expected long, state string"


@pytest.mark.parametrize("seed", [5, 6])
def test_compared_and_set(spark, seed):
    rng = random.Random(seed)
    rows, current = [], {}
    for i in range(600):
        key = rng.choice(["a", "a", "a", "b", "c"])
        guess = current.get(key, 0) + rng.choice([0, 0, -1, 1, 2, -2])
        rows.append((key, i // 2, i, guess, f"s{i}"))
        if guess == current.get(key, 0):
            current[key] = guess + 1
    rows.append(("d", 0, 1000, 4, "never"))
    version, state, won, noops = {}, {}, set(), {}
    for key, _, i, expected, new in sorted(rows, key=lambda r: (r[1], r[2])):
        if expected == version.get(key, 0):
            version[key], state[key] = expected + 1, new
            won.add(i)
        else:
            noops[key] = noops.get(key, 0) + 1
    df = spark.createDataFrame(rows, WRITES).repartition(3)
    found = arbitration.compared_and_set(df, "key", ["at", "id"], "expected", "id")
    assert {r["id"] for r in found.collect() if r["won"]} == won and found.count() == len(rows) and max(version.values()) > 40
    final = {r["key"]: (r["version"], r["state"], r["noops"]) for r in arbitration.final_state(found, "key", "expected", "state").collect()}
    assert final == {k: (version.get(k, 0), state.get(k), noops.get(k, 0)) for k in "abcd"}


def test_paired_open(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randrange(2), i, rng.choice(["s", "f", "x"])) for i in range(200)]
    df = spark.createDataFrame(rows, "run string, turn int, id long, kind string")
    got = {tuple(r) for r in arbitration.paired_open(df, ["run", "turn"], ["id"], F.col("kind") == "s", F.col("kind") == "f", "id").collect()}
    expected, open_ = set(), {}
    for run, turn, i, kind in rows:
        if kind == "s":
            open_[run, turn] = i
        elif kind == "f" and (run, turn) in open_:
            expected.add((run, turn, open_.pop((run, turn)), i))
    assert got == expected
