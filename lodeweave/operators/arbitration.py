"""Compare-and-set among rival writes (STR-09) and marks along chains, by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored


def marked(starts: DataFrame, jumps: DataFrame) -> DataFrame:
    """Every node that can be reached from ``starts`` (node) along ``jumps`` (node, onward; one for each node at most), the starts included.

    Each round marks what the jumps of all marked nodes lead to and joins the jumps with themselves, so they are twice as long: a chain's length costs its logarithm in rounds, and a round
    one row for each node. A round that marks nothing new ends it, on rings too.
    """
    seen = stored(starts.select("node").distinct(), "marked")
    jumps = stored(jumps.where("onward IS NOT NULL").select("node", "onward"), "jumps")
    n = seen.count()
    while n:
        reached = jumps.join(seen, "node", "left_semi").select(F.col("onward").alias("node"))
        seen = stored(seen.unionByName(reached).distinct(), "marked")
        before, n = n, seen.count()
        if n == before:
            break
        jumps = stored(jumps.join(jumps.select(F.col("node").alias("onward"), F.col("onward").alias("further")), "onward").select("node", F.col("further").alias("onward")), "jumps")
    return seen


def compared_and_set(writes: DataFrame, key: str, order: list[str], expected: str, id_: str) -> DataFrame:
    """STR-09: ``writes`` with ``won``: whether a write found its key at the version it expects. Keys begin at version 0, a winner raises its key's by one, and all else is a noop that changes nothing.

    Of the writes that expect a version, the first one after the winner of the version before wins. So each write has at most one that would win after it: the first later one of its key
    that expects one version more, one running value over two neighbouring versions. The winners are the chain of those from the first write that expects 0.
    ``id_`` tells writes apart and ``order`` puts a key's in order.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = stored(writes.withColumn("place", place), "writes")
    ends = F.array(F.struct(F.col(expected).alias("version"), F.lit(True).alias("before")), F.struct((F.col(expected) - 1).alias("version"), F.lit(False).alias("before")))
    both = rows.where(f"{expected} >= 0").select(key, id_, "place", F.explode(ends).alias("x")).select(key, id_, "place", "x.*")
    later = Window.partitionBy(key, "version").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("onward", F.last(F.when(~F.col("before"), F.col(id_)), ignorenulls=True).over(later))
    jumps = both.where("before").select(F.col(id_).alias("node"), "onward")
    starts = both.where("version = -1").groupBy(key).agg(F.min_by(id_, "place").alias("node"))
    winners = marked(starts, jumps).withColumn("won", F.lit(True)).withColumnRenamed("node", id_)
    return rows.drop("place").join(winners, id_, "left").withColumn("won", F.coalesce("won", F.lit(False)))


def final_state(arbitrated: DataFrame, key: str, expected: str, state: str) -> DataFrame:
    """Each key's version and the state that its last winner set, with its noops: key, version, state, noops. A key without a winner is at version 0 and has no state."""
    won = F.col("won")
    return arbitrated.groupBy(key).agg(F.coalesce(F.max(F.when(won, F.col(expected) + 1)), F.lit(0)).cast("long").alias("version"), F.max_by(state, F.when(won, F.col(expected))).alias("state"), F.count_if(~won).alias("noops"))


def paired_open(events: DataFrame, key: list[str], order: list[str], is_start, is_finish, id_: str) -> DataFrame:
    """JOI-24: each finish with the last start before it that is open among those of its key, as of its own place: start_id, finish_id. A start that another one follows, and a finish that comes when nothing is open, pair with nothing.

    One sorted pass: what stands right before a finish among its key's starts and finishes is its start, if it is one.
    """
    rows = events.withColumn("step", F.when(is_start, 1).when(is_finish, -1)).where("step IS NOT NULL")
    run = Window.partitionBy(*key).orderBy(*order)
    rows = rows.withColumns({"before_step": F.lag("step").over(run), "start_id": F.lag(id_).over(run)})
    return rows.where("step = -1 AND before_step = 1").select(*key, "start_id", F.col(id_).alias("finish_id"))
