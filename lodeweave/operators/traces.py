"""Event-log operators: sequences, pairing, gaps, histograms, budgets, limits. ``key`` names a run, ``order`` what its events are ordered by."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 30.0, 120.0)


def sequenced(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """WIN-10: sequence numbers from 0 without gaps in each run."""
    return events.withColumn("sequence", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def gaps(events: DataFrame, key: str, sequence: str = "sequence") -> DataFrame:
    """Runs of numbers that are missing before an event: key, from_sequence, to_sequence."""
    before = F.lag(sequence).over(Window.partitionBy(key).orderBy(sequence))
    first = F.coalesce(before, F.lit(-1)) + 1
    return events.select(key, F.col(sequence), first.alias("from_sequence")).where(F.col(sequence) > F.col("from_sequence")).select(key, F.col("from_sequence").cast("long").alias("from_sequence"), (F.col(sequence) - 1).cast("long").alias("to_sequence"))


def paired_lifo(events: DataFrame, key: str, order: list[str], is_start: Column, is_finish: Column, id_: str) -> DataFrame:
    """JOI-25: each finish with the last start that is still open: key, start_id, finish_id.

    Starts and finishes are brackets: at one depth of a run they alternate, so a start's partner is what follows it at its own depth.
    Finishes without an open start lie deeper than anything before them and pair with nothing.
    """
    step = F.when(is_start, 1).when(is_finish, -1)
    marked = events.withColumn("step", step).where("step IS NOT NULL")
    depth = F.sum("step").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("depth", F.when(F.col("step") == 1, depth).otherwise(depth + 1))
    level = Window.partitionBy(key, "depth").orderBy(*order)
    marked = marked.withColumns({"next_step": F.lead("step").over(level), "finish_id": F.lead(id_).over(level)})
    return marked.where("step = 1 AND next_step = -1").select(key, F.col(id_).alias("start_id"), "finish_id")


def paired_fifo(events: DataFrame, key: str, order: list[str], is_start: Column, is_finish: Column, id_: str) -> DataFrame:
    """JOI-25: the n-th finish of a run with its n-th start, if that came first."""
    by = Window.partitionBy(key, "step").orderBy(*order)
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    marked = events.withColumn("step", F.when(is_start, 1).when(is_finish, -1)).withColumn("place", place).where("step IS NOT NULL").withColumn("n", F.row_number().over(by))
    pairs = marked.groupBy(key, "n").agg(F.max(F.when(F.col("step") == 1, F.col(id_))).alias("start_id"), F.max(F.when(F.col("step") == -1, F.col(id_))).alias("finish_id"), F.max(F.when(F.col("step") == 1, F.col("place"))).alias("a"), F.max(F.when(F.col("step") == -1, F.col("place"))).alias("b"))
    return pairs.where("a < b").select(key, "start_id", "finish_id")


def histogram(events: DataFrame, group: str, value: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """AGG-09: cumulative buckets, the last one without a bound; each row is counted once map-side, whatever its group."""
    sums = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    wide = events.where(F.col(value).isNotNull()).groupBy(group).agg(*sums, F.count(F.lit(1)).alias("le_inf"))
    rows = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("n")))
    return wide.select(group, F.explode(rows).alias("b")).select(group, "b.le", "b.n")


def first_stop(events: DataFrame, key: str, order: list[str], limits: list[tuple[str, Column, int, str]]) -> DataFrame:
    """STR-12: for each run, the first event that would exceed one of the limits (name, predicate, limit, reason): key, event_id, reason. Of limits that one event exceeds, the first counts."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    reason = F.coalesce(*(F.when(predicate & (F.count_if(predicate).over(so_far) > limit), F.lit(why)) for _, predicate, limit, why in limits))
    marked = events.withColumn("reason", reason).where("reason IS NOT NULL")
    first = F.min_by(F.struct("event_id", "reason"), F.struct(*order))
    return marked.groupBy(key).agg(first.alias("x")).select(key, "x.event_id", "x.reason")


def transitions(events: DataFrame, key: str, order: list[str], status: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """STR-09: steps from one status to the next that are not allowed: key, event_id, was, now."""
    was = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    pair = F.concat_ws(">", "was", "now")
    rows = events.select(key, "event_id", was.alias("was"), F.col(status).alias("now")).where("was IS NOT NULL")
    return rows.where(~pair.isin(*(f"{a}>{b}" for a, b in allowed)))


def fixed_window_limit(events: DataFrame, key: list[str], time: str, limit: int, seconds: int, order: list[str]) -> DataFrame:
    """STR-05: ``events`` with ``admitted``: at most ``limit`` events of a key in a window that opens with its first admitted one and lasts ``seconds``; refused ones neither count nor prolong it.

    Where a window opens depends on the one before, so a key's events are walked in order; its partition streams through in sorted batches and holds one counter, never a whole key.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, opened, used = None, None, 0
        for batch in batches:
            admitted = []
            for own, at in zip(batch[key].itertuples(index=False, name=None), batch[time], strict=True):
                if own != current:
                    current, opened, used = own, None, 0
                if opened is None or (at - opened).total_seconds() >= seconds:
                    opened, used = at, 0
                used += 1
                admitted.append(used <= limit)
            yield batch.assign(admitted=admitted)

    from pyspark.sql import types as T

    schema = T.StructType([*events.schema.fields, T.StructField("admitted", T.BooleanType())])
    return events.repartition(*key).sortWithinPartitions(*key, time, *order).mapInPandas(walk, schema)
