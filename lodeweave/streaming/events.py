"""Structured Streaming twins of the event-log operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """STR-03: a stream of the Parquet files that arrive in a folder; a checkpointed query resumes where it stopped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, time: str, group: str, window: str, late: str) -> DataFrame:
    """Counts by event-time window and group; events later than ``late`` are dropped and finished windows leave the state."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), group, "n")


def limited(events: DataFrame, key: str, time: str, id_: str, limit: int, seconds: int) -> DataFrame:
    """STR-05 on a stream: key, id, admitted. A key's state is its window's start and count, and goes once the watermark has passed the window.

    Events of one micro-batch are taken in order of time and id; a key's window opens with its first admitted event.
    """

    def walk(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values([time, id_])
        admitted = []
        for at in rows[time]:
            now = at.timestamp()
            if opened is None or now - opened >= seconds:
                opened, used = now, 0
            used += 1
            admitted.append(used <= limit)
        state.update((opened, min(used, limit)))
        until = int((opened + seconds) * 1000)
        if until > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(until)
        yield pd.DataFrame({key: group[0], id_: rows[id_], "admitted": admitted})

    kinds = dict(events.dtypes)
    out = f"{key} {kinds[key]}, {id_} {kinds[id_]}, admitted boolean"
    return events.withWatermark(time, "0 seconds").groupBy(key).applyInPandasWithState(walk, out, "opened double, used int", "append", GroupStateTimeout.EventTimeTimeout)


def normalised(events: DataFrame, key: str, time: str, id_: str, kind: str, once: tuple[str, ...] = ("plan_created",)) -> DataFrame:
    """STR-01 and STR-02 on a stream: key, id, kind, sequence. Events of kinds in ``once`` count the first time alone; the others are numbered through from 0. A key's state is its next number and the kinds seen."""

    def walk(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, seen = state.get if state.exists else (0, [])
        seen = list(seen)
        out = []
        for row in pd.concat(list(batches)).sort_values([time, id_]).itertuples(index=False):
            own = getattr(row, kind)
            if own in once:
                if own in seen:
                    continue
                seen.append(own)
            out.append((group[0], getattr(row, id_), own, following))
            following += 1
        state.update((following, seen))
        yield pd.DataFrame(out, columns=[key, id_, kind, "sequence"])

    kinds = dict(events.dtypes)
    return events.groupBy(key).applyInPandasWithState(walk, f"{key} {kinds[key]}, {id_} {kinds[id_]}, {kind} string, sequence long", "following long, seen array<string>", "append", GroupStateTimeout.NoTimeout)
