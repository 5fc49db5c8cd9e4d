"""Evidence and data-quality operators: overlaps, containment, rule violations, runs, capacities."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored


def supported(citations: DataFrame, references: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """FLT-16: ``citations`` with ``ok``: whether a reference of the same key contains their range.

    In order of their beginnings, a range is contained if the furthest end of all references so far reaches its own: one sorted pass over both, no pairs.
    """
    names = citations.columns
    own = citations.withColumns({"_cited": F.lit(1), "_end": F.lit(None).cast("long")})
    other = references.select(key, F.col(low), F.col(high).cast("long").alias("_end"), F.lit(0).alias("_cited"))
    order = Window.partitionBy(key).orderBy(low, "_cited").rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(other, allowMissingColumns=True).withColumn("_far", F.max("_end").over(order))
    return both.where("_cited = 1").withColumn("ok", F.coalesce(F.col("_far") >= F.col(high), F.lit(False))).select(*names, "ok")


def citations(answers: DataFrame, key: str, text: str) -> DataFrame:
    """FLT-16: key, path, low, high of every ``path.py:low-high`` in a text."""
    found = answers.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_./-]+\.py:[0-9]+-[0-9]+"), F.lit(0))).alias("cited"))
    part = lambda pattern: F.regexp_extract("cited", pattern, 1)
    return found.select(key, part("^(.*):").alias("path"), part(":([0-9]+)-").cast("int").alias("low"), part("-([0-9]+)$").cast("int").alias("high"))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """FLT-10, FLT-13 and FLT-14: key and rule of every row that breaks one; a rule that can't be decided is broken. One pass for all rules."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return rows.select(key, F.explode(broken).alias("rule"))


def runs(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """WIN-07 and WIN-12: stretches of equal values in order (gaps and islands): key, run, value, n."""
    by = Window.partitionBy(key).orderBy(*order)
    fresh = (F.lag(value).over(by) != F.col(value)) | F.lag(value).over(by).isNull()
    marked = events.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "run", value).agg(F.count(F.lit(1)).alias("n"))


def capped(rows: DataFrame, key: str, order: list[str], size: str, most: int) -> DataFrame:
    """WIN-09: the rows of a key that fit its capacity: taken in order, one that would overflow it is skipped and later ones may still fit. Sorted partitions stream through with one running sum."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used = None, 0
        for batch in batches:
            keep = []
            for own, n in zip(batch[key], batch[size], strict=True):
                if own != current:
                    current, used = own, 0
                fits = used + n <= most
                used += n * fits
                keep.append(fits)
            yield batch[pd.Series(keep, index=batch.index, dtype=bool)]

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(walk, rows.schema)


def ancestors(parents: DataFrame, depth: int) -> DataFrame:
    """GQ-14: every ancestor of every node within ``depth`` steps: node, ancestor, steps. ``parents`` (node, parent). Each level is one join and a stored table; it ends where no level is left."""
    up = stored(parents.where("parent IS NOT NULL").select(F.col("node").alias("ancestor"), F.col("parent").alias("next")), "parents")
    levels = [up.select(F.col("ancestor").alias("node"), F.col("next").alias("ancestor"), F.lit(1).alias("steps"))]
    for k in range(2, depth + 1):
        level = stored(levels[-1].join(up, "ancestor").select("node", F.col("next").alias("ancestor"), F.lit(k).alias("steps")), "ancestors")
        if not level.limit(1).count():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def no_progress(events: DataFrame, key: str, order: list[str], call: str) -> DataFrame:
    """STR-13 and WIN-12: ``events`` of a run with epoch, stagnant and repeats, and ``blocked``: the same call twice without progress between, or three events without any.

    A call seen for the first time in its run is progress and opens an epoch; what follows in it stagnates.
    """
    run = Window.partitionBy(key).orderBy(*order)
    fresh = (F.row_number().over(Window.partitionBy(key, call).orderBy(*order)) == 1).cast("int")
    rows = events.withColumn("fresh", fresh).withColumn("epoch", F.sum("fresh").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    stagnant = F.row_number().over(Window.partitionBy(key, "epoch").orderBy(*order)) - 1
    repeats = F.row_number().over(Window.partitionBy(key, "epoch", call).orderBy(*order))
    rows = rows.withColumns({"stagnant": stagnant, "repeats": repeats}).drop("fresh")
    return rows.withColumn("blocked", (F.col("repeats") >= 2) | (F.col("stagnant") >= 3))
