"""Exact order statistics by passes of histograms (AGG-18, AGG-19)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

#: Bins of a pass, and values among which a rank is looked up directly.
BINS, FEW = 256, 4096


#: Ranges (a few dozen bytes each) that are broadcast at most; more are joined by a shuffle.
MOST_RANGES = 1 << 18


def _held(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The values that lie in the ranges of ``wanted``, each once for every distinct range of its group: g, low, high, value."""
    ranges = stored(wanted.select(F.col("group").alias("g"), "low", "high").distinct(), "distinct-ranges")
    ranges = F.broadcast(ranges) if ranges.count() <= MOST_RANGES else ranges
    return rows.join(ranges, F.col("group").eqNullSafe(F.col("g")) & F.col("value").between(F.col("low"), F.col("high"))).drop("group")


def _of_range(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """``wanted`` with what was ``found`` (g, low, high, ...) for its range."""
    found = found.withColumnsRenamed({"low": "from", "high": "to"})
    return wanted.join(found, F.col("group").eqNullSafe(F.col("g")) & (F.col("low") == F.col("from")) & (F.col("high") == F.col("to")))


def ranked(rows: DataFrame, group: str, value: str, ranks: Mapping[str, Column], bins: int = BINS, few: int = FEW) -> DataFrame:
    """For each group and name the value of the given rank (from 1): group, name, value. ``ranks`` are columns of ``n``, the group's values (nulls, infinities and NaN don't count); a rank beyond them gives no row.

    A pass counts, map-side, how many values of each open (group, name) fall into each of ``bins`` equal parts of the range that still holds the rank, with each part's least and greatest value;
    the part that holds the rank is the next range. Where its ends are equal, the value is found; where few values are left, they are sorted. So no task ever holds or sorts a group, whatever
    its size, and the rows of a group are never brought together. A range that several names share is counted once.
    """
    rows = rows.select(F.col(group).alias("group"), F.col(value).cast("double").alias("value")).where("abs(value) < double('infinity')")
    ends = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    wanted = ends.withColumn("x", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()))))
    wanted = stored(wanted.select("group", "x.name", "x.rank", "n", "low", "high").where("rank BETWEEN 1 AND n"), "ranges")
    found = []
    while True:
        found.append(wanted.where("low = high").select("group", "name", F.col("low").alias("value")))
        small, left = wanted.where(f"low < high AND n <= {few}"), wanted.where(f"low < high AND n > {few}")
        if not left.limit(1).count():
            break
        share = (F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves, so that no difference overflows
        part = F.least(F.lit(bins - 1), F.floor(share * bins)).alias("part")
        counts = _held(rows, left).groupBy("g", "low", "high", part).agg(F.count(F.lit(1)).alias("k"), F.min("value").alias("least"), F.max("value").alias("most"))
        upto = F.sum("k").over(Window.partitionBy("g", "low", "high").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        here = _of_range(left, counts.withColumn("upto", upto)).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("k")))
        here = here.select("group", "name", (F.col("rank") - F.col("upto") + F.col("k")).alias("rank"), F.col("k").alias("n"), F.col("least").alias("low"), F.col("most").alias("high"))
        wanted = stored(here.unionByName(small), "ranges")
    values = _held(rows, small).groupBy("g", "low", "high").agg(F.sort_array(F.collect_list("value")).alias("values"))  # few, by the condition above
    out = _of_range(small, values).select("group", "name", F.get("values", (F.col("rank") - 1).cast("int")).alias("value"))
    for part in found:
        out = out.unionByName(part)
    return out.withColumnRenamed("group", group)


def percentiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """AGG-18 and AGG-19: interpolated and nearest-rank median, nearest-rank 95th percentile and mean of each group's values; null where it has none."""
    n = F.col("n")
    found = ranked(rows, group, value, {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1, "nearest": F.ceil(n * 0.5), "p95": F.ceil(n * 95 / 100)})
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    wide = found.groupBy(group).agg(F.round((of("low") + of("high")) / 2, 6).alias("p50"), of("nearest").alias("p50_nearest"), of("p95").alias("p95"))
    means = rows.groupBy(group).agg(F.round(F.avg(value), 6).alias("mean"))
    return means.alias("m").join(wide.alias("w"), F.col(f"m.{group}").eqNullSafe(F.col(f"w.{group}")), "left").select(f"m.{group}", "p50", "p50_nearest", "p95", "mean")
