"""Retrieval-quality metrics over rankings and gold sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranking: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """EVL-01 to EVL-03 and WIN-13: for each query (query) and cut k: recall, reciprocal rank and nDCG by file.

    ``ranking``: query, rank (from 1), path; ``gold``: query, path. A file counts at its first place alone; the ideal has min(k, relevant files) at the top.
    Queries without gold have null metrics; those without hits have 0.
    """
    relevant = gold.distinct().groupBy("query").agg(F.count(F.lit(1)).alias("relevant"))
    first = ranking.groupBy("query", "path").agg(F.min("rank").alias("rank"))
    hits = first.join(gold.distinct(), ["query", "path"], "left_semi")
    queries = ranking.select("query").distinct().join(relevant, "query", "left")
    every = queries.select("query", "relevant", F.explode(F.array(*(F.lit(k) for k in ks))).alias("k"))
    found = every.join(hits, "query", "left").where("rank IS NULL OR rank <= k")
    at_k = found.groupBy("query", "k").agg(F.count("rank").alias("n"), F.min("rank").alias("best"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("k", "relevant").cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i.cast("double") + 1))
    rows = every.join(at_k, ["query", "k"], "left")
    zero = lambda c: F.when(F.col("relevant").isNotNull(), F.round(F.coalesce(c, F.lit(0.0)), 6))
    return rows.select("query", "k", zero(F.col("n") / F.col("relevant")).alias("recall"), zero(1 / F.col("best")).alias("reciprocal_rank"), zero(F.col("dcg") / ideal).alias("ndcg"))


def ratio(numerator: str, denominator: str):
    """AGG-21: a ratio of sums, null if there is nothing to divide by."""
    return F.round(F.sum(numerator) / F.nullif(F.sum(denominator), F.lit(0)), 6)


def duplicate_rates(ranking: DataFrame) -> DataFrame:
    """EVL-05: the share of a query's items whose file stood before."""
    return ranking.groupBy("query").agg(F.round(1 - F.count_distinct("path") / F.count(F.lit(1)), 6).alias("duplicate_rate"))


def occurrence(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """WIN-05: numbers rows that share a key."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def line_metrics(items: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """EVL-04 and EVL-05: for each query the share of expected (path, line) pairs that its first ``k`` items show, of gold ranges shown whole, and of shown lines that were shown before.

    ``items``: query, rank, path, low, high; ``gold``: query, path, low, high; ranges are closed. Queries without gold have null coverage.
    """
    spread = lambda df: df.select("query", "path", F.explode(F.sequence("low", "high")).alias("line"))
    few = spread(items.where(F.col("rank") <= k))
    repeats = few.groupBy("query", "path", "line").agg(F.count(F.lit(1)).alias("n"))
    totals = repeats.groupBy("query").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("different"))
    wanted = gold.select("query", "path", "low", "high").distinct()
    expected = wanted.select("query", "path", "low", "high", F.explode(F.sequence("low", "high")).alias("line"))
    seen = expected.join(repeats, ["query", "path", "line"], "left").withColumn("shown", F.col("n").isNotNull())
    ranges = seen.groupBy("query", "path", "low", "high").agg(F.bool_and("shown").alias("whole"))
    lines_ = seen.groupBy("query", "path", "line").agg(F.bool_or("shown").alias("shown")).groupBy("query").agg(F.count(F.lit(1)).alias("expected"), F.count_if("shown").alias("covered"))
    whole = ranges.groupBy("query").agg(F.count(F.lit(1)).alias("symbols"), F.count_if("whole").alias("whole"))
    rows = items.select("query").distinct().join(totals, "query", "left").join(lines_, "query", "left").join(whole, "query", "left")
    return rows.select("query", F.round(F.col("covered") / F.col("expected"), 6).alias("line_coverage"), F.round(F.col("whole") / F.col("symbols"), 6).alias("symbol_recall"),
        F.round(F.coalesce((F.col("total") - F.col("different")) / F.col("total"), F.lit(0.0)), 6).alias("duplicate_line_rate"))


def distinct_path_metrics(ranking: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """EVL-06: recall and reciprocal rank where ``k`` counts distinct paths, each at its first place: query, recall, reciprocal_rank."""
    first = ranking.groupBy("query", "path").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank", "path"))
    few = first.withColumn("place", place).where(F.col("place") <= k)
    hits = few.join(gold.distinct(), ["query", "path"], "left_semi").groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.min("place").alias("best"))
    relevant = gold.distinct().groupBy("query").agg(F.count(F.lit(1)).alias("relevant"))
    rows = ranking.select("query").distinct().join(relevant, "query", "left").join(hits, "query", "left")
    zero = lambda c: F.when(F.col("relevant").isNotNull(), F.round(F.coalesce(c, F.lit(0.0)), 6))
    return rows.select("query", zero(F.col("hits") / F.col("relevant")).alias("recall"), zero(1 / F.col("best")).alias("reciprocal_rank"))


def credited_gains(items: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """WIN-14: for each query and rank up to ``k`` whether the item is credited: it covers a gold range that no earlier item was credited for, of several the first.

    ``items``: query, rank, path, low, high; ``gold``: query, place, path, low, high. A query's items are folded in order of rank; only gold that one of them covers is held, so an array is bounded by ``k`` and what k items cover.
    """
    few = items.where(F.col("rank") <= k)
    covers = few.join(gold.select("query", "place", "path", F.col("low").alias("g_low"), F.col("high").alias("g_high")), ["query", "path"]).where("g_low >= low AND g_high <= high")
    each = covers.groupBy("query", "rank").agg(F.array_sort(F.collect_set("place")).alias("places"))
    rows = few.select("query", "rank").join(each, ["query", "rank"], "left").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("places", F.array().cast("array<int>")).alias("places")))).alias("items"))
    empty = F.struct(F.array().cast("array<int>").alias("credited"), F.array().cast("array<struct<rank:int,gain:boolean>>").alias("out"))

    def step(state, item):
        new = F.get(F.filter(item["places"], lambda p: ~F.array_contains(state["credited"], p)), F.lit(0))
        credited = F.when(new.isNotNull(), F.concat(state["credited"], F.array(new))).otherwise(state["credited"])
        return F.struct(credited.alias("credited"), F.concat(state["out"], F.array(F.struct(item["rank"].alias("rank"), new.isNotNull().alias("gain")))).alias("out"))

    return rows.select("query", F.explode(F.aggregate("items", empty, step, lambda s: s["out"])).alias("x")).select("query", "x.rank", "x.gain")
