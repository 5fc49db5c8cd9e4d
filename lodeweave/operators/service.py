"""Relational operators of a task service: pages, quotas, leases, submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """SRT-06 and SRT-07: rows offset+1 to offset+limit in a total order, with ``has_more``: whether a further row follows. Partitions send offset+limit+1 rows each at most."""
    few = rows.orderBy(*order).limit(offset + limit + 1)
    placed = few.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
    more = F.max("place").over(Window.partitionBy(F.lit(1))) > offset + limit
    return placed.withColumn("has_more", more).where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def late_lookup(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """JOI-21: a page of keys joined back to the wide rows; the page is bounded by its limit, so it is broadcast."""
    return rows.join(F.broadcast(keys), key)


def latest(rows: DataFrame, group: str, order: Column, fields: list[str]) -> DataFrame:
    """SRT-08: each group's last row by ``order``, which must be total; an aggregate, so a large group is reduced before it moves."""
    return rows.groupBy(group).agg(F.max_by(F.struct(*fields), order).alias("x")).select(group, *(F.col(f"x.{f}").alias(f) for f in fields))


def active_counts(tasks: DataFrame, owners: DataFrame, key: str, active: Column, limit: int) -> DataFrame:
    """AGG-17 and JOI-20: each owner's active tasks, counted before the join, and whether the quota is reached."""
    counts = tasks.where(active).groupBy(key).agg(F.count(F.lit(1)).alias("active"))
    return owners.join(counts, key, "left").select(key, F.coalesce("active", F.lit(0)).alias("active"), (F.coalesce("active", F.lit(0)) >= limit).alias("exhausted"))


def first_submissions(rows: DataFrame, key: list[str], order: list[str], fingerprint: str) -> DataFrame:
    """STR-10: of each idempotency key its first submission's fingerprint, how many came and whether any has another fingerprint."""
    found = rows.groupBy(*key).agg(F.min_by(F.col(fingerprint), F.struct(*order)).alias("kept"), F.count(F.lit(1)).alias("n"), F.min(fingerprint).alias("low"), F.max(fingerprint).alias("high"))
    return found.select(*key, "kept", "n", (F.col("low") != F.col("high")).alias("conflict"))


def backoff(attempts: Column, maximum: float) -> Column:
    """STR-08: seconds until the next attempt: 5, 15, 30, 60, then doubled each time, never more than ``maximum``."""
    steps = F.when(attempts <= 1, 5.0).when(attempts == 2, 15.0).when(attempts == 3, 30.0).when(attempts == 4, 60.0)
    return F.least(steps.otherwise(60.0 * F.pow(F.lit(2.0), attempts - 4)), F.lit(float(maximum)))


def stale_decision(kind: Column, ready: Column, attempts: Column, token: Column, most: int = 2) -> Column:
    """STR-07: what becomes of a task whose lease has run out: complete, requeue or fail, by the first rule that applies."""
    again = F.when(attempts < most, "requeue").otherwise("fail")
    semantic = F.when(ready, "complete").otherwise(again)
    index = F.when(~token, "fail").when(ready, "complete").otherwise(again)
    run = F.when(~token, "fail").otherwise(again)
    return F.when(kind == "semantic", semantic).when(kind == "repository_index", index).when(kind == "agent_run", run).otherwise("fail")


def stale_decisions(tasks: DataFrame, most: int = 2) -> DataFrame:
    """STR-07: ``tasks`` with decision (deferred, complete, requeue, fail), code (why it failed) and restores (whether its project is ready again), by the first rule that applies.

    Columns: task_type, has_project, locked (its project is), attempts, token, snapshot_id, snapshot_status, snapshot_project, project_id, project_status, current_snapshot, artifact_ready, continuation (the snapshot that what
    follows is for; null: unavailable), backfill (of chunks alone), relations_valid, metadata_valid, core_started, has_result, finished, n_traces. A condition on a null doesn't hold.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind, again = F.col("task_type"), yes(F.col("attempts") < most)
    ready = yes(F.col("snapshot_status") == "ready")
    current, snapshot = F.col("current_snapshot"), F.col("snapshot_id")
    semantic = F.when(ready & yes(F.col("artifact_ready")), "complete").when(ready & again, "requeue").otherwise("fail")
    lost = snapshot.isNull() | F.col("token").isNull() | F.col("snapshot_status").isNull() | F.col("project_status").isNull() | ~yes(F.col("snapshot_project") == F.col("project_id"))
    built = ready & yes(F.col("project_status") == "ready") & yes(current == snapshot)
    under_way = (yes(F.col("snapshot_status") == "indexing") | yes(F.col("backfill"))) & (current.isNull() | yes(current == snapshot)) & again
    index = F.when(lost, "fail").when(built & yes(F.col("continuation") == snapshot), "complete").when(built, F.when(again, "requeue").otherwise("fail")).when(under_way, "requeue").otherwise("fail")
    untouched = yes(F.col("relations_valid")) & yes(F.col("metadata_valid")) & ~yes(F.col("core_started")) & ~yes(F.col("has_result")) & ~yes(F.col("finished")) & yes(F.col("n_traces") == 0)
    run = F.when(F.col("token").isNotNull() & untouched & again, "requeue").otherwise("fail")
    decision = (
        F.when(yes(F.col("has_project")) & yes(F.col("locked")), "deferred")
        .when(kind == "semantic", semantic)
        .when(kind == "repository_index", index)
        .when(kind == "agent_run", run)
        .otherwise("fail")
    )
    failed = F.col("decision") == "fail"
    code = F.when(failed, F.when((kind == "agent_run") & F.col("token").isNotNull() & yes(F.col("core_started")), "worker_lost_after_agent_core").otherwise("worker_execution_lost"))
    return tasks.withColumn("decision", decision).withColumns({"code": code, "restores": failed & (kind == "repository_index") & ~lost & yes(F.col("backfill"))})


def settled(decisions: DataFrame, now: DataFrame, key: str, version: str) -> DataFrame:
    """STR-07: how many tasks came out how: decision, n. A decision is applied only to a task that is still at the version it was made for; otherwise it is a noop, which counts as deferred. ``now`` has each task's version."""
    rows = decisions.join(now.select(key, F.col(version).alias("now_version")), key, "left")
    held = F.coalesce(F.col(version) == F.col("now_version"), F.lit(False))
    return rows.groupBy(F.when(held, F.col("decision")).otherwise("deferred").alias("decision")).agg(F.count(F.lit(1)).alias("n"))
