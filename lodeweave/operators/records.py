"""Records that expire, supersede each other and belong to a scope (STR-14, FLT-06, JOI-28).

``records``: id, origin (user_explicit, code_derived, model_inference), type, title, related_files (array), project_id, snapshot_id, commit_sha, state (active, conflict, invalidated, deleted), created_at, parents (array of ids), text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days that a category's records last, and types that explain a project.
DAYS = {"project_context": None, "code_note": 30, "analysis_hint": 7}
PROJECT_TYPES = ("project", "workflow", "preference")
NAMESPACE = ("origin", "scope", "project_id", "in_snapshot", "in_commit")


def lifecycles(records: DataFrame) -> DataFrame:
    """``records`` with category, scope, expires_at (null: never), target (digest of type, trimmed lower-case title and sorted files) and the columns of their namespace: snapshot and commit count only for records of a snapshot."""
    category = F.when((F.col("origin") == "user_explicit") & F.col("type").isin(*PROJECT_TYPES), "project_context").when(F.col("origin") == "code_derived", "code_note").otherwise("analysis_hint")
    rows = records.withColumn("category", category)
    scope = F.when((F.col("category") == "project_context") & F.col("project_id").isNotNull(), "project").when(F.col("snapshot_id").isNotNull(), "snapshot").otherwise("local")
    days = F.coalesce(*(F.when(F.col("category") == c, F.lit(d).cast("int")) for c, d in DAYS.items()))
    title = F.lower(F.trim("title"))
    target = F.sha2(F.to_json(F.struct(F.sort_array(F.coalesce("related_files", F.array().cast("array<string>"))).alias("related_files"), title.alias("title"), F.col("type").alias("type"))), 256)
    rows = rows.withColumns({"scope": scope, "expires_at": F.col("created_at") + F.make_dt_interval(days=days), "target": target})
    held = F.col("scope") == "snapshot"
    return rows.withColumns({"in_snapshot": F.when(held, F.col("snapshot_id")), "in_commit": F.when(held, F.col("commit_sha"))})


def scope_rejection(project: Column, snapshot: Column, commit: Column) -> Column:
    """FLT-06: why a record (with its lifecycle) doesn't belong to a scope: unknown_source, project_mismatch or snapshot_mismatch; null if it does. What a user has said of a project goes for all its snapshots."""
    same = lambda column, value: F.col(column).eqNullSafe(value)
    declared = (F.col("scope") == "project") & (F.col("category") == "project_context") & (F.col("origin") == "user_explicit")
    return (
        F.when(F.col("origin").isNull(), "unknown_source")
        .when(~same("project_id", project), "project_mismatch")
        .when(declared, None)
        .when(~same("snapshot_id", snapshot) | ~same("commit_sha", commit), "snapshot_mismatch")
    )


def superseded(rows: DataFrame) -> DataFrame:
    """JOI-28: the ids that a record of their own namespace names as parents, be it expired or not; a record of another origin, scope or project suppresses nothing. The link is looked up by id, the namespaces are compared beside it."""
    named = rows.select(F.explode("parents").alias("id"), *(F.col(c).alias(f"c_{c}") for c in NAMESPACE))
    held = rows.select("id", *NAMESPACE).join(named, "id")
    for c in NAMESPACE:
        held = held.where(F.col(c).eqNullSafe(F.col(f"c_{c}")))
    return held.select("id").distinct()


def eligibility(records: DataFrame, project: Column, snapshot: Column, commit: Column, now: Column, sensitive: Column) -> DataFrame:
    """STR-14: id and reason of every record, by the first that applies: out of scope, superseded, conflict, inactive, expired, sensitive_content, else eligible. Only records of the scope supersede."""
    rows = lifecycles(records).withColumn("rejected", scope_rejection(project, snapshot, commit))
    gone = superseded(rows.where("rejected IS NULL")).withColumn("gone", F.lit(True))
    reason = (
        F.when(F.col("rejected").isNotNull(), F.col("rejected"))
        .when(F.col("gone"), "superseded")
        .when(F.col("state") == "conflict", "conflict")
        .when(F.coalesce(F.col("state") != "active", F.lit(True)), "inactive")
        .when(F.col("expires_at") <= now, "expired")
        .when(sensitive, "sensitive_content")
        .otherwise("eligible")
    )
    return rows.join(gone, "id", "left").select("id", reason.alias("reason"))


def conflicts(records: DataFrame) -> DataFrame:
    """STR-14: id, duplicate_of (the first record of its namespace and target with the same text, if that is another one) and contested (whether heads of that namespace and target, active or in conflict, say different things)."""
    rows = lifecycles(records).withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    key = [*NAMESPACE, "target"]
    first = rows.groupBy(*key, "digest").agg(F.min(F.struct("created_at", "id")).alias("first"))
    heads = rows.join(superseded(rows), "id", "left_anti").where("state IN ('active', 'conflict')")
    texts = heads.groupBy(*key).agg(F.count_distinct("digest").alias("texts"))
    nulls = lambda a, b, on: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in on]
    found = rows.alias("r").join(first.alias("f"), nulls("r", "f", [*key, "digest"])).join(texts.alias("t"), nulls("r", "t", key), "left")
    older = F.when(F.col("f.first.id") != F.col("r.id"), F.col("f.first.id"))
    return found.select("r.id", older.alias("duplicate_of"), F.coalesce(F.col("t.texts") > 1, F.lit(False)).alias("contested"))
