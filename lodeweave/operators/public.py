"""What of traces, reports and graphs may be shown: allow-lists, caps and redaction as column expressions. A row that breaks a rule is null, never shown in part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Closed domains and bounds that a public record must keep to.
OUTCOMES = ("complete", "partial", "failed")
BUDGET_BOUNDS = {"max_turns": (1, 128), "max_tool_calls": (0, 256), "max_model_calls": (0, 256), "context_tokens": (4096, 1048576), "tool_output_chars": (256, 1048576)}
SECRET_KEYS = ("api_key", "apikey", "authorization", "cookie", "password", "secret", "token")
SECTIONS = ("identity", "policy", "project", "memory", "evidence", "trace", "response_contract")


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that don't hold, in order; one that can't be decided doesn't hold."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def bounded(bounds: dict[str, tuple[int, int]]) -> dict[str, Column]:
    """A rule for each column that has a least and a largest value."""
    return {name: F.col(name).between(low, high) for name, (low, high) in bounds.items()}


def shown(rows: DataFrame, rules: dict[str, Column], names: list[str]) -> DataFrame:
    """The rows with ``accepted``, and null in the named columns where it is false."""
    accepted = F.size(broken(rules)) == 0
    return rows.withColumn("accepted", accepted).withColumns({n: F.when(F.col("accepted"), F.col(n)) for n in names})


def execution_rules() -> dict[str, Column]:
    """PRJ-10: counts of one run (tool_calls, completed_tools, failed_tools, empty_tools, retried_tools, handler_attempts, required_failed, outcome) are each in bounds and agree."""
    counts = ("tool_calls", "handler_attempts", "retried_tools", "completed_tools", "failed_tools", "empty_tools", "required_failed")
    return bounded({c: (0, 512) for c in counts}) | {
        "outcome": F.col("outcome").isin(*OUTCOMES),
        "sum": F.col("completed_tools") + F.col("failed_tools") + F.col("empty_tools") == F.col("tool_calls"),
        "retries": F.col("retried_tools") <= F.col("tool_calls"),
        "attempts": F.col("handler_attempts") <= 2 * F.col("tool_calls"),
        "required": F.col("required_failed") <= F.col("failed_tools") + F.col("empty_tools"),
    }


def graph_summary_rules(allowed: tuple[str, ...]) -> dict[str, Column]:
    """PRJ-09: a graph's version (1 to 4), capabilities (eight at most, all known) and counts of sites."""
    return {
        "version": F.col("version").between(1, 4),
        "capabilities": (F.size("capabilities") <= 8) & F.forall("capabilities", lambda c: c.isin(*allowed)),
        "counts": (F.col("unknown") >= 0) & (F.col("ambiguous") >= 0) & (F.col("unknown") + F.col("ambiguous") <= F.col("call_sites")),
    }


def first_sites(sites: DataFrame, caller: str, order: list[str], candidates: str, limit: int, shown_candidates: int = 8) -> DataFrame:
    """PRJ-02: of each caller its first ``limit`` sites in stored order, their candidates cut to eight with how many are left out."""
    place = F.row_number().over(Window.partitionBy(caller).orderBy(*order))
    rows = sites.withColumn("place", place).where(F.col("place") <= limit)
    return rows.withColumn("omitted", F.greatest(F.size(candidates) - shown_candidates, F.lit(0))).withColumn(candidates, F.slice(candidates, 1, shown_candidates))


def summarised(keys: Column, values: Column, most: int = 8, chars: int = 200) -> Column:
    """PRJ-13: the first ``most`` pairs of a mapping, given as arrays, as (k, v): secret keys redacted, long values cut, and a last pair that tells how many are left out."""
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    secret = lambda k: F.translate(F.lower(k), "-", "_").isin(*SECRET_KEYS)
    cut = lambda v: F.when(F.length(v) > chars, F.concat(F.substring(v, 1, chars), F.lit("...[truncated]"))).otherwise(v)
    few = F.transform(F.slice(pairs, 1, most), lambda p: F.struct(p["k"].alias("k"), F.when(secret(p["k"]), "[REDACTED]").otherwise(cut(p["v"])).alias("v")))
    rest = F.struct(F.lit("...").alias("k"), F.format_string("%d more keys", F.size(pairs) - most).alias("v"))
    return F.when(F.size(pairs) > most, F.concat(few, F.array(rest))).otherwise(few)


def section_names(values: Column, public: dict[str, str], order: tuple[str, ...] = SECTIONS) -> Column:
    """PRJ-14: the public names of internal sections, unknown ones left out, each once, in a fixed order."""
    known = F.create_map(*(F.lit(x) for pair in public.items() for x in pair))
    mapped = F.transform(values, lambda v: known[v])
    return F.filter(F.array(*(F.lit(s) for s in order)), lambda s: F.array_contains(mapped, s))


def policy(read_only: Column, internal: Column, inside: Column, tests_allowed: Column) -> Column:
    """FLT-08: whether a tool may run: reading always, internal writes inside the project, all else only where tests are allowed."""
    return F.when(read_only, "allowed").when(internal, F.when(inside, "allowed").otherwise("denied")).when(tests_allowed, "allowed").otherwise("denied")


def target_verdict(path: Column) -> Column:
    """FLT-09: what is wrong with a target path, by the first rule that applies: rooted or with a drive (invalid_path), leaving the project (path_forbidden), not Python (invalid_path); else ok."""
    plain = F.translate(path, "\\", "/")
    rooted = plain.startswith("/") | plain.rlike("^[A-Za-z]:") | path.contains("\x00")
    steps = F.transform(F.split(plain, "/"), lambda p: F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1))
    least = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.least(s["low"], s["at"] + x).alias("low")), lambda s: s["low"])
    return F.when(rooted, "invalid_path").when(least < 0, "path_forbidden").when(~F.lower(plain).endswith(".py"), "invalid_path").otherwise("ok")


def relation_line(source: Column, relation: Column, target: Column, resolution: Column, basis: Column, path: Column, low: Column, high: Column) -> Column:
    """PRJ-07: one relation of an evidence text, with what is known of it and never more."""
    known = F.when(resolution.isin("static", "declaration", "unknown", "ambiguous", "legacy"), resolution).otherwise("unavailable")
    place = F.when(path.isNotNull() & low.isNotNull() & high.isNotNull(), F.concat(F.lit("graph_site_path="), path, F.lit("; graph_site_lines="), low.cast("string"), F.lit("-"), high.cast("string"))).otherwise("graph_site=unavailable")
    return F.concat(F.lit("- "), source, F.lit(" --"), relation, F.lit("--> "), target, F.lit(" [resolution="), known, F.lit("; basis="), F.coalesce(basis, F.lit("unavailable")), F.lit("; "), place, F.lit("; runtime=unverified]"))
