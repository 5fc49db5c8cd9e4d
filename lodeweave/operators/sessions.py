"""Sessions of a run: internal events become public ones, numbered through, and the last one says whether the trace is complete.

Internal events have the columns of ``SCHEMA``. ``position`` numbers a run's events as its producer wrote them, from 0; ``ok`` is what the event's kind makes of
it: a context has its section lists, a failed run a result. Of kinds that aren't known nothing comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "run long, position long, ts timestamp, kind string, purpose string, turn long, tool string, ok boolean"
#: An internal kind's public name.
PUBLIC = {
    "run_started": "run_started", "plan": "plan_created", "context": "context_updated", "llm_started": "llm_started", "llm_finished": "llm_finished",
    "tool_started": "tool_started", "tool_finished": "tool_finished", "completed": "run_completed", "failed": "run_failed",
}
TERMINAL = ("completed", "failed")
ONCE = ("run_started", "plan")
#: An event of these counts towards completeness even if it isn't accepted.
KEY = (*PUBLIC, "expected")


def _named(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in PUBLIC.items()))


def sessions(events: DataFrame) -> DataFrame:
    """STR-01 and STR-02: run, sequence, kind (public), position, ts, and for a run's last event trace_complete and duration_ms.

    A run's events are taken by position up to the first completed or failed one. Accepted events are numbered from 0: of run starts and plans the first, contexts
    with their sections, tool finishes whose start is open, and no event without a time. The trace is complete if the run has started and nothing was rejected (a second plan
    may come), nothing came after the end, each finished call had an open start, no call stays open, each purpose has as many starts and finishes as
    expected, and a failed run has a result. Each window is over a run, or over the calls of a run; one run is one task's.
    """
    run = Window.partitionBy("run").orderBy("position")
    whole = Window.partitionBy("run")
    is_end = F.col("kind").isin(*TERMINAL) & F.col("ts").isNotNull()
    rows = events.withColumn("end", F.min(F.when(is_end, F.col("position"))).over(whole))
    inside = F.col("end").isNull() | (F.col("position") <= F.col("end"))
    rows = rows.withColumns({"inside": inside, "counted": inside & F.col("ts").isNotNull()})
    nth = F.sum(F.when(F.col("counted"), 1).otherwise(0)).over(Window.partitionBy("run", "kind").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("nth", nth)

    def low(rows: DataFrame, name: str, start: str, finish: str, *by: str) -> DataFrame:
        """``name``: a finish that found no open start; ``name``_open: what is open at the end of its run and ``by``."""
        step = F.when(~F.col("counted"), 0).when(F.col("kind") == start, 1).when(F.col("kind") == finish, -1).otherwise(0)
        own = Window.partitionBy("run", *by).orderBy("position")
        rows = rows.withColumn("total", F.sum(step).over(own.rowsBetween(Window.unboundedPreceding, 0)))
        before = F.least(F.lit(0), F.coalesce(F.min("total").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        rows = rows.withColumns({name: F.col("counted") & (F.col("kind") == finish) & (F.col("total") < before), "lowest": F.least(F.lit(0), F.min("total").over(Window.partitionBy("run", *by)))})
        last = F.col("total") - F.col("lowest")
        return rows.withColumn(f"{name}_open", F.when(F.col("position") == F.max("position").over(Window.partitionBy("run", *by)), last).otherwise(0)).drop("total", "lowest")

    rows = low(rows, "llm_lost", "llm_started", "llm_finished", "purpose", "turn")
    rows = low(rows, "tool_lost", "tool_started", "tool_finished", "turn", "tool")
    again = F.col("kind").isin(*ONCE) & (F.col("nth") > 1)
    bad = (F.col("kind") == "context") & ~F.coalesce("ok", F.lit(False))
    known = _named(F.col("kind"))
    rows = rows.withColumns({"public": known, "accepted": F.col("counted") & known.isNotNull() & ~again & ~bad & ~F.col("tool_lost")})
    key = F.col("kind").isin(*KEY)
    lost = (F.col("inside") & key & F.col("ts").isNull()) | (~F.col("inside") & key) | (F.col("counted") & (bad | F.col("llm_lost") | F.col("tool_lost") | ((F.col("kind") == "run_started") & again)))
    lost = lost | ((F.col("kind") == "failed") & F.col("accepted") & ~F.coalesce("ok", F.lit(False)))
    of = lambda kind: F.count_if((F.col("kind") == kind) & F.col("counted")).over(Window.partitionBy("run", "purpose"))
    short = (F.col("kind") == "expected") & F.col("counted") & (F.least(of("llm_started"), of("llm_finished")) < of("expected"))
    rows = rows.withColumns({"lost": F.coalesce(lost, F.lit(False)) | F.coalesce(short, F.lit(False)) | (F.col("llm_lost_open") > 0)})
    rows = rows.withColumns({
        "sequence": F.sum(F.col("accepted").cast("long")).over(run.rowsBetween(Window.unboundedPreceding, 0)) - 1,
        "started_at": F.min(F.when((F.col("public") == "run_started") & F.col("accepted"), F.col("ts"))).over(whole),
        "degraded": F.max("lost").over(whole),
    })
    final = F.col("kind").isin(*TERMINAL)
    duration = F.round(F.greatest(F.lit(0.0), (F.unix_micros("ts") - F.unix_micros("started_at")) / 1000), 3)
    return rows.where("accepted").select("run", "sequence", F.col("public").alias("kind"), "position", "ts", F.when(final, ~F.col("degraded") & F.col("started_at").isNotNull()).alias("trace_complete"), F.when(final & F.col("started_at").isNotNull(), duration).alias("duration_ms"))
