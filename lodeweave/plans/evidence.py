"""Evidence, validation and record queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines
from ..operators import evidence as E
from ..operators.ranges import overlapping
from ..operators.store import shared_path, stored
from ..sources import artifact
from ..sources.text_source import line_chunks
from . import graph as star
from .registry import Tables, query
from .source import _CHUNKS, _LINES


@query("interval_overlap", f"{_CHUNKS}, e AS (SELECT doc_id, 15 AS start_line, 25 AS end_line FROM documents) SELECT c.doc_id, c.start_line AS other_low, c.end_line AS other_high FROM e JOIN c ON c.doc_id = e.doc_id AND c.start_line <= e.end_line AND c.end_line >= e.start_line")
def interval_overlap(t: Tables) -> DataFrame:
    wanted = t.documents.select("doc_id", F.lit(15).alias("start_line"), F.lit(25).alias("end_line"))
    return overlapping(wanted, line_chunks(t.documents.select("doc_id", "text"), "doc_id", 20), "doc_id", "start_line", "end_line").select("doc_id", "other_low", "other_high")


_RANGES = "SELECT event_id, user_id % 5 AS doc_id, (event_id * 7919) % 20000 AS start_line, (event_id * 7919) % 20000 + CASE WHEN event_id % 53 = 0 THEN event_id % 4000 ELSE event_id % 40 END AS end_line FROM events WHERE event_type = '{kind}'"


@query("range_overlaps", f"WITH a AS ({_RANGES.format(kind='click')}), b AS ({_RANGES.format(kind='purchase')}) SELECT a.event_id, b.start_line AS other_low, b.end_line AS other_high FROM a JOIN b ON b.doc_id = a.doc_id AND b.start_line <= a.end_line AND b.end_line >= a.start_line")
def range_overlaps(t: Tables) -> DataFrame:
    """JOI-15: two sets of ranges, some of them long, in a few texts."""
    start, size = F.col("event_id") * 7919 % 20000, F.when(F.col("event_id") % 53 == 0, F.col("event_id") % 4000).otherwise(F.col("event_id") % 40)
    rows = t.events.select("event_type", "event_id", (F.col("user_id") % 5).alias("doc_id"), start.alias("start_line"), (start + size).alias("end_line"))
    of = lambda kind: rows.where(F.col("event_type") == kind).drop("event_type")
    return overlapping(of("click"), of("purchase"), "doc_id", "start_line", "end_line").select("event_id", "other_low", "other_high")


_CITED = "SELECT event_id, user_id AS doc_id, CAST(1 + event_id % 30 AS INTEGER) AS start_line, CAST(1 + event_id % 30 + event_id % 4 AS INTEGER) AS end_line, event_type FROM events"


@query("citation_support", f"""{_CHUNKS}, e AS ({_CITED}), s AS (SELECT e.event_type, e.event_id, count(c.doc_id) > 0 AS ok FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.start_line <= e.start_line AND c.end_line >= e.end_line GROUP BY e.event_type, e.event_id)
    SELECT event_type, count(*) AS citations, count(*) FILTER (ok) AS supported, round(count(*) FILTER (ok) / count(*), 6) AS rate FROM s GROUP BY event_type""")
def citation_support(t: Tables) -> DataFrame:
    """EVL-09: events cite line ranges of documents; chunks are what supports them."""
    first = (1 + F.col("event_id") % 30).cast("int")
    cited = t.events.select("event_type", F.col("user_id").alias("doc_id"), first.alias("start_line"), (first + F.col("event_id") % 4).cast("int").alias("end_line"))
    rows = E.supported(cited, line_chunks(t.documents.select("doc_id", "text"), "doc_id", 20), "doc_id", "start_line", "end_line")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("citations"), F.count_if("ok").alias("supported")).withColumn("rate", F.round(F.col("supported") / F.col("citations"), 6))


@query("numbered_snippets", f"SELECT doc_id, array_to_string(list_transform(l[2:4], lambda x, i: concat(i + 1, ': ', x)), chr(10)) AS snippet FROM (SELECT doc_id, {_LINES} AS l FROM documents)")
def numbered_snippets(t: Tables) -> DataFrame:
    """PRJ-04."""
    some = F.slice(lines("text"), 2, 3)
    return t.documents.select("doc_id", F.array_join(F.transform(some, lambda x, i: F.concat((i + 2).cast("string"), F.lit(": "), x)), "\n").alias("snippet"))


@query("scope_ancestors", f"""WITH RECURSIVE {star.EDGES}, p AS (SELECT target AS node, source AS parent FROM edges WHERE type = 'contains'), a(node, ancestor, steps) AS (
    SELECT node, parent, 1 FROM p UNION ALL SELECT a.node, p.parent, a.steps + 1 FROM a JOIN p ON p.node = a.ancestor WHERE a.steps < 3) SELECT node, ancestor, steps FROM a""")
def scope_ancestors(t: Tables) -> DataFrame:
    held = star.edges(t).where("type = 'contains'").select(F.col("target").alias("node"), F.col("source").alias("parent"))
    return E.ancestors(held, 3)


@query("node_rule_violations", f"{star.BOTH} SELECT id, 'path' AS rule FROM nodes WHERE path IS NULL UNION ALL SELECT id, 'name' FROM nodes WHERE name IS NULL OR length(name) > 12 UNION ALL SELECT id, 'kind' FROM nodes WHERE type NOT IN ('file', 'class', 'function', 'method')")
def node_rule_violations(t: Tables) -> DataFrame:
    rules = {"path": F.col("path").isNotNull(), "name": F.length("name") <= 12, "kind": F.col("type").isin("file", "class", "function", "method")}
    return E.violations(star.nodes(t), "id", rules)


@query("event_rule_violations", """SELECT event_id, 'type' AS rule FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup') UNION ALL SELECT event_id, 'value' FROM events WHERE NOT (value >= 0 AND value < 100) OR value IS NULL
    UNION ALL SELECT event_id, 'payload' FROM events WHERE coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 99) >= 90""")
def event_rule_violations(t: Tables) -> DataFrame:
    rules = {"type": F.col("event_type").isin("view", "click", "purchase", "signup"), "value": (F.col("value") >= 0) & (F.col("value") < 100), "payload": F.get_json_object("props", "$.k").cast("long") < 90}
    return E.violations(t.events, "event_id", rules)


@query("repeated_runs", """WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n FROM r GROUP BY ALL HAVING count(*) > 2""")
def repeated_runs(t: Tables) -> DataFrame:
    return E.runs(t.events, "user_id", ["ts", "event_id"], "event_type").where("n > 2")


@query("retained_events", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 16")
def retained_events(t: Tables) -> DataFrame:
    """STR-04: the last 16 of each run."""
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return t.events.select("user_id", "event_id", last.alias("k")).where("k <= 16").drop("k")


@query("merge_first", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def merge_first(t: Tables) -> DataFrame:
    """SET-08: of rows with one key the first."""
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("ordered_distinct", "WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS first_at FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, '>' ORDER BY first_at) AS path FROM f GROUP BY user_id")
def ordered_distinct(t: Tables) -> DataFrame:
    """AGG-16: types in order of first appearance; aggregated before they are listed, so a list has as many entries as there are types."""
    first = t.events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"]), ">").alias("path"))


@query("before_after", """WITH h AS (SELECT event_type, CASE WHEN event_id % 2 = 0 THEN 'before' ELSE 'after' END AS half, value FROM events)
    SELECT event_type, round(avg(value) FILTER (half = 'before'), 6) AS before, round(avg(value) FILTER (half = 'after'), 6) AS after,
    round(100 * (avg(value) FILTER (half = 'after') / nullif(avg(value) FILTER (half = 'before'), 0) - 1), 4) AS change FROM h GROUP BY event_type""")
def before_after(t: Tables) -> DataFrame:
    """AGG-26."""
    old, new = (F.avg(F.when(F.col("event_id") % 2 == k, F.col("value"))) for k in (0, 1))
    rows = t.events.groupBy("event_type").agg(old.alias("b"), new.alias("a"))
    return rows.select("event_type", F.round("b", 6).alias("before"), F.round("a", 6).alias("after"), F.round(100 * (F.col("a") / F.nullif(F.col("b"), F.lit(0.0)) - 1), 4).alias("change"))


@query("metrics_text", """SELECT concat('events_total{type="', event_type, '"} ', count(*)) AS line FROM events GROUP BY event_type""")
def metrics_text(t: Tables) -> DataFrame:
    """SRC-32."""
    return t.events.groupBy("event_type").count().select(F.format_string('events_total{type="%s"} %d', "event_type", "count").alias("line"))


@query("resume_batches", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_batches(t: Tables) -> DataFrame:
    """SRC-22: what earlier batches haven't done yet."""
    done = t.labels.where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return t.embeddings.select("vec_id").join(done, "vec_id", "left_anti")


@query("manifest_seal", "SELECT label, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id, CAST(sum(vec_id) AS BIGINT) AS id_sum FROM embeddings GROUP BY label")
def manifest_seal(t: Tables) -> DataFrame:
    """SRC-21: per part what a manifest states, from one aggregate."""
    return t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"), F.sum("vec_id").alias("id_sum"))


_LANES = " || '/' || ".join(f"sum(CAST(concat('0x', h[{8 * i + 1}:{8 * i + 8}]) AS BIGINT))" for i in range(8))
_SEALED = f"SELECT label, count(*) AS n, sha256(count(*) || '/' || {_LANES}) AS digest FROM {{rows}} GROUP BY label"
_ROWS = "(SELECT label, sha256(concat('{\"label\":', label, ',\"vec_id\":', vec_id, '}')) AS h FROM embeddings)"


@query("artifact_manifest", _SEALED.format(rows=_ROWS))
def artifact_manifest(t: Tables) -> DataFrame:
    """SRC-21: each label's vectors by number and digest."""
    return artifact.sealed(t.embeddings, "label", ["vec_id", "label"])


@query("artifact_verdicts", "SELECT DISTINCT label, CASE label % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'intact' WHEN 2 THEN 'changed' WHEN 3 THEN 'count' ELSE 'intact' END AS verdict FROM embeddings UNION ALL SELECT -1, 'unknown'")
def artifact_verdicts(t: Tables) -> DataFrame:
    """SRC-21: the table is sealed, then some parts lose all rows, one row, or have one changed; one part is new."""
    rows = t.embeddings.select("vec_id", "label")
    manifest = stored(artifact.sealed(rows, "label", ["vec_id", "label"]), "manifest")
    first = F.min("vec_id").over(Window.partitionBy("label"))
    kind = F.col("label") % 5
    now = rows.withColumn("first", F.col("vec_id") == first).where(~((kind == 0) | ((kind == 3) & F.col("first"))))
    now = now.select(F.when((kind == 2) & F.col("first"), -F.col("vec_id") - 1).otherwise(F.col("vec_id")).alias("vec_id"), "label")
    more = rows.select(F.col("vec_id"), F.lit(-1).cast(rows.schema["label"].dataType).alias("label")).limit(1)
    return artifact.verified(now.unionByName(more), manifest, "label", ["vec_id", "label"])


@query("resumed_batches", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm FROM embeddings")
def resumed_batches(t: Tables) -> DataFrame:
    """SRC-22: norms worked out in eight batches by three calls; the second and third go on where the one before stopped."""
    path = shared_path(t.spark, "batches")
    norm = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 6)
    work = lambda rows: rows.select("vec_id", norm.alias("norm"))
    for most in (3, 2, None):
        found, _ = artifact.resumed(t.embeddings.select("vec_id", "embedding"), "vec_id", path, work, 8, most)
    return found.select("vec_id", "norm")


@query("revision_numbers", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS revision FROM conversations")
def revision_numbers(t: Tables) -> DataFrame:
    """WIN-11."""
    return t.conversations.select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).cast("long").alias("revision"))


@query("capacity_cap", """WITH RECURSIVE m AS (SELECT role, conv_id, turn, CAST(strlen(text) AS INTEGER) AS size, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS n FROM conversations),
    w AS (SELECT *, size <= 20000 AS fits, CASE WHEN size <= 20000 THEN size ELSE 0 END AS used FROM m WHERE n = 1 UNION ALL SELECT m.*, w.used + m.size <= 20000, CASE WHEN w.used + m.size <= 20000 THEN w.used + m.size ELSE w.used END FROM w JOIN m ON m.role = w.role AND m.n = w.n + 1)
    SELECT role, conv_id, turn, size FROM w WHERE fits""")
def capacity_cap(t: Tables) -> DataFrame:
    """Messages of a role that fit 20,000 bytes, in order."""
    rows = t.conversations.select("role", "conv_id", "turn", F.octet_length("text").alias("size"))
    return E.capped(rows, "role", ["conv_id", "turn"], "size", 20_000)
