"""More evaluation queries: lines shown, distinct paths, credited gains, summaries of runs and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines
from ..operators import evaluation as E
from ..operators import public as P
from .evaluation import _GOLD, gold, ranking
from .registry import Tables, query
from .source import _LINES

_ITEMS = f"""k AS (SELECT lang AS query, source AS path, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank, 1 AS low, CAST(least(greatest(len({_LINES}), 1), 30) AS INTEGER) AS high FROM documents QUALIFY rank <= 20)"""
_LINE_GOLD = "g AS (SELECT DISTINCT lang AS query, source AS path, 1 AS low, CAST(5 + toxic * 10 AS INTEGER) AS high FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND lang <> 'es')"


def items(t: Tables) -> DataFrame:
    """The 20 longest documents of each language; an item shows up to 30 of its source's lines. Only they are cut into lines."""
    rows = ranking(t).join(t.documents.select("doc_id", "text"), "doc_id")
    return rows.select("query", "rank", "path", F.lit(1).alias("low"), F.least(F.greatest(F.size(lines("text")), F.lit(1)), F.lit(30)).alias("high"))


def line_gold(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "source").join(t.labels.where("quality = 0"), "doc_id").where("lang <> 'es'")
    return rows.select(F.col("lang").alias("query"), F.col("source").alias("path"), F.lit(1).alias("low"), (5 + F.col("toxic") * 10).cast("int").alias("high")).distinct()


@query("eval_line_coverage", f"""WITH {_ITEMS}, {_LINE_GOLD}, s AS (SELECT query, path, unnest(range(low, high + 1)) AS line FROM k WHERE rank <= 6), r AS (SELECT query, path, line, count(*) AS n FROM s GROUP BY ALL),
    t AS (SELECT query, sum(n) AS total, count(*) AS different FROM r GROUP BY query), e AS (SELECT query, path, high, unnest(range(low, high + 1)) AS line FROM g), j AS (SELECT e.*, r.n IS NOT NULL AS shown FROM e LEFT JOIN r USING (query, path, line)),
    l AS (SELECT query, count(*) AS expected, count(*) FILTER (shown) AS covered FROM (SELECT DISTINCT query, path, line, shown FROM j) GROUP BY query), w AS (SELECT query, count(*) AS symbols, count(*) FILTER (whole) AS whole FROM (SELECT query, path, high, bool_and(shown) AS whole FROM j GROUP BY ALL) GROUP BY query)
    SELECT q.query, round(covered / expected, 6) AS line_coverage, round(whole / symbols, 6) AS symbol_recall, round(coalesce((total - different) / total, 0), 6) AS duplicate_line_rate FROM (SELECT DISTINCT query FROM k) q LEFT JOIN t USING (query) LEFT JOIN l USING (query) LEFT JOIN w USING (query)""")
def eval_line_coverage(t: Tables) -> DataFrame:
    return E.line_metrics(items(t), line_gold(t), 6)


@query("eval_distinct_paths", f"""WITH {_ITEMS}, {_GOLD}, f AS (SELECT query, path, min(rank) AS rank FROM k GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, path) AS place FROM f QUALIFY place <= 4),
    h AS (SELECT query, count(*) AS hits, min(place) AS best FROM p JOIN g USING (query, path) GROUP BY query), r AS (SELECT query, count(*) AS relevant FROM g GROUP BY query)
    SELECT q.query, CASE WHEN relevant IS NOT NULL THEN round(coalesce(hits / relevant, 0), 6) END AS recall, CASE WHEN relevant IS NOT NULL THEN round(coalesce(1 / best, 0), 6) END AS reciprocal_rank FROM (SELECT DISTINCT query FROM k) q LEFT JOIN r USING (query) LEFT JOIN h USING (query)""")
def eval_distinct_paths(t: Tables) -> DataFrame:
    return E.distinct_path_metrics(ranking(t).select("query", "rank", "path"), gold(t), 4)


@query("eval_macro_mean", f"""WITH {_ITEMS}, {_GOLD}, h AS (SELECT k.query, min(k.rank) AS best FROM k JOIN g USING (query, path) GROUP BY k.query), q AS (SELECT DISTINCT query FROM k), r AS (SELECT q.query, CASE WHEN q.query IN (SELECT query FROM g) THEN coalesce(1 / h.best, 0) END AS rr FROM q LEFT JOIN h USING (query))
    SELECT count(*) AS queries, count(rr) AS measured, round(avg(rr), 6) AS mean FROM r""")
def eval_macro_mean(t: Tables) -> DataFrame:
    """AGG-20: queries without gold have no metric and don't count; without any there is no mean."""
    rows = E.ranking_metrics(ranking(t).select("query", "rank", "path"), gold(t), [20])
    return rows.agg(F.count(F.lit(1)).alias("queries"), F.count("reciprocal_rank").alias("measured"), F.round(F.avg("reciprocal_rank"), 6).alias("mean"))


@query("eval_micro_evidence", f"""WITH {_ITEMS}, {_LINE_GOLD}, s AS (SELECT 'candidate' AS stage, * FROM k UNION ALL SELECT 'selected', * FROM k WHERE rank <= 6),
    u AS (SELECT stage, g.query, g.path, g.high, bool_or(s.path IS NOT NULL) AS in_file, bool_or(s.high >= g.high) AS in_lines FROM g CROSS JOIN (VALUES ('candidate'), ('selected')) AS x(stage) LEFT JOIN s USING (stage, query, path) GROUP BY ALL)
    SELECT stage, count(*) AS denominator, count(*) FILTER (in_file) AS files, count(*) FILTER (in_lines) AS units, round(count(*) FILTER (in_file) / nullif(count(*), 0), 6) AS file_ratio, round(count(*) FILTER (in_lines) / nullif(count(*), 0), 6) AS unit_ratio FROM u GROUP BY stage""")
def eval_micro_evidence(t: Tables) -> DataFrame:
    """EVL-07: gold ranges by stage whose file, and whose every line, an item shows: sums over all queries, not means of ratios."""
    shown, wanted = items(t), line_gold(t).withColumnRenamed("high", "g_high")
    best = F.max(F.col("high"))
    stages = [shown.where(F.col("rank") <= k).groupBy("query", "path").agg(best.alias("high")).withColumn("stage", F.lit(stage)) for stage, k in (("candidate", 20), ("selected", 6))]
    every = wanted.select("query", "path", "g_high", F.explode(F.array(F.lit("candidate"), F.lit("selected"))).alias("stage"))
    rows = every.join(stages[0].unionByName(stages[1]), ["stage", "query", "path"], "left")
    out = rows.groupBy("stage").agg(F.count(F.lit(1)).alias("denominator"), F.count_if(F.col("high").isNotNull()).alias("files"), F.count_if(F.col("high") >= F.col("g_high")).alias("units"))
    return out.withColumns({"file_ratio": F.round(F.col("files") / F.nullif(F.col("denominator"), F.lit(0)), 6), "unit_ratio": F.round(F.col("units") / F.nullif(F.col("denominator"), F.lit(0)), 6)})


@query("eval_credited_gains", f"""WITH RECURSIVE {_ITEMS}, {_LINE_GOLD}, o AS (SELECT query, list({{'place': place, 'path': path, 'high': high}} ORDER BY place) AS gold FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY path, high) AS INTEGER) AS place FROM g) GROUP BY query),
    q AS (SELECT DISTINCT k.query, coalesce(o.gold, []) AS gold FROM k LEFT JOIN o USING (query)), w(query, rank, credited, gain) AS (SELECT query, 0, CAST([] AS INTEGER[]), false FROM q
        UNION ALL SELECT query, rank, CASE WHEN hit IS NULL THEN credited ELSE list_append(credited, hit) END, hit IS NOT NULL FROM (
            SELECT w.query, k.rank, w.credited, list_min(list_transform(list_filter(q.gold, lambda x: x.path = k.path AND x.high <= k.high AND NOT list_contains(w.credited, x.place)), lambda x: x.place)) AS hit FROM w JOIN k ON k.query = w.query AND k.rank = w.rank + 1 JOIN q ON q.query = w.query))
    SELECT query, rank, gain FROM w WHERE rank > 0""")
def eval_credited_gains(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy("path", "high"))
    return E.credited_gains(items(t), line_gold(t).withColumn("place", place), 20)


@query("eval_provenance", """WITH s AS (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem), r AS (SELECT CASE l_returnflag WHEN 'N' THEN 'static' WHEN 'R' THEN 'unknown' ELSE 'ambiguous' END AS expected, CASE WHEN l_linestatus = 'O' THEN 'static' WHEN l_linenumber > 3 THEN 'unknown' ELSE 'ambiguous' END AS shown FROM s)
    SELECT expected, count(*) AS steps, count(*) FILTER (shown = expected) AS disclosed, count(*) FILTER (shown <> expected) AS conflicting, round(count(*) FILTER (shown = expected) / count(*), 6) AS rate FROM r GROUP BY expected""")
def eval_provenance(t: Tables) -> DataFrame:
    """EVL-10: whether the line written for a relation states the resolution that the graph holds for it; every order's calls."""
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus").distinct()
    expected = F.when(F.col("l_returnflag") == "N", "static").when(F.col("l_returnflag") == "R", "unknown").otherwise("ambiguous")
    written = F.when(F.col("l_linestatus") == "O", "static").when(F.col("l_linenumber") > 3, "unknown").otherwise("ambiguous")
    line = P.relation_line(F.col("l_orderkey").cast("string"), F.lit("calls"), F.col("l_partkey").cast("string"), written, F.lit("call_site"), F.lit(None).cast("string"), F.lit(None), F.lit(None))
    told = rows.select(expected.alias("expected"), F.regexp_extract(line, r"resolution=(\w+)", 1).alias("shown"))
    out = told.groupBy("expected").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("shown") == F.col("expected")).alias("disclosed"), F.count_if(F.col("shown") != F.col("expected")).alias("conflicting"))
    return out.withColumn("rate", F.round(F.col("disclosed") / F.col("steps"), 6))


@query("resolution_distribution", """SELECT l_returnflag AS resolution, count(*) AS sites, count(*) FILTER (l_linestatus = 'F') AS definite, count(*) FILTER (l_linestatus = 'F' AND l_discount > 0.05) AS wrong, round(count(*) FILTER (l_linestatus = 'F' AND l_discount > 0.05) / nullif(count(*) FILTER (l_linestatus = 'F'), 0), 6) AS misbinding_rate,
    round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY l_returnflag""")
def resolution_distribution(t: Tables) -> DataFrame:
    """AGG-22: sites by resolution, and how many of the definite ones are wrong."""
    definite, wrong = F.col("l_linestatus") == "F", F.col("l_discount") > 0.05
    rows = t.lineitem.groupBy(F.col("l_returnflag").alias("resolution")).agg(F.count(F.lit(1)).alias("sites"), F.count_if(definite).alias("definite"), F.count_if(definite & wrong).alias("wrong"))
    total = rows.agg(F.sum("sites").alias("total"))
    return rows.join(total, F.lit(True)).select("resolution", "sites", "definite", "wrong", F.round(F.col("wrong") / F.nullif(F.col("definite"), F.lit(0)), 6).alias("misbinding_rate"), F.round(F.col("sites") / F.col("total"), 6).alias("share"))


@query("harness_summary", """WITH o AS (SELECT user_id, event_type, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed, CASE WHEN event_type = 'error' AND lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'error' THEN 1 ELSE 0 END AS repeated FROM events),
    r AS (SELECT user_id, CASE WHEN sum(failed) = 0 THEN 'complete' WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'partial' ELSE 'failed' END AS outcome, sum(failed) AS failures, sum(repeated) AS repeats, count(*) AS calls FROM o GROUP BY user_id)
    SELECT count(*) AS samples, round(count(*) FILTER (outcome = 'complete') / count(*), 6) AS completion_rate, round(count(*) FILTER (outcome = 'partial') / count(*), 6) AS partial_rate, round(count(*) FILTER (outcome = 'failed') / count(*), 6) AS failure_rate, CAST(sum(calls) AS BIGINT) AS calls,
        round(coalesce(sum(repeats) / nullif(sum(failures), 0), 0), 6) AS repeated_failure_rate FROM r""")
def harness_summary(t: Tables) -> DataFrame:
    """AGG-23: users' events as runs: rates of outcomes, and of failures that follow a failure."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    failed = F.col("event_type") == "error"
    runs = t.events.withColumn("again", failed & (before == "error")).groupBy("user_id").agg(F.count_if(failed).alias("failures"), F.count_if("again").alias("repeats"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count(F.lit(1)).alias("calls"))
    runs = runs.withColumn("outcome", F.when(F.col("failures") == 0, "complete").when(F.col("clicks") > 0, "partial").otherwise("failed"))
    rate = lambda name: F.round(F.count_if(F.col("outcome") == name) / F.count(F.lit(1)), 6)
    return runs.agg(F.count(F.lit(1)).alias("samples"), rate("complete").alias("completion_rate"), rate("partial").alias("partial_rate"), rate("failed").alias("failure_rate"), F.sum("calls").alias("calls"), F.round(F.coalesce(F.sum("repeats") / F.nullif(F.sum("failures"), F.lit(0)), F.lit(0.0)), 6).alias("repeated_failure_rate"))


@query("answer_summary", """WITH a AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS answers, count(*) FILTER (role = 'user') AS questions, CAST(coalesce(sum(strlen(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS bytes, max(strlen(text)) AS peak, avg(length(text)) FILTER (role = 'system') AS coverage FROM conversations GROUP BY conv_id)
    SELECT count(*) AS samples, round(count(*) FILTER (answers >= questions) / count(*), 6) AS completion_rate, CAST(sum(answers) AS BIGINT) AS answers, CAST(sum(bytes) AS BIGINT) AS output_utf8_bytes, max(peak) AS peak_bytes, round(avg(coverage), 4) AS mean_coverage, count(*) FILTER (coverage IS NULL) AS unknown FROM a""")
def answer_summary(t: Tables) -> DataFrame:
    """AGG-24: conversations as answers; samples without the figure leave its mean alone and count as unknown."""
    size, role = F.octet_length("text"), F.col("role")
    each = t.conversations.groupBy("conv_id").agg(F.count_if(role == "assistant").alias("answers"), F.count_if(role == "user").alias("questions"), F.coalesce(F.sum(F.when(role == "assistant", size)), F.lit(0)).alias("bytes"), F.max(size).cast("long").alias("peak"), F.avg(F.when(role == "system", F.length("text"))).alias("coverage"))
    return each.agg(F.count(F.lit(1)).alias("samples"), F.round(F.count_if(F.col("answers") >= F.col("questions")) / F.count(F.lit(1)), 6).alias("completion_rate"), F.sum("answers").alias("answers"), F.sum("bytes").alias("output_utf8_bytes"), F.max("peak").alias("peak_bytes"), F.round(F.avg("coverage"), 4).alias("mean_coverage"), F.count_if(F.col("coverage").isNull()).alias("unknown"))
