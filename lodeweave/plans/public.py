"""Public projections: orders' lines as call sites, users' events as runs, conversations as contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines
from ..operators import public as P
from . import graph as star
from .registry import Tables, query
from .source import _LINES


@query("public_execution", """WITH r AS (SELECT user_id, count(*) FILTER (event_type <> 'purchase') AS tool_calls, count(*) FILTER (event_type IN ('view', 'signup')) AS completed_tools, count(*) FILTER (event_type = 'error') AS failed_tools,
        count(*) FILTER (event_type = 'click') AS empty_tools, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY user_id),
    a AS (SELECT *, tool_calls <= 512 AND p <= tool_calls AND tool_calls + p <= least(512, 2 * tool_calls) AND p <= failed_tools + empty_tools AS accepted FROM r)
    SELECT user_id, CASE WHEN accepted THEN tool_calls END AS tool_calls, CASE WHEN accepted THEN completed_tools END AS completed_tools, CASE WHEN accepted THEN failed_tools END AS failed_tools, accepted FROM a""")
def public_execution(t: Tables) -> DataFrame:
    """PRJ-10: a user's events as one run's tool calls; purchases are retries and required failures."""
    of = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    rows = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") != "purchase").alias("tool_calls"), of("view", "signup").alias("completed_tools"), of("error").alias("failed_tools"), of("click").alias("empty_tools"), of("purchase").alias("retried_tools"))
    rows = rows.withColumns({"handler_attempts": F.col("tool_calls") + F.col("retried_tools"), "required_failed": F.col("retried_tools"), "outcome": F.when(F.col("failed_tools") == 0, "complete").when(F.col("completed_tools") > 0, "partial").otherwise("failed")})
    names = ["tool_calls", "completed_tools", "failed_tools"]
    return P.shown(rows, P.execution_rules(), names).select("user_id", *names, "accepted")


_BUDGETS = """b AS (SELECT c_custkey, c_nationkey * 8 AS max_turns, c_custkey AS max_tool_calls, c_nationkey AS max_model_calls, CAST(floor(c_acctbal * 4) AS BIGINT) AS context_tokens, 256 + c_custkey AS tool_output_chars FROM customer)"""


@query("public_budget", f"""WITH {_BUDGETS} SELECT c_custkey, array_to_string(list_filter([CASE WHEN NOT max_turns BETWEEN 1 AND 128 THEN 'max_turns' END, CASE WHEN NOT max_tool_calls BETWEEN 0 AND 256 THEN 'max_tool_calls' END,
    CASE WHEN NOT max_model_calls BETWEEN 0 AND 256 THEN 'max_model_calls' END, CASE WHEN NOT context_tokens BETWEEN 4096 AND 1048576 THEN 'context_tokens' END, CASE WHEN NOT tool_output_chars BETWEEN 256 AND 1048576 THEN 'tool_output_chars' END], lambda x: x IS NOT NULL), ',') AS broken FROM b""")
def public_budget(t: Tables) -> DataFrame:
    """PRJ-10: a customer's figures as the limits of a budget; which bounds they break."""
    rows = t.customer.select("c_custkey", (F.col("c_nationkey") * 8).alias("max_turns"), F.col("c_custkey").alias("max_tool_calls"), F.col("c_nationkey").alias("max_model_calls"), F.floor(F.col("c_acctbal") * 4).alias("context_tokens"), (256 + F.col("c_custkey")).alias("tool_output_chars"))
    return rows.select("c_custkey", F.array_join(P.broken(P.bounded(P.BUDGET_BOUNDS)), ",").alias("broken"))


@query("public_graph_summary", """WITH s AS (SELECT l_orderkey, min(l_linenumber) AS version, list_sort(list(DISTINCT l_returnflag)) AS capabilities, count(*) AS call_sites, count(*) FILTER (l_linestatus = 'O') AS unknown, count(*) FILTER (l_discount > 0.05) AS ambiguous FROM lineitem GROUP BY l_orderkey),
    a AS (SELECT *, version BETWEEN 1 AND 4 AND len(list_filter(capabilities, lambda c: c NOT IN ('A', 'N'))) = 0 AND unknown + ambiguous <= call_sites AS accepted FROM s)
    SELECT l_orderkey, accepted, CASE WHEN accepted THEN CAST(version AS INTEGER) END AS version, CASE WHEN accepted THEN call_sites END AS call_sites, CASE WHEN accepted THEN unknown END AS unknown, CASE WHEN accepted THEN ambiguous END AS ambiguous FROM a""")
def public_graph_summary(t: Tables) -> DataFrame:
    """PRJ-09: an order's lines as its graph's sites."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("version"), F.array_sort(F.collect_set("l_returnflag")).alias("capabilities"), F.count(F.lit(1)).alias("call_sites"), F.count_if(F.col("l_linestatus") == "O").alias("unknown"), F.count_if(F.col("l_discount") > 0.05).alias("ambiguous"))
    names = ["version", "call_sites", "unknown", "ambiguous"]
    return P.shown(rows, P.graph_summary_rules(("A", "N")), names).select("l_orderkey", "accepted", *names)


@query("public_call_sites", """WITH c AS (SELECT l_partkey, list_sort(list(DISTINCT l_suppkey)) AS candidates FROM lineitem GROUP BY l_partkey),
    s AS (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem), p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS place FROM s)
    SELECT l_orderkey, CAST(place AS INTEGER) AS place, p.l_partkey, array_to_string(candidates[1:8], ',') AS candidates, CAST(greatest(len(candidates) - 8, 0) AS INTEGER) AS omitted FROM p JOIN c ON c.l_partkey = p.l_partkey WHERE place <= 3""")
def public_call_sites(t: Tables) -> DataFrame:
    """PRJ-02: the first three sites of every order, with the suppliers that the called part may mean. Sites are cut before they meet the candidates."""
    candidates = t.lineitem.select("l_partkey", "l_suppkey").distinct().groupBy("l_partkey").agg(F.array_sort(F.collect_list("l_suppkey")).alias("candidates"))
    sites = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber").distinct().withColumn("none", F.array().cast("array<long>"))
    first = P.first_sites(sites, "l_orderkey", ["l_linenumber", "l_partkey"], "none", 3).select("l_orderkey", "place", "l_partkey")
    cut = candidates.select("l_partkey", F.slice("candidates", 1, 8).alias("few"), F.greatest(F.size("candidates") - 8, F.lit(0)).alias("omitted"))
    return first.join(cut, "l_partkey").select("l_orderkey", "place", "l_partkey", F.array_join(F.transform("few", lambda x: x.cast("string")), ",").alias("candidates"), "omitted")


@query("node_projection", f"{star.BOTH} SELECT id, type, name, path, CASE WHEN type IN ('function', 'method', 'class') THEN concat('symbol_key=', name, ';parent=', coalesce(path, '')) END AS details FROM nodes")
def node_projection(t: Tables) -> DataFrame:
    """PRJ-01: the base columns of every node, and details only for kinds that have them."""
    details = F.when(F.col("type").isin("function", "method", "class"), F.concat(F.lit("symbol_key="), "name", F.lit(";parent="), F.coalesce("path", F.lit(""))))
    return star.nodes(t).select("id", "type", "name", "path", details.alias("details"))


@query("graph_info", f"{star.BOTH} SELECT 4 AS schema_version, (SELECT array_to_string(list_sort(list(DISTINCT type)), ',') FROM edges) AS capabilities, (SELECT count(*) FROM nodes WHERE path IS NULL) AS nodes_without_path, CASE WHEN EXISTS (SELECT 1 FROM nodes WHERE path IS NULL) THEN 'paths_missing' ELSE '' END AS warnings")
def graph_info(t: Tables) -> DataFrame:
    """PRJ-03: one row on the graph: version, capabilities, warnings."""
    kinds = star.edges(t).agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("capabilities"))
    missing = star.nodes(t).agg(F.count_if(F.col("path").isNull()).alias("nodes_without_path"))
    return kinds.join(missing, F.lit(True)).select(F.lit(4).alias("schema_version"), "capabilities", "nodes_without_path", F.when(F.col("nodes_without_path") > 0, "paths_missing").otherwise("").alias("warnings"))


@query("index_summary", f"{star.BOTH} SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def index_summary(t: Tables) -> DataFrame:
    """AGG-02."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(t.documents, "files").join(count(star.nodes(t), "nodes"), F.lit(True)).join(count(star.edges(t), "edges"), F.lit(True))


_KEYS = "['role', 'text', 'turn', 'conversation', 'api_key', 'length', 'digest', 'kind', 'upper', 'lower']"


@query("mapping_summary", f"""WITH m AS (SELECT conv_id, turn, {_KEYS} AS k, [role, text, CAST(turn AS VARCHAR), CAST(conv_id AS VARCHAR), md5(text), CAST(length(text) AS VARCHAR), md5(role), 'message', upper(role), lower(role)] AS v FROM conversations),
    x AS (SELECT conv_id, turn, unnest(k[1:8]) AS k, unnest(v[1:8]) AS v FROM m)
    SELECT conv_id, turn, k, CASE WHEN k = 'api_key' THEN '[REDACTED]' WHEN length(v) > 200 THEN concat(v[1:200], '...[truncated]') ELSE v END AS v FROM x UNION ALL SELECT conv_id, turn, '...', '2 more keys' FROM m""")
def mapping_summary(t: Tables) -> DataFrame:
    """PRJ-13: a message as a mapping of ten keys."""
    text = lambda c: F.col(c).cast("string")
    keys = F.array(*(F.lit(k) for k in ("role", "text", "turn", "conversation", "api_key", "length", "digest", "kind", "upper", "lower")))
    values = F.array(F.col("role"), F.col("text"), text("turn"), text("conv_id"), F.md5("text"), F.length("text").cast("string"), F.md5("role"), F.lit("message"), F.upper("role"), F.lower("role"))
    return t.conversations.select("conv_id", "turn", F.explode(P.summarised(keys, values)).alias("p")).select("conv_id", "turn", "p.k", "p.v")


@query("context_sections", """WITH s AS (SELECT conv_id, list(DISTINCT role) AS r FROM conversations GROUP BY conv_id)
    SELECT conv_id, array_to_string(list_filter(['identity', 'policy', 'project', 'memory', 'evidence', 'trace', 'response_contract'], lambda x: (x = 'identity' AND list_contains(r, 'system')) OR (x = 'project' AND list_contains(r, 'user')) OR (x = 'trace' AND list_contains(r, 'assistant'))), ',') AS sections FROM s""")
def context_sections(t: Tables) -> DataFrame:
    """PRJ-14: a conversation's roles under their public names, in the fixed order."""
    roles = t.conversations.groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    names = P.section_names(F.col("r"), {"system": "identity", "user": "project", "assistant": "trace"})
    return roles.select("conv_id", F.array_join(names, ",").alias("sections"))


@query("policy_decision", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'allowed' WHEN event_type = 'signup' THEN CASE WHEN value < 50 THEN 'allowed' ELSE 'denied' END WHEN event_type = 'purchase' AND value > 10 THEN 'allowed' ELSE 'denied' END AS decision FROM events")
def policy_decision(t: Tables) -> DataFrame:
    """FLT-08: views and clicks read, signups write inside, the rest needs leave."""
    kind = F.col("event_type")
    return t.events.select("event_id", P.policy(kind.isin("view", "click"), kind == "signup", F.col("value") < 50, (kind == "purchase") & (F.col("value") > 10)).alias("decision"))


@query("impact_target_paths", r"""WITH p AS (SELECT page_id, unnest([url, concat(regexp_replace(url, '^https?://', ''), '.py'), concat('../', regexp_replace(url, '^https?://', ''), '.PY'), concat('a/../', regexp_replace(url, '^https?://', '')), concat('C:\', CAST(page_id AS VARCHAR), '.py')]) AS path FROM pages),
    v AS (SELECT page_id, path, replace(path, '\', '/') AS plain FROM p)
    SELECT page_id, path, CASE WHEN starts_with(plain, '/') OR regexp_matches(plain, '^[A-Za-z]:') THEN 'invalid_path' WHEN starts_with(plain, '../') THEN 'path_forbidden' WHEN NOT suffix(lower(plain), '.py') THEN 'invalid_path' ELSE 'ok' END AS verdict FROM v""")
def impact_target_paths(t: Tables) -> DataFrame:
    """FLT-09: every page's address, and paths made of it."""
    bare = F.regexp_replace("url", "^https?://", "")
    made = F.array(F.col("url"), F.concat(bare, F.lit(".py")), F.concat(F.lit("../"), bare, F.lit(".PY")), F.concat(F.lit("a/../"), bare), F.concat(F.lit("C:\\"), F.col("page_id").cast("string"), F.lit(".py")))
    return t.pages.select("page_id", F.explode(made).alias("path")).select("page_id", "path", P.target_verdict(F.col("path")).alias("verdict"))


@query("relation_lines", f"""WITH s AS (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag, l_linenumber FROM lineitem)
    SELECT l_orderkey, l_partkey, l_linenumber, concat('- order:', l_orderkey, ' --calls--> part:', l_partkey, ' [resolution=', CASE l_returnflag WHEN 'N' THEN 'static' WHEN 'R' THEN 'unknown' ELSE 'unavailable' END, '; basis=', CASE l_returnflag WHEN 'N' THEN 'call_site' ELSE 'unavailable' END, '; ',
        CASE WHEN l_linenumber < 4 THEN concat('graph_site_path=orders/', l_orderkey, '; graph_site_lines=', l_linenumber, '-', l_linenumber) ELSE 'graph_site=unavailable' END, '; runtime=unverified]') AS line FROM s""")
def relation_lines(t: Tables) -> DataFrame:
    """PRJ-07: every order's calls as lines of an evidence text."""
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber").distinct()
    flag, near = F.col("l_returnflag"), F.col("l_linenumber") < 4
    resolution, basis = F.when(flag == "N", "static").when(flag == "R", "unknown").otherwise("other"), F.when(flag == "N", "call_site")
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    path = F.when(near, F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string")))
    line = P.relation_line(key("order", "l_orderkey"), F.lit("calls"), key("part", "l_partkey"), resolution, basis, path, F.col("l_linenumber"), F.col("l_linenumber"))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", line.alias("line"))


_REFS = f"""r AS (SELECT source, concat(lang, '/', doc_id, '.txt') AS path, len({_LINES}) AS n_lines, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)"""


@query("public_retrieval_summary", f"""WITH {_REFS} SELECT source, CAST(rank AS INTEGER) AS rank, path, CASE WHEN n_lines > 0 THEN 1 END AS start_line, CASE WHEN n_lines > 0 THEN CAST(n_lines AS INTEGER) END AS end_line, CASE WHEN n_lines > 0 THEN 'complete_file' ELSE 'unavailable' END AS coverage,
    CAST(least(4, ceil(n_lines / 20)) AS INTEGER) AS n_chunk_ids, CAST(greatest(0, ceil(n_lines / 20) - 4) AS INTEGER) AS chunk_ids_omitted, n AS evidence_count, greatest(n - 6, 0) AS references_omitted FROM r WHERE rank <= 6""")
def public_retrieval_summary(t: Tables) -> DataFrame:
    """PRJ-05 and PRJ-08: a source's longest documents as a result's references: six at most, four chunk ids each, with how many are left out; counts come from an aggregate, the six from a top-k by group."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    rows = t.documents.select("source", "doc_id", "n_chars", F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.size(lines("text")).alias("n_lines"))
    few = rows.withColumn("rank", rank).where("rank <= 6")
    n, chunks, some = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("evidence_count")), F.ceil(F.col("n_lines") / 20), F.col("n_lines") > 0
    return few.join(n, "source").select("source", "rank", "path", F.when(some, 1).alias("start_line"), F.when(some, F.col("n_lines")).alias("end_line"), F.when(some, "complete_file").otherwise("unavailable").alias("coverage"),
        F.least(F.lit(4), chunks).cast("int").alias("n_chunk_ids"), F.greatest(F.lit(0), chunks - 4).cast("int").alias("chunk_ids_omitted"), "evidence_count", F.greatest(F.col("evidence_count") - 6, F.lit(0)).alias("references_omitted"))


@query("result_summary", f"""WITH {_REFS}, s AS (SELECT source, count(*) AS evidence_count, count(*) FILTER (n_lines = 0) AS unavailable, count(*) FILTER (n_lines > 120) AS oversized FROM r GROUP BY source)
    SELECT source, evidence_count, unavailable, oversized, CASE WHEN evidence_count = 0 THEN 'empty' WHEN unavailable = evidence_count THEN 'unavailable' WHEN unavailable + oversized > 0 THEN 'degraded' ELSE 'ok' END AS status FROM s""")
def result_summary(t: Tables) -> DataFrame:
    """PRJ-06 and RET-16: one row for each source as a result: how much evidence, and its status."""
    size = F.size(lines("text"))
    rows = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("evidence_count"), F.count_if(size == 0).alias("unavailable"), F.count_if(size > 120).alias("oversized"))
    n, gone = F.col("evidence_count"), F.col("unavailable")
    return rows.withColumn("status", F.when(n == 0, "empty").when(gone == n, "unavailable").when(gone + F.col("oversized") > 0, "degraded").otherwise("ok"))


_FIT = """u AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn DESC) AS copy, CAST(strlen(text) AS BIGINT) + 16 AS cost FROM conversations),
    w AS (SELECT *, CASE WHEN copy > 1 THEN 'duplicate' WHEN sum(CASE WHEN copy = 1 THEN cost ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY (role = 'system') DESC, turn DESC ROWS UNBOUNDED PRECEDING) > 400 THEN 'context_budget' END AS reason FROM u)"""


@query("context_report", f"""WITH {_FIT}, r AS (SELECT conv_id, count(*) FILTER (reason IS NULL) AS selected_count, count(*) FILTER (reason = 'duplicate') AS duplicates, count(*) FILTER (reason = 'context_budget') AS over_budget, CAST(coalesce(sum(cost) FILTER (reason IS NULL), 0) AS BIGINT) AS estimated FROM w GROUP BY conv_id)
    SELECT *, greatest(selected_count - 8, 0) AS references_omitted, greatest(duplicates + over_budget - 8, 0) AS decisions_omitted, estimated <= 400 AS accepted FROM r""")
def context_report(t: Tables) -> DataFrame:
    """RET-25, RET-24 and PRJ-11: what of a conversation fits 400 bytes, and why the rest goes; eight references and eight decisions are shown."""
    from pyspark.sql import Window

    copy = F.row_number().over(Window.partitionBy("conv_id", "text").orderBy(F.desc("turn")))
    rows = t.conversations.select("conv_id", "turn", "role", copy.alias("copy"), (F.octet_length("text") + 16).cast("long").alias("cost"))
    order = Window.partitionBy("conv_id").orderBy(F.desc(F.col("role") == "system"), F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.when(F.col("copy") == 1, F.col("cost")).otherwise(0)).over(order)
    rows = rows.withColumn("reason", F.when(F.col("copy") > 1, "duplicate").when(used > 400, "context_budget"))
    kept, of = F.col("reason").isNull(), lambda r: F.count_if(F.col("reason") == r)
    out = rows.groupBy("conv_id").agg(F.count_if(kept).alias("selected_count"), of("duplicate").alias("duplicates"), of("context_budget").alias("over_budget"), F.coalesce(F.sum(F.when(kept, F.col("cost"))), F.lit(0)).alias("estimated"))
    out = out.withColumns({"references_omitted": F.greatest(F.col("selected_count") - 8, F.lit(0)), "decisions_omitted": F.greatest(F.col("duplicates") + F.col("over_budget") - 8, F.lit(0))})
    return out.withColumn("accepted", F.col("estimated") <= 400)
