"""Retrieval queries over documents, embeddings, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import question_tokens, tokens
from ..operators import retrieval as R
from .registry import Tables, query

QUESTION = "Which texts name the MIT License, and with that the other hand?"
_SCORE = " + ".join(f"CAST(contains(lower(text), '{t}') AS INTEGER)" for t in question_tokens(QUESTION))
_KEYWORD = f"(SELECT * FROM (SELECT doc_id, source, n_chars, {_SCORE} AS score FROM documents) WHERE score > 0)"
_COSINE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    q AS (SELECT v AS q FROM v WHERE vec_id = 7),
    c AS (SELECT vec_id, label, round(greatest(-1.0, least(1.0, list_sum(list_transform(list_zip(v, q), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))))), 6) AS score FROM v, q)"""


@query("tokenize_distinct", r"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, sha256(array_to_string(list_sort(t), ' ')) AS tokens_sha256
    FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_/]{2,}')) AS t FROM documents)""")
def tokenize_distinct(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tokens("text").alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("tokens_sha256"))


@query("keyword_candidates_topk", f"SELECT doc_id, CAST(score AS INTEGER) AS score FROM {_KEYWORD} ORDER BY score DESC, doc_id LIMIT 20")
def keyword_candidates_topk(t: Tables) -> DataFrame:
    return R.top(R.keyword_scores(t.documents.select("doc_id", "text"), QUESTION), 20, "doc_id").select("doc_id", "score")


def _cosines(t: Tables) -> DataFrame:
    """Rounded cosines with the stated query vector, that of vec_id 7."""
    vectors = t.embeddings
    own = vectors.where("vec_id = 7").select("embedding").head()
    return vectors.select("vec_id", "label", F.round(R.cosine("embedding", own[0]), 6).alias("score")).where("score IS NOT NULL")


@query("vector_topk", f"WITH {_COSINE} SELECT vec_id, score FROM c ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(t: Tables) -> DataFrame:
    return R.top(_cosines(t), 20, "vec_id").select("vec_id", "score")


@query("vector_max_by_definition", f"WITH {_COSINE} SELECT label, max(score) AS score, arg_min(vec_id, (-score, vec_id)) AS representative, count(*) AS n FROM c GROUP BY label")
def vector_max_by_definition(t: Tables) -> DataFrame:
    """AGG-03: each definition's best score and the row that has it, of several the least."""
    return _cosines(t).groupBy("label").agg(F.max("score").alias("score"), F.min_by("vec_id", F.struct(-F.col("score"), "vec_id")).alias("representative"), F.count(F.lit(1)).alias("n"))


@query("vector_validity", "SELECT CAST(len(embedding) AS INTEGER) AS width, len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS valid, count(*) AS n FROM embeddings GROUP BY ALL")
def vector_validity(t: Tables) -> DataFrame:
    return t.embeddings.groupBy(F.size("embedding").alias("width"), R.valid_vector("embedding").alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def _channels(t: Tables) -> DataFrame:
    words = R.keyword_scores(t.documents.select("doc_id", "text"), QUESTION)
    return R.ranked(words, "keyword", "doc_id").unionByName(R.ranked(_cosines(t), "vector", "vec_id"))


_FUSED = f"""WITH {_COSINE}, ch AS (
        SELECT doc_id AS key, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM {_KEYWORD} QUALIFY rank <= 20
        UNION ALL SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM c QUALIFY rank <= 20),
    f AS (SELECT key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, count(*) AS n_channels FROM ch GROUP BY key)"""


@query("hybrid_rrf_topk", f"{_FUSED} SELECT key, fused, n_channels FROM f ORDER BY fused DESC, key LIMIT 6")
def hybrid_rrf_topk(t: Tables) -> DataFrame:
    return R.top(R.fused(_channels(t)), 6, "key", score="fused")


@query("rrf_file_diversity", f"""{_FUSED}, r AS (SELECT f.key, f.fused, f.n_channels > 1 AS pinned, d.source AS path FROM f JOIN documents d ON d.doc_id = f.key),
    w AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pinned DESC, fused DESC, key) AS k, bool_or(pinned) OVER (PARTITION BY path) AS served FROM r)
    SELECT key, fused, pinned, path, CAST(row_number() OVER (ORDER BY (pinned OR (k = 1 AND NOT served)) DESC, pinned DESC, fused DESC, key) AS INTEGER) AS position FROM w""")
def rrf_file_diversity(t: Tables) -> DataFrame:
    """Rows that both channels found are pinned."""
    rows = R.fused(_channels(t)).join(t.documents.select(F.col("doc_id").alias("key"), F.col("source").alias("path")), "key")
    return R.diverse(rows.select("key", "fused", (F.col("n_channels") > 1).alias("pinned"), "path"))


_VALUES = ["MIT", "License", "Apache License", "nope"]


@query("exact_mention_match", "SELECT value, doc_id FROM documents, (VALUES ('MIT'), ('License'), ('Apache License'), ('nope')) AS x(value) WHERE regexp_matches(text, concat('(?i)(^|[^A-Za-z0-9_./])', value, '($|[^A-Za-z0-9_/.]|\\.($|[^A-Za-z_]))'))".replace("\\\\", "\\"))
def exact_mention_match(t: Tables) -> DataFrame:
    return R.exact_mentions(t.documents.select("doc_id", "text"), _VALUES).select("value", "doc_id")


@query("intent_detect", """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '入口|启动|\\b(entry|main)\\b') THEN 'entry' WHEN regexp_matches(lower(text), '影响|impact|改动|修改') THEN 'impact'
    WHEN regexp_matches(lower(text), '依赖|import|调用|call') THEN 'dependency' ELSE 'general' END AS intent FROM conversations""".replace("\\\\", "\\"))
def intent_detect(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", R.intent("text").alias("intent"))


@query("route_question", """WITH c AS (SELECT conv_id, turn, lower(text) AS l, coalesce(nullif(regexp_extract(text, '(?:^|[^\\w/\\\\.:-])([\\w.-]+(?:/[\\w.-]+)*\\.py)(?:$|[^\\w/\\\\.])', 1), ''), nullif(regexp_extract(text, '`([A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)*)`', 1), '')) AS target FROM conversations),
    a AS (SELECT *, regexp_matches(l, '跨模块|跨文件|调用链|cross[- ](?:module|file)|call (?:chain|graph)|排查|诊断|多步|逐步|debug|investigat|multi[- ]step|step.by.step') AS agent,
        regexp_matches(l, '入口|entry\\b|entrypoint') AS entry, regexp_matches(l, '入门|阅读顺序|概览|onboard|overview') AS tour FROM c)
    SELECT conv_id, turn, CASE WHEN agent THEN 'agent' WHEN target IS NOT NULL OR entry OR tour THEN 'fast' ELSE 'agent' END AS strategy,
        CASE WHEN agent THEN 'general' WHEN target IS NOT NULL THEN CASE WHEN regexp_matches(l, '影响|修改|变更|impact|change|modif') THEN 'impact' WHEN regexp_matches(l, '依赖|dependenc|imports?') THEN 'dependency' WHEN suffix(target, '.py') THEN 'explain' ELSE 'general' END
             WHEN entry THEN 'entry' WHEN tour THEN 'onboard' ELSE 'general' END AS intent,
        CASE WHEN NOT agent THEN target END AS target FROM a""")
def route_question(t: Tables) -> DataFrame:
    strategy, intent, target = R.route("text")
    return t.conversations.select("conv_id", "turn", strategy.alias("strategy"), intent.alias("intent"), target.alias("target"))


def document_graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents as nodes by their source's path, and a reference from each to the next one, if there is one."""
    key = F.col("doc_id").cast("string")
    nodes = t.documents.select(key.alias("id"), F.lit("file").alias("type"), F.col("source").alias("name"), F.col("source").alias("path"))
    following = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), key.alias("target"))
    return nodes, t.documents.select("doc_id", key.alias("source")).join(following, "doc_id").select("source", "target", F.lit("references").alias("type"))


def three_channels(t: Tables) -> DataFrame:
    """Keyword and vector channels, and what the graph reaches within two steps of the four best of each (eight seeds at most)."""
    from ..operators.graph import bounded_bfs
    from ..operators.store import stored

    found = stored(_channels(t), "channels")  # scored once, for the seeds and for the union
    seeds = [str(r["key"]) for r in found.where("rank <= 4").select("key").distinct().collect()]
    nodes, edges = document_graph(t)
    hits, _ = bounded_bfs(nodes, stored(edges, "document-edges"), seeds, depth=2, node_limit=256, edge_limit=4096)
    reached = hits.where("distance > 0").select(F.col("id").cast("long").alias("doc_id"), (1 / F.col("distance")).alias("score"))
    return found.unionByName(R.ranked(reached, "graph", "doc_id"))


_THREE = f"""WITH RECURSIVE {_COSINE}, ch AS (
        SELECT doc_id AS key, 'keyword' AS channel, 0 AS ord, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM {_KEYWORD} QUALIFY rank <= 20
        UNION ALL SELECT vec_id, 'vector', 1, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM c QUALIFY rank <= 20),
    e AS (SELECT a.doc_id AS x, a.doc_id + 1 AS y FROM documents a WHERE a.doc_id + 1 IN (SELECT doc_id FROM documents)), b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
    s AS (SELECT DISTINCT key FROM ch WHERE rank <= 4), h1 AS (SELECT DISTINCT y AS key FROM b JOIN s ON s.key = b.x WHERE y NOT IN (SELECT key FROM s)),
    h2 AS (SELECT DISTINCT y AS key FROM b JOIN h1 ON h1.key = b.x WHERE y NOT IN (SELECT key FROM s) AND y NOT IN (SELECT key FROM h1)),
    g AS (SELECT key, 'graph' AS channel, 2 AS ord, row_number() OVER (ORDER BY score DESC, key) AS rank FROM (SELECT key, 1.0 AS score FROM h1 UNION ALL SELECT key, 0.5 FROM h2) QUALIFY rank <= 20), every AS (SELECT * FROM ch UNION ALL SELECT * FROM g),
    f AS (SELECT key, round(sum(CASE channel WHEN 'graph' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank)), 9) AS fused, count(*) AS n_channels, string_agg(concat(channel, '_rank=', rank), ';' ORDER BY ord) AS reason FROM every GROUP BY key)"""


@query("hybrid_three_channels", f"""{_THREE} SELECT f.key, fused, n_channels, reason, d.source AS path, CASE WHEN n_channels = 1 AND starts_with(reason, 'graph') THEN 'dependency' ELSE 'definition' END AS role,
    CAST(row_number() OVER (ORDER BY fused DESC, f.key) AS INTEGER) AS position FROM f JOIN documents d ON d.doc_id = f.key""")
def hybrid_three_channels(t: Tables) -> DataFrame:
    """RET-08, SET-01, JOI-17, WIN-02 and RET-10: keyword, vector and graph fused, with ranks, reasons and roles."""
    from pyspark.sql import Window

    rows = R.reasons_of(three_channels(t)).join(t.documents.select(F.col("doc_id").alias("key"), F.col("source").alias("path")), "key")
    alone = F.when((F.col("n_channels") == 1) & F.col("reason").startswith("graph"), "graph").otherwise("other")
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("fused"), "key"))
    return rows.select("key", "fused", "n_channels", "reason", "path", R.role(F.col("path"), alone).alias("role"), place.alias("position"))


@query("retrieval_status", f"""{_THREE} SELECT (SELECT count(*) FROM f) AS items, (SELECT count(*) FROM g) AS graph_items, CASE WHEN (SELECT count(*) FROM f) = 0 THEN 'empty' WHEN (SELECT count(*) FROM h1) + (SELECT count(*) FROM h2) > 20 THEN 'degraded' ELSE 'ok' END AS status""")
def retrieval_status(t: Tables) -> DataFrame:
    """RET-01 and RET-16: one row on the whole retrieval: how much was found, and whether the graph's channel was cut."""
    found = three_channels(t)
    rows = found.groupBy(F.lit(1)).agg(F.count_distinct("key").alias("items"), F.count_if(F.col("channel") == "graph").alias("graph_items"))
    return rows.select("items", "graph_items", F.when(F.col("items") == 0, "empty").when(F.col("graph_items") >= 20, "degraded").otherwise("ok").alias("status"))


def candidates(t: Tables) -> DataFrame:
    """The fused list's documents with line ranges in their sources, which overlap, and what they cost to render."""
    rows = R.reasons_of(three_channels(t)).join(t.documents.select(F.col("doc_id").alias("key"), "source", "text", "n_chars"), "key")
    items = rows.select("key", "fused", (F.col("n_channels") > 1).alias("pinned"), F.col("source").alias("path"), F.floor(F.col("n_chars") / 50).cast("int").alias("start_line"), (512 + F.octet_length("text")).cast("long").alias("cost"))
    return R.diverse(items).select("position", "path", "start_line", (F.col("start_line") + 8).alias("end_line"), F.col("pinned").alias("exact"), "cost")


@query("evidence_pack")
def evidence_pack(t: Tables) -> DataFrame:
    """RET-14 and RET-15: the fused list's documents, packed for two budgets; tests hold the operator against a brute-force version."""
    from ..operators.store import stored

    few = stored(candidates(t), "candidates")
    packed = [R.pack_evidence(few.withColumn("query", F.lit(f"budget {b}")), b) for b in (4096, 131072)]
    return packed[0].unionByName(packed[1])


@query("evidence_pack_rendered")
def evidence_pack_rendered(t: Tables) -> DataFrame:
    """RET-14 and RET-15: the fused list's documents, packed for three budgets by the bytes of the whole pack; a test holds the operator against a plain version."""
    from ..operators.store import stored

    rows = R.reasons_of(three_channels(t)).join(t.documents.select(F.col("doc_id").alias("key"), "source", "text", "n_chars"), "key")
    items = rows.select("key", "fused", (F.col("n_channels") > 1).alias("pinned"), F.col("source").alias("path"), F.floor(F.col("n_chars") / 50).cast("int").alias("start_line"), F.substring("text", 1, 2000).alias("text"))
    items = R.diverse(items).select("position", "path", "start_line", (F.col("start_line") + 8).alias("end_line"), F.col("pinned").alias("exact"), "text")
    few = stored(R.rendered_costs(items).drop("text"), "rendered")
    packed = [R.pack_rendered(few.withColumn("query", F.lit(f"budget {b}")), b) for b in (4096, 16384, 131072)]
    return packed[0].unionByName(packed[1]).unionByName(packed[2])


@query("pack_reason_counts")
def pack_reason_counts(t: Tables) -> DataFrame:
    """AGG-06: how many candidates of each pack stay or go, and why."""
    return evidence_pack(t).groupBy("query", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("evidence_sufficiency", """WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (text = '') AS gone, count(*) FILTER (n_chars > 10000) AS cut, count(DISTINCT lang) AS langs FROM documents GROUP BY source)
    SELECT source, concat_ws(',', CASE WHEN n = 0 THEN 'evidence_empty' END, CASE WHEN n = gone THEN 'source_unavailable' END, CASE WHEN gone + cut > 0 THEN 'partial_coverage' END, CASE WHEN n > 40 THEN 'budget_limited' END, CASE WHEN langs > 1 THEN 'relations_unconfirmed' END) AS reasons FROM s""")
def evidence_sufficiency(t: Tables) -> DataFrame:
    """RET-20: why a source's documents don't suffice as evidence."""
    rows = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") == "").alias("gone"), F.count_if(F.col("n_chars") > 10000).alias("cut"), F.count_distinct("lang").alias("langs"))
    n, gone = F.col("n"), F.col("gone")
    rules = {"evidence_empty": n == 0, "source_unavailable": n == gone, "partial_coverage": gone + F.col("cut") > 0, "budget_limited": n > 40, "relations_unconfirmed": F.col("langs") > 1}
    return rows.select("source", R.sufficiency(rules).alias("reasons"))


@query("pack_digest", """WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 6)
    SELECT source, count(*) AS n, sha256(concat('[', string_agg(concat('{"doc_id":', doc_id, ',"n_chars":', n_chars, ',"rank":', rank, '}'), ',' ORDER BY rank), ']')) AS digest FROM r GROUP BY source""")
def pack_digest(t: Tables) -> DataFrame:
    """AGG-27 and RET-21: the digest that binds a source's pack (its six longest documents) to its contents: canonical JSON, keys in order."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    few = t.documents.select("source", "doc_id", "n_chars", rank.alias("rank")).where("rank <= 6")
    listed = few.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("rank", "doc_id", "n_chars"))).alias("items"))
    canonical = F.to_json(F.transform("items", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["n_chars"].alias("n_chars"), x["rank"].alias("rank"))))
    return listed.select("source", "n", F.sha2(canonical, 256).alias("digest"))


_PATHS = ["docs/the", "lib/with", "app/and"]


def _named(value: str) -> str:
    return f"regexp_matches(text, '(?i)(^|[^A-Za-z0-9_./])({value})($|[^A-Za-z0-9_/.]|\\.($|[^A-Za-z_]))')".replace("\\\\", "\\")


@query("best_file_match", "SELECT conv_id, turn, CASE WHEN n = 1 THEN CASE WHEN a THEN 'docs/the' WHEN b THEN 'lib/with' ELSE 'app/and' END END AS target FROM (SELECT conv_id, turn, a, b, CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) AS n FROM (SELECT conv_id, turn, " + ", ".join(f"{_named(v)} AS {k}" for k, v in (("a", "the"), ("b", "with"), ("c", "and"))) + " FROM conversations))")
def best_file_match(t: Tables) -> DataFrame:
    """RET-03: the one of three paths that a message names."""
    return R.best_file(t.conversations, ["conv_id", "turn"], "text", _PATHS)


@query("exact_or_keyword", f"""WITH e AS (SELECT 'MIT License' AS value, doc_id, 100 AS score FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_./])MIT License($|[^A-Za-z0-9_/.]|\\.($|[^A-Za-z_]))')),
    k AS (SELECT 'quux of the' AS value, doc_id, CAST(contains(lower(text), 'quux') AS INTEGER) + CAST(contains(lower(text), 'of') AS INTEGER) + CAST(contains(lower(text), 'the') AS INTEGER) AS score FROM documents)
    SELECT * FROM (SELECT value, doc_id, score FROM e ORDER BY doc_id LIMIT 20) UNION ALL SELECT * FROM (SELECT value, doc_id, score FROM k WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20)""".replace("\\\\", "\\"))
def exact_or_keyword(t: Tables) -> DataFrame:
    """RET-05 and RET-06: a value that texts name as a whole finds them alone, at 100; one that none names falls back to its words."""
    docs, out = t.documents.select("doc_id", "text"), []
    for value in ("MIT License", "quux of the"):
        exact = R.exact_mentions(docs, [value]).select("value", "doc_id", F.lit(100).alias("score")).orderBy("doc_id").limit(20)
        words = R.top(R.keyword_scores(docs, value), 20, "doc_id").select(F.lit(value).alias("value"), "doc_id", "score")
        none = exact.limit(1).select(F.lit(1).alias("hit"))
        out.append(exact.unionByName(words.join(none, F.lit(True), "left_anti")))
    return out[0].unionByName(out[1])


@query("vector_channel", f"WITH {_COSINE} SELECT vec_id, score FROM (SELECT vec_id, score FROM c ORDER BY score DESC, vec_id LIMIT 20) WHERE vec_id IN (SELECT doc_id FROM documents)")
def vector_channel(t: Tables) -> DataFrame:
    """RET-07: the vector channel where nothing was named exactly; rows of unknown texts are refused after the cut."""
    hits = R.top(_cosines(t), 20, "vec_id").select("vec_id", "score")
    return t.documents.select(F.col("doc_id").alias("vec_id")).join(F.broadcast(hits), "vec_id")


_HEX = lambda i: f"((instr('0123456789abcdef', h[{2 * i + 1}:{2 * i + 1}]) - 1) * 16 + instr('0123456789abcdef', h[{2 * i + 2}:{2 * i + 2}]) - 1)"


@query("hash_embedding", f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z_][a-z_0-9]*|[\u4e00-\u9fff]')) AS token FROM documents), n AS (SELECT doc_id, token, count(*) AS n, sha256(token) AS h FROM w GROUP BY doc_id, token),
    s AS (SELECT doc_id, CAST(1 + ({_HEX(0)} + {_HEX(1)} * 256 + {_HEX(2)} * 65536 + {_HEX(3)}::BIGINT * 16777216) % 63 AS INTEGER) AS slot, CASE WHEN {_HEX(4)} % 2 = 1 THEN n ELSE -n END AS v FROM n)
    SELECT doc_id, slot, CAST(sum(v) AS BIGINT) AS value FROM s GROUP BY doc_id, slot HAVING sum(v) <> 0 UNION ALL SELECT doc_id, 0, 1 FROM documents""")
def hash_embedding(t: Tables) -> DataFrame:
    return R.hash_embedding(t.documents.select("doc_id", "text"), "doc_id")


@query("planner_fit", """WITH m AS (SELECT conv_id, turn, role, strlen(text) AS cost, CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS worth FROM conversations)
    SELECT conv_id, turn, role, CASE WHEN coalesce(sum(cost) FILTER (worth = 0) OVER (PARTITION BY conv_id), 0) > 300 THEN 'refused' WHEN sum(cost) OVER (PARTITION BY conv_id ORDER BY worth, CASE WHEN worth = 2 THEN -turn ELSE turn END ROWS UNBOUNDED PRECEDING) <= 300 THEN 'kept' ELSE 'context_budget' END AS decision FROM m""")
def planner_fit(t: Tables) -> DataFrame:
    """RET-23: 400 bytes, of which 100 are the answer's."""
    return R.fit_planner(t.conversations.select("conv_id", "turn", "role", "text"), 400, 100)


@query("context_fit", """WITH u AS (SELECT conv_id, turn, role, CAST(strlen(text) AS BIGINT) + 16 AS cost FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, text ORDER BY turn DESC) = 1),
    w AS (SELECT conv_id, turn, role, cost, CAST(sum(cost) OVER (PARTITION BY conv_id ORDER BY (role = 'system') DESC, turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used, sum(cost) FILTER (role = 'system') OVER (PARTITION BY conv_id) > 600 AS over FROM u)
    SELECT conv_id, turn, role, cost, used, CASE WHEN over THEN 'refused' ELSE 'ok' END AS status FROM w WHERE role = 'system' OR used <= 600""")
def context_fit(t: Tables) -> DataFrame:
    return R.fit_context(t.conversations.select("conv_id", "turn", "role", "text"), 600)


_TIGHT = "(SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'system' ELSE role END AS role, text FROM conversations)"


@query("context_fit_tight", f"""WITH u AS (SELECT conv_id, turn, role, CAST(strlen(text) AS BIGINT) + 16 AS cost FROM {_TIGHT} QUALIFY row_number() OVER (PARTITION BY conv_id, text ORDER BY turn DESC) = 1),
    g AS (SELECT conv_id, coalesce(sum(cost) FILTER (role = 'system'), 0) AS least FROM u GROUP BY conv_id)
    SELECT a.conv_id, a.turn, a.role, a.cost, CAST((SELECT sum(b.cost) FROM u b WHERE b.conv_id = a.conv_id AND ((b.role = 'system' AND a.role <> 'system') OR ((b.role = 'system') = (a.role = 'system') AND b.turn >= a.turn))) AS BIGINT) AS used, CASE WHEN least > 120 THEN 'refused' ELSE 'ok' END AS status
    FROM u a JOIN g USING (conv_id) WHERE a.role = 'system' OR used <= 120""")
def context_fit_tight(t: Tables) -> DataFrame:
    """RET-22: a budget that many first messages, which are protected, exceed by themselves."""
    rows = t.conversations.select("conv_id", "turn", F.when(F.col("turn") == 0, "system").otherwise(F.col("role")).alias("role"), "text")
    return R.fit_context(rows, 120)
