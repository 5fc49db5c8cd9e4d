"""Checks of graphs, chunks, claims and references, and further sources: violations are rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SECRET, lines, public_text
from ..operators import evidence as E
from ..operators import graph as G
from ..sources import text_source as S
from . import graph as star
from .registry import Tables, query
from .source import _CHUNKS, _LINES


@query("graph_constraints", f"""{star.BOTH}, r AS (SELECT 'duplicate_node' AS rule, count(*) AS n FROM (SELECT id FROM nodes GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'duplicate_edge', count(*) FROM (SELECT 1 FROM edges GROUP BY source, target, type HAVING count(*) > 1)
    UNION ALL SELECT 'dangling_source', count(*) FROM edges WHERE source NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'dangling_target', count(*) FROM edges WHERE target NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'self_loop', count(*) FROM edges WHERE source = target
    UNION ALL SELECT 'two_parents', count(*) FROM (SELECT target FROM edges WHERE type = 'contains' GROUP BY target HAVING count(DISTINCT source) > 1) UNION ALL SELECT 'unknown_node_type', count(*) FROM nodes WHERE type NOT IN ('file', 'class', 'function', 'method', 'external')
    UNION ALL SELECT 'unknown_edge_type', count(*) FROM edges WHERE type NOT IN ('contains', 'imports', 'references', 'calls', 'unresolved_call') UNION ALL SELECT 'unsafe_path', count(*) FROM nodes WHERE starts_with(path, '/') OR contains(path, ':') OR contains(path, '//')
    UNION ALL SELECT 'missing_path', count(*) FROM nodes WHERE path IS NULL AND type <> 'external') SELECT * FROM r""")
def graph_constraints(t: Tables) -> DataFrame:
    """FLT-10: how many nodes and edges break each rule."""
    return G.constraint_counts(star.nodes(t), star.edges(t))


@query("binding_fact_diff", """WITH a AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O')
    SELECT side, count(*) AS facts, CAST(sum(n) AS BIGINT) AS surplus FROM (SELECT 'stored' AS side, l_partkey, l_suppkey, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL UNION ALL SELECT 'rebuilt', l_partkey, l_suppkey, count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL) GROUP BY side""")
def binding_fact_diff(t: Tables) -> DataFrame:
    """FLT-11: stored and rebuilt facts as multisets: what either side has too many of. One aggregate over both, no set is held."""
    facts = t.lineitem.groupBy("l_partkey", "l_suppkey").agg((F.count_if(F.col("l_linestatus") == "F") - F.count_if(F.col("l_linestatus") == "O")).alias("d")).where("d <> 0")
    return facts.groupBy(F.when(F.col("d") > 0, "stored").otherwise("rebuilt").alias("side")).agg(F.count(F.lit(1)).alias("facts"), F.sum(F.abs("d")).alias("surplus"))


@query("chunk_hash_rebuild", f"""WITH l AS (SELECT doc_id, text, {_LINES} AS l FROM documents), p AS (SELECT doc_id, unnest(range(1, len(l) + 1, 20)) AS s, l FROM l),
    c AS (SELECT doc_id, s, array_to_string(l[s:s + 19], chr(10)) AS body FROM p), j AS (SELECT doc_id, sha256(string_agg(body, chr(10) ORDER BY s)) AS rebuilt, count(*) AS chunks FROM c GROUP BY doc_id)
    SELECT l.doc_id, coalesce(chunks, 0) AS chunks, coalesce(rebuilt = sha256(CASE WHEN suffix(text, chr(10)) THEN text[:-2] ELSE text END), text = '') AS intact FROM l LEFT JOIN j USING (doc_id)""")
def chunk_hash_rebuild(t: Tables) -> DataFrame:
    """FLT-12: a text put together again from its chunks has its own hash; a last line feed adds no line. A text's chunks are put together where it lies."""
    own = lines("text")
    starts = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own), F.lit(20))).otherwise(F.array().cast("array<int>"))
    bodies = F.transform(starts, lambda s: F.array_join(F.slice(own, s, F.lit(20)), "\n"))
    whole = F.when(F.col("text").endswith("\n"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    return t.documents.select("doc_id", F.size(starts).cast("long").alias("chunks"), F.when(F.size(starts) > 0, F.sha2(F.array_join(bodies, "\n"), 256) == F.sha2(whole, 256)).otherwise(F.col("text") == "").alias("intact"))


@query("evidence_inspection", f"""WITH l AS (SELECT doc_id, {_LINES} AS l FROM documents), c AS (SELECT doc_id, l, unnest([1, 2, 5, len(l) + 1]) AS line, l[1] AS claim FROM l)
    SELECT doc_id, CAST(line AS INTEGER) AS line, CASE WHEN line > len(l) THEN 'missing_line' WHEN l[line] = claim THEN 'ok' ELSE 'snippet_mismatch' END AS verdict FROM c""")
def evidence_inspection(t: Tables) -> DataFrame:
    """FLT-15: every document's first line claimed of its lines 1, 2, 5 and of one past its end; what the source says to that."""
    own = t.documents.select("doc_id", lines("text").alias("l"))
    claims = own.select("doc_id", "l", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5), F.size("l") + 1)).alias("line"), F.get("l", F.lit(0)).alias("claim"))
    verdict = F.when(F.col("line") > F.size("l"), "missing_line").when(F.get("l", F.col("line") - 1) == F.col("claim"), "ok").otherwise("snippet_mismatch")
    return claims.select("doc_id", "line", verdict.alias("verdict"))


_ANSWERS = "a AS (SELECT event_id, concat('see src/u', user_id, '.py:', 1 + event_id % 30, '-', 1 + event_id % 30 + event_id % 4, ' and lib/', event_type, '.py:7-9') AS answer FROM events)"


@query("citation_extract", rf"""WITH {_ANSWERS}, c AS (SELECT event_id, unnest(regexp_extract_all(answer, '[A-Za-z0-9_./-]+\.py:[0-9]+-[0-9]+')) AS cited FROM a)
    SELECT event_id, regexp_extract(cited, '^(.*):', 1) AS path, CAST(regexp_extract(cited, ':([0-9]+)-', 1) AS INTEGER) AS low, CAST(regexp_extract(cited, '-([0-9]+)$', 1) AS INTEGER) AS high FROM c""")
def citation_extract(t: Tables) -> DataFrame:
    """FLT-16: the path and lines of every citation in answers made of the events."""
    first = 1 + F.col("event_id") % 30
    text = lambda c: c.cast("string")
    answer = F.concat(F.lit("see src/u"), text(F.col("user_id")), F.lit(".py:"), text(first), F.lit("-"), text(first + F.col("event_id") % 4), F.lit(" and lib/"), "event_type", F.lit(".py:7-9"))
    return E.citations(t.events.select("event_id", answer.alias("answer")), "event_id", "answer")


@query("definition_candidates", f"""{star.BOTH}, p AS (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY id) AS k, count(*) OVER (PARTITION BY name) AS n FROM nodes)
    SELECT name, n AS candidate_count, CASE WHEN n = 1 THEN 'static' ELSE 'ambiguous' END AS resolution, string_agg(id, ',' ORDER BY id) FILTER (k <= 8) AS candidates FROM p GROUP BY name, n""")
def definition_candidates(t: Tables) -> DataFrame:
    """GQ-08: for every name its definitions; of an ambiguous one eight at most are named. Ranked before they are listed, so no list grows with the graph."""
    every = star.nodes(t).select("name", "id")
    counts = every.groupBy("name").agg(F.count(F.lit(1)).alias("candidate_count"))
    few = every.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("id"))).where("k <= 8").groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("candidates"))
    return counts.join(few, "name").select("name", "candidate_count", F.when(F.col("candidate_count") == 1, "static").otherwise("ambiguous").alias("resolution"), "candidates")


@query("callee_counts", f"""{star.BOTH}, u AS (SELECT name, min(id) AS id FROM nodes GROUP BY name HAVING count(*) = 1) SELECT u.name, u.id, count(e.target) AS callees FROM u LEFT JOIN edges e ON e.source = u.id AND e.type IN ('calls', 'unresolved_call') GROUP BY u.name, u.id""")
def callee_counts(t: Tables) -> DataFrame:
    """GQ-03: for every name with exactly one definition how many calls it makes; edges are counted before they meet the names."""
    unique = star.nodes(t).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    calls = star.edges(t).where(F.col("type").isin("calls", "unresolved_call")).groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("callees"))
    return unique.join(calls, "id", "left").select("name", "id", F.coalesce("callees", F.lit(0)).alias("callees"))


@query("span_lookup", f"""{star.BOTH}, s AS (SELECT path, name, min(id) AS span FROM nodes WHERE path IS NOT NULL GROUP BY path, name HAVING count(*) = 1) SELECT n.id, s.span FROM nodes n LEFT JOIN s ON s.path = n.path AND s.name = n.name""")
def span_lookup(t: Tables) -> DataFrame:
    """JOI-16: each node's span by path and name, where that names one span alone."""
    every = star.nodes(t)
    spans = every.where("path IS NOT NULL").groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("span")).where("n = 1").drop("n")
    return every.join(spans, ["path", "name"], "left").select("id", "span")


@query("vector_documents", "SELECT label, lang, count(*) AS n, count(e.vec_id) AS embedded FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY label, lang")
def vector_documents(t: Tables) -> DataFrame:
    """JOI-18: vector rows with the texts they are of."""
    rows = t.embeddings.select(F.col("vec_id").alias("doc_id"), "vec_id", "label").join(t.documents.select("doc_id", "lang"), "doc_id")
    return rows.groupBy("label", "lang").agg(F.count(F.lit(1)).alias("n"), F.count("vec_id").alias("embedded"))


@query("binding_conflicts", "WITH b AS (SELECT source, min(lang) AS bound, count(DISTINCT lang) AS bindings FROM documents GROUP BY source) SELECT source, bound, bindings, (SELECT count(*) FROM documents d WHERE d.source = b.source AND d.lang <> b.bound) AS foreign_items FROM b")
def binding_conflicts(t: Tables) -> DataFrame:
    """JOI-19: a source's items must share one binding, here the language; how many don't share the first. Counted by binding before sources meet."""
    each = t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("source").agg(F.min("lang").alias("bound"), F.count(F.lit(1)).alias("bindings"), (F.sum("n") - F.min_by("n", "lang")).alias("foreign_items"))


@query("edge_order", f"""{star.BOTH} SELECT source, target, type, CAST(row_number() OVER (ORDER BY source, target, type) AS INTEGER) AS place FROM edges WHERE type IN ('contains', 'imports') QUALIFY place <= 200""")
def edge_order(t: Tables) -> DataFrame:
    """SRT-04: the first 200 edges in the graph's own order."""
    order = ["source", "target", "type"]
    few = star.edges(t).where(F.col("type").isin("contains", "imports")).orderBy(*order).limit(200)
    return few.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


@query("local_graph_edges", f"""{star.BOTH}, s AS (SELECT id FROM nodes WHERE type = 'class' ORDER BY type, lower(name), id LIMIT 10), v AS (SELECT id FROM s UNION SELECT id FROM (SELECT DISTINCT CASE WHEN e.source IN (SELECT id FROM s) THEN e.target ELSE e.source END AS id FROM edges e WHERE (e.source IN (SELECT id FROM s)) <> (e.target IN (SELECT id FROM s))) WHERE id IN (SELECT id FROM nodes) ORDER BY (id NOT IN (SELECT id FROM s)), id LIMIT 40),
    x AS (SELECT source, target, type, row_number() OVER (ORDER BY source, target, type) AS place FROM edges WHERE source IN (SELECT id FROM v) AND target IN (SELECT id FROM v)) SELECT source, target, type, (SELECT count(*) FROM x) > 80 AS truncated FROM x WHERE place <= 80""")
def local_graph_edges(t: Tables) -> DataFrame:
    """SRT-05 and GQ-18: the edges within the 40 nodes about the first ten classes, 80 at most, and whether there are more."""
    every, links = star.nodes(t), star.edges(t)
    return G.inner_edges(links, G.neighbourhood(every, links, every.where("type = 'class'"), 40).select("id"), 80)


@query("candidate_cap", """WITH r AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 40), d AS (SELECT lang, source, min(rank) AS rank FROM r GROUP BY lang, source), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rank) AS place, count(*) OVER (PARTITION BY lang) AS n FROM d)
    SELECT lang, source, CAST(place AS INTEGER) AS place, place > 6 AS beyond_limit, n > 6 AS candidate_limit_reached, n > 12 AS candidate_pool_limited FROM p WHERE place <= 12""")
def candidate_cap(t: Tables) -> DataFrame:
    """SRT-03: of each language's 40 longest texts the first of every source, a limit of six and a pool of twelve; what lies beyond is diagnosed."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    few = t.documents.select("lang", "source", rank.alias("rank")).where("rank <= 40").groupBy("lang", "source").agg(F.min("rank").alias("rank"))
    own = Window.partitionBy("lang")
    placed = few.withColumns({"place": F.row_number().over(own.orderBy("rank")), "n": F.count(F.lit(1)).over(own)}).where("place <= 12")
    return placed.select("lang", "source", "place", (F.col("place") > 6).alias("beyond_limit"), (F.col("n") > 6).alias("candidate_limit_reached"), (F.col("n") > 12).alias("candidate_pool_limited"))


@query("grep_regex", rf"""WITH l AS (SELECT doc_id, source, {_LINES} AS l FROM documents WHERE regexp_matches(source, '^src[0-9]$')), x AS (SELECT doc_id, source, unnest(l) AS content, unnest(range(1, len(l) + 1)) AS line FROM l), m AS (SELECT *, row_number() OVER (ORDER BY source, doc_id, line) AS place FROM x WHERE regexp_matches(content, '(?i)\b(license|copyright)\b'))
    SELECT source, doc_id, CAST(line AS INTEGER) AS line, content, (SELECT count(*) FROM m) >= 50 AS truncated FROM m WHERE place <= 50""")
def grep_regex(t: Tables) -> DataFrame:
    """SRC-24: a pattern in either case, in files that a glob picks, by path and line, 50 at most, and whether it stopped there."""
    return S.grep_pattern(t.documents.select("source", "doc_id", "text"), "source", ["source", "doc_id"], r"\b(license|copyright)\b", "src?", 50, case_sensitive=False)


@query("range_read_capped", f"SELECT doc_id, length(array_to_string(l[2:40], chr(10))) > 120 AS truncated, substring(array_to_string(l[2:40], chr(10)), 1, 120) AS content, CAST(len(l[2:40]) AS INTEGER) AS n_lines FROM (SELECT doc_id, {_LINES} AS l FROM documents)")
def range_read_capped(t: Tables) -> DataFrame:
    """SRC-25: lines 2 to 40, 120 characters at most."""
    body = S.line_range("text", 2, 40)
    return t.documents.select("doc_id", (F.length(body) > 120).alias("truncated"), F.substring(body, 1, 120).alias("content"), F.size(F.slice(lines("text"), 2, 39)).alias("n_lines"))


_CLEAN = r"""regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '<redacted>', 'g'), '(?i)(password|passwd|secret|token|api_?key)(["'']?\s*[=:]\s*["'']?)[A-Za-z0-9+/_.=-]+', '\1\2<redacted>', 'g')"""


@query("sanitize_text", f"SELECT doc_id, md5(CASE WHEN length(c) > 500 THEN concat(substring(c, 1, 500), '...[truncated]') ELSE c END) AS sanitized_md5, c <> text AS redacted FROM (SELECT doc_id, text, {_CLEAN} AS c FROM documents)")
def sanitize_text(t: Tables) -> DataFrame:
    """PRJ-12: addresses and assigned secrets masked over the whole text, then 500 characters shown."""
    clean = F.regexp_replace("text", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<redacted>")
    clean = F.regexp_replace(clean, r"""(?i)(password|passwd|secret|token|api_?key)(["']?\s*[=:]\s*["']?)[A-Za-z0-9+/_.=-]+""", "$1$2<redacted>")
    shown = F.when(F.length("c") > 500, F.concat(F.substring("c", 1, 500), F.lit("...[truncated]"))).otherwise(F.col("c"))
    return t.documents.select("doc_id", "text", clean.alias("c")).select("doc_id", F.md5(shown).alias("sanitized_md5"), (F.col("c") != F.col("text")).alias("redacted"))


@query("public_texts", rf"""WITH c AS (SELECT doc_id, regexp_replace(concat('Bearer abc,def;ghi ', text, ' API-key = ', doc_id, ';'), '{SECRET}', '\1\2[REDACTED]', 'g') AS c FROM documents)
    SELECT doc_id, md5(CASE WHEN length(c) > 500 THEN concat(substring(c, 1, 500), '...[truncated]') ELSE c END) AS shown_md5, md5(c) AS whole_md5 FROM c""")
def public_texts(t: Tables) -> DataFrame:
    """PRJ-12: documents between two more secrets, masked by the whole pattern, shown and whole."""
    text = F.concat(F.lit("Bearer abc,def;ghi "), F.col("text"), F.lit(" API-key = "), F.col("doc_id").cast("string"), F.lit(";"))
    return t.documents.select("doc_id", F.md5(public_text(text)).alias("shown_md5"), F.md5(public_text(text, 1 << 30)).alias("whole_md5"))


@query("chunk_identity", f"""{_CHUNKS} SELECT doc_id, part, sha256(concat('{{"content_hash":"', content_hash, '","end_line":', end_line, ',"path":"', doc_id, '","start_line":', start_line, '}}')) AS chunk_id FROM c""")
def chunk_identity(t: Tables) -> DataFrame:
    """SRC-15: chunk ids from canonical JSON, keys in order, nulls kept."""
    rows = S.line_chunks(t.documents.select("doc_id", "text"), "doc_id", 20)
    canonical = F.to_json(F.struct("content_hash", "end_line", F.col("doc_id").cast("string").alias("path"), "start_line"), {"ignoreNullFields": "false"})
    return rows.select("doc_id", "part", F.sha2(canonical, 256).alias("chunk_id"))
