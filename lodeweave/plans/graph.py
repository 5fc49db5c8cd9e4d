"""Graph queries over a property graph of the star schema: regions contain nations, nations customers and suppliers; customers import their orders, orders call parts, parts refer to suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import Tables, query

NODES = """nodes AS (
    SELECT concat('region:', r_regionkey) AS id, 'file' AS type, r_name AS name, concat('world/', r_name) AS path FROM region
    UNION ALL SELECT concat('nation:', n_nationkey), 'class', n_name, concat('world/', n_regionkey, '/', n_name) FROM nation
    UNION ALL SELECT concat('cust:', c_custkey), 'function', c_name, concat('nation/', c_nationkey, '/', CASE WHEN c_custkey % 100 = 0 THEN 'main.py' ELSE c_name END) FROM customer
    UNION ALL SELECT concat('supp:', s_suppkey), 'function', s_name, concat('nation/', s_nationkey, '/', s_name) FROM supplier
    UNION ALL SELECT concat('order:', o_orderkey), 'method', o_orderpriority, concat('orders/', o_orderkey) FROM orders
    UNION ALL SELECT concat('part:', p_partkey), 'function', p_name, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE concat('parts/', p_brand) END FROM part)"""
EDGES = """edges AS (
    SELECT concat('region:', n_regionkey) AS source, concat('nation:', n_nationkey) AS target, 'contains' AS type FROM nation
    UNION ALL SELECT concat('nation:', c_nationkey), concat('cust:', c_custkey), 'contains' FROM customer
    UNION ALL SELECT concat('nation:', s_nationkey), concat('supp:', s_suppkey), 'contains' FROM supplier
    UNION ALL SELECT concat('cust:', o_custkey), concat('order:', o_orderkey), 'imports' FROM orders
    UNION ALL SELECT concat('order:', l_orderkey), concat('part:', l_partkey), 'calls' FROM lineitem
    UNION ALL SELECT concat('part:', l_partkey), concat('supp:', l_suppkey), 'references' FROM lineitem)"""
BOTH = f"WITH {NODES}, {EDGES}"


def _key(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def nodes(t: Tables) -> DataFrame:
    make = lambda df, kind, key, type_, name, path: df.select(_key(kind, key).alias("id"), F.lit(type_).alias("type"), F.col(name).alias("name"), path.alias("path"))
    text = lambda c: F.col(c).cast("string")
    return G.union_all([
        make(t.region, "region", "r_regionkey", "file", "r_name", F.concat(F.lit("world/"), "r_name")),
        make(t.nation, "nation", "n_nationkey", "class", "n_name", F.concat_ws("/", F.lit("world"), text("n_regionkey"), "n_name")),
        make(t.customer, "cust", "c_custkey", "function", "c_name", F.concat_ws("/", F.lit("nation"), text("c_nationkey"), F.when(F.col("c_custkey") % 100 == 0, "main.py").otherwise(F.col("c_name")))),
        make(t.supplier, "supp", "s_suppkey", "function", "s_name", F.concat_ws("/", F.lit("nation"), text("s_nationkey"), "s_name")),
        make(t.orders, "order", "o_orderkey", "method", "o_orderpriority", F.concat(F.lit("orders/"), text("o_orderkey"))),
        make(t.part, "part", "p_partkey", "function", "p_name", F.when(F.col("p_partkey") % 17 != 0, F.concat(F.lit("parts/"), "p_brand"))),
    ])


def edges(t: Tables) -> DataFrame:
    make = lambda df, a, b, type_: df.select(_key(*a).alias("source"), _key(*b).alias("target"), F.lit(type_).alias("type"))
    return G.union_all([
        make(t.nation, ("region", "n_regionkey"), ("nation", "n_nationkey"), "contains"),
        make(t.customer, ("nation", "c_nationkey"), ("cust", "c_custkey"), "contains"),
        make(t.supplier, ("nation", "s_nationkey"), ("supp", "s_suppkey"), "contains"),
        make(t.orders, ("cust", "o_custkey"), ("order", "o_orderkey"), "imports"),
        make(t.lineitem, ("order", "l_orderkey"), ("part", "l_partkey"), "calls"),
        make(t.lineitem, ("part", "l_partkey"), ("supp", "l_suppkey"), "references"),
    ])


@query("graph_count_by_type", f"{BOTH} SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def graph_count_by_type(t: Tables) -> DataFrame:
    count = lambda df, kind: G.count_by_type(df).select(F.lit(kind).alias("kind"), "type", "n")
    return count(nodes(t), "node").unionByName(count(edges(t), "edge"))


def _near(side: str, key: str, types: str) -> str:
    other = "target" if side == "source" else "source"
    return f"{BOTH} SELECT e.source, e.target, e.type, n.name, n.path FROM edges e JOIN nodes n ON n.id = e.{other} WHERE e.{side} = '{key}' AND e.type IN ({types})"


@query("graph_imports", _near("source", "cust:7", "'imports'"))
def graph_imports(t: Tables) -> DataFrame:
    return G.outgoing(edges(t), nodes(t), "cust:7", ("imports",))


@query("graph_imported_by", _near("target", "order:42", "'imports'"))
def graph_imported_by(t: Tables) -> DataFrame:
    return G.incoming(edges(t), nodes(t), "order:42", ("imports",))


@query("graph_callees", _near("source", "order:42", "'calls', 'unresolved_call'"))
def graph_callees(t: Tables) -> DataFrame:
    return G.outgoing(edges(t), nodes(t), "order:42", ("calls", "unresolved_call"))


@query("graph_callers", f"{BOTH} SELECT source, target FROM edges WHERE type = 'calls' AND target = 'part:5'")
def graph_callers(t: Tables) -> DataFrame:
    return G.callers(nodes(t), edges(t), "part:5")


@query("graph_definitions", f"{BOTH} SELECT id, type, name, path FROM nodes WHERE name = '1-URGENT'")
def graph_definitions(t: Tables) -> DataFrame:
    return G.definitions(nodes(t), "1-URGENT")


@query("graph_entry_candidates", f"""{BOTH} SELECT DISTINCT n.id, n.path FROM nodes n WHERE n.type = 'file' AND n.id IN (SELECT e.source FROM edges e JOIN nodes m ON m.id = e.target WHERE e.type = 'contains' AND m.name = 'NATION_3')
    UNION SELECT id, path FROM nodes WHERE type = 'file' AND lower(string_split(path, '/')[-1]) IN ('main.py', 'app.py', 'cli.py', '__main__.py')""")
def graph_entry_candidates(t: Tables) -> DataFrame:
    return G.entry_candidates(nodes(t), edges(t), "NATION_3")


@query("graph_dangling_edges", f"""{BOTH}, kept AS (SELECT id FROM nodes WHERE NOT (id LIKE 'part:%' AND path IS NULL))
    SELECT source, target, type, 'target' AS side FROM edges WHERE target NOT IN (SELECT id FROM kept)
    UNION ALL SELECT source, target, type, 'source' FROM edges WHERE source NOT IN (SELECT id FROM kept)""")
def graph_dangling_edges(t: Tables) -> DataFrame:
    """Parts without a path are taken out, so that their edges dangle."""
    return G.dangling(edges(t), nodes(t).where("NOT (id LIKE 'part:%' AND path IS NULL)"))


@query("graph_duplicate_edges", f"{BOTH} SELECT source, target, type, count(*) AS n FROM edges GROUP BY ALL HAVING count(*) > 1")
def graph_duplicate_edges(t: Tables) -> DataFrame:
    return G.repeated_edges(edges(t))


@query("graph_reachability", f"""WITH RECURSIVE {EDGES}, d AS (SELECT DISTINCT source, target FROM edges), r(id, distance) AS (
    SELECT 'region:2', 0 UNION SELECT d.target, r.distance + 1 FROM r JOIN d ON d.source = r.id WHERE r.distance < 4)
    SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM r GROUP BY id""")
def graph_reachability(t: Tables) -> DataFrame:
    return G.reachable(edges(t), "region:2", 4)


@query("graph_local_neighborhood", f"""{BOTH}, s AS (SELECT id FROM nodes WHERE type = 'class' ORDER BY type, lower(name), id LIMIT 10),
    e2 AS (SELECT source AS id, target AS other FROM edges UNION ALL SELECT target, source FROM edges),
    near AS (SELECT DISTINCT other AS id FROM e2 WHERE id IN (SELECT id FROM s) AND other NOT IN (SELECT id FROM s) AND other IN (SELECT id FROM nodes)),
    a AS (SELECT id, 0 AS ring FROM s UNION ALL SELECT id, 1 FROM near), f AS (SELECT id, ring FROM a ORDER BY ring, id LIMIT 40)
    SELECT f.id, n.type, n.name, CAST(f.ring AS INTEGER) AS ring FROM f JOIN nodes n ON n.id = f.id""")
def graph_local_neighborhood(t: Tables) -> DataFrame:
    every = nodes(t)
    return G.neighbourhood(every, edges(t), every.where("type = 'class'"), 40)


@query("graph_degree", f"{BOTH} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id")
def graph_degree(t: Tables) -> DataFrame:
    e = edges(t)
    return e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


@query("graph_bounded_bfs", f"""{BOTH}, adj AS (
        SELECT node, other, way, type, row_number() OVER (PARTITION BY node ORDER BY source, target, type, way DESC) AS turn FROM (
            SELECT source AS node, target AS other, source, target, type, 'outgoing' AS way FROM edges UNION ALL SELECT target, source, source, target, type, 'incoming' FROM edges)),
    c1 AS (SELECT a.*, row_number() OVER (ORDER BY turn) AS c FROM adj a WHERE node = 'order:1'),
    f1 AS (SELECT other AS id, min(c) AS c FROM c1 JOIN nodes n ON n.id = other AND n.path IS NOT NULL WHERE other <> 'order:1' GROUP BY other),
    q1 AS (SELECT id, row_number() OVER (ORDER BY c) AS place FROM f1),
    c2 AS (SELECT a.other, row_number() OVER (ORDER BY q.place, a.turn) AS c FROM adj a JOIN q1 q ON q.id = a.node),
    f2 AS (SELECT other AS id, min(c) AS c FROM c2 JOIN nodes n ON n.id = other AND n.path IS NOT NULL
           WHERE c <= 96 - (SELECT count(*) FROM c1) AND other <> 'order:1' AND other NOT IN (SELECT id FROM q1) GROUP BY other),
    q2 AS (SELECT id, (SELECT count(*) FROM q1) + row_number() OVER (ORDER BY c) AS place FROM f2)
    SELECT 'order:1' AS id, 0 AS distance, 0 AS turn UNION ALL SELECT id, 1, CAST(place AS INTEGER) FROM q1 WHERE place < 24
    UNION ALL SELECT id, 2, CAST(place AS INTEGER) FROM q2 WHERE place < 24""")
def graph_bounded_bfs(t: Tables) -> DataFrame:
    return G.bounded_bfs(nodes(t), edges(t), ["order:1"], depth=2, node_limit=24, edge_limit=96)[0].select("id", "distance", "turn")


_FIRM = "CASE type WHEN 'calls' THEN length(target) % 2 = 0 WHEN 'references' THEN length(source) % 2 = 0 ELSE true END"


@query("graph_bfs_paths", f"""{BOTH}, adj AS (
        SELECT node, other, way, type, firm, row_number() OVER (PARTITION BY node ORDER BY source, target, type, way DESC) AS turn FROM (
            SELECT source AS node, target AS other, source, target, type, 'outgoing' AS way, {_FIRM} AS firm FROM edges UNION ALL SELECT target, source, source, target, type, 'incoming', {_FIRM} FROM edges)),
    n AS (SELECT id FROM nodes WHERE path IS NOT NULL),
    c1 AS (SELECT a.*, row_number() OVER (ORDER BY turn) AS c FROM adj a WHERE node = 'cust:7'),
    f1 AS (SELECT other AS id, min(c) AS c, arg_min(CASE way WHEN 'outgoing' THEN '-' || type || '>' ELSE '<' || type || '-' END || other, c) AS step FROM c1 WHERE firm AND other IN (FROM n) AND other <> 'cust:7' GROUP BY other),
    q1 AS (SELECT id, 'cust:7' || step AS path, row_number() OVER (ORDER BY c) AS place FROM f1),
    c2 AS (SELECT a.*, q.path, row_number() OVER (ORDER BY q.place, a.turn) + (SELECT count(*) FROM c1) AS c FROM adj a JOIN q1 q ON q.id = a.node),
    f2 AS (SELECT other AS id, min(c) AS c, arg_min(path || CASE way WHEN 'outgoing' THEN '-' || type || '>' ELSE '<' || type || '-' END || other, c) AS path FROM c2
           WHERE c <= 120 AND firm AND other IN (FROM n) AND other <> 'cust:7' AND other NOT IN (SELECT id FROM q1) GROUP BY other),
    q2 AS (SELECT id, path, (SELECT count(*) FROM q1) + row_number() OVER (ORDER BY c) AS place FROM f2)
    SELECT 'cust:7' AS id, 0 AS distance, 'cust:7' AS path UNION ALL SELECT id, 1, path FROM q1 WHERE place < 60 UNION ALL SELECT id, 2, path FROM q2 WHERE place < 60""")
def graph_bfs_paths(t: Tables) -> DataFrame:
    """GQ-10: the search with the way to each node; calls and references that aren't static are passed over."""
    firm = F.when(F.col("type") == "calls", F.length("target") % 2 == 0).when(F.col("type") == "references", F.length("source") % 2 == 0)
    rows = edges(t).withColumn("resolution", F.when(firm, "static").when(~firm, "dynamic"))
    found = G.path_steps(G.bounded_bfs(nodes(t), rows, ["cust:7"], depth=2, node_limit=60, edge_limit=120)[0])
    step = lambda x: F.when(x["way"] == "outgoing", F.concat(F.lit("-"), x["relation"], F.lit(">"), x["node"])).otherwise(F.concat(F.lit("<"), x["relation"], F.lit("-"), x["node"]))
    return found.select("id", "distance", F.concat("seed", F.array_join(F.transform("steps", step), "")).alias("path"))


@query("import_longest_prefix", """WITH names AS (SELECT DISTINCT replace(regexp_replace(url, '^https?://', ''), '/', '.') AS name FROM pages),
    modules AS (SELECT module, min(name) AS path FROM (SELECT name, array_to_string(list_slice(string_split(name, '.'), 1, 2), '.') AS module FROM names) GROUP BY module HAVING count(*) > 2),
    p AS (SELECT name, unnest(range(1, len(string_split(name, '.')) + 1)) AS k FROM names),
    f AS (SELECT p.name, arg_max(m.path, p.k) AS path FROM p JOIN modules m ON m.module = array_to_string(list_slice(string_split(p.name, '.'), 1, p.k), '.') GROUP BY p.name)
    SELECT n.name, coalesce(f.path, concat('external:', n.name)) AS target FROM names n LEFT JOIN f ON f.name = n.name""")
def import_longest_prefix(t: Tables) -> DataFrame:
    names = t.pages.select(F.translate(F.regexp_replace("url", "^https?://", ""), "/", ".").alias("name")).distinct()
    modules = names.groupBy(F.array_join(F.slice(F.split("name", r"\."), 1, 2), ".").alias("module")).agg(F.min("name").alias("path"), F.count(F.lit(1)).alias("n"))
    return G.longest_prefix(names, modules.where("n > 2").drop("n"))


@query("impact_neighbors", f"""{BOTH}, t AS (SELECT 'order:42' AS id, 0 AS step, 100.0 AS score),
    b AS (SELECT source AS id, 1 AS step, 1.0 AS score FROM edges WHERE type = 'imports' AND target = 'order:42'),
    f AS (SELECT target AS id, 2 AS step, 1.0 AS score FROM edges WHERE type = 'calls' AND source = 'order:42'),
    a AS (SELECT id, min(step) AS step, max(score) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM b UNION ALL SELECT * FROM f) GROUP BY id)
    SELECT a.id, CAST(a.step AS INTEGER) AS step, CAST(a.score AS DOUBLE) AS score FROM a JOIN nodes n ON n.id = a.id AND n.path IS NOT NULL ORDER BY step, a.id LIMIT 8""")
def impact_neighbors(t: Tables) -> DataFrame:
    """RET-12 and SET-02: the target, what imports it, then what it uses; internal nodes only, eight at most."""
    e = edges(t)
    rows = G.union_all([
        t.spark.createDataFrame([("order:42", 0, 100.0)], "id string, step int, score double"),
        e.where("type = 'imports' AND target = 'order:42'").select(F.col("source").alias("id"), F.lit(1).alias("step"), F.lit(1.0).alias("score")),
        e.where("type = 'calls' AND source = 'order:42'").select(F.col("target").alias("id"), F.lit(2).alias("step"), F.lit(1.0).alias("score")),
    ]).groupBy("id").agg(F.min("step").alias("step"), F.max("score").alias("score"))
    return rows.join(nodes(t).where("path IS NOT NULL").select("id"), "id", "left_semi").orderBy("step", "id").limit(8)


@query("onboard_order", f"""{BOTH}, s AS (SELECT id, path, 0 AS step FROM nodes WHERE type = 'function' AND path LIKE '%/main.py'),
    i AS (SELECT DISTINCT n.id, n.path, 1 AS step FROM edges e JOIN s ON s.id = e.source JOIN nodes n ON n.id = e.target WHERE e.type = 'imports')
    SELECT id, path, CAST(step AS INTEGER) AS step FROM (SELECT * FROM s UNION ALL SELECT * FROM i) ORDER BY step, path, id LIMIT 60""")
def onboard_order(t: Tables) -> DataFrame:
    """RET-13: entries by path, then what they import."""
    n = nodes(t)
    starts = n.where("type = 'function' AND path LIKE '%/main.py'").select("id", "path", F.lit(0).alias("step"))
    onward = edges(t).where("type = 'imports'").join(starts.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
    return starts.unionByName(n.join(onward, "id", "left_semi").select("id", "path", F.lit(1).alias("step"))).orderBy("step", "path", "id").limit(60)
