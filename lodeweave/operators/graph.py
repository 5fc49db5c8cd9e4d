"""Property-graph operators over ``nodes`` (id, type, name, path) and ``edges`` (source, target, type)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

TRAVERSABLE = ("imports", "calls", "contains", "references")
#: Ids of missing nodes that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 1 << 20
#: Groups of equal edges that a task counts, about.
MOST_GROUPS = 1 << 20
ENTRY_NAMES = ("main.py", "app.py", "cli.py", "__main__.py")


def count_by_type(items: DataFrame) -> DataFrame:
    """AGG-01."""
    return items.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def outgoing(edges: DataFrame, nodes: DataFrame, source: Column | str, types: tuple[str, ...]) -> DataFrame:
    """FLT-01 and JOI-01: edges of some types from one source, joined with their targets; dangling ones drop out, repeated ones stay."""
    found = edges.where((F.col("source") == source) & F.col("type").isin(*types)).select("source", "target", "type")
    return found.join(nodes.select(F.col("id").alias("target"), "name", "path"), "target").select("source", "target", F.col("type"), "name", "path")


def incoming(edges: DataFrame, nodes: DataFrame, target: Column | str, types: tuple[str, ...]) -> DataFrame:
    """FLT-01 and JOI-02."""
    found = edges.where((F.col("target") == target) & F.col("type").isin(*types)).select("source", "target", "type")
    return found.join(nodes.select(F.col("id").alias("source"), "name", "path"), "source").select("source", "target", F.col("type"), "name", "path")


def definitions(nodes: DataFrame, selector: str) -> DataFrame:
    """GQ-05: the node of that very id, else nodes by name, by path:name or by an id that goes on with @."""
    exact = nodes.where(F.col("id") == selector)
    loose = nodes.where((F.col("name") == selector) | F.col("id").startswith(f"{selector}@") | (F.concat_ws(":", "path", "name") == selector))
    none = exact.limit(1).select(F.lit(1).alias("hit"))
    return exact.unionByName(loose.join(none, F.lit(True), "left_anti")).select("id", "type", "name", "path")


def callers(nodes: DataFrame, edges: DataFrame, selector: str) -> DataFrame:
    """GQ-04: callers of a selector with exactly one definition."""
    found = definitions(nodes, selector).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("target")).where("n = 1")
    return edges.where("type = 'calls'").join(F.broadcast(found.select("target")), "target").select("source", "target")


def entry_candidates(nodes: DataFrame, edges: DataFrame, main: str = "main") -> DataFrame:
    """GQ-06, FLT-02 and JOI-03: files with an entry's name, and files that contain a function of the given name."""
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    holders = edges.where("type = 'contains'").join(nodes.where(F.col("name") == main).select(F.col("id").alias("target")), "target", "left_semi")
    files = nodes.where("type = 'file'")
    named = files.where(base.isin(*ENTRY_NAMES))
    return named.select("id", "path").unionByName(files.join(holders.select(F.col("source").alias("id")), "id", "left_semi").select("id", "path")).distinct()


def _ends(edges: DataFrame, *more: str) -> DataFrame:
    """Both ends of each edge: side and id, with further columns of the edge."""
    end = lambda side: F.struct(F.lit(side).alias("side"), F.col(side).alias("id"))
    return edges.select(*more, F.explode(F.array(end("source"), end("target"))).alias("end")).select(*more, "end.side", "end.id")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """FLT-10: edges with an end that is no node. Only ends' distinct ids meet the nodes; edges aren't shuffled unless more than MOST_BROADCAST ids are missing."""
    missing = stored(_ends(edges).select("id").distinct().join(nodes.select("id"), "id", "left_anti"), "missing").withColumnRenamed("id", "none")
    if missing.count() <= MOST_BROADCAST:
        missing = F.broadcast(missing)
    return _ends(edges, "source", "target", "type").join(missing, F.col("id").eqNullSafe(F.col("none"))).select("source", "target", "type", "side")


def repeated_edges(edges: DataFrame) -> DataFrame:
    """FLT-10: groups of edges that share source, target and type. Most edges are alone in theirs, so they are dealt out before they are counted, to as many tasks as keep a task's groups few."""
    tasks = math.ceil(edges.count() / MOST_GROUPS)
    if tasks > 1:
        edges = edges.repartition(max(tasks, edges.sparkSession.sparkContext.defaultParallelism), "source", "target", "type")
    return edges.groupBy("source", "target", "type").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def constraint_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """FLT-10: rule and n, how many nodes, edges or groups of them break it; one row for each rule, also where none does. An id is counted once as a node, a source and a target."""
    from ..functions.text import safe_path

    count = lambda df, rule: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
    parents = edges.where("type = 'contains'").groupBy("target").agg(F.count_distinct("source").alias("k")).where("k > 1")
    uses = nodes.select(F.lit("node").alias("side"), "id").unionByName(_ends(edges)).groupBy("id").agg(*(F.count_if(F.col("side") == side).alias(side) for side in ("node", "source", "target")))
    missing = F.col("id").isNull() | (F.col("node") == 0)
    rules = {"duplicate_node": F.count_if(F.col("node") > 1), **{f"dangling_{side}": F.coalesce(F.sum(F.when(missing, F.col(side))), F.lit(0).cast("long")) for side in ("source", "target")}}
    bad_node = {"unknown_node_type": ~F.col("type").isin("file", "class", "function", "method", "external"), "unsafe_path": F.col("path").isNotNull() & ~safe_path("path"), "missing_path": F.col("path").isNull() & (F.col("type") != "external")}
    bad_edge = {"self_loop": F.col("source") == F.col("target"), "unknown_edge_type": ~F.col("type").isin(*TRAVERSABLE, "unresolved_call")}
    wide = lambda df, rules: df.agg(*(n.alias(r) for r, n in rules.items())).select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules))).alias("x")).select("x.rule", "x.n")
    each = lambda rules: {r: F.count_if(c) for r, c in rules.items()}
    return union_all([count(repeated_edges(edges), "duplicate_edge"), count(parents, "two_parents"), wide(uses, rules), wide(nodes, each(bad_node)), wide(edges, each(bad_edge))])


def inner_edges(edges: DataFrame, room: DataFrame, limit: int) -> DataFrame:
    """SRT-05: the edges between the nodes of ``room`` (id; bounded by its own limit, so it is broadcast), in order up to ``limit``, with ``truncated``: whether there are more."""
    room = F.broadcast(stored(room, "room"))
    own = edges.join(room.select(F.col("id").alias("source")), "source", "left_semi").join(room.select(F.col("id").alias("target")), "target", "left_semi")
    order = ["source", "target", "type"]
    few = own.select(*order).orderBy(*order).limit(limit + 1).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
    more = F.max("place").over(Window.partitionBy(F.lit(1))) > limit
    return few.withColumn("truncated", more).where(F.col("place") <= limit).select(*order, "truncated")


def neighbourhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """SRT-05: the first seeds by (type, lower-cased name, id), at most ten and ``limit``; then their neighbours by id, until ``limit`` nodes are reached."""
    few = min(10, limit)
    first = seeds.orderBy("type", F.lower("name"), "id").limit(few).select("id", F.lit(0).alias("ring"))
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("other")))
    near = both.join(F.broadcast(first.select("id")), "id", "left_semi").select(F.col("other").alias("id")).distinct()
    near = near.join(first.select("id"), "id", "left_anti").join(nodes.select("id"), "id", "left_semi").select("id", F.lit(1).alias("ring"))
    room = first.unionByName(near.orderBy("id").limit(limit)).orderBy("ring", "id").limit(limit)
    return room.join(nodes, "id").select("id", "type", "name", "ring")


def reachable(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """Least number of steps from ``start`` to each node, up to ``depth``; a level is a join of its frontier with the edges, stored once, and each node is kept at its first level only. The edges are stored once for all levels; only a frontier's own ends are made distinct."""
    edges = stored(edges.select("source", "target"), "edges")
    levels = [edges.sparkSession.createDataFrame([(start, 0)], "id string, distance int")]
    for level in range(1, depth + 1):
        onward = edges.join(levels[-1].select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
        fresh = stored(onward.join(union_all(levels).select("id"), "id", "left_anti").select("id", F.lit(level).alias("distance")), "frontier")
        if not fresh.limit(1).count():
            break
        levels.append(fresh)
    return union_all(levels)


def adjacency(edges: DataFrame, at: DataFrame) -> DataFrame:
    """GQ-09: the edges of the nodes of ``at`` (node, queue), in both directions; each node's own are ordered by source, target, type, outgoing first. ``at`` is bounded by a search's limits, so it is broadcast and the graph isn't shuffled."""
    at = F.broadcast(at)
    out = edges.join(at, F.col("source") == F.col("node")).withColumns({"other": F.col("target"), "way": F.lit("outgoing")})
    back = edges.join(at, F.col("target") == F.col("node")).withColumns({"other": F.col("source"), "way": F.lit("incoming")})
    return out.unionByName(back)


def bounded_bfs(nodes: DataFrame, edges: DataFrame, seeds: list[str], depth: int = 2, node_limit: int = 32, edge_limit: int = 128, direction: str = "both") -> tuple[DataFrame, dict]:
    """GQ-10: breadth-first search that checks edges in queue order under limits: (id, distance, turn of discovery, parent, relation, way) and its counts.

    A level is one ordered limit over its frontier's edges and windows over what that leaves, which is bounded by ``edge_limit``, never by the graph. Every
    check counts before it is judged: a wrong direction is passed over; a type that isn't traversed, a call or reference that isn't static (where edges
    have a resolution) and an end without a path are unknown; of the first checks of unseen nodes as many are taken as there is room for, and the one beyond ends the search.
    """
    if not (0 <= depth <= 4 and 1 <= node_limit <= 256 and 1 <= edge_limit <= 4096 and direction in {"both", "incoming", "outgoing"}):
        raise ValueError("bounds: depth 0..4, nodes 1..256, edges 1..4096, direction both, incoming or outgoing")
    spark, order = edges.sparkSession, ["queue", "source", "target", "type", F.desc("way")]
    whole = Window.partitionBy(F.lit(1))
    paths = nodes.where(F.col("path").isNotNull()).select(F.col("id").alias("other"))
    first = sorted(set(seeds))[:node_limit]
    shape = "id string, distance int, turn int, parent string, relation string, way string"
    seen = [spark.createDataFrame([(n, 0, i, None, None, None) for i, n in enumerate(first)], shape)]
    stats = {"edge_checks": 0, "unknown_relations": 0, "limited": False, "visited_nodes": len(first), "depth_reached": 0}
    firm = F.lit(True) if "resolution" not in edges.columns else ~F.col("type").isin("calls", "references") | F.coalesce(F.col("resolution") == "static", F.lit(False))
    for level in range(1, depth + 1):
        rest, room = edge_limit - stats["edge_checks"], node_limit - stats["visited_nodes"]
        frontier = seen[-1].select(F.col("id").alias("node"), F.col("turn").alias("queue"))
        checks = adjacency(edges, frontier).orderBy(*order).limit(rest + 1).withColumn("check", F.row_number().over(whole.orderBy(*order)))
        checks = stored(checks.withColumn("firm", firm).select("check", "node", "other", "type", "way", "firm"), "checks")
        known = paths.join(F.broadcast(checks.select("other").distinct()), "other", "left_semi").distinct().withColumn("known", F.lit(True))
        judged = checks.join(F.broadcast(known), "other", "left").join(F.broadcast(union_all(seen).select(F.col("id").alias("other"), F.lit(True).alias("visited"))), "other", "left")
        turned = F.lit(direction != "both") & (F.col("way") != direction)
        verdict = F.when(turned, "passed").when(~F.col("type").isin(*TRAVERSABLE) | ~F.col("firm") | F.col("known").isNull(), "unknown").when(F.col("visited"), "visited").otherwise("new")
        judged = stored(judged.withColumn("verdict", verdict), "judged")
        fresh = judged.where((F.col("verdict") == "new") & (F.col("check") <= rest)).groupBy("other").agg(F.min(F.struct("check", "node", "type", "way")).alias("by"))
        fresh = fresh.withColumn("place", F.row_number().over(whole.orderBy("by.check")))
        found = stored(fresh.where(F.col("place") <= room + 1).select(F.col("other").alias("id"), F.lit(level).alias("distance"), (F.col("place") - 1 + stats["visited_nodes"]).cast("int").alias("turn"), F.col("by.node").alias("parent"), F.col("by.type").alias("relation"), F.col("by.way").alias("way"), "place", "by.check"), "found")
        taken, cut = found.agg(F.count_if(F.col("place") <= room), F.min(F.when(F.col("place") > room, F.col("check")))).head()
        last = min(rest, cut or rest)
        total, unknown = judged.agg(F.count(F.lit(1)), F.count_if((F.col("verdict") == "unknown") & (F.col("check") <= last))).head()
        stats["edge_checks"] += min(total, last)
        stats["unknown_relations"] += unknown
        stats["limited"] = cut is not None or total > rest
        if taken:
            stats["visited_nodes"] += taken
            stats["depth_reached"] = level
            seen.append(found.where(F.col("place") <= room).select("id", "distance", "turn", "parent", "relation", "way"))
        if stats["limited"] or not taken:
            break
    return union_all(seen), stats


def path_steps(found: DataFrame) -> DataFrame:
    """GQ-10: each node of a bounded search with its path: id, distance, turn, seed, steps (array of node, relation, way: how each step was taken, from the seed on).

    Parents are followed back level by level, at most four times, over what the search found, which its node limit bounds.
    """
    found = F.broadcast(stored(found.select("id", "distance", "turn", "parent", "relation", "way"), "found"))
    step = F.struct(F.col("id").alias("node"), "relation", "way")
    rows = found.select("id", "distance", "turn", F.col("parent").alias("at"), F.when(F.col("parent").isNotNull(), F.array(step)).otherwise(F.array().cast("array<struct<node:string,relation:string,way:string>>")).alias("steps"), F.when(F.col("parent").isNull(), F.col("id")).alias("seed"))
    up = found.select(F.col("id").alias("at"), F.col("parent").alias("next"), step.alias("step"))
    for _ in range(4):
        rows = rows.join(up, "at", "left").select(
            "id", "distance", "turn", F.col("next").alias("at"), F.when(F.col("next").isNotNull(), F.concat(F.array("step"), "steps")).otherwise(F.col("steps")).alias("steps"),
            F.coalesce("seed", F.when(F.col("next").isNull(), F.col("at"))).alias("seed"),
        )
    return rows.select("id", "distance", "turn", "seed", "steps")


def longest_prefix(names: DataFrame, modules: DataFrame) -> DataFrame:
    """JOI-04: each dotted name's longest prefix that is a module, else external: and the name. ``names`` (name), ``modules`` (module, path)."""
    parts = F.split("name", r"\.")
    prefixes = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, F.lit(1), k), ".").alias("module")))).alias("p"))
    found = prefixes.select("name", "p.k", "p.module").join(modules, "module").groupBy("name").agg(F.max_by("path", "k").alias("path"))
    return names.join(found, "name", "left").select("name", F.coalesce("path", F.concat(F.lit("external:"), F.col("name"))).alias("target"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
