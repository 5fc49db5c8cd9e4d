"""Operators that SQL doesn't express, against plain versions on small inputs."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodeweave.functions.text import lines, mentions, normal_path, safe_path, tokens
from lodeweave.operators import graph, memory, retrieval, traces
from lodeweave.sources import python_source, text_source


def plain_bfs(nodes, edges, seeds, depth, node_limit, edge_limit, direction):
    adjacent = {}
    for s, t, k in sorted(edges):
        adjacent.setdefault(s, []).append((s, t, k, 1, "outgoing", t))
        adjacent.setdefault(t, []).append((s, t, k, 2, "incoming", s))
    seen = {n: 0 for n in sorted(set(seeds))[:node_limit]}
    paths = {n: (n,) for n in seen}
    queue, checks, unknown, limited = list(seen), 0, 0, False
    while queue and not limited:
        node = queue.pop(0)
        if seen[node] >= depth:
            continue
        for _, _, kind, _, way, other in sorted(adjacent.get(node, []), key=lambda e: e[:4]):
            if checks >= edge_limit:
                limited = True
                break
            checks += 1
            if direction not in ("both", way):
                continue
            if kind not in graph.TRAVERSABLE or not nodes.get(other):
                unknown += 1
            elif other not in seen:
                if len(seen) >= node_limit:
                    limited = True
                    break
                seen[other] = seen[node] + 1
                paths[other] = (*paths[node], (other, kind, way))
                queue.append(other)
    return seen, checks, unknown, limited, paths


def test_bounded_bfs(spark):
    rng = random.Random(3)
    for _ in range(6):
        n = rng.randint(2, 9)
        nodes = {f"n{i}": rng.random() < 0.8 and f"p{i}" or None for i in range(n)}
        edges = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n + 1)}", rng.choice(["calls", "imports", "unresolved_call"])) for _ in range(2 * n)}
        depth, most, checks, way = rng.randint(0, 4), rng.randint(1, 6), rng.randint(1, 12), rng.choice(["both", "incoming", "outgoing"])
        n_df = spark.createDataFrame([(k, "function", k, p) for k, p in nodes.items()], "id string, type string, name string, path string")
        e_df = spark.createDataFrame(sorted(edges), "source string, target string, type string")
        found, stats = graph.bounded_bfs(n_df, e_df, ["n0", "n1"], depth, most, checks, way)
        seen, c, u, limited, paths = plain_bfs(nodes, edges, ["n0", "n1"], depth, most, checks, way)
        assert [(r["id"], r["distance"]) for r in found.orderBy("turn").collect()] == list(seen.items())
        assert (stats["edge_checks"], stats["unknown_relations"], stats["limited"]) == (c, u, limited)
        assert {r["id"]: (r["seed"], *map(tuple, r["steps"])) for r in graph.path_steps(found).collect()} == paths


def test_fixed_window_limit(spark):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), start + dt.timedelta(seconds=rng.randrange(400)), i) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long")
    got = {r["id"]: r["admitted"] for r in traces.fixed_window_limit(df, ["key"], "ts", 3, 60, ["id"]).collect()}
    for key in "ab":
        opened, used = None, 0
        for _, at, i in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if opened is None or (at - opened).total_seconds() >= 60:
                opened, used = at, 0
            used += 1
            assert got[i] == (used <= 3)


def test_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.choice(["s", "f", "x"])) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, id long, kind string")
    kind = F.col("kind")
    got = {(r[0], r[1], r[2]) for r in traces.paired_lifo(df, "key", ["id"], kind == "s", kind == "f", "id").collect()}
    expected = set()
    for key in "ab":
        stack = []
        for _, i, k in (r for r in rows if r[0] == key):
            if k == "s":
                stack.append(i)
            elif k == "f" and stack:
                expected.add((key, stack.pop(), i))
    assert got == expected


def test_pack_evidence(spark):
    rows = [("q", 1, "a", 1, 5, False, 50), ("q", 2, "a", 1, 5, False, 50), ("q", 3, "a", 4, 9, False, 50), ("q", 4, "a", 20, 30, False, 900), ("q", 5, "a", 40, 50, False, 10), ("q", 6, "b", 1, 2, True, 400), ("q", 7, "c", 1, 2, False, 10)]
    df = spark.createDataFrame(rows, "query string, position int, path string, start_line int, end_line int, exact boolean, cost long")
    got = {r["position"]: r["reason"] for r in retrieval.pack_evidence(df, 600, limit=6).collect()}
    assert got == {1: "kept", 2: "overlap", 3: "overlap", 4: "token_budget", 5: "kept", 6: "kept", 7: "kept"}


def plain_pack(items, budget, limit=6, per_file=2):
    """One item after the other, on whole rendered packs."""
    import json

    aside = set()
    while True:
        kept, done = [], []
        for x in items:
            same = [k for k in kept if k["path"] == x["path"]]
            if x["position"] in aside:
                reason = "token_budget"
            elif any((k["start_line"], k["end_line"]) == (x["start_line"], x["end_line"]) for k in same):
                reason = "overlap"
            elif len(kept) >= limit:
                reason = "item_limit"
            elif not x["exact"] and any(k["start_line"] <= x["end_line"] and k["end_line"] >= x["start_line"] for k in same):
                reason = "overlap"
            elif not x["exact"] and len(same) >= per_file:
                reason = "file_diversity"
            else:
                reason = "kept"
                kept.append(x)
            done.append((x, reason))
        gone = [(x, r) for x, r in done if r != "kept"]

        def cost(shown):
            dumps = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"))
            lines = [f"{x['path']}:{x['start_line']}-{x['end_line']}" for x in kept]
            tool = sum(len(dumps({k: x[k] for k in ("path", "start_line", "end_line", "exact", "text")}).encode()) + len(line.encode()) + 2 for x, line in zip(kept, lines, strict=True)) + len(kept) + 1
            blocks = "".join(f"[{line}]\n{x['text']}\n" for x, line in zip(kept, lines, strict=True))
            listed = [{k: x[k] for k in ("path", "start_line", "end_line")} | {"reason": r} for x, r in gone[:shown]]
            summary = {"budget": budget, "selected": len(kept), "discarded_count": len(gone), "discarded": listed, "reasons": {r: sum(g == r for _, g in gone) for r in retrieval.DISCARDED}}
            return 512 + max(tool, len((blocks + dumps(summary)).encode()))

        if cost(0) <= budget or not kept:
            shown = max([k for k in range(min(20, len(gone)) + 1) if cost(k) <= budget], default=0)
            return [(x["position"], x["path"], r, cost(shown), shown) for x, r in done]
        largest = max([x for x in kept if not x["exact"]] or kept, key=lambda x: (len(json.dumps({k: x[k] for k in ("path", "start_line", "end_line", "exact", "text")}, ensure_ascii=False, separators=(",", ":")).encode()) + len(f"{x['path']}:{x['start_line']}-{x['end_line']}".encode()), x["position"]))
        aside.add(largest["position"])


def test_pack_rendered(spark):
    rng = random.Random(11)
    rows, expected = [], []
    budgets = (700, 1500, 2500, 9000)
    for q in range(12):
        items = []
        for position in range(1, rng.randint(2, 28)):
            start = rng.randrange(1, 40)
            items.append({"position": position, "path": f"p/{rng.choice('abcde')}.py", "start_line": start, "end_line": start + rng.choice([0, 3, 8]), "exact": rng.random() < 0.2, "text": rng.choice(["x", "é\n", 'q"']) * rng.randrange(160)})
        rows += [(f"q{q}", *x.values()) for x in items]
        expected += [(b, f"q{q}", *x) for b in budgets for x in plain_pack(items, b)]
    df = spark.createDataFrame(rows, "query string, position int, path string, start_line int, end_line int, exact boolean, text string")
    costs = retrieval.rendered_costs(df).drop("text")
    got = [(b, *r) for b in budgets for r in retrieval.pack_rendered(costs, b).collect()]
    assert sorted(got) == sorted(expected) and {r for *_, r, _, _ in expected} == {"kept", *retrieval.DISCARDED}


def test_marks_keep_unlike_sets_from_pairing(spark, monkeypatch):
    """Sets that share their rarest words alone meet, but aren't pairs to fetch words for."""
    rows = [(k, [f"rare{j}" for j in range(6)] + [f"w{k}x{j}" for j in range(60)]) for k in range(20)] + [(50, [f"w{j}" for j in range(40)]), (51, [f"w{j}" for j in range(39)])]
    sizes, store = {}, memory.stored

    def stored(df, name):
        out = store(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(memory, "stored", stored)
    got = [(r["a"], r["b"], r["similarity"]) for r in memory.near_pairs(spark.createDataFrame(rows, "id long, words array<string>"), "id", "words", 0.5).collect()]
    assert got == [(50, 51, 0.975)]
    assert sizes["pairs"] == 1


def test_near_pairs(spark):
    rng = random.Random(5)
    sets = {i: rng.sample(range(12), rng.randint(1, 8)) for i in range(60)}
    df = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in sets.items()], "id long, words array<string>")
    got = {(r["a"], r["b"]) for r in memory.near_pairs(df, "id", "words", 0.7).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and round(len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}), 6) >= 0.7}


def plain_on_cycles(pairs):
    left = set(pairs)
    while (kept := {(a, b) for a, b in left if b in {x for x, _ in left}}) != left:
        left = kept
    return {a for a, _ in left}


def test_on_cycles(spark):
    """Chains of more than six edges peel off whole; what is left is on a cycle, or needs a task that is."""
    chain = [(i, i + 1) for i in range(1, 12)]
    ring = [(100, 101), (101, 102), (102, 100), (103, 100), *((i, i + 1) for i in range(90, 100)), (102, 5), (7, 7_000), (200, 200)]
    for pairs in (chain, [*chain, *ring], [(1, 1)], []):
        got = [r["id"] for r in memory.on_cycles(spark.createDataFrame(pairs, "id long, needs long")).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_on_cycles(pairs)
    assert memory.on_cycles(spark.createDataFrame(chain, "id long, needs long")).count() == 0


def test_cycles_of_orders(spark):
    from lodeweave.plans import memory as plans
    from lodeweave.plans.registry import Tables

    folder = "/root/testdata/sf0.001"
    pairs = {(r["id"], r["needs"]) for r in plans.tasks(Tables(spark, folder))[1].collect()}
    found = plain_on_cycles(pairs)
    assert 0 < len(found) < len({a for a, _ in pairs})
    assert {r["id"] for r in plans.dag_cycle_tasks(Tables(spark, folder)).collect()} == found


def test_text_functions(spark):
    df = spark.createDataFrame([("a\nb\n", "./src\\x.py see src/x.py."), ("", ""), ("x", None)], "t string, m string")
    assert [r[0] for r in df.select(lines("t")).collect()] == [["a", "b"], [], ["x"]]
    row = df.select(tokens("m"), mentions("m", "src/x.py"), mentions(F.lit("see src/x.py"), "x.py"), normal_path("m", True)).head()
    assert row[0] == ["/src/x", "py", "see", "src/x"] and row[1] and not row[2] and row[3].startswith("src/x.py")
    paths = spark.createDataFrame([("a/b.py",), ("/a",), ("a//b",), ("../a",), ("c:/a",)], "p string")
    assert [r[0] for r in paths.select(safe_path("p")).collect()] == [True, False, False, False, False]


def test_segments(spark):
    rng = random.Random(7)
    bodies = ["ab\n" * 20 + "x" * 50, "", None, "\n", "\n" * 45, "x" * 20, "x" * 40, "x" * 41 + "\n", *("".join(rng.choice("ab\n" if rng.random() < 0.5 else "é ") for _ in range(rng.randrange(200))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, text string")
    rows = text_source.segments(df, "id", 33).collect()
    for i, body in enumerate(bodies):
        body, at, expected = body or "", 0, []
        while at < len(body) or not expected:
            stop = min(at + 20, len(body))
            if stop < len(body) and (feed := body.rfind("\n", at, stop)) >= 0:
                stop = feed + 1
            expected.append((len(expected), at, stop, text_source.PREFIX + body[at:stop]))
            at = stop
        own = sorted((r["segment"], r["start_offset"], r["end_offset"], r["text"]) for r in rows if r["id"] == i)
        assert own == expected and {r["segments"] for r in rows if r["id"] == i} == {len(expected)}


def test_python_facts(spark):
    code = "import os.path\nfrom .util import helper as h\n\ndef f(x):\n    h(x).go()\n    os.path.join(x)\n\nclass A(Base):\n    def m(self):\n        self.n()\n        f(1)\n        def inner():\n            hidden()\n\nif '__main__' == __name__:\n    f(2)\n"
    files = spark.createDataFrame([("pkg/a.py", code), ("pkg/util.py", "def helper(x):\n    return x\n"), ("pkg/bad.py", "def (")], "path string, content string")
    facts = python_source.file_facts(files)
    row = facts.where("path = 'pkg/a.py'").head()
    assert row["imports"] == ["os.path", ".util.helper"] and row["functions"] == ["f"] and row["has_main_guard"]
    assert [(c["caller"], c["callee"]) for c in row["calls"]] == [("f", "go"), ("f", "h"), ("f", "os.path.join"), ("A.m", "self.n"), ("A.m", "f")]
    assert not facts.where("path = 'pkg/bad.py'").head()["parsed"]
    edges = {(r["source"], r["target"], r["type"]) for r in python_source.graph_edges(facts).collect()}
    assert ("file:pkg/a.py", "file:pkg/util.py", "imports") in edges and ("file:pkg/a.py", "external:os.path", "imports") in edges
    assert ("method:pkg/a.py:A.m", "func:pkg/a.py:f", "calls") in edges and ("class:pkg/a.py:A", "method:pkg/a.py:A.m", "contains") in edges


def test_scan_files(spark, tmp_path):
    for name in ("a.py", "pkg/b.py", "venv/c.py", "pkg/d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    assert sorted(r["path"] for r in text_source.scan_files(spark, str(tmp_path)).collect()) == ["a.py", "pkg/b.py"]


def test_capped(spark):
    from lodeweave.operators import evidence

    rows = [("a", 1, 5), ("a", 2, 7), ("a", 3, 4), ("a", 4, 1), ("b", 1, 20), ("b", 2, 3)]
    got = evidence.capped(spark.createDataFrame(rows, "key string, turn int, size int"), "key", ["turn"], "size", 10).collect()
    assert sorted((r["key"], r["turn"]) for r in got) == [("a", 1), ("a", 3), ("a", 4), ("b", 2)]


def _exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count(" Exchange hashpartitioning")


def test_dangling_and_constraints(spark, monkeypatch):
    """Ends that are no nodes, one of them null, and repeated ids; edges don't move to find them while few ids are missing."""
    nodes = spark.createDataFrame([("a", "file", "a", "a"), ("b", "file", "b", "b"), ("b", "file", "b", "b")], "id string, type string, name string, path string")
    rows = [("a", "b", "calls"), ("a", "b", "calls"), ("a", "x", "calls"), ("y", "x", "imports"), ("y", "b", "contains"), ("a", "b", "contains"), ("a", None, "calls")]
    edges = spark.createDataFrame(rows, "source string, target string, type string")
    expected = [("a", None, "calls", "target"), ("a", "x", "calls", "target"), ("y", "b", "contains", "source"), ("y", "x", "imports", "source"), ("y", "x", "imports", "target")]
    order = lambda found: sorted(map(tuple, found.collect()), key=str)
    found = graph.dangling(edges, nodes)
    assert order(found) == sorted(expected, key=str) and _exchanges(found) == 0
    counts = dict(map(tuple, graph.constraint_counts(nodes, edges).collect()))
    assert {k: n for k, n in counts.items() if n} == {"duplicate_node": 1, "duplicate_edge": 1, "dangling_source": 2, "dangling_target": 3, "two_parents": 1} and len(counts) == 10
    monkeypatch.setattr(graph, "MOST_BROADCAST", 0)
    monkeypatch.setattr(graph, "MOST_GROUPS", 2)
    assert order(graph.dangling(edges, nodes)) == sorted(expected, key=str)
    repeated = graph.repeated_edges(edges)
    assert list(map(tuple, repeated.collect())) == [("a", "b", "calls", 2)] and "REPARTITION_BY_NUM" in repeated._jdf.queryExecution().toString()


def test_payloads_are_parsed_once(spark):
    """Every rule reads the same variant, of odd payloads too."""
    from lodeweave.operators import payloads

    rows = [(1, "llm_started", None), (2, "llm_started", "[1]"), (3, None, '{"purpose":"plan"}'), (4, "llm_started", '{"purpose":"plan","x":1}'), (5, "llm_finished", '{"purpose":"plan","success":false,"fallback_used":1}'), (6, "guess", "{")]
    found = payloads.payload_violations(spark.createDataFrame(rows, "id long, kind string, payload string"), "id", "kind", "payload")
    expected = [(1, "not_json"), (2, "not_json"), (3, "type"), (4, "unexpected:x"), (5, "bad:fallback_used"), (5, "failure_without_error"), (6, "not_json"), (6, "type")]
    assert sorted(map(tuple, found.collect())) == expected
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
