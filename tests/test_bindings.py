"""Lexical facts and the calls that joins bind, against expected rows of a small tree."""

import pytest

from lodeweave.operators.bindings import bound_graph, import_targets, resolve_calls
from lodeweave.sources.lexical import lexical_facts
from lodeweave.sources.python_source import file_facts
from lodeweave.sources.syntax import syntax_nodes

TREE = {
    "pkg/__init__.py": "from .a import helper\n",
    "pkg/a.py": "def helper():\n    return 1\n\nclass Box:\n    def __init__(self, n):\n        self.n = n\n    def get(self):\n        return self.deep()\n    def deep(self):\n        return helper()\n",
    "pkg/b.py": "from pkg import helper as h\nfrom .a import Box\nimport pkg.a\nimport os.path\n\ndef run():\n    h()\n    pkg.a.helper()\n    box = Box(2)\n    box.get()\n    box.missing()\n    other = box\n    other.deep()\n    os.path.join('a')\n    (lambda: h())()\n    nowhere()\n",
    "pkg/c.py": "from pkg.d import x\nif True:\n    def maybe(): pass\nmaybe()\nx()\ndef twice(): pass\ndef twice(): pass\ntwice()\nlate()\ndef late(): pass\ndef deco(f): return f\n@deco\ndef made(): pass\nmade()\n",
    "pkg/d.py": "from pkg.c import x\n",
    "pkg/e.py": "def f(): pass\neval('1')\nf()\n",
    "pkg/g.py": "class Pot:\n    def put(self): pass\n    @staticmethod\n    def make(): pass\ndef use(k):\n    p = Pot()\n    k(p)\n    p.put()\n    k.put()\n    Pot.make()\n    a = b\n    b = a\n    a()\n",
    "pkg/bad.py": "def (:\n",
}


@pytest.fixture(scope="module")
def facts(spark):
    return lexical_facts(spark.createDataFrame(list(TREE.items()), "path string, content string"))


def test_facts(facts):
    rows = facts.collect()
    assert [r["path"] for r in rows if r["kind"] == "unparsed"] == ["pkg/bad.py"]
    assert {(r["name"], r["tag"], r["flag"]) for r in rows if r["kind"] == "method"} >= {("self", "instance", True), (None, "staticmethod", True)}
    assert {(r["path"], r["name"]) for r in rows if r["kind"] == "definition" and r["flag"]} == {("pkg/c.py", "maybe")}
    assert [r["more"] for r in rows if r["kind"] == "definition" and r["name"] == "made"] == [["decorated"]]
    assert {tuple(r["parts"]) for r in rows if r["kind"] == "mutation"} == {("self",)}
    assert {r["name"] for r in rows if r["kind"] == "escape" and r["path"] == "pkg/g.py"} == {"p"}
    opaque = [r for r in rows if r["kind"] == "scope" and r["tag"] == "opaque"]
    assert [r["parts"] for r in opaque] == [["<module>/run[1]"]]


def test_calls(facts):
    found = {(r["path"][4:-3], r["start_line"], r["expression"]): (r["resolution"], r["basis"], r["target_id"]) for r in resolve_calls(facts).collect()}
    chain, flow, own = "import_binding_chain", "nominal_receiver_or_alias_binding", "unique_same_module_lexical_definition"
    deferred = "receiver_or_dynamic_expression_deferred"
    assert found == {
        ("a", 8, "self.deep"): ("static", flow, "method:pkg/a.py:Box.deep"),
        ("a", 10, "helper"): ("static", own, "func:pkg/a.py:helper"),
        ("b", 7, "h"): ("static", chain, "func:pkg/a.py:helper"),
        ("b", 8, "pkg.a.helper"): ("static", chain, "func:pkg/a.py:helper"),
        ("b", 9, "Box"): ("static", chain, "class:pkg/a.py:Box"),
        ("b", 10, "box.get"): ("static", flow, "method:pkg/a.py:Box.get"),
        ("b", 11, "box.missing"): ("unknown", "instance_attribute_not_bound", None),
        ("b", 13, "other.deep"): ("static", flow, "method:pkg/a.py:Box.deep"),
        ("b", 14, "os.path.join"): ("unknown", "module_not_in_snapshot", None),
        ("b", 15, "lambda: h()"): ("unknown", deferred, None),
        ("b", 15, "h"): ("unknown", "opaque_scope", None),
        ("b", 16, "nowhere"): ("unknown", "name_not_bound_in_module", None),
        ("c", 4, "maybe"): ("unknown", "conditional_or_decorated_definition", None),
        ("c", 5, "x"): ("unknown", "cyclic_import_binding", None),
        ("c", 8, "twice"): ("ambiguous", "multiple_lexical_definitions", None),
        ("c", 9, "late"): ("unknown", "definition_not_available_at_site", None),
        ("c", 14, "made"): ("unknown", "conditional_or_decorated_definition", None),
        ("e", 2, "eval"): ("unknown", "dynamic_or_nonlocal_namespace", None),
        ("e", 3, "f"): ("unknown", "dynamic_or_nonlocal_namespace", None),
        ("g", 6, "Pot"): ("static", own, "class:pkg/g.py:Pot"),
        ("g", 7, "k"): ("unknown", "binding_not_a_unique_definition", None),
        ("g", 8, "p.put"): ("unknown", "receiver_escaped", None),
        ("g", 9, "k.put"): ("unknown", deferred, None),
        ("g", 10, "Pot.make"): ("static", flow, "method:pkg/g.py:Pot.make"),
        ("g", 13, "a"): ("unknown", "assignment_not_available_at_site", None),
    }


def test_imports_and_edges(spark, facts):
    found = {(r["source"], r["name"], r["target"]) for r in import_targets(facts).collect()}
    assert {("file:pkg/b.py", "h", "file:pkg/__init__.py"), ("file:pkg/b.py", "Box", "file:pkg/a.py"), ("file:pkg/b.py", "os", "external:os.path")} <= found
    assert ("file:pkg/b.py", "pkg", "file:pkg/a.py") in found
    empty = lexical_facts(spark.createDataFrame([], "path string, content string"))
    assert resolve_calls(empty).count() == 0 and bound_graph(empty).count() == 0


def test_files_are_parsed_in_every_partition(spark):
    """Small texts that lie in one partition are dealt out before they are parsed."""
    files = spark.createDataFrame(list(TREE.items()), "path string, content string").coalesce(1)
    assert syntax_nodes(files).rdd.getNumPartitions() == 4
    assert file_facts(files).rdd.getNumPartitions() == 4


def test_nodes_know_what_holds_them(spark):
    """A definition holds its body alone, a lambda all of itself; statements that may not run are counted above a node."""
    text = "def f(a=g()):\n    if a:\n        h(lambda x: x.y.z)\n"
    rows = syntax_nodes(spark.createDataFrame([("m.py", text)], "path string, content string"), ("Module", "Lambda"), ("FunctionDef",), ("If",)).collect()
    kind = {r["id"]: r["type"] for r in rows}
    held = {(r["segment"] or r["attrs"].get("id") or r["type"]): (kind[r["within"]], r["chances"]) for r in rows}
    assert held["g"] == ("Module", 0) and held["FunctionDef"] == ("Module", 0) and held["If"] == ("FunctionDef", 0)
    assert held["a"] == ("FunctionDef", 1) and held["h"] == ("FunctionDef", 1) and held["Lambda"] == ("Lambda", 1) and held["x"] == ("Lambda", 1)
    assert ["x", "y", "z"] in [r["dotted"] for r in rows]


def test_pieces_that_read_alike_are_parsed_once():
    """Files are cut before definitions at their left edge; a cut that isn't between statements is undone."""
    from lodeweave.sources import python_source, syntax

    memo = syntax.Memo()
    text = "import a.b\n@d\ndef f():\n    g(1)\nclass C:\n    def m(self): h()\ndef k():\n    pass\n"
    assert len(syntax.pieces(text)) == 4
    assert python_source._file(text, memo)["calls"] == [{"caller": "f", "callee": "g", "place": 0}, {"caller": "C.m", "callee": "h", "place": 0}]
    known = dict(memo.known)
    assert python_source._file("x = 1\n" + text[text.index("@d") :], memo)["functions"] == ["f", "k"]
    assert [k for k in memo.known if k not in known] == ["x = 1\n"]
    inside = 'x = """\ndef f():\n    pass\n"""\n'
    assert len(syntax.pieces(inside)) == 2 and python_source._file(inside, memo)["functions"] == []
    assert python_source._file("def (:\n", memo) is None


def test_facts_come_without_a_shuffle(spark):
    """After the files are dealt out a file's facts need no other row; repeated definitions are numbered through the file, and lines are those of the file."""
    files = spark.createDataFrame([("a.py", "import x\ndef f(): pass\ndef f(): pass\nclass C:\n    f = [g(y) for y in z if y is None]\n"), ("b.py", "def f(): pass\n")], "path string, content string")
    facts = lexical_facts(files)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    rows = facts.collect()
    assert {(r["path"], r["key"], r["start_line"]) for r in rows if r["kind"] == "definition"} == {("a.py", "<module>/f[1]", 2), ("a.py", "<module>/f[2]", 3), ("a.py", "<module>/C[1]", 4), ("b.py", "<module>/f[1]", 1)}
    assert {(r["key"], r["scope"]) for r in rows if r["kind"] == "scope" and r["tag"] == "opaque"} == {("<module>/C[1]/@ListComp[5:8]", "<module>/C[1]")}
    assert [r["name"] for r in rows if r["kind"] == "escape"] == ["y"]


def test_stored_facts_are_not_copied(spark, facts):
    """Facts that are a table already are read from it, and the session's settings are as before."""
    import glob

    from lodeweave.operators.store import stored

    own, name = stored(facts, "facts", "kind"), "spark.sql.requireAllClusterKeysForCoPartition"
    copies, before = f"{spark.conf.get('spark.checkpoint.dir')}/facts-*", spark.conf.get(name)
    n = len(glob.glob(copies))
    assert resolve_calls(own).count() == facts.where("kind = 'call'").count()
    assert len(glob.glob(copies)) == n and spark.conf.get(name) == before
