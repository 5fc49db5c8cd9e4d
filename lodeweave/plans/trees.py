"""A source tree written from the tables: a module for every fifty parts, and for each customer's orders (by stretches of their keys) one that calls them; what is known of it without parsing is the SQL of the queries.

An order is a function; its line items call their parts through a module, through an alias, or call a function of the same file, or one that nothing defines. Urgent orders use an object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..api import Project
from ..operators import bindings, graph_rules
from ..operators.store import stored
from ..sources import lexical, python_source
from .registry import Tables, query

#: The lines between a file's imports and its first order.
HEAD = ("def helper(n):", "    return n", "def show(x):", "    helper(x)", "class Cart:", "    def __init__(self, n):", "        self.n = n", "    def add(self, n):", "        return self.total(n)", "    def total(self, n):", "        return n")
#: Parts of a module, and keys of orders in a file's stretch.
PARTS, STRETCH = 50, 16384


def _lines(items: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """``items``' lines (column text) in order, as an array for each of ``by``."""
    return items.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]).alias(name))


def source_tree(t: Tables) -> DataFrame:
    """path and content of the tree's files. Each file is put together from bounded pieces: fifty parts, or a stretch of one customer's order keys."""
    key = lambda c: F.col(c).cast("string")
    inits = t.nation.select(F.explode(F.array(F.lit("shop/__init__.py"), F.lit("shop/parts/__init__.py"), F.concat(F.lit("shop/n"), key("n_nationkey"), F.lit("/__init__.py")))).alias("path")).distinct().withColumn("content", F.lit(""))
    module = F.floor(F.col("p_partkey") / PARTS).alias("m")
    parts = t.part.select("p_partkey", module, F.format_string("def part_%d(n):\n    return n\n", F.col("p_partkey").cast("long")).alias("text"))
    parts = _lines(parts, ["m"], "p_partkey", "lines").select(F.concat(F.lit("shop/parts/m"), key("m"), F.lit(".py")).alias("path"), F.array_join("lines", "").alias("content"))

    orders = t.orders.select("o_custkey", "o_orderkey", F.floor(F.col("o_orderkey") / STRETCH).alias("b"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    items = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").cast("string").alias("p"), F.floor(F.col("l_partkey") / PARTS).cast("string").alias("m"), (F.col("l_linenumber") % 4).alias("form"), F.col("l_quantity").cast("long").cast("string").alias("q"))
    callee = F.when(F.col("form") == 1, F.concat(F.lit("m"), "m", F.lit(".part_"), "p")).when(F.col("form") == 2, F.concat(F.lit("p"), "p")).when(F.col("form") == 3, "helper").otherwise(F.concat(F.lit("missing_"), "p"))
    items = stored(items.join(orders.select("o_orderkey", "o_custkey", "b"), "o_orderkey").withColumn("text", F.concat(F.lit("    "), callee, F.lit("("), "q", F.lit(")"))), "items")
    imports = items.where("form IN (1, 2)").select("o_custkey", "b", "form", F.when(F.col("form") == 1, F.col("m")).otherwise(F.col("p")).cast("long").alias("number"), "m").distinct()
    text = F.when(F.col("form") == 1, F.concat(F.lit("from shop.parts import m"), "m")).otherwise(F.concat(F.lit("from shop.parts.m"), "m", F.lit(" import part_"), key("number"), F.lit(" as p"), key("number")))
    imports = _lines(imports.withColumns({"text": text, "place": F.struct("form", "number")}), ["o_custkey", "b"], "place", "imports")
    bodies = orders.join(_lines(items, ["o_orderkey"], "l_linenumber", "calls"), "o_orderkey", "left")
    o, none = key("o_orderkey"), F.array().cast("array<string>")
    used = F.when(F.col("urgent"), F.array(F.lit("    cart = Cart(1)"), F.concat(F.lit("    cart.add("), o, F.lit(")")))).otherwise(none)
    body = F.concat(used, F.coalesce("calls", none))
    body = F.when(F.size(body) == 0, F.array(F.lit("    pass"))).otherwise(body)
    functions = bodies.select("o_custkey", "b", "o_orderkey", F.array_join(F.concat(F.array(F.concat(F.lit("def order_"), o, F.lit("():"))), body), "\n").alias("text"))
    files = functions.groupBy("o_custkey", "b").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "text"))), lambda x: x["text"]).alias("functions"), F.min("o_orderkey").alias("first"))
    files = files.join(imports, ["o_custkey", "b"], "left").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    guard = F.when(F.col("o_custkey") % 10 == 0, F.array(F.lit('if __name__ == "__main__":'), F.concat(F.lit("    result = order_"), key("first"), F.lit("()")))).otherwise(none)
    whole = F.array_join(F.concat(F.coalesce("imports", none), F.array(*map(F.lit, HEAD)), "functions", guard), "\n")
    path = F.concat(F.lit("shop/n"), key("c_nationkey"), F.lit("/c"), key("o_custkey"), F.lit("_"), key("b"), F.lit(".py"))
    return inits.unionByName(parts).unionByName(files.select(path.alias("path"), F.concat(whole, F.lit("\n")).alias("content")))


#: The same tree for SQL: files (path, and how many lines its imports have), orders with the line they begin at, calls with their place.
_TREE = f"""
    o AS (SELECT o_custkey, o_orderkey, o_orderkey // {STRETCH} AS b, o_orderpriority = '1-URGENT' AS urgent FROM orders JOIN customer ON c_custkey = o_custkey),
    lx AS (SELECT o.o_custkey, o.b, o.o_orderkey, l_linenumber, l_partkey AS p, l_partkey // {PARTS} AS m, l_linenumber % 4 AS form, CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) AS q FROM lineitem JOIN o ON o.o_orderkey = l_orderkey),
    ly AS (SELECT *, CASE form WHEN 1 THEN concat('m', m, '.part_', p) WHEN 2 THEN concat('p', p) WHEN 3 THEN 'helper' ELSE concat('missing_', p) END AS callee FROM lx),
    li AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, concat(callee, '(', q, ')')) AS nth FROM ly),
    im AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, b ORDER BY form, number) AS line, CASE form WHEN 1 THEN concat('m', m) ELSE concat('p', number) END AS local, CASE form WHEN 1 THEN concat('from shop.parts import m', m) ELSE concat('from shop.parts.m', m, ' import part_', number, ' as p', number) END AS text
           FROM (SELECT DISTINCT o_custkey, b, form, CASE form WHEN 1 THEN m ELSE p END AS number, m FROM li WHERE form IN (1, 2))),
    f AS (SELECT o_custkey, b, concat('shop/n', c_nationkey, '/c', o_custkey, '_', b, '.py') AS path, coalesce((SELECT count(*) FROM im WHERE im.o_custkey = x.o_custkey AND im.b = x.b), 0) AS head, first, total FROM
          (SELECT o_custkey, b, min(o_orderkey) AS first, count(*) AS total FROM o GROUP BY o_custkey, b) x JOIN customer ON c_custkey = o_custkey),
    ob AS (SELECT o.*, 1 + greatest(1, CASE WHEN urgent THEN 2 ELSE 0 END + (SELECT count(*) FROM li WHERE li.o_orderkey = o.o_orderkey)) AS size FROM o),
    ol AS (SELECT ob.*, f.path, f.head, f.head + {len(HEAD)} + 1 + coalesce(sum(size) OVER (PARTITION BY ob.o_custkey, ob.b ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM ob JOIN f ON f.o_custkey = ob.o_custkey AND f.b = ob.b),
    cs AS (
        SELECT path, concat('order_', o_orderkey) AS caller, concat('<module>/order_', o_orderkey, '[1]') AS scope, line + CASE WHEN urgent THEN 2 ELSE 0 END + nth AS line, 4 AS col,
               callee, q AS arg, form, p, m, CASE WHEN urgent THEN 2 ELSE 0 END + nth AS place FROM ol JOIN li USING (o_orderkey)
        UNION ALL SELECT path, concat('order_', o_orderkey), concat('<module>/order_', o_orderkey, '[1]'), line + 1, 11, 'Cart', '1', 10, NULL, NULL, 1 FROM ol WHERE urgent
        UNION ALL SELECT path, concat('order_', o_orderkey), concat('<module>/order_', o_orderkey, '[1]'), line + 2, 4, 'cart.add', CAST(o_orderkey AS VARCHAR), 11, NULL, NULL, 2 FROM ol WHERE urgent
        UNION ALL SELECT path, 'show', '<module>/show[1]', head + 4, 4, 'helper', 'x', 3, NULL, NULL, 1 FROM f
        UNION ALL SELECT path, 'Cart.add', '<module>/Cart[1]/add[1]', head + 9, 15, 'self.total', 'n', 12, NULL, NULL, 1 FROM f
        UNION ALL SELECT f.path, NULL, '<module>', max(ol.line + ol.size) + 1, 13, concat('order_', first), '', 13, NULL, NULL, 1 FROM f JOIN ol ON ol.path = f.path WHERE f.o_custkey % 10 = 0 GROUP BY f.path, first),
    k AS (SELECT *, line AS end_line, col + length(callee) + length(arg) + 2 AS end_col, concat('call/', path, '/', scope, '/', line, '/', col, '/', line, '/', col + length(callee) + length(arg) + 2) AS key FROM cs),
    pf AS (SELECT p_partkey AS p, concat('shop/parts/m', p_partkey // {PARTS}, '.py') AS path, 2 * (row_number() OVER (PARTITION BY p_partkey // {PARTS} ORDER BY p_partkey) - 1) + 1 AS line FROM part),
    df AS (
        SELECT path, concat('part_', p) AS name, 'function' AS tag, concat('<module>/part_', p, '[1]') AS key, '<module>' AS scope, line AS start_line, line + 1 AS end_line FROM pf
        UNION ALL SELECT path, n, g, concat('<module>/', y), z, head + s, head + e FROM f, (VALUES ('helper', 'function', 'helper[1]', '<module>', 1, 2), ('show', 'function', 'show[1]', '<module>', 3, 4), ('Cart', 'class', 'Cart[1]', '<module>', 5, 11),
            ('Cart.__init__', 'method', 'Cart[1]/__init__[1]', '<module>/Cart[1]', 6, 7), ('Cart.add', 'method', 'Cart[1]/add[1]', '<module>/Cart[1]', 8, 9), ('Cart.total', 'method', 'Cart[1]/total[1]', '<module>/Cart[1]', 10, 11)) AS v(n, g, y, z, s, e)
        UNION ALL SELECT path, concat('order_', o_orderkey), 'function', concat('<module>/order_', o_orderkey, '[1]'), '<module>', line, line + size - 1 FROM ol)"""
_WITH = f"WITH {_TREE}"


def _facts(t: Tables, *kinds: str) -> DataFrame:
    """The tree's facts of some kinds; others aren't worked out."""
    return lexical.lexical_facts(source_tree(t), kinds)


@query("source_imports", f"{_WITH} SELECT path, CAST(line - 1 AS INTEGER) AS place, CASE form WHEN 1 THEN concat('shop.parts.m', m) ELSE concat('shop.parts.m', m, '.part_', number) END AS name FROM im JOIN f USING (o_custkey, b)")
def source_imports(t: Tables) -> DataFrame:
    """SRC-02 and SRC-03: what each file imports at its top level, as dotted names in order."""
    return python_source.file_facts(source_tree(t), ("imports",)).select("path", F.posexplode("imports").alias("place", "name"))


@query("source_calls", f"{_WITH}, g AS (SELECT path, caller, callee, min(place) AS earliest FROM cs WHERE caller IS NOT NULL GROUP BY path, caller, callee) SELECT path, caller, callee, CAST(row_number() OVER (PARTITION BY path, caller ORDER BY earliest) - 1 AS INTEGER) AS place FROM g")
def source_calls(t: Tables) -> DataFrame:
    """SRC-04: the names that a function or method calls, each at its first place."""
    return python_source.file_facts(source_tree(t), ("calls",)).select("path", F.explode("calls").alias("c")).select("path", "c.caller", "c.callee", "c.place")


@query("source_entries", f"{_WITH} SELECT path, o_custkey % 10 = 0 AS has_main_guard, CAST(2 + total AS INTEGER) AS n_functions FROM f")
def source_entries(t: Tables) -> DataFrame:
    """SRC-05: whether a file runs as a script."""
    return python_source.file_facts(source_tree(t), ("classes", "functions", "has_main_guard")).where("size(classes) > 0").select("path", "has_main_guard", F.size("functions").alias("n_functions"))


_NAMED = "concat(CASE tag WHEN 'function' THEN 'func' ELSE tag END, ':', path, ':', name)"
_GRAPH = f"""{_WITH}, d AS (SELECT *, {_NAMED} AS id FROM df), a AS (SELECT regexp_extract(name, '[^.]*$') AS last, min(id) AS id FROM d WHERE tag <> 'class' GROUP BY 1)
    SELECT DISTINCT concat('file:', path) AS source, id AS target, 'contains' AS type FROM d WHERE scope = '<module>' UNION ALL SELECT concat('class:', path, ':Cart'), id, 'contains' FROM d WHERE tag = 'method'
    UNION ALL SELECT DISTINCT concat('file:', path), concat('file:shop/parts/m', m, '.py'), 'imports' FROM im JOIN f USING (o_custkey, b)
    UNION ALL SELECT DISTINCT c.id, coalesce(h.id, a.id, concat('func:', callee)), 'calls' FROM cs JOIN d c ON c.path = cs.path AND c.name = cs.caller AND c.tag <> 'class' LEFT JOIN d h ON h.path = cs.path AND h.name = cs.callee AND h.tag <> 'class' LEFT JOIN a ON a.last = regexp_extract(cs.callee, '[^.]*$')"""


@query("python_graph_edges", _GRAPH)
def python_graph_edges(t: Tables) -> DataFrame:
    """GQ-16 with JOI-04 to JOI-06: contains, imports and calls edges by names."""
    return python_source.graph_edges(python_source.file_facts(source_tree(t)))


@query("python_parse_facts")
def python_parse_facts(t: Tables) -> DataFrame:
    """SRC-02 to SRC-05 as one row for each file; ``source_imports``, ``source_calls`` and ``source_entries`` have them apart, with SQL."""
    return python_source.file_facts(source_tree(t))


@query("python_lexical_facts")
def python_lexical_facts(t: Tables) -> DataFrame:
    """SRC-06 to SRC-13: all facts; the queries below have them kind by kind, with SQL."""
    return lexical.lexical_facts(source_tree(t))


@query("python_scopes", f"""{_WITH}, s AS (SELECT path, '<module>' AS key, NULL AS around, 'module' AS tag, 1 AS start_line, CASE WHEN first IS NULL THEN 1 ELSE (SELECT max(ol.line + ol.size) - 1 FROM ol WHERE ol.path = f.path) + CASE WHEN o_custkey % 10 = 0 THEN 2 ELSE 0 END END AS end_line FROM f
    UNION ALL SELECT DISTINCT path, '<module>', NULL, 'module', 1, max(line) OVER (PARTITION BY path) + 1 FROM pf
    UNION ALL SELECT path, '<module>', NULL, 'module', 1, 1 FROM (SELECT 'shop/__init__.py' AS path UNION ALL SELECT 'shop/parts/__init__.py' UNION ALL SELECT concat('shop/n', n_nationkey, '/__init__.py') FROM nation)
    UNION ALL SELECT path, key, scope, tag, start_line, end_line FROM df)
    SELECT path, key, around, tag, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM s""")
def python_scopes(t: Tables) -> DataFrame:
    """SRC-06: every scope and what it stands in."""
    return _facts(t, "scope").select("path", "key", F.col("scope").alias("around"), "tag", "start_line", "end_line")


@query("python_definitions", f"{_WITH} SELECT path, key, scope, name, tag, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM df")
def python_definitions(t: Tables) -> DataFrame:
    """SRC-07."""
    return _facts(t, "definition").select("path", "key", "scope", "name", "tag", "start_line", "end_line")


@query("python_call_sites", f"{_WITH} SELECT key, path, scope, callee AS expression, CAST(line AS INTEGER) AS start_line, CAST(col AS INTEGER) AS start_col, CAST(end_col AS INTEGER) AS end_col FROM k")
def python_call_sites(t: Tables) -> DataFrame:
    """SRC-08: call sites with their identity, which is path, scope and place."""
    return _facts(t, "call").select("key", "path", "scope", F.col("name").alias("expression"), "start_line", "start_col", "end_col")


@query("python_flow_facts", f"""{_WITH} SELECT path, 'assignment' AS kind, scope, callee_of AS target, 'call' AS tag, flag FROM (SELECT path, scope, CASE WHEN form = 10 THEN 'cart' ELSE 'result' END AS callee_of, form = 13 AS flag FROM cs WHERE form IN (10, 13))
    UNION ALL SELECT path, 'assignment', '<module>/Cart[1]/__init__[1]', 'self.n', 'name', false FROM f UNION ALL SELECT path, 'mutation', '<module>/Cart[1]/__init__[1]', 'self.n', NULL, NULL FROM f
    UNION ALL SELECT path, 'escape', scope, arg, NULL, NULL FROM cs WHERE arg IN ('x', 'n') UNION ALL SELECT path, 'method', concat('<module>/Cart[1]/', v.n, '[1]'), 'self', 'instance', v.n = '__init__' FROM f, (VALUES ('__init__'), ('add'), ('total')) AS v(n)""")
def python_flow_facts(t: Tables) -> DataFrame:
    """SRC-09, SRC-11, SRC-12 and SRC-13: assignments (conditional ones flagged), mutations, names that escape into calls, methods with their receiver and whether they only initialise."""
    facts = _facts(t, "assignment", "mutation", "escape", "method")
    target = F.when(F.col("kind") == "assignment", F.array_join("parts", ".")).when(F.col("kind") == "mutation", F.concat(F.array_join("parts", "."), F.lit("."), "name")).otherwise(F.col("name"))
    return facts.select("path", "kind", F.when(F.col("kind") == "method", F.col("key")).otherwise(F.col("scope")).alias("scope"), target.alias("target"), "tag", "flag")


@query("python_import_decls", f"{_WITH} SELECT f.path, concat('import/', path, '/<module>/', line, '/0/', line, '/', length(text)) AS key, local, CASE form WHEN 1 THEN concat('m', m) ELSE concat('part_', number) END AS imported, CASE form WHEN 1 THEN 'shop.parts' ELSE concat('shop.parts.m', m) END AS module, concat('file:shop/parts/m', m, '.py') AS target FROM im JOIN f USING (o_custkey, b)")
def python_import_decls(t: Tables) -> DataFrame:
    """SRC-10 and JOI-08: import declarations and the files they lead to."""
    facts = stored(_facts(t, "import", "scope", "unparsed"), "import-facts")
    own = facts.where("kind = 'import'").select("path", "key", F.col("name").alias("local"), F.col("parts")[0].alias("imported"), F.col("tag").alias("module"))
    return own.join(bindings.import_targets(facts).select("key", F.col("name").alias("local"), "target"), ["key", "local"]).select("path", "key", "local", "imported", "module", "target")


_BOUND = f"""{_WITH}, d AS (SELECT *, {_NAMED} AS id FROM df),
    r AS (SELECT k.*, CASE WHEN caller IS NULL THEN concat('file:', path) WHEN form = 12 THEN concat('method:', path, ':', caller) ELSE concat('func:', path, ':', caller) END AS source, form <> 0 AS static,
                 CASE WHEN form IN (1, 2) THEN concat('func:shop/parts/m', m, '.py:part_', p) WHEN form = 3 THEN concat('func:', path, ':helper') WHEN form = 10 THEN concat('class:', path, ':Cart') WHEN form = 11 THEN concat('method:', path, ':Cart.add') WHEN form = 12 THEN concat('method:', path, ':Cart.total')
                      WHEN form = 13 THEN concat('func:', path, ':', callee) ELSE concat('unresolved:', key) END AS target,
                 CASE WHEN form IN (1, 2) THEN 'import_binding_chain' WHEN form IN (11, 12) THEN 'nominal_receiver_or_alias_binding' WHEN form = 0 THEN 'name_not_bound_in_module' ELSE 'unique_same_module_lexical_definition' END AS basis FROM k)
    SELECT CASE WHEN tag = 'method' THEN concat('class:', path, ':Cart') ELSE concat('file:', path) END AS source, id AS target, 'contains' AS type, NULL AS site, 'static' AS resolution, 'lexical_containment' AS basis FROM d
    UNION ALL SELECT concat('file:', path), concat('file:shop/parts/m', m, '.py'), 'imports', concat('import/', path, '/<module>/', line, '/0/', line, '/', length(text)), 'declaration', 'import_declaration_not_symbol_binding' FROM im JOIN f USING (o_custkey, b)
    UNION ALL SELECT source, target, CASE WHEN static THEN 'calls' ELSE 'unresolved_call' END, key, CASE WHEN static THEN 'static' ELSE 'unknown' END, basis FROM r
    UNION ALL SELECT source, target, 'references', key, 'static', basis FROM r WHERE form IN (1, 2, 11, 12)"""


@query("python_bound_graph", _BOUND)
def python_bound_graph(t: Tables) -> DataFrame:
    """GQ-17 with JOI-07 to JOI-14: edges of calls that lexical scopes, import chains and receivers bind, and of those that nothing binds."""
    return bindings.bound_graph(lexical.lexical_facts(source_tree(t)))


_OWN = "concat(CASE tag WHEN 'function' THEN 'func' ELSE tag END, ':', path, ':', name)"
_FAULTS = f"""{_WITH}, d AS (SELECT *, {_OWN} AS id FROM df), c AS (SELECT f.path, o_custkey FROM f)
    SELECT 'node_name' AS rule, 'nodes' AS table, concat('method:', path, ':Cart.total') AS id FROM c WHERE o_custkey % 5 = 0
    UNION ALL SELECT 'scope_in_parent', 'scopes', concat('method:', path, ':Cart.add') FROM c WHERE o_custkey % 7 = 0 UNION ALL SELECT 'scope_is_its_node', 'scopes', concat('method:', path, ':Cart.add') FROM c WHERE o_custkey % 7 = 0
    UNION ALL SELECT 'node_is_contained', 'nodes', concat('func:', path, ':show') FROM c WHERE o_custkey % 3 = 0
    UNION ALL SELECT 'contains_basis', 'edges', concat('file:', path, ' contains class:', path, ':Cart') FROM c WHERE o_custkey % 4 = 0
    UNION ALL SELECT 'site_basis', 'sites', key FROM k WHERE form = 12 UNION ALL SELECT 'call_place', 'edges', concat('method:', path, ':Cart.add ', v.kind, ' method:', path, ':Cart.total ', key) FROM k, (VALUES ('calls'), ('references')) AS v(kind) WHERE form = 12
    UNION ALL SELECT 'site_id', 'sites', concat('x', key) FROM k WHERE form = 13 UNION ALL SELECT 'site_has_edge', 'sites', concat('x', key) FROM k WHERE form = 13 UNION ALL SELECT 'call_site', 'edges', concat('file:', path, ' calls func:', path, ':', callee, ' ', key) FROM k WHERE form = 13
    UNION ALL SELECT 'call_place', 'edges', concat('file:', path, ' calls func:', path, ':', callee, ' ', key) FROM k WHERE form = 13 UNION ALL SELECT 'call_static', 'edges', concat('file:', path, ' calls func:', path, ':', callee, ' ', key) FROM k WHERE form = 13
    UNION ALL SELECT 'import_conditional', 'imports', concat('import/', path, '/<module>/', line, '/0/', line, '/', length(text)) FROM im JOIN f USING (o_custkey, b) WHERE form = 2 AND number % 6 = 0
    UNION ALL SELECT 'file_digest', 'files', path FROM c WHERE o_custkey % 9 = 0"""


@query("graph_rule_violations", _FAULTS)
def graph_rule_violations(t: Tables) -> DataFrame:
    """FLT-10: the tree's graph, in which some rows are spoilt: what breaks the 66 rules is those rows and what depends on them, and nothing else."""
    files = stored(source_tree(t), "tree")
    g = graph_rules.graph_tables(files, lexical.lexical_facts(files))
    customer = F.regexp_extract("path", "/c([0-9]+)_", 1).try_cast("long")
    every = lambda n: F.coalesce(customer % n == 0, F.lit(False))
    add = F.col("id").endswith(":Cart.add")
    nodes = g.nodes.withColumn("name", F.when((F.col("type") == "method") & F.col("id").endswith(":Cart.total") & every(5), "").otherwise(F.col("name")))
    scopes = g.scopes.withColumn("end_line", F.when((F.col("kind") == "method") & add & every(7), F.col("end_line") + 4).otherwise(F.col("end_line")))
    held, to_cart = F.col("type") == "contains", F.col("target").endswith(":Cart") & F.col("target").startswith("class:")
    holder = F.regexp_extract("target", "/c([0-9]+)_", 1).try_cast("long")
    edges = g.edges.where(~(held & F.col("target").endswith(":show") & F.coalesce(holder % 3 == 0, F.lit(False))))
    edges = edges.withColumn("basis", F.when(held & to_cart & F.coalesce(holder % 4 == 0, F.lit(False)), "guess").otherwise(F.col("basis")))
    sites = g.sites.withColumn("basis", F.when(F.col("expression") == "self.total", "Not A Basis").otherwise(F.col("basis")))
    sites = sites.withColumn("id", F.when(F.col("caller_id").startswith("file:"), F.concat(F.lit("x"), "id")).otherwise(F.col("id")))
    part = F.regexp_extract(F.element_at("names", 1), "^part_([0-9]+)$", 1).try_cast("long")
    imports = g.imports.withColumn("conditional", F.when(~F.coalesce(part % 6 == 0, F.lit(False)), F.col("conditional")))
    sources = g.files.withColumn("source_sha256", F.when(every(9), "none").otherwise(F.col("source_sha256")))
    return graph_rules.violations(graph_rules.Graph(sources, nodes, scopes, sites, imports, edges))


def project(t: Tables) -> Project:
    """The tree as a project; its files are stored, as every question reads them."""
    return Project(stored(source_tree(t), "project"))


_BOUND_CALLS = _BOUND.replace("SELECT CASE WHEN tag = 'method'", ", b AS (SELECT CASE WHEN tag = 'method'", 1) + ")"


@query("project_callers", f"{_BOUND_CALLS} SELECT source, target FROM b WHERE type = 'calls' AND target = 'func:shop/parts/m0.py:part_7'")
def project_callers(t: Tables) -> DataFrame:
    """GQ-04 and GQ-07 through the facade: who calls a part's function, found by its name."""
    return project(t).query("callers", "part_7")


@query("project_calls", f"{_BOUND_CALLS} SELECT source, target, type, resolution FROM b WHERE type IN ('calls', 'unresolved_call') AND source IN (SELECT {_OWN} FROM df WHERE name = (SELECT concat('order_', min(o_orderkey)) FROM orders))")
def project_calls(t: Tables) -> DataFrame:
    """GQ-03 and GQ-07: what the function of the first order calls, bound or not."""
    first = t.orders.agg(F.min("o_orderkey")).first()[0]
    return project(t).query("calls", f"order_{first}")


@query("project_impact", f"""{_WITH}, s AS (SELECT 'shop/parts/m0.py' AS path, 0 AS step UNION ALL SELECT DISTINCT path, 1 FROM im JOIN f USING (o_custkey, b) WHERE m = 0)
    SELECT path, CAST(min(step) AS INTEGER) AS step FROM s GROUP BY path ORDER BY 2, 1 LIMIT 8""")
def project_impact(t: Tables) -> DataFrame:
    """RET-11 and RET-12: a module of parts and the first files that import it."""
    return project(t).impact("shop/parts/m0.py")


@query("project_onboard", f"{_WITH} SELECT path, 2 AS step FROM (SELECT path FROM f UNION SELECT path FROM pf UNION SELECT 'shop/__init__.py' UNION SELECT 'shop/parts/__init__.py' UNION SELECT concat('shop/n', n_nationkey, '/__init__.py') FROM nation) ORDER BY path LIMIT 3")
def project_onboard(t: Tables) -> DataFrame:
    """RET-11 and SRT-12: a tree without an entry is begun with its first three paths."""
    return project(t).onboard()


@query("project_explain", f"""{_BOUND_CALLS}, c AS (SELECT source, count(*) FILTER (type = 'calls') AS n_calls, count(*) FILTER (type = 'unresolved_call') AS n_unresolved FROM b GROUP BY source), x AS (SELECT path FROM f ORDER BY path LIMIT 1)
    SELECT {_OWN} AS id, tag AS type, name, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, coalesce(n_calls, 0) AS n_calls, coalesce(n_unresolved, 0) AS n_unresolved FROM df LEFT JOIN c ON c.source = {_OWN} WHERE path = (SELECT path FROM x)""")
def project_explain(t: Tables) -> DataFrame:
    """RET-11: what the first of the customers' files defines."""
    own = project(t)
    first = own.files.where("path LIKE 'shop/n%/c%'").agg(F.min("path")).first()[0]
    return own.explain(first or "")
