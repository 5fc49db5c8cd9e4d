"""Syntax trees of Python files as rows: one for each node, numbered from the root down."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: A node's columns, and those of what it holds.
SCHEMA = {
    "path": "string", "id": "int", "last": "int", "parent": "int", "field": "string", "place": "int", "type": "string", "attrs": "map<string,string>", "segment": "string",
    "line": "int", "col": "int", "end_line": "int", "end_col": "int", "within": "int", "chances": "int", "dotted": "array<string>",
    "steps": "array<string>", "openers": "array<string>", "perhaps": "boolean", "first_line": "int",
    "held": "array<struct<field:string,type:string,name:string,alias:string,dotted:array<string>,called:array<string>>>",
    "parameters": "array<struct<name:string,positional:boolean>>",
    "body": "array<struct<type:string,targets:int,to:array<string>,value:string,constant:string,callee:array<string>,given:array<struct<type:string,name:string>>>>",
    "passes": "array<string>",
}
_TEXT, _TEXTS = pa.string(), pa.list_(pa.string())
_ARROW = {"string": _TEXT, "int": pa.int32(), "boolean": pa.bool_(), "map<string,string>": pa.map_(_TEXT, _TEXT), "array<string>": _TEXTS} | {
    SCHEMA["held"]: pa.list_(pa.struct([("field", _TEXT), ("type", _TEXT), ("name", _TEXT), ("alias", _TEXT), ("dotted", _TEXTS), ("called", _TEXTS)])),
    SCHEMA["parameters"]: pa.list_(pa.struct([("name", _TEXT), ("positional", pa.bool_())])),
    SCHEMA["body"]: pa.list_(pa.struct([("type", _TEXT), ("targets", pa.int32()), ("to", _TEXTS), ("value", _TEXT), ("constant", _TEXT), ("callee", _TEXTS), ("given", pa.list_(pa.struct([("type", _TEXT), ("name", _TEXT)])))])),
}
_NAMES = list(SCHEMA)[1:]
#: Nodes that leave a task at once, parts of a dotted name at most, and nodes and characters of pieces that a task remembers.
_BATCH, _MOST_PARTS, _REMEMBERED, _CHARACTERS = 1 << 14, 32, 1 << 17, 1 << 24
#: Fields whose nodes a node tells of itself.
_HELD = frozenset(("decorator_list", "bases", "keywords", "type_params", "func", "target", "targets", "value", "names"))
#: Where a definition or a decorator begins at the left edge.
_EDGE = re.compile(r"^(?:@|(?:async[ \t]+)?def\b|class\b)", re.MULTILINE)

#: Types of nodes that hold no others.
_LEAVES = frozenset(("Name", "Constant", "Pass", "Break", "Continue"))

_FAULTS = (SyntaxError, ValueError, RecursionError, MemoryError)


def pieces(text: str) -> list[str]:
    """A text cut before definitions at its left edge, with their decorators. Pieces that can all be parsed give the statements of the whole: one that ends inside a string, a bracket or a statement can't be."""
    if "\r" in text or "\f" in text:
        return [text]
    cuts, decorated = [0], False
    for m in _EDGE.finditer(text):
        if not decorated and m.start():
            cuts.append(m.start())
        decorated = m.group() == "@"
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


class Memo:
    """What a task has made of pieces of text, by their text; emptied when it holds too much."""

    def __init__(self) -> None:
        self.known: dict[str, object] = {}
        self.size = self.characters = 0

    def put(self, text: str, value: object, size: int) -> None:
        if self.size + size > _REMEMBERED or self.characters + len(text) > _CHARACTERS:
            self.known.clear()
            self.size = self.characters = 0
        self.size, self.characters = self.size + size, self.characters + len(text)
        self.known[text] = value


def _plain(node: ast.AST) -> list[tuple[str, str]]:
    """A node's plain fields as strings; nodes without a place of their own (operators, contexts) are plain."""
    plain: dict[str, str] = {}
    for field, value in ast.iter_fields(node):
        for x in value if isinstance(value, list) else [value]:
            bare = isinstance(x, ast.AST) and not x._fields and not hasattr(x, "lineno")
            if isinstance(x, ast.AST) and not bare:
                continue
            if isinstance(node, ast.Constant):
                plain[field] = type(x).__name__
            elif x is not None:
                text = type(x).__name__ if bare else str(x)
                plain[field] = f"{plain[field]},{text}" if field in plain else text
    return list(plain.items())


def _children(node: ast.AST) -> list[tuple[str, int, ast.AST]]:
    """A node's children (field, place, node), its body last."""
    first, body = [], []
    for field in node._fields:
        value = getattr(node, field, None)
        for place, x in enumerate(value if isinstance(value, list) else (value,)):
            if isinstance(x, ast.AST) and (x._fields or hasattr(x, "lineno")):
                (body if field == "body" else first).append((field, place, x))
    return first + body


def dotted(node: ast.AST | None) -> list[str] | None:
    """The parts of a name, or of a chain of attributes of one."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute) and len(parts) < _MOST_PARTS - 1:
        parts.append(node.attr)
        node = node.value
    return [node.id, *reversed(parts)] if isinstance(node, ast.Name) else None


def _named(node: ast.AST) -> str | None:
    return node.id if isinstance(node, ast.Name) else getattr(node, "name", None)


def _held(children: list[tuple[str, int, ast.AST]]) -> list[tuple]:
    return [(f, type(x).__name__, _named(x), getattr(x, "asname", None), dotted(x), dotted(x.func) if isinstance(x, ast.Call) else None) for f, _, x in children if f in _HELD]


def _parameters(node: ast.AST) -> list[tuple[str, bool]]:
    a = node.args
    rest = [x for x in (a.vararg, *a.kwonlyargs, a.kwarg) if x is not None]
    return [(x.arg, True) for x in (*a.posonlyargs, *a.args)] + [(x.arg, False) for x in rest]


def _statement(node: ast.AST) -> tuple:
    """What a statement sets, from what value, and what a call there is given."""
    targets = getattr(node, "targets", None) or [x for x in (getattr(node, "target", None),) if x is not None]
    value = getattr(node, "value", None)
    call = value if isinstance(value, ast.Call) else None
    given = [] if call is None else [(type(x).__name__, _named(x) if isinstance(x, ast.Name) else None) for x in (*call.args, *(k.value for k in call.keywords))]
    constant = type(value.value).__name__ if isinstance(value, ast.Constant) else None
    return type(node).__name__, len(targets), dotted(targets[0]) if targets else None, None if value is None else type(value).__name__, constant, dotted(call.func) if call else None, given


def _is_bare(node: ast.Compare) -> bool:
    """Whether a comparison is a test of identity between names and constants."""
    return all(isinstance(x, ast.Is | ast.IsNot) for x in node.ops) and all(isinstance(x, ast.Name | ast.Constant) for x in (node.left, *node.comparators))


class _Scope:
    """A node that opens a scope, the scope around it, and the statements above it that may not run."""

    __slots__ = ("around", "chances", "id", "node", "openers", "step", "steps")

    def __init__(self, node: ast.AST, own_id: int, around: _Scope | None, chances: int, step: str | None = None):
        self.node, self.id, self.around, self.chances, self.step = node, own_id, around, chances, step
        self.steps: list[str] | None = None
        self.openers = [*([] if around is None else around.openers), type(node).__name__]

    def path(self) -> list[str]:
        if self.steps is None:
            self.steps = [*([] if self.around is None else self.around.path()), self.step]
        return self.steps


class Piece(NamedTuple):
    """Rows of a piece's nodes, numbered from 1; how many nodes and statements it has, the line it was read at, the names it defines at the top, and whether its rows hold lines elsewhere than in their columns."""

    rows: list[tuple]
    nodes: int
    statements: int
    line: int
    names: list[str]
    fixed: bool


def _piece(text: str, at_line: int, whole: frozenset[str], bodies: frozenset[str], counted: frozenset[str], kept: Callable[[ast.AST, ast.AST], bool] | None) -> Piece:
    module = ast.parse(text)
    lines: list[bytes] | None = None
    flat = getattr(kept, "only_statements", False)
    top = _Scope(module, 0, None, 0, "<module>") if "Module" in whole else None
    above: list[int] = [0]
    found, scopes = [], []
    todo: list[tuple] = [(x, module, 0, f, p, top, 0, (), False) for f, p, x in reversed(_children(module))]
    while todo:
        node, over, parent, field, place, scope, chances, calls, bare = todo.pop()
        kind, own_id = type(node).__name__, len(above)
        above.append(parent)
        if calls and kind == "Name" and not bare:
            for names in calls:
                names[node.id] = None
        opened = scope
        if kind in whole:
            opened = scope = _Scope(node, own_id, scope, chances, f"@{kind}[{node.lineno + at_line}:{node.col_offset}]")
            scopes.append(scope)
        elif kind in bodies:
            opened = _Scope(node, own_id, scope, chances)
            scopes.append(opened)
        children = () if kind in _LEAVES else _children(node)
        passes: dict[str, None] = {}
        more, inner = chances + (kind in counted), (*calls, passes) if kind == "Call" else calls
        test = kind == "Compare" and _is_bare(node)
        for f, p, x in reversed(children):
            if flat and isinstance(x, ast.expr):
                continue
            todo.append((x, node, own_id, f, p, opened if f == "body" else scope, more, inner if f in ("args", "keywords") else calls, test))
        if kept is None or kept(node, over):
            found.append((node, own_id, parent, field, place, scope, opened, chances, children, passes))
    last = list(range(len(above)))
    for k in range(len(above) - 1, 0, -1):
        last[above[k]] = max(last[above[k]], last[k])
    count: dict[tuple, int] = {}
    for s in sorted((s for s in scopes if s.step is None), key=lambda s: (s.node.lineno, s.node.col_offset)):
        own = (None if s.around is None else s.around.id, s.node.name)
        count[own] = count.get(own, 0) + 1
        s.step = f"{s.node.name}[{count[own]}]"
    rows = []
    for node, own_id, parent, field, place, scope, opened, chances, children, passes in found:
        kind, segment, first_line, parameters, body = type(node).__name__, None, None, None, None
        if kind == "Call" or field == "func":
            if lines is None:
                lines = [x.encode() for x in re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", text)]
            f = node.func if kind == "Call" and kept is not None else node if field == "func" else None
            if f is not None:
                own = lines[f.lineno - 1 : f.end_lineno]
                own[-1] = own[-1][: f.end_col_offset]
                own[0] = own[0][f.col_offset :]
                segment = b"".join(own).decode()
        if kind in ("FunctionDef", "AsyncFunctionDef", "ClassDef"):
            first_line = min((x.lineno + at_line for x in node.decorator_list), default=None)
            if kind != "ClassDef":
                parameters = _parameters(node)
                if scope is not None and isinstance(scope.node, ast.ClassDef):
                    body = [_statement(x) for x in node.body]
        at = [getattr(node, a, None) for a in ("lineno", "col_offset", "end_lineno", "end_col_offset")]
        if at[0] is not None:
            at[0], at[2] = at[0] + at_line, at[2] + at_line
        rows.append((
            own_id, last[own_id], parent, field, place, kind, _plain(node), segment, *at, None if scope is None else scope.id, chances, dotted(node),
            None if opened is None else opened.path(), None if opened is None else opened.openers, scope is not None and chances > scope.chances,
            first_line, _held(children), parameters, body, list(passes),
        ))
    names = [s.node.name for s in scopes if s.around is top and hasattr(s.node, "name")]
    return Piece(rows, len(above) - 1, len(module.body), at_line, names, any(type(s.node).__name__ in whole for s in scopes))


#: What a file that can't be parsed doesn't tell.
_UNKNOWN: tuple = (None,) * 15


def _file(text: str, read: Callable[[str, int], Piece]) -> list[tuple[Piece, int]]:
    """A file's pieces and the lines above them; one piece where names of definitions repeat, as those are numbered through the file. Raises what the parser does."""
    cut = pieces(text)
    while True:
        out, line = [], 0
        try:
            for x in cut:
                out.append((read(x, line), line))
                line += x.count("\n")
        except _FAULTS:
            if len(cut) == 1:
                raise
        else:
            names = [n for piece, _ in out for n in piece.names]
            if len(cut) == 1 or len(set(names)) == len(names):
                return out
        cut = [text]


def spread(files: DataFrame) -> DataFrame:
    """``files`` (path, content) dealt over all shuffle partitions: parsing takes far longer than the size of the texts tells, so partitions mustn't be merged by size."""
    return files.select("path", "content").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def _batch(todo: list[tuple], fields: list[str]) -> pa.RecordBatch:
    """Rows of pieces (path, lines above, nodes before, statements before, piece). A piece that comes again is made into columns once, and its rows are taken as often as it comes, with their numbers moved."""
    distinct: dict[int, tuple[int, Piece]] = {}
    rows: list[tuple] = []
    for *_, piece in todo:
        if id(piece) not in distinct:
            distinct[id(piece)] = len(rows), piece
            rows += piece.rows
    sizes = np.array([len(t[4].rows) for t in todo], np.int64)
    begin = np.array([distinct[id(t[4])][0] for t in todo], np.int64)
    of = np.repeat(np.arange(len(todo)), sizes)
    at = pa.array(np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()))
    moved = [pa.array(np.array(x, np.int32)[of]) for x in ([t[1] - t[4].line for t in todo], [t[2] for t in todo], [t[3] for t in todo])]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
    own = {n: pa.array(columns[k], _ARROW[SCHEMA[n]]).take(at) for k, n in enumerate(_NAMES) if n in fields or n == "parent"}
    for n, column in own.items():
        if n in ("line", "end_line", "first_line"):
            own[n] = pc.add(column, moved[0])
        elif n in ("id", "last", "parent", "within"):  # the module keeps its number
            own[n] = pc.if_else(pc.greater(column, 0), pc.add(column, moved[1]), column)
        elif n == "place":
            own[n] = pc.if_else(pc.fill_null(pc.equal(own["parent"], 0), False), pc.add(column, moved[2]), column)
    paths = pa.array([t[0] for t in todo], _TEXT).take(pa.array(of))
    return pa.RecordBatch.from_arrays([paths if n == "path" else own[n] for n in fields], fields)


def syntax_nodes(
    files: DataFrame, whole: tuple[str, ...] = (), bodies: tuple[str, ...] = (), counted: tuple[str, ...] = (),
    kept: Callable[[ast.AST, ast.AST | None], bool] | None = None, columns: tuple[str, ...] = (),
) -> DataFrame:
    """The nodes of each file (path, content), parsed where it lies: id (in the order of the tree, a body after all else of its node), last (id of its last descendant), parent, field and place (where the parent holds it),
    type, attrs (plain fields; of a constant its type), segment (source text of what is called), and where it stands; within (the innermost node that holds it, among types ``whole``, each in itself, and, of types ``bodies``, by its body),
    chances (how many nodes of types ``counted`` are above it) and dotted (the parts of a name, or of at most 31 attributes of one). A file that can't be parsed gives one row of type ``unparsed``.

    A node also tells of what is next to it: steps and openers (names and types of what holds it, from the module down, itself included if it opens such; a definition's name is numbered among its like), perhaps (whether it may not run where what holds it does),
    held (its decorators, bases, keywords, targets, values, names and what it calls), a definition's parameters, first line and, in a class, the statements of its body, and passes (the names in a call's arguments, but for those that only a test of identity looks at).
    With ``kept`` (told a node and its parent; of a module, none) others give no row, and a call has the segment; if it has ``only_statements`` set, expressions aren't looked at, nor numbered; ``columns`` are those that come out. Definitions at the left edge that read alike are parsed once by a task.
    """
    kinds = frozenset(whole), frozenset(bodies), frozenset(counted), kept
    fields = list(columns or SCHEMA)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, todo, n = Memo(), [], 0

        def read(text: str, line: int) -> Piece:
            known = memo.known.get(text)
            if known is None:
                known = _piece(text, line, *kinds)
                if not known.fixed:
                    memo.put(text, known, 1 + len(known.rows))
            return known

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                path, text = path.as_py(), (content.as_py() or "").removeprefix("﻿")
                try:
                    found = _file(text, read)
                except _FAULTS:
                    todo.append((path, 0, 0, 0, Piece([(-1, -1, None, None, None, "unparsed", [], None, *_UNKNOWN)], 0, 0, 0, [], True)))
                    n += 1
                else:
                    total = sum(p.nodes for p, _ in found)
                    end = max(1, text.count("\n") + (not text.endswith("\n")))
                    own, names, openers = (0, ["<module>"], ["Module"]) if "Module" in whole else (None, None, None)
                    module = (0, total, None, None, 0, "Module", [], None, 1, 0, end, 0, own, 0, None, names, openers, False, None, [], None, None, [])
                    if kept is None or kept(ast.Module(), None):
                        todo.append((path, 0, 0, 0, Piece([module], 1, 0, 0, [], True)))
                        n += 1
                    nodes = statements = 0
                    for piece, line in found:
                        todo.append((path, line, nodes, statements, piece))
                        nodes, statements, n = nodes + piece.nodes, statements + piece.statements, n + len(piece.rows)
                if n >= _BATCH or len(todo) >= _BATCH:
                    out = _batch(todo, fields)
                    todo, n = [], 0
                    for k in range(0, len(out), _BATCH):
                        yield out.slice(k, _BATCH)
        if todo:
            out = _batch(todo, fields)
            for k in range(0, len(out), _BATCH):
                yield out.slice(k, _BATCH)

    return spread(files).mapInArrow(parse, ", ".join(f"`{f}` {SCHEMA[f]}" for f in fields))
