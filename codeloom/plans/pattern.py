"""Structural search: S-expression patterns over syntax trees.

Node types and field names are those of the common Python grammar. Covered: definitions, decorators,
imports, assignments, the simple and compound statements, calls, attributes, subscripts, operators,
collections and literals; other nodes appear under the snake-case name of their Python class.
Patterns may use node types, ``_``, ``field:``, ``@captures``, ``[alternatives]``, ``?``, ``*``, ``+``,
anchors ``.``, ``!field`` and the predicates ``#eq?``, ``#not-eq?``, ``#match?``, ``#not-match?`` and ``#any-of?``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import field as made

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..model import InvalidPattern
from ..ship import ship
from .extract import parse

MATCHES = "path string, pattern_index int, captures map<string,array<struct<start_line:int,start_col:int,end_line:int,end_col:int,text:string>>>, anchor_line int, anchor_col int, digest string"


@dataclass
class Node:
    type: str
    start: int
    end: int
    children: list[tuple[str | None, Node]] = made(default_factory=list)


class View:
    """A tree of ``Node`` over the bytes of a source text."""

    def __init__(self, text: str, tree: ast.Module):
        self.data = text.encode()
        self.lines = [0]
        for m in re.finditer(b"\n", self.data):
            self.lines.append(m.end())
        self.root = Node("module", 0, len(self.data), [(None, self.of(s)) for s in tree.body])

    def at(self, line: int, column: int) -> int:
        return self.lines[line - 1] + column

    def place(self, offset: int) -> tuple[int, int]:
        import bisect

        line = bisect.bisect_right(self.lines, offset)
        return line, offset - self.lines[line - 1]

    def span(self, n: ast.AST) -> tuple[int, int]:
        return self.at(n.lineno, n.col_offset), self.at(n.end_lineno, n.end_col_offset)

    def word(self, name: str, start: int, end: int) -> Node:
        m = re.compile(rb"(?<![\w])" + re.escape(name.encode()) + rb"(?![\w])").search(self.data, start, end)
        a = m.start() if m else start
        return Node("dotted_name" if "." in name else "identifier", a, a + len(name.encode()))

    def brackets(self, start: int, end: int) -> tuple[int, int]:
        """The bracketed part that begins at or after ``start``."""
        a = self.data.find(b"(", start, end)
        if a < 0:
            return start, start
        depth, i = 0, a
        while i < end:
            c = self.data[i : i + 1]
            depth += (c in b"([{") - (c in b")]}") if c else 0
            i += 1
            if depth == 0:
                break
        return a, i

    def block(self, body: list[ast.stmt]) -> Node:
        parts = [self.of(s) for s in body]
        return Node("block", parts[0].start, parts[-1].end, [(None, p) for p in parts])

    def of(self, n: ast.AST) -> Node:
        start, end = self.span(n)
        marks = getattr(n, "decorator_list", None)
        if marks:
            inner = self.plain(n, start, end)
            begin = self.data.rfind(b"@", 0, self.span(marks[0])[0] + 1)
            found = [Node("decorator", self.data.rfind(b"@", 0, self.span(d)[0] + 1), self.span(d)[1], [(None, self.of(d))]) for d in marks]
            return Node("decorated_definition", begin, end, [*[(None, d) for d in found], ("definition", inner)])
        return self.plain(n, start, end)

    def arguments(self, items: list, keywords: list[ast.keyword], start: int, end: int) -> Node:
        parts = [self.of(x) for x in items]
        for k in keywords:
            a, b = self.span(k)
            value = self.of(k.value)
            parts.append(Node("keyword_argument", a, b, [("name", self.word(k.arg, a, b)), ("value", value)]) if k.arg else Node("dictionary_splat", a, b, [(None, value)]))
        return Node("argument_list", start, end, [(None, p) for p in sorted(parts, key=lambda p: p.start)])

    def parameters(self, n, start: int, end: int) -> Node:
        a, b = self.brackets(start, end)
        args, parts = n.args, []
        plain = [*args.posonlyargs, *args.args]
        defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
        for p, d in [*zip(plain, defaults), *zip(args.kwonlyargs, args.kw_defaults)]:
            s, e = self.span(p)
            name = Node("identifier", s, s + len(p.arg.encode()))
            kids = [("name" if d is not None else None, name)] + ([("type", self.typed(p.annotation))] if p.annotation else [])
            if d is not None:
                value = self.of(d)
                parts.append(Node("typed_default_parameter" if p.annotation else "default_parameter", s, value.end, [*kids, ("value", value)]))
            else:
                parts.append(Node("typed_parameter", s, e, kids) if p.annotation else name)
        for p, kind in ((args.vararg, "list_splat_pattern"), (args.kwarg, "dictionary_splat_pattern")):
            if p is not None:
                s, e = self.span(p)
                parts.append(Node(kind, self.data.rfind(b"*", 0, s), e, [(None, Node("identifier", s, s + len(p.arg.encode())))]))
        return Node("parameters", a, b, [(None, p) for p in sorted(parts, key=lambda p: p.start)])

    def typed(self, n: ast.expr) -> Node:
        inner = self.of(n)
        return Node("type", inner.start, inner.end, [(None, inner)])

    def plain(self, n: ast.AST, start: int, end: int) -> Node:
        make = lambda kind, *kids: Node(kind, start, end, [k if isinstance(k, tuple) else (None, k) for k in kids if k is not None])
        opt = lambda name, x: (name, self.of(x)) if x is not None else None
        match n:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                name = self.word(n.name, start, end)
                return make("function_definition", ("name", name), ("parameters", self.parameters(n, name.end, end)), ("return_type", self.typed(n.returns)) if n.returns else None, ("body", self.block(n.body)))
            case ast.ClassDef():
                name = self.word(n.name, start, end)
                body = self.block(n.body)
                a, b = self.brackets(name.end, body.start) if n.bases or n.keywords else (0, 0)
                return make("class_definition", ("name", name), ("superclasses", self.arguments(n.bases, n.keywords, a, b)) if b else None, ("body", body))
            case ast.Call():
                f = self.of(n.func)
                a = self.data.find(b"(", f.end, end)
                return make("call", ("function", f), ("arguments", self.arguments(n.args, n.keywords, a, end)))
            case ast.Attribute():
                size = len(n.attr.encode())
                return make("attribute", ("object", self.of(n.value)), ("attribute", Node("identifier", end - size, end)))
            case ast.Name():
                return make("identifier")
            case ast.Constant():
                kinds = {bool: str(n.value).lower(), str: "string", bytes: "string", int: "integer", float: "float", complex: "float", type(None): "none", type(...): "ellipsis"}
                return make(kinds[type(n.value)])
            case ast.JoinedStr():
                return make("string")
            case ast.Assign():
                right = ("right", self.of(n.value))
                for t in reversed(n.targets):  # a chain nests to the right
                    left = self.of(t)
                    right = ("right", Node("assignment", left.start, end, [("left", left), right]))
                return Node("expression_statement", start, end, [(None, right[1])])
            case ast.AnnAssign():
                return make("expression_statement", make("assignment", ("left", self.of(n.target)), ("type", self.typed(n.annotation)), opt("right", n.value)))
            case ast.AugAssign():
                return make("expression_statement", make("augmented_assignment", ("left", self.of(n.target)), ("right", self.of(n.value))))
            case ast.Expr():
                return make("expression_statement", self.of(n.value))
            case ast.Import() | ast.ImportFrom():
                parts, at = [], start
                if isinstance(n, ast.ImportFrom):
                    at = start + 4
                    module = "." * n.level + (n.module or "")
                    a = self.data.find(module.encode(), at, end) if module else at
                    parts.append(("module_name", Node("relative_import" if n.level else "dotted_name", a, a + len(module.encode()))))
                    at = self.data.find(b"import", a + len(module), end) + 6
                for x in n.names:
                    a, b = self.span(x)
                    if x.name == "*":
                        parts.append((None, Node("wildcard_import", a, b)))
                        continue
                    name = Node("dotted_name", a, a + len(x.name.encode()))
                    alias = Node("aliased_import", a, b, [("name", name), ("alias", Node("identifier", b - len(x.asname.encode()), b))]) if x.asname else None
                    parts.append(("name", alias or name))
                return make("import_from_statement" if isinstance(n, ast.ImportFrom) else "import_statement", *parts)
            case ast.Return():
                return make("return_statement", self.of(n.value) if n.value else None)
            case ast.If():
                other = None
                if n.orelse:
                    inner = self.block(n.orelse)
                    chained = len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If) and self.data[inner.start : inner.start + 4] == b"elif"
                    other = Node("elif_clause", inner.start, inner.end, inner.children[0][1].children) if chained else Node("else_clause", inner.start, inner.end, [("body", inner)])
                return make("if_statement", ("condition", self.of(n.test)), ("consequence", self.block(n.body)), ("alternative", other) if other else None)
            case ast.For() | ast.AsyncFor():
                return make("for_statement", ("left", self.of(n.target)), ("right", self.of(n.iter)), ("body", self.block(n.body)), ("alternative", self.block(n.orelse)) if n.orelse else None)
            case ast.While():
                return make("while_statement", ("condition", self.of(n.test)), ("body", self.block(n.body)), ("alternative", self.block(n.orelse)) if n.orelse else None)
            case ast.With() | ast.AsyncWith():
                items = []
                for w in n.items:
                    a, b = self.span(w.context_expr)
                    value = self.of(w.context_expr)
                    if w.optional_vars:
                        alias = self.of(w.optional_vars)
                        value = Node("as_pattern", a, alias.end, [(None, value), ("alias", alias)])
                    items.append(Node("with_item", a, value.end, [("value", value)]))
                return make("with_statement", Node("with_clause", items[0].start, items[-1].end, [(None, i) for i in items]), ("body", self.block(n.body)))
            case ast.Try() | ast.TryStar():
                clauses = [Node("except_clause", *self.span(h), [*([(None, self.of(h.type))] if h.type else []), (None, self.block(h.body))]) for h in n.handlers]
                tail = [Node(kind, b.start, b.end, [("body", b)]) for kind, part in (("else_clause", n.orelse), ("finally_clause", n.finalbody)) if part for b in [self.block(part)]]
                return make("try_statement", ("body", self.block(n.body)), *clauses, *tail)
            case ast.BinOp():
                return make("binary_operator", ("left", self.of(n.left)), ("right", self.of(n.right)))
            case ast.BoolOp():
                left = self.of(n.values[0])
                for v in n.values[1:]:
                    right = self.of(v)
                    left = Node("boolean_operator", start, right.end, [("left", left), ("right", right)])
                return left
            case ast.Compare():
                return make("comparison_operator", self.of(n.left), *[self.of(c) for c in n.comparators])
            case ast.UnaryOp():
                return make("not_operator" if isinstance(n.op, ast.Not) else "unary_operator", ("argument", self.of(n.operand)))
            case ast.Subscript():
                return make("subscript", ("value", self.of(n.value)), ("subscript", self.of(n.slice)))
            case ast.Dict():
                pairs = [Node("pair", k.start, v.end, [("key", k), ("value", v)]) if k else Node("dictionary_splat", v.start, v.end, [(None, v)]) for k, v in ((self.of(a) if a else None, self.of(b)) for a, b in zip(n.keys, n.values))]
                return make("dictionary", *pairs)
            case ast.Lambda():
                return make("lambda", ("body", self.of(n.body)))
            case ast.Raise():
                return make("raise_statement", self.of(n.exc) if n.exc else None)
        special = {"List": "list", "Tuple": "tuple", "Set": "set", "IfExp": "conditional_expression", "Await": "await", "Starred": "list_splat", "ListComp": "list_comprehension", "SetComp": "set_comprehension", "DictComp": "dictionary_comprehension", "GeneratorExp": "generator_expression", "NamedExpr": "named_expression"}
        name = type(n).__name__
        kind = special.get(name) or re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower() + ("_statement" if isinstance(n, ast.stmt) else "")
        kids = [c for c in ast.iter_child_nodes(n) if hasattr(c, "lineno")]
        return make(kind, *[self.of(c) for c in kids])


# patterns


@dataclass
class Pattern:
    kind: str  # node, any, group or choice
    type: str = ""
    field: str | None = None
    captures: list[str] = made(default_factory=list)
    parts: list[Pattern] = made(default_factory=list)
    least: int = 1
    most: float = 1
    before: bool = False  # anchored to the sibling before, or to the first
    last: bool = False  # anchored to the end
    without: list[str] = made(default_factory=list)
    predicates: list[tuple[str, list[tuple[str, str]]]] = made(default_factory=list)


TOKEN = re.compile(r'\s+|;[^\n]*|(?P<t>"(?:\\.|[^"\\])*"|[()\[\]]|[?*+]|!|\.|@[\w.-]+|#[\w-]+[?!]?|[A-Za-z_][\w-]*:?)')


def compile_patterns(text: str) -> list[Pattern]:
    tokens, i = [], 0
    while i < len(text):
        m = TOKEN.match(text, i)
        if not m:
            raise InvalidPattern(f"unexpected {text[i]!r} at {i}")
        if m["t"]:
            tokens.append(m["t"])
        i = m.end()
    out, at = [], 0
    while at < len(tokens):
        p, at = _parse(tokens, at)
        out.append(p)
    if not out:
        raise InvalidPattern("empty pattern")
    return out


def _parse(t: list[str], i: int) -> tuple[Pattern, int]:
    try:
        p, i = _parse_one(t, i)
        while i < len(t) and (t[i] in "?*+" or t[i][0] == "@"):
            if t[i][0] == "@":
                p.captures.append(t[i][1:])
            else:
                p.least, p.most = (0, 1) if t[i] == "?" else (0, float("inf")) if t[i] == "*" else (1, float("inf"))
            i += 1
        return p, i
    except IndexError:
        raise InvalidPattern("unexpected end of pattern") from None


def _parse_one(t: list[str], i: int) -> tuple[Pattern, int]:
    if t[i].endswith(":") and len(t[i]) > 1:
        p, j = _parse_one(t, i + 1)
        p.field = t[i][:-1]
        return p, j
    if t[i] == "_":
        return Pattern("any"), i + 1
    if t[i] == "[":
        parts, i = [], i + 1
        while t[i] != "]":
            p, i = _parse(t, i)
            parts.append(p)
        return Pattern("choice", parts=parts), i + 1
    if t[i] != "(":
        raise InvalidPattern(f"unexpected {t[i]}")
    i += 1
    head = Pattern("group")
    if t[i] not in "()[" and t[i][0] not in "#.@" and not t[i].endswith(":"):
        head = Pattern("any" if t[i] == "_" else "node", type=t[i])
        i += 1
    anchored = False
    while t[i] != ")":
        if t[i] == ".":
            anchored, i = True, i + 1
            if t[i] == ")" and head.parts:
                head.parts[-1].last = True
        elif t[i] == "!":
            head.without.append(t[i + 1])
            i += 2
        elif t[i] == "(" and t[i + 1][0] == "#":
            name, args, i = t[i + 1], [], i + 2
            while t[i] != ")":
                args.append(("capture", t[i][1:]) if t[i][0] == "@" else ("text", re.sub(r"\\(.)", r"\1", t[i][1:-1]) if t[i][0] == '"' else t[i]))
                i += 1
            if name not in ("#eq?", "#not-eq?", "#match?", "#not-match?", "#any-of?"):
                raise InvalidPattern(f"unknown predicate {name}")
            head.predicates.append((name, args))
            i += 1
        else:
            p, i = _parse(t, i)
            p.before, anchored = anchored, False
            head.parts.append(p)
    return head, i + 1


Bound = tuple[tuple[str, Node], ...]


def _matches(p: Pattern, n: Node) -> Iterator[Bound]:
    if p.kind == "choice":
        for q in p.parts:
            for b in _matches(q, n):
                yield (*((c, n) for c in p.captures), *b)
        return
    if p.kind == "node" and p.type != n.type or any(f in p.without for f, _ in n.children):
        return
    for b in _sequence(p.parts, n.children, 0, True):
        yield (*((c, n) for c in p.captures), *b)


def _sequence(parts: list[Pattern], kids: list[tuple[str | None, Node]], at: int, first: bool) -> Iterator[Bound]:
    """The parts in order among the children from ``at`` on; a quantified part takes as many as it can."""
    if not parts:
        yield ()
        return
    p, rest = parts[0], parts[1:]
    if p.most > 1:
        for start in [at] if p.before else range(at, len(kids)):
            taken, options = start, []
            while taken < len(kids) and (p.field is None or kids[taken][0] == p.field) and (b := next(_matches(p, kids[taken][1]), None)) is not None:
                options.append(b)
                taken += 1
            if options and (not p.last or taken == len(kids)):
                head = tuple(x for b in options for x in b)
                for tail in _sequence(rest, kids, taken, False):
                    yield (*head, *tail)
                return
        if p.least == 0:
            yield from _sequence(rest, kids, at, first)
        return
    met = False
    for i in range(at, len(kids)):
        name, kid = kids[i]
        if (p.field is None or name == p.field) and (not p.last or i == len(kids) - 1):
            for b in _matches(p, kid):
                for tail in _sequence(rest, kids, i + 1, False):
                    met = True
                    yield (*b, *tail)
        if p.before:
            break
    if p.least == 0 and not met:
        yield from _sequence(rest, kids, at, first)


def _holds(p: Pattern, bound: Bound, data: bytes) -> bool:
    text = lambda n: data[n.start : n.end].decode()
    for q in (p, *p.parts):
        for name, args in q.predicates:
            mine = [text(n) for c, n in bound if c == args[0][1]]
            if name in ("#eq?", "#not-eq?"):
                other = [text(n) for c, n in bound if c == args[1][1]] if args[1][0] == "capture" else [args[1][1]] * len(mine)
                ok = all((a == b) == (name == "#eq?") for a, b in zip(mine, other))
            elif name == "#any-of?":
                ok = all(a in {x for _, x in args[1:]} for a in mine)
            else:
                ok = all(bool(re.search(args[1][1], a)) == (name == "#match?") for a in mine)
            if not ok:
                return False
    return True


def search_text(patterns: list[Pattern], text: str) -> Iterator[tuple[int, dict[str, list[tuple]], tuple[int, int]]]:
    """(pattern, captures, anchor) of every match that captures something, over all nodes of a text."""
    tree = parse(text)
    if tree is None:
        return
    view = View(text, tree)
    todo = [view.root]
    while todo:
        node = todo.pop()
        for k, p in enumerate(patterns):
            found = _sequence(p.parts, node.children, 0, True) if p.kind == "group" else _matches(p, node)
            for bound in found:
                if bound and _holds(p, bound, view.data):
                    captures: dict[str, list[tuple]] = {}
                    for name, n in bound:
                        captures.setdefault(name, []).append((*view.place(n.start), *view.place(n.end), view.data[n.start : n.end].decode()))
                    yield k, captures, min(c[:2] for all_ in captures.values() for c in all_)
        todo += [c for _, c in reversed(node.children)]


def structural_search(files: DataFrame, pattern: str, path_glob: str | None = None) -> DataFrame:
    """One row for each match of ``pattern`` in ``files`` (path, source); files with errors have none."""
    patterns = compile_patterns(pattern)
    ship(files.sparkSession)
    if path_glob is not None:
        files = files.where(F.col("path").rlike(X.fnmatch_regex(path_glob)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ("start_line", "start_col", "end_line", "end_col", "text")
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["source"]):
                for k, captures, anchor in search_text(patterns, text or ""):
                    told = {name: [dict(zip(keys, c)) for c in all_] for name, all_ in captures.items()}
                    rows.append((path, k, told, *anchor, repr(sorted(captures.items()))))
            yield pd.DataFrame(rows, columns=["path", "pattern_index", "captures", "anchor_line", "anchor_col", "digest"])

    return files.select("path", "source").mapInPandas(run, MATCHES)
