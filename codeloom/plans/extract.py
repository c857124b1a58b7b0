"""Symbols, relations and deferred facts of Python files: one table function over source text."""

from __future__ import annotations

import ast
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DEFERRED, RELATIONS, SYMBOLS, names
from ..ship import ship

PROVIDER, VERSION = "python-ast", f"{sys.version_info.major}.{sys.version_info.minor}"
FIXTURES = ("pytest-fixture-heuristic", "1")
FACTS = (
    "row_kind string, path string, id string, qualname string, kind string, start_line int, start_col int, end_line int, end_col int, is_stub boolean, "
    "source string, target string, predicate string, site_file string, site_line int, site_col int, confidence string, "
    "deferred_kind string, module_path string, name string, attribute string, base_name string, method_name string, enclosing_class string, "
    "provenance_provider string, provenance_version string, observed_at string"
)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def terminal(node: ast.expr | None) -> str | None:
    """The last name of ``B``, ``a.B`` or ``B[T]``."""
    while isinstance(node, ast.Subscript):
        node = node.value
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def dotted(path: str) -> str:
    stem = path[: -len("/__init__.py")] if path.endswith("/__init__.py") else path.removesuffix(".py")
    return stem.replace("/", ".")


def package_of(path: str, level: int) -> str | None:
    """What ``level`` leading dots of an import mean in a file; None where they climb too far."""
    parts = dotted(path).split(".")
    if path == "__init__.py":
        parts = []
    is_init = path == "__init__.py" or path.endswith("/__init__.py")
    own = parts if is_init else parts[:-1]
    up = level - 1
    return None if up > (len(own) if is_init else len(own) - 1) else ".".join(own[: len(own) - up])


def attribute_site(node: ast.Attribute) -> tuple[int, int]:
    return node.end_lineno, node.end_col_offset - len(node.attr.encode())


class FileFacts:
    """The facts of one file, from its syntax tree alone."""

    def __init__(self, path: str, text: str, tree: ast.Module):
        self.path, self.tree = path, tree
        self.rows: list[dict] = []
        self.counts: Counter = Counter()
        self.at: dict[tuple[int, int], dict] = {}
        lines = text.encode().split(b"\n")
        self.module = self._symbol("", "module", (1, 0), (len(lines), len(lines[-1])))
        self.classes = [n for n in tree.body if isinstance(n, ast.ClassDef)]
        self.top: dict[str, list[dict]] = defaultdict(list)
        self.methods: dict[str, dict[str, list[dict]]] = defaultdict(lambda: defaultdict(list))
        self.symbols = [self.module]
        self._find_symbols()
        self.bases = {(c.lineno, c.col_offset): [(terminal(b), b) for b in c.bases if terminal(b)] for c in self.classes if not c.decorator_list}
        self.aliases: dict[str, str] = {}
        self._imports()
        self._defines()
        self._inherits()
        self._overrides()
        self._calls()
        self._fixtures()

    # symbols

    def _symbol(self, qualname: str, kind: str, start, end, is_stub: bool = False) -> dict:
        self.counts[qualname, kind] += 1
        n = self.counts[qualname, kind]
        id_ = f"{self.path}:{qualname}#{kind}" + (f"@{n}" if n > 1 else "")
        row = {"row_kind": "symbol", "path": self.path, "id": id_, "qualname": qualname, "kind": kind, "start_line": start[0], "start_col": start[1], "end_line": end[0], "end_col": end[1], "is_stub": is_stub, "confidence": "EXTRACTED"}
        self.rows.append(row)
        return row

    def _define(self, node, qualname: str, kind: str, is_stub: bool = False) -> dict:
        row = self._symbol(qualname, kind, (node.lineno, node.col_offset), (node.end_lineno, node.end_col_offset), is_stub)
        self.at[node.lineno, node.col_offset] = row
        self.symbols.append(row)
        return row

    def _find_symbols(self) -> None:
        known, renamed = self._contexts()
        for node in self.tree.body:
            if isinstance(node, FUNCTIONS):
                self.top[node.name].append(self._define(node, node.name, "function"))
            elif isinstance(node, ast.ClassDef):
                self.top[node.name].append(self._define(node, node.name, "class"))
                protocol, abstract = known[node]
                for m in node.body:
                    if isinstance(m, FUNCTIONS):
                        marks = [d.func if isinstance(d, ast.Call) else d for d in m.decorator_list]
                        marked = any(renamed.get(terminal(d), terminal(d)) == "abstractmethod" for d in marks)
                        stub = _empty(m) and (protocol or abstract and marked)
                        self.methods[node.name][m.name].append(self._define(m, f"{node.name}.{m.name}", "method", stub))

    def _contexts(self) -> tuple[dict, dict[str, str]]:
        """For each class whether it is a Protocol and whether it is abstract, bases in the file included."""
        renamed: dict[str, str] = {}
        todo = [(self.tree, True)]
        while todo:
            node, outer = todo.pop()
            if isinstance(node, ast.ImportFrom):
                renamed |= {a.asname: a.name for a in node.names if a.asname}
            defines = isinstance(node, (*FUNCTIONS, ast.ClassDef))
            if outer and defines:
                renamed.pop(node.name, None)
            todo += [(c, outer and not defines) for c in reversed(list(ast.iter_child_nodes(node)))]
        special = lambda n: renamed[n] if renamed.get(n) in ("Protocol", "ABC") else n
        bases = {c: {special(terminal(b)) for b in c.bases if terminal(b)} for c in self.classes}
        meta = {c: any(k.arg == "metaclass" and renamed.get(terminal(k.value), terminal(k.value)) == "ABCMeta" for k in c.keywords) for c in self.classes}
        known = {c: ("Protocol" in bases[c], "ABC" in bases[c] or meta[c]) for c in self.classes}
        for _ in self.classes:
            sets = [{c.name for c in self.classes if known[c][k]} for k in (0, 1)]
            new = {c: tuple(known[c][k] or bool(sets[k] & bases[c]) for k in (0, 1)) for c in self.classes}
            if new == known:
                break
            known = new
        return known, renamed

    # relations

    def _relation(self, source: dict, target: str, predicate: str, site, confidence: str = "EXTRACTED", provider=None) -> None:
        row = {"row_kind": "relation", "path": self.path, "source": source["id"], "target": target, "predicate": predicate, "site_file": self.path, "site_line": site[0], "site_col": site[1], "confidence": confidence}
        if provider:
            row["provenance_provider"], row["provenance_version"] = provider
        self.rows.append(row)

    def _all(self, source: dict, targets: list[dict], predicate: str, site) -> None:
        for t in targets:
            self._relation(source, t["id"], predicate, site, "EXTRACTED" if len(targets) == 1 else "AMBIGUOUS")

    def _defer(self, kind: str, source: dict, site, module_path: str | None, **more) -> None:
        self.rows.append({"row_kind": "deferred", "path": self.path, "deferred_kind": kind, "source": source["id"], "module_path": module_path, "site_file": self.path, "site_line": site[0], "site_col": site[1], **more})

    def _imports(self) -> None:
        todo = [self.tree]
        while todo:
            node = todo.pop()
            site = (getattr(node, "lineno", 0), getattr(node, "col_offset", 0))
            if isinstance(node, ast.Import):
                for a in node.names:
                    self._relation(self.module, a.name, "imports", site)
            elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
                base = package_of(self.path, node.level) if node.level else ""
                if base is not None:
                    base = ".".join(p for p in (base, node.module) if p)
                    for a in node.names:
                        if a.name != "*":
                            self._relation(self.module, f"{base}.{a.name}" if base else a.name, "imports", site)
                            self.aliases[a.asname or a.name] = base
            todo += reversed(list(ast.iter_child_nodes(node)))

    def _defines(self) -> None:
        last = {s["qualname"]: s for s in self.symbols if s["kind"] == "class"}
        for s in self.symbols[1:]:
            owner = last[s["qualname"].rpartition(".")[0]] if "." in s["qualname"] else self.module
            self._relation(owner, s["id"], "defines", (s["start_line"], s["start_col"]))

    def _classes_named(self, name: str) -> list[dict]:
        return [s for s in self.top.get(name, ()) if s["kind"] == "class"]

    def _inherits(self) -> None:
        for place, bases in self.bases.items():
            for name, node in bases:
                site, own = (node.lineno, node.col_offset), self._classes_named(name)
                if own:
                    self._all(self.at[place], own, "inherits", site)
                elif name in self.aliases:
                    self._defer("inherit", self.at[place], site, self.aliases[name], name=name)

    def _overrides(self) -> None:
        for c in self.classes:
            if c.decorator_list:
                continue
            own: dict[str, list[dict]] = defaultdict(list)
            for m in c.body:
                if isinstance(m, FUNCTIONS):
                    own[m.name].append(self.at[m.lineno, m.col_offset])
            bases = self.bases[c.lineno, c.col_offset]
            here = sorted({s["qualname"] for name, _ in bases for s in self._classes_named(name)})
            imported = [(name, self.aliases[name]) for name, _ in bases if not self._classes_named(name) and name in self.aliases]
            for name, mine in own.items():
                over = [m for q in here for m in (self.methods[q][name] if q in self.methods and name in self.methods[q] else ())]
                sure = len(over) == 1 and len(mine) == 1
                for m in mine:
                    site = (m["start_line"], m["start_col"])
                    for t in over:
                        self._relation(m, t["id"], "overrides", site, "EXTRACTED" if sure else "AMBIGUOUS")
                    for base, module in imported:
                        self._defer("override", m, site, module, base_name=base, method_name=name)

    def _calls(self) -> None:
        todo: list[tuple[ast.AST, dict, dict | None]] = [(self.tree, self.module, None)]
        while todo:
            node, source, cls = todo.pop()
            outer = source, cls
            if isinstance(node, ast.ClassDef):
                cls = self.at.get((node.lineno, node.col_offset), cls)
            elif isinstance(node, FUNCTIONS):
                source = self.at.get((node.lineno, node.col_offset), source)
            elif isinstance(node, ast.Call):
                self._call(node.func, source, cls)
            elif isinstance(node, (ast.Assign, ast.AnnAssign)) and isinstance(node.value, ast.Name):
                self._all(source, self.top.get(node.value.id, []), "references", (node.value.lineno, node.value.col_offset))
            marks = getattr(node, "decorator_list", ())
            todo += [(c, *(outer if c in marks else (source, cls))) for c in reversed(list(ast.iter_child_nodes(node)))]

    def _call(self, func: ast.expr, source: dict, cls: dict | None) -> None:
        if isinstance(func, ast.Name):
            site = (func.lineno, func.col_offset)
            if self.top.get(func.id):
                self._all(source, self.top[func.id], "calls", site)
            elif func.id in self.aliases:
                self._defer("call", source, site, self.aliases[func.id], name=func.id)
        elif isinstance(func, ast.Attribute) and isinstance(func.value, ast.Name):
            site, base = attribute_site(func), func.value.id
            if base == "self" and cls is not None:
                self._self_call(func.attr, source, cls, site)
            elif base in self.aliases:
                self._defer("attribute_call", source, site, self.aliases[base], name=base, attribute=func.attr)

    def _method(self, qualname: str, name: str) -> list[dict]:
        return self.methods[qualname][name] if qualname in self.methods and name in self.methods[qualname] else []

    def _self_call(self, name: str, source: dict, cls: dict, site) -> None:
        """Own methods, else those of the nearest bases in the file; imported bases are deferred."""
        found, imported = self._method(cls["qualname"], name), []
        if not found:
            queue = [n for n, _ in self.bases.get((cls["start_line"], cls["start_col"]), ())]
            seen = {cls["qualname"]}
            for base in queue:  # grows while it is walked
                own = self._classes_named(base)
                if not own and base in self.aliases and (base, self.aliases[base]) not in imported:
                    imported.append((base, self.aliases[base]))
                for b in own:
                    if b["qualname"] in seen:
                        continue
                    seen.add(b["qualname"])
                    if m := self._method(b["qualname"], name):
                        found = [*found, *m]
                    else:
                        queue += [n for n, _ in self.bases.get((b["start_line"], b["start_col"]), ())]
        for base, module in imported:
            self._defer("self_call", source, site, module, base_name=base, method_name=name, enclosing_class=cls["id"])
        if not found and not imported:
            self._defer("self_call", source, site, None, method_name=name, enclosing_class=cls["id"])
        self._all(source, found, "calls", site)

    # fixtures

    def _fixtures(self) -> None:
        members = [(None, n) for n in self.tree.body if isinstance(n, FUNCTIONS)]
        members += [(c.name, m) for c in self.classes for m in c.body if isinstance(m, FUNCTIONS)]
        public: dict[str | None, dict[str, list[dict]]] = defaultdict(lambda: defaultdict(list))
        fixtures = set()
        for cls, m in members:
            marks = [d for d in m.decorator_list if self._is_fixture(d)]
            if marks:
                row = self.at[m.lineno, m.col_offset]
                fixtures.add(row["id"])
                public[cls][_public_name(marks[0], m.name)].append(row)
        base = self.path.rpartition("/")[2]
        tests = base.endswith(".py") and (base.startswith("test_") or base.endswith("_test.py"))
        for cls, m in members:
            row = self.at[m.lineno, m.col_offset]
            if row["id"] not in fixtures and not (tests and m.name.startswith("test_")):
                continue
            for arg in _mandatory(m.args):
                if arg.arg in ("self", "cls"):
                    continue
                own = public[cls].get(arg.arg) if cls is not None and cls in public else None
                for f in own or (public[None].get(arg.arg, ()) if None in public else ()):
                    if f["id"] != row["id"]:
                        self._relation(row, f["id"], "calls", (arg.lineno, arg.col_offset), "AMBIGUOUS", FIXTURES)

    def _is_fixture(self, node: ast.expr) -> bool:
        head = node.func if isinstance(node, ast.Call) else node
        if isinstance(head, ast.Attribute):
            return isinstance(head.value, ast.Name) and head.value.id == "pytest" and head.attr == "fixture"
        return isinstance(head, ast.Name) and head.id == "fixture" and self.aliases.get("fixture") == "pytest"


def _empty(m) -> bool:
    """A body of one ``pass``, ``...`` or string."""
    s = m.body[0]
    if len(m.body) != 1 or not isinstance(s, (ast.Pass, ast.Expr)):
        return False
    return isinstance(s, ast.Pass) or isinstance(s.value, ast.JoinedStr) or isinstance(s.value, ast.Constant) and (s.value.value is ... or isinstance(s.value.value, str))


def _public_name(mark: ast.expr, default: str) -> str:
    for k in mark.keywords if isinstance(mark, ast.Call) else ():
        if k.arg == "name" and isinstance(k.value, ast.Constant) and isinstance(k.value.value, str):
            return k.value.value
    return default


def _mandatory(a: ast.arguments) -> list[ast.arg]:
    plain = [*a.posonlyargs, *a.args]
    return plain[: len(plain) - len(a.defaults)] + [x for x, d in zip(a.kwonlyargs, a.kw_defaults) if d is None]


def parse(text: str) -> ast.Module | None:
    """The tree, or None for a text with any syntax error, which keeps a whole file out."""
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def facts_of(path: str, text: str, observed_at: str) -> list[dict]:
    tree = parse(text)
    if tree is None:
        return [{"row_kind": "error", "path": path, "observed_at": observed_at}]
    rows = FileFacts(path, text, tree).rows
    return [{"provenance_provider": PROVIDER, "provenance_version": VERSION, **r, "observed_at": observed_at} for r in rows]


def extract(files: DataFrame, observed_at: str) -> DataFrame:
    """All facts of ``files`` (path, source), tagged by ``row_kind``: symbol, relation, deferred or error."""
    ship(files.sparkSession)
    columns = names(FACTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for path, text in zip(pdf["path"], pdf["source"]) for r in facts_of(path, text or "", observed_at)]
            out = pd.DataFrame(rows, columns=columns, dtype=object)
            for c in ("start_line", "start_col", "end_line", "end_col", "site_line", "site_col"):
                out[c] = pd.array([None if v is None or v != v else int(v) for v in out[c]], dtype="Int32")
            yield out.where(out.notna(), None)

    return files.select("path", "source").mapInPandas(run, FACTS)


def symbols_of(facts: DataFrame) -> DataFrame:
    return facts.where("row_kind = 'symbol'").select(*names(SYMBOLS))


def relations_of(facts: DataFrame) -> DataFrame:
    return facts.where("row_kind = 'relation'").select(*names(RELATIONS))


def deferred_of(facts: DataFrame) -> DataFrame:
    return facts.where("row_kind = 'deferred'").select(*names(DEFERRED))


def broken(facts: DataFrame) -> DataFrame:
    return facts.where("row_kind = 'error'").select("path", F.lit(True).alias("has_syntax_error"))
