"""Whole jobs as catalogue queries: index batches over generated sources, a repository on disk, the ten tools.

Expected rows of the generated sources follow from their text, so their SQL is a list of facts of one file
crossed with the table that the files are made of.
"""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..model import RELATION_KEY
from ..operators import enrichment, scans
from ..operators.pages import decode_cursor, encode_cursor
from ..operators.tables import shared_dir, written
from ..sources import git
from ..sources.hooks import diff_paths
from ..sources.layers import parse_layers
from ..sources.repo import read_repo, to_repo_relative, with_hash
from ..streaming import watch
from . import upkeep
from .catalogue import QUERIES, SQL, query
from .extract import deferred_of, extract, package_of, relations_of, symbols_of
from .index import enrich, index_files, scan
from .projection import Projection, ctes
from .store import Store
from .tools import Engine, render_relation, render_symbol

_made: dict[tuple, object] = {}


def _once(p: Projection, name: str, make: Callable[[Projection], object]):
    """What ``make`` gives, made once for a session and folder."""
    key = (p.spark.sparkContext.applicationId, p.sf_dir, name)
    if key not in _made:
        _made[key] = make(p)
    return _made[key]


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of constant rows."""

    def one(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def _constant(name: str, columns: str, rows: list[tuple], casts: str | None = None):
    """Register a query whose rows do not depend on the tables; ``casts`` is its select list."""
    return query(name, None, f"WITH {_values('v', columns, rows)}\nSELECT {casts or columns} FROM v")


# one generated file for each supplier, with redefinitions, base chains, fixtures and references

RICH = """\
import pytest
from typing import Protocol
class Root:
    def deep(self):
        return 1
class Left(Root):
    def m(self):
        return 2
class Right(Root):
    def m(self):
        return self.deep()
class Both(Left, Right):
    def m(self):
        return 3
    def run(self):
        self.m()
        self.deep()
def twice():
    return 1
def twice():
    return twice()
@pytest.fixture
def res():
    return twice
@pytest.fixture(name="other")
def original(res):
    return res
def test_one(res, other):
    return Both()
held = twice
class Shape(Protocol):
    def area(self): ...
"""
LATER = """\
import pytest
class Root:
    def deep(self):
        return 2
def late():
    return Root()
"""
#: (qualname, kind, ordinal, start_line, start_col, end_line, end_col, is_stub) of RICH.
RICH_SYMBOLS = [
    ("", "module", None, 1, 0, 33, 0, False),
    ("Root", "class", None, 3, 0, 5, 16, False), ("Root.deep", "method", None, 4, 4, 5, 16, False),
    ("Left", "class", None, 6, 0, 8, 16, False), ("Left.m", "method", None, 7, 4, 8, 16, False),
    ("Right", "class", None, 9, 0, 11, 26, False), ("Right.m", "method", None, 10, 4, 11, 26, False),
    ("Both", "class", None, 12, 0, 17, 19, False), ("Both.m", "method", None, 13, 4, 14, 16, False), ("Both.run", "method", None, 15, 4, 17, 19, False),
    ("twice", "function", None, 18, 0, 19, 12, False), ("twice", "function", 2, 20, 0, 21, 18, False),
    ("res", "function", None, 23, 0, 24, 16, False), ("original", "function", None, 26, 0, 27, 14, False), ("test_one", "function", None, 28, 0, 29, 17, False),
    ("Shape", "class", None, 31, 0, 32, 23, False), ("Shape.area", "method", None, 32, 4, 32, 23, True),
]
#: (source, target, line, column, confidence) by predicate; "" is the module, names are of this file.
RICH_EDGES = {
    "imports": [("", "!pytest", 1, 0, "EXTRACTED"), ("", "!typing.Protocol", 2, 0, "EXTRACTED")],
    "inherits": [("Left#class", "Root#class", 6, 11, "EXTRACTED"), ("Right#class", "Root#class", 9, 12, "EXTRACTED"), ("Both#class", "Left#class", 12, 11, "EXTRACTED"), ("Both#class", "Right#class", 12, 17, "EXTRACTED")],
    "overrides": [("Both.m#method", "Left.m#method", 13, 4, "AMBIGUOUS"), ("Both.m#method", "Right.m#method", 13, 4, "AMBIGUOUS")],
    "calls": [
        ("Right.m#method", "Root.deep#method", 11, 20, "EXTRACTED"), ("Both.run#method", "Both.m#method", 16, 13, "EXTRACTED"), ("Both.run#method", "Root.deep#method", 17, 13, "EXTRACTED"),
        ("twice#function@2", "twice#function", 21, 11, "AMBIGUOUS"), ("twice#function@2", "twice#function@2", 21, 11, "AMBIGUOUS"), ("test_one#function", "Both#class", 29, 11, "EXTRACTED"),
        ("original#function", "res#function", 26, 13, "AMBIGUOUS"), ("test_one#function", "res#function", 28, 13, "AMBIGUOUS"), ("test_one#function", "original#function", 28, 18, "AMBIGUOUS"),
    ],
    "references": [("", "twice#function", 30, 7, "AMBIGUOUS"), ("", "twice#function@2", 30, 7, "AMBIGUOUS")],
}
FILES = "files AS (SELECT 'rich/test_s' || s_suppkey || '.py' AS path, s_suppkey AS k FROM supplier)"
_SYMS = _values("syms", "qualname, kind, ordinal, start_line, start_col, end_line, end_col, is_stub", RICH_SYMBOLS)
_ID = "path || ':' || qualname || '#' || kind || CASE WHEN ordinal IS NULL THEN '' ELSE '@' || ordinal END"


def _rich(p: Projection, text: str = RICH) -> DataFrame:
    return p.table("supplier").select(F.concat(F.lit("rich/test_s"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path"), F.lit(text).alias("source"), F.col("s_suppkey").alias("k"))


def _rich_facts(p: Projection) -> DataFrame:
    return _once(p, "rich-facts", lambda p: written(extract(_rich(p).select("path", "source"), "t")))


@query("rich_symbols", None, f"WITH {FILES},\n{_SYMS}\nSELECT {_ID} AS id, path, qualname, start_line, start_col, end_line, end_col, is_stub FROM files, syms")
def _(p):
    return symbols_of(_rich_facts(p)).select("id", "path", "qualname", "start_line", "start_col", "end_line", "end_col", "is_stub")


def _edge_sql(predicate: str) -> str:
    rows = [(a or "#module", b, line, col, c) for a, b, line, col, c in RICH_EDGES[predicate]]
    target = "CASE WHEN b[1] = '!' THEN b[2:] ELSE path || ':' || b END"
    return f"WITH {FILES},\n{_values('e', 'a, b, site_line, site_col, confidence', rows)}\nSELECT path || ':' || a AS source, {target} AS target, site_line, site_col, confidence FROM files, e"


for _predicate in RICH_EDGES:

    def _of_rich(p, predicate=_predicate):
        return relations_of(_rich_facts(p)).where(F.col("predicate") == predicate).select("source", "target", "site_line", "site_col", "confidence")

    query(f"rich_{_predicate}", None, _edge_sql(_predicate))(_of_rich)


@query("rich_render_relations", None, _edge_sql("inherits").replace("AS source,", "AS source, 'inherits' AS predicate, path AS site_file, 't' AS observed_at,"))
def _(p):
    rows = [render_relation(r, True) for r in relations_of(_rich_facts(p)).where("predicate = 'inherits'").collect()]  # four for each supplier
    told = [(r["source"], r["predicate"], r["site_file"], r["provenance"]["observed_at"], r["target"], r["site_line"], r["site_col"], r["confidence"]) for r in rows]
    return p.spark.createDataFrame(told, "source string, predicate string, site_file string, observed_at string, target string, site_line int, site_col int, confidence string")


@query("rich_render_symbols", None, f"WITH {FILES},\n{_SYMS}\nSELECT {_ID} AS id, kind, start_line, end_col FROM files, syms WHERE kind = 'class'")
def _(p):
    rows = [render_symbol(r) for r in symbols_of(_rich_facts(p)).where("kind = 'class'").collect()]
    return p.spark.createDataFrame([(r["id"], r["kind"], r["start_line"], r["end_col"]) for r in rows], "id string, kind string, start_line int, end_col int")


# index jobs: a first batch, then files that are removed, changed and left alone


def _job(p: Projection) -> tuple[Store, list[dict]]:
    store, k = Store(p.spark, f"{shared_dir(p.spark)}/job-{uuid.uuid4().hex}"), F.col("k") % 3
    first = index_files(store, _rich(p).select("path", "source"), "t1")
    text = F.when(k == 1, F.lit(LATER)).when(k == 2, F.lit(RICH))
    return store, [first, index_files(store, _rich(p).withColumn("source", text).select("path", "source"), "t2")]


def _store(p: Projection) -> Store:
    return _once(p, "job", _job)[0]


LATER_SYMBOLS = [("", "module", 1, 7, 0), ("Root", "class", 2, 4, 16), ("Root.deep", "method", 3, 4, 16), ("late", "function", 5, 6, 17)]
_JOB = f"{FILES},\n{_SYMS},\n{_values('later', 'qualname, kind, start_line, end_line, end_col', LATER_SYMBOLS)},\nold AS (SELECT k, {_ID} AS id, * FROM files, syms),\nnew AS (SELECT k, path || ':' || qualname || '#' || kind AS id, * FROM files, later WHERE k % 3 = 1)"


@query("job_symbols_live", None, f"WITH {_JOB}\nSELECT id, start_line, 't2' AS observed_at FROM old WHERE k % 3 = 2 UNION ALL SELECT id, start_line, 't2' FROM new")
def _(p):
    return _store(p).read("symbols").select("id", "start_line", "observed_at")


@query(
    "job_symbols_history", None,
    f"""WITH {_JOB}
SELECT id, false AS tombstone, 't1' AS observed_at, start_line FROM old
UNION ALL SELECT id, true, 't2', NULL FROM old o WHERE k % 3 = 0 OR k % 3 = 1 AND NOT EXISTS (SELECT 1 FROM new n WHERE n.id = o.id)
UNION ALL SELECT id, false, 't2', start_line FROM new""",
)
def _(p):
    return _store(p).read("symbols_history").select("id", "tombstone", "observed_at", "start_line")


_EDGES1 = [(a or "#module", b, q, line, col, c) for q, rows in RICH_EDGES.items() for a, b, line, col, c in rows] + [
    ("#module", f"{n}#{kind}" + (f"@{o}" if o else ""), "defines", line, col, "EXTRACTED") for n, kind, o, line, col, *_ in RICH_SYMBOLS if kind in ("class", "function")
] + [(n.split(".")[0] + "#class", f"{n}#method", "defines", line, col, "EXTRACTED") for n, kind, _, line, col, *_ in RICH_SYMBOLS if kind == "method"]
_EDGES2 = [("#module", "!pytest", "imports", 1, 0, "EXTRACTED"), ("#module", "Root#class", "defines", 2, 0, "EXTRACTED"), ("Root#class", "Root.deep#method", "defines", 3, 4, "EXTRACTED"), ("#module", "late#function", "defines", 5, 0, "EXTRACTED"), ("late#function", "Root#class", "calls", 6, 11, "EXTRACTED")]
_E = "a, b, predicate, site_line, site_col, confidence"
_NAMED = "path || ':' || a AS source, CASE WHEN b[1] = '!' THEN b[2:] ELSE path || ':' || b END AS target, predicate, path AS site_file, site_line, site_col, confidence, k"
_JOB_EDGES = f"{FILES},\n{_values('e1', _E, _EDGES1)},\n{_values('e2', _E, _EDGES2)},\nold AS (SELECT {_NAMED} FROM files, e1),\nnew AS (SELECT {_NAMED} FROM files, e2 WHERE k % 3 = 1)"
_K = ", ".join(RELATION_KEY)


@query("job_relations_live", None, f"WITH {_JOB_EDGES}\nSELECT {_K}, confidence FROM old WHERE k % 3 = 2 UNION ALL SELECT {_K}, confidence FROM new")
def _(p):
    return _store(p).read("relations").select(*RELATION_KEY, "confidence")


@query(
    "job_relations_history", None,
    f"""WITH {_JOB_EDGES}
SELECT {_K}, false AS tombstone, 't1' AS observed_at FROM old
UNION ALL SELECT {_K}, true, 't2' FROM (SELECT {_K} FROM old WHERE k % 3 < 2 EXCEPT SELECT {_K} FROM new)
UNION ALL SELECT {_K}, false, 't2' FROM (SELECT {_K} FROM new EXCEPT SELECT {_K} FROM old)""",
)
def _(p):
    return _store(p).read("relations_history").select(*RELATION_KEY, "tombstone", "observed_at")


@query("job_history_ids", None, f"WITH {_JOB_EDGES}\nSELECT true AS are_unique, 2::BIGINT AS generation")
def _(p):
    s = _store(p)
    ids = s.read("symbols_history").select("history_id").unionByName(s.read("relations_history").select("history_id"))
    return ids.agg((F.count("history_id") == F.count_distinct("history_id")).alias("are_unique"), F.lit(s.meta()["generation"]).cast("long").alias("generation"))


_N1, _N2, _R1, _R2 = len(RICH_SYMBOLS), len(LATER_SYMBOLS), len(_EDGES1), len(_EDGES2)
_COUNTERS = "batch, generation, indexed, failed, symbols, relations, symbols_tombstoned, relations_tombstoned"


@query(
    "job_counters", None,
    f"""WITH {_JOB_EDGES}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE k % 3 = 0) AS a, count(*) FILTER (WHERE k % 3 = 1) AS b, count(*) FILTER (WHERE k % 3 = 2) AS c FROM files)
SELECT 1::BIGINT AS batch, 1::BIGINT AS generation, n AS indexed, 0::BIGINT AS failed, n * {_N1} AS symbols, n * {_R1} AS relations, 0::BIGINT AS symbols_tombstoned, 0::BIGINT AS relations_tombstoned FROM n
UNION ALL SELECT 2, 2, b + c, 0, b * {_N2} + c * {_N1}, b * {_R2} + c * {_R1}, a * {_N1} + b * {_N1 - 3}, (SELECT count(*) FROM (SELECT {_K} FROM old WHERE k % 3 < 2 EXCEPT SELECT {_K} FROM new)) FROM n""",
)
def _(p):
    rows = [(n, *(r[c] for c in _COUNTERS.split(", ")[1:])) for n, r in enumerate(_once(p, "job", _job)[1], 1)]
    return p.spark.createDataFrame(rows, ", ".join(f"{c} long" for c in _COUNTERS.split(", ")))


@query("job_explain", None, f"WITH {_JOB}\nSELECT id, start_line, observed_at, deleted FROM (VALUES ('rich/test_s1.py:Root.deep#method', 3, 't2', false), ('rich/test_s1.py:Root.deep#method', 4, 't1', false), ('rich/test_s3.py:twice#function@2', 20, 't1', true)) v(id, start_line, observed_at, deleted)")
def _(p):
    engine, rows = Engine.of(_store(p)), []
    for id_ in ("rich/test_s1.py:Root.deep#method", "rich/test_s3.py:twice#function@2"):
        cursor = None
        while True:  # one observation a page
            got = engine.call("explain", {"symbol_id": id_, "limit": 1, "cursor": cursor})["result"]
            rows += [(r["id"], r["start_line"], r["provenance"]["observed_at"], r.get("deleted", False)) for r in got["results"]]
            cursor = got["next_cursor"]
            if cursor is None:
                break
    return p.spark.createDataFrame(rows, "id string, start_line int, observed_at string, deleted boolean")


STUBBY = """\
from typing import Protocol
class P(Protocol):
    def go(self): ...
class Impl(P):
    def go(self):
        return 1
class User(P):
    def use(self):
        self.go()
class Mix:
    def act(self):
        self.other()
class Whole(Mix, Helper):
    pass
class Helper:
    def other(self):
        pass
"""


def _enriched(p: Projection) -> DataFrame:
    """Calls of a file by step: extracted, enriched, indexed again with and without its inferred edges."""
    files = p.spark.createDataFrame([("m.py", STUBBY)], "path string, source string")
    store, parts = Store(p.spark, f"{shared_dir(p.spark)}/job-{uuid.uuid4().hex}"), []

    def told(step: str) -> None:
        calls = store.read("relations").where("predicate = 'calls'")
        parts.append(written(calls.select(F.lit(step).alias("step"), "source", "target", "confidence", enrichment.is_stub_relation().alias("is_stub_relation"))))

    index_files(store, files, "t1")
    told("1 indexed")
    enrich(store, files, "t2")
    told("2 enriched")
    index_files(store, files, "t3", prune_inferred=False)
    told("3 kept")
    index_files(store, files, "t4")
    told("4 pruned")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


_PLAIN = ("m.py:User.use#method", "m.py:P.go#method", "EXTRACTED", False)
_FOUND = [("m.py:User.use#method", "m.py:Impl.go#method", "INFERRED", True), ("m.py:Mix.act#method", "m.py:Helper.other#method", "INFERRED", True)]


@_constant("job_enrichment", "step, source, target, confidence, is_stub_relation", [("1 indexed", *_PLAIN), *[(s, *r) for s in ("2 enriched", "3 kept") for r in (_PLAIN, *_FOUND)], ("4 pruned", *_PLAIN)])
def _(p):
    return _once(p, "enriched", _enriched)


def _located(p: Projection) -> DataFrame:
    """Answers of a definition provider: one answer counts, several or one outside the repository do not."""
    store = Store(p.spark, f"{shared_dir(p.spark)}/job-{uuid.uuid4().hex}")
    put = p.spark.createDataFrame([("a.py", "def f():\n    pass\nclass C:\n    def m(self):\n        pass\n"), ("b.py", "x.f()\ny.m()\nz.f()\nw.f()\n")], "path string, source string")
    index_files(store, put, "t1")
    uri = lambda path: f"file:///work/re%20po/{path}"
    at = lambda path, line, col, link: {("targetUri" if link else "uri"): uri(path), ("targetSelectionRange" if link else "range"): {"start": {"line": line, "character": col}}}
    replies = [
        (1, json.dumps(at("a.py", 0, 4, False))), (2, json.dumps([at("a.py", 3, 8, True)])), (3, json.dumps([at("a.py", 0, 4, False), at("a.py", 1, 4, False)])),
        (4, json.dumps({"uri": "file:///elsewhere/a.py", "range": {"start": {"line": 0, "character": 4}}})), (5, "null"), (6, "[]"), (7, "{"),
    ]
    sites = p.spark.createDataFrame([("b.py:#module", "b.py", n, 2, "calls", reply) for n, reply in replies], "source string, site_file string, site_line int, site_col int, predicate string, reply string")
    locations = enrichment.parsed_replies(sites, "/work/re po")
    enrich(store, put.where("path = 'b.py'"), "t2", locations, ("provider", "9"))
    return store.read("relations").where("predicate = 'calls'").select("source", "target", "site_line", "confidence", "provenance_provider")


@_constant("job_locations", "source, target, site_line, confidence, provenance_provider", [("b.py:#module", "a.py:f#function", 1, "INFERRED", "provider"), ("b.py:#module", "a.py:C.m#method", 2, "INFERRED", "provider")])
def _(p):
    return _located(p)


# a repository on disk

TREE = {
    "a.py": "import os\n\n\nclass Base:\n    def run(self):\n        pass\n\n\nclass Child(Base):\n    def run(self):\n        return helper()\n\n\ndef helper():\n    return 1\n",
    "test_b.py": "from a import helper\n\n\ndef test_helper():\n    assert helper() == 1\n",
    "bad.py": "def (:\n", "skipped.py": "x = 1\n", "notes.txt": "no code\n", "gen/made.py": "y = 1\n", "gen/kept.py": "z = 1\n", ".hidden/in.py": "w = 1\n",
    "pkg/__init__.py": "from . import m\n", "pkg/m.py": "import pkg\n", "pkg/sub/deep.py": "from .. import m\nfrom ... import gone\n",
    ".gitignore": "# rules\nskipped.py\n/gen/*\n!gen/kept.py\n",
    ".layers.json": '{"layers": {"app": ["a.py"], "tests": ["test_*"]}, "allowed_dependencies": {"app": []}}',
}
SEEN = ["a.py", "bad.py", "gen/kept.py", "pkg/__init__.py", "pkg/m.py", "pkg/sub/deep.py", "test_b.py"]


def _write(root: str, files: dict[str, str]) -> None:
    for path, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
        with open(os.path.join(root, path), "w", encoding="utf-8") as f:
            f.write(text)


def _git(root: str, *args: str) -> None:
    subprocess.run(["git", "-C", root, "-c", "user.name=x", "-c", "user.email=x@y", *args], check=True, capture_output=True)


def _folder(p: Projection) -> str:
    """A new folder of the shared one where that is a local path, so that executors on this machine see it."""
    top = shared_dir(p.spark).removeprefix("file://")
    if not os.path.isdir(top):
        try:
            os.makedirs(top, exist_ok=True)
        except OSError:
            top = tempfile.gettempdir()
    return tempfile.mkdtemp(prefix="repo-", dir=top)


def _repo(p: Projection) -> tuple[str, Store, dict]:
    root = os.path.realpath(_folder(p))
    _write(root, TREE)
    _git(root, "init", "-q")
    _git(root, "add", "-A")
    _git(root, "commit", "-qm", "one")
    store = Store(p.spark, f"{shared_dir(p.spark)}/job-{uuid.uuid4().hex}")
    return root, store, scan(store, root, "t1").as_dict()


def _tree(p: Projection) -> tuple[str, Store, dict]:
    return _once(p, "tree", _repo)


@_constant("repo_files", "path, source", [(s, TREE[s]) for s in SEEN], "path, sha256(source) AS content_hash")
def _(p):
    return with_hash(read_repo(p.spark, _tree(p)[0])).select("path", "content_hash")


@_constant("repo_files_by_glob", "path", [(s,) for s in SEEN if s.startswith("pkg/")])
def _(p):
    return read_repo(p.spark, _tree(p)[0], "pkg/*").select("path")


@_constant("repo_files_named", "path", [("a.py",), ("pkg/m.py",)])
def _(p):
    return read_repo(p.spark, _tree(p)[0], paths=["a.py", "pkg/m.py", "skipped.py", "never.py"]).select("path")


@_constant("repo_relative_paths", "path, inside", [("a/b.py", "a/b.py"), ("a/../b.py", "b.py"), ("../b.py", None), ("/repo/x.py", "x.py"), ("/other/x.py", None)])
def _(p):
    return p.spark.createDataFrame([(s, to_repo_relative("/repo", s)) for s in ("a/b.py", "a/../b.py", "../b.py", "/repo/x.py", "/other/x.py")], "path string, inside string")


_BASES = [("pkg/mod.py", 1, "pkg"), ("pkg/mod.py", 2, None), ("pkg/__init__.py", 1, "pkg"), ("pkg/__init__.py", 2, ""), ("a/b/c.py", 2, "a"), ("a/b/c.py", 3, None), ("__init__.py", 1, "")]


@_constant("relative_import_bases", "path, level, base", _BASES, "path, level, base, base AS by_expression")
def _(p):
    rows = p.spark.createDataFrame([(a, n, package_of(a, n)) for a, n, _ in _BASES], "path string, level int, base string")
    return rows.withColumn("by_expression", X.relative_import_base("path", "level"))


@_constant("layer_file", "layer, pattern, may_use", [("app", "a.py", ""), ("tests", "test_*", None)])
def _(p):
    got = parse_layers(TREE[".layers.json"])
    return p.spark.createDataFrame([(n, g, ",".join(got.allowed[n]) if n in got.allowed else None) for n, globs in got.layers.items() for g in globs], "layer string, pattern string, may_use string")


@_constant("diff_order", "n, path", [(0, "b.py"), (1, "a.py"), (2, "c.py")])
def _(p):
    text = "--- a/b.py\n+++ b/a.py\n+++ b/b.py\n--- a/\n+++ /dev/null\n--- a/c.py\n+++ b/a.py\n"
    return p.spark.createDataFrame([(text,)], "d string").select(F.posexplode(diff_paths("d")).alias("n", "path"))


@_constant("cursors", "generation, key", [(7, "src/a.py|3|0")], "generation::BIGINT AS generation, key, true AS same")
def _(p):
    generation, key = decode_cursor(encode_cursor(7, ["src/a.py", 3, 0]))
    return p.spark.createDataFrame([(generation, "|".join(map(str, key)), encode_cursor(generation, key) == encode_cursor(7, key))], "generation long, key string, same boolean")


@_constant("scan_result", "files_indexed, files_failed, symbols, generation", [(6, 1, 12, 1)], "files_indexed::BIGINT AS files_indexed, files_failed::BIGINT AS files_failed, symbols::BIGINT AS symbols, generation::BIGINT AS generation")
def _(p):
    r = _tree(p)[2]
    return p.spark.createDataFrame([tuple(r[c] for c in ("files_indexed", "files_failed", "symbols", "generation"))], "files_indexed long, files_failed long, symbols long, generation long")


def _changed(p: Projection) -> DataFrame:
    root = os.path.realpath(_folder(p))
    _write(root, {"a.py": "a = 1\n", "b.py": "b = 1\n", "c.py": "c = 1\n"})
    _git(root, "init", "-q")
    _git(root, "add", "-A")
    _git(root, "commit", "-qm", "one")
    since, marks = git.head_sha(root), [git.fingerprint(root)]
    _write(root, {"b.py": "b = 2\n"})
    _git(root, "commit", "-qam", "two")
    marks.append(git.fingerprint(root))
    _write(root, {"c.py": "c = 2\n"})
    marks.append(git.fingerprint(root))
    _write(root, {"new.py": "n = 1\n"})
    marks.append(git.fingerprint(root))
    found = git.changed_paths(root, since, ["a.py", "gone.py"])
    same = git.fingerprint(root) == marks[-1]
    return p.spark.createDataFrame([(f, len(set(marks)) == len(marks), same, len(git.worktree_ids(root)[0])) for f in found], "path string, each_mark_is_new boolean, mark_is_stable boolean, id_length int")


@_constant("git_changed_paths", "path", [("b.py",), ("c.py",), ("gone.py",), ("new.py",)], "path, true AS each_mark_is_new, true AS mark_is_stable, 16 AS id_length")
def _(p):
    return _changed(p)


def _kept_current(p: Projection) -> DataFrame:
    """Symbols of a repository after each way of keeping its index current."""
    root, rows = os.path.realpath(_folder(p)), []
    _write(root, {"a.py": "def f(): pass\n"})
    _git(root, "init", "-q")
    _git(root, "add", "-A")
    _git(root, "commit", "-qm", "one")
    store = Store(p.spark, f"{shared_dir(p.spark)}/job-{uuid.uuid4().hex}")
    scan(store, root, "t0")
    upkeep.remember_head(store, root)

    def told(step: str, n: int, of: Store = store) -> None:
        rows.extend((step, n, r["id"]) for r in of.read("symbols").where("kind <> 'module'").collect())

    told("1 nothing new", upkeep.refresh(store, root, ["a.py"], "t1"))
    _write(root, {"a.py": "def g(): pass\n"})
    told("2 edited", upkeep.refresh(store, root, ["a.py", "never.py"], "t2"))
    _write(root, {"b.py": "def b(): pass\n"})
    told("3 hook", upkeep.notify(store, root, "claude-code", json.dumps({"tool_input": {"file_path": "b.py"}}), "t3"))
    _write(root, {"c.py": "def c(): pass\n"})
    _git(root, "add", "-A")
    _git(root, "commit", "-qm", "two")
    told("4 commit", upkeep.notify(store, root, "git", "", "t4"))
    tree = os.path.join(os.path.dirname(root), f"wt-{uuid.uuid4().hex}")
    _git(root, "worktree", "add", "-q", tree, "-b", "other")
    os.remove(os.path.join(tree, "a.py"))
    _write(tree, {"d.py": "def d(): pass\n"})
    told("5 worktree", 0, upkeep.seed_worktree(store, root, f"{shared_dir(p.spark)}/job-{uuid.uuid4().hex}", tree, "t5"))
    os.remove(os.path.join(root, "b.py"))
    told("6 removed", upkeep.refresh(store, root, ["b.py"], "t6"))
    store.commit({}, {}, bump=False, cross_file_pass_version=1)
    told("7 caught up", int(upkeep.catch_up(store, root, "t7")) + int(upkeep.catch_up(store, root, "t7")))
    told("8 enriched", int(upkeep.enrich_if_changed(store, root, "t8")) + int(upkeep.enrich_if_changed(store, root, "t8")))
    return p.spark.createDataFrame(rows, "step string, n_files int, id string")


_A, _G, _B, _C, _D = "a.py:f#function", "a.py:g#function", "b.py:b#function", "c.py:c#function", "d.py:d#function"


@_constant("job_upkeep", "step, n_files, id", [
    ("1 nothing new", 0, _A), ("2 edited", 1, _G), *[("3 hook", 1, i) for i in (_G, _B)], *[("4 commit", 1, i) for i in (_G, _B, _C)], *[("5 worktree", 0, i) for i in (_B, _C, _D)],
    *[(s, 1, i) for s in ("6 removed", "7 caught up", "8 enriched") for i in (_G, _C)],
])
def _(p):
    return _once(p, "upkeep", _kept_current)


def _streamed(p: Projection) -> DataFrame:
    """Symbols after each run of a stream of file events that reindexes what they name."""
    root, src, rows = os.path.realpath(_folder(p)), _folder(p), []
    store = Store(p.spark, f"{shared_dir(p.spark)}/job-{uuid.uuid4().hex}")
    store.create()
    run, state = watch.reindexer(store, root, "t"), f"{shared_dir(p.spark)}/stream-{uuid.uuid4().hex}"

    def send(step: str, *paths: str) -> None:
        with open(os.path.join(src, f"{step[0]}.json"), "w", encoding="utf-8") as f:
            f.writelines(json.dumps({"ts": "2024-01-01T00:00:00", "worktree_id": "w", "event": "modified", "path": x}) + "\n" for x in paths)
        events = p.spark.readStream.schema(watch.EVENTS).json(f"file://{src}")
        events.writeStream.foreachBatch(run).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        rows.extend((step, store.meta()["generation"], r["id"]) for r in store.read("symbols").collect())

    _write(root, {"m.py": "def f(): pass\n", "skip.py": "x = 1\n", ".gitignore": "skip.py\n"})
    send("1 new", "m.py", "notes.txt", "skip.py")
    send("2 the same", "m.py")
    os.utime(os.path.join(root, "m.py"), ns=(1, 1))
    send("3 touched", "m.py")
    os.rename(os.path.join(root, "m.py"), os.path.join(root, "n.py"))
    send("4 renamed", "m.py", "n.py")
    _write(root, {".gitignore": "n.py\n", "skip.py": "x = 2\n"})
    send("5 rules changed", ".gitignore", "skip.py", "n.py")
    return p.spark.createDataFrame(rows, "step string, generation long, id string")


_MF, _NF = ["m.py:#module", "m.py:f#function"], ["n.py:#module", "n.py:f#function"]


@_constant("stream_reindex", "step, generation, id", [
    *[(s, 1, i) for s in ("1 new", "2 the same", "3 touched") for i in _MF], *[("4 renamed", 2, i) for i in _NF], *[("5 rules changed", 3, i) for i in (*_NF, "skip.py:#module")],
], "step, generation::BIGINT AS generation, id")
def _(p):
    return _once(p, "streamed", _streamed)


_PATHS = [("a.py", True), ("a.txt", False), ("gen/x.py", False), ("gen/kept.py", True), ("skipped.py", False), ("sub/skipped.py", False), ("a.pyc", False), ("deep/gen/x.py", True)]


@_constant("relevant_events", "path", [(a,) for a, ok in _PATHS if ok])
def _(p):
    from ..sources.ignore import rules

    rows = p.spark.createDataFrame([("w", a) for a, _ in _PATHS], "worktree_id string, path string")
    return watch.relevant(rows, rules([("", TREE[".gitignore"])])).select("path")


# the ten tools over the projected index


def _engine(p: Projection) -> Engine:
    return Engine(p.symbols, p.relations, generation=7)


def _pages(engine: Engine, method: str, params: dict, pages: int) -> list[tuple[int, dict, dict]]:
    """(page, envelope, row) of the first pages of a tool's answer."""
    out, cursor = [], None
    for n in range(1, pages + 1):
        got = engine.call(method, {**params, "cursor": cursor})["result"]
        out += [(n, got, r) for r in got["results"]]
        cursor = got["next_cursor"]
        if cursor is None:
            break
    return out


def _paged(p: Projection, method: str, params: dict, pages: int, columns: str) -> DataFrame:
    """The rows of several pages with their page and envelope; ``columns`` have their types."""
    names = [c.split()[0] for c in columns.split(", ")]
    rows = [(n, e["index_generation"], e["total_count"], e["truncated"], *(r[c] for c in names)) for n, e, r in _pages(_engine(p), method, params, pages)]
    return p.spark.createDataFrame(rows, "page int, index_generation int, total_count long, truncated boolean, " + columns)


def _page_sql(found: str, order: str, columns: str, limit: int, pages: int) -> str:
    return f"""SELECT ((r - 1) // {limit} + 1)::INT AS page, 7 AS index_generation, total AS total_count, total > ((r - 1) // {limit} + 1) * {limit} AS truncated, {columns}
FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS r, count(*) OVER () AS total FROM ({found})) WHERE r <= {limit * pages}"""


@query("tool_find_symbol", "symbols", _page_sql("SELECT * FROM symbols WHERE contains(qualname, 'S1')", "id", "id, kind, start_line, confidence", 10, 3))
def _(p):
    return _paged(p, "find_symbol", {"name": "S1", "limit": 10, "full": True}, 3, "id string, kind string, start_line int, confidence string")


@query("tool_get_definition", "symbols", "SELECT id, kind, qualname, 1::BIGINT AS total_count FROM symbols WHERE kind = 'class' AND qualname IN ('S1', 'S2')")
def _(p):
    engine, rows = _engine(p), []
    for r in p.symbols.where("kind = 'class' AND qualname IN ('S1', 'S2')").collect():
        by = {"symbol_id": r["id"]} if r["qualname"] == "S1" else {"position": {"file": r["path"], "line": r["start_line"], "column": r["start_col"]}}
        got = engine.call("get_definition", by)["result"]
        rows += [(x["id"], x["kind"], x["qualname"], got["total_count"]) for x in got["results"]]
    return p.spark.createDataFrame(rows, "id string, kind string, qualname string, total_count long")


_REF = "site_file, site_line, site_col, predicate, source, target"


@query("tool_find_references", "relations", _page_sql("SELECT * FROM relations WHERE predicate <> 'imports' AND target IN (SELECT id FROM symbols WHERE qualname = 'S1.m1')", _REF, _REF, 5, 3))
def _(p):
    id_ = p.symbols.where("qualname = 'S1.m1'").collect()[0]["id"]
    return _paged(p, "find_references", {"symbol_id": id_, "limit": 5}, 3, "site_file string, site_line int, site_col int, predicate string, source string, target string")


@query("tool_list_imports", "relations", _page_sql("SELECT * FROM relations WHERE site_file = 'tests/test_n2.py' AND predicate = 'imports'", "site_line, site_col, target", "target, site_line", 2, 3))
def _(p):
    return _paged(p, "list_imports", {"file": "tests/test_n2.py", "limit": 2}, 3, "target string, site_line int")


_CALLED = """root AS (SELECT id FROM methods WHERE pk = 0),
walk(id, level) AS (SELECT id, 0 FROM root UNION SELECT target, 1 FROM root JOIN relations ON source = id AND predicate = 'calls'),
near AS (SELECT id, min(level) AS level FROM walk GROUP BY id)"""


@query("tool_graph_nodes", "relations", _CALLED + "\nSELECT n.id, s.kind, s.id IS NOT NULL AS resolved FROM near n LEFT JOIN symbols s ON s.id = n.id")
def _(p):
    got = _engine(p).call("graph", {"root": p.method_id(), "graph_type": "call", "direction": "downstream", "node_cap": 1000, "depth_clamp": 1})["result"]
    return p.spark.createDataFrame([(n["id"], n.get("kind"), n["resolved"]) for n in got["nodes"]], "id string, kind string, resolved boolean")


@query("tool_graph_edges", "relations", _CALLED + f"\nSELECT {_K} FROM relations JOIN root ON source = id WHERE predicate = 'calls' AND target IN (SELECT id FROM near)")
def _(p):
    got = _engine(p).call("graph", {"root": p.method_id(), "graph_type": "call", "direction": "downstream", "node_cap": 1000, "depth_clamp": 1})["result"]
    return p.spark.createDataFrame([tuple(e[c] for c in RELATION_KEY) for e in got["edges"]], "source string, target string, predicate string, site_file string, site_line int, site_col int")


_ABOVE = """root AS (SELECT id FROM methods WHERE pk = 0),
e AS (SELECT r.*, row_number() OVER (PARTITION BY source ORDER BY site_file, site_line, site_col, source, target, predicate) AS n FROM relations r JOIN root ON target = id AND source <> id WHERE predicate IN ({0}))"""


@query("tool_impact_analysis", "relations", _ABOVE.format("'calls', 'imports', 'overrides'") + "\nSELECT source AS id, predicate AS discovery_predicate, (SELECT count(*) FROM e WHERE n = 1) AS total FROM e WHERE n = 1")
def _(p):
    got = _engine(p).call("impact_analysis", {"root": p.method_id(), "node_cap": 10_000, "depth_clamp": 1})["result"]
    return p.spark.createDataFrame([(n["id"], n["discovery_predicate"], got["impact_summary"]["total"]) for n in got["affected_symbols"]], "id string, discovery_predicate string, total long")


@query("tool_affected_tests", "relations", _ABOVE.format("'calls', 'overrides'") + ",\ntests AS (SELECT * FROM e JOIN symbols s ON s.id = source WHERE n = 1 AND kind = 'function' AND starts_with(s.path, 'tests/test_') AND starts_with(qualname, 'test_'))\nSELECT source AS id, predicate AS discovery_predicate, (SELECT count(*) FROM tests) AS total FROM tests")
def _(p):
    got = _engine(p).call("affected_tests", {"root": p.method_id(), "node_cap": 10_000, "depth_clamp": 1})["result"]
    return p.spark.createDataFrame([(n["id"], n["discovery_predicate"], got["test_summary"]["total"]) for n in got["affected_tests"]], "id string, discovery_predicate string, total long")


@_constant("tool_architecture", "part, a, b", [
    *[("node", s, str(n)) for s, n in (("a.py", 1), ("gen/kept.py", 0), ("pkg/__init__.py", 0), ("pkg/m.py", 0), ("pkg/sub/deep.py", 0), ("test_b.py", 0))],
    ("edge", "pkg/__init__.py", "pkg/m.py"), ("edge", "pkg/m.py", "pkg/__init__.py"), ("edge", "pkg/sub/deep.py", "pkg/m.py"), ("edge", "test_b.py", "a.py"),
    ("violation", "test_b.py", "a.py"), ("cycle", "pkg/__init__.py", "pkg/m.py"), ("package", "", "1"), ("package", "gen", "0"), ("package", "pkg", "0"), ("package", "pkg/sub", "0"),
])
def _(p):
    root, store, _ = _tree(p)
    engine = Engine.of(store, root)
    got, packages = engine.call("architecture", {})["result"], engine.call("architecture", {"granularity": "package"})["result"]
    rows = [("node", n["path"], str(n["external_dependency_count"])) for n in got["nodes"]] + [("edge", e["source"], e["target"]) for e in got["edges"]]
    rows += [("violation", v["source"], v["target"]) for v in got["layer_violations"]] + [("cycle", c[0], c[1]) for c in got["cycles"]]
    return p.spark.createDataFrame(rows + [("package", n["path"], str(n["external_dependency_count"])) for n in packages["nodes"]], "part string, a string, b string")


@_constant("tool_structural_search", "page, path, name, total_count", [(1, "a.py", "Base.run", 3), (1, "a.py", "Child.run", 3), (2, "test_b.py", "test_helper", 3)], "page, path, total_count::BIGINT AS total_count, regexp_replace(name, '.*[.]', '') AS name")
def _(p):
    root, store, _ = _tree(p)
    pattern = '((function_definition name: (identifier) @n) (#match? @n "run$|^test"))'
    found = _pages(Engine.of(store, root), "structural_search", {"pattern": pattern, "limit": 2}, 3)
    return p.spark.createDataFrame([(n, r["path"], e["total_count"], r["captures"]["n"][0]["text"]) for n, e, r in found], "page int, path string, total_count long, name string")


_BAD = [
    ("find_symbol", {"name": "x", "limit": 0}, "INVALID_LIMIT"), ("find_symbol", {"name": "x", "cursor": "?"}, "INVALID_CURSOR"), ("find_symbol", {"name": "x", "kind": "variable"}, "INVALID_ARGUMENT"),
    ("find_symbol", {"name": "x", "cursor": encode_cursor(6, ["x"])}, "STALE_INDEX_GENERATION"), ("find_symbol", {"name": "x", "cursor": encode_cursor(7, [1, 2])}, "INVALID_CURSOR"), ("find_symbol", {}, "INVALID_ARGUMENT"),
    ("get_definition", {}, "INVALID_ARGUMENT"), ("get_definition", {"position": {"file": "a.py"}}, "INVALID_ARGUMENT"), ("find_references", {"symbol_id": "none"}, "SYMBOL_NOT_FOUND"),
    ("graph", {"root": "none", "graph_type": "call", "direction": "sideways"}, "INVALID_ARGUMENT"), ("graph", {"root": "none", "graph_type": "call", "direction": "upstream", "node_cap": 0}, "INVALID_ARGUMENT"),
    ("impact_analysis", {"root": "none"}, "SYMBOL_NOT_FOUND"), ("structural_search", {"pattern": "("}, "INVALID_PATTERN"), ("architecture", {"granularity": "city"}, "INVALID_ARGUMENT"), ("nothing", {}, "UNKNOWN_METHOD"), ("find_symbol", None, "MALFORMED_REQUEST"),
]


@_constant("tool_errors", "n, method, code", [(n, m, c) for n, (m, _, c) in enumerate(_BAD)], "n, method, code, 7 AS index_generation")
def _(p):
    engine = _engine(p)
    rows = [(n, m, engine.call(m, params)["error"]) for n, (m, params, _) in enumerate(_BAD)]
    return p.spark.createDataFrame([(n, m, e["code"], e["index_generation"]) for n, m, e in rows], "n int, method string, code string, index_generation int")


# lookups that had no rows before


@query("relations_at_sites", "relations", f"SELECT {_K} FROM relations WHERE site_file = 'src/r0/n0.py' AND site_line = 1 AND site_col = 0")
def _(p):
    return scans.relations_at_site(p.relations, "src/r0/n0.py", 1, 0).select(*RELATION_KEY)


@query("history_of_symbol", None, f"WITH {_JOB}\nSELECT * FROM (VALUES ('t1', 4), ('t2', 3)) v(observed_at, start_line)")
def _(p):
    return scans.history_of(_store(p).read("symbols_history"), {"id": "rich/test_s1.py:Root.deep#method"}).select("observed_at", "start_line")


@query("history_of_relation", None, f"WITH {_JOB_EDGES}\nSELECT 't1' AS observed_at, 'EXTRACTED' AS confidence")
def _(p):
    key = {"source": "rich/test_s1.py:Left#class", "target": "rich/test_s1.py:Root#class", "predicate": "inherits"}
    return scans.history_of(_store(p).read("relations_history"), key).select("observed_at", "confidence")


@query("relation_tombstones", None, f"WITH {_JOB_EDGES}\nSELECT source, target, predicate, site_line, k % 3 < 2 AS is_tombstoned FROM old WHERE predicate = 'inherits'")
def _(p):
    h = _store(p).read("relations_history").where("predicate = 'inherits'")
    return scans.tombstoned(h, ["source", "target", "predicate", "site_line"])


@query("deferred_of_rich_files", None, f"WITH {FILES}\nSELECT 'inherit' AS deferred_kind, path || ':Shape#class' AS source, 'typing' AS module_path, 'Protocol' AS name, 31 AS site_line FROM files UNION ALL SELECT 'override', path || ':Shape.area#method', 'typing', NULL, 32 FROM files")
def _(p):
    return deferred_of(_rich_facts(p)).select("deferred_kind", "source", "module_path", "name", "site_line")


__all__ = ["QUERIES", "SQL", "ctes"]
