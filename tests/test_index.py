"""Scans, batches, histories and the ten queries over one small repository."""

import textwrap

import pytest
from codeloom.model import IndexNotReady
from codeloom.plans.index import enrich, index_files, scan
from codeloom.plans.store import Store
from codeloom.plans.tools import Engine

A = """\
import os


class Base:
    def run(self):
        pass


class Child(Base):
    def run(self):
        return helper()


def helper():
    return 1


def second():
    x = helper()
    return x


alias = helper
"""
B = "from a import helper\n\n\ndef test_helper():\n    assert helper() == 1\n"


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/index")
    s.create()
    return s


def put(store, files, at, **kw):
    df = store.spark.createDataFrame([(p, textwrap.dedent(t) if t is not None else None) for p, t in files.items()], "path string, source string")
    return index_files(store, df, at, **kw)


def ids(store):
    return {r["id"] for r in store.read("symbols").collect()}


def edges(store, predicate):
    return {(r["source"].split(":")[1], r["target"].split(":")[-1]): r["confidence"] for r in store.read("relations").where(f"predicate = '{predicate}'").collect()}


def history(store, id_):
    return [(r["tombstone"], r["observed_at"]) for r in store.read("symbols_history").where(f"id = '{id_}'").orderBy("history_id").collect()]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "pkg").mkdir()
    (root / "a.py").write_text(A)
    (root / "test_b.py").write_text(B)
    (root / "bad.py").write_text("def (:\n")
    (root / "skipped.py").write_text("x = 1\n")
    (root / ".gitignore").write_text("skipped.py\n")
    (root / "pkg" / "__init__.py").write_text("from . import m\n")
    (root / "pkg" / "m.py").write_text("import pkg\n")
    (root / ".layers.json").write_text('{"layers": {"app": ["a.py"], "tests": ["test_*"]}, "allowed_dependencies": {"app": []}}')
    s = Store(spark, f"file://{tmp_path_factory.mktemp('index')}")
    result = scan(s, str(root), "2024-01-01T00:00:00+00:00")
    return s, str(root), result


def test_scan_and_its_totals(built):
    _, _, r = built
    assert (r.files_indexed, r.files_failed, r.generation) == (4, 1, 1) and r.symbols == 4 + 2 + 2 + 3 and r.elapsed_seconds > 0


def test_ten_queries_agree(built):
    store, root, _ = built
    e = Engine.of(store, root, "t")
    ok = lambda m, **p: e.call(m, p)["result"]
    helper = "a.py:helper#function"
    assert [r["id"] for r in ok("find_symbol", name="helper")["results"]] == [helper, "test_b.py:test_helper#function"]
    refs = ok("find_references", symbol_id=helper)
    assert refs["total_count"] == 5 and {r["predicate"] for r in refs["results"]} == {"defines", "calls", "references"}
    assert sum(r["predicate"] == "calls" for r in refs["results"]) == 3
    assert [r["target"] for r in ok("list_imports", file="a.py")["results"]] == ["os"]
    found = ok("structural_search", pattern="(class_definition name: (identifier) @n)")
    assert [r["captures"]["n"][0]["text"] for r in found["results"]] == ["Base", "Child"]
    up = ok("graph", root=helper, graph_type="call", direction="upstream")
    assert [n["id"] for n in up["nodes"]][0] == helper and {n["id"] for n in up["nodes"]} == {helper, "a.py:Child.run#method", "a.py:second#function", "test_b.py:test_helper#function"}
    assert len(up["edges"]) == 3 and not up["truncated"]
    down = ok("graph", root="a.py:#module", graph_type="dependency", direction="downstream")
    assert down["nodes"][1:] == [{"id": "os", "resolved": False}]
    impact = ok("impact_analysis", root=helper)
    assert impact["impact_summary"] == {"EXTRACTED": 3, "INFERRED": 0, "AMBIGUOUS": 0, "total": 3}
    assert {s["discovery_predicate"] for s in impact["affected_symbols"]} == {"calls"}
    tests = ok("affected_tests", root=helper)
    assert [t["id"] for t in tests["affected_tests"]] == ["test_b.py:test_helper#function"] and tests["test_summary"]["total"] == 1
    assert any(r["predicate"] == "inherits" for r in ok("find_references", symbol_id="a.py:Base#class")["results"])
    at_call = ok("get_definition", position={"file": "a.py", "line": 11, "column": 15})
    assert [r["id"] for r in at_call["results"]] == [helper]
    assert [r["id"] for r in ok("get_definition", position={"file": "a.py", "line": 14, "column": 0})["results"]] == [helper]
    told = ok("explain", symbol_id=helper)
    assert told["total_count"] == 1 and told["results"][0]["provenance"]["observed_at"] == "2024-01-01T00:00:00+00:00"


def test_architecture(built):
    store, root, _ = built
    e = Engine.of(store, root)
    got = e.architecture()
    assert {"source": "test_b.py", "target": "a.py"} in got["edges"]
    assert got["layer_violations"] == [{"source": "test_b.py", "target": "a.py", "from_layer": "tests", "to_layer": "app"}] and got["layering_enabled"]
    assert got["cycles"] == [["pkg/__init__.py", "pkg/m.py"]]
    assert {n["path"]: n["external_dependency_count"] for n in got["nodes"]} == {"a.py": 1, "pkg/__init__.py": 0, "pkg/m.py": 0, "test_b.py": 0}
    packages = e.architecture(granularity="package", root=root)
    assert packages["root"] is None and [n["path"] for n in packages["nodes"]] == ["", "pkg"]
    assert e.architecture(root="")["nodes"] == [] and e.architecture(node_cap=1)["truncated"]


@pytest.mark.parametrize(("method", "params", "code"), [
    ("find_symbol", {"name": "x", "kind": "variable"}, "INVALID_ARGUMENT"), ("find_symbol", {"name": "x", "limit": 0}, "INVALID_LIMIT"), ("find_symbol", {"name": "x", "cursor": "?"}, "INVALID_CURSOR"),
    ("find_symbol", {"name": "x", "min_confidence": "SURE"}, "INVALID_ARGUMENT"), ("find_symbol", {}, "INVALID_ARGUMENT"), ("get_definition", {}, "INVALID_ARGUMENT"),
    ("get_definition", {"symbol_id": "a", "position": {}}, "INVALID_ARGUMENT"), ("get_definition", {"position": {"file": "a.py"}}, "INVALID_ARGUMENT"), ("find_references", {"symbol_id": "none"}, "SYMBOL_NOT_FOUND"),
    ("get_definition", {"position": {"file": "a.py", "line": 99, "column": 0}}, "SYMBOL_NOT_FOUND"), ("graph", {"root": "none", "graph_type": "call", "direction": "sideways"}, "INVALID_ARGUMENT"),
    ("graph", {"root": "none", "graph_type": "call", "direction": "upstream"}, "SYMBOL_NOT_FOUND"), ("graph", {"root": "none", "graph_type": "call", "direction": "upstream", "node_cap": 0}, "INVALID_ARGUMENT"),
    ("explain", {"symbol_id": "none"}, "SYMBOL_NOT_FOUND"), ("explain", {"edge_ref": {c: "x" for c in ("source", "target", "predicate", "site_file")} | {"site_line": 1, "site_col": 0}}, "EDGE_NOT_FOUND"),
    ("structural_search", {"pattern": "("}, "INVALID_PATTERN"), ("architecture", {"granularity": "city"}, "INVALID_ARGUMENT"), ("architecture", {"root": "/elsewhere"}, "INVALID_ARGUMENT"), ("nothing", {}, "UNKNOWN_METHOD"), ("find_symbol", None, "MALFORMED_REQUEST"),
])
def test_errors(built, method, params, code):
    store, root, _ = built
    got = Engine.of(store, root).call(method, params)
    assert not got["ok"] and got["error"]["code"] == code


def test_unready(spark, tmp_path):
    with pytest.raises(IndexNotReady):
        Engine.of(Store(spark, f"file://{tmp_path}/none"))


def test_reindexing_and_removal(store):
    put(store, {"m.py": "def f(): pass\ndef g(): f()\n"}, "t1")
    put(store, {"m.py": "def f(): pass\ndef g(): f()\n"}, "t2")
    assert history(store, "m.py:f#function") == [(False, "t1")]
    assert store.read("symbols").where("id = 'm.py:f#function'").collect()[0]["observed_at"] == "t2"
    put(store, {"m.py": "def g(): pass\n"}, "t3")
    assert ids(store) == {"m.py:#module", "m.py:g#function"}
    assert history(store, "m.py:f#function") == [(False, "t1"), (True, "t3")]
    assert ("g#function", "f#function") not in edges(store, "calls")
    put(store, {"m.py": "def broken(:\n"}, "t4")
    assert ids(store) == {"m.py:#module", "m.py:g#function"} and store.meta()["generation"] == 4
    put(store, {"m.py": None}, "t5")
    assert ids(store) == set() and store.read("relations").count() == 0
    numbers = [r["history_id"] for t in ("symbols_history", "relations_history") for r in store.read(t).collect()]
    assert len(numbers) == len(set(numbers))


def test_explain_after_deletion(store):
    put(store, {"m.py": "def f(): pass\n"}, "t1")
    put(store, {"m.py": "\ndef f(): pass\n"}, "t2")
    put(store, {"m.py": "x = 1\n"}, "t3")
    got = Engine.of(store).explain(symbol_id="m.py:f#function")["results"]
    assert [(r["start_line"], r.get("deleted", False)) for r in got] == [(2, True), (1, False)]


def test_cross_file_names(store):
    put(store, {"a.py": "from lib.b import f\nfrom lib import b\nfrom lib.b import C\nclass D(C):\n    def m(self): self.k()\n    def over(self): pass\nf(); b.f()\n"}, "t1")
    assert edges(store, "calls") == {}
    put(store, {"lib/b.py": "def f(): pass\nclass C:\n    def k(self): pass\n    def over(self): pass\n"}, "t2")
    assert edges(store, "calls") == {}  # only a file that is indexed again is resolved again
    put(store, {"a.py": "from lib.b import f\nfrom lib import b\nfrom lib.b import C\nclass D(C):\n    def m(self): self.k()\n    def over(self): pass\nf(); b.f()\n"}, "t3")
    assert edges(store, "calls") == {("#module", "f#function"): "EXTRACTED", ("D.m#method", "C.k#method"): "EXTRACTED"}
    assert edges(store, "inherits") == {("D#class", "C#class"): "EXTRACTED"} and edges(store, "overrides") == {("D.over#method", "C.over#method"): "EXTRACTED"}
    put(store, {"x/lib/b.py": "def f(): pass\n", "a.py": "from lib.b import f\nf()\n"}, "t4")
    assert list(edges(store, "calls").values()) == ["AMBIGUOUS"] and store.read("relations").where("predicate = 'calls'").count() == 2
    put(store, {"lib/b.py": None}, "t5")
    assert store.read("relations").where("predicate = 'calls'").count() == 1


def test_stub_and_mixin_enrichment(store):
    text = """
        from typing import Protocol
        class P(Protocol):
            def go(self): ...
        class Impl(P):
            def go(self): return 1
        class User(P):
            def use(self): self.go()
        class Mix:
            def act(self): self.other()
        class Whole(Mix, Helper): pass
        class Helper:
            def other(self): pass
        """
    put(store, {"m.py": text}, "t1")
    before = store.meta()["generation"]
    files = store.spark.createDataFrame([("m.py", textwrap.dedent(text))], "path string, source string")
    enrich(store, files, "t2")
    got = edges(store, "calls")
    assert got[("User.use#method", "Impl.go#method")] == "INFERRED" and got[("User.use#method", "P.go#method")] == "EXTRACTED"
    assert got[("Mix.act#method", "Helper.other#method")] == "INFERRED" and store.meta()["generation"] == before
    put(store, {"m.py": text}, "t3", prune_inferred=False)
    assert edges(store, "calls") == got
    put(store, {"m.py": text}, "t4")
    assert ("Mix.act#method", "Helper.other#method") not in edges(store, "calls")


def test_locations(store):
    put(store, {"a.py": "def f():\n    pass\n", "b.py": "x.f()\n"}, "t1")
    rows = [("b.py:#module", "b.py", 1, 2, "calls", "a.py", 0, 4), ("b.py:#module", "b.py", 9, 2, "calls", "a.py", 0, 4), ("b.py:#module", "b.py", 9, 2, "calls", "a.py", 1, 4)]
    at = store.spark.createDataFrame(rows, "source string, site_file string, site_line int, site_col int, predicate string, uri_path string, line int, character int")
    enrich(store, store.spark.createDataFrame([("b.py", "x.f()\n")], "path string, source string"), "t2", at, ("provider", "9"))
    assert edges(store, "calls") == {("#module", "f#function"): "INFERRED"}


def test_clone(store, spark, tmp_path):
    put(store, {"m.py": "def f(): pass\n"}, "t1")
    other = store.clone(f"file://{tmp_path}/clone")
    assert ids(other) == ids(store) and other.meta()["generation"] == 1 and other.needs_resolution()
    put(other, {"m.py": None}, "t2")
    assert ids(store) and not ids(other)


def test_a_crash_or_a_second_writer_harms_no_commit(store):
    from codeloom.plans.store import ConcurrentCommit

    put(store, {"m.py": "def f(): pass\n"}, "t1")
    before = store.meta()
    fs = store._fs()
    fs.create(store._path(".fresh-left.json"), True).close()  # a writer that died before the rename
    assert store.meta() == before and ids(store) == {"m.py:#module", "m.py:f#function"}
    store._point({**before, "head_sha": "one"})
    with pytest.raises(ConcurrentCommit):
        store._point({**before, "head_sha": "two"})
    assert store.meta()["head_sha"] == "one"


def test_older_folders_and_pointers(store, spark):
    """Rows without ``is_stub`` and pointers without the later keys are read with the values they had."""
    put(store, {"m.py": "def f(): pass\n"}, "t1")
    meta = store.meta()
    store.read("symbols").drop("is_stub").write.parquet(f"{store.root}/old")
    keep = {k: v for k, v in meta.items() if k not in ("last_enrichment_fingerprint", "cross_file_pass_version")}
    store._point({**keep, "folders": {**meta["folders"], "symbols": ["old"]}})
    assert {r["is_stub"] for r in store.read("symbols").collect()} == {False} and store.needs_resolution()


def test_the_engine_reads_changed_files_first(spark, tmp_path):
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "a.py").write_text("import one\n")
    s = Store(spark, f"file://{tmp_path}/index")
    scan(s, str(tmp_path / "repo"))
    (tmp_path / "repo" / "a.py").write_text("import two\n")
    got = Engine.of(s, str(tmp_path / "repo"), "t2").call("list_imports", {"file": "a.py"})["result"]
    assert [r["target"] for r in got["results"]] == ["two"] and got["index_generation"] == 2
    assert Engine.of(s).call("list_imports", {"file": "a.py"})["result"]["total_count"] == 1
