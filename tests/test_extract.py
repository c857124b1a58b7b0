"""Facts of single files, from inline sources."""

import textwrap

import pytest
from codeloom.plans.extract import facts_of, package_of


def facts(text, path="pkg/mod.py"):
    return facts_of(path, textwrap.dedent(text), "t")


def symbols(text, path="pkg/mod.py"):
    return {r["id"].split(":", 1)[1]: r for r in facts(text, path) if r["row_kind"] == "symbol"}


def edges(text, predicate, path="pkg/mod.py"):
    short = lambda s: s.split(":", 1)[1] if ":" in s else s
    return sorted((short(r["source"]), short(r["target"]), r["confidence"]) for r in facts(text, path) if r["row_kind"] == "relation" and r["predicate"] == predicate)


def deferred(text, kind, path="pkg/mod.py"):
    return [r for r in facts(text, path) if r["row_kind"] == "deferred" and r["deferred_kind"] == kind]


def test_empty_file_is_one_module():
    got = symbols("")
    assert list(got) == ["#module"] and (got["#module"]["start_line"], got["#module"]["end_line"], got["#module"]["end_col"]) == (1, 1, 0)


def test_spans_names_and_what_is_no_symbol():
    got = symbols("""
        @mark
        def f(a):
            def inner(): pass
            return a
        if True:
            def hidden(): pass
        class C:
            x = 1
            async def m(self): pass
            class D:
                def n(self): pass
        """)
    assert sorted(got) == ["#module", "C#class", "C.m#method", "f#function"]
    assert (got["f#function"]["start_line"], got["f#function"]["end_line"]) == (3, 5)
    assert (got["C.m#method"]["start_line"], got["C.m#method"]["start_col"]) == (10, 4)


def test_columns_are_bytes():
    assert symbols("é = 1; \ndef f(): return 'é'\n")["f#function"]["end_col"] == len("def f(): return 'é'".encode())


def test_redefinitions_get_ordinals():
    assert sorted(symbols("def f(): pass\ndef f(): pass\nclass f: pass\n")) == ["#module", "f#class", "f#function", "f#function@2"]


def test_syntax_error_freezes_the_file():
    assert [r["row_kind"] for r in facts("def ok(): pass\ndef (:\n")] == ["error"]


@pytest.mark.parametrize(("head", "method", "stub"), [
    ("from typing import Protocol\nclass C(Protocol):", "def m(self): ...", True),
    ("from typing import Protocol\nclass C(Protocol[T]):", "def m(self): 'doc'", True),
    ("import typing\nclass C(typing.Protocol):", "def m(self): pass", True),
    ("from typing import Protocol as P\nclass C(P):", "def m(self): pass", True),
    ("from typing import Protocol\nclass C(Protocol):", "def m(self): return 1", False),
    ("from abc import ABC\nclass C(ABC):", "def m(self): pass", False),
    ("from abc import ABC, abstractmethod\nclass C(ABC):", "@abstractmethod\n    def m(self): pass", True),
    ("import abc\nclass C(metaclass=abc.ABCMeta):", "@abc.abstractmethod\n    def m(self): ...", True),
    ("from typing import Protocol\nclass B(Protocol): pass\nclass C(B):", "def m(self): ...", True),
    ("from typing import Protocol as P\ndef P(): pass\nclass C(P):", "def m(self): ...", False),
    ("class C:", "def m(self): ...", False),
])
def test_stubs(head, method, stub):
    assert symbols(f"{head}\n    {method}\n")["C.m#method"]["is_stub"] is stub


def test_imports():
    got = edges("""
        import os, a.b as c
        from m import x, y as z
        from . import near
        from ..up import far
        from ... import toofar
        from q import *
        from __future__ import annotations
        def f():
            import late
        """, "imports", "pkg/sub/mod.py")  # fmt: skip
    assert [t for _, t, _ in got] == ["a.b", "late", "m.x", "m.y", "os", "pkg.sub.near", "pkg.up.far"]


@pytest.mark.parametrize(("path", "level", "base"), [("pkg/mod.py", 1, "pkg"), ("pkg/mod.py", 2, None), ("pkg/__init__.py", 1, "pkg"), ("pkg/__init__.py", 2, ""), ("__init__.py", 1, ""), ("a/b/c.py", 2, "a"), ("mod.py", 1, None)])
def test_relative_bases(path, level, base):
    assert package_of(path, level) == base


def test_inherits():
    text = """
        from other import Far
        class A: pass
        class A: pass
        class B: pass
        class C(A, B, pkg.B, B[int], Far, Nowhere, metaclass=M): pass
        @deco
        class D(B): pass
        """
    assert edges(text, "inherits") == [("C#class", "A#class", "AMBIGUOUS"), ("C#class", "A#class@2", "AMBIGUOUS"), *[("C#class", "B#class", "EXTRACTED")] * 3]
    assert [(d["module_path"], d["name"]) for d in deferred(text, "inherit")] == [("other", "Far")]


def test_overrides():
    text = """
        from other import Far
        class A:
            def m(self): pass
            def k(self): pass
        class B:
            def m(self): pass
        class C(A, B, Far):
            def m(self): pass
            def k(self): pass
            def own(self): pass
        """
    assert edges(text, "overrides") == [("C.k#method", "A.k#method", "EXTRACTED"), ("C.m#method", "A.m#method", "AMBIGUOUS"), ("C.m#method", "B.m#method", "AMBIGUOUS")]
    assert sorted((d["method_name"], d["base_name"]) for d in deferred(text, "override")) == [("k", "Far"), ("m", "Far"), ("own", "Far")]


def test_calls_and_their_sources():
    text = """
        from other import far
        from pkg import sub
        def f(): pass
        class K:
            attr = f()
            def m(self):
                def inner():
                    f()
                return K()
        @f
        @wrap(f())
        def g():
            far(); sub.go(); local.no(); a.b.c()
        """
    assert edges(text, "calls") == [("#module", "f#function", "EXTRACTED"), ("#module", "f#function", "EXTRACTED"), ("K.m#method", "K#class", "EXTRACTED"), ("K.m#method", "f#function", "EXTRACTED")]
    assert [(d["source"].split(":")[1], d["name"]) for d in deferred(text, "call")] == [("g#function", "far")]
    assert [(d["module_path"], d["name"], d["attribute"]) for d in deferred(text, "attribute_call")] == [("pkg", "sub", "go")]


def test_self_calls_walk_the_bases():
    text = """
        from other import Far
        class Root:
            def deep(self): pass
        class Left(Root):
            def m(self): pass
        class Right(Root):
            def m(self): pass
        class C(Left, Right):
            def own(self): pass
            def run(self):
                self.own(); self.m(); self.deep(); self.nowhere()
        class E(Far):
            def run(self): self.x()
        """
    assert edges(text, "calls") == [
        ("C.run#method", "C.own#method", "EXTRACTED"), ("C.run#method", "Left.m#method", "AMBIGUOUS"), ("C.run#method", "Right.m#method", "AMBIGUOUS"), ("C.run#method", "Root.deep#method", "EXTRACTED"),
    ]
    assert sorted((d["method_name"], d.get("base_name") or "") for d in deferred(text, "self_call")) == [("nowhere", ""), ("x", "Far")]


def test_base_cycles_end():
    assert edges("class A(B):\n    def r(self): self.q()\nclass B(A): pass\n", "calls") == []


def test_references_on_right_sides_only():
    text = "def f(): pass\nx = f\ny: object = f\na = b = f\nz += f\nprint(f)\n"
    assert len(edges(text, "references")) == 3


def test_fixture_injection():
    text = """
        import pytest
        @pytest.fixture
        def db(): pass
        @pytest.fixture(name="renamed")
        def original(db): pass
        class TestA:
            @pytest.fixture()
            def db(self): pass
            def test_x(self, db, renamed): pass
        def test_y(db, original, other=1, *args): pass
        def helper(db): pass
        """
    got = edges(text, "calls", "tests/test_m.py")
    assert got == [
        ("TestA.test_x#method", "TestA.db#method", "AMBIGUOUS"), ("TestA.test_x#method", "original#function", "AMBIGUOUS"),
        ("original#function", "db#function", "AMBIGUOUS"), ("test_y#function", "db#function", "AMBIGUOUS"),
    ]
    assert edges(text, "calls", "pkg/m.py") == [("original#function", "db#function", "AMBIGUOUS")]
