"""Structural patterns over inline sources."""

import pytest
from codeloom.model import InvalidPattern
from codeloom.plans.pattern import compile_patterns, search_text, structural_search

TEXT = '''import os
from a.b import c as d

class A(Base):
    @deco
    def m(self, x: int = 1) -> str:
        return helper(x, key=2)

def f():
    y = g("s")
    if y:
        raise ValueError(y)
'''


def found(pattern, name):
    return [c[name][0][4] for _, c, _ in search_text(compile_patterns(pattern), TEXT) if name in c]


@pytest.mark.parametrize(("pattern", "name", "want"), [
    ("(class_definition name: (identifier) @n)", "n", ["A"]),
    ("(function_definition name: (identifier) @n)", "n", ["m", "f"]),
    ("(decorated_definition (decorator (identifier) @d) definition: (function_definition name: (identifier) @n))", "d", ["deco"]),
    ("(call function: (identifier) @f)", "f", ["helper", "g", "ValueError"]),
    ('(call function: (identifier) @f (#eq? @f "g"))', "f", ["g"]),
    ('(call function: (identifier) @f (#match? @f "^[A-Z]"))', "f", ["ValueError"]),
    ('(call function: (identifier) @f (#not-eq? @f "g"))', "f", ["helper", "ValueError"]),
    ('(call function: (identifier) @f (#any-of? @f "g" "helper"))', "f", ["helper", "g"]),
    ("(argument_list . (identifier) @first)", "first", ["Base", "x", "y"]),
    ("(argument_list (_) @last .)", "last", ["Base", "key=2", '"s"', "y"]),
    ("[(import_statement name: (dotted_name) @n) (aliased_import name: (dotted_name) @n)]", "n", ["os", "c"]),
    ("(assignment left: (identifier) @l right: (call))", "l", ["y"]),
    ("(keyword_argument name: (identifier) @k value: (integer) @v)", "v", ["2"]),
    ("(return_statement (call arguments: (argument_list (_)* @all)))", "all", ["x"]),
    ("(class_definition !superclasses name: (identifier) @n)", "n", []),
])
def test_patterns(pattern, name, want):
    assert found(pattern, name) == want


@pytest.mark.parametrize("bad", ["", "(", "(call", "@x", "(call (#nope? @a))", ")", "(call function: )"])
def test_bad_patterns(bad):
    with pytest.raises(InvalidPattern):
        compile_patterns(bad)


def test_positions_and_glob(spark):
    files = spark.createDataFrame([("a/x.py", TEXT), ("b/x.py", TEXT), ("a/bad.py", "def (")], "path string, source string")
    rows = structural_search(files, "(function_definition name: (identifier) @n) @whole", "a/*").orderBy("anchor_line").collect()
    assert [(r["path"], r["pattern_index"], r["anchor_line"], r["anchor_col"]) for r in rows] == [("a/x.py", 0, 6, 4), ("a/x.py", 0, 9, 0)]
    whole = rows[0]["captures"]["whole"][0]
    assert (whole["start_line"], whole["end_line"]) == (6, 7) and whole["text"].startswith("def m(")
    assert structural_search(files, "(call)").count() == 0  # matches that capture nothing are dropped
