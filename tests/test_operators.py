"""Operators against plain Python on small and random tables."""

import random

import pytest
from codeloom.functions import exprs as X
from codeloom.model import RELATION_KEY, RELATIONS, InvalidArgument, InvalidCursor, InvalidLimit, StaleIndexGeneration
from codeloom.operators import architecture as arch
from codeloom.operators import enrichment, pages, scans, traverse
from codeloom.operators.cycles import cycles
from codeloom.plans.extract import package_of
from pyspark.sql import functions as F


def relations(spark, rows):
    """Rows: (source, target, predicate, line, confidence)."""
    return spark.createDataFrame([(s, t, p, "f.py", n, 0, c, "x", "1", "t") for s, t, p, n, c in rows], RELATIONS)


def calls(spark, pairs):
    return relations(spark, [(a, b, "calls", i, "EXTRACTED") for i, (a, b) in enumerate(pairs)])


def plain_bfs(pairs, root, cap, depth, up=False):
    """The traversal as a loop: frontier by id, edges by site."""
    nodes, level, truncated = {root: 0}, 0, False
    edges = sorted((b if up else a, i, a if up else b) for i, (a, b) in enumerate(pairs))
    frontier = [root]
    while frontier and level < depth:
        nxt = []
        for cur in sorted(frontier):
            for a, _, b in edges:
                if a == cur and b not in nodes:
                    if len(nodes) >= cap:
                        truncated = True
                    else:
                        nodes[b] = level + 1
                        nxt.append(b)
        frontier, level = nxt, level + 1
    if frontier and any(a in frontier for a, _, _ in edges):
        truncated = True
    return nodes, truncated


@pytest.mark.parametrize("seed", range(3))
def test_traversal_against_a_loop(spark, seed):
    rnd = random.Random(seed)
    pairs = sorted({(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(30)})
    df = calls(spark, pairs)
    cap, depth, up = rnd.choice([3, 6, 100]), rnd.choice([1, 2, 5]), rnd.random() < 0.5
    got = traverse.graph(df, "n0", "call", "upstream" if up else "downstream", cap, depth)
    nodes, truncated = plain_bfs(pairs, "n0", cap, depth, up)
    assert {r["id"]: r["level"] for r in got.nodes.collect()} == nodes
    assert got.truncated == truncated
    expanded = {n for n, lv in nodes.items() if lv < depth}
    want = sorted((a, b) for a, b in pairs if (b if up else a) in expanded and a in nodes and b in nodes)
    assert sorted((r["source"], r["target"]) for r in got.edges.collect()) == want


def test_truncation_of_impact_needs_an_unknown_node(spark):
    back = calls(spark, [("b", "a"), ("a", "b")])
    assert traverse.graph(back, "a", "call", "downstream", 9, 1).truncated
    assert not traverse.bfs(back, "a", ["calls"], True, 9, 1).truncated


@pytest.mark.parametrize("bad", [{"node_cap": 0}, {"depth_clamp": -1}, {"node_cap": True}])
def test_bounds(spark, bad):
    with pytest.raises(InvalidArgument):
        traverse.bfs(calls(spark, [("a", "b")]), "a", ["calls"], False, **bad)


@pytest.mark.parametrize(("seed", "small"), [(0, 10**6), (1, 10**6), (2, 0)])
def test_cycles_against_reachability(spark, seed, small):
    rnd = random.Random(seed)
    n = 9
    pairs = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(12)}
    reach = {(a, b) for a, b in pairs}
    for _ in range(n):
        reach |= {(a, d) for a, b in reach for c, d in pairs if b == c}
    want = {}
    for a in range(n):
        ring = [b for b in range(n) if (a, b) in reach and (b, a) in reach]
        if ring:
            want[str(a)] = str(min(ring))
    got = cycles(spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "source string, target string"), small)
    assert {r["member"]: r["component"] for r in got.collect()} == want


def test_import_resolution(spark):
    paths = spark.createDataFrame([(p,) for p in ("src/pkg/a.py", "src/pkg/b.py", "lib/a.py", "src/pkg/__init__.py")], "path string")
    rows = [("src/pkg/b.py", t) for t in ("pkg.a", "a", "pkg.a.name", "os", "os.path", "pkg", "pkg.missing")]
    got = arch.resolve_imports(spark.createDataFrame(rows, "site_file string, target string"), paths).collect()
    by = {}
    for r in got:
        by.setdefault(r["target"], set()).add(r["target_path"])
    assert by == {"pkg.a": {"src/pkg/a.py"}, "a": {"src/pkg/a.py", "lib/a.py"}, "pkg.a.name": {"src/pkg/a.py"}, "os": {None}, "os.path": {None}, "pkg": {"src/pkg/__init__.py"}, "pkg.missing": {"src/pkg/__init__.py"}}


def test_layers(spark):
    edges = spark.createDataFrame([("api/x.py", "db/y.py"), ("db/y.py", "api/x.py"), ("api/x.py", "api/z.py"), ("other.py", "db/y.py")], "source string, target string")
    layers = arch.Layers({"api": ["api/*"], "db": ["db/*"], "all": ["*/x.py"]}, {"api": ["db"], "db": []})
    assert sorted(tuple(r) for r in arch.violations(edges, layers).collect()) == [
        ("api/x.py", "api/z.py", "all", "api"), ("api/x.py", "db/y.py", "all", "db"), ("db/y.py", "api/x.py", "db", "all"), ("db/y.py", "api/x.py", "db", "api"),
    ]


def test_expressions(spark):
    paths = ["a.py", "pkg/__init__.py", "__init__.py", "a/b/c.py"]
    df = spark.createDataFrame([(p, n) for p in paths for n in (1, 2, 3)], "path string, n int")
    for r in df.select("path", "n", X.relative_import_base("path", "n").alias("base")).collect():
        assert r["base"] == package_of(r["path"], r["n"])
    got = spark.createDataFrame([("a/b.py:C.m#method@2",), ("x:y#z",), ("broken",), ("p:q",)], "id string").select(X.parse_symbol_id("id").alias("s")).collect()
    assert [r["s"] and tuple(r["s"]) for r in got] == [("a/b.py", "C.m", "method", 2), ("x", "y", "z", None), None, None]
    names = spark.createDataFrame([("tests/test_a.py",), ("a_test.py",), ("tests/a.py",), ("test_dir/a.py",)], "p string")
    assert [r[0] for r in names.select(X.is_test_file("p")).collect()] == [True, True, False, False]


@pytest.mark.parametrize(("pattern", "yes", "no"), [("src/*.py", ["src/a.py", "src/b/c.py"], ["x/src/a.py", "src/a.pyc"]), ("a?c", ["abc", "a/c"], ["ac", "abbc"]), ("[^a]b", ["cb"], ["ab"]), ("[a-c]x", ["bx"], ["dx"]), ("a.b", ["a.b"], ["axb"])])
def test_store_globs(spark, pattern, yes, no):
    df = spark.createDataFrame([(s,) for s in yes + no], "s string")
    assert [r[0] for r in df.select(F.col("s").rlike(X.glob_regex(pattern))).collect()] == [True] * len(yes) + [False] * len(no)


def test_scope(spark):
    df = spark.createDataFrame([("a/b.py",), ("a",), ("ab/c.py",)], "p string")
    of = lambda root: [r[0] for r in df.select(X.in_scope("p", root)).collect()]
    assert of("a/") == [True, True, False] and of(None) == [True] * 3 and of("") == [False] * 3 and of(".") == [False] * 3


def test_pages(spark):
    df = spark.createDataFrame([(f"s{i:02}", i) for i in range(7)], "id string, n int")
    rows, total, more, cursor = pages.page(df, ["id"], 3, 5, None)
    seen = [r["id"] for r in rows]
    while cursor:
        rows, total, more, cursor = pages.page(df, ["id"], 3, 5, cursor)
        seen += [r["id"] for r in rows]
    assert seen == [f"s{i:02}" for i in range(7)] and total == 7 and not more
    with pytest.raises(StaleIndexGeneration):
        pages.page(df, ["id"], 3, 6, pages.encode_cursor(5, ["s01"]))
    for bad in ("x", pages.encode_cursor(5, [1]), pages.encode_cursor(5, ["a", "b"])):
        with pytest.raises(InvalidCursor):
            pages.page(df, ["id"], 3, 5, bad)
    for bad in (0, -1, True, "3"):
        with pytest.raises(InvalidLimit):
            pages.page(df, ["id"], bad, 5, None)
    down = pages.page(df, ["id"], 2, 5, pages.encode_cursor(1, ["s03"]), pinned=False, reverse=True)[0]
    assert [r["id"] for r in down] == ["s02", "s01"]


def test_merge_policy(spark):
    live = relations(spark, [("a", "x", "calls", 1, "EXTRACTED"), ("a", "y", "calls", 2, "AMBIGUOUS"), ("a", "z", "calls", 2, "AMBIGUOUS"), ("b", "p", "calls", 3, "AMBIGUOUS"), ("b", "q", "calls", 3, "AMBIGUOUS")])
    new = relations(spark, [("a", "x", "calls", 1, "INFERRED"), ("a", "y", "calls", 2, "INFERRED"), ("b", "p", "calls", 3, "AMBIGUOUS"), ("b", "r", "calls", 3, "AMBIGUOUS")])
    got = {(r["target"], r["site_line"]): r["confidence"] for r in enrichment.merge(live, new).collect()}
    assert got == {("x", 1): "EXTRACTED", ("y", 2): "INFERRED", ("p", 3): "AMBIGUOUS", ("r", 3): "AMBIGUOUS"}
    kept = enrichment.merge(live, new, preserve_siblings=True)
    assert kept.count() == 6


def test_empty_predicate_set_matches_nothing(spark):
    df = calls(spark, [("a", "b")])
    assert scans.relations_in_file(df, "f.py", []).count() == 0 and scans.relations_in_file(df, "f.py").count() == 1
    assert scans.relation(df, {"source": "a", "target": "b"}).select(*RELATION_KEY).count() == 1


def test_positions_are_looked_up_without_a_broadcast(spark):
    """By its estimate the table of spans is small, whatever it holds: against all spans, and by the plan."""
    rnd = random.Random(8)
    spans = [(rnd.choice("ab"), f"s{i}", a := rnd.randrange(1, 3000), rnd.randrange(9), a + rnd.choice([0, 1, 3, 40, 900]), rnd.randrange(9, 20)) for i in range(120)]
    points = {(rnd.choice("ab"), rnd.randrange(1, 3000), rnd.randrange(20)) for _ in range(200)}
    table = spark.createDataFrame(spans, "path string, id string, start_line int, start_col int, end_line int, end_col int")
    df = scans.symbols_at_position(table, spark.createDataFrame(sorted(points), "path string, line int, col int"))
    got = {(r["path"], r["line"], r["col"]): r["id"] for r in df.collect()}
    want = {(p, x, y): min((e - s, f - c, i) for q, i, s, c, e, f in spans if q == p and (s, c) <= (x, y) <= (e, f)) for p, x, y in points if any(q == p and (s, c) <= (x, y) <= (e, f) for q, i, s, c, e, f in spans)}
    assert got == {k: v[2] for k, v in want.items()} and len(got) > 50
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
