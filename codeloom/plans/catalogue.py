"""Every operator as a query over the projected index, with the SQL that tells the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..model import DEFAULT_DEPTH, DEFERRED, RELATION_KEY, names
from ..operators import architecture as arch
from ..operators import enrichment, reconcile, resolution, scans, traverse
from ..operators.cycles import cycles
from ..operators.history import changes, explain
from ..operators.pages import page_df
from ..operators.tables import written
from ..sources.hooks import touched
from ..streaming import watch
from .extract import broken, deferred_of, extract, relations_of, symbols_of
from .pattern import structural_search
from .projection import Projection, ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DEPTH = DEFAULT_DEPTH
LAYERS = arch.Layers({"core": ["src/r[0-1]/*"], "rest": ["src/*"], "apps": ["app/*"], "tests": ["tests/*", "app/n1?_svc.py"]}, {"apps": ["core"], "rest": ["core"]})


def query(name: str, last: str | None = None, sql: str | None = None, recursive: bool = False):
    """Register a query; ``sql`` follows the projection's expressions up to ``last``."""

    def add(f: Callable[[Projection], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Projection(spark, sf_dir))
        if sql is not None:
            head = f"WITH {'RECURSIVE ' if recursive else ''}{ctes(last)}" if last else ""
            SQL[name] = head + ("\n" if sql.lstrip().startswith("SELECT") or not last else ",\n") + sql
        return f

    return add


S4 = "id, path, qualname, kind"


@query("find_symbol_substring", "symbols", f"SELECT {S4} FROM symbols WHERE qualname LIKE '%S1%' ESCAPE '\\'")
def _(p):
    return scans.search(p.symbols, "S1").select(*S4.split(", "))


@query("find_symbol_kind", "symbols", f"SELECT {S4} FROM symbols WHERE qualname LIKE '%S1%' AND kind = 'class'")
def _(p):
    return scans.search(p.symbols, "S1", "class").select(*S4.split(", "))


@query("find_symbol_glob", "symbols", f"SELECT {S4} FROM symbols WHERE contains(qualname, 'm1') AND path GLOB 'src/r[0-2]/n?.py'")
def _(p):
    return scans.search(p.symbols, "m1", None, "src/r[0-2]/n?.py").select(*S4.split(", "))


@query("find_symbol_literal_needle", "symbols", f"SELECT {S4} FROM symbols WHERE qualname LIKE '%t\\_c%' ESCAPE '\\'")
def _(p):
    return scans.search(p.symbols, "t_c").select(*S4.split(", "))


@query("find_symbol_min_confidence", "symbols", f"SELECT {S4}, confidence FROM symbols WHERE confidence IN ('EXTRACTED', 'INFERRED') AND contains(qualname, '.m')")
def _(p):
    return scans.search(p.symbols, ".m", None, None, "INFERRED").select(*S4.split(", "), "confidence")


@query("find_symbol_page2", "symbols", f"SELECT {S4} FROM (SELECT *, row_number() OVER (ORDER BY id) AS r FROM symbols WHERE kind = 'method') WHERE r BETWEEN 51 AND 100")
def _(p):
    found = scans.search(p.symbols, "", "method")
    last = page_df(found, ["id"], 50).agg(F.max("id")).collect()[0][0]
    return page_df(found, ["id"], 50, [last]).select(*S4.split(", "))


@query("total_count", "symbols", "SELECT count(*) AS total_count FROM symbols WHERE contains(qualname, 'S1')")
def _(p):
    return scans.search(p.symbols, "S1").agg(F.count(F.lit(1)).alias("total_count"))


@query("symbols_by_path", "symbols", f"SELECT {S4} FROM symbols WHERE path = 'tests/test_n2.py'")
def _(p):
    return scans.by_path(p.symbols, "tests/test_n2.py").select(*S4.split(", "))


@query("symbols_by_name_and_kind", "symbols", f"SELECT {S4} FROM symbols WHERE qualname = 'S1.m1' AND kind = 'method'")
def _(p):
    return scans.by_name_and_kind(p.symbols, "S1.m1", "method").select(*S4.split(", "))


@query(
    "symbol_at_position", "symbols",
    """points AS (SELECT DISTINCT path, start_line + 1 AS line, 6 AS col FROM symbols)
SELECT path, line, col, id FROM (SELECT p.*, s.id, row_number() OVER (PARTITION BY p.path, p.line, p.col ORDER BY s.end_line - s.start_line, s.end_col - s.start_col, s.id) AS r
FROM points p JOIN symbols s ON s.path = p.path AND (s.start_line, s.start_col) <= (p.line, p.col) AND (p.line, p.col) <= (s.end_line, s.end_col)) WHERE r = 1""",
)
def _(p):
    return scans.symbols_at_position(p.symbols, p.symbols.select("path", (F.col("start_line") + 1).alias("line"), F.lit(6).alias("col")).distinct())


@query(
    "symbol_at_start", "symbols",
    """points AS (SELECT DISTINCT path, start_line AS line, start_col AS col FROM symbols)
SELECT path, line, col, id FROM (SELECT p.*, s.id, row_number() OVER (PARTITION BY p.path, p.line, p.col ORDER BY s.kind <> 'module', s.id) AS r
FROM points p JOIN symbols s ON s.path = p.path AND s.start_line = p.line AND s.start_col = p.col) WHERE r = 1""",
)
def _(p):
    return scans.symbols_at_start(p.symbols, p.symbols.select("path", F.col("start_line").alias("line"), F.col("start_col").alias("col")).distinct())


@query(
    "get_definition_by_position", "relations",
    """points AS (SELECT DISTINCT site_file AS path, site_line AS line, site_col AS col FROM relations WHERE predicate <> 'imports'),
live AS (SELECT DISTINCT p.path, line, col, s.id FROM points p JOIN relations r ON r.site_file = p.path AND r.site_line = line AND r.site_col = col AND r.predicate IN ('calls', 'references', 'inherits') JOIN symbols s ON s.id = r.target),
starts AS (SELECT path, line, col, id FROM (SELECT p.*, s.id, row_number() OVER (PARTITION BY p.path, p.line, p.col ORDER BY s.kind <> 'module', s.id) AS r
  FROM points p JOIN symbols s ON s.path = p.path AND s.start_line = p.line AND s.start_col = p.col) WHERE r = 1)
SELECT * FROM live UNION ALL SELECT * FROM starts t WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.path = t.path AND l.line = t.line AND l.col = t.col)""",
)
def _(p):
    points = p.relations.where("predicate <> 'imports'").select(F.col("site_file").alias("path"), F.col("site_line").alias("line"), F.col("site_col").alias("col")).distinct()
    return scans.resolve_positions(p.symbols, p.relations, points)


K = ", ".join(RELATION_KEY)


@query("find_references", "relations", f"SELECT {K}, confidence FROM relations WHERE predicate <> 'imports' AND target IN (SELECT id FROM symbols WHERE qualname IN ('S1', 'S1.m1', 'S2.m0'))")
def _(p):
    ids = p.symbols.where(F.col("qualname").isin("S1", "S1.m1", "S2.m0")).select("id")
    return scans.references(p.relations, ids).select(*RELATION_KEY, "confidence")


@query("find_references_min_confidence", "relations", f"SELECT {K} FROM relations WHERE predicate <> 'imports' AND confidence = 'EXTRACTED' AND target IN (SELECT id FROM symbols WHERE kind = 'class')")
def _(p):
    return scans.references(p.relations, p.symbols.where("kind = 'class'").select("id"), "EXTRACTED").select(*RELATION_KEY)


@query("list_imports", "relations", "SELECT target, site_line, site_col FROM relations WHERE site_file = 'tests/test_n2.py' AND predicate = 'imports'")
def _(p):
    return scans.relations_in_file(p.relations, "tests/test_n2.py", ["imports"]).select("target", "site_line", "site_col")


@query("out_edges", "relations", f"SELECT {K} FROM relations WHERE predicate IN ('calls', 'overrides') AND source IN (SELECT id FROM symbols WHERE kind = 'method' AND is_stub)")
def _(p):
    return scans.out_edges(p.relations, p.symbols.where("kind = 'method' AND is_stub"), ["calls", "overrides"]).select(*RELATION_KEY)


# traversal

ROOT = "root AS (SELECT id FROM methods WHERE pk = 0)"


def _levels(predicates: str, here: str, there: str, depth: int, cap: int | None = None) -> str:
    """Chained expressions l0, l1, ...: the first edge that meets each new node, and the cap's order."""
    out = [ROOT, f"e AS (SELECT *, {here} AS cur, {there} AS nxt FROM relations WHERE predicate IN ({predicates}))"]
    out.append("l0 AS (SELECT id, 0 AS level, NULL::VARCHAR AS discovery_predicate, NULL::VARCHAR AS discovery_confidence FROM root)")
    order = "cur, site_file, site_line, site_col, source, target, predicate"
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{k}" for k in range(d))
        limit = f"LIMIT greatest({cap} - (SELECT count(*) FROM ({seen})), 0)" if cap else ""
        out.append(f"""l{d} AS (SELECT nxt AS id, {d} AS level, predicate AS discovery_predicate, confidence AS discovery_confidence FROM (
  SELECT e.*, row_number() OVER (PARTITION BY nxt ORDER BY {order}) AS r FROM e JOIN l{d - 1} ON l{d - 1}.id = cur)
  WHERE r = 1 AND nxt NOT IN ({seen}) ORDER BY {order} {limit})""")
    out.append("reached AS (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(depth + 1)) + ")")
    return ",\n".join(out)


def _bfs(p: Projection, predicates, upstream: bool, cap: int | None = None) -> traverse.Reach:
    return traverse.bfs(p.relations, p.method_id(), predicates, upstream, cap, DEPTH)


def _walk(here: str, there: str, root: str = ROOT, predicate: str = "calls") -> str:
    return f"""{root},
walk(id, level) AS (SELECT id, 0 FROM root UNION SELECT {there}, level + 1 FROM walk JOIN relations ON {here} = id AND predicate = '{predicate}' WHERE level < {DEPTH})
SELECT id, min(level)::INT AS level FROM walk GROUP BY id"""


@query("graph_call_down_nodes", "relations", _walk("source", "target"), True)
def _(p):
    return traverse.graph(p.relations, p.method_id(), "call", "downstream", None, DEPTH).nodes.select("id", "level")


@query("graph_call_up_nodes", "relations", _walk("target", "source"), True)
def _(p):
    return traverse.graph(p.relations, p.method_id(), "call", "upstream", None, DEPTH).nodes.select("id", "level")


@query("graph_call_down_edges", "relations", _levels("'calls'", "source", "target", DEPTH) + f"\nSELECT {K}, level::INT AS level FROM e JOIN reached ON cur = id WHERE level < {DEPTH} AND nxt IN (SELECT id FROM reached)")
def _(p):
    return traverse.graph(p.relations, p.method_id(), "call", "downstream", None, DEPTH).edges.select(*RELATION_KEY, F.col("current_level").alias("level"))


@query("graph_dependency", "relations", _walk("source", "target", "root AS (SELECT path || ':#module' AS id FROM modules WHERE path = 'tests/test_n2.py')", "imports"), True)
def _(p):
    return traverse.graph(p.relations, "tests/test_n2.py:#module", "dependency", "downstream", None, DEPTH).nodes.select("id", "level")


@query("graph_capped", "relations", _levels("'calls'", "source", "target", DEPTH, 60) + "\nSELECT id, level::INT AS level FROM reached")
def _(p):
    return _bfs(p, ["calls"], False, 60).nodes.select("id", "level")


@query("graph_resolved_nodes", "relations", _levels("'imports'", "source", "target", 1).replace(ROOT, "root AS (SELECT 'tests/test_n2.py:#module' AS id)") + "\nSELECT r.id, s.kind, s.id IS NOT NULL AS resolved FROM reached r LEFT JOIN symbols s ON s.id = r.id")
def _(p):
    got = traverse.bfs(p.relations, "tests/test_n2.py:#module", ["imports"], False, None, 1)
    return traverse.resolved(got.nodes, p.symbols).select("id", "kind", "resolved")


IMPACT = _levels("'calls', 'imports', 'overrides'", "target", "source", DEPTH)
TESTS = _levels("'calls', 'overrides'", "target", "source", DEPTH)
TEST_NODES = "tests AS (SELECT r.* FROM reached r JOIN symbols s ON s.id = r.id WHERE level > 0 AND kind IN ('function', 'method') AND regexp_matches(path, '(^|/)(test_[^/]*|[^/]*_test)\\.py$') AND regexp_matches(qualname, '(^|\\.)test_[^.]*$'))"
TIERS = ", ".join(f"count(*) FILTER (WHERE discovery_confidence = '{c}') AS {c}" for c in ("EXTRACTED", "INFERRED", "AMBIGUOUS")) + ", count(*) AS total"
NODE = ["id", "level", "discovery_predicate", "discovery_confidence"]


@query("impact_nodes", "relations", IMPACT + "\nSELECT id, level::INT AS level, discovery_predicate, discovery_confidence FROM reached WHERE level > 0")
def _(p):
    return _bfs(p, ["calls", "imports", "overrides"], True).nodes.where("level > 0").select(*NODE)


@query("impact_summary", "relations", IMPACT + f"\nSELECT {TIERS} FROM reached WHERE level > 0")
def _(p):
    return traverse.tier_counts(_bfs(p, ["calls", "imports", "overrides"], True).nodes.where("level > 0"))


@query("affected_tests", "relations", TESTS + ",\n" + TEST_NODES + "\nSELECT id, level::INT AS level, discovery_predicate, discovery_confidence FROM tests")
def _(p):
    return traverse.test_nodes(_bfs(p, ["calls", "overrides"], True).nodes.where("level > 0"), p.symbols).select(*NODE)


@query("test_summary", "relations", TESTS + ",\n" + TEST_NODES + f"\nSELECT {TIERS} FROM tests")
def _(p):
    return traverse.tier_counts(traverse.test_nodes(_bfs(p, ["calls", "overrides"], True).nodes.where("level > 0"), p.symbols))


# architecture

SUFFIXES = """parts AS (SELECT path, string_split(replace(regexp_replace(path, '(/__init__)?\\.py$', ''), '/', '.'), '.') AS a FROM modules),
suffixes AS (SELECT array_to_string(a[i:], '.') AS suffix, path FROM (SELECT path, a, unnest(generate_series(1, len(a))) AS i FROM parts))"""
RESOLVED = SUFFIXES + """,
imports AS (SELECT source, site_file, site_line, site_col, target FROM relations WHERE predicate = 'imports'),
direct AS (SELECT i.*, path AS target_path FROM imports i JOIN suffixes ON suffix = target),
resolved AS (SELECT * FROM direct UNION ALL
  SELECT i.*, path FROM (SELECT * FROM imports WHERE target NOT IN (SELECT suffix FROM suffixes)) i LEFT JOIN suffixes ON contains(target, '.') AND suffix = regexp_replace(target, '\\.[^.]*$', ''))"""  # fmt: skip
EDGES = RESOLVED + ",\nfile_edges AS (SELECT DISTINCT site_file AS source, target_path AS target FROM resolved WHERE target_path IS NOT NULL)"
COUNTS = RESOLVED + ",\ncounts AS (SELECT m.path, count(r.site_file) AS external_dependency_count FROM modules m LEFT JOIN (SELECT * FROM resolved WHERE target_path IS NULL) r ON r.site_file = m.path GROUP BY m.path)"
DIR = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '' END"


def _modules(p: Projection) -> DataFrame:
    return p.symbols.where("kind = 'module'")


def _resolved(p: Projection) -> DataFrame:
    return arch.resolve_imports(p.relations.where("predicate = 'imports'").select("source", "site_file", "site_line", "site_col", "target"), _modules(p))


@query("dotted_suffix_index", "modules", SUFFIXES + "\nSELECT suffix, path FROM suffixes")
def _(p):
    return arch.dotted_index(_modules(p))


@query("import_resolution", "relations", RESOLVED + "\nSELECT * FROM resolved")
def _(p):
    return _resolved(p)


@query("file_edges", "relations", EDGES + "\nSELECT * FROM file_edges")
def _(p):
    return arch.file_edges(_resolved(p))


@query("file_edges_in_scope", "relations", EDGES + "\nSELECT * FROM file_edges WHERE source LIKE 'src/%' AND target LIKE 'src/%'")
def _(p):
    return arch.file_edges(_resolved(p), "src/")


@query("external_counts", "relations", COUNTS + "\nSELECT * FROM counts")
def _(p):
    return arch.external_counts(_resolved(p), _modules(p))


@query("package_rollup", "relations", COUNTS + f"\nSELECT {DIR.format('path')} AS path, sum(external_dependency_count)::BIGINT AS external_dependency_count FROM counts GROUP BY 1")
def _(p):
    return arch.package_counts(arch.external_counts(_resolved(p), _modules(p)))


@query("package_edges", "relations", EDGES + f"\nSELECT DISTINCT {DIR.format('source')} AS source, {DIR.format('target')} AS target FROM file_edges WHERE {DIR.format('source')} <> {DIR.format('target')}")
def _(p):
    return arch.package_edges(arch.file_edges(_resolved(p)))


@query(
    "layer_violations", "relations",
    EDGES + """,
globs(layer, g) AS (VALUES ('core', 'src/r[0-1]/*'), ('rest', 'src/*'), ('apps', 'app/*'), ('tests', 'tests/*'), ('tests', 'app/n1?_svc.py')),
allowed(a, b) AS (VALUES ('apps', 'core'), ('rest', 'core')),
files AS (SELECT DISTINCT path, layer FROM modules JOIN globs ON path GLOB g)
SELECT source, target, x.layer AS from_layer, y.layer AS to_layer FROM file_edges JOIN files x ON x.path = source JOIN files y ON y.path = target
WHERE x.layer <> y.layer AND NOT EXISTS (SELECT 1 FROM allowed WHERE a = x.layer AND b = y.layer)""",
)
def _(p):
    return arch.violations(arch.file_edges(_resolved(p)), LAYERS)


@query(
    "cycles", "relations",
    EDGES + """,
reach(a, b) AS (SELECT source, target FROM file_edges UNION SELECT a, target FROM reach JOIN file_edges ON source = b)
SELECT least(x.a, min(x.b)) AS component, x.a AS member FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a""",
    True,
)
def _(p):
    return cycles(arch.file_edges(_resolved(p)))


@query(
    "cycles_coloured", "relations",
    EDGES + """,
reach(a, b) AS (SELECT source, target FROM file_edges UNION SELECT a, target FROM reach JOIN file_edges ON source = b)
SELECT least(x.a, min(x.b)) AS component, x.a AS member FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY x.a""",
    True,
)
def _(p):
    return cycles(arch.file_edges(_resolved(p)), small=0)


# resolution of deferred names


def _deferred_sql(spark_dialect: bool) -> str:
    none = "CAST(NULL AS STRING)"
    prov = "'tree' AS provenance_provider, '1' AS provenance_version, 't' AS observed_at"
    module = "CASE WHEN t.ck % 2 = 0 THEN 'test_n' ELSE 'n' END || CAST(t.nk AS STRING) || CASE WHEN t.ck % 2 = 0 THEN '' ELSE '_svc' END"
    folder = "CASE WHEN t.ck % 2 = 0 THEN 'tests' ELSE 'app' END"
    return f"""named AS (SELECT f.*, c_nationkey AS nk FROM functions f JOIN customer ON c_custkey = f.ck),
aims AS (SELECT f.id, f.ck, f.path, CASE WHEN f.ck % 11 = 0 THEN 'nothing' ELSE t.name END AS name, {module} AS module, {folder} AS folder FROM (SELECT named.*, (ck * 7 + 1) % (SELECT count(*) FROM customer) AS other FROM named) f JOIN named t ON t.ck = f.other),
bases AS (SELECT c.id, c.k, c.path, 'S' || CAST(b.k AS STRING) AS base, regexp_replace(regexp_replace(b.path, '.*/', ''), '[.]py$', '') AS module FROM (SELECT classes.*, (k * 3) % (SELECT count(*) FROM supplier) AS other FROM classes) c JOIN classes b ON b.k = c.other),
deferred AS (
  SELECT 'call' AS deferred_kind, id AS source, CASE WHEN ck % 3 = 0 THEN folder || '.' || module ELSE module END AS module_path, name, {none} AS attribute, {none} AS base_name, {none} AS method_name, path AS site_file, CAST(ck + 1 AS INT) AS site_line, 5 AS site_col, {none} AS enclosing_class, {prov} FROM aims
  UNION ALL SELECT 'attribute_call', id, folder, module, name, {none}, {none}, path, CAST(ck + 1 AS INT), 9, {none}, {prov} FROM aims WHERE ck % 5 = 0
  UNION ALL SELECT 'inherit', id, module, base, {none}, {none}, {none}, path, CAST(100 * k + 2 AS INT), 20, {none}, {prov} FROM bases
  UNION ALL SELECT 'override', m.id, b.module, {none}, {none}, b.base, CASE WHEN m.j % 4 = 0 THEN 'none' ELSE 'm' || CAST(m.j AS STRING) END, m.path, CAST(100 * m.k + 3 + 4 * m.j AS INT), 4, {none}, {prov} FROM methods m JOIN bases b ON b.k = m.k
  UNION ALL SELECT 'self_call', m.id, CASE WHEN m.k % 7 = 0 THEN NULL ELSE b.module END, {none}, {none}, CASE WHEN m.k % 7 = 0 THEN NULL ELSE b.base END, 'm' || CAST((m.j * 2) % 24 AS STRING), m.path, CAST(100 * m.k + 4 + 4 * m.j AS INT), 13, b.id, {prov} FROM methods m JOIN bases b ON b.k = m.k)"""


DEFER = _deferred_sql(False)
CANDIDATES = DEFER + ",\n" + SUFFIXES + """,
one AS (SELECT d.*, s.id AS candidate FROM deferred d JOIN suffixes x ON x.suffix = CASE WHEN deferred_kind = 'attribute_call' THEN module_path || '.' || name ELSE module_path END
    JOIN symbols s ON s.path = x.path AND s.qualname = coalesce(d.attribute, d.name) AND s.kind = CASE WHEN deferred_kind = 'inherit' THEN 'class' ELSE 'function' END WHERE deferred_kind IN ('call', 'attribute_call', 'inherit')),
two AS (SELECT d.*, m.id AS candidate FROM deferred d JOIN suffixes x ON x.suffix = module_path JOIN symbols b ON b.path = x.path AND b.qualname = base_name AND b.kind = 'class'
    JOIN symbols m ON m.path = b.path AND m.qualname = b.qualname || '.' || method_name AND m.kind = 'method' WHERE deferred_kind IN ('override', 'self_call')),
found AS (SELECT DISTINCT * FROM one UNION SELECT * FROM two),
told AS (SELECT *, count(*) OVER (PARTITION BY deferred_kind, source, site_file, site_line, site_col, module_path, name, attribute, base_name, method_name, enclosing_class) AS n FROM found)"""  # fmt: skip
TOLD = "\nSELECT source, candidate AS target, CASE deferred_kind WHEN 'inherit' THEN 'inherits' WHEN 'override' THEN 'overrides' ELSE 'calls' END AS predicate, site_file, site_line, site_col, CASE WHEN n = 1 THEN 'EXTRACTED' ELSE 'AMBIGUOUS' END AS confidence FROM told WHERE deferred_kind = "


def _deferred(p: Projection) -> DataFrame:
    for name in ("symbols",):
        getattr(p, name)
    for t in ("customer", "supplier", "nation", "part"):
        p.table(t).createOrReplaceTempView(t)
    return p.spark.sql(f"WITH {ctes('symbols', True)},\n{_deferred_sql(True)} SELECT * FROM deferred").select(*names(DEFERRED))


for _kind, _name in (("call", "resolve_calls"), ("attribute_call", "resolve_attribute_calls"), ("inherit", "resolve_inherits"), ("override", "resolve_overrides"), ("self_call", "resolve_self_calls")):

    def _resolve(p, kind=_kind):
        return resolution.resolve(_deferred(p), p.symbols, (kind,)).select(*RELATION_KEY, "confidence")

    query(_name, "symbols", CANDIDATES + TOLD + f"'{_kind}'")(_resolve)

SITE = ["source", "site_file", "site_line", "site_col"]
OPEN = """,
open AS (SELECT d.* FROM deferred d WHERE deferred_kind <> 'override' AND NOT EXISTS (SELECT 1 FROM found f WHERE f.deferred_kind = d.deferred_kind AND f.source = d.source AND f.site_line = d.site_line AND f.site_col = d.site_col AND f.site_file = d.site_file
    AND f.module_path IS NOT DISTINCT FROM d.module_path AND f.name IS NOT DISTINCT FROM d.name AND f.base_name IS NOT DISTINCT FROM d.base_name AND f.method_name IS NOT DISTINCT FROM d.method_name))"""


@query("unresolved_sites", "symbols", CANDIDATES + OPEN + "\nSELECT deferred_kind, source, site_file, site_line, site_col, module_path, method_name FROM open")
def _(p):
    return resolution.unresolved(_deferred(p), p.symbols).select("deferred_kind", *SITE, "module_path", "method_name")


# enrichment

STUBS = """stubs AS (SELECT s.id AS stub, s.path, regexp_extract(qualname, '^(.*)\\.[^.]*$', 1) AS owner, regexp_extract(qualname, '[^.]*$') AS mname FROM symbols s WHERE is_stub AND contains(qualname, '.')),
declared AS (SELECT DISTINCT t.stub, c.id AS cls, mname FROM stubs t JOIN relations d ON d.predicate = 'defines' AND d.target = t.stub JOIN symbols c ON c.id = d.source AND c.kind = 'class' AND c.path = t.path),
below AS (SELECT DISTINCT stub, m.id AS method FROM declared JOIN relations i ON i.predicate = 'inherits' AND i.target = cls AND i.source <> cls JOIN symbols c ON c.id = i.source AND c.kind = 'class'
    JOIN symbols m ON m.path = c.path AND m.kind = 'method' AND NOT m.is_stub AND m.qualname = c.qualname || '.' || mname),
calls AS (SELECT DISTINCT source, target, site_file, site_line, site_col FROM relations WHERE predicate = 'calls'),
stub_calls AS (SELECT c.source, b.method AS target, c.site_file, c.site_line, c.site_col, CASE WHEN count(*) OVER (PARTITION BY c.source, c.target, c.site_file, c.site_line, c.site_col) = 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence FROM calls c JOIN below b ON b.stub = c.target)"""
OUT = ["source", "target", "site_file", "site_line", "site_col", "confidence"]


@query("protocol_stub_calls", "relations", STUBS + "\nSELECT * FROM stub_calls")
def _(p):
    return enrichment.stub_calls(p.symbols, p.relations, "t").select(*OUT)


MIXINS = """sites AS (SELECT DISTINCT source, site_file, site_line, site_col, enclosing_class, method_name FROM deferred WHERE deferred_kind = 'self_call'),
composed AS (SELECT DISTINCT s.*, m.id AS target FROM sites s JOIN relations a ON a.predicate = 'inherits' AND a.target = s.enclosing_class JOIN relations b ON b.predicate = 'inherits' AND b.source = a.source AND b.target <> s.enclosing_class
    JOIN symbols c ON c.id = b.target JOIN symbols m ON m.kind = 'method' AND m.path = c.path AND m.qualname = c.qualname || '.' || s.method_name)"""


@query("mixin_calls", "relations", DEFER + ",\n" + MIXINS + "\nSELECT source, target, site_file, site_line, site_col, CASE WHEN count(*) OVER (PARTITION BY source, site_file, site_line, site_col, enclosing_class, method_name) = 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence FROM composed")
def _(p):
    return enrichment.mixin_calls(_deferred(p).where("deferred_kind = 'self_call'"), p.symbols, p.relations, "t").select(*OUT)


@query(
    "enrichment_worklist", "relations",
    CANDIDATES + OPEN + """,
mixins AS (SELECT DISTINCT source, site_file, site_line, site_col, 'calls' AS predicate, enclosing_class, method_name FROM open o WHERE deferred_kind = 'self_call' AND enclosing_class IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM relations r WHERE r.predicate = 'calls' AND r.source = o.source AND r.site_file = o.site_file AND r.site_line = o.site_line AND r.site_col = o.site_col)
    AND NOT EXISTS (SELECT 1 FROM found f WHERE f.deferred_kind = 'self_call' AND f.source = o.source AND f.site_file = o.site_file AND f.site_line = o.site_line AND f.site_col = o.site_col)),
plain AS (SELECT source, site_file, site_line, site_col, predicate FROM relations WHERE predicate IN ('calls', 'inherits') AND confidence = 'AMBIGUOUS'
    UNION SELECT source, site_file, site_line, site_col, CASE WHEN deferred_kind = 'inherit' THEN 'inherits' ELSE 'calls' END FROM open WHERE deferred_kind <> 'self_call')
SELECT 'site' AS kind, p.*, NULL::VARCHAR AS enclosing_class, NULL::VARCHAR AS method_name FROM plain p WHERE NOT EXISTS (SELECT 1 FROM mixins m WHERE m.source = p.source AND m.site_file = p.site_file AND m.site_line = p.site_line AND m.site_col = p.site_col)
UNION ALL SELECT 'mixin', source, site_file, site_line, site_col, predicate, enclosing_class, method_name FROM mixins""",
)
def _(p):
    return enrichment.worklist(p.relations, _deferred(p), p.symbols, p.relations)


INCOMING = f"""incoming AS (SELECT source, CASE WHEN site_line % 3 = 0 THEN target || '!' ELSE target END AS target, predicate, site_file, site_line, site_col,
  CASE site_line % 4 WHEN 0 THEN 'AMBIGUOUS' ELSE 'INFERRED' END AS confidence FROM relations WHERE predicate IN ('calls', 'inherits')),
accepted AS (SELECT i.* FROM incoming i LEFT JOIN relations l USING ({K}) WHERE l.confidence IS NULL OR CASE i.confidence WHEN 'INFERRED' THEN 1 ELSE 2 END <= CASE l.confidence WHEN 'EXTRACTED' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END)"""


def _incoming(p: Projection) -> DataFrame:
    r = p.relations.where("predicate IN ('calls', 'inherits')")
    return r.withColumn("target", F.when(F.col("site_line") % 3 == 0, F.concat("target", F.lit("!"))).otherwise(F.col("target"))).withColumn("confidence", F.when(F.col("site_line") % 4 == 0, "AMBIGUOUS").otherwise("INFERRED"))


@query("merge_guard", "relations", INCOMING + f"\nSELECT {K}, confidence FROM accepted")
def _(p):
    return enrichment.accepted(_incoming(p), p.relations).select(*RELATION_KEY, "confidence")


@query(
    "retired_siblings", "relations",
    INCOMING + f"""
SELECT {K} FROM relations l WHERE confidence = 'AMBIGUOUS' AND EXISTS (SELECT 1 FROM accepted a WHERE a.source = l.source AND a.predicate = l.predicate AND a.site_file = l.site_file AND a.site_line = l.site_line AND a.site_col = l.site_col AND a.target <> l.target
  AND (a.confidence <> 'AMBIGUOUS' OR NOT EXISTS (SELECT 1 FROM accepted b WHERE b.source = l.source AND b.predicate = l.predicate AND b.site_file = l.site_file AND b.site_line = l.site_line AND b.site_col = l.site_col AND b.target = l.target)))""",
)
def _(p):
    return enrichment.retired(enrichment.accepted(_incoming(p), p.relations), p.relations).select(*RELATION_KEY)


# history and reconciliation

LIVE = "latest AS (SELECT id, arg_max(content, history_id) AS content, arg_max(observed_at, history_id) AS observed_at, arg_max(tombstone, history_id) AS tombstone FROM history GROUP BY id)"


@query("history_changes", "history", "SELECT history_id, id, content FROM (SELECT *, lag(content) OVER (PARTITION BY id ORDER BY history_id) AS b FROM history) WHERE content IS DISTINCT FROM b")
def _(p):
    return changes(p.history, ["id"], ["content"]).select("history_id", "id", "content")


@query("live_from_history", "history", LIVE + "\nSELECT id, content, observed_at FROM latest WHERE NOT tombstone")
def _(p):
    return scans.latest_content(p.history, ["id"]).select("id", "content", "observed_at")


@query("tombstoned", "history", LIVE + "\nSELECT id, tombstone AS is_tombstoned FROM latest")
def _(p):
    return scans.tombstoned(p.history, ["id"])


@query(
    "explain_symbols", "history",
    LIVE + """,
rows AS (SELECT h.*, row_number() OVER (PARTITION BY id ORDER BY history_id DESC) AS r FROM history h WHERE NOT tombstone)
SELECT id, content, observed_at, false AS deleted FROM latest WHERE NOT tombstone
UNION ALL SELECT r.id, r.content, r.observed_at, l.tombstone AND r = 1 FROM rows r JOIN latest l USING (id) WHERE l.tombstone OR r > 1""",
)
def _(p):
    live = scans.latest_content(p.history, ["id"]).select("id", "content", "observed_at")
    return explain(live, p.history, ["id"]).select("id", "content", "observed_at", "deleted")


CUT = """cut AS (SELECT max(history_id) // 2 AS m FROM history),
old AS (SELECT id, arg_max(content, history_id) AS content FROM history, cut WHERE history_id <= m AND id::INT % 3 <> 0 GROUP BY id),
new AS (SELECT id, arg_max(content, history_id) AS content FROM history, cut WHERE history_id > m AND id::INT % 5 <> 0 GROUP BY id)"""


def _cut(p: Projection) -> tuple[DataFrame, DataFrame]:
    m = p.history.agg(F.max("history_id")).collect()[0][0] // 2
    last = lambda df: df.groupBy("id").agg(F.max_by("content", "history_id").alias("content"))
    old = last(p.history.where((F.col("history_id") <= m) & (F.col("id").cast("int") % 3 != 0)))
    return old, last(p.history.where((F.col("history_id") > m) & (F.col("id").cast("int") % 5 != 0)))


@query("reconcile_actions", "history", CUT + "\nSELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'keep' WHEN n.content IS DISTINCT FROM o.content THEN 'change' ELSE 'refresh' END AS action FROM old o FULL JOIN new n ON n.id = o.id")
def _(p):
    old, new = _cut(p)
    return reconcile.diff(old, new, ["id"], ["content"]).select(F.coalesce("new.id", "old.id").alias("id"), "action")


@query("reconcile_deletes", "history", CUT + "\nSELECT id FROM old WHERE id::INT % 2 = 0 EXCEPT SELECT id FROM new")
def _(p):
    old, new = (df.withColumn("observed_at", F.lit("t")) for df in _cut(p))
    return reconcile.reconcile(old, new, F.col("id").cast("int") % 2 == 0, ["id"], ["content"], "t").removed


@query("reconcile_live", "history", CUT + "\nSELECT id, content FROM new UNION ALL SELECT id, content FROM old WHERE id NOT IN (SELECT id FROM new) AND id::INT % 2 <> 0")
def _(p):
    old, new = (df.withColumn("observed_at", F.lit("t")) for df in _cut(p))
    return reconcile.reconcile(old, new, F.col("id").cast("int") % 2 == 0, ["id"], ["content"], "t").live.select("id", "content")


@query("reconcile_appended", "history", CUT + """
SELECT n.id, n.content, false AS tombstone FROM new n LEFT JOIN old o ON o.id = n.id WHERE n.content IS DISTINCT FROM o.content
UNION ALL SELECT id, NULL, true FROM (SELECT id FROM old WHERE id::INT % 2 = 0 EXCEPT SELECT id FROM new)""")
def _(p):
    old, new = (df.withColumn("observed_at", F.lit("t")) for df in _cut(p))
    return reconcile.reconcile(old, new, F.col("id").cast("int") % 2 == 0, ["id"], ["content"], "t").appended.select("id", "content", "tombstone")


@query("stale_inbound", "relations", f"SELECT {K} FROM relations WHERE target IN (SELECT id FROM symbols WHERE kind = 'method' AND start_line % 13 = 0) AND NOT (predicate = 'overrides')")
def _(p):
    gone = p.symbols.where("kind = 'method' AND start_line % 13 = 0").select("id")
    return reconcile.stale_inbound(p.relations, gone, p.relations.where("predicate = 'overrides'"))


# extraction over generated sources

GEN = """gen AS (SELECT 'gen/s' || k || '.py' AS path, k, j, p_size % 5 = 0 AS empty, count(*) OVER (PARTITION BY k) AS n, 'S' || k AS cls FROM methods),
files AS (SELECT DISTINCT path, k, n, cls, CASE WHEN k % 3 = 0 THEN 'Protocol' ELSE 'Base' || (k % 3) END AS base FROM gen)"""


def _facts(p: Projection) -> DataFrame:
    return extract(p.sources(), "t")


@query(
    "extract_symbols", "methods",
    GEN + """
SELECT path, path || ':#module' AS id, 'module' AS kind, 1 AS start_line, 0 AS start_col, (7 + 2 * n)::INT AS end_line, 0 AS end_col, false AS is_stub FROM files
UNION ALL SELECT path, path || ':' || cls || '#class', 'class', 3, 0, (3 + 2 * n)::INT, (SELECT CASE WHEN empty THEN 12 ELSE 31 + length(((g.j + 1) % g.n)::VARCHAR) END FROM gen g WHERE g.path = f.path AND g.j = f.n - 1)::INT, false FROM files f
UNION ALL SELECT path, path || ':' || cls || '.m' || j || '#method', 'method', (4 + 2 * j)::INT, 4, (5 + 2 * j)::INT, (CASE WHEN empty THEN 12 ELSE 31 + length(((j + 1) % n)::VARCHAR) END)::INT, empty AND k % 3 = 0 FROM gen
UNION ALL SELECT path, path || ':f' || k || '#function', 'function', (4 + 2 * n)::INT, 0, (6 + 2 * n)::INT, (14 + length(k::VARCHAR))::INT, false FROM files""",
)
def _(p):
    return symbols_of(_facts(p)).select("path", "id", "kind", "start_line", "start_col", "end_line", "end_col", "is_stub")


GEN_REL = {
    "defines": """SELECT path || ':#module' AS source, path || ':' || cls || '#class' AS target, 3 AS site_line, 0 AS site_col FROM files UNION ALL SELECT path || ':#module', path || ':f' || k || '#function', (4 + 2 * n)::INT, 0 FROM files
        UNION ALL SELECT path || ':' || cls || '#class', path || ':' || cls || '.m' || j || '#method', (4 + 2 * j)::INT, 4 FROM gen""",
    "imports": "SELECT path || ':#module' AS source, t AS target, l AS site_line, 0 AS site_col FROM (SELECT path, 'os' AS t, 1 AS l FROM files UNION ALL SELECT path, 'ext.base.' || base, 2 FROM files UNION ALL SELECT path, 'ext.base.helper', 2 FROM files)",
    "calls": """SELECT path || ':' || cls || '.m' || j || '#method' AS source, path || ':' || cls || '.m' || ((j + 1) % n) || '#method' AS target, (5 + 2 * j)::INT AS site_line, 27 AS site_col FROM gen WHERE NOT empty
        UNION ALL SELECT path || ':f' || k || '#function', path || ':f' || k || '#function', (6 + 2 * n)::INT, 11 FROM files""",
    "references": "SELECT path || ':f' || k || '#function' AS source, path || ':' || cls || '#class' AS target, (5 + 2 * n)::INT AS site_line, 8 AS site_col FROM files",
}
for _predicate, _text in GEN_REL.items():

    def _extracted(p, predicate=_predicate):
        return relations_of(_facts(p)).where(F.col("predicate") == predicate).select("source", "target", "site_line", "site_col")

    query(f"extract_{_predicate}", "methods", GEN + "\n" + _text)(_extracted)
    SQL[f"extract_{_predicate}"] = f"WITH {ctes('methods')},\n{GEN}\n{_text}"


@query(
    "extract_deferred", "methods",
    GEN + """
SELECT 'inherit' AS deferred_kind, path || ':' || cls || '#class' AS source, 'ext.base' AS module_path, base AS name, NULL::VARCHAR AS method_name, 3 AS site_line, (7 + length(cls))::INT AS site_col FROM files
UNION ALL SELECT 'call', path || ':' || cls || '.m' || j || '#method', 'ext.base', 'helper', NULL, (5 + 2 * j)::INT, 15 FROM gen WHERE NOT empty
UNION ALL SELECT 'override', path || ':' || cls || '.m' || j || '#method', 'ext.base', NULL, 'm' || j, (4 + 2 * j)::INT, 4 FROM gen""",
)
def _(p):
    return deferred_of(_facts(p)).select("deferred_kind", "source", "module_path", "name", "method_name", "site_line", "site_col")


@query("structural_class_names", "methods", GEN + "\nSELECT path, 3 AS anchor_line, 6 AS anchor_col, cls AS name FROM files")
def _(p):
    return structural_search(p.sources(), "(class_definition name: (identifier) @name)").select("path", "anchor_line", "anchor_col", F.col("captures")["name"][0]["text"].alias("name"))


@query("structural_calls", "methods", GEN + "\nSELECT path, (5 + 2 * j)::INT AS anchor_line, 15 AS anchor_col, 'm' || ((j + 1) % n) AS method FROM gen WHERE NOT empty")
def _(p):
    pattern = '(call function: (identifier) @f arguments: (argument_list (call function: (attribute object: (identifier) @o attribute: (identifier) @m)))) (#eq? @f "helper")'
    found = structural_search(p.sources(), pattern.replace(') (#eq? @f "helper")', ' (#eq? @f "helper"))'))
    return found.select("path", "anchor_line", "anchor_col", F.col("captures")["m"][0]["text"].alias("method"))


@query("scan_totals", "methods", GEN + "\nSELECT (SELECT count(*) FROM files) AS files_indexed, 1::BIGINT AS files_failed, (SELECT 3 * count(*) FROM files) + (SELECT count(*) FROM gen) AS symbols")
def _(p):
    files = p.sources().unionByName(p.spark.createDataFrame([("gen/bad.py", "def (:\n")], "path string, source string"))
    facts = written(extract(files, "t"))
    n = facts.agg(F.count_distinct(F.when(F.col("row_kind") == "symbol", F.col("path"))).alias("files_indexed"), F.count_if(F.col("row_kind") == "error").alias("files_failed"), F.count_if(F.col("row_kind") == "symbol").alias("symbols"))
    assert broken(facts).count() == 1
    return n


# streams, as batches

@query(
    "debounce_sessions", None,
    """WITH e AS (SELECT 'w' || (user_id % 20) AS worktree_id, ts, 'f' || (user_id % 7) || '.py' AS path FROM events),
m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY worktree_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY worktree_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT worktree_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths, count(*) AS n_events FROM s GROUP BY worktree_id, g""",
)
def _(p):
    e = p.table("events").select(F.concat(F.lit("w"), (F.col("user_id") % 20).cast("string")).alias("worktree_id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("f"), (F.col("user_id") % 7).cast("string"), F.lit(".py")).alias("path"))
    out = watch.debounced(watch.relevant(e), "1 hour", late=None)
    return out.select("worktree_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), F.array_join("paths", ",").alias("paths"), "n_events")


@query(
    "enrichment_trigger_times", "edits",
    """o AS (SELECT key, at_ms, row_number() OVER (PARTITION BY key ORDER BY at_ms) AS r FROM edits),
runs(key, r, first, last) AS (SELECT key, r, at_ms, at_ms FROM o WHERE r = 1
  UNION ALL SELECT o.key, o.r, CASE WHEN at_ms - last < 30000 AND last < first + 300000 THEN first ELSE at_ms END, at_ms FROM runs JOIN o ON o.key = runs.key AND o.r = runs.r + 1)
SELECT key, greatest(max(last), least(max(last) + 30000, first + 300000))::BIGINT AS fired_ms, first::BIGINT AS first_ms, count(*) AS n_edits FROM runs GROUP BY key, first""",
    True,
)
def _(p):
    return watch.trigger_times(p.edits)


@query(
    "staleness_decisions", "history",
    """state AS (SELECT user_id % 500 AS u, max(event_id) AS mtime, max(props) AS hash FROM events WHERE event_id % 2 = 0 GROUP BY 1),
touched AS (SELECT user_id % 700 AS u, max(event_id) AS mtime, max(props) AS hash, bool_and(event_type <> 'error') AS exists FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT 'f' || t.u AS path, CASE WHEN NOT exists AND s.u IS NOT NULL THEN 'tombstone' WHEN NOT exists THEN 'nothing' WHEN t.mtime = s.mtime THEN 'nothing' WHEN t.hash = s.hash THEN 'refresh' ELSE 'reindex' END AS action FROM touched t LEFT JOIN state s ON s.u = t.u""",
)
def _(p):
    e = p.table("events")
    name = lambda n: F.concat(F.lit("f"), (F.col("user_id") % n).cast("string")).alias("path")
    state = e.where("event_id % 2 = 0").groupBy(name(500)).agg(F.max("event_id").alias("mtime_ns"), F.max("props").alias("content_hash"))
    now = e.where("event_id % 3 = 0").groupBy(name(700)).agg(F.max("event_id").alias("mtime_ns"), F.max("props").alias("content_hash"), F.bool_and(F.col("event_type") != "error").alias("exists"))
    return watch.decide(now, state)


@query("hook_paths", None, "SELECT DISTINCT 'src/u' || user_id || '.py' AS path FROM events WHERE event_type IN ('click', 'view')")
def _(p):
    path = F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".py"))
    diff = F.concat(F.lit("--- a/"), path, F.lit("\\n+++ b/"), path, F.lit("\\n+++ /dev/null\\n+++ b/x.txt"))
    e = p.table("events").select(
        F.when(F.col("event_type") == "click", "claude-code").when(F.col("event_type") == "view", "codex").otherwise("other").alias("agent"),
        F.when(F.col("event_type") == "view", F.concat(F.lit('{"tool_input": {"command": "'), diff, F.lit('"}}'))).otherwise(F.concat(F.lit('{"tool_input": {"file_path": "'), path, F.lit('"}}'))).alias("payload"),
    )
    return touched(e)


# scalar functions


@query("content_hash", None, "SELECT c_custkey, sha256(c_name) AS content_hash, substr(sha256(c_name), 1, 16) AS worktree_id FROM customer")
def _(p):
    return p.table("customer").select("c_custkey", F.sha2("c_name", 256).alias("content_hash"), X.worktree_id("c_name").alias("worktree_id"))


@query("symbol_id_build", "functions", "SELECT path || ':' || name || '#function' || CASE WHEN ck % 4 > 1 THEN '@' || (ck % 4) ELSE '' END AS id FROM functions")
def _(p):
    f = p._sql("functions", False)
    return f.select(X.symbol_id("path", "name", F.lit("function"), (F.col("ck") % 4).cast("int")).alias("id"))


@query("symbol_id_parse", "functions", "SELECT path || ':' || name || '#function' || CASE WHEN ck % 4 > 1 THEN '@' || (ck % 4) ELSE '' END AS id, path, name AS qualname, 'function' AS kind, CASE WHEN ck % 4 > 1 THEN (ck % 4)::INT END AS ordinal FROM functions")
def _(p):
    f = p._sql("functions", False).select(X.symbol_id("path", "name", F.lit("function"), (F.col("ck") % 4).cast("int")).alias("id"))
    return f.select("id", X.parse_symbol_id("id").alias("s")).select("id", "s.path", "s.qualname", "s.kind", "s.ordinal")
