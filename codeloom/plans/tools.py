"""The ten read-only queries of an index, as envelopes."""

from __future__ import annotations

import inspect
import os
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..model import (
    CONFIDENCES, DEFAULT_DEPTH, DEFAULT_LIMIT, DEFAULT_NODE_CAP, IMPACT, RELATION_KEY, SYMBOL_KEY, TESTING,
    EdgeNotFound, InvalidArgument, MalformedRequest, SymbolNotFound, ToolError, UnknownMethod,
)
from ..operators import architecture as arch
from ..operators import scans, traverse
from ..operators.cycles import cycles
from ..operators.history import explain
from ..operators.tables import written
from ..operators.pages import IMPORT_ORDER, MATCH_ORDER, REFERENCE_ORDER, SYMBOL_ORDER, page
from ..sources.layers import load_layers
from ..sources.repo import read_repo, to_repo_relative
from .extract import PROVIDER, VERSION
from .pattern import structural_search

TERSE = ("id", "path", "qualname", "kind", "start_line", "start_col", "end_line", "end_col")


def provenance(r) -> dict:
    return {"provider": r["provenance_provider"], "version": r["provenance_version"], "observed_at": r["observed_at"]}


def render_symbol(r, full: bool = False) -> dict:
    return {c: r[c] for c in TERSE} | ({"confidence": r["confidence"], "provenance": provenance(r)} if full else {})


def render_relation(r, full: bool = False) -> dict:
    return {c: r[c] for c in RELATION_KEY} | ({"confidence": r["confidence"], "provenance": provenance(r)} if full else {})


def need(d: Any, *keys: str) -> dict:
    if not isinstance(d, dict) or any(k not in d for k in keys):
        raise InvalidArgument(f"expected an object with {', '.join(keys)}")
    return d


class Engine:
    """Queries over one snapshot: ``symbols`` and ``relations``, their histories, and its generation.

    ``root``: the repository, for source texts and layers. Every result is a dictionary; errors are
    ``ToolError``s with a code.
    """

    TOOLS = ("find_symbol", "get_definition", "find_references", "list_imports", "structural_search", "graph", "impact_analysis", "explain", "affected_tests", "architecture")

    def __init__(self, symbols: DataFrame, relations: DataFrame, generation: int = 0, symbols_history: DataFrame | None = None, relations_history: DataFrame | None = None, root: str | None = None, observed_at: str = ""):
        self.symbols, self.relations, self.generation = symbols, relations, generation
        self.symbols_history, self.relations_history = symbols_history, relations_history
        self.root, self.observed_at = root, observed_at
        self.spark, self.store = symbols.sparkSession, None

    @classmethod
    def of(cls, store, root: str | None = None, observed_at: str = "") -> Engine:
        """The engine of a store's newest snapshot. With ``root`` and ``observed_at``, a query that names a file
        first brings that file up to date."""
        out = cls(store.read("symbols"), store.read("relations"), store.meta()["generation"], store.read("symbols_history"), store.read("relations_history"), root, observed_at)
        out.store = store
        return out

    def _freshen(self, method: str, params: dict) -> None:
        from .upkeep import freshness_target, refresh

        if self.store is None or not self.root or not self.observed_at:
            return
        target = freshness_target(method, params)
        inner = to_repo_relative(self.root, target) if target else None
        if inner and refresh(self.store, self.root, [inner], self.observed_at):
            new = Engine.of(self.store, self.root, self.observed_at)
            self.symbols, self.relations, self.generation, self.symbols_history, self.relations_history = new.symbols, new.relations, new.generation, new.symbols_history, new.relations_history

    def call(self, method: str, params: Any) -> dict:
        """The response to a request: ``{"ok": true, "result"}`` or ``{"ok": false, "error"}``."""
        try:
            if not isinstance(method, str) or not isinstance(params, dict):
                raise MalformedRequest("a request has a method and parameters")
            if method not in self.TOOLS:
                raise UnknownMethod(f"no method {method}")
            tool = getattr(self, method)
            try:
                inspect.signature(tool).bind(**params)
            except TypeError as e:
                raise InvalidArgument(str(e)) from e
            self._freshen(method, params)
            return {"ok": True, "result": tool(**params)}
        except ToolError as e:
            return {"ok": False, "error": {"code": e.code, "message": str(e), "index_generation": self.generation}}

    def _envelope(self, got: tuple, results: list) -> dict:
        _, total, truncated, cursor = got
        return {"index_generation": self.generation, "results": results, "total_count": total, "truncated": truncated, "next_cursor": cursor}

    def _root(self, root: str) -> None:
        if scans.by_id(self.symbols, root).isEmpty():
            raise SymbolNotFound(f"no symbol {root}")

    def _candidates(self, symbol_id: str | None, position: dict | None) -> DataFrame:
        if (symbol_id is None) == (position is None):
            raise InvalidArgument("give symbol_id or position")
        if symbol_id is not None:
            self._root(symbol_id)
            return scans.by_id(self.symbols, symbol_id).select("id")
        need(position, "file", "line", "column")
        point = self.spark.createDataFrame([(position["file"], position["line"], position["column"])], "path string, line int, col int")
        found = scans.resolve_positions(self.symbols, self.relations, point).select("id").distinct()
        if found.isEmpty():
            raise SymbolNotFound("no symbol at this position")
        return found

    def find_symbol(self, name: str, kind: str | None = None, path_glob: str | None = None, limit: int = DEFAULT_LIMIT, cursor: str | None = None, full: bool = False, min_confidence: str | None = None) -> dict:
        found = scans.search(self.symbols, name, kind, path_glob, min_confidence)
        got = page(found, SYMBOL_ORDER, limit, self.generation, cursor)
        return self._envelope(got, [render_symbol(r, full) for r in got[0]])

    def get_definition(self, symbol_id: str | None = None, position: dict | None = None, limit: int = DEFAULT_LIMIT, cursor: str | None = None, full: bool = False, min_confidence: str | None = None) -> dict:
        found = self.symbols.join(self._candidates(symbol_id, position), "id", "left_semi")
        got = page(scans.at_least(found, min_confidence), SYMBOL_ORDER, limit, self.generation, cursor)
        return self._envelope(got, [render_symbol(r, full) for r in got[0]])

    def find_references(self, symbol_id: str | None = None, position: dict | None = None, limit: int = DEFAULT_LIMIT, cursor: str | None = None, full: bool = False, min_confidence: str | None = None) -> dict:
        found = scans.references(self.relations, self._candidates(symbol_id, position), min_confidence)
        got = page(found, REFERENCE_ORDER, limit, self.generation, cursor)
        return self._envelope(got, [render_relation(r, full) for r in got[0]])

    def list_imports(self, file: str, limit: int = DEFAULT_LIMIT, cursor: str | None = None, full: bool = False) -> dict:
        got = page(scans.relations_in_file(self.relations, file, ["imports"]), IMPORT_ORDER, limit, self.generation, cursor)
        return self._envelope(got, [render_relation(r, full) for r in got[0]])

    def structural_search(self, pattern: str, path_glob: str | None = None, limit: int = DEFAULT_LIMIT, cursor: str | None = None, full: bool = False) -> dict:
        files = read_repo(self.spark, self.root, path_glob) if self.root else self.spark.createDataFrame([], "path string, source string")
        got = page(structural_search(files, pattern), MATCH_ORDER, limit, self.generation, cursor)
        more = {"confidence": CONFIDENCES[0], "provenance": {"provider": PROVIDER, "version": VERSION, "observed_at": self.observed_at}} if full else {}
        return self._envelope(got, [{"path": r["path"], "pattern_index": r["pattern_index"], "captures": {k: [c.asDict() for c in v] for k, v in r["captures"].items()}, **more} for r in got[0]])

    def _nodes(self, nodes: DataFrame, full: bool, *extra: str) -> list[dict]:
        rows = traverse.resolved(nodes, self.symbols).orderBy("level", "via_order").collect()
        return [(render_symbol(r, full) if r["resolved"] else {"id": r["id"]}) | {"resolved": r["resolved"]} | {c: r[c] for c in extra} for r in rows]

    def graph(self, root: str, graph_type: str, direction: str, node_cap: int = DEFAULT_NODE_CAP, depth_clamp: int = DEFAULT_DEPTH, full: bool = False) -> dict:
        if graph_type not in traverse.GRAPHS or direction not in ("upstream", "downstream"):
            raise InvalidArgument("graph_type is call or dependency, direction upstream or downstream")
        traverse.check_bounds(node_cap, depth_clamp)
        self._root(root)
        got = traverse.graph(self.relations, root, graph_type, direction, node_cap, depth_clamp)
        edges = self.relations.join(got.edges.select("current", "current_level", *RELATION_KEY), RELATION_KEY).orderBy("current_level", "current", *traverse.EDGE_ORDER).collect()
        return {"index_generation": self.generation, "nodes": self._nodes(got.nodes, full), "edges": [render_relation(r, full) for r in edges], "node_cap": node_cap, "depth_clamp": depth_clamp, "truncated": got.truncated}

    def _upstream(self, root: str, predicates: tuple[str, ...], node_cap: int, depth_clamp: int) -> traverse.Reach:
        traverse.check_bounds(node_cap, depth_clamp)
        self._root(root)
        return traverse.bfs(self.relations, root, predicates, True, node_cap, depth_clamp)

    def _summary(self, nodes: DataFrame) -> dict:
        return traverse.tier_counts(nodes).collect()[0].asDict()

    def impact_analysis(self, root: str, node_cap: int = DEFAULT_NODE_CAP, depth_clamp: int = DEFAULT_DEPTH, full: bool = False) -> dict:
        got = self._upstream(root, IMPACT, node_cap, depth_clamp)
        found = got.nodes.where("level > 0")
        return {"index_generation": self.generation, "root": root, "affected_symbols": self._nodes(found, full, "discovery_predicate"), "impact_summary": self._summary(found), "node_cap": node_cap, "depth_clamp": depth_clamp, "truncated": got.truncated}

    def affected_tests(self, root: str, node_cap: int = DEFAULT_NODE_CAP, depth_clamp: int = DEFAULT_DEPTH, full: bool = False) -> dict:
        got = self._upstream(root, TESTING, node_cap, depth_clamp)
        found = got.nodes.where("level > 0").join(traverse.test_nodes(got.nodes, self.symbols).select("id"), "id", "left_semi")
        return {"index_generation": self.generation, "root": root, "affected_tests": self._nodes(found, full, "discovery_predicate"), "test_summary": self._summary(found), "node_cap": node_cap, "depth_clamp": depth_clamp, "truncated": got.truncated}

    def explain(self, symbol_id: str | None = None, edge_ref: dict | None = None, limit: int = DEFAULT_LIMIT, cursor: str | None = None, full: bool = False) -> dict:
        if (symbol_id is None) == (edge_ref is None):
            raise InvalidArgument("give symbol_id or edge_ref")
        if symbol_id is not None:
            key, live, history, render = {"id": symbol_id}, self.symbols, self.symbols_history, render_symbol
            order = ["observed_at", "id", "path", "qualname", "kind", "start_line", "start_col", "end_line", "end_col", "confidence", "provenance_provider", "provenance_version"]
        else:
            key, live, history, render = {c: need(edge_ref, *RELATION_KEY)[c] for c in RELATION_KEY}, self.relations, self.relations_history, render_relation
            order = ["observed_at", *RELATION_KEY, "confidence", "provenance_provider", "provenance_version"]
        found = explain(scans.relation(live, key), scans.relation(history, key), SYMBOL_KEY if symbol_id is not None else RELATION_KEY)
        got = page(found, order, limit, self.generation, cursor, pinned=False, reverse=True)
        if not got[1]:
            raise (SymbolNotFound if symbol_id is not None else EdgeNotFound)("never observed")
        return self._envelope(got, [render(r, True) | ({"deleted": True} if r["deleted"] else {}) for r in got[0]])

    def architecture(self, root: str | None = None, granularity: str = "file", node_cap: int = DEFAULT_NODE_CAP, full: bool = False) -> dict:
        if granularity not in ("file", "package"):
            raise InvalidArgument("granularity must be file or package")
        traverse.check_bounds(node_cap, 1)
        if root is not None and os.path.isabs(root):
            inner = to_repo_relative(self.root, root) if self.root else None
            if inner is None:
                raise InvalidArgument("an absolute root must lie in the repository")
            root = None if inner == "." else inner
        layers = load_layers(self.root) if self.root else None
        modules = self.symbols.where("kind = 'module'")
        imports = self.relations.where("predicate = 'imports'")
        found = written(arch.resolve_imports(imports.where(X.in_scope("site_file", root)), modules))
        edges = written(arch.file_edges(found, root))
        counts = arch.external_counts(found, modules, root)
        inside = modules.where(X.in_scope("path", root))
        if granularity == "file":
            shown = inside.orderBy("id").limit(node_cap)
            rows = shown.join(counts, "path", "left").orderBy("id").collect()
            nodes = [render_symbol(r, full) | {"external_dependency_count": r["external_dependency_count"]} for r in rows]
            pairs = edges
        else:
            rows = arch.package_counts(counts).orderBy("path").limit(node_cap).collect()
            nodes = [{"path": r["path"], "kind": "package", "external_dependency_count": r["external_dependency_count"]} for r in rows]
            pairs = arch.package_edges(edges)
        kept = self.spark.createDataFrame([(n["path"],) for n in nodes], "path string")
        total = inside.count() if granularity == "file" else inside.select(X.package_dir("path")).distinct().count()
        pairs = pairs.join(kept.withColumnRenamed("path", "source"), "source", "left_semi").join(kept.withColumnRenamed("path", "target"), "target", "left_semi")
        rings: dict[str, list[str]] = {}
        for r in cycles(edges).orderBy("component", "member").collect():
            rings.setdefault(r["component"], []).append(r["member"])
        broken = arch.violations(edges, layers).orderBy("source", "target", "from_layer", "to_layer").collect() if layers else []
        return {
            "index_generation": self.generation, "root": root, "granularity": granularity, "nodes": nodes,
            "edges": [{"source": r["source"], "target": r["target"]} for r in pairs.select("source", "target").orderBy("source", "target").collect()],
            "node_cap": node_cap, "truncated": total > len(nodes), "layering_enabled": layers is not None,
            "layer_violations": [r.asDict() for r in broken], "cycles": list(rings.values()),
        }
