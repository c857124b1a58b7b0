"""Schemas, vocabularies and errors of the code index."""

from __future__ import annotations

# The vocabularies of the data model.
KINDS = ("module", "class", "function", "method", "variable")
SEARCHABLE_KINDS = ("module", "class", "function", "method")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")  # by rank
PREDICATES = ("imports", "calls", "references", "defines", "inherits", "overrides")
USAGE = ("calls", "references", "inherits", "defines", "overrides")
RESOLVING = ("calls", "references", "inherits")
IMPACT = ("calls", "imports", "overrides")
TESTING = ("calls", "overrides")
GRAPHS = {"call": "calls", "dependency": "imports"}

DEFAULT_LIMIT, DEFAULT_NODE_CAP, DEFAULT_DEPTH = 50, 100, 5
RESOLUTION_VERSION = 3
STUB_PROVIDER, STUB_VERSION = "codeloom", "1"

PROVENANCE = "provenance_provider string, provenance_version string, observed_at string"
SYMBOLS = f"id string, path string, qualname string, kind string, start_line int, start_col int, end_line int, end_col int, is_stub boolean, confidence string, {PROVENANCE}"
RELATIONS = f"source string, target string, predicate string, site_file string, site_line int, site_col int, confidence string, {PROVENANCE}"
SYMBOLS_HISTORY = f"history_id bigint, {SYMBOLS}, tombstone boolean"
RELATIONS_HISTORY = f"history_id bigint, {RELATIONS}, tombstone boolean"
INDEX_META = "generation bigint, head_sha string, cross_file_pass_version int, last_enrichment_fingerprint string"
FILE_STATE = "path string, mtime_ns bigint, content_hash string"
DEFERRED = (
    "deferred_kind string, source string, module_path string, name string, attribute string, base_name string, method_name string, "
    "site_file string, site_line int, site_col int, enclosing_class string, " + PROVENANCE
)

SYMBOL_KEY = ["id"]
SYMBOL_CONTENT = ["path", "qualname", "kind", "start_line", "start_col", "end_line", "end_col", "is_stub", "confidence", "provenance_provider", "provenance_version"]
RELATION_KEY = ["source", "target", "predicate", "site_file", "site_line", "site_col"]
RELATION_CONTENT = ["confidence", "provenance_provider", "provenance_version"]


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class ToolError(Exception):
    """An error of a query; ``code`` is what a caller sees."""

    code = "INTERNAL_ERROR"


class StaleIndexGeneration(ToolError):
    code = "STALE_INDEX_GENERATION"


class SymbolNotFound(ToolError):
    code = "SYMBOL_NOT_FOUND"


class InvalidPattern(ToolError):
    code = "INVALID_PATTERN"


class EdgeNotFound(ToolError):
    code = "EDGE_NOT_FOUND"


class InvalidCursor(ToolError):
    code = "INVALID_CURSOR"


class InvalidLimit(ToolError):
    code = "INVALID_LIMIT"


class InvalidArgument(ToolError):
    code = "INVALID_ARGUMENT"


class InvalidConfig(ToolError):
    code = "INVALID_CONFIG"


class IndexNotReady(ToolError):
    code = "INDEX_NOT_READY"


class UnknownMethod(ToolError):
    code = "UNKNOWN_METHOD"


class MalformedRequest(ToolError):
    code = "MALFORMED_REQUEST"
