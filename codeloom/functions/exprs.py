"""Scalar functions of the data model as column expressions; all stay in generated code."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CONFIDENCES

ID = r"(?s)^([^:]*):([^#]*)#([^@]*)(?:@(\d+))?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def symbol_id(path, qualname, kind, ordinal=None) -> Column:
    """``path:qualname#kind``, with ``@n`` from the second definition on."""
    tail = F.lit("") if ordinal is None else F.when(col(ordinal) > 1, F.concat(F.lit("@"), col(ordinal).cast("string"))).otherwise("")
    return F.concat(col(path), F.lit(":"), col(qualname), F.lit("#"), col(kind), tail)


def parse_symbol_id(value) -> Column:
    """A struct (path, qualname, kind, ordinal): cut at the first ``:``, ``#`` and ``@``. Null if malformed."""
    v = col(value)
    part = lambda k: F.regexp_extract(v, ID, k)
    number = F.when(part(4) != "", part(4).cast("int"))
    return F.when(v.rlike(ID), F.struct(part(1).alias("path"), part(2).alias("qualname"), part(3).alias("kind"), number.alias("ordinal")))


def path_to_dotted(path) -> Column:
    return F.replace(F.regexp_replace(col(path), r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))


def dotted_suffixes(dotted) -> Column:
    """Every suffix of a dotted name, the whole first."""
    parts = F.split(col(dotted), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def strip_last(dotted) -> Column:
    return F.regexp_replace(col(dotted), r"\.[^.]*$", "")


def package_dir(path) -> Column:
    return F.when(F.contains(col(path), F.lit("/")), F.regexp_replace(col(path), r"/[^/]*$", "")).otherwise("")


def owner(qualname) -> Column:
    return F.regexp_extract(col(qualname), r"^(.*)\.[^.]*$", 1)


def leaf(qualname) -> Column:
    return F.element_at(F.split(col(qualname), r"\."), -1)


def confidence_rank(confidence) -> Column:
    out = F.when(col(confidence) == CONFIDENCES[0], 0)
    for k, name in enumerate(CONFIDENCES[1:], 1):
        out = out.when(col(confidence) == name, k)
    return out


def is_test_file(path) -> Column:
    return F.element_at(F.split(col(path), "/"), -1).rlike(r"^(test_.*|.*_test)\.py$")


def is_test_name(qualname) -> Column:
    return F.startswith(leaf(qualname), F.lit("test_"))


def in_scope(path, root: str | None) -> Column:
    """The path-prefix scope: ``root`` itself or what is below; None is all. ``""`` matches nothing."""
    if root is None:
        return F.lit(True)
    r = root.rstrip("/")
    return (col(path) == r) | F.startswith(col(path), F.lit(r + "/"))


def relative_import_base(path, level) -> Column:
    """The package that ``level`` leading dots mean in a file; null where they climb too far."""
    p, n = col(path), col(level)
    is_init = p.rlike(r"(^|/)__init__\.py$")
    dotted = path_to_dotted(p)
    parts = F.split(dotted, r"\.")
    own = F.when(is_init, F.when(dotted == "__init__", F.array().cast("array<string>")).otherwise(parts)).otherwise(F.slice(parts, 1, F.size(parts) - 1))
    climbable = F.when(is_init, F.size(own)).otherwise(F.size(own) - 1)
    return F.when(n - 1 <= climbable, F.array_join(F.slice(own, 1, F.greatest(F.size(own) - (n - 1), F.lit(0))), "."))


def glob_regex(pattern: str) -> str:
    """The store's glob dialect: ``*`` and ``?`` cross ``/``; classes negate by ``^``."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "^" else 2)) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("&", "\\&")
            out.append(f"[{body}]")
            i = end
        else:
            out.append(re.escape(c) if c != "[" else "\\[")
        i += 1
    return "(?s)^" + "".join(out) + "$"


def fnmatch_regex(pattern: str) -> str:
    """The shell dialect of layers and searches: ``*`` crosses ``/``; classes negate by ``!``."""
    return "(?s)^" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z") + "$"


def worktree_id(text) -> Column:
    return F.substring(F.sha2(col(text), 256), 1, 16)
