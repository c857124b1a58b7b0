"""Ignore rules: the rule files of a tree, root to leaf; the last rule that matches wins."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import col


@dataclass(frozen=True)
class Rule:
    """``regex`` is tried on paths below ``folder`` ("" for the root); ``ignore`` is False for ``!`` rules."""

    folder: str
    regex: str
    ignore: bool


def _glob(body: str) -> str:
    out, i = [], 0
    while i < len(body):
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out.append("(?:.+/)?")
            i += 3
        elif body[i:] == "**" and i and body[i - 1] == "/":
            out.append(".+")
            i += 2
        elif body[i] == "*":
            stars = 1 + (body[i : i + 2] == "**")
            alone = (i == 0 or body[i - 1] == "/") and body[i + stars : i + stars + 1] in ("", "/")  # a whole name, which is not empty
            out.append("[^/]+" if alone else "[^/]*")
            i += stars
        elif body[i] == "?":
            out.append("[^/]")
            i += 1
        elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out.append(re.escape(body[i + 1]))
            i += 2
        else:
            out.append(re.escape(body[i]))
            i += 1
    return "".join(out)


def rule(folder: str, line: str) -> Rule | None:
    """The rule of one line; None for blank lines and comments."""
    if not line.strip() or line.strip().startswith("#"):
        return None
    text = re.sub(r"(?<!\\)\s+$", "", line)
    ignore = not text.startswith("!")
    text = text if ignore else text[1:]
    if text.startswith(("\\#", "\\!")):
        text = text[1:]
    only_folders, body = text.endswith("/"), text.rstrip("/")
    anchored = "/" in body
    body = body.removeprefix("/")
    if not body:
        return None
    return Rule(folder, ("^" if anchored else "^(?:.+/)?") + _glob(body) + ("/.*$" if only_folders else "(?:/.*)?$"), ignore)


def rules(files: list[tuple[str, str]]) -> list[Rule]:
    """Rules of (folder, text) pairs; shallower folders come first, so deeper ones override them."""
    ordered = sorted(files, key=lambda f: (f[0].count("/") + bool(f[0]), f[0]))
    return [r for folder, text in ordered for line in text.splitlines() if (r := rule(folder, line))]


def is_ignored(path: str, chosen: list[Rule]) -> bool:
    if path == ".git" or path.startswith(".git/"):
        return True
    out = False
    for r in chosen:
        inner = path if not r.folder else path[len(r.folder) + 1 :] if path.startswith(r.folder + "/") else ""
        if inner and re.match(r.regex, inner):
            out = r.ignore
    return out


def ignored(path: Column | str, chosen: list[Rule]) -> Column:
    """The same as one expression: the rules from the last to the first."""
    p = col(path)
    out = None
    for r in reversed(chosen):
        inner = p if not r.folder else F.substring(p, len(r.folder) + 2, F.length(p))
        hit = inner.rlike(r.regex) if not r.folder else F.startswith(p, F.lit(r.folder + "/")) & (inner != "") & inner.rlike(r.regex)
        out = F.when(hit, r.ignore) if out is None else out.when(hit, r.ignore)
    always = (p == ".git") | F.startswith(p, F.lit(".git/"))
    return always if out is None else always | out.otherwise(False)
