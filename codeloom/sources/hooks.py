"""Paths named by the payloads of editor and agent hooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col


def diff_paths(diff: Column | str) -> Column:
    """The files of a unified diff's headers, each once, in order."""
    lines = F.split(col(diff), "\n")
    heads = F.filter(lines, lambda x: x.rlike(r"^(\+\+\+ b/|--- a/)"))
    return F.array_distinct(F.filter(F.transform(heads, lambda x: F.substring(x, 7, F.length(x))), lambda p: ~p.isin("", "/dev/null")))


def payload_paths(agent: Column | str, payload: Column | str) -> Column:
    """The paths of one payload by its agent's format; none for unknown agents and broken payloads."""
    a, p = col(agent), col(payload)
    file = F.get_json_object(p, "$.tool_input.file_path")
    command = F.coalesce(F.get_json_object(p, "$.tool_input.command"), F.get_json_object(p, "$.diff"))
    none = F.array().cast("array<string>")
    one = F.when(file.isNotNull(), F.array(file)).otherwise(none)
    return F.when(a.isin("claude-code", "omp"), one).when(a == "codex", F.coalesce(diff_paths(command), none)).otherwise(none)


def touched(payloads: DataFrame) -> DataFrame:
    """``path``: the distinct Python files below the root that payloads (agent, payload) name."""
    each = payloads.select(F.explode(payload_paths("agent", "payload")).alias("path"))
    inside = ~F.startswith("path", F.lit("/")) & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    return each.where(F.endswith("path", F.lit(".py")) & inside).distinct()
