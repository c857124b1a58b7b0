"""Cross-file names: deferred facts joined with the symbols of the whole index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import RELATIONS, names
from .architecture import dotted_index
from .tables import written

SITE = ["source", "site_file", "site_line", "site_col"]
ITEM = ["deferred_kind", *SITE, "module_path", "name", "attribute", "base_name", "method_name", "enclosing_class"]


def _matches(deferred: DataFrame, symbols: DataFrame, module: str, name: str, kind: str) -> DataFrame:
    """Deferred rows with the symbols named ``name`` of ``kind`` in the modules that end in ``module``.

    The suffix index is of paths, not of symbols, and is joined first.
    """
    paths = dotted_index(symbols.select("path")).select(F.col("suffix").alias("_module"), F.col("path").alias("_path"))
    found = symbols.where(F.col("kind") == kind).select(F.col("path").alias("_path"), F.col("qualname").alias("_name"), F.col("id").alias("candidate"), F.col("qualname").alias("candidate_name"))
    asked = deferred.withColumn("_module", F.expr(module)).withColumn("_name", F.expr(name))
    return asked.join(paths, "_module").join(found, ["_path", "_name"]).withColumnRenamed("_path", "candidate_path").drop("_module", "_name")


def candidates(deferred: DataFrame, symbols: DataFrame) -> DataFrame:
    """Deferred rows with ``candidate``, one row for each symbol that a row may mean.

    Calls mean functions, inheritances classes, attribute calls functions of the submodule, and
    overrides and self-calls the method of an imported base in the base's own file.
    """
    columns = deferred.columns
    calls = _matches(deferred.where("deferred_kind = 'call'"), symbols, "module_path", "name", "function")
    inherits = _matches(deferred.where("deferred_kind = 'inherit'"), symbols, "module_path", "name", "class")
    attributes = _matches(deferred.where("deferred_kind = 'attribute_call'"), symbols, "CASE WHEN module_path = '' THEN name ELSE concat(module_path, '.', name) END", "attribute", "function")
    bases = _matches(deferred.where("deferred_kind IN ('override', 'self_call') AND base_name IS NOT NULL"), symbols, "module_path", "base_name", "class")
    methods = symbols.where("kind = 'method'").select(F.col("path").alias("candidate_path"), F.col("qualname").alias("_method"), F.col("id").alias("_id"))
    through = bases.withColumn("_method", F.concat("candidate_name", F.lit("."), "method_name")).drop("candidate").join(methods, ["candidate_path", "_method"]).withColumnRenamed("_id", "candidate")
    picked = [df.select(*columns, "candidate") for df in (calls, inherits, attributes, through)]
    out = picked[0]
    for df in picked[1:]:
        out = out.unionByName(df)
    return out.distinct()


def resolve(deferred: DataFrame, symbols: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Relations for deferred rows: EXTRACTED for the only candidate of a row, AMBIGUOUS for several."""
    asked = deferred if kinds is None else deferred.where(F.col("deferred_kind").isin(*kinds))
    found = candidates(asked, symbols)
    many = F.count(F.lit(1)).over(Window.partitionBy(*ITEM))
    predicate = F.when(F.col("deferred_kind") == "inherit", "inherits").when(F.col("deferred_kind") == "override", "overrides").otherwise("calls")
    rows = found.withColumn("confidence", F.when(many == 1, "EXTRACTED").otherwise("AMBIGUOUS")).withColumn("predicate", predicate).withColumn("target", F.col("candidate"))
    return rows.select(*names(RELATIONS))


def unresolved(deferred: DataFrame, symbols: DataFrame) -> DataFrame:
    """Deferred calls, attribute calls, inheritances and self-calls without any candidate."""
    asked = deferred.where("deferred_kind <> 'override'")
    known = written(asked.withColumn("_row", F.monotonically_increasing_id()))  # so a row is told by one number
    met = candidates(known, symbols).select("_row").distinct()
    return known.join(met, "_row", "left_anti").select(*deferred.columns)
