"""Import resolution, dependency rollup and layers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def dotted_index(paths: DataFrame) -> DataFrame:
    """``suffix, path``: every dotted suffix of every module path."""
    return paths.select("path").distinct().select(F.explode(X.dotted_suffixes(X.path_to_dotted("path"))).alias("suffix"), "path")


def resolve_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """``imports`` with ``target_path``: one row for each module that an import may mean, null for none.

    A target means the modules that end in it; only if there are none, those that end in it without
    its last segment.
    """
    index = dotted_index(paths)
    direct = imports.join(index.withColumnRenamed("suffix", "target"), "target").select(*imports.columns, F.col("path").alias("target_path"))
    missed = imports.join(index.select(F.col("suffix").alias("target")), "target", "left_anti").select(*imports.columns)
    shorter = missed.withColumn("_short", F.when(F.contains("target", F.lit(".")), X.strip_last("target")))
    second = shorter.join(index.select(F.col("suffix").alias("_short"), F.col("path").alias("target_path")), "_short", "left").select(*imports.columns, "target_path")
    return direct.unionByName(second)


def file_edges(resolved: DataFrame, scope: str | None = None) -> DataFrame:
    """Distinct (source, target) files, self-loops included, both in scope."""
    edges = resolved.where("target_path IS NOT NULL").select(F.col("site_file").alias("source"), F.col("target_path").alias("target"))
    return edges.where(X.in_scope("source", scope) & X.in_scope("target", scope)).distinct()


def external_counts(resolved: DataFrame, modules: DataFrame, scope: str | None = None) -> DataFrame:
    """``path, external_dependency_count``: import rows that mean no module; 0 for files without."""
    outside = resolved.where("target_path IS NULL").groupBy(F.col("site_file").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    own = modules.where(X.in_scope("path", scope)).select("path").distinct()
    return own.join(outside, "path", "left").select("path", F.coalesce("n", F.lit(0)).cast("long").alias("external_dependency_count"))


def package_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy(X.package_dir("path").alias("path")).agg(F.sum("external_dependency_count").alias("external_dependency_count"))


def package_edges(edges: DataFrame) -> DataFrame:
    """Distinct pairs of different directories."""
    return edges.select(X.package_dir("source").alias("source"), X.package_dir("target").alias("target")).where("source <> target").distinct()


@dataclass(frozen=True)
class Layers:
    """Layer globs, and the layers that each layer may depend on."""

    layers: dict[str, list[str]]
    allowed: dict[str, list[str]] = field(default_factory=dict)


def classify(paths: DataFrame, layers: Layers) -> DataFrame:
    """``path, layer``: every layer with a glob that the path matches. The layers are a constant of the plan."""
    each = [F.when(_any(globs), F.lit(name)) for name, globs in sorted(layers.layers.items())]
    if not each:
        return paths.select("path", F.lit("").alias("layer")).limit(0)
    return paths.select("path").distinct().select("path", F.explode(F.array_compact(F.array(*each))).alias("layer"))


def _any(globs: list[str]):
    out = F.lit(False)
    for g in globs:
        out = out | F.col("path").rlike(X.fnmatch_regex(g))
    return out


def violations(edges: DataFrame, layers: Layers) -> DataFrame:
    """``source, target, from_layer, to_layer``: every pair of layers of an edge that is not allowed.

    Files are classified once each; a file in no layer is in no violation; a layer may use itself.
    """
    files = edges.select(F.col("source").alias("path")).union(edges.select("target"))
    of = classify(files, layers)
    both = edges.join(of.select(F.col("path").alias("source"), F.col("layer").alias("from_layer")), "source").join(of.select(F.col("path").alias("target"), F.col("layer").alias("to_layer")), "target")
    allowed = F.lit(False)
    for name, targets in sorted(layers.allowed.items()):
        if targets:
            allowed = allowed | ((F.col("from_layer") == name) & F.col("to_layer").isin(*targets))
    return both.where((F.col("from_layer") != F.col("to_layer")) & ~allowed).select("source", "target", "from_layer", "to_layer")
