"""Lookups in the symbol and relation tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..model import CONFIDENCES, SEARCHABLE_KINDS, InvalidArgument

BIN, LEVELS = 32, 10  # lines of the smallest bins; 32 * 8 ** 9 lines are more than an int counts

def at_least(df: DataFrame, min_confidence: str | None) -> DataFrame:
    """Rows whose confidence is as good as ``min_confidence`` or better."""
    if min_confidence is None:
        return df
    if min_confidence not in CONFIDENCES:
        raise InvalidArgument(f"min_confidence must be one of {', '.join(CONFIDENCES)}")
    return df.where(F.col("confidence").isin(*CONFIDENCES[: CONFIDENCES.index(min_confidence) + 1]))


def search(symbols: DataFrame, name: str, kind: str | None = None, path_glob: str | None = None, min_confidence: str | None = None) -> DataFrame:
    """Symbols whose qualified name holds ``name`` as it stands; "" is in every name."""
    if kind is not None and kind not in SEARCHABLE_KINDS:
        raise InvalidArgument(f"kind must be one of {', '.join(SEARCHABLE_KINDS)}")
    out = symbols.where(F.contains("qualname", F.lit(name))) if name else symbols
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if path_glob is not None:
        out = out.where(F.col("path").rlike(X.glob_regex(path_glob)))
    return at_least(out, min_confidence)


def by_path(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("path") == path)


def by_id(symbols: DataFrame, id_: str) -> DataFrame:
    return symbols.where(F.col("id") == id_)


def by_name_and_kind(symbols: DataFrame, qualname: str, kind: str) -> DataFrame:
    return symbols.where((F.col("qualname") == qualname) & (F.col("kind") == kind))


def symbols_at_start(symbols: DataFrame, points: DataFrame) -> DataFrame:
    """The symbol that starts at each point (path, line, col): a module before others, then by id."""
    hit = points.join(symbols, (points["path"] == symbols["path"]) & (points["line"] == symbols["start_line"]) & (points["col"] == symbols["start_col"]))
    first = F.min_by(F.col("id"), F.struct(F.col("kind") != "module", F.col("id")))
    return hit.groupBy(points["path"], points["line"], points["col"]).agg(first.alias("id"))


def symbols_at_position(symbols: DataFrame, points: DataFrame) -> DataFrame:
    """The symbol with the smallest span around each point (path, line, col); ties by id.

    Spans are put into bins of lines, of a size of BIN * 8 ** level that is at least their length, so each is in
    two bins at most; a point looks into its bin of every level that occurs. So a point meets the
    spans near it and not all of its file. The best is a partial minimum.

    Both sides are shuffled: a stored table's size is that of its compressed columns and leaves the explosion
    out, so by estimate Spark would broadcast millions of spans through the driver.
    """
    lines = F.col("end_line") - F.col("start_line") + 1
    spans = symbols.select("path", "id", "start_line", "start_col", "end_line", "end_col", F.greatest(F.lit(0), F.ceil(F.log(lines / BIN) / F.log(F.lit(8.0)) - 1e-9)).cast("int").alias("_level"))
    size = F.lit(BIN).cast("long") * F.pow(F.lit(8.0), F.col("_level")).cast("long")
    of = lambda c: F.floor(F.col(c) / size)
    binned = spans.withColumn("_bin", F.explode(F.sequence(of("start_line"), of("end_line"))))
    asked = points.select("path", "line", "col", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("_level")).withColumn("_bin", of("line"))
    at = F.struct("line", "col")
    inside = (F.struct(F.col("start_line").alias("line"), F.col("start_col").alias("col")) <= at) & (at <= F.struct(F.col("end_line").alias("line"), F.col("end_col").alias("col")))
    hit = asked.join(binned.hint("merge"), ["path", "_level", "_bin"]).where(inside)
    span = F.struct((F.col("end_line") - F.col("start_line")).alias("lines"), (F.col("end_col") - F.col("start_col")).alias("cols"), F.col("id"))
    return hit.groupBy("path", "line", "col").agg(F.min(span).alias("best")).select("path", "line", "col", F.col("best.id").alias("id"))


def _of(predicates: Iterable[str] | None) -> Column:
    """An empty set of predicates matches nothing."""
    if predicates is None:
        return F.lit(True)
    chosen = sorted(predicates)
    return F.col("predicate").isin(*chosen) if chosen else F.lit(False)


def relations_in_file(relations: DataFrame, file: str, predicates: Iterable[str] | None = None) -> DataFrame:
    return relations.where((F.col("site_file") == file) & _of(predicates))


def relations_at_site(relations: DataFrame, file: str, line: int, column: int, predicates: Iterable[str] | None = None) -> DataFrame:
    return relations.where((F.col("site_file") == file) & (F.col("site_line") == line) & (F.col("site_col") == column) & _of(predicates))


def in_edges(relations: DataFrame, ids: DataFrame, predicates: Iterable[str] | None = None) -> DataFrame:
    """Relations whose target is among ``ids`` (one column ``id``)."""
    return relations.where(_of(predicates)).join(ids.select(F.col("id").alias("target")), "target").select(*relations.columns)


def out_edges(relations: DataFrame, ids: DataFrame, predicates: Iterable[str] | None = None) -> DataFrame:
    return relations.where(_of(predicates)).join(ids.select(F.col("id").alias("source")), "source").select(*relations.columns)


def relation(relations: DataFrame, key: dict) -> DataFrame:
    out = relations
    for name, value in key.items():
        out = out.where(F.col(name) == value)
    return out


def history_of(history: DataFrame, key: dict) -> DataFrame:
    """Observations, oldest first, without tombstones."""
    return relation(history, key).where(~F.col("tombstone")).orderBy("history_id")


def tombstoned(history: DataFrame, key: list[str]) -> DataFrame:
    """Whether the newest history row of each key is a tombstone."""
    return history.groupBy(*key).agg(F.max_by("tombstone", "history_id").alias("is_tombstoned"))


def latest_content(history: DataFrame, key: list[str]) -> DataFrame:
    """The live rows as history tells them: the newest row of each key, unless it is a tombstone."""
    w = Window.partitionBy(*key).orderBy(F.desc("history_id"))
    return history.withColumn("_r", F.row_number().over(w)).where("_r = 1 AND NOT tombstone").drop("_r")


def resolve_positions(symbols: DataFrame, relations: DataFrame, points: DataFrame) -> DataFrame:
    """Candidates (path, line, col, id) of each point: the live targets of the calls, references and
    inheritances at exactly that site, all of them; where there is none, the symbol that starts there.
    """
    from ..model import RESOLVING

    at = relations.where(F.col("predicate").isin(*RESOLVING)).select(F.col("site_file").alias("path"), F.col("site_line").alias("line"), F.col("site_col").alias("col"), F.col("target").alias("id"))
    live = at.join(points, ["path", "line", "col"], "left_semi").join(symbols.select("id"), "id", "left_semi").distinct().select("path", "line", "col", "id")
    rest = points.join(live, ["path", "line", "col"], "left_anti")
    return live.unionByName(symbols_at_start(symbols, rest).select("path", "line", "col", "id"))


def references(relations: DataFrame, ids: DataFrame, min_confidence: str | None = None) -> DataFrame:
    from ..model import USAGE

    return at_least(in_edges(relations, ids, USAGE), min_confidence)
