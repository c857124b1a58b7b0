"""Bounded breadth-first traversal, level by level, as joins."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..model import CONFIDENCES, DEFAULT_DEPTH, DEFAULT_NODE_CAP, GRAPHS, InvalidArgument
from .tables import written

EDGE_ORDER = ["site_file", "site_line", "site_col", "source", "target", "predicate"]
FEW = 10_000  # a node cap up to which levels are held by the driver and broadcast
NODE = "id string, level int, via_order struct<current:string,site_file:string,site_line:int,site_col:int,source:string,target:string,predicate:string>, discovery_predicate string, discovery_confidence string"


@dataclass
class Reach:
    """``nodes``: id, level, discovery_predicate, discovery_confidence; ``edges``: relations that the
    traversal followed between kept nodes, with the level and id of the node they were met at."""

    nodes: DataFrame
    edges: DataFrame
    truncated: bool


def check_bounds(node_cap: int, depth_clamp: int) -> None:
    for name, v in (("node_cap", node_cap), ("depth_clamp", depth_clamp)):
        if not isinstance(v, int) or isinstance(v, bool) or v <= 0:
            raise InvalidArgument(f"{name} must be positive")


def bfs(relations: DataFrame, root: str, predicates: Iterable[str], upstream: bool, node_cap: int | None = DEFAULT_NODE_CAP, depth_clamp: int = DEFAULT_DEPTH, any_edge_truncates: bool = False) -> Reach:
    """Nodes reached from ``root`` within ``depth_clamp`` levels, ``node_cap`` at most (None: all), root included.

    A level is one join of the frontier with the edges and one partial minimum for each neighbour (the
    first edge that meets it: by current node, then EDGE_ORDER), so a node of many edges is no
    group to be gathered. When the cap is reached, the first by that order stay. ``truncated`` tells
    of dropped nodes, or of a frontier at the depth clamp that leads on: to any edge at all with
    ``any_edge_truncates``, else to an unknown node.
    """
    check_bounds(1 if node_cap is None else node_cap, depth_clamp)
    spark = relations.sparkSession

    def settled(df: DataFrame) -> tuple[DataFrame, int]:
        """A level and its size: rows of the driver under a small cap, else a written table."""
        if node_cap is None or node_cap > FEW:
            table = written(df)
            return table, table.count()
        rows = df.collect()
        return F.broadcast(spark.createDataFrame(rows, df.schema)), len(rows)

    here, there = ("target", "source") if upstream else ("source", "target")
    edges = relations.where(F.col("predicate").isin(*sorted(predicates))).select(*EDGE_ORDER, "confidence", F.col(here).alias("current"), F.col(there).alias("neighbor"))
    visited, _ = settled(spark.createDataFrame([(root, 0, None, None, None)], NODE))
    size, level, truncated, frontier = 1, 0, False, visited
    while level < depth_clamp:
        met = edges.join(frontier.select(F.col("id").alias("current")), "current")
        via = F.struct("current", *EDGE_ORDER)
        first = met.groupBy("neighbor").agg(F.min(via).alias("via_order"), F.min_by("confidence", via).alias("discovery_confidence"))
        new = first.join(visited.select(F.col("id").alias("neighbor")), "neighbor", "left_anti")
        new = new.select(F.col("neighbor").alias("id"), F.lit(level + 1).alias("level"), "via_order", F.col("via_order.predicate").alias("discovery_predicate"), "discovery_confidence")
        best, n = settled(new if node_cap is None else new.orderBy("via_order").limit(node_cap - size + 1))
        if node_cap is not None and n > node_cap - size:
            truncated = True
            best, n = settled(best.orderBy("via_order").limit(node_cap - size))
        level += 1
        if not n:
            frontier = best.limit(0)
            break
        frontier = best
        visited = visited.unionByName(best)
        size += n
    if not truncated and not frontier.isEmpty():
        ahead = edges.join(frontier.select(F.col("id").alias("current")), "current")
        if not any_edge_truncates:
            ahead = ahead.join(visited.select(F.col("id").alias("neighbor")), "neighbor", "left_anti")
        truncated = not ahead.isEmpty()
    expanded = visited.where(F.col("level") < depth_clamp).select(F.col("id").alias("current"), F.col("level").alias("current_level"))
    kept = edges.join(expanded, "current").join(visited.select(F.col("id").alias("neighbor")), "neighbor", "left_semi")
    return Reach(visited, kept, truncated)


def graph(relations: DataFrame, root: str, graph_type: str, direction: str, node_cap: int | None = DEFAULT_NODE_CAP, depth_clamp: int = DEFAULT_DEPTH) -> Reach:
    if graph_type not in GRAPHS:
        raise InvalidArgument(f"graph_type must be one of {', '.join(GRAPHS)}")
    if direction not in ("upstream", "downstream"):
        raise InvalidArgument("direction must be upstream or downstream")
    return bfs(relations, root, [GRAPHS[graph_type]], direction == "upstream", node_cap, depth_clamp, any_edge_truncates=True)


def resolved(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Nodes with their live symbol's columns; ``resolved`` is false, and those null, for the others."""
    told = symbols.withColumn("resolved", F.lit(True))
    return nodes.join(told, "id", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def tier_counts(nodes: DataFrame, confidence: str = "discovery_confidence") -> DataFrame:
    """One row: nodes by the confidence of the edge that met them, all tiers, and their number."""
    each = [F.coalesce(F.sum(F.when(F.col(confidence) == c, 1).otherwise(0)), F.lit(0)).cast("long").alias(c) for c in CONFIDENCES]
    return nodes.agg(*each, F.count(F.lit(1)).alias("total"))


def test_nodes(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Reached functions and methods with a test's name in a test file."""
    found = resolved(nodes, symbols)
    return found.where(F.col("resolved") & F.col("kind").isin("function", "method") & X.is_test_file("path") & X.is_test_name("qualname"))

