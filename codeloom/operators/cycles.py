"""Strongly connected components of a directed graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

SMALL = 500_000  # edges that one task may hold


def cycles(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """``component, member``: nodes on a cycle, by the least node of their component.

    Nodes without an edge in or out lie on no cycle and are trimmed, round by round. If no more than
    ``small`` edges are left, one task finds the components; else they are found by colouring: the
    least node that reaches a node is its colour, and what of a colour reaches the colour's own node is
    a component. Self-loops are cycles of one.
    """
    loops = edges.where("source = target").select(F.col("source").alias("component"), F.col("source").alias("member")).distinct()
    left = written(edges.where("source <> target").select("source", "target").distinct())
    n = left.count()
    while n:
        now = left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        now = written(now.join(now.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        m = now.count()
        left, shrunk, n = now, m < n, m
        if not shrunk:
            break
    found = loops
    if n:
        parts = left.coalesce(1).mapInPandas(_components, "component string, member string") if n <= small else _coloured(left)
        found = parts.unionByName(loops.join(parts.select("member"), "member", "left_anti"))
    return found


def _components(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of more than one node, by two passes over an explicit stack."""
    ahead: dict[str, list[str]] = {}
    behind: dict[str, list[str]] = {}
    for pdf in batches:
        for a, b in zip(pdf["source"], pdf["target"]):
            ahead.setdefault(a, []).append(b)
            behind.setdefault(b, []).append(a)
    finished: list[str] = []
    seen: set[str] = set()
    for start in sorted(ahead):
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(ahead[start]))]
        while stack:
            node, rest = stack[-1]
            for other in rest:
                if other not in seen:
                    seen.add(other)
                    stack.append((other, iter(ahead.get(other, ()))))
                    break
            else:
                finished.append(node)
                stack.pop()
    taken: set[str] = set()
    rows = []
    for start in reversed(finished):
        if start in taken:
            continue
        taken.add(start)
        members, todo = [], [start]
        while todo:
            node = todo.pop()
            members.append(node)
            for other in behind.get(node, ()):
                if other not in taken:
                    taken.add(other)
                    todo.append(other)
        if len(members) > 1:
            rows += [(min(members), m) for m in members]
    yield pd.DataFrame(rows, columns=["component", "member"])


def _coloured(edges: DataFrame) -> DataFrame:
    """The same without ever holding the graph in one task."""
    out = None
    left = edges
    while not left.isEmpty():
        nodes = left.select(F.col("source").alias("node")).union(left.select("target")).distinct()
        colour = written(nodes.withColumn("colour", F.col("node")))
        while True:  # the least node that reaches each node
            sent = left.join(colour.withColumnRenamed("node", "source"), "source").select(F.col("target").alias("node"), "colour")
            new = written(colour.unionByName(sent).groupBy("node").agg(F.min("colour").alias("colour")))
            same = new.join(colour, ["node", "colour"], "left_anti").isEmpty()
            colour = new
            if same:
                break
        within = left.join(colour.select(F.col("node").alias("source"), F.col("colour").alias("c")), "source").join(colour.select(F.col("node").alias("target"), F.col("colour").alias("d")), "target").where("c = d")
        within = written(within.select("source", "target", "c"))
        back = written(colour.where("node = colour").select(F.col("node").alias("member"), F.col("colour").alias("component")))
        while True:  # what of each colour reaches its own node
            more = within.join(back.select(F.col("member").alias("target"), F.col("component").alias("c")), ["target", "c"]).select(F.col("source").alias("member"), F.col("c").alias("component"))
            new = written(back.unionByName(more).distinct())
            grown = new.count() > back.count()
            back = new
            if not grown:
                break
        sizes = back.groupBy("component").count().where("count > 1").select("component")
        part = back.join(sizes, "component", "left_semi").select("component", "member")
        out = part if out is None else out.unionByName(part)
        done = back.select(F.col("member").alias("source"))
        left = written(left.join(done, "source", "left_anti").join(done.withColumnRenamed("source", "target"), "target", "left_anti").select("source", "target"))
    return out
