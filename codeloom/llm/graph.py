"""Connected components of a link table, without ever holding the links in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every end of ``links`` (a, b); ``component`` is the least id it reaches.

    Alternating stars: each round points every vertex's larger neighbours, then its smaller ones, at
    the least of its neighbours, until nothing changes; the rounds grow with the logarithm of the
    size. Minima are combined before each exchange, so a vertex with very many links burdens no task. Two
    rounds are compared by the number of their links and two 64-bit digests.
    """

    def digest(of: DataFrame) -> tuple:  # links are distinct
        return tuple(of.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("low", "high")), F.bit_xor(F.xxhash64("high", "low", F.lit(1)))).collect()[0])

    now = materialize(links.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "edges")
    mark = digest(now)
    while True:
        # large star: every neighbour above a vertex goes to the least neighbour (or itself)
        both = now.select(F.col("low").alias("v"), F.col("high").alias("u")).union(now.select(F.col("high").alias("v"), F.col("low").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("m").alias("low"), F.col("u").alias("high")).where("low <> high").distinct()
        large = materialize(large, "edges")
        # small star: every neighbour below a vertex, and the vertex itself, goes to the least
        small_least = large.groupBy("high").agg(F.min("low").alias("m"))
        joined = large.join(small_least, "high")
        small = joined.select(F.col("m").alias("low"), F.col("low").alias("high")).union(joined.select(F.col("m").alias("low"), "high")).where("low <> high").distinct()
        small = materialize(small, "edges")
        now, mark, before = small, digest(small), mark
        if mark == before:
            return now.select(F.col("high").alias("id"), F.col("low").alias("component")).union(now.select(F.col("low").alias("id"), F.col("low").alias("component")).distinct())
