"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import local_table, materialize, ranked


def ring(shards: int, virtual: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of all virtual nodes as signed 64-bit, and the shard that owns each."""
    nodes = sorted((int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True), s) for s in range(shards) for v in range(virtual))
    return np.array([p for p, _ in nodes], dtype=np.int64), np.array([s for _, s in nodes], dtype=np.int64)


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """The bound of each shard. Without slack they add up to ``rows`` and differ by one at most."""
    if slack > 0:
        return [int(np.ceil(rows * (1 + slack) / shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def place(counts: dict[int, int], owners: np.ndarray, bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Deal the arcs' rows to shards: (arc, first rank, end rank, shard, first slot).

    Keys arrive arc by arc, the arcs with most rows first (large groups of equal keys so fill few shards),
    then in ring order. A key goes to its arc's shard or, where that is full, on clockwise to the next
    virtual node whose shard has room. Each entry ends an arc or fills a shard, so there are at most
    as many entries as arcs and shards together.
    """
    room, used, out = list(bounds), [0] * len(bounds), []
    for arc in sorted(counts, key=lambda a: (-counts[a], a)):
        first, step = 0, arc
        while first < counts[arc]:
            shard = int(owners[step % len(owners)])
            if k := min(counts[arc] - first, room[shard]):
                out.append((arc, first, first + k, shard, used[shard]))
                room[shard] -= k
                used[shard] += k
                first += k
            step += 1
    return out


def arc_of(at: Column, places: np.ndarray) -> Column:
    """How many of the sorted ``places`` lie below ``at``, around the ring: a binary search in one expression."""
    held = F.lit(places)
    steps = F.array(*[F.lit(1 << k) for k in range(len(places).bit_length() - 1, -1, -1)])
    below = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(held, n + step - 1) < at, n + step).otherwise(n))
    return below % len(places)


def shard_documents(docs: DataFrame, shards: int = 24, virtual: int = 128, slack: float = 0.0) -> DataFrame:
    """Put every document into a shard; law ``rows``: with ``slack`` 0, counts differ by one at most.

    A document's place on the ring is a hash of its text, so equal texts are neighbours and stay
    together but where a shard is full: then the rest of them continues clockwise. ``slot`` numbers a
    shard's rows from 0 without gaps. A null text has no bytes. Rows equal in every column read may
    take each other's place. Only ``doc_id`` and ``text`` are read. What another shard moves besides its
    own share is measured in the tests and the README, for this law and with slack.

    The driver holds ``shards * virtual`` arcs with their counts, whatever the input; the table that
    is broadcast has at most twice as many rows. Rows are ranked within arcs in buckets by text and
    id, so that copies are neighbours and an arc with a third of all rows is dealt to many tasks.
    """
    spark = docs.sparkSession
    places, owners = ring(shards, virtual)

    text = F.coalesce(F.col("text"), F.lit(""))
    small = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_at"))
    same = F.when(F.col("doc_id").isNull(), F.floor(F.rand() * 4096))  # spreads rows without an id, those of one text being equal
    small = materialize(small.withColumn("_arc", arc_of(F.col("_at"), places)).withColumn("_same", same), "shard-rows")
    counts = {r["_arc"]: r["count"] for r in small.groupBy("_arc").count().collect()}  # one row for each arc at most
    dealt = place(counts, owners, capacities(sum(counts.values()), shards, slack))
    plan = local_table(spark, dealt or [(0, 0, 0, 0, 0)], "_arc int, _first long, _end long, shard int, _slot long")
    bucket = F.pmod(F.xxhash64("_at"), F.lit(64)) * 64 + F.pmod(F.xxhash64("doc_id", "_same"), F.lit(64))
    rows = ranked(small, "_arc", ["_at", "doc_id", "text_crc32", "size", "_same"], bucket)
    put = rows.join(F.broadcast(plan), (rows["_arc"] == plan["_arc"]) & (rows["rank"] >= plan["_first"]) & (rows["rank"] < plan["_end"]))
    return put.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_slot") + F.col("rank") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
