"""Nearest neighbours by multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import local_table, materialize, ready

CELLS = 4  # of each hash function; the outer two are open
MOST_FUNCTIONS = 10  # so there are at most CELLS ** 10, a million, buckets in a table; enough for 800 million vectors


@dataclass(frozen=True)
class Tables:
    """Hash functions floor((a . x + b) / w) of all tables, with ``a`` from the normal (2-stable) law."""

    a: np.ndarray  # table, dimension, function
    b: np.ndarray  # table, function
    w: float
    reach: float  # typical distance of a near neighbour
    norm: float  # largest norm, for the coordinate that makes all norms equal

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """With one more coordinate the nearest by distance are those of the largest inner product."""
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.norm**2 - np.einsum("ij,ij->i", x, x)))
        return np.c_[x * (self.norm / np.maximum(np.linalg.norm(x, axis=1), 1e-300))[:, None] if query else x, more]

    def cells(self, table: int, lifted: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((lifted @ self.a[table] + self.b[table]) / self.w), -CELLS // 2, CELLS // 2 - 1).astype(np.int64) + CELLS // 2

    def buckets(self, table: int, lifted: np.ndarray) -> np.ndarray:
        return self.cells(table, lifted) @ CELLS ** np.arange(self.a.shape[2])

    def chances(self, table: int, lifted: np.ndarray) -> np.ndarray:
        """Query by function by cell: log of the estimated chance that a neighbour at ``reach`` is in the cell.

        Its projections are normal around the query's. The cells of a bucket are independent, so a bucket's
        chance is the product of theirs, and those of all buckets add up to one.
        """
        at = lifted @ self.a[table] + self.b[table]
        edges = np.array([-np.inf, *(np.arange(1, CELLS) - CELLS // 2) * self.w, np.inf])
        below = _normal((edges[None, None, :] - at[:, :, None]) / self.reach)
        return np.log(np.maximum(np.diff(below, axis=2), 1e-30))


def perturbed(chances: np.ndarray) -> Iterator[tuple[int, float]]:
    """All buckets with their chance, in the order of it, from the best cell of every function on.

    A perturbation gives some functions a worse cell. Each is made once, from the one with its last worsened
    function a step better, so the next bucket is always on the heap, which grows with those asked for.
    """
    cells = np.argsort(-chances, axis=1, kind="stable")
    logs = np.take_along_axis(chances, cells, axis=1)
    places = (cells * CELLS ** np.arange(len(cells))[:, None]).tolist()
    loss = (logs[:, :-1] - logs[:, 1:]).tolist()  # of one step further, by function
    best = float(logs[:, 0].sum())
    heap = [(-best, sum(p[0] for p in places), 0, (0,) * len(places))]
    while heap:
        cost, bucket, last, ranks = heappop(heap)
        yield bucket, np.exp(-cost)
        for f in range(last, len(ranks)):
            r = ranks[f]
            if r + 1 < CELLS:
                heappush(heap, (cost + loss[f][r], bucket - places[f][r] + places[f][r + 1], f, (*ranks[:f], r + 1, *ranks[f + 1 :])))


def _normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7 (a logistic form would do as well for an order)."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    tail = np.exp(-np.minimum(z * z, 1e4) / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(z > 0, 1 - tail, tail)


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist() if hasattr(column, "tolist") else column, dtype=np.float64)


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, tables: int = 2, per_bucket: int = 800, block: int = 16384, aim: float = 0.96, trial: int = 64, seed: int = 5, together: int = 4096,
) -> DataFrame:
    """Each query's ``k`` nearest by inner product: ``query_id, rank, vec_id, score``.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; candidates are all rows but the
    query's own. Ties go to the smaller id. Rows that lack an id or a vector, and vectors that are
    empty, zero, or hold a null or non-finite component, take no part; nor do those of another
    dimension than most. Only ``vec_id`` and ``embedding`` are read.

    Equal vectors are hashed and scored once; of each, the ``k + 1`` smallest ids suffice. Every
    vector is in one bucket of each table. A query visits a table's buckets in the order of their
    estimated success until their share of it reaches a level and they hold enough vectors for ``k``
    rows (all, if there are fewer). ``trial`` queries set the level: against
    all rows, exactly, the levels of all tables together found ``aim`` of their neighbours. The
    candidates of all tables are merged and reranked by exact products. Buckets are gathered into, or
    cut into, blocks of about ``block`` vectors, and the queries that come to a block into parts of about
    ``together``, so a task's work does not grow with either; in a block, a query sees the vectors of the
    buckets that it visits. Functions are added as the rows grow, so buckets stay at some ``per_bucket``. The
    driver holds the trial and the bucket sizes, at most CELLS ** MOST_FUNCTIONS for each table.
    """
    spark = vectors.sparkSession
    ready(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where("vec_id IS NOT NULL AND size(x) > 0")
    v = v.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("x", lambda c: c != 0))
    sizes = v.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return local_table(spark, [], schema)
    v = v.where(F.size("x") == sizes[0]["d"])
    salted = v.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    first = Window.partitionBy("x", "_salt").orderBy("vec_id")
    least = salted.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    then = Window.partitionBy("x").orderBy("vec_id")
    ids = least.withColumn("place", F.row_number().over(then)).where(F.col("place") <= k + 1)
    ids = materialize(ids.select("vec_id", "place", F.min("vec_id").over(Window.partitionBy("x")).alias("id"), "x"), "vector-ids")
    distinct = ids.where("place = 1").select("id", "x")
    head = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c))).alias("norm")).collect()[0]

    queries = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    probe = queries.orderBy(F.xxhash64("query_id")).limit(trial).collect()
    if not probe:
        return local_table(spark, [], schema)
    functions = int(np.clip(round(np.log(max(head["n"] / per_bucket, 1.0)) / np.log(CELLS)), 1, MOST_FUNCTIONS))
    rng = np.random.default_rng(seed)
    dim = sizes[0]["d"]
    model = Tables(rng.normal(size=(tables, dim + 1, functions)), rng.random((tables, functions)) * 0.5, 1.0, 1.0, head["norm"])
    model, level = _calibrated(distinct, probe, model, k, aim)

    def hashed(batches):
        for pdf in batches:
            lifted = model.lifted(_matrix(pdf["x"]), False) if len(pdf) else np.zeros((0, dim + 1))
            for t in range(tables):
                yield pd.DataFrame({"table": np.int32(t), "bucket": model.buckets(t, lifted), "id": pdf["id"], "x": pdf["x"]})

    stored = distinct.mapInPandas(hashed, "table int, bucket long, id long, x array<double>")
    directory = stored.groupBy("table", "bucket").count().collect()  # at most tables * CELLS ** MOST_FUNCTIONS rows
    held, sizes_of, first_block, cut = [], [], [], []
    for t in range(tables):
        counts = sorted((r["bucket"], r["count"]) for r in directory if r["table"] == t)
        held.append(np.array([b for b, _ in counts], dtype=np.int64))
        sizes_of.append(np.array([n for _, n in counts], dtype=np.int64))
        at, full, firsts, parts = -1, block, [], []
        for _, n in counts:
            if full + n > block:
                at, full = at + 1, 0
            firsts.append(at)
            parts.append(max(1, -(-n // block)))
            at, full = at + parts[-1] - 1, full + n
        first_block.append(np.array(firsts, dtype=np.int64))
        cut.append(np.array(parts, dtype=np.int64))

    shared = spark.sparkContext.broadcast([{int(b): (int(n), int(f), int(p)) for b, n, f, p in zip(*x)} for x in zip(held, sizes_of, first_block, cut)])

    def visits(batches):
        known = shared.value
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                part = pdf.iloc[lo : lo + 64]
                lifted = model.lifted(_matrix(part["q"]), True)
                for t in range(tables):
                    out = []
                    for query_id, q, chances in zip(part["query_id"], part["q"], model.chances(t, lifted)):
                        seen: dict[int, list[int]] = {}
                        mass, covered, left = 0.0, 0, len(known[t])
                        for b, chance in perturbed(chances):
                            if (found := known[t].get(b)) is not None:
                                size, first, parts = found
                                for n in range(parts):
                                    seen.setdefault(first + n, []).append(b)
                                covered, left = covered + size, left - 1  # different vectors; the query's own may be among them
                            mass += chance
                            if not left or mass >= level and covered >= k + 1:
                                break
                        out += [(t, n, query_id, q, visited) for n, visited in seen.items()]
                    yield pd.DataFrame(out, columns=["table", "block", "query_id", "q", "visited"])

    asked = materialize(queries.mapInPandas(visits, "table int, block long, query_id long, q array<double>, visited array<long>"), "visits")
    split = asked.groupBy("table", "block").agg(F.ceil(F.count(F.lit(1)) / together).cast("int").alias("parts_"))
    asked = asked.join(split, ["table", "block"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts_")).cast("int")).drop("parts_")
    places = [(t, int(b), int(f), int(n)) for t in range(tables) for b, f, n in zip(held[t], first_block[t], cut[t])]
    blocks = local_table(spark, places, "table int, bucket long, first long, parts long")
    kept = stored.join(F.broadcast(blocks), ["table", "bucket"]).select("table", (F.col("first") + F.pmod(F.xxhash64("id"), "parts")).alias("block"), "bucket", "id", "x")
    kept = kept.join(split, ["table", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1))).drop("parts_")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        q, x = left.column("query_id").to_numpy(), right.column("id").to_numpy()
        out_q, out_id, out_s = [], [], []
        if len(q) and len(x):
            xs, qs = _rows(right.column("x"), dim), _rows(left.column("q"), dim)
            own, of = np.unique(right.column("bucket").to_numpy(), return_inverse=True)
            visited = left.column("visited").to_pylist()
            for lo in range(0, len(q), 256):
                allowed = np.array([np.isin(own, v) for v in visited[lo : lo + 256]])
                s = np.where(allowed[:, of], qs[lo : lo + 256] @ xs.T, -np.inf)
                row, near = _largest(s, min(k + 1, len(x)))
                out_q.append(q[lo : lo + 256][row])
                out_id.append(x[near])
                out_s.append(np.einsum("nd,nd->n", xs[near], qs[lo : lo + 256][row]))
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        return pa.table({"query_id": flat(out_q, np.int64), "id": flat(out_id, np.int64), "score": flat(out_s, np.float64)})

    keys = ["table", "block", "part"]
    scored = asked.groupBy(*keys).cogroup(kept.groupBy(*keys)).applyInArrow(score, "query_id long, id long, score double")
    merged = scored.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    best = merged.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1)
    rows = best.join(ids.select("id", "vec_id"), "id").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rows(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _largest(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places) of the finite ones of ``s`` that are the ``m`` largest of their row, or as large but for
    rounding of the last of those, so an exact order can be found among them.
    """
    cut = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m, None] if s.shape[1] > m else np.full((len(s), 1), -np.inf)
    slack = 1e-11 * (1 + np.max(np.abs(s), axis=1, keepdims=True, where=np.isfinite(s), initial=0.0))
    return np.nonzero((s >= cut - slack) & np.isfinite(s))


def _calibrated(distinct: DataFrame, probe: list, model: Tables, k: int, aim: float) -> tuple[Tables, float]:
    """The cell width and reach for these data, and the level that finds ``aim`` of the neighbours of
    the trial queries, which are compared with all rows (a fixed number of queries, so one pass).
    """
    ask = np.array([r["q"] for r in probe])
    own = np.array([r["query_id"] for r in probe])
    dim = ask.shape[1]

    def exact(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = _matrix(pdf["x"])
            s = ask @ x.T
            of, near = _largest(s, min(k + 1, len(pdf)))
            yield pd.DataFrame({"q": of.astype(np.int32), "id": pdf["id"].to_numpy()[near], "s": np.einsum("nd,nd->n", ask[of], x[near]), "x": list(x[near])})

    found = distinct.mapInPandas(exact, "q int, id long, s double, x array<double>")
    first = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    rows = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).collect()  # trial * (k + 1) rows
    rows = [r for r in rows if r["id"] != own[r["q"]]] or rows
    of, near = np.array([r["q"] for r in rows]), np.array([r["x"] for r in rows])
    lifted, asked = model.lifted(near, False), model.lifted(ask, True)
    reach = max(float(np.median(np.linalg.norm(lifted - asked[of], axis=1))), 1e-9)
    width = max(float(np.std(np.r_[lifted, asked] @ model.a[0])), 1e-9)
    model = Tables(model.a, model.b * width, width, reach, model.norm)
    needed = np.empty((len(model.a), len(of)))
    for t in range(len(model.a)):
        chances, buckets = model.chances(t, asked), model.buckets(t, lifted)
        for i in np.unique(of).tolist():  # one query at a time: a number for each bucket
            every = chances[i][-1]
            for own_cells in chances[i][-2::-1]:
                every = np.add.outer(every, own_cells).ravel()  # the first function's cell is the lowest digit
            order = np.argsort(-every, kind="stable")
            mass = np.cumsum(np.exp(every[order]))
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            at = place[buckets[of == i]]
            needed[t, of == i] = np.where(at > 0, mass[np.maximum(at - 1, 0)], 0.0)  # visited if the mass before it is below the level
    return model, float(np.quantile(needed.min(axis=0), aim)) + 1e-9
