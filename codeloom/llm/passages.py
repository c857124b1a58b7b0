"""Repeated passages by collinear chaining: shared k-mer seeds, chains through a Fenwick tree, alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ready
from .shingles import WORDS, long_lists, mix, release, slices, words

WINDOW = 16  # of consecutive k-mers, one at least is a seed
GAP = 0.1  # cost of each word between two seeds of a chain, on either side
SEED = float(WORDS)  # worth of a seed
MARGIN = 64  # words around a chain that alignment may reach
NEAR = 24  # words that alignment looks ahead at a difference
SURE = 3  # equal words after which it goes on
STRETCH = 32  # words in which the equal runs of one diagonal are one link; below ``least``, so they are one equal run

_EACH = np.random.default_rng(91).integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def kmers(hashes: np.ndarray) -> np.ndarray:
    n = max(0, len(hashes) - WORDS + 1)
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        grams += hashes[k : k + n] * _EACH[k]
    return mix(grams)


def _least_of(values: np.ndarray, window: int) -> np.ndarray:
    """The place of the least value, leftmost of equals, of each window (of all, if they are fewer)."""
    if len(values) <= window:
        return np.array([int(values.argmin())])
    return np.lib.stride_tricks.sliding_window_view(values, window).argmin(axis=1) + np.arange(len(values) - window + 1)


def runs(grams: np.ndarray, least: int, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) of every run of ``least`` words whose seeds all are at ``repeated`` places.

    Equal runs have the same seeds, so what two documents share is among those.
    """
    n, wide = len(grams) - (least - WORDS), least - WORDS - WINDOW + 2  # runs; windows in each
    if n < 1 or not len(repeated):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    known = np.zeros(len(grams), dtype=bool)
    known[repeated[repeated < len(grams)]] = True
    good = np.r_[0, np.cumsum(known[_least_of(grams, WINDOW)])]
    start = np.flatnonzero(good[wide:] - good[:-wide] == wide)
    keys = np.zeros(len(start), dtype=np.uint64)
    for k in sorted({*range(0, least - WORDS, WORDS), least - WORDS}):
        keys = mix(keys + grams[start + k])
    return keys, start


def seeds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k-mers, word places) of a text's minimizers: the least k-mer of every WINDOW, leftmost of equals.

    A k-mer that comes again in the text counts as another one, by its number among its equals, so
    texts that repeat themselves meet place by place and not all in the first.
    """
    grams = kmers(hashes)
    if not len(grams):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.unique(_least_of(grams, WINDOW))
    found = grams[at]
    order = np.argsort(found, kind="stable")
    same = np.r_[False, found[order][1:] == found[order][:-1]]
    if same.any():
        run = np.arange(len(found)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(found))))
        again = np.zeros(len(found), dtype=np.uint64)
        again[order] = run.astype(np.uint64)
        found = np.where(again > 0, mix(found + again * _EACH[0]), found)
    return found, at


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every seed of a text as it is; one that comes again also by its number."""
    for batch in slices(batches):
        hashes, edges = words(batch.column(1))
        grams, places, ids = [], [], []
        for doc_id, a, b in zip(batch.column(0).to_pylist(), edges[:-1].tolist(), edges[1:].tolist()):
            g, at = seeds(hashes[a:b])
            each = kmers(hashes[a:b])
            again = g != each[at]
            grams += [each[at], g[again]]
            places += [at, at[again]]
            ids.append(np.full(len(g) + int(again.sum()), doc_id, dtype=np.int64))
        flat = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (grams, ids, places)]
        yield pa.RecordBatch.from_arrays([pa.array(flat[0].view(np.int64)), pa.array(flat[1]), pa.array(flat[2].astype(np.int32))], names=["seed", "doc_id", "at"])
    release()


def _with_runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The runs of each document (doc_id, text, places of its repeated seeds)."""
    for batch in slices(batches):
        hashes, edges = words(batch.column(1))
        keys, ids, places = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for doc_id, repeated, a, b in zip(batch.column(0).to_pylist(), batch.column(2), edges[:-1].tolist(), edges[1:].tolist()):
            key, at = runs(kmers(hashes[a:b]), least, repeated.values.to_numpy())
            keys.append(key)
            ids.append(np.full(len(key), doc_id, dtype=np.int64))
            places.append(at)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(places).astype(np.int32))], names=["run", "doc_id", "at"])
    release()


class Fenwick:
    """The best (score, when put in) among the keys below a bound, of equal scores the last put in."""

    def __init__(self, size: int):
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)

    def put(self, key: int, score: float, time: int) -> None:
        key += 1
        while key < len(self.best):
            if (score, time) > self.best[key]:
                self.best[key] = (score, time)
            key += key & -key

    def below(self, key: int) -> tuple[float, int]:
        out = (-np.inf, -1)
        while key > 0:
            if self.best[key] > out:
                out = self.best[key]
            key -= key & -key
        return out


def chains(x: np.ndarray, y: np.ndarray, least: int = 2, step: float = np.inf) -> list[tuple[int, int, int, int, int]]:
    """Chains of seeds at (x, y) that rise in both, best first: (x, x of last, y, y of last, seeds).

    A seed is worth SEED, and a step costs GAP for each word that it goes on either side; both being
    linear, the best predecessor has the largest score plus GAP * (x + y) among those of smaller y, which
    a Fenwick tree gives. No seed is in two chains. Chains are cut, though none is dropped for it, where
    they go more than ``step`` words on either side at once, as alignment may not get over that.
    """
    order = np.lexsort((-y, x))  # of equal x the larger y first, so they can't precede each other
    keys = np.unique(y)
    rank = np.searchsorted(keys, y).tolist()
    tree, score, back = Fenwick(len(keys)), [0.0] * len(x), [-1] * len(x)
    xs, ys = x.tolist(), y.tolist()
    for time, i in enumerate(items := order.tolist()):  # in units of GAP, so equal scores are equal
        far = xs[i] + ys[i]
        value, before = tree.below(rank[i])
        score[i] = SEED / GAP
        if before >= 0 and value - far > 0:  # of equally good ones the nearest, so copies chain each by itself
            score[i], back[i] = SEED / GAP + value - far, items[before]
        tree.put(rank[i], score[i] + far, time)
    used, out = [False] * len(x), []
    for i in sorted(range(len(x)), key=lambda i: (-score[i], xs[i], ys[i])):
        j, n, first, last, parts, all_ = i, 0, i, i, [], 0
        while j >= 0 and not used[j]:
            if max(xs[first] - xs[j], ys[first] - ys[j]) > step:
                parts.append((xs[first], xs[last], ys[first], ys[last], n))
                last, n = j, 0
            used[j], first, n, all_, j = True, j, n + 1, all_ + 1, back[j]
        if all_ >= least:
            out += [*parts, (xs[first], xs[last], ys[first], ys[last], n)]
    return out


def _chained(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Chains of each (doc_id, other) of a partition that is sorted by both; a pair may span batches.

    A link with a span is an equal run already, so it stands by itself, with -1 in place of the seeds.
    """
    held: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * 5

    def out(columns: list[np.ndarray]) -> pa.RecordBatch:
        doc, other, x, y, span = columns
        cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])]) if len(doc) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.r_[cut, len(doc)])
        ids, others, found = [], [], []
        for a, n in zip(cut.tolist(), sizes.tolist()):
            one, run = span[a : a + n] == 0, np.flatnonzero(span[a : a + n]) + a
            got = chains(x[a : a + n][one], y[a : a + n][one], least, NEAR + WINDOW) if one.sum() >= least else []
            got += zip(x[run].tolist(), (x + span)[run].tolist(), y[run].tolist(), (y + span)[run].tolist(), [-1] * len(run))
            if got:
                ids.append(doc[a])
                others.append(other[a])
                found.append(np.array(got, dtype=np.int64).ravel())
        return pa.RecordBatch.from_arrays([pa.array(np.array(ids, dtype=np.int64)), pa.array(np.array(others, dtype=np.int64)), long_lists([f.view(np.uint64) for f in found])], names=["doc_id", "other", "chains"])

    for batch in batches:
        new = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
        now = [np.concatenate(p) for p in zip(held, new)]
        if not len(now[0]):
            continue
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        keep = int(last[-1]) + 1 if len(last) else 0
        if keep:
            yield out([c[:keep] for c in now])
        held = [c[keep:] for c in now]
    yield out(held)


@dataclass
class Aligned:
    a: int
    b: int
    equal: int
    edits: int


def follow(a: np.ndarray, b: np.ndarray) -> Aligned:
    """Align from the start of both as far as it goes: equal runs, and the nearest way past a difference.

    At a difference the least number of words is skipped in both, NEAR in each at most, after which SURE
    words (or all that are left) are equal. Trailing differences are not counted in.
    """
    i = j = equal = edits = 0
    while True:
        n = min(len(a) - i, len(b) - j)
        differ = np.flatnonzero(a[i : i + n] != b[j : j + n])[:1]
        run = int(differ[0]) if len(differ) else n
        i, j, equal = i + run, j + run, equal + run
        step = _past(a[i : i + NEAR + SURE], b[j : j + NEAR + SURE]) if run < n or n == run and i < len(a) and j < len(b) else None
        if step is None:
            return Aligned(i, j, equal, edits)
        i, j, edits = i + step[0], j + step[1], edits + max(step)


def _past(a: np.ndarray, b: np.ndarray) -> tuple[int, int] | None:
    if len(a) < SURE or len(b) < SURE:
        return None
    same = a[:, None] == b[None, :]
    run = same[: len(a) - SURE + 1, : len(b) - SURE + 1].copy()
    for k in range(1, SURE):
        run &= same[k : len(a) - SURE + 1 + k, k : len(b) - SURE + 1 + k]
    at = np.argwhere(run)
    if not len(at):
        return None
    best = at[np.lexsort((at[:, 0], at.max(axis=1), at.sum(axis=1)))[0]]
    return int(best[0]), int(best[1])


def align(a: np.ndarray, b: np.ndarray, x: int, y: int) -> tuple[int, int, int, int, int, int]:
    """The passage around the seed at (x, y): (from, to) in a, (from, to) in b, equal words, edits."""
    ahead, behind = follow(a[x:], b[y:]), follow(a[:x][::-1], b[:y][::-1])
    return x - behind.a, x + ahead.a, y - behind.b, y + ahead.b, ahead.equal + behind.equal, ahead.edits + behind.edits


def equal_run(a: np.ndarray, b: np.ndarray, x: int, y: int) -> tuple[int, int, int, int, int, int]:
    """As ``align``, but only the equal words around (x, y)."""

    def far(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        return int((*np.flatnonzero(a[:n] != b[:n])[:1], n)[0])

    ahead, behind = far(a[x:], b[y:]), far(a[:x][::-1], b[:y][::-1])
    return x - behind, x + ahead, y - behind, y + ahead, behind + ahead, 0


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The document's words in and around its chains, in place of its text."""
    for batch in slices(batches):
        hashes, edges = words(batch.column(3))
        parts, starts, bounds = [], [], []
        for got, a, b in zip(batch.column(2), edges[:-1].tolist(), edges[1:].tolist()):
            c = got.values.to_numpy().reshape(-1, 5)
            lo, hi = max(0, int(c[:, 0].min()) - MARGIN), min(b - a, int(c[:, 1].max()) + WORDS + MARGIN)
            parts.append(hashes[a + lo : a + hi])
            starts.append(lo)
            bounds.append(b - a)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(starts, pa.int64()), long_lists(parts)], names=["doc_id", "other", "chains", "first", "part"])


def _aligned(batches: Iterator[pa.RecordBatch], least: int, identity: float) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "other_id", "start", "end", "other_start", "other_end", "n_equal", "n_edits"]
    last, text = None, np.zeros(0, dtype=np.uint64)
    for batch in batches:
        rows = []
        for k in range(len(batch)):
            doc_id, other = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            if other != last:  # rows come sorted by it, so a text is hashed once
                text, last = words(batch.column(5).slice(k, 1))[0], other
            c = batch.column(2)[k].values.to_numpy().reshape(-1, 5)
            first, part = batch.column(3)[k].as_py(), batch.column(4)[k].values.to_numpy().view(np.uint64)
            done: list[tuple[int, int, int, int]] = []
            for x, to, y, _, _ in sorted(r for r in c.tolist() if r[4] < 0):
                if any(s <= x and to + WORDS <= e and u <= y and y + to - x + WORDS <= v for s, e, u, v in done):
                    continue
                s, e, u, v, equal, edits = align(part, text, x - first, y)
                if equal < identity * (equal + edits):  # what lies around it is too different
                    s, e, u, v, equal, edits = equal_run(part, text, x - first, y)
                if part[x - first] == text[y] and equal >= least:
                    done.append((s + first, e + first, u, v))
                    rows.append((doc_id, other, s + first, e + first, u, v, equal, edits))
            for x, _, y, _, _ in sorted(r for r in c.tolist() if r[4] >= 0):
                if x - first >= len(part) or y >= len(text) or part[x - first] != text[y] or any(s <= x < e and u <= y < v for s, e, u, v in done):
                    continue
                s, e, u, v, equal, edits = align(part, text, x - first, y)
                done.append((s + first, e + first, u, v))
                if equal >= least and equal >= identity * (equal + edits):
                    rows.append((doc_id, other, s + first, e + first, u, v, equal, edits))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 8, names=names)


def _run_links(met: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """Runs that several documents hold, linked to their first place: as links of seeds, with the span to the last k-mer."""
    repeated = met.groupBy("doc_id").agg(F.collect_set("at").alias("places"))
    held = texts.join(repeated, "doc_id").select("doc_id", "text", "places").mapInArrow(lambda b: _with_runs(b, least), "run long, doc_id long, at int")
    held = materialize(held, "runs")
    first = held.groupBy("run").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("most")).where("most > first.doc_id")
    first = materialize(first.select("run", F.col("first.doc_id").alias("other"), F.col("first.at").alias("other_at")), "repeated-runs")
    each = held.join(first, "run").where("doc_id <> other").withColumn("diagonal", F.col("at") - F.col("other_at"))
    by = each.groupBy("doc_id", "other", "diagonal", F.floor(F.col("at") / STRETCH).alias("stretch")).agg(F.min("at").alias("at"), F.max("at").alias("last"))
    return by.select("doc_id", "other", "at", (F.col("at") - F.col("diagonal")).alias("other_at"), (F.col("last") - F.col("at") + (least - WORDS)).alias("span"))


def repeated_passages(docs: DataFrame, least: int = 45, identity: float = 0.8) -> DataFrame:
    """Passages of at least ``least`` equal words that a document shares with one of a smaller id:
    ``doc_id, other_id``, the word ranges in both, equal words and edits.

    Words are those of the near-duplicate contract. Every k-mer seed that several documents hold is
    linked to its first place in the document of the least id, not to all others. As the seeds of
    a passage made of frequent lines may have different first documents, runs of ``least`` words are
    linked too, every one of them and each to its own first place: any ``least`` words in a row (20 at least)
    that a document shares with one of a smaller id so are in a row of the result, however often
    their seeds occur elsewhere and however often the passage is repeated in either document. That
    other document is the first that holds the run, which need not be each one that shares the passage.
    Passages with differences, and shorter ones, need two seeds with the same first document. What a
    document repeats within itself alone is not listed.

    The links of a pair of documents are chained, and long enough chains are aligned on the texts, over
    differing words. Rows without an id, or without text, hold no passage; rows that share an id are
    compared with other ids only. Only ``doc_id`` and ``text`` are read.

    Seeds are counted before they are joined; the join on a frequent seed can be split, as its other
    side is one row. Only runs whose seeds all are repeated are looked at. A pair's links are no more
    than its document's seeds, and its runs, one for each diagonal and STRETCH.
    """
    ready(docs.sparkSession)
    span = max(least, WINDOW + WORDS - 1)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = materialize(texts.mapInArrow(_seeded, "seed long, doc_id long, at int"), "seeds")
    first = found.groupBy("seed").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("most")).where("most > first.doc_id")
    first = first.select("seed", F.col("first.doc_id").alias("other"), F.col("first.at").alias("other_at"))
    first = materialize(first, "repeated-seeds")  # so the join below shuffles both sides anew and can split a frequent seed
    met = materialize(found.join(first, "seed").select("doc_id", "other", "at", "other_at"), "met")
    links = met.where("doc_id <> other").select("doc_id", "other", "at", "other_at", F.lit(0).alias("span"))
    links = links.unionByName(_run_links(met, texts, span))
    links = links.repartition("doc_id", "other").sortWithinPartitions("doc_id", "other", "at", "other_at")
    pairs = links.mapInArrow(lambda b: _chained(b, 2), "doc_id long, other long, chains array<long>")
    pairs = materialize(pairs, "chains")
    sliced = pairs.join(texts, "doc_id").select("doc_id", "other", "chains", "text").mapInArrow(_sliced, "doc_id long, other long, chains array<long>, first long, part array<long>")
    # the second join asks for the same exchange of the texts as the first, which Spark then reuses
    both = sliced.alias("s").join(texts.alias("t"), F.col("s.other") == F.col("t.doc_id"))
    both = both.select("s.doc_id", "s.other", "s.chains", "s.first", "s.part", "t.text")
    schema = "doc_id long, other_id long, start long, end long, other_start long, other_end long, n_equal long, n_edits long"
    return both.mapInArrow(lambda b: _aligned(b, least, identity), schema)
