"""Best-fit packing: bin completion with branch and bound over a histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import count
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_table, materialize, ranked, ready
from .shingles import release, slices

END = 2
Pattern = tuple[tuple[int, int], ...]  # (length, how often) in one sequence


@lru_cache(maxsize=2)
def encoder(path: str):
    """Text to ids. ``path`` is the tokenizer file's place, whose ranks lie beside it.

    ``byte_bpe_50k.tiktoken`` holds the same vocabulary as ``byte_bpe_50k.json``; its library gives
    the same ids in a fifth of the time (the tests compare them). The special tokens in a text, such as
    ``<|endoftext|>``, are those of the tokenizer file. Other files go by ``tokenizers``.
    """
    ranks = path.removesuffix(".json") + ".tiktoken"
    try:
        lines = open(ranks, "rb").read().split(b"\n")
    except FileNotFoundError:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4")
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f).get("added_tokens") or ()}
    parts = (line.split() for line in lines if line)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in parts}, special_tokens=special)
    return lambda text: np.asarray(enc.encode_to_numpy(text, allowed_special="all"), dtype="<u4")


def pieces(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """The documents' pieces: all have ``size`` tokens but the first, which has the rest."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in slices(batches, 256):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                first = len(ids) % size or size
                edges = [0, *range(first, len(ids) + 1, size)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: dict[int, int], size: int) -> int:
    """No packing has fewer sequences: by the tokens, and by items that can't share a sequence."""
    best = -(-sum(n * c for n, c in counts.items()) // size)
    for k in range(1, size // 2 + 1):
        large = sum(c for n, c in counts.items() if n > size - k)
        middle = {n: c for n, c in counts.items() if size // 2 < n <= size - k}
        small = sum(n * c for n, c in counts.items() if k <= n <= size // 2)
        alone = sum(middle.values())
        room = alone * size - sum(n * c for n, c in middle.items())
        best = max(best, large + alone + max(0, -(-(small - room) // size)))
    return best


def best_fit(counts: dict[int, int], size: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over equal lengths at once: patterns with how often each is used."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}  # room left -> patterns
    for n in sorted((n for n in counts if counts[n]), reverse=True):
        left = counts[n]
        while left:
            room = min((r for r in open_ if r >= n), default=None)
            if room is None:
                per = size // n
                if bins := left // per:
                    open_.setdefault(size - per * n, []).append((((n, per),), bins))
                if rest := left % per:
                    open_.setdefault(size - rest * n, []).append((((n, rest),), 1))
                break
            pattern, bins = open_[room].pop()
            per = min(room // n, left)
            fill = min(bins, left // per)
            if bins > fill:
                open_[room].append((pattern, bins - fill))
            open_.setdefault(room - per * n, []).append(((*pattern, (n, per)), fill))
            open_ = {r: p for r, p in open_.items() if p}
            left -= per * fill
    return [x for p in open_.values() for x in p]


class _Spent(Exception):
    """No work is left."""


class Work:
    """Nodes that a search may still look at, so its time is the same in every run and bounded."""

    def __init__(self, nodes: int):
        self.left = nodes

    def spend(self, nodes: int = 1) -> None:
        self.left -= nodes
        if self.left < 0:
            raise _Spent


def _raised(sums: int, by: int) -> int:
    """A bit mask of numbers with all numbers up to ``by`` above them."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        sums |= sums << step
        done += step
    return sums


def _dominated(chosen: Pattern, counts: dict[int, int], waste: int) -> bool:
    """Whether some of the items, or none, could be exchanged for one larger unused item that still fits,
    or several for one of their sum: what stays outside would then be easier to place.
    """
    single = several = free = 0  # bit masks of lengths
    for n, k in chosen:
        for _ in range(k):
            several |= (single | several) << n
            single |= 1 << n
    used = dict(chosen)
    for n, c in counts.items():
        if c > used.get(n, 0):
            free |= 1 << n
    return bool((_raised(several, waste) | (_raised(single << 1 | 2, waste - 1) if waste else 0)) & free)


def fillings(counts: dict[int, int], room: int, work: Work, most: int) -> Iterator[tuple[int, Pattern]]:
    """All undominated fillings of ``room`` that waste ``most`` at most, least waste first: (waste, pattern).

    The sums that can be reached with the items up to each length are bit masks, so no branch is a dead end.
    """
    kinds = sorted((n for n, c in counts.items() if c and n <= room), reverse=True)
    mask, reach = (1 << room + 1) - 1, [1]
    for n in reversed(kinds):
        sums, left, step = reach[-1], min(counts[n], room // n), 1
        while left:
            take = min(step, left)
            sums |= sums << take * n & mask
            left, step = left - take, 2 * step
        reach.append(sums)
    reach.reverse()
    work.spend(len(kinds) // 4 + 1)
    for waste in range(min(most, room) + 1):
        stack: list[tuple[int, int, Pattern]] = [(0, room - waste, ())] if reach[0] >> room - waste & 1 else []
        while stack:
            work.spend()
            i, left, chosen = stack.pop()
            if not left:
                if not _dominated(chosen, counts, waste):
                    yield waste, chosen
                continue
            while kinds[i] > left:
                i += 1
            n = kinds[i]
            for k in range(min(counts[n], left // n) + 1):  # the last is looked at first: larger items go first
                if reach[i + 1] >> left - k * n & 1:
                    stack.append((i + 1, left - k * n, (*chosen, (n, k)) if k else chosen))


def _completed(state: dict[int, int], size: int, work: Work, most: int) -> Iterator[tuple[int, Pattern]]:
    """The fillings of a sequence around the largest item, with it."""
    largest = max(state)
    for waste, items in fillings({**state, largest: state[largest] - 1}, size - largest, work, most):
        use = {largest: 1}
        for n, k in items:
            use[n] = use.get(n, 0) + k
        yield waste, tuple(sorted(use.items(), reverse=True))


def _without(state: dict[int, int], pattern: Pattern, times: int = 1) -> dict[int, int]:
    out = dict(state)
    for n, k in pattern:
        out[n] -= k * times
        if not out[n]:
            del out[n]
    return out


def search_tree(counts: dict[int, int], size: int, bins: int, low: int, work: Work) -> tuple[list[tuple[Pattern, int]] | None, bool]:
    """A packing of fewer than ``bins`` sequences, if one is found, and whether it is known to be the best.

    The largest item left is completed by every undominated filling, in order of waste, used as often as
    the counts allow or less often. A branch ends once its waste exceeds what an improvement may waste
    in all. Branches that differ least from the first choices come first. No option is left out, so
    once all are looked at there is nothing better.
    """
    total, best, tick = sum(n * c for n, c in counts.items()), None, count()

    def options(state: dict[int, int], waste: int) -> Iterator[tuple[int, Pattern, int]]:
        room = (bins - 1) * size - total - waste
        for lost, pattern in _completed(state, size, work, room):
            for times in range(min(state[n] // k for n, k in pattern), 0, -1):
                if lost * times <= room:
                    yield lost * times, pattern, times

    heap = [(0, 0, next(tick), counts, None, 0, 0, options(counts, 0))]
    try:
        while heap and bins > low:
            late, _, _, state, done, used, waste, left = heappop(heap)
            while (option := next(left, None)) is not None:
                lost, pattern, times = option
                heappush(heap, (late + 1, -used, next(tick), state, done, used, waste, left))
                if waste + lost > (bins - 1) * size - total:  # there was an improvement since
                    break
                work.spend(len(state) // 8)
                state, done, used, waste = _without(state, pattern, times), (done, pattern, times), used + times, waste + lost
                if not state:
                    bins, best = used, []
                    while done:
                        done, pattern, times = done
                        best.append((pattern, times))
                    break
                left = options(state, waste)
    except _Spent:
        return best, bins <= low
    return best, True


def _squeezed(group: list[Pattern], size: int, work: Work, slack: int) -> list[Pattern] | None:
    """Sequences for the items of ``group`` of which all but the last waste less together than now, so the
    last holds less (or, with ``slack``, other items); found by bin completion, or None.
    """
    counts: dict[int, int] = {}
    for n, c in (x for p in group for x in p):
        counts[n] = counts.get(n, 0) + c
    full = len(group) - 1
    most = full * size - sum(n * c for p in group[:full] for n, c in p) - 1 + slack

    def fill(state: dict[int, int], left: int, allowed: int) -> list[Pattern] | None:
        if not left or not state:
            return None if left else []
        for waste, pattern in _completed(state, size, work, allowed):
            rest = fill(_without(state, pattern), left - 1, allowed - waste)
            if rest is not None:
                return [pattern, *rest]
        return None

    found = fill(counts, full, most) if most >= 0 else None
    if found is None or sorted(found) == sorted(group[:full]):
        return None
    for p in found:
        counts = _without(counts, p)
    return [*found, tuple(sorted(counts.items(), reverse=True))] if counts else found


def improve(packed: list[tuple[Pattern, int]], size: int, low: int, work: Work, seed: int = 1) -> list[tuple[Pattern, int]]:
    """Empty the least filled sequences into the waste of others, a few at a time, by bin completion.

    Patterns are squeezed as often at once as all of a group are used, so one step may end many sequences.
    """
    rng, times = Random(seed), {}
    for p, t in packed:
        times[p] = times.get(p, 0) + t
    fill = {p: sum(n * c for n, c in p) for p in times}
    try:
        while sum(times.values()) > low:
            last = min(times, key=lambda p: (fill[p], p))
            others = [p for p in times if p != last and p[0][0] < size]
            wasting = [p for p in others if fill[p] < size]
            if not wasting:
                break
            weights = [size - fill[p] for p in wasting]
            for _ in range(200):
                if rng.random() < 0.5:
                    more = rng.choices(others, k=rng.randrange(1, 4))
                else:
                    more = rng.choices(wasting, weights, k=rng.randrange(1, 6))
                group = [*dict.fromkeys([rng.choice(wasting), *more]), last]
                own = Work(min(400, work.left))
                try:
                    new = _squeezed(group, size, own, int(rng.random() < 0.3))
                except _Spent:
                    new = None
                work.spend(405 - max(0, own.left))
                if new is None:
                    continue
                often = min(times[p] for p in group)
                for p in group:
                    times[p] -= often
                    if not times[p]:
                        del times[p]
                for p in new:
                    times[p] = times.get(p, 0) + often
                    fill[p] = sum(n * c for n, c in p)
                break
    except _Spent:
        pass
    return list(times.items())


def bin_completion(counts: dict[int, int], size: int, tree: int = 30_000, climb: int = 300_000) -> list[tuple[Pattern, int]]:
    """Pack ``counts`` items of each length into sequences of ``size``; as few as the search finds.

    Best-fit decreasing gives the incumbent; where it meets the lower bound, that is all. Else
    ``search_tree`` looks for less with ``tree`` nodes, which proves small cases, and ``improve`` then
    works on the incumbent with ``climb`` nodes. Both count nodes, so the search takes some seconds at most, on a
    histogram whose size does not depend on the rows.
    """
    counts = {n: c for n, c in counts.items() if c}
    best, low = best_fit(counts, size), lower_bound(counts, size)
    bins = sum(k for _, k in best)
    if bins <= low:
        return best
    found, proven = search_tree(counts, size, bins, low, Work(tree))
    best = found or best
    return best if proven else improve(best, size, low, Work(climb))


def runs(packed: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, end rank, in a sequence, first
    sequence, first offset). One entry for each length in each pattern: at most some 45 times the
    patterns, as more different lengths do not fit into 1024 tokens.
    """
    out, next_rank, sequence = [], {}, 0
    for pattern, times in packed:
        offset = 0
        for n, k in pattern:
            first = next_rank.get(n, 0)
            out.append((n, first, first + k * times, k, sequence, offset))
            next_rank[n] = first + k * times
            offset += k * n
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = 1024) -> DataFrame:
    """Pack all documents into as few sequences of at most ``size`` tokens as the search finds.

    A null or empty text is the end token alone. Only documents longer than ``size`` are cut. Repeated
    rows are packed each by itself. Only ``doc_id`` and ``text`` are read.

    The driver sees a histogram of at most ``size`` lengths, whatever the input, and solves that.
    Pieces are ranked among those of their length in hashed buckets, so one frequent length is dealt
    to all tasks, and look up their place in a table bounded by ``size`` (see ``runs``).
    """
    spark = docs.sparkSession
    ready(spark)
    same = F.when(F.col("doc_id").isNull(), F.floor(F.rand() * 4096))  # spreads rows without an id
    cut = materialize(pieces(docs, tokenizer, size).withColumn("_same", same), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    dealt = runs(bin_completion(counts, size)) or [(0, 0, 0, 1, 0, 0)]
    plan = local_table(spark, dealt, "length long, _first long, _end long, _k long, _sequence long, _offset long")
    rows = ranked(cut, "length", ["doc_id", "piece", "start", "ids_crc32", "_same"])
    put = rows.join(F.broadcast(plan), (rows["length"] == plan["length"]) & (rows["rank"] >= plan["_first"]) & (rows["rank"] < plan["_end"]))
    nth = F.col("rank") - F.col("_first")
    return put.select(
        "doc_id", "piece", "start", rows["length"], "ids_crc32",
        (F.col("_sequence") + F.floor(nth / F.col("_k"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_k") * rows["length"]).cast("long").alias("offset"),
    )
