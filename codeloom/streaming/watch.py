"""From file events to reindexed files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from ..sources.ignore import Rule, ignored
from ..sources.ignore import rules as compiled

EVENTS = "ts timestamp, worktree_id string, event string, path string"
DEBOUNCE = "500 milliseconds"
QUIET_MS, LONGEST_MS = 30_000, 300_000


def relevant(events: DataFrame, rules: list[Rule] = ()) -> DataFrame:
    """Events of Python files that no rule ignores."""
    return events.where(F.endswith("path", F.lit(".py")) & ~ignored("path", list(rules)))


def debounced(events: DataFrame, gap: str = DEBOUNCE, late: str | None = "10 seconds") -> DataFrame:
    """``worktree_id, start, last, paths``: the distinct paths of each burst of a worktree's events.

    A burst ends with a pause longer than ``gap``. On a stream in append mode it is emitted once the watermark has
    passed it; a trailing burst waits for a later event.
    """
    timed = events.withWatermark("ts", late) if late is not None else events
    grouped = timed.groupBy("worktree_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("last")).select("worktree_id", F.col("w.start").alias("start"), "last", "paths", "n_events")


def decision(seen: Column, exists: Column, mtime: Column, hash_: Column, old_mtime: Column, old_hash: Column) -> Column:
    """What a touched file needs: tombstone, nothing, refresh (of its state only) or reindex."""
    return (
        F.when(~exists, F.when(seen, "tombstone").otherwise("nothing"))
        .when(seen & (mtime == old_mtime), "nothing")
        .when(seen & (hash_ == old_hash), "refresh")
        .otherwise("reindex")
    )


def decide(touched: DataFrame, state: DataFrame) -> DataFrame:
    """``path, action`` for touched files (path, exists, mtime_ns, content_hash) by the recorded state."""
    old = state.select("path", F.col("mtime_ns").alias("old_mtime"), F.col("content_hash").alias("old_hash"), F.lit(True).alias("seen"))
    both = touched.join(old, "path", "left")
    return both.select("path", decision(F.coalesce("seen", F.lit(False)), F.col("exists"), F.col("mtime_ns"), F.col("content_hash"), F.col("old_mtime"), F.col("old_hash")).alias("action"))


def trigger_times(edits: DataFrame, quiet_ms: int = QUIET_MS, longest_ms: int = LONGEST_MS) -> DataFrame:
    """``key, fired_ms, first_ms, n_edits`` of (key, at_ms): when the edits of a key set off an enrichment.

    It fires ``quiet_ms`` after the last edit, but ``longest_ms`` after the first at the latest; an edit
    at or after that instant, if it came before the pause ended, is absorbed by that firing. A pause of
    ``quiet_ms`` always ends a firing, so edits are cut there first, by window functions; only what lies
    between two pauses is gone through in order, as a stream of sorted batches.
    """
    ship(edits.sparkSession)
    in_order = Window.partitionBy("key").orderBy("at_ms")
    fresh = F.coalesce((F.col("at_ms") - F.lag("at_ms").over(in_order) >= quiet_ms).cast("long"), F.lit(1))
    cut = edits.select("key", "at_ms").withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    long_ = Window.partitionBy("key", "run")
    cut = cut.withColumns({"first_ms": F.min("at_ms").over(long_), "last_ms": F.max("at_ms").over(long_)})
    short = cut.where(F.col("last_ms") < F.col("first_ms") + longest_ms)  # one firing
    whole = short.groupBy("key", "run").agg(F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"), F.count(F.lit(1)).alias("n_edits"))
    whole = whole.select("key", F.least(F.col("last_ms") + quiet_ms, F.col("first_ms") + longest_ms).alias("fired_ms"), "first_ms", "n_edits")
    ordered = cut.where(F.col("last_ms") >= F.col("first_ms") + longest_ms).select("key", "run", "at_ms").repartition("key", "run").sortWithinPartitions("key", "run", "at_ms")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None  # key and run, first, last, edits
        for pdf in batches:
            out = []
            for key, n, at in zip(pdf["key"].tolist(), pdf["run"].tolist(), pdf["at_ms"].tolist()):
                if now is not None and now[0] == (key, n) and now[2] < now[1] + longest_ms:
                    now = (now[0], now[1], at, now[3] + 1)
                    continue
                if now is not None:
                    out.append((now[0][0], fires(now[1], now[2], quiet_ms, longest_ms), now[1], now[3]))
                now = ((key, n), at, at, 1)
            yield pd.DataFrame(out, columns=["key", "fired_ms", "first_ms", "n_edits"])
        if now is not None:
            yield pd.DataFrame([(now[0][0], fires(now[1], now[2], quiet_ms, longest_ms), now[1], now[3])], columns=["key", "fired_ms", "first_ms", "n_edits"])

    kind = edits.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind), *[T.StructField(c, T.LongType()) for c in ("fired_ms", "first_ms", "n_edits")]])
    return whole.unionByName(ordered.mapInPandas(run, schema))


def fires(first: int, last: int, quiet_ms: int, longest_ms: int) -> int:
    return max(last, min(last + quiet_ms, first + longest_ms))


def trigger_stream(edits: DataFrame, quiet_ms: int = QUIET_MS, longest_ms: int = LONGEST_MS) -> DataFrame:
    """The same for a stream of (key string, at timestamp), in processing time: a row for each firing."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "first_ms": [first], "last_ms": [last], "n_edits": [n]})
            return
        now = state.getCurrentProcessingTimeMs()
        first, n = (state.get[0], state.get[2]) if state.exists else (now, 0)
        n += sum(len(b) for b in batches)
        state.update((first, now, n))
        state.setTimeoutDuration(max(1, min(quiet_ms, first + longest_ms - now)))
        yield from ()

    return edits.groupBy("key").applyInPandasWithState(step, "key string, first_ms long, last_ms long, n_edits long", "first long, last long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def burst_stream(events: DataFrame, gap_ms: int = 500) -> DataFrame:
    """``worktree_id, paths, n_events``: each burst of a worktree's events once ``gap_ms`` of processing time have
    passed without another one, so a trailing burst waits for no later event.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            paths, n = state.get
            state.remove()
            yield pd.DataFrame({"worktree_id": [key[0]], "paths": [list(paths)], "n_events": [n]})
            return
        paths, n = (set(state.get[0]), state.get[1]) if state.exists else (set(), 0)
        for b in batches:
            paths |= set(b["path"])
            n += len(b)
        state.update((sorted(paths), n))
        state.setTimeoutDuration(gap_ms)
        yield from ()

    return events.groupBy("worktree_id").applyInPandasWithState(step, "worktree_id string, paths array<string>, n_events long", "paths array<string>, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def reindexer(store, root: str, observed_at=None, rules: list[Rule] | None = None):
    """A ``foreachBatch`` function: the batch's changed files, read now, go through one index job.

    Replayed or repeated events find the file's time or digest unchanged and do nothing. Without ``rules``,
    the tree's own rule files count; they are read at the first batch, and again when an event names one.
    """
    from ..plans.upkeep import refresh
    from ..sources.repo import ignore_files

    chosen = {"rules": rules}

    def run(batch: DataFrame, epoch: int) -> None:
        if chosen["rules"] is None or rules is None and not batch.where(F.col("path").rlike(r"(^|/)\.gitignore$")).isEmpty():
            chosen["rules"] = compiled(ignore_files(root))
        paths = [r["path"] for r in relevant(batch, chosen["rules"]).select("path").distinct().collect()]  # of one micro-batch
        refresh(store, root, paths, observed_at() if callable(observed_at) else observed_at, prune_inferred=True)

    return run


def worktree_reindexer(worktrees: dict[str, tuple[object, str]], observed_at=None):
    """A ``foreachBatch`` function for events of several worktrees (id -> store and root), each by its own
    ``reindexer``, one after the other: a worktree's changes are committed in the order of their batches.
    Events of unknown worktrees do nothing.
    """
    each = {name: reindexer(store, root, observed_at) for name, (store, root) in worktrees.items()}

    def run(batch: DataFrame, epoch: int) -> None:
        for name in sorted(each):
            each[name](batch.where(F.col("worktree_id") == name), epoch)

    return run


def enricher(worktrees: dict[str, tuple[object, str]], observed_at=None):
    """A ``foreachBatch`` function for the firings of ``trigger_stream``: the named worktrees are enriched, if they
    have changed since they last were.
    """
    from ..plans.upkeep import enrich_if_changed

    def run(batch: DataFrame, epoch: int) -> None:
        fired = {r["key"] for r in batch.select("key").distinct().collect()}  # worktrees of one micro-batch
        for name in sorted(fired & set(worktrees)):
            store, root = worktrees[name]
            enrich_if_changed(store, root, observed_at() if callable(observed_at) else observed_at)

    return run
