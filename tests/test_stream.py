"""Streams run to their end, and their batch forms."""

import datetime as dt
import json
import os
import random

from codeloom.plans.store import Store
from codeloom.sources.ignore import rules
from codeloom.streaming import watch
from pyspark.sql import functions as F


def drop(folder, name, rows):
    with open(f"{folder}/{name}.json", "w") as f:
        f.writelines(json.dumps(dict(zip(("ts", "worktree_id", "event", "path"), (r[0].isoformat(), *r[1:])))) + "\n" for r in rows)


def test_debounced_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    ms = lambda n: t + dt.timedelta(milliseconds=n)
    src = tmp_path / "in"
    src.mkdir()
    drop(src, "1", [(ms(0), "w", "modified", "a.py"), (ms(200), "w", "modified", "b.py"), (ms(300), "w", "modified", "a.py"), (ms(100), "v", "created", "c.py"), (ms(150), "w", "modified", "skip.py"), (ms(160), "w", "modified", "x.txt")])
    drop(src, "2", [(ms(5000), "w", "deleted", "a.py"), (ms(60000), "w", "modified", "z.py"), (ms(60000), "v", "modified", "z.py")])
    events = watch.relevant(spark.readStream.schema(watch.EVENTS).option("maxFilesPerTrigger", 1).json(str(src)), rules([("", "skip.py")]))
    q = watch.debounced(events, late="1 second").writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["worktree_id"], tuple(r["paths"])) for r in spark.table("bursts").collect()}
    assert got == {("w", ("a.py", "b.py")), ("v", ("c.py",)), ("w", ("a.py",))}


def test_a_pause_longer_than_the_gap_splits(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(milliseconds=n), "w", "m", f"{n}.py") for n in (0, 500, 1001, 1498)]
    got = watch.debounced(spark.createDataFrame(rows, watch.EVENTS), late=None).orderBy("start").collect()
    assert [r["n_events"] for r in got] == [2, 2]


def test_trigger_times_against_a_loop(spark):
    rnd = random.Random(3)
    rows, want = [], []
    for key in "abc":
        at, now = 0, None
        for _ in range(80):
            at += rnd.choice([1_000, 9_000, 29_999, 30_000, 31_000])
            rows.append((key, at))
            if now and at - now[1] < 30_000 and now[1] < now[0] + 300_000:
                now = (now[0], at, now[2] + 1)
            else:
                if now:
                    want.append((key, *now))
                now = (at, at, 1)
        want.append((key, *now))
    got = watch.trigger_times(spark.createDataFrame(rows, "key string, at_ms long")).collect()
    assert sorted((r["key"], r["first_ms"], r["n_edits"]) for r in got) == sorted((k, f, n) for k, f, _, n in want)
    for r in got:
        assert r["fired_ms"] - r["first_ms"] <= 300_000 + 30_000


def test_trigger_stream_fires_after_a_pause(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("".join(json.dumps({"key": "w", "at": "2024-01-01T00:00:00"}) + "\n" for _ in range(3)))
    edits = spark.readStream.schema("key string, at timestamp").json(str(src))
    q = watch.trigger_stream(edits, quiet_ms=300, longest_ms=2000).writeStream.outputMode("append").format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            if spark.table("fired").count():
                break
            q.awaitTermination(0.5)
        (src / "2.json").write_text('{"key": "w", "at": "2024-01-01T00:00:09"}\n')
        rows = spark.table("fired").collect()
        assert [(r["key"], r["n_edits"]) for r in rows][:1] == [("w", 3)]
    finally:
        q.stop()


def test_decisions(spark):
    state = spark.createDataFrame([("same", 1, "h"), ("touched", 1, "h"), ("edited", 1, "h"), ("gone", 1, "h")], "path string, mtime_ns long, content_hash string")
    now = spark.createDataFrame([("same", True, 1, "h"), ("touched", True, 2, "h"), ("edited", True, 2, "i"), ("gone", False, None, None), ("never", False, None, None), ("new", True, 1, "h")], "path string, exists boolean, mtime_ns long, content_hash string")
    assert {r["path"]: r["action"] for r in watch.decide(now, state).collect()} == {"same": "nothing", "touched": "refresh", "edited": "reindex", "gone": "tombstone", "never": "nothing", "new": "reindex"}


def test_changed_files_are_reindexed(spark, tmp_path):
    root, src = tmp_path / "repo", tmp_path / "in"
    root.mkdir()
    src.mkdir()
    store = Store(spark, f"file://{tmp_path}/index")
    store.create()
    run = watch.reindexer(store, str(root), "t")

    def send(name, *paths):
        drop(src, name, [(dt.datetime(2024, 1, 1), "w", "modified", p) for p in paths])
        q = spark.readStream.schema(watch.EVENTS).json(str(src)).writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return {r["id"] for r in store.read("symbols").collect()}

    (root / "m.py").write_text("def f(): pass\n")
    assert send("1", "m.py", "notes.txt") == {"m.py:#module", "m.py:f#function"}
    generation = store.meta()["generation"]
    assert send("2", "m.py") and store.meta()["generation"] == generation
    os.utime(root / "m.py", ns=(1, 1))
    send("3", "m.py")
    assert store.meta()["generation"] == generation and store.read("file_state").select(F.max("mtime_ns")).collect()[0][0] == 1
    (root / "m.py").rename(root / "n.py")
    assert send("4", "m.py", "n.py") == {"n.py:#module", "n.py:f#function"}


def test_watched_folder(spark, tmp_path):
    """Creations, changes, a move and a deletion, each poll a numbered step; a restart goes on where it was."""
    from codeloom.sources.watching import watch_files

    root, state, cp = tmp_path / "repo", tmp_path / "state", tmp_path / "cp"
    root.mkdir()
    seen, done = [], set()

    def keep(batch, epoch):
        seen.extend((r["event"], r["path"]) for r in batch.collect())

    def poll():
        seen.clear()
        q = watch_files(spark, str(root), str(state), "w").writeStream.foreachBatch(keep).option("checkpointLocation", str(cp)).trigger(processingTime="200 milliseconds").start()
        try:
            for _ in range(40):
                if seen:
                    break
                q.awaitTermination(0.25)
        finally:
            q.stop()
        done.update(seen)
        return sorted(seen)

    (root / "a.py").write_text("x = 1\n")
    (root / "sub").mkdir()
    (root / "sub" / "b.py").write_text("y = 1\n")
    assert poll() == [("created", "a.py"), ("created", "sub/b.py")]
    os.utime(root / "a.py", ns=(5, 5))
    (root / "sub" / "b.py").rename(root / "c.py")
    assert poll() == [("created", "c.py"), ("deleted", "sub/b.py"), ("modified", "a.py")]


def test_trailing_burst_needs_no_later_event(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    drop(src, "1", [(dt.datetime(2024, 1, 1), "w", "modified", p) for p in ("b.py", "a.py", "b.py")])
    events = spark.readStream.schema(watch.EVENTS).json(str(src))
    q = watch.burst_stream(events, 300).writeStream.outputMode("append").format("memory").queryName("trailing").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(80):
            if spark.table("trailing").count():
                break
            q.awaitTermination(0.5)
        assert [(r["worktree_id"], r["paths"], r["n_events"]) for r in spark.table("trailing").collect()] == [("w", ["a.py", "b.py"], 3)]
    finally:
        q.stop()


def test_worktrees_and_enrichment_of_a_batch(spark, tmp_path):
    trees = {}
    for name in ("v", "w"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.py").write_text(f"def {name}(): pass\n")
        trees[name] = (Store(spark, f"file://{tmp_path}/index-{name}"), str(tmp_path / name))
        trees[name][0].create()
    rows = [(dt.datetime(2024, 1, 1), t, "modified", "m.py") for t in ("v", "w", "unknown")]
    watch.worktree_reindexer(trees, "t")(spark.createDataFrame(rows, watch.EVENTS), 0)
    assert {r["id"] for s, _ in trees.values() for r in s.read("symbols").where("kind = 'function'").collect()} == {"m.py:v#function", "m.py:w#function"}
    watch.enricher(trees, "t")(spark.createDataFrame([("w",), ("unknown",)], "key string"), 0)
    assert trees["w"][0].meta()["generation"] == 1
