"""Keeping an index current: freshness before a query, worktree seeding, catch-up passes, hooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import RESOLUTION_VERSION
from ..operators.tables import written
from ..sources import git
from ..sources.hooks import touched
from ..sources.repo import read_repo, with_hash
from ..streaming.watch import decide
from .index import enrich, index_files, scan
from .store import Store


def freshness_target(method: str, params: dict) -> str | None:
    """The one file whose staleness a query would show, if its parameters name one."""
    if method == "list_imports":
        found = params.get("file")
    elif method in ("get_definition", "find_references") and isinstance(params.get("position"), dict):
        found = params["position"].get("file")
    else:
        return None
    return found if isinstance(found, str) else None


def refresh(store: Store, root: str, paths: list[str], observed_at: str | None, prune_inferred: bool = False) -> int:
    """Bring the given files up to date; the number of files that were indexed again.

    Files whose time or digest is as recorded cost nothing more; missing ones lose their symbols.
    Inferred relations stay by default, as enrichment does not run here.
    """
    spark = store.spark
    if not paths:
        return 0
    found = written(with_hash(read_repo(spark, root, paths=paths)))
    asked = spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string")
    seen = asked.join(found.withColumn("exists", F.lit(True)), "path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    known = store.read("file_state")
    unrecorded = store.read("symbols").select("path").distinct().join(known, "path", "left_anti")  # indexed without a state
    state = known.unionByName(unrecorded.select("path", F.lit(-1).cast("long").alias("mtime_ns"), F.lit("").alias("content_hash")))
    todo = written(decide(seen, state))
    files = written(todo.where("action IN ('reindex', 'tombstone')").join(found, "path", "left").select("path", "source", "mtime_ns"))
    fresh = written(todo.where("action = 'refresh'").join(found, "path").select("path", "mtime_ns", "content_hash"))
    n = files.count()
    if n:
        index_files(store, files, observed_at, prune_inferred)
    if not fresh.isEmpty():
        store.commit({"file_state": store.read("file_state").join(fresh.select("path"), "path", "left_anti").unionByName(fresh)}, {}, bump=False)
    return n


def seed_worktree(primary: Store, primary_root: str, target: str, root: str, observed_at: str) -> Store:
    """An index for a linked worktree: the primary's snapshot, then what differs on either side."""
    store = primary.clone(target)
    since = primary.meta()["head_sha"] or "HEAD"
    seeded = [r["path"] for r in primary.read("symbols").select("path").distinct().collect()]  # the file list of one repository
    here, there = git.changed_paths(root, since, seeded), git.changed_paths(primary_root, since)
    if here is None or there is None:
        scan(store, root, observed_at)
    else:
        refresh(store, root, [p for p in {*here, *there} if p.endswith(".py")], observed_at, prune_inferred=True)
    remember_head(store, root)
    return store


def remember_head(store: Store, root: str) -> None:
    """Record the repository's commit; where version control tells none, the recorded one stays."""
    if (found := git.head_sha(root)) is not None:
        store.commit({}, {}, bump=False, head_sha=found)


def catch_up(store: Store, root: str, observed_at: str) -> bool:
    """Run the global resolution again if the index was made by an older version of it."""
    if not store.needs_resolution():
        return False
    files = written(read_repo(store.spark, root))
    index_files(store, files, observed_at)
    store.commit({}, {}, bump=False, cross_file_pass_version=RESOLUTION_VERSION)
    return True


def enrich_if_changed(store: Store, root: str, observed_at: str | None, locations: DataFrame | None = None) -> bool:
    """Enrich if the repository's fingerprint is not that of the last enrichment."""
    mark = git.fingerprint(root)
    if mark is not None and mark == store.meta()["last_enrichment_fingerprint"]:
        return False
    enrich(store, written(read_repo(store.spark, root)), observed_at, locations)
    store.commit({}, {}, bump=False, last_enrichment_fingerprint=mark)
    return True


def notify(store: Store, root: str, agent: str, payload: str, observed_at: str) -> int:
    """A hook's call: the files it names, or for ``git`` those that changed since the recorded commit."""
    if agent == "git":
        since = store.meta()["head_sha"]
        paths = git.changed_paths(root, since) if since else None
        n = refresh(store, root, [p for p in paths or () if p.endswith(".py")], observed_at)
        remember_head(store, root)
        return n
    named = touched(store.spark.createDataFrame([(agent, payload)], "agent string, payload string"))
    return refresh(store, root, [r["path"] for r in named.collect()], observed_at)
