"""Index jobs: full scans and batches of changed files, as one extraction and one global join."""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import RELATION_KEY, RELATIONS_HISTORY, RESOLUTION_VERSION, SYMBOLS_HISTORY, names
from ..operators import enrichment, reconcile, resolution
from ..operators.tables import written
from ..sources.repo import read_repo, with_hash
from .extract import broken, deferred_of, extract, relations_of, symbols_of
from .store import Store


@dataclass
class ScanResult:
    files_indexed: int
    files_failed: int
    symbols: int
    relations: int
    generation: int
    elapsed_seconds: float

    def as_dict(self) -> dict:
        return asdict(self)


def now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat()


def index_files(store: Store, files: DataFrame, observed_at: str | None = None, prune_inferred: bool = True, whole: bool = False) -> dict:
    """(Re)index ``files`` (path, source; a null source is a deleted file) in one batch and commit it.

    Files of a batch see each other's symbols. A file with a syntax error keeps what the index has of
    it. Only the batch's own outgoing edges are resolved; removed symbols lose their inbound edges from
    everywhere. ``whole``: what the store has of other files goes (a full scan). ``observed_at``: by default
    the present time. The result counts what was found, and what got a tombstone.
    """
    observed_at = observed_at or now()
    store.create()
    facts = written(extract(files.where("source IS NOT NULL"), observed_at))
    bad = broken(facts).select("path")
    paths = files.select("path").join(bad, "path", "left_anti")
    live, edges = store.read("symbols"), store.read("relations")
    if whole:
        paths = paths.unionByName(live.select("path").join(files.select("path"), "path", "left_anti")).distinct()
    paths = written(paths)
    new = symbols_of(facts)
    known = live.join(paths, "path", "left_anti").unionByName(new)
    resolved = relations_of(facts).unionByName(resolution.resolve(deferred_of(facts), known)).dropDuplicates(RELATION_KEY)
    sym, rel = reconcile.index_batch(live, edges, new, written(resolved), paths, observed_at, prune_inferred)
    start = store.meta()["history_id"]
    sym_told, rel_told = written(sym.appended), written(rel.appended)
    told = reconcile.numbered(sym_told, start, ["id"]).select(*names(SYMBOLS_HISTORY))
    told_edges = reconcile.numbered(rel_told, start + sym_told.count(), RELATION_KEY).select(*names(RELATIONS_HISTORY))
    state = store.read("file_state").join(paths, "path", "left_anti")
    if "mtime_ns" in files.columns:
        seen = with_hash(files.where("source IS NOT NULL")).join(paths, "path", "left_semi").select("path", "mtime_ns", "content_hash")
        state = state.unionByName(seen)
    meta = store.commit({"symbols": sym.live, "relations": rel.live, "file_state": state}, {"symbols_history": told, "relations_history": told_edges})
    failed, gone = bad.count(), [df.where("tombstone").count() for df in (sym_told, rel_told)]
    return {
        "generation": meta["generation"], "failed": failed, "indexed": files.where("source IS NOT NULL").count() - failed,
        "symbols": new.count(), "relations": resolved.count(), "symbols_tombstoned": gone[0], "relations_tombstoned": gone[1],
    }


def scan(store: Store, root: str, observed_at: str | None = None) -> ScanResult:
    """A full scan of a repository, with the enrichment that needs no other tool."""
    began, observed_at = time.monotonic(), observed_at or now()
    files = written(read_repo(store.spark, root))
    got = index_files(store, files, observed_at, whole=True)
    enrich(store, files, observed_at)
    meta = store.commit({}, {}, bump=False, cross_file_pass_version=RESOLUTION_VERSION)
    return ScanResult(got["indexed"], got["failed"], got["symbols"], got["relations"], meta["generation"], round(time.monotonic() - began, 3))


def enrich(store: Store, files: DataFrame, observed_at: str | None, locations: DataFrame | None = None, provider: tuple[str, str] = ("lsp", "0")) -> None:
    """Stub calls, mixin calls, and answers of a definition provider if given, merged into the live edges.

    The generation stays, so cursors survive, as do rows that outrank what a pass finds.
    """
    observed_at = observed_at or now()
    symbols, live = store.read("symbols"), store.read("relations")
    facts = written(extract(files.where("source IS NOT NULL"), observed_at))
    stubs = enrichment.stub_calls(symbols, live, observed_at)
    merged = written(enrichment.merge(live, stubs, preserve_siblings=True))
    sites = enrichment.worklist(merged, deferred_of(facts), symbols, relations_of(facts)).where("kind = 'mixin'")
    merged = written(enrichment.merge(merged, enrichment.mixin_calls(sites, symbols, merged, observed_at)))
    if locations is not None:
        merged = enrichment.merge(merged, enrichment.from_locations(locations, symbols, *provider, observed_at))
    fresh = written(merged.join(live.select(*RELATION_KEY), RELATION_KEY, "left_anti").withColumn("tombstone", F.lit(False)))
    appended = reconcile.numbered(fresh, store.meta()["history_id"], RELATION_KEY).select(*names(RELATIONS_HISTORY))
    store.commit({"relations": merged}, {"relations_history": appended}, bump=False)
