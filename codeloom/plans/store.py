"""Snapshots of an index: immutable tables in version folders, and one pointer."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..model import FILE_STATE, RELATIONS, RELATIONS_HISTORY, RESOLUTION_VERSION, SYMBOLS, SYMBOLS_HISTORY, IndexNotReady

TABLES = {"symbols": SYMBOLS, "relations": RELATIONS, "symbols_history": SYMBOLS_HISTORY, "relations_history": RELATIONS_HISTORY, "file_state": FILE_STATE}
APPENDED = ("symbols_history", "relations_history")
#: What a new index begins with; also the values of keys that an older pointer lacks.
FRESH = {"generation": 0, "head_sha": None, "cross_file_pass_version": 0, "last_enrichment_fingerprint": None, "history_id": 0}
#: Columns that came later, with the value that rows of older folders get.
ADDED = {"symbols": {"is_stub": False}}
KEPT = 3  # pointers that stay, for readers that have just listed them


class ConcurrentCommit(RuntimeError):
    """Another writer has committed since the snapshot was read."""


class Store:
    """The index of one worktree in ``root``, a folder of any file system that Spark reaches.

    A commit writes new folders and then a pointer of the next number, so readers see all of a commit or nothing of
    it. History tables are lists of folders that only grow.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        fs, top = self._fs(), self._path("")
        if not fs.exists(top):
            return []
        names = (x.getPath().getName() for x in fs.listStatus(top))
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"current-(\d+)\.json", n)))

    def pointer(self) -> dict | None:
        """The newest commit; its number is ``commit``."""
        fs, numbers = self._fs(), self._pointers()
        if not numbers:
            return None
        stream = fs.open(self._path(f"current-{numbers[-1]}.json"))
        try:
            found = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return {**FRESH, **found, "folders": {**{t: [] for t in TABLES}, **found["folders"]}, "commit": numbers[-1]}

    def _point(self, to: dict) -> None:
        """Make ``to`` the commit after the one that it was made from. The pointer is written aside and renamed
        into a name that must be free: so a reader sees one of both, a crash leaves the old one, and of two
        writers the second fails.
        """
        fs, number = self._fs(), to.get("commit", 0) + 1
        fresh, target = self._path(f".fresh-{uuid.uuid4().hex}.json"), self._path(f"current-{number}.json")
        out = fs.create(fresh, True)
        out.write(json.dumps({k: v for k, v in to.items() if k != "commit"}).encode())
        out.close()
        if fs.exists(target) or not fs.rename(fresh, target):
            fs.delete(fresh, False)
            raise ConcurrentCommit(f"commit {number} of {self.root} was made by another writer")
        for old in self._pointers()[:-KEPT]:
            fs.delete(self._path(f"current-{old}.json"), False)

    def ready(self) -> bool:
        return self.pointer() is not None

    def create(self) -> None:
        if not self.ready():
            self._point({**FRESH, "folders": {t: [] for t in TABLES}})

    def meta(self) -> dict:
        found = self.pointer()
        if found is None:
            raise IndexNotReady("no index has been built")
        return found

    def read(self, table: str) -> DataFrame:
        folders = self.meta()["folders"][table]
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        found = self.spark.read.schema(TABLES[table]).parquet(*[f"{self.root}/{f}" for f in folders])
        return found.fillna(ADDED.get(table, {})) if table in ADDED else found

    def commit(self, live: dict[str, DataFrame], appended: dict[str, DataFrame], bump: bool = True, **meta) -> dict:
        """Replace tables by ``live`` and extend histories by ``appended`` (with history ids)."""
        now = self.meta()
        new = {**now, **meta, "folders": dict(now["folders"])}
        tag = uuid.uuid4().hex[:12]
        for name, df in live.items():
            df.write.parquet(f"{self.root}/{name}-{tag}")
            new["folders"][name] = [f"{name}-{tag}"]
        for name, df in appended.items():
            df.write.parquet(f"{self.root}/{name}-{tag}")
            new["folders"][name] = [*now["folders"][name], f"{name}-{tag}"]
            last = self.spark.read.parquet(f"{self.root}/{name}-{tag}").agg({"history_id": "max"}).collect()[0][0]
            new["history_id"] = max(new["history_id"], last or 0)
        new["generation"] = now["generation"] + bool(bump)
        self._point(new)
        return self.meta()

    def needs_resolution(self) -> bool:
        return self.meta()["cross_file_pass_version"] < RESOLUTION_VERSION

    def clone(self, root: str) -> Store:
        """The same snapshot for another worktree."""
        out = Store(self.spark, root)
        out.create()
        out.commit({t: self.read(t) for t in TABLES if t not in APPENDED}, {t: self.read(t) for t in APPENDED}, bump=False)
        mine = self.meta()
        out._point({**out.meta(), **{k: mine[k] for k in ("generation", "head_sha", "cross_file_pass_version", "last_enrichment_fingerprint")}})
        return out
