"""A streaming source of file changes below a folder, by polling."""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..ship import ship

SCHEMA = "ts timestamp, worktree_id string, event string, path string"


def listing(root: str) -> dict[str, int]:
    """Path -> time of every file below ``root``, without ``.git``."""
    out = {}
    for folder, inner, files in os.walk(root):
        inner[:] = [d for d in inner if d != ".git"]
        for f in files:
            full = os.path.join(folder, f)
            try:
                out[os.path.relpath(full, root).replace(os.sep, "/")] = os.stat(full).st_mtime_ns
            except OSError:  # gone meanwhile
                continue
    return out


def differences(old: dict[str, int], new: dict[str, int]) -> list[tuple[str, str]]:
    """(event, path); a move is a deletion and a creation, and folders are no events of their own."""
    gone = [("deleted", p) for p in old if p not in new]
    return sorted([*gone, *(("created" if p not in old else "modified", p) for p, t in new.items() if old.get(p) != t)])


class ChangeReader(SimpleDataSourceStreamReader):
    """Each poll that finds a difference is one numbered file in ``state``: its events and the new listing, so
    a batch can be read again after a failure. The first poll reports all files as created, unless ``existing`` is
    false.
    """

    def __init__(self, root: str, state: str, worktree_id: str, existing: bool):
        self.root, self.state, self.worktree_id, self.existing = root, state, worktree_id, existing

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _file(self, n: int) -> str:
        return os.path.join(self.state, f"{n}.json")

    def _at(self, n: int) -> dict:
        if n == 0:
            return {"events": [], "listing": {}}
        with open(self._file(n), encoding="utf-8") as f:
            return json.load(f)

    def _rows(self, n: int) -> list[tuple]:
        found = self._at(n)
        return [(dt.datetime.fromisoformat(found["ts"]), self.worktree_id, event, path) for event, path in found["events"]]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = start["n"]
        if not os.path.exists(self._file(n + 1)):
            new = listing(self.root)
            found = differences(self._at(n)["listing"], new)
            if not found:
                return iter([]), start
            if n == 0 and not self.existing:
                found = []
            os.makedirs(self.state, exist_ok=True)
            fresh = self._file(n + 1) + f".{uuid.uuid4().hex}"
            with open(fresh, "w", encoding="utf-8") as f:
                json.dump({"ts": dt.datetime.now().isoformat(), "events": found, "listing": new}, f)
            os.replace(fresh, self._file(n + 1))
        return iter(self._rows(n + 1)), {"n": n + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([row for n in range(start["n"] + 1, end["n"] + 1) for row in self._rows(n)])

    def commit(self, end: dict) -> None:
        for n in range(end["n"] - 1, 0, -1):  # those before the last two are never asked for again
            if n < end["n"] - 1 and os.path.exists(self._file(n)):
                os.remove(self._file(n))


class WatchSource(DataSource):
    """``spark.readStream.format("pywatch")``: options ``path`` (the root), ``state`` (a folder for offsets),
    ``worktree_id`` and ``existing``.
    """

    @classmethod
    def name(cls) -> str:
        return "pywatch"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> ChangeReader:
        o = self.options
        return ChangeReader(o["path"], o["state"], o.get("worktree_id", ""), o.get("existing", "true") == "true")


def watch_files(spark: SparkSession, root: str, state: str, worktree_id: str = "", existing: bool = True) -> DataFrame:
    """Changes below ``root`` as a stream of ``ts, worktree_id, event, path``; ``state`` is a local folder of the driver."""
    ship(spark)
    spark.dataSource.register(WatchSource)
    reader = spark.readStream.format("pywatch").option("state", state).option("worktree_id", worktree_id).option("existing", str(existing).lower())
    return reader.load(root)
