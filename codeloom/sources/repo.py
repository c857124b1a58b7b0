"""Source trees as tables of (path, source)."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..ship import ship
from .ignore import is_ignored, rules

SCHEMA = "path string, source string, mtime_ns long"
PER_TASK = 256


def ignore_files(root: str) -> list[tuple[str, str]]:
    out = []
    for folder, inner, files in os.walk(root):
        inner[:] = [d for d in inner if d != ".git"]
        if ".gitignore" in files:
            at = os.path.relpath(folder, root).replace(os.sep, "/")
            try:
                with open(os.path.join(folder, ".gitignore"), encoding="utf-8") as f:
                    out.append(("" if at == "." else at, f.read()))
            except (OSError, UnicodeDecodeError):
                continue
    return out


def list_files(root: str, path_glob: str | None = None) -> list[str]:
    """Python files below ``root``; dot folders and ignored folders are not entered."""
    chosen, out = rules(ignore_files(root)), []
    for folder, inner, files in os.walk(root):
        at = os.path.relpath(folder, root).replace(os.sep, "/")
        at = "" if at == "." else at + "/"
        inner[:] = [d for d in inner if d[0] != "." and not is_ignored(at + d, chosen) and not is_ignored(at + d + "/", chosen)]
        out += [at + f for f in files if f.endswith(".py") and not is_ignored(at + f, chosen) and (path_glob is None or fnmatch.fnmatchcase(at + f, path_glob))]
    return sorted(out)


class Part(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class RepoReader(DataSourceReader):
    def __init__(self, root: str, path_glob: str | None, paths: list[str] | None):
        self.root, self.path_glob, self.paths = root, path_glob, paths

    def partitions(self) -> list[Part]:
        found = list_files(self.root, self.path_glob)
        if self.paths is not None:
            wanted = set(self.paths)
            found = [p for p in found if p in wanted]
        return [Part(found[i : i + PER_TASK]) for i in range(0, len(found), PER_TASK)] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        base = os.path.realpath(self.root)
        for path in partition.paths:
            full = os.path.join(base, path)
            if not os.path.realpath(full).startswith(base + os.sep):
                continue
            try:
                with open(full, "rb") as f:
                    yield path, f.read().decode("utf-8"), os.stat(full).st_mtime_ns
            except (OSError, UnicodeDecodeError):  # unreadable files are left out
                continue


class RepoSource(DataSource):
    """``spark.read.format("pyrepo").load(root)``: Spark's own file sources hide names like ``__init__.py``.

    Files are listed by the driver and read by the tasks, PER_TASK in each, so ``root`` is a folder that
    all executors share. Options: ``path_glob``; ``only``, paths separated by line ends.
    """

    @classmethod
    def name(cls) -> str:
        return "pyrepo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepoReader:
        paths = self.options.get("only")
        return RepoReader(self.options["path"], self.options.get("path_glob"), paths.split("\n") if paths is not None else None)


def read_repo(spark: SparkSession, root: str, path_glob: str | None = None, paths: list[str] | None = None) -> DataFrame:
    ship(spark)
    spark.dataSource.register(RepoSource)
    reader = spark.read.format("pyrepo")
    if path_glob is not None:
        reader = reader.option("path_glob", path_glob)
    if paths is not None:
        reader = reader.option("only", "\n".join(paths))
    return reader.load(root)


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.sha2("source", 256))


def to_repo_relative(root: str, path: str) -> str | None:
    """``path`` below ``root`` with ``/``, or None where it leads out."""
    full = os.path.normpath(path if os.path.isabs(path) else os.path.join(root, path))
    at = os.path.relpath(full, os.path.normpath(root)).replace(os.sep, "/")
    return None if at == ".." or at.startswith("../") else at
