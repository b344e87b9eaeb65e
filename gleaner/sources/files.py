"""Directories as rows: a data source that walks trees, and reads by byte range."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import FILES


class Folder(InputPartition):
    """A list of directories, each taken without its subdirectories."""

    def __init__(self, dirs: list[str]):
        super().__init__(dirs)
        self.dirs = dirs


class FilesSource(DataSource):
    """`files`: path, size, mtime, error of each regular file, hidden and empty ones too.

    Directories that cannot be listed are passed over.  Options: path; batch, the directories of one partition.
    """

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema):
        return FilesReader(self.options["path"], int(self.options.get("batch", 64)))


class FilesReader(DataSourceReader):
    def __init__(self, root: str, batch: int):
        self.root, self.batch = os.path.abspath(root), batch

    def partitions(self):
        dirs = [d for d, _, _ in os.walk(self.root)]
        return [Folder(dirs[k : k + self.batch]) for k in range(0, len(dirs), self.batch)] or [Folder([])]

    def read(self, partition):
        for d in partition.dirs:
            try:
                entries = sorted(os.scandir(d), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                try:
                    if not e.is_file():
                        continue
                    s = e.stat()
                    yield (e.path, s.st_size, dt.datetime.fromtimestamp(s.st_mtime), None)
                except OSError:
                    continue


def files(spark: SparkSession, root: str, batch: int = 64) -> DataFrame:
    spark.dataSource.register(FilesSource)
    return spark.read.format("files").option("path", root).option("batch", batch).load()


def count_files(spark: SparkSession, root: str) -> DataFrame:
    """dirs (root included), files, bytes: metadata alone."""
    n = sum(1 for _ in os.walk(root))
    return files(spark, root).agg(F.lit(n).cast("long").alias("dirs"), F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def read_range(path: str, start: int, length: int) -> bytes:
    """length bytes from start (from the end, if negative)."""
    with open(path, "rb") as f:
        f.seek(start if start >= 0 else max(0, os.fstat(f.fileno()).st_size + start))
        return f.read(length)


# ---- path safety on the host ------------------------------------------------------------


def has_link(path: str, root: str) -> bool:
    """Whether a component below root is a symbolic link."""
    rel = os.path.relpath(path, root)
    at = root
    for part in rel.split(os.sep):
        at = os.path.join(at, part)
        if os.path.islink(at):
            return True
    return False


def resolved(path: str) -> str:
    """The path with links of its deepest existing parent resolved."""
    tail, at = [], os.path.abspath(path)
    while not os.path.lexists(at) and os.path.dirname(at) != at:
        tail.append(os.path.basename(at))
        at = os.path.dirname(at)
    return os.path.join(os.path.realpath(at), *reversed(tail))


def is_within(root: str, path: str) -> bool:
    rel = os.path.relpath(path, root)
    return rel != ".." and not rel.startswith(".." + os.sep)


def check_roots(source: str, dest: str) -> None:
    if not source or not dest:
        raise ValueError("source and destination must be given")
    if os.path.islink(source) or not os.path.isdir(source):
        raise ValueError("the source must be a folder and no link")
    if os.path.exists(dest) and not os.path.isdir(dest):
        raise ValueError("the destination is a file")
    if is_within(resolved(source), resolved(dest)):
        raise ValueError("the destination lies in the source")


def nearest_folder(path: str) -> str:
    at = os.path.abspath(path)
    while not os.path.isdir(at):
        at = os.path.dirname(at)
    return at


def free_bytes(path: str) -> int:
    import shutil

    return shutil.disk_usage(nearest_folder(path)).free


def check_space(need: int, path: str, free=free_bytes) -> None:
    if need < 0:
        raise ValueError("negative size")
    if need > (have := free(path)):
        raise OSError(f"not enough space: {need} bytes needed, {have} available")
