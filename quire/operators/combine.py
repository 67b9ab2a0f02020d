"""Bag union of same-schema chunks, in memory or by appending to a sink."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def union_chunks(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; schemas must agree (a chunk with other columns
    is an error, as a fixed writer schema would be)."""
    if not frames:
        raise ValueError("no chunks")
    return reduce(lambda a, b: a.unionByName(b), frames)


def append_chunks(frames: Sequence[DataFrame], path: str, *, fmt: str = "parquet",
                  options: dict[str, str] | None = None) -> str:
    """Write all chunks, in order, as one output that replaces the target. The
    first chunk fixes the columns and types; a chunk that differs is an error
    before anything is written.

    The chunks go to a staging folder beside the target, in one job; one commit
    step then puts the folder in the target's place. A chunk that fails while it
    runs leaves the target as it was.
    """
    if not frames:
        raise ValueError("no chunks")
    fixed = dict(frames[0].dtypes)
    for i, df in enumerate(frames[1:], 2):
        if dict(df.dtypes) != fixed:
            raise ValueError(f"chunk {i} has columns {df.dtypes}, the first chunk {frames[0].dtypes}")
    stage = Staging(frames[0].sparkSession, path)
    try:
        union_chunks(frames).write.options(**(options or {})).format(fmt).save(stage.folder)
    except BaseException:
        stage.abort()
        raise
    stage.commit()
    return path


class Staging:
    """A folder beside ``path`` that takes its place on ``commit``: the file
    system's renames, so readers see the old output or the new one."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        mark = uuid.uuid4().hex[:12]
        self.target, self.folder, self.old = path, f"{path.rstrip('/')}.staging-{mark}", f"{path.rstrip('/')}.old-{mark}"
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _rename(self, a: str, b: str) -> None:
        if not self._fs.rename(self._path(a), self._path(b)):
            raise OSError(f"could not rename {a} to {b}")

    def commit(self) -> None:
        had = self._fs.exists(self._path(self.target))
        if had:
            self._rename(self.target, self.old)
        try:
            self._rename(self.folder, self.target)
        except BaseException:
            if had:
                self._rename(self.old, self.target)
            raise
        if had:
            self._fs.delete(self._path(self.old), True)

    def abort(self) -> None:
        self._fs.delete(self._path(self.folder), True)
