"""Tables in published versions: a reader sees a version whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

MARKS = "_published"


class Versions:
    """Folders below ``root``, of which readers see those that have been published.

    A writer fills a folder of its own and then creates one empty file that bears the folder's name: with that one step
    all of it becomes visible. A writer that stops before leaves a folder that nobody reads; ``clean`` deletes it.
    Names begin with a number one above the newest published one, so the last name in order is the newest version.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        fs = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def published(self) -> list[str]:
        """Names of all published versions, the newest last."""
        return self._names(MARKS)

    def newest(self) -> str | None:
        """Name of the newest version, None if there is none; one listing of a small folder."""
        return max(self.published(), default=None)

    def folder(self, version: str) -> str:
        return f"{self.root}/{version}"

    def parts(self, version: str) -> list[str]:
        """Names of the tables of a version."""
        return self._names(version)

    def begin(self) -> str:
        """The name of a version yet to be written."""
        last = self.newest()
        return f"{int(last.split('-')[0]) + 1 if last else 1:08d}-{uuid.uuid4().hex}"

    def publish(self, version: str) -> None:
        self._fs().create(self._path(MARKS, version), False).close()

    def table(self, name: str, version: str | None = None, columns: Sequence[str] = ()) -> DataFrame:
        """A Parquet table of one version, the newest by default."""
        version = version or self.newest()
        if version is None:
            raise ValueError(f"nothing has been published under {self.root}")
        df = self.spark.read.parquet(f"{self.folder(version)}/{name}")
        return df.select(*columns) if columns else df

    def clean(self, keep: int = 1, also: Sequence[str] = ()) -> list[str]:
        """Delete all folders but those of the last ``keep`` versions and of ``also``; returns their names.

        For a time when nobody writes: a version being written is not published yet.
        """
        fs, last = self._fs(), {*self.published()[-keep:], *also}
        gone = [n for n in self._names() if n != MARKS and n not in last]
        for name in gone:
            fs.delete(self._path(MARKS, name), False)
            fs.delete(self._path(name), True)
        return gone
