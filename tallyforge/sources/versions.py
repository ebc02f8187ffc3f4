"""Versions of a table in a folder: each is written whole and then marked; readers take the highest marked one.

A crash leaves an unmarked version, which nobody reads and the next writer passes over. Each writer claims its number
first, so writers that start together fill folders of their own; the highest number counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

_MARK = "_COMPLETE"


class Versions:
    """The folder ``path`` with versions v-0, v-1, ..."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def numbers(self, marked: bool = True) -> list[int]:
        """The versions there are, in order."""
        fs, p = self._at(self.path)
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        found = sorted(int(n[2:]) for n in names if n.startswith("v-") and n[2:].isdigit())
        return [n for n in found if not marked or fs.exists(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v-{n}/{_MARK}"))]

    def current(self) -> str:
        """The folder of the highest complete version."""
        found = self.numbers()
        if not found:
            raise FileNotFoundError(f"no complete version in {self.path}")
        return self.folder(found[-1])

    def folder(self, n: int) -> str:
        return f"{self.path}/v-{n}"

    def _claim(self) -> int:
        """A number that no other writer has: its claim is a file that only one can create."""
        fs, p = self._at(self.path)
        fs.mkdirs(p)
        n = max(self.numbers(marked=False), default=-1) + 1
        while not fs.createNewFile(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/claim-{n}")):
            n += 1
        return n

    def add(self, write: Callable[[str], None]) -> int:
        """Let ``write`` fill the folder of a version of its own, then mark it."""
        n = self._claim()
        write(self.folder(n))
        self.mark(f"{self.folder(n)}/{_MARK}")
        return n

    def drop_before(self, n: int) -> None:
        """Delete the versions below ``n``."""
        for k in self.numbers(marked=False):
            if k < n:
                fs, p = self._at(self.folder(k))
                fs.delete(p, True)

    def holds(self, path: str) -> bool:
        """Whether there is something at ``path``."""
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """What lies in the folder ``path``; nothing if it is not there."""
        fs, p = self._at(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def mark(self, path: str) -> None:
        """An empty file at ``path``."""
        fs, p = self._at(path)
        fs.create(p, True).close()

    def drop_others(self, path: str, kept: set[str]) -> None:
        """Delete what lies in the folder ``path`` under other names than ``kept``."""
        fs, p = self._at(path)
        for x in fs.listStatus(p) if fs.exists(p) else ():
            if x.getPath().getName() not in kept:
                fs.delete(x.getPath(), True)


def fingerprint(spark: SparkSession, files: list[str]) -> str:
    """Names, sizes and times of files, as a text that changes with them."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for f in sorted(files):
        p = jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(conf).getFileStatus(p)
        out.append(f"{f} {s.getLen()} {s.getModificationTime()}")
    return "\n".join(out)
