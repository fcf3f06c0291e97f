"""Numbered Parquet deltas over a numbered base, below one folder that Spark reaches.

A folder counts once its write has finished. What a base replaces stays for
``expire_seconds``, so a table that was read before keeps its files that long.
One writer at a time.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"([bd])(\d+)(?:-(.+))?")


@dataclass(frozen=True)
class Part:
    """A finished folder: a base "b" or a delta "d", its number, and the batch that a delta was named for."""

    kind: str
    number: int
    batch: str | None
    name: str


class Versions:
    def __init__(self, spark: SparkSession, root: str, schema: str, compact_every: int, expire_seconds: float):
        self.spark, self.root, self.schema, self.compact_every, self.expire_seconds = spark, root.rstrip("/"), schema, compact_every, expire_seconds

    def _path(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _parts(self, finished: bool = True) -> list[Part]:
        fs, at = self._fs(), self._path()
        if not fs.exists(at):
            return []
        found = [(s.getPath().getName(), _NAME.fullmatch(s.getPath().getName())) for s in fs.listStatus(at) if s.isDirectory()]
        return [Part(m[1], int(m[2]), m[3], name) for name, m in found if m and (not finished or fs.exists(self._path(f"{name}/_SUCCESS")))]

    def base(self) -> Part | None:
        return max((p for p in self._parts() if p.kind == "b"), key=lambda p: p.number, default=None)

    def deltas(self) -> list[Part]:
        """The finished deltas after the base."""
        base = self.base()
        return sorted((p for p in self._parts() if p.kind == "d" and p.number > (base.number if base else 0)), key=lambda p: p.number)

    def version(self) -> int:
        """The last write that was finished, 0 for none."""
        base = self.base()
        return max([base.number if base else 0, *(p.number for p in self.deltas())])

    def place(self, batch: str | None = None) -> str:
        """Where the next delta goes; a batch that has a place, finished or not, keeps it."""
        for p in self._parts(finished=False) if batch else []:
            if p.batch == batch:
                return p.name
        return f"d{self.version() + 1}" + (f"-{batch}" if batch else "")

    def read(self, names: list[str]) -> DataFrame | None:
        if not names:
            return None
        return self.spark.read.schema(self.schema).option("basePath", self.root).parquet(*[f"{self.root}/{n}" for n in names])

    def due(self) -> bool:
        return len(self.deltas()) >= self.compact_every

    def clear(self) -> None:
        """Delete what a base replaced over ``expire_seconds`` ago, and what writes that failed left below it."""
        fs, parts = self._fs(), self._parts(finished=False)
        made = {p.number: fs.getFileStatus(self._path(f"{p.name}/_SUCCESS")).getModificationTime() / 1000 for p in self._parts() if p.kind == "b"}
        for p in parts:
            later = [n for n in sorted(made) if n > p.number or n == p.number and p.kind == "d"]
            if later and time.time() - made[later[0]] >= self.expire_seconds:
                fs.delete(self._path(p.name), True)
