"""Pairs inside hash buckets, with hot buckets dealt out over many tasks.

A bucket of m members is cut into c = ceil(m / chunk) parts, and each pair of
parts is a group of its own; every pair of members meets in exactly one group,
and no task holds more than two parts of a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of one part of a bucket.
CHUNK = 1024


def crowded(entries: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``entries`` (bucket, member) in buckets of two or more, dealt into groups.

    Adds ``part`` and the group's ``part_a`` <= ``part_b``; a member of a
    bucket of c parts is repeated c times.
    """
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
    parts = F.ceil(F.col("m") / chunk).cast("int")
    held = entries.join(sizes, "bucket").withColumn("c", parts).withColumn("part", F.pmod(F.xxhash64("member"), F.col("c")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    return held.select("bucket", "member", "part", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the rows where groups begin, from batches sorted by ``keys``."""
    rest: pa.Table | None = None

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        at = starts(t)
        rest = t.slice(at[-1])
        if len(at) > 1:
            yield t.slice(0, at[-1]), at[:-1]
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.zeros(1, np.int64)


def pair_blocks(at: np.ndarray, rows: int, part: np.ndarray, part_a: np.ndarray, part_b: np.ndarray, limit: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, group) of all pairs to compare, in blocks of about ``limit``.

    In a group of one part all i < j; in a group of two parts the pairs across.
    """
    ends = np.append(at[1:], rows)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0
    for g, (s, e) in enumerate(zip(at.tolist(), ends.tolist())):
        if part_a[s] == part_b[s]:
            m = e - s
            if m < 2:
                continue
            for first in range(0, m, max(1, limit // m)):
                i, j = np.nonzero(np.arange(first, min(m, first + max(1, limit // m)))[:, None] < np.arange(m)[None, :])
                held.append((i + first + s, j + s, np.full(len(i), g)))
                count += len(i)
                if count >= limit:
                    yield tuple(np.concatenate(x) for x in zip(*held))
                    held, count = [], 0
        else:
            left, right = s + np.flatnonzero(part[s:e] == part_a[s]), s + np.flatnonzero(part[s:e] == part_b[s])
            if not len(left) or not len(right):
                continue
            step = max(1, limit // len(right))
            for first in range(0, len(left), step):
                some = left[first : first + step]
                held.append((np.repeat(some, len(right)), np.tile(right, len(some)), np.full(len(some) * len(right), g)))
                count += len(held[-1][0])
                if count >= limit:
                    yield tuple(np.concatenate(x) for x in zip(*held))
                    held, count = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


class Forest:
    """Union-find over the rows of a table; keeps only links that join two trees."""

    def __init__(self, rows: int):
        self.parent = np.arange(rows)

    def roots(self) -> np.ndarray:
        root = self.parent
        while True:
            up = root[root]
            if np.array_equal(up, root):
                self.parent = root
                return root
            root = up

    def add(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """The pairs that join trees. Taken in growing slices, as after the first most pairs lie in one tree."""
        kept: list[tuple[int, int]] = []
        step = 2048
        while len(i):
            parent = self.roots().tolist()
            for x, y in zip(i[:step].tolist(), j[:step].tolist()):
                a, b = x, y
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    kept.append((x, y))
                parent[x] = parent[y] = min(a, b)
            self.parent = np.array(parent)
            root = self.roots()
            open_ = root[i[step:]] != root[j[step:]]
            i, j = i[step:][open_], j[step:][open_]
            step *= 2
        return kept


def by_group(df: DataFrame, keys: list[str], kernel: Callable, schema: str) -> DataFrame:
    """``kernel`` over partitions that hold the groups of ``keys`` whole and in order."""
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(kernel, schema)
