"""Batch and streaming readers: snapshots, change-log folders, frame folders."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql import types as T

from tidemark.model import CHANGE_EVENT


def read_snapshot(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None, format: str = "parquet") -> DataFrame:
    """A table's files; the predicate and the columns reach the scan."""
    df = spark.read.format(format).load(path)
    df = df.filter(where) if where else df
    return df.select(*columns) if columns else df


def read_jdbc_chunks(spark: SparkSession, url: str, table: str, key: str, ranges: list[tuple[int, int]], properties: dict | None = None, connections: int = 10) -> DataFrame:
    """One read a half-open key range, over at most ``connections`` connections at a time. The driver's JAR must be on the class path."""
    chunks = spark.read.jdbc(url, table, predicates=[f"{key} >= {a} AND {key} < {b}" for a, b in ranges], properties=properties or {})
    return chunks.coalesce(connections) if len(ranges) > connections else chunks


def read_change_log(spark: SparkSession, path: str, schema: T.StructType = CHANGE_EVENT, format: str = "json") -> DataFrame:
    return spark.read.format(format).schema(schema).load(path)


def stream_change_log(spark: SparkSession, path: str, schema: T.StructType = CHANGE_EVENT, format: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """New files of a folder, as a stream; progress is the query's checkpoint."""
    reader = spark.readStream.format(format).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


class _FrameRange(InputPartition):
    """Bytes [start, end) of one file, both at record boundaries, with the number of the first record."""

    def __init__(self, path: str, start: int, end: int, seq: int):
        self.path, self.start, self.end, self.seq = path, start, end, seq


def _records(path: str, start: int, end: int, seq: int) -> Iterator[tuple]:
    """Each file is one slot: records of length (4 bytes), LSN (8 bytes) and frame."""
    slot = os.path.basename(path).removesuffix(".frames")
    with open(path, "rb") as f:
        f.seek(start)
        while f.tell() < end:
            head = f.read(12)
            size, lsn = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:], "big")
            yield slot, f"{lsn >> 32:X}/{lsn & 0xFFFFFFFF:X}", seq, f.read(size)
            seq += 1


def _complete(path: str, start: int, seq: int) -> tuple[int, int]:
    """Where the last whole record from ``start`` ends, and the number of the record that comes next; a record that is still being written waits."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        while start + 12 <= size:
            f.seek(start)
            end = start + 12 + int.from_bytes(f.read(4), "big")
            if end > size:
                break
            start, seq = end, seq + 1
    return start, seq


def _frame_files(folder: str) -> list[str]:
    return sorted(os.path.join(folder, n) for n in os.listdir(folder) if n.endswith(".frames"))


class _FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def partitions(self) -> list[_FrameRange]:
        return [_FrameRange(p, 0, _complete(p, 0, 0)[0], 0) for p in _frame_files(self.folder)]

    def read(self, partition: _FrameRange) -> Iterator[tuple]:
        return _records(partition.path, partition.start, partition.end, partition.seq)


class _FrameStream(DataSourceStreamReader):
    """Offsets are the end of the last whole record of every file; they live in the query's checkpoint."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.seen: dict = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for p in _frame_files(self.folder):
            self.seen[p] = list(_complete(p, *self.seen.get(p, (0, 0))))
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[_FrameRange]:
        return [_FrameRange(p, *((start.get(p) or [0, 0])[:1]), end[p][0], (start.get(p) or [0, 0])[1]) for p in sorted(end) if end[p] != start.get(p)]

    def read(self, partition: _FrameRange) -> Iterator[tuple]:
        return _records(partition.path, partition.start, partition.end, partition.seq)


class FrameSource(DataSource):
    """``format("wal_frames").load(folder)``, batch or stream: slot, lsn, seq, frame. All executors mount the folder."""

    @classmethod
    def name(cls) -> str:
        return "wal_frames"

    def schema(self) -> str:
        return "slot string, lsn string, seq long, frame binary"

    def reader(self, schema) -> DataSourceReader:
        return _FrameReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FrameStream(dict(self.options))


def describe_table(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(column_name, ordinal, data_type, nullable, is_key) of a table."""
    rows = [(f.name, k + 1, f.dataType.simpleString(), f.nullable, f.name in (keys or [])) for k, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column_name string, ordinal int, data_type string, nullable boolean, is_key boolean")


def estimated_rows(df: DataFrame) -> int:
    """Rows from the optimizer's statistics: its row count if it has one, else bytes by the width of a row."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    if stats.rowCount().isDefined():
        return int(str(stats.rowCount().get()))
    widths = {"integer": 4, "date": 4, "boolean": 1, "string": 20}
    width = sum(widths.get(f.dataType.typeName(), 8) for f in df.schema.fields)
    return int(str(stats.sizeInBytes())) // max(1, width)


def sniff_schema(df: DataFrame, json_column: str) -> str:
    """The merged schema of all documents of a column, not of one sample."""
    return df.select(F.schema_of_variant_agg(F.try_parse_json(json_column)).alias("s")).first()[0]


def stream_kafka(spark: SparkSession, servers: str, topic: str, schema: T.StructType = CHANGE_EVENT) -> DataFrame:
    """Change events as JSON values of a topic; the connector's JAR must be on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return kafka_events(raw, schema)


def kafka_events(raw: DataFrame, schema: T.StructType = CHANGE_EVENT) -> DataFrame:
    """Rows of a topic (value, partition, offset) as change events; one without a position gets its partition and offset."""
    parsed = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e"), F.concat_ws(":", F.col("partition").cast("string"), F.col("offset").cast("string")).alias("at"))
    return parsed.filter("e is not null").select("e.*", "at").withColumn("position", F.coalesce("position", "at")).drop("at")


@dataclass
class SourceRegistry:
    """Named sources and the jobs that use them; a used source can't be removed."""

    kinds: tuple[str, ...] = ("mysql", "postgresql", "mongodb", "files", "kafka")
    sources: dict[str, dict] = field(default_factory=dict)
    jobs: dict[str, set[str]] = field(default_factory=dict)

    def register(self, name: str, kind: str, **options) -> None:
        if kind not in self.kinds:
            raise ValueError(f"unknown source type {kind!r}")
        self.sources[name] = {"type": kind, **options}
        self.jobs.setdefault(name, set())

    def unregister(self, name: str) -> None:
        if self.jobs.get(name):
            raise ValueError(f"source {name!r} is used by {sorted(self.jobs[name])}")
        self.sources.pop(name, None)
        self.jobs.pop(name, None)

    def attach(self, name: str, job: str) -> dict:
        if name not in self.sources:
            raise KeyError(name)
        self.jobs[name].add(job)
        return self.sources[name]

    def detach(self, name: str, job: str) -> None:
        self.jobs.get(name, set()).discard(job)

    def problems(self) -> list[str]:
        need = {"mysql": ("host", "user"), "postgresql": ("host", "user", "database"), "mongodb": ("uri",), "files": ("path",), "kafka": ("servers", "topic")}
        return [f"{n}: no {k}" for n, s in self.sources.items() for k in need[s["type"]] if not s.get(k)]
