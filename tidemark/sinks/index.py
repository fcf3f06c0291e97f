"""Keyed document indices as Parquet deltas over a base, and bulk text for a search service.

A write appends its batch, one row a key, as the next delta: its cost is that of
the batch. A read merges the base and the deltas after it by key and sequence,
so order of writes and repeated writes don't matter. Every ``compact_every``
deltas become a new base; what that replaces stays for ``expire_seconds``, for
those who read it, and a failed write is overwritten by the next.
Deleted keys stay as tombstones with their sequence; ``read`` hides them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.documents import index_name, strip_metadata_json
from tidemark.operators.upsert import known_operations, latest
from tidemark.sinks.versions import Versions

COLUMNS = ["index", "pk", "op", "seq", "data"]
SCHEMA = "index string, pk string, op string, seq long, data string"


class SinkError(RuntimeError):
    """The sink took nothing; the events are for the dead letters."""


class IndexStore:
    """Documents by index and key below ``root``, a path that Spark's readers and writers reach."""

    def __init__(self, spark: SparkSession, root: str, prefix: str, compact_every: int = 16, expire_seconds: float = 3600):
        self.spark, self.prefix = spark, prefix
        self.parts = Versions(spark, root, SCHEMA, compact_every, expire_seconds)

    def version(self) -> int:
        """The last write that was finished, 0 for none."""
        return self.parts.version()

    def _rows(self) -> DataFrame | None:
        base = self.parts.base()
        rows = self.parts.read([p.name for p in [*([base] if base else []), *self.parts.deltas()]])
        return rows.select(*COLUMNS) if rows is not None else None

    def state(self) -> DataFrame:
        """The newest row of every key, tombstones included."""
        rows = self._rows()
        return latest(rows, ["index", "pk"]) if rows is not None else self.spark.createDataFrame([], SCHEMA).select(*COLUMNS)

    def read(self, index: str | None = None) -> DataFrame:
        """Live documents; a filter on the index reaches the scan."""
        live = self.state().filter("op <> 'DELETE'")
        return live.filter(F.col("index") == index) if index else live

    def route(self, events: DataFrame) -> DataFrame:
        """Events as rows of this store: known operations, index names, clean documents."""
        known = known_operations(events)
        return known.select(index_name(self.prefix, F.col("table")).alias("index"), "pk", "op", F.col("seq").cast("long").alias("seq"), strip_metadata_json(F.col("data")).alias("data"))

    def write(self, events: DataFrame) -> int:
        """Append a batch; the same batch again changes nothing. Returns the new version."""
        latest(self.route(events), ["index", "pk"]).write.mode("overwrite").parquet(f"{self.parts.root}/{self.parts.place()}")
        if self.parts.due():
            self.compact()
        return self.version()

    def compact(self) -> None:
        """The state as a new base."""
        deltas = self.parts.deltas()
        if deltas:
            self.state().repartition("index", "pk").sortWithinPartitions("index", "pk").write.mode("overwrite").parquet(f"{self.parts.root}/b{deltas[-1].number}")
        self.parts.clear()

    def ensure(self, name: str, fields: dict[str, dict] | None = None) -> bool:
        """Settings and mapping of an index, written as ``_mappings/<name>`` unless they are there; False if they are."""
        at = self.parts._path(f"_mappings/{name}.json")
        if self.parts._fs().exists(at):
            return False
        with_text = self.spark.createDataFrame([(json.dumps(create_mapping(fields), sort_keys=True),)], "value string")
        with_text.coalesce(1).write.mode("overwrite").text(f"{self.parts.root}/_mappings/{name}.json")
        return True

    def mapping(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.parts.root}/_mappings/{name}.json").first()[0])

    def put_template(self, name: str) -> None:
        """Templates and life cycles belong to a search service; Parquet indices have none."""
        raise NotImplementedError("index templates")

    setup_lifecycle = put_template

    def describe(self) -> DataFrame:
        """(index, n_docs) of indices that hold live documents."""
        return self.read().groupBy("index").agg(F.count("*").alias("n_docs"))


class FailingStore:
    """A sink that takes nothing, for a job whose sink is down: all its events become dead letters."""

    def __init__(self, spark: SparkSession, reason: str = "no sink"):
        self.spark, self.reason = spark, reason

    def write(self, events: DataFrame) -> int:
        raise SinkError(self.reason)


def bulk_lines(index: Column, pk: Column, op: Column, data: Column) -> Column:
    """Lines of a bulk request: an action, and the document unless it is a deletion. An empty key lets the service choose one."""
    name = F.when(F.coalesce(pk, F.lit("")) != "", F.struct(index.alias("_index"), pk.alias("_id"))).otherwise(F.struct(index.alias("_index"), F.lit(None).cast("string").alias("_id")))
    action = F.when(op == "DELETE", F.to_json(F.struct(name.alias("delete")))).otherwise(F.to_json(F.struct(name.alias("index"))))
    return F.when(op == "DELETE", action).otherwise(F.concat(action, F.lit("\n"), data))


def bulk_requests(docs: DataFrame, max_bytes: int = 1_000_000) -> DataFrame:
    """(part, request, n_docs, body): each partition's lines cut to requests of about ``max_bytes``.

    Requests are cut by running bytes within hash groups, which are as many
    as partitions and not one for all rows.
    """
    from pyspark.sql import Window

    lined = docs.withColumn("line", bulk_lines(F.col("index"), F.col("pk"), F.col("op"), F.col("data"))).withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy("index", "pk").rowsBetween(Window.unboundedPreceding, -1)
    cut = lined.withColumn("request", F.floor(F.coalesce(F.sum(F.octet_length("line") + 1).over(w), F.lit(0)) / max_bytes).cast("long"))
    return cut.groupBy("part", "request").agg(F.count("*").alias("n_docs"), F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "pk", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("body"))


def create_mapping(fields: dict[str, dict] | None = None, shards: int = 1, replicas: int = 1) -> dict:
    """Settings and mapping of a new index: dynamic, with five fixed properties and any given ones."""
    # Property names, types and settings that indices of this kind have.
    fixed = {"timestamp": {"type": "date"}, "operation": {"type": "keyword"}, "table": {"type": "keyword"}, "primary_key": {"type": "keyword"}, "data": {"type": "object", "dynamic": True}}
    return {"settings": {"number_of_shards": shards, "number_of_replicas": replicas, "refresh_interval": "5s"}, "mappings": {"dynamic": True, "properties": fixed | (fields or {})}}
