"""Dead letters: an append-only log of item states over a base.

An item's state is its row of the greatest version. Writes append; every
``compact_every`` of them become a new base, which is parted into open and closed
items and leaves out closed ones that are too old. Adding failures reads the open
items alone, so a batch costs no more the longer a job runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import DEAD_LETTER
from tidemark.operators import dead_letters
from tidemark.operators.upsert import latest
from tidemark.sinks.versions import Versions

_COLUMNS = [f.name for f in DEAD_LETTER.fields]
_SCHEMA = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in DEAD_LETTER.fields)


def _is_open() -> Column:
    return F.col("status").isin(*dead_letters.OPEN)


class LetterStore:
    def __init__(self, spark: SparkSession, root: str, compact_every: int = 16, expire_seconds: float = 3600, keep_days: int = 7):
        self.spark, self.keep_days = spark, keep_days
        self.parts = Versions(spark, root, f"{_SCHEMA}, is_open boolean", compact_every, expire_seconds)

    def _rows(self, base_rows: Column | None = None, without: str | None = None) -> DataFrame:
        """Rows of the base (those that ``base_rows`` picks) and of all deltas but one."""
        base, out = self.parts.base(), self.spark.createDataFrame([], DEAD_LETTER)
        if base:
            rows = self.spark.read.schema(self.parts.schema).parquet(f"{self.parts.root}/{base.name}")
            out = (rows.filter(base_rows) if base_rows is not None else rows).select(*_COLUMNS)
        deltas = self.parts.read([p.name for p in self.parts.deltas() if p.name != without])
        return out.unionByName(deltas.select(*_COLUMNS)) if deltas is not None else out

    def state(self) -> DataFrame:
        """Every item as it is now."""
        return latest(self._rows(), ["item_id"], "version").select(*_COLUMNS)

    def opened(self) -> DataFrame:
        """The items that are pending or being retried."""
        return latest(self._rows(F.col("is_open")), ["item_id"], "version").filter(_is_open()).select(*_COLUMNS)

    def add(self, failures: DataFrame, batch: str) -> None:
        """Failures as pending items, none whose key is open; the same batch again changes nothing.

        A batch that is replayed keeps its place in the log, so what happened to its
        items later stays so; its own items don't count as open.
        """
        place = self.parts.place(batch)
        known = latest(self._rows(F.col("is_open") | (F.col("batch") == batch), without=place), ["item_id"], "version").filter(_is_open() | (F.col("batch") == batch)).select("item_id")
        new = failures.dropDuplicates(["item_id"]).join(known, "item_id", "left_anti")
        self._write(new.withColumn("batch", F.lit(batch)), place)

    def put(self, items: DataFrame) -> None:
        """Items with their next status."""
        self._write(items, self.parts.place())

    def _write(self, items: DataFrame, place: str) -> None:
        number = int(place.split("-")[0][1:])
        items.withColumn("version", F.lit(number).cast("long")).select(*_COLUMNS).write.mode("overwrite").parquet(f"{self.parts.root}/{place}")
        if self.parts.due():
            self.compact()

    def compact(self, now: Column | None = None) -> None:
        """A new base of all items but closed ones older than ``keep_days``."""
        deltas = self.parts.deltas()
        if deltas:
            kept = self.state().filter(~dead_letters.expired(now if now is not None else F.current_timestamp(), self.keep_days))
            kept.withColumn("is_open", _is_open()).repartition("is_open", "item_id").sortWithinPartitions("batch").write.mode("overwrite").partitionBy("is_open").parquet(f"{self.parts.root}/b{deltas[-1].number}")
        self.parts.clear()
