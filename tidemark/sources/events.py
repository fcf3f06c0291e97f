"""Raw connector payloads to change events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import bson
from tidemark.functions.documents import composite_key, render
from tidemark.functions.positions import lsn_number
from tidemark.model import CHANGE_EVENT
from tidemark.operators.relational import change_operation, include_tables

_ORDER = [f.name for f in CHANGE_EVENT.fields]


def from_row_log(log: DataFrame, keys: list[str], tables: list[str] | None = None) -> DataFrame:
    """Row events of a binary log to change events.

    ``log``: op, schema_name, table, file, pos, seq, before, after (structs of
    the row, null where absent). An update keeps its after-image, a deletion its
    before-image; the key joins ``keys`` with a colon.
    """
    kept = include_tables(log, tables or []).filter(F.upper("op").isin("INSERT", "UPDATE", "DELETE"))
    row = F.coalesce("after", "before")
    fields = sorted(log.schema["after"].dataType.names)
    data = F.to_json(F.struct(*[row[f].alias(f) for f in fields]), {"ignoreNullFields": "false"})
    return kept.select(F.upper("op").alias("op"), F.lit("mysql").alias("source_type"), F.concat_ws(":", "file", F.col("pos").cast("string")).alias("position"), F.col("seq").cast("long").alias("seq"), composite_key(*[row[k] for k in keys]).alias("pk"), "schema_name", "table", data.alias("data")).select(*_ORDER)


def from_decoded_wal(rows: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """Decoded logical-replication rows (``sources.pgoutput``) to change events; the position is the LSN."""
    kept = include_tables(rows.filter(F.col("op").isNotNull()), tables or [])
    return kept.select("op", F.lit("postgresql").alias("source_type"), F.col("lsn").alias("position"), lsn_number(F.col("lsn")).cast("long").alias("seq"), F.coalesce("pk", F.lit("")).alias("pk"), "schema_name", "table", "data").select(*_ORDER)


def from_change_stream(stream: DataFrame, collections: list[str] | None = None) -> DataFrame:
    """Change-stream envelopes to change events.

    ``stream``: operation, database, collection, token, seq, full_document and
    document_key (extended JSON text). A deletion's data is its document key; an
    update without a full document is skipped.
    """
    op = change_operation(F.col("operation"))
    kept = include_tables(stream.withColumn("op", op).filter("op is not null"), collections or [], "collection")
    kept = kept.withColumn("raw", F.when(F.col("op") == "DELETE", F.col("document_key")).otherwise(F.col("full_document"))).filter("raw is not null")
    return kept.select("op", F.lit("mongodb").alias("source_type"), F.base64(F.col("token").cast("binary")).alias("position"), F.col("seq").cast("long").alias("seq"), bson.primary_key(F.coalesce("document_key", "raw")).alias("pk"), F.col("database").alias("schema_name"), F.col("collection").alias("table"), bson.normalise(F.col("raw")).alias("data")).select(*_ORDER)


def from_snapshot(table: DataFrame, name: str, keys: list[str], schema_name: str = "", position: str = "", seq: int = 0) -> DataFrame:
    """Rows of a table as inserts at one position, before all events of the log."""
    return table.select(F.lit("INSERT").alias("op"), F.lit("snapshot").alias("source_type"), F.lit(position).alias("position"), F.lit(seq).cast("long").alias("seq"), composite_key(*[F.col(k) for k in keys]).alias("pk"), F.lit(schema_name).alias("schema_name"), F.lit(name).alias("table"), render(table).alias("data")).select(*_ORDER)


def log_position(log: DataFrame) -> tuple[str, int]:
    """(position, seq) of the newest event of a log, ("", 0) for none: taken before a snapshot is read, it is where the stream goes on."""
    last = log.agg(F.max(F.struct("seq", "position")).alias("last")).first()["last"]
    return (last["position"], last["seq"]) if last else ("", 0)


def snapshot_at(table: DataFrame, name: str, keys: list[str], at: tuple[str, int], schema_name: str = "") -> DataFrame:
    """A snapshot stamped with the position that was taken before it. Events since then may be in it too; replaying them changes nothing."""
    return from_snapshot(table, name, keys, schema_name, *at)


def resume_after(log: DataFrame, at: tuple[str, int]) -> DataFrame:
    """The events that a snapshot at ``at`` leaves to the stream; the filter reaches the scan."""
    return log.filter(F.col("seq") > at[1])
