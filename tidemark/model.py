"""The shapes that all parts agree on: change events, checkpoints, documents."""

from __future__ import annotations

from pyspark.sql import types as T

INSERT, UPDATE, DELETE, TRUNCATE = "INSERT", "UPDATE", "DELETE", "TRUNCATE"
OPERATIONS = (INSERT, UPDATE, DELETE, TRUNCATE)
#: Operations that a keyed index takes; others are skipped there.
INDEX_OPERATIONS = (INSERT, UPDATE, DELETE)

#: Fields that connectors add to a document and an index never stores.
METADATA_FIELDS = ("_table", "_collection", "_schema", "_database", "_id")

CHECKPOINT = T.StructType(
    [
        T.StructField("position", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("timestamp", T.LongType()),
    ]
)

#: ``seq`` orders the events of one source; ``data`` is the row as JSON text.
CHANGE_EVENT = T.StructType(
    [
        T.StructField("op", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("position", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("pk", T.StringType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("data", T.StringType()),
    ]
)

DEAD_LETTER = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("pk", T.StringType()),
        T.StructField("position", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("table", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_msg", T.StringType()),
        T.StructField("retry_count", T.IntegerType()),
        T.StructField("max_retries", T.IntegerType()),
        T.StructField("first_failed", T.TimestampType()),
        T.StructField("last_retried", T.TimestampType()),
        T.StructField("status", T.StringType()),
        # the batch that found the failure, and the number of the write that says so
        T.StructField("batch", T.StringType()),
        T.StructField("version", T.LongType()),
    ]
)
