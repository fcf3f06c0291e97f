"""Chunk plans for snapshots, and rows dealt to their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

#: Rows below which a table has a priority and a largest chunk.
PRIORITIES = [(10_000, 100), (100_000, 80), (1_000_000, 60), (10_000_000, 40)]
LOWEST_PRIORITY = 20
CHUNK_LIMITS = [(10_000, 1_000), (100_000, 5_000), (1_000_000, 10_000)]
#: Tries of a chunk, and seconds that each adds to the wait before the next.
CHUNK_TRIES, CHUNK_WAIT = 3, 5


def plan_even(low: int, high: int, size: int, most: int = 8) -> list[tuple[int, int]]:
    """Half-open ranges of one width, ``most`` at most; the last takes the remainder."""
    if low == high:
        return [(low, high + 1)]
    span = high - low + 1
    count = min(max(1, span // size), most)
    step = span // count
    return [(low + k * step, high + 1 if k == count - 1 else low + (k + 1) * step) for k in range(count)]


def even_chunks(df: DataFrame, key: str, size: int, most: int = 8) -> DataFrame:
    """(chunk_id, start_id, end_id) by ``plan_even`` over the key's range; two numbers are all that is aggregated."""
    span = df.agg(F.min(key).alias("low"), F.max(key).alias("high")).filter("low is not null")
    count = F.least(F.greatest(F.floor((F.col("high") - F.col("low") + 1) / size), F.lit(1)), F.lit(most)).cast("long")
    plan = span.withColumn("n", count).withColumn("step", F.floor((F.col("high") - F.col("low") + 1) / F.col("n")).cast("long"))
    plan = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("chunk_id"))
    return plan.select("chunk_id", (F.col("low") + F.col("chunk_id") * F.col("step")).alias("start_id"), F.when(F.col("chunk_id") == F.col("n") - 1, F.col("high") + 1).otherwise(F.col("low") + (F.col("chunk_id") + 1) * F.col("step")).alias("end_id"))


def stride_chunks(df: DataFrame, key: str, size: int) -> DataFrame:
    """(chunk_id, start_id, end_id): inclusive ranges of ``size`` ids, the last cut at the greatest."""
    span = df.agg(F.min(key).alias("low"), F.max(key).alias("high")).filter("low is not null")
    starts = span.select("high", F.posexplode(F.sequence("low", "high", F.lit(size).cast("long"))).alias("chunk_id", "start_id"))
    return starts.select(F.col("chunk_id").cast("long").alias("chunk_id"), "start_id", F.least(F.col("start_id") + size - 1, "high").alias("end_id"))


def chunk_of(key: Column, ranges: list[tuple[int, int]]) -> Column:
    """The number of the half-open range that holds a key; null outside all. Ranges of one width are found by division."""
    low, high = ranges[0][0], ranges[-1][1]
    step = ranges[0][1] - low
    return F.when((key >= low) & (key < high), F.least(F.floor((key - low) / step), F.lit(len(ranges) - 1)).cast("long"))


def hash_chunk(key: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def modulo_chunk(key: Column, count: int) -> Column:
    return F.pmod(key, F.lit(count)).cast("int")


def time_chunk(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts)


def pages(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Rows with ``row_index`` and ``page`` in a total order, numbered without one task seeing all rows.

    A range sort puts rows in order over all partitions, settled so that both
    readings see the same cuts; counts of the partitions before give each its first number.
    """
    ordered = settle(df.repartitionByRange(*order)).withColumn("__p", F.spark_partition_id())
    ordered = ordered.withColumn("__k", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    sizes = ordered.groupBy("__p").agg(F.count("*").alias("__n"))
    first = sizes.withColumn("__first", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")
    numbered = ordered.join(F.broadcast(first), "__p").withColumn("row_index", (F.col("__first") + F.col("__k") - 1).cast("long"))
    return numbered.withColumn("page", F.floor(F.col("row_index") / size).cast("long")).drop("__p", "__k", "__first")


def priority(rows: Column) -> Column:
    out = F.when(rows < PRIORITIES[0][0], PRIORITIES[0][1])
    for limit, value in PRIORITIES[1:]:
        out = out.when(rows < limit, value)
    return out.otherwise(LOWEST_PRIORITY)


def adaptive_size(rows: Column, base: int = 100_000) -> Column:
    out = F.when(rows < CHUNK_LIMITS[0][0], F.least(F.lit(base), F.lit(CHUNK_LIMITS[0][1])))
    for limit, value in CHUNK_LIMITS[1:]:
        out = out.when(rows < limit, F.least(F.lit(base), F.lit(value)))
    return out.otherwise(base)


def group_boundaries(df: DataFrame, key: str, groups: int) -> DataFrame:
    """(bucket, first_key, last_key, n) of ``groups`` parts of nearly equal rows."""
    cuts = df.agg(F.percentile_approx(key, F.array(*[F.lit(k / groups) for k in range(1, groups)]), 10_000)).first()[0]
    bucket = sum([(F.col(key) > c).cast("int") for c in cuts or []], F.lit(0))
    return df.groupBy(bucket.alias("bucket")).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("n"))


def key_span(df: DataFrame, key: str) -> DataFrame:
    """One row: the least key, the greatest, and how many rows there are."""
    return df.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"))


def rows_per_chunk(df: DataFrame, key: str, size: int, most: int = 8) -> DataFrame:
    """(chunk_id, n) of the plan that ``even_chunks`` makes over the key's whole range; rows without a key are in no chunk."""
    span = key_span(df, key).first()
    if span["low"] is None:
        return df.select(F.lit(0).cast("long").alias("chunk_id"), F.lit(0).cast("long").alias("n")).limit(0)
    return df.withColumn("chunk_id", chunk_of(F.col(key), plan_even(span["low"], span["high"], size, most))).filter("chunk_id is not null").groupBy("chunk_id").agg(F.count("*").alias("n"))


def sorted_chunks(df: DataFrame, key: str, chunk: Column) -> DataFrame:
    """Rows with ``chunk_id``, each chunk's in key order and in one task, as a scan of chunks emits them."""
    return df.withColumn("chunk_id", chunk).repartition("chunk_id").sortWithinPartitions("chunk_id", key)


def page(df: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """One page of a total order."""
    return df.orderBy(*order).offset(offset).limit(size)


def after_failure(chunks: DataFrame) -> DataFrame:
    """Failed chunks (tries, failed_at) with their next status and time: a few tries with a wait that grows by steps, then failed for good."""
    again = F.col("tries") + 1 < CHUNK_TRIES
    due = F.timestamp_seconds(F.unix_seconds("failed_at") + (F.col("tries") + 1) * CHUNK_WAIT)
    return chunks.withColumns({"status": F.when(again, "pending").otherwise("failed"), "next_at": F.when(again, due), "tries": F.col("tries") + 1})
