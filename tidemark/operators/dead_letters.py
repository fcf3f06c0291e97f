"""Failed events: deduplicated, retried with backoff, counted, retired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "retrying", "exhausted", "resolved", "discarded")
OPEN = ("pending", "retrying")


def dedupe_key(job: Column, pk: Column, position: Column) -> Column:
    """Job, key and position: a second failure of one key at another position is an item of its own."""
    return F.concat_ws("|", F.coalesce(job, F.lit("")), F.coalesce(pk, F.lit("")), F.coalesce(position.cast("string"), F.lit("")))


def add_failures(items: DataFrame, failures: DataFrame) -> DataFrame:
    """The failures to append: one a key, none whose key is open in ``items``."""
    key = dedupe_key(F.col("job_id"), F.col("pk"), F.col("position"))
    opened = items.filter(F.col("status").isin(*OPEN)).select(key.alias("__key")).distinct()
    return failures.withColumn("__key", key).dropDuplicates(["__key"]).join(opened, "__key", "left_anti").drop("__key")


def backoff_seconds(retries: Column, base: int = 30) -> Column:
    return F.lit(base) * F.pow(F.lit(2), retries)


def eligible(now: Column, base: int = 30) -> Column:
    """Pending, retries left, and never tried or long enough ago."""
    waited = F.unix_timestamp(now) - F.unix_timestamp("last_retried")
    return (F.col("status") == "pending") & (F.col("retry_count") < F.col("max_retries")) & (F.col("last_retried").isNull() | (waited >= backoff_seconds(F.col("retry_count"), base)))


def after_retry(items: DataFrame, succeeded: Column, now: Column) -> DataFrame:
    """Retried items with their next status: resolved, pending again, or exhausted."""
    tries = F.col("retry_count") + 1
    ok = F.coalesce(succeeded, F.lit(False))
    return items.withColumns({"status": F.when(ok, "resolved").when(tries >= F.col("max_retries"), "exhausted").otherwise("pending"), "retry_count": tries, "last_retried": now})


def recovered(items: DataFrame) -> DataFrame:
    """Items left in retrying by a crash are pending again."""
    return items.withColumn("status", F.when(F.col("status") == "retrying", "pending").otherwise(F.col("status")))


def route_retry(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """(item_id, target_job): the item's own job if enabled, else the smallest enabled one, else null. ``jobs``: (job_id, enabled)."""
    enabled = jobs.filter("enabled").select("job_id").distinct()
    fallback = enabled.agg(F.min("job_id")).first()[0]
    own = items.join(enabled.withColumnRenamed("job_id", "own"), F.col("job_id") == F.col("own"), "left")
    return own.select("item_id", F.coalesce("own", F.lit(fallback).cast("string")).alias("target_job"))


def list_items(items: DataFrame, status: str | None = None, limit: int = 100, ordered: bool = True) -> DataFrame:
    """The oldest items of a status, or of all; a report of ``limit`` rows. Without ``ordered`` any of them, read from as few files as hold that many."""
    some = items.filter(F.col("status") == status) if status else items
    return (some.orderBy("first_failed", "item_id") if ordered else some).limit(limit)


def status_counts(items: DataFrame) -> DataFrame:
    """One row: total and the count of each status."""
    return items.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def expired(now: Column, days: int = 7) -> Column:
    """Closed items whose first failure is older than ``days``."""
    return F.col("status").isin("resolved", "discarded", "exhausted") & (F.unix_timestamp("first_failed") < F.unix_timestamp(now) - days * 86_400)


def orphans(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Items whose job is gone."""
    return items.join(jobs.select("job_id").distinct(), "job_id", "left_anti")


def discard(items: DataFrame, which: Column) -> DataFrame:
    return items.withColumn("status", F.when(which, "discarded").otherwise(F.col("status")))
