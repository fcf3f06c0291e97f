"""Progress, throughput and lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(F.lit(0.0))


def overall(chunks: DataFrame, elapsed_seconds: float) -> DataFrame:
    """One row from chunks (table_name, status, total_rows, processed_rows): totals, percentages, rows a second, seconds left."""
    done = F.col("status") == "completed"
    sums = chunks.agg(F.count("*").alias("total_chunks"), F.count_if(done).alias("completed_chunks"), F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total_rows"), F.coalesce(F.sum(F.when(done, F.col("processed_rows"))), F.lit(0)).alias("processed_rows"), F.countDistinct("table_name").alias("total_tables"))
    rate = F.col("processed_rows") / F.lit(float(elapsed_seconds)) if elapsed_seconds > 0 else F.lit(0.0)
    left = F.col("total_rows") - F.col("processed_rows")
    return sums.withColumns({"chunk_progress": percent(F.col("completed_chunks"), F.col("total_chunks")), "row_progress": percent(F.col("processed_rows"), F.col("total_rows")), "rows_per_second": rate}).withColumn("eta_seconds", F.when((F.col("rows_per_second") > 0) & (left > 0), F.floor(left / F.col("rows_per_second"))).otherwise(0).cast("long"))


def per_table(chunks: DataFrame) -> DataFrame:
    done = F.col("status") == "completed"
    sums = chunks.groupBy("table_name").agg(F.count("*").alias("total_chunks"), F.count_if(done).alias("completed_chunks"), F.coalesce(F.sum("total_rows"), F.lit(0)).alias("total_rows"), F.coalesce(F.sum(F.when(done, F.col("processed_rows"))), F.lit(0)).alias("processed_rows"))
    return sums.withColumn("progress", percent(F.col("completed_chunks"), F.col("total_chunks")))


def completed_tables(chunks: DataFrame) -> DataFrame:
    """Tables all of whose chunks are completed."""
    return chunks.groupBy("table_name").agg(F.bool_and(F.col("status") == "completed").alias("all_done")).filter("all_done").select("table_name")


def throughput(batches: DataFrame, value: str, failed: Column) -> DataFrame:
    """Mean, greatest, 99th percentile and error rate of a measure."""
    return batches.agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value"), F.percentile(value, 0.99).alias("p99_value"), (F.count_if(failed) / F.count("*")).alias("error_rate"))


def event_counts(events: DataFrame, job: str) -> DataFrame:
    return events.groupBy(job).agg(F.count("*").alias("n_events"))


def worker_rates(batches: DataFrame, worker: str, rows: str, elapsed_seconds: float) -> DataFrame:
    """Batches, rows and rows a second of each worker."""
    return batches.groupBy(worker).agg(F.count("*").alias("batches"), F.sum(rows).alias("done_rows"), (F.sum(rows) / F.lit(elapsed_seconds)).alias("rows_per_second"))


def histogram(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def lag_seconds(seen: DataFrame, by: str, produced: str, committed: str) -> DataFrame:
    """Seconds between the newest event of each source and the newest one committed, none if the commit is ahead."""
    newest = seen.groupBy(by).agg(F.max(F.unix_seconds(produced)).alias("p"), F.max(F.unix_seconds(committed)).alias("c"))
    return newest.select(by, F.greatest(F.col("p") - F.coalesce("c", "p"), F.lit(0)).cast("long").alias("lag_seconds"))


def smoothed(batches: DataFrame, by: str, order: str, value: str, last: int = 64) -> DataFrame:
    """Each measure counts half of what is left: older ones than the ``last`` add under 2 ** -last of the whole."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    recent = batches.withColumn("__rank", rank).filter(F.col("__rank") <= last)
    listed = recent.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("v"))
    values = F.transform("v", lambda x: x[value].cast("double"))
    return listed.select(by, F.aggregate(values, F.element_at(values, 1), lambda a, x: (a + x) / 2).alias("smoothed"))
