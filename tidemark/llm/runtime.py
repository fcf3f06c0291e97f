"""Session-level helpers: cutting lineage in the shared folder, reading tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import settle, shared_folder, ship


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of a session, whose workers find the package."""
    return shared_folder(ship(spark))


#: Rows of a settled side that a join may broadcast.
BROADCAST_ROWS = 1_000_000


def join_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` settled, with a broadcast hint if its counted rows are few; else the join shuffles. Rows must be narrow."""
    df = settle(df)
    return F.broadcast(df) if df.count() <= limit else df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: for what is read more than once by some of its columns."""
    at = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Rows of one class beyond which its join is no shuffle.
HOT_ROWS = 100_000


def join_classes(rows: DataFrame, classes: DataFrame, on: list[str], size: str, hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the columns of their class; ``on`` is unique in ``classes``, without nulls, and ``size`` counts its rows.

    Classes of over ``hot`` rows are broadcast, so their rows stay where they are;
    there is at most one for every ``hot`` rows. The others are joined by a shuffle
    in which no key has more than ``hot`` rows. Both sides should be settled.
    """
    large = settle(classes.filter(F.col(size) > hot))
    if large.isEmpty():
        return rows.join(classes.drop(size), on)
    large = F.broadcast(large)
    return rows.join(large.drop(size), on).unionByName(rows.join(large.select(*on), on, "left_anti").join(classes.filter(F.col(size) <= hot).drop(size), on))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Settled ``rows`` with a gapless number from 0 in each group of ``by`` (without nulls), as the long ``name``.

    Rows are counted by group and partition, and numbered in each partition from
    where those before it end: no task sees more than one partition's rows of a
    group, however many the group has. Within a partition the order is ``order``.
    """
    at = rows.withColumn("__p", F.spark_partition_id())
    sizes = at.groupBy(*by, "__p").agg(F.count("*").alias("__n"))
    begins = sizes.withColumn("__begin", F.sum("__n").over(Window.partitionBy(*by).orderBy("__p")) - F.col("__n")).drop("__n")
    own = at.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "__p").orderBy(*order)))
    return own.join(begins, [*by, "__p"]).withColumn(name, (F.col("__begin") + F.col("__k") - 1).cast("long")).drop("__p", "__k", "__begin")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that Spark's writers made, wherever they reach."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
