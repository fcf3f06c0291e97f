"""Lookups, keyed unions and differences over catalogs and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import OPERATIONS

#: Lookups of at most so many bytes are broadcast; larger ones are left to the planner.
BROADCAST_BYTES = 32_000_000


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only where the plan's own size estimate is within the limit."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit else df


def lookup(rows: DataFrame, catalog: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    return rows.join(small(catalog), on, how)


def include_tables(events: DataFrame, tables: list[str], column: str = "table", most: int = 1000) -> DataFrame:
    """Events of the listed tables, by exact name; an empty list is all."""
    if not tables:
        return events
    if len(tables) <= most:
        return events.filter(F.col(column).isin(tables))
    names = events.sparkSession.createDataFrame([(t,) for t in tables], f"`{column}` string")
    return events.join(names, column, "left_semi")


def missing(wanted: DataFrame, present: DataFrame, on: str | list[str]) -> DataFrame:
    return wanted.join(present, on, "left_anti")


def only(rows: DataFrame, named: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is in another table."""
    return rows.join(small(named), on, "left_semi")


def latest_of_those(rows: DataFrame, facts: DataFrame, on: str, value: str, wanted: Column) -> DataFrame:
    """Rows that have a fact as ``wanted``, with the greatest ``value`` of all their facts: a subquery and an EXISTS in one pass over the facts."""
    per = facts.groupBy(on).agg(F.max(value).alias(value), F.bool_or(wanted).alias("__wanted"))
    return rows.join(per.filter("__wanted").drop("__wanted"), on)


def change_operation(kind: Column) -> Column:
    """Change-stream operation to log operation; null for others."""
    return F.when(kind == "insert", "INSERT").when(kind.isin("update", "replace"), "UPDATE").when(kind == "delete", "DELETE")


def valid_operation(op: Column) -> Column:
    return F.upper(op).isin(*OPERATIONS)


def keyed_union(new: DataFrame, old: DataFrame, key: str, dropped: list | None = None) -> DataFrame:
    """All new rows, and old ones whose key is not among them nor ``dropped``."""
    kept = old.join(new.select(key), key, "left_anti")
    return new.unionByName(kept.filter(~F.col(key).isin(dropped)) if dropped else kept)


def started_and_finished(before: DataFrame, after: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Keys only in ``after``, and keys only in ``before``."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    return b.join(a, key, "left_anti"), a.join(b, key, "left_anti")


def ordered_values(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Each group's values as an array in the given order, ties in order of the values."""
    return df.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v")))), lambda x: x["__v"]).alias("items"))


def needs_initial_sync(enabled: bool, forced: bool, has_checkpoint: bool, target: DataFrame | None) -> bool:
    """Off, forced, already positioned, already filled, else yes; looks at one row of the target."""
    if not enabled:
        return False
    if forced:
        return True
    return not has_checkpoint and (target is None or target.isEmpty())
