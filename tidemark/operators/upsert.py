"""Last write wins per key, guarded by sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import DELETE, INDEX_OPERATIONS, TRUNCATE, UPDATE


def known_operations(events: DataFrame, op: str = "op") -> DataFrame:
    """Upper-cased operations that an index takes; others are skipped."""
    return events.withColumn(op, F.upper(op)).filter(F.col(op).isin(*INDEX_OPERATIONS))


def latest(events: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Each key's event of greatest ``seq``; of several, as a snapshot's rows have one ``seq``, that of greatest position, operation and data.

    One aggregation and one shuffle: each task sorts its rows by key, spilling if
    it must, and sends one row a key, so a key with a third of all events costs no
    more than any other. A window would send all rows and buffer the key's.
    """
    rest = [c for c in events.columns if c not in keys]
    order = F.struct(seq, *[c for c in ("position", "op", "data") if c in rest])
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


def current_state(events: DataFrame, keys: list[str], seq: str = "seq", op: str = "op") -> DataFrame:
    """What an index holds after all events: latest rows that aren't deletions."""
    return latest(known_operations(events, op), keys, seq).filter(F.col(op) != DELETE)


def merge_state(state: DataFrame, batch: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """State and batch by key; an older event never replaces a newer row. Deletions stay as tombstones, so later old events lose too."""
    return latest(state.unionByName(batch, allowMissingColumns=True), keys, seq)


def split_key_changes(events: DataFrame, before_key: str, after_key: str, op: str = "op") -> DataFrame:
    """An update that changes the key becomes a deletion of the old and an upsert of the new key."""
    changed = (F.col(op) == UPDATE) & (F.col(before_key) != F.col(after_key))
    as_rows = F.when(changed, F.array(F.struct(F.lit(DELETE).alias("o"), F.col(before_key).alias("k")), F.struct(F.lit(UPDATE).alias("o"), F.col(after_key).alias("k")))).otherwise(F.array(F.struct(F.col(op).alias("o"), F.coalesce(after_key, before_key).alias("k"))))
    rest = [c for c in events.columns if c not in (op, before_key, after_key)]
    return events.select(*rest, F.explode(as_rows).alias("__e")).select(*rest, F.col("__e.o").alias(op), F.col("__e.k").alias("pk"))


def after_truncation(events: DataFrame, table: str = "table", seq: str = "seq", op: str = "op") -> DataFrame:
    """Events of each table later than its last TRUNCATE. What is broadcast is a row a table."""
    cut = events.filter(F.col(op) == TRUNCATE).groupBy(table).agg(F.max(seq).alias("__cut"))
    return events.filter(F.col(op) != TRUNCATE).join(cut, table, "left").filter(F.col("__cut").isNull() | (F.col(seq) > F.col("__cut"))).drop("__cut")


def fill_unchanged(previous: Column, current: Column, unchanged: Column) -> Column:
    """A column that the log left out as unchanged keeps its previous value."""
    return F.when(unchanged, previous).otherwise(current)


def merge_partial(events: DataFrame, keys: list[str], columns: list[str], seq: str = "seq", unchanged: str = "unchanged") -> DataFrame:
    """Latest value of each column among events that carry it; ``unchanged`` is an array of column names."""
    carried = lambda c: ~F.coalesce(F.array_contains(unchanged, c), F.lit(False))
    values = [F.max_by(F.struct(F.col(c).alias("v")), F.when(carried(c), F.col(seq))).alias(c) for c in columns]
    out = events.groupBy(*keys).agg(*values, F.max(seq).alias(seq))
    return out.select(*keys, *[F.col(f"{c}.v").alias(c) for c in columns], seq)
