"""What servers say about themselves, as tables: slots, publications, topologies, shards.

A catalog is recorded as rows, by a JDBC read or an export; these operators say
what follows from it. Statements that change a server are returned as text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.positions import lag_bytes, lsn_number

#: Ranges of one collection that workers hold.
RANGES = 1_000_000


def slot_actions(slots: DataFrame, wanted: DataFrame, plugin: str = "pgoutput") -> DataFrame:
    """(slot_name, action): create a wanted slot that is missing, recreate one of another plugin, reuse, or drop an idle one nobody wants.

    ``slots``: slot_name, plugin, active; ``wanted``: slot_name. An active slot is never dropped.
    """
    both = slots.withColumn("there", F.lit(True)).join(wanted.select("slot_name", F.lit(True).alias("wanted")).distinct(), "slot_name", "full")
    action = F.when(F.col("there").isNull(), "create").when(F.col("wanted").isNull(), F.when(F.col("active"), "keep").otherwise("drop")).when(F.col("plugin") != plugin, "recreate").otherwise("reuse")
    return both.select("slot_name", action.alias("action"))


def slot_lags(slots: DataFrame, current: Column) -> DataFrame:
    """(slot_name, active, lag): bytes of log that each slot holds back."""
    return slots.select("slot_name", "active", lag_bytes(current, F.col("confirmed_lsn")).alias("lag"))


def oldest_slot(slots: DataFrame) -> DataFrame:
    """The one slot that keeps the server's log longest."""
    return slots.agg(F.min_by("slot_name", F.struct(lsn_number(F.col("restart_lsn")), "slot_name")).alias("slot_name"))


def publication_changes(published: DataFrame, wanted: DataFrame) -> DataFrame:
    """(table, change) that a publication needs: tables to add and tables to drop."""
    have, want = published.select("table").distinct(), wanted.select("table").distinct()
    return want.join(have, "table", "left_anti").withColumn("change", F.lit("add")).unionByName(have.join(want, "table", "left_anti").withColumn("change", F.lit("drop")))


def topology(hello: Column) -> Column:
    """What a server's greeting (JSON) says it is."""
    return F.when(F.get_json_object(hello, "$.msg") == "isdbgrid", "sharded").when(F.get_json_object(hello, "$.setName").isNotNull(), "replicaset").when(hello.isNotNull(), "standalone")


def shard_of(rows: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """``rows`` with the ``shard`` whose range [low, high) holds their long key; null for a key in none.

    ``ranges`` are those of one collection, don't overlap, and are ``RANGES`` at
    most; they go to the workers as sorted arrays, in which each key is searched.
    """
    found = ranges.select("low", "high", "shard").orderBy("low").limit(RANGES + 1).toPandas()
    if len(found) > RANGES:
        raise ValueError(f"over {RANGES} ranges")
    low, high, shard = found["low"].to_numpy("int64"), found["high"].to_numpy("int64"), found["shard"].to_numpy(object)

    @F.pandas_udf("string")
    def lookup(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        k = keys.fillna(0).to_numpy("int64")
        at = np.searchsorted(low, k, side="right") - 1
        inside = known & (at >= 0)
        inside[inside] &= k[inside] < high[at[inside]]
        out = np.full(len(k), None, object)
        out[inside] = shard[at[inside]]
        return pd.Series(out)

    return rows.withColumn("shard", lookup(F.col(key).cast("long")))


def merged_shards(streams: list[DataFrame]) -> DataFrame:
    """Change streams of all shards as one; what balancing moved between shards (``from_migrate``) is no change."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out.filter(~F.coalesce(F.col("from_migrate"), F.lit(False))).drop("from_migrate")
