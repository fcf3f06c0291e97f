"""Log positions as ordered values: LSNs, binary-log positions, resume tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LSN = r"^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"
_HALF = 4294967296


def lsn_number(lsn: Column) -> Column:
    """64 bits as decimal(20,0); null for malformed text."""
    part = lambda k: F.conv(F.split(lsn, "/")[k], 16, 10).cast("decimal(20,0)")
    return F.when(lsn.rlike(_LSN), (part(0) * F.lit(_HALF).cast("decimal(20,0)") + part(1)).cast("decimal(20,0)"))


def lsn_valid(lsn: Column) -> Column:
    """1 to 8 hex digits a side and not zero."""
    return F.coalesce(lsn_number(lsn) > 0, F.lit(False))


def lsn_format(number: Column) -> Column:
    """Upper-case hex without leading zeros, the low half not padded."""
    high = F.floor(number / F.lit(_HALF)).cast("long")
    low = (number - high.cast("decimal(20,0)") * F.lit(_HALF).cast("decimal(20,0)")).cast("long")
    return F.concat(F.hex(high), F.lit("/"), F.hex(low))


def lsn_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null if either is malformed."""
    x, y = lsn_number(a), lsn_number(b)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def lsn_advance(lsn: Column, by: Column) -> Column:
    return lsn_format((lsn_number(lsn) + by.cast("decimal(20,0)")).cast("decimal(20,0)"))


def lag_bytes(latest: Column, committed: Column) -> Column:
    """Bytes not yet committed, none if the commit is ahead."""
    return F.greatest(lsn_number(latest) - lsn_number(committed), F.lit(0).cast("decimal(20,0)")).cast("decimal(20,0)")


def binlog_file_number(file: Column) -> Column:
    return F.regexp_extract(file, r"\.(\d+)$", 1).try_cast("long")


def binlog_order(file: Column, position: Column) -> Column:
    """Sorts by the number of the file, then its name, then the position."""
    return F.struct(binlog_file_number(file).alias("number"), file.alias("file"), position.cast("long").alias("position"))


def binlog_compare(file_a: Column, pos_a: Column, file_b: Column, pos_b: Column) -> Column:
    a, b = binlog_order(file_a, pos_a), binlog_order(file_b, pos_b)
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def encode_token(token: Column) -> Column:
    return F.base64(token.cast("binary"))


def decode_token(text: Column) -> Column:
    """Null if it is no base64: a stream then starts from now."""
    good = text.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return F.when(good, F.unbase64(text).cast("string"))


def checkpoint_valid(source_type: Column, position: Column) -> Column:
    """Whether a stored position can be resumed from."""
    mysql = position.rlike(r"^[^:]+\.\d+:\d+$")
    return F.coalesce(F.when(source_type == "postgresql", lsn_valid(position)).when(source_type == "mysql", mysql).when(source_type == "mongodb", decode_token(position).isNotNull() & (F.length(position) > 0)), F.lit(False))
