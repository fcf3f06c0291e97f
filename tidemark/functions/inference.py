"""Types by value, for sources that send bytes without a schema.

Each value takes the first reading that fits. This turns "00123" into a number
and "t" into a truth value, so declared types are the default elsewhere and
this is on demand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.datetimes import parse_datetime

#: The spellings that read as truth values.
TRUE_WORDS = ("1", "t", "T", "TRUE", "true", "True")
FALSE_WORDS = ("0", "f", "F", "FALSE", "false", "False")

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_bool(value: Column) -> Column:
    """Null for any other spelling."""
    return F.when(value.isin(*TRUE_WORDS), True).when(value.isin(*FALSE_WORDS), False)


def pg_bool(value: Column) -> Column:
    return parse_bool(F.lower(value))


def parse_long(value: Column) -> Column:
    return F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast("long"))


def parse_double(value: Column) -> Column:
    return F.when(value.rlike(_NUMBER), value.try_cast("double"))


def repair_utf8(value: Column) -> Column:
    return F.make_valid_utf8(value.cast("string"))


def kind_of(value: Column, with_datetime: bool = True) -> Column:
    """datetime, long, double, boolean or string; null for null."""
    first = F.when(value.isNull(), F.lit(None))
    first = first.when(parse_datetime(value).isNotNull(), "datetime") if with_datetime else first
    return first.when(parse_long(value).isNotNull(), "long").when(parse_double(value).isNotNull(), "double").when(parse_bool(value).isNotNull(), "boolean").otherwise("string")


def infer_variant(value: Column, with_datetime: bool = True) -> Column:
    """The value as VARIANT in its inferred type."""
    readings = [parse_datetime(value)] if with_datetime else []
    readings += [parse_long(value), parse_double(value), parse_bool(value), repair_utf8(value)]
    return F.coalesce(*[r.cast("variant") for r in readings])
