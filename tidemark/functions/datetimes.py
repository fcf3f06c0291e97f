"""Date and time text to RFC 3339 with up to nine digits, as columns.

Seconds go through Spark's timestamps; the fraction is carried as text, so
nanoseconds survive although Spark keeps microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"^\d{4}-\d{2}-\d{2}$"
_TIME = r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,9})?$"
_PLAIN = r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2})(\.\d{1,9})?$"
_ZONED = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"
_PG_ZONED = r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2})(\.\d{1,9})?([+-]\d{2}(?::\d{2})?)$"


def _fraction(value: Column, pattern: str) -> Column:
    """The fraction without trailing zeros, empty if nothing is left."""
    digits = F.regexp_replace(F.regexp_extract(value, pattern, 3), "0+$", "")
    return F.when(digits == ".", "").otherwise(digits)


def _seconds(value: Column, pattern: str) -> Column:
    return F.try_to_timestamp(F.concat(F.regexp_extract(value, pattern, 1), F.lit(" "), F.regexp_extract(value, pattern, 2)), F.lit("yyyy-MM-dd HH:mm:ss"))


def _offset_seconds(zone: Column) -> Column:
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    hours = F.coalesce(F.substring(zone, 2, 2).try_cast("int"), F.lit(0))
    minutes = F.coalesce(F.substring(zone, 5, 2).try_cast("int"), F.lit(0))
    return F.when(zone == "Z", 0).otherwise(sign * (hours * 3600 + minutes * 60))


def _formatted(seconds: Column, fraction: Column, zone: Column | str = "Z") -> Column:
    return F.concat(F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit(zone) if isinstance(zone, str) else zone)


def _shifted(seconds: Column, by: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(seconds) - by)


def _utc(value: Column, pattern: str) -> Column:
    zone = F.regexp_extract(value, pattern, 4)
    return F.when(value.rlike(pattern), _formatted(_shifted(_seconds(value, pattern), _offset_seconds(zone)), _fraction(value, pattern)))


def _plain(value: Column) -> Column:
    return F.when(value.rlike(_PLAIN), _formatted(_seconds(value, _PLAIN), _fraction(value, _PLAIN)))


def parse_datetime(value: Column) -> Column:
    """MySQL text: date and time, date, time of year 0, or RFC 3339, in UTC; null if it is none of them. The session's zone is UTC."""
    date = F.when(value.rlike(_DATE), _formatted(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")), F.lit("")))
    digits = F.regexp_replace(F.regexp_extract(value, _TIME, 2), r"\.?0+$", "")
    clock = F.when(value.rlike(_TIME), F.concat(F.lit("0000-01-01T"), F.substring(value, 1, 8), digits, F.lit("Z")))
    return F.coalesce(_plain(value), date, clock, _utc(value, _ZONED))


def pg_date(value: Column) -> Column:
    """A valid date as it is; anything else too."""
    return F.coalesce(F.date_format(F.try_to_timestamp(value, F.lit("yyyy-MM-dd")), "yyyy-MM-dd"), value)


def pg_timestamp(value: Column) -> Column:
    """Without a shift of zone; text that doesn't parse stays."""
    zone = F.regexp_extract(value, _ZONED, 4)
    kept = F.when(value.rlike(_ZONED), _formatted(_seconds(value, _ZONED), _fraction(value, _ZONED), F.when(_offset_seconds(zone) == 0, "Z").otherwise(zone)))
    return F.coalesce(_plain(value), kept, value)


def pg_timestamptz(value: Column) -> Column:
    """In UTC; text that doesn't parse stays."""
    return F.coalesce(_utc(value, _PG_ZONED), _utc(value, _ZONED), value)


def rfc3339_nano(ts: Column) -> Column:
    """A timestamp with its fraction trimmed of zeros."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0*$", ""), F.lit("Z"))


def from_pg_epoch_micros(micros: Column) -> Column:
    """Microseconds since 2000-01-01, as the replication protocol counts."""
    return F.timestamp_micros(micros + F.lit(946684800000000))
