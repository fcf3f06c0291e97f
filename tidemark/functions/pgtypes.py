"""PostgreSQL text values to document values, type by type.

A converter is a function from Column to Column, found by type name, alias or
OID; unknown types are text, indexed as keyword.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import datetimes
from tidemark.functions.inference import parse_double, parse_long, pg_bool

Converter = Callable[[Column], Column]


def as_text(value: Column) -> Column:
    return value


def as_int(value: Column) -> Column:
    return value.try_cast("int")


def as_float(value: Column) -> Column:
    return parse_double(value).cast("float")


def json_value(value: Column) -> Column:
    """Parsed as VARIANT; text that isn't JSON stays text."""
    return F.coalesce(F.try_parse_json(value), value.cast("variant"))


def array_elements(value: Column) -> Column:
    """Elements of a one-dimensional array literal; quoted ones may hold commas and escapes, NULL is null."""
    body = F.regexp_extract(value, r"^\{(.*)\}$", 1)
    found = F.regexp_extract_all(body, F.lit(r'(?:^|,)\s*("(?:[^"\\]|\\.)*"|[^,"]*)\s*(?=,|$)'), F.lit(1))
    bare = lambda x: F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), r"\\(.)", "$1")).when(F.upper(x) != "NULL", F.trim(x))
    return F.when(value.rlike(r"^\{.*\}$"), F.when(body == "", F.array().cast("array<string>")).otherwise(F.transform(found, bare)))


def legacy_array_elements(value: Column) -> Column:
    """Trim braces, split at every comma, strip quotes."""
    body = F.regexp_replace(value, r"^\{+|\}+$", "")
    return F.when(value.isNotNull(), F.when(body == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(body, ","), lambda x: F.regexp_replace(F.trim(x), '^"+|"+$', ""))))


def array_of(element: Converter) -> Converter:
    return lambda value: F.transform(array_elements(value), element)


def point(value: Column) -> Column:
    """(x,y) as {lat: y, lon: x}, both text; null if malformed."""
    pattern = r"^\(\s*([^,()]+)\s*,\s*([^,()]+)\s*\)$"
    part = lambda k: F.trim(F.regexp_extract(value, pattern, k))
    return F.when(value.rlike(pattern), F.struct(part(2).alias("lat"), part(1).alias("lon")))


def money(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\d.-]", "").try_cast("double")


def _unquoted(text: Column, escaped: str) -> Column:
    """A quoted text without its quotes; ``escaped`` is the pattern of an escape, its character in group 1."""
    return F.regexp_replace(F.regexp_replace(text, '^"|"$', ""), escaped, "$1")


def composite(value: Column) -> Column:
    """A row literal as field_1 to field_n, all text; quoted fields may hold commas, brackets and doubled or escaped quotes, and an empty one is the empty text."""
    body = F.regexp_extract(value, r"(?s)^\((.*)\)$", 1)
    found = F.regexp_extract_all(body, F.lit(r'(?s)(?:^|,)("(?:[^"\\]|\\.|"")*"|[^,"]*)(?=,|$)'), F.lit(1))
    # doubled quotes and backslash escapes are one character each
    plain = lambda x: F.when(x.startswith('"'), _unquoted(x, r'(?s)(?:\\|"(?="))(.)')).otherwise(x)
    fields = F.transform(found, lambda x, i: F.struct(F.concat(F.lit("field_"), (i + 1).cast("string")), plain(x)))
    return F.when(value.rlike(r"(?s)^\(.*\)$"), F.map_from_entries(fields))


def hstore(value: Column) -> Column:
    """"k"=>"v" pairs as a map of text; keys and values may be quoted and escaped, NULL is null, and a repeated key keeps its first value."""
    word = r'"(?:[^"\\]|\\.)*"|[^\s",=>]+'
    pairs = F.regexp_extract_all(value, F.lit(rf"(?s)(?:{word})\s*=>\s*(?:{word})"), F.lit(0))
    side = lambda p, k: F.regexp_extract(p, rf"(?s)^({word})\s*=>\s*({word})$", k)
    plain = lambda x: F.when(x.startswith('"'), _unquoted(x, r"(?s)\\(.)")).otherwise(x)
    entries = F.transform(pairs, lambda p: F.struct(plain(side(p, 1)).alias("k"), F.when(F.upper(side(p, 2)) != "NULL", plain(side(p, 2))).alias("v")))
    keys = F.transform(entries, lambda e: e["k"])
    first = F.filter(entries, lambda e, i: F.array_position(keys, e["k"]) == i + 1)
    return F.when(value.isNotNull(), F.map_from_entries(first))


@dataclass(frozen=True)
class PgType:
    oid: int
    name: str
    index_type: str
    convert: Converter
    aliases: tuple[str, ...] = ()


#: OIDs, names and index types of the protocol and the index.
BASE_TYPES = [
    PgType(20, "bigint", "long", parse_long, ("int8",)),
    PgType(21, "smallint", "integer", as_int, ("int2",)),
    PgType(23, "integer", "integer", as_int, ("int4", "int")),
    PgType(700, "real", "float", as_float, ("float4",)),
    PgType(701, "double precision", "double", parse_double, ("float8",)),
    PgType(1700, "numeric", "scaled_float", as_text, ("decimal",)),
    PgType(25, "text", "text", as_text),
    PgType(1042, "char", "keyword", as_text, ("bpchar", "character")),
    PgType(1043, "varchar", "text", as_text, ("character varying",)),
    PgType(19, "name", "keyword", as_text),
    PgType(16, "boolean", "boolean", pg_bool, ("bool",)),
    PgType(1082, "date", "date", datetimes.pg_date),
    PgType(1083, "time", "date", as_text, ("time without time zone",)),
    PgType(1114, "timestamp", "date", datetimes.pg_timestamp, ("timestamp without time zone",)),
    PgType(1184, "timestamptz", "date", datetimes.pg_timestamptz, ("timestamp with time zone",)),
    PgType(1266, "timetz", "date", as_text, ("time with time zone",)),
    PgType(17, "bytea", "binary", as_text),
    PgType(2950, "uuid", "keyword", as_text),
    PgType(114, "json", "object", json_value),
    PgType(3802, "jsonb", "object", json_value),
    PgType(1007, "_int4", "integer", array_of(as_int), ("integer[]",)),
    PgType(1009, "_text", "text", array_of(as_text), ("text[]",)),
    PgType(1016, "_int8", "long", array_of(parse_long), ("bigint[]",)),
    PgType(869, "inet", "ip", as_text),
    PgType(650, "cidr", "keyword", as_text),
    PgType(600, "point", "geo_point", point),
    PgType(718, "circle", "keyword", as_text),
    PgType(3614, "tsvector", "text", as_text),
    PgType(3615, "tsquery", "keyword", as_text),
]

#: Further types of the protocol. Intervals, bits, ranges and XML are documents' text as the server prints them.
ADVANCED_TYPES = [
    PgType(1186, "interval", "keyword", as_text),
    PgType(790, "money", "double", money),
    PgType(1560, "bit", "keyword", as_text),
    PgType(1562, "varbit", "keyword", as_text),
    PgType(3904, "int4range", "keyword", as_text),
    PgType(3926, "int8range", "keyword", as_text),
    PgType(3906, "numrange", "keyword", as_text),
    PgType(3908, "tsrange", "keyword", as_text),
    PgType(3910, "tstzrange", "keyword", as_text),
    PgType(3912, "daterange", "keyword", as_text),
    PgType(4451, "int4multirange", "keyword", as_text),
    PgType(4536, "int8multirange", "keyword", as_text),
    PgType(142, "xml", "text", as_text),
    PgType(0, "hstore", "object", hstore),
    PgType(1000, "_bool", "boolean", array_of(pg_bool), ("boolean[]",)),
    PgType(1021, "_float4", "float", array_of(as_float), ("real[]",)),
    PgType(1022, "_float8", "double", array_of(parse_double), ("double precision[]",)),
    PgType(2951, "_uuid", "keyword", array_of(as_text), ("uuid[]",)),
]

UNKNOWN = PgType(-1, "unknown", "keyword", as_text)


class TypeRegistry:
    """Base and advanced types, and those that a catalog adds: enums, composites, domains, arrays."""

    def __init__(self, extra: list[PgType] | None = None):
        self.by_oid: dict[int, PgType] = {}
        self.by_name: dict[str, PgType] = {}
        for t in [*BASE_TYPES, *ADVANCED_TYPES, *(extra or [])]:
            self.add(t)

    def add(self, t: PgType) -> None:
        if t.oid > 0:
            self.by_oid[t.oid] = t
        for name in (t.name, *t.aliases):
            self.by_name[name] = t

    def add_enum(self, oid: int, name: str) -> None:
        self.add(PgType(oid, name, "keyword", as_text))

    def add_composite(self, oid: int, name: str) -> None:
        self.add(PgType(oid, name, "object", composite))

    def add_domain(self, oid: int, name: str, base: str | int) -> None:
        of = self.find(base)
        self.add(PgType(oid, name, of.index_type, of.convert))

    def add_array(self, oid: int, name: str) -> None:
        self.add(PgType(oid, name, "text", array_of(as_text)))

    def find(self, key: str | int) -> PgType:
        return (self.by_oid.get(key) if isinstance(key, int) else self.by_name.get(key.lower())) or UNKNOWN

    def convert(self, key: str | int, value: Column) -> Column:
        return self.find(key).convert(value)

    def index_mapping(self, key: str | int) -> dict:
        kind = self.find(key).index_type
        extra = {
            "text": {"analyzer": "standard"},
            "date": {"format": "strict_date_optional_time||epoch_millis"},
            "scaled_float": {"scaling_factor": 100},
            "geo_point": {"ignore_malformed": True},
        }
        return {"type": kind} | extra.get(kind, {})
