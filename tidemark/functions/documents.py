"""Documents: keys, metadata, rendering, flattening."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import METADATA_FIELDS


def composite_key(*columns: Column) -> Column:
    """Values joined by a colon; a null prints as <nil>."""
    return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("<nil>")) for c in columns])


def quote_name(name: str) -> str:
    """An identifier for SQL text, quotes doubled; a dotted name part by part."""
    return ".".join('"' + part.replace('"', '""') + '"' for part in name.split("."))


def row_key(columns: Iterable[Column]) -> Column:
    """A key for tables without one: a digest of the whole row."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def table_of(data: Column) -> Column:
    """The table or collection that a JSON document names, else empty."""
    return F.coalesce(F.get_json_object(data, "$._table"), F.get_json_object(data, "$._collection"), F.lit(""))


def index_name(prefix: str, table: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.when(F.coalesce(table, F.lit("")) == "", "default").otherwise(F.lower(table)))


def strip_metadata(df: DataFrame, fields: Iterable[str] = METADATA_FIELDS) -> DataFrame:
    return df.drop(*fields)


def strip_metadata_json(data: Column, fields: Iterable[str] = METADATA_FIELDS) -> Column:
    """A JSON object without the reserved keys; other values stay exact, and text that is no object stays."""
    parsed = F.from_json(data, "map<string,variant>")
    kept = F.to_json(F.map_filter(parsed, lambda k, v: ~k.isin(*fields)), {"ignoreNullFields": "false"})
    return F.coalesce(F.when(parsed.isNotNull() & data.rlike(r"^\s*\{"), kept), data)


def render(df: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """JSON with sorted keys and nulls kept."""
    names = sorted(columns or df.columns)
    return F.to_json(F.struct(*[F.col(n) for n in names]), {"ignoreNullFields": "false"})


def flatten_columns(schema: T.StructType, prefix: str = "", depth: int = 3) -> list[Column]:
    """Nested fields as columns with dotted names, down to ``depth`` levels; arrays and maps stay, and so does a root ``_id``."""

    def walk(struct: T.StructType, path: str, name: str, left: int) -> list[Column]:
        out: list[Column] = []
        for f in struct.fields:
            here, label = f"{path}.`{f.name}`" if path else f"`{f.name}`", f"{name}.{f.name}" if name else f.name
            deeper = isinstance(f.dataType, T.StructType) and left > 0 and not (not path and f.name == "_id")
            out += walk(f.dataType, here, label, left - 1) if deeper else [F.col(here).alias(label)]
        return out

    return walk(schema, "", prefix, depth)


def flatten_json(data: Column, prefix: str = "", depth: int = 3) -> Column:
    """``flatten_columns`` for JSON text of any shape; no object gives null. Of fields that get one name the last stays, and empty objects go."""
    as_map = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    named = f"{prefix}." if prefix else ""

    def deeper(e: Column) -> Column:
        inner = F.transform(F.map_entries(as_map(e["value"])), lambda x: pair(F.concat(e["key"], F.lit("."), x["key"]), x["value"]))
        return F.coalesce(F.when(e["key"] != "_id", inner), F.array(e))

    def last_of_a_name(fields: Column) -> Column:
        keys = F.transform(fields, lambda x: x["key"])
        kept = F.filter(fields, lambda x, k: F.array_position(F.slice(keys, k + 2, F.size(fields)), x["key"]) == 0)
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), fields).otherwise(kept)

    def flat(root: Column) -> Column:
        fields = F.transform(F.map_entries(root), lambda x: pair(F.concat(F.lit(named), x["key"]), x["value"]))
        for _ in range(depth):
            fields = F.flatten(F.transform(fields, deeper))
        return F.transform(F.array(fields), last_of_a_name)[0]

    # one-element arrays bind what is used more than once
    fields = F.transform(F.array(as_map(F.try_parse_json(data))), flat)[0]
    return F.to_json(F.map_from_entries(fields), {"ignoreNullFields": "false"})
