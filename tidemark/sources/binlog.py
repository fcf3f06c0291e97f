"""Binary-log row events (version 4 of the log, rows events 1 and 2) to rows.

A rows event names its columns only by the TABLE_MAP before it, so each server's
events are read in log order: one task a server, batch by batch, holding nothing
but the maps. Names, keys and signs come from the map's optional metadata, else
from a catalog.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import CHANGE_EVENT

SCHEMA = "server string, file string, pos long, seq long, kind string, op string, schema_name string, table string, pk string, data string, old_data string"

#: Numbers of events and of column types in the log.
ROTATE, XID, TABLE_MAP = 4, 16, 19
ROWS = {23: ("INSERT", 1), 24: ("UPDATE", 1), 25: ("DELETE", 1), 30: ("INSERT", 2), 31: ("UPDATE", 2), 32: ("DELETE", 2)}
TINY, SHORT, LONG, FLOAT, DOUBLE, NULL, TIMESTAMP, LONGLONG, INT24, DATE = range(1, 11)
YEAR, VARCHAR, BIT, TIMESTAMP2, DATETIME2, TIME2 = 13, 15, 16, 17, 18, 19
JSON, NEWDECIMAL, ENUM, SET, BLOB, VAR_STRING, STRING, GEOMETRY = 245, 246, 247, 248, 252, 253, 254, 255
_INTEGERS = {TINY: 1, SHORT: 2, INT24: 3, LONG: 4, LONGLONG: 8}
_NUMERIC = {*_INTEGERS, FLOAT, DOUBLE, NEWDECIMAL}
#: Bytes of metadata of each type that has some.
_META = {FLOAT: 1, DOUBLE: 1, BLOB: 1, JSON: 1, GEOMETRY: 1, TIMESTAMP2: 1, DATETIME2: 1, TIME2: 1, VARCHAR: 2, BIT: 2, NEWDECIMAL: 2, VAR_STRING: 2, STRING: 2, ENUM: 2, SET: 2}
#: Bytes that so many decimal digits take.
_DIGIT_BYTES = (0, 1, 1, 2, 2, 3, 3, 4, 4, 4)


class EventError(ValueError):
    pass


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise EventError("event ends early")
        out, self.at = self.data[self.at : self.at + n], self.at + n
        return out

    def number(self, n: int, signed: bool = False, order: str = "little") -> int:
        return int.from_bytes(self.take(n), order, signed=signed)

    def length(self) -> int:
        """A length in one, three, four or nine bytes."""
        first = self.number(1)
        return first if first < 251 else self.number({252: 2, 253: 3, 254: 8}.get(first, -1))

    def left(self) -> int:
        return len(self.data) - self.at


def _bits(data: bytes, count: int) -> list[bool]:
    return [bool(data[k // 8] >> k % 8 & 1) for k in range(count)]


@dataclass
class TableMap:
    schema: str
    table: str
    types: list[int]
    meta: list[bytes]
    names: list[str] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)
    unsigned: list[bool] = field(default_factory=list)


def read_table_map(r: _Bytes, catalog: dict[str, tuple[list[str], list[str]]]) -> tuple[int, TableMap]:
    number = r.number(6)
    r.take(2)
    schema, _ = r.take(r.number(1)).decode("utf-8", "replace"), r.take(1)
    table, _ = r.take(r.number(1)).decode("utf-8", "replace"), r.take(1)
    types = list(r.take(r.length()))
    described = _Bytes(r.take(r.length()))
    meta = [described.take(_META.get(t, 0)) for t in types]
    r.take((len(types) + 7) // 8)
    out = TableMap(schema, table, types, meta, unsigned=[False] * len(types))
    while r.left() > 1:
        kind = r.number(1)
        body = _Bytes(r.take(r.length()))
        if kind == 1:
            signs = iter([b >> (7 - k) & 1 for b in body.data for k in range(8)])
            out.unsigned = [bool(next(signs, 0)) if t in _NUMERIC else False for t in types]
        elif kind == 4:
            while body.left():
                out.names.append(body.take(body.length()).decode("utf-8", "replace"))
        elif kind == 8:
            while body.left():
                out.keys.append(body.length())
    names, keys = catalog.get(f"{schema}.{table}", ([], []))
    out.names = out.names or list(names) or [f"column_{k + 1}" for k in range(len(types))]
    out.keys = out.keys or [out.names.index(k) for k in keys]
    return number, out


def _decimal(r: _Bytes, precision: int, scale: int) -> str:
    """Nine digits in four bytes, the rest of either side in fewer; the first bit is the sign."""
    whole = precision - scale
    sizes = [_DIGIT_BYTES[whole % 9], *[4] * (whole // 9), *[4] * (scale // 9), _DIGIT_BYTES[scale % 9]]
    raw = bytearray(r.take(sum(sizes)))
    negative = not raw[0] & 0x80
    raw[0] ^= 0x80
    body = _Bytes(bytes(b ^ 0xFF for b in raw) if negative else bytes(raw))
    parts = [body.number(n, order="big") for n in sizes]
    left = "".join([str(parts[0]) if sizes[0] else "", *[f"{p:09d}" for p in parts[1 : 1 + whole // 9]]]).lstrip("0") or "0"
    right = "".join([*[f"{p:09d}" for p in parts[1 + whole // 9 : -1]], f"{parts[-1]:0{scale % 9}d}" if scale % 9 else ""])
    return ("-" if negative else "") + left + (f".{right}" if right else "")


def _fraction(r: _Bytes, digits: int) -> str:
    n = (digits + 1) // 2
    micros = r.number(n, order="big") * 100 ** (3 - n) if n else 0
    return f".{micros:06d}"[: digits + 1] if digits else ""


def _value(r: _Bytes, kind: int, meta: bytes, unsigned: bool):
    if kind == STRING:
        # the real type, and two bits of a long text's length, are in the first byte
        real, size = meta[0] | 0x30, meta[1] | ((meta[0] & 0x30) ^ 0x30) << 4
        if real not in (ENUM, SET):
            return r.take(r.number(1 if size < 256 else 2)).decode("utf-8", "replace")
        kind, meta = real, bytes([real, meta[1]])
    if kind in _INTEGERS:
        return r.number(_INTEGERS[kind], signed=not unsigned)
    if kind in (FLOAT, DOUBLE):
        return struct.unpack("<f" if kind == FLOAT else "<d", r.take(4 if kind == FLOAT else 8))[0]
    if kind == NEWDECIMAL:
        return _decimal(r, meta[0], meta[1])
    if kind in (VARCHAR, VAR_STRING):
        return r.take(r.number(1 if int.from_bytes(meta, "little") < 256 else 2)).decode("utf-8", "replace")
    if kind in (BLOB, GEOMETRY, JSON):
        body = r.take(r.number(meta[0]))
        try:
            return body.decode() if kind == BLOB else base64.b64encode(body).decode()
        except UnicodeDecodeError:
            return base64.b64encode(body).decode()
    if kind in (ENUM, SET):
        return r.number(meta[1])
    if kind == BIT:
        return r.number(meta[1] + (meta[0] > 0), order="big")
    if kind == YEAR:
        year = r.number(1)
        return year + 1900 if year else 0
    if kind == DATE:
        v = r.number(3)
        return f"{v >> 9:04d}-{v >> 5 & 15:02d}-{v & 31:02d}"
    if kind == TIMESTAMP:
        return r.number(4)
    if kind == TIMESTAMP2:
        # seconds since 1970, as text so that the fraction stays
        return f"{r.number(4, order='big')}{_fraction(r, meta[0])}"
    if kind == DATETIME2:
        v = r.number(5, order="big") - 0x8000000000
        day, clock = v >> 17, v & 0x1FFFF
        return f"{(day >> 5) // 13:04d}-{(day >> 5) % 13:02d}-{day & 31:02d} {clock >> 12:02d}:{clock >> 6 & 63:02d}:{clock & 63:02d}{_fraction(r, meta[0])}"
    if kind == TIME2:
        n = (meta[0] + 1) // 2
        v = r.number(3 + n, order="big") - (0x800000 << 8 * n)
        clock, micros = abs(v) >> 8 * n, (abs(v) & ((1 << 8 * n) - 1)) * 100 ** (3 - n)
        return f"{'-' if v < 0 else ''}{clock >> 12:02d}:{clock >> 6 & 63:02d}:{clock & 63:02d}" + (f".{micros:06d}"[: meta[0] + 1] if n else "")
    raise EventError(f"column type {kind}")


class Decoder:
    """State of one server: its file and its table maps."""

    def __init__(self, catalog: dict[str, tuple[list[str], list[str]]] | None = None, checksum: bool = True, file: str = ""):
        self.catalog, self.checksum, self.file, self.maps = catalog or {}, checksum, file, {}

    def _row(self, r: _Bytes, table: TableMap, present: list[bool]) -> dict:
        shown = [k for k, p in enumerate(present) if p]
        empty = _bits(r.take((len(shown) + 7) // 8), len(shown))
        return {table.names[k]: None if none else _value(r, table.types[k], table.meta[k], table.unsigned[k]) for k, none in zip(shown, empty)}

    def decode(self, event: bytes) -> list[dict]:
        if len(event) < 19:
            raise EventError("event ends early")
        kind, pos = event[4], int.from_bytes(event[13:17], "little")
        r = _Bytes(event[19 : len(event) - 4 * self.checksum])
        at = {"file": self.file, "pos": pos}
        if kind == ROTATE:
            start = r.number(8)
            self.file = r.take(r.left()).decode("utf-8", "replace")
            return [{"kind": "ROTATE", "file": self.file, "pos": start}]
        if kind == XID:
            return [{"kind": "COMMIT", **at}]
        if kind == TABLE_MAP:
            number, table = read_table_map(r, self.catalog)
            self.maps[number] = table
            return []
        if kind not in ROWS:
            return []
        op, version = ROWS[kind]
        table = self.maps.get(r.number(6))
        if table is None:
            raise EventError("rows of an unknown table")
        r.take(2)
        if version == 2:
            r.take(r.number(2) - 2)
        count = r.length()
        images = [_bits(r.take((count + 7) // 8), count) for _ in range(2 if op == "UPDATE" else 1)]
        dump = lambda row: json.dumps(row, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        out = []
        while r.left():
            rows = [self._row(r, table, present) for present in images]
            keys = [rows[-1].get(table.names[k]) for k in table.keys]
            pk = ":".join("<nil>" if k is None else str(k) for k in keys) if keys else hashlib.sha256(dump(rows[-1]).encode()).hexdigest()
            out.append({"kind": op, "op": op, "schema_name": table.schema, "table": table.table, "pk": pk, "data": dump(rows[-1]), "old_data": dump(rows[0]) if op == "UPDATE" else None, **at})
        return out


def decode_events(frames: DataFrame, catalog: dict[str, tuple[list[str], list[str]]] | None = None, checksum: bool = True) -> DataFrame:
    """``frames``: server, seq, frame (binary), a log's events in order. ``catalog``: "schema.table" to its column names and its key's. An event that can't be read is a row of kind ERROR with the reason as data."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64() if n in ("pos", "seq") else pa.string() for n in names]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        server, decoder = None, Decoder(catalog, checksum)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                # partitions hold whole servers in order, one after another
                if row["server"] != server:
                    server, decoder = row["server"], Decoder(catalog, checksum)
                try:
                    found = decoder.decode(row["frame"] or b"")
                except EventError as e:
                    found = [{"kind": "ERROR", "file": decoder.file, "data": str(e)}]
                out += [{"server": server, "seq": row["seq"]} | x for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in out], k) for n, k in zip(names, kinds)], names)

    return frames.select("server", "seq", "frame").repartition("server").sortWithinPartitions("server", "seq").mapInArrow(kernel, SCHEMA)


def change_events(rows: DataFrame) -> DataFrame:
    """Decoded rows as change events; the position is file and place."""
    kept = rows.filter("op is not null")
    return kept.select("op", F.lit("mysql").alias("source_type"), F.concat_ws(":", "file", F.col("pos").cast("string")).alias("position"), "seq", "pk", "schema_name", "table", "data").select(*[f.name for f in CHANGE_EVENT.fields])


def encode_event(kind: int, body: bytes, pos: int = 0) -> bytes:
    """An event without a checksum. For tests and replays."""
    return struct.pack("<IBIIIH", 0, kind, 1, 19 + len(body), pos, 0) + body


def encode_table_map(number: int, schema: str, table: str, columns: list[tuple[str, int, bytes]], keys: list[int] = (), unsigned: list[int] = ()) -> bytes:
    """A TABLE_MAP event; columns are (name, type, metadata), and those numbered in ``unsigned`` have no sign."""
    text = lambda s: bytes([len(s.encode())]) + s.encode()
    meta = b"".join(m for _, _, m in columns)
    numeric = [k for k, (_, t, _) in enumerate(columns) if t in _NUMERIC]
    signs = bytearray((len(numeric) + 7) // 8)
    for place, k in enumerate(numeric):
        signs[place // 8] |= (k in unsigned) << (7 - place % 8)
    names = b"".join(text(n) for n, _, _ in columns)
    more = b"".join(bytes([kind, len(b)]) + b for kind, b in ((1, bytes(signs)), (4, names), (8, bytes(keys))) if b)
    body = number.to_bytes(6, "little") + b"\1\0" + text(schema) + b"\0" + text(table) + b"\0" + bytes([len(columns)]) + bytes(t for _, t, _ in columns) + bytes([len(meta)]) + meta + bytes((len(columns) + 7) // 8) + more
    return encode_event(TABLE_MAP, body)


def encode_rows(op: str, number: int, columns: int, images: list[list[bytes | None]], pos: int) -> bytes:
    """A rows event of version 2; each image is a row's encoded values, None for null, and an update has two for each row."""
    full = bytes(sum(1 << k for k in range(8) if 8 * b + k < columns) for b in range((columns + 7) // 8))
    rows = b""
    for image in images:
        rows += bytes(sum((image[8 * b + k] is None) << k for k in range(8) if 8 * b + k < columns) for b in range((columns + 7) // 8)) + b"".join(v for v in image if v is not None)
    kind = next(k for k, v in ROWS.items() if v == (op, 2))
    return encode_event(kind, number.to_bytes(6, "little") + b"\1\0\2\0" + bytes([columns]) + full * (2 if op == "UPDATE" else 1) + rows, pos)


def encode_decimal(value: str, precision: int, scale: int) -> bytes:
    d = Decimal(value)
    digits = f"{d.copy_abs():.{scale}f}"
    left, _, right = digits.partition(".")
    whole = precision - scale
    left = left.rjust(whole, "0")
    head = whole % 9
    out = int(left[:head] or 0).to_bytes(_DIGIT_BYTES[head], "big") if head else b""
    for k in range(head, whole, 9):
        out += int(left[k : k + 9]).to_bytes(4, "big")
    for k in range(0, scale - scale % 9, 9):
        out += int(right[k : k + 9]).to_bytes(4, "big")
    if scale % 9:
        out += int(right[scale - scale % 9 :]).to_bytes(_DIGIT_BYTES[scale % 9], "big")
    raw = bytearray(b ^ 0xFF for b in out) if d < 0 else bytearray(out)
    raw[0] ^= 0x80
    return bytes(raw)
