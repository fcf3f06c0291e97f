"""Extended JSON read value by value: the plain version of ``functions.bson``."""

import base64
from datetime import UTC, datetime


def _instant(value) -> str:
    """Milliseconds or RFC 3339 text to RFC 3339 in UTC, trailing zeros trimmed."""
    if isinstance(value, dict):
        value = int(value.get("$numberLong", 0))
    if isinstance(value, int | float):
        at = datetime.fromtimestamp(0, UTC).timestamp() + value / 1000
        whole = datetime.fromtimestamp(int(at // 1), UTC)
        millis = int(value) % 1000
        return whole.strftime("%Y-%m-%dT%H:%M:%S") + (f".{millis:03d}".rstrip("0") if millis else "") + "Z"
    try:
        at = datetime.fromisoformat(str(value).replace("Z", "+00:00")).astimezone(UTC)
    except ValueError:
        return str(value)
    return at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{at.microsecond:06d}".rstrip("0") if at.microsecond else "") + "Z"


def _binary(value: dict) -> dict:
    body = value.get("$binary", {})
    body = body if isinstance(body, dict) else {"base64": body, "subType": value.get("$type", "00")}
    kind = int(str(body.get("subType", "00")), 16)
    return {"$binary": {"base64": body.get("base64", ""), "subType": f"{kind:02x}"}}


def _regex(value: dict) -> dict:
    body = value.get("$regularExpression", {})
    return {"$regex": body.get("pattern", value.get("$regex", "")), "$options": body.get("options", value.get("$options", ""))}


#: One reading for each wrapper key of extended JSON.
_WRAPPERS = {
    "$oid": lambda v: v["$oid"],
    "$date": lambda v: _instant(v["$date"]),
    "$timestamp": lambda v: {"t": v["$timestamp"].get("t"), "i": v["$timestamp"].get("i")},
    "$binary": _binary,
    "$numberDecimal": lambda v: v["$numberDecimal"],
    "$numberInt": lambda v: int(v["$numberInt"]),
    "$numberLong": lambda v: int(v["$numberLong"]),
    "$numberDouble": lambda v: float(v["$numberDouble"]) if v["$numberDouble"] not in ("NaN", "Infinity", "-Infinity") else v["$numberDouble"],
    "$regularExpression": _regex,
    "$regex": _regex,
    "$symbol": lambda v: v["$symbol"],
    "$dbPointer": lambda v: {"$ref": v["$dbPointer"].get("$ref"), "$id": convert(v["$dbPointer"].get("$id"))},
    "$minKey": lambda v: {"$minKey": 1},
    "$maxKey": lambda v: {"$maxKey": 1},
    "$undefined": lambda v: None,
}


def convert(value):
    """A parsed extended-JSON value as a plain one, to any depth."""
    if isinstance(value, dict):
        if "$code" in value:
            return {"$code": value["$code"], "$scope": convert(value["$scope"])} if "$scope" in value else value["$code"]
        for key, read in _WRAPPERS.items():
            if key in value:
                return read(value)
        return {k: convert(v) for k, v in value.items()}
    if isinstance(value, list):
        return [convert(v) for v in value]
    if isinstance(value, bytes):
        return base64.b64encode(value).decode()
    return value
