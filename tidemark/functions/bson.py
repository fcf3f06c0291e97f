"""MongoDB values: extended JSON to plain documents.

Everything is done on the canonical text of a document (VARIANT's: keys sorted, no
space between tokens). There a wrapper object is a fixed pattern, and no string can
hold one, as quotes inside a string are escaped: ``{"$oid":"`` never is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEXT = r'"((?:[^"\\\\]|\\\\.)*)"'.replace("\\\\", "\\")
_FLOAT = r'"(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)"'

_DAY = r"\d{4}-[01]\d-[0-3]\dT[0-2]\d:[0-5]\d:[0-5]\d"

#: Each wrapper and what stays of it, innermost first: those of most documents,
_COMMON = [
    (r'\{"\$(?:oid|symbol|numberDecimal)":' + _TEXT + r"\}", '"$1"'),
    (r'\{"\$number(?:Int|Long|Double)":' + _FLOAT + r"\}", "$1"),
    # dates in UTC, trailing zeros trimmed
    (r'\{"\$date":("' + _DAY + r')(?:\.0{1,6})?(Z")\}', "$1$2"),
    (r'\{"\$date":("' + _DAY + r'\.\d{0,5}[1-9])0{0,5}(Z")\}', "$1$2"),
]
#: and the others.
_RARE = [
    (r'\{"\$numberDouble":"(NaN|-?Infinity)"\}', '"$1"'),
    (r'\{"\$undefined":true\}', "null"),
    (r'\{"\$(min|max)Key":[^{}\[\]]*?\}', r'{"\$$1Key":1}'),
    (r'\{"\$timestamp":\{"i":(-?\d+),"t":(-?\d+)\}\}', r'{"i":$1,"t":$2}'),
    # a subtype has two hexadecimal digits; the older form names it beside the data
    (r'\{"\$binary":' + _TEXT + r',"\$type":"([0-9a-fA-F]{1,2})"\}', r'{"\$binary":{"base64":"$1","subType":"$2"}}'),
    (r'\{"\$binary":' + _TEXT + r"\}", r'{"\$binary":{"base64":"$1","subType":"00"}}'),
    (r'\{"\$binary":\{"base64":' + _TEXT + r',"subType":"([0-9a-fA-F])"\}\}', r'{"\$binary":{"base64":"$1","subType":"0$2"}}'),
    (r'\{"\$regularExpression":\{"options":' + _TEXT + r',"pattern":' + _TEXT + r"\}\}", r'{"\$options":"$1","\$regex":"$2"}'),
    (r'\{"\$regularExpression":\{"pattern":' + _TEXT + r"\}\}", r'{"\$options":"","\$regex":"$1"}'),
    (r'\{"\$regex":' + _TEXT + r"\}", r'{"\$options":"","\$regex":"$1"}'),
    (r'\{"\$dbPointer":\{"\$id":([^{}]*?|\{[^{}]*\}),"\$ref":' + _TEXT + r"\}\}", r'{"\$id":$1,"\$ref":"$2"}'),
    (r'\{"\$code":' + _TEXT + r"\}", '"$1"'),
]
_DATE = r'\{"\$date":(?:\{"\$numberLong":"-?\d+"\}|-?\d+|"(?:[^"\\]|\\.)*")\}'


def _instant(wrapper: Column) -> Column:
    """The quoted text that a date wrapper becomes: RFC 3339 in UTC, trailing zeros trimmed; text that is no date stays."""
    millis = F.regexp_extract(wrapper, r'^\{"\$date":(?:\{"\$numberLong":")?(-?\d+)', 1)
    text = F.regexp_extract(wrapper, r'^\{"\$date":"(.*)"\}$', 1)
    at = F.when(millis != "", F.timestamp_millis(millis.try_cast("long"))).otherwise(F.try_to_timestamp(text))
    utc = F.to_utc_timestamp(at, F.current_timezone())
    shown = F.regexp_replace(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0{1,6}$", "")
    trimmed = F.when(F.date_format(utc, "SSSSSS") == "000000", F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(shown)
    return F.concat(F.lit('"'), F.coalesce(F.concat(trimmed, F.lit("Z")), text), F.lit('"'))


def normalise(data: Column) -> Column:
    """Extended JSON text to plain JSON text with sorted keys; text that isn't JSON gives null."""
    def replaced(text: Column, wrappers: list[tuple[str, str]]) -> Column:
        for pattern, kept in wrappers:
            text = F.regexp_replace(text, pattern, kept)
        return text

    def rest(text: Column) -> Column:
        dates = F.concat(F.transform(F.regexp_extract_all(text, F.lit(_DATE), F.lit(0)), _instant), F.array(F.lit("")))
        dated = F.when(text.contains('{"$date":'), F.array_join(F.zip_with(F.split(text, _DATE), dates, lambda a, b: F.concat(a, b)), "")).otherwise(text)
        return F.when(text.contains('{"$'), replaced(dated, _RARE)).otherwise(text)

    # a one-element array binds the text, and few documents hold more than the common wrappers
    return F.transform(F.array(replaced(F.to_json(F.try_parse_json(data)), _COMMON)), rest)[0]


def primary_key(data: Column) -> Column:
    """The ``_id`` of a document: hex of an object id, text or number as text, anything else as JSON; missing is empty."""
    oid, plain = F.get_json_object(data, "$._id['$oid']"), F.get_json_object(data, "$._id")
    number = F.coalesce(F.get_json_object(data, "$._id['$numberLong']"), F.get_json_object(data, "$._id['$numberInt']"))
    return F.coalesce(oid, number, plain, F.lit(""))
