import json
import random

import pytest
from pyspark.sql import functions as F

from plain_bson import convert
from tidemark.functions import bson, datetimes, documents, inference, masks, pgtypes, positions


def one(spark, column, value="x", kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(column(F.col("v")).alias("r")).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-01-02 03:04:05", "2024-01-02T03:04:05Z"),
        ("2024-01-02 03:04:05.120000", "2024-01-02T03:04:05.12Z"),
        ("2024-01-02 03:04:05.123456789", "2024-01-02T03:04:05.123456789Z"),
        ("2024-01-02", "2024-01-02T00:00:00Z"),
        ("15:04:05", "0000-01-01T15:04:05Z"),
        ("2024-01-02T03:04:05+02:00", "2024-01-02T01:04:05Z"),
        ("2024-13-02", None),
        ("soon", None),
        (None, None),
    ],
)
def test_parse_datetime(spark, text, want):
    assert one(spark, datetimes.parse_datetime, text) == want


def test_pg_times(spark):
    assert one(spark, datetimes.pg_timestamp, "2024-01-02 03:04:05.5") == "2024-01-02T03:04:05.5Z"
    assert one(spark, datetimes.pg_timestamp, "infinity") == "infinity"
    assert one(spark, datetimes.pg_timestamptz, "2024-01-02 03:04:05.5+05:30") == "2024-01-01T21:34:05.5Z"
    assert one(spark, datetimes.pg_timestamptz, "2024-01-02 03:04:05-08") == "2024-01-02T11:04:05Z"
    assert one(spark, datetimes.pg_date, "tomorrow") == "tomorrow"


@pytest.mark.parametrize("text, kind", [("00123", "long"), ("1e3", "double"), ("t", "boolean"), ("nan", "string"), ("2024-01-01", "datetime"), ("abc", "string"), ("9223372036854775808", "double"), (None, None)])
def test_inference(spark, text, kind):
    assert one(spark, inference.kind_of, text) == kind


def test_inference_keeps_long_exact(spark):
    df = spark.createDataFrame([("9007199254740993",)], "v string")
    assert df.select(F.to_json(inference.infer_variant(F.col("v")))).first()[0] == "9007199254740993"


@pytest.mark.parametrize("text, want", [("{1,2,3}", ["1", "2", "3"]), ('{"hello","wor,ld","a\\"b"}', ["hello", "wor,ld", 'a"b']), ("{}", []), ("{a,NULL}", ["a", None]), ("{a,,b}", ["a", "", "b"]), ("oops", None)])
def test_pg_array(spark, text, want):
    assert one(spark, pgtypes.array_elements, text) == want


def test_pg_types(spark):
    types = pgtypes.TypeRegistry()
    assert one(spark, lambda c: types.convert("int4", c), "12") == 12
    assert one(spark, lambda c: types.convert(23, c), "x") is None
    assert one(spark, lambda c: types.convert("_int8", c), "{1,2}") == [1, 2]
    assert one(spark, lambda c: types.convert(99999, c), "as is") == "as is"
    assert one(spark, lambda c: types.convert("money", c), "-$1,234.50") == -1234.5
    p = one(spark, lambda c: types.convert("point", c), "(1.5,2)")
    assert (p["lat"], p["lon"]) == ("2", "1.5")
    assert one(spark, lambda c: types.convert("hstore", c), '"a"=>"1", "b"=>NULL') == {"a": "1", "b": None}
    assert one(spark, pgtypes.composite, '(1,"two",)') == {"field_1": "1", "field_2": "two", "field_3": ""}
    types.add_domain(70001, "positive", "bigint")
    types.add_enum(70002, "mood")
    assert one(spark, lambda c: types.convert("positive", c), "7") == 7
    assert types.index_mapping("mood") == {"type": "keyword"}
    assert types.index_mapping("text") == {"type": "text", "analyzer": "standard"}
    assert types.index_mapping("numeric")["scaling_factor"] == 100
    assert types.index_mapping(99999) == {"type": "keyword"}


def test_positions(spark):
    assert one(spark, lambda c: positions.lsn_number(c).cast("string"), "FFFFFFFF/FFFFFFFF") == str(2**64 - 1)
    assert one(spark, positions.lsn_valid, "0/0") is False
    assert one(spark, positions.lsn_valid, "16/B374D848") is True
    assert one(spark, positions.lsn_valid, "nope") is False
    assert one(spark, lambda c: positions.lsn_advance(c, F.lit(1000)), "0/1000") == "0/13E8"
    assert one(spark, lambda c: positions.lsn_advance(c, F.lit(1)), "0/FFFFFFFF") == "1/0"
    assert one(spark, lambda c: positions.lsn_compare(c, F.lit("1/0")), "0/FFFFFFFF") == -1
    assert one(spark, lambda c: positions.decode_token(positions.encode_token(c)), "tök") == "tök"
    assert one(spark, positions.decode_token, "%%%") is None
    assert one(spark, lambda c: positions.checkpoint_valid(F.lit("mysql"), c), "binlog.000001:4") is True


def test_masks(spark):
    assert one(spark, lambda c: masks.keep_ends(c, 3, 4), "13812348001") == "138****8001"
    assert one(spark, lambda c: masks.keep_ends(c, 0, 0), "10.0.0.1") == "********"
    assert one(spark, lambda c: masks.keep_ends(c, 4, 4), "1234567") == "1234567"
    assert one(spark, lambda c: masks.replace(c, "(.{2}).*(@.*)", "$1***$2"), "alice@example.com") == "al***@example.com"
    with pytest.raises(ValueError):
        masks.digest(F.lit("x"), "crc")


def test_documents(spark):
    assert one(spark, lambda c: documents.composite_key(c, F.lit(None), F.lit(3)), "a") == "a:<nil>:3"
    clean = one(spark, documents.strip_metadata_json, '{"_table":"t","_id":1,"big":9007199254740993,"n":null}')
    assert json.loads(clean) == {"big": 9007199254740993, "n": None}
    assert one(spark, documents.strip_metadata_json, "no object") == "no object"
    assert json.loads(one(spark, documents.flatten_json, '{"a":{"b":{"c":{"d":{"e":1}}}},"_id":{"x":1},"l":[{"k":1}]}')) == {"a.b.c.d": {"e": 1}, "_id": {"x": 1}, "l": [{"k": 1}]}
    assert json.loads(one(spark, lambda c: documents.flatten_json(c, depth=0), '{"a":{"b":1}}')) == {"a": {"b": 1}}
    assert json.loads(one(spark, lambda c: documents.flatten_json(c, "p"), '{"a":{"b":1}}')) == {"p.a.b": 1}


@pytest.mark.parametrize(
    "value, want",
    [
        ({"$oid": "507f1f77bcf86cd799439011"}, "507f1f77bcf86cd799439011"),
        ({"$date": {"$numberLong": "1704164645120"}}, "2024-01-02T03:04:05.12Z"),
        ({"$date": "2024-01-02T05:04:05+02:00"}, "2024-01-02T03:04:05Z"),
        ({"$timestamp": {"t": 5, "i": 1}}, {"t": 5, "i": 1}),
        ({"$binary": {"base64": "AQI=", "subType": "0"}}, {"$binary": {"base64": "AQI=", "subType": "00"}}),
        ({"$numberDecimal": "1.10"}, "1.10"),
        ({"$numberInt": "3"}, 3),
        ({"$regularExpression": {"pattern": "^a", "options": "i"}}, {"$regex": "^a", "$options": "i"}),
        ({"$code": "f()"}, "f()"),
        ({"$code": "f()", "$scope": {"x": {"$numberInt": "1"}}}, {"$code": "f()", "$scope": {"x": 1}}),
        ({"$symbol": "s"}, "s"),
        ({"$minKey": 1}, {"$minKey": 1}),
        ({"$undefined": True}, None),
        ({"a": [{"$numberLong": "9007199254740993"}]}, {"a": [9007199254740993]}),
    ],
)
def test_bson(spark, value, want):
    assert convert(value) == want
    assert json.loads(one(spark, bson.normalise, json.dumps({"v": value}))) == {"v": want}
    assert json.loads(one(spark, bson.normalise, json.dumps([value, 1, [value]]))) == [want, 1, [want]]


def test_bson_against_the_plain_reading(spark):
    rng = random.Random(17)
    texts = ["a", "", 'quote " and \\\\ slash', '{"$oid":"x"}', "é 日本 \n\t", '","$type":"0', "{", "}]", "$1 \\\\1"]
    leaf = [
        lambda: {"$oid": rng.choice(["ab", "0" * 24])},
        lambda: {"$date": {"$numberLong": str(rng.randint(-(10**12), 2 * 10**12))}},
        lambda: {"$date": rng.choice(["2024-02-29T23:59:59.999Z", "2001-01-01T00:00:00+05:30", "2024-01-02T03:04:05.120Z", "never"])},
        lambda: {"$date": rng.randint(0, 10**12)},
        lambda: {"$timestamp": {"t": rng.randint(0, 99), "i": 3}},
        lambda: {"$binary": {"base64": "AQI=", "subType": rng.choice(["0", "04", "f"])}},
        lambda: {"$binary": "AQI=", "$type": "02"},
        lambda: {"$numberDecimal": rng.choice(["1.10", "NaN", "1E+400"])},
        lambda: {"$numberInt": str(rng.randint(-9, 9))},
        lambda: {"$numberLong": str(rng.randint(-(2**63), 2**63 - 1))},
        lambda: {"$numberDouble": rng.choice(["1.5", "-0.25", "NaN", "-Infinity", "3.0"])},
        lambda: {"$regularExpression": {"pattern": rng.choice(texts), "options": "i"}},
        lambda: {"$symbol": rng.choice(texts)},
        lambda: {"$code": rng.choice(texts)},
        lambda: {"$code": "f()", "$scope": {"x": {"$numberInt": "1"}}},
        lambda: {"$dbPointer": {"$ref": rng.choice(["c", "d"]), "$id": {"$oid": "ab"}}},
        lambda: {"$minKey": 1},
        lambda: {"$maxKey": 1},
        lambda: {"$undefined": True},
        lambda: rng.choice(texts),
        lambda: rng.choice([None, True, False, 0, -1, 1.5, 2**40]),
    ]

    def value(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.5:
            return rng.choice(leaf)()
        if kind < 0.8:
            return {rng.choice(["a", "b", "c d", "é", "$x", 'k"']): value(depth - 1) for _ in range(rng.randint(0, 4))}
        return [value(depth - 1) for _ in range(rng.randint(0, 4))]

    docs = [{"_id": k, "v": value(4)} for k in range(400)]
    df = spark.createDataFrame([(k, json.dumps(d, ensure_ascii=k % 2 == 0)) for k, d in enumerate(docs)], "k long, t string")
    got = {r["k"]: json.loads(r["x"]) for r in df.select("k", bson.normalise(F.col("t")).alias("x")).collect()}
    for k, d in enumerate(docs):
        assert got[k] == convert(d), (d, got[k])
    assert one(spark, bson.normalise, "{no json") is None and one(spark, bson.normalise, None) is None


def test_bson_primary_key(spark):
    key = lambda text: one(spark, bson.primary_key, text)
    assert key('{"_id":{"$oid":"ab"}}') == "ab"
    assert key('{"_id":7}') == "7"
    assert key('{"x":1}') == ""
    assert json.loads(key('{"_id":{"a":1}}')) == {"a": 1}
