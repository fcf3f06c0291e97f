"""The catalogue: each operator as a query over the test tables, with SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import bson, datetimes, documents, inference, masks, pgtypes, positions
from tidemark.operators import chunks, dead_letters, progress, relational, upsert
from tidemark.plans.rules import RuleSet, apply_rules
from tidemark.session import shared_folder, ship
from tidemark.sinks.index import FailingStore, IndexStore, bulk_lines
from tidemark.sources import binlog, catalogs
from tidemark.sources import events as source_events
from tidemark.sources import pgoutput, readers
from tidemark.streaming import windows
from tidemark.streaming.jobs import SyncJob

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OP = "CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END"


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a change log: one table, keyed by user, ordered by event id."""
    e = _t(spark, sf_dir, "events")
    return e.select(F.expr(_OP).alias("op"), F.lit("files").alias("source_type"), F.col("event_id").cast("string").alias("position"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("pk"), F.lit("app").alias("schema_name"), F.lit("Users").alias("table"), F.col("props").alias("data"))


_LAST = f"SELECT * FROM (SELECT event_id, user_id, event_type, value, props, {_OP} AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1"


@query(f"SELECT user_id::VARCHAR AS pk, event_id AS seq, op, props AS data FROM ({_LAST}) WHERE op <> 'DELETE'")
def cdc_current_state(spark, sf_dir):
    return upsert.current_state(change_log(spark, sf_dir), ["pk"]).select("pk", "seq", "op", "data")


@query("SELECT event_type AS kind, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'view' THEN 'UPDATE' WHEN 'click' THEN 'UPDATE' WHEN 'error' THEN 'DELETE' END AS op, count(*) AS n FROM events GROUP BY 1, 2")
def cdc_op_mapping(spark, sf_dir):
    stream = {"signup": "insert", "view": "update", "click": "replace", "error": "delete"}
    kind = F.col("event_type").alias("kind")
    mapped = F.create_map(*[x for kv in stream.items() for x in map(F.lit, kv)])
    return _t(spark, sf_dir, "events").select(kind, relational.change_operation(mapped[F.col("event_type")]).alias("op")).groupBy("kind", "op").agg(F.count("*").alias("n"))


@query("SELECT concat_ws(':', l_orderkey::VARCHAR, l_linenumber::VARCHAR) AS pk, count(*) AS n FROM lineitem GROUP BY 1")
def cdc_pk_composite(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select(documents.composite_key(F.col("l_orderkey"), F.col("l_linenumber")).alias("pk")).groupBy("pk").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey::VARCHAR AS pk, CASE WHEN o_orderstatus = 'F' THEN 'DELETE' WHEN o_orderstatus = 'O' THEN 'UPDATE' ELSE 'INSERT' END AS op, o_orderkey AS seq, concat('binlog.000007:', o_orderkey::VARCHAR) AS position FROM orders")
def cdc_update_after_image(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    image = lambda p: F.struct(F.col("o_orderkey").alias("id"), p.alias("price"))
    op = F.when(F.col("o_orderstatus") == "F", "delete").when(F.col("o_orderstatus") == "O", "update").otherwise("insert")
    log = o.select(op.alias("op"), F.lit("shop").alias("schema_name"), F.lit("orders").alias("table"), F.lit("binlog.000007").alias("file"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("seq"), F.when(op != "insert", image(F.col("o_totalprice"))).alias("before"), F.when(op != "delete", image(F.col("o_totalprice") + 1)).alias("after"))
    return source_events.from_row_log(log, ["id"]).select("pk", "op", "seq", "position")


@query("""SELECT o_orderkey AS seq, 'UPDATE' AS op, o_custkey AS pk FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 'DELETE', o_custkey FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 'UPDATE', o_custkey + 1000000 FROM orders WHERE o_orderkey % 5 = 0""")
def cdc_pk_change(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.lit("UPDATE").alias("op"), F.col("o_custkey").alias("before"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey")).alias("after"))
    return upsert.split_key_changes(o, "before", "after")


@query("""WITH e AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS t FROM events), c AS (SELECT t, max(event_id) AS cut FROM e WHERE event_id % 400 = 0 GROUP BY t)
SELECT e.t AS table_name, user_id::VARCHAR AS pk, count(*) AS n FROM e LEFT JOIN c USING (t) WHERE event_id % 400 <> 0 AND (cut IS NULL OR event_id > cut) GROUP BY 1, 2""")
def cdc_truncate(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    log = e.select(F.when(F.col("event_id") % 400 == 0, "TRUNCATE").otherwise("UPDATE").alias("op"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("pk"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("table"))
    return upsert.after_truncation(log).groupBy(F.col("table").alias("table_name"), "pk").agg(F.count("*").alias("n"))


@query("""SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) FILTER (event_id % 3 <> 0) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def cdc_partial_update(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("unchanged", F.when(F.col("event_id") % 3 == 0, F.array(F.lit("event_type"))).otherwise(F.array().cast("array<string>")))
    return upsert.merge_partial(e.withColumnRenamed("event_id", "seq"), ["user_id"], ["event_type", "value"])


@query("SELECT table_name, count(*) AS n FROM (SELECT event_type AS table_name FROM events) WHERE table_name IN ('view', 'click') GROUP BY 1")
def table_filter_list(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumnRenamed("event_type", "table_name")
    return relational.include_tables(e, ["view", "click"], "table_name").groupBy("table_name").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def table_filter_semi(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relational.only(_t(spark, sf_dir, "customer"), o, "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def table_missing_anti(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return relational.missing(_t(spark, sf_dir, "customer"), o, "c_custkey").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000")
def range_predicate(spark, sf_dir):
    return readers.read_snapshot(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey"], "o_orderkey >= 100 AND o_orderkey < 5000")


@query("SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#%1' AND NOT (c_acctbal < 0) AND c_mktsegment <> 'BUILDING'")
def like_not_predicate(spark, sf_dir):
    return readers.read_snapshot(spark, f"{sf_dir}/customer.parquet", ["c_custkey"], "c_name LIKE 'Customer#%1' AND NOT (c_acctbal < 0) AND c_mktsegment <> 'BUILDING'")


@query("SELECT event_id FROM events WHERE regexp_matches(event_type, '^(view|click)$') AND value > 50")
def regex_state_predicate(spark, sf_dir):
    return readers.read_snapshot(spark, f"{sf_dir}/events.parquet", ["event_id"], "event_type RLIKE '^(view|click)$' AND value > 50")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def catalog_lookup_join(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    n = relational.lookup(_t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return relational.lookup(s, n, "n_nationkey").select("s_suppkey", "n_name", "r_name")


@query("SELECT n_nationkey, n_name, s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def catalog_left_join(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return relational.lookup(_t(spark, sf_dir, "nation"), s, "n_nationkey", "left").select("n_nationkey", "n_name", "s_suppkey")


@query("SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def scalar_subquery_exists(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("last_order"), "o_orderstatus")
    return relational.latest_of_those(_t(spark, sf_dir, "customer"), o, "c_custkey", "last_order", F.col("o_orderstatus") == "P").select("c_custkey", "last_order")


@query("""WITH s AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders), p AS (SELECT lo, hi, least(greatest((hi - lo + 1) // 1000, 1), 8) AS n FROM s)
SELECT k AS chunk_id, lo + k * ((hi - lo + 1) // n) AS start_id, CASE WHEN k = n - 1 THEN hi + 1 ELSE lo + (k + 1) * ((hi - lo + 1) // n) END AS end_id FROM (SELECT lo, hi, n, unnest(range(0, n)) AS k FROM p)""")
def chunk_id_ranges_even(spark, sf_dir):
    return chunks.even_chunks(_t(spark, sf_dir, "orders"), "o_orderkey", 1000)


@query("""WITH s AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders)
SELECT k AS chunk_id, lo + k * 1000 AS start_id, least(lo + k * 1000 + 999, hi) AS end_id FROM (SELECT lo, hi, unnest(range(0, (hi - lo) // 1000 + 1)) AS k FROM s)""")
def chunk_id_ranges_stride(spark, sf_dir):
    return chunks.stride_chunks(_t(spark, sf_dir, "orders"), "o_orderkey", 1000)


@query("""WITH s AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders), p AS (SELECT lo, hi, least(greatest((hi - lo + 1) // 2000, 1), 8) AS n FROM s)
SELECT least((o_orderkey - lo) // ((hi - lo + 1) // n), n - 1)::BIGINT AS chunk_id, count(*) AS n FROM orders, p GROUP BY 1""")
def chunk_rowcounts(spark, sf_dir):
    return chunks.rows_per_chunk(_t(spark, sf_dir, "orders"), "o_orderkey", 2000)


@query("SELECT (o_orderkey % 8)::INTEGER AS chunk_id, count(*) AS n FROM orders GROUP BY 1")
def chunk_hash(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy(chunks.modulo_chunk(F.col("o_orderkey"), 8).alias("chunk_id")).agg(F.count("*").alias("n"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def chunk_time(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.date_format(chunks.time_chunk(F.col("ts"), "day"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT (row_number() OVER (ORDER BY event_id) - 1) // 500 AS page, event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM events")
def chunk_skip_limit(spark, sf_dir):
    return chunks.pages(_t(spark, sf_dir, "events").select("event_id"), ["event_id"], 500).select("page", "event_id", "row_index")


_SIZES = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("customer", "orders", "lineitem", "events", "nation"))


def _sizes(spark, sf_dir):
    out = None
    for t in ("customer", "orders", "lineitem", "events", "nation"):
        one = _t(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT table_name, CASE WHEN n < 10000 THEN 100 WHEN n < 100000 THEN 80 WHEN n < 1000000 THEN 60 WHEN n < 10000000 THEN 40 ELSE 20 END AS priority FROM ({_SIZES})")
def table_priority(spark, sf_dir):
    return _sizes(spark, sf_dir).select("table_name", chunks.priority(F.col("n")).alias("priority"))


@query(f"SELECT table_name, n, CASE WHEN n < 10000 THEN 1000 WHEN n < 100000 THEN 5000 WHEN n < 1000000 THEN 10000 ELSE 100000 END AS chunk_size FROM ({_SIZES})")
def adaptive_chunk_size(spark, sf_dir):
    return _sizes(spark, sf_dir).select("table_name", "n", chunks.adaptive_size(F.col("n")).alias("chunk_size"))


@query("SELECT concat('app-', CASE WHEN o_orderpriority = '' THEN 'default' ELSE lower(o_orderpriority) END) AS idx, count(*) AS n FROM orders GROUP BY 1")
def index_route(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy(documents.index_name("app", F.col("o_orderpriority")).alias("idx")).agg(F.count("*").alias("n"))


@query(f"SELECT concat('app-', event_type) AS idx, count(*) AS n_docs FROM ({_LAST}) WHERE op <> 'DELETE' GROUP BY 1")
def index_doc_counts(spark, sf_dir):
    log = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.expr(_OP).alias("op"), documents.index_name("app", F.col("event_type")).alias("idx"))
    return upsert.current_state(log, ["user_id"]).groupBy("idx").agg(F.count("*").alias("n_docs"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def strip_metadata(spark, sf_dir):
    doc = F.concat(F.lit('{"_table":"events","_schema":"app","k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    clean = documents.strip_metadata_json(doc)
    kept = F.map_keys(F.from_json(clean, "map<string,string>"))
    return _t(spark, sf_dir, "events").select("event_id", F.when(F.size(kept) == 1, F.get_json_object(clean, "$.k").cast("long")).alias("k"))


@query("SELECT table_name, count(*) AS n FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'events' WHEN 1 THEN 'coll' ELSE '' END AS table_name FROM events) GROUP BY 1")
def table_name_extraction(spark, sf_dir):
    doc = F.when(F.col("event_id") % 3 == 0, F.lit('{"_table":"events","_collection":"x"}')).when(F.col("event_id") % 3 == 1, F.lit('{"_collection":"coll"}')).otherwise(F.lit("{}"))
    return _t(spark, sf_dir, "events").select(documents.table_of(doc).alias("table_name")).groupBy("table_name").agg(F.count("*").alias("n"))


@query("SELECT min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n FROM orders")
def top1_min_max(spark, sf_dir):
    return chunks.key_span(_t(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
def ordered_page(spark, sf_dir):
    return chunks.page(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 200, 100)


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_histogram(spark, sf_dir):
    return progress.histogram(_t(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_shipdate, l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1")
def ordered_array_agg(spark, sf_dir):
    return relational.ordered_values(_t(spark, sf_dir, "lineitem"), "l_orderkey", ["l_shipdate", "l_linenumber"], "l_partkey").select("l_orderkey", F.array_join("items", ",").alias("parts"))


_CHUNKS = "SELECT o_orderpriority AS table_name, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'pending' END AS status, 100 + o_orderkey % 50 AS total_rows, 90 + o_orderkey % 50 AS processed_rows FROM orders"


@query(f"""WITH c AS ({_CHUNKS}), s AS (SELECT count(*) AS total_chunks, count(*) FILTER (status = 'completed') AS completed_chunks, sum(total_rows)::BIGINT AS total_rows, sum(processed_rows) FILTER (status = 'completed')::BIGINT AS processed_rows, count(DISTINCT table_name) AS total_tables FROM c)
SELECT *, completed_chunks * 100.0::DOUBLE / total_chunks AS chunk_progress, processed_rows * 100.0::DOUBLE / total_rows AS row_progress, processed_rows / 64.0::DOUBLE AS rows_per_second, floor((total_rows - processed_rows) / (processed_rows / 64.0::DOUBLE))::BIGINT AS eta_seconds FROM s""")
def progress_overall(spark, sf_dir):
    return progress.overall(_chunk_rows(spark, sf_dir), 64.0)


def _chunk_rows(spark, sf_dir):
    return _t(spark, sf_dir, "orders").selectExpr("o_orderpriority AS table_name", "CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'pending' END AS status", "100 + o_orderkey % 50 AS total_rows", "90 + o_orderkey % 50 AS processed_rows")


@query(f"""WITH c AS ({_CHUNKS}) SELECT table_name, count(*) AS total_chunks, count(*) FILTER (status = 'completed') AS completed_chunks, sum(total_rows)::BIGINT AS total_rows, coalesce(sum(processed_rows) FILTER (status = 'completed'), 0)::BIGINT AS processed_rows, count(*) FILTER (status = 'completed') * 100.0::DOUBLE / count(*) AS progress FROM c GROUP BY 1""")
def progress_per_table(spark, sf_dir):
    return progress.per_table(_chunk_rows(spark, sf_dir))


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean_value, max(value) AS max_value, round(quantile_cont(value, 0.99), 6) AS p99_value, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM events")
def throughput_stats(spark, sf_dir):
    out = progress.throughput(_t(spark, sf_dir, "events"), "value", F.col("event_type") == "error")
    return out.select("n", F.round("mean_value", 6).alias("mean_value"), "max_value", F.round("p99_value", 6).alias("p99_value"), F.round("error_rate", 6).alias("error_rate"))


@query("SELECT user_id AS job, count(*) AS n_events FROM events GROUP BY 1")
def event_counter(spark, sf_dir):
    return progress.event_counts(_t(spark, sf_dir, "events").withColumnRenamed("user_id", "job"), "job")


_LSN = "upper(format('{:x}/{:x}', event_id // 7, event_id * 4099))"


def _lsn(spark, sf_dir):
    # the low half carries into the high one, as 1 to 8 hex digits a side are all that a position has
    e = _t(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 4099).alias("n"))
    high = F.expr("event_id div 7 + n div 4294967296")
    return e.select("event_id", F.concat(F.hex(high), F.lit("/"), F.hex(F.col("n") % 4294967296)).alias("lsn"))


@query("SELECT event_id, (event_id // 7) * 4294967296 + event_id * 4099 AS n FROM events")
def lsn_to_int(spark, sf_dir):
    return _lsn(spark, sf_dir).select("event_id", positions.lsn_number(F.col("lsn")).cast("long").alias("n"))


@query("SELECT event_id, CASE WHEN (event_id // 7) * 4294967296 + event_id * 4099 < 428 * 4294967296 + 4096 THEN -1 WHEN (event_id // 7) * 4294967296 + event_id * 4099 > 428 * 4294967296 + 4096 THEN 1 ELSE 0 END AS c FROM events")
def lsn_compare(spark, sf_dir):
    return _lsn(spark, sf_dir).select("event_id", positions.lsn_compare(F.col("lsn"), F.lit("1AC/1000")).alias("c"))


@query("SELECT event_id, upper(format('{:x}/{:x}', event_id // 7 + (event_id * 4099 + 4294967200) // 4294967296, (event_id * 4099 + 4294967200) % 4294967296)) AS lsn FROM events")
def lsn_advance(spark, sf_dir):
    return _lsn(spark, sf_dir).select("event_id", positions.lsn_advance(F.col("lsn"), F.lit(4294967200)).alias("lsn"))


@query("SELECT max((event_id // 7) * 4294967296 + event_id * 4099) - min((event_id // 7) * 4294967296 + event_id * 4099) AS lag FROM events")
def lsn_lag(spark, sf_dir):
    n = _lsn(spark, sf_dir).select(positions.lsn_number(F.col("lsn")).alias("n"))
    ends = n.agg(F.max("n").alias("a"), F.min("n").alias("b"))
    return ends.select(positions.lag_bytes(positions.lsn_format(F.col("a")), positions.lsn_format(F.col("b"))).cast("long").alias("lag"))


@query("SELECT event_id, CASE WHEN event_id % 13 < 6 OR event_id % 13 = 6 AND event_id < 5000 THEN -1 WHEN event_id % 13 = 6 AND event_id = 5000 THEN 0 ELSE 1 END AS c FROM events")
def binlog_compare(spark, sf_dir):
    file = F.format_string("binlog.%06d", F.col("event_id") % 13)
    return _t(spark, sf_dir, "events").select("event_id", positions.binlog_compare(file, F.col("event_id"), F.lit("binlog.000006"), F.lit(5000)).alias("c"))


@query("SELECT event_id, base64(encode(props)) AS token, props AS back FROM events")
def resume_token_codec(spark, sf_dir):
    token = positions.encode_token(F.col("props"))
    return _t(spark, sf_dir, "events").select("event_id", token.alias("token"), positions.decode_token(token).alias("back"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT00:00:00Z') WHEN 2 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.25Z') END AS t FROM events""")
def datetime_parse(spark, sf_dir):
    k, ts = F.col("event_id") % 4, F.col("ts")
    text = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(ts, "yyyy-MM-dd")).when(k == 2, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".2500+02:00"))).otherwise(F.lit("no date"))
    return _t(spark, sf_dir, "events").select("event_id", datetimes.parse_datetime(text).alias("t"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'long' WHEN 1 THEN 'double' WHEN 2 THEN 'boolean' WHEN 3 THEN 'datetime' WHEN 4 THEN 'string' END AS kind FROM events""")
def type_inference(spark, sf_dir):
    k, i = F.col("event_id") % 6, F.col("event_id").cast("string")
    text = F.when(k == 0, i).when(k == 1, F.concat(i, F.lit(".5e1"))).when(k == 2, F.lit("T")).when(k == 3, F.lit("2024-02-29 10:00:00.5")).when(k == 4, F.concat(F.lit("x"), i))
    return _t(spark, sf_dir, "events").select("event_id", inference.kind_of(text).alias("kind"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS b FROM events")
def bool_parse(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, ("TRUE", "f", "1", "False", "yes"))), (F.col("event_id") % 5 + 1).cast("int"))
    return _t(spark, sf_dir, "events").select("event_id", inference.pg_bool(text).alias("b"))


@query("SELECT o_orderkey, o_totalprice AS amount FROM orders")
def money_clean(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", pgtypes.money(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("amount"))


@query("SELECT o_orderkey, concat(o_orderkey::VARCHAR, '|a,b|c\"d|', o_orderstatus) AS joined, 4 AS n FROM orders")
def pg_array_parse(spark, sf_dir):
    text = F.concat(F.lit("{"), F.col("o_orderkey").cast("string"), F.lit(',"a,b","c\\"d",'), F.col("o_orderstatus"), F.lit("}"))
    parsed = pgtypes.array_elements(text)
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.array_join(parsed, "|").alias("joined"), F.size(parsed).alias("n"))


@query("SELECT o_orderkey, o_custkey::VARCHAR AS lat, o_orderkey::VARCHAR AS lon FROM orders")
def pg_point_parse(spark, sf_dir):
    text = F.concat(F.lit("("), F.col("o_orderkey").cast("string"), F.lit(", "), F.col("o_custkey").cast("string"), F.lit(")"))
    return _t(spark, sf_dir, "orders").withColumn("p", pgtypes.point(text)).select("o_orderkey", "p.lat", "p.lon")


@query("""SELECT o_orderkey, o_orderstatus AS s, concat('a"', o_orderpriority, '\\, =>b') AS p, o_custkey::VARCHAR AS odd, true AS empty, 4 AS n FROM orders""")
def hstore_parse(spark, sf_dir):
    text = F.concat(F.lit('"s"=>"'), F.col("o_orderstatus"), F.lit('", "p"=>"a\\"'), F.col("o_orderpriority"), F.lit('\\\\, =>b", "k, \\"=>"=> '), F.col("o_custkey").cast("string"), F.lit(', z=>NULL, "s"=>"again"'))
    m = pgtypes.hstore(text)
    return _t(spark, sf_dir, "orders").select("o_orderkey", m["s"].alias("s"), m["p"].alias("p"), m['k, "=>'].alias("odd"), (F.map_contains_key(m, "z") & m["z"].isNull()).alias("empty"), F.size(m).alias("n"))


@query("""SELECT o_orderkey, o_orderstatus AS f1, o_custkey::VARCHAR AS f2, concat('a,', o_orderpriority, '"b') AS f3, '' AS f4, '(x)\\' AS f5, 5 AS n FROM orders""")
def pg_composite_parse(spark, sf_dir):
    text = F.concat(F.lit("("), F.col("o_orderstatus"), F.lit(","), F.col("o_custkey").cast("string"), F.lit(',"a,'), F.col("o_orderpriority"), F.lit('""b",,"(x)\\\\")'))
    m = pgtypes.composite(text)
    return _t(spark, sf_dir, "orders").select("o_orderkey", *[m[f"field_{k}"].alias(f"f{k}") for k in range(1, 6)], F.size(m).alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k, event_id % 3 = 0 AS is_text FROM events")
def json_or_string(spark, sf_dir):
    v = pgtypes.json_value(F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).otherwise(F.col("props")))
    return _t(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), (F.schema_of_variant(v) == "STRING").alias("is_text"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS tz, strftime(ts, '%Y-%m-%d') AS d, round(value, 3)::DOUBLE AS x FROM events")
def pg_typed_row(spark, sf_dir):
    types = pgtypes.TypeRegistry()
    e = _t(spark, sf_dir, "events")
    zoned = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00"))
    return e.select("event_id", types.convert(1184, zoned).alias("tz"), types.convert("date", F.date_format("ts", "yyyy-MM-dd")).alias("d"), F.round(types.convert("float8", F.col("value").cast("string")), 3).alias("x"))


@query("""SELECT event_id, concat('{"_id":"', format('{:024x}', event_id), '","at":"2024-01-02T03:04:05.5Z","n":', event_id::VARCHAR, '}') AS doc, format('{:024x}', event_id) AS pk FROM events""")
def bson_normalise(spark, sf_dir):
    oid = F.lower(F.lpad(F.hex("event_id"), 24, "0"))
    raw = F.concat(F.lit('{"_id":{"$oid":"'), oid, F.lit('"},"at":{"$date":"2024-01-02T03:04:05.500Z"},"n":{"$numberLong":"'), F.col("event_id").cast("string"), F.lit('"}}'))
    return _t(spark, sf_dir, "events").select("event_id", bson.normalise(raw).alias("doc"), bson.primary_key(raw).alias("pk"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, 7::BIGINT AS deep FROM events""")
def flatten_props(spark, sf_dir):
    nested = F.concat(F.lit('{"a":'), F.col("props"), F.lit(',"b":{"c":{"d":7}}}'))
    flat = documents.flatten_json(nested)
    get = lambda k: F.from_json(flat, "map<string,string>")[k].cast("long")
    return _t(spark, sf_dir, "events").select("event_id", get("a.k").alias("k"), get("b.c.d").alias("deep"))


@query("SELECT event_id, event_type AS \"meta.kind\", value AS \"meta.inner.value\" FROM events")
def flatten_struct(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.struct(F.col("event_type").alias("kind"), F.struct("value").alias("inner")).alias("meta"))
    return e.select(*documents.flatten_columns(e.schema))


@query("""SELECT event_id, concat('{"a":', event_id::VARCHAR, ',"b":null,"c":"', event_type, '"}') AS doc FROM events""")
def render_sorted_json(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("c"), F.lit(None).cast("string").alias("b"), F.col("event_id").alias("a"))
    return e.select("event_id", documents.render(e, ["c", "a", "b"]).alias("doc"))


@query("SELECT event_id, strftime(make_timestamp(946684800000000 + event_id * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS t FROM events")
def pg_epoch(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", datetimes.rfc3339_nano(datetimes.from_pg_epoch_micros(F.col("event_id") * 1000000)).alias("t"))


@query("SELECT c_custkey, concat(left(c_name, 3), repeat('*', greatest(length(c_name) - 7, 0)), right(c_name, 4)) AS masked FROM customer")
def mask_prefix_suffix(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", masks.keep_ends(F.col("c_name"), 3, 4).alias("masked"))


@query("SELECT c_custkey, concat(left(c_name, 2), '***@example.com') AS masked FROM customer")
def mask_regex_email(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", masks.replace(F.concat("c_name", F.lit("@example.com")), "(.{2}).*(@.*)", "$1***$2").alias("masked"))


@query("SELECT c_custkey, sha256(c_name) AS masked FROM customer")
def mask_hash_sha256(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", masks.digest(F.col("c_name")).alias("masked"))


def _rules(**rule) -> RuleSet:
    return RuleSet([{"id": "r", "table_patterns": ["*"], **rule}], {"phone": {"strategy": "mask", "params": {"prefix": 3, "suffix": 4, "char": "*"}}})


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment, c_mktsegment AS segment_copy FROM customer")
def rule_rename_copy_exclude(spark, sf_dir):
    rules = _rules(field_mappings=[{"source_field": "c_name", "target_field": "name", "action": "rename"}, {"source_field": "c_mktsegment", "target_field": "segment", "action": "rename"}, {"source_field": "segment", "target_field": "segment_copy", "action": "copy"}], field_configs=[{"field": "c_acctbal", "exclude": True}, {"field": "c_nationkey", "exclude": True}])
    return apply_rules(_t(spark, sf_dir, "customer"), "customer", rules)[0]


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id::INTEGER END AS age, event_id % 2 = 0 AS vip FROM events")
def rule_cast_default(spark, sf_dir):
    raw = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_id").cast("string")).otherwise("n/a").alias("age"), F.when(F.col("event_id") % 2 == 0, "true").alias("vip"))
    rules = _rules(field_configs=[{"field": "age", "target_type": "int", "default_value": 0, "null_strategy": "default"}, {"field": "vip", "target_type": "bool", "default_value": False}])
    return apply_rules(raw, "users", rules)[0]


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'contact: required' ELSE 'contact: no address' END AS reason FROM events WHERE event_id % 5 < 2")
def rule_required_validate(spark, sf_dir):
    k = F.col("event_id") % 5
    raw = _t(spark, sf_dir, "events").select("event_id", F.when(k == 1, "nobody").when(k > 1, F.concat(F.lit("u"), F.col("event_id").cast("string"), F.lit("@mail.test"))).alias("contact"))
    rules = _rules(field_configs=[{"field": "contact", "target_type": "keyword", "required": True, "validation": {"pattern": r"^\S+@\S+\.\w+$", "error_message": "no address"}}])
    return apply_rules(raw, "users", rules)[1].select("event_id", F.array_join("_errors", "; ").alias("reason"))


@query("SELECT p_partkey, CASE WHEN p_size <= 7 THEN 'box' WHEN p_size <= 31 THEN 'crate' ELSE 'pallet' END AS size_group, p_size > 10 AS large FROM part")
def rule_computed_ternary(spark, sf_dir):
    rules = _rules(computed_fields=[{"field": "size_group", "expression": "$.p_size <= 7 ? 'box' : ($.p_size <= 31 ? 'crate' : 'pallet')", "dependencies": ["p_size"]}, {"field": "large", "expression": "$.p_size > 10"}])
    return apply_rules(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), "part", rules)[0].drop("p_size")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, round(l_extendedprice * l_quantity, 2) AS total FROM lineitem")
def rule_computed_arith(spark, sf_dir):
    rules = _rules(computed_fields=[{"field": "total", "expression": "round($.l_extendedprice * $.l_quantity, 2)", "dependencies": ["l_extendedprice", "l_quantity"]}])
    return apply_rules(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), "lineitem", rules)[0]


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS order_year FROM orders")
def rule_year(spark, sf_dir):
    raw = _t(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("order_date"))
    rules = _rules(field_configs=[{"field": "order_date", "target_type": "date"}], computed_fields=[{"field": "order_year", "expression": "new Date($.order_date).getFullYear()", "dependencies": ["order_date"]}])
    return apply_rules(raw, "orders", rules)[0].drop("order_date")


@query("SELECT c_custkey, concat(coalesce(nullif(c_name, ''), ''), ' ', CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE c_mktsegment END) AS full_name FROM customer")
def rule_concat_default(spark, sf_dir):
    raw = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    rules = _rules(computed_fields=[{"field": "full_name", "expression": "concat($.c_name || '', ' ', $.segment || 'none')", "dependencies": ["c_name", "segment"]}], field_configs=[{"field": "c_name", "exclude": True}, {"field": "segment", "exclude": True}])
    return apply_rules(raw, "users", rules)[0]


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'error' AND event_type NOT IN ('click', 'view')")
def rule_filter_ne_nin(spark, sf_dir):
    rules = _rules(filters=[{"field": "event_type", "operator": "ne", "value": "error", "action": "include"}, {"field": "event_type", "operator": "nin", "value": ["click", "view"], "action": "include"}])
    return apply_rules(_t(spark, sf_dir, "events").select("event_id", "event_type"), "events", rules)[0]


@query("SELECT event_id, event_type FROM events WHERE event_type = 'view'")
def rule_filter_absent(spark, sf_dir):
    """A field that no document has differs from every value: it passes ne, and neither eq nor regex."""
    e = _t(spark, sf_dir, "events").select("event_id", "event_type")
    passed = apply_rules(e, "events", _rules(filters=[{"field": "gone", "operator": "ne", "value": "x"}, {"field": "gone", "operator": "exists", "value": False}, {"field": "event_type", "operator": "eq", "value": "view"}]))[0]
    stopped = [apply_rules(e, "events", _rules(filters=[{"field": "gone", "operator": o, "value": "x"}]))[0] for o in ("eq", "in", "regex", "gt")]
    for none in stopped:
        passed = passed.unionByName(none)
    return passed


@query("SELECT 'audit_log' AS table_name, 'all,log' AS rules UNION ALL SELECT 'users', 'all' UNION ALL SELECT 'logs', 'all,log'")
def rule_glob_targeting(spark, sf_dir):
    rules = RuleSet([{"id": "log", "table_patterns": ["logs", "*_log"], "priority": 10}, {"id": "all", "table_patterns": ["*"], "priority": 1}, {"id": "off", "table_patterns": ["*"], "enabled": False}, {"id": "other", "source_id": "b", "table_patterns": ["*"]}])
    return spark.createDataFrame([(t, ",".join(r["id"] for r in rules.chosen(t, "a"))) for t in ("audit_log", "users", "logs")], "table_name string, rules string")


@query("SELECT c_custkey, concat(left(c_name, 3), repeat('*', greatest(length(c_name) - 7, 0)), right(c_name, 4)) AS c_name FROM customer")
def rule_mask_template(spark, sf_dir):
    rules = _rules(masking_rules=[{"field": "c_name", "template": "phone"}])
    return apply_rules(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), "customer", rules)[0]


@query()
def rule_now(spark, sf_dir):
    rules = _rules(computed_fields=[{"field": "processed_at", "expression": "now()"}])
    return apply_rules(_t(spark, sf_dir, "nation"), "nation", rules)[0]


_NOW = "TIMESTAMP '2030-01-01 00:00:00'"
_ITEMS = "SELECT event_id::VARCHAR AS item_id, concat('job', (event_id % 3)::VARCHAR) AS job_id, user_id::VARCHAR AS pk, (event_id // 50)::VARCHAR AS position, (event_id % 4)::INTEGER AS retry_count, 3 AS max_retries, CASE event_id % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'retrying' ELSE 'pending' END AS status FROM events WHERE event_type = 'error'"


def _items(spark, sf_dir):
    e = _t(spark, sf_dir, "events").filter("event_type = 'error'")
    return e.selectExpr("cast(event_id as string) AS item_id", "concat('job', event_id % 3) AS job_id", "cast(user_id as string) AS pk", "cast(event_id div 50 as string) AS position", "cast(event_id % 4 as int) AS retry_count", "3 AS max_retries", "CASE event_id % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'retrying' ELSE 'pending' END AS status", "timestampadd(SECOND, -cast(event_id % 300 as int), timestamp'2030-01-01 00:00:00') AS tried", "timestampadd(DAY, -cast(event_id % 20 as int), timestamp'2030-01-01 00:00:00') AS first_failed", "event_id").withColumn("last_retried", F.when(F.col("event_id") % 7 != 0, F.col("tried")))


@query(f"""WITH i AS ({_ITEMS}), old AS (SELECT * FROM i WHERE item_id::BIGINT % 2 = 0), new AS (SELECT DISTINCT job_id, pk, position FROM i WHERE item_id::BIGINT % 2 = 1)
SELECT job_id, pk, position FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.job_id = new.job_id AND old.pk = new.pk AND old.position = new.position AND old.status IN ('pending', 'retrying'))""")
def dlq_dedupe(spark, sf_dir):
    i = _items(spark, sf_dir)
    return dead_letters.add_failures(i.filter("event_id % 2 = 0"), i.filter("event_id % 2 = 1")).select("job_id", "pk", "position")


@query("SELECT event_id::VARCHAR AS item_id FROM events WHERE event_type = 'error' AND event_id % 5 > 1 AND event_id % 4 < 3 AND (event_id % 7 = 0 OR event_id % 300 >= 30 * pow(2, event_id % 4))")
def dlq_eligible(spark, sf_dir):
    return _items(spark, sf_dir).filter(dead_letters.eligible(F.lit("2030-01-01 00:00:00").cast("timestamp"))).select("item_id")


@query(f"SELECT item_id, (retry_count + 1)::INTEGER AS retry_count, CASE WHEN item_id::BIGINT % 2 = 0 THEN 'resolved' WHEN retry_count + 1 >= max_retries THEN 'exhausted' ELSE 'pending' END AS status FROM ({_ITEMS})")
def dlq_fsm(spark, sf_dir):
    out = dead_letters.after_retry(_items(spark, sf_dir), F.col("event_id") % 2 == 0, F.lit("2030-01-01").cast("timestamp"))
    return out.select("item_id", "retry_count", "status")


@query("SELECT event_id::VARCHAR AS item_id FROM events WHERE event_type = 'error' AND NOT (event_id % 5 = 0 AND event_id % 20 > 7)")
def dlq_cleanup(spark, sf_dir):
    return _items(spark, sf_dir).filter(~dead_letters.expired(F.lit("2030-01-01 00:00:00").cast("timestamp"))).select("item_id")


@query("SELECT event_id::VARCHAR AS item_id FROM events WHERE event_type = 'error' AND event_id % 3 = 2")
def dlq_orphans(spark, sf_dir):
    jobs = spark.createDataFrame([("job0",), ("job1",)], "job_id string")
    return dead_letters.orphans(_items(spark, sf_dir), jobs).select("item_id")


@query("SELECT event_id::VARCHAR AS item_id, CASE event_id % 3 WHEN 1 THEN 'job1' ELSE 'job1' END AS target_job FROM events WHERE event_type = 'error'")
def dlq_route(spark, sf_dir):
    jobs = spark.createDataFrame([("job0", False), ("job1", True)], "job_id string, enabled boolean")
    return dead_letters.route_retry(_items(spark, sf_dir), jobs)


@query("SELECT count(*) AS total, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'retrying') AS retrying, 0::BIGINT AS exhausted, count(*) FILTER (s = 'resolved') AS resolved, 0::BIGINT AS discarded FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'retrying' ELSE 'pending' END AS s FROM events WHERE event_type = 'error')")
def dlq_stats(spark, sf_dir):
    return dead_letters.status_counts(_items(spark, sf_dir))


@query("SELECT event_id::VARCHAR AS item_id FROM events WHERE event_type = 'error' AND event_id % 5 > 1 ORDER BY event_id % 20 DESC, event_id::VARCHAR LIMIT 20")
def dlq_list(spark, sf_dir):
    return dead_letters.list_items(_items(spark, sf_dir), "pending", 20).select("item_id")


@query("SELECT 'OBJECT<k: BIGINT>' AS found")
def schema_sniff(spark, sf_dir):
    return spark.createDataFrame([(readers.sniff_schema(_t(spark, sf_dir, "events"), "props"),)], "found string")


@query("""SELECT count(*) AS rows_in, max(b) - min(b) + 1 AS n_buckets, true AS even FROM (SELECT o_orderkey % 4 AS b FROM orders)""")
def chunk_equal_rows(spark, sf_dir):
    parts = chunks.group_boundaries(_t(spark, sf_dir, "orders"), "o_orderkey", 4)
    even = F.max("n") <= 1.1 * F.min("n")
    return parts.agg(F.sum("n").alias("rows_in"), F.count("*").alias("n_buckets"), even.alias("even"))


_BEFORE, _AFTER = "event_type = 'view' AND value > 100", "event_type = 'click' AND value < 5"
_USERS = "SELECT DISTINCT user_id FROM events WHERE "


@query(f"{_USERS}{_AFTER} EXCEPT {_USERS}{_BEFORE}")
def migration_started(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return relational.started_and_finished(e.filter(_BEFORE), e.filter(_AFTER), "user_id")[0]


@query(f"{_USERS}{_BEFORE} EXCEPT {_USERS}{_AFTER}")
def migration_finished(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return relational.started_and_finished(e.filter(_BEFORE), e.filter(_AFTER), "user_id")[1]


@query("SELECT c_custkey, 'new' AS origin FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey NOT IN (2, 4)")
def config_keyed_union(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey")
    return relational.keyed_union(c.filter("c_custkey % 3 = 0").withColumn("origin", F.lit("new")), c.filter("c_custkey % 2 = 0").withColumn("origin", F.lit("old")), "c_custkey", [2, 4])


@query(f"""WITH s AS (SELECT c_custkey::VARCHAR AS pk, 'INSERT' AS op, -1 AS seq FROM customer UNION ALL SELECT user_id::VARCHAR, {_OP}, event_id FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY seq DESC) AS rn FROM s) SELECT pk, op, seq FROM l WHERE rn = 1 AND op <> 'DELETE'""")
def snapshot_then_cdc(spark, sf_dir):
    snap = source_events.from_snapshot(_t(spark, sf_dir, "customer"), "Users", ["c_custkey"], seq=-1)
    return upsert.current_state(snap.unionByName(change_log(spark, sf_dir)), ["pk"]).select("pk", "op", "seq")


@query(f"""SELECT user_id::VARCHAR AS pk, concat('{{"index":{{"_index":"app-users","_id":"', user_id::VARCHAR, '"}}}}', chr(10), props) AS lines FROM ({_LAST}) WHERE op <> 'DELETE'
UNION ALL SELECT user_id::VARCHAR, concat('{{"delete":{{"_index":"app-users","_id":"', user_id::VARCHAR, '"}}}}') FROM ({_LAST}) WHERE op = 'DELETE'""")
def bulk_request_lines(spark, sf_dir):
    last = upsert.latest(change_log(spark, sf_dir), ["pk"])
    return last.select("pk", bulk_lines(documents.index_name("app", F.col("table")), F.col("pk"), F.col("op"), F.col("data")).alias("lines"))


@query("SELECT column_name, ordinal::INTEGER AS ordinal, column_name = 'o_orderkey' AS is_key FROM (VALUES ('o_orderkey', 1), ('o_custkey', 2), ('o_orderstatus', 3), ('o_totalprice', 4), ('o_orderdate', 5), ('o_orderpriority', 6)) t(column_name, ordinal)")
def table_metadata(spark, sf_dir):
    return readers.describe_table(_t(spark, sf_dir, "orders"), ["o_orderkey"]).select("column_name", "ordinal", "is_key")


@query("""SELECT concat('0/', upper(format('{:x}', n_nationkey + 1))) AS lsn, 'INSERT' AS op, n_nationkey::VARCHAR AS pk, concat('{"n_name":"', n_name, '","n_nationkey":"', n_nationkey::VARCHAR, '"}') AS data FROM nation""")
def pgoutput_decode(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    relation = pgoutput.encode_relation(16384, "public", "nation", [("n_nationkey", 23, True), ("n_name", 25, False)])
    field = lambda c: F.concat(F.lit(b"t"), F.unhex(F.lpad(F.hex(F.octet_length(c)), 8, "0")), c.cast("binary"))
    row = F.concat(F.lit(b"I" + (16384).to_bytes(4, "big") + b"N" + (2).to_bytes(2, "big")), field(F.col("n_nationkey").cast("string")), field(F.col("n_name")))
    head = spark.createDataFrame([("s", "0/0", 0, bytearray(relation))], "slot string, lsn string, seq long, frame binary")
    rows = n.select(F.lit("s").alias("slot"), F.concat(F.lit("0/"), F.hex(F.col("n_nationkey") + 1)).alias("lsn"), (F.col("n_nationkey") + 1).cast("long").alias("seq"), row.alias("frame"))
    return pgoutput.decode_frames(head.unionByName(rows)).filter("op is not null").select("lsn", "op", "pk", "data")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'INSERT' WHEN event_id % 3 = 1 THEN 'UPDATE' ELSE 'DELETE' END AS op, event_id::VARCHAR AS pk FROM events WHERE event_id % 7 <> 1 OR event_id % 3 <> 1")
def change_stream_events(spark, sf_dir):
    k = F.col("event_id") % 3
    key = F.concat(F.lit('{"_id":{"$numberLong":"'), F.col("event_id").cast("string"), F.lit('"}}'))
    full = F.when((k != 2) & ~((F.col("event_id") % 7 == 1) & (k == 1)), F.concat(F.lit('{"_id":{"$numberLong":"'), F.col("event_id").cast("string"), F.lit('"},"v":1}')))
    stream = _t(spark, sf_dir, "events").select(F.when(k == 0, "insert").when(k == 1, "replace").otherwise("delete").alias("operation"), F.lit("app").alias("database"), F.lit("users").alias("collection"), F.lit("t").alias("token"), F.col("event_id").alias("seq"), full.alias("full_document"), key.alias("document_key"))
    return source_events.from_change_stream(stream).select(F.col("seq").alias("event_id"), "op", "pk")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE concat('a', chr(65533), 'b') END AS text FROM events")
def utf8_repair(spark, sf_dir):
    raw = F.when(F.col("event_id") % 2 == 0, F.lit(b"ok")).otherwise(F.lit(b"a\xffb"))
    return _t(spark, sf_dir, "events").select("event_id", inference.repair_utf8(raw).alias("text"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS s, coalesce(CASE WHEN event_type = 'error' THEN 1 END, 0) AS failed FROM events")
def epoch_extract(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"), F.coalesce(F.when(F.col("event_type") == "error", 1), F.lit(0)).alias("failed"))


@query("SELECT event_id, event_id % 4 IN (0, 2) OR event_id % 4 = 1 AND event_id > 1 AS valid FROM events")
def checkpoint_validity(spark, sf_dir):
    k, i = F.col("event_id") % 4, F.col("event_id")
    kind = F.when(k == 0, "mysql").when(k == 1, "postgresql").when(k == 2, "mongodb").otherwise("mysql")
    position = F.when(k == 0, F.concat(F.lit("binlog.000001:"), i.cast("string"))).when(k == 1, F.concat(F.lit("0/"), F.hex(F.when(i > 1, i).otherwise(0)))).when(k == 2, F.base64(i.cast("string").cast("binary"))).otherwise("nowhere")
    return _t(spark, sf_dir, "events").select("event_id", positions.checkpoint_valid(kind, position).alias("valid"))


@query("SELECT o_orderkey // 3000 AS chunk_id, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, true AS in_order FROM orders GROUP BY 1")
def chunk_sorted_scan(spark, sf_dir):
    """Each chunk's rows arrive in key order: the gap to the row before is never negative."""
    ordered = chunks.sorted_chunks(_t(spark, sf_dir, "orders"), "o_orderkey", F.floor(F.col("o_orderkey") / 3000)).select("chunk_id", "o_orderkey", F.monotonically_increasing_id().alias("at"))
    gaps = ordered.withColumn("gap", F.col("o_orderkey") - F.lag("o_orderkey").over(Window.partitionBy("chunk_id").orderBy("at")))
    return gaps.groupBy("chunk_id").agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.coalesce(F.min("gap") >= 0, F.lit(True)).alias("in_order"))


@query("""SELECT * FROM (VALUES ('bigint', 'long', NULL), ('text', 'text', 'standard'), ('timestamp', 'date', NULL), ('numeric', 'scaled_float', NULL), ('point', 'geo_point', NULL), ('_int4', 'integer', NULL), ('jsonb', 'object', NULL), ('inet', 'ip', NULL), ('no such type', 'keyword', NULL)) t(name, index_type, analyzer)""")
def index_type_mapping(spark, sf_dir):
    types = pgtypes.TypeRegistry()
    names = ["bigint", "text", "timestamp", "numeric", "point", "_int4", "jsonb", "inet", "no such type"]
    return spark.createDataFrame([(n, types.index_mapping(n)["type"], types.index_mapping(n).get("analyzer")) for n in names], "name string, index_type string, analyzer string")


@query()
def table_row_estimate(spark, sf_dir):
    """Rows by file sizes and column widths, without a scan."""
    return spark.createDataFrame([(t, readers.estimated_rows(_t(spark, sf_dir, t))) for t in ("orders", "lineitem", "events")], "table_name string, about long")


@query("SELECT event_type AS worker, count(*) AS batches, sum(user_id)::BIGINT AS done_rows, sum(user_id) / 60.0::DOUBLE AS rows_per_second FROM events GROUP BY 1")
def worker_stats(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("worker"), F.col("user_id").alias("n"))
    return progress.worker_rates(e, "worker", "n", 60.0)


@query(f"SELECT user_id::VARCHAR AS pk, event_id AS seq FROM ({_LAST})")
def index_merge_old_events(spark, sf_dir):
    """A replay of old events onto a newer state leaves it as it is."""
    log = change_log(spark, sf_dir)
    state = upsert.latest(log, ["pk"])
    return upsert.merge_state(state, log.filter("seq % 2 = 0"), ["pk"]).select("pk", "seq")


def _scratch(spark: SparkSession) -> str:
    """A fresh folder that all executors see."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


_STREAM_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.readStream.schema(_STREAM_SCHEMA).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    return e.select(F.expr(_OP).alias("op"), F.lit("files").alias("source_type"), F.col("event_id").cast("string").alias("position"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("pk"), F.lit("app").alias("schema_name"), F.lit("Users").alias("table"), F.col("props").alias("data"))


@query(f"SELECT 'app-users' AS index, user_id::VARCHAR AS pk, event_id AS seq, op, replace(props, ' ', '') AS data FROM ({_LAST}) WHERE op <> 'DELETE'")
def stream_upsert_available_now(spark, sf_dir):
    at = _scratch(spark)
    job = SyncJob("upsert", IndexStore(spark, f"{at}/index", "app"), f"{at}/letters", f"{at}/checkpoint")
    job.start(_stream(spark, sf_dir), once=True).awaitTermination()
    return job.store.read()


@query(f"SELECT user_id::VARCHAR AS pk, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM (SELECT event_id, user_id, {_OP} AS op FROM events WHERE event_id % 10 <> 3)) WHERE rn = 1 AND op <> 'DELETE'")
def stream_dlq_branch(spark, sf_dir):
    at = _scratch(spark)
    job = SyncJob("branch", IndexStore(spark, f"{at}/index", "app"), f"{at}/letters", f"{at}/checkpoint", error=lambda b: F.when(F.col("seq") % 10 == 3, "rejected"))
    job.start(_stream(spark, sf_dir), once=True).awaitTermination()
    return job.store.read().select("pk", "seq")


@query("SELECT event_id::VARCHAR AS position, 'rejected' AS error_msg, 'pending' AS status FROM events WHERE event_id % 10 = 3")
def stream_dead_letters(spark, sf_dir):
    at = _scratch(spark)
    job = SyncJob("letters", IndexStore(spark, f"{at}/index", "app"), f"{at}/letters", f"{at}/checkpoint", error=lambda b: F.when(F.col("seq") % 10 == 3, "rejected"))
    job.start(_stream(spark, sf_dir), once=True).awaitTermination()
    return job.letters().select("position", "error_msg", "status")


@query(f"SELECT user_id::VARCHAR AS pk, event_id AS seq FROM ({_LAST}) WHERE op <> 'DELETE'")
def stream_restart_resume(spark, sf_dir):
    """Run twice from one checkpoint: the second run finds nothing new and changes nothing."""
    at = _scratch(spark)
    for _ in range(2):
        job = SyncJob("resume", IndexStore(spark, f"{at}/index", "app"), f"{at}/letters", f"{at}/checkpoint")
        job.start(_stream(spark, sf_dir), once=True).awaitTermination()
    return job.store.read().select("pk", "seq")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n_events FROM events GROUP BY 1, 2")
def window_tumbling(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.windowed_counts(e, "ts", ["event_type"], "1 hour").select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n_events")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n_events FROM s GROUP BY user_id, k""")
def window_session(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.sessions(e, "ts", "user_id", "30 minutes").select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n_events")


@query("SELECT event_id::VARCHAR AS position, 'pending' AS status FROM events WHERE event_id % 10 = 3")
def stream_replay_letters(spark, sf_dir):
    """A batch that comes again after its letters were written leaves them as they were."""
    at = _scratch(spark)
    job = SyncJob("replay", IndexStore(spark, f"{at}/index", "app"), f"{at}/letters", f"{at}/checkpoint", error=lambda b: F.when(F.col("seq") % 10 == 3, "rejected"))
    job.start(_stream(spark, sf_dir), once=True).awaitTermination()
    job.handle(change_log(spark, sf_dir), 0)
    return job.letters().select("position", "status")


@query("SELECT event_id::VARCHAR AS position, CASE WHEN event_id % 20 = 3 THEN 'resolved' ELSE 'exhausted' END AS status, CASE WHEN event_id % 20 = 3 THEN 1 ELSE 3 END AS retry_count FROM events WHERE event_id % 10 = 3")
def stream_retry_fsm(spark, sf_dir):
    """Rounds of retries until nothing is due: mended letters are resolved, the others exhausted after their tries."""
    at = _scratch(spark)
    bad = lambda b: F.when((F.col("seq") % 10 == 3) & ~F.col("pk").startswith("mended-"), "rejected")
    job = SyncJob("fsm", IndexStore(spark, f"{at}/index", "app"), f"{at}/letters", f"{at}/checkpoint", error=bad, base_seconds=0)
    job.handle(change_log(spark, sf_dir), 0)
    mend = lambda df: df.withColumn("pk", F.when(F.col("seq") % 20 == 3, F.concat(F.lit("mended-"), "pk")).otherwise(F.col("pk")))
    while job.retry(mend):
        pass
    return job.letters().select("position", "status", "retry_count")


@query("SELECT event_id::VARCHAR AS position, 'sink' AS error_type, 'resolved' AS status FROM events")
def stream_sink_down(spark, sf_dir):
    """A job whose sink takes nothing loses no event: all are letters, and go through once the sink is back."""
    at = _scratch(spark)
    job = SyncJob("down", FailingStore(spark), f"{at}/letters", f"{at}/checkpoint", base_seconds=0)
    job.handle(change_log(spark, sf_dir), 0)
    job.store = IndexStore(spark, f"{at}/index", "app")
    job.retry()
    return job.letters().select("position", "error_type", "status")


_RULED = f"SELECT event_id, user_id, {_OP} AS op, json_extract_string(props, '$.k')::BIGINT AS k FROM events"


@query(f"""SELECT user_id::VARCHAR AS pk, event_id AS seq, concat('{{"key":', k::VARCHAR, ',"odd":', CASE WHEN k > 50 THEN '"high"' ELSE '"low"' END, '}}') AS data
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM ({_RULED}) WHERE op = 'DELETE' OR k % 10 <> 3) WHERE rn = 1 AND op <> 'DELETE'""")
def stream_rules(spark, sf_dir):
    """The stream's documents go through rules on their way to the index."""
    at = _scratch(spark)
    rules = _rules(field_mappings=[{"source_field": "k", "target_field": "key", "action": "rename"}], field_configs=[{"field": "key", "validation": {"pattern": "[^3]$", "error_message": "ends in 3"}}], computed_fields=[{"field": "odd", "expression": "$.key > 50 ? 'high' : 'low'"}])
    job = SyncJob("ruled", IndexStore(spark, f"{at}/index", "app"), f"{at}/letters", f"{at}/checkpoint", rules=rules, schemas={"Users": "k bigint"})
    job.start(_stream(spark, sf_dir), once=True).awaitTermination()
    return job.store.read().select("pk", "seq", "data")


@query(f"""WITH p AS (SELECT max(event_id) AS top FROM events WHERE value <= 50), s AS (SELECT c_custkey::VARCHAR AS pk, 'INSERT' AS op, top AS seq, top::VARCHAR AS position FROM customer, p UNION ALL SELECT user_id::VARCHAR, {_OP}, event_id, event_id::VARCHAR FROM events, p WHERE event_id > top)
SELECT pk, op, seq, position FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY seq DESC) AS rn FROM s) WHERE rn = 1 AND op <> 'DELETE'""")
def snapshot_position(spark, sf_dir):
    """A snapshot stamped with the position that the log had before it, and the stream from there on."""
    log = change_log(spark, sf_dir)
    seen = log.join(_t(spark, sf_dir, "events").filter("value <= 50").select(F.col("event_id").alias("seq")), "seq", "left_semi")
    at = source_events.log_position(seen)
    snap = source_events.snapshot_at(_t(spark, sf_dir, "customer"), "Users", ["c_custkey"], at)
    return upsert.current_state(snap.unionByName(source_events.resume_after(log, at)), ["pk"]).select("pk", "op", "seq", "position")


@query("SELECT event_type, user_id AS source, (max(event_id) * 60 - coalesce(max(CASE WHEN value < 50 THEN event_id * 60 END), max(event_id) * 60))::BIGINT AS lag_seconds FROM events GROUP BY 1, 2")
def replication_lag_seconds(spark, sf_dir):
    at = F.timestamp_seconds(F.col("event_id") * 60)
    e = _t(spark, sf_dir, "events").select(F.struct("event_type", "user_id").alias("source"), at.alias("produced"), F.when(F.col("value") < 50, at).alias("committed"))
    return progress.lag_seconds(e, "source", "produced", "committed").select("source.event_type", F.col("source.user_id").alias("source"), "lag_seconds")


@query("SELECT event_type, round(list_reduce(list(value ORDER BY event_id)[-64:], lambda a, x: (a + x) / 2), 6) AS smoothed FROM events GROUP BY 1")
def smoothed_latency(spark, sf_dir):
    return progress.smoothed(_t(spark, sf_dir, "events"), "event_type", "event_id", "value").select("event_type", F.round("smoothed", 6).alias("smoothed"))


@query("SELECT least(count(*), 100) AS n, true AS all_pending FROM events WHERE event_type = 'error' AND event_id % 5 > 1")
def dlq_list_unordered(spark, sf_dir):
    some = dead_letters.list_items(_items(spark, sf_dir), "pending", 100, ordered=False)
    return some.agg(F.count("*").alias("n"), F.bool_and(F.col("status") == "pending").alias("all_pending"))


@query("SELECT o_orderkey, (o_orderkey % 3 + 1)::INTEGER AS tries, CASE WHEN o_orderkey % 3 < 2 THEN 'pending' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 3 < 2 THEN 5 * (o_orderkey % 3 + 1) END::BIGINT AS wait FROM orders")
def chunk_retry(spark, sf_dir):
    at = F.lit("2030-01-01 00:00:00").cast("timestamp")
    failed = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).cast("int").alias("tries"), at.alias("failed_at"))
    return chunks.after_failure(failed).select("o_orderkey", "tries", "status", (F.unix_seconds("next_at") - F.unix_seconds("failed_at")).alias("wait"))


_SLOTS = "SELECT concat('slot_', s_suppkey::VARCHAR) AS slot_name, CASE WHEN s_suppkey % 5 = 0 THEN 'test_decoding' ELSE 'pgoutput' END AS plugin, s_acctbal > 5000 AS active, s_suppkey FROM supplier"


def _slots(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").select(F.concat(F.lit("slot_"), F.col("s_suppkey").cast("string")).alias("slot_name"), F.when(F.col("s_suppkey") % 5 == 0, "test_decoding").otherwise("pgoutput").alias("plugin"), (F.col("s_acctbal") > 5000).alias("active"), F.concat(F.lit("1/"), F.hex("s_suppkey")).alias("confirmed_lsn"), F.concat(F.lit("1/"), F.hex(F.lit(1 << 20) - F.col("s_suppkey"))).alias("restart_lsn"))


@query(f"""WITH s AS ({_SLOTS}), w AS (SELECT concat('slot_', n_nationkey::VARCHAR) AS slot_name FROM nation)
SELECT coalesce(s.slot_name, w.slot_name) AS slot_name, CASE WHEN s.slot_name IS NULL THEN 'create' WHEN w.slot_name IS NULL THEN CASE WHEN active THEN 'keep' ELSE 'drop' END WHEN plugin <> 'pgoutput' THEN 'recreate' ELSE 'reuse' END AS action FROM s FULL JOIN w ON s.slot_name = w.slot_name""")
def slot_actions(spark, sf_dir):
    wanted = _t(spark, sf_dir, "nation").select(F.concat(F.lit("slot_"), F.col("n_nationkey").cast("string")).alias("slot_name"))
    return catalogs.slot_actions(_slots(spark, sf_dir), wanted)


@query(f"SELECT slot_name, active, 1048576 - s_suppkey AS lag, s_suppkey = (SELECT max(s_suppkey) FROM supplier) AS oldest FROM ({_SLOTS})")
def slot_lags(spark, sf_dir):
    slots = _slots(spark, sf_dir)
    lags = catalogs.slot_lags(slots, F.lit("1/100000"))
    oldest = catalogs.oldest_slot(slots).withColumn("oldest", F.lit(True))
    return relational.lookup(lags, oldest, "slot_name", "left").select("slot_name", "active", F.col("lag").cast("long").alias("lag"), F.coalesce("oldest", F.lit(False)).alias("oldest"))


@query("SELECT DISTINCT concat('t', c_nationkey::VARCHAR) AS table_name, 'add' AS change FROM customer WHERE c_acctbal > 9500 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT DISTINCT concat('t', s_nationkey::VARCHAR), 'drop' FROM supplier WHERE s_acctbal > 5000 AND s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500)")
def publication_changes(spark, sf_dir):
    published = _t(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("table"))
    wanted = _t(spark, sf_dir, "customer").filter("c_acctbal > 9500").select(F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("table"))
    return catalogs.publication_changes(published, wanted).withColumnRenamed("table", "table_name")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'sharded' WHEN 1 THEN 'replicaset' ELSE 'standalone' END AS kind FROM events")
def topology_detect(spark, sf_dir):
    hello = F.when(F.col("event_id") % 3 == 0, '{"msg":"isdbgrid","ok":1}').when(F.col("event_id") % 3 == 1, '{"setName":"rs0","hosts":["a"]}').otherwise('{"ok":1}')
    return _t(spark, sf_dir, "events").select("event_id", catalogs.topology(hello).alias("kind"))


@query("SELECT o_orderkey, CASE WHEN o_custkey >= 100 THEN concat('shard', least(o_custkey // 100, 9)::VARCHAR) END AS shard FROM orders")
def shard_lookup(spark, sf_dir):
    """Keys in the ranges that a router's catalog lists; the first range is in no shard."""
    ranges = spark.createDataFrame([(100 * k, 100 * k + 100 if k < 9 else 1 << 60, f"shard{k}") for k in range(1, 10)], "low long, high long, shard string")
    return catalogs.shard_of(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", ranges).select("o_orderkey", "shard")


@query("SELECT event_id AS seq, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS shard FROM events WHERE event_type <> 'error'")
def shard_streams_merged(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "user_id", F.when(F.col("event_type") == "error", True).alias("from_migrate"))
    own = lambda k, name: e.filter(F.col("user_id") % 2 == k).select("seq", F.lit(name).alias("shard"), "from_migrate")
    return catalogs.merged_shards([own(0, "a"), own(1, "b")])


@query("SELECT event_id AS seq, concat((event_id % 4)::VARCHAR, ':', event_id::VARCHAR) AS position, user_id::VARCHAR AS pk FROM events")
def kafka_value_events(spark, sf_dir):
    e = change_log(spark, sf_dir)
    raw = e.select(F.to_json(F.struct(*[c for c in e.columns if c != "position"])).cast("binary").alias("value"), (F.col("seq") % 4).cast("int").alias("partition"), F.col("seq").alias("offset"))
    return readers.kafka_events(raw).select("seq", "position", "pk")


#: A literal of every type, and the document value that it becomes, as JSON.
_LITERALS = [
    ("bigint", "9007199254740993", "9007199254740993"),
    ("smallint", "-32768", "-32768"),
    ("integer", "2147483647", "2147483647"),
    ("real", "1.5", "1.5"),
    ("double precision", "-2.25", "-2.25"),
    ("numeric", "12345678901234567890.123", '"12345678901234567890.123"'),
    ("text", "it''s", '"it\'\'s"'),
    ("char", "ab  ", '"ab  "'),
    ("varchar", "x", '"x"'),
    ("name", "pg_class", '"pg_class"'),
    ("boolean", "t", "true"),
    ("date", "2024-02-29", '"2024-02-29"'),
    ("time", "10:11:12.5", '"10:11:12.5"'),
    ("timestamp", "2024-02-29 10:11:12.5", '"2024-02-29T10:11:12.5Z"'),
    ("timestamptz", "2024-02-29 10:11:12+02", '"2024-02-29T08:11:12Z"'),
    ("timetz", "10:11:12+02", '"10:11:12+02"'),
    ("bytea", "\\x00ff", '"\\\\x00ff"'),
    ("uuid", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11", '"a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"'),
    ("json", '{"a": [1, null]}', '{"a":[1,null]}'),
    ("jsonb", "{no json", '"{no json"'),
    ("_int4", "{1,NULL,-3}", "[1,null,-3]"),
    ("_text", '{"a,b",c,"d\\"e"}', '["a,b","c","d\\"e"]'),
    ("_int8", "{}", "[]"),
    ("inet", "10.0.0.1/8", '"10.0.0.1/8"'),
    ("cidr", "10.0.0.0/8", '"10.0.0.0/8"'),
    ("point", "(1.5,-2)", '{"lat":"-2","lon":"1.5"}'),
    ("circle", "<(0,0),1>", '"<(0,0),1>"'),
    ("tsvector", "\'a\':1", '"\'a\':1"'),
    ("tsquery", "\'a\' & \'b\'", '"\'a\' & \'b\'"'),
    ("interval", "1 day 02:00:00", '"1 day 02:00:00"'),
    ("money", "-$1,234.50", "-1234.5"),
    ("bit", "101", '"101"'),
    ("varbit", "0", '"0"'),
    ("int4range", "[1,10)", '"[1,10)"'),
    ("int8range", "empty", '"empty"'),
    ("numrange", "(,2.5]", '"(,2.5]"'),
    ("tsrange", '["2024-01-01 00:00:00",)', '"[\\"2024-01-01 00:00:00\\",)"'),
    ("tstzrange", "(,)", '"(,)"'),
    ("daterange", "[2024-01-01,2024-02-01)", '"[2024-01-01,2024-02-01)"'),
    ("int4multirange", "{[1,3),[5,7)}", '"{[1,3),[5,7)}"'),
    ("int8multirange", "{}", '"{}"'),
    ("xml", "<a b=\'c\'/>", '"<a b=\'c\'/>"'),
    ("hstore", '"a"=>"1", b=>NULL', '{"a":"1","b":null}'),
    ("_bool", "{t,f}", "[true,false]"),
    ("_float4", "{0.5}", "[0.5]"),
    ("_float8", "{1e3,NULL}", "[1000.0,null]"),
    ("_uuid", "{a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11}", '["a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"]'),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("SELECT n_nationkey, type, value FROM nation, (VALUES " + ", ".join(f"({_quoted(t)}, {_quoted(v)})" for t, _, v in _LITERALS) + ") t(type, value)")
def pg_all_types(spark, sf_dir):
    """Every type's converter, on a row of text values as a server prints them."""
    types = pgtypes.TypeRegistry()
    texts = [F.when(F.col("n_nationkey") >= 0, F.lit(text)).alias(f"t{k}") for k, (_, text, _) in enumerate(_LITERALS)]
    rows = _t(spark, sf_dir, "nation").select("n_nationkey", *texts)
    # the document's field without the name that JSON needs around it
    value = lambda k, t: F.regexp_extract(F.to_json(F.struct(types.convert(t, F.col(f"t{k}")).alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1)
    return rows.select("n_nationkey", F.explode(F.array(*[F.struct(F.lit(t).alias("type"), value(k, t).alias("value")) for k, (t, _, _) in enumerate(_LITERALS)])).alias("x")).select("n_nationkey", "x.*")


@query("SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 'DELETE' WHEN o_orderstatus = 'O' THEN 'UPDATE' ELSE 'INSERT' END AS op, o_orderkey::VARCHAR AS pk, concat('binlog.000007:', o_orderkey::VARCHAR) AS position, o_custkey AS cust, CASE WHEN o_orderstatus = 'O' THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def binlog_decode(spark, sf_dir):
    """Orders written as binary-log events, by eight servers, and read again."""
    columns = [("id", binlog.LONGLONG, b""), ("cust", binlog.LONG, b""), ("status", binlog.VARCHAR, b"\x10\x00")]
    ops = {"F": "DELETE", "O": "UPDATE"}

    @F.pandas_udf("binary")
    def encoded(key, cust, status):
        import pandas as pd

        out = []
        for k, c, s in zip(key, cust, status):
            image = lambda text: [int(k).to_bytes(8, "little"), int(c).to_bytes(4, "little"), bytes([len(text)]) + text.encode()]  # noqa: B023, E731
            op = ops.get(s, "INSERT")
            out.append(binlog.encode_rows(op, 7, 3, [image(s), image("new")] if op == "UPDATE" else [image(s)], int(k)))
        return pd.Series(out)

    o = _t(spark, sf_dir, "orders")
    server = F.concat(F.lit("db"), (F.col("o_orderkey") % 8).cast("string"))
    heads = [(f"db{k}", -n, bytearray(e)) for k in range(8) for n, e in ((1, binlog.encode_table_map(7, "shop", "orders", columns, [0])), (2, binlog.encode_event(binlog.ROTATE, (4).to_bytes(8, "little") + b"binlog.000007")))]
    frames = spark.createDataFrame(heads, "server string, seq long, frame binary").unionByName(o.select(server.alias("server"), F.col("o_orderkey").alias("seq"), encoded("o_orderkey", "o_custkey", "o_orderstatus").alias("frame")))
    events = binlog.change_events(binlog.decode_events(frames, checksum=False))
    return events.select("seq", "op", "pk", "position", F.get_json_object("data", "$.cust").cast("long").alias("cust"), F.get_json_object("data", "$.status").alias("status"))


@query("SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H') AS batch_start, (k - 1) // 20 AS part, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY time_bucket(INTERVAL 6 HOUR, ts) ORDER BY event_id) AS k FROM events) GROUP BY 1, 2")
def size_or_time_batches(spark, sf_dir):
    batches = windows.size_or_time_batches(_t(spark, sf_dir, "events"), "ts", "event_id", 20, 21600)
    return batches.groupBy(F.date_format("batch_start", "yyyy-MM-dd HH").alias("batch_start"), "part").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
