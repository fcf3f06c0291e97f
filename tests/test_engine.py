import json
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import documents
from tidemark.operators import chunks, dead_letters, relational, upsert
from tidemark.plans import config
from tidemark.plans.expressions import ExpressionError, compile_expression
from tidemark.plans.rules import RuleSet, apply_rules
from tidemark.functions import pgtypes
from tidemark.operators import progress
from tidemark.sinks.index import FailingStore, IndexStore, bulk_requests, create_mapping
from tidemark.sinks.letters import LetterStore
from tidemark.sources import binlog, catalogs, pgoutput
from tidemark.sources.readers import FrameSource, SourceRegistry, stream_change_log
from tidemark.streaming.jobs import JobManager, SyncJob, commit_log

EVENT = "op string, source_type string, position string, seq long, pk string, schema_name string, `table` string, data string"


def events(spark, *rows):
    return spark.createDataFrame([(op, "t", str(seq), seq, pk, "s", "T", json.dumps({"_table": "T", "v": v})) for op, seq, pk, v in rows], EVENT)


def test_current_state_and_guard(spark):
    e = events(spark, ("insert", 1, "a", 1), ("UPDATE", 3, "a", 3), ("UPDATE", 2, "a", 2), ("DELETE", 4, "b", 0), ("INSERT", 1, "b", 1), ("NOTE", 9, "a", 9))
    assert [(r["pk"], r["seq"]) for r in upsert.current_state(e, ["pk"]).collect()] == [("a", 3)]


def test_index_store_is_idempotent_and_guarded(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"), "app")
    first = events(spark, ("INSERT", 1, "a", 1), ("INSERT", 2, "b", 2))
    assert store.write(first) == 1
    store.write(events(spark, ("DELETE", 5, "b", 0)))
    store.write(events(spark, ("UPDATE", 3, "b", 3), ("UPDATE", 4, "a", 4)))
    store.write(first)
    got = {r["pk"]: (r["seq"], json.loads(r["data"])) for r in store.read().collect()}
    assert got == {"a": (4, {"v": 4})}
    assert [(r["index"], r["n_docs"]) for r in store.describe().collect()] == [("app-t", 1)]
    assert store.read("app-none").count() == 0


def test_bulk_requests_split(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"), "app")
    store.write(events(spark, *[("INSERT", k, f"k{k:03d}", k) for k in range(100)]))
    out = bulk_requests(store.read(), max_bytes=1000).collect()
    assert sum(r["n_docs"] for r in out) == 100 and len(out) > 3
    assert all(len(r["body"]) < 1200 and r["body"].endswith("\n") for r in out)
    assert create_mapping()["mappings"]["properties"]["timestamp"] == {"type": "date"}


def test_streaming_resume_dead_letters_and_retry(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def drop(name, rows):
        (log / name).write_text("\n".join(json.dumps({"op": op, "source_type": "t", "position": str(s), "seq": s, "pk": pk, "schema_name": "s", "table": "T", "data": json.dumps({"v": s})}) for op, s, pk in rows))

    def job():
        return SyncJob("j", IndexStore(spark, str(tmp_path / "i"), "app"), str(tmp_path / "letters"), str(tmp_path / "cp"), error=lambda b: F.when(F.col("pk") == "bad", "no"))

    drop("1.json", [("INSERT", 1, "a"), ("INSERT", 2, "bad")])
    j = job()
    j.start(stream_change_log(spark, str(log)), once=True).awaitTermination()
    assert commit_log(j.query)
    drop("2.json", [("UPDATE", 3, "a"), ("INSERT", 4, "c")])
    again = job()
    again.start(stream_change_log(spark, str(log)), once=True).awaitTermination()
    assert sum(r["rows"] for r in commit_log(again.query)) == 2
    assert {r["pk"]: r["seq"] for r in again.store.read().collect()} == {"a": 3, "c": 4}
    assert [r["pk"] for r in again.letters().collect()] == ["bad"]
    assert again.retry() == {"pending": 1}
    assert again.retry() == {}  # not before the wait is over
    later = F.current_timestamp() + F.expr("INTERVAL 5 MINUTES")
    assert again.retry(lambda df: df.withColumn("pk", F.lit("good")), later) == {"resolved": 1}
    assert again.retry(now=later) == {}
    assert {r["pk"] for r in again.store.read().collect()} == {"a", "good", "c"}
    assert [(r["pk"], r["status"], r["retry_count"]) for r in again.letters().collect()] == [("bad", "resolved", 2)]
    assert again.status() == "STOPPED"
    manager = JobManager(spark)
    manager.create(again)
    with pytest.raises(ValueError):
        manager.create(again)
    assert manager.list().first()["status"] == "STOPPED"
    drop("3.json", [("DELETE", 5, "c")])
    manager.start("j", stream_change_log(spark, str(log)), once=True).awaitTermination()
    assert {r["pk"] for r in again.store.read().collect()} == {"a", "good"}
    assert manager.health().first()["healthy"]
    with pytest.raises(NotImplementedError):
        again.store.put_template("t")
    again.enabled = False
    with pytest.raises(ValueError):
        manager.start("j", stream_change_log(spark, str(log)))
    manager.remove("j")


def bad_job(spark, tmp_path, **more):
    return SyncJob("j", IndexStore(spark, str(tmp_path / "i"), "app"), str(tmp_path / "letters"), str(tmp_path / "cp"), error=lambda b: F.when(F.col("pk").startswith("bad"), "no"), **more)


def test_a_replayed_batch_keeps_its_letters(spark, tmp_path):
    job = bad_job(spark, tmp_path)
    batch = events(spark, ("INSERT", 1, "bad1", 1), ("INSERT", 2, "bad2", 2), ("INSERT", 3, "ok", 3), ("INSERT", 2, "bad2", 2))
    for _ in range(3):
        job.handle(batch, 0)
        assert sorted(r["pk"] for r in job.letters().collect()) == ["bad1", "bad2"]
    # the same failures in another batch are still the open items
    job.handle(batch, 1)
    assert sorted((r["pk"], r["batch"]) for r in job.letters().collect()) == [("bad1", "batch-0"), ("bad2", "batch-0")]
    job.retry(lambda df: df.withColumn("pk", F.lit("fine")))
    # and a replay doesn't open again what was resolved since
    job.handle(batch, 0)
    assert {r["status"] for r in job.letters().collect()} == {"resolved"}
    job.letter_store.compact()
    job.handle(batch, 0)
    assert {r["status"] for r in job.letters().collect()} == {"resolved"}
    # a later failure of a closed item is an item again
    job.handle(batch, 7)
    assert {(r["status"], r["retry_count"]) for r in job.letters().collect()} == {("pending", 0)}


def test_letters_are_exhausted_and_compacted(spark, tmp_path):
    job = bad_job(spark, tmp_path, max_retries=2, base_seconds=0)
    job.letter_store.parts.compact_every, job.letter_store.parts.expire_seconds = 3, 0
    job.handle(events(spark, *[("INSERT", k, f"bad{k}", k) for k in range(5)]), 0)
    assert job.retry() == {"pending": 5} and job.retry() == {"exhausted": 5} and job.retry() == {}
    for k in range(1, 6):
        job.handle(events(spark, ("INSERT", 100 + k, f"bad-{k}", k)), k)
    assert sorted(r["status"] for r in job.letters().collect()) == ["exhausted"] * 5 + ["pending"] * 5
    assert {r["status"] for r in job.letter_store.opened().collect()} == {"pending"}
    names = [p.name for p in (tmp_path / "letters").iterdir() if p.is_dir()]
    assert sum(n.startswith("b") for n in names) == 1 and len(names) <= 4
    old = F.current_timestamp() + F.expr("INTERVAL 8 DAYS")
    job.letter_store.put(job.letters().filter("status = 'pending'").limit(1).withColumn("status", F.lit("discarded")))
    job.letter_store.compact(old)
    assert sorted(r["status"] for r in job.letters().collect()) == ["pending"] * 4


def test_a_crash_while_retrying_is_recovered(spark, tmp_path):
    job = bad_job(spark, tmp_path)
    job.handle(events(spark, ("INSERT", 1, "bad", 1)), 0)
    job.letter_store.put(job.letters().withColumn("status", F.lit("retrying")))
    assert job.retry(lambda df: df.withColumn("pk", F.lit("ok"))) == {"resolved": 1}


def test_a_sink_that_is_down(spark, tmp_path):
    job = bad_job(spark, tmp_path, base_seconds=0)
    store, job.store = job.store, FailingStore(spark, "away")
    job.handle(events(spark, ("INSERT", 1, "a", 1), ("INSERT", 2, "bad", 2)), 0)
    assert sorted((r["pk"], r["error_type"], r["error_msg"]) for r in job.letters().collect()) == [("a", "sink", "away"), ("bad", "transform", "no")]
    assert job.retry() == {"pending": 2}
    job.store = store
    assert job.retry() == {"resolved": 1, "pending": 1}
    assert [r["pk"] for r in store.read().collect()] == ["a"]


def test_rules_in_a_job(spark, tmp_path):
    rules = RuleSet([{"id": "r", "field_mappings": [{"source_field": "v", "target_field": "w", "action": "rename"}], "field_configs": [{"field": "w", "required": True}], "filters": [{"field": "v", "operator": "ne", "value": 9}]}])
    job = SyncJob("j", IndexStore(spark, str(tmp_path / "i"), "app"), str(tmp_path / "letters"), str(tmp_path / "cp"), rules=rules, schemas={"T": "v long"})
    batch = events(spark, ("INSERT", 1, "a", 1), ("INSERT", 2, "dropped", 9), ("DELETE", 3, "gone", 0), ("INSERT", 4, "empty", None))
    other = batch.limit(1).withColumn("table", F.lit("Other")).withColumn("pk", F.lit("o"))
    broken = batch.limit(1).withColumn("data", F.lit("[1")).withColumn("pk", F.lit("broken"))
    job.handle(batch.unionByName(other).unionByName(broken), 0)
    assert {(r["index"], r["pk"]): json.loads(r["data"]) for r in job.store.read().collect()} == {("app-t", "a"): {"w": 1}, ("app-other", "o"): {"v": 1}}
    assert {r["pk"]: r["error_msg"] for r in job.letters().collect()} == {"empty": "w: required", "broken": "data is no JSON object"}
    assert json.loads(job.letters().filter("pk = 'empty'").first()["data"])["v"] is None


def test_retries_are_routed(spark, tmp_path):
    log, manager = LetterStore(spark, str(tmp_path / "shared")), JobManager(spark)
    first, second = bad_job(spark, tmp_path / "1"), bad_job(spark, tmp_path / "2")
    second.job_id = "k"
    manager.create(first)
    manager.create(second)
    first.letter_store = second.letter_store = log
    first.handle(events(spark, ("INSERT", 1, "bad", 1)), 0)
    second.handle(events(spark, ("INSERT", 1, "bad", 1)), 1)
    for job in (first, second):
        job.error = None
    first.enabled = False
    assert manager.retry(log) == {"resolved": 2}
    assert not first.store.read().count() and [r["pk"] for r in second.store.read().collect()] == ["bad"]
    second.error = lambda b: F.lit("never")
    second.handle(events(spark, ("INSERT", 9, "x", 1)), 2)
    second.enabled = False
    assert manager.retry(log) == {"pending": 1}


def test_readers_keep_their_files(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"), "app", compact_every=2)
    store.write(events(spark, ("INSERT", 1, "a", 1)))
    old = store.read()
    for k in range(2, 6):
        store.write(events(spark, ("INSERT", k, f"k{k}", k)))
    assert old.count() == 1 and store.read().count() == 5
    store.parts.expire_seconds = 0
    store.compact()
    assert store.read().count() == 5 and len(list((tmp_path / "i").iterdir())) <= 2


def test_indices_are_ensured(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"), "app")
    assert store.ensure("app-t", {"data": {"type": "object"}}) and not store.ensure("app-t")
    assert store.mapping("app-t")["mappings"]["properties"]["data"] == {"type": "object"}
    store.write(events(spark, ("INSERT", 1, "a", 1)))
    assert store.read().count() == 1


def test_ties_of_a_sequence_have_one_winner(spark):
    rows = events(spark, ("INSERT", 0, "a", 1), ("INSERT", 0, "a", 2), ("UPDATE", 0, "a", 0))
    for parts in (1, 2, 3):
        assert upsert.latest(rows.repartition(parts), ["pk"]).first()["op"] == "UPDATE"


def test_rows_without_a_key(spark):
    relation = pgoutput.encode_relation(7, "public", "t", [("id", 20, False), ("v", 25, False)])
    rows = [relation, *[pgoutput.encode_row("I", 7, ["5", x]) for x in "aab"]]
    frames = spark.createDataFrame([("s", f"0/{k}", k, bytearray(f)) for k, f in enumerate(rows)], "slot string, lsn string, seq long, frame binary")
    pks = [r["pk"] for r in pgoutput.decode_frames(frames).filter("op is not null").orderBy("lsn").collect()]
    assert pks[0] == pks[1] != pks[2] and len(pks[0]) == 64


@pytest.mark.parametrize("text, want", [("(a,b)", ["a", "b"]), ('("a,b",c)', ["a,b", "c"]), ('("x""y","p\\\\q",)', ['x"y', "p\\q", ""]), ("()", [""]), ('("(1,2)"," z ")', ["(1,2)", " z "]), ("no row", None), (None, None)])
def test_row_literals(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(pgtypes.composite(F.col("t")).alias("m")).first()["m"]
    assert (None if got is None else [got[f"field_{k + 1}"] for k in range(len(got))]) == want


@pytest.mark.parametrize("text, want", [('"a"=>"1"', {"a": "1"}), ('"k"=>"a\\"b", "z,y"=>"1"', {"k": 'a"b', "z,y": "1"}), ('a=>b, c => NULL,"d"=>"NULL"', {"a": "b", "c": None, "d": "NULL"}), ('"x=>y"=>"p=>q", "\\\\"=>""', {"x=>y": "p=>q", "\\": ""}), ('"a"=>"1", "a"=>"2"', {"a": "1"}), ("", {}), (None, None)])
def test_hstore_literals(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(pgtypes.hstore(F.col("t")).alias("m")).first()["m"] == want


def test_shard_ranges(spark):
    ranges = spark.createDataFrame([(0, 10, "a"), (10, 20, "b"), (30, 40, "c")], "low long, high long, shard string")
    keys = spark.createDataFrame([(k,) for k in (-1, 0, 9, 10, 19, 20, 29, 30, 39, 40, None)], "k long")
    got = {r["k"]: r["shard"] for r in catalogs.shard_of(keys, "k", ranges).collect()}
    assert got == {-1: None, 0: "a", 9: "a", 10: "b", 19: "b", 20: None, 29: None, 30: "c", 39: "c", 40: None, None: None}
    assert catalogs.shard_of(keys, "k", ranges.limit(0)).filter("shard is not null").count() == 0


def test_smoothing_forgets(spark):
    rows = spark.createDataFrame([("a", k, float(k % 7)) for k in range(200)] + [("b", 1, 5.0)], "w string, k long, v double")
    want = 0.0
    for k in range(200):
        want = (want + k % 7) / 2 if k else float(k % 7)
    got = {r["w"]: r["smoothed"] for r in progress.smoothed(rows, "w", "k", "v").collect()}
    assert abs(got["a"] - want) < 1e-12 and got["b"] == 5.0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from tidemark import session

    no = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: no)), master="spark://host:7077")
    with pytest.raises(RuntimeError):
        session.shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))


def test_pgoutput_frames(spark, tmp_path):
    relation = pgoutput.encode_relation(1, "public", "users", [("id", 20, True), ("name", 25, False), ("bio", 25, False)])
    frames = [
        b"B" + (5).to_bytes(8, "big") + (0).to_bytes(8, "big") + (7).to_bytes(4, "big"),
        relation,
        pgoutput.encode_row("I", 1, ["1", "NNN", None]),
        pgoutput.encode_row("U", 1, ["1", "new", pgoutput.UNCHANGED], ["1", "N-old", "x"]),
        pgoutput.encode_row("D", 1, old=["1", None, None], key_only=True),
        b"T" + (1).to_bytes(4, "big") + b"\0" + (1).to_bytes(4, "big"),
        pgoutput.encode_row("I", 9, ["1"]),
        b"I\0",
    ]
    with open(tmp_path / "slot.frames", "wb") as f:
        for k, frame in enumerate(frames):
            f.write(len(frame).to_bytes(4, "big") + (k + 1).to_bytes(8, "big") + frame)
    spark.dataSource.register(FrameSource)
    rows = pgoutput.decode_frames(spark.read.format("wal_frames").load(str(tmp_path))).collect()
    by = {r["lsn"]: r for r in rows}
    assert by["0/1"]["commit_micros"] == 946684800000000
    assert json.loads(by["0/3"]["data"]) == {"id": "1", "name": "NNN", "bio": None}
    assert json.loads(by["0/4"]["data"]) == {"id": "1", "name": "new"} and by["0/4"]["unchanged"] == ["bio"]
    assert json.loads(by["0/4"]["old_data"])["name"] == "N-old"
    assert (by["0/5"]["op"], by["0/5"]["pk"]) == ("DELETE", "1")
    assert by["0/6"]["op"] == "TRUNCATE"
    assert by["0/7"]["kind"] == by["0/8"]["kind"] == "ERROR"


def test_preloaded_relations(spark):
    relation = pgoutput.encode_relation(7, "public", "t", [("id", 20, True)])
    frames = spark.createDataFrame([("s", "0/1", 0, bytearray(pgoutput.encode_row("I", 7, ["5"])))], "slot string, lsn string, seq long, frame binary")
    assert pgoutput.decode_frames(frames, [relation]).first()["pk"] == "5"
    assert pgoutput.decode_frames(frames).first()["kind"] == "ERROR"


def test_frames_as_a_stream_keep_relations(spark, tmp_path):
    spark.dataSource.register(FrameSource)
    folder = tmp_path / "wal"
    folder.mkdir()

    def append(slot, first, *frames, torn=b""):
        with open(folder / f"{slot}.frames", "ab") as f:
            for k, frame in enumerate(frames):
                f.write(len(frame).to_bytes(4, "big") + (first + k).to_bytes(8, "big") + frame)
            f.write(torn)

    def run():
        decoded = pgoutput.decode_stream(spark.readStream.format("wal_frames").load(str(folder)))
        decoded.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return {(r["slot"], r["lsn"]): r["kind"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    relation = pgoutput.encode_relation(1, "public", "users", [("id", 20, True)])
    append("a", 1, relation, pgoutput.encode_row("I", 1, ["1"]), torn=b"\0\0")
    append("b", 1, pgoutput.encode_row("I", 1, ["1"]))
    assert run() == {("a", "0/1"): "RELATION", ("a", "0/2"): "INSERT", ("b", "0/1"): "ERROR"}
    (folder / "a.frames").write_bytes((folder / "a.frames").read_bytes()[:-2])
    append("a", 3, pgoutput.encode_row("D", 1, old=["1"]))
    assert run()[("a", "0/3")] == "DELETE" and len(run()) == 4


@pytest.mark.parametrize("low, high, size", [(1, 1, 10), (1, 5, 10), (0, 99, 10), (5, 1004, 7), (1, 100000, 100)])
def test_chunk_plans_cover(low, high, size):
    even = chunks.plan_even(low, high, size)
    assert even[0][0] == low and even[-1][1] == high + 1 and len(even) <= 8
    assert all(a[1] == b[0] for a, b in zip(even, even[1:]))


def test_chunks_of_empty_table(spark):
    assert chunks.even_chunks(spark.createDataFrame([], "id long"), "id", 10).count() == 0


def test_group_boundaries(spark):
    out = chunks.group_boundaries(spark.range(1000), "id", 4).collect()
    assert sum(r["n"] for r in out) == 1000 and all(200 <= r["n"] <= 300 for r in out)


def test_expressions(spark):
    row = spark.createDataFrame([(20, None, "x", 2.345)], "age int, none string, s string, f double")
    run = lambda e: row.select(compile_expression(e).alias("r")).first()[0]
    assert run("$.age <= 7 ? 'box' : ($.age <= 31 ? 'crate' : 'pallet')") == "crate"
    assert run("concat($.none || 'd', '-', $.s)") == "d-x"
    assert run("round($.f, 2)") == 2.35 or run("round($.f, 2)") == 2.34
    assert run("1 + 2 * 3 - 4") == 3
    assert run("($.age >= 20) && !($.age > 20)") is True
    assert run("$.age / 0") is None
    assert run("new Date('2024-05-06').getFullYear()") == 2024
    for bad in ("1 +", "foo(1)", "$.a ? 1", "1 2", "'open"):
        with pytest.raises(ExpressionError):
            compile_expression(bad)


def test_rules_all_parts_together(spark):
    rules = RuleSet.from_config(
        {
            "transform_rules": [
                {
                    "id": "parcels",
                    "source_id": "depot",
                    "table_patterns": ["parcel*"],
                    "field_mappings": [{"source_field": "nr", "target_field": "label", "action": "rename"}, {"source_field": "sent", "target_field": "first_seen", "action": "copy"}],
                    "field_configs": [{"field": "grams", "target_type": "int", "default_value": 5, "null_strategy": "default"}, {"field": "zone", "target_type": "keyword", "required": True, "validation": {"pattern": "^Z[0-9]+$", "error_message": "no zone"}}, {"field": "memo", "exclude": True}],
                    "masking_rules": [{"field": "iban", "template": "account"}, {"field": "pin", "strategy": "hash", "params": {"algorithm": "sha256"}}],
                    "computed_fields": [{"field": "kind", "expression": "$.grams <= 20 ? 'letter' : 'parcel'", "dependencies": ["grams"]}],
                    "filters": [{"field": "state", "operator": "ne", "value": "void", "action": "include"}],
                }
            ],
            "masking_templates": {"account": {"strategy": "mask", "params": {"prefix": 2, "suffix": 3, "char": "#"}}},
        }
    )
    assert rules.problems() == []
    df = spark.createDataFrame([("n1", "2031", "x", "Z7", "AB12345678", "00", None, "m"), ("n2", "2031", "30", "7", "1", "00", "out", "m"), ("n3", "2031", "30", None, "1", "00", "out", "m"), ("n4", "2031", "30", "Z1", "1", "00", "void", "m")], "nr string, sent string, grams string, zone string, iban string, pin string, state string, memo string")
    good, bad = apply_rules(df, "parcels_2031", rules, "depot")
    r = good.collect()
    assert len(r) == 1 and (r[0]["label"], r[0]["grams"], r[0]["iban"], r[0]["kind"], r[0]["first_seen"]) == ("n1", 5, "AB#####678", "letter", "2031")
    assert "memo" not in good.columns and len(r[0]["pin"]) == 64
    assert {x["label"]: list(x["_errors"]) for x in bad.collect()} == {"n2": ["zone: no zone"], "n3": ["zone: required"]}
    same, none = apply_rules(df, "other", rules)
    assert same.count() == 4 and none.count() == 0


def test_rule_problems():
    bad = RuleSet([{"table_patterns": ["x"], "field_mappings": [{"action": "move"}], "field_configs": [{"field": "a", "target_type": "blob", "validation": {"pattern": "("}}], "masking_rules": [{"field": "a", "template": "none"}, {"field": "b", "strategy": "rot13"}], "filters": [{"field": "a", "operator": "like"}], "computed_fields": [{"field": "z", "expression": "`"}]}])
    assert len(bad.problems()) == 9


def test_dead_letter_rules(spark):
    items = spark.sql("SELECT 'j' AS job_id, 'k' AS pk, '1' AS position, 'retrying' AS status")
    fresh = spark.sql("SELECT * FROM VALUES ('j','k','1'),('j','k','2'),('j','k','2') t(job_id, pk, position)")
    assert [r["position"] for r in dead_letters.add_failures(items, fresh).collect()] == ["2"]
    assert dead_letters.recovered(items).first()["status"] == "pending"
    assert dead_letters.discard(items, F.lit(True)).first()["status"] == "discarded"


def test_relational_helpers(spark):
    t = spark.createDataFrame([("a",), ("b",)], "`table` string")
    assert relational.include_tables(t, []).count() == 2
    assert relational.include_tables(t, ["a"] + [str(k) for k in range(2000)]).count() == 1
    assert relational.needs_initial_sync(False, True, False, None) is False
    assert relational.needs_initial_sync(True, True, True, t) is True
    assert relational.needs_initial_sync(True, False, True, None) is False
    assert relational.needs_initial_sync(True, False, False, t) is False
    assert relational.needs_initial_sync(True, False, False, t.limit(0)) is True


def test_config_formats_and_merge():
    legacy = config.load('{"db_host": "h", "db_user": "u", "es_addresses": ["a"]}')
    assert legacy.problems() == [] and legacy.jobs[0]["source_id"] == legacy.data_sources[0]["id"] == "default-mysql"
    new = config.load('{"version": "2.0", "data_sources": [{"id": "s"}], "sinks": [{"id": "k"}], "jobs": [{"id": "j", "source_id": "s", "sink_id": "none"}]}')
    assert len(new.problems()) == 1
    merged = config.merge(new, config.MultiConfig(data_sources=[{"id": "default-mysql"}, {"id": "s", "old": 1}, {"id": "t"}], jobs=[{"id": "default-job"}]))
    assert [x["id"] for x in merged.data_sources] == ["s", "t"] and [x["id"] for x in merged.jobs] == ["j"]
    assert config.detect_version("[]") == config.detect_version("{") == "unknown"
    with pytest.raises(config.ConfigError):
        config.load("{}")
    assert config.MultiConfig(options={"dlq_config": {"retry_delay": "1m30s"}}).dead_letters()["retry_delay"] == 90
    with pytest.raises(config.ConfigError):
        config.seconds("soon")


def test_config_store(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"db_host": "h", "db_name": "d", "es_addresses": ["a"]}')
    store = config.ConfigStore(str(path))
    store.open()
    assert config.detect_version(path.read_text()) == "2.0" and len(list(tmp_path.glob("*.backup_*"))) == 1
    told = []
    store.listen(lambda old, new: told.append((len(old.jobs), len(new.jobs))))
    store.add("jobs", {"id": "j2", "source_id": "default-mysql", "sink_id": "default-es"})
    with pytest.raises(config.ConfigError):
        store.add("jobs", {"id": "j2"})
    assert not store.poll() and store.config.find("jobs", "j2")
    text = path.read_text()
    path.write_text("{broken")
    assert not store.poll()
    value = json.loads(text)
    value["jobs"].pop()
    path.write_text(json.dumps(value))
    assert store.poll() and told == [(2, 1)]
    store.remove("jobs", "default-job")
    with pytest.raises(config.ConfigError):
        store.remove("jobs", "default-job")


def test_index_store_compacts(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"), "app", compact_every=3, expire_seconds=0)
    for k in range(1, 8):
        store.write(events(spark, ("UPDATE", k, "a", k), ("INSERT", k, f"k{k}", k), ("DELETE", k, f"k{k - 2}", 0)))
    assert store.version() == 7
    assert sorted(p.name for p in (tmp_path / "i").iterdir()) == ["b6", "d7"]
    assert {r["pk"]: r["seq"] for r in store.read().collect()} == {"a": 7, "k6": 6, "k7": 7}


def test_quote_name():
    assert documents.quote_name('a.b"c') == '"a"."b""c"'


def test_registry():
    r = SourceRegistry()
    r.register("a", "files", path="/x")
    r.attach("a", "job")
    with pytest.raises(ValueError):
        r.unregister("a")
    r.detach("a", "job")
    assert r.problems() == []
    r.unregister("a")
    with pytest.raises(ValueError):
        r.register("b", "oracle")


def test_binlog_rows(spark):
    columns = [("id", binlog.LONGLONG, b""), ("u", binlog.TINY, b""), ("s", binlog.VARCHAR, (1000).to_bytes(2, "little")), ("c", binlog.STRING, bytes([binlog.STRING, 20])), ("e", binlog.STRING, bytes([binlog.ENUM, 1])), ("d", binlog.NEWDECIMAL, bytes([14, 4])), ("x", binlog.DOUBLE, b"\x08"), ("day", binlog.DATE, b""), ("at", binlog.DATETIME2, b"\x03"), ("stamp", binlog.TIMESTAMP2, b"\x00"), ("t", binlog.TIME2, b"\x00"), ("y", binlog.YEAR, b""), ("b", binlog.BLOB, b"\x02"), ("f", binlog.BIT, bytes([1, 1])), ("m", binlog.INT24, b"")]
    clock = ((2024 * 13 + 2) << 5 | 29) << 17 | 10 << 12 | 11 << 6 | 12
    row = [(-5).to_bytes(8, "little", signed=True), b"\xff", (3).to_bytes(2, "little") + "hé".encode(), b"\x02ab", b"\x02", binlog.encode_decimal("-1234567.0089", 14, 4), struct.pack("<d", 2.5), (2024 << 9 | 2 << 5 | 29).to_bytes(3, "little"), (clock + 0x8000000000).to_bytes(5, "big") + (1250).to_bytes(2, "big"), (1700000000).to_bytes(4, "big"), (0x800000 - (1 << 12 | 2 << 6 | 3)).to_bytes(3, "big"), bytes([124]), (2).to_bytes(2, "little") + b"\xff\x00", b"\x01\x03", (-2).to_bytes(3, "little", signed=True)]
    want = {"id": -5, "u": 255, "s": "hé", "c": "ab", "e": 2, "d": "-1234567.0089", "x": 2.5, "day": "2024-02-29", "at": "2024-02-29 10:11:12.125", "stamp": "1700000000", "t": "-01:02:03", "y": 2024, "b": "/wA=", "f": 259, "m": -2}
    decoder = binlog.Decoder(checksum=False)
    assert decoder.decode(binlog.encode_event(binlog.ROTATE, (4).to_bytes(8, "little") + b"binlog.000009")) == [{"kind": "ROTATE", "file": "binlog.000009", "pos": 4}]
    assert decoder.decode(binlog.encode_table_map(77, "shop", "things", columns, [0], [1])) == []
    (found,) = decoder.decode(binlog.encode_rows("INSERT", 77, len(columns), [row], 500))
    assert json.loads(found["data"]) == want and (found["op"], found["pk"], found["file"], found["pos"], found["table"]) == ("INSERT", "-5", "binlog.000009", 500, "things")
    new = [*row[:2], None, *row[3:]]
    two = decoder.decode(binlog.encode_rows("UPDATE", 77, len(columns), [row, new, new, row], 600))
    assert [json.loads(x["data"])["s"] for x in two] == [None, "hé"] and json.loads(two[0]["old_data"]) == want
    assert decoder.decode(binlog.encode_rows("DELETE", 77, len(columns), [row], 700))[0]["op"] == "DELETE"
    assert decoder.decode(binlog.encode_event(binlog.XID, bytes(8), 800)) == [{"kind": "COMMIT", "file": "binlog.000009", "pos": 800}]
    assert decoder.decode(binlog.encode_event(2, b"BEGIN")) == []
    frames = [binlog.encode_rows("INSERT", 1, 1, [[b"\x01"]], 1), b"short", binlog.encode_table_map(1, "s", "t", [("a", binlog.TINY, b"")]), binlog.encode_rows("INSERT", 1, 1, [[b"\x01"], [b"\x02"]], 9)]
    rows = binlog.decode_events(spark.createDataFrame([("m", k, bytearray(f)) for k, f in enumerate(frames)], "server string, seq long, frame binary"), checksum=False).orderBy("seq", "data").collect()
    assert [(r["seq"], r["kind"], r["data"]) for r in rows] == [(0, "ERROR", "rows of an unknown table"), (1, "ERROR", "event ends early"), (3, "INSERT", '{"a":1}'), (3, "INSERT", '{"a":2}')]


@pytest.mark.parametrize("value", ["0", "-0.5", "1", "123456789", "1234567890.123456789", "-99999999999999999999.0000000001"])
def test_binlog_decimals(value):
    from decimal import Decimal

    assert Decimal(binlog._decimal(binlog._Bytes(binlog.encode_decimal(value, 32, 10)), 32, 10)) == Decimal(value)
