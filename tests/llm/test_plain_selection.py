"""Resampling, k-d shards and the joins of hot classes against plain versions."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import embed_dedup, resample, runtime, sharding, simhash
from tidemark.llm.queries import op7_kd_sharding
from tidemark.llm.textbytes import hash_words, mix64


def spark_hash(*values):
    """xxhash64 of integers (as (value, bytes)) and texts, one after another; None leaves it as it is."""
    h = 42
    for v in values:
        if v is None:
            continue
        data = v if isinstance(v, bytes) else int(v[0]).to_bytes(v[1], "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_grams(text):
    """Buckets of all tokens and pairs of neighbouring tokens."""
    tokens = [m.group() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", (text or "").encode())]
    h = [hash_words([t])[0] for t in tokens]
    return [int(x) % resample.BUCKETS for x in h] + [int(mix64(np.array([a * np.uint64(3) + b]))[0]) % resample.BUCKETS for a, b in zip(h, h[1:])]


def plain_resample(rows, good, fraction):
    """[(doc_id, n_grams, log weight, key, kept)] with every document counted and every key compared."""
    with np.errstate(over="ignore"):
        counts = [plain_grams(t) for _, t in rows]
    total, target = np.ones(resample.BUCKETS), np.ones(resample.BUCKETS)
    for (doc, _), g in zip(rows, counts):
        np.add.at(total, g, 1)
        if doc in good:
            np.add.at(target, g, 1)
    ratio = np.log(target / target.sum()) - np.log(total / total.sum()) if target.sum() > len(target) else np.zeros(len(target))
    seen, out = {}, []
    for (doc, text), g in zip(rows, counts):
        key = spark_hash((resample.SEED, 4), (doc is None, 4), None if doc is None else (doc, 8), (text is None, 4), None if text is None else text.encode())
        n = seen[doc, text] = seen.get((doc, text), -1) + 1
        u = ((spark_hash((signed(key), 8), (n, 8)) >> 11) + 0.5) / 2.0**53
        weight = float(ratio[g].sum())
        out.append([doc, len(g), weight, weight / max(1, len(g)) / resample.TEMPERATURE - np.log(-np.log(u))])
    k = -(-len(rows) * round(fraction * 10**6) // 10**6)
    best = set(sorted(range(len(rows)), key=lambda i: -out[i][3])[:k])
    return [(*r, i in best) for i, r in enumerate(out)]


def order(r):
    return (r[0] is None, r[0] or 0, r[1], r[3])


@pytest.mark.parametrize("fraction, target", [(0.75, True), (0.3, True), (0.5, False)])
def test_resampling_against_the_plain_draw(spark, sf_dir, fraction, target):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(None, "no id"), (None, "no id"), (None, "nor this"), (None, None), (None, ""), (3, "x y"), (3, "x y"), (3, None)]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet") if target else spark.createDataFrame([], "doc_id long, quality int")
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).repartition(5)
    got = sorted(map(tuple, resample.resample(docs, labels, fraction).collect()), key=order)
    want = sorted(plain_resample(rows, good, fraction), key=order)
    assert [(g[0], g[1], g[4]) for g in got] == [(w[0], w[1], w[4]) for w in want]
    assert all(abs(g[2] - w[2]) < 1e-6 and abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want))


def test_rows_without_ids_are_drawn_one_by_one(spark):
    docs = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "").alias("text")).repartition(6)
    out = resample.resample(docs, spark.createDataFrame([], "doc_id long, quality int"), 0.4).cache()
    assert out.filter("kept").count() == 20_000
    assert out.select("sample_key").distinct().count() >= 49_990


def test_numbers_are_gapless_and_taken_in_parts(spark):
    rows = runtime.settle(spark.range(3000).select((F.col("id") % 3).alias("g"), "id").repartition(7))
    out = runtime.numbered(rows, ["g"], ["id"], "n")
    by = {}
    for r in out.collect():
        by.setdefault(r["g"], []).append(r["n"])
    assert all(sorted(v) == list(range(1000)) for v in by.values()) and out.columns == ["g", "id", "n"]
    plan = out._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert sorted(r["n"] for r in runtime.numbered(rows, [], ["id"], "n").collect()) == list(range(3000))


@pytest.mark.parametrize("hot", [1, 50, 10**6])
def test_hot_classes_are_joined_in_place(spark, hot):
    rng = random.Random(hot)
    rows = [(k, rng.choice([0, 0, 0, k % 40])) for k in range(900)]
    left = spark.createDataFrame(rows, "id long, c long")
    classes = left.groupBy("c").agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("class "), F.col("c")))
    out = runtime.join_classes(left, classes, ["c"], "n", hot)
    assert sorted((r["id"], r["c"], r["name"]) for r in out.select("id", "c", "name").collect()) == [(i, c, f"class {c}") for i, c in rows]


def test_a_hot_class_of_each_operator(spark, monkeypatch):
    monkeypatch.setattr(runtime.join_classes, "__defaults__", (5,))
    texts = [(k, "one hot text of several words" if k % 3 else f"cold {k} text number {k} of its own") for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_components(docs).collect()}
    assert len(found) == 60 and all(found[k] == 1 for k in range(60) if k % 3)
    assert sorted(r["doc_id"] for r in simhash.keep_representatives(docs).collect()) == [k for k in range(60) if k % 3 == 0 or k == 1]
    shards = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, 4).collect()}
    assert len(shards) == 60 and len({shards[k] for k in range(60) if k % 3}) == 1
    vectors = spark.createDataFrame([(k, [1.0, 2.0] if k % 3 else [float(k), -1.0], "a" if k < 30 else "b") for k in range(60)], "vec_id long, embedding array<double>, label string")
    links = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicate_vectors(vectors).collect()}
    assert all(links[k] == 19 for k in range(60) if k % 3)


def plain_shards(atoms, first, shards, before, out):
    """Shards by splitting lists of atoms, one node after another."""
    if shards == 1 or not atoms:
        out.update({a["text_key"]: first for a in atoms})
        return
    goal = sum(a["weight"] for a in atoms) * ((shards // 2) / shards)
    width = lambda d: before[d][max(a[f"x_{d}"] for a in atoms)] - before[d][min(a[f"x_{d}"] for a in atoms)]
    d = max(sharding.DIMENSIONS, key=lambda d: (width(d), -sharding.DIMENSIONS.index(d)))
    run, cell = 0, None
    for x in sorted({a[f"x_{d}"] for a in atoms}):
        w = sum(a["weight"] for a in atoms if a[f"x_{d}"] == x)
        cell = x
        if run + w >= goal:
            break
        run += w
    inside = [a for a in atoms if a[f"x_{d}"] == cell]
    cut = None
    for t in sorted({a["tie"] for a in inside}):
        w = sum(a["weight"] for a in inside if a["tie"] == t)
        cut = t + (abs(run + w - goal) < abs(run - goal))
        if run + w >= goal:
            break
        run += w
    high = [a for a in atoms if a[f"x_{d}"] > cell or a[f"x_{d}"] == cell and a["tie"] >= cut]
    low = [a for a in atoms if not (a[f"x_{d}"] > cell or a[f"x_{d}"] == cell and a["tie"] >= cut)]
    plain_shards(low, first, shards // 2, before, out)
    plain_shards(high, first + shards // 2, shards - shards // 2, before, out)


@pytest.mark.parametrize("shards", [7, 40])
def test_shards_against_the_plain_tree(spark, sf_dir, shards):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    size = lambda t: len((t or "").encode()) + 16
    cell = lambda v: 0 if v is None else zlib.crc32(v.encode()) % (sharding.CELLS - 1) + 1
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"] or "", []).append(r)
    atoms = []
    for text, own in by_text.items():
        b = text.encode()
        key = spark_hash((signed(spark_hash(b)), 8), (len(b), 4), (zlib.crc32(b), 8))
        atoms.append({"text_key": key, "weight": sum(size(r["text"]) for r in own), "c_lang": min(cell(r["lang"]) for r in own), "c_source": min(cell(r["source"]) for r in own), "c_size": min(sharding.CELLS - 1, int(np.floor(np.log2(size(text)) * 128))), "tie": spark_hash((signed(key), 8)) >> 52})
    weights = {d: {} for d in sharding.DIMENSIONS}
    for a in atoms:
        for d in weights:
            weights[d][a[f"c_{d}"]] = weights[d].get(a[f"c_{d}"], 0) + a["weight"]
    before = {}
    for d, w in weights.items():
        cells = sorted(range(sharding.CELLS), key=lambda c: c if d == "size" else (-w.get(c, 0), c))
        place = {c: k for k, c in enumerate(cells)}
        before[d] = [sum(w.get(c, 0) for c in cells[:k]) / sum(w.values()) if k < 300 or d == "size" else 1.0 for k in range(sharding.CELLS)]
        for a in atoms:
            a[f"x_{d}"] = place[a[f"c_{d}"]]
    want, rest, light = {}, sum(a["weight"] for a in atoms), sorted(atoms, key=lambda a: (-a["weight"], signed(a["text_key"])))
    while light and len(want) < shards - 1 and light[0]["weight"] * (shards - len(want)) >= rest:
        rest -= light[0]["weight"]
        want[light.pop(0)["text_key"]] = len(want)
    alone = len(want)
    plain_shards(light, alone, shards - alone, before, want)
    got = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, shards).collect()}
    for text, own in by_text.items():
        b = text.encode()
        key = spark_hash((signed(spark_hash(b)), 8), (len(b), 4), (zlib.crc32(b), 8))
        assert {got[r["doc_id"]] for r in own} == {want[key]}


def test_the_registered_query_is_balanced(spark, sf_dir):
    sizes, heaviest, texts = {}, 0, {}
    for r in op7_kd_sharding(spark, sf_dir).collect():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        texts.setdefault(r["shard"], {}).setdefault((r["text_crc32"], r["size"]), []).append(r["size"])
    assert set(sizes) == set(range(40))
    shared = [s for s in sizes if len(texts[s]) > 1]
    heaviest = max(sum(v) for s in shared for v in texts[s].values())
    # a text's copies stay together, so sizes agree to the heaviest of them
    assert max(sizes[s] for s in shared) - min(sizes[s] for s in shared) <= 2 * heaviest


def test_rows_without_ids_have_slots(spark):
    docs = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source")).repartition(6)
    out = sharding.assign(docs, 10)
    per = out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect()
    assert sum(r["n"] for r in per) == 50_000 and all((r["d"], r["a"], r["b"]) == (r["n"], 0, r["n"] - 1) for r in per)
