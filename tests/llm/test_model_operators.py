"""Vectors, classifier, resampling, shards and components against plain versions, and their edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embed_dedup, resample, sharding, toxicity
from tidemark.llm.components import connected_components
from tidemark.llm.queries import op1_toxicity, op5_importance_resampling, op7_kd_sharding
from tidemark.llm.textbytes import column_bytes, hash_words, row_blocks, span_hashes, word_bounds


def test_components_against_search(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(1, 80)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if a != b:
            parent[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {x: find(x) for x in linked}
    assert connected_components(df.limit(0)).count() == 0


def plain_links(rows):
    ok = [(k, i, np.array(v, float), lab) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for k, _, v, a in ok:
        for m, _, w, b in ok:
            if m != k and a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[k].add(m)
    return links


def test_vectors_against_all_pairs(spark, sf_dir):
    rng = np.random.default_rng(2)
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    n = len(rows)
    for k in range(40):
        v = np.array(rows[k][1])
        rows.append((n + k, (v + rng.normal(0, 0.02, len(v))).astype(np.float32).tolist(), rows[k][2]))
    rows += [(n + 50 + k, rows[0][1], rows[0][2]) for k in range(30)]
    rows += [(n + 100, None, 1), (n + 101, [], 1), (n + 102, [0.0] * 64, 1), (n + 103, [float("nan")] * 64, 1), (n + 104, rows[3][1], None), (n + 105, [None, *rows[3][1][1:]], 1), (n + 106, [1.0, 2.0], 1), (n + 107, [2.0, 4.0], 1), (n + 108, [1.0], 1), (n + 109, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicate_vectors(df).collect()}
    links = plain_links(rows)
    found = sum(got[rows[k][0]]["n_links"] for k in links)
    wanted = sum(len(x) for x in links.values())
    assert found <= wanted and found >= 0.97 * wanted
    assert all(got[rows[k][0]]["n_links"] <= len(x) for k, x in links.items())
    assert got[n + 106]["n_links"] == 1 and got[n + 107]["component_id"] == n + 106 and not got[n + 107]["kept"]
    for k in (100, 101, 102, 103, 104, 105, 108, 109):
        assert (got[n + k]["n_links"], got[n + k]["component_id"], got[n + k]["kept"]) == (0, n + k, True)
    assert got[0]["n_links"] >= 30


def test_vector_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(1500, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    x, y = embed_dedup.bucket_codes(a), embed_dedup.bucket_codes(b)
    assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean() >= 0.99


def test_vectors_null_and_repeated_ids(spark):
    v = [1.0, 0.5, 0.25]
    df = spark.createDataFrame([(None, v, 1), (7, v, 1), (7, v, 1), (5, v, 1), (9, v, 2)], "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicate_vectors(df).collect())
    assert got == [(-1, 0, None, False), (5, 2, 5, True), (7, 2, 5, False), (7, 2, 5, False), (9, 0, 9, True)]
    assert embed_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_hot_buckets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup.crowded, "__defaults__", (8,))
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    rows = [(k, (centre + rng.normal(0, 0.05, 16)).tolist(), 1) for k in range(80)]
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {k: len(x) for k, x in plain_links(rows).items()}


def test_word_kernels():
    import pyarrow as pa

    texts = [None, "", "Ab c", "ab", "c-d éÉ", "x"]
    data, offsets = column_bytes(pa.array(texts))
    low, starts, ends, rows = word_bounds(data, offsets)
    assert [low[s:e].tobytes().decode() for s, e in zip(starts, ends)] == ["ab", "c", "ab", "c", "d", "éÉ", "x"]
    assert rows.tolist() == [0, 0, 0, 2, 3, 6, 7]
    h = span_hashes(low, starts, ends)
    assert h[0] == h[2] == hash_words([b"ab"])[0] and h[1] == h[3] and len(set(h.tolist())) == 5
    assert list(row_blocks(np.array([0, 5, 5, 100, 101]), 10)) == [(0, 2), (2, 3), (3, 4)]
    sliced, at = column_bytes(pa.array(texts)[2:4])
    assert sliced.tobytes() == b"Ab cab" and at.tolist() == [0, 4, 6]


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(4)
    clean, stems = [f"w{k}" for k in range(400)], ["grumph", "blarg", "snork"]
    rows, labels = [], []
    for k in range(900):
        words = [rng.choice(clean) for _ in range(rng.randint(3, 120))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(stems) + rng.choice(["", "ed", "ing", "s"])
        rows.append((k, " ".join(words), rng.choice(["en", "de", None])))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([*labels, (None, 1), (5000, 1), (1, None)], "doc_id long, toxic int")
    return docs, labels, toxicity.fit(docs, labels, F.col("id") % 3 != 1)


def test_toxicity_on_held_out_rows(spark, trained):
    docs, labels, model = trained
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(900) if k % 3 == 1]
    right = sum((got[k]["score"] >= 0.7) == (k % 5 == 0) for k in held)
    assert right / len(held) >= 0.97
    assert set(model.thresholds) >= {""} and all(0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.drop_toxic(docs.withColumn("score", F.lit("mine")), model)
    assert kept.columns == ["doc_id", "text", "lang", "score"]
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if not r["rejected"]}


def test_toxicity_reads_text_alone_and_odd_texts(spark, trained):
    docs, labels, model = trained
    odd = spark.createDataFrame([(1, None, None), (2, "", "xx"), (3, "!!", "en"), (None, "grumph " * 20000, "de"), (4, "grumph grumph", "en"), (4, "grumph grumph", "de")], "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(odd, model).collect()]
    by = {}
    for k, s in got:
        by.setdefault(k, set()).add(round(s, 9))
    assert len(got) == 6 and by[1] == by[2] == by[3] and len(by[4]) == 1 and max(by[4]) > 0.7 and max(by[None]) > 0.7
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_toxicity_without_both_classes(spark, trained):
    docs, labels, _ = trained
    model = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert toxicity.score(docs, model).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.drop_toxic(docs, model).count() == 900


def test_op1_contract(spark, sf_dir):
    rows = op1_toxicity(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1


def test_resampling_prefers_good_text(spark, sf_dir):
    rows = {r["doc_id"]: r for r in op5_importance_resampling(spark, sf_dir).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sum(r["kept"] for r in rows.values()) == -(-len(rows) * 3 // 4)
    least = min(r["sample_key"] for r in rows.values() if r["kept"])
    assert all(r["sample_key"] <= least for r in rows.values() if not r["kept"])
    mean = lambda q: np.mean([r["log_weight"] / max(1, r["n_grams"]) for k, r in rows.items() if labels.get(k) == q])
    assert mean(1) > mean(0)


def test_resampling_weights_are_the_ratio_of_the_counts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, None), (None, "b !! b")], "doc_id long, text string")
    good, total = resample.bucket_counts(docs, spark.createDataFrame([(1,)], "id long"))
    assert good.sum() == 3 and total.sum() == 3 + 3 + 0 + 5
    ratios = resample.log_ratios(good, total)
    n = resample.BUCKETS
    import pyarrow as pa

    bucket, row = resample.grams(*column_bytes(pa.array(["a b"])))
    want = sum(np.log((good[b] + 1) / (3 + n)) - np.log((total[b] + 1) / (11 + n)) for b in bucket)
    got = {r["doc_id"]: r for r in resample.weigh(docs, ratios).collect()}
    assert abs(got[1]["log_weight"] - want) < 1e-9 and got[3]["log_weight"] == 0 and got[None]["n_grams"] == 5


def test_gumbel_keys_draw_in_proportion(spark):
    key = resample.sample_keys(resample.weigh(spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), np.zeros(resample.BUCKETS)))
    v = np.array([r["sample_key"] for r in key.collect()])
    assert abs(v.mean() - 0.5772) < 0.03 and abs(v.std() - 1.2825) < 0.04


def test_kth_key_and_ties(spark):
    for values, k in (([1.0] * 10, 4), ([float(x) for x in range(2000)], 700), ([0.0, 0.0, 5.0, 5.0, 5.0, 9.0], 3), ([-1.5], 1)):
        key, room = resample._kth_key(spark.createDataFrame([(v,) for v in values], "key double"), k)
        assert key == sorted(values, reverse=True)[k - 1]
        assert room == k - sum(v > key for v in values)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    same = spark.createDataFrame([(1, "x")] * 8, "doc_id long, text string")
    assert resample.resample(same, labels, 0.5).filter("kept").count() == 4
    assert resample.resample(same.limit(0), labels).count() == 0


def test_shards_of_real_documents(spark, sf_dir):
    rows = op7_kd_sharding(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts) and {r["law"] for r in rows} == {"bytes"}
    for r in rows:
        b = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(b) + 16, zlib.crc32(b), None)
    check_shards(rows)


def check_shards(rows, shards=40):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert all(0 <= s < shards for s in by)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    of = {}
    for r in rows:
        of.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    return {s: sum(r["size"] for r in own) for s, own in by.items()}


def test_shards_with_a_hot_text(spark):
    rng = random.Random(3)
    rows = [(k, "hot " * 50, "en", "s0") for k in range(3000)] + [(3000 + k, f"{k} " + "y" * rng.randint(10, 300), rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None])) for k in range(6000)]
    rows += [(None, None, None, None), (9, "", "en", "s"), (9, "", "en", "s")]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("clash")), 10).collect()
    sizes = check_shards(out, 10)
    hot = max(sizes, key=sizes.get)
    rest = [v for s, v in sizes.items() if s != hot]
    assert len(sizes) == 10 and len(out) == len(rows)
    assert max(rest) <= 1.02 * min(rest)


def test_shards_of_few_rows(spark):
    df = spark.createDataFrame([(1, "a", "en", "s"), (2, "b", "en", "s")], "doc_id long, text string, lang string, source string")
    assert len(sharding.assign(df).collect()) == 2
    empty = sharding.assign(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
