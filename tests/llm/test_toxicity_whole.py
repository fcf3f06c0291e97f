"""The classifier learns from all labelled rows, whatever their number, length and partitions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.textbytes import column_bytes


def scores(model, texts):
    return model.scores(*toxicity.word_buckets(*column_bytes(pa.array(texts, pa.string()))))


def test_rows_beyond_a_sample_teach(spark):
    """A word that only stands in the documents that a sample of 2000 a label would leave out."""
    per_label = 2150
    places = {}
    for y in (0, 1):
        ids = spark.range(y, 2 * per_label, 2).orderBy(F.xxhash64("id"), "id").collect()
        places |= {r["id"]: k for k, r in enumerate(ids)}
    rows = [(k, f"w{k % 40} w{k % 7}" + ("" if k % 2 == 0 else " zork" if places[k] >= 2000 else " grumph")) for k in range(2 * per_label)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.range(2 * per_label).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    late, early, clean = scores(model, ["w3 w4 zork"])[0], scores(model, ["w3 w4 grumph"])[0], scores(model, ["w3 w4 w5"])[0]
    assert late >= 0.7 and early >= 0.7 and clean < 0.7


def test_a_long_text_teaches(spark):
    """Texts of over 375,000 words were left out."""
    long = "blarg " + "w1 w2 w3 " * 130_000
    rows = [(k, long) for k in range(8)] + [(k, f"w{k % 5} w{k % 3} w{k % 9}") for k in range(8, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(k, int(k < 8)) for k in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, epochs=8)
    assert not model.constant and scores(model, [long])[0] > 0.5 > scores(model, ["w4 w1 w7"])[0]


def dealt(spark, docs, labels):
    return toxicity._dealt(docs, labels, None, "doc_id", "text", "lang", "toxic")


@pytest.fixture
def some(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 90)
    docs = spark.createDataFrame([(k, f"n{k} w{k % 11} " + "grumph" * (k % 4 == 0)) for k in range(480)] + [(3, "second text"), (None, "no id")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(480)] + [(8, 0), (8, 1), (9, 7), (10, None), (5000, 1)], "doc_id long, toxic int")
    return docs, labels


def test_each_labelled_document_once_and_shards_whole(spark, some, monkeypatch):
    rows = dealt(spark, *some)
    assert rows.count() == 480 and rows.filter("y = 1").count() == 120
    placed = rows.select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    shards = {r["shard"] for r in placed}
    assert len(shards) > 2 and len(placed) == len(shards) == len({r["p"] for r in placed})
    assert 0.15 < rows.filter("held").count() / 480 < 0.35
    # a session that raises the partitions gets no more files, and shards that are whole
    raised = lambda self, n, *cols, f=type(some[0]).repartition: f(self, max(n, 23) if isinstance(n, int) else n, *cols)
    monkeypatch.setattr(type(some[0]), "repartition", raised)
    more = dealt(spark, *some)
    assert more.rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    placed = more.select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(placed) == len(shards)
    assert sorted(map(tuple, more.collect())) == sorted(map(tuple, rows.collect()))


def test_a_model_is_the_same_from_any_partitions(some):
    docs, labels = some
    one, two = toxicity.fit(docs, labels, epochs=2), toxicity.fit(docs.repartition(7), labels.repartition(3), epochs=2)
    assert (one.embedding == two.embedding).all() and (one.weight == two.weight).all() and one.thresholds == two.thresholds
    assert (one.scale, one.shift) == (two.scale, two.shift)


def test_buffers_and_blocks_do_not_show(monkeypatch):
    rng = np.random.default_rng(3)
    w = toxicity.Weights.beginning(50, 1)
    filters = toxicity._views(w.other)[0]
    sizes = [0, 1, 2, 40, 7, 0, 90]
    text, begins = toxicity.padded(rng.integers(0, 51, (sum(sizes), 3)).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)]))
    ends = np.append(begins[1:], len(text) - max(toxicity.WIDTHS))
    whole, at = toxicity._strongest(w.embedding, filters, text, begins, ends)
    vectors = w.embedding[text].sum(axis=1)
    for d, (a, b) in enumerate(zip(begins, ends)):
        for k, f in enumerate(filters):
            plain = np.array([sum(vectors[p + j] @ f[j] for j in range(len(f))) for p in range(a, b + 1 - len(f))])
            assert np.allclose(plain.max(axis=0), whole[d, k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS], atol=1e-5)
    monkeypatch.setattr(toxicity, "TRAIN_WORDS", 5)
    again, _ = toxicity._strongest(w.embedding, filters, text, begins, ends)
    assert np.allclose(again, whole, atol=1e-5)


def test_the_gradient_is_that_of_the_loss(monkeypatch):
    """A step of nearly no learned sums goes along the slope that differences of the loss give."""
    monkeypatch.setattr(toxicity, "RATE", 0.0)

    class Never:
        def random(self, shape, kind):
            return np.ones(shape, kind)

    rng = np.random.default_rng(4)
    w = toxicity.Weights.beginning(30, 2)
    texts = [rng.integers(1, 31, (n, 3)).astype(np.int32) for n in (4, 9, 1)]
    label, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 0.7, 1.3])

    def loss(other):
        filters, bias, last, offset = toxicity._views(other)
        text, begins = toxicity.padded(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
        pooled, _ = toxicity._strongest(w.embedding, filters, text, begins, np.append(begins[1:], len(text) - max(toxicity.WIDTHS)))
        z = toxicity._leaky(pooled + np.concatenate(bias)) @ last + offset
        return (weight * (np.log1p(np.exp(z)) - label * z)).sum() / len(texts) + 5e-6 * (last**2).sum()

    w.embedding *= 20
    before = w.other_sums.copy()
    toxicity._descend(w, texts, label, weight, Never())
    slope = np.sqrt(w.other_sums.astype(np.float64) - before)
    for k in rng.choice(len(w.other), 60, replace=False).tolist() + [len(w.other) - 1]:
        up, down = w.other.astype(np.float64), w.other.astype(np.float64)
        up[k], down[k] = up[k] + 1e-4, down[k] - 1e-4
        assert abs(abs(loss(up) - loss(down)) / 2e-4 - slope[k]) < 2e-3


def test_changes_are_weighted_by_what_a_shard_learned():
    rows = [(0, -1, s, np.array(c, np.float32).tobytes(), np.array(g, np.float32).tobytes()) for s, c, g in ((1, [1, 4, 0], [1, 0, 0]), (0, [3, 2, 0], [3, 5, 0]))]
    table = pa.table({n: pa.array(v) for n, v in zip(("seed", "piece", "shard", "change", "growth"), zip(*rows))})
    found = toxicity._averaged(table).to_pylist()[0]
    assert np.frombuffer(found["change"], np.float32).tolist() == [2.5, 2.0, 0.0]
    assert np.frombuffer(found["growth"], np.float32).tolist() == [2.5, 5.0, 0.0]
