"""The classifier against a plain scorer, bit by bit, whatever rows share a block; its bounded sample."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests_llm_plain import words_of
from tidemark.llm import toxicity
from tidemark.llm.textbytes import column_bytes, hash_words, mix64


def plain_buckets(word):
    out = [hash_words([word])[0]]
    for k in toxicity.PREFIXES:
        out.append(mix64(hash_words([word[:k]]) + np.uint64(k))[0])
    return [int(h % np.uint64(toxicity.BUCKETS - 1)) + 1 for h in out]


def plain_score(model, text):
    """One word after another, one filter after another."""
    place = [plain_buckets(w.encode()) for w in words_of(text)] + [[0, 0, 0]] * 3
    vectors = [[sum(float(model.embedding[b][d]) for b in own) for d in range(toxicity.DIMENSIONS)] for own in place]
    active = []
    for f, bias in zip(model.filters, model.bias):
        for e in range(toxicity.FILTERS):
            best = max(math.fsum(v * float(f[j][d][e]) for j in range(len(f)) for d, v in enumerate(vectors[s + j])) for s in range(len(place) - len(f) + 1))
            x = best + float(bias[e])
            x = max(x, toxicity.LEAK * x)
            active.append(round(max(-500, min(500, x)) * 65536) / 65536)
    raw = math.fsum(a * float(w) for a, w in zip(active, model.weight)) + model.offset
    z = model.scale * max(-15, min(15, raw)) + model.shift
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


@pytest.fixture(scope="module")
def fitted(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, toxicity.fit(docs, labels, epochs=2)


def test_scores_against_the_plain_scorer(spark, fitted):
    docs, _, model = fitted
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 3000][:60]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "!?"), (10**6 + 3, "word"), (10**6 + 4, "two words")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    for k, text in rows:
        assert abs(got[k] - plain_score(model, text)) < 1e-12


def test_scores_are_the_same_in_any_batch(fitted, monkeypatch):
    docs, _, model = fitted
    texts = [r["text"] for r in docs.collect()] + [None, "", "!!"]
    score = lambda some: model.scores(*toxicity.word_buckets(*column_bytes(pa.array(some, pa.string()))))
    alone = np.concatenate([score([t]) for t in texts])
    assert (score(texts) == alone).all()
    rng = random.Random(3)
    for size in (2, 7, 31):
        order = rng.sample(range(len(texts)), len(texts))
        for a in range(0, len(order), size):
            some = order[a : a + size]
            assert (score([texts[k] for k in some]) == alone[some]).all()
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 17)
    assert (score(texts) == alone).all()


def test_sample_is_bounded_and_defined(spark):
    docs = spark.createDataFrame([(k, "w " * (10 + k)) for k in range(60)] + [(60, "long " * 5000), (3, "another text"), (None, "no id")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(61)] + [(None, 1), (99, 1), (4, None), (4, 7)], "doc_id long, toxic int")
    whole = toxicity.labelled_sample(docs, labels, max_words=100_000)
    assert len(whole.y) == 61 and whole.rows[-1] == len(whole.words) and np.diff(whole.rows).max() == 5000
    few = toxicity.labelled_sample(docs, labels, max_words=800)
    assert np.diff(few.rows).max() <= 100 and all(np.diff(few.rows)[few.y == y].sum() <= 800 for y in (0, 1))
    again = toxicity.labelled_sample(docs.repartition(7), labels, max_words=800)
    assert (few.words == again.words).all() and (few.rows == again.rows).all()
    assert len(toxicity.labelled_sample(docs, labels, max_per_class=5).y) == 10
    assert len(toxicity.labelled_sample(docs.limit(0), labels).y) == 0
