"""Each stage of the pipeline against a plain version, on the input that the stage before left."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests_llm_plain import plain_components, plain_contamination, plain_fingerprint, words_of
from tidemark.llm import toxicity
from tidemark.llm.queries import fold
from tidemark.llm.textbytes import column_bytes
from tidemark.llm.vocabulary import load
from tidemark.llm.bpe import decode_text
import public_tokenizers


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """[(rows in, rows out)] of all stages, as dictionaries by doc_id."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append((before, {r["doc_id"]: r for r in docs.collect()}))
    return out


def test_toxicity(spark, sf_dir, stages):
    before, after = stages[0]
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, fold("id") != 1)
    for k, r in before.items():
        score = model.scores(*toxicity.word_buckets(*column_bytes(pa.array([r["text"]]))))[0]
        limit = model.thresholds.get(r["lang"], model.thresholds[""])
        assert (k in after) == (score < limit)
    assert all(after[k] == before[k] for k in after)


def test_near_duplicates(stages):
    before, after = stages[1]
    ids = sorted(before)
    prints = [plain_fingerprint(before[k]["text"]) for k in ids]
    component = plain_components(ids, prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert set(after) == set(component.values())
    assert all(after[k] == before[k] for k in after)


def test_repeats(stages):
    before, after = stages[2]
    assert set(after) == set(before)
    seen: dict[tuple, int] = {}
    for k in sorted(before):
        w = before[k]["text"].lower().split()
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), k)
    for k, r in before.items():
        w = r["text"].lower().split()
        repeats = any(seen[tuple(w[i : i + 50])] < k for i in range(len(w) - 49))
        assert not repeats or len(after[k]["text"]) < len(r["text"])
        assert after[k]["n_chars"] == len(after[k]["text"])
        if after[k]["text"] != r["text"]:
            # what is left is a subsequence of the words before
            rest = iter(r["text"].split())
            assert all(x in rest for x in after[k]["text"].split())
    # no passage of 50 words is left twice
    left: dict[tuple, int] = {}
    for k, r in after.items():
        w = r["text"].lower().split()
        for i in range(len(w) - 49):
            assert left.setdefault(tuple(w[i : i + 50]), k) == k


def test_benchmark(spark, sf_dir, stages):
    before, after = stages[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    ids = sorted(before)
    tainted = {k for k, r in zip(ids, plain_contamination([before[k]["text"] for k in ids], items)) if r[4]}
    assert set(after) == set(before) - tainted
    assert all(after[k] == before[k] for k in after)


def test_tokens(stages):
    before, after = stages[4]
    vocabulary = load(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(after) == set(before)
    for k, r in after.items():
        ids = vocabulary.tokenizer.encode(before[k]["text"], add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert decode_text(vocabulary, np.array(ids)) == before[k]["text"]


def test_folds_are_kept_apart(spark):
    rows = spark.range(1000).select(fold("id").alias("m"), "id").collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in rows)
    assert words_of("A-b") == ["a", "b"]
