"""Copies with other white space, rows that share an id, and repeats pieced together."""

import random
import textwrap

import numpy as np

import corpus_pipeline
from test_text_operators import docs_of, passage
from tests_llm_plain import plain_fingerprint
from tidemark.llm import simhash, substring_dedup
from tidemark.llm.textbytes import LOWER


def test_repeats_with_other_white_space(spark):
    rng = random.Random(11)
    respace = [lambda p: "\n".join(textwrap.wrap(p, 72)), lambda p: "\r\n".join(textwrap.wrap(p, 60)), lambda p: p.replace(" ", "  "), lambda p: p.replace(" ", "\n"), lambda p: p.replace(" ", " \t\n")]
    passages = [passage(rng, n) for n in (60, 120, 200) for _ in respace]
    first = [f"{passage(rng, 40)} {p} {passage(rng, 40)}" for p in passages]
    again = [f"\n {passage(rng, 30)}\n{respace[k % len(respace)](p)}\n{passage(rng, 30)} \n" for k, p in enumerate(passages)]
    found = {}
    for r in substring_dedup.repeated_spans(docs_of(spark, first + again)).collect():
        found.setdefault(r["doc_id"] - len(first), []).append(r)
    assert set(found) == set(range(len(again)))
    for k, spans in found.items():
        assert all(list(r["kept_doc_ids"]) == [k] for r in spans)
        cut = [again[k].encode()[r["first_byte"] : r["end_byte"]].decode() for r in spans]
        assert [len(c.split()) for c in cut] == [r["n_words"] for r in spans]
        assert all(" ".join(c.split()) in passages[k] for c in cut)
        # to the chunk at either end
        assert sum(r["n_words"] for r in spans) >= len(passages[k].split()) - 40
    out = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs_of(spark, first + again)).collect()}
    assert all(out[k] == first[k] and passages[k] not in " ".join(out[len(first) + k].split()) for k in range(len(first)))


def test_squeezed_bytes_know_their_place():
    texts = [b"", b" \n ", b"a", b"  A b\r\n\tc  ", b"\xc3\xa9  x", b"y"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    low, squeezed, place = substring_dedup.squeeze(data, offsets)
    assert [low[a:b].tobytes() for a, b in zip(squeezed, squeezed[1:])] == [b" ".join(t.lower().split()) for t in texts]
    assert all(LOWER[data[k]] == c or c == 0x20 and bytes([data[k]]).isspace() for k, c in zip(place, low))


def test_contaminated_rows_go_alone(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = ["nothing of a test is here", "nor is it here", "a third clean text"]
    rows = [(None, item), (None, clean[0]), (None, clean[1]), (7, item), (7, clean[2]), (8, item)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.benchmark_stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == sorted([(0, clean[0]), (0, clean[1]), (7, clean[2])])


def test_ids_with_several_texts_are_judged_text_by_text(spark):
    rng = random.Random(12)
    a, b, c, d = (passage(rng, 200) for _ in range(4))
    near = next(x for x in (b + " " + passage(rng, 1) for _ in range(99)) if 0 < (plain_fingerprint(b) ^ plain_fingerprint(x)).bit_count() <= 4)
    rows = [(9, a), (9, b), (9, b), (5, b), (11, c), (11, d), (11, d), (20, d), (9, near), (30, a)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, other string")
    out = simhash.keep_representatives(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted([(9, a), (5, b), (11, c), (11, d)])
    # an id that two near texts share links no other group, and one of the two stays
    rows = [(9, a), (9, b), (5, near), (6, c), (6, c + " more")]
    out = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"][:50]) for r in out) == sorted([(9, a[:50]), (5, near[:50]), (6, c[:50])])
