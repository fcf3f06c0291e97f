"""Text operators against plain versions, and their edge cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests_llm_plain import plain_components, plain_contamination, plain_fingerprint, words_of
from tidemark.llm import bpe, decontaminate, licenses, simhash, substring_dedup, token_counts
from tidemark.llm.vocabulary import load

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(k + start, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


ODD = [None, "", " \n\t", "a", "é", "日本 語", "x" * 5000, "the " * 3000, " 　a", "A!?\x00b", "😀 😀", "I'm they'll 'sup", "<|endoftext|> hi<|endoftext|>"]


def library():
    return load(PATH).tokenizer


def test_bpe_matches_the_library(spark, corpus):
    texts = [r["text"] for r in corpus.select("text").collect()] + ODD
    df = docs_of(spark, texts)
    t = library()
    for r in bpe.encode_documents(df, PATH, with_text=True).collect():
        want = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == want and r["n_tokens"] == len(want)
        assert r["decoded"] == t.decode(want, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_bytes_that_are_no_utf8(spark):
    raw = [b"good \xff\xfe bad", b"\xc3", b"\xa9 alone", b"x\xe2\x82 y", b"fine", None]
    df = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in enumerate(raw)], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) AS text").coalesce(1)
    t = library()
    want = [t.encode((b or b"").decode("utf-8", "replace"), add_special_tokens=False).ids for b in raw]
    assert {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in bpe.encode_documents(df, PATH, with_text=True).collect()} == {k: (x, t.decode(x, skip_special_tokens=False)) for k, x in enumerate(want)}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df, PATH).collect()} == {k: (len(raw[k] or b""), len(x)) for k, x in enumerate(want)}


def test_remembered_fragments_are_bounded_in_bytes():
    rng, encoder = random.Random(12), bpe.Encoder(PATH)
    most, sizes = 0, []
    for _ in range(30):
        # text without certain cuts: each document is one fragment
        texts = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(700)) for _ in range(300)] + ["word%d" % rng.randint(0, 10**6) for _ in range(3000)]
        parts = [x.encode() for x in texts]
        encoder.encode_rows(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
        most = max(most, max(map(len, encoder.known), default=0))
        sizes.append(encoder.held)
    assert most <= bpe.LONGEST and max(sizes) <= bpe.CACHE_BYTES
    assert sum(len(k) + len(v) for k, v in encoder.known.items()) <= encoder.held


def scramble(rng, pieces, most):
    return "".join(rng.choice(pieces) for _ in range(rng.randint(0, most)))


PIECES = [*"abcXYZ 019.,!?'\n\t\r\"-_<>|{}", "'s", "'ll", "<|endoftext|>", "é", "ß", " ", " ", "\u0085", "　", "日本", "😀", "\x1c", "\x00", "  ", "\n\n", "the", " qz", "zxq", "ñ ", "É ", "ÿ'", "  "]


def test_bpe_and_splicing_on_scrambled_text():
    rng, t, encoder, vocabulary = random.Random(8), library(), bpe.Encoder(PATH), load(PATH)
    for _ in range(1500):
        s = scramble(rng, PIECES, 60)
        b = s.encode()
        want = t.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode_rows(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0], "<u4").tolist() == want, repr(s)
        if len(b) > 12:
            assert token_counts.count_spliced(vocabulary, b, 12, 4) == len(want), repr(s)


def test_cuts_are_never_inside_a_token():
    inside, _ = bpe.cut_tables(PATH)
    for token in load(PATH).token_bytes:
        assert not any(inside[a * 256 + b] for a, b in zip(token, token[1:]))


def test_token_counts(spark, corpus):
    texts = [r["text"] for r in corpus.select("text").collect()] + ODD + ["z" * 100_000, "word, " * 30_000, " " * 70_000 + "x"]
    t = library()
    for r in token_counts.token_counts(docs_of(spark, texts), PATH, chunk=2000, overlap=64).collect():
        text = texts[r["doc_id"]] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 1024)


def test_simhash_against_all_pairs(spark, corpus):
    texts = [r["text"] for r in corpus.orderBy("doc_id").limit(150).collect()]
    base = " ".join(f"word{k}" for k in range(300))
    texts += [base] * 3 + [base + f" end{k}" for k in range(20)] + ODD
    found = {r["doc_id"]: r for r in simhash.near_duplicate_components(docs_of(spark, texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert all(found[k]["fp"] % 2**64 == f for k, f in enumerate(prints))
    want = plain_components(list(range(len(texts))), prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {k: r["component_id"] for k, r in found.items()} == want


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_pigeonhole_meets_every_close_pair(spark, blocks, monkeypatch):
    rng = random.Random(blocks)
    centre = rng.getrandbits(64)
    values = list({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    monkeypatch.setattr(simhash.crowded, "__defaults__", (16,))  # many parts a bucket
    rows = [(simhash._signed(v), k) for k, v in enumerate(values)]
    edges = simhash.close_links(spark.createDataFrame(rows, "fp long, rep long"), blocks)
    from tidemark.llm.components import connected_components

    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    want = plain_components(list(range(len(values))), values, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {k: got.get(k, k) for k in want} == want


def test_simhash_edges_of_input(spark):
    empty = docs_of(spark, [])
    assert simhash.near_duplicate_components(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, None), (4, "")], "doc_id long, text string")
    got = sorted((r["doc_id"] is not None and r["doc_id"], r["component_id"]) for r in simhash.near_duplicate_components(df).collect())
    assert got == [(False, 3), (3, 3), (3, 3), (4, 4), (9, 4)]
    kept = simhash.keep_representatives(df.withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit(1)))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4]
    bare = df.filter("doc_id is null").unionByName(spark.createDataFrame([(None, "quite another text of its own"), (None, "quite another text of its own"), (7, "a b c")], "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_representatives(bare).collect()) == [(0, "a b c d e f"), (0, "quite another text of its own"), (7, "a b c")]
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]


def test_decontamination(spark, corpus, sf_dir):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bench += [(900, "Two WORDS"), (901, None), (902, "!!"), (903, "dup dup dup " * 8), (904, bench[0][1]), (None, "null item here now")]
    texts = [r["text"] for r in corpus.select("text").collect()] + ODD
    texts += [bench[1][1], "x " * 500 + bench[1][1], "two words two words", "dup " * 40, f"{bench[0][1]} and {bench[2][1]}", "a null item here now b"]
    spark_bench = spark.createDataFrame(bench, "item_id long, text string")
    want = plain_contamination(texts, [("null" if n is None else n, t) for n, t in bench])
    for shard in (200_000, 6_000_000):
        got = {r["doc_id"]: r for r in decontaminate.scan(docs_of(spark, texts), spark_bench, shard_bytes=shard).collect()}
        assert [(got[k]["n_words"], got[k]["n_hit"], got[k]["n_items"], got[k]["items_sha256"], got[k]["contaminated"]) for k in range(len(texts))] == want
    for k, t in enumerate(texts):
        inside = sum(s["last_word"] - s["first_word"] + 1 for s in got[k]["spans"])
        assert inside == got[k]["n_hit"]
        for s in got[k]["spans"]:
            assert words_of(t.encode()[s["first_byte"] : s["end_byte"]].decode()) == words_of(t)[s["first_word"] : s["last_word"] + 1]


def test_decontamination_without_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(docs_of(spark, []), none).count() == 0
    r = decontaminate.scan(docs_of(spark, ["some text"]), none).first()
    assert (r["n_words"], r["n_hit"], r["contaminated"]) == (2, 0, False)


def test_decontamination_by_a_benchmark_of_many_sets(spark, corpus, sf_dir):
    rng = random.Random(13)
    bench = [(k, passage(rng, rng.randint(3, 400))) for k in range(150)] + [(k, passage(rng, 20)) for k in range(140, 160)]
    bench.append((500, passage(rng, 3000)))
    texts = [r["text"] for r in corpus.select("text").limit(30).collect()]
    for k, (_, t) in enumerate(bench):
        w = t.split(" ")
        a = rng.randint(0, max(0, len(w) - 40))
        texts.append(" ".join([passage(rng, rng.randint(0, 60)), *w[a : a + rng.randint(10, 60)], passage(rng, 9)]))
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = plain_contamination(texts, bench)
    whole = list(decontaminate.phrase_sets(items))
    cut = list(decontaminate.phrase_sets(items, set_bytes=5000, piece_windows=300))
    assert len(whole) == 1 and len(cut) > 20
    assert all(s.nbytes <= 16 * (len(s.low) + 6000) for s in [*whole, *cut])
    got = {r["doc_id"]: r for r in decontaminate.scan(docs_of(spark, texts).withColumn("spans", F.lit(1)).withColumn("items", F.lit("x")), items, set_bytes=5000).collect()}
    assert [(got[k]["n_words"], got[k]["n_hit"], got[k]["n_items"], got[k]["items_sha256"], got[k]["contaminated"]) for k in range(len(texts))] == want


def test_pieces_of_a_long_item_hold_all_windows():
    words = [f"w{k}" for k in range(1000)]
    parts = list(decontaminate._pieces(" ".join(words).encode(), 13, 100))
    assert len(parts) == 10 and {tuple(p.decode().split()[k : k + 13]) for p in parts for k in range(len(p.split()) - 12)} == {tuple(words[k : k + 13]) for k in range(988)}
    assert list(decontaminate._pieces(b"a few", 13, 100)) == [b"a few"] and list(decontaminate._pieces(b" !", 13, 5)) == [b""]


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 5, 500)
    index = decontaminate.FMIndex(text, 5, every=7)
    phrases = np.array([[1, 2, 0], [3, 3, 3], [4, 0, 0], [2, 1, 4], [5, 5, 5]])
    lengths = np.array([2, 3, 1, 3, 3])
    lo, hi = index.search(phrases.ravel(), np.arange(0, 15, 3), lengths)
    for p, n, a, b in zip(phrases, lengths, lo, hi):
        want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_licenses(spark, corpus, sf_dir):
    texts = ODD + ["Released under the MIT License.", "mit-license MIT LICENSE mit licenses", "the GNU General Public License, version 3 of the gnu general public license", "Licensed under the Apache License, Version 2.0 CC BY cc by 4.0", "apache  license apache", "Apache.License"]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    for k, t in enumerate(texts):
        w = words_of(t)
        starts = [s for p in licenses.BASE_PHRASES for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        labels = sorted({v for p, v in licenses.BASE_PHRASES.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()})
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(starts), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(labels) and set(labels) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    assert "apache-2.0" in got[len(ODD) + 3]["labels"].split(",") and "cc-by-4.0" not in got[len(ODD)]["labels"]
    assert licenses.scan(docs_of(spark, [])).count() == 0


def plain_licenses(text, templates, accept=licenses.ACCEPT):
    """Every phrase compared at every word."""
    w = words_of(text)
    places = {p: [s for s in range(len(w)) if w[s : s + len(p.split())] == p.split()] for p in licenses.phrases(templates)}
    base = [s for p in licenses.BASE_PHRASES for s in places[p]]
    names = {v for p, v in licenses.BASE_PHRASES.items() if places[p]}
    share = lambda t, s: sum(0 <= s - t.key_at + k < len(w) and w[s - t.key_at + k] == x for k, x in enumerate(t.words)) / len(t.words)
    best = [(max((share(t, s) for s in places[t.key]), default=0.0), t.label) for t in templates]
    return len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(names)), ",".join(sorted(names | {n for x, n in best if x >= accept})), max(best)[0]


def test_licenses_against_every_place_and_many_templates(spark, corpus):
    rng = random.Random(61)
    texts = [r["text"] for r in corpus.limit(60).collect()] + ODD
    for t in licenses.TEMPLATES:
        w = t.text.split()
        texts.append(" ".join([passage(rng, 5), *w, passage(rng, 3)]))
        texts.append(", ".join([x.upper() if rng.random() < 0.5 else x for x in w[rng.randint(0, 3) :]]))
        texts.append(" ".join([*w, *w[::-1], *w, t.key, t.key]))
    many = licenses.TEMPLATES + [licenses.Template(f"own-{k}", f"own {passage(rng, 2)} licence {k % 50}", "") for k in range(170)]
    many = [t if t.text else licenses.Template(t.label, t.key, f"under the {t.key} as published {passage(rng, 20)}") for t in many]
    texts += [f"{passage(rng, 9)} {t.text} {passage(rng, 3)}" for t in many[-40:]]
    df = docs_of(spark, texts).withColumn("labels", F.lit("clash")).withColumn("n_words", F.lit(1))
    for templates in (licenses.TEMPLATES, many):
        got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(df, templates=templates).collect()}
        want = {k: plain_licenses(t, templates) for k, t in enumerate(texts)}
        assert {k: v[:6] for k, v in got.items()} == {k: v[:6] for k, v in want.items()}
        assert all(abs(got[k][6] - want[k][6]) < 1e-12 for k in want)


def test_the_license_index_is_folded_to_constants(spark, corpus):
    plan = licenses.scan(corpus)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "Python" not in plan


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_repeated_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(5)
    texts = [passage(rng, rng.randint(5, 900)) for _ in range(120)]
    clean = set(range(80, 120))
    planted = {}
    for k in range(40):
        p = passage(rng, rng.randint(51, 90))
        for d in (k, k + 40):
            w = texts[d].split(" ")
            at = rng.randint(0, len(w))
            texts[d] = " ".join([*w[:at], p, *w[at:]])
        planted[k + 40] = (k, p)
    found = {}
    for r in substring_dedup.repeated_spans(docs_of(spark, texts)).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert set(found) == set(planted)
    for d, (first, p) in planted.items():
        covered = sum(r["n_words"] for r in found[d])
        assert covered >= 20 and all(list(r["kept_doc_ids"]) == [first] for r in found[d])
        for r in found[d]:
            assert texts[d].encode()[r["first_byte"] : r["end_byte"]].decode().strip() in p
    out = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs_of(spark, texts), chars="n_chars").collect()}
    assert len(out) == len(texts)
    for d, t in enumerate(texts):
        assert (out[d]["text"] == t) == (d not in planted)
        assert out[d]["n_chars"] == len(out[d]["text"])
        if d in planted:
            assert planted[d][1] not in out[d]["text"]
    assert clean.isdisjoint(found)


def test_insertions_shift_no_later_chunk(spark):
    rng = random.Random(6)
    base = passage(rng, 400)
    w = base.split(" ")
    other = " ".join([*w[:100], "something", "new", *w[100:]])
    rows = substring_dedup.units(docs_of(spark, [base, other])).collect()
    a, b = ({r["digest"] for r in rows if r["doc_id"] == d} for d in (0, 1))
    assert len(a - b) <= 6 and len(b - a) <= 6 and len(a) > 30


def test_substring_edges_of_input(spark):
    assert substring_dedup.repeated_spans(docs_of(spark, [])).count() == 0
    rng = random.Random(7)
    p = passage(rng, 200)
    df = spark.createDataFrame([(5, p, "x"), (5, p, "x"), (None, p, "y"), (7, None, "z"), (8, "", "z"), (9, p, "q"), (5, "other text", "w")], "doc_id long, text string, digest string")
    spans = substring_dedup.repeated_spans(df).collect()
    assert {r["doc_id"] for r in spans} == {None, 9} and all(list(r["kept_doc_ids"]) == [5] for r in spans)
    out = substring_dedup.remove_repeats(df)
    kept = [(r["doc_id"], len(r["text"] or "")) for r in out.collect()]
    assert out.columns == df.columns and kept.count((5, len(p))) == 2 and (5, 10) in kept
    assert all(n < len(p) / 4 for d, n in kept if d in (None, 9))


def test_repeated_words_shared_by_documents(spark):
    rng = random.Random(10)
    p = "the " * 60
    texts = [passage(rng, 100) + " " + p + passage(rng, 50), passage(rng, 80) + " " + p + passage(rng, 90)]
    assert {r["doc_id"] for r in substring_dedup.repeated_spans(docs_of(spark, texts)).collect()} == {1}


def test_repeats_inside_one_document_stay(spark):
    rng = random.Random(9)
    p = passage(rng, 100)
    assert substring_dedup.repeated_spans(docs_of(spark, [f"{p} {p} {p}", passage(rng, 300)])).count() == 0
