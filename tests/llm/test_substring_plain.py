"""Substring deduplication against a plain chunk join; rows without ids; recall by length."""

import random
import re

import pytest

from tests_llm_plain import AZ
from tidemark.llm import substring_dedup
from tidemark.llm.substring_dedup import _GEAR, MIN_WORDS, REACH, WINDOW

DOCS = "doc_id long, text string"
_WHITE = " \t\n\x0b\x0c\r"


def plain_chunks(text):
    """[(first byte, end byte, words, what it holds)] of a text, byte by byte."""
    data = (text or "").translate(AZ).encode()
    words = [(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", data)]
    joined = b" ".join(w for _, _, w in words)
    ends, at = [], 0
    for _, _, w in words[:-1]:
        at += len(w)
        h = sum(int(_GEAR[joined[at - 1 - age]]) << age for age in range(min(16, at))) & 0xFFFF
        ends.append((at, h))
        at += 1
    open_ = [k for k, (e, _) in enumerate(ends) if e >= WINDOW]
    cut = []
    for n, k in enumerate(open_):
        near = open_[max(0, n - REACH) : n + REACH + 1]
        if n >= REACH and len(open_) - 1 - n >= REACH and all(ends[k][1] <= ends[m][1] for m in near):
            cut.append(k)
    out, first = [], 0
    for k in [*cut, len(words) - 1] if words else []:
        begin = 0 if first == 0 else words[first - 1][1] + 1
        end = len(data) if k == len(words) - 1 else words[k][1] + 1
        out.append([begin, end, k + 1 - first, b" ".join(w for _, _, w in words[first : k + 1])])
        first = k + 1
    merged = []
    for c in out:
        if merged and merged[-1][4] == c[3]:
            merged[-1][1], merged[-1][2], merged[-1][5] = c[1], merged[-1][2] + c[2], merged[-1][5] + 1
        else:
            merged.append([*c, c[3], 1])
    return [(a, b, n, ("run" if m > 1 and n >= MIN_WORDS else "", held)) for a, b, n, held, _, m in merged]


def plain_spans(rows):
    """{(doc_id, text): [(first byte, end byte, words, chunks, first holders)]} by comparing all units."""
    order = lambda i: (i is None, i or 0)
    holders, own = {}, {}
    for doc, text in set(rows):
        c = plain_chunks(text)
        found = [((k, k + 1), (c[k][3], c[k + 1][3])) for k in range(len(c) - 1)] + [((k, k), (c[k][3],)) for k in range(len(c)) if c[k][2] >= MIN_WORDS]
        own[doc, text] = c, sorted(found)
        for _, key in found:
            holders[key] = min(holders.get(key, doc), doc, key=order)
    out = {}
    for (doc, text), (c, found) in own.items():
        spans = []
        for (i, j), key in found:
            first = holders[key]
            if first is None or doc is not None and first >= doc:
                continue
            if spans and i <= spans[-1][1]:
                spans[-1][1] = max(j, spans[-1][1])
                spans[-1][2].add(first)
            else:
                spans.append([i, j, {first}])
        kept = [(c[i][0], c[j][1], sum(x[2] for x in c[i : j + 1]), j + 1 - i, tuple(sorted(ids))) for i, j, ids in spans]
        kept = [s for s in kept if s[2] >= MIN_WORDS]
        if kept:
            out[doc, text] = kept
    return out


def found_spans(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    keys = {(r["doc_id"], r["k"]): r["text"] for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS k").collect()}
    out = {}
    for r in substring_dedup.repeated_spans(df).collect():
        out.setdefault((r["doc_id"], keys[r["doc_id"], r["text_key"]]), []).append((r["first_byte"], r["end_byte"], r["n_words"], r["n_chunks"], tuple(r["kept_doc_ids"])))
    return {k: sorted(v) for k, v in out.items()}


def passage(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_spans_of_real_documents_against_the_plain_join(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found_spans(spark, rows) == plain_spans(rows)


def test_spans_of_planted_rows_against_the_plain_join(spark):
    rng = random.Random(21)
    shared = [passage(rng, rng.randint(15, 90)) for _ in range(25)] + ["the " * 50, "Ünï cödé " * 20]
    rows = []
    for k in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(shared) if rng.random() < 0.5 else passage(rng, rng.randint(0, 60))
            if rng.random() < 0.3:
                p = re.sub(" ", lambda _: rng.choice([" ", "  ", "\n", "\t", "\r\n"]), p.upper() if rng.random() < 0.5 else p)
            parts.append(p)
        rows.append((rng.choice([None, k, k % 20]), " ".join(parts)))
    rows += [(None, None), (3, ""), (3, None), (4, " \n"), (None, ""), *rows[:10]]
    assert found_spans(spark, rows) == plain_spans(rows)


def test_chained_chunks_of_different_documents_are_no_span(spark):
    """Chunks of three documents side by side repeat no passage."""
    rng = random.Random(31)
    whole = [passage(rng, 200) for _ in range(3)]
    bits = []
    for t in whole:
        c = plain_chunks(t)
        a, b, n, _ = next(x for x in c[3:] if 7 <= x[2] < MIN_WORDS)
        bits.append(t.encode()[a:b].decode().strip())
    rows = [*enumerate(whole), (9, " ".join([passage(rng, 30), *bits, passage(rng, 30)]))]
    assert found_spans(spark, rows) == plain_spans(rows) == {}


def test_many_rows_without_ids(spark):
    """Texts without ids that share a passage with one that has one: each is cut by itself, in time linear in the rows."""
    rng = random.Random(41)
    p = passage(rng, 60)
    rows = [(1, p)] + [(None, f"{passage(rng, 20)} {p} {k}") for k in range(20_000)] + [(None, "same text " * 3 + p)] * 3000
    df = spark.createDataFrame(rows, DOCS).repartition(8)
    out = substring_dedup.remove_repeats(df).collect()
    assert len(out) == len(rows) and all(p not in r["text"] for r in out if r["doc_id"] is None)


def test_bytes_that_are_no_utf8_stay(spark):
    rng = random.Random(51)
    p = passage(rng, 80).encode()
    df = spark.createDataFrame([(1, bytearray(b"\xff " + p)), (2, bytearray(b"\xfe\xc3 x " + p + b" \xe2\x82"))], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) AS text")
    out = {r["doc_id"]: bytes(r["b"]) for r in substring_dedup.remove_repeats(df).selectExpr("doc_id", "cast(text as binary) AS b").collect()}
    assert out[1] == b"\xff " + p and out[2].startswith(b"\xfe\xc3 x ") and len(out[2]) < 200


@pytest.mark.parametrize("length, least", [(30, 0.3), (40, 0.93), (51, 1.0)])
def test_recall_by_passage_length(length, least):
    """Share of passages, whatever stands around them, that leave a span in the later text."""
    rng = random.Random(length)
    found = 0
    for _ in range(300):
        p = passage(rng, length)
        rows = [(k, " ".join([passage(rng, rng.randint(0, 40)), p, passage(rng, rng.randint(0, 40))])) for k in (1, 2)]
        found += any(d == 2 for d, _ in plain_spans(rows))
    assert found / 300 >= least, found / 300
