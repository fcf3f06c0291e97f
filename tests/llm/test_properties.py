"""Properties over generated inputs, without a session."""

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tests_llm_plain import plain_fingerprint, words_of
from tidemark.llm import bpe, decontaminate, simhash, substring_dedup, token_counts
from tidemark.llm.textbytes import LOWER, span_hashes, word_bounds
from tidemark.llm.vocabulary import load

PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY, ENCODER = load(PATH), bpe.Encoder(PATH)
TEXT = st.text(st.one_of(st.sampled_from("ab zq'.,\n\t é  　日1<|>"), st.characters(codec="utf-8")), max_size=80)


def ids_of(text):
    return VOCABULARY.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_fragments_concatenate_to_the_library_ids(text):
    b = text.encode()
    got = np.frombuffer(ENCODER.encode_rows(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0], "<u4")
    assert got.tolist() == ids_of(text)
    assert bpe.decode_text(VOCABULARY, got) == VOCABULARY.tokenizer.decode(got.tolist(), skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(8, 40), st.integers(1, 8))
def test_spliced_counts_are_those_of_whole_texts(text, chunk, overlap):
    assert token_counts.count_spliced(VOCABULARY, text.encode(), chunk, overlap) == len(ids_of(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_word_bounds_are_those_of_the_pattern(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    low, starts, ends, rows = word_bounds(np.frombuffer(b"".join(raw), np.uint8), offsets)
    words = [low[s:e].tobytes().decode() for s, e in zip(starts, ends)]
    assert [words[a:b] for a, b in zip(rows, rows[1:])] == [words_of(t) for t in texts]
    hashes = span_hashes(low, starts, ends)
    assert len(set(hashes.tolist())) == len(set(words))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4), st.sampled_from([3, 65_536]))
def test_fingerprints(texts, block):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    usual, simhash.BLOCK_SHINGLES = simhash.BLOCK_SHINGLES, block
    try:
        got = simhash.prints(np.frombuffer(b"".join(raw), np.uint8), offsets)
    finally:
        simhash.BLOCK_SHINGLES = usual
    assert [int(x) % 2**64 for x in got] == [plain_fingerprint(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.lists(st.integers(1, 4), min_size=1, max_size=4), st.integers(1, 9))
def test_backward_search_counts_and_locates(text, phrase, every):
    index = decontaminate.FMIndex(np.array(text), 4, every)
    lo, hi = index.search(np.array(phrase), np.array([0]), np.array([len(phrase)]))
    want = [k for k in range(len(text) - len(phrase) + 1) if text[k : k + len(phrase)] == phrase]
    assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(TEXT, st.lists(st.sampled_from("a of the tion retion inghe onthan ér".split()), max_size=150).map(" ".join)), min_size=1, max_size=4))
def test_chunks_tile_every_text(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    low = LOWER[np.frombuffer(b"".join(raw), np.uint8)] if offsets[-1] else np.zeros(0, np.uint8)
    starts, ends, _, row = substring_dedup.chunk_bounds(low, offsets)
    for k, b in enumerate(raw):
        own = [(s, e) for s, e, r in zip(starts, ends, row) if r == k]
        assert b"".join(low[s:e].tobytes() for s, e in own) == b.lower()
        # alone, a text has the same chunks as among others
        alone = substring_dedup.chunk_bounds(LOWER[np.frombuffer(b, np.uint8)] if b else np.zeros(0, np.uint8), np.array([0, len(b)]))
        assert [(s - offsets[k], e - offsets[k]) for s, e in own] == list(zip(alone[0], alone[1]))
