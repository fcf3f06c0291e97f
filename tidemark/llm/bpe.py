"""BPE encoding and decoding with forced boundaries.

A merge always makes a vocabulary token, so two bytes that stand side by side
inside no token are never merged: between them a cut is certain. Cut there, the
fragments encode independently and their ids concatenate to those of the whole
text. Of these pairs only those are used at which the pattern that splits text
before merging cannot look across either: a visible character before ASCII
white space, letter before letter, and letter or digit before another class.

Null and empty texts have no tokens and decode to the empty text. Bytes that are
no UTF-8 are read as U+FFFD. Each row is
encoded by itself; repeated rows give repeated results, an empty table none. Ids
are integers, or text that reads as such; other text is an error.
Columns besides the named ones are not read.

A worker holds one block of texts (``BLOCK`` bytes, or one text) and remembers short
fragments in ``CACHE_BYTES`` at most; text without any certain cut is one fragment,
which is encoded and forgotten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbytes import blocks_of, valid_utf8
from tidemark.llm.vocabulary import Vocabulary, load

#: Bytes of fragments, their ids and what Python adds to each, that a worker remembers; then it forgets all and goes on.
CACHE_BYTES = 48_000_000
#: Bytes of the longest fragment that is remembered, and of what a dictionary and two objects take besides their content.
LONGEST, OBJECT_BYTES = 64, 200
BLOCK = 1_000_000

_SPACE, _LETTER, _DIGIT, _OTHER, _FAR = range(5)


def _byte_classes() -> np.ndarray:
    kind = np.full(256, _OTHER)
    kind[:33] = kind[127] = _FAR  # controls: white space in one engine's eyes, not in another's
    kind[[0x20, 0x09, 0x0A, 0x0D]] = _SPACE
    kind[0x30:0x3A] = _DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = _LETTER
    kind[0x80:] = _FAR
    return kind


@lru_cache(maxsize=4)
def cut_tables(path: str) -> tuple[np.ndarray, np.ndarray]:
    """For each byte pair (first * 256 + second): a cut is certain; it is if the first byte ends a two-byte letter above U+00BF."""
    vocabulary = load(path)
    inside = np.zeros(65536, bool)
    for token in [*vocabulary.token_bytes, *vocabulary.added]:
        b = np.frombuffer(token, np.uint8).astype(np.int64)
        inside[b[:-1] * 256 + b[1:]] = True
    kind = _byte_classes()
    first, second = np.repeat(kind, 256), np.tile(kind, 256)
    visible = (first == _LETTER) | (first == _DIGIT) | (first == _OTHER)
    safe = visible & (second == _SPACE) | (first == _LETTER) & (second == _LETTER) | (first == _LETTER) & ((second == _OTHER) | (second == _DIGIT)) | (first == _DIGIT) & ((second == _OTHER) | (second == _LETTER))
    continuation = (np.repeat(np.arange(256), 256) & 0xC0) == 0x80
    return ~inside & safe, ~inside & continuation & (second == _SPACE)


def fragment_bounds(data: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """Where fragments begin, rows included; ends with the length of ``data``."""
    sure, after_two = cut_tables(path)
    code = data[:-1].astype(np.int64) * 256 + data[1:]
    cut = sure[code]
    if len(data) > 2:
        lead = data[:-2]
        cut[1:] |= after_two[code[1:]] & (lead >= 0xC3) & (lead <= 0xDF)
    at = np.zeros(len(data) + 1, bool)
    at[1:-1] = cut
    at[offsets] = True
    return np.flatnonzero(at)


class Encoder:
    """Texts to packed little-endian ids, by fragments that are remembered."""

    def __init__(self, path: str):
        self.path, self.vocabulary = path, load(path)
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        if not len(data):
            return [b""] * (len(offsets) - 1)
        data, offsets, raw = valid_utf8(data, offsets)
        at = fragment_bounds(data, offsets, self.path)
        cuts = at.tolist()
        parts = [raw[s:e] for s, e in zip(cuts, cuts[1:])]
        known = self.known
        new = [p for p in dict.fromkeys(parts) if p not in known]
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            for p, e in zip(some, self.vocabulary.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)):
                known[p] = np.array(e.ids, "<u4").tobytes()
        packed = list(map(known.__getitem__, parts))
        for p in new:
            if len(p) > LONGEST:
                del known[p]
            else:
                self.held += len(p) + len(known[p]) + OBJECT_BYTES
        if self.held > CACHE_BYTES:
            known.clear()
            self.held = 0
        rows = np.searchsorted(at, offsets).tolist()
        return [b"".join(packed[s:e]) for s, e in zip(rows, rows[1:])]


def decode_text(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    return vocabulary.decode(ids).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str, text: str = "text", id_column: str = "doc_id", with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, digests of the ids and of the text decoded from them; the ids and that text on demand."""
    extra = [("ids", pa.list_(pa.int32()), "array<int>")] * with_ids + [("decoded", pa.string(), "string")] * with_text
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *((n, t) for n, t, _ in extra)])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for block, data, offsets in blocks_of(batches, limit=BLOCK):
            packed = encoder.encode_rows(data, offsets)
            ids = [np.frombuffer(p, "<u4") for p in packed]
            decoded = [decode_text(encoder.vocabulary, x) for x in ids]
            columns = [block.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string())]
            if with_ids:
                flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
                columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32), flat))
            if with_text:
                columns.append(pa.array(decoded, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {n} {k}" for n, _, k in extra))
