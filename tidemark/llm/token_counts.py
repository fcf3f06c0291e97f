"""Token counts of whole texts, huge ones by overlapping chunks.

A text over ``chunk_bytes`` is encoded as chunks that overlap. In an overlap a
place is a proven stable boundary if a visible ASCII character stands before it
and ASCII white space after it (no pattern match, merge or special token
spans such a place, whatever stands around), and if the token ends of both
chunks, summed from the tokens' bytes, agree on it. The tokens before it come
from the left chunk and those after it from the right one, so the count is that
of the whole text. Without such a place the overlap is doubled, up to the
chunk; a chunk that still has none is joined to the next and encoded anew.

Null and empty texts have no tokens. Bytes that are no UTF-8 are read as U+FFFD;
``n_bytes`` counts the bytes as they are. Each row is counted by itself; an empty
table gives no rows; columns besides the named ones are not read. Ids are integers,
or text that reads as such; other text is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbytes import blocks_of, valid_utf8
from tidemark.llm.vocabulary import Vocabulary, load

CHUNK_BYTES = 32_768
OVERLAP_BYTES = 256
BLOCK = 500_000

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0D]] = True


def _character_start(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _ends(vocabulary: Vocabulary, part: bytes) -> np.ndarray:
    ids = vocabulary.tokenizer.encode_batch_fast([part.decode()], add_special_tokens=False)[0].ids
    return np.cumsum(vocabulary.lengths[ids])


def count_spliced(vocabulary: Vocabulary, data: bytes, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> int:
    """Tokens of a text of any length, holding the tokens of two chunks at a time."""
    size = len(data)
    start, stop = 0, _character_start(data, min(size, chunk))
    left, total = _ends(vocabulary, data[start:stop]), 0
    while stop < size:
        width, spliced = overlap, False
        while True:
            begin = max(start, _character_start(data, stop - width))
            end = _character_start(data, min(size, begin + max(chunk, 2 * width)))
            right = _ends(vocabulary, data[begin:end])
            common = np.intersect1d(left + start, right + begin)
            common = common[(common > begin) & (common < stop)]
            shared = np.frombuffer(data, np.uint8)
            common = common[_VISIBLE[shared[common - 1]] & _WHITE[shared[common]]]
            if len(common):
                cut = int(common[-1])
                total += int(np.searchsorted(left, cut - start, side="right"))
                start, stop, left, spliced = cut, end, right[right + begin > cut] + begin - cut, True
                break
            if begin <= start or width >= chunk:
                break
            width *= 2
        if not spliced:
            stop = _character_start(data, min(size, stop + max(chunk, stop - start)))
            left = _ends(vocabulary, data[start:stop])
    return total + len(left)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", id_column: str = "doc_id", chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for block, data, offsets in blocks_of(batches, limit=BLOCK):
            stored = np.diff(offsets)
            _, offsets, raw = valid_utf8(data, offsets)
            at, sizes = offsets.tolist(), np.diff(offsets)
            small = np.flatnonzero(sizes <= chunk)
            counts = np.zeros(len(sizes), np.int64)
            encoded = vocabulary.tokenizer.encode_batch_fast([raw[at[k] : at[k + 1]].decode() for k in small.tolist()], add_special_tokens=False)
            counts[small] = [len(e) for e in encoded]
            for k in np.flatnonzero(sizes > chunk).tolist():
                counts[k] = count_spliced(vocabulary, raw[at[k] : at[k + 1]], chunk, overlap)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(stored, pa.int64()), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(kernel, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
