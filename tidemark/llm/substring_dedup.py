"""Substring deduplication by content-defined chunks.

A gear hash (h = 2h + gear[byte], 16 bits, so it sees the last 16 bytes) rolls
over the lower-cased words of a text, joined by single spaces, so copies that are
wrapped or spaced otherwise have the same chunks; cuts are made at the bytes of the
text as it is. A white-space byte ends a chunk if its hash is the
least of those of the ``reach`` word ends before and after it: the choice
depends on nearby text alone, so an insertion shifts no later boundary. Equal
least hashes all end chunks, so a word that is repeated over and over is cut
too, and equal neighbours are then one chunk; other chunks have more than
``reach`` words. What is joined by digest is a unit: two neighbouring chunks, so that a
run of units stands as it is in earlier text, or one chunk that alone has ``min_words``.
A unit repeats if a document with a smaller id holds its digest; a run of overlapping
repeating units of at least ``min_words`` words is a repeated span. The
first holder keeps its text, and repeats inside one document alone stay.

Null and empty texts have no chunks. Rows that repeat a doc_id are one document
and don't repeat each other; a null doc_id comes after all others. Rows are told apart
by id and a 64-bit hash of the text, so a row without an id is cut where its own text
repeats, and equal rows alike. Ids are integers, or text that reads as such; other text
is an error. An empty table gives no rows. ``remove_repeats`` keeps all rows and columns,
and bytes that are no UTF-8 as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import settle, written
from tidemark.llm.textbytes import blocks_of, mix64, string_column, word_bounds

#: Cuts, a few dozen bytes each, that the join with the texts may broadcast.
BROADCAST_CUTS = 200_000
REACH = 3
#: Bytes that a 16-bit gear hash sees.
WINDOW = 16
MIN_WORDS = 20

_GEAR = np.random.default_rng(1607).integers(0, 1 << 16, 256, dtype=np.uint16)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def squeeze(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's lower-cased words joined by single spaces, the new row offsets, and the place in ``data`` of every byte kept; a space is the first of its run."""
    low, starts, ends, rows = word_bounds(data, offsets, ~_WHITE)
    white = _WHITE[low]
    keep = ~white
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    keep[ends[:-1][row[1:] == row[:-1]]] = True
    place = np.flatnonzero(keep)
    return np.where(white, np.uint8(0x20), low)[place], np.concatenate([[0], np.cumsum(keep)])[offsets], place


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte, its 16 terms summed by doubling."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        shifted = h[:-step] << np.uint16(step)
        h = h.copy()
        h[step:] += shifted
    return h


def chunk_bounds(low: np.ndarray, offsets: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words, row) of the chunks of all rows, white space with the chunk that it ends."""
    n = len(low)
    white = _WHITE[low]
    last = np.zeros(n, bool)
    last[1:] = white[1:] & ~white[:-1]  # the first white-space byte after a word
    heads = offsets[:-1][np.diff(offsets) > 0]
    last[heads] = False
    at = np.flatnonzero(last)
    row = np.searchsorted(offsets, at, side="right") - 1
    # word ends whose hash would see bytes of the row before take no part
    own = at - offsets[row] >= WINDOW
    at, row = at[own], row[own]
    # the same in every copy of the text
    hashes = gear_hashes(low)[at - 1].astype(np.int64) if n else np.zeros(0, np.int64)
    least = np.ones(len(at), bool)
    for k in range(1, reach + 1):
        if len(at) > k:
            same = row[k:] == row[:-k]
            least[k:] &= ~same | (hashes[k:] <= hashes[:-k])
            least[:-k] &= ~same | (hashes[:-k] <= hashes[k:])
    # a row's first and last word ends have no full neighbourhood
    order = np.arange(len(at)) - np.searchsorted(row, row)
    left = np.searchsorted(row, row, side="right") - np.searchsorted(row, row) - 1 - order
    least &= (order >= reach) & (left >= reach)
    cut = np.zeros(n + 1, bool)
    cut[at[least] + 1] = True
    cut[offsets] = True
    points = np.flatnonzero(cut)
    starts, ends = points[:-1], points[1:]
    begins = ~white
    begins[1:] &= white[:-1]
    begins[heads] = ~white[heads]
    words = np.concatenate([[0], np.cumsum(begins)])
    return starts, ends, words[ends] - words[starts], np.searchsorted(offsets, starts, side="right") - 1


def merge_equal(starts: np.ndarray, ends: np.ndarray, words: np.ndarray, row: np.ndarray, digests: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Neighbouring chunks of one digest, as of a word repeated over and over, become one; if it has ``min_words`` words, with a digest that only such ones have."""
    head = np.ones(len(starts), bool)
    head[1:] = (digests[1:] != digests[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(head)
    if len(at) == len(starts):
        return starts, ends, words, row, digests
    last = np.append(at[1:], len(starts)) - 1
    total = np.add.reduceat(words, at)
    long_ = (last > at) & (total >= min_words)
    return starts[at], ends[last], total, row[at], np.where(long_, mix64(digests[at].view(np.uint64)).view(np.int64), digests[at])


def chunk_table(block: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, reach: int, min_words: int) -> tuple[np.ndarray, ...]:
    """(row, first, last, words, digest) of a block's chunks; first and last are bytes of the text."""
    digest = xxhash.xxh3_64_intdigest
    low, squeezed, place = squeeze(data, offsets)
    starts, ends, words, row = chunk_bounds(low, squeezed, reach)
    raw = low.tobytes()
    # without the space that ends it, as a text's last chunk has none
    digests = np.array([digest(raw[s:e].rstrip(b" ")) for s, e in zip(starts.tolist(), ends.tolist())], np.uint64).view(np.int64)
    starts, ends, words, row, digests = merge_equal(starts, ends, words, row, digests, min_words)
    # back to bytes of the text: a cut is after the first white-space byte, a row's outer white space is with its outer chunks
    head, tail = starts == squeezed[row], ends == squeezed[row + 1]
    starts, ends = np.where(head, offsets[row], place[starts - 1] + 1), np.where(tail, offsets[row + 1], place[ends - 1] + 1)
    return row, starts - offsets[row], ends - offsets[row], words, digests


def _two(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two numbers of 31 bits as one."""
    return (high.astype(np.int64) << 32) | low.astype(np.int64)


def units(docs: DataFrame, text: str = "text", id_column: str = "doc_id", reach: int = REACH, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, at, bytes, words, digest) of all units.

    ``at`` holds the unit's first and last chunk, ``bytes`` its first byte and the
    end, ``words`` the text's words before it and up to its end, two numbers in
    one long each.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in blocks_of(batches, limit=2_000_000):
            row, first, last, words, digests = chunk_table(block, data, offsets, reach, min_words)
            head = np.searchsorted(row, row)
            number = np.arange(len(row)) - head
            total = np.concatenate([[0], np.cumsum(words)])
            before, through = total[:-1] - total[head], total[1:] - total[head]
            d = digests.view(np.uint64)
            pair = np.flatnonzero(row[1:] == row[:-1])
            alone = np.flatnonzero(words >= min_words)
            a, b = np.concatenate([pair, alone]), np.concatenate([pair + 1, alone])
            key = np.concatenate([mix64(mix64(d[pair]) * np.uint64(3) + d[pair + 1]), mix64(d[alone] + np.uint64(1))]).view(np.int64)
            own = pa.array(row[a])
            yield pa.RecordBatch.from_arrays([block.column(0).take(own), block.column(2).take(own), *map(pa.array, (_two(number[a], number[b]), _two(first[a], last[b]), _two(before[a], through[b]), key))], ["doc_id", "text_key", "at", "bytes", "words", "digest"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key")).mapInArrow(kernel, "doc_id long, text_key long, at long, bytes long, words long, digest long")


def runs_of(found: list[dict], min_words: int) -> list[dict]:
    """The repeated spans of one text from its repeating units."""
    out, reached = [], -1
    for u in sorted(found, key=lambda u: u["at"]):
        i, j = u["at"] >> 32, u["at"] & 0xFFFFFFFF
        span = {"first_byte": u["bytes"] >> 32, "end_byte": u["bytes"] & 0xFFFFFFFF, "from": u["words"] >> 32, "to": u["words"] & 0xFFFFFFFF, "i": i, "j": j, "kept": {u["kept"]}}
        if out and i <= reached:
            last = out[-1]
            last["kept"] |= span["kept"]
            if j > last["j"]:
                last["end_byte"], last["to"], last["j"] = span["end_byte"], span["to"], j
        else:
            out.append(span)
        reached = out[-1]["j"]
    return [{"first_byte": s["first_byte"], "end_byte": s["end_byte"], "n_words": s["to"] - s["from"], "n_chunks": s["j"] - s["i"] + 1, "kept_doc_ids": sorted(s["kept"])} for s in out if s["to"] - s["from"] >= min_words]


_SPAN = "array<struct<first_byte:int,end_byte:int,n_words:int,n_chunks:int,kept_doc_ids:array<long>>>"


def spans_by_text(docs: DataFrame, text: str = "text", id_column: str = "doc_id", reach: int = REACH, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, spans): one row for each text that holds repeated spans."""
    pieces = written(units(docs, text, id_column, reach, min_words), "chunks")
    # settled, so that the join below deals both sides anew and may split the rows of a hot digest
    shared = pieces.groupBy("digest").agg(F.min("doc_id").alias("kept"), F.max("doc_id").alias("top"), F.bool_or(F.col("doc_id").isNull()).alias("bare")).filter("kept < top or (bare and kept is not null)").select("digest", "kept")
    repeats = pieces.join(settle(shared), "digest").filter("doc_id is null or doc_id > kept")
    # equal rows are one as early as in the task that reads them; what a text gathers is its own units
    gathered = repeats.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "bytes", "words", "kept")).alias("units"))
    kind = pa.list_(pa.struct([*((n, pa.int32()) for n in ("first_byte", "end_byte", "n_words", "n_chunks")), ("kept_doc_ids", pa.list_(pa.int64()))]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                spans = pa.array([runs_of(u, min_words) for u in some.column(2).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), spans], ["doc_id", "text_key", "spans"])

    return gathered.mapInArrow(kernel, f"doc_id long, text_key long, spans {_SPAN}").filter(F.size("spans") > 0)


def repeated_spans(docs: DataFrame, text: str = "text", id_column: str = "doc_id", reach: int = REACH, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, first_byte, end_byte, n_words, n_chunks, kept_doc_ids) of each repeated span.

    kept_doc_ids: the distinct first holders of its units, sorted; at most as
    many as the span has units.
    """
    return spans_by_text(docs, text, id_column, reach, min_words).select("doc_id", "text_key", F.explode("spans").alias("s")).select("doc_id", "text_key", "s.*")


def remove_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id", chars: str | None = None, reach: int = REACH, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated spans cut from ``text``; ``chars``, if named, gets the new length in characters."""
    cuts = settle(spans_by_text(docs, text, id_column, reach, min_words).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.transform("spans", lambda s: F.struct(s["first_byte"].alias("first_byte"), s["end_byte"].alias("end_byte"))).alias("__cuts")))
    few = (cuts.agg(F.sum(F.size("__cuts") + 1)).first()[0] or 0) <= BROADCAST_CUTS
    same = F.col(id_column).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__key"))
    joined = docs.join(F.broadcast(cuts) if few else cuts, same, "left")
    names = docs.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in blocks_of(batches, text=text, limit=2_000_000):
            found = block.column(block.schema.get_field_index("__cuts")).to_pylist()
            if not any(found):
                yield block.select(names)
                continue
            column = block.schema.get_field_index(text)
            raw, at, missing = data.tobytes(), offsets.tolist(), block.column(column).is_null().to_pylist()
            texts: list[bytes | None] = []
            for k, cut in enumerate(found):
                source, place, parts = raw[at[k] : at[k + 1]], 0, []
                for c in cut or ():
                    parts.append(source[place : c["first_byte"]])
                    place = c["end_byte"]
                texts.append(None if missing[k] else b"".join([*parts, source[place:]]))
            out = block.set_column(column, block.schema.field(column), string_column(texts, block.schema.field(column).type))
            yield out.select(names)

    out = joined.select(*[F.col(f"`{n}`") for n in names], "__cuts").mapInArrow(kernel, docs.schema)
    return out.withColumn(chars, F.char_length(text).cast(docs.schema[chars].dataType)) if chars else out
