"""SimHash near-duplicates: pigeonhole blocks, verified by Hamming distance.

A fingerprint of 64 bits is cut into ``blocks`` blocks. Two fingerprints that
differ in at most d bits share blocks - d of them, so joining on every choice
of that many blocks meets every close pair. Copies share a fingerprint and are
one entry; a bucket gives only links that join two trees, so a group of m near
copies gives at most m - 1 links a bucket and never all its pairs.

Null and empty texts, and texts without a word, have fingerprint zero and link
like any other. Repeated rows are separate rows of one group. A row with a null
doc_id gets the component of its fingerprint and offers it no id; if none of
a fingerprint's rows has an id, its component is null and it links to no other.
An empty table gives no rows. Ids are integers, or text that reads as such; other
text is an error. Columns besides the two named are left out of the
fingerprints, and kept by ``keep_representatives``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.buckets import Forest, by_group, crowded, grouped, pair_blocks
from tidemark.llm.components import connected_components
from tidemark.llm.runtime import join_classes, join_side, settle
from tidemark.llm.textbytes import blocks_of, word_bounds

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4


#: Shingles that are hashed and counted at a time.
BLOCK_SHINGLES = 65_536

_VISIBLE = np.ones(256, bool)
_VISIBLE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def prints(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """Fingerprints of rows of text: each bit that is set in more than half of a row's shingle hashes.

    Words stand between ASCII white space, A-Z lower-cased; a row of fewer words
    than ``size`` is one shingle. Shingles are slices of the text with white space
    squeezed, hashed in blocks, so memory doesn't grow with the longest text.
    """
    low, starts, ends, rows = word_bounds(data, offsets, _VISIBLE)
    white = ~_VISIBLE[low]
    keep = ~white
    after = ends[ends < len(low)]
    keep[after] = True
    squeezed = np.where(white, np.uint8(0x20), low)[keep].tobytes()
    begin = np.cumsum(keep)[starts] - 1
    end = begin + ends - starts
    n_words = np.diff(rows)
    n = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
    edges = np.concatenate([[0], np.cumsum(n)])
    counts, digest = np.zeros((len(n), 64), np.int64), xxhash.xxh64_intdigest
    for a in range(0, int(edges[-1]), BLOCK_SHINGLES):
        b = min(a + BLOCK_SHINGLES, int(edges[-1]))
        row = np.searchsorted(edges, np.arange(a, b), side="right") - 1
        first = rows[row] + np.arange(a, b) - edges[row]
        last = first + np.minimum(size, n_words[row]) - 1
        hashes = np.array([digest(squeezed[s:e], seed) for s, e in zip(begin[first].tolist(), end[last].tolist())], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        counts[row[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<i8")[:, 0]


def fingerprints(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every row, as a signed long."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in blocks_of(batches, limit=1_000_000):
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(prints(data, offsets))], ["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(kernel, "doc_id long, fp long")


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__fp``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in blocks_of(batches, text=text, limit=1_000_000):
            yield block.append_column("__fp", pa.array(prints(data, offsets)))

    return docs.mapInArrow(kernel, T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())]))


def block_masks(blocks: int, max_bits: int = MAX_BITS) -> list[int]:
    """A mask for each choice of ``blocks - max_bits`` of the blocks."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(one, blocks - max_bits)]


def enough_blocks(distinct: int, max_bits: int = MAX_BITS) -> int:
    """Fewest blocks whose keys spread ``distinct`` fingerprints to about eight a bucket; any number is exact."""
    blocks = max_bits + 1
    while blocks < max_bits + 6 and 64 * (blocks - max_bits) / blocks < math.log2(max(distinct, 2)) - 3:
        blocks += 1
    return max(blocks, max_bits + 2)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def close_links(classes: DataFrame, blocks: int, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) between the representatives ``rep`` of distinct fingerprints ``fp``: for each bucket a spanning forest of its close pairs."""
    keys = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for k, m in enumerate(block_masks(blocks, max_bits))])
    entries = classes.select("fp", "rep", F.explode(keys).alias("bucket")).select(F.struct("bucket.t", "bucket.v").alias("bucket"), F.struct("fp", "rep").alias("member"))
    held = crowded(entries).select(F.col("bucket.t").alias("t"), F.col("bucket.v").alias("v"), "part", "part_a", "part_b", F.col("member.fp").alias("fp"), F.col("member.rep").alias("rep"))
    group = ["t", "v", "part_a", "part_b"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in grouped(batches, group):
            fp, rep = t.column("fp").to_numpy().view(np.uint64), t.column("rep").to_numpy()
            forest, kept = Forest(t.num_rows), []
            for i, j, _ in pair_blocks(at, t.num_rows, *(t.column(k).to_numpy() for k in ("part", "part_a", "part_b"))):
                near = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
                kept += forest.add(i[near], j[near])
            if kept:
                a, b = np.array(kept).T
                yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

    return by_group(held, group, kernel, "a long, b long")


def near_duplicate_components(docs: DataFrame, text: str = "text", id_column: str = "doc_id", max_bits: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; see the module's head."""
    prints = settle(fingerprints(docs, text, id_column))
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    known = classes.filter("rep is not null").select("fp", "rep")
    edges = close_links(known, blocks or enough_blocks(known.count(), max_bits), max_bits)
    component = connected_components(edges)
    names = classes.join(component, classes.rep == component.node, "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    return join_classes(prints, settle(names), ["fp"], "n").select("doc_id", "fp", "component_id")


def first_of_groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, n, first_id, first_fp) for every fingerprint that a row with an id has: its rows with one, and the least (doc_id, fp) of its group.

    Fingerprints are the nodes, so texts that share an id link no groups.
    """
    known = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("doc_id").alias("n")).filter("rep is not null"))
    component = connected_components(close_links(known.select("fp", F.col("fp").alias("rep")), enough_blocks(known.count(), max_bits), max_bits))
    linked = known.join(component, known.fp == component.node).groupBy("component").agg(F.min(F.struct("rep", "fp")).alias("first"))
    named = component.join(linked, "component").select("node", "first")
    first = F.coalesce("first", F.struct("rep", "fp"))
    return known.join(named, known.fp == named.node, "left").select("fp", "n", first["rep"].alias("first_id"), first["fp"].alias("first_fp"))


def keep_representatives(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row of each group: that with the least id and, of those, the least fingerprint.

    An id with several texts is decided text by text; rows that repeat an id and
    a fingerprint stay once. Rows without an id stay, once a fingerprint, where no
    row with an id has their fingerprint.
    """
    prints = settle(fingerprints(docs, text, id_column))
    known = prints.filter("doc_id is not null")
    judged = settle(join_classes(known, settle(first_of_groups(prints)), ["fp"], "n").select("doc_id", "fp", (F.struct("doc_id", "fp") == F.struct("first_id", "first_fp")).alias("stays")))
    per_id = settle(judged.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("stays").alias("stays")))
    apart = join_side(per_id.filter("n > 1 or not stays").select(F.col("doc_id").alias("__apart")))
    kept = docs.filter(F.col(id_column).isNotNull()).join(apart, F.col(id_column) == F.col("__apart"), "left_anti")
    again = join_side(per_id.filter("n > 1 and stays").select(F.col("doc_id").alias("__again")))
    if not again.isEmpty():
        twice = with_fingerprints(docs.join(again, F.col(id_column) == F.col("__again"), "left_semi"), text)
        stay = join_side(judged.filter("stays").select(F.col("doc_id").alias("__id"), F.col("fp").alias("__first")).distinct())
        twice = twice.join(stay, (F.col(id_column) == F.col("__id")) & (F.col("__fp") == F.col("__first")), "left_semi")
        kept = kept.unionByName(twice.dropDuplicates([id_column, "__fp"]).drop("__fp"))
    if prints.filter("doc_id is null").isEmpty():
        return kept
    bare = docs.filter(F.col(id_column).isNull())
    marked = with_fingerprints(bare, text).join(known.select(F.col("fp").alias("__fp")).distinct(), "__fp", "left_anti")
    return kept.unionByName(marked.dropDuplicates(["__fp"]).drop("__fp"))
