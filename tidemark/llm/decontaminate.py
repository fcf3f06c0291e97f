"""Benchmark decontamination by an FM-index over each shard of training text.

A shard (a block of documents) becomes a sequence of word numbers, a suffix
array gives its Burrows-Wheeler transform, and a wavelet tree answers rank
queries on that. All test phrases are searched backward at once; the rows of
their ranges walk to the next sampled suffix, which gives the text positions.
Words that no phrase holds can be part of no occurrence: a run of other words
that is shorter than the shortest phrase is left out of the index, which
loses nothing.

The benchmark, the stated query set, is cut into sets of at most ``SET_BYTES`` of text,
a long item into overlapping pieces, so the object made of a set is bounded too
(``PhraseSet.nbytes``). The driver builds one set at a time, Spark keeps them on the
executors' disks, and a worker reads one at a time for each of its shards; a benchmark
of any size costs time in proportion, and no more memory than one set.

Null and empty texts have no words, are hit nowhere and are clean. Null
benchmark texts and those without words are no items. Items with one item_id
are one item with the phrases of all; a null item_id is the string "null".
Repeated documents are judged, and dropped, row by row. Tables without rows give no rows, or
clean documents. Document ids are integers, or text that reads as such; other text is
an error. Columns besides the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbytes import blocks_of, mix64, span_hashes, word_bounds

WINDOW = 13
SAMPLE_EVERY = 16
#: Bytes of documents in one index.
SHARD_BYTES = 6_000_000
#: Bytes of benchmark text that are searched as one set.
SET_BYTES = 4_000_000
#: Windows of one item that a set holds at most.
PIECE_WINDOWS = 100_000


class BitRank:
    """Rank over one bit vector."""

    def __init__(self, bits: np.ndarray):
        self.ones = np.zeros(len(bits) + 1, np.int32)
        np.cumsum(bits, out=self.ones[1:])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        return self.ones[i]


class WaveletTree:
    """Levels of bits from the highest down, each stably parted by its bit."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.depth = max(1, int(top).bit_length())
        self.levels: list[BitRank] = []
        self.zeros: list[int] = []
        rest = symbols
        for k in range(self.depth - 1, -1, -1):
            bit = ((rest >> k) & 1).astype(bool)
            self.levels.append(BitRank(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            rest = np.concatenate([rest[~bit], rest[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        start, end = np.zeros_like(i), i
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (symbol >> (self.depth - 1 - k)) & 1 == 1
            s1, e1 = level.rank1(start), level.rank1(end)
            start, end = np.where(one, zeros + s1, start - s1), np.where(one, zeros + e1, end - e1)
        return end - start

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for level, zeros in zip(self.levels, self.zeros):
            before = level.rank1(i)
            one = level.rank1(i + 1) > before
            symbol = symbol * 2 + one
            i = np.where(one, zeros + before, i - before)
        return symbol


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; a suffix that ends sorts before its extensions."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(ordered[1:] != ordered[:-1], out=new[1:])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2
        if step >= n:
            return order


class FMIndex:
    """Backward search and location over a sequence of small integers >= 1."""

    def __init__(self, text: np.ndarray, top: int, every: int = SAMPLE_EVERY):
        text = np.append(text, 0)  # the end, smaller than all
        order = suffix_array(text)
        self.size = len(text)
        self.bwt = WaveletTree(text[order - 1], top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))]).astype(np.int64)
        sampled = order % every == 0
        self.is_sampled = BitRank(sampled)
        self.samples = order[sampled]

    def search(self, words: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the phrases that stand in ``words`` from ``first`` on."""
        lo, hi = np.zeros(len(first), np.int64), np.full(len(first), self.size)
        for k in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > k) & (lo < hi))
            if not len(live):
                break
            symbol = words[first[live] + lengths[live] - 1 - k].astype(np.int64)
            base = self.before[symbol]
            lo[live], hi[live] = base + self.bwt.rank(symbol, lo[live]), base + self.bwt.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by walking to the next sampled suffix."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            before = self.is_sampled.rank1(at)
            there = self.is_sampled.rank1(at + 1) > before
            out[open_[there]] = self.samples[before[there]] + steps
            open_, at = open_[~there], at[~there]
            symbol = self.bwt.access(at)
            rows[open_] = self.before[symbol] + self.bwt.rank(symbol, at)
            steps += 1
        return out


@dataclass
class PhraseSet:
    """Distinct windows over the items' words, and the items of each; words are numbers from 2, as 1 parts runs of a shard."""

    vocabulary: np.ndarray  # sorted word hashes
    low: np.ndarray  # the items' bytes in lower case
    starts: np.ndarray  # of each word in ``low``
    ends: np.ndarray
    text: np.ndarray  # the number of each word
    first: np.ndarray  # a place of each window in ``text``
    lengths: np.ndarray
    owner_at: np.ndarray  # owners of window k are owners[owner_at[k] : owner_at[k + 1]]
    owners: np.ndarray
    names: list[str]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray)) + sum(len(n) + 64 for n in self.names)

    def words(self, k: int) -> list[bytes]:
        """The words of window k."""
        a = self.first[k]
        return [self.low[s:e].tobytes() for s, e in zip(self.starts[a : a + self.lengths[k]], self.ends[a : a + self.lengths[k]])]


def phrase_set(items: list[tuple[str, bytes]], window: int = WINDOW) -> PhraseSet:
    texts = [t for _, t in items]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    low, starts, ends, rows = word_bounds(data, offsets)
    hashes = span_hashes(low, starts, ends)
    vocabulary, number = np.unique(hashes, return_inverse=True)
    n_words = np.diff(rows)
    per = np.where(n_words > 0, np.maximum(n_words - window + 1, 1), 0)
    item = np.repeat(np.arange(len(items)), per)
    first = np.arange(len(item)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(rows[:-1], per)
    lengths = np.minimum(n_words, window)[item]
    # windows of the same words, by 128 bits of hash
    one, two = lengths.astype(np.uint64), lengths.astype(np.uint64)
    for k in range(window):
        inside = lengths > k
        word = hashes[first[inside] + k]
        one[inside], two[inside] = mix64(one[inside] * np.uint64(31) + word), mix64(two[inside] ^ (word * np.uint64(0x9E3779B97F4A7C15)))
    label: dict[str, int] = {}
    named = np.array([label.setdefault(n, len(label)) for n, _ in items], np.int32)
    owner = named[item]
    order = np.lexsort((owner, two, one))
    one, two, owner = one[order], two[order], owner[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    other = fresh.copy()
    other[1:] |= owner[1:] != owner[:-1]
    heads = order[fresh]
    return PhraseSet(vocabulary, low, starts.astype(np.int32), ends.astype(np.int32), (number + 2).astype(np.int32), first[heads].astype(np.int32), lengths[heads].astype(np.int32), np.append(np.flatnonzero(fresh[other]), other.sum()).astype(np.int32), owner[other], list(label))


def _pieces(text: bytes, window: int, most: int) -> Iterator[bytes]:
    """``text``, or overlapping parts of it that hold ``most`` windows each."""
    _, starts, ends, _ = word_bounds(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    for k in range(0, max(1, len(starts) - window + 1), most):
        last = min(len(starts), k + most + window - 1)
        yield text[starts[k] : ends[last - 1]] if last > k else b""


def phrase_sets(benchmark: DataFrame, id_column: str = "item_id", text: str = "text", window: int = WINDOW, set_bytes: int = SET_BYTES, piece_windows: int = PIECE_WINDOWS) -> Iterator[PhraseSet]:
    """The benchmark in sets of a checked size, one at a time."""
    rows = benchmark.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("name"), F.col(text).cast("binary").alias("text"))
    held, size = [], 0
    for r in rows.toLocalIterator():
        for part in _pieces(bytes(r["text"]), window, piece_windows):
            held.append((r["name"], part))
            size += len(part) + 64
            if size >= set_bytes:
                yield phrase_set(held, window)
                held, size = [], 0
    if held:
        yield phrase_set(held, window)


class SharedSets:
    """The sets as workers see them: one at a time in memory, the others on the executor's disk."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int, set_bytes: int):
        context = docs.sparkSession.sparkContext
        self.shared: list[Broadcast] = [context.broadcast(s) for s in phrase_sets(benchmark, window=window, set_bytes=set_bytes)]

    def __iter__(self) -> Iterator[PhraseSet]:
        for b in self.shared:
            yield b.value
            if len(self.shared) > 1:
                # what the worker holds of it goes; the next shard reads it anew
                vars(b).pop("_value", None)


def occurrences(known: np.ndarray, phrases: PhraseSet, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, position of its first word) of all occurrences in a shard.

    ``known`` holds a word number for each word, 0 for words of no phrase;
    ``rows`` the index of each document's first word.
    """
    part = known == 0
    fresh = ~part
    fresh[1:] &= part[:-1]
    heads = rows[:-1][rows[:-1] < len(known)]
    fresh[heads] = ~part[heads]
    starts = np.flatnonzero(fresh)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stops = part.copy()
    run = np.cumsum(fresh) - 1
    sizes = np.bincount(run[~stops], minlength=len(starts))
    long_ = sizes >= phrases.lengths.min()
    if not long_.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, sizes = starts[long_], sizes[long_]
    ends = np.cumsum(sizes + 1)
    shift = starts - (ends - sizes - 1)
    origin = np.arange(ends[-1]) + np.repeat(shift, sizes + 1)
    text = np.ones(ends[-1], np.int64)
    inner = np.ones(ends[-1], bool)
    inner[ends - 1] = False
    text[inner] = known[origin[inner]]
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    lo, hi = index.search(phrases.text, phrases.first, phrases.lengths)
    counts = hi - lo
    found = np.flatnonzero(counts)
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    phrase = np.repeat(found, counts[found])
    first = np.cumsum(counts[found]) - counts[found]
    places = index.locate(np.arange(len(phrase)) - np.repeat(first, counts[found]) + np.repeat(lo[found], counts[found]))
    return phrase, origin[places]


def hit_words(sets: Iterable[PhraseSet], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, set[str]]]:
    """Starts and ends of a block's words, index of each row's first, whether a phrase covers each word, and the items of rows that are hit."""
    low, starts, ends, rows = word_bounds(data, offsets)
    hashes = span_hashes(low, starts, ends)
    cover = np.zeros(len(starts) + 1, np.int32)
    items: dict[int, set[str]] = {}
    for s in sets:
        if not len(s.vocabulary) or not len(hashes):
            continue
        at = np.minimum(np.searchsorted(s.vocabulary, hashes), len(s.vocabulary) - 1)
        known = np.where(s.vocabulary[at] == hashes, at + 2, 0)
        phrase, first = occurrences(known, s, rows)
        owner = np.searchsorted(rows, first, side="right") - 1
        for p, f, d in zip(phrase.tolist(), first.tolist(), owner.tolist()):
            words = s.words(p)
            if all(low[starts[f + k] : ends[f + k]].tobytes() == w for k, w in enumerate(words)):
                cover[f] += 1
                cover[f + len(words)] -= 1
                items.setdefault(d, set()).update(s.names[k] for k in s.owners[s.owner_at[p] : s.owner_at[p + 1]])
    hit = np.cumsum(cover[:-1]) > 0
    return starts, ends, rows, hit, items


def hit_counts(rows: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and words hit of each row, and whether it is contaminated."""
    total = np.concatenate([[0], np.cumsum(hit)])
    n_words, n_hit = np.diff(rows), total[rows[1:]] - total[rows[:-1]]
    return n_words, n_hit, (n_hit > 0) & (20 * n_hit >= n_words)


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<first_word:int,last_word:int,first_byte:int,end_byte:int>>"


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_column: str = "doc_id", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, set_bytes: int = SET_BYTES) -> DataFrame:
    """Per row of ``docs``: words, words hit, items found, and merged spans of hit words with their UTF-8 bytes."""
    sets = SharedSets(docs, benchmark, window, set_bytes)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([(k, pa.int32()) for k in ("first_word", "last_word", "first_byte", "end_byte")])))])
        for block, data, offsets in blocks_of(batches, limit=shard_bytes):
            starts, ends, rows, hit, items = hit_words(sets, data, offsets)
            n_words, n_hit, contaminated = hit_counts(rows, hit)
            names = [sorted(items.get(d, ())) for d in range(len(n_words))]
            spans: list[list[dict]] = [[] for _ in names]
            for d in np.flatnonzero(n_hit).tolist():
                base = int(rows[d])
                change = np.flatnonzero(np.diff(np.concatenate([[False], hit[base : rows[d + 1]], [False]]).astype(np.int8)))
                spans[d] = [{"first_word": int(a), "last_word": int(b) - 1, "first_byte": int(starts[base + a] - offsets[d]), "end_byte": int(ends[base + b - 1] - offsets[d])} for a, b in change.reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                    pa.array(contaminated),
                    pa.array(names, pa.list_(pa.string())),
                    pa.array(spans, kinds.field("spans").type),
                ],
                schema=kinds,
            )

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(kernel, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, set_bytes: int = SET_BYTES) -> DataFrame:
    """The rows of ``docs`` that ``scan`` doesn't call contaminated, unchanged; ids play no part."""
    sets = SharedSets(docs, benchmark, window, set_bytes)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in blocks_of(batches, text=text, limit=shard_bytes):
            _, _, rows, hit, _ = hit_words(sets, data, offsets)
            yield block.filter(pa.array(~hit_counts(rows, hit)[2]))

    return docs.mapInArrow(kernel, docs.schema)
