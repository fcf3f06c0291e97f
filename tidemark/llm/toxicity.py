"""Toxicity: a convolutional text classifier in numpy.

A word's vector is the sum of learned embeddings of three hashes: the word's and
those of its first 4 and 6 bytes, so inflected forms share what their stem
taught. Filters of several widths slide over them, each filter keeps its greatest
response over the whole text, and a logistic layer weighs those. All labelled
rows that may be learned from teach, whole: three in four train, the fourth, by a hash
of its id, is held back. Rows are dealt by that hash into shards; in each round every
shard trains by Adagrad from the common weights, its rows streaming by, and the
changes are averaged, each weight's by what it learned in a shard. Scores are
then calibrated on all held-back rows, and each language gets the threshold with
the best F1 there. The driver gets weights and counts of scores by cell, no rows. Language,
source and id never enter a score.

A score is a function of the text alone, to the last bit: a trained model's weights
are multiples of 2**-16 and small enough that all its sums are exact in double
precision, so neither a block's rows nor their order matter.

Null and empty texts have a score: that of a text of padding. Labels that are
neither 0 nor 1, or of unknown documents, teach nothing; repeated labels of a document count
once, as the largest; of several texts under one id the one with the smallest
hash teaches. Without both classes among them the score is 0 and
nothing is rejected. A null language takes the threshold of all languages. Ids are
integers, or text that reads as such; other text is an error.
Columns besides the named ones are not read by ``score``; ``drop_toxic`` keeps
all rows it doesn't reject, with all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.runtime import BROADCAST_ROWS, settle
from tidemark.llm.textbytes import blocks_of, mix64, span_hashes, word_bounds

BUCKETS = 1 << 17
DIMENSIONS = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Documents and words of one label that ``labelled_sample`` takes at most; training has no such bounds.
MAX_PER_CLASS = 2000
MAX_WORDS = 3_000_000
#: Times that the shards' changes are averaged.
ROUNDS = 4
#: Passes over the training rows, by the rows up to which they hold; beyond those one a round.
EPOCHS = ((1000, 16), (4000, 8))
#: Rows of a shard, until there are MAX_SHARDS; each sends its changes, 7 MB at most, once a round.
SHARD_ROWS = 16_000
MAX_SHARDS = 32
#: Models trained from different beginnings; the one that fits the held-back rows best after the first round goes on.
RESTARTS = 3
THRESHOLD = 0.7
#: Labelled documents that a bucket must stand in to have an embedding of its own.
MIN_DOCUMENTS = 4
#: Fewest held-back rows of a language that may set a threshold of their own.
MIN_CALIBRATION = 60

#: Words whose responses are in memory at once.
BLOCK_WORDS = 16_384
#: Bytes of text that are scored at once; a longer text is a block of its own.
SCORE_BYTES = 500_000
PAD = 0
LEAK = 0.1
RATE, BATCH = 0.04, 32
#: Words of a shard that are in memory at once, with the text that goes beyond, and those whose responses are.
BUFFER_WORDS, TRAIN_WORDS = 1_000_000, 32_768
#: Embeddings of one piece of a model while shards are averaged.
PIECE = 8192
#: Cells of a unit of raw score by which held-back rows are counted.
CELLS = 1024
#: Bytes of the word beginnings that have embeddings of their own.
PREFIXES = (4, 6)
#: Steps of a unit, greatest size of a trained weight and of a pooled response. A word's three embeddings times a
#: filter's weight has 44 bits, and 36 of those add up within 53; a response times a weight 46, and 36 of those too.
STEPS, LARGEST, LOUDEST = 1 << 16, 31.0, 500.0


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, 3) buckets, from 1, and the index of each row's first word."""
    low, starts, ends, rows = word_bounds(data, offsets)
    hashes = [span_hashes(low, starts, ends), *(mix64(span_hashes(low, starts, np.minimum(ends, starts + k)) + np.uint64(k)) for k in PREFIXES)]
    return np.stack([(h % np.uint64(BUCKETS - 1)).astype(np.int32) + 1 for h in hashes], axis=1), rows


def padded(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows after one another, each followed by as much padding as the widest filter, so every filter has a window of its own row."""
    gap = max(WIDTHS)
    sizes = np.diff(rows)
    begins = np.concatenate([[0], np.cumsum(sizes + gap)])
    out = np.full((begins[-1] + gap, words.shape[1]), PAD, np.int32)
    out[np.arange(len(words)) + np.repeat(begins[:-1] - rows[:-1], sizes)] = words
    return out, begins[:-1]


def _leaky(x: np.ndarray) -> np.ndarray:
    """Keeps a filter that never fires trainable."""
    return np.maximum(x, x.dtype.type(LEAK) * x)


def _exact(x: np.ndarray, kind: type = np.float64, largest: float = LARGEST) -> np.ndarray:
    """Rounded to the steps that weights and responses have."""
    return (np.rint(np.clip(np.asarray(x, np.float64), -largest, largest) * STEPS) / STEPS).astype(kind)


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, dimensions, filters)
    bias: list[np.ndarray]
    weight: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: bool = False

    def vectors(self, text: np.ndarray) -> np.ndarray:
        out = self.embedding[text[:, 0]]
        for k in range(1, text.shape[1]):
            out += self.embedding[text[:, k]]
        return out

    def pooled(self, text: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Greatest response of each filter in each row, in blocks of positions, so that memory grows with neither rows nor the longest text."""
        n = len(text) - max(WIDTHS)
        out, ends = np.full((len(begins), len(self.filters) * FILTERS), -np.inf), np.append(begins[1:], n)
        stacked = np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)
        for p in range(0, n, BLOCK_WORDS):
            q = min(n, p + BLOCK_WORDS)
            products = self.vectors(text[p : q + max(WIDTHS)]).astype(np.float64) @ stacked
            rows = slice(int(np.searchsorted(begins, p, side="right")) - 1, int(np.searchsorted(begins, q)))
            at, first = np.maximum(begins[rows], p) - p, 0
            for k, f in enumerate(self.filters):
                response = products[: q - p, first : first + FILTERS].copy()
                for j in range(1, len(f)):
                    response += products[j : q - p + j, first + j * FILTERS : first + (j + 1) * FILTERS]
                    # the last paddings of a row begin windows that reach into the next one
                    over = ends[rows] - j
                    response[over[(over >= p) & (over < q)] - p] = -np.inf
                first += len(f) * FILTERS
                own = out[rows, k * FILTERS : (k + 1) * FILTERS]
                np.maximum(own, np.maximum.reduceat(response, at, axis=0), out=own)
        return out + np.concatenate(self.bias)

    def raw(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.clip(_exact(_leaky(self.pooled(*padded(words, rows))), largest=LOUDEST) @ self.weight + self.offset, -15, 15)

    def scores(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.zeros(len(rows) - 1)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(words, rows) + self.shift, -40, 40)))

    def frozen(self) -> Model:
        """The model for scoring, its weights rounded so that all sums are exact."""
        return Model(_exact(self.embedding, np.float32), [_exact(f) for f in self.filters], [_exact(b) for b in self.bias], _exact(self.weight), float(_exact(np.array(self.offset))))


@dataclass
class Weights:
    """A model while it is trained: embeddings of the ``PAD`` and the common buckets, and all else in one row; Adagrad's sums are by embedding and by weight."""

    embedding: np.ndarray
    other: np.ndarray
    embedding_sums: np.ndarray
    other_sums: np.ndarray

    @staticmethod
    def beginning(common: int, seed: int) -> Weights:
        rng = np.random.default_rng(seed)
        embedding = rng.normal(0, 0.02, (common + 1, DIMENSIONS)).astype(np.float32)
        filters = [rng.normal(0, 0.4, w * DIMENSIONS * FILTERS) for w in WIDTHS]
        width = len(WIDTHS) * FILTERS
        other = np.concatenate([*filters, np.zeros(width), rng.normal(0, 0.3, width), np.zeros(1)]).astype(np.float32)
        return Weights(embedding, other, np.full(len(embedding), 1e-3, np.float32), np.full_like(other, 1e-3))

    def copy(self) -> Weights:
        return Weights(self.embedding.copy(), self.other.copy(), self.embedding_sums.copy(), self.other_sums.copy())

    def model(self, common: np.ndarray) -> Model:
        """For scoring; all buckets that aren't ``common`` are padding."""
        filters, bias, weight, offset = _views(self.other)
        embedding = np.repeat(self.embedding[:1], BUCKETS, axis=0)
        embedding[common] = self.embedding[1:]
        return Model(embedding, filters, bias, weight, float(offset[0])).frozen()


def _views(other: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Filters, their bias, weight and offset as parts of the one row."""
    width = len(WIDTHS) * FILTERS
    at = np.cumsum([0, *[w * DIMENSIONS * FILTERS for w in WIDTHS]])
    filters = [other[a:b].reshape(w, DIMENSIONS, FILTERS) for w, a, b in zip(WIDTHS, at, at[1:])]
    bias = [other[at[-1] + k * FILTERS : at[-1] + (k + 1) * FILTERS] for k in range(len(WIDTHS))]
    return filters, bias, other[at[-1] + width : at[-1] + 2 * width], other[-1:]


def _strongest(embedding: np.ndarray, filters: list[np.ndarray], text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's greatest response in each row and where it is, in blocks of positions."""
    pooled, best = np.full((len(begins), len(WIDTHS) * FILTERS), -np.inf, np.float32), np.zeros((len(begins), len(WIDTHS) * FILTERS), np.int64)
    n = len(text) - max(WIDTHS)
    for p in range(0, n, TRAIN_WORDS):
        q = min(n, p + TRAIN_WORDS)
        some = text[p : q + max(WIDTHS)]
        vectors = embedding[some[:, 0]]
        for k in range(1, some.shape[1]):
            vectors += embedding[some[:, k]]
        first, last = int(np.searchsorted(begins, p, side="right")) - 1, int(np.searchsorted(begins, q))
        for k, f in enumerate(filters):
            response = sum(vectors[j : q - p + j] @ f[j] for j in range(len(f)))
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            for d in range(first, last):
                a, b = max(begins[d], p), min(ends[d] + 1 - len(f), q)
                if a < b:
                    top = response[a - p : b - p].argmax(axis=0)
                    value = response[a - p + top, np.arange(FILTERS)]
                    better = value > pooled[d, own]
                    best[d, own] = np.where(better, a + top, best[d, own])
                    pooled[d, own] = np.where(better, value, pooled[d, own])
    return pooled, best


def _descend(w: Weights, texts: list[np.ndarray], label: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
    """One batch: ``w`` changes in place."""
    rows = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text, begins = padded(np.concatenate(texts), rows)
    filters, bias, last, offset = _views(w.other)
    # words are few times dropped, so no single one carries all
    text = np.where(rng.random(text.shape, np.float32) < 0.3, np.int32(PAD), text)
    pooled, best = _strongest(w.embedding, filters, text, begins, np.append(begins[1:], len(text) - max(WIDTHS)))
    pooled += np.concatenate(bias)
    active = _leaky(pooled)
    p = 1 / (1 + np.exp(-np.clip(active @ last + offset, -30, 30)))
    error = ((p - label) * weight / len(texts)).astype(np.float32)
    back = error[:, None] * last[None, :] * np.where(pooled > 0, np.float32(1), np.float32(LEAK))
    touched, moves, slopes, slopes_of_bias = [], [], [], []
    for k, f in enumerate(filters):
        own, at = back[:, k * FILTERS : (k + 1) * FILTERS], best[:, k * FILTERS : (k + 1) * FILTERS]
        for j in range(len(f)):
            ids = text[at + j]
            slopes.append(np.einsum("df,dfe->ef", own, w.embedding[ids].sum(axis=2)).ravel())
            touched.append(ids.reshape(-1))
            moves.append(np.repeat((own[:, :, None] * f[j].T[None, :, :]).reshape(-1, DIMENSIONS), text.shape[1], axis=0))
        slopes_of_bias.append(own.sum(axis=0))
    slope = np.concatenate([*slopes, *slopes_of_bias, active.T @ error + np.float32(1e-5) * last, [error.sum()]]).astype(np.float32)
    w.other_sums += slope * slope
    w.other -= np.float32(RATE) * slope / np.sqrt(w.other_sums)
    ids, where = np.unique(np.concatenate(touched), return_inverse=True)
    slope = np.zeros((len(ids), DIMENSIONS), np.float32)
    np.add.at(slope, where, np.concatenate(moves))
    w.embedding_sums[ids] += (slope * slope).mean(axis=1)
    w.embedding[ids] -= np.float32(RATE) * slope / np.sqrt(w.embedding_sums[ids])[:, None]


class _Shard:
    """One shard's training in one round, rows added one after another."""

    def __init__(self, begun: Weights, balance: dict[int, float], passes: int, key: tuple[int, int, int]):
        self.begun, self.w, self.balance, self.passes, self.key = begun, begun.copy(), balance, passes, key
        self.rng = np.random.default_rng(key)
        self.texts: list[np.ndarray] = []
        self.labels: list[int] = []
        self.held = 0

    def add(self, words: np.ndarray, label: int) -> None:
        self.texts.append(words.copy())
        self.labels.append(label)
        self.held += len(words) + max(WIDTHS)
        if self.held >= BUFFER_WORDS:
            self.learn()

    def learn(self) -> None:
        label = np.array(self.labels, np.float64)
        weight = np.array([self.balance[y] for y in self.labels])
        for _ in range(self.passes):
            order = self.rng.permutation(len(label))
            for s in range(0, len(order), BATCH):
                some = order[s : s + BATCH]
                _descend(self.w, [self.texts[k] for k in some], label[some], weight[some], self.rng)
        self.texts, self.labels, self.held = [], [], 0

    def changes(self) -> Iterator[pa.RecordBatch]:
        """The shard's changes and the growth of Adagrad's sums, by piece; the last one, -1, is all but embeddings."""
        if self.texts:
            self.learn()
        seed, shard, _ = self.key
        new, old = self.w, self.begun
        for k in range(-1, -(-len(new.embedding) // PIECE)):
            part = slice(k * PIECE, (k + 1) * PIECE)
            change = new.other - old.other if k < 0 else new.embedding[part] - old.embedding[part]
            growth = new.other_sums - old.other_sums if k < 0 else new.embedding_sums[part] - old.embedding_sums[part]
            yield pa.RecordBatch.from_arrays([pa.array([seed], pa.int32()), pa.array([k], pa.int32()), pa.array([shard], pa.int32()), pa.array([change.tobytes()], pa.binary()), pa.array([growth.tobytes()], pa.binary())], ["seed", "piece", "shard", "change", "growth"])


def _averaged(shards: pa.Table) -> pa.Table:
    """One piece: the shards' changes and growths, weighted by growth, so that what few shards know isn't thinned by the others."""
    shards = shards.sort_by("shard")
    change, growth, whole = 0.0, 0.0, 0.0
    for c, g in zip(shards.column("change").to_pylist(), shards.column("growth").to_pylist()):
        g = np.frombuffer(g, np.float32).astype(np.float64)
        change = change + np.frombuffer(c, np.float32).reshape(len(g), -1) * g[:, None]
        growth, whole = growth + g * g, whole + g
    whole = np.where(whole > 0, whole, 1.0)
    change, growth = (change / whole[:, None]).astype(np.float32), (growth / whole).astype(np.float32)
    return pa.table({"seed": shards.column("seed").slice(0, 1), "piece": shards.column("piece").slice(0, 1), "change": pa.array([change.tobytes()], pa.binary()), "growth": pa.array([growth.tobytes()], pa.binary())})


def _calibrate(model: Model, raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
    """Scale and shift of the raw score by logistic regression on smoothed labels, which stays finite where the classes part cleanly."""
    x, beta = np.stack([raw, np.ones_like(raw)], axis=1), np.array([1.0, 0.0])
    ones, zeros = weight[label == 1].sum(), weight[label == 0].sum()
    goal = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-1, 1e-2])
        step = np.linalg.solve(h, x.T @ (weight * (p - goal)) + np.array([1e-1, 1e-2]) * (beta - [1, 0]))
        step *= min(1.0, 0.5 / max(1e-12, abs(step).max()))
        beta -= step
        if abs(step).max() < 1e-8:
            break
    model.scale, model.shift = max(0.05, float(beta[0])), float(beta[1])


def _best_threshold(z: np.ndarray, label: np.ndarray, weight: np.ndarray, usual: float | None = None) -> float:
    """The logit with the best F1; of several ``usual`` if it is one, else the middle of the widest gap."""
    order = np.argsort(-z, kind="stable")
    z, hit, all_ = z[order], np.cumsum((label * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (label * weight).sum())
    last = np.append(z[1:] < z[:-1], True)
    below = np.append(z[1:], z[-1] - 1)
    best = np.flatnonzero(last & (f1 >= f1[last].max() - 1e-12))
    if usual is not None and any(below[k] < usual <= z[k] for k in best):
        return usual
    k = max(best, key=lambda k: z[k] - below[k])
    return float((z[k] + below[k]) / 2)


def _logit(p: np.ndarray | float) -> np.ndarray | float:
    return np.log(np.maximum(p, 1e-17)) - np.log(np.maximum(1 - p, 1e-17))


@dataclass
class Sample:
    """Labelled texts as word buckets: ``words`` of text k are rows[k] to rows[k + 1]."""

    words: np.ndarray
    rows: np.ndarray
    y: np.ndarray
    langs: list[str | None]
    #: What a row of each class stands for in the whole labelled table.
    weight: np.ndarray


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, max_per_class: int = MAX_PER_CLASS, id_column: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", max_words: int = MAX_WORDS) -> Sample:
    """The words of at most ``max_per_class`` documents and ``max_words`` words of each label, for a look at the driver; ``fit`` doesn't use it."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    known = known if allowed is None else known.filter(allowed)
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        some = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_per_class)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("key")).join(F.broadcast(picked), "id")
    schema = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("key", pa.int64()), ("y", pa.int32()), ("n", pa.int64()), ("words", pa.binary())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in blocks_of(batches):
            words, at = word_buckets(data, offsets)
            own = [words[a:b].tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), block.column(3), block.column(4), pa.array(np.diff(at)), pa.array(own, pa.binary())], schema=schema)

    hashed = rows.select("id", "lang", "text", "key", "y").mapInArrow(kernel, "id long, lang string, key long, y int, n long, words binary")
    # at most 2 * max_per_class rows from here on
    one = settle(hashed.groupBy("id", "y").agg(F.min_by(F.struct("n", "lang", "words"), F.struct("key", "n", "lang")).alias("t")).select("id", "y", "t.*"))
    before = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id")
    fits = one.filter(F.col("n") * 8 <= max_words).select("id", "y", F.sum("n").over(before).alias("so_far")).filter(F.col("so_far") <= max_words)
    found = one.join(F.broadcast(fits.select("id")), "id").orderBy("id").select("lang", "y", "n", "words").toArrow()
    y = found.column("y").to_numpy()
    n = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    whole = max(1, sum(totals.values()))
    share = {k: totals.get(k, 0) / whole * len(y) / n[k] for k in n}
    words = np.frombuffer(b"".join(found.column("words").to_pylist()), np.int32).reshape(-1, 1 + len(PREFIXES))
    return Sample(words, np.concatenate([[0], np.cumsum(found.column("n").to_numpy())]).astype(np.int64), y, found.column("lang").to_pylist(), np.array([share[k] for k in y.tolist()]))


def _deals(spark: SparkSession, shards: int) -> list[int]:
    """A key for each shard that a hash partitioning by as many puts into a partition of its own."""
    keys = spark.range(64 * shards + 64).groupBy(F.pmod(F.hash("id"), F.lit(shards)).alias("p")).agg(F.min("id").alias("k"))
    return [r["k"] for r in keys.orderBy("p").collect()]


def _dealt(docs: DataFrame, labels: DataFrame, allowed: Column | None, id_column: str, text: str, lang: str, label: str) -> DataFrame:
    """Settled (shard, held, y, lang, text): each labelled document once, its shard whole in one partition, by a hash of the id."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    known = known if allowed is None else known.filter(allowed)
    n = known.count()
    deals = _deals(docs.sparkSession, min(MAX_SHARDS, max(1, -(-n * 3 // (4 * SHARD_ROWS)))))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(known) if n <= BROADCAST_ROWS else known, "id").withColumn("h", F.xxhash64("id")).withColumn("key", F.xxhash64("text"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(len(deals))).cast("int"))
    rows = rows.withColumn("deal", F.array(*map(F.lit, deals))[F.col("shard")].cast("long")).repartition(len(deals), "deal")
    first = F.row_number().over(Window.partitionBy("deal", "h", "id").orderBy("key", "lang"))
    # a session that deals into more partitions than asked for still gets as many files as shards
    rows = rows.withColumn("k", first).filter("k = 1").sortWithinPartitions("deal", "h", "id").coalesce(len(deals))
    return settle(rows.select("shard", (F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(4)) == 0).alias("held"), "y", "lang", "text"))


def _common(rows: DataFrame) -> np.ndarray:
    """The buckets that stand in ``MIN_DOCUMENTS`` of ``rows``; others would only be learned by heart and are padding, now and when scoring."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for _, data, offsets in blocks_of(batches, limit=SCORE_BYTES):
            words, at = word_buckets(data, offsets)
            for a, b in zip(at, at[1:]):
                seen[np.unique(words[a:b])] += 1
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(seen[found])], ["bucket", "n"])

    counts = rows.select("text").mapInArrow(kernel, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return np.sort(counts.filter(F.col("n") >= MIN_DOCUMENTS).select("bucket").toArrow().column("bucket").to_numpy())


def _round(rows: DataFrame, models: dict[int, Weights], common: np.ndarray, balance: dict[int, float], passes: int, number: int) -> dict[int, Weights]:
    """Each of ``models`` after one round over all ``rows``."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((models, common))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, known = shared.value
        place = np.full(BUCKETS, PAD, np.int32)
        place[known] = np.arange(1, len(known) + 1)
        own: _Shard | None = None
        for block, data, offsets in blocks_of(batches, limit=SCORE_BYTES):
            words, at = word_buckets(data, offsets)
            words = place[words]
            for k, (shard, seed, y) in enumerate(zip(*(block.column(c).to_pylist() for c in ("shard", "seed", "y")))):
                if own is None or own.key != (seed, shard, number):
                    if own is not None:
                        yield from own.changes()
                    own = _Shard(begun[seed], balance, passes, (seed, shard, number))
                own.add(words[at[k] : at[k + 1]], y)
        if own is not None:
            yield from own.changes()

    all_ = None
    for seed in models:
        some = rows.select("shard", F.lit(seed).alias("seed"), "y", "text")
        all_ = some if all_ is None else all_.union(some)
    changes = all_.mapInArrow(kernel, "seed int, piece int, shard int, change binary, growth binary")
    means = changes.groupBy("seed", "piece").applyInArrow(_averaged, "seed int, piece int, change binary, growth binary").toArrow().to_pylist()
    shared.unpersist()
    out = {seed: w.copy() for seed, w in models.items()}
    for r in means:
        w, k = out[r["seed"]], r["piece"]
        change, growth = np.frombuffer(r["change"], np.float32), np.frombuffer(r["growth"], np.float32)
        if k < 0:
            w.other += change
            w.other_sums += growth
        else:
            w.embedding[k * PIECE : (k + 1) * PIECE] += change.reshape(-1, DIMENSIONS)
            w.embedding_sums[k * PIECE : (k + 1) * PIECE] += growth
    return out


@dataclass
class Cells:
    """Counted rows: ``n`` of them have this raw score, label and language."""

    raw: np.ndarray
    y: np.ndarray
    n: np.ndarray
    langs: list[str | None]


def _cells(rows: DataFrame, models: dict[int, Model], langs: list[str]) -> dict[int, Cells]:
    """``rows`` counted by raw score, for each model; languages other than ``langs`` count as none."""
    shared = rows.sparkSession.sparkContext.broadcast((models, set(langs)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value
        for block, data, offsets in blocks_of(batches, limit=SCORE_BYTES):
            words, at = word_buckets(data, offsets)
            named = pa.array([x if x in known else None for x in block.column(1).to_pylist()], pa.string())
            for seed, m in own.items():
                cell = np.rint(m.raw(words, at) * CELLS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), seed, np.int32)), named, block.column(0), pa.array(cell)], ["seed", "lang", "y", "cell"])

    found = rows.select("y", "lang", "text").mapInArrow(kernel, "seed int, lang string, y int, cell int").groupBy("seed", "lang", "y", "cell").agg(F.count("*").alias("n")).toArrow()
    shared.unpersist()
    out = {}
    for seed in models:
        t = found.filter(pa.array(found.column("seed").to_numpy() == seed)).sort_by([("cell", "ascending"), ("y", "ascending"), ("lang", "ascending")])
        out[seed] = Cells(t.column("cell").to_numpy() / CELLS, t.column("y").to_numpy(), t.column("n").to_numpy().astype(np.float64), t.column("lang").to_pylist())
    return out


def _loss(model: Model, cells: Cells, balance: dict[int, float]) -> float:
    """Of the model, which gets calibrated on ``cells``, there."""
    _calibrate(model, cells.raw, cells.y, cells.n)
    p = np.clip(1 / (1 + np.exp(-np.clip(model.scale * cells.raw + model.shift, -40, 40))), 1e-12, 1 - 1e-12)
    weight = cells.n * np.where(cells.y == 1, balance[1], balance[0])
    return float(-(weight * np.where(cells.y == 1, np.log(p), np.log(1 - p))).sum() / cells.n.sum())


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id_column: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", epochs: int | None = None) -> Model:
    """Learned from all labelled rows; ``allowed``: a condition on the column ``id`` of labels that may be learned from."""
    rows = _dealt(docs, labels, allowed, id_column, text, lang, label)
    totals = {(r["held"], r["y"]): r["n"] for r in rows.groupBy("held", "y").agg(F.count("*").alias("n")).collect()}
    if len({y for _, y in totals}) < 2:
        return Model(np.zeros((1, 1)), [], [], np.zeros(0), 0.0, thresholds={"": THRESHOLD}, constant=True)
    # too few rows for both parts to have both classes: all are in both
    apart = len(totals) == 4
    learn, held = (rows.filter("not held"), rows.filter("held")) if apart else (rows, rows)
    n = {y: sum(k for (h, own), k in totals.items() if own == y and not (apart and h)) for y in (0, 1)}
    # each class weighs the same while training; calibration brings the shares back
    balance = {y: 0.5 * sum(n.values()) / n[y] for y in n}
    epochs = epochs or next((e for most, e in EPOCHS if sum(n.values()) <= most), ROUNDS)
    langs = [r["lang"] for r in held.filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_CALIBRATION).collect()]
    common = _common(learn)
    weights = {seed: Weights.beginning(len(common), seed) for seed in range(RESTARTS)}
    for k in range(rounds := min(ROUNDS, epochs)):
        weights = _round(learn, weights, common, balance, epochs // rounds + (k < epochs % rounds), k)
        if len(weights) > 1 or k == rounds - 1:
            models = {seed: w.model(common) for seed, w in weights.items()}
            cells = _cells(held, models, langs)
            best = min(models, key=lambda seed: (_loss(models[seed], cells[seed], balance), seed))
            weights = {best: weights[best]}
    model, found = models[best], cells[best]
    # the threshold with the best F1 over all languages becomes THRESHOLD
    usual = float(_logit(THRESHOLD))
    model.shift += usual - _best_threshold(model.scale * found.raw + model.shift, found.y, found.n)
    z = model.scale * found.raw + model.shift
    model.thresholds = {"": THRESHOLD}
    for name in sorted(langs):
        own = np.array([x == name for x in found.langs])
        if len(set(found.y[own].tolist())) == 2:
            model.thresholds[name] = float(1 / (1 + np.exp(-_best_threshold(z[own], found.y[own], found.n[own], usual))))
    return model


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, score, threshold, rejected) of every row; threshold is that of the row's language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("threshold", pa.float64()), ("rejected", pa.bool_())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for block, data, offsets in blocks_of(batches, limit=SCORE_BYTES):
            s = m.scores(*word_buckets(data, offsets))
            limit = np.array([m.thresholds.get(x, m.thresholds[""]) if x is not None else m.thresholds[""] for x in block.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(s), pa.array(limit), pa.array(s >= limit)], schema=schema)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(kernel, "doc_id long, score double, threshold double, rejected boolean")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for block, data, offsets in blocks_of(batches, text=text, limit=SCORE_BYTES):
            s = m.scores(*word_buckets(data, offsets))
            limit = np.array([m.thresholds.get(x, m.thresholds[""]) if x is not None else m.thresholds[""] for x in block.column(names.index(lang)).to_pylist()])
            yield block.filter(pa.array(s < limit))

    return docs.mapInArrow(kernel, docs.schema)
