"""Quality by importance resampling.

Tokens (runs of letters, digits and non-ASCII bytes, and runs of other visible
characters; case counts) and pairs of neighbouring tokens are hashed to ``BUCKETS``
buckets. Two bag models, smoothed
bucket shares of the target text (labelled good) and of all raw text, give each
document the log weight sum(count * log(target / raw)). Documents are drawn
without replacement, in proportion to their weights, by Gumbel top-k: the k
greatest of log weight / temperature + Gumbel noise, the noise from a hash of
the id, the text and, for rows that agree in both, their number. The target model is fitted on at most ``MAX_TARGET`` labelled documents, the
raw one on all; what the driver gets is 2 * BUCKETS
numbers, whatever the input.

The weight is taken per n-gram (``temperature`` per unit) so that long texts
neither win nor lose by length; ``temperature=None`` takes the document's whole
ratio. Null and empty texts have log weight 0. Rows without an id, and repeated
rows, each have noise of their own. Should keys tie at the last place all the same,
as many of them are kept as there is room. No labelled target gives log weight 0 for
all, a uniform draw. Ids are integers, or text that reads as such; other text is an
error. Columns besides the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import join_side, numbered, settle
from tidemark.llm.textbytes import blocks_of, mix64, span_hashes

BUCKETS = 10_000
#: Nats of mean weight per n-gram that count as one nat of a key.
TEMPERATURE = 0.02
FRACTION = 0.75
#: Labelled good documents that the target model reads at most, the first by a hash of their id.
MAX_TARGET = 20_000
SEED = 7

_KIND = np.full(256, 2, np.uint8)
_KIND[:0x21] = _KIND[0x7F] = 0
_KIND[0x30:0x3A] = _KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x80:] = 1


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all tokens and pairs of neighbouring tokens of a row."""
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    points = np.flatnonzero(change)
    starts, ends = points[:-1], points[1:]
    seen = kind[starts] > 0
    starts, ends = starts[seen], ends[seen]
    rows = np.searchsorted(starts, offsets)
    h = span_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    same = row[1:] == row[:-1]
    pairs = mix64(h[:-1] * np.uint64(3) + h[1:])[same]
    return np.concatenate([h % np.uint64(BUCKETS), pairs % np.uint64(BUCKETS)]).astype(np.int64), np.concatenate([row, row[1:][same]])


def bucket_counts(docs: DataFrame, target_ids: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """n-grams in each bucket: of the documents in ``target_ids`` (column id, a bounded sample), and of all. No text is shuffled."""
    marked = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(target_ids.select("id", F.lit(1).alias("good"))), "id", "left").select("text", F.coalesce("good", F.lit(0)).alias("good"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for block, data, offsets in blocks_of(batches):
            bucket, row = grams(data, offsets)
            total += np.bincount(bucket, minlength=BUCKETS)
            good += np.bincount(bucket[block.column(1).to_numpy()[row] == 1], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some]), pa.array(good[some])], ["bucket", "total", "good"])

    rows = marked.mapInArrow(kernel, "bucket long, total long, good long").groupBy("bucket").agg(F.sum("total").alias("total"), F.sum("good").alias("good")).toArrow()
    out = np.zeros((2, BUCKETS), np.int64)
    for k, name in enumerate(("good", "total")):
        out[k, rows.column("bucket").to_numpy()] = rows.column(name).to_numpy()
    return out[0], out[1]


def log_ratios(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """log(target share / raw share) of each bucket, one added to every count."""
    if not good.sum():
        return np.zeros(len(good))
    return np.log((good + 1) / (good.sum() + len(good))) - np.log((total + 1) / (total.sum() + len(total)))


def weigh(docs: DataFrame, ratios: np.ndarray, id_column: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, row_key) of every row; row_key is a hash of seed, id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for block, data, offsets in blocks_of(batches):
            bucket, row = grams(data, offsets)
            n = len(offsets) - 1
            count = np.bincount(row, minlength=n)
            total = np.bincount(row, weights=r[bucket], minlength=n)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(count.astype(np.int64)), pa.array(total.astype(np.float64)), block.column(2)], ["doc_id", "n_grams", "log_weight", "row_key"])

    number = F.col(id_column).cast("long")
    key = F.xxhash64(F.lit(seed), number.isNull(), number, F.col(text).isNull(), text)
    return docs.select(number.alias("doc_id"), F.col(text).alias("text"), key.alias("row_key")).mapInArrow(kernel, "doc_id long, n_grams long, log_weight double, row_key long")


def _with_occurrence(rows: DataFrame) -> DataFrame:
    """Settled ``rows`` with ``occurrence``: 0 for a row_key of its own, else the row's number among its equals."""
    repeated = join_side(rows.groupBy("row_key").agg(F.count("*").alias("m")).filter("m > 1").select("row_key"))
    if repeated.isEmpty():
        return rows.withColumn("occurrence", F.lit(0).cast("long"))
    # the filter keeps a settled table's partitions, as its join is by broadcast or its result settled
    again = settle(rows.join(repeated, "row_key", "left_semi"))
    return rows.join(repeated, "row_key", "left_anti").withColumn("occurrence", F.lit(0).cast("long")).unionByName(numbered(again, ["row_key"], ["row_key"], "occurrence"))


def gumbel(*key: str) -> Column:
    """Standard Gumbel noise from a hash of the columns, 53 bits of it as a number inside (0, 1)."""
    uniform = (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def sample_keys(weighed: DataFrame, temperature: float | None = TEMPERATURE) -> DataFrame:
    """Settled ``weighed`` rows with their ``sample_key``."""
    weight = F.col("log_weight") if temperature is None else F.col("log_weight") / F.greatest("n_grams", F.lit(1)) / temperature
    return _with_occurrence(weighed).withColumn("sample_key", weight + gumbel("row_key", "occurrence")).drop("row_key", "occurrence")


def _kth_key(keys: DataFrame, k: int) -> tuple[float, int]:
    """The k-th greatest value of ``key``, and how many rows equal to it belong to the k. Counts in ever finer bins; only bin counts reach the driver."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    need = k
    while low < high:
        width = (high - low) / 1024
        if low + width <= low or high - width >= high:
            break
        number = F.least(F.lit(1023), F.floor((F.col("key") - low) / width))
        rows = keys.filter(F.col("key").between(low, high)).groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).orderBy(F.desc("bin")).collect()
        for r in rows:
            if r["n"] >= need:
                low, high = r["a"], r["b"]
                break
            need -= r["n"]
    return low, need


def resample(docs: DataFrame, labels: DataFrame, fraction: float = FRACTION, id_column: str = "doc_id", text: str = "text", label: str = "quality", temperature: float | None = TEMPERATURE, seed: int = SEED, max_target: int = MAX_TARGET) -> DataFrame:
    """(doc_id, n_grams, log_weight, sample_key, kept) of every row; kept for ceil(fraction * rows) of them."""
    good = labels.filter((F.col(label) == 1) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(max_target)
    weighed = settle(weigh(docs, log_ratios(*bucket_counts(docs, good, id_column, text)), id_column, text, seed))
    keyed = settle(sample_keys(weighed, temperature))
    rows = keyed.count()
    k = -(-rows * round(fraction * 10**6) // 10**6)
    if not k:
        return keyed.withColumn("kept", F.lit(False))
    key, room = _kth_key(keyed.select(F.col("sample_key").alias("key")), k)
    tied = F.col("sample_key") == key
    if keyed.filter(tied).count() == room:
        return keyed.withColumn("kept", F.col("sample_key") >= key)
    tie = numbered(settle(keyed.filter(tied)), [], ["doc_id"], "place").withColumn("kept", F.col("place") < room).drop("place")
    return keyed.filter(~tied).withColumn("kept", F.col("sample_key") > key).unionByName(tie)
