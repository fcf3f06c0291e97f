"""Near-duplicate vectors by cross-polytope hashing.

Each of ``tables`` tables turns a vector by ``hashes`` fast Hadamard rotations
(three rounds of random signs and a Hadamard transform) and takes the coordinate
of greatest size, with its sign, from each: that is its bucket. Next-best
coordinates give ``probes`` more buckets. Two vectors that share a bucket are a
candidate pair, verified by its cosine in double precision. A pair that meets in
several buckets counts in the first of them only, so links are counted without
ever writing pairs; what a bucket returns is a count for each member and the
links that join two trees.

Equal vectors of a label are one class with a size; its copies are links of one
another and are not expanded. A vector that is null, empty, zero, or holds null
or non-finite components, and one without label, links with nothing, nor do
vectors of different length. A row with a null id links with nothing and has a
null component; rows that share an id are one node but count as several
vectors. Ids are integers, or text that reads as such; other text is an error.
Labels may have any type that can be sorted. An empty table gives no rows.

A bucket's members travel with their vector and codes, in the width that the
table's components and the codes need; members that share no bucket don't travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.buckets import Forest, by_group, crowded, grouped, pair_blocks
from tidemark.llm.components import connected_components
from tidemark.llm.runtime import join_classes, settle

THRESHOLD = 0.93
TABLES = 12
HASHES = 3
PROBES = 4
SEED = 41


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, size = x.shape
    step = 1
    while step < size:
        y = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return x / np.sqrt(size)


def bucket_codes(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(rows, tables, probes) distinct bucket codes of unit vectors, the vector's own bucket first; probes <= 2 ** hashes."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - d)))
    rng = np.random.default_rng(seed)
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        best, second, lost = [], [], []
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size))
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            value = np.take_along_axis(y, top, axis=1)
            first = np.argmax(np.abs(value), axis=1)
            pick = lambda k: np.take_along_axis(top, k[:, None], 1)[:, 0] * 2 + (np.take_along_axis(value, k[:, None], 1)[:, 0] < 0)
            best.append(pick(first))
            second.append(pick(1 - first))
            size_of = np.abs(value)
            lost.append(size_of.max(axis=1) - size_of.min(axis=1))
        # probes swap a subset of the coordinates for the next best; subsets by what they lose
        loss = np.array(lost).T
        subsets = np.arange(1 << hashes)
        bits = (subsets[:, None] >> np.arange(hashes)) & 1
        order = np.argsort(loss @ bits.T, axis=1, kind="stable")[:, :probes]
        chosen = bits[order]
        code = np.zeros((n, order.shape[1]), np.int64)
        for k in range(hashes):
            code = code * (2 * size) + np.where(chosen[:, :, k] == 1, second[k][:, None], best[k][:, None])
        out[:, t] = code
    return out


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, d).astype(np.float64)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", embedding: str = "embedding", label: str = "label", tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; see the module's head."""
    probes = min(probes, 2**hashes)
    given = vectors.schema[embedding].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)
    number = "float" if single else "double"
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast(f"array<{number}>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", valid)
    # -0.0 and 0.0 are one value to a grouping; kernels see one of them, and cosines can't tell
    distinct = rows.filter("usable").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")).withColumn("class", F.monotonically_increasing_id()).withColumn("d", F.size("v")).select("class", "label", "v", "rep", "size", "d")

    def hash_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column(5).to_numpy()
            for length in np.unique(d).tolist():
                some = batch.filter(pa.array(d == length)) if (d != length).any() else batch
                for k in range(0, some.num_rows, 2048):
                    part = some.slice(k, 2048)
                    x = _matrix(part.column(2), length)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    codes = bucket_codes(x / np.linalg.norm(x, axis=1, keepdims=True), tables, hashes, probes)
                    n, per = len(x), tables * probes
                    yield part.append_column("codes", pa.ListArray.from_arrays(np.arange(0, n * per + 1, per, dtype=np.int32), codes.ravel()))

    schema = T.StructType([*distinct.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))])
    hashed = distinct.mapInArrow(hash_kernel, schema)
    longest = rows.filter("usable").agg(F.max(F.size("v"))).first()[0] or 1
    narrow = (2 << max(1, (longest - 1).bit_length())) ** hashes <= 1 << 31
    classes = settle(hashed.withColumn("codes", F.col("codes").cast("array<int>")) if narrow else hashed)
    places = classes.select("class", "label", "d", F.posexplode("codes").alias("at", "code"))
    entries = places.select(F.struct("label", "d", F.floor(F.col("at") / probes).cast("int").alias("t"), "code").alias("bucket"), F.col("class").alias("member"))
    held = crowded(entries).select(F.col("bucket.label").alias("label"), F.col("bucket.d").alias("d"), F.col("bucket.t").alias("t"), F.col("bucket.code").alias("code"), "part", "part_a", "part_b", F.col("member").alias("class"))
    held = held.join(classes.select("class", "rep", "size", "v", "codes"), "class").select("label", "d", "t", "code", "part", "part_a", "part_b", "class", "rep", "size", "v", "codes")
    group = ["label", "d", "t", "code", "part_a", "part_b"]

    def link_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in grouped(batches, group):
            col = lambda k: t.column(k).to_numpy()  # noqa: B023, E731
            d = col("d")
            links = np.zeros(t.num_rows, np.int64)
            size, rep, table, code, mine = col("size"), col("rep"), col("t"), col("code"), t.column("codes").combine_chunks().flatten().to_numpy().reshape(-1, tables, probes)
            forest, kept = Forest(t.num_rows), []
            flat = t.column("v").combine_chunks().flatten().to_numpy()
            begin = np.concatenate([[0], np.cumsum(d)])
            for length in np.unique(d).tolist():
                own = np.flatnonzero(d == length)
                x = flat[(begin[own][:, None] + np.arange(length)[None, :])].astype(np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                norm = np.sqrt((x * x).sum(axis=1))
                heads = at[d[at] == length]
                place = np.full(t.num_rows, -1)
                place[own] = np.arange(len(own))
                for i, j, g in pair_blocks(place[heads], len(own), *(col(k)[own] for k in ("part", "part_a", "part_b")), limit=100_000):
                    near = np.einsum("nd,nd->n", x[i], x[j]) / (norm[i] * norm[j]) >= threshold
                    i, j = own[i[near]], own[j[near]]
                    if not len(i):
                        continue
                    # is this the first bucket that the two share, by table and then by code?
                    first = np.ones(len(i), bool)
                    for k in range(tables):
                        shared = mine[i, k][:, :, None] == mine[j, k][:, None, :]
                        met = shared.any(axis=(1, 2))
                        first &= ~met | (k >= table[i])
                        here = (table[i] == k) & met
                        if here.any():
                            least = np.where(shared.any(axis=2), mine[i, k], np.iinfo(mine.dtype).max).min(axis=1)
                            first &= ~here | (least == code[i])
                    np.add.at(links, i[first], size[j[first]])
                    np.add.at(links, j[first], size[i[first]])
                    kept += forest.add(i[first], j[first])
            some = np.flatnonzero(links)
            a = np.array(kept, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([col("class")[some], rep[a[:, 0]]])), pa.array(np.concatenate([links[some], rep[a[:, 1]]])), pa.array(np.concatenate([np.zeros(len(some), bool), np.ones(len(a), bool)]))], ["a", "b", "is_link"])

    found = settle(by_group(held, group, link_kernel, "a long, b long, is_link boolean"))
    component = connected_components(found.filter("is_link").select("a", "b"))
    counts = found.filter("not is_link").groupBy(F.col("a").alias("class")).agg(F.sum("b").alias("others"))
    names = classes.join(counts, "class", "left").join(component, classes.rep == component.node, "left").select("label", "v", "size", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = join_classes(rows.filter("usable"), settle(names), ["label", "v"], "size").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
