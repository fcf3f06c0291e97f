"""Shards by a k-d tree over document metadata, in DataFrame functions only.

Equal texts are one atom that carries all their bytes, so copies stay together.
An atom that alone reaches the target of a shard is a shard of its own. The
others are split recursively: each node is cut along its widest metadata
dimension (language, source, size), at the weighted median that gives either
side the bytes of its share of the shards, until every leaf is one shard.

A dimension is an order of 4096 cells: sizes on a logarithmic scale, languages and
sources by the bytes they hold, heaviest first, so that large ones lie apart and
small ones together. A node's width is the share of all bytes that lies between its
outermost cells in that order, one unit for every dimension. Atoms that agree in it
are ordered by a hash of the text, so ties never unbalance a cut. A cut is found
from two sums, over the cells of the dimension and then over 4096 cells of the hash
inside one; a level of the tree is two passes over the atoms, and what reaches the
driver is a few rows a node.

Law ``bytes``: shard sizes are near equal, as far as one text's copies, which
stay together, let them be. ``slot`` numbers the rows of a shard from 0 without
a gap. Null texts are empty ones: size 16, one group; null languages and sources have a
cell of their own. Copies with several languages or sources lie where the first of
their cells does. Repeated rows are counted and numbered one by one; the order of
slots is open. Ids may have any type and be null. An empty table gives no rows.
Columns besides the named ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.runtime import join_classes, numbered, settle

SHARDS = 40
ROW_BYTES = 16
CELLS = 4096
DIMENSIONS = ("lang", "source", "size")


def _cell(value: Column) -> Column:
    """A cell of [1, CELLS) for a text, 0 for null."""
    return F.coalesce(F.pmod(F.crc32(value.cast("binary")), F.lit(CELLS - 1)) + 1, F.lit(0)).cast("int")


def _atoms(rows: DataFrame) -> DataFrame:
    """One row for each distinct text: its rows, its bytes with all copies, a cell in each dimension, and a hash cell that orders equal ones."""
    # sizes on a logarithmic scale: 128 cells a doubling
    size = F.least(F.lit(CELLS - 1), F.floor(F.log2(F.max("size").cast("double")) * 128)).cast("int")
    tie = F.shiftrightunsigned(F.xxhash64("text_key"), 52).cast("int")
    return rows.groupBy("text_key").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), F.min("c_lang").alias("c_lang"), F.min("c_source").alias("c_source"), size.alias("c_size")).withColumn("tie", tie)


def axes(weights: dict[str, dict[int, int]]) -> tuple[dict[str, list[int]], dict[str, list[float]]]:
    """From the bytes of each cell of each dimension: the place of every cell, and the share of all bytes before every place."""
    places, before = {}, {}
    for d in DIMENSIONS:
        w = [weights.get(d, {}).get(c, 0) for c in range(CELLS)]
        order = range(CELLS) if d == "size" else sorted(range(CELLS), key=lambda c: (-w[c], c))
        place, run, shares = [0] * CELLS, 0, []
        for k, c in enumerate(order):
            place[c] = k
            shares.append(run / max(1, sum(w)))
            run += w[c]
        places[d], before[d] = place, shares
    return places, before


def with_axes(atoms: DataFrame) -> tuple[DataFrame, dict[str, list[float]]]:
    """``atoms`` with their places ``x_`` in each dimension; the driver gets one sum for each cell."""
    sides = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"c_{d}").alias("c")) for d in DIMENSIONS]))
    weights: dict[str, dict[int, int]] = {}
    for r in atoms.select("weight", sides.alias("s")).groupBy("s.d", "s.c").agg(F.sum("weight").alias("w")).collect():
        weights.setdefault(r["d"], {})[r["c"]] = r["w"]
    places, before = axes(weights)
    # a constant array, read by position; settled, as each level of the tree reads the places many times
    x = {f"x_{d}": F.element_at(F.split(F.lit(",".join(map(str, places[d]))), ",").cast("array<int>"), F.col(f"c_{d}") + 1) for d in DIMENSIONS}
    return settle(atoms.select("text_key", "n", "weight", "tie", *[c.alias(k) for k, c in x.items()])), before


@dataclass
class Node:
    """A part of the tree: its first shard, its shards, and its cut once it is split."""

    first: int
    shards: int
    dimension: str | None = None
    cell: int = 0
    tie: int = 0
    low: Node | None = None
    high: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.low is None else [*self.low.leaves(), *self.high.leaves()]

    def place(self) -> Column:
        """The first shard of the leaf that an atom falls in."""
        if self.low is None:
            return F.lit(self.first)
        x = F.col(f"x_{self.dimension}")
        return F.when((x > self.cell) | ((x == self.cell) & (F.col("tie") >= self.tie)), self.high.place()).otherwise(self.low.place())


def _by_node(values: dict[int, object], kind: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("node")).cast(kind)


def _crossing(sums: DataFrame, by: list[str], cell: str, want: Column, start: Column) -> DataFrame:
    """For each group of ``sums`` (w by cell) the first cell at which the running sum from ``start`` reaches ``want``."""
    w = Window.partitionBy(*by).orderBy(cell)
    run = sums.withColumn("before", start + F.sum("w").over(w) - F.col("w")).withColumn("is_last", F.lead(cell).over(w).isNull())
    reached = run.filter((F.col("before") + F.col("w") >= want) | F.col("is_last"))
    return reached.groupBy(*by).agg(F.min_by(F.struct(F.col(cell).alias("cell"), "before", "w"), F.col(cell)).alias("hit"))


def _split(atoms: DataFrame, tree: Node, before: dict[str, list[float]]) -> bool:
    """Split every leaf of more than one shard; False if there was none that holds atoms."""
    open_ = {n.first: n for n in tree.leaves() if n.shards > 1}
    if not open_:
        return False
    share = {k: (n.shards // 2) / n.shards for k, n in open_.items()}
    here = atoms.withColumn("node", tree.place()).filter(F.col("node").isin(list(open_)))
    sides = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"x_{d}").alias("x")) for d in DIMENSIONS]))
    sums = here.select("node", "weight", sides.alias("s")).groupBy("node", "s.d", "s.x").agg(F.sum("weight").alias("w"))
    whole = Window.partitionBy("node", "d")
    sums = sums.withColumns({"total": F.sum("w").over(whole), "least": F.min("x").over(whole), "most": F.max("x").over(whole)})
    hits = _crossing(sums, ["node", "d", "total", "least", "most"], "x", F.col("total") * _by_node(share, "double"), F.lit(0)).collect()
    best = {}
    for r in hits:
        rank = (before[r["d"]][r["most"]] - before[r["d"]][r["least"]], -DIMENSIONS.index(r["d"]))
        if r["node"] not in best or rank > best[r["node"]][0]:
            best[r["node"]] = (rank, r)
    if not best:
        return False
    chosen = {k: r for k, (_, r) in best.items()}
    goal = {k: float(r["total"]) * share[k] for k, r in chosen.items()}
    along = F.element_at(F.create_map(*[x for d in DIMENSIONS for x in (F.lit(d), F.col(f"x_{d}"))]), _by_node({k: r["d"] for k, r in chosen.items()}, "string"))
    ties = here.filter(along == _by_node({k: r["hit"]["cell"] for k, r in chosen.items()}, "int")).groupBy("node", "tie").agg(F.sum("weight").alias("w"))
    for r in _crossing(ties, ["node"], "tie", _by_node(goal, "double"), _by_node({k: int(r["hit"]["before"]) for k, r in chosen.items()}, "long")).collect():
        n, hit = open_[r["node"]], r["hit"]
        # the hash cell that crosses the goal goes to the side that comes nearer to it so
        over = abs(hit["before"] + hit["w"] - goal[r["node"]]) < abs(hit["before"] - goal[r["node"]])
        n.dimension, n.cell, n.tie = chosen[r["node"]]["d"], int(chosen[r["node"]]["hit"]["cell"]), int(hit["cell"]) + int(over)
        n.low, n.high = Node(n.first, n.shards // 2), Node(n.first + n.shards // 2, n.shards - n.shards // 2)
    return True


def assign(docs: DataFrame, shards: int = SHARDS, text: str = "text", id_column: str = "doc_id", lang: str = "lang", source: str = "source", row_bytes: int = ROW_BYTES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    full = F.coalesce(F.col(text), F.lit(""))
    rows = settle(docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(full) + row_bytes).cast("long").alias("size"), F.crc32(full.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(F.xxhash64(full), F.octet_length(full), F.crc32(full.cast("binary"))).alias("text_key"), _cell(F.col(lang).cast("string")).alias("c_lang"), _cell(F.col(source).cast("string")).alias("c_source")))
    atoms = settle(_atoms(rows))
    total = atoms.agg(F.sum("weight")).first()[0]
    if total is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    # texts that fill a shard alone, heaviest first: fewer than the shards, as each holds that share of what is left
    alone: dict[int, int] = {}
    rest = total
    for r in atoms.orderBy(F.desc("weight"), "text_key").limit(shards - 1).collect():
        if r["weight"] * (shards - len(alone)) < rest:
            break
        alone[r["text_key"]] = len(alone)
        rest -= r["weight"]
    atoms, before = with_axes(atoms)
    light = atoms.filter(~F.col("text_key").isin(list(alone))) if alone else atoms
    tree = Node(len(alone), shards - len(alone))
    while _split(light, tree, before):
        pass
    own = F.element_at(F.create_map(*[F.lit(x) for kv in alone.items() for x in kv]), F.col("text_key")) if alone else F.lit(None).cast("int")
    shard_of = settle(atoms.select("text_key", "n", F.coalesce(own, tree.place()).alias("shard")))
    found = settle(join_classes(rows.select("doc_id", "size", "text_crc32", "text_key"), shard_of, ["text_key"], "n").select("doc_id", "size", "text_crc32", "shard"))
    out = numbered(found, ["shard"], ["doc_id"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
