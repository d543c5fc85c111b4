"""Sharding by a k-d tree over document metadata.

Documents are split recursively: a node that stands for several shards is cut along its widest metadata dimension at the distributed
weighted median (or the share of its bytes that its left shards should hold), until every leaf is one shard of the target
bytes. Dimensions are source, lang, size and doc_id, scaled to the range that they have over all documents; width is the
range inside the node. The law is ``bytes``: shards are near equal in bytes, up to a few units.

What is cut are units: the copies of one text are one unit, so they lie in one shard. Copies that weigh more than 1 / ``GRAIN`` of a
shard's target in all (in bytes, or in rows against a shard's mean rows) are dealt by hash into units of about that weight, so a text that
makes up a third of the rows is spread like other rows. A unit's metadata are the smallest of its documents.

The order along a dimension is total: 31 bits of the scaled value, then 32 bits of the unit's hash, so a value that a third of the rows share is
cut too. A weighted median is found by narrowing: each pass sums weights by bins of the node's key range, for all nodes of
a level at once, with at most ``BINS`` bins in all; the bin that holds the cut is narrowed until what is in it is below 1 /
``EXACT`` of a shard, or one key is left. Only bin sums reach the driver, and the tree has two nodes a shard at most. The table that passes read
has one row a unit, without texts; texts are read once.

Slots number a shard's rows in two levels: positions inside (shard, input part), plus sums over the parts before.

Defined cases: null texts count as empty, size ``OVERHEAD``; null lang, source and doc_id come first in their dimension; repeated rows
are rows of their own, with slots of their own; with fewer units than shards some shards are empty; an empty table gives an empty result; other columns
are not read, or carried whole as ``row`` on demand. Which of a heavy text's rows go into which unit, and the order of slots, follow the order in which rows were
read and written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import materialise, packed

OVERHEAD = 16
GRAIN = 50
EXACT = 1000
BINS = 1 << 16
VALUE_BITS, HASH_BITS = 31, 32
DIMENSIONS = ("source", "lang", "size", "doc_id")


def _slim(docs: DataFrame, carry: bool) -> DataFrame:
    """One row a document: what the tree needs of it, and which part of the input it came from."""
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    raw = text.cast("binary")
    rows = docs.select(
        F.col("`doc_id`").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.xxhash64(text).alias("h1"), F.expr("conv(substr(md5(cast(coalesce(cast(`text` as string), '') as binary)), 1, 15), 16, 10)").cast("long").alias("h2"),
        _prefix(F.col("`lang`")).alias("lang"), _prefix(F.col("`source`")).alias("source"), *([packed(docs)] if carry else []),
    )
    return rows.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()})


def _prefix(col: Column) -> Column:
    """The first seven bytes as a number, so that texts keep their order; -1 for null."""
    padded = F.rpad(F.hex(F.substring(col.cast("string").cast("binary"), 1, 7)), 14, "0")
    return F.coalesce(F.conv(padded, 16, 10).cast("long"), F.lit(-1).cast("long"))


@dataclass
class Node:
    """A node of the tree: shards [first, first + shards); children of node i are named 2i + 1 and 2i + 2."""

    first: int
    shards: int
    name: int
    dim: str = ""
    cut: int = -1
    left: Node | None = None
    right: Node | None = None


def _units(slim: DataFrame, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slim with its unit's piece, units with weight and raw dimensions)."""
    piece = F.coalesce(F.pmod(F.xxhash64("place"), F.col("pieces")), F.lit(0).cast("long"))
    rows = slim.join(F.broadcast(heavy), ["h1", "h2"], "left").withColumn("piece", piece).drop("pieces")
    units = rows.groupBy("h1", "h2", "piece").agg(F.sum("size").alias("weight"), *(F.min(d).alias(d) for d in DIMENSIONS))
    return rows, units


def _keys(units: DataFrame) -> DataFrame:
    """Units with one order-preserving key for each dimension."""
    ends = units.agg(*(f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max)))).first()
    tie = F.col("tie")
    units = units.withColumn("tie", F.pmod(F.xxhash64("h1", "h2", "piece"), F.lit(1 << HASH_BITS)))
    keys = []
    for d in DIMENSIONS:
        lo, hi = ends[f"lo_{d}"], ends[f"hi_{d}"]
        span = 0 if lo is None or hi is None else hi - lo
        scaled = F.floor((F.col(d).cast("double") - float(lo)) * ((1 << VALUE_BITS) - 2) / float(span)) + 1 if span else F.lit(1)
        scaled = F.least(F.greatest(F.coalesce(scaled, F.lit(0)).cast("long"), F.lit(0)), F.lit((1 << VALUE_BITS) - 1))
        keys.append((scaled * (1 << HASH_BITS) + tie).alias(f"k_{d}"))
    return units.select("h1", "h2", "piece", "weight", *keys)


def _place(batch: pa.RecordBatch, root: Node) -> np.ndarray:
    """Of each unit, the ``name`` of the node without children that it falls into."""
    out = np.empty(batch.num_rows, np.int64)
    open_ = [(root, np.arange(batch.num_rows))]
    while open_:
        node, rows = open_.pop()
        if node.left is None:
            out[rows] = node.name
            continue
        low = batch.column(f"k_{node.dim}").to_numpy()[rows] <= node.cut
        open_ += [(node.left, rows[low]), (node.right, rows[~low])]
    return out


def _bins(batches: Iterator[pa.RecordBatch], root: Node, spans: list[tuple[int, str, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Weights by bin of each span (node, dimension, low, high, bin width), with the smallest and largest key seen."""
    for batch in batches:
        at, weight = _place(batch, root), batch.column("weight").to_numpy()
        parts = []
        for i, (name, dim, low, high, width) in enumerate(spans):
            key = batch.column(f"k_{dim}").to_numpy()
            own = np.flatnonzero((at == name) & (key >= low) & (key <= high))
            if not len(own):
                continue
            bins, of = np.unique((key[own] - low) // width, return_inverse=True)
            sums, lo, hi = np.zeros(len(bins), np.int64), np.full(len(bins), high), np.full(len(bins), low)
            np.add.at(sums, of, weight[own])
            np.minimum.at(lo, of, key[own])
            np.maximum.at(hi, of, key[own])
            parts.append((np.full(len(bins), i), bins, sums, lo, hi))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["span", "bin", "w", "lo", "hi"])


def _histogram(units: DataFrame, root: Node, spans: list[tuple[int, str, int, int]]) -> list[tuple[list[Row], int]]:
    """(rows bin, w, lo, hi in order, bin width) of each span; at most BINS bins in all."""
    bins = max(2, BINS // len(spans))
    full = [(n, d, lo, hi, (hi - lo) // bins + 1) for n, d, lo, hi in spans]
    rows = units.mapInArrow(lambda it: _bins(it, root, full), "span long, bin long, w long, lo long, hi long")
    out: list[tuple[list[Row], int]] = [([], x[4]) for x in full]
    for r in rows.groupBy("span", "bin").agg(F.sum("w").alias("w"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        out[r["span"]][0].append(r)
    for found, _ in out:
        found.sort(key=lambda r: r["bin"])
    return out


def _cut_bin(found: list[Row], below: int, goal: float) -> tuple[Row, int]:
    """The bin in which the weight reaches the goal, and the weight before it."""
    for r in found:
        if below + r["w"] >= goal:
            break
        below += r["w"]
    else:
        below -= r["w"]
    return r, below


def build_tree(units: DataFrame, shards: int) -> Node:
    """The k-d tree over units with keys: a pass over the units for each level's ranges and first bins, and one for each narrowing."""
    root = Node(0, shards, 0)
    top = (1 << VALUE_BITS + HASH_BITS) - 1
    boxes = {0: dict.fromkeys(DIMENSIONS, (0, top))}
    level = [root]
    while level := [n for n in level if n.shards > 1]:
        spans = [(n.name, d, *boxes[n.name][d]) for n in level for d in DIMENSIONS]
        seen = dict(zip([(x[0], x[1]) for x in spans], _histogram(units, root, spans), strict=True))
        open_ = {}
        for n in level:
            ends = {d: seen[n.name, d][0] or [Row(lo=0, hi=0)] for d in DIMENSIONS}
            box = boxes[n.name] = {d: (found[0]["lo"], found[-1]["hi"]) for d, found in ends.items()}
            n.dim = max(DIMENSIONS, key=lambda d: ((box[d][1] >> HASH_BITS) - (box[d][0] >> HASH_BITS), -DIMENSIONS.index(d)))
            found = seen[n.name, n.dim][0]
            weight = sum(r["w"] for r in found)
            if found:
                open_[n.name] = (n, found, 0, weight * (n.shards // 2) / n.shards, weight / n.shards / EXACT)
        while open_:
            again = []
            for name, (n, found, below, goal, exact) in list(open_.items()):
                r, below = _cut_bin(found, below, goal)
                if r["lo"] == r["hi"] or r["w"] <= exact:
                    n.cut = r["hi"] if below + r["w"] - goal <= goal - below else r["lo"] - 1
                    del open_[name]
                else:
                    again.append((name, n.dim, r["lo"], r["hi"]))
                    open_[name] = (n, [], below, goal, exact)
            for (name, *_), (found, _) in zip(again, _histogram(units, root, again) if again else [], strict=True):
                n, _, below, goal, exact = open_[name]
                open_[name] = (n, found, below, goal, exact)
        after = {}
        for n in level:
            half = n.shards // 2
            n.left, n.right = Node(n.first, half, 2 * n.name + 1), Node(n.first + half, n.shards - half, 2 * n.name + 2)
            lo, hi = boxes[n.name][n.dim]
            after[n.left.name] = {**boxes[n.name], n.dim: (lo, max(lo, min(hi, n.cut)))}
            after[n.right.name] = {**boxes[n.name], n.dim: (min(hi, max(lo, n.cut + 1)), hi)}
        boxes, level = after, [c for n in level for c in (n.left, n.right)]
    return root


def leaves(root: Node) -> dict[int, int]:
    """Shard of each node without children."""
    return {root.name: root.first} if root.left is None else leaves(root.left) | leaves(root.right)


def _shard_of(batches: Iterator[pa.RecordBatch], root: Node) -> Iterator[pa.RecordBatch]:
    shard = leaves(root)
    for batch in batches:
        got = [shard[n] for n in _place(batch, root).tolist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "piece")), pa.array(got, pa.int32())], names=["h1", "h2", "piece", "shard"])


def _slots(rows: DataFrame) -> DataFrame:
    """``rows`` with slot: the place in the shard, gapless from 0."""
    inside = Window.partitionBy("shard", "part").orderBy("place")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.withColumn("inside", F.row_number().over(inside)).join(counts, ["shard", "part"]).withColumn("slot", F.col("before") + F.col("inside") - 1)


def shard_documents(docs: DataFrame, *, shards: int = 40, carry: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard[, row]) of every document; grown_shard is null under the law ``bytes``."""
    slim = materialise(_slim(docs, carry), "slim")
    whole = slim.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    if not whole["rows"]:
        out = slim.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["row"] if carry else []))
        return out
    most = max(1.0, whole["bytes"] / shards / GRAIN), max(1.0, whole["rows"] / shards / GRAIN)
    # at most 2 * shards * GRAIN texts are heavy
    groups = slim.groupBy("h1", "h2").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
    heavy = groups.where((F.col("n") > 1) & ((F.col("w") > most[0]) | (F.col("n") > most[1])))
    heavy = heavy.select("h1", "h2", F.ceil(F.greatest(F.col("w") / most[0], F.col("n") / most[1])).cast("long").alias("pieces"))
    rows, units = _units(slim, materialise(heavy, "heavy"))
    units = materialise(_keys(materialise(units, "units")), "keys")
    tree = build_tree(units, shards)
    placed = units.mapInArrow(lambda it: _shard_of(it, tree), "h1 long, h2 long, piece long, shard int")
    rows = _slots(rows.join(placed, ["h1", "h2", "piece"]))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *(["row"] if carry else []))
