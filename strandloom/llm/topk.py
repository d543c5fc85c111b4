"""Exact top-k search by tiled matrix products.

Queries are read in tiles of bounded size; each tile is broadcast (at most ``TILE_BYTES``) and every
partition of the vectors multiplies it, shard by shard, with its own rows. A shard keeps only its
best k for each query, a partition the best k of its shards, and the per-partition lists are merged
in a tree of fixed fan-in until one list for each query is left. With more than one tile the result
of each tile is written before the next one is broadcast.

Scores are integer inner products. They are computed with double-precision products, which are
exact while every partial sum stays below 2**53; where sizes don't guarantee that, a shard falls back
to Python integers. Scores outside the range of a long are held at its ends.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part; vectors
of different lengths don't meet; rows that repeat an id are separate candidates and, with different vectors, separate
queries, each of which has the others as candidates (only its own row is left out: the list is one longer at first, and one
entry with the query's id and its product with itself goes); rows equal in id and vector give one list. Fewer candidates than
k give a shorter list. Null ids take no part. Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

TILE_BYTES = 16 << 20
# Rows of one product: its memory is SHARD_ROWS x QUERY_ROWS doubles and a few copies.
SHARD_ROWS = 4096
QUERY_ROWS = 512
FAN_IN = 16
LONG = (-(2**63), 2**63 - 1)


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v): components as floor(scale * x) in double; rows with unusable vectors are left out."""
    x = F.col("raw").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("raw"))
    rows = rows.where(F.col("id").isNotNull() & F.col("raw").isNotNull()).where(fine)
    whole = lambda c: F.when(F.abs(c * scale) >= 2.0**53, c * scale).otherwise(F.floor(c * scale).cast("double"))
    return rows.select("id", F.transform(x, lambda c: whole(c)).alias("v")).where(F.forall("v", lambda c: F.abs(c) != float("inf")))


def exact_topk(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, query_every: int = 50, k: int = 5, tile_bytes: int = TILE_BYTES
) -> DataFrame:
    """(query_id, rank, id, score) of the k best rows for every query; ties go to the smaller id.

    Queries are the rows whose id is divisible by ``query_every``.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vec_col, scale)
    queries = rows.where(F.col("id") % query_every == 0).distinct()
    parts = []
    tiles = _tiles(queries.sort(F.size("v"), "id", "v").toLocalIterator(), tile_bytes)
    tile = next(tiles, None)
    while tile is not None:
        shared = spark.sparkContext.broadcast(tile)
        found = rows.mapInArrow(lambda it, shared=shared: _partial(it, shared.value, k + 1), "number long, query_id long, own long, part long, best array<struct<s:long,id:long>>")
        merged = _without_own(_merge(found, k + 1, rows.rdd.getNumPartitions()), k)
        tile = next(tiles, None)
        if parts or tile is not None:
            merged = materialise(merged, "topk")
            shared.unpersist()
        parts.append(merged)
    if not parts:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", F.posexplode("best").alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias(id_col), F.bitwise_not(F.col("hit.s")).alias("score")
    )


def _without_own(lists: DataFrame, k: int) -> DataFrame:
    """(query_id, best): the k best but the query's own row, which is one of those with its id and its product with itself."""
    own = F.array_position("best", F.struct(F.col("own").alias("s"), F.col("query_id").alias("id")))
    return lists.withColumn("at", own).select("query_id", F.slice(F.filter("best", lambda _, i: i + 1 != F.col("at")), 1, k).alias("best"))


def _tiles(rows, tile_bytes: int):
    """Lists of (ids, matrix), one for each vector length, of ``tile_bytes`` in all at most."""
    tile, ids, vecs, held = [], [], [], 0

    def close():
        if ids:
            tile.append((np.array(ids, np.int64), np.array(vecs, np.float64).reshape(len(ids), -1)))
            ids.clear()
            vecs.clear()

    for _, group in groupby(rows, key=lambda r: len(r["v"])):
        for r in group:
            need = 8 * (len(r["v"]) + 1)
            if held and held + need > tile_bytes:
                close()
                yield tile
                tile, held = [], 0
            ids.append(r["id"])
            vecs.append(r["v"])
            held += need
        close()
    if tile:
        yield tile


def _scores(q: np.ndarray, m: np.ndarray) -> np.ndarray | None:
    """Exact products as float64, or None where a double can't hold them."""
    if q.shape[1] and np.abs(q).max(initial=0) * np.abs(m).max(initial=0) * q.shape[1] >= 2.0**53:
        return None
    return q @ m.T


def exact_product(a: np.ndarray, b: np.ndarray) -> int:
    return min(max(sum(int(x) * int(y) for x, y in zip(a, b, strict=True)), LONG[0]), LONG[1])


def _select(q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """Per query the k best (inverted score, id) of one shard; ``ids`` ascend."""
    s = _scores(q, m)
    if s is None:
        return [sorted((-1 - exact_product(x, row), int(j)) for row, j in zip(m, ids, strict=True))[:k] for x in q]
    n = len(ids)
    if n > k:
        # (score, position) as one number where it is exact; else a full stable sort
        if np.abs(s).max(initial=0) < 2.0**52 / n:
            pick = np.argpartition(-(s * n - np.arange(n)), k - 1, axis=1)[:, :k]
        else:
            pick = np.argsort(-s, axis=1, kind="stable")[:, :k]
    else:
        pick = np.broadcast_to(np.arange(n), (len(q), n))
    got, who = np.take_along_axis(s, pick, 1), ids[pick]
    return [[(-1 - int(a), int(b)) for a, b in zip(x, y, strict=True)] for x, y in zip(got, who, strict=True)]


def _partial(batches: Iterator[pa.RecordBatch], tile, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of this partition for each query of the tile; queries are numbered over the tile."""
    by_len, about = {}, []
    for ids, m in tile:
        by_len[m.shape[1]] = (len(about), m)
        about += [(int(i), -1 - exact_product(v, v)) for i, v in zip(ids, m, strict=True)]
    best: dict[int, list] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, SHARD_ROWS):
            shard = batch.slice(lo, SHARD_ROWS)
            vec = shard.column("v")
            lens = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
            for n in np.unique(lens):
                if n not in by_len:
                    continue
                take = pa.array(np.flatnonzero(lens == n))
                ids = shard.column("id").take(take).to_numpy()
                m = vec.take(take).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), n)
                order = np.argsort(ids, kind="stable")
                first, q = by_len[n]
                ids, m = ids[order], m[order]
                for at in range(0, len(q), QUERY_ROWS):
                    for who, new in enumerate(_select(q[at : at + QUERY_ROWS], ids, m, k), first + at):
                        best[who] = sorted(best.get(who, []) + new)[:k]
    part = TaskContext.get().partitionId()
    cols = {"number": list(best), "query_id": [about[w][0] for w in best], "own": [about[w][1] for w in best], "part": [part] * len(best)}
    lists = pa.array([[{"s": a, "id": b} for a, b in x] for x in best.values()], pa.list_(pa.struct([("s", pa.int64()), ("id", pa.int64())])))
    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols.values()), lists], names=[*cols, "best"])


def _merge(lists: DataFrame, k: int, parts: int) -> DataFrame:
    """Merge per-partition lists, at most FAN_IN at a time, into one list for each query."""
    while True:
        last = parts <= FAN_IN
        keys = ["number", "query_id", "own"] + ([] if last else [F.expr(f"part div {FAN_IN}").alias("part")])
        lists = lists.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        if last:
            return lists
        parts = -(-parts // FAN_IN)

