"""Centroid clustering with annulus search.

A vector v within distance u of some centroid can have its nearest centroid only among those whose norm lies between |v| - u and |v| + u.
Centroids are sorted by norm. A vector looks up its place among the norms and measures the ``SEEDS`` centroids around it: the nearest
of them is its upper bound u. Two binary searches find the centroids whose norms lie in the annulus, ends included, so that ties at
the border are seen; those alone are compared, by exact squared distance, and equal distances go to the smaller number.
Norms and bounds are widened by a few units in the last place, so rounding can only add candidates.

Components are the integers floor(scale * x). Squared distances are computed in doubles where every partial sum stays below 2**53, and in
Python's integers elsewhere; distances and their sums that don't fit into a long are held at its end. Sums of components are exact at any
size: a task adds them up as whole numbers and sends them as signed digits of base 2**32.

Each round reads the vectors once, with the centroids broadcast (k * width numbers, at most ``MAX_CELLS``), and returns at most
k * width sums for each task, which Spark adds up; k * width sums reach the driver. Nothing else is kept between rounds, so a lost executor costs the
re-run of its tasks only.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component are left out; repeated rows are
vectors of their own; rows with null ids are clustered, but are starts only where the others are too few; fewer than k vectors give
fewer centroids; equal ids among the starts are ordered by their vectors; a centroid that loses all its vectors stays where it is. Empty tables give an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

SEEDS = 4
MAX_CELLS = 1 << 22
#: Vectors that are measured in one product.
BLOCK = 256
DIGIT = 1 << 32
TOP = 2**63 - 1
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int, width: int) -> DataFrame:
    """(id, v): v holds floor(scale * x) as doubles; products of over 2**53 are whole as they are."""
    x = F.col("raw").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("raw")).where((F.size("raw") == width) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    rows = rows.select("id", F.transform(x, lambda c: F.when(F.abs(c * scale) >= 2.0**53, c * scale).otherwise(F.floor(c * scale).cast("double"))).alias("v"))
    return rows.where(F.forall("v", lambda c: F.abs(c) != float("inf")))


def starts(rows: DataFrame, k: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of their ids, in that order."""
    key = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)
    return [[int(c) for c in r["v"]] for r in rows.select(key.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]


class Annulus:
    """Centroids sorted by norm; ``nearest`` finds the nearest of each vector."""

    def __init__(self, centroids: list[list[int]]):
        norms = [math.sqrt(sum(c * c for c in row)) for row in centroids]
        self.order = np.array(sorted(range(len(centroids)), key=lambda i: (norms[i], i)), np.int64)
        self.exact = [centroids[i] for i in self.order]
        self.norms = np.array(norms)[self.order]
        self.rows = np.array(self.exact, np.float64).reshape(len(centroids), -1)
        self.squares = (self.rows * self.rows).sum(axis=1)
        self.largest = np.abs(self.rows).max(initial=0)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(number of the nearest centroid, squared distance) of each row of ``v``."""
        cluster, distance = np.zeros(len(v), np.int64), [0] * len(v)
        small = (np.abs(v).max(axis=1, initial=0) + self.largest) ** 2 * 4 * max(1, v.shape[1]) < 2.0**53
        at = np.flatnonzero(small)
        if len(at):
            own = v[at]
            norm = np.sqrt((own * own).sum(axis=1))
            low, high = self._candidates(own, norm)
            # vectors with neighbouring intervals share a product; what lies outside of a vector's own interval is left out
            by_place = np.lexsort((high, low))
            for lo in range(0, len(at), BLOCK):
                some = by_place[lo : lo + BLOCK]
                first, last = int(low[some].min()), int(high[some].max())
                found = self.squares[None, first:last] - 2 * (own[some] @ self.rows[first:last].T)
                place = np.arange(first, last)
                found[(place < low[some][:, None]) | (place >= high[some][:, None])] = np.inf
                best = found.min(axis=1)
                number = np.where(found == best[:, None], self.order[None, first:last], len(self.order)).min(axis=1)
                exact = best + (own[some] * own[some]).sum(axis=1)
                for i, c, d in zip(at[some].tolist(), number.tolist(), exact.tolist(), strict=True):
                    cluster[i], distance[i] = c, int(d)
        for i in np.flatnonzero(~small).tolist():
            row = [int(x) for x in v[i]]
            distance[i], cluster[i] = min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), int(n)) for n, c in zip(self.order, self.exact, strict=True))
        return cluster, distance

    def _candidates(self, v: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open intervals of the sorted centroids whose norms lie in each vector's annulus."""
        k = len(self.order)
        near = np.clip(np.searchsorted(self.norms, norm) - SEEDS // 2, 0, max(0, k - SEEDS))
        bound = np.full(len(v), np.inf)
        for step in range(min(SEEDS, k)):
            gap = v - self.rows[near + step]
            np.minimum(bound, (gap * gap).sum(axis=1), out=bound)
        reach = np.sqrt(bound)
        slack = (norm + reach + 1) * 1e-12
        return np.searchsorted(self.norms, norm - reach - slack, "left"), np.searchsorted(self.norms, norm + reach + slack, "right")


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _sums(batches: Iterator[pa.RecordBatch], search: Annulus, width: int) -> Iterator[pa.RecordBatch]:
    """(cluster, column, digit, part): sums of the task's vectors; column -1 counts them."""
    total: dict[int, list[int]] = {}
    for batch in batches:
        v = _matrix(batch, width)
        cluster, _ = search.nearest(v)
        for c in np.unique(cluster).tolist():
            own = v[cluster == c]
            if np.abs(own).max(initial=0) * len(own) < 2.0**53:
                sums = [int(x) for x in own.sum(axis=0)]
            else:
                sums = [sum(map(int, col)) for col in own.T]
            total[c] = [a + b for a, b in zip(total.get(c, [0] * (width + 1)), [*sums, len(own)], strict=True)]
    out = []
    for c, sums in total.items():
        for j, s in enumerate(sums):
            sign, s, digit = (1, s, 0) if s >= 0 else (-1, -s, 0)
            while s or not digit:
                out.append((c, j if j < width else -1, digit, sign * (s % DIGIT)))
                s, digit = s // DIGIT, digit + 1
    cols = list(zip(*out, strict=True)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["cluster", "place", "digit", "part"])


def _moved(centroids: list[list[int]], sums: list) -> list[list[int]]:
    total: dict[tuple[int, int], int] = {}
    for r in sums:
        key = (r["cluster"], r["place"])
        total[key] = total.get(key, 0) + r["part"] * DIGIT ** r["digit"]
    return [[total[c, j] // total[c, -1] for j in range(len(row))] if (c, -1) in total else row for c, row in enumerate(centroids)]


def _assigned(batches: Iterator[pa.RecordBatch], search: Annulus, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cluster, distance = search.nearest(_matrix(batch, width))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array([min(d, TOP) for d in distance], pa.int64())], names=["vec_id", "cluster", "distance"])


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, *, k: int, rounds: int, scale: int, width: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    if k * width > MAX_CELLS:
        raise ValueError("too many centroids to broadcast")
    spark: SparkSession = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vec_col, scale, width)
    centroids = starts(rows, k)
    if not centroids:
        return spark.createDataFrame([], RESULT)

    def broadcast():
        return spark.sparkContext.broadcast(Annulus(centroids))

    for _ in range(rounds):
        search = broadcast()
        parts = rows.mapInArrow(lambda it, search=search: _sums(it, search.value, width), "cluster long, place long, digit long, part long")
        centroids = _moved(centroids, parts.groupBy("cluster", "place", "digit").agg(F.sum("part").alias("part")).collect())
        search.unpersist()
    search = broadcast()
    found = materialise(rows.mapInArrow(lambda it: _assigned(it, search.value, width), "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = min(sum(inertia.values()), TOP)
    about = spark.createDataFrame([(c, min(d, TOP), whole, digest(centroids[c])) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int, rounds: int, scale: int, width: int) -> str:
    """The same rows in SQL, for components whose products a double holds."""
    parts = [
        f"v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)) as v from embeddings where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)",
        f"c0 as materialized (select row_number() over (order by h, v) - 1 as c, v as m from (select *, sha256('2:' || vec_id) as h from v order by h, v limit {k}))",
    ]
    near = "(select r, vec_id, v, list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m) as d, c, m from v, c{0} qualify row_number() over (partition by r order by d, c) = 1)"
    for i in range(rounds):
        parts.append(f"a{i} as materialized (select c, unnest(v)::hugeint as x, unnest(range({width})) as j from {near.format(i)})")
        parts.append(f"s{i} as (select c, j, sum(x)::hugeint as s, count(*)::hugeint as n from a{i} group by 1, 2)")
        parts.append(f"n{i} as (select c, list(((s - ((s % n) + n) % n) // n)::double order by j) as m from s{i} group by 1)")
        parts.append(f"c{i + 1} as materialized (select c, coalesce(n.m, o.m) as m from c{i} o left join n{i} n using (c))")
    parts.append(f"last as materialized {near.format(rounds)}")
    return f"with {', '.join(parts)} select vec_id, c::int as cluster, d::bigint as distance, sum(d::hugeint) over (partition by c)::bigint as cluster_inertia, sum(d::hugeint) over ()::bigint as inertia, sha256(array_to_string(list_transform(m, lambda x: x::bigint), ',')) as centroid_sha256 from last"
