"""Orders of copies that compose: what a stretch of a chromosome does to the order of all copies, as a monoid, and its scan.

A stretch (some edges, or some blocks) sorts the copies by what they carry in it, latest first. Copies that carry the same stay in the
order that they had. That is an ``Order``: the class of each copy, and for each class but the first the place from which on it matches
the class before it. Two neighbouring stretches compose to one, in any grouping, so all stretches of a chromosome
can be summed up apart and joined by ``prefixes``, a tree of groups of ``FAN`` stretches: a task sees the orders of one group, never a
chromosome.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise

FAN = 64


@dataclass
class Order:
    """``cls`` of each copy, from 0, and ``start`` of each class: where it begins to match the class before it (0 for the first class)."""

    cls: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, classes: np.ndarray) -> Order:
        """The order by classes alone; places are not wanted."""
        kept, number = np.unique(classes, return_inverse=True)
        return cls(number, np.zeros(len(kept), np.int64))

    def then(self, after: Order) -> Order:
        """This stretch and the one behind it: by the later class, then by this one's."""
        if not len(self.cls):
            return after
        if not len(after.cls):
            return self
        size = len(self.start)
        pairs, cls = np.unique(after.cls.astype(np.int64) * size + self.cls, return_inverse=True)
        later, own = pairs // size, pairs % size
        start = after.start[later]
        # inside a class of the later stretch, neighbours match since the latest start of this stretch's classes in between
        inner = np.flatnonzero(later[1:] == later[:-1]) + 1
        if len(inner):
            ends = np.stack([own[inner - 1] + 1, own[inner] + 1], 1).ravel()
            start[inner] = np.maximum.reduceat(np.append(self.start, 0), ends)[::2]
        return Order(cls, start)

    def sorted(self, copies: int) -> tuple[np.ndarray, np.ndarray]:
        """(copies in order, for each of them since where it matches the one before it; 0: throughout)."""
        if not len(self.cls):
            return np.arange(copies), np.zeros(copies, np.int64)
        order = np.argsort(self.cls, kind="stable")
        since, own = np.zeros(copies, np.int64), self.cls[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        since[first] = self.start[own[first]]
        return order, since


NONE = Order(np.zeros(0, np.int64), np.zeros(0, np.int64))


def order_of(row) -> Order:
    return Order(np.asarray(row["cls"], np.int64), np.asarray(row["start"], np.int64))


def prefixes(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """(chrom, part, cls, start): the composition of all parts before each part; empty lists stand for nothing.

    ``parts`` has (chrom, part, cls, start) with parts numbered from 0 on a chromosome; missing numbers are orders that change nothing.
    """
    kind = parts.schema["chrom"].dataType.simpleString()
    schema = f"chrom {kind}, part long, cls array<int>, start array<long>"
    over = F.expr(f"part div {fan}").alias("over")

    def table(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["chrom", "part", "cls", "start"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        total = NONE
        for _, r in pdf.sort_values("part").iterrows():
            total = total.then(order_of(r))
        return table([(pdf["chrom"].iloc[0], int(pdf["over"].iloc[0]), total.cls.astype(np.int32), total.start)])

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        known, out = NONE, []
        for _, r in pdf.sort_values(["own", "part"]).iterrows():  # what lies before the group comes first
            if r["own"]:
                out.append((r["chrom"], int(r["part"]), known.cls.astype(np.int32), known.start))
            known = known.then(order_of(r))
        return table(out)

    levels = [materialise(parts.select("chrom", "part", "cls", "start"), "orders")]
    while (levels[-1].agg(F.max("part")).first()[0] or 0) >= fan:
        levels.append(materialise(levels[-1].withColumn("over", over).groupBy("chrom", "over").applyInPandas(whole, schema), "orders"))
    known = None
    for level in reversed(levels):
        rows = level.select("*", over, F.lit(True).alias("own"))
        if known is not None:
            rows = rows.unionByName(known.select("*", F.col("part").alias("over"), F.lit(False).alias("own")))
        known = materialise(rows.groupBy("chrom", "over").applyInPandas(before, schema), "prefixes")
    return known
