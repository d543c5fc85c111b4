"""Running aggregates in two levels, so that no chromosome has to fit into one task.

A plain window over (partition by chromosome order by position) gathers a chromosome in one task. Here the
order is cut into buckets of a fixed width: a window inside each bucket, a small window over the
bucket totals (one row a bucket), and an equi-join that puts the two together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WHOLE = {"sum": F.sum, "count": F.sum, "max": F.max}


def prefix_scan(df: DataFrame, by: list[str], order: list[str], bucket: Column | str, specs: list[tuple[str, str, Column]], *, inclusive: bool = True) -> DataFrame:
    """``df`` with one column for each (name, kind, value) of ``specs``.

    kind is ``sum``, ``count`` or ``max``; ``bucket`` must not decrease along ``order``. Exclusive results
    leave out the row itself; they are 0 for sums and counts, and null for maxima, where nothing precedes. Where ``bucket`` names a column, that
    stays in the result, so the next scan over the same buckets finds its rows dealt out already.
    """
    key = bucket if isinstance(bucket, str) else "_bucket"
    rows = df if isinstance(bucket, str) else df.withColumn(key, bucket)
    end = 0 if inclusive else -1
    inside = Window.partitionBy(*by, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    value = {name: (F.lit(1).cast("long") if kind == "count" else expr) for name, kind, expr in specs}
    totals = rows.groupBy(*by, key).agg(*(_WHOLE[kind](value[name]).alias(f"_{name}") for name, kind, _ in specs))
    totals = totals.select(*by, key, *(_WHOLE[kind](f"_{name}").over(before).alias(f"_{name}") for name, kind, _ in specs))
    rows = rows.withColumns({name: _WHOLE[kind](value[name]).over(inside) for name, kind, _ in specs})
    rows = rows.join(totals, [*by, key])
    for name, kind, _ in specs:
        both = F.greatest(name, f"_{name}") if kind == "max" else F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"_{name}"), F.lit(0))
        rows = rows.withColumn(name, both).drop(f"_{name}")
    return rows if isinstance(bucket, str) else rows.drop(key)
