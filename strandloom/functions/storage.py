"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir.

A table that several later steps read is written once; its lineage ends at the files, so a lost executor costs a
re-read and plans stay small. Where the session names none, a local session gets one of its own; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is sorted and merged, never sent through the driver, however small its files look."""
    return df.hint("merge")


#: Estimated bytes of a part of ``dealt``; rows in memory take many times as much.
PART_BYTES = 2 << 20
#: Estimates above this are no sizes: a table that is read from no file has the largest number as its size.
UNKNOWN = 1 << 50


def dealt(df: DataFrame, *keys: str, of: DataFrame | None = None) -> DataFrame:
    """``df`` dealt by keys into parts of a bounded size: their number grows with the input, while the session's number of shuffle partitions is fixed.

    ``of`` is a table that grows with ``df`` and whose size is known; that of a join is not.
    """
    size = int((df if of is None else of)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > UNKNOWN:
        return df.repartition(*keys)
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)), *keys)


def materialise(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_root(df.sparkSession)}/strandloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
