"""Optional streaming: new genotype rows arrive as files and are added to a graph's path table.

Edges are static; each micro-batch joins its genotypes with them and appends the carried edges. Batches are
idempotent: a batch that runs again overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.paths import carried_edges

GENOTYPES = "chrom long, variant_idx long, sample_idx int, copy_idx int, allele int"


def stream_paths(spark: SparkSession, source: str, copies: DataFrame, edges: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Follow Parquet genotype files under ``source``; carried edges go to ``target``/batch=N."""

    def add(batch: DataFrame, number: int) -> None:
        carried_edges(batch, copies, edges).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(GENOTYPES).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
