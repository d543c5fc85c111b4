"""Command line: regions of a BED file from an alignment, one FASTA file for each region."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import regions, sinks
from .sources import readers

CHUNK = 1 << 12


def from_files(spark: SparkSession, aligned_reference: str, bed: str, sources: list[str], *, chunk: int = CHUNK) -> DataFrame:
    """(name, seq_no, seq_id, text): of each region, the wanted characters of every sequence of the source files.

    The aligned reference is the first sequence of its file. Files may be A2M or plain; a plain file has one sequence, named by
    its path. Chromosome names in the BED file are not looked at: one alignment is of one chromosome.
    """
    one = F.lit("").alias("chrom")
    reference = readers.read_a2m(spark, aligned_reference, chunk).where("seq_no <= 0")
    reference = reference.select(one, "chunk_no", F.col("start").alias("aln"), "text")
    parts = [readers.read_a2m(spark, f, chunk).select(F.struct(F.lit(i).alias("file"), "seq_no", F.coalesce("seq_id", F.lit(f)).alias("name")).alias("seq_id"), "chunk_no", F.col("start").alias("aln"), "text") for i, f in enumerate(sources)]
    msa = parts[0]
    for p in parts[1:]:
        msa = msa.unionByName(p)
    wanted = readers.read_bed(spark, bed).select(one, "start", "end", "name")
    rows = regions.extract_by_text(wanted, reference, msa.select(one, "seq_id", "chunk_no", "aln", "text"), bucket=chunk)
    return rows.select("name", F.struct("seq_id.file", "seq_id.seq_no").alias("seq_no"), F.col("seq_id.name").alias("seq_id"), "text")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="strandloom.extract", description=__doc__)
    p.add_argument("--aligned-reference", required=True)
    p.add_argument("--extracted-co-ordinates", required=True, metavar="BED")
    p.add_argument("--output-folder", default=".")
    p.add_argument("sources", nargs="+")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("strandloom").getOrCreate()
    sinks.write_regions(from_files(spark, a.aligned_reference, a.extracted_co_ordinates, a.sources), a.output_folder).count()


if __name__ == "__main__":
    main()
