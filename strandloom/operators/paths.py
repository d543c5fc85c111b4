"""Samples, chromosome copies, the edges they carry, overlaps, and the edges a walk takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import prefix_scan
from ..functions.storage import large
from .incidence import edge_words, unpacked


def chosen_genotypes(genotypes: DataFrame, names: DataFrame, listed: DataFrame | None, *, exclude: bool = False) -> DataFrame:
    """Genotypes of the copies that a sample list names, or of all others.

    Names and list have a row for each sample or copy; the genotypes, which grow with the records, stay where they are.
    """
    rows = genotypes.join(F.broadcast(names), "sample_idx")
    if listed is None:
        return rows
    keys = listed.select("chrom", F.col("sample").alias("name"), "copy_idx").distinct()
    return rows.join(F.broadcast(keys), ["chrom", "name", "copy_idx"], "left_anti" if exclude else "left_semi")


def number_copies(genotypes: DataFrame) -> DataFrame:
    """(chrom, sample_idx, name, copy_idx, copy, copy_in_sample): copies as the first record of a chromosome has them.

    Copies are numbered anew after a choice of samples; samples without a copy are gone.
    """
    first = genotypes.groupBy("chrom").agg(F.min("variant_idx").alias("variant_idx"))
    rows = genotypes.join(F.broadcast(first), ["chrom", "variant_idx"]).select("chrom", "sample_idx", "name", "copy_idx").distinct()
    all_of = Window.partitionBy("chrom").orderBy("sample_idx", "copy_idx")
    own = Window.partitionBy("chrom", "sample_idx").orderBy("copy_idx")
    return rows.withColumns({"copy": F.row_number().over(all_of) - 1, "copy_in_sample": F.row_number().over(own) - 1})


def ploidy(copies: DataFrame) -> DataFrame:
    """(chrom, sample_idx, name, ploidy, copy_base)."""
    return copies.groupBy("chrom", "sample_idx", "name").agg(F.count("*").alias("ploidy"), F.min("copy").alias("copy_base"))


def carried_edges(genotypes: DataFrame, copies: DataFrame, edges: DataFrame) -> DataFrame:
    """(chrom, copy, edge, src, dst, src_pos, tgt_pos, variant_idx, allele): alleles 0, missing or unhandled drop out."""
    calls = genotypes.where("allele > 0").join(F.broadcast(copies.select("chrom", "sample_idx", "copy_idx", "copy")), ["chrom", "sample_idx", "copy_idx"])
    steps = edges.select("chrom", "variant_idx", F.col("alt_idx").alias("allele"), "edge", "src", "dst", "src_pos", "tgt_pos")
    return calls.join(large(steps), ["chrom", "variant_idx", "allele"]).select("chrom", "copy", "edge", "src", "dst", "src_pos", "tgt_pos", "variant_idx", "allele")


def packed_edges(genotypes: DataFrame, copies: DataFrame, sites: DataFrame) -> DataFrame:
    """(chrom, edge, src, dst, src_pos, tgt_pos, variant_idx, allele, label, bubble, words): a row for each carried edge, its carriers packed.

    Genotypes are packed by record and allele where they lie, so what meets the records is a row for each carried alternative and none for each carrier.
    """
    calls = genotypes.where("allele > 0").join(F.broadcast(copies.select("chrom", "sample_idx", "copy_idx", "copy")), ["chrom", "sample_idx", "copy_idx"])
    packed = edge_words(calls.select("chrom", F.col("variant_idx").alias("edge"), "allele", "copy"), copies, "allele").withColumnRenamed("edge", "variant_idx")
    rows = packed.join(large(sites), ["chrom", "variant_idx"])
    rows = rows.withColumn("i", F.array_position(F.col("alts.alt_idx"), F.col("allele").cast(sites.schema["alts"].dataType.elementType["alt_idx"].dataType))).where("i > 0")
    label = F.get("alts", (F.col("i") - 1).cast("int"))["label"].alias("label")
    return rows.select("chrom", (F.col("first_edge") + F.col("i") - 1).alias("edge"), "src", "dst", "src_pos", "tgt_pos", "variant_idx", "allele", label, "bubble", "words")


def unpacked_paths(packed: DataFrame) -> DataFrame:
    """The rows of ``carried_edges`` from packed ones."""
    return unpacked(packed.drop("label", "bubble")).select("chrom", "copy", "edge", "src", "dst", "src_pos", "tgt_pos", "variant_idx", "allele")


def overlaps(paths: DataFrame) -> DataFrame:
    """Carried edges that start before the target of the copy's last carried edge."""
    last = ("last", "max", F.struct("variant_idx", "edge", "tgt_pos"))  # the carried edge before, whatever bucket it is in
    rows = prefix_scan(paths, ["chrom", "copy"], ["variant_idx", "edge"], F.expr("edge div 65536"), [last], inclusive=False)
    return rows.where("last.tgt_pos > src_pos").drop("last")


def overlap_report(paths: DataFrame, variants: DataFrame, copies: DataFrame) -> DataFrame:
    """LINENO, POS (0-based), ID, SAMPLE, CHROM_COPY (0-based, as in the input), GT."""
    rows = overlaps(paths).join(large(variants.select("chrom", "variant_idx", "lineno", "ids")), ["chrom", "variant_idx"]).join(F.broadcast(copies.select("chrom", "copy", "name", "copy_idx")), ["chrom", "copy"])
    return rows.select("chrom", F.col("lineno").alias("LINENO"), F.col("src_pos").alias("POS"), F.array_join("ids", ",").alias("ID"), F.col("name").alias("SAMPLE"), F.col("copy_idx").alias("CHROM_COPY"), F.col("allele").alias("GT"))


def taken_edges(paths: DataFrame) -> DataFrame:
    """The carried edges that a walk takes: in edge order, each that starts where the last taken one has ended.

    Only stretches of overlapping edges depend on each other; each is folded on its own.
    """
    by, order, bucket = ["chrom", "copy"], ["src", "edge"], "_part"
    rows = prefix_scan(paths.select("chrom", "copy", "edge", "src", "dst", F.expr("src div 65536").alias(bucket)), by, order, bucket, [("far", "max", F.col("dst"))], inclusive=False)
    rows = rows.withColumn("opens", F.coalesce(F.col("far") <= F.col("src"), F.lit(True)).cast("long"))
    rows = prefix_scan(rows, by, order, bucket, [("island", "sum", F.col("opens"))])
    groups = rows.groupBy("chrom", "copy", "island").agg(F.sort_array(F.collect_list(F.struct("src", "edge", "dst"))).alias("g"))
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast("array<long>").alias("kept"))
    step = lambda a, e: F.when(e["src"] >= a["end"], F.struct(e["dst"].alias("end"), F.concat(a["kept"], F.array(e["edge"])).alias("kept"))).otherwise(a)
    return groups.select("chrom", "copy", F.explode(F.aggregate("g", start, step)["kept"]).alias("edge"))
