"""Readers: FASTA, VCF, sample lists, BED and saved graphs, all as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.prefix import prefix_scan
from ..functions.storage import materialise

CHUNK = 1 << 16


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, id): lines with the split that they are in; ids rise by one from line to line of a split."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))


def _numbered(lines: DataFrame, blocks: DataFrame, *, whole: bool = False) -> DataFrame:
    """(file, line, value) from lines and the number of lines and the first id of each split; ``whole`` counts on from file to file, by name."""
    own = Window.orderBy("file", "block") if whole else Window.partitionBy("file").orderBy("block")  # one row a split
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return lines.join(F.broadcast(sizes), ["file", "block"]).select("file", (F.col("base") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def numbered_lines(spark: SparkSession, path: str, *, whole: bool = False) -> DataFrame:
    """(file, line, value): 1-based physical line numbers, whatever way the file was split. With ``whole`` the files of a folder are parts of one."""
    lines = _split_lines(spark, path)
    return _numbered(lines, lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first")), whole=whole)


def read_fasta(spark: SparkSession, path: str, chrom: str | None = None, *, record: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """reference(chrom, chunk_no, start, bases): the named record (the first if none is named).

    ``chrom`` renames the record, since a FASTA id and a VCF chromosome may differ. Case is kept.
    A folder is one file in parts, by their names.
    """
    lines = numbered_lines(spark, path, whole=True)
    head = lines.where(F.col("value").startswith(">")).select("line", F.regexp_extract("value", r"^>\s*(\S+)", 1).alias("name"))
    if record is not None:
        head = head.where(F.col("name") == record)
    got = head.orderBy("line").limit(1).collect()
    if not got:
        raise ValueError(f"{path}: no such sequence: {record}")
    own = got[0]
    following = lines.where((F.col("line") > own["line"]) & F.col("value").startswith(">")).agg(F.min("line")).first()[0]
    body = lines.where(F.col("line") > own["line"])
    if following is not None:
        body = body.where(F.col("line") < following)
    body = body.select("line", F.regexp_replace("value", r"\s+", "").alias("bases")).withColumn("n", F.length("bases").cast("long"))
    body = prefix_scan(body.withColumn("chrom", F.lit(chrom or own["name"])), ["chrom"], ["line"], F.expr("line div 65536"), [("start", "sum", F.col("n"))], inclusive=False).where("n > 0")
    return rechunked(body, chunk)


def rechunked(body: DataFrame, chunk: int) -> DataFrame:
    """(chrom, chunk_no, start, bases) in chunks of one size, from pieces (chrom, start, n, bases) of any size."""
    pieces = body.withColumn("chunk_no", F.explode(F.sequence(F.expr(f"start div {chunk}"), F.expr(f"(start + n - 1) div {chunk}"))))
    lo = F.greatest(F.lit(0), F.col("chunk_no") * chunk - F.col("start"))
    hi = F.least(F.col("n"), (F.col("chunk_no") + 1) * chunk - F.col("start"))
    pieces = pieces.select("chrom", F.col("chunk_no").cast("int"), (F.col("start") + lo).alias("at"), F.expr("bases").substr((lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    parts = F.sort_array(F.collect_list(F.struct("at", "part")))
    return pieces.groupBy("chrom", "chunk_no").agg(parts.alias("p")).select("chrom", "chunk_no", (F.col("chunk_no").cast("long") * chunk).alias("start"), F.array_join(F.col("p.part"), "").alias("bases"))


def alt_kind(text: Column) -> Column:
    """NONE for a plain sequence, DEL for exactly <DEL>, OTHER for anything else (., *, breakends, symbols)."""
    return F.when(text == "<DEL>", "DEL").when(text.rlike("^[A-Za-z]+$"), "NONE").otherwise("OTHER")


class VcfFile:
    """A VCF file, or a folder of its parts in order of their names: an index of it from one counting pass, and records from one parse.

    The index has a row for each (file, split, chromosome): lines and first line id, so that line numbers are exact however the file is
    split. It also holds the header line. The parse observes what it handles and passes over, so no further pass counts that.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        v = F.col("value")
        kind = F.when(v.startswith("#") | (F.length(F.trim(v)) == 0), F.lit(None)).otherwise(F.substring_index("value", "\t", 1))
        lines = _split_lines(spark, path).select("file", "block", "id", kind.alias("chrom"), F.when(v.startswith("#CHROM"), v).alias("head"))
        self.index = materialise(lines.groupBy("file", "block", "chrom").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min("head").alias("head")), "vcf-index")

    def samples(self) -> list[str]:
        head = self.index.where("head is not null").select("head").first()
        if head is None:
            raise ValueError(f"{self.path}: no header line")
        return head["head"].split("\t")[9:]

    def names(self) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(self.samples())), "sample_idx int, name string")

    def counts(self) -> DataFrame:
        """(chrom, records, others): what a choice of each chromosome handles and what it passes over."""
        counts = self.index.where("chrom is not null").groupBy("chrom").agg(F.sum("n").alias("records"))
        every = F.sum("records").over(Window.partitionBy(F.lit(0)))  # one row a chromosome
        return counts.withColumn("others", every - F.col("records"))

    def records(self, chrom: str | None = None) -> tuple[DataFrame, Observation]:
        """(records of the chosen chromosome, an observation of ``handled`` and ``others`` that the first action on them fills)."""
        n = max(1, len(self.samples()))
        blocks = self.index.groupBy("file", "block").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        lines = _numbered(_split_lines(self.spark, self.path), blocks, whole=True)
        rows = lines.where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0)).withColumn("f", F.split("value", "\t"))
        own = F.lit(True) if chrom is None else F.get("f", F.lit(0)) == chrom
        seen = Observation()
        rows = rows.observe(seen, F.count_if(own).alias("handled"), F.count_if(~own).alias("others")).where(own)
        alts = F.transform(F.split(F.get("f", F.lit(4)), ","), lambda t, i: F.struct((i + 1).cast("int").alias("idx"), t.alias("text"), alt_kind(t).alias("kind")))
        place = F.array_position(F.split(F.get("f", F.lit(8)), ":"), "GT")
        place = F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": no GT"))))
        records = rows.select(
            F.get("f", F.lit(0)).alias("chrom"), F.col("line").alias("variant_idx"), F.col("line").alias("lineno"), (F.get("f", F.lit(1)).cast("long") - 1).alias("pos"), F.split(F.get("f", F.lit(2)), ";").alias("ids"),
            F.get("f", F.lit(3)).alias("ref"), alts.alias("alts"), place.cast("int").alias("gt"), F.slice("f", 10, n).alias("calls"),
        )
        return records, seen


def variants(records: DataFrame) -> DataFrame:
    return records.select("chrom", "variant_idx", "lineno", "pos", "ids", "ref", "alts")


def genotypes(records: DataFrame) -> DataFrame:
    """(chrom, variant_idx, sample_idx, copy_idx, allele) in long form; a missing allele is null."""
    calls = records.select("chrom", "variant_idx", "gt", F.posexplode("calls").alias("sample_idx", "call"))
    calls = calls.select("chrom", "variant_idx", "sample_idx", F.posexplode(F.split(F.get(F.split("call", ":"), F.col("gt") - 1), "[|/]")).alias("copy_idx", "a"))
    return calls.select("chrom", "variant_idx", "sample_idx", "copy_idx", F.when(F.col("a") != ".", F.col("a").cast("int")).alias("allele"))


def read_vcf(spark: SparkSession, path: str, chrom: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variants, genotypes, names): records in file order with 0-based positions, genotypes in long form.

    A record on the chosen chromosome without GT is an error. Sample columns beyond the header are ignored.
    """
    file = VcfFile(spark, path)
    records, _ = file.records(chrom)
    return variants(records), genotypes(records), file.names()


def record_counts(spark: SparkSession, path: str) -> DataFrame:
    return VcfFile(spark, path).counts()


def read_sample_list(spark: SparkSession, path: str, chrom: str | None = None) -> DataFrame:
    """(chrom, sample, copy_idx) of a headerless three-column TSV; a malformed row is an error."""
    rows = spark.read.schema("chrom string, sample string, copy_idx int").option("sep", "\t").option("mode", "FAILFAST").csv(path)
    return rows if chrom is None else rows.where(F.col("chrom") == chrom)


def read_a2m(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(seq_no, seq_id, chunk_no, start, text) of every sequence of an A2M or FASTA file, in chunks of ``chunk`` characters.

    A file without a header line is one sequence, with number -1 and no id.
    """
    lines = numbered_lines(spark, path)
    head = F.col("value").startswith(">")
    lines = prefix_scan(lines.where(head | (F.length("value") > 0)).withColumn("head", head.cast("long")), ["file"], ["line"], F.expr("line div 65536"), [("seq_no", "sum", F.col("head"))])
    names = lines.where("head = 1").select("file", "seq_no", F.expr("substring(value, 2)").alias("seq_id"))
    body = lines.where("head = 0").withColumn("n", F.length("value").cast("long"))
    body = prefix_scan(body, ["file", "seq_no"], ["line"], F.expr("line div 65536"), [("start", "sum", F.col("n"))], inclusive=False)
    pieces = body.withColumn("chunk_no", F.explode(F.sequence(F.expr(f"start div {chunk}"), F.expr(f"(start + n - 1) div {chunk}"))))
    lo = F.greatest(F.lit(0), F.col("chunk_no") * chunk - F.col("start"))
    hi = F.least(F.col("n"), (F.col("chunk_no") + 1) * chunk - F.col("start"))
    pieces = pieces.select("file", "seq_no", "chunk_no", (F.col("start") + lo).alias("at"), F.col("value").substr((lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    rows = pieces.groupBy("file", "seq_no", "chunk_no").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("p"))
    return rows.join(names, ["file", "seq_no"], "left").select("file", (F.col("seq_no") - 1).alias("seq_no"), "seq_id", "chunk_no", (F.col("chunk_no") * chunk).alias("start"), F.array_join(F.col("p.part"), "").alias("text"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chrom string, start bigint, end bigint, name string, score string, strand string").option("sep", "\t").csv(path)

