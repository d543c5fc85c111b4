"""Variant data derived from relational tables by closed formulas, so that SQL can state every result.

orders give the records (chromosome = key mod 5), lineitem the carried alleles; bases follow from the position.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import dealt, large, materialise, shared_root
from ..operators import graph as g
from ..operators import paths
from .graph import Graph, build_tables

CHUNK = 1 << 12
SAMPLES, COPIES = 10, 2
#: The base at position p is that of number (7 * p + 3 * chrom + p div 5) % 4, which comes again every ``PERIOD`` positions and every four chromosomes.
PERIOD = 20
_PATTERNS = ["".join("ACGT"[(7 * p + 3 * c + p // 5) % 4] for p in range(PERIOD)) for c in range(4)]


def _bases(lo: str, n: str, most: int) -> str:
    """SQL of the ``n`` bases from position ``lo``, ``most`` or fewer."""
    texts = ", ".join(f"'{t * (most // PERIOD + 2)}'" for t in _PATTERNS)
    return f"substring(element_at(array({texts}), cast(1 + chrom % 4 as int)), cast(1 + ({lo}) % {PERIOD} as int), cast({n} as int))"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").selectExpr("o_orderkey as vid", "o_orderkey % 5 as chrom", "o_orderkey div 5 as k", "1 + o_custkey % 8 as ref_len", "cast(1 + o_custkey % 3 as int) as n_alt", "o_orderpriority as prio")
    return o.withColumn("pos", F.expr("3 * k + k % 2"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    alt = "named_struct('idx', i, 'text', if(prio = '5-LOW' and i = n_alt, '<DEL>', repeat(substr('ACGT', cast(1 + (vid + i) % 4 as int), 1), cast(1 + (vid + 3 * i) % 5 as int))), 'kind', if(prio = '5-LOW' and i = n_alt, 'DEL', 'NONE'))"
    return _places(spark, sf_dir).select(
        "chrom", F.col("vid").alias("variant_idx"), (F.col("vid") + 1).alias("lineno"), "pos", F.array(F.concat(F.lit("v"), F.col("vid").cast("string"))).alias("ids"),
        F.expr(_bases("pos", "ref_len", 8)).alias("ref"), F.expr(f"transform(sequence(1, n_alt), i -> {alt})").alias("alts"),
    )


def reference(spark: SparkSession, sf_dir: str, chunk: int = CHUNK) -> DataFrame:
    ends = _places(spark, sf_dir).groupBy("chrom").agg((F.max(F.col("pos") + F.col("ref_len")) + 8).alias("n"))
    rows = ends.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {chunk}")))).withColumn("start", F.col("chunk_no") * chunk)
    rows = rows.repartition(spark.sparkContext.defaultParallelism, "chrom", "chunk_no")  # the lengths are one task's rows, the bases are not
    return rows.select("chrom", F.col("chunk_no").cast("int"), "start", F.expr(_bases("start", f"least(n - start, {chunk})", chunk)).alias("bases"))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carried alleles only; a copy without a row carries the reference."""
    calls = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as vid", f"cast(l_suppkey % {SAMPLES} as int) as sample_idx", f"cast(l_linenumber % {COPIES} as int) as copy_idx", "l_partkey as part")
    rows = dealt(calls, "vid").join(large(_places(spark, sf_dir).select("vid", "chrom", "n_alt")), "vid")
    return rows.groupBy("chrom", F.col("vid").alias("variant_idx"), "sample_idx", "copy_idx").agg(F.min(F.expr("cast(1 + part % n_alt as int)")).alias("allele"))


def names(spark: SparkSession) -> DataFrame:
    return spark.range(SAMPLES).selectExpr("cast(id as int) as sample_idx", "concat('S', id) as name")


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample has two copies on every chromosome."""
    chroms = _places(spark, sf_dir).select("chrom").distinct()
    grid = chroms.select("chrom", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES * COPIES - 1))).alias("copy"))
    return grid.selectExpr("chrom", f"copy div {COPIES} as sample_idx", f"concat('S', copy div {COPIES}) as name", f"copy % {COPIES} as copy_idx", "copy", f"copy % {COPIES} as copy_in_sample").withColumns({"sample_idx": F.col("sample_idx").cast("int")})


def sample_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample list: copy 0 of samples 0 to 4, on chromosomes 0 to 2."""
    chroms = _places(spark, sf_dir).select("chrom").distinct().where("chrom < 3")
    return chroms.select("chrom", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("chrom", F.concat(F.lit("S"), F.col("i").cast("string")).alias("sample"), F.lit(0).alias("copy_idx"))


# ---------------------------------------------------------------- the same as files, for queries that read files

LINE = 64


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Sizes and times of the tables' files, so that a result kept for a folder is not used after a change."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in ("orders", "lineitem"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        at = path.getFileSystem(conf).getFileStatus(path)
        out.append((at.getLen(), at.getModificationTime()))
    return (spark.sparkContext.applicationId, sf_dir, *out)


_kept: dict[tuple, object] = {}


def _once(kind: str, spark: SparkSession, sf_dir: str, make):
    key = (kind, *_stamp(spark, sf_dir))
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Drop what was kept of built graphs and files, so that the next query builds them anew."""
    _kept.clear()


def _text_file(lines: DataFrame, order: list[str], name: str) -> str:
    """The lines in order, as a folder of part files that all tasks write: one after the other they are one file."""
    path = f"{shared_root(lines.sparkSession)}/strandloom-{name}-{uuid.uuid4().hex}"
    lines.orderBy(*order).select("value").write.text(path)
    return path


def fasta_file(spark: SparkSession, sf_dir: str) -> str:
    """One FASTA file with a record for each chromosome: c0, c1 and so on."""

    def make() -> str:
        bases = reference(spark, sf_dir).select("chrom", F.col("start"), F.posexplode(F.expr(f"transform(sequence(0, (length(bases) - 1) div {LINE}), i -> substring(bases, i * {LINE} + 1, {LINE}))")).alias("i", "value"))
        rows = bases.select("chrom", (F.col("start") + F.col("i") * LINE).alias("at"), "value")
        heads = rows.select("chrom").distinct().select("chrom", F.lit(-1).cast("long").alias("at"), F.concat(F.lit(">c"), F.col("chrom").cast("string"), F.lit(" derived")).alias("value"))
        return _text_file(heads.unionByName(rows), ["chrom", "at"], "fasta")

    return _once("fasta", spark, sf_dir, make)


def vcf_file(spark: SparkSession, sf_dir: str) -> str:
    """One VCF file: records by chromosome, position and key; every seventh key has a further alternative of a kind that is not handled."""

    def make() -> str:
        calls = genotypes(spark, sf_dir).groupBy("chrom", "variant_idx").agg(F.map_from_entries(F.collect_list(F.struct((F.col("sample_idx") * COPIES + F.col("copy_idx")).alias("k"), "allele"))).alias("calls"))
        of = lambda i, k: F.coalesce(F.try_element_at("calls", F.lit(i * COPIES + k)), F.lit(0)).cast("string")
        columns = [F.concat_ws("|", *(of(i, k) for k in range(COPIES))) for i in range(SAMPLES)]
        alts = F.concat(F.array_join(F.transform("alts", lambda a: a["text"]), ","), F.when(F.col("variant_idx") % 7 == 0, ",<CNV>").otherwise(""))
        v = variants(spark, sf_dir).join(large(calls), ["chrom", "variant_idx"], "left")
        line = F.concat_ws("\t", F.col("chrom").cast("string"), (F.col("pos") + 1).cast("string"), F.get("ids", F.lit(0)), "ref", alts, F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), *columns)
        rows = v.select(F.lit(2).alias("part"), "chrom", "pos", "variant_idx", line.alias("value"))
        names_ = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *(f"S{i}" for i in range(SAMPLES))])
        zero = F.lit(0).cast("long")
        head = spark.createDataFrame([(0, "##fileformat=VCFv4.3"), (1, names_)], "part int, value string").select("part", zero.alias("chrom"), zero.alias("pos"), zero.alias("variant_idx"), "value")
        return _text_file(head.unionByName(rows), ["part", "chrom", "pos", "variant_idx"], "vcf")

    return _once("vcf", spark, sf_dir, make)


def sample_file(spark: SparkSession, sf_dir: str) -> str:
    """The sample list as a TSV file."""
    make = lambda: _text_file(sample_list(spark, sf_dir).select("chrom", "sample", F.concat_ws("\t", F.col("chrom").cast("string"), "sample", F.col("copy_idx").cast("string")).alias("value")), ["chrom", "sample"], "samples")
    return _once("samples", spark, sf_dir, make)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of these tables, built once in a Spark application while they don't change: its tables lie in the shared folder."""

    def make() -> Graph:
        v, ref, c = materialise(variants(spark, sf_dir), "variants"), materialise(reference(spark, sf_dir), "reference"), copies(spark, sf_dir)
        nodes, sites = build_tables(v, g.reference_lengths(ref))
        steps = materialise(paths.packed_edges(genotypes(spark, sf_dir), c, sites), "steps")
        return Graph(ref, nodes, g.edges_of(sites), paths.unpacked_paths(steps), c, v, CHUNK, steps=steps)

    return _once("graph", spark, sf_dir, make)
