"""VCF and FASTA files as Spark data sources: ``spark.read.format("vcf").load(path)`` and ``format("fasta")``.

Files are read in byte ranges, one partition each, or several where there are many; a line belongs to the range that its first byte is in. A filter on the chromosome is
pushed down: lines of other chromosomes are dropped before they are split into fields. A range doesn't know how many lines lie before it, so rows
carry (file, split, line in the split), and ``option("count", true)`` gives one row a split with its number of lines (or, for FASTA, what each
stretch of a sequence adds), which ``vcf_records`` and ``fasta_reference`` join to line numbers and places.

Paths may be of any file system that pyarrow opens (local, file, hdfs, s3, gs). ``readers`` reads what only Spark can open.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from ..functions.prefix import prefix_scan
from . import readers

SPLIT = 64 << 20
#: Lines or bytes that one batch of rows is made of.
BATCH_LINES = 20_000
BATCH_BYTES = 8 << 20
#: Tasks of a scan at most: of more ranges, neighbours share one.
TASKS = 256


def _local(path: str) -> str | None:
    """The path in the local file system, or None for any other."""
    return path.removeprefix("file://").removeprefix("file:") if "://" not in path or path.startswith("file:") else None


def _remote(path: str):
    from pyarrow import fs  # only where it is needed: its threads should not be there when workers fork

    return fs.FileSystem.from_uri(path)


def data_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the file, or of the files of the folder, without hidden ones."""
    local = _local(path)
    if local is None:
        from pyarrow import fs

        system, at = _remote(path)
        info = system.get_file_info(at)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(at, recursive=True))
        sizes = [(f.path, f.size) for f in found if f.is_file]
    elif os.path.isfile(local):
        sizes = [(local, os.path.getsize(local))]
    elif os.path.isdir(local):
        sizes = [(p, os.path.getsize(p)) for top, _, names in os.walk(local) for p in (os.path.join(top, n) for n in names)]
    else:
        raise FileNotFoundError(path)
    return sorted(x for x in sizes if os.path.basename(x[0])[0] not in "._")


@dataclass
class Range(InputPartition):
    """Lines that begin in [start, end) of a file."""

    path: str
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """Neighbouring ranges that one task reads."""

    parts: list[Range]


def lines_of(root: str, part: Range) -> Iterator[bytes]:
    """The lines of a range, without their ends."""
    with open(part.path, "rb") if _local(root) else _remote(root)[0].open_input_file(part.path) as raw:
        at = part.start
        if at:
            raw.seek(at - 1)  # a line that began before goes on to its end
            while (piece := raw.read(1 << 16)) and (cut := piece.find(b"\n")) < 0:
                at += len(piece)
            if not piece:
                return
            at += cut
        raw.seek(at)
        held = b""
        while at < part.end:
            piece = raw.read(min(1 << 20, max(1 << 16, part.end - at - len(held))))  # little more than the range
            if not piece:
                if held:
                    yield held
                return
            *whole, held = (held + piece).split(b"\n")
            for line in whole:
                if at >= part.end:
                    return
                yield line
                at += len(line) + 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("load() needs a path")
        self.split = int(options.get("split", SPLIT))
        self.count = str(options.get("count", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        found = [Range(path, lo, min(size, lo + self.split)) for path, size in data_files(self.path) for lo in range(0, size, self.split)]
        size = max(1, -(-len(found) // TASKS))
        return [Ranges(found[i : i + size]) for i in range(0, len(found), size)] or [Ranges([])]


class VcfReader(_Reader):
    schema = "file string, split long, line long, chrom string, pos long, ids array<string>, ref string, alts array<string>, format string, calls array<string>"
    counts = "file string, split long, lines long, head string"

    def __init__(self, options: dict):
        super().__init__(options)
        self.chrom: bytes | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chrom",) and self.chrom is None:
                self.chrom = str(f.value).encode()
            else:
                yield f

    def read(self, task: Ranges) -> Iterator[pa.RecordBatch]:
        if self.count:
            for part in task.parts:
                n, head = 0, None
                for line in lines_of(self.path, part):
                    n += 1
                    head = line.decode() if line.startswith(b"#CHROM") else head
                yield _batch(self.counts, [[part.path], [part.start], [n], [head]])
            return
        own = None if self.chrom is None else self.chrom + b"\t"
        rows: list[tuple] = []
        for part, number, line in ((part, *x) for part in task.parts for x in enumerate(lines_of(self.path, part))):
            if line.startswith(b"#") or not line.strip() or own and not line.startswith(own):
                continue
            f = line.decode().split("\t")
            rows.append((part.path, part.start, number, f[0], int(f[1]) - 1, f[2].split(";"), f[3], f[4].split(","), f[8] if len(f) > 8 else None, f[9:]))
            if len(rows) == BATCH_LINES:
                yield _batch(self.schema, list(zip(*rows, strict=True)))
                rows = []
        if rows:
            yield _batch(self.schema, list(zip(*rows, strict=True)))


class FastaReader(_Reader):
    """A stretch is what a split has of one record; ``name`` is null where the record began in a split before."""

    schema = "file string, split long, stretch long, piece long, name string, bases string"
    counts = "file string, split long, stretch long, name string, bases long"

    def read(self, task: Ranges) -> Iterator[pa.RecordBatch]:
        for part in task.parts:
            yield from self._range(part)

    def _range(self, part: Range) -> Iterator[pa.RecordBatch]:
        stretch, piece, name, held, size, total = 0, 0, None, [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            yield _batch(self.schema, [[part.path], [part.start], [stretch], [piece], [name], ["".join(held)]])

        out: list[tuple] = []
        for line in lines_of(self.path, part):
            if line.startswith(b">"):
                if self.count:
                    out.append((part.path, part.start, stretch, name, total))
                elif held:
                    yield from flush()
                words = line[1:].split()
                stretch, piece, name, held, size, total = stretch + 1, 0, words[0].decode() if words else "", [], 0, 0
                continue
            bases = b"".join(line.split())
            total += len(bases)
            if self.count or not bases:
                continue
            held.append(bases.decode())
            size += len(bases)
            if size >= BATCH_BYTES:
                yield from flush()
                piece, held, size = piece + 1, [], 0
        if self.count:
            out.append((part.path, part.start, stretch, name, total))
            yield _batch(self.counts, list(zip(*out, strict=True)))
        elif held:
            yield from flush()


_TYPES = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _source(kind: str, reader_class: type[_Reader]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return reader_class.counts if str(self.options.get("count", "false")).lower() == "true" else reader_class.schema

        def reader(self, schema) -> _Reader:
            return reader_class(dict(self.options))

    return Source


def register(spark: SparkSession) -> None:
    """Makes the formats ``vcf`` and ``fasta`` known to a session, and lets it push filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for kind, reader in (("vcf", VcfReader), ("fasta", FastaReader)):
        spark.dataSource.register(_source(kind, reader))


def vcf_records(spark: SparkSession, path: str, chrom: str | None = None, *, split: int = SPLIT) -> DataFrame:
    """Records as ``readers.VcfFile`` has them (a folder is one file in parts), through the data source; the choice of chromosome is pushed down."""
    register(spark)
    read = spark.read.format("vcf").option("split", split)
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    base = read.option("count", True).load(path).select("file", "split", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("base"))
    rows = spark.read.format("vcf").option("split", split).load(path)
    rows = rows if chrom is None else rows.where(F.col("chrom") == chrom)
    line = F.col("base") + F.col("line") + 1
    alts = F.transform("alts", lambda t, i: F.struct((i + 1).cast("int").alias("idx"), t.alias("text"), readers.alt_kind(t).alias("kind")))
    place = F.array_position(F.split("format", ":"), "GT")
    gt = F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("line "), line.cast("string"), F.lit(": no GT"))))
    rows = rows.join(F.broadcast(base), ["file", "split"])
    return rows.select("chrom", line.alias("variant_idx"), line.alias("lineno"), "pos", "ids", "ref", alts.alias("alts"), gt.cast("int").alias("gt"), "calls")


def fasta_reference(spark: SparkSession, path: str, *, chunk: int = readers.CHUNK, split: int = SPLIT) -> DataFrame:
    """(chrom, chunk_no, start, bases) of every record of the files, named by the record, through the data source."""
    register(spark)
    order = Window.orderBy("file", "split", "stretch")  # one row a stretch: records and splits, no bases
    stretches = spark.read.format("fasta").option("split", split).option("count", True).load(path)
    stretches = stretches.withColumn("record", F.count("name").over(order)).where("record > 0")
    own = Window.partitionBy("record").orderBy("file", "split", "stretch")
    named = stretches.select("file", "split", "stretch", "record", F.first("name").over(own).alias("chrom"), (F.sum("bases").over(own) - F.col("bases")).alias("before"))
    rows = spark.read.format("fasta").option("split", split).load(path).drop("name").join(named, ["file", "split", "stretch"])
    rows = rows.withColumn("n", F.length("bases").cast("long"))
    rows = prefix_scan(rows, ["file", "split", "stretch"], ["piece"], F.expr("piece div 1024"), [("inside", "sum", F.col("n"))], inclusive=False)
    return readers.rechunked(rows.withColumn("start", F.col("before") + F.col("inside")), chunk)
