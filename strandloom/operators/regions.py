"""Regions of an alignment: from a reference start, a number of non-gap characters of every sequence.

What is asked of a chunk meets the chunk's text in one row, so a text is looked through once for all of its regions, with arrays of positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.prefix import prefix_scan
from ..functions.storage import dealt, large, materialise

GAP = ord("-")
#: Regions of a row; a chunk in which more begin has several rows.
ASKED = 4096
#: Bytes of text, and regions, that are cut out at a time.
CUT_BYTES, CUT_ROWS = 1 << 22, 1 << 16


def region_starts(bed: DataFrame, nodes: DataFrame, *, bubbles: int, bucket: int = 1 << 14) -> DataFrame:
    """``bed`` with aln_start and chunk_no: an as-of join of the start with REF intervals, as a running value along the positions.

    A start lies in the interval of the last node that is not behind it; one at the sink or behind it has no row.
    """
    here = F.struct(F.col("ref_pos").cast("long").alias("lo"), "aln_pos", (F.col("bubble") + F.col("is_bridge").cast("int") - 1).alias("bubble"))
    marks = nodes.select("chrom", F.col("ref_pos").cast("long").alias("at"), F.lit(0).alias("asks"), here.alias("here"))
    asked = bed.select("chrom", F.col("start").cast("long").alias("at"), F.lit(1).alias("asks"), F.struct(*bed.columns).alias("of"))
    rows = marks.unionByName(asked, allowMissingColumns=True).withColumn("_part", F.expr(f"at div {bucket}"))
    rows = prefix_scan(rows, ["chrom"], ["at", "asks"], "_part", [("last", "max", F.col("here"))]).where("asks = 1 and last is not null")
    ends = nodes.groupBy("chrom").agg(F.max("ref_pos").alias("sink"))
    rows = rows.join(F.broadcast(ends), "chrom").where("at < sink")
    return rows.select("of.*", (F.col("last.aln_pos") + F.col("at") - F.col("last.lo")).alias("aln_start"), F.expr(f"last.bubble div {bubbles}").alias("chunk_no"))


def extract_regions(bed: DataFrame, nodes: DataFrame, msa: DataFrame, *, bubbles: int = 64, bucket: int = 1 << 14) -> DataFrame:
    """(chrom, name, seq_id, text): end - start non-gap characters from the aligned start, fewer at the row's end.

    ``msa`` has (chrom, seq_id, chunk_no, aln, text). A start past the reference gives no row. What a region wants behind its start's chunk
    is an interval join on ranks among the non-gap characters, by buckets.
    """
    return _extracted(region_starts(bed, nodes, bubbles=bubbles).select("chrom", "name", "start", "end", "aln_start", "chunk_no"), msa, bucket)


def _length(text: str):
    return F.length(F.replace(text, F.lit("-"), F.lit(""))).cast("long")


def _buckets(lo: str, hi: str, bucket: int):
    return F.explode(F.sequence(F.expr(f"({lo}) div {bucket}"), F.expr(f"({hi} - 1) div {bucket}"))).alias("b")


def _listed(rows: DataFrame, order: str, asked) -> DataFrame:
    """(chrom, chunk_no, asked): what is asked of each chunk, in lists of ``ASKED`` at most."""
    number = F.row_number().over(Window.partitionBy("chrom", "chunk_no").orderBy(order))
    rows = rows.select("chrom", "chunk_no", asked.alias("x"), number.alias("no"))
    return rows.groupBy("chrom", "chunk_no", F.expr(f"(no - 1) div {ASKED}").alias("list")).agg(F.collect_list("x").alias("asked")).drop("list")


class Filled:
    """The characters of some texts, one text after the other: which of them are no gaps, and where these are."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
        begins, filled = (data & 0xC0) != 0x80, data != GAP  # a character's first byte; a gap is a byte of its own
        at = np.append(np.flatnonzero(begins), len(data))
        #: Number of the first character of each text, and of all characters.
        self.first = np.searchsorted(at, ends - ends[0])
        self.is_filled = filled[at[:-1]]
        #: Non-gap characters before each character.
        self.rank = np.append(0, np.cumsum(self.is_filled))
        #: The bytes of the non-gap characters, and where each begins.
        self.bare = data[filled]
        self.begin = np.append(np.flatnonzero(begins[filled]), len(self.bare))

    def cut(self, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, int, pa.Array]]:
        """(i, j, texts of the pairs i to j - 1): the non-gap characters of ranks ``lo`` to ``hi``, some pairs at a time."""
        begin, width = self.begin[lo], self.begin[hi] - self.begin[lo]
        upto = np.append(0, np.cumsum(width))
        i = 0
        while i < len(lo):
            j = max(i + 1, min(i + CUT_ROWS, int(np.searchsorted(upto, upto[i] + CUT_BYTES, side="right")) - 1))
            ends = upto[i : j + 1] - upto[i]
            data = self.bare[np.arange(ends[-1]) + np.repeat(begin[i:j] - ends[:-1], width[i:j])]
            yield i, j, pa.StringArray.from_buffers(j - i, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
            i = j


def _asked(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.StructArray]:
    """(row of each entry of the lists ``asked``, these entries)."""
    asked = batch.column("asked")
    return np.repeat(np.arange(batch.num_rows), pc.list_value_length(asked).to_numpy(zero_copy_only=False)), asked.flatten()


def _places_in_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, (row, asked) = Filled(batch.column("text")), _asked(batch)
        rank = text.rank[text.first[row]] + asked.field("rank").to_numpy()
        place = np.flatnonzero(text.is_filled)[rank] - text.first[row] + batch.column("aln").to_numpy()[row]
        of = asked.field("of")
        yield pa.RecordBatch.from_arrays([*of.flatten(), pa.array(place), batch.column("chunk_no").take(pa.array(row))], names=[*(f.name for f in of.type), "aln_start", "chunk_no"])


def starts_in_text(bed: DataFrame, aligned: DataFrame, *, bucket: int = 1 << 12) -> DataFrame:
    """``bed`` with aln_start and chunk_no, from the aligned reference's own text: (chrom, chunk_no, aln, text).

    A start is the rank of a non-gap character; running counts over the chunks find its chunk, by buckets of ranks, and the chunk's text its place.
    """
    ranks = prefix_scan(aligned.select("chrom", "chunk_no", _length("text").alias("g")), ["chrom"], ["chunk_no"], F.expr("chunk_no div 4096"), [("g0", "sum", F.col("g"))], inclusive=False)
    ranks = ranks.where("g > 0").select("*", _buckets("g0", "g0 + g", bucket))
    hits = bed.withColumn("b", F.expr(f"start div {bucket}")).join(large(ranks), ["chrom", "b"]).where("start >= g0 and start < g0 + g")
    asked = _listed(hits, "start", F.struct(F.struct(*bed.columns).alias("of"), (F.col("start") - F.col("g0")).cast("long").alias("rank")))
    texts = aligned.select("chrom", "chunk_no", F.col("aln").cast("long").alias("aln"), "text")
    schema = StructType([*bed.schema, StructField("aln_start", LongType()), aligned.schema["chunk_no"]])
    return asked.join(large(texts), ["chrom", "chunk_no"]).mapInArrow(_places_in_text, schema)


def extract_by_text(bed: DataFrame, aligned: DataFrame, msa: DataFrame, *, bucket: int = 1 << 12) -> DataFrame:
    """``extract_regions`` for alignments read from files: ``aligned`` is the aligned reference, cut at the same places as ``msa``."""
    return _extracted(starts_in_text(bed, aligned, bucket=bucket).select("chrom", "name", "start", "end", "aln_start", "chunk_no"), msa, bucket)


def _texts_behind(texts: DataFrame, need: DataFrame, bucket: int) -> DataFrame:
    """(chrom, seq_id, chunk_no, behind): of each sequence, the next ``need`` non-gap characters behind a chunk, fewer at the row's end."""
    key = ["chrom", "seq_id", "chunk_no"]
    ranks = prefix_scan(texts.select(*key, "g"), ["chrom", "seq_id"], ["chunk_no"], F.expr("chunk_no div 4096"), [("g0", "sum", F.col("g"))], inclusive=False)
    wants = ranks.join(large(need), ["chrom", "chunk_no"]).where("need > 0").select("chrom", "seq_id", F.col("chunk_no").alias("of"), F.expr("g0 + g").alias("r0"), F.expr("g0 + g + need").alias("r1"))
    wants = wants.select("*", _buckets("r0", "r1", bucket))
    held = ranks.where("g > 0").select(*key, "g0", "g", _buckets("g0", "g0 + g", bucket))
    parts = wants.join(large(held), ["chrom", "seq_id", "b"]).where("g0 < r1 and g0 + g > r0").where(f"b = greatest(r0, g0) div {bucket}")
    parts = parts.select(*key, "of", "g0", F.expr("cast(greatest(r0 - g0, 0) + 1 as int)").alias("from"), F.expr("cast(least(r1, g0 + g) - greatest(r0, g0) as int)").alias("n"))
    parts = parts.join(large(texts), key).select("chrom", "seq_id", F.col("of").alias("chunk_no"), "g0", F.expr("substring(replace(text, '-', ''), from, n)").alias("t"))
    return parts.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("g0", "t")))["t"], "").alias("behind"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, (row, asked) = Filled(batch.column("text")), _asked(batch)
        at = np.maximum(asked.field("aln_start").to_numpy() - batch.column("aln").to_numpy()[row], 0)
        end = text.first[row + 1]
        lo = text.rank[np.minimum(text.first[row] + at, end)]
        hi = np.minimum(lo + np.maximum(asked.field("size").to_numpy(), 0), text.rank[end])
        for i, j, texts in text.cut(lo, hi):
            of = pa.array(row[i:j])
            yield pa.RecordBatch.from_arrays([batch.column("chrom").take(of), asked.field("name").slice(i, j - i), batch.column("seq_id").take(of), texts], names=["chrom", "name", "seq_id", "text"])


def _extracted(starts: DataFrame, msa: DataFrame, bucket: int) -> DataFrame:
    """A chunk's text, with as much of the row behind it as a region there can want, meets the regions that begin in it."""
    key = ["chrom", "seq_id", "chunk_no"]
    texts = materialise(msa.select(*key, F.col("aln").cast("long").alias("aln"), "text", _length("text").alias("g")), "texts")  # made once for the times that they are read
    size = (F.col("end") - F.col("start")).cast("long")
    asked = materialise(_listed(starts, "aln_start", F.struct("name", F.col("aln_start").cast("long").alias("aln_start"), size.alias("size"))), "asked")
    need = asked.groupBy("chrom", "chunk_no").agg(F.max(F.array_max("asked.size")).alias("need"))
    whole = texts.join(large(_texts_behind(texts, need, bucket)), key, "left").select(*key, "aln", F.concat("text", F.coalesce("behind", F.lit(""))).alias("text"))
    schema = StructType([starts.schema["chrom"], starts.schema["name"], msa.schema["seq_id"], StructField("text", StringType())])
    whole = dealt(whole, "chrom", "chunk_no", of=texts)  # what comes out is many times as large as what is dealt out, so small parts are not put together
    return whole.join(large(asked), ["chrom", "chunk_no"]).mapInArrow(_cut_out, schema)
