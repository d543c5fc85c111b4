"""The user's entry point: a graph built from DataFrames or files, and everything that is derived from it."""

from __future__ import annotations

import logging
from contextlib import nullcontext
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import founder_name, haplotype_name, sequence_id
from ..functions.progress import Counter, Records, watched
from ..functions.storage import large, materialise
from ..operators import graph as g
from ..operators import incidence, matching, paths, regions, segments, sinks, walk
from ..operators.outputs import Listener
from ..sources import readers

log = logging.getLogger("strandloom")


def build_tables(variants: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with bridges, bubbles and aligned positions, records with their ALT edges); both are read from one table of bubbles, which is written once."""
    sites = materialise(g.sites(variants), "sites")  # the running values read its numbers several times, its alternatives once
    folded = g.fold_bubbles(g.marked_sites(sites, lengths, variants), variants)
    return g.nodes_of(folded, materialise(g.bubble_offsets(folded), "offsets")), g.sites_of(folded)


def mismatch_line(r: Row) -> str:
    return f"REF does not match the reference: chromosome {r['chrom']}, record {r['variant_idx']}, position {r['pos'] + 1}, REF {r['ref']!r}, expected {r['expected']!r}"


#: Columns of saved cut positions.
CUTS = "chrom string, cut_idx int, node long, score long, min_distance long"


@dataclass
class Graph:
    """Tables of a variant graph; ``chrom`` is a column of all of them."""

    reference: DataFrame
    nodes: DataFrame
    edges: DataFrame
    paths: DataFrame
    copies: DataFrame
    variants: DataFrame | None = None
    chunk: int = readers.CHUNK
    #: Numbers of the build: handled records, records of other chromosomes (files only), records whose REF differs.
    stats: dict = field(default_factory=dict)
    #: The records whose REF differs from the reference, with what was expected.
    mismatches: DataFrame | None = None
    #: The carried edges with labels, bubbles and packed carriers (``paths.packed_edges``); made from the other tables if not given.
    steps: DataFrame | None = None

    def __post_init__(self) -> None:
        if "bubble" not in self.edges.columns:  # saved before edges had it
            at = self.nodes.select("chrom", F.col("node").alias("dst"), "bubble")
            self.edges = self.edges.join(large(at), ["chrom", "dst"])

    # ---- building, saving, loading

    @classmethod
    def build(cls, reference: DataFrame, variants: DataFrame, genotypes: DataFrame, names: DataFrame, *, listed: DataFrame | None = None, exclude: bool = False, on_mismatch: str = "warn", chunk: int = readers.CHUNK, check: bool = True, keep: Column | None = None) -> Graph:
        """Build a graph. ``on_mismatch`` is warn or error, for REF fields that differ from the reference.

        With warn they are counted in ``stats``, kept in ``mismatches``, and the first ones are logged. Unsorted records and
        alternatives that reach past the reference end are errors. ``listed`` chooses samples by a list, ``keep`` by any predicate on
        chrom, name, sample_idx and copy_idx.
        """
        stats = {"handled": variants.count()}
        wrong = None
        lengths = g.reference_lengths(reference)
        if check:
            if g.unsorted_records(variants).limit(1).count():
                raise ValueError("records are not sorted by position")
            wrong = materialise(g.ref_mismatches(variants, reference, chunk), "mismatches")
            stats["ref_mismatches"] = wrong.count()
            some = wrong.orderBy("chrom", "variant_idx").limit(1 if on_mismatch == "error" else cls.LOGGED).collect()
            if some and on_mismatch == "error":
                raise ValueError(mismatch_line(some[0]))
            for r in some:
                log.warning(mismatch_line(r))
            if stats["ref_mismatches"] > len(some):
                log.warning("%d more records whose REF does not match", stats["ref_mismatches"] - len(some))
        alts = g.handled_alts(variants)
        if check and alts.join(F.broadcast(lengths), "chrom").where("tgt_pos > ref_len").limit(1).count():
            raise ValueError("an alternative reaches past the end of the reference")
        nodes, sites = build_tables(variants, lengths)
        chosen = paths.chosen_genotypes(genotypes, names, listed, exclude=exclude)
        chosen = chosen if keep is None else chosen.where(keep)
        copies = materialise(paths.number_copies(chosen), "copies")
        steps = materialise(paths.packed_edges(chosen, copies, sites), "steps")
        return cls(reference, nodes, g.edges_of(sites), paths.unpacked_paths(steps), copies, variants, chunk, stats, wrong, steps)

    @classmethod
    def from_files(cls, spark: SparkSession, fasta: str, vcf: str, chrom: str, *, record: str | None = None, include: str | None = None, exclude: str | None = None, on_mismatch: str = "warn", chunk: int = readers.CHUNK, keep: Column | None = None, listener: Listener | None = None) -> Graph:
        if include and exclude:
            raise ValueError("samples can be included or excluded, not both")
        file = readers.VcfFile(spark, vcf)
        with watched(Records(spark), listener.RECORDS, listener.handled_records) if listener else nullcontext():
            records, seen = file.records(chrom)
            records = materialise(records, "records")  # the one parse of the text
        variants, genotypes, names = readers.variants(records), readers.genotypes(records), file.names()
        bases = materialise(readers.read_fasta(spark, fasta, chrom, record=record, chunk=chunk), "reference")
        listed = readers.read_sample_list(spark, include or exclude, chrom) if include or exclude else None
        out = cls.build(bases, variants, genotypes, names, listed=listed, exclude=bool(exclude), on_mismatch=on_mismatch, chunk=chunk, keep=keep)
        out.stats["chrom_mismatches"] = seen.get["others"] or 0
        return out

    #: How many mismatching records are logged one by one.
    LOGGED = 20
    TABLES = ("nodes", "edges", "paths", "copies")

    def save(self, path: str) -> None:
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").partitionBy("chrom").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, reference: DataFrame, chunk: int = readers.CHUNK) -> Graph:
        """A saved graph; only the chromosomes of ``reference`` are read."""
        own = reference.select(F.col("chrom").cast("string").alias("chrom")).distinct()
        read = {n: spark.read.parquet(f"{path}/{n}").withColumn("chrom", F.col("chrom").cast("string")).join(own, "chrom", "left_semi").withColumn("chrom", F.col("chrom").cast(reference.schema["chrom"].dataType)) for n in cls.TABLES}
        return cls(reference, **read, chunk=chunk)

    @staticmethod
    def saved_chromosomes(spark: SparkSession, path: str) -> list[str]:
        return sorted(str(r[0]) for r in spark.read.parquet(f"{path}/nodes").select("chrom").distinct().collect())

    # ---- reports

    def statistics(self) -> DataFrame:
        """(chrom, nodes, alt_edges, copies)."""
        n = self.nodes.groupBy("chrom").agg(F.count("*").alias("nodes"))
        e = self.edges.groupBy("chrom").agg(F.count("*").alias("alt_edges"))
        c = self.copies.groupBy("chrom").agg(F.count("*").alias("copies"))
        return n.join(e, "chrom", "left").join(c, "chrom", "left").fillna(0, ["alt_edges", "copies"])

    def sizes(self) -> DataFrame:
        """(part, rows, bytes) of each table: rows counted, bytes as the optimizer estimates them."""
        spark = self.nodes.sparkSession
        parts = {"reference": self.reference, **{n: getattr(self, n) for n in self.TABLES}}
        rows = [(n, df.count(), int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for n, df in parts.items()]
        return spark.createDataFrame(rows, "part string, rows long, bytes long")

    def overlap_report(self) -> DataFrame:
        return paths.overlap_report(self.paths, self.variants, self.copies)

    def graphviz(self) -> DataFrame:
        ref = g.ref_edges(self.nodes)
        ref = g.reference_slices(ref.withColumnsRenamed({"src_pos": "lo", "tgt_pos": "hi"}).withColumn("id", F.col("dst")), self.reference, self.chunk)
        return sinks.graphviz_lines(self.nodes, ref, self.edges)

    # ---- sequences

    @cached_property
    def carried(self) -> DataFrame:
        """(chrom, edge, words): the carriers of each edge as packed bits."""
        return self._steps.select("chrom", "edge", "words")

    @cached_property
    def _steps(self) -> DataFrame:
        if self.steps is not None:
            return self.steps
        more = self.edges.select("chrom", "edge", "src", "dst", "src_pos", "tgt_pos", "label", "bubble")
        return materialise(incidence.edge_words(self.paths, self.copies).join(large(more), ["chrom", "edge"]), "steps")

    @cached_property
    def taken(self) -> DataFrame:
        return materialise(paths.taken_edges(self.paths), "taken")

    @cached_property
    def chunks(self) -> DataFrame:
        return materialise(walk.ref_chunks(self.nodes, self.reference, self.chunk), "chunks")

    def copy_texts(self, aligned: bool = True) -> DataFrame:
        return walk.copy_chunks(self.copies, self.chunks, self._steps, "words", incidence.carries, aligned=aligned)

    @cached_property
    def several(self) -> bool:
        return self.nodes.select("chrom").distinct().limit(2).count() > 1

    def _labelled(self, rows: DataFrame, seq_no: Column, name: Column, parts: list[Column], chromosome: str | None) -> DataFrame:
        """msa rows. Sequences of several chromosomes carry theirs in id and file name, so they don't mix; ``chromosome`` overrides it."""
        prefix = F.lit(chromosome) if chromosome else F.col("chrom").cast("string") if self.several else None
        apart = [F.col("chrom").cast("string")] if self.several else []
        return rows.select("chrom", seq_no.alias("seq_no"), sequence_id(name, prefix).alias("seq_id"), F.array(*apart, *parts).alias("name"), "chunk_no", "text")

    def _ref(self, aligned: bool, chromosome: str | None) -> DataFrame:
        return self._labelled(walk.ref_row(self.chunks, aligned=aligned), F.lit(0), F.lit("REF"), [F.lit("REF")], chromosome)

    def haplotypes(self, *, aligned: bool = True, reference: bool = True, chromosome: str | None = None) -> DataFrame:
        """msa(chrom, seq_no, seq_id, name, chunk_no, text): the REF row and every copy, in order."""
        who = self.copies.select("chrom", "copy", F.col("name").alias("sample"), "copy_in_sample")
        rows = self.copy_texts(aligned).join(who, ["chrom", "copy"])
        rows = self._labelled(rows, F.col("copy") + 1, haplotype_name(F.col("sample"), F.col("copy_in_sample")), [F.col("sample"), (F.col("copy_in_sample") + 1).cast("string")], chromosome)
        return self._ref(aligned, chromosome).unionByName(rows) if reference else rows

    # ---- founders

    def cut_positions(self, min_distance: int = 0, listener: Listener | None = None) -> DataFrame:
        """Cut positions of least height; ``listener`` hears of the nodes while they are handled."""
        candidates = segments.bubble_candidates(self.nodes, self.edges)
        if listener is None:
            return segments.cut_positions(candidates, self.carried, self.copies, self.nodes, min_distance)
        count = Counter(self.nodes.sparkSession)
        with watched(count, listener.NODES, listener.handled_node, self.nodes.count()):
            return segments.cut_positions(candidates, self.carried, self.copies, self.nodes, min_distance, count=count)

    def check_cuts(self, cuts: DataFrame) -> DataFrame:
        """``cuts`` as loaded from a file, if each is a bridge of its chromosome, and its first and last nodes are cuts."""
        marks = self.nodes.select("chrom", "node", "is_bridge")
        chrom = self.nodes.schema["chrom"].dataType
        cuts = cuts.withColumn("chrom", F.col("chrom").cast(chrom))
        sink = marks.groupBy("chrom").agg(F.max("node").alias("sink"))
        odd = cuts.join(marks.where("is_bridge"), ["chrom", "node"], "left_anti").limit(1).collect()
        ends = cuts.groupBy("chrom").agg(F.min("node").alias("first"), F.max("node").alias("last")).join(sink, "chrom").where("first <> 0 or last <> sink").limit(1).collect()
        if odd or ends:
            raise ValueError(f"these cut positions are not of this graph: {(odd or ends)[0]}")
        return cuts

    def load_cuts(self, path: str) -> DataFrame:
        """Saved cut positions, with the score and the minimum distance that they were found with."""
        return self.check_cuts(self.nodes.sparkSession.read.json(path, schema=CUTS))

    def match(self, cuts: DataFrame, founders: int, *, keep_ref: bool = False) -> DataFrame:
        """(chrom, block, founder, copy) by greedy matching."""
        held = materialise(segments.in_blocks(self._steps.select("chrom", "edge", "src", "words"), cuts).drop("src"), "blocks")
        spans = cuts.groupBy("chrom").agg((F.count("*") - 1).cast("int").alias("n")).where("n > 0").select("chrom", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
        classes = materialise(segments.ranked_carriers(held, self.copies), "classes")
        return materialise(matching.founder_assignments(classes, held.drop("block"), held.drop("words"), spans, self.copies, founders, keep_ref), "assignments")

    def founder_rows(self, cuts: DataFrame, assignments: DataFrame, *, aligned: bool = True, reference: bool = True, chromosome: str | None = None) -> DataFrame:
        """msa of the founders: each block's text of the assigned copy, or of the reference.

        A founder is a path of its own: the taken edges of the assigned copies, block by block, since no edge and no stretch of overlapping edges crosses a cut.
        """
        steps = segments.assigned_steps(self._steps, cuts, assignments)
        who = assignments.select("chrom", F.col("founder").alias("copy")).distinct()
        rows = walk.copy_chunks(who, self.chunks, steps, "who", F.array_contains, aligned=aligned)
        rows = self._labelled(rows, F.col("copy") + 1, founder_name(F.col("copy")), [founder_name(F.col("copy"))], chromosome)
        return self._ref(aligned, chromosome).unionByName(rows) if reference else rows

    def founders(self, n: int, *, min_distance: int = 0, keep_ref: bool = False, cuts: DataFrame | None = None, **how) -> DataFrame:
        cuts = self.cut_positions(min_distance) if cuts is None else cuts
        return self.founder_rows(cuts, self.match(cuts, n, keep_ref=keep_ref), **how)

    def extract(self, bed: DataFrame, msa: DataFrame) -> DataFrame:
        """Regions of an aligned msa."""
        at = self.chunks.select("chrom", "chunk_no", "aln")
        return regions.extract_regions(bed, self.nodes, msa.join(at, ["chrom", "chunk_no"]))
