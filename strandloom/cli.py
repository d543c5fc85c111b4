"""Command line: a reference and variant calls (or a saved graph) to haplotype or founder alignments."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import sinks
from .operators.outputs import Listener, Output
from .plans.graph import Graph
from .sources import readers

log = logging.getLogger("strandloom")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom", description=__doc__)
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("--haplotypes", action="store_true", help="write every haplotype")
    mode.add_argument("--founder-sequences", type=int, metavar="N", help="write N founder sequences")
    p.add_argument("--minimum-distance", type=int)
    p.add_argument("--input-cut-positions")
    p.add_argument("--output-cut-positions")
    p.add_argument("--keep-ref-edges", action="store_true")
    p.add_argument("--input-reference", required=True)
    p.add_argument("--reference-sequence")
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--input-variants")
    source.add_argument("--input-graph")
    p.add_argument("--chromosome")
    p.add_argument("--output-sequences-a2m")
    p.add_argument("--output-sequences-separate", metavar="FOLDER")
    p.add_argument("--separate-output-format", choices=["A2M", "plain"], default="A2M")
    p.add_argument("--dst-chromosome")
    p.add_argument("--omit-reference", action="store_true")
    p.add_argument("--unaligned", action="store_true")
    p.add_argument("--pipe")
    p.add_argument("--output-graph")
    p.add_argument("--output-graphviz")
    p.add_argument("--output-overlaps")
    p.add_argument("--output-graph-statistics", action="store_true")
    p.add_argument("--output-memory-breakdown", metavar="FILE", help="rows and bytes of each table of the graph")
    p.add_argument("--output-sequences-parts", metavar="FOLDER", help="A2M as a folder of text files, written by all executors")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--show-invocation", action="store_true")
    p.add_argument("--ref-mismatch-handling", choices=["warning", "error"], default="warning")
    chosen = p.add_mutually_exclusive_group()
    chosen.add_argument("--include-samples")
    chosen.add_argument("--exclude-samples")
    return p


def check(a: argparse.Namespace, p: argparse.ArgumentParser) -> None:
    if a.input_variants and not a.chromosome:
        p.error("--chromosome is needed with --input-variants")
    if a.founder_sequences is not None and a.founder_sequences <= 0:
        p.error("--founder-sequences must be positive")
    if a.minimum_distance is not None and a.minimum_distance < 0:
        p.error("--minimum-distance can't be negative")
    if a.minimum_distance is not None and a.input_cut_positions:
        p.error("--minimum-distance and --input-cut-positions exclude each other")
    for name in ("output_graph", "output_overlaps"):
        if getattr(a, name) and a.input_graph:
            p.error(f"--{name.replace('_', '-')} needs --input-variants")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = parser()
    a = p.parse_args(argv)
    check(a, p)
    logging.basicConfig(stream=sys.stderr, format="%(asctime)s %(message)s")
    log.setLevel(logging.INFO if a.verbose else logging.WARNING)
    if a.show_invocation:
        print("Invocation:", " ".join(sys.argv if argv is None else ["strandloom", *argv]), file=sys.stderr)
    spark = spark or SparkSession.builder.appName("strandloom").getOrCreate()
    listener = Listener()
    if a.input_graph:
        saved = Graph.saved_chromosomes(spark, a.input_graph)
        if a.chromosome is None and len(saved) != 1:
            p.error(f"--chromosome is needed: the graph has {', '.join(saved)}")
        if a.chromosome is not None and a.chromosome not in saved:
            p.error(f"the graph has no chromosome {a.chromosome}")
        chrom = a.chromosome or saved[0]
        graph = Graph.load(spark, a.input_graph, readers.read_fasta(spark, a.input_reference, chrom, record=a.reference_sequence))
    else:
        graph = Graph.from_files(
            spark, a.input_reference, a.input_variants, a.chromosome, record=a.reference_sequence, include=a.include_samples, exclude=a.exclude_samples, on_mismatch="error" if a.ref_mismatch_handling == "error" else "warn", listener=listener
        )
        log.info("handled records: %s, of other chromosomes: %s, with another REF: %s", *(graph.stats.get(k) for k in ("handled", "chrom_mismatches", "ref_mismatches")))
        for r in graph.copies.orderBy("copy").toLocalIterator() if a.verbose and (a.include_samples or a.exclude_samples) else ():
            log.info("sample %s, chromosome copy %s", r["name"], r["copy_idx"])
        if not a.output_overlaps:
            for r in sinks.overlap_sentences(graph.overlap_report()).orderBy("LINENO", "SAMPLE", "CHROM_COPY").toLocalIterator():
                print(r["line"])
    if a.output_graph:
        graph.save(a.output_graph)
    if a.output_graphviz:
        sinks.write_graphviz(graph.graphviz(), a.output_graphviz)
    if a.output_overlaps:
        sinks.write_overlaps(graph.overlap_report(), a.output_overlaps)
    if a.output_graph_statistics:
        for r in graph.statistics().toLocalIterator():
            print(f"chromosome {r['chrom']}: {r['nodes']} nodes, {r['alt_edges']} ALT edges, {r['copies']} chromosome copies")
    if a.output_memory_breakdown:
        with open(a.output_memory_breakdown, "w") as out:
            out.writelines(f"{r['part']}\t{r['rows']}\t{r['bytes']}\n" for r in graph.sizes().collect())
    output = Output("haplotypes" if a.haplotypes else "founders", not a.unaligned, not a.omit_reference, a.dst_chromosome, a.pipe, listener)
    if a.haplotypes:
        msa = output.rows(graph)
    elif a.founder_sequences:
        if a.input_cut_positions:
            cuts = graph.load_cuts(a.input_cut_positions)
        else:
            cuts = graph.cut_positions(a.minimum_distance or 0, listener)
        top = cuts.agg(F.max("score")).first()[0]
        print(f"Maximum segmentation height: {'-' if top is None else top + 1}")
        if a.output_cut_positions:
            cuts.write.mode("overwrite").json(a.output_cut_positions)
        matched = graph.match(cuts, a.founder_sequences, keep_ref=a.keep_ref_edges)
        for r in cuts.orderBy("chrom", "cut_idx").toLocalIterator() if a.verbose else ():
            log.info("cut %s at node %s", r["cut_idx"], r["node"])
        for r in matched.orderBy("chrom", "block", "founder").toLocalIterator() if a.verbose else ():
            log.info("block %s, founder %s: %s", r["block"], r["founder"] + 1, "REF" if r["copy"] is None else f"copy {r['copy']}")
        msa = output.rows(graph, cuts=cuts, assignments=matched)
    else:
        return
    if a.output_sequences_a2m:
        output.a2m(msa, a.output_sequences_a2m)
    if a.output_sequences_parts:
        output.parts(msa, a.output_sequences_parts)
    if a.output_sequences_separate:
        output.separate(msa, a.output_sequences_separate, a2m=a.separate_output_format == "A2M")


if __name__ == "__main__":
    main()
