"""Readers, writers, sample lists, command line, properties, and every query with SQL on the smallest tables."""

import os
import random
import stat
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom import cli, extract
from strandloom.functions.prefix import prefix_scan
from strandloom.functions.storage import materialise
from strandloom.operators import graph as g
from strandloom.operators import matching, paths, segments, sinks
from strandloom.plans import derived
from strandloom.plans import queries as core
from strandloom.plans.graph import Graph
from strandloom.sources import readers
from strandloom.streaming import ingest

from .golden import FOUNDERS, GRAPHS, write_case
from .test_founders import PrefixSort, best_cuts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def rows_of(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple("" if pd.isna(x) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(core.SQL))
def test_query_matches_sql(spark, duck, name):
    got = core.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", [n for n in core.QUERIES if n not in core.SQL])
def test_query_without_sql_runs(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_regions_of_all_records_and_copies(spark):
    graph = derived.graph(spark, SF)
    texts, at = {}, {(r.chrom, r.ref_pos): r.aln_pos for r in graph.nodes.collect()}
    for r in graph.copy_texts().orderBy("chunk_no").collect():
        texts[r.chrom, r.copy] = texts.get((r.chrom, r.copy), "") + r.text
    records = derived.variants(spark, SF).select("chrom", "variant_idx", "pos").collect()
    want = {(r.chrom, f"r{r.variant_idx}", copy, t[at[r.chrom, r.pos] :].replace("-", "")[:20]) for r in records for (chrom, copy), t in texts.items() if chrom == r.chrom}
    got = [tuple(r) for r in core.region_extract(spark, SF).collect()]
    assert len(texts) == 100 and len(got) == len(want) == 20 * len(records) and set(got) == want


def test_prefix_scan_equals_plain_running_values(spark):
    rows = [(c, i, random.Random(i * 7 + c).randrange(100)) for c in range(2) for i in range(300)]
    df = spark.createDataFrame(rows, "c int, i int, v int")
    specs = [("s", "sum", F.col("v")), ("m", "max", F.col("v")), ("n", "count", F.lit(1))]
    for inclusive in (True, False):
        got = {(r.c, r.i): (r.s, r.m, r.n) for r in prefix_scan(df, ["c"], ["i"], F.expr("i div 37"), specs, inclusive=inclusive).collect()}
        for c in range(2):
            seen = []
            for i in range(300):
                v = rows[c * 300 + i][2]
                part = seen + [v] if inclusive else list(seen)
                assert got[c, i] == (sum(part), max(part) if part else None, len(part))
                seen.append(v)


def test_haplotypes_equal_naive_edits(spark, tmp_path):
    bases, records, *_ = FOUNDERS["1"]
    g1 = Graph.from_files(spark, *write_case(tmp_path, bases, records), "1")
    aligned = {r.seq_id: r.text for r in g1.haplotypes().orderBy("seq_no", "chunk_no").collect()}
    plain = {r.seq_id: r.text for r in g1.haplotypes(aligned=False).collect()}
    assert len({len(t) for t in aligned.values()}) == 1
    assert aligned["REF"].replace("-", "") == bases == plain["REF"]
    for i in range(14):
        text, shift = bases, 0
        for _, pos, ref, alt, gt in records:
            if gt[i] != "0":
                a = alt.split(",")[int(gt[i]) - 1]
                text = text[: pos - 1 + shift] + a + text[pos - 1 + shift + len(ref) :]
                shift += len(a) - len(ref)
        assert aligned[f"SAMPLE{i + 1}-1"].replace("-", "") == text == plain[f"SAMPLE{i + 1}-1"]


def test_sample_lists_save_and_load(spark, tmp_path):
    bases, _, records, *_ = GRAPHS["1a"]
    fa, vcf = write_case(tmp_path, bases, records)
    (tmp_path / "list.tsv").write_text("1\tSAMPLE2\t0\n1\tSAMPLE3\t0\n1\tSAMPLE3\t1\n2\tSAMPLE1\t0\n")
    inc = Graph.from_files(spark, fa, vcf, "1", include=str(tmp_path / "list.tsv"))
    assert [(r.name, r.copy_idx, r.copy, r.copy_in_sample) for r in inc.copies.orderBy("copy").collect()] == [("SAMPLE2", 0, 0, 0), ("SAMPLE3", 0, 1, 0), ("SAMPLE3", 1, 2, 1)]
    exc = Graph.from_files(spark, fa, vcf, "1", exclude=str(tmp_path / "list.tsv"))
    assert [(r.name, r.copy_idx, r.copy_in_sample) for r in exc.copies.orderBy("copy").collect()] == [("SAMPLE1", 0, 0), ("SAMPLE1", 1, 1), ("SAMPLE2", 1, 0), ("SAMPLE4", 0, 0), ("SAMPLE4", 1, 1)]
    odd = Graph.from_files(spark, fa, vcf, "1", keep=(F.col("name") == "SAMPLE2") & (F.col("copy_idx") == 1))
    assert [(r.name, r.copy_idx, r.copy) for r in odd.copies.collect()] == [("SAMPLE2", 1, 0)]
    exc.save(str(tmp_path / "graph"))
    back = Graph.load(spark, str(tmp_path / "graph"), exc.reference)
    key = lambda x: sorted((r.seq_id, r.chunk_no, r.text) for r in x.haplotypes().collect())
    assert key(back) == key(exc)
    assert back.statistics().collect()[0]["copies"] == 5


def test_command_line_outputs(spark, tmp_path):
    bases, records, _, _, rows = FOUNDERS["1"]
    fa, vcf = write_case(tmp_path, bases, records)
    pipe = tmp_path / "pipe.sh"
    pipe.write_text('#!/bin/sh\ncat > "$1.piped"\n')
    pipe.chmod(pipe.stat().st_mode | stat.S_IEXEC)
    base = ["--input-reference", fa, "--input-variants", vcf, "--chromosome", "1"]
    cli.main([*base, "--founder-sequences", "2", "--output-sequences-a2m", str(tmp_path / "f.a2m"), "--output-cut-positions", str(tmp_path / "cuts"), "--output-graphviz", str(tmp_path / "g.dot"), "--output-overlaps", str(tmp_path / "o.tsv")], spark)
    assert (tmp_path / "f.a2m").read_text().split("\n")[1::2] == rows
    assert "penwidth = 2.0" in (tmp_path / "g.dot").read_text()
    cli.main([*base, "--founder-sequences", "2", "--input-cut-positions", str(tmp_path / "cuts"), "--output-sequences-separate", str(tmp_path / "sep"), "--dst-chromosome", "x", "--omit-reference"], spark)
    assert (tmp_path / "sep/x.1.a2m").read_text() == f">x\t1\n{rows[1]}\n" and not (tmp_path / "sep/x.REF.a2m").exists()
    cli.main([*base, "--haplotypes", "--unaligned", "--separate-output-format", "plain", "--output-sequences-separate", str(tmp_path / "plain")], spark)
    assert (tmp_path / "plain/REF").read_text() == bases + "\n"
    cli.main([*base, "--haplotypes", "--output-sequences-a2m", str(tmp_path / "h"), "--pipe", str(pipe)], spark)
    assert (tmp_path / "h.piped").read_text().startswith(">REF\n" + rows[0] + "\n>SAMPLE1-1\n")
    with pytest.raises(SystemExit):
        cli.main([*base, "--founder-sequences", "0"], spark)


def two_chromosomes(spark, tmp_path):
    """Graphs of founders' case 1 on chromosomes X and Y, the second in lower case, as one graph."""
    bases, records, *_ = FOUNDERS["1"]
    parts = []
    for chrom, text in (("X", bases), ("Y", bases.lower())):
        (tmp_path / chrom).mkdir()
        fa, vcf = write_case(tmp_path / chrom, text, records)
        (tmp_path / chrom / "x.vcf").write_text((tmp_path / chrom / "x.vcf").read_text().replace("\n1\t", f"\n{chrom}\t"))
        parts.append(Graph.from_files(spark, fa, vcf, chrom, chunk=4))
    both = {n: getattr(parts[0], n).unionByName(getattr(parts[1], n)) for n in ("reference", *Graph.TABLES)}
    return parts, Graph(**both, chunk=4)


def test_chromosomes_stay_apart(spark, tmp_path):
    parts, both = two_chromosomes(spark, tmp_path)
    want = ""
    for p, chrom in zip(parts, "XY"):
        texts = {}
        for r in p.haplotypes().orderBy("seq_no", "chunk_no").collect():
            texts[r.seq_id] = texts.get(r.seq_id, "") + r.text
        want += "".join(f">{chrom}\t{k}\n{v}\n" for k, v in texts.items())
    sinks.write_a2m(both.haplotypes(), str(tmp_path / "both.a2m"))
    assert (tmp_path / "both.a2m").read_text() == want
    sinks.write_a2m_parts(both.haplotypes(), str(tmp_path / "parts"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "parts").glob("part-*")))
    bare = lambda t: [h.split("\n")[0] + "".join(h.split("\n")[1:]) for h in t.split(">")[1:]]
    assert bare(text) == bare(want)
    files = {r.file for r in sinks.write_separate(both.haplotypes(), str(tmp_path / "sep")).collect()}
    assert len(files) == 30 and {p.name for p in (tmp_path / "sep").iterdir()} == {os.path.basename(f) for f in files}
    assert (tmp_path / "sep/Y.REF.a2m").read_text().startswith(">Y\tREF\n")
    with pytest.raises(ValueError, match="one chromosome"):
        sinks.write_graphviz(both.graphviz(), str(tmp_path / "x.dot"))
    # a saved graph of chromosome X is read under its own name, and of several only the chosen one
    both.save(str(tmp_path / "graph"))
    cli.main(["--input-reference", str(tmp_path / "Y/x.fa"), "--input-graph", str(tmp_path / "graph"), "--chromosome", "Y", "--haplotypes", "--output-sequences-a2m", str(tmp_path / "y.a2m")], spark)
    assert (tmp_path / "y.a2m").read_text() == want[want.index(">Y") :].replace(">Y\t", ">")
    parts[0].save(str(tmp_path / "one"))
    cli.main(["--input-reference", str(tmp_path / "X/x.fa"), "--input-graph", str(tmp_path / "one"), "--haplotypes", "--output-sequences-a2m", str(tmp_path / "x.a2m")], spark)
    assert (tmp_path / "x.a2m").read_text() == want[: want.index(">Y")].replace(">X\t", ">")
    for bad in ([], ["--chromosome", "Z"]):
        with pytest.raises(SystemExit):
            cli.main(["--input-reference", str(tmp_path / "X/x.fa"), "--input-graph", str(tmp_path / "graph"), *bad], spark)


def test_mismatches_are_reported_and_counted(spark, tmp_path, caplog):
    fa, vcf = write_case(tmp_path, "ACGTACGT", [("x", 2, "G", "T", ["1"]), ("y", 5, "A", "C", ["0"])])
    (tmp_path / "x.vcf").write_text((tmp_path / "x.vcf").read_text() + "2\t1\tz\tA\tC\t.\tPASS\t.\tGT\t1\n")
    got = Graph.from_files(spark, fa, vcf, "1")
    assert got.stats == {"handled": 2, "chrom_mismatches": 1, "ref_mismatches": 1}
    assert [(r.pos, r.ref, r.expected) for r in got.mismatches.collect()] == [(1, "G", "C")]
    assert "position 2, REF 'G', expected 'C'" in caplog.text


def test_verbose_statistics_and_overlap_sentences(spark, tmp_path, capsys):
    bases, _, records, *_ = GRAPHS["1a"]
    fa, vcf = write_case(tmp_path, bases, records)
    cli.main(["--input-reference", fa, "--input-variants", vcf, "--chromosome", "1", "--output-memory-breakdown", str(tmp_path / "sizes"), "--output-graph-statistics", "--verbose", "--show-invocation"], spark)
    out = capsys.readouterr()
    assert "Line number: 7 current variant position: 9 variant identifiers: a5 sample: SAMPLE2 chromosome copy: 0 genotype: 1" in out.out
    assert "--verbose" in out.err
    rows = [x.split("\t") for x in (tmp_path / "sizes").read_text().splitlines()]
    assert [r[0] for r in rows] == ["reference", "nodes", "edges", "paths", "copies"] and rows[1][1] == "11" and all(int(r[2]) > 0 for r in rows)


def test_cut_positions_of_another_graph_are_refused(spark, tmp_path):
    bases, records, cuts, *_ = FOUNDERS["1"]
    g1 = Graph.from_files(spark, *write_case(tmp_path, bases, records), "1")
    g1.cut_positions().write.json(str(tmp_path / "cuts"))
    back = g1.load_cuts(str(tmp_path / "cuts"))
    assert [r.node for r in back.orderBy("cut_idx").collect()] == cuts and {r.min_distance for r in back.collect()} == {0}
    for bad in ([1, 3, 5], [0, 3], [0, 99]):
        with pytest.raises(ValueError, match="not of this graph"):
            g1.check_cuts(spark.createDataFrame([("1", i, n, 1, 0) for i, n in enumerate(bad)], "chrom string, cut_idx int, node long, score long, min_distance long"))


def test_extraction_from_files(spark, tmp_path):
    rng = random.Random(4)
    ref = "".join(rng.choice("ACGT-") for _ in range(500))
    rows = {f"s{i}": "".join(rng.choice("ACGT--") for _ in range(500)) for i in range(4)}
    (tmp_path / "ref").write_text(ref + "\n")
    (tmp_path / "a.a2m").write_text("".join(f">{k}\n{v}\n" for k, v in list(rows.items())[:3]))
    (tmp_path / "plain").write_text(rows["s3"] + "\n")
    n = len(ref.replace("-", ""))
    bed = [(0, 20, "r0"), (37, 90, "r1"), (n - 5, n, "r2"), (100, 100, "r3"), (n + 3, n + 9, "r4"), (5, n, "r5")]
    (tmp_path / "x.bed").write_text("".join(f"any\t{a}\t{b}\t{name}\t0\t+\n" for a, b, name in bed))
    sources = [str(tmp_path / "a.a2m"), str(tmp_path / "plain")]
    want = {}
    for a, b, name in bed:
        at = [i for i, c in enumerate(ref) if c != "-"]
        if a < len(at):
            want[name] = "".join(f">{k if k != 's3' else sources[1]}\n{v[at[a]:].replace('-', '')[: b - a]}\n" for k, v in rows.items())
    for chunk in (64, 4096):
        got = {}
        for r in extract.from_files(spark, str(tmp_path / "ref"), str(tmp_path / "x.bed"), sources, chunk=chunk).orderBy("name", "seq_no").collect():
            got[r.name] = got.get(r.name, "") + f">{r.seq_id}\n{r.text}\n"
        assert got == want
    args = ["--aligned-reference", str(tmp_path / "ref"), "--extracted-co-ordinates", str(tmp_path / "x.bed"), "--output-folder", str(tmp_path / "out"), *sources]
    extract.main(args, spark)
    assert {p.stem: p.read_text() for p in (tmp_path / "out").iterdir()} == want
    with pytest.raises(Exception, match="FileExistsError"):
        extract.main(args, spark)


def test_founder_queries_equal_brute_force(spark):
    """Cut positions by the stated rule over all pairs of candidates, and rows joined from the copies' texts (assignments: test_founders)."""
    graph = derived.graph(spark, SF)
    carriers, aln = {}, {(r.chrom, r.node): r.aln_pos for r in graph.nodes.collect()}
    for r in graph.paths.collect():
        carriers.setdefault((r.chrom, r.edge), set()).add(r.copy)
    candidates = {}
    for r in core.cut_candidates(spark, SF).collect():
        candidates.setdefault(r.chrom, []).append((r.node, r.first_edge, r.aln_pos))
    sinks_ = {r.chrom: r.n for r in graph.nodes.groupBy("chrom").agg(F.max("node").alias("n")).collect()}
    for distance, query in ((0, core.cut_positions), (50, core.cut_positions_distance_50)):
        cuts = {}
        for r in query(spark, SF).orderBy("cut_idx").collect():
            cuts.setdefault(r.chrom, []).append((r.node, r.score))
        for chrom, own in candidates.items():
            own = sorted(own)
            score, prev = [0] + [20] * (len(own) - 1), [None] * len(own)
            for j in range(1, len(own)):
                seen, heights = [frozenset()] * 20, {}
                for i in range(j - 1, -1, -1):
                    for e in range(own[i][1], own[i + 1][1]):
                        for c in carriers.get((chrom, e), ()):
                            seen[c] = seen[c] | {e}
                    heights[len(set(seen))] = i  # the leftmost start of each number of classes
                for h in sorted(heights):
                    i = heights[h]
                    if own[j][2] - own[i][2] >= distance and max(h, score[i]) < score[j]:
                        score[j], prev[j] = max(h, score[i]), i
            want, at = [], len(own) - 1
            while at is not None:
                want.append(own[at][0])
                at = prev[at]
            want = [0] * (want[-1] != 0) + want[::-1]
            want[-1] = sinks_[chrom]
            assert cuts[chrom] == [(n, score[-1]) for n in want]
    texts = {}
    for r in graph.copy_texts().orderBy("chunk_no").collect():
        texts[r.chrom, r.copy] = texts.get((r.chrom, r.copy), "") + r.text
    for r in graph._ref(True, None).orderBy("chunk_no").collect():
        texts[r.chrom, None] = texts.get((r.chrom, None), "") + r.text
    cuts = core._fixed_cuts(graph)
    assigned = core.founder_assignments(spark, SF)
    nodes = {}
    for r in cuts.collect():
        nodes.setdefault(r.chrom, []).append(r.node)
    want = {}
    for r in assigned.orderBy("block").collect():
        own = sorted(nodes[r.chrom])
        lo, hi = aln[r.chrom, own[r.block]], aln[r.chrom, own[r.block + 1]]
        want[r.chrom, r.founder] = want.get((r.chrom, r.founder), "") + texts[r.chrom, r.copy][lo:hi]
    got = {}
    for r in graph.founder_rows(cuts, assigned, reference=False).orderBy("chunk_no").collect():
        got[r.chrom, r.seq_no - 1] = got.get((r.chrom, r.seq_no - 1), "") + r.text
    assert got == want and len(got) == 5 * core.FOUNDERS


def test_bad_input_is_refused(spark, tmp_path):
    fa, vcf = write_case(tmp_path, "ACGTACGT", [("x", 5, "A", "G", ["1"]), ("y", 2, "C", "T", ["0"])])
    with pytest.raises(ValueError, match="sorted"):
        Graph.from_files(spark, fa, vcf, "1")
    fa, vcf = write_case(tmp_path, "ACGTACGT", [("x", 2, "G", "T", ["1"])])
    with pytest.raises(ValueError, match="REF"):
        Graph.from_files(spark, fa, vcf, "1", on_mismatch="error")
    fa, vcf = write_case(tmp_path, "ACGT", [("x", 3, "GTT", "T", ["1"])])
    with pytest.raises(ValueError, match="past the end"):
        Graph.from_files(spark, fa, vcf, "1")
    (tmp_path / "x.vcf").write_text((tmp_path / "x.vcf").read_text().replace("\tGT\t", "\tDP\t"))
    with pytest.raises(Exception, match="no GT"):
        Graph.from_files(spark, fa, vcf, "1")


def test_fasta_chunks_and_line_numbers(spark, tmp_path):
    text = "".join(random.Random(3).choice("ACGTacgt") for _ in range(1000))
    (tmp_path / "x.fa").write_text(">one two\n" + text[:10] + "\n" + text[10:600] + "\n\n" + text[600:] + "\n>other\nGG\n")
    rows = readers.read_fasta(spark, str(tmp_path / "x.fa"), chunk=128).orderBy("chunk_no").collect()
    assert "".join(r.bases for r in rows) == text and {r.chrom for r in rows} == {"one"} and [r.start for r in rows] == list(range(0, 1000, 128))
    assert readers.read_fasta(spark, str(tmp_path / "x.fa"), record="other").collect()[0].bases == "GG"
    with pytest.raises(ValueError):
        readers.read_fasta(spark, str(tmp_path / "x.fa"), record="none")


def test_long_bubbles_fold_alike(spark, tmp_path):
    bases, _, records, nodes, *_ = GRAPHS["4"]
    g1 = Graph.from_files(spark, *write_case(tmp_path, bases, records), "1")
    again = g.align_nodes(g1.nodes.drop("aln_pos"), g1.edges, long_bubble=1)
    assert [(r.ref_pos, r.aln_pos) for r in again.orderBy("node").collect()] == nodes


def test_class_counts_equal_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        m, e = rng.randrange(2, 7), rng.randrange(1, 12)
        bits = [[rng.random() < 0.4 for _ in range(m)] for _ in range(e)]
        sort = PrefixSort(m)
        for j, row in enumerate(bits):
            sort.add(j, np.array(row))
            for i in range(j + 1):
                assert sort.classes_since(i) == len({tuple(bits[x][c] for x in range(i, j + 1)) for c in range(m)})
            key = {c: (sorted((x for x in range(j + 1) if bits[x][c]), reverse=True), c) for c in range(m)}
            assert sort.order.tolist() == sorted(range(m), key=key.get)
            whole = segments.stretch(np.array(bits[: j + 1]), np.arange(1, j + 2))
            assert whole.sorted(m)[0].tolist() == sort.order.tolist() and whole.sorted(m)[1][1:].tolist() == sort.since[1:].tolist()


def test_best_cuts_follow_the_rule():
    """Without a distance the score is the optimum; with one, the stated rule (leftmost start of each height) holds."""
    rng = random.Random(11)
    for _ in range(60):
        m, e = rng.randrange(2, 5), rng.randrange(1, 8)
        carriers = {x: [c for c in range(m) if rng.random() < 0.4] for x in range(e)}
        nodes = list(range(e + 1))
        classes = lambda a, b: len({tuple(c in carriers[x] for x in range(a, b)) for c in range(m)})  # noqa: B023, E731
        for distance in (0, 2):
            cuts, score = best_cuts(nodes, nodes, nodes, e, carriers, m, distance)
            best, rule = {0: 0}, {0: 0}
            for j in range(1, e + 1):
                best[j] = min([m] + [max(classes(i, j), best[i]) for i in range(j) if j - i >= distance])
                rule[j] = m
                for h in sorted({classes(i, j) for i in range(j)}):
                    i = min(i for i in range(j) if classes(i, j) == h)
                    if j - i >= distance and max(h, rule[i]) < rule[j]:
                        rule[j] = max(h, rule[i])
            assert score == rule[e] and cuts[0] == 0 and cuts[-1] == e
            if not distance:
                assert score == best[e]


def test_matching_hazards_end():
    assert matching.follow([([], 1, 1)], 2) == [[None, None], [None, None]]
    assert matching.follow([], 2) == []
    # a founder that starts in the reference stays there for a block, and may leave it after that
    assert matching.follow([([(4, 7)], 3, 1), ([(7, 9)], 1, 1)], 3) == [[4, None, None], [7, None, None], [9, 9, 9]]


def test_matching_rules():
    """Every class gets a founder while there is room, nobody is handed out twice, and extras go to the largest pairs in turn."""
    rng = random.Random(2)
    for _ in range(300):
        f, n, m = rng.randrange(1, 9), rng.randrange(1, 5), rng.randrange(1, 5)
        pairs = rng.sample([(a, 10 + b) for a in range(n) for b in range(m)], rng.randrange(1, n * m + 1))
        first, second = matching.follow([(pairs, n, m)], f)
        lefts, rights = [a for a, _ in pairs], [b for _, b in pairs]
        assert set(first) <= {*lefts, None} and set(second) <= {*rights, None}
        if f >= n:
            assert set(lefts) <= set(first)
        assert [c is None for c in first] == [c is None for c in second]
    # three founders for two classes: the extra one goes to the first pair that has founders on its left
    assert matching.grants([(1, 5), (2, 6)], Counter({1: 2, 2: 1}), 2, 3) == ([(1, 5), (2, 6), (1, 5)], [])
    assert matching.grants([(1, 5), (2, 6)], Counter({1: 3}), 2, 3) == ([(1, 5), (1, 5)], [6])


def test_streamed_paths_equal_batch(spark, tmp_path):
    graph = derived.graph(spark, SF)
    derived.genotypes(spark, SF).repartition(3).write.parquet(str(tmp_path / "in"))
    q = ingest.stream_paths(spark, str(tmp_path / "in"), graph.copies, graph.edges, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    rows = lambda df: Counter(tuple(r) for r in df.select("chrom", "copy", "edge", "src", "dst", "allele").collect())
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(graph.paths)


def test_graphviz_line_order(spark, tmp_path):
    bases, _, records, *_ = GRAPHS["2"]
    g1 = Graph.from_files(spark, *write_case(tmp_path, bases, records), "1")
    sinks.write_graphviz(g1.graphviz(), str(tmp_path / "x.dot"))
    lines = (tmp_path / "x.dot").read_text().splitlines()
    assert lines[0] == "digraph variants" and lines[-1] == "}" and sum("penwidth" in x for x in lines) == 4


def test_genotypes_are_never_the_broadcast_side(spark, tmp_path):
    bases, _, records, *_ = GRAPHS["1b"]
    _, vcf = write_case(tmp_path, bases, records)
    file = readers.VcfFile(spark, vcf)
    calls = readers.genotypes(materialise(file.records("1")[0], "records"))
    listed = spark.createDataFrame([("1", "SAMPLE1", 0)], "chrom string, sample string, copy_idx int")
    for rows in (paths.chosen_genotypes(calls, file.names(), None), paths.chosen_genotypes(calls, file.names(), listed, exclude=True), paths.number_copies(paths.chosen_genotypes(calls, file.names(), None))):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan


def test_tables_that_grow_are_merged_whatever_their_size(spark):
    graph = derived.graph(spark, SF)
    for rows in (g.edge_counts(graph.nodes, graph.edges), paths.carried_edges(derived.genotypes(spark, SF), graph.copies, graph.edges)):
        assert "SortMergeJoin" in rows._jdf.queryExecution().executedPlan().toString()
