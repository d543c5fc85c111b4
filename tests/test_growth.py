"""Steps whose tasks must not grow with the input: parts of files, ranges, buckets, stretches."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandloom.functions import storage
from strandloom.operators import incidence, paths, segments
from strandloom.plans import derived
from strandloom.sources import datasource, readers

HEAD = "##fileformat=VCFv4.3\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\n"


def test_a_folder_of_parts_is_one_file(spark, tmp_path):
    lines = [f"{1 + i // 20}\t{i + 1}\tv{i}\tA\tC\t.\tPASS\t.\tGT\t0|1\n" for i in range(40)]
    for name in ("vcf", "fa"):
        (tmp_path / name).mkdir()
    for k in range(4):
        (tmp_path / f"vcf/part-{k}.txt").write_text((HEAD if not k else "") + "".join(lines[k * 10 : k * 10 + 10]))
        (tmp_path / f"fa/part-{k}.txt").write_text((">a\n" if not k else "") + "ACGT" * (k + 1) + "\n" + (">b\nTT\n" if k == 2 else ""))
    want = [(3 + i, f"v{i}") for i in range(40)]
    for rows in (readers.read_vcf(spark, str(tmp_path / "vcf"))[0], datasource.vcf_records(spark, str(tmp_path / "vcf"), split=90)):
        assert sorted((r.lineno, r.ids[0]) for r in rows.collect()) == want
    for record, text in (("a", "ACGT" * 6), ("b", "TT" + "ACGT" * 4)):
        chunks = readers.read_fasta(spark, str(tmp_path / "fa"), record=record, chunk=8).orderBy("chunk_no").collect()
        assert "".join(r.bases for r in chunks) == text


def test_derived_files_are_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(derived, "_kept", {})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = derived.vcf_file(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(datasource.data_files(path)) > 1


def test_scans_have_a_bounded_number_of_tasks(tmp_path):
    (tmp_path / "x").write_text("".join(f"{i}\n" for i in range(5000)))
    for split in (10, 1000):
        tasks = datasource.VcfReader({"path": str(tmp_path / "x"), "split": split}).partitions()
        assert len(tasks) <= datasource.TASKS
        lines = [line for t in tasks for part in t.parts for line in datasource.lines_of(str(tmp_path / "x"), part)]
        assert lines == [str(i).encode() for i in range(5000)]


def test_parts_of_the_carried_alleles_follow_the_input(spark, monkeypatch):
    few = derived.genotypes(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(storage, "PART_BYTES", 1000)
    many = derived.genotypes(spark, "/root/testdata/sf0.001")
    assert many.rdd.getNumPartitions() > few.rdd.getNumPartitions() and sorted(many.collect()) == sorted(few.collect())


def test_overlaps_are_found_across_buckets(spark):
    rng = random.Random(3)
    rows = [("1", c, e, e * 2, e * 2 + rng.randint(1, 9), e // 3) for c in range(3) for e in sorted(rng.sample(range(65_000, 66_000), 300))]
    table = spark.createDataFrame(rows, "chrom string, copy int, edge long, src_pos long, tgt_pos long, variant_idx long")
    want = [b for a, b in zip(rows, rows[1:], strict=False) if a[1] == b[1] and a[4] > b[3]]
    got = paths.overlaps(table)
    assert sorted(map(tuple, got.collect())) == sorted(want) and "_bucket" in got._jdf.queryExecution().executedPlan().toString()


def test_classes_in_two_levels_equal_one(spark, monkeypatch):
    monkeypatch.setattr(segments, "RANKED", 3)
    rng = random.Random(5)
    rows = [("1", c, e) for c in range(30) for e in range(24) if rng.random() < (0.06 if c % 2 else 0.3)]
    copies = spark.createDataFrame([("1", c) for c in range(40)], "chrom string, copy int")
    words = incidence.edge_words(spark.createDataFrame(rows, "chrom string, copy int, edge long"), copies)
    blocks = spark.range(24).select(F.lit("1").alias("chrom"), F.col("id").alias("edge"), F.expr("cast(id div 12 as int)").alias("block"))
    want = segments.colex_ranks(segments.block_signatures(words, blocks), copies).select("chrom", "block", "copy", "cls")
    got = segments.carrier_classes(words, blocks, copies)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_classes_are_ranked_without_a_row_for_each_carrier(spark):
    rng = random.Random(6)
    sets = [{e for e in range(300) if rng.random() < 0.05} for _ in range(30)] + [set()]
    carried = {c: rng.choice(sets) for c in range(70)}
    copies = spark.createDataFrame([("1", c) for c in carried], "chrom string, copy int")
    words = incidence.edge_words(spark.createDataFrame([("1", c, e) for c, own in carried.items() for e in own], "chrom string, copy int, edge long"), copies)
    blocks = spark.range(300).select(F.lit("1").alias("chrom"), F.col("id").alias("edge"), F.expr("cast(if(id < 9, 0, 1) as int)").alias("block"))
    want = segments.colex_ranks(segments.block_signatures(words, blocks), copies).select("chrom", "block", "copy", "cls")
    got = segments.carrier_classes(words, blocks, copies)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert "Generate explode" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_bases_of_the_derived_reference_follow_their_formula(spark):
    base = lambda c, p: "ACGT"[(7 * p + 3 * c + p // 5) % 4]
    rows = derived.reference(spark, "/root/testdata/sf0.001", 64).collect()
    assert all(r.bases == "".join(base(r.chrom, r.start + i) for i in range(len(r.bases))) for r in rows) and {len(r.bases) for r in rows if r.start == 0} == {64}
    records = derived.variants(spark, "/root/testdata/sf0.001").collect()
    assert all(r.ref == "".join(base(r.chrom, r.pos + i) for i in range(len(r.ref))) for r in records) and {len(r.ref) for r in records} == set(range(1, 9))
    assert "transform(sequence(" not in derived.reference(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_a_region_over_a_chunk_border_that_is_asked_for_twice_has_its_text_once(spark):
    from strandloom.operators import regions

    msa = spark.createDataFrame([("1", 0, 0, 0, "AC-G"), ("1", 0, 1, 4, "T-TA")], "chrom string, seq_id int, chunk_no long, aln long, text string")
    starts = spark.createDataFrame([("1", "r", 1, 4, 1, 0)] * 2 + [("1", "s", 0, 2, 0, 0), ("1", "t", 4, 9, 6, 1)], "chrom string, name string, start long, end long, aln_start long, chunk_no long")
    rows = sorted((r.name, r.text) for r in regions._extracted(starts, msa, 2).collect())
    assert rows == [("r", "CGT"), ("r", "CGT"), ("s", "AC"), ("t", "TA")]


def test_regions_of_a_chunk_meet_its_text_in_lists_of_bounded_size(spark, monkeypatch):
    from strandloom.operators import regions

    for name, value in (("ASKED", 7), ("CUT_BYTES", 40), ("CUT_ROWS", 5)):
        monkeypatch.setattr(regions, name, value)
    rng = random.Random(7)
    chunks = ["".join(rng.choice("ACGTé-") for _ in range(rng.choice((0, 3, 30)))) for _ in range(12)]
    other = ["".join(rng.choice("AC-") for _ in t) for t in chunks]
    alns = [sum(map(len, chunks[:i])) for i in range(13)]
    rows = [("1", s, i, alns[i], t) for s, own in (("a", chunks), ("b", other)) for i, t in enumerate(own)]
    msa = spark.createDataFrame(rows, "chrom string, seq_id string, chunk_no long, aln long, text string")
    bare = "".join(chunks).replace("-", "")
    bed = [("1", f"r{i}", start, start + rng.choice((-1, 0, 1, 5, 40, 500))) for i, start in enumerate(rng.choices(range(len(bare) + 3), k=60))]
    aligned = msa.where("seq_id = 'a'").drop("seq_id")
    starts = regions.starts_in_text(spark.createDataFrame(bed, "chrom string, name string, start long, end long"), aligned, bucket=16)
    at = [i for i, c in enumerate("".join(chunks)) if c != "-"]
    want = {(n, s): "".join(own)[at[lo] :].replace("-", "")[: max(hi - lo, 0)] for _, n, lo, hi in bed if lo < len(at) for s, own in (("a", chunks), ("b", other))}
    got = [(r.name, r.seq_id, r.text) for r in regions._extracted(starts, msa, 16).collect()]
    assert len(got) == len(want) and {(n, s): t for n, s, t in got} == want
    text = regions.Filled(pa.array(["", "A-éC", "--", "GT-A"]))
    lo, hi = [0, 2, 2, 3, 6, 0], [3, 6, 2, 4, 6, 6]
    parts = [(i, j, t.to_pylist()) for i, j, t in text.cut(np.array(lo), np.array(hi))]
    assert [t for *_, own in parts for t in own] == ["AéCGTA"[a:b] for a, b in zip(lo, hi, strict=True)] and [p[:2] for p in parts] == [(0, 5), (5, 6)]
    listed = regions._listed(starts, "aln_start", F.struct("name"))
    assert listed.agg(F.max(F.size("asked"))).first()[0] == 7 and listed.count() < starts.count() / 2


def test_starts_of_regions_are_found_without_pairs_of_starts_and_nodes(spark):
    from strandloom.operators import regions

    nodes = [("1", 0, 0, True, 0, 0), ("1", 1, 3, False, 1, 4), ("1", 2, 5, True, 1, 9), ("1", 3, 40, True, 2, 50)]
    nodes = spark.createDataFrame(nodes, "chrom string, node long, ref_pos long, is_bridge boolean, bubble long, aln_pos long")
    bed = spark.createDataFrame([("1", x, f"r{x}") for x in (-1, 0, 2, 3, 4, 5, 39, 40, 41)] + [("2", 1, "none")], "chrom string, start long, name string")
    got = regions.region_starts(bed, nodes, bubbles=1, bucket=4)
    assert [tuple(r) for r in got.select("start", "aln_start", "chunk_no").orderBy("start").collect()] == [(0, 0, 0), (2, 2, 0), (3, 4, 0), (4, 5, 0), (5, 9, 1), (39, 43, 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "start#" in line]


def test_a_walk_is_told_from_carried_edges_in_one_fold(spark):
    from strandloom.operators import walk

    chunks = spark.createDataFrame([("1", 0, 0, 10, 5, "AC--GT", "ACGT", [10, 11, 14, 15, 16])], "chrom string, chunk_no long, base long, aln long, lo long, text string, plain string, alns array<long>")
    held = [("1", 1, 0, 0, 2, 5, 7, "T", [0b011]), ("1", 1, 1, 1, 3, 6, 8, "GGG", [0b110]), ("1", 1, 2, 2, 3, 7, 8, "", [0b001])]
    steps = spark.createDataFrame(held, "chrom string, bubble long, edge long, src long, dst long, src_pos long, tgt_pos long, label string, words array<long>")
    copies = spark.createDataFrame([("1", c) for c in range(4)], "chrom string, copy int")
    for aligned, want in ((True, ["T----T", "T---GT", "AGGG-T", "AC--GT"]), (False, ["TT", "TGT", "AGGGT", "ACGT"])):
        rows = walk.copy_chunks(copies, chunks, steps, "words", incidence.carries, aligned=aligned)
        assert [r.text for r in rows.orderBy("copy").collect()] == want
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression") == 1 and "exists(" not in plan


def test_walks_of_many_chunks_and_some_copies_equal_those_of_each(spark):
    from strandloom.operators import walk

    rng, chunks, steps, want = random.Random(4), [], [], {}
    for c in range(6):
        alns = sorted(rng.sample(range(100 * c, 100 * c + 60), 9))
        text = "".join(rng.choice("ACGé") for _ in range(alns[-1] - alns[0]))
        chunks.append(("1", c, 10 * c, alns[0], 0, text, text, alns))
        own = []
        for e in range(0 if c == 3 else 12):
            src = rng.randrange(8)
            dst = rng.randrange(src + 1, 9)
            label = "".join(rng.choice("TÜ") for _ in range(rng.randrange(alns[dst] - alns[src] + 1)))
            own.append((10 * c + src, e, 10 * c + dst, label, rng.getrandbits(63), rng.getrandbits(7)))
        steps += [("1", 64 * c + 1, e, s, d, 0, 0, t, [low, high]) for s, e, d, t, low, high in own]
        for copy in range(71):
            out, end, at = "", 0, 0
            for s, _, d, t, low, high in sorted(own):
                if (low | high << 64) >> copy & 1 and s >= end:
                    lo, hi = alns[s - 10 * c] - alns[0], alns[d - 10 * c] - alns[0]
                    out, end, at = out + text[at:lo] + t.ljust(hi - lo, "-"), d, hi
            want[c, copy] = out + text[at:]
    table = spark.createDataFrame(chunks, "chrom string, chunk_no long, base long, aln long, lo long, text string, plain string, alns array<long>")
    held = spark.createDataFrame(steps, "chrom string, bubble long, edge long, src long, dst long, src_pos long, tgt_pos long, label string, words array<long>")
    copies = spark.createDataFrame([("1", c) for c in range(71)], "chrom string, copy int")
    rows = walk.copy_chunks(copies, table, held, "words", incidence.carries)
    assert {(r.chunk_no, r.copy): r.text for r in rows.collect()} == want and "MapInArrow" in rows._jdf.queryExecution().optimizedPlan().toString()
    at = [(c[2], [x for x in steps if x[1] == 64 * c[1] + 1]) for c in chunks]
    fields = ("src", "edge", "dst", "src_pos", "tgt_pos", "label", "held")
    lists = [[dict(zip(fields, (x[3], x[2], x[4], x[5], x[6], x[7], x[8]), strict=True)) for x in own] or None for _, own in at]
    whole = pa.RecordBatch.from_pydict({"chrom": ["1"] * 6, "chunk_no": range(6), "base": [c[2] for c in chunks], "origin": [c[3] for c in chunks], "whole": [c[5] for c in chunks], "alns": [c[7] for c in chunks], "steps": lists, "size": [71] * 6})
    got = walk._walk(whole.slice(2, 3), 60, 80, walk._PAIRS[incidence.carries], True).to_pylist()
    assert {(r["chunk_no"], r["copy"]): r["text"] for r in got} == {k: t for k, t in want.items() if 2 <= k[0] < 5 and k[1] >= 60}


def test_carried_edges_meet_chunks_and_founders_once(spark):
    from strandloom.plans import queries

    graph = derived.graph(spark, "/root/testdata/sf0.001")
    cuts = queries._fixed_cuts(graph)
    assigned = graph.match(cuts, 2)
    for rows in (graph.copy_texts(False), graph.founder_rows(cuts, assigned, reference=False)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Join" in line and "edge#" in line]


def test_parts_of_the_build_follow_the_input(spark, monkeypatch):
    from strandloom.operators import graph as g

    v = derived.variants(spark, "/root/testdata/sf0.001")
    lengths = g.reference_lengths(derived.reference(spark, "/root/testdata/sf0.001"))
    few = g.marked_sites(g.sites(v), lengths, v)
    monkeypatch.setattr(storage, "PART_BYTES", 1000)
    monkeypatch.setattr(g, "BUCKET", 256)
    many = g.marked_sites(g.sites(v), lengths, v)
    parts = lambda df: max(int(line.rsplit(", ", 1)[1]) for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line)
    assert parts(many) > parts(few) and sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
