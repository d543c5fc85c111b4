"""Progress, listeners, output strategies, the parallel A2M writer, and the one parse of calls."""

import stat
import time

import pytest
from pyspark.sql import functions as F

from strandloom import cli
from strandloom.functions.progress import Counter, Records, watched
from strandloom.operators import outputs, sinks
from strandloom.operators.outputs import Listener, Output
from strandloom.plans.graph import Graph
from strandloom.sources import readers

from .golden import FOUNDERS, GRAPHS, write_case
from .test_engine import two_chromosomes


class Heard(Listener):
    RECORDS = NODES = 2
    SEQUENCES = 2

    def __init__(self):
        self.seen = []

    def handled_records(self, n, total):
        self.seen.append(("records", n, total))

    def handled_node(self, n, total):
        self.seen.append(("nodes", n, total))

    def handled_sequences(self, n, total):
        self.seen.append(("sequences", n, total))

    def will_handle_sequence(self, seq_id):
        self.seen.append(("will", seq_id))

    def unable_to_execute(self, command, target, reason):
        self.seen.append(("unable", target, reason))

    def exited(self, command, target, status):
        self.seen.append(("exit", target.rsplit("/", 1)[-1], status))

    def of(self, kind):
        return [x[1:] for x in self.seen if x[0] == kind]


def test_counts_are_told_while_the_job_runs(spark):
    count, told = Counter(spark), []

    def slow(batches):
        for pdf in batches:
            time.sleep(0.4)
            count.add(len(pdf))
            yield pdf

    with watched(count, 100, lambda n, total: told.append((n, total, time.time())), 1600):
        spark.range(0, 1600, numPartitions=16).mapInPandas(slow, "id long").count()
        ended = time.time()
    assert [t[:2] for t in told] == [(n, 1600) for n in range(100, 1601, 100)]
    assert sum(t[2] < ended for t in told) >= 4


def test_records_are_told_from_sparks_own_status(spark, tmp_path):
    spark.range(0, 800, numPartitions=16).write.parquet(str(tmp_path / "t"))
    told, rows = [], spark.read.parquet(str(tmp_path / "t"))

    def slow(batches):
        for pdf in batches:
            time.sleep(0.4)
            yield pdf

    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    try:
        with watched(Records(spark), 100, lambda n, total: told.append((n, time.time()))):
            rows.mapInPandas(slow, "id long").write.format("noop").mode("overwrite").save()
            ended = time.time()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [t[0] for t in told] == list(range(100, 801, 100)) and told[0][1] < ended
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_listener_hears_records_and_nodes(spark, tmp_path):
    bases, records, cuts, *_ = FOUNDERS["1"]
    heard = Heard()
    g1 = Graph.from_files(spark, *write_case(tmp_path, bases, records), "1", listener=heard)
    assert heard.of("records")[-1] >= (2, None)
    found = g1.cut_positions(0, heard)
    assert [r.node for r in found.orderBy("cut_idx").collect()] == cuts
    assert heard.of("nodes") == [(n, g1.nodes.count()) for n in range(2, g1.nodes.count() + 1, 2)]


def script(path, body):
    path.write_text(f"#!/bin/sh\n{body}\n")
    path.chmod(path.stat().st_mode | stat.S_IEXEC)
    return str(path)


def test_a_strategy_and_the_exit_codes_of_its_command(spark, tmp_path):
    bases, records, *_ = FOUNDERS["1"]
    g1 = Graph.from_files(spark, *write_case(tmp_path, bases, records), "1")

    @outputs.register("three copies")
    def three(graph, *, first, **how):
        return graph.haplotypes(**how).where(F.col("seq_no").between(first, first + 2))

    try:
        command = script(tmp_path / "p.sh", 'case "$1" in *SAMPLE3*) exit 7;; *SAMPLE4*) kill -9 $$;; esac; cat > "$1.out"')
        heard = Heard()
        out = Output("three copies", reference=False, command=command, listener=heard)
        files = out.separate(out.rows(g1, first=2), str(tmp_path / "sep"))
        assert len(files) == 3 and sorted(heard.of("exit")) == [("SAMPLE2.1.a2m", 0), ("SAMPLE3.1.a2m", 7), ("SAMPLE4.1.a2m", -9)]
        assert heard.of("will") == [("SAMPLE2-1",), ("SAMPLE3-1",), ("SAMPLE4-1",)] and heard.of("sequences") == [(2, 3)]
        assert (tmp_path / "sep/SAMPLE2.1.a2m.out").read_text().startswith(">SAMPLE2-1\n")
        out.a2m(out.rows(g1, first=2), str(tmp_path / "SAMPLE3"))
        assert heard.of("exit")[-1] == ("SAMPLE3", 7)
        missing = Output("three copies", reference=False, command=str(tmp_path / "none.sh"), listener=heard)
        missing.separate(missing.rows(g1, first=2), str(tmp_path / "sep"))
        missing.a2m(missing.rows(g1, first=2), str(tmp_path / "x"))
        assert len(heard.of("unable")) == 4 and all("No such file" in x[1] for x in heard.of("unable"))
        strict = Output("three copies", reference=False, command=command)
        with pytest.raises(RuntimeError, match="ended with 7"):
            strict.separate(strict.rows(g1, first=3), str(tmp_path / "sep"))
        with pytest.raises(RuntimeError, match="could not be run"):
            Output("three copies", command=str(tmp_path / "none.sh")).a2m(out.rows(g1, first=2), str(tmp_path / "x"))
    finally:
        del outputs.STRATEGIES["three copies"]


def test_one_file_written_at_once_equals_the_stream(spark, tmp_path):
    _, both = two_chromosomes(spark, tmp_path)
    msa = both.haplotypes()
    sinks.write_a2m(msa, str(tmp_path / "stream"))
    for parts in (1, 7):
        sinks.write_a2m_at_once(msa.repartition(parts), str(tmp_path / "once"))
        assert (tmp_path / "once").read_bytes() == (tmp_path / "stream").read_bytes()
    sinks.write_a2m_at_once(msa.limit(0), str(tmp_path / "none"))
    assert (tmp_path / "none").read_bytes() == b"" and not list(tmp_path.glob("*.part"))
    odd = msa.withColumn("seq_id", F.concat("seq_id", F.lit("ß>x"))).withColumn("text", F.concat(F.lit(">"), "text"))
    sinks.write_a2m(odd, str(tmp_path / "stream"))
    sinks.write_a2m_at_once(odd, str(tmp_path / "once"))
    assert (tmp_path / "once").read_bytes() == (tmp_path / "stream").read_bytes()


def test_calls_are_parsed_once(spark, tmp_path):
    bases, _, records, *_ = GRAPHS["1a"]
    fa, vcf = write_case(tmp_path, bases, records)
    (tmp_path / "x.vcf").write_text((tmp_path / "x.vcf").read_text() + "\n2\t5\tz\tA\tC\t.\tPASS\t.\tGT\t1|0\t.|1\t0|0\t0|0\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        file = readers.VcfFile(spark, vcf)
        rows, seen = file.records("1")
        assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
        lines = (tmp_path / "x.vcf").read_text().split("\n")
        want = {i: x.split("\t")[2] for i, x in enumerate(lines, 1) if x.startswith("1\t")}
        assert {r.lineno: r.ids[0] for r in rows.collect()} == want
        assert seen.get == {"handled": 6, "others": 1}
        assert {r.chrom: r.records for r in file.counts().collect()} == {"1": 6, "2": 1}
        two = {(r.sample_idx, r.copy_idx): r.allele for r in readers.genotypes(file.records("2")[0]).collect()}
        assert two == {(0, 0): 1, (0, 1): 0, (1, 0): None, (1, 1): 1, **{(s, c): 0 for s in (2, 3) for c in (0, 1)}}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_overlaps_of_a_saved_graph_are_refused(spark, tmp_path, capsys):
    with pytest.raises(SystemExit):
        cli.main(["--input-reference", "x", "--input-graph", "y", "--output-overlaps", str(tmp_path / "o")], spark)
    assert "--output-overlaps needs --input-variants" in capsys.readouterr().err
