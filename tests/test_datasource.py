"""VCF and FASTA as data sources: ranges of any size, line numbers, push-down."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.sources import datasource, readers

from .golden import GRAPHS, write_case


@pytest.mark.parametrize("split", [1, 7, 60, 1 << 20])
def test_ranges_hold_each_line_once(tmp_path, split):
    rng = random.Random(split)
    for end in ("", "\n"):
        lines = ["x" * rng.choice([0, 1, 5, 200, 90_000 if i == 3 else 2]) for i in range(40)]
        (tmp_path / "t").write_text("\n".join(lines) + end)
        if split == 1:
            (tmp_path / "t").write_text("\n".join(lines[5:20]) + end)
            lines = lines[5:20]
        size = (tmp_path / "t").stat().st_size
        got = [x.decode() for lo in range(0, size, split) for x in datasource.lines_of(str(tmp_path / "t"), datasource.Range(str(tmp_path / "t"), lo, min(size, lo + split)))]
        assert got == (lines if end or lines[-1] else lines[:-1])


def test_records_of_the_source_equal_the_reader(spark, tmp_path):
    bases, _, records, *_ = GRAPHS["1b"]
    _, vcf = write_case(tmp_path, bases, records)
    (tmp_path / "x.vcf").write_text((tmp_path / "x.vcf").read_text() + "\n12\t5\tz;y\tA\tC\t.\tPASS\t.\tGT\t1|0\t.|1\t0|0\t0|0\n")
    for chrom in (None, "1", "12", "2"):
        want = sorted(map(str, readers.VcfFile(spark, vcf).records(chrom)[0].collect()))
        for split in (40, 1 << 20):
            assert sorted(map(str, datasource.vcf_records(spark, vcf, chrom, split=split).collect())) == want
    # the scan takes the choice over: no filter is left above it, and lines of other chromosomes are never split into fields
    plan = datasource.vcf_records(spark, vcf, "1")._jdf.queryExecution().optimizedPlan().toString()
    assert "= 1)" not in plan and "isnotnull(chrom" in plan
    reader = datasource.VcfReader({"path": vcf})
    rest = [datasource.EqualTo(("pos",), 4), datasource.EqualTo(("chrom",), "2")]
    assert list(reader.pushFilters([datasource.EqualTo(("chrom",), "1"), *rest])) == rest and reader.chrom == b"1"
    good = (tmp_path / "x.vcf").read_text()
    (tmp_path / "x.vcf").write_text(good + "bad\tno position\n")
    assert datasource.vcf_records(spark, vcf, "1").count() == 6
    with pytest.raises(Exception, match="no position"):
        datasource.vcf_records(spark, vcf, "bad").collect()
    (tmp_path / "x.vcf").write_text(good)
    # by the format alone, also by a file: path and a folder
    datasource.register(spark)
    (tmp_path / "d").mkdir()
    (tmp_path / "d/part-0.txt").write_text((tmp_path / "x.vcf").read_text())
    (tmp_path / "d/_SUCCESS").write_text("")
    for path in (vcf, f"file://{vcf}", str(tmp_path / "d")):
        rows = spark.read.format("vcf").load(path).where("chrom = '12'")
        assert [(r.pos, r.ids, r.calls) for r in rows.collect()] == [(4, ["z", "y"], ["1|0", ".|1", "0|0", "0|0"])]
    (tmp_path / "x.vcf").write_text((tmp_path / "x.vcf").read_text().replace("\tGT\t", "\tDP\t"))
    with pytest.raises(Exception, match="no GT"):
        datasource.vcf_records(spark, vcf, "1").collect()
    with pytest.raises(Exception, match="FileNotFoundError"):
        spark.read.format("vcf").load(str(tmp_path / "none")).collect()
    (tmp_path / "empty").write_text("")
    assert datasource.vcf_records(spark, str(tmp_path / "empty")).count() == 0


@pytest.mark.parametrize("split", [50, 333, 1 << 20])
def test_reference_of_the_source_equals_the_reader(spark, tmp_path, split, monkeypatch):
    rng = random.Random(split)
    texts = {n: "".join(rng.choice("ACGTacgtN") for _ in range(size)) for n, size in (("a", 1000), ("b", 1), ("c", 500))}
    body = "".join(f">{n} about {n}\n" + "".join(t[i : i + 37] + ("\n\n" if i == 37 else "\n") for i in range(0, len(t), 37)) for n, t in texts.items())
    (tmp_path / "x.fa").write_text(body + ">none\n")
    got = {}
    for r in datasource.fasta_reference(spark, str(tmp_path / "x.fa"), chunk=128, split=split).orderBy("chunk_no").collect():
        assert r.start == r.chunk_no * 128
        got[r.chrom] = got.get(r.chrom, "") + r.bases
    assert got == texts
    one = readers.read_fasta(spark, str(tmp_path / "x.fa"), record="c", chunk=128)
    same = datasource.fasta_reference(spark, str(tmp_path / "x.fa"), chunk=128, split=split).where(F.col("chrom") == "c")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, same.collect()))
