import pytest

from strandloom.operators import sinks
from strandloom.plans.graph import Graph

from .golden import FOUNDERS, GRAPHS, write_case


@pytest.mark.parametrize("name", list(GRAPHS))
def test_graph(spark, tmp_path, name):
    bases, _, records, nodes, edges, reports = GRAPHS[name]
    fa, vcf = write_case(tmp_path, bases, records)
    g = Graph.from_files(spark, fa, vcf, "1")
    assert [(r.ref_pos, r.aln_pos) for r in g.nodes.orderBy("node").collect()] == nodes
    assert [(r.src, r.dst, r.label) for r in g.edges.orderBy("edge").collect()] == edges
    got = [(r.SAMPLE, r.CHROM_COPY, r.POS, r.ID, r.GT) for r in g.overlap_report().collect()]
    assert got == reports


@pytest.mark.parametrize("name", list(FOUNDERS))
def test_founders(spark, tmp_path, name):
    bases, records, cuts, copies, rows = FOUNDERS[name]
    fa, vcf = write_case(tmp_path, bases, records)
    g = Graph.from_files(spark, fa, vcf, "1")
    found = g.cut_positions(0)
    assert [r.node for r in found.orderBy("cut_idx").collect()] == cuts
    assigned = g.match(found, 2)
    by = {}
    for r in assigned.orderBy("founder", "block").collect():
        by.setdefault(r.founder, []).append(r.copy)
    assert [by[0], by[1]] == copies
    out = tmp_path / "out.a2m"
    sinks.write_a2m(g.founder_rows(found, assigned), str(out))
    assert out.read_text() == "".join(f">{i}\n{t}\n" for i, t in zip(("REF", "1", "2"), rows, strict=True))
