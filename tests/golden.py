"""Golden cases: small inputs with their expected graphs, cuts, assignments and alignments (fixed values)."""

GRAPHS = {
    "1a": ("A" * 14, 4, [
        ("a1", 5, "A", "G", ["0|0", "0|0", "0|0", "1|0"]), ("a2", 7, "A", "T,CC", ["0|0", "1|0", "2|0", "0|2"]), ("a3", 8, "A", "T,GGGG", ["0|2", "1|2", "2|0", "0|2"]),
        ("a4", 9, "AA", "T", ["0|0", "1|0", "0|0", "0|0"]), ("a5", 10, "AA", "CC", ["0|1", "1|0", "0|0", "0|0"]), ("a6", 11, "AA", "GG", ["1|0", "0|1", "1|1", "1|1"])],
        [(0, 0), (4, 4), (5, 5), (6, 6), (7, 8), (8, 12), (9, 13), (10, 14), (11, 15), (12, 16), (14, 18)],
        [(1, 2, "G"), (3, 4, "T"), (3, 4, "CC"), (4, 5, "T"), (4, 5, "GGGG"), (5, 7, "T"), (6, 8, "CC"), (7, 9, "GG")], [("SAMPLE2", 0, 9, "a5", 1)]),
    "1b": ("A" * 14, 4, [
        ("a1", 5, "A", ".,G", ["0|0", "0|0", "0|0", "1|0"]), ("a2", 7, "A", "T,CC", ["0|0", "1|0", "2|0", "0|2"]), ("a3", 8, "A", "T,GGGG", ["0|2", "1|2", "2|0", "0|2"]),
        ("a4", 9, "AA", "T", ["0|0", "1|0", "0|0", "0|0"]), ("a5", 10, "AA", "CC", ["0|1", "1|0", "0|0", "0|0"]), ("a6", 11, "AA", "GG", ["1|0", "0|1", "1|1", "1|1"])],
        [(0, 0), (4, 4), (5, 5), (6, 6), (7, 8), (8, 12), (9, 13), (10, 14), (11, 15), (12, 16), (14, 18)],
        [(1, 2, "G"), (3, 4, "T"), (3, 4, "CC"), (4, 5, "T"), (4, 5, "GGGG"), (5, 7, "T"), (6, 8, "CC"), (7, 9, "GG")], [("SAMPLE2", 0, 9, "a5", 1)]),
    "2": ("GCAACC", 3, [("b1", 1, "GCAACC", "TTTT", ["1|0", "0|0", "0|0"]), ("b2", 3, "AA", "C", ["0|0", "1|0", "1|0"]), ("b3", 5, "C", "GG", ["0|0", "1|0", "0|1"])],
        [(0, 0), (2, 2), (4, 4), (5, 6), (6, 7)], [(0, 4, "TTTT"), (1, 2, "C"), (2, 3, "GG")], []),
    "4": ("TGCTGGGAGGCAACCGGGG", 1, [
        ("c1", 1, "TGCTGGGAGGCAACC", "T", ["0|0"]), ("c2", 2, "GCTGGGAGGCA", "C", ["0|0"]), ("c3", 4, "TG", "CCCC", ["0|0"]), ("c4", 7, "G", "T", ["0|0"]), ("c5", 10, "GCAACC", "TTTT", ["0|0"]),
        ("c6", 12, "A", "G", ["0|0"]), ("c7", 12, "AA", "C,<DEL>,<CNV:TEST>", ["0|3"])],
        [(0, 0), (1, 1), (3, 3), (5, 7), (6, 8), (7, 9), (9, 11), (11, 13), (12, 14), (13, 15), (15, 17), (19, 21)],
        [(0, 10, "T"), (1, 8, "C"), (2, 3, "CCCC"), (4, 5, "T"), (6, 10, "TTTT"), (7, 8, "G"), (7, 9, "C"), (7, 9, "")], []),
}

_A1, _A2, _A3 = "1 2 3 0 0 0 0 0 0 1 1 1 3 0".split(), "0 0 0 1 2 3 0 0 0 1 0 0 0 3".split(), "0 0 0 0 0 0 1 2 3 1 1 1 3 3".split()
_ALT = ("CAA", "AAA,GAAA,TAA"), ("CTT", "ATT,GTTT,TTT"), ("CGG", "AGG,GGGG,TGG")


def _three(places):
    return [(f"a{i}", p, ref, alt, gt) for i, (p, (ref, alt), gt) in enumerate(zip(places, _ALT, (_A1, _A2, _A3), strict=True), 1)]


FOUNDERS = {
    "1": ("CAAAACTTCCCGG", _three((1, 6, 11)), [0, 1, 3, 5], [[0, 6, 6], [3, 5, 8]], ["CAA-AACTT-CCCGG-", "AAA-AACTT-CCAGG-", "CAA-AATTT-CCTGG-"]),
    "1-2": ("CAAAACTTCCCGGAAAA", _three((1, 6, 11)), [0, 1, 3, 6], [[0, 6, 6], [3, 5, 8]], ["CAA-AACTT-CCCGG-AAAA", "AAA-AACTT-CCAGG-AAAA", "CAA-AATTT-CCTGG-AAAA"]),
    "2": ("CAACTTCGG", [("a1", 1, "CAA", "AAA,GAAA,TAA", "1 2 3 0 0 0 0 0 0 1 0".split()), ("a2", 3, "ACT", "ATT,GTTT,TTT", "0 0 0 1 2 3 0 0 0 0 0".split()), ("a3", 6, "TCG", "AGG,GGGG,TGG", "0 0 0 0 0 0 1 2 3 1 3".split())],
        [0, 3, 5], [[6, 8], [0, 7]], ["CAA-CTTCG-G", "CAA-CTTGG-G", "AAA-CTGGGGG"]),
    "3": ("CAACTTCGG", _three((1, 4, 7)), [0, 1, 2, 3], [[0, 6, 6], [3, 5, 8]], ["CAA-CTT-CGG-", "AAA-CTT-AGG-", "CAA-TTT-TGG-"]),
    "4": ("TTTCAAAACTTCCCGG", _three((4, 9, 14)), [0, 2, 4, 6], [[0, 6, 6], [3, 5, 8]], ["TTTCAA-AACTT-CCCGG-", "TTTAAA-AACTT-CCAGG-", "TTTCAA-AATTT-CCTGG-"]),
}


def write_case(folder, bases, records, samples=None):
    """FASTA and VCF files of a case; returns their paths."""
    n = len(records[0][4])
    names = [f"SAMPLE{i + 1}" for i in range(n)]
    lines = ["##fileformat=VCFv4.3", "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split() + names)]
    lines += ["\t".join(["1", str(pos), name, ref, alt, ".", "PASS", ".", "GT", *gt]) for name, pos, ref, alt, gt in records]
    (folder / "x.vcf").write_text("\n".join(lines) + "\n")
    (folder / "x.fa").write_text(f">test1\n{bases}\n")
    return str(folder / "x.fa"), str(folder / "x.vcf")
