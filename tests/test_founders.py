"""The founder path against plain statements of its rules: packed carriers, composing orders, cuts in parts, classes, greedy matching, and its SQL."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.operators import incidence, matching, orders, segments
from strandloom.plans import founder_sql


class PrefixSort:
    """Order of the copies by their carried edges, latest first, and where each starts to match its predecessor."""

    def __init__(self, copies: int):
        self.order, self.since = np.arange(copies), np.zeros(copies, np.int64)

    def add(self, edge: int, carriers: np.ndarray) -> None:
        bit = carriers[self.order]
        since = []
        for value in (False, True):
            # a copy matches the last copy with its own bit since the latest start in between
            at = np.flatnonzero(bit == value)
            if len(at):
                latest = np.maximum.reduceat(self.since[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
                latest[0] = max(latest[0], edge + 1)
                since.append(latest)
        self.order = np.concatenate([self.order[~bit], self.order[bit]])
        self.since = np.concatenate(since)

    def classes_since(self, edge) -> np.ndarray:
        """Number of distinct carried sets among the edges from ``edge`` on (one number, or an array of them)."""
        starts = np.sort(self.since[1:])
        return 1 + len(starts) - np.searchsorted(starts, edge, side="right")

    def options(self, j: int, height: int):
        i = np.unique(np.append(self.since[1:], 0))[::-1]
        i = i[i < j]
        classes = self.classes_since(i)
        return i[classes <= height], classes[classes <= height]


def best_cuts(nodes, first_edge, aln, sink, carriers, copies, distance):
    """(cut nodes, score) from one sort over all edges of a chromosome."""
    starts, sort, options, done = np.array(first_edge), PrefixSort(copies), [], 0
    for j in range(1, len(nodes)):
        for e in range(done, first_edge[j]):
            row = np.zeros(copies, bool)
            row[list(carriers.get(e, ()))] = True
            sort.add(int(np.searchsorted(starts, e, "right")) - 1, row)
        done = first_edge[j]
        options.append(sort.options(j, copies))
    return segments.traced(nodes, aln, options, sink, copies, distance)


def random_carriers(rng, copies, edges, share):
    """carriers of each edge; stretches of edges are shared by groups of copies, some by all and some by none."""
    out, kinds = {}, None
    for e in range(edges):
        if kinds is None or rng.random() < 0.2:
            kinds = [rng.randrange(4) for _ in range(copies)]
        bits = [rng.random() < share for _ in range(4)] if rng.random() < 0.9 else [rng.random() < 0.5] * 4
        out[e] = {c for c in range(copies) if bits[kinds[c]] and rng.random() < 0.97}
    return {e: c for e, c in out.items() if c}


def tables(spark, carriers, copies):
    """(paths, copies) of chromosomes by name."""
    paths = [(chrom, c, e) for chrom, own in carriers.items() for e, who in own.items() for c in who]
    return spark.createDataFrame(paths, "chrom string, copy int, edge long"), spark.createDataFrame([(chrom, c) for chrom, n in copies.items() for c in range(n)], "chrom string, copy int")


# ---------------------------------------------------------------- packed carriers


def test_packed_carriers_hold_the_matrix_both_ways(spark):
    rng = random.Random(1)
    own = {"a": {rng.randrange(9000): set(rng.sample(range(150), rng.choice([1, 3, 150]))) for _ in range(300)}, "b": {0: {0}, 63: {0}, 64: {0}}}
    own["b"][4095] = own["b"][4096] = {0}
    paths, copies = tables(spark, own, {"a": 150, "b": 1})
    words = incidence.edge_words(paths, copies).cache()
    assert {(r.chrom, len(r.words)) for r in words.collect()} == {("a", 3), ("b", 1)}
    assert {(r.chrom, r.edge): r.carriers for r in incidence.carriers(words).collect()} == {(k, e): len(c) for k, x in own.items() for e, c in x.items()}
    want = {(k, e, c) for k, x in own.items() for e, who in x.items() for c in who}
    rows = incidence.unpacked(words).collect()
    assert len(rows) == len(want) and {(r.chrom, r.edge, r.copy) for r in rows} == want
    got = set()
    for r in incidence.copy_words(words).collect():
        assert len(r.words) == incidence.CHUNK_WORDS and any(r.words)
        got |= {(r.chrom, r.chunk * 4096 + i * 64 + b, r.copy) for i, w in enumerate(r.words) for b in range(64) if w >> b & 1}
    assert got == want


def test_packed_carriers_are_far_smaller_than_rows(spark, tmp_path):
    """5,000 copies, a third of which carry each edge."""
    paths = spark.range(400).select(F.lit("c").alias("chrom"), F.col("id").alias("edge"), F.explode(F.sequence(F.lit(0), F.lit(4999))).alias("copy")).where("pmod(xxhash64(edge, copy), 3) = 0")
    copies = spark.range(5000).select(F.lit("c").alias("chrom"), F.col("id").cast("int").alias("copy"))
    size = {}
    for name, df in (("rows", paths), ("words", incidence.edge_words(paths, copies))):
        df.coalesce(1).write.parquet(str(tmp_path / name))
        size[name] = df.count()
    assert size["rows"] > 1000 * size["words"]
    disk = {n: sum(f.stat().st_size for f in (tmp_path / n).glob("*.parquet")) for n in size}
    assert disk["words"] * 3 < disk["rows"]  # a random third is near the entropy of the matrix; real carriers pack better


# ---------------------------------------------------------------- orders


def plain_sort(parts, copies):
    """(order, since) from all edges: by carried edges, latest first, then by number."""
    edges = [e for part in parts for e in part]
    key = {c: [c in who for _, who in reversed(edges)] + [c] for c in range(copies)}
    order = sorted(range(copies), key=key.get)
    since = [max((at + 1 for at, who in edges if (a in who) != (b in who)), default=0) for a, b in zip(order, order[1:])]
    return order, since


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_orders_compose_and_scan(spark, fan):
    rng = random.Random(fan)
    copies = {"x": 9, "y": 2, "z": 1}
    parts = {k: [[(10 * p + i, {c for c in range(n) if rng.random() < 0.3}) for i in range(rng.randrange(0, 4))] for p in range(rng.choice([1, 7, 20]))] for k, n in copies.items()}
    rows = []
    for k, own in parts.items():
        for p, edges in enumerate(own):
            bits = np.array([[c in who for c in range(copies[k])] for _, who in edges]).reshape(len(edges), copies[k])
            whole = segments.stretch(bits, np.array([at + 1 for at, _ in edges]))
            rows.append((k, p, whole.cls.tolist(), whole.start.tolist()))
    got = orders.prefixes(spark.createDataFrame(rows, "chrom string, part long, cls array<int>, start array<long>"), fan).collect()
    assert len(got) == len(rows)
    for r in got:
        order, since = orders.order_of(r).sorted(copies[r.chrom])
        assert (order.tolist(), since[1:].tolist()) == plain_sort(parts[r.chrom][: r.part], copies[r.chrom])


def test_chunks_are_sorted_side_by_side_and_candidates_seen_in_batches(spark, monkeypatch):
    """More copies than a word has bits, steps of more edges than a key, several chunks in a row of a table, each in one row."""
    monkeypatch.setattr(segments, "CHUNK_EDGES", 150)
    rng = random.Random(8)
    copies, edges = {"a": 70, "b": 6}, {"a": 700, "b": 500}
    own = {k: random_carriers(rng, copies[k], n, 0.01 if k == "a" else 0.3) for k, n in edges.items()}
    first = {k: sorted({0, n, *rng.sample(range(n + 1), 12), *range(n // 2, n // 2 + 9)}) for k, n in edges.items()}
    nodes = {k: [i * 2 for i in range(len(x))] for k, x in first.items()}
    rows = [(k, n, e, 5 * n) for k in edges for n, e in zip(nodes[k], first[k], strict=True)]
    candidates = spark.createDataFrame(rows, "chrom string, node long, first_edge long, aln_pos long")
    paths, who = tables(spark, own, copies)
    words, sinks = incidence.edge_words(paths, who), spark.createDataFrame([(k, x[-1]) for k, x in nodes.items()], "chrom string, node long")
    chunks = segments._chunks(candidates, words, who).collect()
    assert len(chunks) == len({(r.chrom, r.part) for r in chunks}) == sum(-(-n // 150) for n in edges.values()) and sum(len(r.marks) for r in chunks) == len(rows)
    got = defaultdict(list)
    for r in segments.cut_positions(candidates, words, who, sinks, 0, 8).orderBy("cut_idx").collect():
        got[r.chrom].append((r.node, r.score))
    for k in edges:
        cuts, score = best_cuts(nodes[k], first[k], [5 * n for n in nodes[k]], nodes[k][-1], own[k], copies[k], 0)
        assert got[k] == [(n, score) for n in cuts]
    run = segments.Recursion(3, 2)
    for batch in (([0, 4], [0, 1], [0, 0, 1], [0], [1]), ([6, 9], [2, 4], [0, 2, 4], [1, 0, 2, 0], [1, 2, 1, 2])):
        run.add(*batch)
    assert run.traced(9) == ([0, 6, 9], 2)


def test_candidates_of_bubbles_are_those_of_edge_counts(spark):
    from strandloom.operators import graph as g
    from strandloom.plans import derived

    graph = derived.graph(spark, "/root/testdata/sf0.001")
    want = segments.cut_candidates(graph.nodes, g.edge_counts(graph.nodes, graph.edges))
    got = segments.bubble_candidates(graph.nodes, graph.edges).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize(("seed", "height", "distance"), [(1, 64, 0), (2, 2, 0), (3, 1, 6), (4, 64, 10**6)])
def test_cuts_in_parts_equal_one_sort(spark, monkeypatch, seed, height, distance):
    """Parts of three edges, and heights that are too low at first."""
    monkeypatch.setattr(segments, "CHUNK_EDGES", 3)
    rng = random.Random(seed)
    copies = {"a": 12, "b": 3, "c": 5, "d": 4}
    edges = {"a": 300, "b": 17, "c": 40, "d": 0}
    own = {k: random_carriers(rng, copies[k], n, 0.4) for k, n in edges.items()}
    own["c"] = {}
    first = {k: sorted({0, n, *rng.sample(range(n + 1), n // 2)}) for k, n in edges.items()}
    nodes = {k: [i * 3 + (i > 0) for i in range(len(x))] for k, x in first.items()}
    aln = {k: [2 * n for n in x] for k, x in nodes.items()}
    candidates = spark.createDataFrame([(k, n, e, a) for k in edges for n, e, a in zip(nodes[k], first[k], aln[k])], "chrom string, node long, first_edge long, aln_pos long")
    all_nodes = spark.createDataFrame([(k, n) for k in edges for n in range(nodes[k][-1] + 3)], "chrom string, node long")
    paths, who = tables(spark, own, copies)
    got = defaultdict(list)
    for r in segments.cut_positions(candidates, incidence.edge_words(paths, who), who, all_nodes, distance, height).orderBy("cut_idx").collect():
        got[r.chrom].append((r.node, r.score))
    want = {}
    for k in ("a", "b", "c"):
        cuts, score = best_cuts(nodes[k], first[k], aln[k], nodes[k][-1] + 2, own[k], copies[k], distance)
        want[k] = [(n, score) for n in cuts]
    assert dict(got) == want  # d has one candidate: no cuts
    if not distance:
        assert len(want["a"]) > 2


# ---------------------------------------------------------------- classes and matching


def plain_greedy(steps, founders):
    """The greedy rule, founder by founder. ``steps`` has (ranked pairs, classes on the left, classes on the right) of each block but the first."""
    rows = []
    for pairs, n_left, n_right in steps:
        if not rows:
            row, seen, slots, spare = [], set(), min(founders, n_left), founders - min(founders, n_left)
            for left, _ in pairs:  # each class has a slot, further pairs of it take what is spare
                if left in seen:
                    if spare:
                        spare -= 1
                        row.append(left)
                elif slots:
                    slots -= 1
                    seen.add(left)
                    row.append(left)
            turn = 0
            while spare and pairs:
                row.append(pairs[turn % len(pairs)][0])
                turn, spare = turn + 1, spare - 1
            rows.append(row + [None] * (founders - len(row)))
            waiting = [(c, f) for f, c in enumerate(rows[0]) if c is not None]
        else:
            waiting = [(float("inf") if c is None else c, f) for f, c in enumerate(rows[-1])]
        waiting.sort()
        row, served, missed = [None] * founders, set(), []
        slots, spare = min(founders, n_right), founders - min(founders, n_right)

        def take(left):
            at = next((i for i, (c, _) in enumerate(waiting) if c == left), None)
            return None if at is None else waiting.pop(at)[1]

        turn, going = 0, True
        while going:
            moved = False
            for left, right in pairs:
                if right in served:
                    if spare:
                        f = take(left)
                        if f is not None:
                            row[f], moved, spare = right, True, spare - 1
                    elif turn:
                        going = False
                        break
                elif slots:
                    slots -= 1
                    f = take(left)
                    if f is None:
                        missed.append(right)
                    else:
                        row[f] = right
                        served.add(right)
            going = going and spare > 0 and (turn == 0 or moved)
            turn += 1
        for right in missed:
            if right not in served and waiting:
                row[waiting.pop(0)[1]] = right
                served.add(right)
        turn = 0
        while waiting and pairs:
            row[waiting.pop(0)[1]] = pairs[turn % len(pairs)][1]
            turn += 1
        rows.append(row)
    return rows


def test_greedy_equals_its_plain_statement():
    rng = random.Random(3)
    for _ in range(2000):
        f, n = rng.randrange(1, 9), rng.randrange(1, 6)
        sizes, steps = [rng.randrange(1, 6) for _ in range(n + 1)], []
        for b in range(n):
            every = [(10 * b + i, 10 * (b + 1) + j) for i in range(sizes[b]) for j in range(sizes[b + 1])]
            steps.append((rng.sample(every, rng.randrange(0, len(every) + 1)), sizes[b], sizes[b + 1]))
        assert matching.follow(steps, f) == plain_greedy(steps, f), (steps, f)


def plain_assignments(own, copies, blocks, founders, keep_ref):
    """rows of (block, founder, copy) of one chromosome; ``blocks`` lists the edges of each block."""
    sig = [{c: tuple(e for e in reversed(edges) if c in own.get(e, ())) for c in range(copies)} for edges in blocks]
    number = [{s: i for i, s in enumerate(sorted(set(x.values())))} for x in sig]
    cls = [{c: number[b][s] for c, s in x.items()} for b, x in enumerate(sig)]
    plain = [not any(len(own.get(e, ())) == copies for e in edges) for edges in blocks]
    history = lambda c, b: ([tuple(sig[x][c]) for x in range(b - 1, -1, -1)], c)
    rep = [{k: min((c for c in range(copies) if cls[b][c] == k), key=lambda c, b=b: history(c, b)) for k in number[b].values()} for b in range(len(blocks))]
    if len(blocks) == 1:
        size = Counter(cls[0].values())
        some = [k for k in sorted(size, key=lambda k: (-size[k], -k)) if keep_ref or k]  # the first class stands for the reference
        rows = [[rep[0][k] for k in some[:founders]]]
        rows[0] += [None] * (founders - len(rows[0]))
    else:
        steps = []
        for b in range(1, len(blocks)):
            size = Counter((cls[b - 1][c], cls[b][c]) for c in range(copies))
            pairs = [p for p in sorted(size, key=lambda p: (-size[p], -p[1], -p[0])) if keep_ref or p != (0, 0) or not plain[b] or not plain[b - 1]]
            steps.append(([(rep[b - 1][x], rep[b][y]) for x, y in pairs], len(number[b - 1]), len(number[b])))
        rows = plain_greedy(steps, founders)
    return cls, rep, {(b, f, c) for b, row in enumerate(rows) for f, c in enumerate(row)}


@pytest.mark.parametrize(("seed", "founders", "keep_ref"), [(1, 4, False), (2, 1, False), (3, 7, True), (4, 12, False)])
def test_assignments_equal_plain_rule_and_sql(spark, monkeypatch, seed, founders, keep_ref):
    """Random carriers: blocks without a carrier, with edges that all carry, chromosomes of one block and of many; in Spark, in Python and in SQL."""
    monkeypatch.setattr(matching, "PART", 3)
    rng = random.Random(seed)
    copies = {"1": 9, "2": 6, "3": 4, "4": 5}
    shape = {"1": 40, "2": 7, "3": 1, "4": 3}
    own, blocks = {}, {}
    for k, n in copies.items():
        ends = [0]
        for _ in range(shape[k]):
            ends.append(ends[-1] + rng.randrange(1, 6))
        blocks[k] = [list(range(a, b)) for a, b in zip(ends, ends[1:])]
        own[k] = random_carriers(rng, n, ends[-1], 0.35)
        if k == "4":
            own[k] = {e: c for e, c in own[k].items() if e in blocks[k][1]}
    paths, who = tables(spark, own, copies)
    at = spark.createDataFrame([(k, e, b) for k, x in blocks.items() for b, edges in enumerate(x) for e in edges], "chrom string, edge long, block int")
    spans = spark.createDataFrame([(k, b) for k, x in blocks.items() for b in range(len(x))], "chrom string, block int")
    words = incidence.edge_words(paths, who).cache()
    sigs = segments.block_signatures(words, at)
    classes = segments.colex_ranks(sigs, who).select("chrom", "block", "copy", "cls").cache()
    counts = {(r.chrom, r.block): r.n_classes for r in segments.class_counts(sigs, who, spans).collect()}
    sizes = {(r.chrom, r.block, r.cls): (r.first_copy, r["size"]) for r in segments.class_sizes(classes, who, spans).collect()}
    named = {(r.chrom, r.block, r.cls): r.representative for r in matching.representatives(classes, who, spans).collect()}
    got = defaultdict(set)
    for r in matching.founder_assignments(classes, words, at, spans, who, founders, keep_ref).collect():
        got[r.chrom].add((r.block, r.founder, r["copy"]))
    want_sizes, want_named = {}, {}
    for k in copies:
        cls, rep, rows = plain_assignments(own[k], copies[k], blocks[k], founders, keep_ref)
        for b, own_cls in enumerate(cls):
            assert counts[k, b] == len(set(own_cls.values()))
            for c in set(own_cls.values()):
                held = [x for x, y in own_cls.items() if y == c]
                want_sizes[k, b, c], want_named[k, b, c] = (min(held), len(held)), rep[b][c]
        if rows or k in got:
            assert got[k] == rows, k
    assert sizes == want_sizes and named == want_named
    if keep_ref:
        return
    con = duckdb.connect()
    flat = {
        "edges": pd.DataFrame([(k, e, e, e + 1) for k, x in blocks.items() for edges in x for e in edges], columns=["chrom", "edge", "src", "dst"]),
        "carried": pd.DataFrame([(k, c, e) for k, x in own.items() for e, w in x.items() for c in w], columns=["chrom", "copy", "edge"]),
        "copies": pd.DataFrame([(k, c) for k, n in copies.items() for c in range(n)], columns=["chrom", "copy"]),
        "cuts": pd.DataFrame([(k, n) for k, x in blocks.items() for n in [0, *(edges[-1] + 1 for edges in x)]], columns=["chrom", "node"]),
    }
    for name, df in flat.items():
        con.register(name, df)
    sql = con.sql("with recursive " + ",".join((founder_sql.BLOCKS, founder_sql.assignments(founders))) + "select chrom, block, founder, copy from assigned").fetchall()
    assert {(k, b, f, c) for k, b, f, c in sql} == {(k, *r) for k, x in got.items() for r in x}
