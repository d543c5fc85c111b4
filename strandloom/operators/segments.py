"""Segmentation: equivalence classes of copies in blocks, and the cut positions of least height.

Classes have rows for carriers only: a copy without a row carries nothing in the block and is of class 0, which stands before all others. So
tables grow with what is carried, not with copies times blocks.

Cut positions take three steps. Chunks of edges are sorted on their own, and what each does to the order of the copies is joined by
a scan of composing orders (``orders.prefixes``). Each chunk then starts from its own prefix and lists, for each candidate in it, where
a block may begin for each number of classes. A chunk is one row, and a task sorts many chunks side by side. The recursion over these lists runs
along a chromosome and sees candidates only, batch by batch.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import prefix_scan
from ..functions.progress import Counter
from ..functions.storage import dealt, large, materialise
from .incidence import carries, unpacked
from .orders import NONE, Order, prefixes

#: Nodes of a part whose edges and cuts are put in order in one window.
PART_NODES = 1 << 14
#: Edges of a chunk whose copies are sorted on their own.
CHUNK_EDGES = 1024
#: Edges that are one key of a sort, and edges times copies that a task sorts side by side.
KEY_EDGES, SORTED_BITS = 62, 1 << 23
#: Candidates of a chunk.
MARKS = "array<struct<at:bigint,node:bigint,aln_pos:bigint>>"
#: The recursion first sees blocks of so many classes at most; if the result needs more, of more.
HEIGHT = 64


def cut_candidates(marked: DataFrame, counts: DataFrame) -> DataFrame:
    """(chrom, node, first_edge, aln_pos): bridges, the first of those with the same first edge."""
    rows = marked.where("is_bridge").join(large(counts.select("chrom", "node", "first_edge")), ["chrom", "node"])
    first = rows.groupBy("chrom", "first_edge").agg(F.min(F.struct("node", "aln_pos")).alias("n"))
    return first.select("chrom", "n.node", "first_edge", "n.aln_pos")


def bubble_candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``cut_candidates`` from whole bubbles: the first node, and the bridges that end bubbles with edges.

    Edges are numbered along a chromosome, so those that leave nodes before such a bridge are the edges up to the last one of its bubble.
    """
    ends = nodes.where("is_bridge").select("chrom", "bubble", "node", "aln_pos")
    first = ends.where("node = 0").select("chrom", "node", F.lit(0).cast("long").alias("first_edge"), "aln_pos")
    last = edges.groupBy("chrom", "bubble").agg((F.max("edge") + 1).cast("long").alias("first_edge"))
    return first.unionByName(ends.join(large(last), ["chrom", "bubble"]).select("chrom", "node", "first_edge", "aln_pos"))


def _after_cuts(rows: DataFrame, cuts: DataFrame, specs: list) -> DataFrame:
    """``rows`` (with chrom and src) and the cuts in one order, where a cut comes before the rows that start there: running values of the cuts' columns."""
    marks = cuts.withColumnRenamed("node", "src").withColumn("_cut", F.lit(1).cast("long"))
    both = rows.withColumn("_cut", F.lit(0).cast("long")).unionByName(marks, allowMissingColumns=True)
    both = dealt(both.withColumn("_part", F.expr(f"src div {PART_NODES}")), "chrom", "_part", of=rows)
    both = both.withColumn("_behind", 1 - F.col("_cut"))
    return prefix_scan(both, ["chrom"], ["src", "_behind"], "_part", specs).where("_cut = 0").drop("_cut", "_behind", "_part")


def in_blocks(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (with chrom and src) with block: the block between neighbouring cuts that holds the edge; no edge crosses a cut. Edges before the first cut or behind the last are left out."""
    marks = cuts.select("chrom", "node").distinct()
    last = marks.groupBy("chrom").agg(F.count("*").alias("cuts"))
    seen = _after_cuts(rows, marks, [("seen", "sum", F.col("_cut"))]).join(F.broadcast(last), "chrom").where("seen > 0 and seen < cuts")
    return seen.withColumn("block", (F.col("seen") - 1).cast("int")).drop("seen", "cuts")


def block_of_edges(edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """(chrom, edge, block) of the edges."""
    return in_blocks(edges.select("chrom", "edge", "src"), cuts).select("chrom", "edge", "block")


def assigned_steps(steps: DataFrame, cuts: DataFrame, assignments: DataFrame) -> DataFrame:
    """``steps`` (carried edges with words) with who: the founders whose copy in the edge's block carries it; edges without one are left out.

    Each cut brings along what is assigned behind it, so an edge meets its block's copies by a running value and not by a join.
    """
    marks = cuts.select("chrom", "node").distinct().withColumn("_part", F.expr(f"node div {PART_NODES}"))
    marks = prefix_scan(marks, ["chrom"], ["node"], "_part", [("block", "count", F.lit(1))], inclusive=False).drop("_part").withColumn("block", F.col("block").cast("int"))
    plan = assignments.where("copy is not null").groupBy("chrom", "block").agg(F.sort_array(F.collect_list(F.struct("founder", "copy"))).alias("plan"))
    marks = marks.join(large(plan), ["chrom", "block"], "left").select("chrom", "node", F.struct(F.col("node").alias("at"), "plan").alias("cut"))
    rows = _after_cuts(steps, marks, [("now", "max", F.col("cut"))])
    who = F.transform(F.filter("now.plan", lambda x: carries(F.col("words"), x["copy"])), lambda x: x["founder"])
    return rows.withColumn("who", who).where("size(who) > 0").drop("now", "cut", "words")


def block_signatures(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chrom, block, copy, sig): carried edges of a block, highest first; copies that carry none are left out."""
    rows = unpacked(words.join(large(blocks), ["chrom", "edge"]))
    return rows.groupBy("chrom", "block", "copy").agg(F.sort_array(F.collect_list("edge"), asc=False).alias("sig"))


def _sizes(copies: DataFrame) -> DataFrame:
    return copies.groupBy("chrom").agg(F.count("*").alias("copies"))


def class_counts(signatures: DataFrame, copies: DataFrame, spans: DataFrame) -> DataFrame:
    """(chrom, block, n_classes) of every block of ``spans``; copies that carry nothing are a class."""
    own = signatures.groupBy("chrom", "block").agg(F.count_distinct("sig").alias("kinds"), F.count("*").alias("carriers"))
    rows = spans.select("chrom", "block").join(_sizes(copies), "chrom").join(own, ["chrom", "block"], "left").fillna(0, ["kinds", "carriers"])
    return rows.select("chrom", "block", (F.col("kinds") + (F.col("carriers") < F.col("copies")).cast("long")).alias("n_classes"))


def colex_ranks(signatures: DataFrame, copies: DataFrame) -> DataFrame:
    """``signatures`` with cls: the class number of the copy in its block, in co-lexicographic order; class 0 is for those without a row, if any."""
    own = Window.partitionBy("chrom", "block")
    rows = signatures.join(_sizes(copies), "chrom").withColumn("first", (F.count("*").over(own) < F.col("copies")).cast("int"))
    return rows.withColumn("cls", F.dense_rank().over(own.orderBy("sig")) - 1 + F.col("first")).drop("first", "copies")


#: Edges of a block whose carriers are ranked on their own.
RANKED = 4096


def carrier_classes(words: DataFrame, blocks: DataFrame, copies: DataFrame) -> DataFrame:
    """(chrom, block, copy, cls) as ``colex_ranks`` has them, in two levels, so that no row holds all edges of a block.

    Stretches of ``RANKED`` edges are ranked apart. A block then compares (stretch, rank) pairs, highest first: ranks agree with the edges, since a
    copy that carries more edges of a stretch than one that is equal so far comes after it, whatever the stretches before hold.
    """
    return ranked_carriers(words.join(large(blocks), ["chrom", "edge"]), copies)


def ranked_carriers(held: DataFrame, copies: DataFrame) -> DataFrame:
    """``carrier_classes`` of edges that have their block and words. The edges of a stretch meet in one row, packed, and no row is made for each carrier."""
    kind, block = held.schema["chrom"].dataType.simpleString(), held.schema["block"].dataType.simpleString()
    edge = F.struct((F.col("edge") % RANKED).cast("long").alias("at"), "words")
    rows = held.groupBy("chrom", "block", F.expr(f"cast(edge as bigint) div {RANKED}").alias("stretch")).agg(F.collect_list(edge).alias("edges"))
    rows = rows.withColumn("marks", F.array().cast(MARKS)).join(F.broadcast(_sizes(copies)), "chrom")
    rows = rows.mapInArrow(_rank_stretches, f"chrom {kind}, block {block}, stretch long, copy int, rank long")
    sig = F.sort_array(F.collect_list(F.struct("stretch", "rank")), asc=False)
    return colex_ranks(rows.groupBy("chrom", "block", "copy").agg(sig.alias("sig")), copies).drop("sig")


def _rank_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of the copies that carry an edge of a stretch, by what they carry, latest first."""
    for whole in batches:
        for batch, copies in _side_by_side(whole):
            chunks = Chunks(batch, copies)
            order, since, _ = sort_steps(*chunks.start(), chunks.first_step, chunks.keys, chunks.places)
            rank = np.zeros(order.shape, np.int64)
            np.put_along_axis(rank, order, np.cumsum(since >= 0, axis=1), 1)
            row, copy = np.nonzero(np.logical_or.reduceat(chunks.keys != 0, chunks.first_step[:-1], axis=0))
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(x).take(own) for x in ("chrom", "block", "stretch")), pa.array(copy, pa.int32()), pa.array(rank[row, copy])], names=["chrom", "block", "stretch", "copy", "rank"])


def class_sizes(classes: DataFrame, copies: DataFrame, spans: DataFrame) -> DataFrame:
    """(chrom, block, cls, first_copy, size) of every class of every block of ``spans``."""
    own = classes.groupBy("chrom", "block", F.col("cls").cast("long").alias("cls")).agg(F.min("copy").cast("int").alias("first_copy"), F.count("*").alias("size"))
    # the first copy without a row: where the k-th carrier is not copy k for the first time
    rank = F.row_number().over(Window.partitionBy("chrom", "block").orderBy("copy")) - 1
    held = classes.select("chrom", "block", "copy", rank.alias("k")).groupBy("chrom", "block").agg(F.count("*").alias("n"), F.min(F.when(F.col("copy") > F.col("k"), F.col("k"))).alias("gap"))
    rest = spans.select("chrom", "block").join(_sizes(copies), "chrom").join(held, ["chrom", "block"], "left").fillna(0, ["n"]).where("n < copies")
    rest = rest.select("chrom", "block", F.lit(0).cast("long").alias("cls"), F.coalesce("gap", "n").cast("int").alias("first_copy"), (F.col("copies") - F.col("n")).alias("size"))
    return own.unionByName(rest)


# ---------------------------------------------------------------- cut positions


def sort_steps(order: np.ndarray, since: np.ndarray, ends: np.ndarray, keys: np.ndarray, places: np.ndarray, height: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, since, most) of the copies of several chunks, which are sorted side by side, a step of each at a time.

    ``order`` and ``since`` have a row for each chunk: the copies in order, and for each since where it matches the one before it (-1: throughout). Step s of chunk p
    is row ``ends[p] + s`` of ``keys``, a key for each copy, and of ``places``, from where on copies match again that it tells apart. ``most`` has the ``height``
    largest values of since behind each step.
    """
    order, since, copies = order.copy(), since.copy(), order.shape[1]
    most = np.zeros((len(keys), min(height, copies)), np.int64)
    steps = np.diff(ends)
    rank = np.argsort(-steps, kind="stable")
    order, since = order[rank], since[rank]
    for t in range(int(steps.max(initial=0))):
        n = int(np.count_nonzero(steps > t))
        now = ends[rank[:n]] + t
        own = np.take_along_axis(keys[now], order[:n], 1)
        by = np.argsort(own, axis=1, kind="stable")
        order[:n] = np.take_along_axis(order[:n], by, 1)
        own = np.take_along_axis(own, by, 1)
        fresh = np.repeat(places[now, None], copies, 1)
        row, at = np.nonzero(own[:, 1:] == own[:, :-1])
        if len(row):  # copies with one key match since the latest place between where they stood
            pairs = np.stack([row * copies + by[row, at] + 1, row * copies + by[row, at + 1] + 1], 1).ravel()
            fresh[row, at + 1] = np.maximum.reduceat(np.append(since[:n], -1), pairs)[::2]
        fresh[:, 0] = -1
        since[:n] = fresh
        if height:
            most[now] = -np.sort(-fresh, axis=1)[:, : most.shape[1]]
    back = np.argsort(rank)
    return order[back], since[back], most


def _order(order: np.ndarray, since: np.ndarray) -> Order:
    """One chunk's result as classes."""
    first = since >= 0
    cls = np.zeros(len(order), np.int64)
    cls[order] = np.cumsum(first)
    return Order(cls, np.append(0, since[first]))


def stretch(bits: np.ndarray, places: np.ndarray) -> Order:
    """What edges do to the order of the copies: ``bits`` has a row for each edge, ``places`` where copies match again behind each."""
    if not len(bits):
        return NONE
    order, since, _ = sort_steps(np.arange(bits.shape[1])[None], np.full((1, bits.shape[1]), -1), np.array([0, len(bits)]), bits.astype(np.int64), np.asarray(places))
    return _order(order[0], since[0])


class Recursion:
    """The segmentation of a chromosome whose largest number of classes is least, from the options of its candidates in order.

    Of equal heights the block with fewest classes is taken. Each candidate keeps its score and where the block before it begins.
    """

    def __init__(self, copies: int, distance: int):
        self.copies, self.distance = copies, distance
        self.nodes, self.aln, self.prev, self.score = array("q"), array("q"), array("q"), []

    def add(self, nodes: list[int], aln: list[int], ends: list[int], places: list[int], classes: list[int]) -> None:
        """The next candidates; those of ``ends[r]`` to ``ends[r + 1] - 1`` are the options of the r-th, by ascending classes."""
        known, score, distance = self.aln, self.score, self.distance
        self.nodes.extend(nodes)
        known.extend(aln)
        for at, lo, hi in zip(aln, ends, ends[1:], strict=False):
            best, prev = self.copies if score else 0, -1
            for q in range(lo, hi):
                c = classes[q]
                if c >= best:
                    break
                i = places[q]
                if at - known[i] >= distance:
                    c = max(c, score[i])
                    if c < best:
                        best, prev = c, i
            score.append(best)
            self.prev.append(prev)

    def traced(self, sink: int) -> tuple[list[int], int]:
        """(cut nodes, score). The last cut is the sink."""
        out, at = [], len(self.nodes) - 1
        while at >= 0:
            out.append(self.nodes[at])
            at = self.prev[at]
        if out[-1] != 0:
            out.append(0)
        out.reverse()
        out[-1] = sink
        return out, self.score[-1]


def traced(nodes: list[int], aln: list[int], options: list, sink: int, copies: int, distance: int) -> tuple[list[int], int]:
    """(cut nodes, score) from the options of all candidates but the first: pairs of arrays, where a block may begin and its number of classes."""
    run, ends = Recursion(copies, distance), np.cumsum([0, 0, *(len(i) for i, _ in options)])
    flat = [np.concatenate([np.zeros(0, np.int64), *(o[x] for o in options)]).astype(np.int64).tolist() for x in (0, 1)]
    run.add(list(nodes), list(aln), ends.tolist(), *flat)
    return run.traced(sink)


def _chunks(candidates: DataFrame, words: DataFrame, copies: DataFrame) -> DataFrame:
    """(chrom, part, marks, edges, copies): candidates (at, node, aln_pos) and edges (at, words) of each chunk in one row, in any order.

    A candidate stands in the chunk of the last edge before it; ``at`` counts from the chunk's first edge.
    """
    part = lambda at: F.call_function("div", at, F.lit(CHUNK_EDGES).cast("long"))
    own = lambda at, part: (at - part * CHUNK_EDGES).alias("at")
    at = F.col("first_edge").cast("long")
    before = part(F.greatest(at - 1, F.lit(0)))
    marks = candidates.select("chrom", before.alias("part"), F.struct(own(at, before), F.col("node").cast("long").alias("node"), F.col("aln_pos").cast("long").alias("aln_pos")).alias("mark"))
    edge = F.col("edge").cast("long")
    rows = words.select("chrom", part(edge).alias("part"), F.struct(own(edge, part(edge)), "words").alias("edge"))
    rows = dealt(rows.unionByName(marks, allowMissingColumns=True), "chrom", "part", of=words)
    return rows.groupBy("chrom", "part").agg(F.collect_list("mark").alias("marks"), F.collect_list("edge").alias("edges")).join(F.broadcast(_sizes(copies)), "chrom")


class Chunks:
    """Some chunks of chromosomes with the same number of copies, side by side: candidates and steps in order.

    Edges between two candidates tell copies apart up to the same place, the number of the candidate behind them, so they are one step (or several, of ``KEY_EDGES`` edges).
    Numbers of candidates count from the first of the chunk.
    """

    def __init__(self, batch: pa.RecordBatch, copies: int):
        self.copies, size = copies, batch.num_rows
        of_mark, marks = _entries(batch.column("marks"))
        of_edge, edges = _entries(batch.column("edges"))
        at_mark, at_edge = marks.field("at").to_numpy(), edges.field("at").to_numpy()
        width = max(at_mark.max(initial=0), at_edge.max(initial=0)) + 1
        key = of_mark * width + at_mark
        by = np.argsort(key)
        self.of_mark, key = of_mark[by], key[by]
        self.node, self.aln = (marks.field(x).to_numpy()[by] for x in ("node", "aln_pos"))
        self.first_mark = np.searchsorted(self.of_mark, np.arange(size + 1))
        edge_key = of_edge * width + at_edge
        order = np.argsort(edge_key)
        of_edge, edge_key = of_edge[order], edge_key[order]
        gap = np.searchsorted(key, edge_key, side="right")  # number of the candidate behind, among all of the batch
        new = np.append(True, (gap[1:] != gap[:-1]) | (of_edge[1:] != of_edge[:-1]))[: len(gap)]
        begins = np.flatnonzero(new)
        place = np.arange(len(gap)) - np.repeat(begins, np.diff(np.append(begins, len(gap))))
        starts = np.flatnonzero(place % KEY_EDGES == 0)
        bits = _bits(edges.field("words"), copies)[order].astype(np.int64) << (place % KEY_EDGES)[:, None]
        self.keys = np.add.reduceat(bits, starts, axis=0) if len(starts) else np.zeros((0, copies), np.int64)
        self.of_step, self.gap = of_edge[starts], gap[starts]
        self.first_step = np.searchsorted(self.of_step, np.arange(size + 1))
        self.places = self.gap - self.first_mark[self.of_step]

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        size = len(self.first_step) - 1
        return np.tile(np.arange(self.copies), (size, 1)), np.full((size, self.copies), -1)

    def seen(self) -> np.ndarray:
        """For each candidate, the number of the last step before it among all of the batch; less than its chunk's first if there is none."""
        step = self.of_step * (len(self.node) + 1) + self.gap
        return np.searchsorted(step, self.of_mark * (len(self.node) + 1) + np.arange(len(self.node)), side="right") - 1


def _entries(lists: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """(row of each entry, all entries) of a column of lists."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


def _bits(words: pa.ListArray, copies: int) -> np.ndarray:
    packed = words.flatten().to_numpy().reshape(len(words), -1) if len(words) else np.zeros((0, 1), np.int64)
    return np.unpackbits(np.ascontiguousarray(packed).view(np.uint8), axis=1, bitorder="little")[:, :copies]


def _side_by_side(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
    """(rows, their number of copies): rows of one number of copies and a bounded number of bits."""
    sizes = batch.column("copies").to_numpy()
    for copies in np.unique(sizes):
        rows = np.flatnonzero(sizes == copies)
        longest = np.diff(batch.column("edges").offsets.to_numpy())[rows].max()
        at_a_time = max(1, SORTED_BITS // max(1, int(longest * copies)))
        for i in range(0, len(rows), at_a_time):
            yield batch.take(pa.array(rows[i : i + at_a_time])), int(copies)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, kind))


def _sort_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the edges of each chunk do to the order of the copies; places count from the chunk's first candidate."""
    for whole in batches:
        for batch, copies in _side_by_side(whole):
            chunks = Chunks(batch, copies)
            order, since, _ = sort_steps(*chunks.start(), chunks.first_step, chunks.keys, chunks.places)
            found = [_order(o, s) if n else NONE for o, s, n in zip(order, since, np.diff(chunks.first_step), strict=True)]
            lists = [_lists(np.concatenate(v), np.array([len(x) for x in v]), k) for v, k in (([f.cls for f in found], pa.int32()), ([f.start for f in found], pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("chrom"), batch.column("part"), *lists], names=["chrom", "part", "cls", "start"])


def _known(batch: pa.RecordBatch, copies: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and since of what lies before each chunk."""
    cls, size = np.zeros((batch.num_rows, copies), np.int64), np.diff(batch.column("cls").offsets.to_numpy())
    cls[size > 0] = batch.column("cls").flatten().to_numpy().reshape(-1, copies)
    order = np.argsort(cls, axis=1, kind="stable")
    own, since = np.take_along_axis(cls, order, 1), np.full(cls.shape, -1)
    row, at = np.nonzero(own[:, 1:] != own[:, :-1])
    since[row, at + 1] = batch.column("start").flatten().to_numpy()[batch.column("start").offsets.to_numpy()[row] + own[row, at + 1]]
    return order, since


def _options_up_to(height: int, count: Counter | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each candidate, the leftmost candidates at which a block with each number of classes may begin, up to ``height`` classes.

    Places are numbers of candidates: a number of classes holds back to the start where it changes. Chunks are sorted on from what lies before them.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, copies in _side_by_side(whole):
                chunks = Chunks(batch, copies)
                order, since = _known(batch, copies)
                k0 = batch.column("k0").to_numpy()
                _, _, most = sort_steps(order, since, chunks.first_step, chunks.keys, chunks.places + k0[chunks.of_step], height)
                step, of = chunks.seen(), chunks.of_mark
                none = step < chunks.first_step[of]
                starts = np.zeros((len(of), most.shape[1]), np.int64)
                starts[~none] = most[step[~none]]
                starts[none] = -np.sort(-since, axis=1)[:, : most.shape[1]][of[none]]
                starts = np.maximum(starts, 0)
                k = k0[of] + np.arange(len(of)) - chunks.first_mark[of]
                kept = starts < k[:, None]
                kept[:, 1:] &= starts[:, 1:] != starts[:, :-1]
                if count:  # nodes from the candidate before each to itself
                    before = np.append(-1, chunks.node[:-1])[: len(of)]
                    opens = chunks.first_mark[of] == np.arange(len(of))
                    before[opens] = batch.column("seen").to_numpy()[of[opens]]
                    count.add(int((chunks.node - before).sum()))
                size = kept.sum(axis=1)
                i, classes = _lists(starts[kept], size, pa.int32()), _lists(np.nonzero(kept)[1] + 1, size, pa.int32())
                own = pa.array(of)
                columns = [batch.column("chrom").take(own), pa.array(k), pa.array(chunks.node), pa.array(chunks.aln), batch.column("copies").take(own), i, classes]
                yield pa.RecordBatch.from_arrays(columns, names=["chrom", "k", "node", "aln_pos", "copies", "i", "classes"])

    return listed


def _cuts_along(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The recursion over candidates sorted by chromosome and number; it keeps four numbers of each and sees the options batch by batch."""

    def ended(chrom: pa.Array, sink: int, run: Recursion) -> pa.RecordBatch:
        cuts, score = run.traced(sink) if len(run.nodes) > 1 else ([], 0)
        n = len(cuts)
        columns = [chrom.take(pa.array([0] * n, pa.int32())), pa.array(range(n), pa.int32()), pa.array(cuts, pa.int64()), pa.array([score] * n, pa.int64()), pa.array([distance] * n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["chrom", "cut_idx", "node", "score", "min_distance"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for whole in batches:
            k = whole.column("k").to_numpy()
            begins = [0, *np.flatnonzero(k[1:] == 0) + 1, len(k)]  # candidate 0 begins a chromosome
            for lo, hi in zip(begins, begins[1:], strict=False):
                batch = whole.slice(lo, hi - lo)
                if batch.num_rows and k[lo] == 0:
                    if now:
                        yield ended(*now)
                    now = batch.column("chrom").slice(0, 1), batch.column("sink")[0].as_py(), Recursion(batch.column("copies")[0].as_py(), distance)
                if batch.num_rows:
                    i, classes = batch.column("i"), batch.column("classes")
                    ends = np.append(0, np.cumsum(i.value_lengths().to_numpy()))
                    now[2].add(batch.column("node").to_pylist(), batch.column("aln_pos").to_pylist(), ends.tolist(), i.flatten().to_pylist(), classes.flatten().to_pylist())
        if now:
            yield ended(*now)

    return solve


def cut_positions(candidates: DataFrame, words: DataFrame, copies: DataFrame, nodes: DataFrame, min_distance: int = 0, height: int = HEIGHT, count: Counter | None = None) -> DataFrame:
    """(chrom, cut_idx, node, score, min_distance) of each chromosome with copies and more than one candidate.

    ``words`` has the packed carriers of each edge. A row has a chunk of ``CHUNK_EDGES`` edges and one order; the last step reads
    the candidates of a chromosome with at most ``height`` options each. Options of more classes can't be part of a result
    whose score is ``height`` or less; where the score is higher, the options are listed again up to a larger height. ``count`` hears of the
    nodes that are done while the job runs.
    """
    kind, key = nodes.schema["chrom"].dataType.simpleString(), ["chrom", "part"]
    chunks = materialise(_chunks(candidates, words, copies), "chunks")
    numbers = chunks.select(*key, F.size("marks").cast("long").alias("n"), F.array_max("marks.node").alias("last"))
    numbers = prefix_scan(numbers, ["chrom"], ["part"], F.expr("part div 4096"), [("k0", "sum", F.col("n")), ("seen", "max", F.col("last"))], inclusive=False)
    numbers = materialise(numbers.select(*key, "k0", F.coalesce("seen", F.lit(-1).cast("long")).alias("seen")), "numbers")
    sorted_ = chunks.mapInArrow(_sort_chunks, f"chrom {kind}, part long, cls array<int>, start array<long>").join(large(numbers), key)
    state = prefixes(sorted_.withColumn("start", F.transform("start", lambda x, i: F.when(i == 0, x).otherwise(x + F.col("k0")))))
    rows = chunks.join(large(state.join(large(numbers), key)), key)
    sink = F.broadcast(nodes.groupBy("chrom").agg(F.max("node").cast("long").alias("sink")))

    most = copies.groupBy("chrom").count().agg(F.max("count")).first()[0] or 0
    while True:
        listed = rows.mapInArrow(_options_up_to(height, count), f"chrom {kind}, k long, node long, aln_pos long, copies long, i array<int>, classes array<int>")
        along = listed.join(sink, "chrom").repartition(listed.sparkSession.sparkContext.defaultParallelism, "chrom").sortWithinPartitions("chrom", "k")
        cuts = materialise(along.mapInArrow(_cuts_along(min_distance), f"chrom {kind}, cut_idx int, node long, score long, min_distance long"), "cuts")
        count = None  # a second search is not told again
        if height >= most or (cuts.agg(F.max("score")).first()[0] or 0) <= height:
            return cuts
        height *= 8
