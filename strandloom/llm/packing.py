"""Best-fit packing by a configuration linear program over the length histogram.

1. Every whole text is tokenised in one pass without a shuffle; documents longer than the window are cut
   into full windows and a rest. Pieces (ids of documents, lengths and checksums, no text) are written to
   the shared folder, because the histogram and the placement both read them.
2. The histogram of piece lengths has at most ``window`` entries whatever the input, so the driver
   solves the covering program over it (``Weights``: multiplicative weights, a knapsack recursion that prices all configurations at
   once, a dual bound). It is rounded in ``BATCHES`` rounds: configurations are drawn from the fractional solution and taken
   while their pieces last, then the weights are fitted to what is left. The last pieces, and those of under 1 / ``FILLER`` of a window,
   are placed best fit, longest first. Plain best fit is computed too, and the better plan is taken. Steps, rounds and draws are fixed
   numbers, so neither time nor plan grow with the input.
3. Pieces get their rank among pieces of equal length from two windows (rank inside a salt, and a running
   sum of the counts of the salts), so a length that a third of all documents share is spread over
   ``SALTS`` groups, equal rows too. A rank names its window and offset through the plan, which is broadcast: a few rows for each draw and
   length, at most.

Defined cases: null and empty texts are one piece of the closing id alone; repeated rows and repeated or
null ids are packed like any others; an empty table gives no rows. The pieces of one row have
consecutive numbers and starts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_groups
from .tokens import tokenizer

WINDOW = 4096
CLOSING_ID = 1
SALTS = 256
#: Pieces shorter than 1 / FILLER of a window close gaps after the program is solved.
FILLER = 64
#: Sharpness of the weights at the beginning and at the end, per 4096 tokens of a window, and its growth per step.
SOFT, SHARP, GROWTH = 12.0, 600.0, 1.05
MOMENTUM = 0.9
STEPS = 220
#: Rounding: in each of BATCHES rounds SHARE of the windows that are left is taken, as at most DRAWS configurations.
BATCHES = 24
SHARE = 0.25
DRAWS = 1024
REFIT = 6


# ---------------------------------------------------------------- the program over the histogram


class Weights:
    """Multiplicative weights of the piece lengths, priced by a knapsack dynamic program.

    The program: minimise the number of windows such that configurations (sequences of lengths that fit into one window) hold
    every piece. Configurations are mixed in proportion to the product of their lengths' weights and exp(-sharp * gap). One
    knapsack recursion over capacities sums that over all configurations, and gives how often each length occurs. Lengths
    that occur less often than their share of the pieces gain weight, others lose. When all shares agree, the mixture is a
    fractional solution; as ``sharp`` grows, gaps vanish from it. The logarithms of the weights are prices of the dual
    program, which bound the number of windows from below.
    """

    def __init__(self, lengths: np.ndarray, pieces: np.ndarray, window: int):
        self.lengths, self.pieces, self.window = lengths, pieces.astype(np.float64), window
        self.logs = self._level(np.log(self.pieces / self.pieces.sum()))
        self.pull = np.zeros(len(lengths))
        self.sharp, self.last = SOFT / window, SHARP / window

    def _level(self, logs: np.ndarray) -> np.ndarray:
        """Tilt by length so that the weights sum to 1, which keeps the recursion in range (mixtures of equal fill don't change)."""
        lo, hi = -1.0, 1.0
        with np.errstate(over="ignore"):
            for _ in range(50):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if np.exp(np.minimum(logs + mid * self.lengths, 50.0)).sum() > 1 else (mid, hi)
        return logs + lo * self.lengths

    def _recursion(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weights, sum over sequences of each total, the same for all ways to end within each room, gaps included)."""
        size, least = self.window, int(self.lengths[0])
        w = np.exp(self.logs)
        back = np.zeros(size + 1)
        back[size - self.lengths] = w
        exact = np.zeros(size + 1)
        exact[0] = 1.0
        for c in range(least, size + 1):
            exact[c] = back[size - c : size - least + 1] @ exact[: c - least + 1]
        ends, keep, total = np.empty(size + 1), np.exp(-self.sharp), 0.0
        for c, x in enumerate(exact.tolist()):
            total = total * keep + x
            ends[c] = total
        return w, exact, ends

    def step(self) -> float:
        """One update; returns how far the scarcest length is from its share."""
        w, exact, ends = self._recursion()
        each = w * np.convolve(exact, ends)[self.window - self.lengths] / ends[self.window]
        ratio = self.pieces / np.maximum(each, 1e-300)
        self.windows = float((self.pieces @ self.lengths) / (each @ self.lengths))
        off = np.log(ratio / self.windows)
        self.pull = MOMENTUM * self.pull + 3 * (1 - MOMENTUM) * np.clip(off, -2, 2)
        self.logs = self._level(self.logs + self.pull)
        self.sharp = min(self.sharp * GROWTH, self.last)
        return float(off.max())

    def solve(self) -> None:
        for _ in range(STEPS):
            if self.step() < 1e-3 and self.sharp == self.last:
                break

    def bound(self) -> float:
        """The dual bound of these prices, by the knapsack dynamic program of the dearest configuration."""
        price = np.maximum(self.lengths * self.sharp + self.logs, 0.0)
        best = np.zeros(self.window + 1)
        fits = np.searchsorted(self.lengths, np.arange(self.window + 1), side="right")
        for c in range(int(self.lengths[0]), self.window + 1):
            best[c] = max(best[c - 1], (best[c - self.lengths[: fits[c]]] + price[: fits[c]]).max())
        return float(self.pieces @ price / best[-1]) if best[-1] > 0 else 0.0

    def draw(self, many: int, rng: np.random.Generator) -> dict[tuple[int, ...], int]:
        """Configurations (places of lengths, ascending) drawn from the mixture, and how often."""
        w, _, ends = self._recursion()
        room = np.full(many, self.window)
        taken: list[np.ndarray] = []
        live = np.arange(many)
        while len(live):
            pick = np.full(many, -1)
            for r in np.unique(room[live]).tolist():
                own = live[room[live] == r]
                n = int(np.searchsorted(self.lengths, r, side="right"))
                run = np.cumsum(w[:n] * ends[r - self.lengths[:n]])
                at = np.searchsorted(run, rng.random(len(own)) * ends[r], side="right")
                pick[own] = np.where(at < n, at, -1)
            taken.append(pick)
            live = live[pick[live] >= 0]
            room[live] -= self.lengths[pick[live]]
        found: dict[tuple[int, ...], int] = {}
        for row in np.sort(np.stack(taken), axis=0).T:
            key = tuple(row[row >= 0].tolist())
            found[key] = found.get(key, 0) + 1
        return found


Plan = list[tuple[int, list[int]]]


def _rounded(lengths: np.ndarray, pieces: np.ndarray, window: int) -> tuple[Plan, np.ndarray, float]:
    """(windows of whole configurations, pieces that are left, dual bound) for the lengths of which gaps can't be made."""
    weights = Weights(lengths, pieces, window)
    weights.solve()
    bound = weights.bound()
    rng = np.random.default_rng(1)
    left = pieces.copy()
    plan: Plan = []
    for _ in range(BATCHES):
        live = np.flatnonzero(left)
        windows = int(SHARE * weights.windows)
        if not len(live) or windows < 1:
            break
        draws = min(DRAWS, windows)
        for key, times in weights.draw(draws, rng).items():
            kinds, each = np.unique(live[list(key)], return_counts=True)
            many = min(times * (windows // draws), int((left[kinds] // each).min())) if len(kinds) else 0
            if many:
                plan.append((many, lengths[live[list(key)]].tolist()))
                left[kinds] -= many * each
        keep = left[live] > 0
        weights.lengths, weights.pieces = weights.lengths[keep], left[live][keep].astype(np.float64)
        weights.logs, weights.pull = weights.logs[keep], weights.pull[keep]
        if not keep.any():
            break
        for _ in range(REFIT):
            weights.step()
    return plan, left, bound


def _best_fit(plan: Plan, lengths: np.ndarray, pieces: np.ndarray, window: int) -> Plan:
    """Places pieces, longest first, each into the smallest gap that holds it, in runs of equal windows."""
    gaps: list[list[tuple[int, list[int]]]] = [[] for _ in range(window + 1)]
    held = np.zeros(window + 1, bool)

    def put(times: int, config: list[int], gap: int) -> None:
        gaps[gap].append((times, config))
        held[gap] = True

    for times, config in plan:
        put(times, config, window - sum(config))
    for n, r in zip(lengths[::-1].tolist(), pieces[::-1].tolist(), strict=True):
        while r:
            fit = int(held[n:].argmax()) + n
            if not held[fit]:
                fit = window
                put(r, [], window)
            times, config = gaps[fit].pop()
            held[fit] = bool(gaps[fit])
            each = min(fit // n, r)
            some = min(times, r // each)
            put(some, config + [n] * each, fit - each * n)
            r -= some * each
            if times > some and config:
                put(times - some, config, fit)
    return [x for g in gaps for x in g if x[1]]


def solve(histogram: dict[int, int], window: int = WINDOW) -> tuple[Plan, float]:
    """(how many windows, lengths in the window) for the whole histogram, and a lower bound of any plan.

    The rounded program is compared with best fit alone, and the better plan is taken.
    """
    lengths = np.array(sorted(n for n in histogram if n < window and histogram[n]), np.int64)
    pieces = np.array([histogram[int(n)] for n in lengths], np.int64)
    full: Plan = [(histogram[window], [window])] if histogram.get(window) else []
    whole = histogram.get(window, 0)
    if not len(lengths):
        return full, float(whole)
    bound = float(pieces @ lengths) / window
    plain = _best_fit([], lengths, pieces, window)
    large = lengths * FILLER >= window
    plan = plain
    if large.any():
        rounded, left, dual = _rounded(lengths[large], pieces[large], window)
        rest = pieces.copy()
        rest[large] = left
        plan = _best_fit(rounded, lengths, rest, window)
        bound = max(bound, dual)
    best = min(plan, plain, key=lambda p: sum(t for t, _ in p))
    return full + best, whole + bound


def plan_rows(plan: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Length -> rows (first rank, pieces a window, first window, offset in the window), by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for times, config in plan:
        offset = 0
        at = 0
        while at < len(config):
            n = config[at]
            same = 1
            while at + same < len(config) and config[at + same] == n:
                same += 1
            rows.setdefault(n, []).append((used.get(n, 0), same, first, offset))
            used[n] = used.get(n, 0) + times * same
            offset += same * n
            at += same
        first += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def locate(rows: dict[int, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of the pieces with these lengths and ranks."""
    window, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        n = int(length[part[0]])
        own = rows[n]
        i = np.searchsorted(own[:, 0], rank[part], side="right") - 1
        k = rank[part] - own[i, 0]
        window[part] = own[i, 2] + k // own[i, 1]
        offset[part] = own[i, 3] + k % own[i, 1] * n
    return window, offset


# ---------------------------------------------------------------- tables


def cut_pieces(docs: DataFrame, *, window: int = WINDOW, vocabulary: str = "word_bpe_49k.json", closing_id: int = CLOSING_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document row."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for part, texts in text_groups(batches):
            owner, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(tok.ids(texts)):
                ids = np.append(ids, np.uint32(closing_id)).astype("<u4")
                for p, lo in enumerate(range(0, len(ids), window)):
                    own = ids[lo : lo + window]
                    owner.append(i)
                    piece.append(p)
                    start.append(lo)
                    length.append(len(own))
                    crc.append(zlib.crc32(own.tobytes()))
                    kept.append(own)
            cols = {"doc_id": part.column("doc_id").take(pa.array(owner, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                cols["ids"] = pa.array([k.astype(np.int64) for k in kept], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(cols)

    schema = f"doc_id {key}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, *, window: int = WINDOW, **how) -> DataFrame:
    """The pieces of ``cut_pieces`` with sequence_id and offset: gapless windows, as few as the plan finds."""
    spark = docs.sparkSession
    # any fixed numbering of pieces of equal length will do; where rows lie spreads equal rows over all salts
    pieces = materialise(cut_pieces(docs, window=window, **how).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "pieces")
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    shared = spark.sparkContext.broadcast(plan_rows(solve(histogram, window)[0]))
    base = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("inside", inside).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("inside")).drop("inside", "base", "salt")
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, offset = locate(shared.value, b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names[:-2]] + [pa.array(seq), pa.array(offset)], names=names)

    return ranked.mapInArrow(run, schema)
