"""Benchmark decontamination by pigeonhole edit matching.

Text and items are lower-cased and white space is folded to single spaces. An item of n characters
has an error budget of k = floor(``rate`` * n) edits and is split into k + 1 pieces: an occurrence with at
most k edits leaves one piece untouched. All pieces sit in one Aho-Corasick automaton, which each
whole text runs through once. The pieces are the leaves of a binary tree in which a node with budget b
has children whose budgets add up to b - 1, so for every occurrence some exact piece has ancestors that
all hold within their own budgets; a hit is checked from the smallest ancestor upwards, by Myers'
bit-parallel distance, and most chance hits end after a few characters. What passes the
root is an occurrence of the item within its budget. Owners of a piece that agree in its parent's text are checked once for all of
them there, so a phrase that many items share costs one comparison until they differ.

Items are read in blocks of ``block_items`` items and ``BLOCK_CHARS`` characters at most; one block is
broadcast at a time, and its hits are written to the shared folder before the next one, so a benchmark of any size works in bounded memory.
Documents aren't shuffled.

Defined cases: null or empty texts match nothing; items shorter than ``min_chars`` characters after
folding say nothing about a document and are left out; null item ids are left out; repeated items
or rows give a row each; one row per (document row, item) with the smallest distance, and of those the
first end; overlapping hits of one item count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, packed, text_groups

RATE = 0.1
MIN_CHARS = 30
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 8 << 20


def fold(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern_bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(smallest distance of the pattern to a substring of ``text``, its first end)."""
    ones = (1 << m) - 1
    high = 1 << (m - 1)
    pv, mv, score, best, end = ones, 0, m, m, 0
    get = pattern_bits.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & ones)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, i
        ph <<= 1
        mh <<= 1
        pv = (mh | (~(xv | ph) & ones)) & ones
        mv = ph & xv & ones
    return best, end


def bits_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | (1 << i)
    return out


class Item:
    """Tree of pieces: ``nodes`` as (start, end, budget, parent); leaves have budget 0."""

    def __init__(self, item_id: int, text: str, rate: float):
        self.id, self.text = item_id, text
        self.budget = int(rate * len(text))
        self.nodes: list[tuple[int, int, int, int]] = []
        self.leaves: list[int] = []
        self.bits: dict[int, dict[str, int]] = {}
        self._split(0, len(text), self.budget, -1)

    def _split(self, start: int, end: int, budget: int, parent: int) -> None:
        me = len(self.nodes)
        self.nodes.append((start, end, budget, parent))
        if not budget:
            self.leaves.append(me)
            return
        left = (budget - 1) // 2
        right = budget - 1 - left
        cut = start + (end - start) * (left + 1) // (budget + 1)
        self._split(start, cut, left, me)
        self._split(cut, end, right, me)

    def check(self, text: str, leaf: int, at: int) -> tuple[int, int] | None:
        """Verify a leaf hit that starts at ``at`` of ``text``: (distance, end in the text) or None."""
        node = leaf
        found = (0, at + self.nodes[leaf][1] - self.nodes[leaf][0])
        while (node := self.nodes[node][3]) >= 0:
            found = self.near(text, node, at - self.nodes[leaf][0])
            if found is None:
                return None
        return found

    def near(self, text: str, node: int, origin: int) -> tuple[int, int] | None:
        """A node's text within its budget around where it stands if the item starts at ``origin``."""
        start, end, budget, _ = self.nodes[node]
        if node not in self.bits:
            self.bits[node] = bits_of(self.text[start:end])
        lo = max(0, origin + start - budget)
        d, stop = myers(self.bits[node], end - start, text[lo : origin + end + budget])
        return (d, lo + stop) if d <= budget else None

    def parent_of(self, leaf: int) -> tuple[str, int, int]:
        """(text, budget, place of the leaf) of the leaf's parent: what its first check depends on."""
        start, end, budget, _ = self.nodes[max(0, self.nodes[leaf][3])]
        return self.text[start:end], budget, self.nodes[leaf][0] - start


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [Item(i, t, rate) for i, t in items]
        pieces: dict[str, dict[tuple, list[tuple[int, int]]]] = {}
        for n, item in enumerate(self.items):
            for leaf in item.leaves:
                start, end, _, _ = item.nodes[leaf]
                pieces.setdefault(item.text[start:end], {}).setdefault(item.parent_of(leaf), []).append((n, leaf))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), list(owners.values())))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def matches(self, raw: str | None) -> list[tuple[int, int, int]]:
        """(item number, distance, end in the folded text) of every item that the text holds."""
        if self.empty or not raw:
            return []
        text = fold(raw)
        best: dict[int, tuple[int, int]] = {}
        seen: dict[int, int] = {}
        for stop, (size, groups) in self.automaton.iter(text):
            at = stop + 1 - size
            for owners in groups:
                n, leaf = owners[0]
                item = self.items[n]
                if len(owners) > 1 and item.nodes[leaf][3] >= 0 and item.near(text, item.nodes[leaf][3], at - item.nodes[leaf][0]) is None:
                    continue
                for n, leaf in owners:
                    item = self.items[n]
                    origin = at - item.nodes[leaf][0]
                    if seen.get(n) == origin:
                        continue  # the same occurrence has been measured from another piece
                    hit = item.check(text, leaf, at)
                    if hit:
                        seen[n] = origin
                        best[n] = min(hit, best.get(n, hit))
        return [(n, d, e) for n, (d, e) in sorted(best.items())]


def _blocks(rows, block_items: int, min_chars: int):
    block, chars = [], 0
    for r in rows:
        text = fold(r["text"])
        if len(text) < min_chars:
            continue
        if block and (len(block) >= block_items or chars + len(text) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((r["item_id"], text))
        chars += len(text)
    if block:
        yield block


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, distance, budget, end_char) for every item found in a document row."""
    found = flag_rows(docs.select("doc_id", "text"), benchmark, **how)
    return found.select("row.doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.item_id", "hit.distance", "hit.budget", "hit.end_char")


HITS = "array<struct<item_id:long,distance:int,budget:int,end_char:long>>"


def flag_rows(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, min_chars: int = MIN_CHARS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(row, hits): each row of ``docs`` as one packed column, and its hits; block after block adds to them.

    The texts go to Python and back inside the packed rows only: a column of their own would double every Arrow batch on both sides.
    """
    spark = docs.sparkSession
    out = docs.select(packed(docs), F.array().cast(HITS).alias("hits"))
    schema = out.schema
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    shared = written = None
    for block in _blocks(items.sort("item_id", "text").toLocalIterator(), block_items, min_chars):
        if shared is not None:  # the block before has done its work once its hits are written
            out = materialise(out, "hits")
            if written is not None:
                discard(written)
            shared.unpersist()
            written = out
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for part, texts in text_groups(b.append_column("text", pc.struct_field(b.column("row"), "text")) for b in batches):
                part = part.select(["row", "hits"])
                old = part.column("hits").to_pylist()
                new = [o + [{"item_id": matcher.items[n].id, "distance": d, "budget": matcher.items[n].budget, "end_char": e} for n, d, e in matcher.matches(t)] for o, t in zip(old, texts, strict=True)]
                at = part.schema.get_field_index("hits")
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

        out = out.mapInArrow(run, schema)
    return out


def clean_rows(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents in which no benchmark item was found, with their own columns."""
    return flag_rows(docs, benchmark, **how).where(F.size("hits") == 0).select("row.*")
