"""Aligned and unaligned texts of copies, in chunks that end at bridges, so that no edge crosses a border.

The REF text of a chunk is built once; a copy's text is the REF text with the aligned ranges of its taken edges
replaced. A chunk of a copy that takes no edge there is the REF text itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.labels import padded
from ..functions.letters import letters, strings
from ..functions.storage import dealt, large
from . import incidence
from .graph import reference_slices

BUBBLES = 64
#: Letters of texts that a task makes at a time.
TEXT_BYTES = 1 << 22


def ref_chunks(nodes: DataFrame, reference: DataFrame, chunk: int, bubbles: int = BUBBLES) -> DataFrame:
    """(chrom, chunk_no, base, aln, lo, text, plain, alns): the REF row, aligned and plain.

    ``base`` is the node that a chunk begins at (it ends the chunk before), ``aln`` and ``lo`` its aligned and its own position; ``alns`` are the aligned positions
    of base and of the chunk's nodes. The reference is sliced once for a chunk, not for each piece.
    """
    own = F.expr(f"greatest(bubble - 1, 0) div {bubbles}")
    both = F.when(F.col("is_bridge") & (F.col("bubble") > 0) & (F.col("bubble") % bubbles == 0), F.array(own, own + 1)).otherwise(F.array(own))
    rows = nodes.select("chrom", F.explode(both).alias("chunk_no"), "node", "ref_pos", "aln_pos")
    spans = rows.groupBy("chrom", F.col("chunk_no").alias("id")).agg(F.min("ref_pos").alias("lo"), F.max("ref_pos").alias("hi"))
    plain = reference_slices(spans, reference, chunk).select("chrom", F.col("id").alias("chunk_no"), "lo", F.col("text").alias("plain"))
    groups = rows.groupBy("chrom", "chunk_no").agg(F.sort_array(F.collect_list(F.struct("node", "ref_pos", "aln_pos"))).alias("g")).where("size(g) > 1")
    groups = groups.join(large(plain), ["chrom", "chunk_no"])
    at = lambda i: F.get("g", i)
    # the letters are bound to a variable, so that the plain text is split once and not again for each piece
    piece = lambda t, x, i: padded(F.array_join(F.slice(t, (at(i)["ref_pos"] - F.col("lo") + 1).cast("int"), (x["ref_pos"] - at(i)["ref_pos"]).cast("int")), ""), x["aln_pos"] - at(i)["aln_pos"])
    joined = lambda t: F.array_join(F.transform(F.slice("g", 2, F.size("g") - 1), lambda x, i: piece(t, x, i)), "")
    text = F.get(F.transform(F.array(F.split("plain", "")), joined), F.lit(0))
    return groups.select("chrom", "chunk_no", at(F.lit(0))["node"].alias("base"), at(F.lit(0))["aln_pos"].alias("aln"), "lo", text.alias("text"), "plain", F.transform("g", lambda x: x["aln_pos"]).alias("alns"))


def _entries(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(row of each entry, all entries) of a column of lists."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


def _set_bits(held: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(step, copy) of the set bits of packed carriers."""
    step, words = _entries(held)
    at, bit = np.nonzero(np.unpackbits(words.to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    first = np.append(0, np.cumsum(np.bincount(step, minlength=len(held))))
    return step[at], (at - first[step[at]]) * incidence.WORD + bit


def _listed(held: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    step, copies = _entries(held)
    return step, copies.to_numpy().astype(np.int64)


#: How tasks read what ``has`` asks of a column.
_PAIRS = {incidence.carries: _set_bits, F.array_contains: _listed}


def _taken(ends: np.ndarray, n: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Which edges walks take: ``n`` edges each, one walk's after the other's; an edge is taken that starts where the last one taken has ended, or behind.

    All walks go on one edge at a time; ``ends`` is where they begin.
    """
    taken, ends, first = np.zeros(len(src), bool), ends.copy(), np.cumsum(n) - n
    rank = np.argsort(-n, kind="stable")
    for t in range(int(n.max(initial=0))):
        on = rank[: np.count_nonzero(n > t)]
        e = first[on] + t
        free = src[e] >= ends[on]
        taken[e] = free
        ends[on[free]] = dst[e[free]]
    return taken


def _walk(batch: pa.RecordBatch, lo: int, hi: int, pairs: Callable[[pa.ListArray], tuple[np.ndarray, np.ndarray]], aligned: bool) -> pa.RecordBatch:
    """The texts of copies ``lo`` to ``hi`` - 1 of some chunks."""
    size = np.clip(batch.column("size").to_numpy().astype(np.int64), lo, hi) - lo
    base, origin = (batch.column(x).to_numpy() for x in ("base", "origin"))
    whole, at_chunk = letters(batch.column("whole"))
    of, steps = _entries(batch.column("steps"))
    value = lambda x: steps.field(x).to_numpy()
    step, copy = pairs(steps.field("held"))
    kept = (copy >= lo) & (copy < lo + size[of[step]])
    step, copy = step[kept], copy[kept] - lo
    first = np.cumsum(size) - size
    walk, chunk = first[of[step]] + copy, np.repeat(np.arange(len(size)), size)
    order = np.lexsort((value("edge")[step], value("src")[step], walk))
    step, walk = step[order], walk[order]
    taken = _taken(base[chunk], np.bincount(walk, minlength=len(chunk)), value("src")[step], value("dst")[step])
    step, walk = step[taken], walk[taken]
    if aligned:
        alns = batch.column("alns")
        known, at_node = alns.flatten().to_numpy(), (alns.offsets.to_numpy() - alns.offsets[0].as_py())[of[step]] - base[of[step]]
        place = lambda node: known[at_node + value(node)[step]]
        begin, end = place("src"), place("dst")
    else:
        begin, end = value("src_pos")[step], value("tgt_pos")[step]
    begin, end = begin - origin[of[step]], end - origin[of[step]]
    labels, at_label = letters(steps.field("label"))
    width = np.diff(at_label)[step]
    pad = np.maximum(end - begin - width, 0) if aligned else np.zeros(len(step), np.int64)
    pool = np.concatenate([whole, labels, np.full(pad.max(initial=0), ord("-"), np.uint8)])
    # a text is, for each edge taken, the chunk's text before it, its label and gaps, and the chunk's text behind the last one
    n = np.bincount(walk, minlength=len(chunk))
    last = np.cumsum(3 * n + 1) - 1
    at, length = np.zeros((2, 3 * len(step) + len(chunk)), np.int64)
    p = 3 * np.arange(len(step)) + walk
    since = np.append(0, end[:-1])[: len(step)]
    since[np.append(True, walk[1:] != walk[:-1])[: len(step)]] = 0
    at[p], length[p] = at_chunk[chunk[walk]] + since, begin - since
    at[p + 1], length[p + 1] = len(whole) + at_label[step], width
    at[p + 2], length[p + 2] = len(whole) + len(labels), pad
    since = np.zeros(len(chunk), np.int64)
    since[walk] = end  # of a walk's edges the last one stays
    at[last], length[last] = at_chunk[chunk] + since, np.diff(at_chunk)[chunk] - since
    ends = np.append(0, np.cumsum(length))
    text = pool[np.arange(ends[-1]) + np.repeat(at - ends[:-1], length)]
    own = pa.array(chunk)
    columns = [batch.column("chrom").take(own), pa.array(np.arange(len(chunk)) - first[chunk] + lo, pa.int32()), batch.column("chunk_no").take(own), strings(text, np.append(0, ends[last + 1]))]
    return pa.RecordBatch.from_arrays(columns, names=["chrom", "copy", "chunk_no", "text"])


def copy_chunks(copies: DataFrame, chunks: DataFrame, steps: DataFrame, held: str, has: Callable[[Column, Column], Column], *, aligned: bool = True, bubbles: int = BUBBLES) -> DataFrame:
    """(chrom, copy, chunk_no, text) of every copy and chunk.

    ``steps`` are the carried edges with a column ``held``, and ``has(held, copy)`` says whether a copy carries one (``incidence.carries`` or ``array_contains``). The edges of a chunk meet in
    one row, once for all copies. A copy takes, in order, each of its edges that starts where the last one taken has ended; all copies of some chunks walk side by side. No edge leaves a chunk.
    """
    rows = steps.select("chrom", F.expr(f"(bubble - 1) div {bubbles}").alias("chunk_no"), F.struct("src", "edge", "dst", "src_pos", "tgt_pos", "label", F.col(held).alias("held")).alias("e"))
    own = dealt(rows, "chrom", "chunk_no", of=chunks).groupBy("chrom", "chunk_no").agg(F.collect_list("e").alias("steps"))
    # copies are numbered from 0, so their number per chromosome (one row each) names all of them; a chunk's text meets its
    # copies inside the row and is not shuffled once for each
    size = F.broadcast(copies.groupBy("chrom").agg(F.count_distinct("copy").cast("int").alias("size")))
    rows = chunks.join(large(own), ["chrom", "chunk_no"], "left").join(size, "chrom")
    whole, origin = ("text", "aln") if aligned else ("plain", "lo")
    rows = rows.select("chrom", "chunk_no", "base", F.col(origin).alias("origin"), F.col(whole).alias("whole"), "alns", "steps", "size")
    pairs = _PAIRS[has]

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, width = batch.column("size").to_numpy().astype(np.int64), pc.utf8_length(batch.column("whole")).to_numpy(zero_copy_only=False) + 1
            upto, i = np.append(0, np.cumsum(size * width)), 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(upto, upto[i] + TEXT_BYTES, side="right")) - 1)
                many = max(1, TEXT_BYTES // int(width[i])) if j == i + 1 else int(size.max())  # copies at a time
                for lo in range(0, int(size[i:j].max()), many):
                    yield _walk(batch.slice(i, j - i), lo, lo + many, pairs, aligned)
                i = j

    kinds = chunks.select("chrom", "chunk_no").schema
    return rows.mapInArrow(walked, StructType([kinds["chrom"], StructField("copy", IntegerType()), kinds["chunk_no"], StructField("text", StringType())]))


def ref_row(chunks: DataFrame, *, aligned: bool = True) -> DataFrame:
    return chunks.select("chrom", "chunk_no", F.col("text" if aligned else "plain").alias("text"))
