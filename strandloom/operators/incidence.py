"""Carried edges as packed bits: one word of 64 copies for an edge, or of 64 edges for a copy.

``edge_words`` has a row for each carried edge, its carriers as array<bigint>: bit c % 64 of word c div 64 is copy c. At 5,000
copies a row is 79 words, whatever the number of carriers. ``copy_words`` is the same matrix by copies, in chunks of edges so that no
row holds a chromosome: squares of 64 edges by 64 copies are transposed on their own, so neither side is ever unpacked to rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64
#: Words of a row of ``copy_words``: 4096 edges.
CHUNK_WORDS = 64


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (i % WORD).cast("int"))


def _dense(words: Column, n: Column) -> Column:
    """The array of n words with those of (no, word) structs at their places and 0 elsewhere."""
    held = F.map_from_entries(words)
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.coalesce(F.try_element_at(held, i), F.lit(0).cast("long")))


def edge_words(paths: DataFrame, copies: DataFrame, *more: str) -> DataFrame:
    """(chrom, edge, words) of every edge that a copy carries; all rows of a chromosome have the same number of words. ``more`` names further columns of the edge that stay."""
    size = copies.groupBy("chrom").agg(F.expr(f"max(cast(copy as bigint)) div {WORD} + 1").alias("n"))
    of = ["chrom", "edge", *more]
    words = paths.groupBy(*of, F.expr(f"cast(copy as bigint) div {WORD}").alias("no")).agg(F.bit_or(_bit(F.col("copy"))).alias("word"))
    rows = words.groupBy(*of).agg(F.collect_list(F.struct("no", "word")).alias("held")).join(F.broadcast(size), "chrom")
    return rows.select(*of, F.when(F.col("n") == 1, F.col("held.word")).otherwise(_dense(F.col("held"), F.col("n"))).alias("words"))


def carries(words: Column, copy: Column) -> Column:
    """Whether a copy's bit is set."""
    word = F.get(words, F.call_function("div", copy.cast("long"), F.lit(WORD).cast("long")).cast("int"))
    return F.call_function("shiftright", word, (copy % WORD).cast("int")).bitwiseAND(F.lit(1)) == 1


def carriers(words: DataFrame) -> DataFrame:
    """(chrom, edge, carriers): how many copies carry each edge."""
    ones = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))
    return words.select("chrom", "edge", ones.alias("carriers"))


def unpacked(words: DataFrame) -> DataFrame:
    """(chrom, edge, copy, ...) rows of the set bits; other columns stay."""
    rest = [c for c in words.columns if c != "words"]
    rows = words.select(*rest, F.posexplode("words").alias("no", "word")).where("word <> 0")
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("shiftright", F.col("word"), i).bitwiseAND(F.lit(1)) == 1)
    return rows.select(*rest, "no", F.explode(bits).alias("bit")).select(*rest, (F.col("no") * WORD + F.col("bit")).cast("int").alias("copy"))


def _flip(squares: np.ndarray) -> np.ndarray:
    """64 x 64 bit squares transposed: bit j of word i becomes bit i of word j."""
    bits = np.unpackbits(squares.view(np.uint8).reshape(len(squares), WORD, 8), axis=2, bitorder="little")
    return np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(len(squares), WORD, 8).view(np.int64)[:, :, 0]


def _transposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("held")
        at = np.repeat(np.arange(batch.num_rows), np.diff(rows.offsets.to_numpy()))
        flat = rows.flatten()
        squares = np.zeros((batch.num_rows, WORD), np.int64)
        squares[at, flat.field("bit").to_numpy()] = flat.field("word").to_numpy()
        words = _flip(squares)
        of, bit = np.nonzero(words)
        copy = pa.array(batch.column("no").to_numpy()[of] * WORD + bit)
        yield pa.RecordBatch.from_arrays([batch.column("chrom").take(pa.array(of)), copy, batch.column("row").take(pa.array(of)), pa.array(words[of, bit])], names=["chrom", "copy", "row", "word"])


def copy_words(words: DataFrame) -> DataFrame:
    """(chrom, copy, chunk, words): bit e % 64 of word (e div 64) % CHUNK_WORDS of chunk e div (64 * CHUNK_WORDS) is edge e.

    Chunks in which a copy carries nothing are left out.
    """
    kind = words.schema["chrom"].dataType.simpleString()
    rows = words.select("chrom", F.expr(f"cast(edge as bigint) div {WORD}").alias("row"), (F.col("edge") % WORD).cast("int").alias("bit"), F.posexplode("words").alias("no", "word")).where("word <> 0")
    squares = rows.groupBy("chrom", "row", F.col("no").cast("long").alias("no")).agg(F.collect_list(F.struct("bit", "word")).alias("held"))  # 64 words at most
    flipped = squares.mapInArrow(_transposed, f"chrom {kind}, copy long, row long, word long")
    chunk = F.expr(f"row div {CHUNK_WORDS}")
    out = flipped.groupBy("chrom", "copy", chunk.alias("chunk")).agg(F.collect_list(F.struct((F.col("row") % CHUNK_WORDS).alias("no"), "word")).alias("held"))
    return out.select("chrom", F.col("copy").cast("int"), "chunk", _dense(F.col("held"), F.lit(CHUNK_WORDS).cast("long")).alias("words"))
