"""Helpers that the training-data operators share.

* shared storage: ``shared_root`` / ``materialise`` / ``discard`` keep intermediate tables in the
  folder named by ``spark.checkpoint.dir``, so that a lost executor costs a re-read, not a re-run;
* word tables: ``WordTable`` keeps per-word results in a Python worker, bounded in entries;
* batching: ``text_groups`` walks Arrow batches in groups of bounded text volume.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that a Python worker turns into word lists at one time.
GROUP_BYTES = 1 << 20


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session; a local session without one gets its own, on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="strandloom-", dir=None)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/strandloom-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends at the files.

    The path is kept on the result as ``scratch`` for ``discard``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialise`` once nothing reads it any more."""
    path = getattr(df, "scratch", None)
    if path:
        remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> Column:
    """The whole row as one column, so that its names can't clash with an operator's own; ``row.*`` unpacks it."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def id_fold(col: Column) -> Column:
    """crc32(id as text) mod 5, the fold that keeps rows out of training (0 is held out)."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(5)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class WordTable:
    """Word -> row number of a growing value array, at most ``cap`` words at a time.

    ``compute(list of new words) -> array`` gives one value (or row) for each new word. When the
    cap would be passed the table starts again, so memory is bounded; results never depend on it.
    """

    def __init__(self, compute: Callable[[list], np.ndarray], cap: int = 150_000):
        self.compute, self.cap = compute, cap
        self.index: dict = {}
        self.store: np.ndarray | None = None

    def values(self, words: list) -> np.ndarray:
        index = self.index
        found = list(map(index.get, words))
        if None in found:
            new = list({w: 0 for w, i in zip(words, found, strict=True) if i is None})
            if len(index) + len(new) > self.cap:
                index.clear()
                new = list(dict.fromkeys(words))
            made = np.asarray(self.compute(new))
            base = len(index)
            need = base + len(new)
            if self.store is None or need > len(self.store):
                bigger = np.zeros((max(need, 2 * base, 1024), *made.shape[1:]), made.dtype)
                if base:
                    bigger[:base] = self.store[:base]
                self.store = bigger
            self.store[base:need] = made
            index.update(zip(new, range(base, need), strict=True))
            found = list(map(index.__getitem__, words))
        if self.store is None:
            self.store = np.asarray(self.compute([]))
        return self.store[np.asarray(found, dtype=np.int64)]


def text_groups(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = GROUP_BYTES):
    """Yield (batch slice, list of whole texts or None), each slice of about ``limit`` bytes at most.

    A text longer than the limit comes alone; no text is cut.
    """
    for batch in batches:
        sizes = [0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()]
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                part = batch.slice(start, i - start)
                yield part, part.column(column).to_pylist()
                start, total = i, 0
            total += n
        if start < len(sizes):
            part = batch.slice(start)
            yield part, part.column(column).to_pylist()


def runs_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by a non-null column, cut anew so that no value is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        if held and held[-1].column(column)[-1] != values[0]:
            yield _one(held)
            held = []
        last = pc.index(values, values[-1]).as_py()
        if last:  # what stands before the last run is whole
            yield _one([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bits set at the low ends of the hashes, as 64-bit words; at most bits / 64 rows reach the driver."""
    slot = F.col(column).bitwiseAND(bits - 1)
    rows = hashes.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    got = rows.toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[got["word"].to_numpy()] = got["bits"].to_numpy()
    return words.view(np.uint64)


def in_bitmap(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    a = hashes.view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(a >> np.uint64(6)).astype(np.int64)] >> (a & np.uint64(63))) & np.uint64(1) != 0


def join_texts_lower(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``join_texts`` with A-Z lower-cased."""
    from .bytehash import LOWER, join_texts

    data, ends = join_texts(texts)
    return LOWER[data], ends


def starts_of(counts) -> np.ndarray:
    """Start offset of each group and the total at the end."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out
