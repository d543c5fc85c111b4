"""Writers: A2M in one file, in parts or one file a sequence, through a pipe, Graphviz, overlap tables.

Sequences are told apart by (chrom, seq_no). Files take their names only when they are complete, so a second attempt
at a task, or a reader, never meets a half-written one (a command that a sequence is piped to names its file itself).
"""

from __future__ import annotations

import os
import subprocess
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager, suppress
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import abbreviated, file_name
from ..functions.prefix import prefix_scan
from ..functions.progress import Counter


@contextmanager
def _whole(path: str):
    """A text file that appears under its name when it is closed without an error."""
    draft = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(draft, "w") as out:
            yield out
        os.replace(draft, path)
    finally:
        Path(draft).unlink(missing_ok=True)


class CommandFailed(RuntimeError):
    """A command that could not be run (status None) or ended with another status than 0."""

    def __init__(self, command: str, target: str, status: int | None, reason: str | None):
        super().__init__(f"{command} {target} ended with {status}" if reason is None else f"{command} {target}: {reason}")
        self.status, self.reason = status, reason


@contextmanager
def _piped(command: str, target: str):
    try:
        run = subprocess.Popen([command, target], stdin=subprocess.PIPE, text=True)
    except OSError as e:
        raise CommandFailed(command, target, None, str(e)) from e
    try:
        yield run.stdin
        run.stdin.close()
    except BrokenPipeError:  # it ended before it had read everything: its status tells
        pass
    finally:
        with suppress(BrokenPipeError):
            run.stdin.close()
        code = run.wait()
    if code:
        raise CommandFailed(command, target, code, None)


def _opened(command: str | None, target: str):
    return _piped(command, target) if command else _whole(target)


def write_a2m(msa: DataFrame, path: str, command: str | None = None, listener=None) -> None:
    """One file: for each sequence ``>id``, its chunks and a line end, in (chrom, seq_no, chunk_no) order.

    Chunks stream through the driver a partition at a time, which suits a few founders and a command that reads one
    stream; ``write_a2m_at_once`` makes the same file with all executors. With ``command`` the text goes to its
    standard input (it is called with the file name), and a failing command is an error.
    """
    now, n = None, 0
    with _opened(command, path) as out:
        for r in msa.orderBy("chrom", "seq_no", "chunk_no").select("chrom", "seq_no", "seq_id", "text").toLocalIterator():
            if (r["chrom"], r["seq_no"]) != now:
                if listener:
                    if n and n % listener.SEQUENCES == 0:
                        listener.handled_sequences(n, None)
                    listener.will_handle_sequence(r["seq_id"])
                out.write(("\n" if now else "") + f">{r['seq_id']}\n")
                now, n = (r["chrom"], r["seq_no"]), n + 1
            out.write(r["text"])
        out.write("\n" if now else "")
    if listener and n and n % listener.SEQUENCES == 0:
        listener.handled_sequences(n, None)


def pipe_a2m(msa: DataFrame, path: str, command: str, listener=None) -> tuple[int | None, str | None]:
    """``write_a2m`` to a command: (its status, or None and why it could not be run)."""
    try:
        write_a2m(msa, path, command, listener)
    except CommandFailed as e:
        return e.status, e.reason
    return 0, None


def placed_chunks(msa: DataFrame) -> DataFrame:
    """``msa`` with ``piece`` and ``at``: what each chunk adds to an A2M file (head and line end with the first and last), and at which byte.

    Places are running sums in two levels, by sequences and buckets of chunks, so no task holds a sequence.
    """
    ends = msa.groupBy("chrom", "seq_no").agg(F.min("chunk_no").alias("first"), F.max("chunk_no").alias("last"))
    rows = msa.join(ends, ["chrom", "seq_no"])
    head = F.when(F.col("chunk_no") == F.col("first"), F.concat(F.lit(">"), "seq_id", F.lit("\n"))).otherwise("")
    tail = F.when(F.col("chunk_no") == F.col("last"), F.lit("\n")).otherwise("")
    rows = rows.withColumn("piece", F.concat(head, "text", tail).cast("binary")).drop("first", "last", "text")
    rows = rows.withColumn("bytes", F.octet_length("piece").cast("long"))
    bucket = F.struct("chrom", F.col("seq_no").cast("long").alias("seq_no"), F.expr("cast(chunk_no as bigint) div 1024").alias("part"))
    return prefix_scan(rows, [], ["chrom", "seq_no", "chunk_no"], bucket, [("at", "sum", F.col("bytes"))], inclusive=False)


def write_a2m_at_once(msa: DataFrame, path: str, count: Counter | None = None) -> None:
    """The file of ``write_a2m``, byte for byte, written by all executors into one file of a shared folder.

    Each task writes its chunks at their own places of a draft, so a task that runs again writes the same bytes again; the draft takes its
    name when all are done. Only sums reach the driver.
    """
    rows = placed_chunks(msa).select("at", "bytes", "piece", (F.expr("substring(piece, 1, 1)") == F.lit(b">")).cast("int").alias("head"))
    draft = f"{path}.{uuid.uuid4().hex}.part"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = os.open(draft, os.O_WRONLY)
        written = heads = 0
        try:
            for batch in batches:
                for at, piece, head in zip(*(batch.column(c).to_pylist() for c in ("at", "piece", "head")), strict=True):
                    view = memoryview(piece)
                    while view:
                        done = os.pwrite(file, view, at)
                        view, at, written = view[done:], at + done, written + done
                    heads += head
            os.fsync(file)
        finally:
            os.close(file)
        if count:
            count.add(heads)
        yield pa.RecordBatch.from_pydict({"written": [written]})

    try:
        open(draft, "wb").close()
        done = rows.repartitionByRange("at").sortWithinPartitions("at").mapInArrow(put, "written long").agg(F.sum("written")).first()[0] or 0
        if os.path.getsize(draft) != done:
            raise OSError(f"{path}: {os.path.getsize(draft)} bytes instead of {done}")
        os.replace(draft, path)
    finally:
        Path(draft).unlink(missing_ok=True)


def write_a2m_parts(msa: DataFrame, path: str) -> None:
    """The same sequences as a folder of text files, in order: part files one after the other are one A2M file.

    Lines end with each chunk. A sequence may go over several files, so nothing is as large as a sequence.
    """
    head = msa.groupBy("chrom", "seq_no").agg(F.concat(F.lit(">"), F.first("seq_id")).alias("value")).withColumn("chunk_no", F.lit(-1).cast("long"))
    rows = head.unionByName(msa.select("chrom", "seq_no", F.col("text").alias("value"), F.col("chunk_no").cast("long")))
    rows.repartitionByRange("chrom", "seq_no", "chunk_no").sortWithinPartitions("chrom", "seq_no", "chunk_no").select("value").write.text(path)


def write_separate(msa: DataFrame, folder: str, *, chromosome: str | None = None, a2m: bool = True, aligned: bool = True, command: str | None = None, strict: bool = True, count: Counter | None = None) -> DataFrame:
    """One file a sequence, written by the executors; the folder must be shared. Returns (file, status, reason), one row a sequence.

    ``msa`` has ``name``, an array of the parts of the file name. Plain files have no header line. A command that fails is an
    error, or, if not ``strict``, a row with its status (null where it could not be run, with the reason).
    """

    def put(batches: Iterator) -> Iterator:
        import pandas as pd

        now, done, target = None, [], None
        stack = ExitStack()

        def close() -> None:
            if target is None:
                return
            status, reason = 0, None
            try:
                if out:
                    with suppress(BrokenPipeError):
                        out.write("\n")
                stack.close()
            except CommandFailed as e:
                if strict:
                    raise
                status, reason = e.status, e.reason
            done.append((target, *(failed or (status, reason))))
            if count:
                count.add(1)

        with stack:
            out = failed = None
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    if (r.chrom, r.seq_no) != now:
                        close()
                        now, out, failed = (r.chrom, r.seq_no), None, None
                        target = str(Path(folder) / file_name(list(r.name), chromosome=chromosome, a2m=a2m, aligned=aligned))
                        try:
                            out = stack.enter_context(_opened(command, target))
                        except CommandFailed as e:
                            if strict:
                                raise
                            failed = (e.status, e.reason)
                        if out and a2m:
                            with suppress(BrokenPipeError):
                                out.write(f">{r.seq_id}\n")
                    if out:
                        with suppress(BrokenPipeError):  # the command's status tells
                            out.write(r.text)
            close()
        yield pd.DataFrame(done, columns=["file", "status", "reason"]).astype({"status": "Int64"})

    Path(folder).mkdir(parents=True, exist_ok=True)
    rows = msa.repartition("chrom", "seq_no").sortWithinPartitions("chrom", "seq_no", "chunk_no").select("chrom", "seq_no", "seq_id", "name", "text")
    return rows.mapInPandas(put, "file string, status int, reason string")


def graphviz_lines(nodes: DataFrame, ref: DataFrame, edges: DataFrame) -> DataFrame:
    """(chrom, part, node, ord, line) of the node records, REF edges and ALT edges of a DOT file.

    ``ref`` is ``ref_edges`` with text, ``edges`` the ALT edges.
    """
    n = nodes.select("chrom", F.lit(0).alias("part"), "node", F.lit(0).cast("long").alias("ord"), F.format_string('\t%d [shape = Mrecord, label = "%d | %d | %d"];', "node", "node", "ref_pos", "aln_pos").alias("line"))
    r = ref.withColumn("label", F.col("text")).select("chrom", F.lit(1).alias("part"), F.col("src").alias("node"), F.lit(0).cast("long").alias("ord"), F.format_string('\t%d -> %d [label = "%s", penwidth = 2.0];', "src", "dst", abbreviated(F.col("label"))).alias("line"))
    a = edges.select("chrom", F.lit(1).alias("part"), F.col("src").alias("node"), (F.col("edge") + 1).alias("ord"), F.format_string('\t%d -> %d [label = "%s"];', "src", "dst", abbreviated(F.col("label"))).alias("line"))
    return n.unionByName(r).unionByName(a)


def write_graphviz(lines: DataFrame, path: str) -> None:
    """One DOT file of one chromosome, streamed in order; node numbers of several would mix, so they are refused."""
    if lines.select("chrom").distinct().limit(2).count() > 1:
        raise ValueError("a DOT file holds one chromosome: filter the lines by chrom")
    with _whole(path) as out:
        out.write("digraph variants\n{\n\trankdir = LR;\n\trank = same;\n")
        for r in lines.orderBy("part", "node", "ord").select("line").toLocalIterator():
            out.write(r["line"] + "\n")
        out.write("}\n")


def write_overlaps(report: DataFrame, path: str) -> None:
    cols = ["LINENO", "POS", "ID", "SAMPLE", "CHROM_COPY", "GT"]
    report.select(*cols).sort("LINENO", "SAMPLE", "CHROM_COPY").write.option("sep", "\t").option("header", True).csv(path)


def overlap_sentences(report: DataFrame) -> DataFrame:
    """(chrom, LINENO, line): the report as prose, for the standard output."""
    text = "Overlapping alternative alleles. Line number: %d current variant position: %d variant identifiers: %s sample: %s chromosome copy: %d genotype: %d"
    ids = F.array_join(F.split("ID", ","), ", ")
    return report.select("chrom", "LINENO", "SAMPLE", "CHROM_COPY", F.format_string(text, "LINENO", "POS", ids, "SAMPLE", "CHROM_COPY", "GT").alias("line"))


def write_regions(rows: DataFrame, folder: str) -> DataFrame:
    """NAME.fa for each region of (name, seq_no, seq_id, text), written by the executors; a file that is there already is an error."""

    def put(batches: Iterator) -> Iterator:
        import pandas as pd

        now, files = None, []
        with ExitStack() as stack:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    if r.name != now:
                        stack.close()
                        files.append(str(Path(folder) / f"{r.name}.fa"))
                        if Path(files[-1]).exists():
                            raise FileExistsError(files[-1])
                        out = stack.enter_context(_whole(files[-1]))
                        now = r.name
                    out.write(f">{r.seq_id}\n{r.text}\n")
        yield pd.DataFrame({"file": files})

    Path(folder).mkdir(parents=True, exist_ok=True)
    return rows.repartition("name").sortWithinPartitions("name", "seq_no").select("name", "seq_id", "text").mapInPandas(put, "file string")
