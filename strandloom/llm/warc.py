"""WARC archives: write, normalise, read back.

``write_archives`` writes the records of every partition into one archive as a single gzip stream (the
form that many tools hand over). ``normalise`` takes such monolithic files: it inflates the whole-file
stream once, in bounded chunks, rewrites each record as a gzip member of its own, and writes a
sidecar index (one JSON line a record: offset and length of the member, type, record id, uri). ``read_archives``
uses the index alone to find the members. All files lie in a shared folder and are reached through
``pyarrow.fs``, so executors need no common disk. Each attempt at a task writes files of names of its own, and only the names that
a successful task returns are read, so a lost executor or a second attempt leaves nothing half-written in use. Monolithic files go
when all of them are normalised; archives and indexes stay, as they are the product.

Records with equal payloads of at least ``MIN_SHARED`` bytes: the one with the smallest page id is a
``response``; the others are ``revisit`` records, which name it and keep the HTTP header (with the
payload's length) but not the payload. Smaller payloads are always responses. Digests and the smallest
page id come from DataFrame aggregation, so a payload shared by a third of all pages is pre-aggregated. Where several rows have that
smallest page id, one of them (the smallest url) is the response.

Defined cases: null html is an empty payload; a null page id makes a record of its own (never the
target of a revisit) and comes back as null; rows that repeat a page id are separate records, and of those with one payload of
at least ``MIN_SHARED`` bytes all but one are revisits; an empty table gives no archive and no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, scratch_path

MIN_SHARED = 100
CHUNK = 1 << 20
LEVEL = 6
CRLF = b"\r\n"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def plan_records(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """(page_id, url, html, digest, n, kind, refers_to): one row for each row of ``pages``."""
    body = F.coalesce(F.col("html"), F.lit(""))
    columns = ["page_id", "url", "html", "digest", "n", "kind", "refers_to"]
    rows = pages.select("page_id", "url", "html").withColumns({"digest": F.sha2(body.cast("binary"), 256), "n": F.octet_length(body).cast("long")})
    first = rows.where((F.col("n") >= min_shared) & F.col("page_id").isNotNull()).groupBy("digest", "page_id").agg(F.count("*").alias("c"))
    first = first.groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.sum("c").alias("copies"), F.min_by("c", "page_id").alias("tied")).where("copies > 1")
    first = materialise(first.select("d", "first", "tied"), "first-pages")
    rows = rows.join(first, F.col("digest") == F.col("d"), "left").drop("d")
    revisit = lambda again: {"kind": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first"))}
    plain = rows.withColumns(revisit(F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first"))))
    if first.where("tied > 1").isEmpty():
        return plain.select(*columns)
    # rows that share the smallest page id are counted by url, and one of the first url is the response
    ties = (F.col("tied") > 1) & (F.col("page_id") == F.col("first"))
    equal = rows.where(ties).groupBy("digest", "page_id", "url", "n", "first").agg(F.first("html").alias("html"), F.count("*").alias("c"))
    order = Window.partitionBy("digest").orderBy(F.asc_nulls_last("url"))
    equal = equal.withColumn("place", F.row_number().over(order)).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))))
    return plain.where(~F.coalesce(ties, F.lit(False))).select(*columns).unionByName(equal.withColumns(revisit((F.col("place") > 1) | (F.col("i") > 1))).select(*columns))


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to, n: int) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join((url or '').split())}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


class Records:
    """Splits a stream of inflated bytes into whole WARC records."""

    def __init__(self):
        self.held = bytearray()
        self.need = 0

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held += data
        at = 0
        while True:
            end = self.held.find(CRLF + CRLF, at)
            if end < 0:
                break
            headers = parse_headers(bytes(self.held[at:end]))
            size = end + 4 + int(headers["content-length"]) + 4
            if size > len(self.held):
                break
            yield headers, bytes(self.held[at:size])
            at = size
        del self.held[:at]


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflate(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """Inflated chunks of bounded size of a gzip stream, whether of one member or of many."""
    z = zlib.decompressobj(31)
    while data := stream.read(chunk):
        while data:
            yield z.decompress(data, chunk)
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)


def _put(system: pafs.FileSystem, path: str, write) -> None:
    with system.open_output_stream(path, compression=None) as out:
        write(out)


def _attempt() -> str:
    """A name that no other attempt at this task has."""
    return f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"


def write_archives(pages: DataFrame, folder: str, *, min_shared: int = MIN_SHARED) -> DataFrame:
    """One monolithic archive for each partition with rows; returns (name, records), materialised."""
    rows = plan_records(pages, min_shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        system, root = open_fs(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{_attempt()}.warc.gz"
        count = 0

        def write(out):
            nonlocal count
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            batch = first
            while batch is not None:
                cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "kind", "refers_to", "n")]
                for page_id, url, html, digest, kind, refers, n in zip(*cols, strict=True):
                    out.write(z.compress(record_bytes(page_id, url, (html or "").encode(), digest, kind, refers, n)))
                    count += 1
                batch = next(batches, None)
            out.write(z.flush())

        _put(system, f"{root}/{name}", write)
        yield pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([count], pa.int64())})

    return materialise(rows.mapInArrow(run, "name string, records long"), "warc-names")


def normalise(files: DataFrame, folder: str, *, remove: bool = True) -> DataFrame:
    """Rewrite every named archive member by member, with a sidecar index; returns (name) of the new archives, materialised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                source, own = f"{root}/{name}", f"members-{_attempt()}-{name}"
                target = f"{root}/{own}"
                index: list[bytes] = []

                def write(out, source=source, index=index):
                    offset, records = 0, Records()
                    with system.open_input_stream(source, compression=None) as stream:
                        for data in inflate(stream):
                            for headers, record in records.feed(data):
                                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                                member = z.compress(record) + z.flush()
                                out.write(member)
                                entry = {"offset": offset, "length": len(member), "type": headers["warc-type"], "id": headers["warc-record-id"], "uri": headers["warc-target-uri"]}
                                index.append(json.dumps(entry).encode() + b"\n")
                                offset += len(member)
                    if records.held:
                        raise ValueError(f"{source} ends inside a record")

                _put(system, target, write)
                _put(system, f"{target}.idx", lambda out, index=index: out.write(b"".join(index)))
                yield pa.RecordBatch.from_pydict({"name": [own]})

    done = materialise(files.repartition(max(1, files.rdd.getNumPartitions()), "name").mapInArrow(run, "name string"), "warc-normalised")
    if remove:  # only now: until all new names are written down, a task may have to read its source again
        system, root = open_fs(folder)
        for r in files.select("name").toLocalIterator():  # one row a partition
            system.delete_file(f"{root}/{r['name']}")
    return done


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, uri) of every indexed record.

    A response's digest and length are computed from the payload and must agree with its header.
    """

    def page(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                out = []
                with system.open_input_stream(f"{root}/{name}.idx", compression=None) as idx, system.open_input_file(f"{root}/{name}") as data:
                    for line in _lines(idx):
                        entry = json.loads(line)
                        data.seek(entry["offset"])
                        raw = zlib.decompress(data.read(entry["length"]), 31)
                        head, _, rest = raw.partition(CRLF + CRLF)
                        h = parse_headers(head)
                        http, _, payload = rest[:-4].partition(CRLF + CRLF)
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest = h["warc-payload-digest"].removeprefix("sha256:")
                        if h["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{name}: a payload differs from its header")
                        out.append((page(h["warc-record-id"]), size, digest, h["warc-type"], page(h.get("warc-refers-to")), h["warc-target-uri"]))
                        if len(out) >= 5000:
                            yield _rows(out)
                            out = []
                yield _rows(out)

    return files.repartition(max(1, files.rdd.getNumPartitions()), "name").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string")


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while data := stream.read(CHUNK):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string())]
    cols = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, types, strict=True)], names=[n for n, _ in types])


def archive_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
