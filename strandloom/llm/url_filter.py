"""URL filters by a sort-merge range join.

A host is written with its labels reversed and a closing dot (``blog.example.org`` becomes
``org.example.blog.``). In that order a rule for a host covers one interval of keys,
[``org.example.``, ``org.example/``), because ``/`` follows ``.``: the host and all its subdomains.
Rows are sorted by key inside their own partition (no exchange is needed, so a host with a third
of all rows stays spread out), and the sorted rules are swept alongside. A stack holds the nested
intervals that contain the present key; each stack entry keeps the path rules of its host.

Rules are read in sorted blocks of ``block_rules`` rules and ``BLOCK_CHARS`` characters at most; one block is broadcast at a
time. The best match so far travels with the row, and is written to the shared folder before the next block is broadcast, so any
number of rules works in bounded memory.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no rule.
Rules with a null or empty host never fit; a null path counts as empty. The longest rule
(host plus path, in characters) wins; on equal length the longer host, then ``block`` before
``allow``. Repeated rows are each judged. Empty tables give empty results. Only the id and URL
columns of the pages are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, materialise

MAX_RULE_CHARS = 4096
BLOCK_RULES = 50_000
BLOCK_CHARS = 8 << 20


def split_url(url):
    """(host, path) columns: host lower-cased in A-Z; both empty without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.expr("substring({0}, instr({0}, '://') + 3)".format("url"))
    host = F.when(has, F.regexp_extract(rest, r"^([^/?#]*)", 1)).otherwise("")
    path = F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    return ascii_lower(host), path


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


class _Sweep:
    """One pass over ascending keys; the stack holds the rule hosts that contain the present key."""

    def __init__(self, rules: list[tuple[bytes, str, str, str]]):
        by_key: dict[bytes, dict] = {}
        for key, host, path, verdict in rules:
            paths = by_key.setdefault(key, {})
            old = paths.get(path)
            if old is None or (old[1] == "allow" and verdict == "block"):
                paths[path] = (host, verdict)
        self.frames = [(k, by_key[k], sorted({len(p) for p in by_key[k]}, reverse=True)) for k in sorted(by_key)]
        self.next, self.stack = 0, []

    def best(self, key: bytes, path: str):
        """(length, host length, host + path, verdict) of the longest rule that fits, or None."""
        while self.next < len(self.frames) and self.frames[self.next][0] <= key:
            frame = self.frames[self.next]
            while self.stack and not frame[0].startswith(self.stack[-1][0]):
                self.stack.pop()
            self.stack.append(frame)
            self.next += 1
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()
        top = None
        for _, paths, lengths in self.stack:
            for n in lengths:
                hit = paths.get(path[:n]) if n <= len(path) else None
                if hit:
                    found = (len(hit[0]) + n, len(hit[0]), hit[0] + path[:n], hit[1])
                    if top is None or found[:2] > top[:2]:
                        top = found
                    break
        return top


def url_verdicts(
    pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", block_rules: int = BLOCK_RULES
) -> DataFrame:
    """Judge every URL: (id, host, path, rule, verdict).

    ``rules`` has host, path and verdict (``allow`` or ``block``). ``default`` is the verdict of a
    URL that no rule fits.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    rows = base.select("id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("key", F.when(F.col("host") == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split("host", "[.]")), "."), F.lit("."))))
    rows = rows.withColumns({"n": F.lit(-1), "hn": F.lit(-1), "rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    rows = before = rows.sortWithinPartitions("key")
    schema = rows.schema

    kept = rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> '' and verdict is not null").distinct()
    long = kept.where(F.length("host") + F.length("path") > MAX_RULE_CHARS).limit(1).count()
    if long:
        raise ValueError(f"a rule is longer than {MAX_RULE_CHARS} characters")
    ordered = kept.sort(F.array_join(F.reverse(F.split("host", "[.]")), "."), "path").toLocalIterator()
    shared = None
    for block in _blocks(ordered, block_rules):
        if shared is not None:  # the block before has done its work once its rows are written
            done = materialise(rows, "urls")
            discard(before)
            shared.unpersist()
            before = done
            rows = done.sortWithinPartitions("key")
        shared = spark.sparkContext.broadcast(block)
        rows = rows.mapInArrow(lambda it, shared=shared: _judge(it, shared.value), schema)
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")


def _blocks(rules, block_rules: int) -> Iterator[list[tuple[bytes, str, str, str]]]:
    block, chars = [], 0
    for r in rules:
        size = len(r["host"]) + len(r["path"])
        if block and (len(block) >= block_rules or chars + size > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((host_key(r["host"]).encode(), r["host"], r["path"], r["verdict"]))
        chars += size
    if block:
        yield block


def _judge(batches: Iterator[pa.RecordBatch], rules) -> Iterator[pa.RecordBatch]:
    sweep = _Sweep(rules)
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in ("key", "path", "n", "hn", "rule", "verdict")}
        for i, (key, path) in enumerate(zip(cols["key"], cols["path"], strict=True)):
            hit = sweep.best(key.encode(), path)
            if hit and hit[:2] > (cols["n"][i], cols["hn"][i]):
                cols["n"][i], cols["hn"][i], cols["rule"][i], cols["verdict"][i] = hit
        arrays = [pa.array(cols[f.name], f.type) if f.name in cols else batch.column(f.name) for f in batch.schema]
        yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
