"""Substring dedup with suffix automata of reference shards.

A window is ``length`` consecutive words of one document row; a word goes when a window over it also
starts anywhere else. Sending every document past automata of the whole corpus would take work in
proportion to the square of the corpus, so the shards are formed first by content:

1. The anchor of a window is its ``GRAM``-word gram with the smallest hash (leftmost of equals). Equal
   windows have equal anchors, so they can only meet in one shard. Windows in a row that share an anchor make a piece of at most
   2 * length - GRAM words. Pieces are counted by (anchor, content) before any shuffle, so
   a passage with thousands of copies is one counted row.
2. Three bitmaps of bounded size (``BITMAP_BITS`` each at most) are broadcast: anchors that come back, owners (one
   occurrence of each content, which sends its words), and very popular anchors. A second pass over the texts sends on
   only pieces that pass. A false hit costs a row and is dropped by the exact joins.
3. The distinct pieces of an anchor, with how often each occurs, form a reference shard. A suffix automaton over word
   hashes is built for a batch of shards (at most ``SHARD_WORDS`` words, or one anchor) and handed to the
   task that streams the pieces through it: matching statistics held at the window length give the state of
   each window, whose weighted end positions say how often it occurs. An anchor with one distinct content needs
   no automaton: its windows occur as often as it does.
4. An anchor with more than ``MAX_CONTENTS`` distinct contents would make one task as large as
   the passage is popular; its windows are counted by hash over all tasks instead, exactly.
5. Spans go back to their document; maximal spans are cut out there.

Words and windows are compared by 64-bit hashes (windows by anchor and content, 128 bits).

Defined cases: null and empty texts have no words; texts shorter than a window keep all their words;
repeated rows are elsewhere for each other; rows are told apart by id and text, so repeated or null
ids are fine; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import mix, powers, row_hashes, slice_hashes, words_of
from .common import bitmap, discard, in_bitmap, materialise, text_groups

LENGTH = 35
GRAM = 8
#: Widest bitmap; narrower ones are made for fewer entries. A false hit costs a row and is dropped by the exact joins.
BITMAP_BITS = 1 << 28
MAX_CONTENTS = 200
SHARD_WORDS = 40_000


def row_key(text: str = "text", doc_id: str = "doc_id"):
    """Tells rows apart by id and text; rows equal in both have equal spans anyway."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def find_pieces(texts: list[str | None], length: int, gram: int) -> dict[str, np.ndarray]:
    """Pieces of a group of texts: text number, first window, windows, anchor, content, and word hashes."""
    data, start, end, counts = words_of(texts)
    words = slice_hashes(data, start, end)
    n = len(words) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return {"text": none, "first": none, "windows": none, "anchor": none, "content": none, "words": words, "at": none}
    doc_end = np.cumsum(counts)
    doc_start = doc_end - counts
    grams = row_hashes(words, gram)
    span = length - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    place = np.empty(n, np.int64)
    for lo in range(0, n, 1 << 16):
        place[lo : lo + (1 << 16)] = view[lo : lo + (1 << 16)].argmin(axis=1)
    place += np.arange(n)
    owner = np.repeat(np.arange(len(counts)), counts)[:n]
    inside = np.arange(n) + length <= doc_end[owner]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new & inside)
    bound = np.flatnonzero(np.concatenate([new, [True]]) | np.concatenate([~inside, [True]]))
    windows = bound[np.searchsorted(bound, first, side="right")] - first
    stop = first + windows + length - 1
    # content hashes from one running sum over the word hashes
    content = slice_hashes_of_words(words, first, stop)
    return {"text": owner[first], "first": first - doc_start[owner[first]], "windows": windows, "anchor": grams[place[first]].view(np.int64), "content": content.view(np.int64), "words": words, "at": first}


def slice_hashes_of_words(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = powers(len(words) + 1, 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words) * power[: len(words)], out=run[1:])
        return mix((run[end] - run[start]) * inverse[start])


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for part, texts in text_groups(batches):
        p = find_pieces(texts, length, gram)
        if len(p["anchor"]):
            yield pa.RecordBatch.from_arrays([pa.array(p["anchor"]), pa.array(p["content"]), part.column("key").take(pa.array(p["text"]))], names=["anchor", "content", "key"])


PIECE = "anchor long, content long, key long, first int, windows int, hot boolean, words array<long>"


def _piece_rows(batches: Iterator[pa.RecordBatch], maps: tuple[np.ndarray, ...], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Pieces whose anchor comes back; the owner row of a content among several also sends its words."""
    again, owners, hot = maps
    for part, texts in text_groups(batches):
        p = find_pieces(texts, length, gram)
        pick = np.flatnonzero(in_bitmap(again, p["anchor"]))
        if not len(pick):
            continue
        anchor, content = p["anchor"][pick], p["content"][pick]
        key = part.column("key").to_numpy()[p["text"][pick]]
        full = in_bitmap(owners, anchor ^ content ^ key)
        at, size = p["at"][pick], np.where(full, p["windows"][pick] + length - 1, 0)
        ends = np.cumsum(size)
        flat = p["words"].view(np.int64)[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]))]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
        cols = [anchor, content, key, p["first"][pick].astype(np.int32), p["windows"][pick].astype(np.int32), in_bitmap(hot, anchor)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), lists], names=["anchor", "content", "key", "first", "windows", "hot", "words"])


# ---------------------------------------------------------------- the automaton


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; each counts as many times as its weight."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.count = [-1], [0], [0]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.len) - 1

    def add(self, words: list[int], weight: int) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)
            self.count[last] += weight

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        q = nxt[last].get(w)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = self._state(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link = self.next, self.link
        copy = self._state(self.len[p] + 1, dict(nxt[q]), link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def close(self) -> None:
        """Give every state the weight of all its end positions."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]

    def repeated(self, words: list[int], length: int) -> list[bool]:
        """For each window of a sequence: does it occur at least twice in what was added?"""
        nxt, link, longest, count = self.next, self.link, self.len, self.count
        v = matched = 0
        out = []
        for w in words:
            while v and w not in nxt[v]:
                v = link[v]
                matched = longest[v]
            if w in nxt[v]:
                v = nxt[v][w]
                matched += 1
            while longest[link[v]] >= length if v else False:
                v = link[v]
            matched = min(matched, longest[v])
            out.append(matched >= length and count[v] >= 2)
        return out[length - 1 :]


def spans_of(flags: list[bool]) -> list[tuple[int, int]]:
    """Runs of True as (first, end)."""
    out, i, n = [], 0, len(flags)
    while i < n:
        if flags[i]:
            j = i
            while j < n and flags[j]:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _shard_spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (anchor, content, n, words) -> spans of repeated windows of each content.

    A content comes as one row with its count and one or more with its words, in this order.
    """

    def flush(rows):
        auto = SuffixAutomaton()
        for _, _, n, words in rows:
            auto.add(words, n)
        auto.close()
        found = [(a, c, [{"a": x, "b": y} for x, y in spans_of(auto.repeated(words, length))]) for a, c, _, words in rows]
        found = [f for f in found if f[2]]
        return pa.RecordBatch.from_pydict({"anchor": pa.array([r[0] for r in found], pa.int64()), "content": pa.array([r[1] for r in found], pa.int64()), "spans": pa.array([r[2] for r in found], SPANS)})

    held, size, count = [], 0, None
    for batch in batches:
        for a, c, n, words in zip(*(batch.column(x).to_pylist() for x in ("anchor", "content", "n", "words")), strict=True):
            if n is not None:
                count = (a, c, n)
            elif count and count[:2] == (a, c):  # else a false hit of a bitmap, or words that came before
                if size >= SHARD_WORDS and a != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append((*count, words))
                size += len(words)
                count = None
    if held:
        yield flush(held)


def _window_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Each window of each content: (anchor, content, place, window hash, n)."""
    for batch in batches:
        for a, c, n, words in zip(*(batch.column(x).to_pylist() for x in ("anchor", "content", "n", "words")), strict=True):
            h = row_hashes(mix(np.array(words, np.int64).view(np.uint64)), length, 1).view(np.int64)
            yield pa.RecordBatch.from_pydict({"anchor": np.full(len(h), a), "content": np.full(len(h), c), "place": np.arange(len(h), dtype=np.int32), "window": h, "n": np.full(len(h), n)})


# ---------------------------------------------------------------- tables


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, bits: int = BITMAP_BITS, max_contents: int = MAX_CONTENTS) -> DataFrame:
    """(key, spans): for each row with repeated windows, word spans (a, end b) to take out; unordered."""
    spark = docs.sparkSession
    texts = docs.select(row_key().alias("key"), "text").where("text is not null")
    counted = texts.mapInArrow(lambda it: _anchor_rows(it, length, gram), "anchor long, content long, key long")
    counted = counted.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min("key").alias("owner"))
    counted = materialise(counted, "counted")
    anchors = counted.groupBy("anchor").agg(F.count("*").alias("contents"), F.sum("n").alias("total")).where("total > 1").drop("total")
    contents = materialise(counted.join(anchors, "anchor"), "contents")
    discard(counted)
    several = contents.where("contents > 1")
    bits = min(bits, 1 << max(16, (32 * contents.count()).bit_length()))
    maps = (bitmap(contents, "anchor", bits), bitmap(several.select(F.expr("anchor ^ content ^ owner").alias("h")), "h", bits), bitmap(several.where(F.col("contents") > max_contents), "anchor", bits))
    shared = spark.sparkContext.broadcast(maps)
    pieces = materialise(texts.mapInArrow(lambda it: _piece_rows(it, shared.value, length, gram), PIECE), "pieces")
    shared.unpersist()

    whole = contents.where("contents = 1").select("anchor", "content", F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"))
    words = pieces.where(F.size("words") > 0).select("anchor", "content", "hot", F.lit(None).cast("long").alias("n"), "words")
    counts = several.where(F.col("contents") <= max_contents).select("anchor", "content", "n", F.lit(None).cast("array<long>").alias("words"))
    few = words.where(~F.col("hot")).drop("hot").unionByName(counts)
    few = few.repartition("anchor").sortWithinPartitions("anchor", "content", F.col("n").asc_nulls_last())
    few = few.mapInArrow(lambda it: _shard_spans(it, length), "anchor long, content long, spans array<struct<a:int,b:int>>")

    hot = words.where("hot").drop("n").dropDuplicates(["anchor", "content"]).join(several.select("anchor", "content", "n"), ["anchor", "content"])
    windows = hot.mapInArrow(lambda it: _window_rows(it, length), "anchor long, content long, place int, window long, n long")
    often = windows.groupBy("anchor", "window").agg(F.sum("n").alias("m")).where("m > 1").drop("m")
    many = windows.join(often, ["anchor", "window"]).groupBy("anchor", "content").agg(F.collect_list(F.struct(F.col("place").alias("a"), (F.col("place") + 1).alias("b"))).alias("spans"))

    found = materialise(few.unionByName(many).unionByName(whole), "spans")
    parts = pieces.select("anchor", "content", "key", "first", "windows").join(found, ["anchor", "content"])
    all_of_it = F.array(F.struct(F.lit(0).alias("a"), F.col("windows").alias("b")))
    shifted = F.transform(F.coalesce("spans", all_of_it), lambda s: F.struct((s["a"] + F.col("first")).alias("a"), (s["b"] + F.col("first") + F.lit(length - 1)).alias("b")))
    # rows equal in id and text send the same spans: a set of them is as large as one row's own, however many rows there are
    return parts.select("key", shifted.alias("spans")).groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def keep_mask(n: int, spans) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["a"]] += 1
        edge[s["b"]] -= 1
    return np.cumsum(edge[:-1]) == 0


def remove_repeats(docs: DataFrame, *, with_text: bool = True, **how) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept text]) of every row of ``docs``."""
    spans = repeated_spans(docs, **how)
    rows = docs.select("doc_id", "text", row_key().alias("key")).join(spans, "key", "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_groups(batches):
            n, gone, sha, kept_text = [], [], [], []
            for text, own in zip(texts, part.column("spans").to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if own:
                    keep = keep_mask(len(words), own)
                    left = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                else:
                    left = words
                joined = b" ".join(left)
                n.append(len(words))
                gone.append(len(words) - len(left))
                sha.append(hashlib.sha256(joined).hexdigest())
                kept_text.append(joined)
            cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array([k.decode("utf-8", "replace") for k in kept_text], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
