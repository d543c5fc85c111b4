"""Language ID: script ranges narrow the candidates, Viterbi labels the spans.

Each word has one score for every learned language: the sum of the log probabilities of its hashed
character n-grams. The script of the word's letters (by Unicode range) leaves only languages that were seen
in that script; others are ruled out by ``OFF_SCRIPT``, which no gain makes up for. A text's candidates are the languages that are left for any
of its words; with one candidate there is nothing to decide. A Viterbi pass over a document's words with a
fixed switching penalty gives the most likely sequence of labels, so a text of mixed language comes out
as labelled spans, and a single odd word doesn't split a span.

A document needs no pass if no stretch of words gains more than half the penalty against the best single label. Proof: let a sequence
have k runs of other labels, each of which gains at most g. If k = 1 it is the whole text (which gains nothing, the label being
the best single one) or costs one switch at least, and g is less. If k > 1 it costs k - 1 switches at least, and gains k * g <= k / 2 *
penalty <= (k - 1) * penalty.

Texts of over ``LONG_TEXT`` characters are labelled exactly like others, in chunks of words: a first pass collects their scripts and with them the candidates; in
the second only the best label and one bit for each word and language are kept for the way back. There is no limit on languages; words held at a time are bounded by words x languages (``CELLS``).

Training rows: at most ``MAX_PER_LANG`` whole documents a language, lowest hash of the id first, of the
folds that aren't held out, and ``MAX_TRAIN_BYTES`` of text a language (parameters). Of rows with one id, those that are equal to
it count each. Language, source and id are no inputs of a prediction.

Defined cases: null text, or text without a letter, is ``und`` with score 0 and no span; a script that no learned
language uses gives the best n-gram language with a score of 1 / languages; nothing to learn from
gives ``und``. Words without letters belong to the span around them. Null ids are predicted, not learned
from. Repeated rows are each predicted; very long texts are labelled whole.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, id_fold, starts_of, text_groups
from .subword import ngram_buckets

SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 15
PENALTY = 12.0
OFF_SCRIPT = -1e4
SCRIPT_SHARE = 0.005
MAX_PER_LANG = 600
MAX_TRAIN_BYTES = 8 << 20
LONG_TEXT = 1 << 20
CELLS = 1 << 23

#: First code point of each range of the Unicode blocks that tell scripts apart.
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
_POINTS = [p for p, _ in SCRIPT_STARTS]
_CODES = [SCRIPTS.index(s) for _, s in SCRIPT_STARTS]


def script_of(word: str) -> tuple[int, int]:
    """(script number of the first letter or -1, number of letters)."""
    letters = [c for c in word if c.isalpha()]
    return (_CODES[bisect.bisect_right(_POINTS, ord(letters[0])) - 1] if letters else -1), len(letters)


class Model:
    def __init__(self, langs: list[str], logs: np.ndarray, allowed: np.ndarray):
        self.langs, self.logs, self.allowed = langs, logs, allowed

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Scores by language, then the number of letters, then 1 if no language has the script, then the script (-1 without letters)."""
        n = len(self.langs)
        out = np.zeros((len(words), n + 3), np.float32)
        kinds = [script_of(w) for w in words]
        script = np.fromiter((s for s, _ in kinds), np.int64, len(words))
        out[:, n] = [m for _, m in kinds]
        ids, owner = ngram_buckets(words, SIZES, self.logs.shape[1])
        for k in range(n):
            out[:, k] = np.bincount(owner, self.logs[k][ids], minlength=len(words))
        known = script >= 0
        fits = self.allowed[:, script].T
        none = known & ~fits.any(axis=1)
        out[:, :n] += np.where(fits | none[:, None] | ~known[:, None], 0.0, OFF_SCRIPT)
        out[~known, :n] = 0.0
        out[:, n + 1] = none
        out[:, n + 2] = script
        return out


def fit(rows: Iterator[tuple[str, str]]) -> Model | None:
    """Train on (text, language) pairs."""
    counts: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for text, lang in rows:
        words = [w for w in text.lower().split() if any(map(str.isalpha, w))]
        if not words:
            continue
        own = counts.setdefault(lang, np.zeros(BUCKETS))
        seen = scripts.setdefault(lang, np.zeros(len(SCRIPTS)))
        own += np.bincount(ngram_buckets(words, SIZES, BUCKETS)[0], minlength=BUCKETS)
        for w in words:
            s, n = script_of(w)
            seen[s] += n
    langs = sorted(counts)
    if not langs:
        return None
    table = np.stack([counts[k] for k in langs]) + 0.5
    shares = np.stack([scripts[k] / scripts[k].sum() for k in langs])
    return Model(langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32), shares >= SCRIPT_SHARE)


def train(docs: DataFrame, *, max_per_lang: int = MAX_PER_LANG, max_bytes: int = MAX_TRAIN_BYTES) -> Model | None:
    spark = docs.sparkSession
    rows = docs.select("doc_id", "lang", "text").where("doc_id is not null and lang is not null and text is not null").where(id_fold(F.col("doc_id")) != 0)
    counts = rows.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return None
    # a hash threshold for each language lets through about twice the bound; the reader stops at the bound
    span = 1 << 32
    limit = spark.createDataFrame([(r["lang"], min(span, int(span * min(1.0, (2 * max_per_lang + 50) / r["count"])))) for r in counts], "lang string, top long")
    h = F.xxhash64("doc_id").bitwiseAND(span - 1)
    some = rows.withColumn("h", h).join(F.broadcast(limit), "lang").where("h < top").orderBy("h", "doc_id", F.xxhash64("text"))

    def picked():
        n, held = dict.fromkeys((r["lang"] for r in counts), 0), dict.fromkeys((r["lang"] for r in counts), 0)
        for r in some.toLocalIterator():
            lang = r["lang"]
            size = len(r["text"].encode())
            if n[lang] < max_per_lang and (not n[lang] or held[lang] + size <= max_bytes):
                n[lang] += 1
                held[lang] += size
                yield r["text"], lang

    return fit(picked())


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best label sequence of every score matrix (words x labels), worked off side by side."""
    out: list = [None] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    at = 0
    while at < len(order):
        longest = max(1, len(scores[order[at]]))
        group = order[at : at + max(1, 400_000 // longest)]
        at += len(group)
        k = scores[group[0]].shape[1]
        best = np.zeros((len(group), k))
        back = np.zeros((longest, len(group), k), np.int16)
        lens = [len(scores[i]) for i in group]
        padded = np.zeros((longest, len(group), k), np.float32)
        for j, i in enumerate(group):
            padded[: lens[j], j] = scores[i]
        live = len(group)
        same = np.arange(k)
        final = np.zeros(len(group), np.int64)
        for t in range(longest):
            while lens[live - 1] <= t:
                live -= 1
                final[live] = best[live].argmax()
            v = best[:live]
            if t:
                top = v.argmax(axis=1)
                jump = v[np.arange(live), top][:, None] - penalty
                move = jump > v
                back[t, :live] = np.where(move, top[:, None], same)
                v = np.where(move, jump, v)
            best[:live] = v + padded[t, :live]
        for j in range(live):
            final[j] = best[j].argmax()
        for j, i in enumerate(group):
            labels = np.empty(lens[j], np.int64)
            now = final[j]
            for t in range(lens[j] - 1, -1, -1):
                labels[t] = now
                now = back[t, j, now]
            out[i] = labels
    return out


def is_single(scores: np.ndarray, top: int, penalty: float) -> bool:
    """Whether no stretch of words gains more than half the penalty against label ``top`` throughout."""
    run = np.cumsum(scores - scores[:, top : top + 1], axis=0)
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, scores.shape[1])), run[:-1]]), axis=0)
    return bool((run - low).max() <= penalty / 2)


def label_words(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Label sequence of each score matrix (words x labels); only documents that may switch get the full pass."""
    out: list = [None] * len(scores)
    hard = []
    for i, r in enumerate(scores):
        s = r.astype(np.float64)
        if not len(s) or s.shape[1] == 1:
            out[i] = np.zeros(len(s), np.int64)
            continue
        top = int(s.sum(axis=0).argmax())
        if is_single(s, top, penalty):
            out[i] = np.full(len(s), top, np.int64)
        else:
            hard.append(i)
    for width in {scores[i].shape[1] for i in hard}:
        own = [i for i in hard if scores[i].shape[1] == width]
        for i, labels in zip(own, viterbi([scores[i] for i in own], penalty), strict=True):
            out[i] = labels
    return out


def label_chunks(chunks: Iterator[np.ndarray], penalty: float) -> np.ndarray:
    """The Viterbi path of one long text, from its score matrices in order."""
    best, tops, moves, k = None, [], [], 0
    for scores in chunks:
        k = scores.shape[1]
        top, move = np.zeros(len(scores), np.int32), np.zeros((len(scores), k), bool)
        for t, s in enumerate(scores.astype(np.float64)):
            if best is None:
                best = s.copy()
                continue
            top[t] = best.argmax()
            jump = best[top[t]] - penalty
            move[t] = jump > best
            best = np.maximum(best, jump) + s
        tops.append(top)
        moves.append(np.packbits(move, axis=1))
    if best is None:
        return np.zeros(0, np.int64)
    top, move = np.concatenate(tops), np.concatenate(moves)
    labels = np.empty(len(top), np.int64)
    now = int(best.argmax())
    for t in range(len(top) - 1, -1, -1):
        labels[t] = now
        if move[t, now >> 3] >> (7 - (now & 7)) & 1:
            now = int(top[t])
    return labels


def candidates(allowed: np.ndarray, scripts: np.ndarray) -> np.ndarray:
    """Languages that are left for any of these scripts; all of them if none is."""
    fits = np.flatnonzero(allowed[:, scripts].any(axis=1)) if len(scripts) else np.zeros(0, np.int64)
    return fits if len(fits) else np.arange(len(allowed))


class Reader:
    """Labels texts with a model, holding at most about ``CELLS`` scores at a time."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty, self.n = model, penalty, len(model.langs)
        self.words = max(1000, CELLS // self.n)
        self.table = WordTable(model.word_rows, cap=min(150_000, self.words))

    def read(self, texts: list[str | None]) -> list[tuple[str, float, list[dict]]]:
        """(language, score, spans) of each text."""
        out: list = [None] * len(texts)
        short: list[tuple[int, list[str]]] = []
        held = 0
        for i, text in enumerate(texts):
            if text and (len(text) > LONG_TEXT or len(text) > 4 * self.words):
                out[i] = self._long(text)
                continue
            words = (text or "").lower().split()
            if short and held + len(words) > self.words:
                self._short(short, out)
                short, held = [], 0
            short.append((i, words))
            held += len(words)
        self._short(short, out)
        return out

    def _short(self, docs: list[tuple[int, list[str]]], out: list) -> None:
        values = self.table.values([w for _, ws in docs for w in ws])
        cut = starts_of([len(ws) for _, ws in docs])
        rows = [values[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        kinds = [candidates(self.model.allowed, np.unique(r[r[:, self.n] > 0, self.n + 2]).astype(np.int64)) for r in rows]
        labels = label_words([r[:, k] for r, k in zip(rows, kinds, strict=True)], self.penalty)
        for (i, _), r, k, found in zip(docs, rows, kinds, labels, strict=True):
            out[i] = self._answer(k[found], r[:, self.n].astype(np.float64), bool(r[r[:, self.n] > 0, self.n + 1].all()))

    def _long(self, text: str) -> tuple[str, float, list[dict]]:
        """The same in chunks of words: a pass for the scripts, which name the candidates as in short texts, and one for the labels."""
        lower = text.lower()

        def chunks() -> Iterator[np.ndarray]:
            found = (m.group() for m in re.finditer(r"\S+", lower))
            while words := list(islice(found, self.words)):
                yield self.table.values(words)

        scripts: set[int] = set()
        letters, odd = [], []
        for r in chunks():
            known = r[:, self.n] > 0
            scripts.update(np.unique(r[known, self.n + 2]).astype(int).tolist())
            letters.append(r[:, self.n].astype(np.float64))
            odd.append(bool(r[known, self.n + 1].all()))
        kept = candidates(self.model.allowed, np.array(sorted(scripts), np.int64))
        labels = label_chunks((r[:, kept] for r in chunks()), self.penalty)
        return self._answer(kept[labels], np.concatenate([np.zeros(0), *letters]), all(odd))

    def _answer(self, labels: np.ndarray, letters: np.ndarray, odd: bool) -> tuple[str, float, list[dict]]:
        total = letters.sum()
        if not total:
            return "und", 0.0, []
        share = np.bincount(labels, letters, minlength=self.n) / total
        best = int(share.argmax())
        ends = [*(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
        spans = [{"start": a, "end": b, "lang": self.model.langs[labels[a]]} for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return self.model.langs[best], 1.0 / self.n if odd else float(share[best]), spans


def identify(docs: DataFrame, *, train_on: DataFrame | None = None, penalty: float = PENALTY, **bounds) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans) for every row; spans are of words, end excluded.

    The predicted language is the one whose spans hold most letters; its share is the score.
    """
    spark = docs.sparkSession
    model = train(docs if train_on is None else train_on, **bounds)
    shared = spark.sparkContext.broadcast(model and (model.langs, model.logs, model.allowed))
    rows = docs.select("doc_id", "text", F.coalesce(id_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value and Model(*shared.value)
        reader = own and Reader(own, penalty)
        for part, texts in text_groups(batches):
            found = reader.read(texts) if reader else [("und", 0.0, [])] * len(texts)
            cols = [part.column("doc_id"), part.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], span_type)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
