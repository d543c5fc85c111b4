"""Toxicity: averaged subword-bag embeddings under a linear softmax.

A word is the bag of its hashed character n-grams and its whole form; its vector is the mean of
their embeddings, so an unseen misspelling shares most of its vector with the word it bends. A
passage is the mean of its words' vectors, and a two-class softmax reads it. Embeddings and softmax are
trained together by full-batch Adam in numpy. A document is read in passages of ``PASSAGE`` words
that overlap by half, and its score is that of its worst passage, so length doesn't thin out an
insult; every word of every text is read.

Training rows: at most ``MAX_PER_CLASS`` labelled documents a class, lowest hash of the id first. The bias is set for the best F1, at
every size alike: one in ``CALIBRATE_EVERY`` labelled documents (by hash) is set aside, a second model is trained without them, and its best
threshold on at most ``MAX_CALIBRATE`` of them is taken over. No sample takes more than ``MAX_TRAIN_BYTES`` of text (all four are parameters); only whole texts are used,
and never a row of the held-out fold (crc32 of the id as text, modulo 5, is 0). Label, language, source and id are
no inputs of a score.

Since the head is linear, every word has one number (its share of the logit); executors keep a
bounded table of it. Defined cases: a null or empty text has the score of the bias alone; a null id
is never trained on and not held out; documents without label are scored like others; repeated
label rows count as toxic if any is; without both classes in the training rows every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, id_fold, packed, starts_of, text_groups
from .subword import ngram_buckets

SIZES = (3, 4, 5)
BUCKETS = 1 << 17
DIMS = 3
PASSAGE = 10
#: An n-gram needs this many training documents; rarer ones carry no weight.
MIN_DOCS = 5
DECAY = 6e-5
MAX_PER_CLASS = 800
MAX_CALIBRATE = 4000
CALIBRATE_EVERY = 4
MAX_TRAIN_BYTES = 48 << 20
#: Bias of a model without training rows.
UNTRAINED = -1e6
EDGE = ".,;:!?\"'()[]{}|*#<>"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def passage_starts(n: int) -> np.ndarray:
    """Starts of passages of PASSAGE words, half overlapping, that cover n words."""
    if n <= PASSAGE:
        return np.zeros(1, np.int64)
    half = PASSAGE // 2
    return np.arange(0, n - half, half)


def _passage_sums(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of each document's passages, number of passages by document, and word bounds."""
    base = starts_of(counts)
    starts = [passage_starts(n) + b for n, b in zip(counts.tolist(), base[:-1].tolist(), strict=True)]
    per = np.fromiter(map(len, starts), np.int64, len(starts))
    lo = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    hi = np.minimum(lo + PASSAGE, np.repeat(base[1:], per))
    run = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    size = np.maximum(hi - lo, 1)
    return (run[hi] - run[lo]) / (size if values.ndim == 1 else size[:, None]), per, np.stack([lo, hi])


class Model:
    """``grams`` holds each bucket's share of the logit (embedding times head); ``bias`` the rest."""

    def __init__(self, grams: np.ndarray, bias: float):
        self.grams, self.bias = grams, bias

    def word_logits(self, words: list[str]) -> np.ndarray:
        ids, owner = ngram_buckets([w.strip(EDGE) for w in words], SIZES, len(self.grams))
        n = np.bincount(owner, minlength=len(words))
        return (np.bincount(owner, self.grams[ids], minlength=len(words)) / np.maximum(n, 1)).astype(np.float32)

    def logits(self, texts: list[str | None], table: WordTable) -> np.ndarray:
        """Logit of each text's worst passage."""
        lists = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        values = table.values([w for ws in lists for w in ws]).astype(np.float64)
        means, per, _ = _passage_sums(values, counts)
        worst = np.maximum.reduceat(means, starts_of(per)[:-1]) if len(per) else means
        return worst + self.bias

    def scores(self, texts: list[str | None], table: WordTable) -> np.ndarray:
        logits = self.logits(texts, table)
        return np.where(logits <= UNTRAINED / 2, 0.0, 1.0 / (1.0 + np.exp(-np.clip(logits, -700, 700))))


def fit(texts: list[str], labels: np.ndarray, *, epochs: int = 120, rate: float = 0.2, seed: int = 7) -> Model:
    """Train embeddings and softmax together.

    A toxic document teaches by its worst passage under the present model and a clean one by all
    its passages (in equal shares), which is what the maximum over passages asks for.
    """
    labels = np.asarray(labels, np.int64)
    if not len(texts) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), UNTRAINED)
    lists = [[w.strip(EDGE) for w in words_of(t)] for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    index: dict[str, int] = {}
    seq = np.fromiter((index.setdefault(w, len(index)) for ws in lists for w in ws), np.int64, int(counts.sum()))
    vocab = list(index)
    del lists, index  # the driver's memory is bounded too
    ids, owner = ngram_buckets(vocab, SIZES, BUCKETS)
    per_word = np.bincount(owner, minlength=len(vocab)).astype(np.float64)
    in_doc = np.unique(np.repeat(np.arange(len(counts)), counts) * np.int64(len(vocab)) + seq) % len(vocab)
    docs_of_word = np.bincount(in_doc, minlength=len(vocab))
    frequent = np.bincount(ids, docs_of_word[owner], minlength=BUCKETS) >= MIN_DOCS
    keep = frequent[ids]
    used, ids = np.unique(ids[keep], return_inverse=True)
    owner = owner[keep]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.01, (len(used), DIMS))
    head = rng.normal(0, 0.5, (DIMS, 2))
    bias = np.zeros(2)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, head, bias)]
    _, per, (lo, hi) = _passage_sums(np.zeros(len(seq)), counts)
    first, doc = starts_of(per)[:-1], np.repeat(np.arange(len(per)), per)
    toxic = labels[doc] == 1
    share = np.where(toxic, 1.0, 1.0 / per[doc])
    size = np.maximum(hi - lo, 1)
    balance = np.array([0.5 / max(1, (labels == 0).sum()), 0.5 / max(1, (labels == 1).sum())])
    for step in range(1, epochs + 1):
        word_vec = np.stack([np.bincount(owner, emb[ids, d], minlength=len(vocab)) for d in range(DIMS)], axis=1) / per_word[:, None]
        run = np.concatenate([np.zeros((1, DIMS)), np.cumsum(word_vec[seq], axis=0)])
        mean = (run[hi] - run[lo]) / size[:, None]
        logits = mean @ head + bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        worst = np.maximum.reduceat(p[:, 1], first)[doc] == p[:, 1]
        weight = np.where(toxic, worst, share) * balance[labels[doc]]
        weight = np.where(toxic | ~worst, weight, np.maximum(weight, 0.5 * balance[0]))
        g = p.copy()
        g[np.arange(len(g)), labels[doc]] -= 1
        g *= weight[:, None]
        g_head, g_bias = mean.T @ g, g.sum(axis=0)
        g_mean = (g @ head.T) / size[:, None]
        # spread over the words: a running sum of passage gradients, opened at lo and closed at hi
        n = len(seq) + 1
        edge = np.stack([np.bincount(lo, g_mean[:, d], minlength=n) - np.bincount(hi, g_mean[:, d], minlength=n) for d in range(DIMS)], axis=1)
        at_word = np.cumsum(edge, axis=0)[:-1]
        g_word = np.stack([np.bincount(seq, at_word[:, d], minlength=len(vocab)) for d in range(DIMS)], axis=1) / per_word[:, None]
        g_emb = np.stack([np.bincount(ids, g_word[owner, d], minlength=len(used)) for d in range(DIMS)], axis=1) + DECAY * emb
        for (m, v), param, grad in zip(moments, (emb, head, bias), (g_emb, g_head, g_bias), strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    grams = np.zeros(BUCKETS)
    grams[used] = emb @ (head[:, 1] - head[:, 0])
    return Model(grams, float(bias[1] - bias[0]))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, h) of the labelled rows that may be learned from, one for each id."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    return marks.where(id_fold(F.col("doc_id")) != 0).withColumn("h", F.xxhash64("doc_id"))


def _read(docs: DataFrame, picked: DataFrame, max_bytes: int) -> tuple[list[str], np.ndarray]:
    """Whole texts of the picked ids (a bounded number) in hash order; a text that would go beyond ``max_bytes`` is left out.

    Of rows with one id the text with the smallest hash counts.
    """
    texts, marks, held = [], [], 0
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").withColumn("t", F.xxhash64("text"))
    last = None
    for r in rows.orderBy("h", "doc_id", "t").toLocalIterator():
        size = len(r["text"].encode())
        if r["doc_id"] == last or (held + size > max_bytes and texts):
            continue
        last = r["doc_id"]
        held += size
        texts.append(r["text"])
        marks.append(r["toxic"])
    return texts, np.array(marks, np.int64)


def best_bias(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold on worst-passage logits with the best F1 (middle of the gap it falls in); 0 without both labels."""
    if not len(labels) or labels.min() == labels.max():
        return 0.0
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # a cut can't fall between equal scores
    i = int(np.argmax(f1))
    return float((s[i] + s[i + 1]) / 2 if i + 1 < len(s) else s[i] - 1.0)


def train(docs: DataFrame, labels: DataFrame, *, max_per_class: int = MAX_PER_CLASS, max_calibrate: int = MAX_CALIBRATE, max_bytes: int = MAX_TRAIN_BYTES) -> Model:
    marks = labelled(labels)
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(CALIBRATE_EVERY)) == 0

    def fitted(rows: DataFrame) -> Model:
        some = [rows.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(max_per_class) for label in (0, 1)]  # a top-n a class, not a full sort
        return fit(*_read(docs, some[0].unionByName(some[1]), max_bytes))

    model, part = fitted(marks), fitted(marks.where(~aside))
    if part.bias > UNTRAINED:
        texts, truth = _read(docs, marks.where(aside).orderBy("h", "doc_id").limit(max_calibrate), max_bytes)
        table = WordTable(part.word_logits)
        logits = np.concatenate([np.zeros(0), *(part.logits(texts[i : i + 200], table) for i in range(0, len(texts), 200))])
        model.bias -= best_bias(logits, truth)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    rows = docs.select("doc_id", "text", F.coalesce(id_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"))
    return _scored(rows, train(docs, labels, **bounds))


def reject_toxic(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns."""
    return _scored(docs.select(packed(docs), "text"), train(docs, labels, **bounds)).where("predicted = 0").select("row.*")


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` without text, but with score and predicted."""
    shared = rows.sparkSession.sparkContext.broadcast((model.grams.astype(np.float32), model.bias))
    schema = rows.drop("text").schema
    names = list(schema.names)
    schema = schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        table = WordTable(own.word_logits)
        for part, texts in text_groups(batches):
            s = own.scores(texts, table)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return rows.mapInArrow(run, schema)
