"""Token ids of whole texts by a public tokenizer file, with a bounded table of pieces seen before.

The tokenizer lower-cases, splits at white space and then into letter runs, single digits and runs of
anything else; the ids of a text are those of its pieces one after the other. That split is done here on
whole byte buffers in numpy, and each distinct piece is tokenised once while it stays in the table.
Words with an apostrophe, a ``<``, or any character beyond ASCII and the Latin-1 letters go to the
tokenizer whole, because there its own rules on contractions, special tokens, composition and case apply.
"""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers

from .bytehash import SPACE, join_texts, slice_hashes

CAP = 150_000
LEARN = 2000
LETTER, DIGIT, OTHER, LEAD, TAIL, ODD = 1, 2, 3, 4, 5, 6
CLASS = np.full(256, ODD, np.uint8)
CLASS[:128] = OTHER
CLASS[SPACE] = 0
CLASS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = LETTER
CLASS[ord("0") : ord("9") + 1] = DIGIT
CLASS[0x80:0xC0] = TAIL
CLASS[0xC3] = LEAD
CLASS[[ord("'"), ord("<")]] = ODD
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
WHOLE = np.uint64(0x5DEECE66D)
_loaded: dict[str, TextTokenizer] = {}


def pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased buffer, starts, ends, whether the piece is a word that must stay whole)."""
    kind = CLASS[data]
    space = kind == 0
    after = np.empty_like(kind)
    after[0], after[1:] = 0, kind[:-1]
    # a Latin-1 letter is the lead byte C3 and a tail byte that is not the sign of multiplication or division
    tail = kind == TAIL
    lead = after == LEAD
    odd = (kind == ODD) | (tail != lead) | (tail & ((data == 0x97) | (data == 0xB7)))
    lower = LOWER[data]
    capital = tail & lead & (data <= 0x9E)
    lower[capital] += 32
    group = kind.copy()
    group[(kind == LEAD) | tail] = LETTER
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    w0, w1 = edge[0::2], edge[1::2]
    count = np.concatenate([[0], np.cumsum(odd)])
    whole = count[w1] > count[w0]
    if whole.any():
        inside = np.zeros(len(data) + 1, np.int8)
        inside[w0[whole]] = 1
        inside[w1[whole]] -= 1
        keep = np.cumsum(inside[:-1]).astype(bool)
        group[keep] = ODD
        lower[keep] = data[keep]
    before = np.empty_like(group)
    before[0], before[1:] = 0, group[:-1]
    start = np.flatnonzero((group != 0) & ((group != before) | (group == DIGIT)))
    last = np.empty(len(group), bool)
    last[-1:] = True
    last[:-1] = (group[:-1] != group[1:]) | (group[:-1] == DIGIT)
    end = np.flatnonzero((group != 0) & last) + 1
    return lower, start, end, group[start] == ODD


class TextTokenizer:
    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(public_tokenizers.path(name))
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # ascending
        self.slot = np.zeros(0, np.int64)  # where each key's ids are
        self.flat = np.zeros(0, np.uint32)
        self.cuts = np.zeros(1, np.int64)
        self.used = np.zeros(0, np.int64)

    def _slim(self) -> None:
        """Keep the keys that were used again since they came, at most half the cap."""
        order = np.argsort(-self.used, kind="stable")[: CAP // 2]
        order = np.sort(order[self.used[order] > 1])
        start, size = self.cuts[self.slot[order]], self.cuts[self.slot[order] + 1] - self.cuts[self.slot[order]]
        ends = np.cumsum(size)
        self.flat = self.flat[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.cuts = np.concatenate([[0], ends]).astype(np.int64)
        self.keys, self.slot, self.used = self.keys[order], np.arange(len(order)), np.zeros(len(order), np.int64)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        # a few at a time: an encoding takes far more memory than its ids
        ids = [e.ids for lo in range(0, len(texts), LEARN) for e in self.tok.encode_batch_fast(texts[lo : lo + LEARN], add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        n = len(self.cuts) - 1
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum()))])
        self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(lens)])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slot = np.insert(self.slot, at, np.arange(n, n + len(keys)))
        self.used = np.insert(self.used, at, 0)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each whole text (none for null or empty)."""
        data, text_end = join_texts(texts)
        lower, start, end, whole = pieces(data)
        if not len(start):
            return [np.zeros(0, np.uint32) for _ in texts]
        h = slice_hashes(lower, start, end)
        h[whole] ^= WHOLE
        distinct, first, inverse, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        if len(self.keys) > CAP:
            self._slim()
        at = np.searchsorted(self.keys, distinct)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == distinct[known]
        if not known.all():
            new = first[~known]
            raw = lower.tobytes()
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            self._learn(distinct[~known], words)
            at = np.searchsorted(self.keys, distinct)
        self.used[at] += times
        slot = self.slot[at][inverse]
        begin = self.cuts[slot]
        size = self.cuts[slot + 1] - begin
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]))]
        run = np.concatenate([[0], ends])
        cut = run[np.searchsorted(start, text_end)].tolist()
        return [flat[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]


def tokenizer(name: str) -> TextTokenizer:
    """This worker's tokenizer of that file."""
    if name not in _loaded:
        _loaded[name] = TextTokenizer(name)
    return _loaded[name]
