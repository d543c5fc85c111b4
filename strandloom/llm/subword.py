"""Character n-grams of words, hashed to a fixed number of buckets, in numpy."""

from __future__ import annotations

import numpy as np

#: Word borders; control characters don't occur inside words that were split at white space.
OPEN, CLOSE = "\x02", "\x03"
MIX = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(words: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, owner word of each n-gram); a word's own whole form is one of them."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = "".join(f"{OPEN}{w}{CLOSE}" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lens)
    out, who = [], []
    with np.errstate(over="ignore"):
        mixed = (codes + np.uint64(1)) * MIX
        mixed ^= mixed >> np.uint64(29)
        for n in sizes:
            if len(codes) < n:
                continue
            m = len(codes) - n + 1
            h = np.full(m, n, np.uint64)
            for j in range(n):
                h = h * MIX + mixed[j : j + m]
            h ^= h >> np.uint64(31)
            whole = owner[:m] == owner[n - 1 :]
            out.append((h[whole] * MIX >> np.uint64(17)) % np.uint64(buckets))
            who.append(owner[:m][whole])
        # whole words: the sum of position-weighted characters
        start = np.cumsum(lens) - lens
        place = (np.arange(len(codes)) - start[owner]).astype(np.uint64)
        h = np.add.reduceat(mixed * (place * np.uint64(2) + np.uint64(1)) * MIX, start)
        h ^= h >> np.uint64(33)
        out.append((h * MIX >> np.uint64(17)) % np.uint64(buckets))
        who.append(np.arange(len(words)))
    return np.concatenate(out).astype(np.int64), np.concatenate(who)
