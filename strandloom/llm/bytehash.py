"""Vectorised 64-bit hashes of slices of a byte buffer, in numpy.

A slice's hash is a polynomial in an odd base over random 64-bit values of its bytes, modulo 2**64,
taken from one running sum over the buffer; odd numbers have inverses there, so every slice costs two
look-ups. The mixing step at the end spreads the result over all bits. Hashes are the same on every
machine.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_INVERSE = np.array([pow(int(b), -1, 1 << 64) for b in _BASE], np.uint64)
#: Entries of the tables of powers that a worker keeps.
KEPT = 1 << 22
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Byte classes of white space: space and the five control characters from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def powers(n: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, at least; tables of over ``KEPT`` entries live only as long as they are used."""
    held = _powers.get(lane)
    if held is None or len(held[0]) < n:
        size = 1 << max(16, n.bit_length())
        held = []
        with np.errstate(over="ignore"):
            for b in (_BASE[lane], _INVERSE[lane]):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                held.append(np.multiply.accumulate(p))
        held = tuple(held)
        if size <= KEPT:
            _powers[lane] = held
    return held


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of data[start:end] for each pair; ``data`` holds bytes."""
    power, inverse = powers(len(data) + 1, lane)
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[lane][data] * power[: len(data)], out=run[1:])
        return mix((run[end] - run[start]) * inverse[start])


def row_hashes(values: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive 64-bit values (none if there are fewer)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(values) + 1, lane)
    with np.errstate(over="ignore"):
        run = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=run[1:])
        return mix((run[width:] - run[:n]) * inverse[:n])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of a byte buffer."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[data], [True]])))
    return edge[0::2], edge[1::2]


def join_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(buffer, end of each text): UTF-8 bytes, each text followed by a line feed."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), ends


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, word starts, word ends, number of words of each text)."""
    data, ends = join_texts(texts)
    start, end = word_bounds(data)
    upto = np.searchsorted(start, ends)
    return data, start, end, np.diff(np.concatenate([[0], upto]))
