"""Columns of texts as arrays of letters inside tasks, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all texts one after the other, where each text begins and the last one ends); one byte a letter if all are ASCII."""
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if data.max(initial=0) < 0x80:
        return data, ends
    before = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), before[ends]


def strings(codes: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts between neighbouring ``ends`` as a column."""
    if codes.dtype != np.uint8:
        width = 1 + sum((codes >= low).astype(np.int64) for low in (0x80, 0x800, 0x10000))
        ends = np.append(0, np.cumsum(width))[ends]
        codes = np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(codes)))
