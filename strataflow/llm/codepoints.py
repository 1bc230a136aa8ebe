"""Texts of an Arrow batch as one array of code points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(points, offsets): all texts' code points in a row as uint32, and where each text begins; a null is an empty stretch.

    The Arrow buffer is decoded once; offsets of bytes become offsets of code points by counting the bytes that begin one.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    starts = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None and starts[-1] > starts[0] else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return points, before[starts - starts[0]]


def from_codepoints(points: np.ndarray, offsets: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    """The texts of to_codepoints() again, as an Arrow array; ``nulls`` marks texts that are null."""
    data = points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    raw = np.frombuffer(data, np.uint8)
    begins = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    bounds = begins[offsets].astype(np.int64)
    array = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data)])
    if nulls is not None and nulls.any():
        import pyarrow.compute as pc

        array = pc.if_else(pa.array(~nulls), array, pa.scalar(None, pa.large_string()))
    return array.cast(pa.string())


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For each code point the number of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def any_in_row(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text whether one of its code points is marked."""
    total = np.concatenate(([0], np.cumsum(marks)))
    return total[offsets[1:]] > total[offsets[:-1]]
