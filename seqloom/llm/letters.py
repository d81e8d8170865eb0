"""Sequences as arrays of letters: upper case, without '-' and white space.

Bytes below 128 stand for themselves. Other characters, which no sequence format has, are compared by
their code point modulo 128.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32
_KEPT = np.ones(256, bool)
_KEPT[[ord(c) for c in "- \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"]] = False
_GAPS = re.compile(r"[-\s]")


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all texts in one array, offsets of length n + 1). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if len(raw) and raw.max() >= 128:
        texts = [_GAPS.sub("", t.upper()) for t in column.to_pylist()]
        codes = [np.array([o if o < 128 else 128 + o % 128 for o in map(ord, t)], np.uint8) for t in texts]
        return np.concatenate(codes), np.concatenate(([0], np.cumsum([len(c) for c in codes]))).astype(np.int64)
    kept = _KEPT[raw]
    total = np.concatenate(([0], np.cumsum(kept)))
    return _UPPER[raw[kept]], total[offsets].astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor-shift-multiply rounds)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


#: A 64-bit number for each letter.
LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
BASE, MASK = np.uint64(0xD1342543DE82EF95), 0xFFFFFFFFFFFFFFFF


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every run of size values along the last axis; each bit of size doubles or adds a run."""
    done, out = 0, None
    run, run_power, length = values, BASE, 1
    while size:
        if size & 1:
            if out is None:
                out, done = run, length
            else:
                n = values.shape[-1] - done - length + 1
                out = out[..., :n] * run_power + run[..., done : done + n]
                done += length
        size >>= 1
        if size:
            n = values.shape[-1] - 2 * length + 1
            if n <= 0:
                return values[..., :0]
            run = run[..., :n] * run_power + run[..., length : length + n]
            run_power, length = np.uint64(int(run_power) ** 2 & MASK), 2 * length
    return out


def first_least(h: np.ndarray, size: int) -> np.ndarray:
    """Position of the first smallest value in each run of size values."""
    n = len(h) - size + 1
    at, length = np.arange(len(h)), 1
    while 2 * length <= size:
        a, b = at[: len(at) - length], at[length:]
        at, length = np.where(h[a] <= h[b], a, b), 2 * length
    if length < size:
        a, b = at[:n], at[size - length : size - length + n]
        at = np.where(h[a] <= h[b], a, b)
    return at[:n]
