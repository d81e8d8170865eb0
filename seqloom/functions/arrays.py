"""Letters and k-mers of whole Arrow batches as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = 0xD6E8FEB86659FD93


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts in one array, offsets). Null counts as empty."""
    raw = pc.fill_null(texts, "").cast(pa.large_string())
    size = pc.utf8_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(raw.to_pylist())
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate(([0], np.cumsum(size)))


def kmer_hashes(codes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of every run of k letters that lies in one text."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    letter = (codes.astype(np.uint64) + np.uint64(1)) * _SPREAD
    letter ^= letter >> np.uint64(29)
    h, done = letter, 1  # the hashes of runs of `done` letters; doubled along the bits of k
    for bit in bin(k)[3:]:
        h = h[: len(h) - done] * np.uint64(pow(_FACTOR, done, 1 << 64)) + h[done:]
        done *= 2
        if bit == "1":
            h = h[:-1] * np.uint64(_FACTOR) + letter[done:]
            done += 1
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    ok = np.arange(n) + k <= offsets[text + 1]
    return text[ok], h[ok]


def counted(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, key) in order, and how often each occurs."""
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])))) if len(key) else np.zeros(0, np.int64)
    return text[first], key[first], np.diff(np.append(first, len(key)))
