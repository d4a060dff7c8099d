"""Arrays of words and bytes out of Arrow batches, for operators that run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes that are worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts have about ``limit`` bytes together."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 texts of a column; null is empty."""
    values = batch.column(column).cast(pa.binary()).to_pylist()
    return [v or b"" for v in values]


class WordHashes(dict):
    """64-bit hash of each word, kept for the words seen lately."""

    def __init__(self, limit: int = 300_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of all documents, and where each document starts (one entry more)."""
        starts = np.zeros(len(docs) + 1, np.int64)
        np.cumsum([len(d) for d in docs], out=starts[1:])
        out = np.empty(starts[-1], np.uint64)
        for words, at in zip(docs, starts.tolist()):
            out[at : at + len(words)] = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return out, starts


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` values from each position on; entries near the end run short and are not valid."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    # Doubling: a window of 2k values is made of two windows of k values.
    total, done, block, size, factor = np.zeros(n, np.uint64), 0, words.copy(), 1, _BASE
    left = width
    while left:
        if left & 1:
            shifted = np.zeros(n, np.uint64)
            if done < n:
                shifted[: n - done] = block[done:]
            total = total * np.uint64(factor % 2**64) + shifted
            done += size
        left >>= 1
        if left:
            ahead = np.zeros(n, np.uint64)
            if size < n:
                ahead[: n - size] = block[size:]
            block = block * np.uint64(factor % 2**64) + ahead
            size, factor = size * 2, factor * factor % 2**64
    return mix(total)


def valid_windows(starts: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a window of ``width`` words lies inside its document."""
    lengths = np.diff(starts)
    counts = np.maximum(lengths - width + 1, 0)
    first = np.repeat(starts[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(counts.sum(), dtype=np.int64) + first


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each position on (fewer near the end)."""
    out, size = values.copy(), 1
    while size < width:
        step = min(size, width - size)
        if step < len(out):
            out[:-step] = np.minimum(out[:-step], out[step:])
        size += step
    return out
