"""Whole Arrow batches of text as flat byte arrays: words, hashes and shingles without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a single longer text is one piece of its own.
PIECE_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]
_SHINGLE = np.random.default_rng(31).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: The characters \\x20 and \\x09 to \\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut the batches into runs of rows with about ``size`` bytes of text each."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.diff(offsets_of(sizes)[1]))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def offsets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more entry than texts); nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]), PIECE_BYTES + 1)
        for k, base in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of ``flat`` one after another, and where each begins in the result (one more entry than spans)."""
    to = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(starts - to[:-1], sizes) + np.arange(to[-1])], to


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] that depend on the bytes alone."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no space, and for each text the index of its first word.

    is_space has one entry per byte of data. A run never crosses the end of a text.
    """
    inside = ~is_space
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    first = inside & (begins[: len(data)] | np.concatenate([[True], ~inside])[: len(data)])
    starts = np.flatnonzero(first)
    stop = np.concatenate([first | ~inside, [True]]) | begins
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, "right")] if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside each text, and the index of each text's first run.

    A text with fewer than k words has its whole sequence as the only run; a text without words has none.
    """
    counts = np.diff(firsts)
    runs = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    begin = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(runs, out=begin[1:])
    doc = np.repeat(np.arange(len(runs)), runs)
    at = np.arange(begin[-1]) - begin[doc] + firsts[:-1][doc]
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    short = counts[doc]
    for j in range(k):
        part = padded[at + j] * _SHINGLE[j]
        out += part if j == 0 else np.where(short > j, part, np.uint64(0))
    return mixed(out + np.minimum(short, k).astype(np.uint64)), begin
