"""Quality classification: histogram gradient-boosted trees over statistics of whole documents.

The statistics of a batch are computed on its bytes at once. Trees are grown on a bounded labelled sample, level by
level on binned features, and flattened into arrays, so that a batch walks all of them with numpy indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.text import SPACE, offsets_of, pieces, span_hashes, words

_CLASSES = np.full(256, 6, np.uint8)  # 6: bytes of letters outside ASCII
_CLASSES[[0x20, *range(9, 14)]] = 0
_CLASSES[97:123] = 1
_CLASSES[65:91] = 2
_CLASSES[48:58] = 3
for _c in ".,;:!?'\"()-":
    _CLASSES[ord(_c)] = 4
_CLASSES[[c for c in range(128) if _CLASSES[c] == 6]] = 5
FEATURES = (
    "log_bytes", "log_words", "lower", "upper", "digit", "punct", "symbol", "high", "space",
    "mean_word", "long_word", "one_byte_word", "distinct_words", "repeat_next", "shouted_words", "symbol_words",
    "log_lines", "words_per_line", "distinct_lines", "ends_in_stop", "pipes", "exclaims", "top_word",
)


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n owners the number of distinct hashes (by 44 bits of them), and how often the commonest occurs."""
    keys = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    owners, runs = (keys[fresh] >> np.uint64(44)).astype(np.int64), np.diff(np.append(fresh, len(keys)))
    top, begin = np.zeros(n), np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]])) if len(owners) else owners
    if len(owners):
        top[owners[begin]] = np.maximum.reduceat(runs, begin)
    return np.bincount(owners, minlength=n), top


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; empty and null texts have zeros."""
    data, offsets = offsets_of(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    kinds = _CLASSES[data]
    starts, ends, firsts = words(data, offsets, SPACE[data])
    count = np.diff(firsts)
    at_least = lambda x: np.maximum(x, 1).astype(np.float64)

    def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    shares = [per_text(kinds == k, offsets) / at_least(size) for k in (1, 2, 3, 4, 5, 6, 0)]
    length = ends - starts
    hashes = span_hashes(data, starts, ends)
    owner = np.repeat(np.arange(n), count)
    upper = np.concatenate([[0], np.cumsum(kinds == 2)])
    lower = np.concatenate([[0], np.cumsum((kinds == 1))])
    marks = np.concatenate([[0], np.cumsum(kinds == 5)])
    shouted = (upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    distinct, top = _distinct(owner, hashes, n)
    line_starts, line_ends, line_firsts = words(data, offsets, data == 10)
    lines = np.diff(line_firsts)
    line_owner = np.repeat(np.arange(n), lines)
    distinct_lines, _ = _distinct(line_owner, span_hashes(data, line_starts, line_ends), n)
    last = data[np.maximum(ends - 1, 0)] if len(ends) else data[:0]
    return np.column_stack([
        np.log1p(size), np.log1p(count), *shares,
        (per_text(~SPACE[data], offsets)) / at_least(count), per_text(length > 20, firsts) / at_least(count), per_text(length == 1, firsts) / at_least(count),
        distinct / at_least(count), per_text(same, firsts) / at_least(count), per_text(shouted, firsts) / at_least(count), per_text(marks[ends] > marks[starts], firsts) / at_least(count),
        np.log1p(lines), count / at_least(lines), distinct_lines / at_least(lines), per_text(last == 46, firsts) / at_least(count),
        per_text(data == 124, offsets) / at_least(count), per_text(data == 33, offsets) / at_least(count), top / at_least(count),
    ]).astype(np.float32)


@dataclass(frozen=True)
class Forest:
    """Trees side by side: in tree t, node i splits on ``feature[t, i]`` at ``threshold[t, i]``, its children are 2i+1 and 2i+2."""

    bias: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for t in range(len(self.value)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            total += self.value[t, node - (2**self.depth - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 1.0, least: int = 10) -> Forest:
    """Boost log loss: each level of a tree takes the best split of every node from gradient histograms of binned features."""
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves))
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Forest(float(np.log(share / (1 - share))), depth, feature[:0], threshold[:0], value[:0])
    share = y.mean()
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    bias = float(np.log(share / (1 - share)))
    raw = np.full(len(y), bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width = 2**level
            best = np.full(width, 1e-9)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                key = node * bins + codes[:, f]
                grids = [np.bincount(key, w, width * bins).reshape(width, bins).cumsum(axis=1) for w in (g, h, np.ones(len(y)))]
                (gl, hl, nl), (ga, ha, na) = grids, [z[:, -1:] for z in grids]
                gain = gl**2 / (hl + smooth) + (ga - gl) ** 2 / (ha - hl + smooth) - ga**2 / (ha + smooth)
                gain[(nl < least) | (na - nl < least)] = 0
                gain = gain[:, : len(e)]
                at = gain.argmax(axis=1)
                better = np.flatnonzero(gain[np.arange(width), at] > best)
                best[better] = gain[better, at[better]]
                feature[t, width - 1 + better], threshold[t, width - 1 + better] = f, e[at[better]]
            here = width - 1 + node
            node = 2 * node + (x[np.arange(len(y)), feature[t, here]] > threshold[t, here])
        value[t] = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + smooth)
        raw += value[t, node]
    return Forest(bias, depth, feature, threshold, value)


def train(labelled: DataFrame, max_rows: int = 20_000, **growing) -> Forest:
    """Fit on the rows (doc_id, text, label) with label 0 or 1, at most about ``max_rows`` of them, chosen by a hash of doc_id.

    Only their statistics reach the driver: ``max_rows`` rows of len(FEATURES) numbers. Null labels teach nothing.
    """
    labelled = labelled.where("label in (0, 1)")
    share = min(1.0, max_rows / max(1, labelled.count()))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            table = features(piece.column(2))
            yield pa.record_batch([piece.column(0).cast(pa.int64()), piece.column(1).cast(pa.int32()), pa.FixedSizeListArray.from_arrays(table.ravel(), table.shape[1]).cast(pa.list_(pa.float32()))], ["doc_id", "label", "x"])

    got = sample.mapInArrow(run, "doc_id long, label int, x array<float>").toPandas().sort_values(["doc_id", "label"])
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES)), np.float32)
    return grow(x.astype(np.float32), got["label"].to_numpy(np.float64), **growing)


def score(docs: DataFrame, forest: Forest, id_column: str = "doc_id", text_column: str = "text", keep: bool = False) -> DataFrame:
    """One row per input row: the id and ``score`` (0 to 1), or with ``keep`` all columns and ``quality_score``.

    Null and empty texts have the statistics of an empty text and get a score like any other. Repeated rows are scored
    one by one; further columns, whatever their names, take no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    slim = docs.select(*([F.col(f"`{c}`") for c in docs.columns] if keep else [F.col(id_column), F.col(text_column)]))
    name = "quality_score" if keep else "score"
    out = slim.withColumn(name, F.lit(0.0)).schema if keep else slim.select(id_column).withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_column):
            table = features(piece.column(piece.schema.get_field_index(text_column)))
            columns = [piece.column(i) for i in range(piece.num_columns)] if keep else [piece.column(0)]
            yield pa.record_batch([*columns, pa.array(shared.value.probability(table), pa.float64())], out.names)

    return slim.mapInArrow(run, out)
