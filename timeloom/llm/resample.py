"""Importance resampling towards a target: documents drawn by how much likelier their n-grams are in the target.

N-grams are hashed into buckets. The buckets of all n-grams of a piece of a batch are one packed stream of uint16 with the
offsets of its documents; streams are written once. To count, each is sorted and run-length encoded and the runs are
added up; to weigh, the gain of each bucket is gathered along the stream and added up between the offsets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.session import checkpointed
from timeloom.llm.text import LOWER, offsets_of, pieces, ragged, words

#: Everything in ASCII but digits and lower-case letters parts words.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)]] = False
#: Longer n-grams are hashed one by one.
LONG = 64


@dataclass(frozen=True)
class Resampling:
    """Runs of 1 to ``n`` words, ``buckets`` of them (65536 at most); of documents with ``least`` words ``percent`` are drawn."""

    n: int = 1
    buckets: int = 10_000
    least: int = 20
    percent: int = 10
    seed: int = 2024

    def __post_init__(self):
        if not 1 <= self.buckets <= 1 << 16:
            raise ValueError("buckets are 16-bit numbers")


def _crc_table() -> np.ndarray:
    rest = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rest = np.where(rest & 1, (rest >> 1) ^ np.uint32(0xEDB88320), rest >> 1)
    return rest


CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each span; all spans take their next byte together."""
    order = np.argsort(-np.minimum(sizes, LONG + 1), kind="stable")
    at, size = starts[order], sizes[order]
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    short = int(np.searchsorted(-size, -LONG, "left"))  # from here on, size <= LONG
    for j in range(LONG):
        to = int(np.searchsorted(-size[short:], -j, "left")) + short  # size > j
        if to <= short:
            break
        part = state[short:to]
        state[short:to] = CRC[(part ^ data[at[short:to] + j]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(short):
        state[i] = zlib.crc32(data[at[i] : at[i] + size[i]])
    out = np.empty(len(at), np.uint32)
    out[order] = state
    return out


def bucket_stream(texts: pa.Array, rule: Resampling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all n-grams, document after document; where each document's begin; and its number of words."""
    data, offsets = offsets_of(texts)
    data = LOWER[data]
    starts, ends, firsts = words(data, offsets, BETWEEN[data])
    counts = np.diff(firsts)
    if rule.n == 1:
        return (crc32s(data, starts, ends - starts) % np.uint32(rule.buckets)).astype(np.uint16), firsts, counts
    # words of a document one space apart, so that a run of words is one span
    flat, to = ragged(np.append(data, 32).astype(np.uint8), starts, ends - starts + 1)
    flat[to[1:] - 1] = 32
    doc = np.repeat(np.arange(len(counts)), counts)
    left = firsts[1:][doc] - np.arange(len(starts))
    spans = [(doc[left >= k], to[:-1][left >= k], to[k:][: len(starts) - k + 1][left[: len(starts) - k + 1] >= k] - 1) for k in range(1, rule.n + 1)]
    doc, begin, end = (np.concatenate(x) for x in zip(*spans, strict=True))
    order = np.argsort(doc, kind="stable")
    buckets = crc32s(flat, begin[order], (end - begin)[order]) % np.uint32(rule.buckets)
    return buckets.astype(np.uint16), np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(counts)))]), counts


STREAMS = "ids array<long>, offsets array<int>, n_words array<int>, stream binary"


def streams(docs: DataFrame, rule: Resampling, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: the ids of its documents, where each one's buckets begin (and the last ones end), its words, and the packed stream."""
    slim = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            stream, offsets, n = bucket_stream(piece.column(1), rule)
            row = [[piece.column(0).to_pylist()], [offsets.tolist()], [n.tolist()], [stream.tobytes()]]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["ids", "offsets", "n_words", "stream"])

    return slim.mapInArrow(run, STREAMS)


def bucket_counts(written: DataFrame, rule: Resampling) -> np.ndarray:
    """How often each bucket stands in the streams: each is sorted and run-length encoded, Spark adds the runs up.

    No more rows than there are buckets come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                stream = np.sort(np.frombuffer(row.as_buffer(), np.uint16))
                begin = np.flatnonzero(np.concatenate([[True], stream[1:] != stream[:-1]])[: len(stream)])
                runs = np.diff(np.append(begin, len(stream)))
                yield pa.record_batch([pa.array(stream[begin].astype(np.int32)), pa.array(runs.astype(np.int64))], ["bucket", "n"])

    out = np.zeros(rule.buckets, np.int64)
    for bucket, n in written.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, a thousand times the logarithm of how much likelier it is in the target, rounded down."""
    s, t, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + k) / ((a + 1) * (t + k)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(written: DataFrame, gains: np.ndarray) -> DataFrame:
    """One row per document: ``id``, ``n_features``, ``n_words`` and ``weight``, the sum of its buckets' gains."""
    shared = written.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                ids, offsets, n, stream = (batch.column(c)[row] for c in range(4))
                offsets = np.array(offsets.values, np.int64)
                sizes = np.diff(offsets)
                weight = np.zeros(len(sizes), np.int64)
                full = sizes > 0
                if full.any():
                    # between the begins of two documents with features, no others' features stand
                    weight[full] = np.add.reduceat(gains[np.frombuffer(stream.as_buffer(), np.uint16)], offsets[:-1][full])
                yield pa.record_batch([ids.values, pa.array(sizes), n.values.cast(pa.int64()), pa.array(weight)], ["id", "n_features", "n_words", "weight"])

    return written.mapInArrow(run, "id long, n_features long, n_words long, weight long")


def resample(docs: DataFrame, target: DataFrame, rule: Resampling = Resampling(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_features``, ``weight``, ``score`` and ``rank`` (null for those not drawn).

    The score is the weight plus Gumbel noise made of seed and id, so the draw is one without replacement and the same at
    every run. Drawn are the highest scores, ties to the smaller id, then to the one with more features. Null and empty
    texts have no features and weight 0. A row without an id has no noise, hence no score, and isn't drawn or counted
    among those to draw from; rows that share an id are drawn each for itself. With an empty target every bucket still has
    its one added count; an empty table gives an empty result. Further columns are ignored whatever their names.
    """
    spark = docs.sparkSession
    written = checkpointed(streams(docs, rule, id_column, text_column))
    wanted = bucket_counts(streams(target.select(F.lit(None).cast("long").alias("id"), F.col(text_column).alias("text")), rule, "id"), rule)
    weighed = weigh(written, gains_of(bucket_counts(written, rule), wanted))
    first = F.substring(F.sha2(F.concat(F.lit(f"{rule.seed}:"), F.col("id").cast("string")).cast("binary"), 256), 1, 8)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(first, 16, 10).cast("double") + 0.5) / 4294967296.0)))
    scored = checkpointed(weighed.withColumn("score", F.col("weight") + noise))
    may = (F.col("n_words") >= rule.least) & F.col("score").isNotNull()
    # rows in global order, numbered inside their partition; then what stands before each partition is added
    ordered = checkpointed(scored.where(may).orderBy(F.desc("score"), "id", F.desc("n_features")).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted((r[0], r[1]) for r in ordered.groupBy(part.alias("part")).count().collect())
    draw = rule.percent * sum(n for _, n in sizes) // 100
    before, seen = [], 0
    for p, n in sizes:
        before.append((p, seen))
        seen += n
    before = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    columns = [F.col("id").alias(id_column), "n_features", "weight", "score"]
    ranked = ordered.withColumn("part", part).join(before, "part").select(*columns, F.when(rank <= draw, rank).alias("rank"))
    return ranked.unionByName(scored.where(~F.coalesce(may, F.lit(False))).select(*columns, F.lit(None).cast("long").alias("rank")))
