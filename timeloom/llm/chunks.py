"""Substring deduplication by content-defined chunks.

A gear hash rolls over each text and sets borders that depend on the few bytes before them alone. From each border a chunk
goes to the first lesser border that is far enough, so chunks have varying lengths and overlap, and a passage has the same
ones wherever it stands: an insertion changes none but those around it. Chunks meet by digest. Where chunks that stand in
other documents follow one another, the run is extended to spans of the passage length, which are compared in turn: what
these cover is repeated, and a phrase that is shorter than a passage is not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.session import checkpointed, numbered, short_shuffles, small
from timeloom.llm.text import offsets_of, pieces, ragged, span_hashes

#: A digest with more than _HOT rows is dealt to tasks by _SALTED rows.
_HOT, _SALTED = 8192, 2048
#: Bytes that a border depends on: the bits of the hash that are tested take in no more.
WINDOW = 8
#: A chunk is its first byte shifted by so many bits, and its length.
_SIZE = 16
#: Chunks no further apart belong to one run: between two borders there may be more than a chunk's length.
BRIDGE = 32
_GEAR = np.random.default_rng(8).integers(0, 2**WINDOW, 256, dtype=np.uint8)


@dataclass(frozen=True)
class Chunking:
    """Chunks begin at borders, at which the highest ``bits`` bits of the hash are zero, and end at the first place ``least``
    bytes on or later at which the highest two are, at ``most`` bytes where none is. Where no border comes for ``most``
    bytes, as in one word over and over, the largest hashes are borders. A repeated passage counts from ``passage`` bytes on.
    """

    bits: int = 4
    least: int = 48
    most: int = 256
    passage: int = 100


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash h = 2 h + gear[byte] modulo 2**WINDOW at every byte: of a window of so many bytes, summed by doubling."""
    h = _GEAR[data]
    for step in (1, 2, 4):
        later = h.copy()
        later[step:] += h[:-step] << np.uint8(step) if len(h) > step else h[:0]
        h = later
    return h


def borders(data: np.ndarray, offsets: np.ndarray, rule: Chunking) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of all texts, in order of their starts; offsets are where texts begin, and the end."""
    hashes = gear(data)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # a border stands behind the byte at which the hash is tested, which has a whole window of its own text
    inside = np.arange(len(data)) - offsets[:-1][text] >= WINDOW - 1
    zero = lambda bits: np.flatnonzero(((hashes >> np.uint8(WINDOW - bits)) == 0) & inside) + 1
    starts, stops = zero(rule.bits), zero(2)
    starts = starts[starts < len(data)]
    starts = starts[text[starts] == text[starts - 1]]
    # the same window again and again, as in a row of one letter, is one border in 16 bytes
    again = (np.diff(starts, prepend=-16) < 16) & (hashes[starts - 1] == hashes[np.roll(starts, 1) - 1])
    starts = starts[~again | ((starts - offsets[text[starts]]) % 16 == 0)]
    bounds = np.unique(np.concatenate([offsets, starts]))
    more = []
    for i in np.flatnonzero(np.diff(bounds) > rule.most).tolist():
        last, end = int(bounds[i]), int(bounds[i + 1])
        while end - last > rule.most:
            last += rule.least + int(hashes[last + rule.least : last + rule.most].argmax())
            more.append(last)
    starts = np.sort(np.concatenate([starts, np.array(more, np.int64)]))
    stop = np.searchsorted(stops, starts + rule.least)
    ends = np.minimum(np.append(stops, len(data) + rule.most)[stop], starts + rule.most)
    whole = ends <= offsets[1:][text[starts]]
    return starts[whole], ends[whole]


def spans_of(starts: np.ndarray, ends: np.ndarray, size: int, rule: Chunking) -> np.ndarray:
    """Where to compare spans of ``passage`` bytes in a text of ``size`` bytes, given its chunks (sorted) that others have too.

    Around a run of chunks that is shorter than a passage all spans that hold the run; in a longer one those that begin
    where a chunk does, and the last one.
    """
    reach = np.maximum.accumulate(ends)
    first = np.concatenate([[True], starts[1:] > reach[:-1] + BRIDGE])
    run = np.cumsum(first) - 1
    begin, end = starts[first], reach[np.append(np.flatnonzero(first)[1:] - 1, len(starts) - 1)]
    short = end - begin < rule.passage
    low = np.maximum(end[short] - rule.passage, 0)
    many = np.maximum(np.minimum(begin[short], size - rule.passage) - low + 1, 0)
    around, _ = ragged(np.arange(size + 1), low, many)
    inner = starts[~short[run]]
    # where chunks begin far apart, more spans lie between, so that none of the run is left out
    steps = np.maximum(1, -(-np.diff(inner, append=inner[-1:]) // (rule.passage // 2)))
    filled = np.repeat(inner, steps) + (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)) * (rule.passage // 2)
    filled = filled[filled + rule.passage <= np.repeat(end[run][~short[run]], steps)]
    return np.unique(np.concatenate([around, filled, end[~short] - rule.passage]))


def _chunked(rows: DataFrame, rule: Chunking) -> DataFrame:
    """A row for each chunk of the rows (doc_id, text): its digest ``key``, its document, and its first byte and length as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            data, offsets = offsets_of(piece.column(1))
            starts, ends = borders(data, offsets, rule)
            text = np.searchsorted(offsets, starts, "right") - 1
            keys = span_hashes(data, starts, ends).view(np.int64)
            chunk = (starts - offsets[text] << _SIZE) + ends - starts
            yield pa.record_batch([pa.array(keys), piece.column(0).take(pa.array(text)), pa.array(chunk)], ["key", "doc_id", "chunk"])

    return rows.mapInArrow(run, "key long, doc_id long, chunk long")


def _packed(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, text) with their bytes compressed, which travel to where their chunks are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor()
        for piece in pieces(batches):
            packed = [compressor.compress(t.as_buffer()) for t in piece.column(1).cast(pa.binary())]
            yield pa.record_batch([piece.column(0), pa.array(packed, pa.binary())], ["doc_id", "packed"])

    return rows.mapInArrow(run, "doc_id long, packed binary")


def _spans(rows: DataFrame, rule: Chunking) -> DataFrame:
    """A row for each span of ``passage`` bytes around the chunks of the rows (doc_id, packed, chunks): ``doc_id``, ``at``,
    and its 96-bit digest as ``hi`` and ``lo``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blake, unpack = hashlib.blake2b, zstandard.ZstdDecompressor().decompress
        kind = np.dtype([("hi", "<i8"), ("lo", "<i4")])
        for batch in batches:
            for i, packed, chunks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw, chunks = unpack(packed.as_buffer()), chunks.values.to_numpy()
                places = spans_of(chunks >> _SIZE, (chunks >> _SIZE) + (chunks & (1 << _SIZE) - 1), len(raw), rule)
                digest = np.frombuffer(b"".join([blake(raw[a : a + rule.passage], digest_size=12).digest() for a in places.tolist()]), kind)
                yield pa.record_batch([pa.array(np.full(len(places), i, np.int64)), pa.array(places.astype(np.int32)), pa.array(digest["hi"].copy()), pa.array(digest["lo"].copy())], ["doc_id", "at", "hi", "lo"])

    return rows.mapInArrow(run, "doc_id long, at int, hi long, lo int")


def _in_others(rows: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """The rows (with ``doc_id``) whose digest ``by`` more than one document has: columns ``keep`` and ``first_doc``, the
    smallest id with it. A third of all rows may have one digest: those of such digests are salted."""
    with short_shuffles(rows.sparkSession):
        shared = checkpointed(
            rows.groupBy(*by).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n"))
            .where("first_doc <> last_doc")
            .select(*by, "first_doc", F.when(F.col("n") > _HOT, F.ceil(F.col("n") / _SALTED)).otherwise(1).cast("int").alias("salts"))
        )
    hot = small(shared.where("salts > 1").select(*by, "salts"))
    salted = rows.join(hot, by, "left").select(*by, *keep, F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*keep), F.col("salts"))).cast("int").alias("salt"))
    dealt = shared.select(*by, "first_doc", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return salted.join(dealt, [*by, "salt"]).select(*keep, "first_doc")


def repeated_spans(docs: DataFrame, rule: Chunking = Chunking(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The spans of ``passage`` bytes that stand in more than one document: ``doc_id``, ``at`` (the first byte) and
    ``first_doc``, the smallest id with it. Null and empty texts have none; a row without an id has none either."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null and text is not null")
    with short_shuffles(docs.sparkSession):
        found = _in_others(_chunked(rows, rule), ["key"], ["doc_id", "chunk"])
        of_doc = checkpointed(found.groupBy("doc_id").agg(F.array_sort(F.collect_set("chunk")).alias("chunks")))
    return _in_others(_spans(_packed(rows).join(of_doc, "doc_id"), rule), ["hi", "lo"], ["doc_id", "at"])


def _covered(starts, passage: int):
    """How many bytes the spans at the sorted ``starts`` cover, and in how many pieces."""
    n = F.size(starts)
    gaps = F.zip_with(F.slice(starts, 2, F.greatest(n - 1, F.lit(0))), F.slice(starts, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    size = F.when(n > 0, F.aggregate(gaps, F.lit(passage).cast("long"), lambda acc, g: acc + F.least(g, F.lit(passage)))).otherwise(0)
    return size.cast("long"), (1 + F.size(F.filter(gaps, lambda g: g > passage))).cast("long")


def _cut(raw: bytes, gone: list[int], passage: int) -> str:
    """A text without the spans that begin at the sorted ``gone``; a character that an end splits goes as a whole."""
    kept, done = [], 0
    for a in gone:
        kept.append(raw[done:a])
        done = a + passage
    return b"".join([*kept, raw[done:]]).decode("utf-8", "ignore")


def _without(rows: DataFrame, rule: Chunking, text_column: str) -> DataFrame:
    """``rows`` with the spans in their column ``__gone`` cut out of the text; that column goes."""
    names = [c for c in rows.columns if c != "__gone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_column):
            gone = piece.column(piece.schema.get_field_index("__gone")).to_pylist()
            columns = [piece.column(piece.schema.get_field_index(c)) for c in names]
            at = names.index(text_column)
            columns[at] = pa.array([_cut(t.encode(), g, rule.passage) if g and t is not None else t for t, g in zip(columns[at].to_pylist(), gone, strict=True)], pa.string())
            yield pa.record_batch(columns, names)

    return rows.mapInArrow(run, rows.drop("__gone").schema)


def repeats(docs: DataFrame, rule: Chunking = Chunking(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row with a passage that stands in another document too: ``doc_id``, ``n_passages``,
    ``repeated_bytes``, ``removed_bytes`` (of spans that a document with a smaller id has), ``first_docs`` (sorted ids of
    the first documents of all its spans, its own id left out) and ``text`` without the bytes removed.

    No passage of fewer than ``passage`` bytes is found. One is found if a chunk lies in it: of those of 100 bytes in random
    words nine in ten, of 138 more than 99 in a hundred, and of 250 all but one in 10**5. Its bytes count from its first
    chunk to the end of its last, so some 8 to 40 at either end may stay, but for short ones, which count whole.

    Rows that repeat an id and a text are one document. A row without an id, and each text of an id that has several, is a
    document of its own, that goes by a number of 2**62 or more. Null and empty texts have no passages. Further columns
    are ignored, and an empty table gives an empty result.
    """
    rows = numbered(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")))
    found = repeated_spans(rows, rule, "__row", "text")
    later = F.col("first_doc") < F.col("doc_id")
    per_row = found.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("at")).alias("all"), F.array_sort(F.collect_set(F.when(later, F.col("at")))).alias("__gone"), F.array_sort(F.collect_set(F.when(later, F.col("first_doc")))).alias("first_docs")
    )
    (size, n), (removed, _) = _covered(F.col("all"), rule.passage), _covered(F.col("__gone"), rule.passage)
    counted = per_row.select(F.col("doc_id").alias("__row"), n.alias("n_passages"), size.alias("repeated_bytes"), removed.alias("removed_bytes"), "first_docs", "__gone")
    with short_shuffles(docs.sparkSession):  # spans are off the disks before texts are dealt
        counted = checkpointed(counted)
    return _without(rows.join(counted, "__row").drop("__row"), rule, "text").select("doc_id", "n_passages", "repeated_bytes", "removed_bytes", "first_docs", "text")


def deduplicated(docs: DataFrame, rule: Chunking = Chunking(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, with all their columns, without the bytes of spans that documents with smaller ids have.

    Spans are cut out of the UTF-8 bytes; a character that an end splits loses its other half too. The cases are those
    of repeats(): each row is cut by its own text. Rows without repeats and null texts stay as they are.
    """
    rows = numbered(docs, id_column, text_column)
    spans = repeated_spans(rows, rule, "__row", text_column).where(F.col("first_doc") < F.col("doc_id"))
    with short_shuffles(docs.sparkSession):
        gone = checkpointed(spans.groupBy(F.col("doc_id").alias("__row")).agg(F.array_sort(F.collect_set("at")).alias("__gone")))
    return _without(rows.join(gone, "__row", "left").drop("__row"), rule, text_column).select(*[F.col(f"`{c}`") for c in docs.columns])
