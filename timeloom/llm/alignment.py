"""Alignment of two tokenizers over the same bytes.

Each byte of a text has an owner in A and an owner in B, the token that holds it: token numbers repeated over their bytes.
Consecutive distinct pairs of owners are the links between overlapping tokens; where both owners change at once the text can
be cut, and between two cuts stands a group of tokens that spell the same bytes.

Both tokenizers cut before a space that follows something else, so a text is a row of chunks that align on their own; of a
piece of a batch every distinct chunk is encoded and aligned once. How often two ids are linked in the whole corpus is
counted in Spark, and each piece gets the counts of its own pairs back: no table of pairs is held anywhere whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from timeloom.llm.session import checkpointed, short_shuffles
from timeloom.llm.text import offsets_of, pieces, ragged, span_hashes
from timeloom.llm.tokens import byte_letters

MARK = "▁"
#: Bytes of text that are aligned at once: the more, the fewer times a chunk is aligned and a pair asked for.
PIECE = 4 << 20
#: What is certainly no space: printable ASCII; and as the next byte, also the first of a character, but for those with which spaces begin.
PRINTABLE = np.zeros(256, bool)
PRINTABLE[0x21:0x7F] = True
SOLID = PRINTABLE.copy()
SOLID[0xC3:0xF5] = True
SOLID[[0xE1, 0xE2, 0xE3]] = False


@dataclass(frozen=True)
class Pair:
    """The files of tokenizers A (byte-level, ``tokenizers``) and B (``sentencepiece``), and the bytes of their ids."""

    a_file: str
    b_file: str
    a_bytes: tuple[bytes, ...]
    b_bytes: tuple[bytes, ...]

    @property
    def width(self) -> int:
        """The number of ids of B; a pair of ids is the number a * width + b."""
        return len(self.b_bytes)


def load(a_file: str, b_file: str) -> Pair:
    """Refused are a first file that isn't plainly byte-level, and a second one that normalises texts or has pieces across
    words: they don't cut where this module does."""
    with open(a_file, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"]
    if spec["normalizer"] or split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"]:
        raise ValueError(f"{a_file}: not a plain byte-level file")
    value = {c: b for b, c in enumerate(byte_letters())}
    named = {i: bytes(value[c] for c in token) for token, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    b = sentencepiece.SentencePieceProcessor(model_file=b_file)
    spelled = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    if "".join(b.encode(" X  ﬁ ", out_type=str)).replace("<0xEF><0xAC><0x81>", "ﬁ") != " X  ﬁ ".replace(" ", MARK).join([MARK, ""]):
        raise ValueError(f"{b_file}: normalises texts")
    if any(MARK in p.lstrip(MARK) for p in spelled):
        raise ValueError(f"{b_file}: has pieces across words")
    of_b = tuple(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(spelled))
    return Pair(a_file, b_file, tuple(named.get(i, b"") for i in range(max(named) + 1)), of_b)


@dataclass
class Aligned:
    """Distinct chunks, aligned: which ones both tokenizers spell (others have no tokens), their numbers of tokens and
    groups, each one's groups as written, and their links one after another."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    written: list[bytes]
    links: np.ndarray
    n_links: np.ndarray


class Aligner:
    """Encodes and aligns chunks, inside a task."""

    def __init__(self, pair: Pair):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.pair = pair
        self.a = Tokenizer.from_file(pair.a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pair.b_file)
        self.space = [self.b.piece_to_id(MARK)]
        self.a_size, self.b_size = (np.array([len(x) for x in of], np.int64) for of in (pair.a_bytes, pair.b_bytes))
        decimal = [f"{i},".encode() for i in range(max(len(self.a_size), len(self.b_size)))]
        self.decimal, self.decimal_at = np.frombuffer(b"".join(decimal), np.uint8), np.cumsum([0, *map(len, decimal)])

    def encode(self, chunks: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B of chunks that begin with a space; B adds that space itself, but not to nothing."""
        texts = [c.decode() for c in chunks]
        of_a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        of_b = [ids if ids else self.space for ids in self.b.encode([t[1:] for t in texts], num_threads=1)]
        return of_a, of_b

    def align(self, chunks: list[bytes]) -> Aligned:
        of_a, of_b = self.encode(chunks)
        spell_a, spell_b = self.pair.a_bytes.__getitem__, self.pair.b_bytes.__getitem__
        good = [b"".join(map(spell_a, a)) == c == b"".join(map(spell_b, b)) for a, b, c in zip(of_a, of_b, chunks, strict=True)]
        of_a, of_b = ([ids if g else [] for ids, g in zip(of, good, strict=True)] for of in (of_a, of_b))
        n_a, n_b = (np.array([len(ids) for ids in of], np.int64) for of in (of_a, of_b))
        a, b = (np.fromiter((i for ids in of for i in ids), np.int64) for of in (of_a, of_b))
        owner_a, owner_b = np.repeat(np.arange(len(a)), self.a_size[a]), np.repeat(np.arange(len(b)), self.b_size[b])
        new_a, new_b = (np.diff(owner, prepend=-1) != 0 for owner in (owner_a, owner_b))
        at, cut = np.flatnonzero(new_a | new_b), np.flatnonzero(new_a & new_b)
        chunk = np.repeat(np.arange(len(chunks)), n_a)[owner_a]
        n_links, n_groups = (np.bincount(chunk[x], minlength=len(chunks)) for x in (at, cut))
        text, ends = self._written(a, b, owner_a[cut], owner_b[cut])
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_groups)])].tolist()
        written = [text[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        return Aligned(np.array(good, bool), n_a, n_b, n_groups, written, a[owner_a[at]] * self.pair.width + b[owner_b[at]], n_links)

    def _written(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All groups as ``a1,a2|b1;``, one after another, and where each ends; given the first tokens of each group."""
        group_a = np.searchsorted(first_a, np.arange(len(a)), "right") - 1
        group_b = np.searchsorted(first_b, np.arange(len(b)), "right") - 1
        next_a, next_b = (np.append(first[1:], len(x)) if len(first) else first for first, x in ((first_a, a), (first_b, b)))
        # a token of A stands behind those of B in earlier groups, one of B behind those of A up to its own group
        to_a, to_b = np.arange(len(a)) + first_b[group_a], np.arange(len(b)) + next_a[group_b]
        ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[to_a], ids[to_b] = a, b
        mark[to_a[next_a - 1]], mark[to_b[next_b - 1]] = ord("|"), ord(";")
        out, to = ragged(self.decimal, self.decimal_at[ids], np.diff(self.decimal_at)[ids])
        out[to[1:] - 1] = mark
        return out.tobytes(), to[to_b[next_b - 1] + 1]


def chunks_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts with a space before each that isn't empty, as bytes; starts and ends of their chunks; and for each text
    the index of its first chunk (one more entry than texts)."""
    data, offsets = offsets_of(texts)
    full = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][full], 32)
    offsets = offsets + np.concatenate([[0], np.cumsum(full)])
    space = data == 32
    before, after = np.append(np.uint8(32), data[:-1]), np.append(data[1:], np.uint8(32))
    cut = space & (before != 32) & (PRINTABLE[before] | SOLID[after])[: len(data)] if len(data) else space
    cut[offsets[:-1][full]] = True
    starts = np.flatnonzero(cut)
    return data, starts, np.append(starts[1:], len(data))[: len(starts)], np.searchsorted(starts, offsets)


PIECES = "batch long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, ends array<int>, stream binary, links binary, link_ends array<int>"


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.astype(np.int32).tobytes(), 3)


def _unpacked(packed: pa.Scalar) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed.as_py()), np.int32).astype(np.int64)


def aligned(docs: DataFrame, pair: Pair, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece of a batch: its documents' ids and counts, the digests of their groups, their chunks as one packed
    stream with the documents' ends, and the links of each distinct chunk."""
    slim = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(pair)
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(shared.value)
        number = TaskContext.get().partitionId() << 32
        for piece in pieces(batches, size=PIECE):
            data, starts, ends, firsts = chunks_of(piece.column(1))
            _, at, stream = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            raw = data.tobytes()
            got = aligner.align([raw[starts[i] : ends[i]] for i in at])
            # a text with a chunk that isn't spelled has no tokens
            doc = np.repeat(np.arange(piece.num_rows), np.diff(firsts))
            spelled = np.bincount(doc[~got.good[stream]], minlength=piece.num_rows) == 0
            stream = stream[spelled[doc]]
            firsts = np.concatenate([[0], np.cumsum(np.where(spelled, np.diff(firsts), 0))])
            totals = [np.diff(np.concatenate([[0], np.cumsum(of[stream])])[firsts]) for of in (got.n_a, got.n_b, got.n_groups, got.n_links)]
            which, bounds = stream.tolist(), firsts.tolist()
            groups = [b"".join([got.written[i] for i in which[x:y]])[:-1] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            row = [number, piece.column(0).to_pylist(), *[t.tolist() for t in totals], digests, bounds[1:], _packed(stream), _packed(got.links), np.cumsum(got.n_links).tolist()]
            yield pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [f.split(" ")[0] for f in PIECES.split(", ")])
            number += 1

    return slim.mapInArrow(run, PIECES)


def piece_pairs(written: DataFrame) -> DataFrame:
    """For each piece the pairs of ids in it, and how many links hold them: columns ``batch``, ``pair``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, stream, links, ends = (batch.column(c)[row] for c in range(4))
                sizes = np.diff(np.array(ends.values, np.int64), prepend=0)
                times = np.repeat(np.bincount(_unpacked(stream), minlength=len(sizes)), sizes)
                pairs, which = np.unique(_unpacked(links), return_inverse=True)
                n = np.bincount(which, times, minlength=len(pairs)).astype(np.int64)
                pairs, n = pairs[n > 0], n[n > 0]
                yield pa.record_batch([pa.array(np.full(len(pairs), number.as_py(), np.int64)), pa.array(pairs.astype(np.int32)), pa.array(n)], ["batch", "pair", "n"])

    return written.select("batch", "stream", "links", "link_ends").mapInArrow(run, "batch long, pair int, n long")


RESULT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _judged(piece: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a piece with the sums over their links, given the counts of the piece's pairs."""
    row = {c: piece.column(c)[0] for c in piece.column_names}
    pairs = counts.column("pair").to_numpy().astype(np.int64)
    order = np.argsort(pairs)
    links, stream = _unpacked(row["links"]), _unpacked(row["stream"])
    # links of chunks that only texts without tokens have are not among the pairs, and stand nowhere in the stream
    at = order[np.minimum(np.searchsorted(pairs, links, sorter=order), max(0, len(order) - 1))] if len(order) else np.zeros(0, np.int64)
    ends, link_ends = np.array(row["ends"].values, np.int64), np.concatenate([[0], np.array(row["link_ends"].values, np.int64)])
    sums = []
    for name in ("best", "count"):
        if not len(order):
            sums.append(pa.array(np.zeros(len(ends), np.int64)))
            continue
        per_link = counts.column(name).to_numpy().astype(np.int64)[at]
        per_chunk = np.diff(np.concatenate([[0], np.cumsum(per_link)])[link_ends])
        sums.append(pa.array(np.diff(np.concatenate([[0], np.cumsum(per_chunk[stream])])[ends], prepend=0)))
    columns = [row["ids"].values, *[row[c].values for c in ("n_a", "n_b", "n_groups", "n_links")], *sums, row["digests"].values]
    return pa.table(columns, names=[f.split(" ")[0] for f in RESULT.split(", ")])


def pair_counts(pairs: DataFrame, width: int) -> DataFrame:
    """Over all pieces: ``pair``, ``count``, and ``best``: 1 where no other pair with its id of B has a higher count."""
    counted = checkpointed(pairs.groupBy("pair").agg(F.sum("n").alias("count")))
    of_b = F.pmod("pair", F.lit(width)).alias("b")
    # one row per id of B, so no more than its vocabulary has
    highest = counted.groupBy(of_b).agg(F.max("count").alias("highest"))
    return counted.withColumn("b", F.pmod("pair", F.lit(width))).join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))


def align(docs: DataFrame, pair: Pair, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_a`` and ``n_b`` tokens, ``n_groups``, ``n_links``, ``n_best`` (links whose pair of
    ids no other pair with that id of B exceeds in the corpus), ``count_sum`` (of all links' counts) and ``groups_sha256``.

    A is given a space and the text, B the text, to which it adds a space. Null and empty texts, and texts whose tokens
    don't spell a space and the text (those that hold the whitespace marker itself), have no tokens: zeros, an empty
    string for the digest, and no part in the counts. Repeated rows and rows that share an id, or have none, count one by
    one; among pairs with equal counts all are highest. Further columns are ignored whatever their names, an empty table
    gives an empty result. Within a piece, chunks are told apart by 64-bit hashes.
    """
    with short_shuffles(docs.sparkSession):
        written = checkpointed(aligned(docs, pair, id_column, text_column))
        pairs = piece_pairs(written)
        counts = pairs.select("batch", "pair").join(pair_counts(pairs, pair.width), "pair")
        judged = written.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(_judged, RESULT)
        return checkpointed(judged).withColumnRenamed("id", id_column)
