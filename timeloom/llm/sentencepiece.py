"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of scored pieces.

Characters that no piece covers are written as byte pieces; decoding joins pieces, turns whitespace markers back into
spaces and byte pieces into their bytes. The vocabulary comes from a model file, whose path is a parameter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.text import offsets_of, pieces, span_hashes

MARK = "▁"
#: Distinct chunks of text whose pieces a task remembers before it starts afresh; the last so many stay at hand.
REMEMBERED = 200_000
#: Tells the first chunk of a text from an equal one elsewhere.
_FIRST = np.uint64(0x5851F42D4C957F2D)
#: Score of a character without a piece, below the worst piece.
UNKNOWN_PENALTY = 10.0


#: A text that any other normalisation than none would change.
_PROBE = "  a  \ufb01 \uff21\tE\u0301\n "


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with log scores, and a double-array trie over the UTF-8 bytes of the ordinary ones.

    ``base[s] + byte`` is the next state if ``check`` there holds s; ``leaf[s]`` is the piece that ends in s, or -1.
    """

    pieces: tuple[str, ...]
    scores: np.ndarray
    byte_ids: np.ndarray
    base: np.ndarray
    check: np.ndarray
    leaf: np.ndarray
    worst: float

    @property
    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes every piece decodes to, in a row, and where each begins."""
        byte_of = {int(i): bytes([b]) for b, i in enumerate(self.byte_ids) if i >= 0}
        parts = [byte_of.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lay a trie of byte strings out in three arrays: base, check and leaf."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, piece in keys.items():
        at = 0
        for byte in key:
            nxt = children[at].get(byte)
            if nxt is None:
                nxt = children[at][byte] = len(children)
                children.append({})
                ends.append(-1)
            at = nxt
        ends[at] = piece
    size = 2 * len(children) + 1024
    base, check, leaf = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = bytearray(size)
    used[0] = 1
    place, todo = {0: 0}, deque([0])
    hints = [1] * 258  # by the number of labels: where the last state with so many found its place
    while todo:
        node = todo.popleft()
        state = place[node]
        leaf[state] = ends[node]
        labels = sorted(children[node])
        if not labels:
            continue
        start = hints[len(labels)]
        while True:
            if start + 512 > len(used):
                grow = len(used)
                used.extend(bytes(grow))
                base, check, leaf = (np.concatenate([a, np.full(grow, v, np.int32)]) for a, v in ((base, 0), (check, -1), (leaf, -1)))
            if not any(used[start + x] for x in labels):
                break
            start += 1
        base[state] = hints[len(labels)] = start
        for x in labels:
            used[start + x] = 1
            check[start + x] = state
            place[children[node][x]] = start + x
            todo.append(children[node][x])
    return base, check, leaf


def load(path: str) -> Vocabulary:
    """Read pieces and scores of a model file of the sentencepiece library (on the driver; the file is small).

    Texts are encoded as they are, with one marker in front: a model that changes them first, by other forms of characters
    or fewer spaces, is refused.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.normalize(_PROBE) != (" " + _PROBE).replace(" ", MARK):
        raise ValueError("the model normalises texts, which encode() doesn't")
    n = model.get_piece_size()
    return vocabulary(
        [model.id_to_piece(i) for i in range(n)],
        [model.get_score(i) for i in range(n)],
        {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)},
        {int(model.id_to_piece(i)[3:-1], 16): i for i in range(n) if model.is_byte(i)},
    )


def vocabulary(names: list[str], scores: list[float], special: set[int], byte_pieces: dict[int, int]) -> Vocabulary:
    """Build the trie of all pieces that are neither special nor byte pieces. Byte fallback needs all 256 byte pieces."""
    if len(byte_pieces) != 256:
        raise ValueError("the vocabulary has no complete set of byte pieces")
    left_out = special | set(byte_pieces.values())
    keys = {p.encode(): i for i, p in enumerate(names) if i not in left_out}
    if any(MARK in p.lstrip(MARK) for i, p in enumerate(names) if i not in left_out):
        raise ValueError("a piece has a whitespace marker after another character")
    ordinary = [scores[i] for i in keys.values()]
    return Vocabulary(tuple(names), np.array(scores, np.float64), np.array([byte_pieces[b] for b in range(256)]), *double_array(keys), min(ordinary, default=0.0) - UNKNOWN_PENALTY)


def viterbi(data: bytes, v: Vocabulary) -> list[int]:
    """The pieces of the best path through one chunk; of equal paths the one whose last differing piece is longer wins."""
    n = len(data)
    score, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    score[0] = 0.0
    base, check, leaf, scores = v.base, v.check, v.leaf, v.scores
    starts = [i for i in range(n) if data[i] & 0xC0 != 0x80]
    for k, i in enumerate(starts):
        here, state, single = score[i], 0, False
        one = starts[k + 1] if k + 1 < len(starts) else n
        for j in range(i, n):
            nxt = int(base[state]) + data[j]
            if check[nxt] != state or not base[state]:
                break
            state = nxt
            if (p := int(leaf[state])) >= 0:
                single |= j + 1 == one
                if here + scores[p] > score[j + 1]:
                    score[j + 1], back[j + 1], piece[j + 1] = here + float(scores[p]), i, p
        if not single and here + v.worst > score[one]:
            score[one], back[one], piece[one] = here + v.worst, i, -1
    out: list[int] = []
    at = n
    while at:
        i = back[at]
        out.extend([piece[at]] if piece[at] >= 0 else [int(v.byte_ids[b]) for b in reversed(data[i:at])])
        at = i
    return out[::-1]


def viterbi_many(chunks: list[bytes], v: Vocabulary) -> list[list[int]]:
    """viterbi() of many short chunks at once: all of them advance together through the trie."""
    order = sorted(range(len(chunks)), key=lambda i: -len(chunks[i]))
    width = len(chunks[order[0]]) if chunks else 0
    size = np.array([len(chunks[i]) for i in order])
    n = len(order)
    grid = np.frombuffer(b"".join(chunks[i].ljust(width + 1, b"\0") for i in order), np.uint8).reshape(n, width + 1).T.astype(np.int32)
    head = (grid & 0xC0) != 0x80
    score = np.full((width + 1, n), -np.inf)
    score[0] = 0
    back, piece = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
    for i in range(width):
        rows = np.flatnonzero(head[i, : np.searchsorted(-size, -i, "left")])
        here, state, single = score[i, rows], np.zeros(len(rows), np.int32), np.zeros(len(rows), bool)
        live, at, j = rows, np.arange(len(rows)), i
        while len(live):
            step = v.base[state]
            nxt = step + grid[j, live]
            good = (step > 0) & (v.check[nxt] == state) & (size[live] > j)
            live, state, at = live[good], nxt[good], at[good]
            if not len(live):
                break
            j += 1
            found = v.leaf[state]
            hit = found >= 0
            r, p, a = live[hit], found[hit], at[hit]
            single[a[head[j, r] & (_first_head(head, i, r, j))]] = True
            cand = here[a] + v.scores[p]
            better = cand > score[j, r]
            r, p = r[better], p[better]
            score[j, r], back[j, r], piece[j, r] = cand[better], i, p
        bare = rows[~single]
        if len(bare):
            base_score = here[~single] + v.worst
            end = np.full(len(bare), i + 1)
            for _ in range(3):
                end += (end < size[bare]) & ~head[np.minimum(end, width), bare]
            better = base_score > score[end, bare]
            score[end[better], bare[better]], back[end[better], bare[better]], piece[end[better], bare[better]] = base_score[better], i, -1
    out: list[list[int]] = [[] for _ in chunks]
    byte_ids = v.byte_ids.tolist()
    backs, pieces_ = back.T.tolist(), piece.T.tolist()
    for k, i in enumerate(order):
        at, ids, b, p = len(chunks[i]), [], backs[k], pieces_[k]
        while at:
            ids.extend([p[at]] if p[at] >= 0 else [byte_ids[x] for x in reversed(chunks[i][b[at] : at])])
            at = b[at]
        out[i] = ids[::-1]
    return out


def _first_head(head: np.ndarray, i: int, rows: np.ndarray, j: int) -> np.ndarray:
    """Whether no character begins between positions i and j, so that [i, j) is a single one."""
    return ~head[i + 1 : j, rows].any(axis=0) if j > i + 1 else np.ones(len(rows), bool)


def _encoder(v: Vocabulary):
    young: dict[int, np.ndarray] = {}
    old: dict[int, np.ndarray] = {}
    mark = MARK.encode()

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text's ids."""
        nonlocal young, old
        data, offsets = offsets_of(texts)
        raw, space, size = data.tobytes(), data == 32, np.diff(offsets)
        # a chunk is a run of spaces with the run of other bytes after it, or the spaces at the end of a text: no piece
        # crosses such a border. The first chunk of a text gets a marker in front.
        begin = np.zeros(len(data) + 1, bool)
        begin[offsets] = True
        border = begin[:-1] | (space & ~np.concatenate([[False], space])[:-1])
        starts = np.flatnonzero(border)
        ends = np.append(starts[1:], len(data))
        first = begin[starts]
        keys = span_hashes(data, starts, ends) ^ np.where(first, _FIRST, np.uint64(0))
        distinct, at, which = np.unique(keys, return_index=True, return_inverse=True)
        known = distinct.tolist()
        found: list = [young.get(k) for k in known]
        fresh = []
        for i, k in enumerate(known):
            if found[i] is None:
                got = old.get(k)
                if got is None:
                    fresh.append(i)
                else:
                    found[i] = young[k] = got
        chunks = []
        for i in fresh:
            c = raw[starts[at[i]] : ends[at[i]]].replace(b" ", mark)
            chunks.append(mark + c if first[at[i]] else c)
        order = sorted(range(len(fresh)), key=lambda i: len(chunks[i]))
        for k in range(0, len(order), 4096):
            part = order[k : k + 4096]
            many = [i for i in part if len(chunks[i]) <= 64]
            results = viterbi_many([chunks[i] for i in many], v) + [viterbi(chunks[i], v) for i in part[len(many) :]]
            for i, ids in zip(part, results, strict=True):
                found[fresh[i]] = young[known[fresh[i]]] = np.array(ids, np.int32)
        if len(young) > REMEMBERED:
            young, old = {}, young
        lengths = np.array([len(x) for x in found], np.int64)
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        places = np.concatenate([[0], np.cumsum(lengths)])
        counts = lengths[which]
        to = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(places[which] - to[:-1], counts) + np.arange(to[-1])]
        bounds = to[np.searchsorted(starts, offsets)]
        return ids, np.diff(bounds)

    return encode


def encode(docs: DataFrame, v: Vocabulary, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: the id, ``pieces`` (array of ids), ``n_pieces`` and ``n_fallback`` (byte pieces among them).

    Null and empty texts have no pieces; every other text is encoded whole, behind one whitespace marker. Repeated rows
    are encoded one by one and further columns are ignored.
    """
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        is_byte = np.zeros(len(shared.value.pieces), bool)
        is_byte[shared.value.byte_ids] = True
        for piece in pieces(batches):
            ids, counts = encoder(piece.column(1))
            ends = np.concatenate([[0], np.cumsum(counts)])
            falls = np.concatenate([[0], np.cumsum(is_byte[ids])])[ends]
            arrays = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.record_batch([piece.column(0), arrays, pa.array(counts.astype(np.int32)), pa.array(np.diff(falls).astype(np.int32))], ["id", "pieces", "n_pieces", "n_fallback"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, pieces array<int>, n_pieces int, n_fallback int").withColumnRenamed("id", id_column)


def decode_flat(ids: np.ndarray, ends: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all decoded texts in a row without their leading space, and where each begins."""
    size = at[ids + 1] - at[ids]
    to = np.concatenate([[0], np.cumsum(size)])
    out = flat[np.repeat(at[ids] - to[:-1], size) + np.arange(to[-1])]
    bounds = to[ends]
    full = bounds[1:] > bounds[:-1]
    drop = bounds[:-1][full][out[bounds[:-1][full]] == 32]
    keep = np.ones(len(out), bool)
    keep[drop] = False
    gone = np.concatenate([[0], np.cumsum(~keep)])
    return out[keep], bounds - gone[bounds]


def decode(encoded: DataFrame, v: Vocabulary, id_column: str = "doc_id", pieces_column: str = "pieces") -> DataFrame:
    """One row per input row: the id and ``text``. Null and empty piece lists give an empty text.

    Bytes that are not UTF-8 (possible only for lists that no encoding made) become U+FFFD.
    """
    slim = encoded.select(F.col(id_column).alias("id"), F.col(pieces_column).cast("array<int>").alias("pieces"))
    shared = encoded.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, at = shared.value.flat
        for batch in batches:
            yield pa.record_batch([batch.column(0), decode_array(batch.column(1), flat, at)], ["id", "text"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)


def decode_array(lists: pa.Array, flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """The texts of an array of piece lists."""
    sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
    ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out, bounds = decode_flat(ids, np.concatenate([[0], np.cumsum(sizes)]), flat, at)
    raw = out.tobytes()
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())


def round_trip(docs: DataFrame, v: Vocabulary, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """Encode, decode what was encoded, and compare: the columns of encode(), ``same`` (the text came back) and, with
    ``with_text``, the decoded ``text``.

    A null text comes back as an empty one, which counts as the same. A text that holds the whitespace marker itself
    comes back with a space in its place.
    """
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        flat, at = shared.value.flat
        is_byte = np.zeros(len(shared.value.pieces), bool)
        is_byte[shared.value.byte_ids] = True
        for piece in pieces(batches):
            ids, counts = encoder(piece.column(1))
            ends = np.concatenate([[0], np.cumsum(counts)])
            falls = np.concatenate([[0], np.cumsum(is_byte[ids])])[ends]
            out, bounds = decode_flat(ids.astype(np.int64), ends, flat, at)
            data, offsets = offsets_of(piece.column(1))
            raw, back, bounds = data.tobytes(), out.tobytes(), bounds.tolist()
            texts = [back[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            same = [raw[a:b] == x for a, b, x in zip(offsets[:-1].tolist(), offsets[1:].tolist(), texts, strict=True)]
            arrays = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            columns = [piece.column(0), arrays, pa.array(counts.astype(np.int32)), pa.array(np.diff(falls).astype(np.int32)), pa.array(same, pa.bool_())]
            more = [pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())] if with_text else []
            yield pa.record_batch([*columns, *more], ["id", "pieces", "n_pieces", "n_fallback", "same", "text"][: 5 + len(more)])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, pieces array<int>, n_pieces int, n_fallback int, same boolean" + ", text string" * with_text).withColumnRenamed("id", id_column)
