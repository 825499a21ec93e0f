"""Token counts by rank-synchronous merging: batches of pre-tokens as ragged arrays, merged without a loop over words.

A byte-pair tokenizer turns a text into pre-tokens, each a row of symbols, and merges the pair of neighbours with the
lowest rank until none is left. Here all distinct pre-tokens of a piece of a batch stand in one array; in every round each
sequence's lowest-rank pair is applied everywhere in it at once, finished sequences drop out, and what survives is counted.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from timeloom.llm.text import pieces, ragged, span_hashes

#: How the supported files split normalised text: fixed by their format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, NUMBER, OTHER = range(4)
#: No pair.
NONE = np.iinfo(np.int32).max
#: Sequences of more symbols are merged one by one, with their pairs held by rank.
LONG = 512


@dataclass(frozen=True)
class Vocabulary:
    """What merging needs: symbols of bytes, ranks and products of pairs, classes of characters, and special strings."""

    file: str
    size: int
    #: The symbol of each byte inside a pre-token, and at its end.
    inner: np.ndarray
    final: np.ndarray
    #: Sorted keys of pairs (left * size + right), their ranks, and the product of each rank.
    keys: np.ndarray
    ranks: np.ndarray
    products: np.ndarray
    #: The class of each code point.
    kinds: np.ndarray
    specials: tuple[str, ...]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def load(path: str) -> Vocabulary:
    """The vocabulary of a ``tokenizers`` file of byte-level pairs with word ends.

    Refused are files that split otherwise than SPLIT, whose special strings are matched after normalisation or strip
    white space, and merges in which a symbol is used at a lower rank than it is made: for those, applying all places of
    a pair at once is not what the library does.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, steps = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    if model["type"] != "BPE" or model["continuing_subword_prefix"] or model["dropout"] or model["unk_token"] or model["ignore_merges"]:
        raise ValueError(f"{path}: not a plain byte-pair model")
    if steps[0].get("pattern") != {"Regex": SPLIT} or not steps[0]["invert"] or steps[0]["behavior"] != "Removed" or steps[-1]["type"] != "ByteLevel" or steps[-1]["use_regex"] or steps[-1]["add_prefix_space"]:
        raise ValueError(f"{path}: splits texts in another way")
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: special strings that depend on their neighbours")
    vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    made, used = {}, {}
    for rank, (a, b) in enumerate(merges):
        made[a + b] = rank
        used.setdefault(a, rank), used.setdefault(b, rank)
    if any(used.get(symbol, NONE) <= rank for symbol, rank in made.items()):
        raise ValueError(f"{path}: a symbol is merged at a lower rank than it is made")
    size = max(vocab.values()) + 1
    keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
    order = np.argsort(keys)
    letters = byte_letters()
    return Vocabulary(
        path, size, np.array([vocab[c] for c in letters], np.int32), np.array([vocab[c + end] for c in letters], np.int32), keys[order],
        order.astype(np.int32), np.array([vocab[a + b] for a, b in merges], np.int32), kinds_of(Tokenizer.from_file(path)), tuple(t["content"] for t in spec["added_tokens"]),
    )


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level files: itself if it is printable, else the next free one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


def kinds_of(tokenizer: Tokenizer) -> np.ndarray:
    """The class of every code point as the library itself has it, asked of one text that holds them all.

    A run of letters or of other characters comes back as one span, so that few spans are left to ask about.
    """
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype(np.uint32)
    kinds = np.zeros(0x110000, np.uint8)
    for _, (a, b) in split(points.tobytes().decode("utf-32-le")):
        c = chr(points[a])
        kinds[points[a:b]] = LETTER if len(split("a" + c)) == 1 else OTHER if len(split(c + c)) == 1 else NUMBER
    return kinds


def pretokens(points: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches of SPLIT in an array of code points."""
    kind = np.concatenate([[SPACE], kinds[points], [SPACE] * 4])
    first = np.zeros(len(kind), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    first &= kind != SPACE
    # an apostrophe alone before a letter may begin a contraction, which ends inside the run of letters
    padded = np.concatenate([[0], points, [0] * 4])
    mark = np.flatnonzero(padded == ord("'"))
    mark = mark[(kind[mark - 1] != OTHER) & (kind[mark + 1] == LETTER)]
    one, two = padded[mark + 1], padded[mark + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    first[mark[short | long] + 1] = False
    after = np.concatenate([mark[short] + 2, mark[long] + 3])
    first[after[kind[after] == LETTER]] = True
    starts = np.flatnonzero(first)
    stops = np.flatnonzero(first | (kind == SPACE))
    return starts - 1, stops[np.searchsorted(stops, starts, "right")] - 1


def merged_counts(symbols: np.ndarray, ends: np.ndarray, v: Vocabulary) -> np.ndarray:
    """How many symbols survive in each sequence; ``ends`` are where the sequences end, one after another, none empty."""
    out = np.zeros(len(ends), np.int64)
    sizes = np.diff(ends, prepend=0)
    for i in np.flatnonzero(sizes > LONG):
        out[i] = _merged_long(symbols[ends[i] - sizes[i] : ends[i]], v)
    left = np.flatnonzero(sizes <= LONG)
    symbols, sizes = symbols[np.repeat(sizes <= LONG, sizes)].copy(), sizes[left]
    ranks = np.full(len(symbols), NONE, np.int32)
    if len(symbols):
        ranks[:-1] = v.rank(symbols[:-1], symbols[1:])
        ranks[np.cumsum(sizes) - 1] = NONE
    while len(left):
        low = np.minimum.reduceat(ranks, np.cumsum(sizes) - sizes)
        done = low == NONE
        if done.any():
            out[left[done]] = sizes[done]
            keep = np.repeat(~done, sizes)
            symbols, ranks, left, sizes, low = symbols[keep], ranks[keep], left[~done], sizes[~done], low[~done]
            if not len(left):
                break
        sequence = np.repeat(np.arange(len(left)), sizes)
        at = _apart(np.flatnonzero(ranks == low[sequence]))
        symbols[at] = v.products[ranks[at]]
        # the right halves go; the last symbol of a sequence has no pair, so a right half is of the same one
        ranks[at] = ranks[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        sizes = sizes - np.bincount(sequence[at], minlength=len(left))
        symbols, ranks = symbols[keep], ranks[keep]
        at = at - np.arange(len(at))
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(sizes) - 1] = True
        touched = np.concatenate([at, at[at > 0] - 1])
        touched = touched[~last[touched]]
        ranks[touched] = v.rank(symbols[touched], symbols[touched + 1])
        ranks[last] = NONE
    return out


def _apart(at: np.ndarray) -> np.ndarray:
    """Of places that follow one another directly, the first, third, and so on: a symbol merges once a round."""
    fresh = np.diff(at, prepend=-2) != 1
    return at[(np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))) % 2 == 0]


def _merged_long(symbols: np.ndarray, v: Vocabulary) -> int:
    """One long sequence: its pairs wait by rank, and all places of the lowest are applied at once, in time n log n."""
    n = len(symbols)
    symbols, following, before, alive = symbols.copy(), np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def wait(at: np.ndarray) -> None:
        ranks = v.rank(symbols[at], symbols[following[at]])
        at, ranks = at[ranks != NONE], ranks[ranks != NONE]
        order = np.argsort(ranks, kind="stable")
        found, begin = np.unique(ranks[order], return_index=True)
        for rank, part in zip(found.tolist(), np.split(at[order], begin[1:]) if len(found) else [], strict=True):
            if rank not in waiting:
                heapq.heappush(heap, rank)
            waiting.setdefault(rank, []).append(part)

    wait(np.arange(n - 1))
    while heap:
        rank = heapq.heappop(heap)
        at = np.unique(np.concatenate(waiting.pop(rank)))
        at = at[alive[at]]
        at = at[following[at] < n]
        at = at[v.rank(symbols[at], symbols[following[at]]) == rank]
        if not len(at):
            continue
        joined = np.concatenate([[False], following[at[:-1]] == at[1:]])
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
        at = at[run % 2 == 0]
        gone = following[at]
        symbols[at], alive[gone], following[at] = v.products[rank], False, following[gone]
        inside = at[following[at] < n]
        before[following[inside]] = inside
        touched = np.concatenate([inside, before[at][before[at] >= 0]])
        wait(np.unique(touched))
    return int(alive.sum())


def _counter(v: Vocabulary):
    normalise = Tokenizer.from_file(v.file).normalizer.normalize_str
    special = re.compile("|".join(re.escape(s) for s in sorted(v.specials, key=len, reverse=True))) if v.specials else None

    def plain(text: str) -> tuple[str, int]:
        """The normalised text, and how many special strings were in it; white space stands in their places."""
        found = 0
        if special is not None and special.search(text):
            parts = special.split(text)
            return " ".join(x.lower() if x.isascii() else normalise(x) for x in parts), len(parts) - 1
        return (text.lower() if text.isascii() else normalise(text)), found

    def count(texts: list[str | None]) -> np.ndarray:
        ready = [plain(t or "") for t in texts]
        whole = " ".join(t for t, _ in ready)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(whole.encode(), np.uint8)
        starts, ends = pretokens(points, v.kinds)
        widths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.concatenate([[0], np.cumsum(widths)])
        first, last = byte_at[starts], byte_at[ends]
        _, one, which = np.unique(span_hashes(data, first, last), return_index=True, return_inverse=True)
        sizes = last[one] - first[one]
        flat, to = ragged(data, first[one], sizes)
        symbols = v.inner[flat]
        symbols[to[1:] - 1] = v.final[flat[to[1:] - 1]]
        counts = np.concatenate([[0], np.cumsum(merged_counts(symbols, to[1:], v)[which])])
        borders = np.cumsum([0, *[len(t) + 1 for t, _ in ready]])
        return np.diff(counts[np.searchsorted(starts, borders)]) + np.array([n for _, n in ready], np.int64)

    return count


def count(docs: DataFrame, v: Vocabulary, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    Texts are counted whole, as the library counts them without begin, end and added tokens; a special string inside a
    text is one token. Null and empty texts have no bytes and no tokens. Repeated rows are counted one by one, further
    columns are ignored whatever their names, and an empty table gives an empty result. Within a piece, pre-tokens are told
    apart by 64-bit hashes.
    """
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for piece in pieces(batches):
            n = counter(piece.column(1).to_pylist())
            yield pa.record_batch([piece.column(0), pc.fill_null(pc.binary_length(piece.column(1)), 0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_column)
