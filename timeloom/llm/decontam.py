"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND, then verified.

Every passage of every document is a query. Each term has the list of its items in order, the most that it adds to any of
them, and the most for each block of items, as shares of the item's threshold. The lists of a passage's terms are
walked together: the first item at which the largest shares of the terms that have come so far add up to the threshold
is the pivot, what lies before it is passed over; if the shares of its block don't add up, so is the rest of the block;
else the pivot is scored. Many passages walk side by side, a step of each at a time. Items that reach their threshold
are verified by the words of their question and of their answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.session import checkpointed
from timeloom.llm.text import offsets_of, pieces, ragged, shingles, span_hashes, words

#: Bytes between words: ASCII other than letters and digits.
_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Passages that walk side by side, and indexes that are searched in one pass over the documents.
_SIDE_BY_SIDE, _TOGETHER = 1024, 8
#: Spreads of items in which a passage must have enough before it walks; as many for any index.
_SPREADS = 32
_NO_ITEM = np.int64(1 << 40)
_ENOUGH = 1 - 1e-6


@dataclass(frozen=True)
class Contamination:
    """An item is retrieved from ``threshold`` of its own BM25 score on, and confirmed if ``overlap`` of the runs of
    ``gram`` words of its question, and as many of its answer, stand in the passage (or ``overlap`` of the part's words in
    their places, so that a changed word in a short answer doesn't hide it). ``block`` items share bounds; ``shard``
    bounds the items, and ``shard_bytes`` about the text, of one index. They steer cost, not results: frequencies and
    lengths are those of all items.
    """

    threshold: float = 0.6
    overlap: float = 0.8
    gram: int = 5
    block: int = 8
    shard: int = 16384
    shard_bytes: int = 1 << 24
    k1: float = 1.2
    b: float = 0.75


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and each text's first word."""
    data, offsets = offsets_of(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    starts, ends, firsts = words(data, offsets, _BETWEEN[data])
    return span_hashes(data, starts, ends), firsts


def parts(text: str) -> tuple[str, str]:
    """Question and answer of an item: its last sentence is the answer, or its last quarter if there is only one."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    w = text.split()
    cut = len(w) - max(1, len(w) // 4) if len(w) > 1 else len(w)
    return " ".join(w[:cut]), " ".join(w[cut:])


@dataclass(frozen=True)
class Statistics:
    """Of all items with words: their number, mean and largest number of words; sorted terms and the items that have them."""

    n: int
    mean: float
    most: int
    terms: np.ndarray
    df: np.ndarray


@dataclass(frozen=True)
class Index:
    """``terms`` are sorted hashes. The postings of all terms stand in one array in order of term and item: ``keys`` (term
    times items, plus item), what the term ``adds`` to the item, and ``block_most``, the most that it adds to any item
    of the same block; those of term t end before ends[t]. ``largest`` is the most a term adds to any item, ``spread`` the
    most in each of a few equal spreads of items, ``grams`` the runs of words of each item's two parts."""

    items: np.ndarray
    terms: np.ndarray
    largest: np.ndarray
    spread: np.ndarray
    keys: np.ndarray
    ends: np.ndarray
    adds: np.ndarray
    block_most: np.ndarray
    grams: tuple[tuple[tuple[int, np.ndarray, np.ndarray], ...], ...]
    stride: int


def statistics(texts: list[str]) -> Statistics:
    """Those of a list of items, for tables that are small."""
    hashes, firsts = _word_hashes(pa.array(texts, pa.string()))
    counts = np.diff(firsts)
    pairs = np.unique(np.stack([np.repeat(np.arange(len(counts)), counts).astype(np.uint64), hashes]), axis=1)
    terms, df = np.unique(pairs[1], return_counts=True)
    some = counts[counts > 0]
    return Statistics(len(some), float(some.mean()) if len(some) else 1.0, int(counts.max(initial=0)), terms, df)


def build(ids: list[int], texts: list[str], rule: Contamination, known: Statistics | None = None) -> Index:
    """Index one shard of items; items without words are never retrieved. ``known`` are the statistics of all items."""
    known = known or statistics(texts)
    hashes, firsts = _word_hashes(pa.array(texts, pa.string()))
    counts = np.diff(firsts)
    item = np.repeat(np.arange(len(ids)), counts)
    terms, code = np.unique(hashes, return_inverse=True)
    n_items = max(1, len(ids))
    keys, tf = np.unique(code.astype(np.int64) * n_items + item, return_counts=True)
    term, item = keys // n_items, keys % n_items
    df = known.df[np.searchsorted(known.terms, terms)] if len(terms) else np.zeros(0)
    idf = np.log(1 + (max(1, known.n) - df + 0.5) / (df + 0.5))
    adds = idf[term] * tf * (rule.k1 + 1) / (tf + rule.k1 * (1 - rule.b + rule.b * counts[item] / known.mean))
    adds = adds / (rule.threshold * np.bincount(item, adds, n_items))[item] if len(item) else adds
    blocks = -(-n_items // rule.block)
    of_block, at = np.unique(term * blocks + item // rule.block, return_inverse=True)
    most, largest = np.zeros(len(of_block)), np.zeros(len(terms))
    np.maximum.at(most, at, adds)
    np.maximum.at(largest, term, adds)
    spread = np.zeros((len(terms), _SPREADS), np.float32)
    np.maximum.at(spread, (term, item * _SPREADS // n_items), adds.astype(np.float32))
    grams = []
    for text in texts:
        both = []
        for part in parts(text):
            h, f = _word_hashes(pa.array([part], pa.string()))
            k = max(1, min(rule.gram, len(h)))
            both.append((k, np.unique(shingles(h, f, k)[0]), h))
        grams.append(tuple(both))
    return Index(np.array(ids, np.int64), terms, largest, spread, keys, np.searchsorted(term, np.arange(len(terms)), "right"), adds, most[at], tuple(grams), max(64, known.most))


def wand(index: Index, term: np.ndarray, cuts: np.ndarray, block: int) -> list[tuple[int, int, float]]:
    """(passage, item, score over threshold) of all items that reach their threshold. ``term`` holds the distinct terms of all
    passages one after the other; passage p has those from cuts[p] to cuts[p + 1]."""
    n_items = max(1, len(index.items))
    items = np.append(index.keys % n_items, _NO_ITEM)
    sizes = np.diff(cuts)
    own = np.full((len(sizes), int(sizes.max(initial=0))), -1, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    own[row, np.arange(len(term)) - cuts[row]] = term
    most, end = np.where(own >= 0, index.largest[own], 0.0), np.where(own >= 0, index.ends[own], len(index.keys))
    at = np.where(own > 0, index.ends[own - 1], np.where(own == 0, 0, len(index.keys)))  # where each list stands
    now = items[at]
    passages = np.arange(len(sizes))
    found = []

    def move(rows: np.ndarray, columns: np.ndarray, to: np.ndarray) -> None:
        at[rows, columns] = to
        now[rows, columns] = np.where(to < end[rows, columns], items[to], _NO_ITEM)

    def advance(rows: np.ndarray, columns: np.ndarray, item: np.ndarray) -> None:
        """Set those lists on their first item from ``item`` on."""
        move(rows, columns, np.searchsorted(index.keys, own[rows, columns] * n_items + np.minimum(item, n_items)))

    while len(passages):
        order = np.argsort(now, axis=1)
        reached = np.cumsum(np.take_along_axis(most, order, 1), axis=1) >= _ENOUGH
        first = reached.argmax(axis=1)
        line = np.arange(len(passages))
        pivot = np.where(reached[line, first], now[line, order[line, first]], _NO_ITEM)
        going = pivot < _NO_ITEM
        if not going.all():
            passages, pivot, own, most, end, at, now = (x[going] for x in (passages, pivot, own, most, end, at, now))
            if not len(passages):
                break
        r, c = np.nonzero(now < pivot[:, None])
        advance(r, c, pivot[r])
        stop = (pivot // block + 1) * block
        r, c = np.nonzero(now < stop[:, None])
        here, place = now[r, c] == pivot[r], at[r, c]
        total = np.bincount(r, np.where(here, index.adds[place], 0.0), len(passages))
        for p in np.flatnonzero(total >= _ENOUGH).tolist():
            found.append((int(passages[p]), int(pivot[p]), float(total[p])))
        # what is left of a block whose shares don't add up is passed over
        skip = np.bincount(r, index.block_most[place], len(passages))[r] < _ENOUGH
        advance(r[skip], c[skip], stop[r[skip]])
        step = here & ~skip
        move(r[step], c[step], place[step] + 1)
    return found


#: Meetings of equal words that are counted at once.
_TOGETHER_WORDS = 1 << 20


def _in_place(part: np.ndarray, passage: np.ndarray) -> float:
    """The largest share of a part's words that stand at one place of the passage in theirs.

    Words meet by their sorted places, so many at a time that memory stays bounded however long both are.
    """
    m, n = len(part), len(passage)
    if not m or not n:
        return 0.0
    order = np.argsort(passage, kind="stable")
    low, high = (np.searchsorted(passage[order], part, side) for side in ("left", "right"))
    ends = np.concatenate([[0], np.cumsum(high - low)])
    moved = np.zeros(m + n, np.int64)
    a = 0
    while a < m:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + _TOGETHER_WORDS, "right")) - 1)
        at, _ = ragged(order, low[a:b], (high - low)[a:b])
        moved += np.bincount(at - np.repeat(np.arange(a, b), (high - low)[a:b]) + m, minlength=m + n)
        a = b
    return float(moved.max()) / m


def search(index: Index, texts: pa.Array, rule: Contamination) -> list[tuple[int, int, float, float, float]]:
    """(text, item, score over threshold, question overlap, answer overlap) of all confirmed items, the best passage of each."""
    hashes, firsts = _word_hashes(texts)
    if not len(hashes) or not len(index.terms):
        return []
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == hashes)
    # a passage is two neighbouring segments of a text, so that every item lies whole within one
    counts = np.diff(firsts)
    per_text = -(-counts // index.stride)
    first_segment = np.concatenate([[0], np.cumsum(per_text)])
    text_of = np.repeat(np.arange(len(counts)), per_text)
    owner = np.repeat(np.arange(len(counts)), counts)
    segment = first_segment[owner] + (np.arange(len(hashes)) - firsts[owner]) // index.stride
    width = np.int64(len(index.terms))
    follows = np.zeros(len(text_of), bool)
    follows[:-1] = text_of[1:] == text_of[:-1]
    lone_tail = ~follows & np.concatenate([[False], follows])[:-1]  # its words stand in the passage before it
    pairs = np.unique(segment[known] * width + at[known])
    before = pairs // width - 1
    pairs = np.unique(np.concatenate([pairs, pairs[(before >= 0) & follows[before]] - width]))
    passage, term = pairs // width, pairs % width
    # where no spread of the items has enough, the walk would find nothing
    live = (np.bincount(passage, index.largest[term], len(text_of)) >= _ENOUGH) & ~lone_tail
    keep = live[passage]
    passage, term = passage[keep], term[keep]
    begin = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(passage) else np.zeros(0, np.int64)
    for a in range(0, len(begin), _SIDE_BY_SIDE):
        own = begin[a : a + _SIDE_BY_SIDE]
        rows = term[own[0] : begin[a + _SIDE_BY_SIDE] if a + _SIDE_BY_SIDE < len(begin) else len(term)]
        live[passage[own]] = np.add.reduceat(index.spread[rows], own - own[0]).max(axis=1) >= 1 - 1e-3
    keep = live[passage]
    passage, term = passage[keep], term[keep]
    numbers, begin = np.unique(passage, return_index=True)
    cuts = np.append(begin, len(passage))
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    by_size = np.argsort(np.diff(cuts), kind="stable")  # passages with as many terms side by side
    for a in range(0, len(numbers), _SIDE_BY_SIDE):
        group = by_size[a : a + _SIDE_BY_SIDE]
        sizes = np.diff(cuts)[group]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        some = term[np.arange(ends[-1]) + np.repeat(cuts[group] - ends[:-1], sizes)]
        for p, item, score in wand(index, some, ends, rule.block):
            p = int(numbers[group[p]])
            t = int(text_of[p])
            start = firsts[t] + (p - first_segment[t]) * index.stride
            here = hashes[start : min(start + 2 * index.stride, firsts[t + 1])]
            shares = []
            for k, wanted, part in index.grams[item]:
                have = shingles(here, np.array([0, len(here)]), k)[0]
                share = float(np.isin(wanted, have).mean()) if len(wanted) else 1.0
                shares.append(share if share >= rule.overlap else max(share, _in_place(part, here)))
                if shares[-1] < rule.overlap:
                    break
            if min(shares) >= rule.overlap:
                best[t, item] = max(best.get((t, item), (0.0, 0.0, 0.0)), (score, *shares))
    return [(t, i, *found) for (t, i), found in sorted(best.items())]


def _counted(items: DataFrame) -> tuple[DataFrame, dict]:
    """The number of items of each term (term, df), and the number, mean, longest and bytes of all items with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "t"):
            hashes, firsts = _word_hashes(piece.column(1))
            counts = np.diff(firsts)
            owner = np.repeat(np.arange(len(counts)), counts)
            terms, code = np.unique(hashes, return_inverse=True)
            pairs = np.unique(code.astype(np.int64) * max(1, len(counts)) + owner)
            ones = np.bincount(pairs // max(1, len(counts)), minlength=len(terms))
            some = counts[counts > 0]
            lengths = pa.array([None] * len(terms) + some.tolist(), pa.int64())
            yield pa.record_batch([pa.array([*terms.view(np.int64).tolist(), *[None] * len(some)], pa.int64()), pa.array([*ones.tolist(), *[1] * len(some)], pa.int64()), lengths], ["term", "n", "length"])

    rows = checkpointed(items.mapInArrow(run, "term long, n long, length long"))
    total = rows.where("length is not null").agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.max("length").alias("most")).first()
    return rows.where("length is null").groupBy("term").agg(F.sum("n").alias("df")), total.asDict()


def _indexes(benchmark: DataFrame, rule: Contamination, item_column: str, text_column: str) -> Iterator[Index]:
    """Indexes of at most about ``shard`` items each; only one shard of items is on the driver at a time. Frequencies are
    counted in Spark over all items, so it doesn't matter which of them share an index."""
    slim = checkpointed(benchmark.select(F.col(item_column).cast("long").alias("i"), F.col(text_column).alias("t")).where("i is not null and t is not null").distinct())
    df, total = _counted(slim)
    if not total["n"]:
        return
    df = checkpointed(df)
    size = slim.agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("bytes")).first()
    shards = max(1, -(-size["n"] // max(1, rule.shard)), -(-size["bytes"] // rule.shard_bytes))
    for k in range(shards):
        rows = slim.where(F.pmod(F.xxhash64("i"), F.lit(shards)) == k).orderBy("i", "t").collect()
        if not rows:
            continue
        texts = [r["t"] for r in rows]
        wanted = np.unique(_word_hashes(pa.array(texts, pa.string()))[0]).view(np.int64)
        if shards == 1:
            own = df.toArrow()
        else:
            own = df.join(df.sparkSession.createDataFrame(pa.table({"term": wanted})), "term", "left_semi").toArrow()
        terms = own.column("term").to_numpy().view(np.uint64)
        order = np.argsort(terms)
        known = Statistics(total["n"], float(total["mean"]), total["most"], terms[order], own.column("df").to_numpy()[order])
        yield build([r["i"] for r in rows], texts, rule, known)


def _held(docs: DataFrame, benchmark: DataFrame, rule: Contamination, id_column: str, text_column: str, item_column: str, item_text: str) -> DataFrame:
    """doc_id, ``key`` (a digest of the text where there is no id), item_id, score and overlaps, for each row that holds an item."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_column).alias("doc_id"), F.when(F.col(id_column).isNull(), F.md5(F.col(text_column).cast("binary"))).alias("key"), F.col(text_column).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "key", "item_id", "score", "question_overlap", "answer_overlap"]
    schema = f"doc_id {kind}, key string, item_id long, score double, question_overlap double, answer_overlap double"
    found = None

    def pass_over(group: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches):
                for shared in group:
                    got = search(shared.value, piece.column(2), rule)
                    rows = pa.array([x[0] for x in got], pa.int64())
                    values = [pa.array([int(shared.value.items[x[1]]) for x in got], pa.int64()), pa.array([x[2] * rule.threshold for x in got], pa.float64()), *(pa.array([x[j] for x in got], pa.float64()) for j in (3, 4))]
                    yield pa.record_batch([piece.column(0).take(rows), piece.column(1).take(rows), *values], names)

        return slim.mapInArrow(run, schema)

    group: list = []
    for index in _indexes(benchmark, rule, item_column, item_text):
        group.append(spark.sparkContext.broadcast(index))
        if len(group) == _TOGETHER:
            found = pass_over(group) if found is None else found.unionByName(pass_over(group))
            group = []
    if group:
        found = pass_over(group) if found is None else found.unionByName(pass_over(group))
    return spark.createDataFrame([], schema) if found is None else found


def find(docs: DataFrame, benchmark: DataFrame, rule: Contamination = Contamination(), id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and test item that it holds: ``doc_id``, ``item_id``, ``score`` (the best passage's BM25
    score as a share of the item's own), ``question_overlap`` and ``answer_overlap``.

    Null and empty texts hold nothing; items without words, an id or a text are never held. Rows that share an id are one
    document; they and rows that repeat give one row per document and item, with the largest values, and so do rows
    without an id that have the same text. Further columns are ignored, and an empty benchmark or an empty table gives
    an empty result.
    """
    values = ("score", "question_overlap", "answer_overlap")
    held = _held(docs, benchmark, rule, id_column, text_column, item_column, item_text)
    return held.groupBy("doc_id", "key", "item_id").agg(*[F.max(c).alias(c) for c in values]).drop("key")


def clean(docs: DataFrame, benchmark: DataFrame, rule: Contamination = Contamination(), id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no test item; of rows that share an id all go if one holds an item.

    A row without an id goes if its own text holds an item, and stays otherwise; null and empty texts stay.
    """
    name = lambda i, key: F.coalesce(F.concat(F.lit("id "), i.cast("string")), F.concat(F.lit("text "), key))
    held = _held(docs, benchmark, rule, id_column, text_column, item_column, item_text).select(name(F.col("doc_id"), F.col("key")).alias("__held")).distinct()
    return docs.join(held, name(F.col(id_column), F.md5(F.col(text_column).cast("binary"))) == F.col("__held"), "left_anti")
