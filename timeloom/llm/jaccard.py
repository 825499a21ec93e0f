"""Exact similarity join of documents on the Jaccard similarity of their sets of word shingles, by token-combination prefixes.

All shingles have one global order: rare ones first, by how improbable their words are; shingles counted as frequent
last. Of two linked documents at most a known number of shingles of either is missing in the other, so some signature
of their prefixes agrees: a rare shingle is a signature by itself; frequent ones are dealt into groups, and the pairs
within a group are signatures, for which the prefix extends until it can't be emptied by the shingles that may miss.

Documents that share a signature meet at the signature's smallest document. Their sets are compared there, in blocks
of bounded size and at full precision, and only enough links to span each component leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.session import UNNAMED, checkpointed, connected_components, numbered, salted_join, short_shuffles
from timeloom.llm.text import LOWER, SPACE, mixed, offsets_of, pieces, shingles, span_hashes, words


@dataclass(frozen=True)
class JaccardJoin:
    """``shingle`` words a shingle; linked from ``percent`` / 100 similarity on.

    ``words`` and ``frequent`` bound the two tables of counts that every task gets (the most frequent words, and
    shingles seen at least ``least`` times); ``block`` bounds the documents compared in one go, and ``volume`` their
    shingles. They steer cost, not results.
    """

    shingle: int = 4
    percent: int = 85
    words: int = 1 << 17
    frequent: int = 1 << 17
    least: int = 32
    block: int = 384
    volume: int = 1 << 20


#: Words or shingles that a task counts before it hands over what it has.
_COUNTED = 2_000_000
#: From so many shingles on, frequent ones are dealt into so many groups; few enough that a whole set always suffices.
_TIERS = ((0, 1), (64, 32), (1024, 512), (16384, 8192))
_FREQUENT = 200
#: Tasks over which the sets that meet at one pivot are dealt.
_SALTS = 64
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def missing(n: int, percent: int) -> int:
    """How many of n shingles a linked document may lack: it shares at least percent / 100 of n."""
    return n - -(-n * percent // 100)


def _tokens(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with the first word of each text, and shingle hashes with the first shingle of each text."""
    data, offsets = offsets_of(texts)
    data = LOWER[data]
    starts, ends, firsts = words(data, offsets, SPACE[data])
    hashes = span_hashes(data, starts, ends)
    return hashes, firsts, *shingles(hashes, firsts, k)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; none for an empty or null text."""
    _, _, grams, begin = _tokens(texts, k)
    return [np.unique(grams[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def set_key(shingle_set: np.ndarray) -> int:
    """A 64-bit digest of a set of shingles."""
    with np.errstate(over="ignore"):  # sums are modulo 2**64
        total = np.bitwise_xor.reduce(mixed(shingle_set ^ _PAIR)) + mixed(shingle_set).sum(dtype=np.uint64) if len(shingle_set) else np.uint64(0)
        return int(mixed(np.array([total + np.uint64(len(shingle_set))], np.uint64)).view(np.int64)[0])


@dataclass(frozen=True)
class _Counts:
    """Sorted hashes of frequent words with the logarithm of their share in whole eighths (sums must be exact, as a shingle
    has one place wherever it stands), and of frequent shingles with their place in the order."""

    words: np.ndarray
    shares: np.ndarray
    rarest: int
    shingles: np.ndarray
    places: np.ndarray


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _most(counted: DataFrame, bound: int) -> pa.Table:
    """The keys with the largest counts, at most ``bound``: a histogram of the counts tells from which count on. Nothing
    is sorted, and the driver receives no more than the histogram and the keys."""
    grade = F.floor(F.log2("n") * 64)
    left, low = bound, None
    for r in sorted(counted.groupBy(grade.alias("grade")).agg(F.count("*").alias("n"), F.min("n").alias("low")).collect(), key=lambda r: -r["grade"]):
        left -= r["n"]
        if left < 0:
            break
        low = r["low"]
    return counted.where(F.col("n") >= low if low is not None else F.lit(False)).select("key", "n").toArrow()


def _count(docs: DataFrame, rule: JaccardJoin) -> _Counts:
    """Count all words, and all shingles that a task sees more than once, in one pass; the tables that come to the driver are bounded."""
    k = rule.shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[list[np.ndarray]] = [[], []]

        def out() -> Iterator[pa.RecordBatch]:
            for kind, found in enumerate(seen):
                if found:
                    keys, n = np.unique(np.concatenate(found), return_counts=True)
                    more = n > kind
                    yield pa.record_batch([pa.array(np.full(int(more.sum()), bool(kind))), pa.array(keys[more].view(np.int64)), pa.array(n[more])], ["is_shingle", "key", "n"])
                found.clear()

        held = 0
        for piece in pieces(batches):
            hashes, _, grams, begin = _tokens(piece.column(0), k)
            seen[0].append(hashes)
            seen[1].append(grams)
            held += len(hashes)
            if held >= _COUNTED:
                held = 0
                yield from out()
        yield from out()

    counted = checkpointed(
        docs.select("text").mapInArrow(run, "is_shingle boolean, key long, n long").groupBy("is_shingle", "key").agg(F.sum("n").alias("n"))
        .where(F.when(F.col("is_shingle"), F.col("n") >= rule.least).otherwise(F.col("n") > 1))
    )
    top, grams = (_most(counted.where(which), bound) for which, bound in (("not is_shingle", rule.words), ("is_shingle", rule.frequent)))

    def by_hash(table: pa.Table):
        keys = table.column("key").to_numpy().view(np.uint64)
        by = np.argsort(keys)
        return keys[by], table.column("n").to_numpy().astype(np.float64)[by]

    keys, n = by_hash(top)
    total = max(float(n.sum()), 1.0)
    shares = np.maximum(-200, np.rint(8 * np.log2(n / total))).astype(np.int64)
    gram_keys, gram_n = by_hash(grams)
    places = _FREQUENT + np.minimum(55, 2 * np.log2(np.maximum(gram_n, 1))).astype(np.int64)
    return _Counts(keys, shares, max(-200, int(shares.min()) - 16) if len(shares) else 0, gram_keys, places)


def _places(grams: np.ndarray, begin: np.ndarray, hashes: np.ndarray, firsts: np.ndarray, k: int, counts: _Counts) -> np.ndarray:
    """Where in the global order each shingle belongs: 0 to 199 by the improbability of its words, from 200 on if frequent."""
    share = np.concatenate([[0], np.cumsum(_look_up(counts.words, counts.shares, hashes, counts.rarest))])
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    at = np.arange(begin[-1]) - begin[doc] + firsts[:-1][doc]
    stop = np.minimum(at + k, firsts[1:][doc])
    place = np.clip((share[stop] - share[at]) // k + _FREQUENT, 0, _FREQUENT - 1)
    return _look_up(counts.shingles, counts.places, grams, -1), place


def signatures(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of one document from its distinct tokens in the global order (place in the upper 8 bits)."""
    n = len(tokens)
    if n < 2:
        return tokens[:0]
    may_miss = missing(n, percent)
    rare = int(np.searchsorted(tokens, np.uint64(_FREQUENT) << np.uint64(56)))
    if rare > may_miss:
        return tokens[: may_miss + 1]
    found = [tokens[:rare]]
    low, high = -(-n * percent // 100), n * 100 // percent
    for tier, (least, groups) in enumerate(_TIERS):
        most = _TIERS[tier + 1][0] - 1 if tier + 1 < len(_TIERS) else high
        if high < least or low > most:
            continue
        common = tokens[rare:]
        group = (mixed(common) % np.uint64(groups)).astype(np.int64)
        # a group of c tokens still has a pair until c - 1 of them miss
        later = np.zeros(len(common), bool)
        order = np.argsort(group, kind="stable")
        later[order[1:]] = group[order][1:] == group[order][:-1]
        need = may_miss + 1 - rare
        reach = np.cumsum(later)
        stop = int(np.searchsorted(reach, need)) + 1
        common, group = common[:stop], group[:stop]
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                members = common[order[a:b]]
                i, j = np.triu_indices(b - a, 1)
                found.append(mixed(members[i] * _PAIR + mixed(members[j]) + np.uint64(tier)))
    return np.unique(np.concatenate(found))


def _prepared(docs: DataFrame, rule: JaccardJoin, counts: _Counts) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    k, percent = rule.shingle, rule.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        seen: set[int] = set()  # copies within a task don't repeat their signatures; rows without an id have none
        for piece in pieces(batches):
            hashes, firsts, grams, begin = _tokens(piece.column(1), k)
            frequent, place = _places(grams, begin, hashes, firsts, k, table)
            place = np.where(frequent >= 0, frequent, place).astype(np.uint64)
            tokens = (place << np.uint64(56)) | (grams >> np.uint64(8))
            sizes, nodes, found = [], [], []
            for a, b, named in zip(begin[:-1].tolist(), begin[1:].tolist(), piece.column(0).is_valid().to_pylist(), strict=True):
                own, first = np.unique(grams[a:b], return_index=True)
                sizes.append(len(own))
                nodes.append(node := set_key(own))
                found.append(tokens[:0] if node in seen or not named else signatures(np.sort(tokens[a:b][first]), percent))
                if named:
                    seen.add(node)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.record_batch([piece.column(0), piece.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "row", "n_shingles", "node", "signatures"])

    return docs.mapInArrow(run, "doc_id long, row long, n_shingles long, node long, signatures array<long>")


def links_within(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first set of its component of links among the given ones, by exact comparison of all."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.zeros(2, np.int64) if 100 * both >= percent * (size.sum() - both) and both else np.arange(2)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    same = flat[1:] == flat[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    flat, owner = flat[shared], owner[shared]  # what one set alone has is in no intersection
    column = np.cumsum(np.concatenate([[False], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    columns = int(column[-1]) + 1 if len(flat) else 0
    both = np.zeros((n, n), np.float32)
    step = min(max(256, 4_000_000 // n), columns)
    for a in range(0, columns, max(1, step)):
        lo, hi = np.searchsorted(column, [a, a + step])
        grid = np.zeros((n, step), np.float32)
        grid[owner[lo:hi], column[lo:hi] - a] = 1
        both += grid @ grid.T
    np.fill_diagonal(both, size)
    linked = (100 * both.astype(np.int64) >= percent * (size[:, None] + size[None] - both.astype(np.int64))) & (both > 0)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i], todo = i, [i]
        while todo:
            new = np.flatnonzero(linked[todo.pop()] & (root < 0))
            root[new] = i
            todo.extend(new.tolist())
    return root


def _compare(rule: JaccardJoin):
    k, percent = rule.shingle, rule.percent

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pivot", "ascending"), ("i", "ascending"), ("j", "ascending")]).combine_chunks()
        keys = np.stack([table.column(c).to_numpy() for c in ("pivot", "i", "j")])
        nodes, texts = table.column("doc_id").to_numpy(), table.column("text")
        cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]]))
        left, right = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own, first = np.unique(nodes[a:b], return_index=True)
            if len(own) < 2:
                continue
            root = links_within(shingle_sets(texts.slice(a, b - a).take(pa.array(first)).combine_chunks(), k), percent)
            other = np.flatnonzero(root != np.arange(len(own)))
            left.append(own[other])
            right.append(own[root[other]])
        return pa.table({"a": pa.array(np.concatenate(left) if left else np.zeros(0, np.int64), pa.int64()), "b": pa.array(np.concatenate(right) if right else np.zeros(0, np.int64), pa.int64())})

    return run


def components(docs: DataFrame, rule: JaccardJoin = JaccardJoin(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Null texts and texts without words have no shingles and link with nothing; texts shorter than a shingle have their
    whole sequence as one. Equal sets are one component without being compared. An id with several texts links with all
    that any of them links with, and a row counts the shingles of its own text. A row without an id links with nothing and
    has no component_id. Further columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    slim = numbered(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))).select("doc_id", "text", F.col("__row").alias("row"))
    with short_shuffles(spark):
        prepared = checkpointed(_prepared(slim, rule, _count(slim, rule)))
        first = checkpointed(prepared.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("row").alias("first"), F.max("n_shingles").alias("size")))
        # a text of an id with several goes by a number of its own, and the id, which is smaller, holds them together
        several = prepared.where(f"n_shingles > 0 and doc_id is not null and row >= {UNNAMED}").select("doc_id", "node").join(first, "node").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
        labels = _linked(slim, _meeting(prepared, rule.percent), first, several, rule)
    # by sets, which go by their smallest id: a set may have a third of all documents
    of_node = first.join(labels, F.col("first") == labels["node"], "left").select(first["node"], F.coalesce("component", "first").alias("component_id"))
    return (
        prepared.select("doc_id", "n_shingles", "node")
        .join(of_node, "node", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))
    )


def _meeting(prepared: DataFrame, percent: int) -> DataFrame:
    """(pivot, node): where two sets or more of like size have a signature in common, all of them meet at the smallest.

    Sizes of linked sets lie in one class of a geometric scale or in two neighbouring ones, so a set stands in its own
    class and in the next one, and any two that may be linked share one of these.
    """
    signed = prepared.where("n_shingles > 1 and doc_id is not null").select("node", "n_shingles", F.explode("signatures").alias("signature"))
    common = checkpointed(signed.groupBy("signature").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low <> high").select("signature", "n"))
    size = F.floor(F.log("n_shingles") / math.log(100 / percent * (1 + 1e-9)))
    near = checkpointed(
        salted_join(signed, common, ["signature"], "node")
        .select("node", "signature", F.explode(F.array(size, size + 1)).alias("size"))
        .select("node", F.xxhash64("signature", "size").alias("signature"))
        .distinct()
    )
    met = checkpointed(near.groupBy("signature").agg(F.min("node").alias("pivot"), F.max("node").alias("high"), F.count("*").alias("n")).where("pivot <> high").select("signature", "pivot", "n"))
    return checkpointed(salted_join(near, met, ["signature"], "node").select("pivot", "node").distinct())


def _with_blocks(meeting: DataFrame, rule: JaccardJoin) -> DataFrame:
    """``meeting`` with the number of blocks at each pivot; salted, as a third of all sets may meet at one pivot.

    Only pivots of more than one block are repeated for each salt, so they are at most a share of salts / block of the rows.
    """
    many = F.ceil(F.greatest(F.count("*") / rule.block, F.sum("size") / rule.volume)).cast("int")
    large = meeting.groupBy("pivot").agg(many.alias("blocks")).where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = meeting.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int"))
    return salted.join(large, ["pivot", "salt"], "left").select("pivot", "doc_id", "size", F.coalesce("blocks", F.lit(1)).alias("blocks"))


def _linked(slim: DataFrame, meeting: DataFrame, first: DataFrame, known: DataFrame, rule: JaccardJoin) -> DataFrame:
    """Components of the sets that meet, by exact comparison in pairs of blocks of about ``rule.block`` sets, or fewer long
    ones, and of links that are ``known``.

    A set goes by the smallest row of its documents, so the label of a component is its smallest id.
    """
    named = checkpointed(meeting.join(first, "node").select("pivot", F.col("first").alias("doc_id"), "size"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    dealt = (
        _with_blocks(named, rule)
        .select("doc_id", "size", "pivot", block.alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
        .select("doc_id", "size", "pivot", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    )
    total = dealt.agg(F.count("*").alias("rows"), F.sum("size").alias("size")).first()
    bundles = max(1, math.ceil(total["rows"] / 1000), math.ceil((total["size"] or 0) / rule.volume))
    compared = (
        dealt.join(slim.where("doc_id is not null").select(F.col("row").alias("doc_id"), "text"), "doc_id")
        .select("doc_id", "pivot", "i", "j", "text", F.pmod(F.xxhash64("pivot", "i", "j"), F.lit(bundles)).alias("bundle"))
        .groupBy("bundle")
        .applyInArrow(_compare(rule), "a long, b long")
    )
    return checkpointed(connected_components(compared.unionByName(known)))
