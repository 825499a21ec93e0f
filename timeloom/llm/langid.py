"""Language identification by word-first backoff.

Words seen in training score by their log frequency in each language; a word not seen falls back to its longest
character n-grams that were seen, then to shorter ones. Texts are scored whole. Words and n-grams go by 64-bit hashes,
so that a batch is looked up without a loop over its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.text import offsets_of, pieces, span_hashes

#: What a word may not contain: everything but letters of any script.
NOT_LETTERS = r"[^\p{L}]+"
UNKNOWN = "und"
#: What a word without a seen n-gram scores in every language, and what one with n-grams is lowered by.
FLOOR = -2.0
#: More languages than this are taken for a mistake in the column of labels.
MOST_LANGUAGES = 10_000


@dataclass(frozen=True)
class Table:
    """Sorted hashes of terms, and for each a log frequency in every language."""

    keys: np.ndarray
    scores: np.ndarray

    def rows(self, wanted: np.ndarray) -> np.ndarray:
        """The row of each wanted hash, -1 if it has none."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    words: Table
    grams: Table
    longest: int


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts, starts and ends of their words in them, and the text of each word."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("").cast(pa.large_string())), NOT_LETTERS)
    data, offsets = offsets_of(lists.flatten())
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = offsets[1:] > offsets[:-1]
    return data, offsets[:-1][real], offsets[1:][real], owner[real]


def _padded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with a space on either side as new bytes, where their characters begin (and end), and the word of each."""
    sizes = ends - starts
    begin = np.cumsum(sizes + 2) - sizes - 2
    out = np.full(int((sizes + 2).sum()), 0x20, np.uint8)
    each = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[begin[each] + 1 + inside] = data[starts[each] + inside]
    chars = np.flatnonzero((out & 0xC0) != 0x80)
    return out, np.append(chars, len(out)), np.searchsorted(begin, chars, "right") - 1


def _grams(out: np.ndarray, chars: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of characters inside one word, other than a space alone, and the word of each."""
    at = np.arange(max(0, len(owner) - n + 1))
    at = at[owner[at] == owner[at + n - 1]]
    if n == 1:
        at = at[out[chars[at]] != 0x20]
    return span_hashes(out, chars[at], chars[at + n]), owner[at]


def _summed(kind: int, keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, code = np.unique(keys, return_inverse=True)
    return np.full(len(own), kind), own.view(np.int64), np.bincount(code, weights, len(own)).astype(np.int64)


def train(labelled: DataFrame, max_rows: int = 12_000, least: int = 2, longest: int = 5) -> LanguageModel:
    """Fit on at most about ``max_rows`` of the rows (text, lang, doc_id), the ones with the smallest hash of doc_id.

    The bound is on the sample only. Spark counts it; the driver receives each word and each n-gram of up to ``longest``
    characters that stands ``least`` times in it or more, with its counts in all languages. Null texts and null
    languages teach nothing.
    """
    labelled = labelled.where("text is not null and lang is not null")
    per_lang = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(per_lang) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in the column lang")
    langs = sorted(per_lang)
    if not langs:
        none = Table(np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
        return LanguageModel((), none, none, longest)
    share = max_rows / len(langs)
    keep = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, share / per_lang[lang]))])
    code = F.create_map(*[F.lit(x) for pair in zip(langs, range(len(langs)), strict=True) for x in pair])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < keep[F.col("lang")] * (1 << 20)).select(code[F.col("lang")].alias("lang"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            of = piece.column(0).to_numpy(zero_copy_only=False)
            for lang in np.unique(of).tolist():
                data, starts, ends, _ = _words(piece.column(1).filter(pa.array(of == lang)))
                hashes, first, code, n = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
                found = [_summed(0, hashes, n)]
                padded = _padded(data, starts[first], ends[first])
                for k in range(1, longest + 1):
                    grams, word = _grams(*padded, k)
                    found.append(_summed(1, grams, n[word]))
                kind, key, n = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.record_batch([pa.array(np.full(len(key), lang, np.int32)), pa.array(kind.astype(np.int32)), pa.array(key), pa.array(n)], ["lang", "kind", "key", "n"])

    counted = sample.mapInArrow(run, "lang int, kind int, key long, n long")
    per_term = counted.groupBy("kind", "key").agg(F.sum("n").alias("total"), *[F.coalesce(F.sum(F.when(F.col("lang") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(len(langs))])
    got = per_term.where(F.col("total") >= least).toArrow()
    kind, keys = got.column("kind").to_numpy(), got.column("key").to_numpy().view(np.uint64)
    counts = np.stack([got.column(f"n{i}").to_numpy() for i in range(len(langs))], axis=1).astype(np.float64)

    def table(k: int) -> Table:
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(keys[own])]
        n = counts[own] + 0.1
        return Table(keys[own], np.log(n / n.sum(axis=0)).astype(np.float32))

    return LanguageModel(tuple(langs), table(0), table(1), longest)


def _unseen(model: LanguageModel, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word the mean log frequency of its longest n-grams that were seen, lowered; the floor if none was."""
    scores = np.full((len(starts), len(model.langs)), FLOOR)
    left = np.arange(len(starts))
    for n in range(model.longest, 0, -1):
        if not len(left):
            break
        hashes, word = _grams(*_padded(data, starts[left], ends[left]), n)
        rows = model.grams.rows(hashes)
        word, rows = word[rows >= 0], rows[rows >= 0]
        many = np.bincount(word, minlength=len(left))
        for lang in range(len(model.langs)):
            total = np.bincount(word, model.grams.scores[rows, lang], len(left))
            scores[left[many > 0], lang] += total[many > 0] / many[many > 0]
        left = left[many == 0]
    return scores


def score(model: LanguageModel, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Per text the language and the model's share for it."""
    data, starts, ends, owner = _words(texts)
    hashes, first, code = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    rows = model.words.rows(hashes)
    table = np.zeros((len(hashes), len(model.langs)))
    seen = rows >= 0
    table[seen] = model.words.scores[rows[seen]]
    table[~seen] = _unseen(model, data, starts[first[~seen]], ends[first[~seen]])
    n = np.bincount(owner, minlength=len(texts))
    z = np.stack([np.bincount(owner, table[code, lang], len(texts)) for lang in range(len(model.langs))], axis=1)
    # the evidence of a text grows with the root of its words: they are not independent draws
    z = z / np.sqrt(np.maximum(n, 1))[:, None]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    share = z / z.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    return [model.langs[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], np.where(n > 0, share[np.arange(len(best)), best], 0.0)


def predict(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: the id, ``lang_pred`` and ``score`` (0 to 1, the model's share for that language).

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if the model learned no
    language. Ties go to the language that sorts first. Repeated rows are scored one by one, and further columns are
    ignored.
    """
    slim = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            if not shared.value.langs:
                langs, scores = [UNKNOWN] * piece.num_rows, np.zeros(piece.num_rows)
            else:
                langs, scores = score(shared.value, piece.column(1))
            yield pa.record_batch([piece.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)


def accuracy(predicted: DataFrame) -> float:
    """Share of rows whose prediction equals ``lang``."""
    got = predicted.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")).alias("a")).first()["a"]
    return got if got is not None else math.nan
