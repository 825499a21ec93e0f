"""Operators 11 to 13: token counts, importance resampling, alignment of two tokenizers, against plain versions."""

import bisect
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.test_operators import EDGES, clashing, docs
from timeloom.llm import alignment, queries, resample, tokens

SF = "/root/testdata/sf0.001"
PARTS = [
    "a", "b", "'", "s", "t", "re", "'ll", "'S", "''", "!", " ", "  ", "\n", "\t", " ", "　", " ", "\x85", "1", "12", "²", "é", "é", "İ", "Σ", "中文", "ก",
    "\x00", "\x1c", "😀", "👍🏽", "ﬁ", "aaaa", "hello", " world", "Wor", "--", "…", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "<|startoftext|>", "<|END", "\r\n",
]


def odd_texts(n=1500, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


# 11. Token counts


@pytest.fixture(scope="module")
def words():
    return tokens.load(queries.WORDS)


def test_counts_equal_the_librarys(spark, words):
    rng = random.Random(8)
    texts = [None, "", *odd_texts(), *["a" * n for n in (1, 2, 511, 512, 513, 3000)], "ab" * 2000, "".join(rng.choice("abcdefghij") for _ in range(5000)), "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(900))]
    library = Tokenizer.from_file(queries.WORDS)
    got = {r["doc_id"]: r for r in tokens.count(docs(spark, list(enumerate(texts))), words).collect()}
    for i, text in enumerate(texts):
        want = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (want, len((text or "").encode()), want > 2048), text[:80]


def test_counts_of_whole_documents(spark, words):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    library = Tokenizer.from_file(queries.WORDS)
    want = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in table.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op11_token_counts(spark, SF).collect()} == want


def test_a_limit_is_exceeded_only_above(spark, words):
    rows = tokens.count(docs(spark, [(1, "a b c"), (2, "a b c d"), (None, "a"), (2, "a b c d")]), words, limit=3).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["over_limit"]) for r in rows) == [(0, 1, False), (1, 3, False), (2, 4, True), (2, 4, True)]


def test_long_and_short_sequences_merge_alike(words):
    rng = random.Random(2)
    sequences = [words.inner[np.frombuffer("".join(rng.choice("aehinorst") for _ in range(rng.randint(1, 400))).encode(), np.uint8)] for _ in range(60)]
    counts = tokens.merged_counts(np.concatenate(sequences), np.cumsum([len(s) for s in sequences]), words)
    assert counts.tolist() == [tokens._merged_long(s, words) for s in sequences]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        tokens.load(queries.BYTES)


def test_count_edges(spark, words):
    assert tokens.count(clashing(spark), words).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert tokens.count(clashing(spark), words).count() == len(EDGES)
    assert tokens.count(docs(spark, []), words).count() == 0


# 12. Importance resampling


def plain_resampling(rows, wanted, rule):
    """(id, n_features, weight, score, rank) of each row, sorted."""

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % rule.buckets for k in range(1, rule.n + 1) for i in range(len(w) - k + 1)]

    all_rows = [(i, *features(t)) for i, t in rows]
    s, t = collections.Counter(b for _, _, f in all_rows for b in f), collections.Counter(b for x in wanted for b in features(x)[1])
    top, bottom = sum(s.values()) + rule.buckets, sum(t.values()) + rule.buckets
    out = []
    for i, n, f in all_rows:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * top / ((s[b] + 1) * bottom))) for b in f)
        h = int(hashlib.sha256(f"{rule.seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((x for x in out if x[1] >= rule.least and x[4] is not None), key=lambda x: (-x[4], x[0], -x[2]))
    drawn = may[: rule.percent * len(may) // 100]
    rest = [x for x in may[len(drawn) :]] + [x for x in out if not (x[1] >= rule.least and x[4] is not None)]
    return sorted([(i, n, w, s, k + 1) for k, (i, _, n, w, s) in enumerate(drawn)] + [(i, n, w, s, None) for i, _, n, w, s in rest], key=repr)


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_against_a_plain_version(spark, n):
    rng = random.Random(n)
    texts = [" ".join(rng.choice(["alpha", "Beta", "gamma-1", "é", "x" * 90, "中文", "z9"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    rows = [*EDGES, *[(10 + i, t) for i, t in enumerate(texts)], (11, texts[0] + " beta"), (None, texts[1] * 3), (12, texts[2]), (12, texts[2])]
    rule = resample.Resampling(n=n, buckets=97, percent=30)
    wanted = [None, "", "alpha beta Alpha", "gamma 1 z9"]
    got = resample.resample(docs(spark, rows), docs(spark, list(enumerate(wanted))), rule)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resampling(rows, wanted, rule)


def test_ties_go_to_the_smaller_id(spark):
    # without a target and with one word each, scores differ by noise alone; repeated ids tie
    rows = [(i, " ".join(["same"] * 20)) for i in (3, 1, 2, 2, 1)]
    rule = resample.Resampling(percent=100)
    got = resample.resample(docs(spark, rows), docs(spark, []), rule).collect()
    ordered = [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])]
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5] and {tuple(ordered.index(i) + k for k in range(ordered.count(i))) == tuple(k for k, x in enumerate(ordered) if x == i) for i in (1, 2)} == {True}


def test_crc_of_spans():
    rng = random.Random(6)
    spans = [rng.randbytes(rng.choice([0, 1, 2, 5, 63, 64, 65, 300])) for _ in range(300)]
    data = np.frombuffer(b"".join(spans), np.uint8)
    sizes = np.array([len(s) for s in spans])
    assert resample.crc32s(data, np.cumsum(sizes) - sizes, sizes).tolist() == [zlib.crc32(s) for s in spans]


def test_resampling_edges(spark):
    target = docs(spark, [(1, "one")])
    assert resample.resample(clashing(spark), clashing(spark)).count() == len(EDGES)
    assert resample.resample(docs(spark, []), target).count() == 0
    with pytest.raises(ValueError):
        resample.Resampling(buckets=70_000)


# 13. Alignment


@pytest.fixture(scope="module")
def pair():
    return alignment.load(queries.BYTES, queries.TOKENIZER)


def plain_alignment(rows):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each row, by whole texts and byte positions."""
    a_side, b_side = Tokenizer.from_file(queries.BYTES), sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    a_side.encode_special_tokens = True
    value = {c: b for b, c in enumerate(tokens.byte_letters())}
    counts, found = collections.Counter(), []
    for i, text in rows:
        a, b = (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ([], [])
        of_a = [bytes(value[c] for c in a_side.id_to_token(x)) for x in a]
        of_b = [bytes([x - b_side.piece_to_id("<0x00>")]) if b_side.is_byte(x) else b_side.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or b"".join(of_a) != f" {text}".encode() or b"".join(of_b) != f" {text}".encode():
            a, b, of_a, of_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
        links, x, y = [], 0, 0
        while x < len(a) and y < len(b):
            links.append((a[x], b[y]))
            here_a, here_b = ends_a[x], ends_b[y]
            x, y = x + (here_a <= here_b), y + (here_b <= here_a)
        cuts = sorted(set(ends_a) & set(ends_b))
        sides = [collections.defaultdict(list), collections.defaultdict(list)]
        for side, ids, ends in ((sides[0], a, ends_a), (sides[1], b, ends_b)):
            for t, e in zip(ids, ends, strict=True):
                side[bisect.bisect_left(cuts, e)].append(str(t))
        groups = [",".join(sides[0][k]) + "|" + ",".join(sides[1][k]) for k in range(len(cuts))]
        counts.update(links)
        found.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    highest = collections.Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return sorted([(i, n_a, n_b, g, len(k), sum(counts[x] == highest[x[1]] for x in k), sum(counts[x] for x in k), d) for i, n_a, n_b, g, k, d in found], key=repr)


def test_alignment_against_a_plain_version(spark, pair):
    rows = [*EDGES, *enumerate(odd_texts(600, 7), 100), (20, "▁"), (21, "a▁ b"), (22, " "), (23, "x "), (None, "no id"), (24, "word word"), (24, "another"), (25, "the same"), (26, "the same")]
    got = alignment.align(docs(spark, rows).repartition(3), pair)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_alignment(rows)


def test_alignment_of_whole_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows_got = sorted((tuple(r) for r in queries.op13_tokenizer_alignment(spark, SF).collect()), key=repr)
    assert rows_got == plain_alignment(rows)


def test_chunks_hold_the_texts(pair):
    rows = [(i, t) for i, t in enumerate(odd_texts(120, 9))]
    texts = pa.array([t for _, t in rows])
    aligner, whole = alignment.Aligner(pair), alignment.chunks_of(texts)
    assert len(whole[3]) == len(rows) + 1 and whole[0].tobytes().decode() == "".join(f" {t}" for _, t in rows if t)
    got = aligner.align([whole[0].tobytes()[a:b] for a, b in zip(whole[1], whole[2], strict=True)])
    assert got.good.all() and (got.n_links >= np.maximum(got.n_a, got.n_b)).all() and (got.n_groups <= np.minimum(got.n_a, got.n_b)).all()


def test_alignment_refuses_other_files():
    with pytest.raises(ValueError):
        alignment.load(queries.WORDS, queries.TOKENIZER)


def test_alignment_edges(spark, pair):
    assert alignment.align(clashing(spark), pair).count() == len(EDGES)
    assert alignment.align(docs(spark, []), pair).count() == 0
    assert all(r["n_a"] == 0 and r["groups_sha256"] == "" for r in alignment.align(docs(spark, [(1, None), (2, "")]), pair).collect())
