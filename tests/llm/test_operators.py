"""The operators on small tables: edge cases, and plain versions of what SQL can't express."""

import collections
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from timeloom.llm import chunks, decontam, embeddings, html, jaccard, langid, licenses, pii, quality, sentencepiece, session
from timeloom.llm.queries import TOKENIZER

DOCS = "doc_id long, text string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
#: Null, empty, white space, repeated and very long texts.
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, LONG), (7, "a b c d e"), (8, "A b\tc  d e")]


def docs(spark, rows=EDGES):
    return spark.createDataFrame(rows, DOCS)


def clashing(spark, rows=EDGES):
    """Columns named like those that the operators make."""
    return spark.createDataFrame([(*r, 7, "x", 0.5, [1]) for r in rows], DOCS + ", id long, node string, score double, spans array<int>")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# Connected components


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 120)] + [(7, 7), (None, 3)]
    got = dict(rows_of(session.connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 120)}}
    assert session.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1. Licences

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


def test_license_sentences_and_rules(spark):
    rows = [(10, MIT), (11, "Words. This work is licensed under the GNU General Public License, version 3."), (12, "x |\nReleased under the MIT License."), (13, "This licence is unknown to all."), (14, None), (15, "")]
    got = {r["doc_id"]: (r["licenses"], r["n_unknown"]) for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == {10: (["MIT"], 0), 11: (["GPL-3.0-only"], 0), 12: (["MIT"], 0), 13: ([], 1), 14: ([], 0), 15: ([], 0)}


def test_every_known_sentence_is_looked_up_and_used():
    stem = re.compile(licenses.STEMS)
    used = {p for _, parts in licenses.RULES for p in parts}
    for sentence, name in licenses.SENTENCES.items():
        assert name in used or name in ("apache2-url", "mit-warranty"), name
        if name not in ("apache2-head", "apache2-use", "apache2-copy", "apache2-url"):
            assert stem.search(sentence), sentence


WHOLE = {
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "OFL-1.1": "// SPDX-License-Identifier: OFL-1.1",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def test_whole_license_texts(spark):
    rows = [(i, f"Some words.\n{t}\nMore words.") for i, t in enumerate(WHOLE.values())] + [(50, MIT + '\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.')]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert [got[i]["licenses"] for i in range(len(WHOLE))] == [[x] for x in WHOLE] and got[50]["licenses"] == ["MIT"]
    assert got[50]["sentence_ids"] == ["mit-grant", "mit-notice", "mit-warranty"]


def test_wrapped_sentences_are_found_beside_others(spark):
    wrapped = "Released under the Apache License,\nVersion 2.0."
    head = "Licensed under the MIT License\nAll rights reserved\n"
    rows = [(1, f"Some words. {wrapped}"), (2, f"{head}Some words. {wrapped}"), (3, f"{head}Some words\n{wrapped}"), (4, "This work\nis licensed\nunder the\n\nMIT\nLicense"), (5, "\n".join(MIT.split()))]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs(spark, rows)).collect()}
    both = ["Apache-2.0", "LicenseRef-proprietary", "MIT"]
    assert got == {1: ["Apache-2.0"], 2: both, 3: both, 4: ["MIT"], 5: ["MIT"]}


def test_of_sentences_within_one_another_the_longest_counts(spark):
    text = "Licensed under the Apache License, Version 2.0\n(the \"License\");"
    (row,) = licenses.scan(docs(spark, [(None, text)])).collect()
    assert (row["sentence_ids"], row["n_unknown"]) == (["apache2-head"], 0)


def test_license_edges(spark):
    assert licenses.scan(clashing(spark)).count() == len(EDGES)
    assert licenses.scan(docs(spark, [])).count() == 0


# 2. Language


def test_language_model_backs_off_and_handles_edges(spark):
    rng = random.Random(3)
    syllables = {"aa": ["ka", "lo", "mi", "ter"], "bb": ["zu", "qui", "vex", "oth"]}
    text = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 5))) for _ in range(30))
    train = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb"] * 60)] + [(900, None, "aa"), (901, "kalo", None)]
    model = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.langs == ("aa", "bb")
    test = [(i, text(lang)) for i, lang in enumerate(["aa", "bb"] * 20)] + [(50, None), (51, "12 !"), (52, "終わり"), (53, "kalomikalomikalomiter")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs(spark, test), model).collect()}
    assert [got[i][0] for i in range(40)] == ["aa", "bb"] * 20
    assert got[50] == got[51] == ("und", 0.0) and got[52][0] in model.langs and got[53][0] == "aa"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.predict(clashing(spark), model).count() == len(EDGES)
    empty = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert rows_of(langid.predict(docs(spark, [(1, "kalo")]), empty), "lang_pred") == [("und",)]


def test_language_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(table.where(session.fold_column() != 1))
    held = table.where(session.fold_column() == 1)
    assert langid.accuracy(langid.predict(held, model).join(held.select("doc_id", "lang"), "doc_id")) > 0.97


def test_language_scores_against_a_plain_version(spark):
    rng = random.Random(8)
    syllables = {"aa": ["ka", "lo", "mi", "té", "r"], "bb": ["zu", "lo", "vex", "ö"], "cc": ["ka", "zu", "qui"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4)))
    train = [(i, " ".join(word(lang) for _ in range(20)), lang) for i, lang in enumerate(["aa", "bb", "cc", "aa"] * 15)]
    test = [(i, " ".join(word(rng.choice("abc") * 2) for _ in range(rng.randint(1, 9)))) for i in range(80)] + [(90, "xyz"), (91, "Kalo LO-lo 12 vex!"), (92, "k" * 300)]
    counts = {lang: (collections.Counter(), collections.Counter()) for lang in "aa bb cc".split()}
    for _, text, lang in train:
        for w in text.split():
            counts[lang][0][w] += 1
            p = f" {w} "
            for n in range(1, 6):
                counts[lang][1].update(p[i : i + n] for i in range(len(p) - n + 1) if p[i : i + n] != " ")
    logs = []
    for k in (0, 1):
        kept = [t for t in set().union(*(counts[lang][k] for lang in counts)) if sum(counts[lang][k][t] for lang in counts) >= 2]
        total = {lang: sum(counts[lang][k][t] + 0.1 for t in kept) for lang in counts}
        logs.append({t: [np.log((counts[lang][k][t] + 0.1) / total[lang]) for lang in counts] for t in kept})

    def of(w):
        if w in logs[0]:
            return np.array(logs[0][w])
        p = f" {w} "
        for n in range(5, 0, -1):
            seen = [logs[1][p[i : i + n]] for i in range(len(p) - n + 1) if p[i : i + n] in logs[1]]
            if seen:
                return np.mean(seen, axis=0) - 2.0
        return np.full(3, -2.0)

    model = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in langid.predict(docs(spark, test), model).collect()}
    for i, text in test:
        ws = re.findall(r"[^\W\d_]+", text.lower())
        z = sum(of(w) for w in ws) / np.sqrt(len(ws))
        share = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i]["score"] == pytest.approx(share.max(), rel=1e-4)
        assert got[i]["lang_pred"] == list(counts)[int(share.argmax())] or np.sort(share)[-1] - np.sort(share)[-2] < 1e-5


# 3. Jaccard join


def near(text, rng, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("shingle, percent", [(4, 85), (5, 80)])
def test_jaccard_against_brute_force(spark, shingle, percent):
    rng = random.Random(shingle)
    word = lambda: rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.5 else f"v{rng.randrange(3000)}"
    rows = list(EDGES)
    base = " ".join(word() for _ in range(120))
    rows += [(100 + i, near(base, rng, rng.randrange(6))) for i in range(150)]
    rows += [(400 + i, " ".join([*["same", "line", "in", "all", "of", "them"] * 3, *(word() for _ in range(rng.randrange(1, 90)))])) for i in range(120)]
    rows += [(700 + i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(800 + i, near(LONG, rng, 500 * i)) for i in range(4)]
    rule = jaccard.JaccardJoin(shingle=shingle, percent=percent, least=4, block=40)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(docs(spark, rows), rule).collect()}
    assert got == brute.jaccard_components(rows, shingle, percent)


def test_ids_with_several_texts_link_whatever_the_order(spark):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randint(0, 500)}" for _ in range(80))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (1, b), (3, b + " more"), (9, c), (9, d), (4, c + " more"), (5, d + " more"), (9, c), (6, text()), (8, None), (8, "alone here")]
    want = brute.jaccard_components(rows)
    assert want[3][1] == want[1][1] == 1 and want[9][1] == want[4][1] == want[5][1] == 4
    for _ in range(3):
        rng.shuffle(rows)
        got = {(r["doc_id"], r["component_id"]) for r in jaccard.components(docs(spark, rows)).collect()}
        assert got == {(i, x) for i, (_, x) in want.items()}


def test_a_signature_that_a_third_of_all_rows_have(spark, monkeypatch):
    rng = random.Random(9)
    common = " ".join(f"c{i}" for i in range(12))
    rows = [(i, f"{common} a{i} b{i % 7}" if i % 3 == 0 else " ".join(f"w{rng.randint(0, 40)}" for _ in range(9))) for i in range(240)]
    want = brute.jaccard_components(rows, 2, 60)
    for hot, salted in ((65_536, 16_384), (8, 3)):
        monkeypatch.setattr(session, "HOT", hot)
        monkeypatch.setattr(session, "SALTED", salted)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(docs(spark, rows), jaccard.JaccardJoin(shingle=2, percent=60, least=4, block=40)).collect()}
        assert got == want
    assert sum(c != i for i, (_, c) in want.items()) > 60


def test_jaccard_edges(spark):
    got = jaccard.components(clashing(spark, [*EDGES, (None, "a b c d e")]))
    assert got.count() == len(EDGES) + 1
    assert jaccard.components(docs(spark, [])).count() == 0


def test_signatures_of_linked_sets_always_meet():
    rng = np.random.default_rng(5)
    for trial in range(300):
        n, percent = int(rng.integers(2, 400)), int(rng.choice([80, 85]))
        rare = rng.integers(0, 2, n) if trial % 2 else np.ones(n, np.int64)
        universe = np.unique((np.where(rare, jaccard._FREQUENT, 3).astype(np.uint64) << np.uint64(56)) | (rng.integers(0, 2**62, n).astype(np.uint64) >> np.uint64(8)))
        x = universe
        y = np.sort(rng.permutation(x)[: -(-len(x) * percent // 100)])
        both = len(y)
        if 100 * both >= percent * len(x) and len(y) > 1 and len(y) != len(x):
            assert np.intersect1d(jaccard.signatures(x, percent), jaccard.signatures(y, percent)).size, (n, percent)


# 4. SentencePiece


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece.load(TOKENIZER)


def test_viterbi_is_best_by_dynamic_programming(vocabulary):
    v = vocabulary
    scores = {p.encode(): s for p, s in zip(v.pieces, v.scores, strict=True) if not p.startswith("<")}
    for text in ["thntblere", "unbelievable", "ñoéç日本語😀", "aaaaaaa", "x"]:
        data = (sentencepiece.MARK + text).encode()
        best = [0.0] + [-np.inf] * len(data)
        for i in range(len(data)):
            if data[i] & 0xC0 == 0x80:
                continue
            for j in range(i + 1, len(data) + 1):
                if data[i:j] in scores:
                    best[j] = max(best[j], best[i] + scores[data[i:j]])
            one = next(j for j in range(i + 1, len(data) + 1) if j == len(data) or data[j] & 0xC0 != 0x80)
            if data[i:one] not in scores:
                best[one] = max(best[one], best[i] + v.worst)
        ids = sentencepiece.viterbi(data, v)
        byte_ids = set(v.byte_ids.tolist())
        runs = re.sub(r"b+", lambda m: m[0], "".join("b" if i in byte_ids else "p" for i in ids))
        total = sum(v.scores[i] for i in ids if i not in byte_ids)
        n_bare = sum(1 for c in sentencepiece.MARK + text if c.encode() not in scores) if "b" in runs else 0
        assert total + n_bare * v.worst == pytest.approx(best[-1])


def test_encoding_of_batches_equals_that_of_whole_texts_and_round_trips(spark, vocabulary):
    texts = [None, "", " ", "  two  spaces ", "line\nline\tüber", "日本 語😀", "a" * 300, " ".join(f"wörd{i}" for i in range(500)), LONG]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in sentencepiece.round_trip(docs(spark, rows), vocabulary, with_text=True).collect()}
    for i, t in rows:
        want = sentencepiece.viterbi((" " + t).replace(" ", sentencepiece.MARK).encode(), vocabulary) if t and len(t) < 10_000 else got[i]["pieces"] if t else []
        assert got[i]["pieces"] == want and got[i]["same"] and got[i]["text"] == (t or "")
    back = sentencepiece.decode(sentencepiece.encode(docs(spark, rows), vocabulary), vocabulary)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in rows}
    assert sentencepiece.encode(clashing(spark), vocabulary).count() == len(EDGES)
    assert sentencepiece.round_trip(docs(spark, []), vocabulary).count() == 0


# 5. Decontamination

ITEMS = [(1, "What colour has the sky over the northern harbour at noon in late spring? It is a deep and very clear blue without clouds."), (2, "Name the river that runs past seven old mills before it meets the sea. The long winding Arrow river."), (3, None), (4, "..."), (5, "tiny")]


def test_contamination_is_found_and_clean_documents_stay(spark):
    filler = " ".join(f"filler{i % 61}" for i in range(300))
    rows = [(10, f"{filler} {ITEMS[0][1].upper()} {filler}"), (11, filler + " " + ITEMS[1][1]), (12, f"{filler} the sky over the harbour is blue {filler}"), (13, ITEMS[0][1][:70]), (14, None), (15, ""), (10, "again")]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = rows_of(decontam.find(docs(spark, rows), bench), "doc_id", "item_id")
    assert got == [(10, 1), (11, 2)]
    assert sorted(r["doc_id"] for r in decontam.clean(docs(spark, rows), bench).collect()) == [12, 13, 14, 15]
    assert decontam.find(clashing(spark), bench).count() == 0
    assert decontam.find(docs(spark, rows), bench.limit(0)).count() == 0
    small = decontam.Contamination(shard=2, block=1)
    assert rows_of(decontam.find(docs(spark, rows), bench, small), "doc_id", "item_id") == got


def test_contamination_against_brute_force(spark):
    table, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    items = {r["item_id"]: [grams(words(p)) if len(words(p)) >= 5 else {tuple(words(p))} for p in decontam.parts(r["text"])] for r in bench.collect()}
    want = set()
    for r in table.collect():
        w = words(r["text"])
        have = grams(w)
        for i, parts in items.items():
            if any(p & have for p in parts):
                runs = [{tuple(w[j : j + len(next(iter(p)))]) for j in range(len(w))} for p in parts]
                if all(len(p & h) >= 0.8 * len(p) for p, h in zip(parts, runs, strict=True)):
                    want.add((r["doc_id"], i))
    assert set(rows_of(decontam.find(table, bench), "doc_id", "item_id")) == want and want


def bm25(items, rule):
    """A function that gives every item's score for a passage as a share of its own threshold; items without words have none."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bags = {i: words(t) for i, t in items if words(t)}
    mean, n = sum(map(len, bags.values())) / len(bags), len(bags)
    df = collections.Counter(w for b in bags.values() for w in set(b))
    add = lambda w, b: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b.count(w) * (rule.k1 + 1) / (b.count(w) + rule.k1 * (1 - rule.b + rule.b * len(b) / mean))
    adds = {i: {w: add(w, b) for w in set(b)} for i, b in bags.items()}
    return lambda passage: {i: sum(x for w, x in a.items() if w in have) / (rule.threshold * sum(a.values())) for have in [set(words(passage))] for i, a in adds.items()}


def test_wand_retrieves_what_exhaustive_bm25_does():
    rng = random.Random(6)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 400}"
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(90)] + [(900, "..."), (901, "")]
    passages = [" ".join([word() for _ in range(rng.randint(1, 25))] + items[rng.randrange(90)][1].split()[:30]) for _ in range(150)]
    for rule in (decontam.Contamination(), decontam.Contamination(block=1), decontam.Contamination(block=64, threshold=0.4)):
        index = decontam.build([i for i, _ in items], [t for _, t in items], rule)
        got, want, scores = {}, {}, bm25(items, rule)
        hashes, firsts = decontam._word_hashes(pa.array(passages))
        terms = [np.flatnonzero(np.isin(index.terms, hashes[a:b])) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
        for p, slot, score in decontam.wand(index, np.concatenate(terms), np.cumsum([0, *map(len, terms)]), rule.block):
            got[p, int(index.items[slot])] = score
        for p, text in enumerate(passages):
            want |= {(p, i): s for i, s in scores(text).items() if s >= 1 - 1e-6}
        assert got.keys() == want.keys() and len(got) > 100 and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_shards_change_no_score_and_an_edited_answer_is_held(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(30)) + "? " + " ".join(word() for _ in range(12))) for i in range(60)]
    edited = items[7][1].split()
    edited[36] = "edited"
    rows = [(i, " ".join([word() for _ in range(40)] + items[i % 60][1].split()[: 42 - i % 3] + [word() for _ in range(50)])) for i in range(120)] + [(500, " ".join(edited)), (None, items[3][1]), (None, "clean words"), (None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda **k: {(r["doc_id"], r["item_id"]): (r["score"], r["question_overlap"]) for r in decontam.find(docs(spark, rows), bench, decontam.Contamination(**k)).collect()}
    one = found()
    assert (500, 7) in one and (None, 3) in one and len(one) > 80
    for rule in ({"shard": 7, "block": 2}, {"shard_bytes": 500}):
        other = found(**rule)
        assert other.keys() == one.keys() and all(abs(other[k][0] - one[k][0]) < 1e-9 and other[k][1] == one[k][1] for k in one)
    kept = [(r["doc_id"], r["text"]) for r in decontam.clean(docs(spark, rows), bench).collect()]
    assert {t for i, t in kept if i is None} == {"clean words", None} and 500 not in dict(kept)


def test_a_copy_without_an_id_does_not_take_the_signatures(spark):
    words = [f"w{i}" for i in range(40)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.components(docs(spark, [(None, text), (7, text), (8, near)]).coalesce(1)).where("doc_id is not null").collect()}
    assert got == {7: 7, 8: 7}


# 6. Chunks


def chunks_in(text: bytes, rule=chunks.Chunking()):
    starts, ends = chunks.borders(np.frombuffer(text, np.uint8), np.array([0, len(text)]), rule)
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def test_borders_come_back_after_an_insertion():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000)).encode()
    rule = chunks.Chunking()
    a, b = ({t[i:j] for i, j in chunks_in(t)} for t in (text, text[:1000] + b"inserted" + text[1000:]))
    assert len(a) > 150 and len(a & b) >= len(a) - 12 and all(rule.least <= len(x) <= rule.most for x in a)
    for same in (b"x" * 5000, b"ab" * 2500, b"word " * 1000):
        assert 4 < len(chunks_in(same)) <= 400 and chunks_in(same)[0][0] <= rule.most
    assert chunks_in(b"") == [] and chunks_in(b"short") == []


def test_borders_do_not_depend_on_other_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc def") for _ in range(rng.choice([0, 5, 60, 900]))).encode() for _ in range(40)]
    offsets = np.cumsum([0, *map(len, texts)])
    starts, ends = chunks.borders(np.frombuffer(b"".join(texts), np.uint8), offsets, chunks.Chunking())
    for k, t in enumerate(texts):
        mine = (starts >= offsets[k]) & (starts < offsets[k + 1])
        assert {(i - offsets[k], j - offsets[k]) for i, j in zip(starts[mine], ends[mine], strict=True)} == set(chunks_in(t))


def test_repeated_passages_are_found_and_cut(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    passage = " ".join(word() for _ in range(60))
    own = lambda: " ".join(word() for _ in range(80))
    rows = [(1, f"{own()} {passage} {own()}"), (2, f"{own()} {passage} {own()}"), (3, own()), (4, passage), (5, None), (6, ""), (7, own() + " short line repeated"), (8, own() + " short line repeated")]
    got = {r["doc_id"]: r for r in chunks.repeats(docs(spark, rows)).collect()}
    assert set(got) == {1, 2, 4} and got[1]["removed_bytes"] == 0 and got[2]["first_docs"] == [1]
    texts = {r["doc_id"]: r["text"] for r in chunks.deduplicated(docs(spark, rows), chunks.Chunking()).collect()}
    assert texts[1] == rows[0][1] and len(texts[2]) < len(rows[1][1]) - 150 and texts[5] is None and texts[3] == rows[2][1]
    assert chunks.repeats(docs(spark, [])).count() == 0
    assert chunks.deduplicated(clashing(spark)).count() == len(EDGES)


def test_recall_of_short_passages(spark):
    """Passages of 100 to 300 bytes, 200 of each length, each in two documents of its own."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6)))
    own = lambda n: " ".join(word() for _ in range(n))
    rows, sizes = [], (90, 100, 110, 120, 138, 300)
    for k in range(len(sizes) * 200):
        passage = own(200)[: sizes[k % len(sizes)]]
        rows += [(2 * k, f"{own(rng.randint(0, 40))} #{passage}# {own(9)}"), (2 * k + 1, f"{own(rng.randint(0, 23))} <{passage}> {own(30)}")]
    got = {r["doc_id"] for r in chunks.repeats(docs(spark, rows)).collect()}
    found = {n: sum(2 * k in got and 2 * k + 1 in got for k in range(len(rows) // 2) if sizes[k % len(sizes)] == n) for n in sizes}
    assert found[90] == 0 and min(found.values(), key=lambda n: n or 200) >= 180 and found[138] >= 196 and found[300] == 200, found


def test_all_first_documents_of_a_run_are_listed(spark):
    rng = random.Random(5)
    own = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))
    a, b = own(60), own(60)
    rows = [(1, f"{own(50)} {a} {own(50)}"), (2, f"{own(50)} {b} {own(50)}"), (3, f"{own(9)} {a} {b} {own(9)}"), (4, own(40))]
    got = {r["doc_id"]: r for r in chunks.repeats(docs(spark, rows)).collect()}
    assert set(got) == {1, 2, 3} and got[3]["first_docs"] == [1, 2] and got[3]["removed_bytes"] == got[3]["repeated_bytes"] > 500
    assert got[1]["n_passages"] == 1 and got[1]["first_docs"] == [] and got[1]["removed_bytes"] == 0


def test_repeats_against_a_plain_version(spark):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghij éü") for _ in range(rng.randint(2, 8)))
    own = lambda n: " ".join(word() for _ in range(n))
    shared = [own(rng.randint(8, 60)) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(shared) if rng.random() < 0.4 else own(rng.randint(1, 25)) for _ in range(rng.randint(1, 7)))) for i in range(60)]
    rows += [rows[3], (100, None), (101, ""), (102, "ab" * 900), (103, "x " + "ab" * 800), (104, shared[0] * 3)]
    rule = chunks.Chunking()
    texts = {i: (t or "").encode() for i, t in rows}
    own_chunks, holders, spans_at, span_holders = {}, {}, {}, {}
    for i, t in texts.items():
        own_chunks[i] = chunks_in(t)
        for a, b in own_chunks[i]:
            holders.setdefault(t[a:b], set()).add(i)
    for i, t in texts.items():
        shared_chunks = [(a, b) for a, b in own_chunks[i] if len(holders[t[a:b]]) > 1]
        # runs of chunks, and the spans around them
        spans_at[i] = set()
        for run in (list(g) for g in runs_of(shared_chunks)):
            begin, end = run[0][0], max(b for _, b in run)
            if end - begin < rule.passage:
                spans_at[i] |= {a for a in range(max(0, end - rule.passage), begin + 1) if a + rule.passage <= len(t)}
            else:
                begins = [a for a, _ in run]
                steps = {a + k for a, z in zip(begins, [*begins[1:], begins[-1] + 1]) for k in range(0, z - a, 50)}
                spans_at[i] |= {a for a in steps if a + rule.passage <= end} | {end - rule.passage}
        for a in spans_at[i]:
            span_holders.setdefault(t[a : a + rule.passage], set()).add(i)
    got = {r["doc_id"]: r for r in chunks.repeats(docs(spark, rows)).collect()}
    everywhere = collections.Counter(s for t in texts.values() for s in {t[a : a + 100] for a in range(len(t) - 99)})
    for i, t in texts.items():
        spans = [a for a in spans_at[i] if len(span_holders[t[a : a + 100]]) > 1]
        later = [a for a in spans if min(span_holders[t[a : a + 100]]) < i]
        cover = lambda starts: set().union(*(range(a, a + 100) for a in starts)) if starts else set()
        assert (i in got) == bool(spans) and all(everywhere[t[a : a + 100]] > 1 for a in spans)
        if spans:
            gone = cover(later)
            assert got[i]["repeated_bytes"] == len(cover(spans)) and got[i]["removed_bytes"] == len(gone)
            assert got[i]["first_docs"] == sorted({min(span_holders[t[a : a + 100]]) for a in later})
            assert got[i]["text"] == bytes(b for k, b in enumerate(t) if k not in gone).decode("utf-8", "ignore")
    assert len(got) > 20


def runs_of(found):
    """Spans in order, cut where one begins far behind all before it."""
    run, reach = [], -1
    for a, b in found:
        if run and a > reach + chunks.BRIDGE:
            yield run
            run = []
        run.append((a, b))
        reach = max(reach, b)
    if run:
        yield run


def test_texts_of_one_id_and_rows_without_an_id_are_cut_by_their_own(spark):
    rng = random.Random(16)
    own = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))
    passage, other = own(60), own(90)
    rows = [(1, f"{own(5)} {passage} {own(5)}"), (2, other), (2, f"{own(40)} {passage}"), (None, f"{passage} {own(30)}"), (None, own(50)), (None, None), (1, None)]
    got = [(r["doc_id"], r["text"]) for r in chunks.deduplicated(docs(spark, rows)).collect()]
    assert len(got) == len(rows) and (2, other) in got and (None, None) in got and (None, rows[4][1]) in got
    assert sum(passage[30:200] in (t or "") for _, t in got) == 1


# 7. Pages


def test_main_text_of_a_page():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><a href=x>Menu, of, things</a></nav>
    <div class="cookie-notice">We use cookies, many, many.</div><article><h1>A title &amp; more</h1><p><b>First   para,
    with <i>inline</i> text<br><p>Second &lt;para&gt;, longer, with commas.</p><ul><li>one</li><li>two</li></ul><div class="ad">Buy, buy, buy</div>
    <script>var t="</p>"</script><form><p>Name</p></form></article><aside>Side, bar</aside><section class="comments"><p>I, the reader, disagree, a lot, with this.</p></section><footer>&copy;</footer></body></html>"""
    assert html.main_text(page) == "A title & more\n\nFirst para, with inline text\n\nSecond <para>, longer, with commas.\n\none\n\ntwo"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("plain words") == "plain words"
    assert html.main_text("<p>open <a href='x>y</p><p>z, and more words here.") != ""


def test_extraction_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>x, y</p></article>"), (3, "u", "<article><p>x, y</p></article>"), (4, "u", "<p>" + "long, " * 50_000)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars"))
    assert [(r["page_id"], r["n_chars"]) for r in sorted(got.collect(), key=lambda r: (r["page_id"], r["n_chars"]))] == [(1, 0), (2, 0), (3, 4), (3, 4), (4, 299_999)]


def test_no_text_of_an_article_is_lost():
    long = "One long text, with commas, and more, and more, so that it counts, yes, and again, and again, so it is best, of all."
    paper = f"<body><div><p>{long}</p><section id='discussion'><p>We discuss, at length, the outcome of this study, in words.</p><p>More, and more, of it.</p></section></div></body>"
    assert html.main_text(paper).endswith("More, and more, of it.")
    for wrapped in ("<header><h1>Title</h1></header>", "<div class='entry-header'><h1>Title</h1></div>"):
        assert html.main_text(f"<article>{wrapped}<p>Text, and more.</p></article>") == "Title\n\nText, and more."
    assert html.main_text("<article><p>Text, and more.</p><div class='commentList'><p>I disagree, a lot, with this.</p></div><div id='adBox'>Buy, buy.</div></article>") == "Text, and more."
    listed = "<article><p>Text, and more.</p><h2>References</h2><ol><li><a href=x>Doe, J. A study of things that are long. Journal, 2001.</a></li></ol><ul><li><a>Home</a></li><li><a>About</a></li></ul></article>"
    assert html.main_text(listed).split("\n\n") == ["Text, and more.", "References", "Doe, J. A study of things that are long. Journal, 2001."]
    assert html.main_text(f"<body><div><p>{long}</p></div><div><p>Short</p></div><div><p>{long}</p></div></body>") == f"{long}\n\nShort\n\n{long}"
    for tag in ("noscript", "script", "iframe"):
        assert html.main_text(f"<body><article><p>Before, yes.</p><div><{tag}>off</div><p>After, it goes on.</p></article></body>") == "Before, yes.\n\nAfter, it goes on.", tag
    assert html.main_text(f"<body><div class='widget'><p>{long}</p></div></body>") == long


LONG_TEXT = "One long text, with commas, and more, and more, so that it counts, yes, and again, and again, so it is best, of all."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>LONG</p><section id='related-work'><h2>Related work</h2><p>Others have done it, too.</p></section></article>", ["LONG", "Related work", "Others have done it, too."]),
        ("<article><p>LONG</p><h2 id='search'>Search</h2><p>LONG</p><h2 id='social-impact'>Social impact</h2><p>x, y.</p></article>", ["LONG", "Search", "LONG", "Social impact", "x, y."]),
        ("<article><section id='search'><h2>Search</h2><p>LONG</p></section><p>LONG</p></article>", ["Search", "LONG", "LONG"]),
        ("<article><p>LONG</p><ul><li><a>Ada Lovelace</a></li><li><a>Alan Turing</a></li></ul><p>LONG</p></article>", ["LONG", "Ada Lovelace", "Alan Turing", "LONG"]),
        ("<body><form id='aspnetForm'><article><p>LONG</p><p>And so on.</p></article></form></body>", ["LONG", "And so on."]),
        ("<body><form id='aspnetForm'><div><p>LONG</p><p>And so on</p></div></form></body>", ["LONG", "And so on"]),
        ("<body><div><p>LONG</p></div><p>LONG</p><p>The end</p></body>", ["LONG", "LONG", "The end"]),
        ("<article><p>LONG</p><form><p>Your name</p><label>Mail</label><input></form><div class='newsletter-signup'><p>Get it by mail, now.</p></div></article>", ["LONG"]),
        ("<article><p>LONG</p><section id='comments'><h2>3 comments</h2><p>LONG</p><p>LONG</p><p>LONG</p></section></article>", ["LONG"]),
        ("<article><p>LONG</p><ul class='share'><li><a>Post it</a></li><li><a>Send it</a></li></ul><div class='related-posts'><a>Another text</a></div></article>", ["LONG"]),
    ],
)
def test_names_weigh_and_do_not_delete(page, want):
    assert html.main_text(page.replace("LONG", LONG_TEXT)).split("\n\n") == [w.replace("LONG", LONG_TEXT) for w in want]


def test_of_equal_containers_the_first_is_the_best():
    # siblings that read alike are kept with it, in page order
    page = "<body><div><p>{0}</p></div><div><p>{1}</p></div></body>".format(LONG_TEXT, LONG_TEXT.replace("One", "Two"))
    assert html.main_text(page) == LONG_TEXT + "\n\n" + LONG_TEXT.replace("One", "Two")


@pytest.mark.parametrize("page", ["<b><p>some words, and more." * 16_000, "<span>" * 16_000 + "<p>some words, and more.</p>" * 16_000, "<p>some words, and more.</p><div>" * 16_000])
def test_unclosed_tags_take_no_more_time(page):
    began = time.time()
    assert html.main_text(f"<article>{page}</article>").count("some words") == 16_000
    assert time.time() - began < 5


def test_generated_pages_give_their_article_and_nothing_else():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    text = lambda a, b: " ".join(word() + ("," if rng.random() < 0.15 else "") for _ in range(rng.randint(a, b))).rstrip(",") + "."
    links = lambda n: "<ul>" + "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(n)) + "</ul>"
    noise = [
        lambda: f"<nav>{links(6)}</nav>", lambda: f"<div class='ad-box ads'>{text(3, 40)}</div>", lambda: f"<aside><h3>{word()}</h3><p>{text(5, 30)}</p></aside>", lambda: f"<div id='cookie-consent'><p>{text(5, 25)}</p></div>",
        lambda: f"<form><p>{text(2, 9)}</p><input name=q><button>Go</button></form>", lambda: f"<script>var x = '<p>{word()}</p>';</script>", lambda: "<style>p { margin: 0 }</style>", lambda: f"<!-- <p>{word()}</p> -->",
        lambda: f"<section class='comments'>{''.join(f'<p>{text(5, 30)}</p>' for _ in range(rng.randint(1, 4)))}</section>", lambda: f"<div class='sidebar'>{links(3)}<p>{text(3, 20)}</p></div>",
    ]
    for trial in range(200):
        blocks, inner = [], []
        for _ in range(rng.randint(3, 12)):
            kind = rng.choice(["p", "p", "p", "h2", "li", "inline", "noise"])
            if kind == "noise":
                inner.append(rng.choice(noise)())
                continue
            b = text(4, 60) if kind != "h2" else text(1, 5)[:-1]
            blocks.append(b)
            shown = b.replace(" ", "\n  ", 1) if rng.random() < 0.3 else b
            inner.append(f"<ul><li>{shown}</li></ul>" if kind == "li" else f"<p>{shown[:2]}<b>{shown[2:]}</b></p>" if kind == "inline" else f"<{kind}>{shown}</{kind}>")
        if not blocks:
            continue
        blocks.append(end := text(40, 60))
        inner.append(f"<p>{end}")
        tag = rng.choice(["article", "main", "div class='content'"])
        before, after = ("".join(rng.choice(noise)() for _ in range(rng.randint(0, 4))) for _ in range(2))
        page = f"<html><head><title>{word()}</title></head><body><header><p>{text(3, 9)}</p></header>{before}<{tag}>{''.join(inner)}</{tag.split()[0]}>{after}<footer><p>{text(5, 20)}</p></footer></body></html>"
        assert html.main_text(page) == "\n\n".join(blocks), (trial, page)


def test_pages_against_a_plain_version(spark):
    import html as entities

    def plain(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        inner = re.sub(r"<br>", " ", re.sub(r"<!--.*?-->", "", inner, flags=re.S))
        return "\n\n".join(b for part in re.split(r"</?(?:p|h1)>", inner) if (b := " ".join(entities.unescape(re.sub(r"<[^>]*>", "", part)).split())))

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in html.extract(pages).collect()} == want and len(want) == 250


# 8. Quality


def test_trees_learn_and_walk_in_arrays():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = quality.grow(x, y, trees=40)
    assert (((forest.probability(x) >= 0.5) == y).mean()) > 0.97

    def walk(row):
        total = forest.bias
        for t in range(len(forest.value)):
            node = 0
            while node < 2**forest.depth - 1:
                node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.threshold[t, node])
            total += forest.value[t, node - 2**forest.depth + 1]
        return total

    assert np.allclose([walk(r) for r in x[:50]], forest.raw(x[:50]))
    assert 0 < quality.grow(x[:0], y[:0]).probability(x[:1])[0] < 1


def test_features_are_finite_and_independent_of_neighbours():
    texts = [None, "", "a", "THE! END!! 12 ###", "x\nx\nx y", LONG]
    together = quality.features(pa.array(texts, pa.string()))
    assert together.shape == (6, len(quality.FEATURES)) and np.isfinite(together).all()
    for i, t in enumerate(texts):
        assert np.allclose(quality.features(pa.array([t], pa.string()))[0], together[i])


def test_features_against_a_plain_version():
    texts = ["The END. Of, the (the) line!\n\nNEW line | x # é\n12 34 a a", "one", " \n ", "VERYLONGWORDINDEEDOFMORETHANTWENTY b!!\nb!!"]
    got = quality.features(pa.array(texts))
    for row, text in zip(got, texts, strict=True):
        raw = text.encode()
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
        n, w, k = max(1, len(raw)), max(1, len(words)), max(1, len(lines))
        kind = lambda c: "space" if c in b" \t\n\x0b\x0c\r" else "lower" if 97 <= c <= 122 else "upper" if 65 <= c <= 90 else "digit" if 48 <= c <= 57 else "punct" if c in b".,;:!?'\"()-" else "high" if c > 127 else "symbol"
        shares = collections.Counter(kind(c) for c in raw)
        has = lambda x, name: sum(kind(c) == name for c in x)
        want = {
            "log_bytes": np.log1p(len(raw)), "log_words": np.log1p(len(words)), **{c: shares[c] / n for c in ("lower", "upper", "digit", "punct", "symbol", "high", "space")},
            "mean_word": sum(map(len, words)) / w, "long_word": sum(len(x) > 20 for x in words) / w, "one_byte_word": sum(len(x) == 1 for x in words) / w, "distinct_words": len(set(words)) / w,
            "repeat_next": sum(a == b for a, b in zip(words, words[1:])) / w, "shouted_words": sum(has(x, "upper") >= 2 and not has(x, "lower") for x in words) / w, "symbol_words": sum(has(x, "symbol") > 0 for x in words) / w,
            "log_lines": np.log1p(len(lines)), "words_per_line": len(words) / k, "distinct_lines": len(set(lines)) / k, "ends_in_stop": sum(x.endswith(b".") for x in words) / w, "pipes": raw.count(b"|") / w,
            "exclaims": raw.count(b"!") / w, "top_word": max(collections.Counter(words).values(), default=0) / w,
        }
        assert set(want) == set(quality.FEATURES)
        assert np.allclose(row, [want[f] for f in quality.FEATURES], atol=1e-6), dict(zip(quality.FEATURES, row, strict=True))


def test_quality_held_out_accuracy_and_edges(spark):
    path = "/root/testdata/sf0.01/"
    table = spark.read.parquet(path + "documents.parquet").join(spark.read.parquet(path + "labels.parquet"), "doc_id").withColumnRenamed("quality", "label")
    forest = quality.train(table.where(session.fold_column() != 1))
    scored = quality.score(table.where(session.fold_column() == 1), forest, keep=True).select("label", "quality_score").toPandas()
    assert ((scored.quality_score >= 0.5) == scored.label).mean() > 0.95
    assert quality.score(clashing(spark), forest).where("score between 0 and 1").count() == len(EDGES)
    assert quality.train(table.limit(0)).probability(np.zeros((1, len(quality.FEATURES)), np.float32)).shape == (1,)


def test_folds_agree_with_the_driver_side(spark):
    got = spark.range(50).select("id", session.fold_column("id").alias("f")).collect()
    assert [(r["id"], r["f"]) for r in got] == [(i, zlib.crc32(str(i).encode()) % 3) for i in range(50)]


# 9. Personal data


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed([int(c) for c in digits]))) % 10 == 0


def plain_spans(text):
    out = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 13 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15][k]
            if good:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_against_the_patterns(spark):
    rng = random.Random(4)
    parts = ["a.b@c.de", "x@y", "@", "é😀", "10.0.0.1", "999.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 123-4567", "+49", " ", "-", "5", "word", "\n"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))) for i in range(400)] + [(900, None), (901, ""), (902, "1" * 5000), (903, "7 " * 4000), (904, "a" * 20000 + "@")]
    got = {r["id"]: [tuple(s) for s in r["spans"]] for r in pii.find(docs(spark, rows)).collect()}
    assert got == {i: plain_spans(t) for i, t in rows}


def test_revealing_words_are_found_and_text_is_sanitised(spark):
    common = [(i, f"plain words stand here again number {'abcdefghijklmnopqrst'[i % 20]}") for i in range(200)]
    rows = [*common, (500, "plain Zanzibarius lives here mail z@x.org words"), (501, "here Zanzibarius wrote z@x.org again"), (502, None)]
    got = {r["id"]: r for r in pii.find(docs(spark, rows)).collect()}
    term = [(t["start"], t["end"]) for t in got[500]["terms"]]
    assert (6, 17) in term and all(rows[-3][1][a:b] not in ("plain", "here", "words") for a, b in term)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(clashing(spark, rows)).collect()}
    assert clean[502] is None and "[EMAIL]" in clean[501] and "Zanz" not in clean[501] and "z@x" not in clean[500] and clean[3] == rows[3][1]
    assert pii.find(docs(spark, [])).count() == 0 and pii.find(clashing(spark)).count() == len(EDGES)


def test_personal_data_of_repeated_rows_and_rows_without_an_id(spark, tmp_path):
    import duckdb

    from compare import canonical
    from timeloom.llm.queries import op9_pii
    from timeloom.llm.sql import pii_sql

    common = [(i, f"plain words stand here again number {'abcdefghijklmnopqrst'[i % 20]}") for i in range(200)]
    held = (500, "plain Zanzibarius lives here mail z@x.org words")
    rows = [*common, *[held] * 6, (501, "here Zanzibarius wrote z@x.org again"), (None, "Zanzibarius has no id but z@x.org"), (501, "completely other text without any personal stuff"), (502, None), (503, "")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    # the SQL gathers spans by id, so it is asked for rows that have one id each; copies count for it all the same
    single = lambda frame: frame[~frame.doc_id.isin([501]) & frame.doc_id.notna()].drop_duplicates()
    ours, theirs = single(op9_pii(spark, str(tmp_path)).toPandas()), single(con.execute(pii_sql()).df())
    theirs = theirs[theirs.doc_id != 500]
    assert canonical(ours[ours.doc_id != 500]) == canonical(theirs) and len(theirs) == 202
    got = [(r["id"], r["text"], [(t["start"], t["end"]) for t in r["terms"]]) for r in pii.find(docs(spark, rows)).collect()]
    assert all((6, 17) in t for i, _, t in got if i == 500) and sum(i == 500 for i, _, _ in got) == 6
    assert [t for i, x, t in got if x.startswith("completely")] == [[]] and [(0, 11) in t for i, _, t in got if i is None] == [True]
    clean = {(r["doc_id"], r["text"]) for r in pii.sanitise(docs(spark, rows)).collect()}
    assert (501, rows[-3][1]) in clean and (502, None) in clean and not any(x and ("Zanz" in x or "z@x" in x) for _, x in clean)


def test_one_long_token_takes_linear_time_and_many_matches_too(spark):
    rows = [(1, "7" * 1_000_000), (2, "a" * 1_000_000 + "@"), (3, "a@b.cd " * 20_000), (4, "1." * 300_000), (5, "+1" + "(" * 500_000), (6, "1.2.3.4 " * 5_000 + "x" * 300_000)]
    began = time.monotonic()
    got = {r["id"]: r["n"] for r in pii.find(docs(spark, rows)).selectExpr("id", "size(spans) AS n").collect()}
    assert got == {1: 0, 2: 0, 3: 20_000, 4: 75_000, 5: 0, 6: 5_000} and time.monotonic() - began < 60
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(spark, rows)).collect()}
    assert clean[3] == "[EMAIL] " * 20_000 and clean[1] == rows[0][1]


def test_words_are_generalised_to_their_class_or_removed(spark):
    text = "In Paris, NATO told a.b@c.de and sixwords"
    spans, terms = [(0, 20, 28)], [(3, 8, 0.9), (10, 14, 0.9), (29, 32, 0.99), (33, 41, 0.9)]
    row = spark.createDataFrame([(text, spans, terms)], "text string, spans array<struct<kind:int,start:int,end:int>>, terms array<struct<start:int,end:int,share:double>>")
    assert row.select(pii.sanitised(row.text, row.spans, row.terms)).first()[0] == "In [NAME], [ABBREVIATION] told [EMAIL]  [WORD]"
    assert "[WORD]" in pii.CLASSES


# 10. Embeddings


def plain_links(rows, threshold=0.9):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    links = {i: [j for j in ids if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= threshold] for i in ids}
    root = {i: i for i in ids}
    for _ in ids:
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in ids}
    return {i: (len(links.get(i, [])), root.get(i, i)) for i, _ in rows}


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 60)
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 12))
    rows = [(i, (base[i % 40] + rng.normal(size=12) * rng.choice([0.0, 0.2, 0.4])).tolist()) for i in range(300)]
    rows += [(900, None), (901, []), (902, [0.0] * 12), (903, [float("nan")] * 12), (904, [None] + [1.0] * 11), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] * 12)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, id string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(frame).collect()}
    assert got == plain_links(rows)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_very_large_and_small_vectors_link_by_their_direction(spark):
    rows = [(1, [1e200, 2e200, 0.0]), (2, [1e-200, 2e-200, 0.0]), (3, [1.0, 2.0, 0.0]), (4, [0.0, 0.0, 5e-324]), (5, [0.0, 1e-30, 1.0]), (6, [-1.0, -2.0, 0.0]), (6, [-1.0, -2.0, 0.0]), (None, [1.0, 2.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (1, 4, True), 5: (1, 4, False), 6: (0, 6, True), None: (0, None, False)}


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 20))
    unit, codes, scale, length, rest = embeddings.quantised(x)
    error = np.abs(unit @ unit.T - (codes @ codes.T) * scale[:, None] * scale[None])
    bound = length[:, None] * rest[None] + rest[:, None] * length[None] + rest[:, None] * rest[None]
    assert (error <= bound + 1e-12).all()


# Ties


def test_of_equal_languages_the_first_by_name_is_named(spark):
    rows = [(i, text, lang) for i in range(40) for text, lang in (("alpha beta gamma", "zz"), ("alpha beta gamma", "aa"))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    (row,) = langid.predict(docs(spark, [(1, "alpha gamma")]), model).collect()
    assert row["lang_pred"] == "aa" and row["score"] == pytest.approx(0.5)


def test_a_score_of_one_half_is_predicted(spark, monkeypatch):
    forest = quality.Forest(0.0, 1, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    monkeypatch.setattr("timeloom.llm.queries.trained_quality", lambda *_: forest)
    from timeloom.llm import queries

    got = queries.op8_quality(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got)


def test_items_of_one_text_are_all_held(spark):
    item = " ".join(f"question{i} of the test" for i in range(12)) + ". The answer is something rare indeed."
    bench = spark.createDataFrame([(9, item), (4, item), (7, "another item that nobody holds, with words of its own.")], "item_id long, text string")
    got = decontam.find(docs(spark, [(1, f"before {item} after"), (2, "clean words")]), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 4), (1, 9)] and len({r["score"] for r in got}) == 1


def test_rows_without_an_id_are_of_no_fold(spark, tmp_path):
    from timeloom.llm import queries

    spark.createDataFrame([(None, "some words here", "en"), (1, "mais oui", "fr"), (2, "and words", "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert all(r["held_out"] is not None for r in queries.op2_language_id(spark, str(tmp_path)).collect())


def test_frequencies_count_ids_and_not_rows(spark):
    person = "write to anna@mail.example about Hohenfels, please"
    rows = [*[(i, person) for i in range(6)], *[(100 + i, f"word{i} and others") for i in range(30)]]
    spans = lambda rows: {r["id"]: [(t["start"], t["end"], round(t["share"], 9)) for t in r["terms"]] for r in pii.find(docs(spark, rows)).collect()}
    once = spans(rows)
    assert once[0] and spans(rows + rows[:3] + rows[10:20]) == once


def test_words_in_place_against_all_pairs():
    rng = np.random.default_rng(8)
    for m, n, kinds in ((0, 5, 3), (5, 0, 3), (1, 1, 1), (30, 80, 4), (200, 500, 40), (60, 10, 2)):
        part, passage = (rng.integers(0, kinds, x).astype(np.uint64) for x in (m, n))
        places = [sum(0 <= i + d < n and part[i] == passage[i + d] for i in range(m)) for d in range(-m, n)]
        assert decontam._in_place(part, passage) == (max(places) / m if m and n else 0.0)
    began = time.time()
    long = rng.integers(0, 3000, 16_000).astype(np.uint64)
    assert decontam._in_place(long, np.concatenate([long[8000:], long])) == 1.0 and decontam._in_place(np.zeros(4000, np.uint64), np.zeros(9000, np.uint64)) == 1.0
    assert time.time() - began < 5
