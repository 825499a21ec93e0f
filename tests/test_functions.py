"""Column functions on the values that the rules give by hand."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from timeloom.functions import signal
from timeloom.functions import text as tx
from timeloom.functions import timegrid as tg


def one(spark, column, **values):
    row = spark.range(1).select(*[(v if not isinstance(v, (int, float, str, bool)) else F.lit(v)).alias(k) for k, v in values.items()] or ["id"])
    return row.select(column.alias("x")).first()["x"]


def test_legal_frames(spark):
    assert tg.GRID.legal == [107, 124, 141, 158, 175, 192, 209, 226, 243, 260, 277, 294, 311, 328, 345]
    want = {2.0: 107, 4.458: 107, 5.0: 124, 5.8: 141, 8.0: 192, 10.0: 243, 14.375: 345, 20.0: 345}
    rows = spark.createDataFrame([(k,) for k in want], "s double").select("s", tg.snapped(tg.frames(F.col("s"))).alias("n")).collect()
    assert {r["s"]: r["n"] for r in rows} == want
    every = spark.range(1, 400).select(F.col("id").cast("int").alias("n")).select("n", tg.snapped(F.col("n")).alias("m")).collect()
    assert all(r["m"] == min(tg.GRID.legal, key=lambda x: (abs(x - r["n"]), x)) for r in every)


def test_grids(spark):
    starts = tg.window_starts(F.lit(10_000), F.array(*[F.lit(x) for x in (2600, 4000, 9900, 12000)]))
    assert one(spark, starts) == [0, 2500, 4000, 5000, 7500, 9900]
    assert one(spark, tg.cell_starts(F.lit(4000), F.lit(7000))) == list(range(4000, 6751, 250))
    assert one(spark, tg.cell_starts(F.lit(9900), F.lit(10_000))) == [9900]
    assert one(spark, tg.spread(F.lit(10), 4)) == [0, 3, 6, 9] and one(spark, tg.spread(F.lit(2), 4)) == [0, 1] and one(spark, tg.spread(F.lit(5), 1)) == [0]
    assert one(spark, tg.chunk_starts(F.lit(500_000))) == [0, 239_600, 479_200]
    assert one(spark, tg.frame_name(F.lit(4250))) == "00425"
    assert one(spark, tg.stable_seed(F.lit("a"), F.lit("b"))) == int(__import__("hashlib").md5(b"a:b").hexdigest()[:8], 16)


@pytest.mark.parametrize("text", ["哈哈哈哈哈哈", "abababab", "hello everyone", "", None, "))))", "甲乙丙丁戊己庚辛" * 3])
def test_hallucinations(spark, text):
    assert one(spark, tx.hallucinated(F.lit(text).cast("string"))) is True


def test_lines_and_forms(spark):
    assert one(spark, tx.hallucinated(F.lit("你好世界"))) is False
    assert [one(spark, tx.dialogue_caption(F.lit(t))) for t in ("你好", "a", "C+++", "你")] == [True, False, False, False]
    assert one(spark, tx.squeezed(F.lit(" A　b\tC "))) == "abc" and one(spark, tx.bare_title(F.lit("《你好_世界》 a!"))) == "你好世界a"
    assert one(spark, tx.region(F.lit(0.72))) == "bottom" and one(spark, tx.region(F.lit(0.22))) == "title" and one(spark, tx.region(F.lit(0.5))) == "other"
    assert one(spark, tx.similarity(F.lit("你好世界"), F.lit("你好世"))) == pytest.approx(0.857, abs=1e-3) and one(spark, tx.similarity(F.lit(""), F.lit("x"))) == 0
    assert one(spark, tx.same_title(F.lit("第一集 大结局"), F.lit("第一集"))) is True


def test_times_and_colours(spark):
    assert one(spark, tx.subtitle_time(F.lit(3_661_500))) == "1:01:01.50" and one(spark, tx.subtitle_time(F.lit(59_999))) == "0:01:00.00"
    assert one(spark, tx.stamp(F.lit(61_005))) == "01:01.005"
    assert one(spark, tx.subtitle_colour(F.lit("#1a2B3c"))) == "&H3C2B1A&" and one(spark, tx.subtitle_colour(F.lit("red"))) == ""
    runs = F.array(F.struct(F.lit("a{b}").alias("text"), F.lit(None).cast("string").alias("color")), F.struct(F.lit("c").alias("text"), F.lit("#FF0000").alias("color")))
    assert one(spark, tx.styled(runs)) == "a\\{b\\}{\\c&H0000FF&}c"


@pytest.mark.parametrize("w, h, label", [(1920, 1080, "16:9"), (1080, 1920, "9:16"), (1000, 700, "10:7"), (1170, 500, "21:9"), (1300, 500, "13:5")])
def test_aspects(spark, w, h, label):
    assert one(spark, tx.aspect_label(F.lit(w), F.lit(h))) == label


def test_bounds_spare_blocks_and_change_nothing(spark):
    import random
    from difflib import SequenceMatcher

    from timeloom.functions import ratio

    rng = random.Random(9)
    text = lambda: "".join(rng.choice("abcde Xé世 ") for _ in range(rng.choice([0, 1, 3, 8, 20, 60])))
    pairs = [(text(), text()) for _ in range(300)] + [(t := text(), t[:-1] + "b") for _ in range(150)] + [(None, "a"), ("a", None), ("x" * 300, "x" * 290 + "y")]
    plain = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    want = [plain(ratio.squeeze(a), ratio.squeeze(b)) for a, b in pairs]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = rows.select("i", tx.similarity("a", "b").alias("r"), tx.bound(F.col("a"), F.col("b")).alias("most"), *[tx.similar(F.col("a"), F.col("b"), x).alias(str(x)) for x in (0.55, 0.72, 0.85, 1.0)]).collect()
    for r in got:
        w = want[r["i"]]
        assert r["r"] == w <= r["most"] + 1e-9 and all(r[str(x)] == (w >= x) for x in (0.55, 0.72, 0.85, 1.0))
        a, b = (ratio.squeeze(x) for x in pairs[r["i"]])
        assert all(ratio.reaches(a, b, x) == (w >= x) for x in (0.55, 0.72, 0.85, 1.0))
    assert sum(r["most"] < 0.72 for r in got) > 150


def test_json_salvage(spark):
    assert one(spark, tx.json_payload(F.lit('Well: {"a": 1} ok'))) == '{"a": 1}'
    assert one(spark, tx.json_payload(F.lit('<think>{"x":2}</think>```json\n{"a": {"b": [1]}}\n```'))) == '{"a": {"b": [1]}}'
    assert one(spark, tx.json_payload(F.lit("prose only"))) is None and one(spark, tx.json_payload(F.lit('{"a": 1}'), key="events")) is None
    raw = '{"action": "runs \\"fast\\"", "adults": "3", "cells": [{"t": "极4.0", "see": "a dog"}, {"t": 5, "see": "cut of'
    assert one(spark, tx.salvaged_count(F.lit(raw), "adults")) == 3 and one(spark, tx.salvaged_field(F.lit(raw), "missing")) is None
    assert [(c["t"], c["see"]) for c in one(spark, tx.salvaged_cells(F.lit(raw)))] == [(4.0, "a dog")]


def payload(text, key=None):
    """The rule by Python's own decoder."""
    import json
    import re

    clean = re.sub(r"(?i)```(?:json)?", "", re.sub(r"(?is)<think>.*?</think>", "", text))
    for start in [i for i, c in enumerate(clean) if c in "{["][:12]:
        try:
            value, end = json.JSONDecoder().raw_decode(clean[start:])
        except ValueError:
            continue
        if key is None or isinstance(value, list) or key in value:
            return clean[start : start + end]
    return None


def test_first_documents_of_noisy_texts(spark):
    import random

    rng = random.Random(5)
    parts = ['{"a": 1}', '{"n": [1, {"x": "}"}]}', "[1, 2]", "[", "{", "}", "]", '"', "\\", " so ", "```json\n", "```", '{"n": "\\\"{"}', "<think>{}</think>", "é{", "[]", '{"b": null}', "{x}", "'"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ['{"a": 1} and {"n": 2}', "{" * 12 + '{"n": 1}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows.select("i", tx.json_payload(F.col("t")).alias("any"), tx.json_payload(F.col("t"), "n").alias("n")).collect()
    assert {r["i"]: (r["any"], r["n"]) for r in got} == {i: (payload(t), payload(t, "n")) for i, t in enumerate(texts)}


def test_a_long_document_takes_time_in_proportion(spark):
    import time

    def took(n):
        text = "{ [ " * 5 + '{"n": [' + ", ".join(f'{{"t": {i}, "see": "a \\"dog\\" [{i}]"}}' for i in range(n)) + "]} bye"
        rows = spark.createDataFrame([(text,)], "t string").repartition(1)
        began = time.time()
        found = rows.select(tx.json_payload(F.col("t"), "n")).first()[0]
        assert found is not None and found.endswith("]}")
        return time.time() - began

    took(10)
    assert took(30_000) < 10  # over a million characters


def test_paths_and_options(spark):
    assert [one(spark, tx.safe_path(F.lit(p))) for p in ("a/b.txt", "/a", "C:\\x", "a/../b", "..", "")] == [True, False, False, False, False, False]
    assert one(spark, tx.option_list(F.lit("a, b;;c "))) == ["a", "b", "c"]


def test_sound(spark):
    assert one(spark, signal.faded(F.array(*[F.lit(1.0)] * 6), 2)) == [0.5, 1.0, 1.0, 1.0, 1.0, 0.5]
    assert one(spark, signal.leading_silence(F.array(*[F.lit(x) for x in (0.0, 0.0, 3.0)]), 1.0)) == 2
    assert sum(one(spark, signal.softmax(F.array(F.lit(1.0), F.lit(2.0))))) == pytest.approx(1)
    import numpy as np

    x = np.zeros(16000)
    x[4000:7200] = np.sin(np.arange(3200) * 2 * np.pi * 500 / 16000)
    frames = spark.createDataFrame([("j", x.tolist())], "k string, s array<double>").select("k", F.posexplode(signal.band_energy()("s")).alias("i", "energy"))
    (island,) = signal.speech_islands(frames, "k").collect()
    assert abs(island["t0"] - 240) <= 40 and abs(island["t1"] - 450) <= 40


def test_elapsed(spark):
    from timeloom.operators.views import elapsed_seconds

    t = lambda s: F.lit(datetime.datetime(2024, 1, 1, 0, 0, s))
    assert one(spark, elapsed_seconds(t(5), F.lit(None).cast("timestamp"), t(9))) == 4 and one(spark, elapsed_seconds(t(9), t(5), t(9))) == 0


def test_phrase_loops_of_lines_and_of_texts_agree(spark):
    rng = random.Random(5)
    texts = ["", "x", "a" * 36, "a" * 35, "abcdefgh" * 3, "abcdefgh" * 2, "字" * 24 + "q", "twelve chars " * 4, "lead in, " + "the same words again " * 3 + "z" * 5]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 90))) for _ in range(150)]
    texts += ["".join(rng.choice("abcdefghij") for _ in range(20)) + "a phrase of twelve and more" * rng.randrange(1, 4) + "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(120))) for _ in range(100)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, text string")
    rows = df.select("i", "text", tx.phrase_loop(F.col("text")).alias("line"), tx.phrase_loop_of_text("text").alias("whole")).collect()
    assert all(r["line"] == r["whole"] for r in rows if r["i"] >= 0), [r for r in rows if r["line"] != r["whole"]][:3]
    assert {r["whole"] for r in rows} == {True, False, None}


def test_bound_squeezes_each_text_once(spark):
    from timeloom.functions import ratio

    pairs = spark.createDataFrame([("A b c", "abc", 1.0), ("ab", "ba", 1.0), ("", "a", 0.0), (None, "a", 0.0), ("aab", "abb", 2 / 3), ("a.*", ".a", 0.8)], "a string, b string, want double").repartition(2)
    found = pairs.select("want", ratio.bound(F.col("a"), F.col("b")).alias("got"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2
    assert all(abs(r["want"] - r["got"]) < 1e-12 for r in found.collect())
