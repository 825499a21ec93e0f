"""Timeline operators on hand-worked cases."""

import random

import pytest
from pyspark.sql import functions as F

from timeloom.operators import audit, boundaries, delivery, dialogue, events, graph, intervals, jobs, packing, retime, sequences, views


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def points(spark, ts):
    return spark.createDataFrame([("j", t) for t in ts], "job_id string, t long")


def test_anchored_clusters_measure_from_their_first_member(spark):
    got = rows_of(sequences.anchored_clusters(points(spark, [1000, 1500, 1900, 2400, 2700]), "job_id", 800), "t", "anchor")
    assert got == [(1000, 1000), (1500, 1000), (1900, 1900), (2400, 1900), (2700, 1900)]


def test_thinning_counts_from_the_last_point_kept(spark):
    assert rows_of(sequences.thinned(points(spark, [1200, 1900, 2300, 3100]), "job_id", 1000), "t") == [(1200,), (2300,)]


def test_lookback_merge(spark):
    rows = [("j", i, t, x) for i, (t, x) in enumerate([(0, "A"), (250, "B"), (500, "A"), (750, "B"), (3000, "A")])]
    got = rows_of(sequences.lookback_merge(spark.createDataFrame(rows, "job_id string, ord int, t long, text string"), "job_id"), "t0", "t1", "text")
    assert got == [(0, 500, "A"), (250, 750, "B"), (3000, 3000, "A")]


def test_slots_islands_offsets_and_locks(spark):
    slot = spark.createDataFrame([("j", 1, 500), ("j", 2, 550), ("j", 3, 1900)], "k string, ord int, t long")
    assert rows_of(sequences.last_per_slot(slot, "k", 250, "ord"), "slot", "t") == [(2, 550), (7, 1900)]
    flags = spark.createDataFrame([("j", i, c == "1") for i, c in enumerate("0110111000101")], "k string, i long, f boolean")
    assert rows_of(sequences.boolean_islands(flags, "k", "f", "i", 1, 4), "first", "last", "n") == [(1, 6, 6)]
    laid = sequences.offsets(spark.createDataFrame([("j", 1, 5), ("j", 2, 7)], "k string, n int, d long"), "k", "n", "d")
    assert rows_of(laid, "cat0", "cat1") == [(0, 5), (5, 12)]
    lock = spark.createDataFrame([("j", 1, ""), ("j", 2, "x"), ("j", 3, "y")], "k string, n int, v string")
    assert rows_of(sequences.canonical(lock, ["k"], "n", "v", "c"), "n", "c") == [(1, "x"), (2, "x"), (3, "x")]


def test_fuzzy_sessions(spark):
    hits = [("j", "bottom", t, x) for t, x in [(0, "你好世界"), (500, "你好世"), (1000, "完全不同"), (9000, "完全不同")]]
    got = rows_of(sequences.fuzzy_sessions(spark.createDataFrame(hits, "job_id string, region string, t long, text string"), ["job_id", "region"], 500), "t0", "t1", "text", "n")
    assert got == [(0, 1000, "你好世界", 2), (1000, 1500, "完全不同", 1), (9000, 9500, "完全不同", 1)]


@pytest.mark.parametrize("reasons, want", [(["cut", "gap"], 3), (["title", "tail-silent"], 5), (["unknown"], 1), (["cut", "cut"], 2)])
def test_scores(spark, reasons, want):
    assert spark.range(1).select(boundaries.score(F.array(*[F.lit(r) for r in reasons])).alias("s")).first()["s"] == want


def mock(spark):
    speech = [("m", t0, t1) for t0, t1 in [(800, 3200), (6600, 9000), (12400, 14800), (18200, 20600), (24000, 26800)]]
    empty = lambda s: spark.createDataFrame([], s)
    return (
        empty("job_id string, t long"),
        spark.createDataFrame(speech, "job_id string, t0 long, t1 long"),
        empty("job_id string, ord int, t0 long, t1 long, adults int, children int, action string"),
        empty("job_id string, t long, text string"),
        spark.createDataFrame([("m", 30_000)], "job_id string, duration long"),
    )


def test_signals_and_shortlist_of_the_mock_timeline(spark):
    signals = boundaries.story_signals(*mock(spark))
    assert sorted(rows_of(signals, "t", "reason")) == [(4900, "gap"), (10700, "gap"), (16500, "gap"), (22300, "gap"), (26800, "tail-silent")]
    short = boundaries.shortlist(boundaries.candidates(signals, "job_id"), "job_id", 800)
    assert rows_of(short, "t", "score") == [(26800, 3)]


def split(t0, t1, points, longest, least=2000):
    """The parts of one span, by the rule itself."""
    for usable in ([p for p in points if p[2]], points if t1 - t0 > longest else []):
        usable = [p for p in usable if t0 + least <= p[0] <= t1 - least]
        if usable:
            at = max(usable, key=lambda p: (p[2], p[1], -abs(2 * p[0] - t0 - t1), -p[0]))[0]
            return split(t0, at, points, longest) + split(at, t1, points, longest)
    n = (t1 - t0) // longest + 1 if t1 - t0 > longest else 1
    edges = [t0 + round((t1 - t0) * i / n) for i in range(n + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def test_splitting_level_by_level(spark):
    rng = random.Random(7)
    spans = [("j", 1, 0, 6500, [(3000, 2, True)]), ("j", 2, 10_000, 20_000, [(15_000, 1, False)]), ("k", 3, 0, 20_000, [(9000, 1, False)]), ("l", 4, 0, 30_000, []), ("m", 5, 0, 400_000, [(i * 1000, i % 3, True) for i in range(1, 400)])]
    spans += [(f"r{i}", i, t0 := rng.randint(0, 9000), t0 + rng.randint(1, 200_000), [(t, rng.randint(1, 4), rng.random() < 0.3) for t in rng.sample(range(210_000), rng.randint(0, 40))]) for i in range(10, 40)]
    events = spark.createDataFrame([(k, i, a, b, f"kept {i}") for k, i, a, b, _ in spans], "k string, id int, t0 long, t1 long, note string")
    points = spark.createDataFrame([(k, *p) for k, _, _, _, ps in spans for p in ps], "k string, t long, s int, hard boolean")
    got = rows_of(packing.pieces(events, points, "k", 14_375), "id", "part", "t0", "t1", "note")
    assert sorted(got) == sorted((i, n, x, y, f"kept {i}") for _, i, a, b, ps in spans for n, (x, y) in enumerate(split(a, b, [p for p in ps if a < p[0] < b], 14_375)))
    assert packing.pieces(events.where("false"), points, "k", 14_375).count() == 0


def test_splitting(spark):
    ev = spark.createDataFrame([("j", "a", "story", 0, 6500, True), ("j", "b", "story", 7000, 27_000, False), ("j", "c", "endcard", 30_000, 35_000, False)], "job_id string, id string, kind string, t0 long, t1 long, cast_reset boolean")
    cand = spark.createDataFrame([("j", 3000, ["cut"]), ("j", 16_000, ["gap"])], "job_id string, t long, reasons array<string>")
    got = rows_of(packing.pack(ev, cand), "n", "event_id", "t0", "t1", "frames", "padded", "cast_reset")
    assert got == [(1, "a", 0, 3000, 107, True, True), (2, "a", 3000, 6500, 107, True, False), (3, "b", 7000, 16_000, 209, False, False), (4, "b", 16_000, 27_000, 260, False, False)]


def test_interval_joins(spark):
    a = spark.createDataFrame([("j", 1, 0, 1000), ("j", 2, 900, 5000), ("k", 3, 0, 10)], "k string, id int, t0 long, t1 long")
    b = spark.createDataFrame([("j", 7, 950, 2000), ("j", 8, 1000, 4000)], "k string, id int, t0 long, t1 long")
    assert rows_of(intervals.overlapping(a, b, "k"), "l_id", "r_id") == [(1, 7), (2, 7), (2, 8)]
    assert rows_of(intervals.touching(a, b, "k"), "id") == [(1,), (2,)] and rows_of(intervals.touching(a, b, "k", anti=True), "id") == [(3,)]
    owned = intervals.owners(a.withColumnRenamed("id", "item"), b.withColumnRenamed("id", "span"), "k", "item", "span")
    assert rows_of(owned, "item", "owner") == [(1, None), (2, 8), (3, None)]
    p = spark.createDataFrame([("j", 1, 40), ("j", 2, 99)], "k string, n int, t long")
    m = spark.createDataFrame([("j", 40, "x"), ("j", 90, "y")], "k string, t long, v string")
    assert rows_of(intervals.as_of(p, m, "k", "v"), "n", "v") == [(1, "x"), (2, "y")]
    assert rows_of(intervals.nearest(p, m, "k", "n", 10), "n", "anchor") == [(1, 40), (2, 90)]


def test_events(spark):
    kinds = "job_id string, t0 long, t1 long, kind string, cast_reset boolean"
    ev = spark.createDataFrame([("j", 0, 5000, "story", False), ("j", 5000, 9000, "story", True), ("j", 9000, 20_000, "story", False)], kinds)
    snapped = events.snapped(ev, spark.createDataFrame([("j", 6000)], "job_id string, t long"), "job_id")
    assert rows_of(snapped, "t0", "t1") == [(0, 6000), (6000, 20_000)]
    speech = spark.createDataFrame([("j", 4000, 5500), ("j", 8000, 12_000)], "job_id string, t0 long, t1 long")
    none = spark.createDataFrame([], "job_id string, t long")
    assert rows_of(events.repaired(ev, speech, none, "job_id"), "t0", "t1") == [(0, 5500), (5500, 8000), (8000, 20_000)]
    assert rows_of(events.repaired(ev, speech, spark.createDataFrame([("j", 5100)], "job_id string, t long"), "job_id"), "t0", "t1") == [(0, 5000), (5000, 8000), (8000, 20_000)]
    tiny = spark.createDataFrame([("j", 0, 1000, "story", True), ("j", 1000, 4000, "story", False), ("j", 4000, 4500, "story", False), ("j", 4500, 5000, "endcard", False)], kinds)
    assert rows_of(events.merged(tiny, "job_id"), "t0", "t1", "kind", "cast_reset") == [(0, 4500, "story", True), (4500, 5000, "endcard", False)]
    split = events.force_split(ev, spark.createDataFrame([("j", 12_000), ("j", 19_000)], "job_id string, t long"), "job_id")
    assert rows_of(split, "t0", "t1") == [(0, 5000), (12_000, 20_000), (5000, 9000), (9000, 12_000)]
    cuts, said, windows, titles, ends = mock(spark)
    shown = spark.createDataFrame([("m", 1, 27_000, 30_000, 0, 0, "credits roll")], windows.schema)
    proposed = spark.createDataFrame([("m", 0, 26_000, "story", False), ("m", 26_000, 30_000, "story", False)], kinds)
    short = spark.createDataFrame([("m", 26_800, ["tail-silent"], 3)], "job_id string, t long, reasons array<string>, score int")
    final = events.finalised(proposed, short.select("job_id", "t"), short, none, said, shown, titles.selectExpr("job_id", "t AS t0", "t AS t1", "text", "'title' AS region"), ends)
    assert rows_of(final, "id", "t0", "t1", "kind") == [("e01", 0, 26_800, "story"), ("e02", 26_800, 30_000, "endcard")]
    shots = spark.createDataFrame([("j", 0, 100), ("j", 100, 900), ("j", 900, 1000), ("j", 1000, 1100)], "job_id string, t0 long, t1 long")
    assert rows_of(events.merged_shots(shots, "job_id"), "id", "t0", "t1") == [("shot_001", 0, 100), ("shot_002", 100, 1100)]


def test_dialogue(spark):
    captions = spark.createDataFrame([("j", 1, 1000, 2000, "你好世界")], "job_id string, ord int, t0 long, t1 long, text string")
    words = spark.createDataFrame([("j", 1, 900, 1300, "你好"), ("j", 2, 1300, 1900, "世界"), ("j", 3, 1950, 2600, "外")], "job_id string, ord int, t0 long, t1 long, word string")
    assert rows_of(dialogue.caption_words(captions, words, "job_id"), "t0", "t1", "said") == [(900, 1900, "你好世界")]
    segments = spark.createDataFrame([("j", 1500, 2500, "一二三四五六七"), ("j", 3000, 4000, "甲乙丙丁戊己庚"), ("j", 4100, 5000, "子丑寅卯辰巳午")], "job_id string, t0 long, t1 long, text string")
    ends = spark.createDataFrame([("j", 60_000)], "job_id string, duration long")
    extra = dialogue.extra_lines(segments, captions, ends, "job_id")
    assert rows_of(extra, "t0") == [(3000,)]  # the third lies too near to the second, which was taken
    assert dialogue.reconciled(captions, words, segments, ends, "job_id").count() == 2
    cases = spark.createDataFrame([("你好世界", "你好世界", "ocr"), ("你好世界", "", "ocr"), ("", "你好世界", "ocr"), ("", "", "ocr"), ("你好世界", "你好中国", "ocr"), ("", "", "asr")], "o string, a string, s string")
    assert [r[0] for r in cases.select(dialogue.decision(F.col("o"), F.col("a"), F.col("s"))).collect()] == ["keep", "keep", "use-asr", "drop", "judge", "keep"]
    long = [(i * 1000, i * 1000 + 1000, "w." if i == 4 else "w") for i in range(10)]
    seg = spark.createDataFrame([("j", 1, 0, 10_000, long), ("j", 2, 11_000, 12_000, [(11_000, 12_000, "x")])], "job_id string, id int, t0 long, t1 long, words array<struct<t0:long,t1:long,word:string>>")
    assert rows_of(dialogue.split_segments(seg, "job_id"), "id", "t0", "t1") == [(1, 0, 5000), (2, 5000, 10_000), (3, 11_000, 12_000)]


def test_retiming_and_delivery(spark):
    spans = spark.createDataFrame([("j", 1, 0, 5800, 0), ("j", 2, 5800, 11_600, 5800)], "k string, ord int, src0 long, src1 long, cat0 long")
    pts = spark.createDataFrame([("j", 1, 5800), ("j", 2, 6600), ("j", 3, 99_000)], "k string, n int, t long")
    assert rows_of(retime.mapped(pts, spans, "k"), "n", "at") == [(1, 5800), (2, 6600), (3, None)]
    subs = spark.createDataFrame([("j", 1, "bottom", 1000, 2000, "a", 0, 9000), ("j", 2, "title", 1000, 2000, "t", 0, 9000), ("j", 3, "bottom", 6000, 7000, "b", 0, 9000)], "k string, ord long, style string, t0 long, t1 long, text string, span0 long, span1 long")
    islands = spark.createDataFrame([("j", 1500, 2300), ("j", 6100, 6900)], "k string, t0 long, t1 long")
    assert rows_of(delivery.aligned_subtitles(subs, islands, "k"), "ord", "t0", "t1") == [(1, 1420, 2420), (2, 1000, 2000), (3, 6020, 7020)]
    files = spark.createDataFrame([("m", 1, 6), ("m", 2, 5), ("m", 3, 4)], "k string, ord int, size long")
    assert rows_of(delivery.fitting(files, "k", 10), "ord", "fits") == [(1, True), (2, False), (3, True)]


def test_lookback_merges_against_the_rule_itself(spark):
    rng = random.Random(3)
    rows, want = [], []
    for k in ("a", "b", "c", None):
        t, kept = 0, []
        for n in range(rng.randint(30, 80)):
            t += rng.choice([0, 250, 500, 1400, 1600])
            text = rng.choice(["x", "y", "z", None, ""])
            rows.append((k, n, t, text))
            same = next((r for r in reversed(kept[-2:]) if text is not None and r[2] == text and t - r[1] <= 1500), None)
            if same:
                same[1] = t
            else:
                kept.append([t, t, text])
        want += [(k, *r) for r in kept]
    got = sequences.lookback_merge(spark.createDataFrame(rows, "k string, ord long, t long, text string").repartition(3), "k")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_subtitles_against_the_rule_itself(spark):
    rng = random.Random(12)

    def plain(lines, islands, radius=1500):
        free, out, before = sorted(islands), [], None
        for n, style, t0, t1, text, s0, s1 in sorted(lines):
            moved = False
            if style == "bottom" and t1 - t0 > 50 and free:
                apart = lambda x: abs(x[0] + x[1] - t0 - t1)  # noqa: B023, E731
                near = [x for x in free if apart(x) < 2 * radius] or [x for x in free if s0 is not None and x[0] >= s0 - 300 and x[1] <= s1 + 300]
                if near:
                    best = min(near, key=apart)
                    free.remove(best)
                    if before is None or max(0, best[0] - 80) >= before - 10:
                        t0, t1, moved = max(0, best[0] - 80), best[1] + 120, True
            out.append((n, t0, t1, moved))
            before = t1
        return out

    lines, islands, want = [], [], []
    for k in ("a", "b", "c", "d", "e", None):
        mine = [(n, rng.choice(["bottom", "bottom", "title"]), t := rng.randint(0, 60_000), t + rng.choice([20, 800, 3000]), f"x{n}", *rng.choice([(None, None), (t - 9000, t + 9000)])) for n in range(rng.randint(0, 25))]
        theirs = sorted({(t := rng.randint(0, 60_000), t + rng.randint(100, 2000)) for _ in range(rng.randint(0, 25))}) if k else []
        lines += [(k, *x) for x in mine]
        islands += [(k, *x) for x in theirs]
        want += [(k, *x) for x in plain(mine, theirs)]
    subs = spark.createDataFrame(lines, "k string, ord long, style string, t0 long, t1 long, text string, span0 long, span1 long")
    got = delivery.aligned_subtitles(subs, spark.createDataFrame(islands, "k string, t0 long, t1 long"), "k")
    assert sorted(((r["k"], r["ord"], r["t0"], r["t1"], r["moved"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_audit(spark):
    prompts = spark.createDataFrame([("c", "x <d>[Chinese] 你好，世界</d> (S1) (S2) 字")], "clip string, text string")
    allowed = spark.createDataFrame([("c", "你好， 世界")], "clip string, line string")
    assert audit.unknown_dialogue(prompts, allowed, "clip", "text", "line").count() == 0
    assert audit.uncovered_speech(prompts, spark.createDataFrame([("c", "你好"), ("c", "再见了")], "clip string, line string"), "clip", "text", "line").select("line").collect()[0][0] == "再见了"
    r = prompts.select(audit.stray_han(F.col("text")).alias("h"), audit.undefined_speakers(F.col("text"), F.array(F.lit("S1"))).alias("u"), audit.burned_text(F.lit("a logo appears")).alias("b"), audit.burned_text(F.lit("no logo appears")).alias("n")).first()
    assert (r["h"], r["u"], r["b"] != "", r["n"]) == (1, ["S2"], True, "")
    beats = spark.createDataFrame([("c", 0, 2000, 5000), ("c", 2000, 4000, 5000)], "clip string, t0 long, t1 long, d long")
    assert rows_of(audit.untiled(beats, "clip", "d"), "where", "from", "to") == [("tail", 4000, 5000)]


def test_jobs_and_views(spark):
    done = {n: ("done", None, None, None) for n in jobs.PREPARATION}
    kinds = "job_id string, state string, stages map<string,struct<status:string,error:string,started_at:timestamp,finished_at:timestamp>>, dirty boolean, running boolean, drafts_ready boolean, finals_ready boolean, last_quality string"
    rows = [
        ("waiting", "paused", {"download": ("done", None, None, None), "pagemeta": ("skipped", None, None, None), "understand": ("waiting", None, None, None)}, False, False, False, False, None),
        ("script", "paused", done, False, False, False, False, None),
        ("review", "paused", {**done, "generate": ("done", None, None, None)}, False, False, True, False, None),
        ("failed", "failed", done, False, False, False, False, None),
        ("complete", "done", {**done, "finish": ("done", None, None, None)}, False, False, True, True, None),
        ("edited", "done", done, True, False, True, True, None),
    ]
    frame = spark.createDataFrame(rows, kinds)
    assert dict(rows_of(frame.select("job_id", jobs.next_action().alias("n")), "job_id", "n")) == {"waiting": "understand", "script": "draft", "review": "final", "failed": "retry", "complete": "done", "edited": "redraft"}
    assert dict(rows_of(frame.select("job_id", jobs.shown_stage().alias("n")), "job_id", "n")) == {"waiting": "understand", "script": "draft", "review": "draft", "failed": "draft", "complete": "finish", "edited": "clips"}
    log = spark.createDataFrame([("j", 1, "download", "running", None), ("j", 2, "download", "done", None), ("j", 3, "script", "failed", "x")], "job_id string, at long, stage string, status string, error string")
    assert rows_of(jobs.transitions(log), "state", "stage", "updated_at") == [("failed", "script", 3)]
    manifest = spark.createDataFrame([("a", "p1", 5), ("a", "p2", None), ("b", "p3", 7)], "k string, path string, size long")
    files = spark.createDataFrame([("p1", 5), ("p2", 2_000_000), ("p3", 7), ("p3.part", 1)], "path string, size long")
    assert rows_of(jobs.complete_sets(manifest, files, "k"), "k", "ready") == [("a", True), ("b", False)]
    clips = spark.createDataFrame([("j", "c1"), ("j", "c2")], "job_id string, clip_id string")
    progress = spark.createDataFrame([("j", "c1", "draft", "done", "f", "bad"), ("j", "c2", "draft", "running", "", None)], "job_id string, clip_id string, quality string, status string, file string, prompt_hash string")
    prompts = spark.createDataFrame([("j", "c1", "text")], "job_id string, clip_id string, prompt string")
    assert rows_of(views.clip_status(clips, progress, prompts), "clip_id", "status", "dirty") == [("c1", "done", True), ("c2", "running", False)]


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src int, dst int")
    assert graph.closure(edges).count() == 9
    nodes = spark.createDataFrame([(1, "Load"), (2, "Reroute"), (3, "Reroute"), (4, "Save")], "id int, type string")
    links = spark.createDataFrame([(1, 0, 2, 0), (2, 0, 3, 0), (3, 0, 4, 5)], "src int, src_slot int, dst int, dst_slot int")
    assert (4, 5, 1, 0) in rows_of(graph.origins(nodes, links), "dst", "dst_slot", "src", "src_slot")


def test_subgraphs_and_executable_nodes(spark):
    nodes = spark.createDataFrame([("1", "Load"), ("2", "Sub"), ("3", "Save")], "id string, type string")
    links = spark.createDataFrame([("1", 0, "2", 0), ("2", 0, "3", 1)], "src string, src_slot int, dst string, dst_slot int")
    inner_nodes = spark.createDataFrame([("Sub", 7, "Blur"), ("Sub", 8, "Deep"), ("Deep", 9, "Sharpen")], "sub string, id int, type string")
    inner_links = spark.createDataFrame([("Sub", -10, 0, 7, 2), ("Sub", 7, 0, 8, 0), ("Sub", 8, 0, -20, 0), ("Deep", -10, 0, 9, 5), ("Deep", 9, 1, -20, 0)], "sub string, src int, src_slot int, dst int, dst_slot int")
    n, e = graph.expanded(nodes, links, inner_nodes, inner_links)
    assert rows_of(n, "id") == [("1",), ("2/7",), ("2/8/9",), ("3",)]
    assert rows_of(e, "src", "src_slot", "dst", "dst_slot") == [("1", 0, "2/7", 2), ("2/7", 0, "2/8/9", 5), ("2/8/9", 1, "3", 1)]
    circle = spark.createDataFrame([("A", 1, "B"), ("B", 2, "A"), ("C", 3, "A"), ("D", 4, "Blur"), ("D", 5, "D2"), ("D2", 6, "Save")], "sub string, id int, type string")
    flat, _, held = graph.flat_definitions(circle, inner_links)
    assert rows_of(held, "sub") == [("A",), ("B",), ("C",)] and rows_of(flat, "sub", "id") == [("D", "4"), ("D", "5/6"), ("D2", "6")]
    n, e = graph.expanded(spark.createDataFrame([("1", "A"), ("2", "D")], "id string, type string"), links, circle, inner_links.where("false"))
    assert rows_of(n, "id", "type") == [("1", "A"), ("2/4", "Blur"), ("2/5/6", "Save")]
    runs, direct = graph.executable(spark.createDataFrame([("1", "Load", 0), ("2", "Reroute", 0), ("3", "Save", 0), ("4", "Note", 0), ("5", "Save", 4)], "id string, type string, mode int"), links)
    assert rows_of(runs, "id") == [("1",), ("3",)] and rows_of(direct, "src", "dst") == [("1", "3")]


def test_beats_and_prompts(spark):
    from timeloom.operators import beats, prompts

    raw = '```json\n{"action": "walks；sits", "adults": 2, "children": null, "cells": []}\n```'
    got = spark.range(1).select(beats.parsed(F.lit(raw)).alias("b")).first()["b"]
    assert (got["action"], got["adults"], got["children"], [c["see"] for c in got["cells"]]) == ("walks；sits", 2, None, ["walks", "sits"])
    kinds = "k string, ord int, t0 long, t1 long, adults int, children int, has_text boolean, error string, raw string, cells array<struct<t:double,see:string>>"
    windows = spark.createDataFrame([("j", 1, 0, 3000, 1, 0, False, None, "x", [(0.0, "a"), (0.25, "b")]), ("j", 2, 2500, 5500, 2, 0, True, None, "x", [(2.5, "c")]), ("j", 3, 5000, 8000, 2, 0, False, "boom", "", [])], kinds)
    cuts = spark.createDataFrame([("j", 3000)], "k string, t long")
    speech = spark.createDataFrame([("j", 0, 1000), ("j", 1500, 2000)], "k string, t0 long, t1 long")
    texts = spark.createDataFrame([("j", 1, 100, 400, "hi"), ("j", 2, 100, 400, "hi"), ("j", 3, 200, 400, "you")], "k string, ord int, t0 long, t1 long, text string")
    flagged = beats.flags(windows, cuts, speech, texts, "k")
    assert dict(rows_of(flagged, "ord", "flags")) == {1: ["speech", "text"], 2: ["cut", "people", "text"], 3: ["error"]}
    ends = spark.createDataFrame([("j", 8000)], "k string, duration long")
    tick = {r["t"]: (r["see"], r["read"], r["adults"]) for r in beats.ticks(ends, windows, texts, "k").collect()}
    assert len(tick) == 32 and tick[0] == ("a", "", 1) and tick[250] == ("b", "hi / you", 1) and tick[2500][2] == 1 and tick[3000][2] == 2
    assert rows_of(beats.complete(windows, ends, "k"), "complete") == [(False,)] and rows_of(beats.complete(windows.where("ord < 3"), spark.createDataFrame([("j", 6000)], "k string, duration long"), "k"), "complete") == [(True,)]
    assert rows_of(beats.summary(windows, "k"), "total", "failed", "rate") == [(3, 1, 0.6667)]
    said = spark.range(1).select(prompts.speakers_of(F.lit("(S1) says <d>[Chinese] a</d> and <d>b</d> then (S2) <d>c</d>")).alias("s")).first()["s"]
    assert [(x["speaker"], x["line"]) for x in said] == [("S1", "a"), ("S1", "b"), ("S2", "c")]
    parts = spark.range(1).select(prompts.sections(F.lit("# A\none\n# B\n(none)\n## C\n- x\n2. y")).alias("s")).first()["s"]
    assert parts == {"A": "one", "B": "", "C": "- x\n2. y"} and spark.range(1).select(prompts.bullets(F.lit(parts["C"])).alias("b")).first()["b"] == ["x", "y"]
    base = spark.createDataFrame([("c", 1, 0.0, "old"), ("c", 2, 2.0, "two")], "clip string, index int, at double, text string")
    patch = spark.createDataFrame([("c", 1, None, "new"), ("c", 3, 4.0, "x")], "clip string, index int, at double, text string")
    assert rows_of(prompts.merged_shots(base, patch, ["clip"]), "index", "at", "text") == [(1, 0.0, "new"), (3, 4.0, "x")]
    shots = F.array(F.struct(F.lit(2).alias("index"), F.lit(1.5).alias("at"), F.lit("then").alias("text")), F.struct(F.lit(1).alias("index"), F.lit(0.0).alias("at"), F.lit("first").alias("text")))
    speakers = F.array(F.struct(F.lit("S1").alias("id"), F.lit("tall").alias("lock"), F.lit("low").alias("voice")))
    text = spark.range(1).select(prompts.assembled(F.lit("film"), F.lit(""), speakers, shots, F.lit("wind"), F.lit(None).cast("string")).alias("t")).first()["t"]
    assert text == "Style: film\n(S1) tall Voice: low\n[00:00.000] first\n[00:01.500] then\nOverall soundscape: wind\nNon-diegetic music: N/A"


def test_one_dense_island_is_folded_as_it_streams(spark):
    n = 200_000
    dense = spark.range(n).select(F.lit("a").alias("job_id"), (F.col("id") * 5).alias("t"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    kept = sequences.thinned(dense, "job_id", 10)
    assert "collect_list" not in plan(kept)
    assert kept.agg(F.count("*"), F.min("t"), F.max("t"), F.sum((F.col("t") % 10).cast("int"))).first()[:] == (n // 2, 0, 5 * n - 10, 0)
    got = sequences.anchored_clusters(dense, "job_id", 12).groupBy("anchor").count()
    assert got.agg(F.count("*"), F.max("count")).first()[:] == (-(-n // 3), 3)
    hits = dense.limit(3000).select("job_id", F.lit("top").alias("region"), (F.col("t") * 20).alias("t"), F.lit("same words").alias("text"))
    sessions = sequences.fuzzy_sessions(hits, ["job_id", "region"], 500)
    assert "FlatMapGroupsInPandas" not in plan(sessions)
    assert rows_of(sessions, "t0", "t1", "text", "n") == [(0, 2999 * 100 + 500, "same words", 3000)]


def test_greedy_match_needs_shared_time_and_keeps_speech_without_a_match(spark):
    from timeloom.functions import text as tx

    kinds = "job_id string, id long, t0 long, t1 long, text string"
    speech = [("j", 1, 0, 1000, "we leave tonight"), ("j", 2, 900, 2000, "we leave tonight!"), ("j", 3, 2000, 3000, "nothing like it"), ("j", 4, 9000, 9500, "we leave tonight"), ("j", 5, 0, 500, " "), ("k", 1, 0, 1000, "we leave tonight")]
    # 7 has another longest word than what is said; 9 shares 119 ms with speech 3
    seen = [("j", 7, 500, 1500, "we leave tonlght"), ("j", 8, 0, 1500, "we leave tonight"), ("j", 9, 2881, 8000, "nothing like it")]
    got = sequences.greedy_match(spark.createDataFrame(speech, kinds), spark.createDataFrame(seen, kinds), "job_id", tx.similarity)
    assert [r[:-1] for r in rows_of(got, "job_id", "id", "match", "seen", "score")] == [("j", 1, 8, "we leave tonight"), ("j", 2, 7, "we leave tonlght"), ("j", 3, None, None), ("j", 4, None, None), ("k", 1, None, None)]
    assert {r["id"]: r["score"] for r in got.where("job_id = 'j'").collect()}[3] == 0.0


def test_long_chains_are_followed_to_their_end(spark):
    n = 20
    got = graph.closure(spark.createDataFrame([(i, i + 1) for i in range(n)], "src int, dst int"))
    assert got.count() == n * (n + 1) // 2 and got.where(f"src = 0 and dst = {n}").first()["depth"] == n
    m = 70
    nodes = spark.createDataFrame([(0, "Load"), *((i, "Reroute") for i in range(1, m + 1)), (m + 1, "Save")], "id int, type string")
    links = spark.createDataFrame([(i, i % 3, i + 1, 0) for i in range(m + 1)], "src int, src_slot int, dst int, dst_slot int")
    assert {(r["src"], r["src_slot"]) for r in graph.origins(nodes, links).collect()} == {(0, 0)}
    ring = spark.createDataFrame([(1, 0, 2, 0), (2, 0, 3, 0), (3, 0, 1, 0)], "src int, src_slot int, dst int, dst_slot int")
    assert graph.origins(spark.createDataFrame([(i, "Reroute") for i in (1, 2, 3)], "id int, type string"), ring).count() == 3


def test_gapless_spans_with_the_same_times_are_ordered_by_ties(spark):
    spans = [("a", i, t, t + 5, 99) for t in (1, 10, 20) for i in (3, 1, 2)]
    for order in (spans, spans[::-1]):
        got = sequences.gapless(spark.createDataFrame(order, "k string, id int, t0 int, t1 int, z int"), "k", "z", "id").select("id", "t0", "t1")
        assert sorted(map(tuple, got.collect())) == [(1, 0, 1), (3, 1, 10), (3, 10, 20), (3, 20, 99)]


def test_cast_changes_number_equal_events_in_one_order(spark):
    from timeloom.operators import events

    marks = spark.createDataFrame([("a", 90, ["people"])], "k string, t long, reasons array<string>")
    for order in ((True, False), (False, True)):
        e = spark.createDataFrame([("a", 9000, 9900, "story", c) for c in order], "k string, t0 long, t1 long, kind string, cast_reset boolean").coalesce(1)
        assert sorted(r["cast_reset"] for r in events.cast_changes(e, marks, "k").collect()) == [False, True]
