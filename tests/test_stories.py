"""Hand-worked cases of the operators for clips, prompts, views, transcripts and graphs."""

import pytest
from pyspark.sql import functions as F

from timeloom.functions import signal
from timeloom.functions import text as tx
from timeloom.operators import audit, boundaries, clips, graph, intervals, metadata, prompts, screen


def rows(df, *columns):
    columns = columns or df.columns
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def one(spark, column, ddl="a int", row=(1,)):
    return spark.createDataFrame([row], ddl).select(column.alias("x")).first()["x"]


def lit(value):
    return F.lit(value)


# Rules


def test_burned_text_is_what_is_drawn_and_not_what_is_denied(spark):
    cases = {"a logo appears": "logo appears", "no logo appears": "", "never titles fade": "", "four large Chinese characters glow": "large Chinese characters", "her words show hesitation": "", "the character appears": "", "NEON hanzi": "", "Neon kanji glyph": "Neon kanji glyph", "no kanji text": "kanji text", "not two hanzi words": "hanzi words", "a logo, appears": "", "": "", "cannot\nTitles  Burn": "Titles  Burn"}
    got = {t: one(spark, audit.burned_text(lit(t))) for t in cases}
    assert got == cases


def test_burned_text_takes_time_in_proportion(spark):
    import time

    text = "quiet words of a hall, " * 400 + "No logo appears; two hanzi  Words"
    began = time.time()
    assert one(spark, audit.burned_text(F.concat(lit(text), F.lit("")))) == "two hanzi  Words"
    assert time.time() - began < 15  # each word had all words split anew, several times over


def test_joint_speakers_and_header(spark):
    text = "(S1) and (S2,S3) talk (S1) (S4x)"
    assert one(spark, audit.speaker_marks(lit(text))) == ["S1", "S2", "S3"]
    assert one(spark, audit.undefined_speakers(lit(text), F.array(lit("S1")))) == ["S2", "S3"]
    assert one(spark, audit.header_off(lit("aligns with the 4.46-second mark"), lit(4.458))) is False
    assert one(spark, audit.header_off(lit("aligns with the 4.50-second mark"), lit(4.458))) is True
    assert one(spark, audit.header_off(lit("aligns with the 4-second mark"), lit(9.0))) is False
    got = one(spark, prompts.speakers_of(lit("(S2,S1)'s hand <d>[Chinese] a</d> and <d>[Chinese] b</d> then (S1) <d>[Chinese] c</d>")))
    assert [(x["speaker"], x["line"]) for x in got] == [("S2", "a"), ("S2", "b"), ("S1", "c")]


def test_shot_stamps_of_the_worked_example(spark):
    shots = spark.createDataFrame([("c", 1, None, 5000), ("c", 2, 150, 5000), ("c", 3, 3000, 5000), ("d", 1, 0, 5000), ("d", 2, None, 5000), ("d", 3, 5000, 5000), ("e", 1, None, 5000)], "k string, i int, at int, d int")
    assert rows(audit.shot_stamps(shots, "k", "i", "d")) == [("c", 2, "short"), ("d", 1, "stamped"), ("d", 2, "unstamped"), ("d", 3, "late"), ("d", 3, "tail")]


def test_dialogue_past_the_trim_line(spark):
    text = "From 0.00 to 2.00s one <d>[Chinese] in time</d> From 2 to 4.4 <d>[Chinese] cut</d> <d>[Chinese] too</d> <d>[Chinese] third</d>"
    p = spark.createDataFrame([("a", text, 4.5, 3.0), ("b", text, 4.5, 4.48), ("c", text, 4.5, None), ("d", "<d>[Chinese] x</d>", 4.5, 1.0)], "k string, t string, seconds double, source double")
    assert rows(audit.late_dialogue(p, "k", "t", "seconds", "source")) == [("a", "cut", 4.4), ("a", "too", 4.4)]


def test_all_rules_of_a_whole_prompt(spark):
    good = "Identity lock: a. Scene lock: b. Voice lock: c. (S1) From 0.00 to 5.00 speaks <d>[Chinese] 你好吗</d>"
    bad = "emotional From 1.00 to 3.00 (S9) <d>[calm] 别的话</d> 好 caption a title appears"
    p = spark.createDataFrame([("g", good, 5.0, 5.0, ["S1"], "film", "wind", "N/A"), ("b", bad, 5.0, 2.0, ["S1"], " ", "", "piano")], "clip_id string, text string, seconds double, source_seconds double, speakers array<string>, style string, sound string, music string")
    shots = spark.createDataFrame([("g", 1, None, 5000), ("g", 2, 2000, 5000)], "clip_id string, index int, at int, duration int")
    allowed = spark.createDataFrame([("g", "你好吗"), ("b", "你好吗")], "clip_id string, line string")
    got = rows(prompts.checked(p, shots, allowed, audit.BANNED), "clip_id", "rule", "detail")
    assert [r for r in got if r[0] == "g"] == []
    assert {r[1:] for r in got} == {
        ("shot:none", ""), ("beat:head", "0-1000"), ("beat:tail", "3000-5000"), ("dialogue:late", "别的话"), ("dialogue:tag", "[calm]"), ("dialogue:unknown", "别的话"), ("dialogue:uncovered", "你好吗"), ("han", "好"),
        ("speaker", "S9"), ("banned", "caption"), ("burned", "title appears"), ("thin", "identity lock"), ("thin", "scene lock"), ("thin", "voice lock"), ("thin", "emotional"), ("empty", "style"), ("empty", "sound"), ("music", "piano"),
    }


def test_unmatched_prompts_and_end_cards(spark):
    a, b = (spark.createDataFrame(r, "job_id int, clip_id string") for r in ([(1, "a"), (1, "b")], [(1, "b"), (1, "c")]))
    assert rows(prompts.unmatched(a, b, ["job_id", "clip_id"]), "clip_id", "side") == [("a", "no prompt"), ("c", "no clip")]
    events = spark.createDataFrame([(1, "story"), (1, "endcard"), (2, "story")], "job_id int, kind string")
    assert rows(prompts.end_cards(events, "job_id")) == [(1, 1), (2, 0)]
    assert rows(audit.over_length(spark.createDataFrame([(1, 14.375), (2, 14.4)], "id int, s double"), "s", 14.375), "id") == [(2,)]


# Clips


def test_touching_and_holding_agree_with_their_definitions(spark):
    left = [("a", i, t, t + d) for i, (t, d) in enumerate([(0, 10), (10, 5), (15, 0), (30, 10), (50, 1)])] + [("b", 9, 0, 100)]
    right = [("a", 8, 12), ("a", 40, 45), ("a", 0, 3), ("a", 49, 60)]
    want = {i for k, i, a0, a1 in left for k2, b0, b1 in right if k == k2 and a0 < a1 and a0 < b1 and b0 < a1}
    lf, rf = spark.createDataFrame(left, "k string, i int, t0 int, t1 int"), spark.createDataFrame(right, "k string, t0 int, t1 int")
    assert {r["i"] for r in intervals.touching(lf, rf, "k").collect()} == want
    assert {r["i"] for r in intervals.touching(lf, rf, "k", anti=True).collect()} == {i for _, i, *_ in left} - want
    points = spark.createDataFrame([("a", 41), ("a", 100), ("b", 40), ("b", 60)], "k string, t int")
    spans = spark.createDataFrame([("a", 1, 0, 80), ("a", 2, 0, 82), ("a", 3, 1, 200), ("b", 4, 0, 100)], "k string, i int, t0 int, t1 int")
    assert {r["i"] for r in intervals.holding_point(spans, points, "k").collect()} == {2, 3}


def test_windows_of_three_tiers(spark):
    c = spark.createDataFrame([("j", "x", 10_000, 14_000)], "job_id string, clip string, t0 long, t1 long")
    tiers = lambda ws: rows(intervals.tiered(c, spark.createDataFrame(ws, "job_id string, w int, t0 long, t1 long"), "job_id", "clip", "w"), "w", "tier")
    # another part: begins before the clip, or late and ends after it
    assert tiers([("j", 1, 9_000, 12_000), ("j", 2, 10_000, 13_000), ("j", 3, 12_500, 15_500)]) == [(2, 1)]
    assert tiers([("j", 1, 9_000, 12_000), ("j", 4, 10_100, 10_500)]) == [(4, 2)]
    assert tiers([("j", 1, 9_000, 12_000), ("j", 3, 12_500, 15_500)]) == [(1, 3)]
    assert tiers([("j", 5, 9_000, 10_010)]) == []


def test_facts_of_clips(spark):
    c = spark.createDataFrame([(1, "a", 0, 0, 6000, 6000, True, False), (1, "b", 1, 6000, 12_000, 5000, False, False), (1, "c", 2, 12_000, 18_000, 6000, True, True)], "job_id int, clip string, n int, t0 long, t1 long, h3 long, padded boolean, cast_reset boolean")
    w = spark.createDataFrame([(1, 0, 0, 3000, 2, None, "walks"), (1, 1, 3000, 6000, 3, 1, None), (1, 2, 7000, 9000, None, None, "sits")], "job_id int, window int, t0 long, t1 long, adults int, children int, action string")
    s = spark.createDataFrame([(1, 0, 500, 1500, " hello "), (1, 1, 5500, 8500, "second"), (1, 2, 13_000, 14_000, "")], "job_id int, line int, t0 long, t1 long, text string")
    cuts = spark.createDataFrame([(1, 2000), (1, 2500), (1, 5990), (1, 9000)], "job_id int, t long")
    got = {r["clip"]: r for r in clips.facts(c, w, s, cuts, "job_id").collect()}
    assert got["a"]["actions"] == ["0.00-3.00s walks"] and (got["a"]["adults"], got["a"]["children"]) == (3, 1) and got["a"]["cuts"] == [2000]
    assert [(x["a"], x["b"], x["text"]) for x in got["a"]["speech"]] == [(500, 1500, "hello")]
    assert [x["text"] for x in got["b"]["speech"]] == ["second"] and got["b"]["adults"] is None and got["b"]["cuts"] == [2500]
    assert (got["b"]["before"], got["b"]["lines_before"], got["b"]["thread"]) == ("a", ["hello"], "a") and got["c"]["speech"] is None and got["c"]["thread"] is None
    texts = spark.createDataFrame([(1, "a", "(S1) <d>[Chinese] hello</d>"), (1, "b", "nothing said")], "job_id int, clip string, prompt string")
    near = clips.neighbours(c, clips.texts_of(clips.speech_of(c, s, "job_id"), "job_id"), "job_id")
    assert [(r["clip"], r["thread"], [(t["speaker"], t["line"]) for t in r["turns"]]) for r in clips.threads(near, texts, "job_id").collect()] == [("b", "a", [("S1", "hello")])]


def test_transcripts(spark):
    word = lambda w, a, b: (w, a, b)
    ddl = "array<struct<word:string,start:long,end:long>>"
    segs = spark.createDataFrame([(1, 1, "b", None, [word("b", 5, 9)]), (1, 0, "x", "a", [word("a", 0, 4)]), (2, 0, None, "", None)], f"k int, ord int, text string, text_asr string, words {ddl}")
    got = {r["k"]: (r["text"], [x["word"] for x in r["words"]]) for r in clips.normalised_transcript(segs, "k").collect()}
    assert got == {1: ("ab", ["a", "b"]), 2: ("", [])}
    whole = spark.createDataFrame([(1, " ab ", 90, [word("a", 3, 4), word("b", 5, 9)]), (2, "t", 90, []), (3, " ", 90, [])], f"k int, text string, duration long, words {ddl}")
    assert rows(clips.fallback_segments(whole, "k")) == [(1, 3, 9, "ab"), (2, 0, 90, "t")]
    assert [one(spark, clips.speech_source(lit(a), lit(b))) for a, b in [("asr-extra", "x"), ("other", "x"), (None, None)]] == ["asr-extra", "ocr", "asr"]
    assert rows(clips.needs_judge(spark.createDataFrame([(1, "keep"), (1, "judge"), (2, None)], "k int, decision string"), "k")) == [(1, True), (2, False)]
    assert rows(clips.source_counts(spark.createDataFrame([(1, "ocr"), (1, "asr-extra"), (1, "asr")], "k int, source string"), "k")) == [(1, 1, 1)]


def test_texts_made_of_rows(spark):
    w = spark.createDataFrame([(1, 1, 3000, 6000, 2, None, True, ["cut"], None, "a\nb"), (1, 0, 0, 3000, None, 1, None, [], "late", None)], "k int, ord int, t0 long, t1 long, adults int, children int, has_text boolean, flags array<string>, error string, action string")
    assert clips.beat_lines(w, "k").first()["text"] == "0.00-3.00s  ? adults 1 children  text=false  open=none ERR=late  \n3.00-6.00s  2 adults ? children  text=true  open=cut  a b"
    assert one(spark, clips.call_statistics(lit("m"), lit(3), lit(4), lit(1500), F.array(lit("t")))) == "m, in 3 out 4, 1.5s, back[t]"
    assert one(spark, clips.call_statistics(lit(None).cast("string"), lit(0), lit(None).cast("int"), lit(0), lit(None).cast("array<string>"))) == "no statistics"
    text = one(spark, prompts.editor_text(lit("c1"), lit("0-5"), lit(5.0), {"Scene": lit("hall"), "Note": lit("")}, F.array(F.struct(lit("S1").alias("id"), lit("old").alias("note"))), F.array(lit("x"), lit("y"))))
    assert text == "c1\nsource 0-5 | clip 5.00s\n\n## Beats\n- x\n- y\n\n## Scene\nhall\n\n## Note\n(nothing)\n\n## People\n- (S1) old"
    review = one(spark, prompts.review_text(lit("c1"), {"Speech": F.array(lit("a")), "Cuts": F.array().cast("array<string>")}, lit(" p ")))
    assert review == "# c1\n\n## Speech\n\n- a\n\n## Cuts\n\n- (none)\n\n## Prompt\n\n```text\np\n```\n"


def test_stills_and_vocabulary(spark):
    c = spark.createDataFrame([(1, "a", 0, 100), (1, "b", 100, 200)], "k int, clip string, t0 long, t1 long")
    f = spark.createDataFrame([(1, t) for t in (0, 10, 20, 30, 40)], "k int, t long")
    assert {r["clip"]: r["times"] for r in clips.still_times(c, f, "k", 3).collect()} == {"a": [0, 20, 40], "b": [100, 150, 200]}


def test_titles_that_jitter_are_no_change(spark):
    t = spark.createDataFrame([(1, 0, "the first title of it"), (1, 10, "the first titIe of it"), (1, 20, "quite another"), (1, 20, "the first title of it"), (1, 30, "no likeness here")], "k int, t long, text string")
    assert rows(boundaries.title_changes(t, "k")) == [(1, 30)]


# Views


def test_media_and_readiness(spark):
    j = spark.createDataFrame([(1, None, "p", "done"), (2, "v.mp4", "p", "running"), (3, None, "p", None)], "job_id int, video string, path string, finish string")
    f = spark.createDataFrame([(1, x) for x in ("source/video.mp4", "output/p/final.mp4", "output/p/cover.jpg")] + [(2, "v.mp4"), (2, "output/p/final.mp4"), (2, "output/p/draft.mp4"), (2, "cover.jpg")], "job_id int, file string")
    assert rows(screen.media(j, f)) == [(1, "source/video.mp4", None, "output/p/final.mp4", "output/p/cover.jpg", None), (2, "v.mp4", "output/p/draft.mp4", None, None, None), (3, None, None, None, None, None)]
    c = spark.createDataFrame([(1, "a", 4000), (1, "b", None), (2, "c", 4000), (3, "d", 4000)], "job_id int, clip_id string, trim int")
    p = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "c", "z"), (3, "d", "z")], "job_id int, clip_id string, prompt string")
    sha = F.sha1(F.col("prompt").cast("binary"))
    g = p.select("job_id", "clip_id", F.lit("draft").alias("quality"), F.lit("f").alias("file"), F.when(F.col("clip_id") == "z", "old").otherwise(sha).alias("prompt_hash"), F.when(F.col("clip_id") == "d", 5.0).alias("play"))
    islands = spark.createDataFrame([(1, "a", 4100), (2, "c", 4200), (3, "d", 4200)], "job_id int, clip_id string, t1 int")
    assert rows(screen.complete(c, g, p, islands, "draft")) == [(1, True), (2, False), (3, True)]
    stale = g.withColumn("prompt_hash", F.when(F.col("clip_id") == "b", "old").otherwise(F.col("prompt_hash")))
    assert rows(screen.complete(c, stale, p, islands, "draft"))[0] == (1, False)
    sizes = spark.createDataFrame([(1, "a", "draft", 2000), (1, "b", "draft", 1000), (1, "a", "final", 10), (2, "c", "final", 5000)], "job_id int, clip_id string, quality string, size long")
    assert rows(screen.ready_by_size(c, sizes)) == [(1, True, False), (2, False, True), (3, False, False)]
    assert rows(screen.ready_by_status(spark.createDataFrame([(1, "draft", "done"), (1, "draft", None)], "job_id int, quality string, status string"))) == [(1, "draft", False)]


def test_parameters_routes_and_queues(spark):
    q = lambda w, m, s: F.struct(lit(w).cast("string").alias("workflow"), lit(m).cast("double").alias("megapixels"), lit(s).cast("int").alias("steps"))
    get = lambda c: (lambda x: x and tuple(x))(one(spark, c))
    null = F.when(lit(False), q("w", 1, 1))
    assert get(screen.quality_parameters(q("own", 0, None), q("c", 1, 9), lit("s"))) == ("own", 0.4, 6)
    assert get(screen.quality_parameters(q("", 2, 2), q("", 0.9, 8), lit("s"))) == ("s", 0.9, 8)
    assert get(screen.quality_parameters(null, q(None, 1, 1), lit(""))) is None
    known = ("a", "b")
    assert get(screen.overlaid_parameters(q("a", 0.4, 8), q(None, None, 3), known, q("b", 1, 1))) == ("a", 0.4, 3)
    assert get(screen.overlaid_parameters(q("z", 0.4, 8), q(None, 2, None), known, q("b", 1, 1))) == ("b", 2.0, 1)
    assert get(screen.overlaid_parameters(q("a", 0.4, 8), q("z", None, None), known, q("b", 1, 1))) is None
    assert one(spark, screen.route(lit(""), lit("old"), lit("x"), {"old": "new"}, ("new",), "d")) == "new" and one(spark, screen.route(lit(None), lit(None), lit("x"), {}, ("new",), "d")) is None
    run, wait = F.array(lit("p1")), F.array(lit("p2"), lit("p3"))
    assert tuple(one(spark, screen.queue_summary(run, wait))) == (3, True, "p1") and one(spark, screen.in_queue(run, wait, lit("p3"))) is True
    progress = spark.createDataFrame([(1, "p9", {"c": {"draft": ("p1",), "final": (None,)}}), (2, None, None)], "job_id int, last_prompt_id string, clips map<string,map<string,struct<prompt_id:string>>>")
    own = screen.own_prompts(progress)
    assert rows(own) == [(1, "p1"), (1, "p9")]
    queue = spark.createDataFrame([("p1",), ("p7",)], "prompt_id string")
    assert rows(screen.foreign_runs(queue, own)) == [("p7",)]


def test_gates_reviews_and_new_jobs(spark):
    checks = spark.createDataFrame([(1, 0, "no tool", False), (1, 1, "no mail", None), (1, 2, "no tool", False), (2, 0, "x", True)], "job_id int, ord int, reason string, ok boolean")
    assert [tuple(r) for r in screen.gate_reasons(checks, "job_id").collect()] == [(1, ["no tool", "no mail"])]
    reviews = spark.createDataFrame([(1, 1, "a", False), (1, 2, "a", True), (1, 2, "b", None), (2, 1, "c", True)], "job_id int, round int, clip_id string, pass boolean")
    assert rows(screen.round_passed(reviews)) == [(1, 2, False), (2, 1, True)]
    c, p = spark.createDataFrame([(1, "b", 5)], "job_id int, clip_id string, t0 int"), spark.createDataFrame([(1, "b", "text")], "job_id int, clip_id string, prompt string")
    assert rows(screen.patched_reviews(reviews, c, p), "clip_id", "prompt") == [("b", "text")]
    made = screen.created(spark.createDataFrame([(7, "url", "u", None, "9:16")], "job_id int, kind string, url string, original_path string, aspect string").withColumn("at", F.lit("2024-01-01").cast("timestamp")), {"aspect": "16:9", "mode": "real"}, ("download", "finish")).first()
    assert made["stages"]["finish"]["status"] == "pending" and tuple(made["options"]) == ("9:16", "real") and made["source"]["video"] == "source/video.mp4"
    stages = F.create_map(lit("script"), F.struct(lit("failed").alias("status"), lit("boom").alias("error")), lit("finish"), F.struct(lit("Waiting").alias("status"), lit("full").alias("error")))
    assert one(spark, screen.failure_reasons(lit("running"), lit("boom"), lit("boom"), stages)) == ["boom", "finish (waiting): full"]


def test_detail_and_choice(spark):
    q = "struct<status:string,dirty:boolean>"
    c = spark.createDataFrame([(1, "b", ("done", False), ("done", True), True), (1, "a", ("done", False), ("pending", False), False)], f"job_id int, clip_id string, draft {q}, final {q}, has_script boolean")
    j = spark.createDataFrame([(1, "paused", {n: ("done",) for n in ("download", "pagemeta", "understand", "script", "precheck")}, False, None), (2, "paused", {}, False, None)], "job_id int, state string, stages map<string,struct<status:string>>, running boolean, last_quality string")
    log = spark.createDataFrame([(1, i, f"e{i}") for i in range(60)], "job_id int, at int, text string")
    m = spark.createDataFrame([(1, "v")], "job_id int, source string")
    got = {r["job_id"]: r for r in screen.detail(j, c, m, log, spark.createDataFrame([(1, "han")], "job_id int, rule string")).collect()}
    assert [x["clip_id"] for x in got[1]["clips"]] == ["a", "b"] and got[1]["dirty_clip_ids"] == ["b"] and len(got[1]["events"]) == 40 and got[1]["events"][0]["text"] == "e20"
    assert (got[1]["next_action"], got[1]["drafts_ready"], got[1]["errors"]) == ("redraft", True, ["han"]) and (got[2]["next_action"], got[2]["drafts_ready"]) == ("download", False)
    assert rows(screen.chosen(j, "9", "1")) == [(1,)] and rows(screen.chosen(j, None, None)) == [(2,)]


def test_editor(spark):
    c = spark.createDataFrame([(1, "a", 0, 5000, 5.0), (1, "b", 5000, 9000, 4.0)], "job_id int, clip_id string, t0 long, t1 long, seconds double")
    lines = spark.createDataFrame([(1, "a", 900, "second", "asr"), (1, "a", 100, "first", "ocr")], "job_id int, clip_id string, t0 long, text string, source string")
    d = spark.createDataFrame([(1, "a", "prompt", "{}", [("S1", "old")], ["x"], {"Scene": "hall"})], "job_id int, clip_id string, prompt string, document string, people array<struct<id:string,note:string>>, beats array<string>, parts map<string,string>")
    got = {r["clip_id"]: r for r in screen.editor(c, lines, d).collect()}
    assert [x["text"] for x in got["a"]["speech"]] == ["first", "second"] and "## Scene\nhall" in got["a"]["script"] and got["a"]["has_prompt"]
    assert got["b"]["script"] == "" and not got["b"]["has_document"] and got["b"]["prompt"] == ""


# Documents


def test_details_addresses_and_cookies(spark):
    doc = '{"data": {"item": {"desc": "d", "statistics": {"n": 1}, "author": {"nickname": "a"}}}}'
    assert one(spark, F.try_variant_get(F.try_parse_json(metadata.detail_node(lit(doc))), "$.desc", "string")) == "d"
    assert one(spark, metadata.detail_node(lit('{"desc": "d", "statistics": 3}'))) is None and one(spark, metadata.detail_node(lit("no json"))) is None
    video = '{"video": {"play_addr": {"url_list": ["http://a", "x"]}, "bit_rate": [{"play_addr": {"url_list": ["http://b", "http://a"]}}, {"other": 1}]}}'
    assert one(spark, metadata.play_urls(F.parse_json(lit(video)))) == ["http://a", "http://b"]
    urls = F.array(lit("http://x/1"), lit("http://vod/2"), lit("http://vod/3?watermark=1"), lit("http://x/4"))
    assert one(spark, metadata.picked_urls(urls, "vod", most=2)) == ["http://vod/2", "http://x/1"]
    cookies = spark.createDataFrame([(1, 0, ".a.b", None, True, "99", "n", "v"), (1, 1, "a.b", "/x", None, "-1", "m", None), (1, 2, "a.b", "/", None, None, "", "z")], "k int, ord int, domain string, path string, secure boolean, expires string, name string, value string")
    assert metadata.netscape_cookies(cookies, "k").first()["document"] == "# Netscape HTTP Cookie File\n\n.a.b\tTRUE\t/\tTRUE\t99\tn\tv\na.b\tFALSE\t/x\tFALSE\t0\tm\t\n"
    assert rows(metadata.logged_in(cookies, "k", ("m",))) == [(1, True)]
    files = spark.createDataFrame([(1, "a.mp4", 5), (1, "b.mp4", 9), (1, "c.txt", 99)], "k int, path string, size long")
    assert rows(metadata.largest(files, "k", r"\.mp4$")) == [(1, "b.mp4", 9)]


def test_small_predicates(spark):
    text = lambda f, *a: one(spark, f(*[lit(x) for x in a]))
    assert [one(spark, tx.title_of_drama(lit(t), "skip")) for t in ("《一二三四》", "《一二三》", "这是最好的一天", "skip《一二三四》", "")] == [True, False, True, False, False]
    assert text(tx.aspect_differs, "16:9", "9:16") is True and text(tx.aspect_differs, "16:9", "") is False
    assert one(spark, tx.canonical_name(lit("old"), {"old": "new"}, ("new",))) == "new" and one(spark, tx.canonical_name(lit("x"), {"old": "new"}, ("new",))) is None
    assert text(tx.plain_message, "boom\nTraceback (most recent call last)") == "boom" and one(spark, tx.plain_message(lit("x" * 900))) == "x" * 799 + "…"
    assert text(tx.mail_error, "bad", 535) == "login refused (535): bad" and text(tx.mail_error, "Connection Unexpectedly Closed", 0) == "connection closed during login" and text(tx.mail_error, " other ", 1) == "other"
    assert one(spark, tx.made_by_another(F.array(lit(1)), lit("x Model-7b"), lit("org/model-7B"))) is False and one(spark, tx.made_by_another(F.array().cast("array<int>"), lit("m"), lit("m"))) is True
    ready = lambda title, body, videos, detail=None: one(spark, tx.page_ready(lit(title), lit(body), lit(detail).cast("string"), lit(videos), "sorry", "loading", ("shell",)))
    assert [ready("", "", 0, "d"), ready("", "sorry", 0), ready("t", "loading", 1), ready("shell", "", 1), ready("shell", "", 0), ready("t", "", 0)] == [True, True, False, True, False, True]
    assert text(tx.light, True, False) == "ok" and text(tx.light, False, True) == "red" and text(tx.light, False, False) == "yellow"
    assert one(spark, tx.without_prefixes(lit("model.d2v_model.model.w"), ("d2v_model.", "model."))) == "w"
    assert one(spark, tx.mentions(lit("the cookie is gone"), ("cookie is",))) is True


# Workflows


def test_widget_values_by_position(spark):
    specs = [("n", 0, "seed", True, False, False, True, False), ("n", 1, "image", True, False, False, False, True), ("n", 2, "model", False, True, False, False, False), ("n", 3, "steps", True, True, True, False, False), ("n", 4, "cfg", True, False, False, False, False), ("n", 5, "last", True, False, False, False, False)]
    s = spark.createDataFrame(specs, "node string, ord int, name string, widget boolean, linked boolean, converted boolean, control boolean, upload boolean")
    w = spark.createDataFrame([("n", ["7", "randomize", "a.png", "image", "20", "fixed", "1.5"])], "node string, values array<string>")
    assert rows(graph.widget_values(s, w, "node")) == [("n", "cfg", "1.5"), ("n", "image", "a.png"), ("n", "seed", "7")]


def test_patched_nodes_and_runs(spark):
    n = spark.createDataFrame([(1, "Video", None, [], []), (2, "PrimitiveFloat", "Duration (s)", ["1"], []), (3, "RandomNoise", None, ["5"], []), (4, "Sub", None, ["p", "x", "y", "1", "2", "3"], ["Steps"]), (5, "BasicScheduler", None, ["simple", "4", "1"], []), (6, "Other", None, ["k"], [])], "id int, type string, title string, widgets array<string>, input_names array<string>")
    v = lambda x: lit(x)
    rules = graph.standard_rules(v("text"), v(5.0), v(8), v(42), v("out"), v("16:9"), v(0.4), lit(None).cast("string"), ("Video",))
    got = {r["id"]: r["widgets"] for r in graph.patched(n, [rules[0], graph.subgraph_rule(v("text"), v(5.0), v(8), v(42)), *rules[1:]]).collect()}
    assert got == {1: ["text"], 2: ["5.0"], 3: ["42", "fixed"], 4: ["text", "x", "y", "5.0", "8", "42"], 5: ["simple", "8", "1"], 6: ["k"]}
    files = spark.createDataFrame([("videos", "a.bin"), ("images", "b.MP4"), ("images", "c.png"), ("other", "d.mp4")], "kind string, filename string")
    assert rows(graph.video_files(files), "filename") == [("a.bin",), ("b.MP4",)]
    messages = lambda *m: F.array(*[F.struct(lit(a).alias("name"), lit(b).cast("string").alias("text")) for a, b in m])
    error = lambda status, m: one(spark, graph.run_error(lit(status), m))
    assert error("error", messages(("start", None), ("x", " boom "))) == "boom" and error("success", messages(("execution_error", None))) == "the run failed" and error("success", messages(("start", "x"))) is None
    assert one(spark, graph.run_over(lit(False), lit("error"), messages(("a", "b")))) is True and one(spark, graph.run_over(lit(None).cast("boolean"), lit("ok"), messages(("a", "b")))) is False


def test_inputs_by_name_and_subgraph_definitions(spark):
    i = spark.createDataFrame([("n", 0, "a.model"), ("n", 1, "model"), ("n", 2, "cfg")], "node string, ord int, input string")
    want = spark.createDataFrame([("n", "model"), ("n", "b.cfg"), ("n", "none")], "node string, name string")
    assert rows(graph.found_input(i, want, "node"), "name", "input") == [("b.cfg", "cfg"), ("model", "a.model")]
    assert one(spark, graph.input_names(F.array(lit("a"), lit("b")), F.array(lit("b"), lit("c")))) == ["a", "b", "c"]
    assert [one(spark, graph.is_widget(lit(k), lit(ls), lit(f))) for k, ls, f in (("INT", False, False), ("MODEL", False, False), ("MODEL", True, None), ("INT", False, True))] == [True, False, True, False]
    docs = [("l", '{"definitions": {"subgraphs": [{"id": "s1", "x": 1}, {"x": 2}]}}'), ("m", '{"definitions": {"subgraphs": {"s2": {"x": 1}, "k": {"id": "s3"}}}}'), ("n", "{}"), ("o", "broken")]
    assert rows(graph.subgraph_index(spark.createDataFrame(docs, "graph string, document string")), "graph", "sub") == [("l", "s1"), ("m", "s2"), ("m", "s3")]


# Sound


def test_sound_helpers(spark):
    a = lambda *x: F.array(*[lit(float(y)) for y in x])
    assert one(spark, signal.pooled(F.array(a(1, 2), a(3, 6)))) == [2.0, 4.0]
    assert one(spark, signal.capped(a(0.5, -2.0), 1.0)) == [0.25, -1.0] and one(spark, signal.capped(a(0.5, -0.2), 1.0)) == [0.5, -0.2]
    assert one(spark, signal.without_holes(a(0, 0, 0, 5, 0, 6, 0, 0), a(1, 2), 2)) == [1.0, 2.0, 1.0, 5.0, 0.0, 6.0, 1.0, 2.0]
    assert one(spark, signal.resampled(a(0, 2, 4, 6), 8000, 16000)) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 6.0]
    assert one(spark, signal.resampled(a(0, 1, 2, 3), 32000, 16000)) == pytest.approx([0.0, 2.0])


def test_sound_files_frames_and_subtitles(spark, tmp_path):
    import struct
    import wave

    from timeloom.operators import retime
    from timeloom.sources import documents

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(struct.pack("<8h", 0, 0, 16384, 0, 16384, 16384, 0, 16384))
    (tmp_path / "b.wav").write_bytes(b"no sound")
    got = documents.sounds(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["samples"] == pytest.approx([0, 0.125, 0.25, 0.375, 0.5, 0.375, 0.25, 0.25])
    frames = spark.createDataFrame([(1, "f2"), (1, "f1"), (1, "f3")], "k int, path string")
    assert rows(documents.listed_frames(frames, "k", 3.0)) == [(1, 0, "f1", 0), (1, 1, "f2", 333), (1, 2, "f3", 667)]
    events = spark.createDataFrame([(1, "bottom", 1000, 2000, "a{b")], "k int, style string, t0 long, t1 long, text string")
    text = retime.subtitle_document(events, "k").first()["document"]
    assert text.startswith("[Script Info]\n") and "Style: title," in text and text.endswith("Dialogue: 0,0:00:01.00,0:00:02.00,bottom,,0,0,0,,a\\{b\n")


def test_documents_of_other_jobs_stay(spark, tmp_path):
    from timeloom.sources import documents

    frame = lambda r: spark.createDataFrame(r, "job_id int, x int")
    documents.write_documents(frame([(1, 1), (2, 2)]), str(tmp_path / "d"))
    documents.write_documents(frame([(2, 3)]), str(tmp_path / "d"))
    assert rows(spark.read.json(str(tmp_path / "d")).select("job_id", "x")) == [(1, 1), (2, 3)]


def test_what_is_seen_in_a_clip(spark):
    c = spark.createDataFrame([(1, "a", 1100, 6000)], "job_id int, clip string, t0 long, t1 long")
    w = spark.createDataFrame([(1, 0, 1000, 4000), (1, 1, 3500, 6200)], "job_id int, window int, t0 long, t1 long")
    seen = [(0, 0, 1050, "before"), (0, 1, 1120, "A"), (0, 2, 1500, "B"), (0, 3, 1750, "A"), (0, 4, 3600, "lost"), (1, 0, 3600, "C"), (1, 1, 3700, " "), (1, 2, 5400, "C"), (1, 3, 5500, "late"), (1, 4, 5900, "edge")]
    cells = spark.createDataFrame([(1, *x) for x in seen], "job_id int, window int, i int, t long, see string")
    assert rows(clips.vision(c, w, cells, "job_id"), "t0", "t1", "text") == [(1120, 1750, "A"), (1500, 1500, "B"), (3500, 3500, "C"), (5500, 5500, "late")]


def test_segments_gates_routes_and_inputs(spark):
    from timeloom.operators import beats

    ddl = "array<struct<word:string,start:long,end:long>>"
    t = spark.createDataFrame([(1, "你好世界", 90, [("你好", 5, 900), ("世界", 1000, 1900)]), (2, "whole", 90, []), (3, "hello everyone", 90, [("hello everyone", 0, 9)])], f"k int, text string, duration long, words {ddl}")
    assert rows(clips.asr_segments(t, "k")) == [(1, 1, 5, 1900, "你好世界"), (2, 1, 0, 90, "whole")]
    j = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    e = spark.createDataFrame([(1, "x"), (2, "x")], "k int, id string")
    w = spark.createDataFrame([(1, "r", None), (2, "r", "bad"), (3, "r", None)], "k int, raw string, error string")
    assert rows(beats.events_done(j, e, w, "k")) == [(1, True), (2, False), (3, False)]
    assert one(spark, boundaries.strong_count(F.array(lit("cut"), lit("gap"), lit("title")))) == 2
    assert [one(spark, metadata.ingest_route(lit(u), ("a.com",), ("b.com",))) for u in ("http://x.a.com/1", "//b.com", "http://notb.com/a.com")] == ["api", "browser", "download"]
    assert [tuple(one(spark, screen.mail_ready(*[lit(x) for x in a]))) for a in ((False, "", ""), (True, "u", " "), (True, "u", "p"))] == [(True, True, []), (False, False, ["password"]), (True, False, [])]
    nodes = spark.createDataFrame([("1", "Load", 0), ("2", "Reroute", 0), ("3", "Save", 0), ("4", "Off", 2)], "id string, type string, mode int")
    links = spark.createDataFrame([("1", 0, "2", 0), ("2", 0, "3", 1), ("1", 1, "4", 0)], "src string, src_slot int, dst string, dst_slot int")
    sockets = spark.createDataFrame([("3", 1, "image"), ("4", 0, "image")], "node string, slot int, name string")
    values = spark.createDataFrame([("3", "name", "out"), ("3", "image", "typed"), ("4", "name", "x")], "node string, name string, value string")
    assert rows(graph.node_inputs(nodes, links, sockets, values), "node", "name", "src", "src_slot", "value") == [("3", "image", "1", 0, None), ("3", "name", None, None, "out")]


def test_comment_rows_read_no_more_of_a_text_than_they_take(spark, tmp_path):
    import time

    from timeloom.plans import stories

    long = spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("1, a? é"), 3000).alias("text"))
    odd = spark.createDataFrame([(2000, "12 !?"), (2001, None), (2002, "b" * 41), (2003, "\n1c\n2"), (2004, "")], "doc_id long, text string")
    long.unionByName(odd).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in stories.comment_rows(spark, str(tmp_path)).collect()}
    assert time.time() - began < 15  # whole texts went through a pattern, many times over
    assert len(got) == 1002 and got[7] == (" a " * 14)[:40].strip() and got[2002] == "b" * 40 and got[2003] == "c"
