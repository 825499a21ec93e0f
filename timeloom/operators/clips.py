"""What is known of a clip: its speech, its windows, its neighbours, the thread of its dialogue, and these as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions import text as tx
from timeloom.operators import beats, dialogue, intervals, prompts, retime, sequences

# Where a line of speech may come from.
SOURCES = ("ocr", "asr", "asr-extra")


def speech_source(source: Column, corrected_by: Column) -> Column:
    """Where a line comes from: as it says, else read from the screen if it was corrected, else heard."""
    said = tx.trimmed(F.coalesce(source, F.lit("")))
    return F.when(said.isin(*SOURCES), said).when(F.coalesce(corrected_by, F.lit("")) != "", "ocr").otherwise("asr")


def source_counts(speech: DataFrame, key: str) -> DataFrame:
    """Lines read from the screen and lines only heard, per key."""
    return speech.groupBy(key).agg(F.count_if(F.col("source") == "ocr").alias("read"), F.count_if(F.col("source") == "asr-extra").alias("heard"))


def needs_judge(cases: DataFrame, key: str) -> DataFrame:
    """Whether any of a key's lines must be judged (``decision``)."""
    return cases.groupBy(key).agg(F.bool_or(F.coalesce(F.col("decision") == "judge", F.lit(False))).alias("judge"))


def normalised_transcript(segments: DataFrame, key: str) -> DataFrame:
    """One row per key: the text of all segments (ord, text, text_asr, words) in order, and all their words."""
    said = F.coalesce(F.nullif("text_asr", F.lit("")), F.nullif("text", F.lit("")), F.lit(""))
    rows = F.array_sort(F.collect_list(F.struct("ord", said.alias("said"), F.coalesce("words", F.array().cast(segments.schema["words"].dataType)).alias("words"))))
    return segments.groupBy(key).agg(rows.alias("__r")).select(key, F.array_join(F.transform("__r", lambda r: r["said"]), "").alias("text"), F.flatten(F.transform("__r", lambda r: r["words"])).alias("words"))


def fallback_segments(transcripts: DataFrame, key: str) -> DataFrame:
    """Segments of transcripts (key, text, duration in ms, words of word, start, end) that have none of their own: from the
    first word to the last, or without words the whole length; a transcript without text has none."""
    some = F.size("words") > 0
    some = F.coalesce(some, F.lit(False))
    whole = transcripts.where(some | (tx.trimmed(F.coalesce("text", F.lit(""))) != ""))
    return whole.select(key, F.when(some, F.col("words")[0]["start"]).otherwise(0).cast("long").alias("t0"), F.when(some, F.element_at("words", -1)["end"]).otherwise(F.col("duration")).cast("long").alias("t1"), tx.trimmed(F.col("text")).alias("text"))


def speech_of(clips: DataFrame, speech: DataFrame, key: str) -> DataFrame:
    """Lines of speech (key, line, t0, t1, text) with the clip (key, clip) that owns each; lines that no clip owns are left out."""
    return intervals.owners(speech, clips, key, "line", "clip").where("owner is not null").withColumnRenamed("owner", "clip").drop("shared")


def texts_of(owned: DataFrame, key: str) -> DataFrame:
    """The texts of a clip's lines, in order of time, empty ones left out."""
    rows = F.array_sort(F.collect_list(F.struct("t0", "line", tx.trimmed(F.col("text")).alias("text"))))
    return owned.groupBy(key, "clip").agg(F.filter(F.transform(rows, lambda r: r["text"]), lambda t: t != "").alias("lines"))


def most_people(covering: DataFrame, key: str) -> DataFrame:
    """The most adults and children in any window of a clip; NULL only where no window knows."""
    return covering.groupBy(key, "clip").agg(F.max("adults").alias("adults"), F.max("children").alias("children"))


def neighbours(clips: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Clips (key, clip, n, cast_reset) with the clips before and after and their lines, and ``thread``: the clip before if
    the cast changes with neither of the two."""
    w = Window.partitionBy(key).orderBy("n")
    rows = clips.join(lines.select(key, "clip", "lines"), [key, "clip"], "left")
    thread = F.when(~F.coalesce("cast_reset", F.lit(False)) & ~F.coalesce(F.lag("cast_reset").over(w), F.lit(False)), F.lag("clip").over(w))
    return rows.select("*", F.lag("clip").over(w).alias("before"), F.lag("lines").over(w).alias("lines_before"), F.lead("clip").over(w).alias("after"), F.lead("lines").over(w).alias("lines_after"), thread.alias("thread"))


def threads(clips: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """For each clip with a ``thread`` the turns (speaker, line) of the prompt (key, clip, prompt) before it."""
    turns = texts.select(key, F.col("clip").alias("thread"), prompts.speakers_of(F.col("prompt")).alias("turns")).where(F.size("turns") > 0)
    return clips.where("thread is not null").join(turns, [key, "thread"]).select(key, "clip", "thread", "turns")


def facts(clips: DataFrame, windows: DataFrame, speech: DataFrame, cuts: DataFrame, key: str) -> DataFrame:
    """One row per clip with what its prompt is written from.

    ``clips`` are (key, clip, n, t0, t1, h3, padded, cast_reset), ``windows`` (key, window, t0, t1, adults, children, action),
    ``speech`` (key, line, t0, t1, text), ``cuts`` (key, t), times in ms. The row has the windows' actions in order, the
    most people, the clip's lines in its own time, its cuts at least a second apart, and its neighbours. Every part is a
    join on the key and one grouping by clip, so clips without a part keep their row.
    """
    covering = intervals.tiered(clips, windows, key, "clip", "window").join(windows, [key, "window"]).where("tier is not null")
    actions = F.array_sort(F.collect_list(F.when(F.coalesce("action", F.lit("")) != "", F.struct("t0", F.concat(F.format_string("%.2f-%.2fs ", F.col("t0") / 1000, F.col("t1") / 1000), "action").alias("said")))))
    seen = covering.groupBy(key, "clip").agg(F.transform(actions, lambda a: a["said"]).alias("actions"), F.max("adults").alias("adults"), F.max("children").alias("children"))
    span = clips.select(key, "clip", F.col("t0").alias("c0"), F.col("t1").alias("c1"), "h3", "padded")
    local = lambda t: retime.local_time(t, F.col("c0"), F.col("c1"), F.col("h3"), F.col("padded"))
    owned = speech_of(clips, speech, key)
    said = owned.join(span, [key, "clip"]).where(tx.trimmed(F.col("text")) != "").groupBy(key, "clip").agg(
        F.array_sort(F.collect_list(F.struct(local(F.greatest("t0", "c0")).alias("a"), local(F.least("t1", "c1")).alias("b"), tx.trimmed(F.col("text")).alias("text")))).alias("speech")
    )
    within = clips.select(key, "clip", (F.col("t0") + 41).alias("t0"), (F.col("t1") - 40).alias("t1"))
    met = intervals.overlapping(within, cuts.select(key, F.col("t").alias("t0"), (F.col("t") + 1).alias("t1")), key)
    inner = met.select(F.col(f"l_{key}").alias(key), F.col("l_clip").alias("clip"), F.col("r_t0").alias("__t")).join(span, [key, "clip"]).select(key, "clip", "h3", local(F.col("__t")).alias("t"))
    of = F.to_json(F.struct(key, "clip"))
    inside = inner.where((F.col("t") >= 1000) & (F.col("t") <= F.col("h3") - 1000)).select(of.alias("__of"), "t")
    kept = sequences.thinned(inside, "__of", 1000).groupBy("__of").agg(F.array_sort(F.collect_list("t")).alias("cuts"))
    cut = span.select(key, "clip", of.alias("__of")).join(kept, "__of").drop("__of")
    near = neighbours(clips, texts_of(owned, key), key).select(key, "clip", "before", "lines_before", "after", "lines_after", "thread")
    out = clips
    for part in (seen, said, cut, near):
        out = out.join(part, [key, "clip"], "left")
    return out


def vision(clips: DataFrame, windows: DataFrame, cells: DataFrame, key: str, step: int = 250, edge: int = 200) -> DataFrame:
    """What is seen in each clip, as (key, clip, t0, t1, text): the cells (key, window, i, t, see) of its windows, one for each
    step of ``step`` ms, where the same is seen again within 1.5 s and two rows joined.

    Of cells in one step the last by window and place counts. The last ``edge`` ms of a clip are left out, and of a window
    that goes on after the clip the last 550. A cell that its step would put before the clip keeps its own time.
    """
    covering = intervals.tiered(clips, windows, key, "clip", "window").select(key, "clip", "window")
    ends = windows.select(key, "window", F.col("t1").alias("w1"))
    rows = covering.join(cells, [key, "window"]).join(ends, [key, "window"]).join(clips.select(key, "clip", F.col("t0").alias("c0"), F.col("t1").alias("c1")), [key, "clip"])
    goes_on = (F.col("w1") > F.col("c1") + 250) & (F.col("t") >= F.col("c1") - 550)
    rows = rows.where((F.col("t") >= F.col("c0")) & (F.col("t") < F.col("c1") - edge) & ~goes_on)
    slot = F.bround(F.col("t") / step).cast("long") * step
    rows = rows.withColumn("early", slot < F.col("c0")).withColumn("at", F.when(slot < F.col("c0"), F.col("t")).otherwise(slot)).where(F.col("at") < F.col("c1") - edge)
    last = Window.partitionBy(key, "clip", "early", "at").orderBy(F.desc("window"), F.desc("i"))
    of = F.to_json(F.struct(key, "clip"))
    kept = rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").where(tx.trimmed(F.coalesce("see", F.lit(""))) != "").select(of.alias("__of"), F.col("at").alias("ord"), F.col("at").alias("t"), tx.trimmed(F.col("see")).alias("text"))
    merged = sequences.lookback_merge(kept, "__of")
    return clips.select(key, "clip", of.alias("__of")).join(merged, "__of").drop("__of")


def asr_segments(transcripts: DataFrame, key: str) -> DataFrame:
    """Segments of transcripts that have none of their own, long ones split at pauses: (key, id, t0, t1, text); what no one said
    is left out where there are words."""
    words = F.transform("words", lambda w: F.struct(w["start"].alias("t0"), w["end"].alias("t1"), w["word"].alias("word")))
    spoken = transcripts.where(F.size("words") > 0)
    whole = fallback_segments(spoken, key).withColumn("id", F.lit(1)).join(spoken.select(key, words.alias("words")), key)
    parts = dialogue.split_segments(whole.select(key, "id", "t0", "t1", "words"), key)
    silent = fallback_segments(transcripts.where(F.coalesce(F.size("words"), F.lit(0)) <= 0), key).withColumn("id", F.lit(1))
    return parts.where(~tx.hallucinated(F.col("text"))).unionByName(silent.select(key, "id", "t0", "t1", "text"))


def beat_lines(windows: DataFrame, key: str) -> DataFrame:
    """The windows of a film as text, a line each."""
    line = F.concat(
        F.format_string("%.2f-%.2fs  ", F.col("t0") / 1000, F.col("t1") / 1000),
        F.format_string("%s adults %s children  text=%s  open=%s", F.coalesce(F.col("adults").cast("string"), F.lit("?")), F.coalesce(F.col("children").cast("string"), F.lit("?")), F.coalesce("has_text", F.lit(False)).cast("string"), F.coalesce(F.nullif(F.array_join("flags", ","), F.lit("")), F.lit("none"))),
        F.when(F.coalesce("error", F.lit("")) != "", F.concat(F.lit(" ERR="), "error")).otherwise(""),
        F.lit("  "),
        F.regexp_replace(F.coalesce("action", F.lit("")), "\n", " "),
    )
    return windows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def span_lines(spans: DataFrame, key: str, extra: str | None = None) -> DataFrame:
    """Spans with texts as text, a line each; empty ones are left out."""
    line = F.concat(F.format_string("%.2f-%.2fs  ", F.coalesce("t0", F.lit(0)) / 1000, F.coalesce("t1", "t0", F.lit(0)) / 1000), tx.trimmed(F.col("text")), F.concat(F.lit("  "), F.coalesce(F.col(extra).cast("string"), F.lit(""))) if extra else F.lit(""))
    rows = spans.where(tx.trimmed(F.coalesce("text", F.lit(""))) != "")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def call_statistics(model: Column, tokens_in: Column, tokens_out: Column, millis: Column, trace: Column) -> Column:
    """How a model was called, in one line."""
    n = lambda c: F.coalesce(c, F.lit(0))
    return F.coalesce(
        F.nullif(
            F.concat_ws(
                ", ",
                F.nullif(model, F.lit("")),
                F.when((n(tokens_in) > 0) | (n(tokens_out) > 0), F.format_string("in %d out %d", n(tokens_in), n(tokens_out))),
                F.when(n(millis) > 0, F.format_string("%.1fs", millis / 1000)),
                F.array_join(F.transform(F.coalesce(trace, F.array().cast("array<string>")), lambda x: F.concat(F.lit("back["), x, F.lit("]"))), ", "),
            ),
            F.lit(""),
        ),
        F.lit("no statistics"),
    )


def vocabulary(captions: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The first distinct captions (ord, text) of 2 to 14 characters of each key, in order."""
    w = Window.partitionBy(key).orderBy("ord")
    fit = captions.select(key, "ord", tx.trimmed(F.col("text")).alias("text")).where(F.length("text").between(2, 14)).groupBy(key, "text").agg(F.min("ord").alias("ord"))
    return fit.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("terms"))


def sentence_ends(key: str, *spans: DataFrame) -> DataFrame:
    """The distinct ends of all given spans."""
    ends = spans[0].select(key, "t1")
    for other in spans[1:]:
        ends = ends.unionByName(other.select(key, "t1"))
    return ends.distinct()


def still_times(clips: DataFrame, frames: DataFrame, key: str, most: int) -> DataFrame:
    """For each clip the times of its frames (key, t), at most ``most`` spread evenly, or its start, middle and end if it has none."""
    f = frames.select(F.col(key).alias("__k"), F.col("t").alias("__t"))
    got = clips.join(f, (F.col(key) == F.col("__k")) & F.col("__t").between(F.col("t0"), F.col("t1")), "left").groupBy(key, "clip", "t0", "t1").agg(F.array_sort(F.collect_set("__t")).alias("all"))
    n = F.size("all")
    spread = F.when(n <= most, F.col("all")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at("all", F.bround(i * (n - 1) / max(1, most - 1)).cast("int") + 1)))
    fallback = F.array("t0", F.floor((F.col("t0") + F.col("t1")) / 2), "t1")
    return got.select(key, "clip", F.when(n == 0, fallback).otherwise(spread).alias("times"))


def failed_windows(windows: DataFrame, key: str) -> DataFrame:
    """Keys whose windows keep a script from being written."""
    return windows.where(beats.failed(F.col("raw"), F.col("error"))).groupBy(key).agg(F.count("*").alias("n"))
