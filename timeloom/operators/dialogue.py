"""Captions and recognised speech: words of a caption, extra lines, decisions between both, long segments, titles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions import text as tx
from timeloom.functions.ratio import reaches, squeeze
from timeloom.operators.intervals import overlapping


def persistent_labels(hits: DataFrame, key: str, least: int = 3000) -> DataFrame:
    """(key, text) of short bottom texts that stay for ``least`` ms or longer: labels rather than speech."""
    bottom = hits.where("region = 'bottom' and not coalesce(watermark, false)").withColumn("text", tx.squeezed(F.col("text")))
    return bottom.where((F.col("text") != "") & (tx.han_count(F.col("text")) <= 3)).groupBy(key, "text").agg((F.max("t") - F.min("t")).alias("stays")).where(F.col("stays") >= least).select(key, "text")


def caption_hits(hits: DataFrame, key: str) -> DataFrame:
    """Bottom hits that read like dialogue: no watermark, no label."""
    labels = persistent_labels(hits, key).select(F.col(key).alias("__k"), F.col("text").alias("__label"))
    good = hits.where("region = 'bottom' and not coalesce(watermark, false)").where(tx.dialogue_caption(F.col("text")))
    return good.join(labels, (F.col(key) == F.col("__k")) & (tx.squeezed(F.col("text")) == F.col("__label")), "left_anti")


def caption_words(captions: DataFrame, words: DataFrame, key: str, share: float = 0.55) -> DataFrame:
    """Captions (key, ord, t0, t1, text) with the words said meanwhile, joined, and their span where there are any.

    A word (ord, t0, t1, word) belongs if at least ``share`` of it lies in the caption.
    """
    spans = captions.withColumn("t1", F.when(F.col("t1") - F.col("t0") < 200, F.col("t0") + 450).otherwise(F.col("t1")))
    met = overlapping(spans.select(key, "ord", "t0", "t1"), words.select(key, "ord", "t0", "t1", "word"), key)
    shared = F.least("l_t1", "r_t1") - F.greatest("l_t0", "r_t0")
    said = met.where(shared / F.greatest(F.lit(20), F.col("r_t1") - F.col("r_t0")) >= share)
    inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_ord", "r_word"))), lambda x: tx.unspaced(x["r_word"])), "")
    joined = said.groupBy(F.col(f"l_{key}").alias(key), F.col("l_ord").alias("ord")).agg(F.min("r_t0").alias("w0"), F.max_by("r_t1", "r_ord").alias("w1"), inside.alias("said"))
    return spans.join(joined, [key, "ord"], "left").select(key, "ord", F.coalesce("w0", "t0").alias("t0"), F.coalesce("w1", "t1").alias("t1"), "text", F.coalesce("said", F.lit("")).alias("said"))


def extra_lines(segments: DataFrame, captions: DataFrame, ends: DataFrame, key: str, near: int = 350, most: int = 50) -> DataFrame:
    """Recognised segments that no caption covers: six Han characters, no hallucination, begun before the end, overlap of at
    most ``most`` ms with captions and at least ``near`` ms from all of them, and from the extra lines taken before.
    """
    fit = segments.join(ends.select(key, "duration"), key, "left").where(~tx.hallucinated(F.col("text")) & (tx.han_count(F.col("text")) >= 6)).where("coalesce(duration, 0) = 0 or t0 < duration - 50").drop("duration")
    wide = fit.select(key, F.col("t0").alias("s0"), F.col("t1").alias("s1"), "text", (F.col("t0") - near).alias("t0"), (F.col("t1") + near).alias("t1"))
    met = overlapping(wide, captions.select(key, "t0", "t1"), key)
    shared = F.sum(F.greatest(F.lit(0), F.least("l_s1", "r_t1") - F.greatest("l_s0", "r_t0")))
    apart = F.min(F.least(F.abs(F.col("l_s0") - F.col("r_t1")), F.abs(F.col("l_s1") - F.col("r_t0"))))
    covered = met.groupBy(F.col(f"l_{key}").alias(key), F.col("l_s0").alias("t0"), F.col("l_s1").alias("t1"), F.col("l_text").alias("text")).agg(shared.alias("shared"), apart.alias("apart"))
    clear = fit.join(covered.where((F.col("shared") > most) | (F.col("apart") < near)), [key, "t0", "t1", "text"], "left_anti")
    lists = clear.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("t0").cast("bigint").alias("t0"), F.col("t1").cast("bigint").alias("t1"), "text"))).alias("xs"))

    def add(acc, x):
        blocked = F.exists(acc, lambda y: (F.least(y["t1"], x["t1"]) - F.greatest(y["t0"], x["t0"]) > most) | (F.abs(x["t0"] - y["t1"]) < near) | (F.abs(x["t1"] - y["t0"]) < near))
        return F.when(blocked, acc).otherwise(F.array_append(acc, x))

    taken = F.aggregate("xs", F.array().cast("array<struct<t0:bigint,t1:bigint,text:string>>"), add)
    return lists.select(key, F.explode(taken).alias("x")).select(key, "x.*", F.lit("asr-extra").alias("source"))


def reconciled(captions: DataFrame, words: DataFrame, segments: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """Captions with their spoken spans and, between them, the extra lines; numbered along the timeline."""
    spoken = caption_words(captions, words, key).select(key, "t0", "t1", "text", "said", F.lit("ocr").alias("source"))
    extra = extra_lines(segments, spoken, ends, key).select(key, "t0", "t1", "text", F.col("text").alias("said"), "source")
    w = Window.partitionBy(key).orderBy("t0", "t1", "text")
    return spoken.unionByName(extra).withColumn("id", F.row_number().over(w))


def decision(ocr: Column, asr: Column, source: Column) -> Column:
    """What to do with a caption and what was heard: keep it, drop it, use the speech, or have it judged."""
    seen, heard = tx.usable_line(ocr), tx.usable_line(asr)
    return F.when(source != "ocr", "keep").when(~seen & ~heard, "drop").when(seen & ~heard, "keep").when(heard & ~seen, "use-asr").when(tx.squeezed(ocr) == tx.squeezed(asr), "keep").otherwise("judge")


def adjudicated(segments: DataFrame, picks: DataFrame, key: str) -> DataFrame:
    """Segments (key, id, text, said, source) after the decisions; ``picks`` (key, id, pick) answers the judged ones, and
    without an answer the caption stays. Numbered anew."""
    decided = segments.withColumn("decision", decision(F.col("text"), F.col("said"), F.col("source"))).join(picks, [key, "id"], "left")
    use = (F.col("decision") == "use-asr") | ((F.col("decision") == "judge") & (F.col("pick") == "asr"))
    w = Window.partitionBy(key).orderBy("id")
    return decided.where("decision <> 'drop'").withColumn("text", F.when(F.coalesce(use, F.lit(False)), F.col("said")).otherwise(F.col("text"))).withColumn("id", F.row_number().over(w)).drop("pick")


def split_segments(segments: DataFrame, key: str, longest: int = 8000, pause: int = 3500, least: int = 1500) -> DataFrame:
    """Segments (key, id, t0, t1, words array<struct<t0,t1,word>>) longer than ``longest`` in pieces that end at a
    punctuation mark after ``pause`` ms, or at ``longest``; a last piece under ``least`` ms joins the one before."""
    piece = "struct<t0:bigint,t1:bigint,words:array<string>,closed:boolean>"

    def add(acc, w):
        last = F.try_element_at(acc, F.lit(-1))
        fresh = (F.size(acc) == 0) | F.coalesce(last["closed"], F.lit(True))
        t0 = F.when(fresh, w["t0"]).otherwise(last["t0"])
        words = F.when(fresh, F.array(w["word"])).otherwise(F.array_append(last["words"], w["word"]))
        length = w["t1"] - t0
        closed = (length >= longest) | ((length >= pause) & tx.trimmed(w["word"]).rlike("[,.!?;，。！？；、]$"))
        new = F.struct(t0.alias("t0"), w["t1"].alias("t1"), words.alias("words"), closed.alias("closed"))
        return F.when(fresh, F.array_append(acc, new)).otherwise(F.array_append(F.slice(acc, 1, F.size(acc) - 1), new))

    def settle(acc):
        last, before = F.try_element_at(acc, F.lit(-1)), F.try_element_at(acc, F.lit(-2))
        short = (F.size(acc) > 1) & ~last["closed"] & (last["t1"] - last["t0"] < least)
        joined = F.struct(before["t0"].alias("t0"), last["t1"].alias("t1"), F.concat(before["words"], last["words"]).alias("words"), F.lit(True).alias("closed"))
        return F.when(short, F.array_append(F.slice(acc, 1, F.size(acc) - 2), joined)).otherwise(acc)

    long = (F.col("t1") - F.col("t0") > longest) & (F.size("words") >= 4)
    parts = F.aggregate("words", F.array().cast(f"array<{piece}>"), add, settle)
    whole = F.array(F.struct(F.col("t0").cast("bigint").alias("t0"), F.col("t1").cast("bigint").alias("t1"), F.transform("words", lambda w: w["word"]).alias("words"), F.lit(True).alias("closed")))
    rows = segments.select(key, F.col("id").alias("__id"), F.posexplode(F.when(long, parts).otherwise(whole)).alias("__p", "p"))
    w = Window.partitionBy(key).orderBy("__id", "__p")
    return rows.select(key, F.row_number().over(w).alias("id"), F.col("p.t0").alias("t0"), F.col("p.t1").alias("t1"), tx.trimmed(F.array_join("p.words", "")).alias("text"))


def collapsed_lines(lines: DataFrame, key: str, least: float = 0.85) -> DataFrame:
    """Lines (key, ord, text) without near duplicates of the line kept before; the longer of the two stays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, ord, text: lines stream by in order
        for batch in batches:
            out = []
            for k, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is not None and last[0] == k and reaches(squeeze(last[2]), squeeze(text), least):
                    last[2] = max(last[2], text, key=len)
                else:
                    out.append(last)
                    last = [k, n, text or ""]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[x for x in out if x]), batch.schema.types, strict=True)] if any(out) else [pa.array([], t) for t in batch.schema.types], batch.schema.names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, batch.schema.types, strict=True)], batch.schema.names)

    ordered = lines.select(key, F.col("ord").cast("long").alias("ord"), "text").repartition(key).sortWithinPartitions(key, "ord")
    return ordered.mapInArrow(run, ordered.schema)


def mouth_evidence(speech: DataFrame, mouths: DataFrame, key: str, least: int = 150) -> DataFrame:
    """Speech (key, ord, t0, t1) with the sorted names of those whose mouth (t0, t1, who, state) is open meanwhile."""
    met = overlapping(speech.select(key, "ord", "t0", "t1"), mouths.where("state = 'open'").select(key, "t0", "t1", "who"), key)
    long = F.least("l_t1", "r_t1") - F.greatest("l_t0", "r_t0") > least
    seen = met.where(long).groupBy(F.col(f"l_{key}").alias(key), F.col("l_ord").alias("ord")).agg(F.array_sort(F.collect_set("r_who")).alias("mouths"))
    return speech.join(seen, [key, "ord"], "left").withColumn("mouths", F.coalesce("mouths", F.array().cast("array<string>")))


def with_emotions(speech: DataFrame, emotions: DataFrame, key: str) -> DataFrame:
    """Speech with the emotion of the row with the same times; short spans and weak or vague labels have none."""
    sure = emotions.where("t1 - t0 >= 600 and score >= 0.45 and label not in ('other', 'unknown')").select(key, "t0", "t1", F.struct("label", "score").alias("emotion"))
    return speech.join(sure.dropDuplicates([key, "t0", "t1"]), [key, "t0", "t1"], "left")
