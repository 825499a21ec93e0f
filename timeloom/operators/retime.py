"""From the source's timeline to the output's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.functions import text as tx


def mapped(points: DataFrame, spans: DataFrame, key: str, margin: int = 1) -> DataFrame:
    """Points (key, n, t) with ``at``, their time on the output, through the first span (ord, src0, src1, cat0) that holds
    them; NULL outside of all spans."""
    s = spans.select(F.col(key).alias("__k"), "ord", "src0", "src1", "cat0")
    held = points.join(s, (F.col(key) == F.col("__k")) & F.col("t").between(F.col("src0") - margin, F.col("src1") + margin), "left")
    at = F.col("cat0") + F.greatest(F.lit(0), F.least("src1", "t") - F.col("src0"))
    return held.groupBy(key, "n", "t").agg(F.min_by(at, "ord").alias("at"))


def mapped_spans(items: DataFrame, spans: DataFrame, key: str, least: int = 120) -> DataFrame:
    """Items (key, n, t0, t1) cut to each span that they overlap and moved to the output; pieces under ``least`` ms go."""
    s = spans.select(F.col(key).alias("__k"), "ord", "src0", "src1", "cat0")
    held = items.join(s, (F.col(key) == F.col("__k")) & (F.col("t0") < F.col("src1")) & (F.col("src0") < F.col("t1")))
    a, b = F.greatest("t0", "src0"), F.least("t1", "src1")
    return held.where(b - a >= least).select(key, "n", "ord", (F.col("cat0") + a - F.col("src0")).alias("out0"), (F.col("cat0") + b - F.col("src0")).alias("out1"))


def local_time(t, start, end, length, padded):
    """A source time within a clip: one to one in a padded clip, else scaled to the clip's length; kept inside it."""
    inside = F.least(F.greatest(t - start, F.lit(0)), end - start)
    return F.when(padded, inside).otherwise(F.least(length, inside * length / F.greatest(end - start, F.lit(1))))


def subtitle_lines(events: DataFrame, key: str) -> DataFrame:
    """A subtitle document per timeline: its events (style, t0, t1, text) as dialogue lines in order of time."""
    line = F.concat(F.lit("Dialogue: 0,"), tx.subtitle_time(F.col("t0")), F.lit(","), tx.subtitle_time(F.col("t1")), F.lit(","), F.col("style"), F.lit(",,0,0,0,,"), tx.subtitle_escape(F.col("text")))
    return events.withColumn("__line", line).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t0", "t1", "style", "__line"))), lambda x: x["__line"]), "\n").alias("document"))


# The head of a subtitle document, and its styles by name with size, place and whether they are bold.
STYLES = {"bottom": (64, 2, 0), "title": (72, 8, -1), "other": (48, 5, 0)}


def subtitle_document(events: DataFrame, key: str, width: int = 1920, height: int = 1080, font: str = "Noto Sans CJK SC") -> DataFrame:
    """A whole subtitle document per timeline: its head, the styles, and its events as dialogue lines."""
    styles = [f"Style: {name},{font},{size},&H00FFFFFF,&H00000000,{bold},{place},60,60,40" for name, (size, place, bold) in STYLES.items()]
    head = ["[Script Info]", "ScriptType: v4.00+", f"PlayResX: {width}", f"PlayResY: {height}", "", "[V4+ Styles]", "Format: Name, Fontname, Fontsize, PrimaryColour, OutlineColour, Bold, Alignment, MarginL, MarginR, MarginV", *styles]
    body = ["", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text", ""]
    return subtitle_lines(events, key).select(key, F.concat(F.lit("\n".join([*head, *body])), "document", F.lit("\n")).alias("document"))
