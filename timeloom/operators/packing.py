"""Splitting of spans into clips of a legal length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions.timegrid import GRID, FrameGrid, frames, snapped
from timeloom.operators.boundaries import HARD, score
from timeloom.operators.intervals import overlapping
from timeloom.plans.materialise import checkpointed

#: The least length of a piece, in ms.
LEAST = 2000
#: Levels that are cut before what is done is put aside.
_LEVELS = 4

def cuts(spans: DataFrame, points: DataFrame, key: str, longest: int, least: int = LEAST) -> DataFrame:
    """Where spans (key, id, t0, t1) are cut at points (key, t, s, hard): columns key, id, t0, t1 and ``cut``.

    A span is cut at the best of its points that lie at least ``least`` from both ends: a hard one before any other, then
    by the score ``s``, then the nearest to the middle, then the earlier. Points that aren't hard count only in what is
    longer than ``longest``. Both parts are cut in turn.

    All spans are cut level by level, as many levels as cuts lie within one another: for each score about the logarithm of
    the cuts of a span, as the middle comes first. Points stand by their span, so a few levels are cut without a shuffle
    between; then cuts and points of parts that are done drop out.
    """
    met = overlapping(spans.select(key, "id", "t0", "t1").distinct(), points.select(key, F.col("t").alias("t0"), (F.col("t") + 1).alias("t1"), "s", "hard"), key).where("r_t0 > l_t0")
    at = [key, "id", "t0", "t1"]
    inside = met.select(*[F.col(f"l_{c}").alias(c) for c in at], F.col("l_t0").alias("a"), F.col("l_t1").alias("b"), F.col("r_t0").alias("t"), F.col("r_s").alias("s"), F.col("r_hard").alias("hard"), F.lit(False).alias("done"))
    usable = ~F.col("done") & (F.col("t") >= F.col("a") + least) & (F.col("t") <= F.col("b") - least) & (F.col("hard") | (F.col("b") - F.col("a") > longest))
    order = F.struct("hard", "s", -F.abs(2 * F.col("t") - F.col("a") - F.col("b")), -F.col("t"), "t")
    part, found = Window.partitionBy(*at, "a", "b"), []
    left, right = F.col("t") < F.col("cut"), F.col("t") > F.col("cut")
    while True:
        rows = inside.repartition(*at)
        for _ in range(_LEVELS):
            # what can't be used in its part now can't be in any part of that
            rows = rows.where(F.col("done") | usable).withColumn("cut", F.when(~F.col("done"), F.max(F.when(usable, order)).over(part)["t"]))
            rows = rows.withColumns({"a": F.when(right, F.col("cut")).otherwise(F.col("a")), "b": F.when(left, F.col("cut")).otherwise(F.col("b")), "done": F.col("done") | (F.col("t") == F.col("cut"))}).drop("cut")
        rows = checkpointed(rows.where(F.col("done") | usable))
        found.append(rows.where("done").select(*at, F.col("t").alias("cut")))
        inside = rows.where("not done")
        if inside.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()


def pieces(spans: DataFrame, points: DataFrame, key: str, longest: int, least: int = LEAST) -> DataFrame:
    """The parts of spans (key, id, t0, t1, ...), numbered as ``part`` from 0: cut at points as by cuts(), and in equal
    parts what is still longer than ``longest``. Other columns stay."""
    at = [key, "id", "t0", "t1"]
    rest = [c for c in spans.columns if c not in at]
    # other columns ride along with the first part; spans that only differ in them are one
    firsts = spans.groupBy(*at).agg(F.collect_list(F.struct(F.lit(0).alias("__"), *rest)).alias("rest"), F.first("t0").alias("a"))
    cut = cuts(spans, points, key, longest, least).select(*at, F.lit(None).cast(firsts.schema["rest"].dataType).alias("rest"), F.col("cut").alias("a"))
    w = Window.partitionBy(*at).orderBy("a")
    size = F.col("b") - F.col("a")
    n = F.when(size > longest, F.floor(size / longest) + 1).otherwise(1)
    edge = lambda i: (F.col("a") + F.bround(size * i / F.col("n"))).cast("long")
    parts = firsts.unionByName(cut).withColumn("b", F.coalesce(F.lead("a").over(w), F.col("t1"))).withColumn("n", n)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("rest", F.first("rest", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))).withColumn("rest", F.explode("rest"))
    return parts.select(key, "id", *[F.col(f"rest.{c}").alias(c) for c in rest], (F.col("before") + F.col("i")).cast("int").alias("part"), edge(F.col("i")).alias("t0"), edge(F.col("i") + 1).alias("t1"))


def pack(events: DataFrame, candidates: DataFrame, key: str = "job_id", grid: FrameGrid = GRID) -> DataFrame:
    """Clips of the story events (key, id, kind, t0, t1, cast_reset), split at candidates (key, t, reasons), and their
    legal lengths: frames, seconds, drift against the source, whether padded, and a number along the timeline. Events that
    are repeated count once."""
    points = candidates.select(key, "t", score(F.col("reasons")).alias("s"), F.arrays_overlap("reasons", F.array(*[F.lit(h) for h in HARD])).alias("hard"))
    story = events.where("kind <> 'endcard' and t1 > t0").select(key, "id", "cast_reset", "t0", "t1").distinct()
    clips = pieces(story, points, key, int(grid.longest * 1000)).withColumnRenamed("id", "event_id").select(key, "event_id", "part", "cast_reset", "t0", "t1")
    seconds = (F.col("t1") - F.col("t0")) / 1000
    legal = snapped(frames(seconds, grid), grid)
    return (
        clips.withColumn("source_seconds", seconds)
        .withColumn("frames", legal)
        .withColumn("seconds", F.col("frames") / float(grid.fps))
        .withColumn("drift", F.col("seconds") - F.col("source_seconds"))
        .withColumn("padded", F.col("source_seconds") < grid.shortest)
        .withColumn("stretched", F.col("seconds") > F.col("source_seconds") + 0.05)
        .withColumn("cast_reset", F.col("cast_reset") & (F.col("part") == 0))
        .withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("t0", "event_id", "part")))
    )
