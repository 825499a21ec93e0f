"""Joins of intervals and points along timelines.

Every join has the timeline's key as an equality, so no plan needs a cartesian product. Where one timeline may be long,
``overlapping`` adds an equality on nodes of a tree over time, so that a hot timeline spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.operators.scans import last, spread


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether two open intervals share time."""
    return (a0 < b1) & (b0 < a1)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared time, at least zero."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def widened(df: DataFrame, least: int = 50) -> DataFrame:
    """Spans (t0, t1) with degenerate ones stretched to ``least`` ms."""
    return df.withColumn("t1", F.when(F.col("t1") <= F.col("t0"), F.col("t0") + least).otherwise(F.col("t1")))


def _shift(df: DataFrame) -> Column:
    """The level of a span: the least even number of bits that its length fits in."""
    length = F.greatest(F.col("t1") - F.col("t0"), F.lit(1)).cast("double")
    return (2 * F.ceil(F.log2(length) / 2)).cast("int")


def _standing(df: DataFrame, name: str, others: DataFrame, own: int, lifted: int, higher: Callable[[Column], Column]) -> DataFrame:
    """A row for each node that a span touches, at its own level (two or three) or lifted to a ``higher`` one that other spans
    have (two at most): node, level and case as one number. The last moment of a span is not in it."""
    codes = others.agg(F.collect_set(F.col("__level") * 2 + lifted)).scalar()
    coded = df.withColumn("__codes", codes).withColumn("__code", F.explode(F.array_append(F.coalesce("__codes", F.array().cast("array<int>")), F.col("__level") * 2 + own)))
    level = F.call_function("shiftright", F.col("__code"), F.lit(1))
    rows = coded.where((F.col("__code") % 2 == own) | higher(level))
    node = lambda t: F.call_function("shiftright", t.cast("long"), level)
    touched = F.sequence(node(F.col("t0")), node(F.greatest(F.col("t1"), F.col("t0") + 1) - 1))
    placed = rows.withColumn("__node", F.explode(touched))
    return placed.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "__level"], (F.col("__node") * 128 + F.col("__code")).alias(f"__{name}"))


def overlapping(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All pairs of spans of one timeline that overlap: columns of both sides, named l_* and r_*. Spans are (key, t0, t1, ...).

    Spans meet in the nodes of a tree over time: at level 2k a node has 4**k ms. A span stands at its own level, where it
    touches two or three nodes, and is lifted to the levels of longer spans on the other side, at most one more row or two
    for each level that there is; so a pair meets at the level of its longer span, in the node where both begin to overlap.
    Rows grow with the logarithm of lengths, whatever lengths come together, and a hot timeline spreads over many tasks.
    """
    a, b = left.withColumn("__level", _shift(left)), right.withColumn("__level", _shift(right))
    # case 0: the right span stands at its own level, which is as high or higher; case 1: the left one, which is higher
    a, b = _standing(a, "l", b, 1, 0, lambda x: x >= F.col("__level")), _standing(b, "r", a, 0, 1, lambda x: x > F.col("__level"))
    level, node = F.floor(F.pmod("__l", F.lit(128)) / 2).cast("int"), F.call_function("shiftright", F.col("__l"), F.lit(7))
    on = (F.col(f"l_{key}") == F.col(f"r_{key}")) & (F.col("__l") == F.col("__r")) & overlaps(F.col("l_t0"), F.col("l_t1"), F.col("r_t0"), F.col("r_t1"))
    on &= node == F.call_function("shiftright", F.greatest("l_t0", "r_t0").cast("long"), level)
    return a.join(b, on).drop("__l", "__r")


def touching(left: DataFrame, right: DataFrame, key: str, anti: bool = False) -> DataFrame:
    """The left spans that some right span of their timeline overlaps, or with ``anti`` those that none does.

    One sorted pass over both sides, however many spans a timeline has: of the right spans that begin by then the latest
    end, and of the others the first begin tell it. A span that doesn't end after it begins touches nothing.
    """
    marks = right.where("t0 < t1").select(F.col(key), F.col("t0").alias("__at"), F.lit(0).alias("__side"), F.col("t0").alias("__t0"), F.col("t1").alias("__t1"))
    spans = left.withColumn("__at", F.col("t0")).withColumn("__side", F.lit(1))
    s = spread(spans.unionByName(marks, allowMissingColumns=True), key, "__at").carrying({"__ends": (F.max("__t1"), F.max)}, {"__begins": (F.min("__t0"), F.min)})
    w = s.window("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = s.window("__at", F.desc("__side")).rowsBetween(0, Window.unboundedFollowing)
    # of spans that begin at or before this one, the latest end; of those that begin after it, the first begin
    found = s.rows.withColumn("__end", F.greatest(F.max("__t1").over(w), "__ends")).withColumn("__next", F.least(F.min("__t0").over(ahead), "__begins")).where("__side = 1")
    hit = (F.col("t0") < F.col("t1")) & (F.coalesce(F.col("t0") < F.col("__end"), F.lit(False)) | F.coalesce(F.col("__next") < F.col("t1"), F.lit(False)))
    return found.where(~hit if anti else hit).select(*left.columns)


def holding_point(spans: DataFrame, points: DataFrame, key: str, margin: int = 40) -> DataFrame:
    """The spans that hold a point further than ``margin`` ms from both ends: one sorted pass, as for touching()."""
    marks = points.select(F.col(key), (F.col("t") - margin).alias("__at"), F.lit(0).alias("__side"), F.col("t").alias("__t"))
    both = spans.withColumn("__at", F.col("t0")).withColumn("__side", F.lit(-1)).unionByName(marks, allowMissingColumns=True)
    s = spread(both, key, "__at").carrying(after={"__later": (F.min("__t"), F.min)})
    ahead = s.window("__at", F.desc("__side")).rowsBetween(0, Window.unboundedFollowing)
    found = s.rows.withColumn("__next", F.least(F.min("__t").over(ahead), "__later")).where("__side = -1")
    return found.where(F.col("__next") < F.col("t1") - margin).select(*spans.columns)


def owners(items: DataFrame, spans: DataFrame, key: str, item: str, span: str, least: int = 50) -> DataFrame:
    """For each item the span that overlaps it most, if by more than ``least`` ms; the earliest of equal ones; else NULL."""
    pairs = overlapping(items.select(key, item, "t0", "t1"), spans.select(key, span, "t0", "t1"), key).withColumn("shared", overlap(F.col("l_t0"), F.col("l_t1"), F.col("r_t0"), F.col("r_t1"))).where(F.col("shared") > least)
    best = pairs.groupBy(F.col(f"l_{key}").alias(key), F.col(f"l_{item}").alias(item)).agg(F.min_by(F.struct(F.col(f"r_{span}").alias("s"), "shared"), F.struct(-F.col("shared"), F.col("r_t0"), F.col(f"r_{span}"))).alias("b"))
    return items.join(best, [key, item], "left").withColumn("owner", F.col("b.s")).withColumn("shared", F.coalesce("b.shared", F.lit(0))).drop("b")


def tiered(clips: DataFrame, windows: DataFrame, key: str, clip: str, window: str) -> DataFrame:
    """Per clip the windows of its best tier, overlaps of 10 ms or less left out.

    The first tier are windows of the clip's own part of the story that overlap it by at least 45 % of its length (400 to
    1000 ms), the second any windows of that part, the third the one window that overlaps most. A window is of another part
    if it begins over 200 ms before the clip, or over 400 ms into it and ends over 200 ms after it.
    """
    pairs = overlapping(clips.select(key, clip, "t0", "t1"), windows.select(key, window, "t0", "t1"), key)
    own = (F.col("r_t0") >= F.col("l_t0") - 200) & ~((F.col("r_t1") > F.col("l_t1") + 200) & (F.col("r_t0") > F.col("l_t0") + 400))
    pairs = pairs.select(F.col(f"l_{key}").alias(key), F.col(f"l_{clip}").alias(clip), F.col(f"r_{window}").alias(window), overlap(F.col("l_t0"), F.col("l_t1"), F.col("r_t0"), F.col("r_t1")).alias("shared"), F.greatest(F.lit(400), F.col("l_t1") - F.col("l_t0")).alias("span"), own.alias("own")).where("shared > 10")
    need = F.least(F.lit(1000), F.greatest(F.lit(400), F.bround(F.col("span") * 45 / 100)))
    tier = pairs.withColumn("tier", F.when(F.col("own") & (F.col("shared") >= need), 1).when(F.col("own"), 2).otherwise(3))
    best = Window.partitionBy(key, clip)
    ranked = tier.withColumn("best", F.min("tier").over(best)).withColumn("n", F.row_number().over(best.orderBy(F.desc("shared"), window)))
    return ranked.where((F.col("tier") == F.col("best")) & ((F.col("tier") < 3) | (F.col("n") == 1))).select(key, clip, window, "tier", "shared")


def as_of(points: DataFrame, marks: DataFrame, key: str, value: str) -> DataFrame:
    """For each point the value of the last mark of its timeline at or before it: one sorted pass, no join. A long timeline
    is cut into chunks, each of which knows the last mark before it."""
    both = points.withColumn("__mark", F.lit(0)).withColumn("__v", F.lit(None).cast(marks.schema[value].dataType)).unionByName(
        marks.select(key, "t", F.lit(-1).alias("__mark"), F.col(value).alias("__v")), allowMissingColumns=True
    )
    newest = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("t")))
    s = spread(both, key, "t").carrying({"__carried": (newest, last)})
    found = last("__v").over(s.window("t", "__mark").rowsBetween(Window.unboundedPreceding, 0))
    return s.rows.withColumn(value, F.coalesce(found, F.col("__carried").cast(marks.schema[value].dataType))).where("__mark = 0").drop("__mark", "__v", "__carried", "__chunk")


def nearest(points: DataFrame, anchors: DataFrame, key: str, point: str, radius: int) -> DataFrame:
    """For each point the nearest anchor within a radius (the earlier of two equally near); NULL if there is none."""
    a = anchors.select(F.col(key).alias("__k"), F.col("t").alias("anchor"), F.explode(F.array(*[F.floor(F.col("t") / radius) + d for d in (-1, 0, 1)])).alias("__b"))
    p = points.withColumn("__b0", F.floor(F.col("t") / radius))
    near = p.join(a, (F.col(key) == F.col("__k")) & (F.col("__b0") == F.col("__b")) & (F.abs(F.col("anchor") - F.col("t")) <= radius))
    best = near.groupBy(key, point).agg(F.min_by("anchor", F.struct(F.abs(F.col("anchor") - F.col("t")), F.col("anchor"))).alias("anchor"))
    return points.join(best, [key, point], "left")
