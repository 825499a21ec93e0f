"""Boundaries of a timeline from several signals: candidates, scores, clusters and the shortlist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions import text as tx
from timeloom.operators.sequences import anchored_clusters

# Weights of the reasons for a boundary (any other reason counts 1), and the roles they have.
WEIGHTS = {"tail-cut": 4, "tail-silent": 3, "people": 2, "cut": 2, "title": 2, "gap": 1}
ALWAYS_KEPT = ("title", "cut", "tail-cut")
LIMIT_EXEMPT = ("title", "cut", "tail-cut", "tail-silent")
HARD = ("cut", "tail-cut")


def score(reasons: Column) -> Column:
    """The weights of the distinct reasons, added up."""
    weights = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.aggregate(F.array_distinct(reasons), F.lit(0), lambda acc, r: acc + F.coalesce(F.try_element_at(weights, r), F.lit(1)))


def candidates(signals: DataFrame, key: str, end: str | None = None, edge: int = 150) -> DataFrame:
    """(key, t, reasons) from signals (key, t, reason): the sorted distinct reasons at each time; points near an end are left out."""
    inside = signals if end is None else signals.where((F.col("t") > edge) & (F.col("t") < F.col(end) - edge))
    return inside.groupBy(key, "t").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def title_changes(titles: DataFrame, key: str) -> DataFrame:
    """(key, t) where fewer than half of the lines of a title (key, t, text) are like any line of the title before it. Lines
    are like each other if they are the same title, as reading jitters; empty ones don't count."""
    lines = titles.select(key, "t", tx.bare_title(F.col("text")).alias("text")).where("text <> ''")
    blocks = lines.groupBy(key, "t").agg(F.array_sort(F.collect_set("text")).alias("lines"))
    before = blocks.withColumn("old", F.lag("lines").over(Window.partitionBy(key).orderBy("t"))).where("old is not null")
    pairs = before.select(key, "t", F.explode("lines").alias("line"), "old").select(key, "t", "line", F.explode("old").alias("o"))
    like = pairs.withColumn("same", tx.same_title(F.col("line"), F.col("o"))).groupBy(key, "t", "line").agg(F.bool_or("same").alias("same"))
    return like.groupBy(key, "t").agg(F.count_if("same").alias("hits"), F.count("*").alias("n")).where("hits * 2 < n").select(key, "t")


def story_signals(cuts: DataFrame, speech: DataFrame, windows: DataFrame, titles: DataFrame, ends: DataFrame, key: str = "job_id") -> DataFrame:
    """The five signals of a film as (key, t, reason): cuts (after the last speech they are tail cuts), changes of the
    number of people, pauses of speech (at their middle), changes of the title, and a tail without speech.

    cuts (t), speech (t0, t1), windows (ord, t0, adults, children), titles (t, text), ends (duration).
    """
    last = speech.groupBy(key).agg(F.max("t1").alias("__last"))
    tail = F.coalesce("__last", F.lit(0))
    hard = cuts.join(last, key, "left").select(key, "t", F.when((tail > 200) & (F.col("t") > tail + 500), "tail-cut").otherwise("cut").alias("reason"))
    by_order = Window.partitionBy(key).orderBy("ord")
    people = windows.select(key, "ord", F.col("t0").alias("t"), (F.col("adults") + F.coalesce("children", F.lit(0))).alias("p"))
    people = people.withColumn("q", F.lag("p").over(by_order)).where("p <> q").select(key, "t", F.lit("people").alias("reason"))
    by_start = Window.partitionBy(key).orderBy("t0", "t1")
    pauses = speech.withColumn("e", F.lag("t1").over(by_start)).where("t0 - e >= 350").select(key, F.floor((F.col("t0") + F.col("e")) / 2).alias("t"), F.lit("gap").alias("reason"))
    changed = title_changes(titles, key).select(key, "t", F.lit("title").alias("reason"))
    silent = ends.join(last, key).where("duration - __last >= 400").select(key, F.col("__last").alias("t"), F.lit("tail-silent").alias("reason"))
    return reduce(DataFrame.unionByName, [x.withColumn("t", F.col("t").cast("long")) for x in (hard, people, pauses, changed, silent)])


def shortlist(found: DataFrame, key: str, radius: int, limit: int = 40) -> DataFrame:
    """One boundary for each anchored cluster of candidates (key, t, reasons): the union of its reasons with their score,
    at the time of its best member (by score, then a hard cut, then the earliest). Kept are those with a reason that
    always counts or a score of at least 3; beyond the ones exempt, only the best ``limit`` of a timeline.
    """
    has = lambda c, names: F.arrays_overlap(c, F.array(*[F.lit(n) for n in names]))
    clustered = anchored_clusters(found, key, radius).withColumn("own", score(F.col("reasons")))
    merged = clustered.groupBy(key, "anchor").agg(
        F.min_by("t", F.struct(-F.col("own"), (~has(F.col("reasons"), HARD)).cast("int"), F.col("t"))).alias("t"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"),
    )
    scored = merged.withColumn("score", score(F.col("reasons"))).where(has(F.col("reasons"), ALWAYS_KEPT) | (F.col("score") >= 3))
    exempt = has(F.col("reasons"), LIMIT_EXEMPT)
    w = Window.partitionBy(key)
    room = F.greatest(F.lit(0), F.lit(limit) - F.sum(exempt.cast("int")).over(w))
    ranked = scored.withColumn("exempt", exempt).withColumn("room", room).withColumn("rank", F.row_number().over(w.orderBy("exempt", F.desc("score"), "t")))
    return ranked.where(F.col("exempt") | (F.col("rank") <= F.col("room"))).select(key, "t", "reasons", "score")


def anchors(found: DataFrame, names: tuple[str, ...] = LIMIT_EXEMPT) -> DataFrame:
    """The candidates with a strong reason, with their score."""
    return found.where(F.arrays_overlap("reasons", F.array(*[F.lit(n) for n in names]))).withColumn("score", score(F.col("reasons")))


def strong_count(reasons: Column, names: tuple[str, ...] = LIMIT_EXEMPT) -> Column:
    """How many strong reasons a boundary has."""
    return F.size(F.array_intersect(reasons, F.array(*[F.lit(n) for n in names])))
