"""From proposed events to final ones: snapping, repair, forced splits, merging of remnants, cast changes, the end card.

Events are (key, t0, t1, kind, cast_reset) in ms. Every pass is a DataFrame of its own; the two that depend on what was
accepted before fold one timeline's events, of which a film has tens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.operators.sequences import gapless
from timeloom.plans.materialise import checkpointed

#: Fixed values in ms: how near a boundary must be to an anchor, and the least length of an event.
SNAP = 1500
LEAST = 2000
_EVENT = "struct<t0:bigint,t1:bigint,kind:string,cast_reset:boolean>"


def cleaned(proposed: DataFrame) -> DataFrame:
    """Proposals with usable times; kinds other than an end card are stories, a missing cast change is none."""
    kind = F.when(F.lower("kind") == "endcard", "endcard").otherwise("story")
    return proposed.where("t0 is not null and t1 > t0").withColumn("kind", kind).withColumn("cast_reset", F.coalesce(F.col("cast_reset").cast("boolean"), F.lit(False)))


def _ordered(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast(t).alias(c) for c, t in (("t0", "bigint"), ("t1", "bigint"), ("kind", "string"), ("cast_reset", "boolean"))]))).alias("es"))


def _unfolded(lists: DataFrame, key: str, es: Column) -> DataFrame:
    return lists.select(key, F.explode(es).alias("e")).select(key, "e.*")


def _with(e: Column, **changes: Column) -> Column:
    return F.struct(*[changes.get(c, e[c]).alias(c) for c in ("t0", "t1", "kind", "cast_reset")])


def _replace_last(acc: Column, e: Column) -> Column:
    return F.array_append(F.slice(acc, 1, F.size(acc) - 1), e)


def snapped(events: DataFrame, anchors: DataFrame, key: str, radius: int = SNAP) -> DataFrame:
    """Boundaries on the nearest anchor within ``radius`` and after the event before; a boundary without one goes."""
    lists = _ordered(events, key).join(anchors.groupBy(key).agg(F.array_sort(F.collect_set("t")).alias("ts")), key, "left")

    def add(acc, e):
        last = F.try_element_at(acc, F.lit(-1))
        near = F.filter(F.coalesce("ts", F.array().cast("array<bigint>")), lambda t: (F.abs(t - e["t0"]) <= radius) & (t > last["t0"]))
        best = F.array_min(F.transform(near, lambda t: F.struct(F.abs(t - e["t0"]).alias("d"), t.alias("t"))))["t"]
        joined = _replace_last(acc, _with(last, t1=e["t1"]))
        moved = F.array_append(_replace_last(acc, _with(last, t1=best)), _with(e, t0=best))
        return F.when(F.size(acc) == 0, F.array(e)).when(F.size(F.coalesce("ts", F.array().cast("array<bigint>"))) == 0, F.array_append(acc, e)).when(best.isNull(), joined).otherwise(moved)

    return _unfolded(lists, key, F.aggregate("es", F.array().cast(f"array<{_EVENT}>"), add))


def repaired(events: DataFrame, speech: DataFrame, hard: DataFrame, key: str) -> DataFrame:
    """Boundaries inside a sentence (t0, t1) on its nearer end, unless a hard cut (t) lies within 200 ms; both sides follow."""
    w = Window.partitionBy(key).orderBy("t0", "t1")
    numbered = events.withColumn("__n", F.row_number().over(w))
    cuts = numbered.where("__n > 1").select(key, "__n", F.col("t0").alias("cut"))
    h = hard.select(F.col(key).alias("__k"), F.col("t").alias("__h"))
    loose = cuts.join(h, (F.col(key) == F.col("__k")) & (F.abs(F.col("cut") - F.col("__h")) <= 200), "left_anti")
    s = speech.select(F.col(key).alias("__k"), F.col("t0").alias("s0"), F.col("t1").alias("s1"))
    inside = loose.join(s, (F.col(key) == F.col("__k")) & (F.col("cut") > F.col("s0") + 20) & (F.col("cut") < F.col("s1") - 20))
    moved = inside.groupBy(key, "__n", "cut").agg(F.min(F.struct("s0", "s1")).alias("s")).select(key, "__n", F.when(F.col("cut") - F.col("s.s0") <= F.col("s.s1") - F.col("cut"), F.col("s.s0")).otherwise(F.col("s.s1")).alias("to"))
    joined = numbered.join(moved, [key, "__n"], "left").withColumn("__to", F.col("to"))
    by = Window.partitionBy(key).orderBy("__n")
    fixed = joined.withColumn("__t1", F.coalesce(F.lead("__to").over(by), F.col("t1"))).withColumn("t0", F.coalesce("__to", "t0")).withColumn("t1", F.col("__t1"))
    return fixed.where("t1 - t0 >= 200").select(key, "t0", "t1", "kind", "cast_reset")


def covering(events: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """Events without gaps from 0 to the timeline's ``duration``, numbered e01, e02, ...; the first changes no cast."""
    laid = gapless(events.join(ends.select(key, "duration"), key), key, "duration", "kind", "cast_reset").drop("duration")
    return laid.withColumn("id", F.concat(F.lit("e"), F.lpad(F.col("n").cast("string"), 2, "0"))).withColumn("cast_reset", F.col("cast_reset") & (F.col("n") > 1)).drop("n")


def force_split(events: DataFrame, marks: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """Events cut at the marks (t) that lie further than ``least`` from both of their ends; only the first piece changes the cast."""
    m = marks.select(F.col(key).alias("__k"), F.col("t").alias("__t")).distinct()
    inside = events.join(m, (F.col(key) == F.col("__k")) & (F.col("__t") > F.col("t0") + least) & (F.col("__t") < F.col("t1") - least), "left")
    edges = inside.groupBy(key, "t0", "t1", "kind", "cast_reset").agg(F.array_sort(F.collect_set("__t")).alias("ts"))
    starts, stops = F.concat(F.array("t0"), "ts"), F.concat("ts", F.array("t1"))
    pieces = edges.select(key, "kind", "cast_reset", F.col("t0").alias("__a"), F.explode(F.arrays_zip(starts.alias("a"), stops.alias("b"))).alias("p"))
    return pieces.select(key, F.col("p.a").alias("t0"), F.col("p.b").alias("t1"), "kind", (F.col("cast_reset") & (F.col("p.a") == F.col("__a"))).alias("cast_reset"))


def merged(events: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """Stories shorter than ``least`` joined to the story before, or to the next one where they stand first."""

    def add(acc, e):
        last = F.try_element_at(acc, F.lit(-1))
        beside = (F.size(acc) > 0) & (last["kind"] != "endcard") & (e["kind"] != "endcard")
        back = _replace_last(acc, _with(last, t1=e["t1"]))
        ahead = _replace_last(acc, _with(e, t0=last["t0"], cast_reset=last["cast_reset"]))
        return F.when(F.coalesce(beside & (e["t1"] - e["t0"] < least), F.lit(False)), back).when(F.coalesce(beside & (last["t1"] - last["t0"] < least), F.lit(False)), ahead).otherwise(F.array_append(acc, e))

    return _unfolded(_ordered(events, key), key, F.aggregate("es", F.array().cast(f"array<{_EVENT}>"), add))


def cast_changes(events: DataFrame, shortlist: DataFrame, key: str, reason: str = "people", radius: int = SNAP) -> DataFrame:
    """Events that begin near a boundary with the reason change the cast; the first of a timeline never does."""
    marks = shortlist.where(F.array_contains("reasons", reason)).select(F.col(key).alias("__k"), F.col("t").alias("__t"))
    forced = events.join(marks, (F.col(key) == F.col("__k")) & (F.abs(F.col("__t") - F.col("t0")) <= radius), "left_semi").select(key, "t0").distinct().withColumn("__f", F.lit(True))
    first = F.row_number().over(Window.partitionBy(key).orderBy("t0", "t1", "cast_reset")) == 1
    return events.join(forced, [key, "t0"], "left").withColumn("cast_reset", ~first & (F.col("cast_reset") | F.coalesce("__f", F.lit(False)))).drop("__f")


def end_card_tails(windows: DataFrame, titles: DataFrame, tails: DataFrame, key: str, see: str = "(?i)end ?card|credits|logo") -> DataFrame:
    """The tails (key, t0, t1) that look like an end card: a title or a window that shows one comes before any window with
    people, or windows without people and none with."""
    w = windows.select(F.col(key).alias("__k"), F.col("t0").alias("w0"), F.col("t1").alias("w1"), "adults", "children", "action")
    over = tails.join(w, (F.col(key) == F.col("__k")) & (F.col("w0") < F.col("t1")) & (F.col("t0") < F.col("w1")), "left")
    people = F.coalesce("adults", F.lit(0)) + F.coalesce("children", F.lit(0))
    counted = F.col("adults").isNotNull() | F.col("children").isNotNull()
    facts = over.groupBy(key, "t0", "t1").agg(
        F.min(F.when(counted & (people > 0), F.col("w0"))).alias("peopled"),
        F.min(F.when(F.col("action").rlike(see), F.col("w0"))).alias("shown"),
        F.coalesce(F.bool_or(counted & (people == 0)), F.lit(False)).alias("empty"),
    )
    t = titles.where("trim(text) <> '' and region in ('title', 'top', 'upper')").select(F.col(key).alias("__k"), F.col("t0").alias("s0"), F.col("t1").alias("s1"))
    titled = tails.join(t, (F.col(key) == F.col("__k")) & (F.col("s0") < F.col("t1")) & (F.col("t0") < F.col("s1")), "left_semi").select(key).distinct().withColumn("titled", F.lit(True))
    title = F.coalesce("titled", F.lit(False))
    shown = F.col("shown").isNotNull() & (F.col("peopled").isNull() | (F.col("shown") <= F.col("peopled")))
    return facts.join(titled, key, "left").where(title | shown | (F.col("peopled").isNull() & F.col("empty"))).select(key, "t0", "t1")


def split_end_card(events: DataFrame, speech: DataFrame, windows: DataFrame, titles: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """The tail after the last sentence as an end card of its own, where it looks like one; talk is never an end card."""
    last = speech.groupBy(key).agg(F.max("t1").alias("__last"))
    known = events.join(last, key, "left").withColumn("__last", F.coalesce("__last", F.lit(0)))
    spoken = known.withColumn("kind", F.when((F.col("kind") == "endcard") & (F.col("t0") < F.col("__last")), "story").otherwise(F.col("kind")))
    tails = ends.join(last, key).where("__last > 200 and duration - __last >= 300").select(key, F.col("__last").alias("t0"), F.col("duration").alias("t1"))
    cut = end_card_tails(windows, titles, tails, key).select(key, F.col("t0").alias("__cut"))
    both = spoken.drop("__last").join(cut, key, "left")
    pieces = F.when(F.col("__cut").isNull() | (F.col("t1") <= F.col("__cut") + 20), F.array(F.struct("t0", "t1", "kind", "cast_reset")))
    card = lambda a: F.struct(a.alias("t0"), F.col("t1"), F.lit("endcard").alias("kind"), F.lit(False).alias("cast_reset"))
    head = F.struct(F.col("t0"), F.col("__cut").alias("t1"), F.lit("story").alias("kind"), F.col("cast_reset"))
    pieces = pieces.when(F.col("t0") >= F.col("__cut") - 20, F.array(card(F.col("t0")))).otherwise(F.array(head, card(F.col("__cut"))))
    return both.select(key, F.explode(pieces).alias("p")).select(key, "p.*")


def finalised(proposed: DataFrame, anchors: DataFrame, shortlist: DataFrame, hard: DataFrame, speech: DataFrame, windows: DataFrame, titles: DataFrame, ends: DataFrame, key: str = "job_id") -> DataFrame:
    """All passes in their order. Passes that read their events twice hand on a table, so that no plan doubles with each."""
    marks = shortlist.where(F.array_contains("reasons", "title")).select(key, "t")
    steps = (
        lambda e: snapped(cleaned(e), anchors, key),
        lambda e: checkpointed(repaired(checkpointed(e), speech, hard, key)),
        lambda e: covering(e, ends, key),
        lambda e: force_split(e, marks, key),
        lambda e: merged(e, key),
        lambda e: checkpointed(repaired(checkpointed(e), speech, hard, key)),
        lambda e: checkpointed(covering(e, ends, key)),
        lambda e: checkpointed(cast_changes(e, shortlist, key)),
        lambda e: split_end_card(e, speech, windows, titles, ends, key),
        lambda e: merged(e, key),
        lambda e: covering(e, ends, key),
    )
    return reduce(lambda e, step: step(e), steps, proposed)


def merged_shots(shots: DataFrame, key: str, least: int = 400) -> DataFrame:
    """Shots shorter than ``least`` joined to the one before (the first to none), numbered shot_001, ..."""

    def add(acc, e):
        return F.when((F.size(acc) > 0) & (e["t1"] - e["t0"] < least), _replace_last(acc, F.struct(F.try_element_at(acc, F.lit(-1))["t0"].alias("t0"), e["t1"].alias("t1")))).otherwise(F.array_append(acc, e))

    lists = shots.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("t0").cast("bigint").alias("t0"), F.col("t1").cast("bigint").alias("t1")))).alias("es"))
    rows = lists.select(key, F.posexplode(F.aggregate("es", F.array().cast("array<struct<t0:bigint,t1:bigint>>"), add)).alias("i", "e"))
    return rows.select(key, F.concat(F.lit("shot_"), F.lpad((F.col("i") + 1).cast("string"), 3, "0")).alias("id"), "e.t0", "e.t1")
