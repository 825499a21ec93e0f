"""Windows of a film that were looked at: parsing, flags, ticks, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions import text as tx
from timeloom.operators.intervals import overlapping

_BEAT = "action string, adults string, children string, has_text boolean, cells array<struct<t:string,see:string>>, unsure array<string>"


def parsed(raw: Column) -> Column:
    """A window's answer as a struct; fields that are missing or broken are NULL, an action without cells becomes cells by
    its clauses, and cells that only a pattern finds are salvaged."""
    doc = F.from_json(F.coalesce(tx.json_payload(raw), F.lit("{}")), _BEAT)
    numbers = {n: F.coalesce(doc[n].try_cast("int"), tx.salvaged_count(raw, n)) for n in ("adults", "children")}
    action = F.coalesce(F.nullif(doc["action"], F.lit("")), tx.salvaged_field(raw, "action"))
    cells = F.transform(doc["cells"], lambda c: F.struct(tx.salvaged_number(c["t"]).alias("t"), c["see"].alias("see")))
    clauses = F.transform(F.split(action, "[；;]"), lambda s: F.struct(F.lit(None).cast("double").alias("t"), tx.trimmed(s).alias("see")))
    some = lambda c: F.when(F.size(c) > 0, c)
    return F.struct(action.alias("action"), *[c.alias(n) for n, c in numbers.items()], F.coalesce(doc["has_text"], F.lit(False)).alias("has_text"), F.coalesce(some(cells), some(tx.salvaged_cells(raw)), clauses).alias("cells"), doc["unsure"].alias("unsure"))


def failed(raw: Column, error: Column) -> Column:
    """A window without an answer, or with an error, failed."""
    return F.coalesce(raw, F.lit("")).eqNullSafe("") | (F.coalesce(error, F.lit("")) != "")


def flags(windows: DataFrame, cuts: DataFrame, speech: DataFrame, texts: DataFrame, key: str, margin: int = 40) -> DataFrame:
    """Windows (key, ord, t0, t1, adults, children, has_text, error) with what speaks for another look: a hard cut inside,
    other people than before, two lines of speech or more, text seen but not read or read but not seen. An error stands alone."""
    w = Window.partitionBy(key).orderBy("ord")
    people = F.col("adults") + F.coalesce("children", F.lit(0))
    rows = windows.withColumn("__changed", people != F.lag(people).over(w))

    spans = windows.select(key, "ord", "t0", "t1")
    inner = windows.select(key, "ord", (F.col("t0") + margin + 1).alias("t0"), (F.col("t1") - margin).alias("t1"))
    points = cuts.select(key, F.col("t").alias("t0"), (F.col("t") + 1).alias("t1"))

    def counted(mine: DataFrame, other: DataFrame, name: str) -> DataFrame:
        pairs = overlapping(mine, other.select(key, "t0", "t1"), key)
        return pairs.groupBy(F.col(f"l_{key}").alias(key), F.col("l_ord").alias("ord")).agg(F.count("*").alias(name))

    joined = rows
    for mine, other, name in ((inner, points, "n_cuts"), (spans, speech, "n_speech"), (spans, texts.where("trim(text) <> ''"), "n_texts")):
        joined = joined.join(counted(mine, other, name), [key, "ord"], "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    tests = ((n("n_cuts") > 0, "cut"), (F.col("__changed"), "people"), (n("n_speech") >= 2, "speech"), ((n("n_texts") > 0) != F.coalesce("has_text", F.lit(False)), "text"))
    found = F.filter(F.array(*[F.when(t, F.lit(name)) for t, name in tests]), lambda x: x.isNotNull())
    return joined.select(*windows.columns, F.when(F.coalesce("error", F.lit("")) != "", F.array(F.lit("error"))).otherwise(found).alias("flags"))


def ticks(ends: DataFrame, windows: DataFrame, texts: DataFrame, key: str, step: int = 250) -> DataFrame:
    """A row for every ``step`` ms of a timeline (key, duration): the first window (ord, t0, t1, adults, children, cells) that
    holds it, the nearest of its cells (within half a step), and the distinct texts (ord, t0, t1, text) on screen, in order."""
    grid = ends.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("duration") / step).cast("long") - 1))).alias("i")).select(key, (F.col("i") * step).alias("t"))
    points = grid.select(key, F.col("t").alias("t0"), (F.col("t") + 1).alias("t1"))
    at = lambda pairs, *more: pairs.groupBy(F.col(f"l_{key}").alias(key), F.col("l_t0").alias("t"), *more)
    met = overlapping(points, windows.select(key, "ord", "t0", "t1", "adults", "children", "cells"), key)
    first = at(met).agg(F.min_by(F.struct(*[F.col(f"r_{c}").alias(c) for c in ("adults", "children", "cells")]), "r_ord").alias("w"))
    held = grid.join(first, [key, "t"], "left")
    near = F.filter(F.transform("w.cells", lambda c, i: F.struct(F.abs(c["t"] * 1000 - F.col("t")).alias("d"), i.alias("i"), c["see"].alias("see"))), lambda c: c["d"] <= step / 2 + 10)
    shown = texts.select(key, "ord", "t0", (F.greatest(F.col("t1"), F.col("t0") + 1) + step // 2).alias("t1"), "text")
    each = at(overlapping(points, shown, key), F.col("r_text").alias("text")).agg(F.min("r_ord").alias("o"))
    read = each.groupBy(key, "t").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "text"))), lambda y: y["text"]), " / ").alias("read"))
    return held.join(read, [key, "t"], "left").select(key, "t", "w.adults", "w.children", F.array_min(near)["see"].alias("see"), F.coalesce("read", F.lit("")).alias("read"))


def complete(windows: DataFrame, ends: DataFrame, key: str, hop: int = 2500) -> DataFrame:
    """Whether the windows of a timeline cover it: starts at most a hop and 100 ms apart, the last end within 600 ms of the
    timeline's, none failed. A timeline without windows isn't covered."""
    w = Window.partitionBy(key).orderBy("t0")
    step = windows.withColumn("__gap", F.lead("t0").over(w) - F.col("t0"))
    facts = step.groupBy(key).agg(F.coalesce(F.max("__gap"), F.lit(0)).alias("gap"), F.max("t1").alias("last"), F.bool_or(failed(F.col("raw"), F.col("error"))).alias("failed"))
    good = (F.col("gap") <= hop + 100) & (F.col("last") >= F.col("duration") - 600) & ~F.col("failed")
    return ends.join(facts, key, "left").select(key, F.coalesce(good, F.lit(False)).alias("complete"))


def summary(windows: DataFrame, key: str) -> DataFrame:
    """Windows, failed ones, and the share that succeeded, to four places."""
    bad = F.count_if(failed(F.col("raw"), F.col("error")))
    return windows.groupBy(key).agg(F.count("*").alias("total"), bad.alias("failed"), F.round(1 - bad / F.count("*"), 4).alias("rate"))


def events_done(jobs: DataFrame, events: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Whether the events of each job are final: it has some, and windows of which none failed."""
    some = events.groupBy(key).agg(F.count("*").alias("__events"))
    bad = windows.groupBy(key).agg(F.bool_or(failed(F.col("raw"), F.col("error"))).alias("__failed"))
    joined = jobs.select(key).join(some, key, "left").join(bad, key, "left")
    return joined.select(key, (F.col("__events").isNotNull() & ~F.coalesce("__failed", F.lit(True))).alias("done"))
