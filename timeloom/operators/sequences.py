"""Ordered scans of timelines: lags, carries, islands, and folds where a result depends on rows accepted before.

A fold never takes a whole timeline at once: wherever a gap makes the state fall back to its start, the timeline is cut
first, by window functions, and only the islands between are folded. An island may still be a whole timeline, so the
folds of points and of fuzzy sessions stream its sorted rows and keep only their state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from timeloom.functions.ratio import reaches, squeeze
from timeloom.operators.scans import Spread, running, spread


def islands(points: DataFrame, key: str, gap: int, t: str = "t", name: str = "island") -> DataFrame:
    """Number the runs of points of a timeline whose neighbours are at most ``gap`` ms apart. A long timeline is cut into
    chunks, each of which knows the last point before it and the islands that begin before it."""
    s = spread(points, key, t)
    w = s.window(t)
    if s.cut:
        s = s.carrying({"__previous": (F.max(t), F.max)})
        w = s.window(t)
    before = F.lag(t).over(w)
    far = F.coalesce((F.col(t) - (F.coalesce(before, F.col("__previous")) if s.cut else before) > gap).cast("int"), F.lit(1))
    marked = Spread(s.rows.withColumn("__far", far), key, s.cut)
    inside = F.sum("__far").over(w.rangeBetween(Window.unboundedPreceding, 0))
    if not s.cut:
        return marked.rows.withColumn(name, inside).drop("__far")
    # of rows without a time each is far from the others, as in an uncut timeline; they come first
    marked = marked.carrying({"__begun": (F.sum("__far"), F.sum)})
    return marked.rows.withColumn(name, inside + F.coalesce("__begun", F.lit(0))).drop("__far", "__begun", "__previous", "__chunk")


def _in_order(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The rows of each island side by side and in order, so that a task can fold them as they stream by."""
    return rows.repartition(key, "island").sortWithinPartitions(key, "island", *order)


def _folded(points: DataFrame, key: str, gap: int, keep: Callable[[int, int], bool]) -> DataFrame:
    """(key, t) of the points that start something: a point does if keep(last started, point).

    Points stream by in order, and only the last one that started something is kept, however dense an island is.
    """
    cut = islands(points.select(key, "t").where("t is not null").distinct(), key, gap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, 0
        for batch in batches:
            started = []
            for i, (k, t, island) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if (k, island) != at or keep(last, t):
                    at, last = (k, island), t
                    started.append(i)
            yield batch.take(pa.array(started, pa.int64())).select([0, 1])

    ordered = _in_order(cut.select(key, "t", "island"), key, "t")
    return ordered.mapInArrow(run, ordered.select(key, "t").schema)


def anchored_clusters(points: DataFrame, key: str, radius: int) -> DataFrame:
    """Points with ``anchor``, the first member of their cluster: a new one begins further than ``radius`` ms from the anchor.

    A gap of more than ``radius`` always begins a cluster, so clusters are found within islands.
    """
    from timeloom.operators.intervals import as_of

    anchors = _folded(points, key, radius, lambda last, t: t - last > radius).withColumn("anchor", F.col("t"))
    return as_of(points, anchors, key, "anchor")


def thinned(points: DataFrame, key: str, least: int) -> DataFrame:
    """(key, t) of the points kept by a scan that drops what lies less than ``least`` ms after the last point kept."""
    return _folded(points, key, least - 1, lambda last, t: t - last >= least)


def last_per_slot(rows: DataFrame, key: str, step: int, order: str) -> DataFrame:
    """One row for each slot of ``step`` ms of a timeline: the last one in order, with ``slot``."""
    slotted = rows.withColumn("slot", F.floor(F.col("t") / step))
    w = Window.partitionBy(key, "slot").orderBy(F.desc("t"), F.desc(order))
    return slotted.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def boolean_islands(rows: DataFrame, key: str, flag: str, order: str, hole: int = 0, least: int = 1) -> DataFrame:
    """Runs of true rows as (key, first, last, n): holes of up to ``hole`` rows close, runs of fewer than ``least`` rows go."""
    placed = running(rows.select(key, flag, order), key, order, F.lit(1), "__n", False).where(F.col(flag))
    runs = islands(placed, key, hole + 1, "__n", "__run")
    return runs.groupBy(key, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), (F.max("__n") - F.min("__n") + 1).alias("n")).where(F.col("n") >= least).drop("__run")


def groups_by_reset(rows: DataFrame, key: str, order: str, reset: Column, name: str = "group_id") -> DataFrame:
    """Number the groups of a timeline that begin at its first row and at every reset."""
    return running(rows, key, order, F.coalesce(reset.cast("int"), F.lit(0)), name)


def canonical(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The first value of a group that is neither NULL nor empty, on all of its rows."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn(name, F.first(F.nullif(F.col(value), F.lit("")), ignorenulls=True).over(w))


def offsets(rows: DataFrame, key: str, order: str, length: str) -> DataFrame:
    """Rows laid end to end: ``cat0`` and ``cat1`` are where each begins and ends."""
    return running(rows, key, order, F.col(length), "cat1", False).withColumn("cat0", F.col("cat1") - F.col(length))


def gapless(spans: DataFrame, key: str, end: str, *ties: str) -> DataFrame:
    """Spans in order without gaps or overlaps: the first begins at 0, each at the end of the one before, the last ends at ``end``.
    Of spans with the same times only the last is left (and the first of a timeline); ``ties`` order them."""
    s = spread(spans, key, "t0")
    s = s.carrying({"__some": (F.count("*"), F.sum)}, {"__following": (F.min("t0"), F.min)})
    w = s.window("t0", "t1", *ties)
    following = F.coalesce(F.lead("t0").over(w), F.col("__following").cast(spans.schema["t0"].dataType))
    first = F.lag("t0").over(w).isNull() & F.col("__some").isNull()
    fixed = s.rows.withColumn("__t1", F.when(following.isNull(), F.col(end)).otherwise(following)).withColumn("__t0", F.coalesce(F.when(first, F.lit(0)), F.col("t0")))
    fixed = fixed.withColumn("t0", F.col("__t0")).withColumn("t1", F.col("__t1")).drop("__t0", "__t1", "__some", "__following", "__chunk").where("t1 > t0")
    return running(fixed, key, "t0", F.lit(1), "n", False)


def lookback_merge(rows: DataFrame, key: str, gap: int = 1500) -> DataFrame:
    """Rows (key, ord, t, text): a text that stands in one of the last two rows at most ``gap`` ms before extends that row.

    Rows stream by in order, and only the last two are kept; islands of rows that close together are dealt out apart.
    """
    cut = islands(rows, key, gap)
    ordered = _in_order(cut.select(key, "island", "ord", F.col("t").cast("long").alias("t"), "text"), key, "ord", "t", F.asc_nulls_first("text"))
    out = StructType([ordered.schema[key], StructField("t0", LongType()), StructField("t1", LongType()), StructField("text", StringType())])
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_ = None, []
        made = lambda found: pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kinds.types[i]) for i in range(4)], schema=kinds)
        for batch in batches:
            found = []
            for k, island, _, t, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, island) != at:
                    found += open_
                    at, open_ = (k, island), []
                same = next((r for r in reversed(open_) if text is not None and r[3] == text and t - r[2] <= gap), None)
                if same is not None:
                    same[2] = t
                    continue
                open_.append([k, t, t, text])
                if len(open_) > 2:
                    found.append(open_.pop(0))
            yield made(found)
        yield made(open_)

    return ordered.mapInArrow(run, out)


def fuzzy_sessions(hits: DataFrame, keys: list[str], step: int, least: float = 0.72) -> DataFrame:
    """Sessions of similar texts in each lane (``keys``) of hits (t, text): a hit joins the open session if its text is
    similar enough and it comes at most 1.5 steps and 350 ms after the session's end. The longest text stands for all.

    A longer pause closes every session, so lanes are cut there. Hits stream by in order with the open session as state.
    """
    slack = int(1.5 * step + 350)
    lane = hits.withColumn("__lane", F.to_json(F.struct(*keys)))
    cut = islands(lane, "__lane", slack + step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, kinds = None, None, None

        def closed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, kinds)

        for batch in batches:
            if kinds is None:
                kinds = pa.schema([*(batch.schema.field(k) for k in keys), ("t0", pa.int64()), ("t1", pa.int64()), ("text", pa.string()), ("n", pa.int64())])
            out = []
            for row in batch.to_pylist():
                text, here = row["text"] or "", (row["__lane"], row["island"])
                if here == at and row["t"] - last["t1"] <= slack and reaches(squeeze(last["text"]), squeeze(text), least):
                    last["t1"] = row["t"] + step
                    last["n"] += 1
                    if len(text) > len(last["text"]):
                        last["text"] = text
                else:
                    if last is not None:
                        out.append(last)
                    at, last = here, {**{k: row[k] for k in keys}, "t0": row["t"], "t1": row["t"] + step, "text": text, "n": 1}
            yield closed(out)
        if last is not None:
            yield closed([last])

    ordered = _in_order(cut.select(*keys, "t", "text", "__lane", "island"), "__lane", "t", F.asc_nulls_last("text"))
    kinds = ", ".join(f"`{c}` {hits.schema[c].dataType.simpleString()}" for c in keys)
    return ordered.mapInArrow(run, f"{kinds}, t0 long, t1 long, text string, n long")


def greedy_match(speech: DataFrame, seen: DataFrame, key: str, score: Callable[[str, str], Column], least: float = 0.55, shared: int = 120, bound: Callable[[str, str], Column] | None = None) -> DataFrame:
    """One-to-one matches of spans (key, id, t0, t1, text): spoken ones in order of time take the best-scored span seen
    that shares at least ``shared`` ms and is still free, if it scores ``least``. A row for each spoken span that has
    text: (key, id, t0, t1, text, match, seen, score); without a match ``match`` and ``seen`` are NULL and ``score`` is 0.

    Pairs that score less can't be accepted and so can't disturb others; where a ``bound`` of the score is known, only pairs
    whose bound allows it are scored. The rest stream by in chains of pairs whose
    times meet. What is taken is kept only until the spoken spans have passed it.
    """
    from timeloom.operators.intervals import overlapping, overlap

    said = speech.select(key, "id", "t0", "t1", "text").where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    pairs = overlapping(said, seen.select(key, "id", "t0", "t1", "text"), key)
    pairs = pairs.where(overlap(F.col("l_t0"), F.col("l_t1"), F.col("r_t0"), F.col("r_t1")) >= shared)
    if bound is not None:
        pairs = pairs.where(bound("l_text", "r_text") >= least - 1e-9)
    pairs = pairs.withColumn("score", score("l_text", "r_text")).where(F.col("score") >= least)
    pairs = pairs.select(F.col(f"l_{key}").alias(key), "l_id", "l_t0", "r_id", "r_t1", "score", F.least("l_t0", "r_t0").alias("__a"), F.greatest("l_t1", "r_t1").alias("__z"))
    w = Window.partitionBy(key).orderBy("__a", "l_t0", "l_id", "r_id")
    before = F.max("__z").over(w.rowsBetween(Window.unboundedPreceding, -1))
    chains = pairs.withColumn("__far", F.coalesce((F.col("__a") >= before).cast("int"), F.lit(1))).withColumn("island", F.sum("__far").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, one, used = None, None, {}
        for batch in batches:
            taken = []
            for i, (k, island, t0, left, right, t1) in enumerate(zip(*(batch.column(c).to_pylist() for c in (key, "island", "l_t0", "l_id", "r_id", "r_t1")), strict=True)):
                if (k, island) != at:
                    at, one, used = (k, island), None, {}
                if left != one and right not in used:
                    one = left
                    used[right] = t1
                    taken.append(i)
                    if len(used) > 1024:
                        used = {r: t for r, t in used.items() if t > t0}
            yield batch.take(pa.array(taken, pa.int64())).select([key, "l_id", "r_id", "score"])

    ordered = _in_order(chains.select(key, "island", "l_t0", "l_id", "r_id", "r_t1", "score"), key, "l_t0", "l_id", F.desc("score"), "r_id")
    found = ordered.mapInArrow(run, ordered.select(key, "l_id", "r_id", "score").schema).select(F.col(key), F.col("l_id").alias("id"), F.col("r_id").alias("match"), "score")
    words = seen.select(key, F.col("id").alias("match"), F.col("text").alias("seen"))
    return said.join(found, [key, "id"], "left").join(words, [key, "match"], "left").select(key, "id", "t0", "t1", "text", "match", "seen", F.coalesce("score", F.lit(0.0)).alias("score"))
