"""Delivery: what plays of each clip, where subtitles go once the speech of the output is known, what fits into a mail."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StructField, StructType

from timeloom.operators.intervals import overlapping
from timeloom.operators.sequences import offsets


def play_seconds(source: Column, legal: Column, override: Column) -> Column:
    """What plays of a clip: an override up to the clip's length, or else the shorter of source and clip."""
    return F.when(override > 0, F.least(override, legal)).otherwise(F.least(source, legal))


def trim_line(source: Column, legal: Column) -> Column:
    """Where a padded clip is cut; NULL if it isn't padded."""
    return F.when(legal > source + 0.05, source)


def concat_spans(clips: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Clips (key, n, id, t0, t1, seconds) laid end to end: source span, play time in ms and output span."""
    joined = clips.join(overrides.select(key, "id", "play"), [key, "id"], "left")
    play = F.bround(play_seconds((F.col("t1") - F.col("t0")) / 1000, F.col("seconds"), F.col("play")) * 1000).cast("long")
    return offsets(joined.withColumn("play_ms", play), key, "n", "play_ms").select(key, "n", "id", F.col("t0").alias("src0"), (F.col("t0") + F.col("play_ms")).alias("src1"), "play_ms", "cat0", "cat1")


def aligned_subtitles(events: DataFrame, islands: DataFrame, key: str, radius: int = 1500) -> DataFrame:
    """Subtitles (key, ord, style, t0, t1, text) moved onto islands of speech (t0, t1), each used once.

    A bottom line takes the free island whose middle is nearest, within ``radius``, or else the nearest free one inside its
    own span (span0, span1); it begins 80 ms before and ends 120 ms after, unless that would cross the line before.

    Lines meet the islands that they may take as spans that overlap; then lines stream by in order, each with its islands by
    preference, and what is kept is the islands taken and the end of the line before.
    """
    last = lambda t, least: F.greatest(t, least + 1)
    mid, line = F.col("t0") + F.col("t1"), (F.col("style") == "bottom") & (F.col("t1") - F.col("t0") > 50)
    near = F.floor(mid / 2) - radius, F.floor(mid / 2) + radius + 1
    low, high = F.least(near[0], F.coalesce(F.col("span0") - 300, near[0])), F.greatest(near[1], F.coalesce(F.col("span1") + 300, near[1]))
    reach = events.where(line).select(key, "ord", "span0", "span1", mid.alias("mid"), low.cast("long").alias("t0"), high.cast("long").alias("t1"))
    # an island is met where its middle lies, or anywhere inside the span
    spots = islands.select(key, F.col("t0").cast("long").alias("t0"), last(F.col("t1").cast("long"), F.col("t0").cast("long")).alias("t1"), F.col("t1").cast("long").alias("b")).distinct()
    met = overlapping(reach, spots, key)
    apart = F.abs(F.col("r_t0") + F.col("r_b") - F.col("l_mid"))
    inside = (F.col("r_t0") >= F.col("l_span0") - 300) & (F.col("r_b") <= F.col("l_span1") + 300)
    may = met.select(F.col(f"l_{key}").alias("__k"), F.col("l_ord").alias("__o"), F.when(apart < 2 * radius, 0).when(inside, 1).alias("__rank"), apart.alias("__apart"), F.col("r_t0").alias("__a"), F.col("r_b").alias("__b")).where("__rank is not null")
    rows = events.select(key, F.col("ord").cast("long").alias("ord"), "style", F.col("t0").cast("long").alias("t0"), F.col("t1").cast("long").alias("t1"), "text")
    joined = rows.join(may, F.col(key).eqNullSafe(F.col("__k")) & (F.col("ord") == F.col("__o")), "left").drop("__k", "__o")
    out = StructType([*rows.schema.fields, StructField("moved", BooleanType())])
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, taken, before, done, choices = None, set(), None, None, []

        def settled() -> list:
            """The line that has gone by, with the island it takes."""
            nonlocal before
            k, n, style, t0, t1, text = done
            moved, best = False, next((c for c in choices if c not in taken), None)
            if best is not None:
                taken.add(best)
                if before is None or max(0, best[0] - 80) >= before - 10:
                    t0, t1, moved = max(0, best[0] - 80), best[1] + 120, True
            before = t1
            return [k, n, style, t0, t1, text, moved]

        for batch in batches:
            found = []
            for *line, rank, _, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if line != done:
                    if done is not None:
                        found.append(settled())
                    if done is None or line[0] != at:
                        at, taken, before = line[0], set(), None
                    done, choices = line, []
                if rank is not None:
                    choices.append((a, b))
            yield pa.RecordBatch.from_pydict({c: [x[i] for x in found] for i, c in enumerate(names)}, kinds)
        if done is not None:
            yield pa.RecordBatch.from_pydict({c: [x] for c, x in zip(names, settled(), strict=True)}, kinds)

    kinds = to_arrow_schema(out)
    ordered = joined.repartition(key).sortWithinPartitions(key, "ord", "t0", "t1", "text", "style", "__rank", "__apart", "__a", "__b")
    return ordered.mapInArrow(run, out)


def fitting(files: DataFrame, key: str, budget: int) -> DataFrame:
    """Files (key, ord, size) that go into a mail in order: one that would exceed the budget is left out, later ones may fit."""
    lists = files.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", F.col("size").cast("bigint").alias("size")))).alias("xs"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<ord:bigint,fits:boolean>>").alias("out"))

    def add(acc, x):
        fits = acc["used"] + x["size"] <= budget
        return F.struct((acc["used"] + F.when(fits, x["size"]).otherwise(0)).alias("used"), F.array_append(acc["out"], F.struct(x["ord"].cast("bigint").alias("ord"), fits.alias("fits"))).alias("out"))

    return lists.select(key, F.explode(F.aggregate("xs", start, add, lambda acc: acc["out"])).alias("x")).select(key, "x.*")


def speech_over_trim(islands: DataFrame, lines: DataFrame, keys: list[str], slack: float = 0.12) -> DataFrame:
    """Clips whose speech goes on past the line where they are cut."""
    last = islands.groupBy(*keys).agg(F.max("t1").alias("last"))
    return lines.join(last, keys).where(F.col("trim").isNotNull() & (F.col("last") > F.col("trim") + slack)).select(*keys, "last", "trim")


def numbered_clips(clips: DataFrame, key: str) -> DataFrame:
    """Clips with their names h3_01, h3_02, ... along the timeline."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("t0"))
    return clips.withColumn("id", F.concat(F.lit("h3_"), F.lpad(n.cast("string"), 2, "0")))
