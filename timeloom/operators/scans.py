"""Prefix scans of timelines, however many rows one of them has.

A window over a timeline sorts its rows in one task. Where a timeline has more than ``MOST`` rows it is cut into chunks at
quantiles of its order, windows run inside chunks, and what a row needs of the chunks before or after its own is scanned
over one summary row a chunk. Rows that are equal in order share a chunk, so frames by value mean what they mean uncut.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.plans.materialise import checkpointed

#: Rows of one timeline that one task sorts.
MOST = 2_000_000
#: Rows of many timelines that one task sorts or gathers, as dealt() hands them out.
SHARE = 250_000
#: No timeline of a table that is estimated to have fewer bytes can have that many rows.
TINY = 32 << 20
#: Splits are looked up in two steps: among every so many, then among those between two of them.
_STEP = 32


@dataclass(frozen=True)
class Spread:
    """Rows that may have a column ``__chunk``; ``by`` are the columns that windows are cut by."""

    rows: DataFrame
    key: str
    cut: bool

    @property
    def by(self) -> list[str]:
        return [self.key, "__chunk"] if self.cut else [self.key]

    def window(self, *order: Column | str) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*order)

    def carrying(self, before: dict[str, tuple[Column, Callable]] | None = None, after: dict[str, tuple[Column, Callable]] | None = None) -> Spread:
        """Add for each row what the chunks before (after) its own have together: a summary of each chunk by an aggregate,
        combined over chunks by a function (F.sum, F.max, F.last, ...) that leaves nulls out. Null where there are none."""
        before, after = before or {}, after or {}
        names = [*before, *after]
        if not self.cut:
            return Spread(self.rows.select("*", *[F.lit(None).alias(n) for n in names]), self.key, False)
        summary = self.rows.groupBy(*self.by).agg(*[made.alias(n) for n, (made, _) in (before | after).items()])
        order = Window.partitionBy(self.key).orderBy("__chunk")
        past, future = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
        combined = [combine(n).over(past).alias(n) for n, (_, combine) in before.items()] + [combine(n).over(future).alias(n) for n, (_, combine) in after.items()]
        carried = checkpointed(summary.select(*self.by, *combined)).withColumnsRenamed({c: f"__s_{c}" for c in self.by})
        # a summary row stands for MOST / 2 rows on average, or for a whole timeline with fewer
        on = [F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in self.by]
        return Spread(self.rows.join(carried, on, "left").drop(*[f"__s_{c}" for c in self.by]), self.key, True)

    def done(self) -> DataFrame:
        return self.rows.drop("__chunk")


def _estimate(df: DataFrame) -> int:
    """Bytes that the optimiser expects of a table."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(rows: DataFrame, key: str, order: str, most: int | None = None) -> Spread:
    """Cut timelines with more than ``most`` rows (MOST if not given) into chunks of fewer, in the order of a number or time.

    Keys that are so long are few, fewer than rows / ``most``; quantiles are estimated for them alone. A key that is null is
    a timeline like others. An order that is neither number nor time isn't cut.
    """
    most = most or MOST
    kind = rows.schema[order].dataType
    if not isinstance(kind, (T.NumericType, T.TimestampType, T.DateType)) or most >= MOST and _estimate(rows) < TINY:
        return Spread(rows, key, False)
    hot = checkpointed(rows.groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__many")).where(F.col("__many") > most))
    largest = hot.agg(F.max("__many")).first()[0]
    if largest is None:
        return Spread(rows, key, False)
    parts = 2 * math.ceil(largest / most)
    known = F.col(key).eqNullSafe(F.col("__hot"))
    quantiles = F.percentile_approx(order, [k / parts for k in range(1, parts)], 20 * parts)
    mine = rows.select(key, order).join(F.broadcast(hot), known).groupBy("__hot").agg(quantiles.alias("q"), F.max("__many").alias("__many"))
    # a shorter one of them takes every so many splits
    every = F.greatest(F.lit(1), F.floor(F.lit(largest) / F.col("__many"))).cast("int")
    splits = F.array_distinct(F.filter("q", lambda x, i: F.pmod(i + 1, every) == 0))
    splits = checkpointed(mine.select("__hot", splits.alias("__splits"), F.filter(splits, lambda x, i: F.pmod(i + 1, F.lit(_STEP)) == 0).alias("__coarse")))
    at = F.size(F.filter("__coarse", lambda s: s <= F.col(order)))
    fine = F.size(F.filter(F.slice("__splits", at * _STEP + 1, F.lit(_STEP)), lambda s: s <= F.col(order)))
    chunk = F.when(F.col("__splits").isNull() | F.col(order).isNull(), 0).otherwise(at * _STEP + fine)
    return Spread(rows.join(F.broadcast(splits), known, "left").withColumn("__chunk", chunk).drop("__hot", "__splits", "__coarse"), key, True)


def dealt(rows: DataFrame, *keys: str, share: int | None = None) -> DataFrame:
    """Rows dealt out by ``keys`` to so many tasks that each gets about ``share`` of them (SHARE if not given), as many as
    the session has cores at least.

    Adaptive execution joins partitions by their compressed bytes, so what a task sorts, groups and joins behind one
    shuffle grows with how well rows compress; here it doesn't grow with the input. Windows and groups by keys that begin
    with these take the rows as they lie. Rows are counted, so this belongs where they are read.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / (share or SHARE)))
    return rows.repartition(tasks, *keys)


def last(column: str | Column) -> Column:
    """The last value that isn't null."""
    return F.last(column, ignorenulls=True)


def running(rows: DataFrame, key: str, order: str, value: Column, name: str, by_value: bool = True, *ties: Column | str) -> DataFrame:
    """Running totals of ``value`` along timelines; ``by_value``: rows that are equal in order have the same total."""
    s = spread(rows.withColumn("__value", value), key, order)
    s = s.carrying({"__earlier": (F.sum("__value"), F.sum)})
    w = s.window(order, *ties)
    w = w.rangeBetween(Window.unboundedPreceding, 0) if by_value else w.rowsBetween(Window.unboundedPreceding, 0)
    inside = F.sum("__value").over(w)
    total = F.when(F.col("__earlier").isNull(), inside).otherwise(F.col("__earlier") + F.coalesce(inside, F.lit(0))) if s.cut else inside
    return s.rows.withColumn(name, total).drop("__value", "__earlier", "__chunk")
