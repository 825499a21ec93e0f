"""Streams of timeline points: hopping windows, idle sessions, exact duplicates, fuzzy sessions and change feeds.

A point is (job_id, t timestamp, ...). Watermarks bound the state: what comes later than ``late`` is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from timeloom.functions.ratio import reaches, squeeze


def timed(points: DataFrame, time: str = "ts") -> DataFrame:
    """Points with ``t`` as a timestamp that watermarks accept (parquet may hold one without a zone)."""
    return points.withColumn("t", F.col(time).cast("timestamp"))


def hopping(points: DataFrame, key: str, size: str, hop: str, late: str = "10 minutes") -> DataFrame:
    """Count, sum and largest value of every window; a window comes out once it can't change any more."""
    w = F.window("t", size, hop)
    return points.withWatermark("t", late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most")).select(key, F.col("w.start").alias("w0"), F.col("w.end").alias("w1"), "n", "total", "most")


def sessions(points: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of points that come at most ``gap`` apart."""
    w = F.session_window("t", gap)
    return points.withWatermark("t", late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("t0"), F.col("w.end").alias("t1"), "n")


def distinct(points: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first point of each key within the watermark."""
    return points.withWatermark("t", late).dropDuplicatesWithinWatermark(keys)


def fuzzy_sessions(hits: DataFrame, key: str, slack_ms: int, least: float = 0.72, late: str = "10 minutes") -> DataFrame:
    """Sessions of similar texts of each key, as hits (key, t, text) come in: one open session a key is all the state.

    A session comes out when a hit can't join it, or when the watermark has passed its end by the slack.
    """

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if state.hasTimedOut:
            t0, t1, text, n = state.get
            out.append((k[0], t0, t1, text, n))
            state.remove()
        else:
            open_ = state.get if state.exists else None
            rows = pd.concat(list(parts)).sort_values(["t", "text"])
            for t, text in zip((rows["t"].astype("int64") // 1_000_000).tolist() if rows["t"].dtype == "datetime64[ns]" else (rows["t"].astype("datetime64[ms]").astype("int64")).tolist(), rows["text"].fillna("").tolist(), strict=True):
                if open_ is not None and t - open_[1] <= slack_ms and reaches(squeeze(open_[2]), squeeze(text), least):
                    open_ = (min(open_[0], t), max(open_[1], t), max(open_[2], text, key=len), open_[3] + 1)
                else:
                    if open_ is not None:
                        out.append((k[0], *open_))
                    open_ = (t, t, text, 1)
            state.update(open_)
            state.setTimeoutTimestamp(max(open_[1] + slack_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "t0", "t1", "text", "n"])

    kind = hits.schema[key].dataType.simpleString()
    return (
        hits.withWatermark("t", late)
        .select(key, "t", "text")
        .groupBy(key)
        .applyInPandasWithState(fold, f"{key} {kind}, t0 long, t1 long, text string, n long", "t0 long, t1 long, text string, n long", "append", GroupStateTimeout.EventTimeTimeout)
    )


class _Changes(StatefulProcessor):
    """Per key the time and digest of the last row handed over, and a timer that tells when the key has been silent."""

    def __init__(self, names: list[str], silent_ms: int | None):
        self.names, self.silent_ms = names, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "ms long, digest string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = None
        for row in rows:  # one row is kept, however many come
            at = (int(row["__ms"]), row["__digest"])
            if newest is None or at > newest[0]:
                newest = at, row
        (ms, digest), row = newest
        known = self.last.get() if self.last.exists() else None
        if known is not None and ms < known[0]:
            return
        self.last.update((ms, digest))
        if self.silent_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            # a timer can't lie before the watermark; a key that comes this late is silent at once
            self.handle.registerTimer(max(ms + self.silent_ms, timerValues.getCurrentWatermarkInMs() + 1))
        if known is None or digest != known[1]:
            yield Row(**{c: row[c] for c in self.names}, gone=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        yield Row(**{c: key[i] if i < len(key) else None for i, c in enumerate(self.names)}, gone=True)

    def close(self) -> None:
        pass


def change_feed(stream: DataFrame, keys: list[str], late: str = "10 minutes", silent_ms: int | None = None) -> DataFrame:
    """Of rows with keys, a time ``t`` and any other columns, those that differ from the last one of their key.

    As somebody would see who looks after each batch: of a key's rows in a batch the newest counts, and it comes out if it
    is the first or another column than ``t`` has changed; nulls are equal to nulls. A row older than the last one seen is
    ignored. With ``silent_ms`` a key that the watermark has left behind by so much comes out once more with ``gone`` set
    and nulls for the rest, and is forgotten: its next row is a first one. The columns are the keys, the others in order,
    and ``gone``.

    All the state is a time and a digest a key, kept by the query's checkpoint, so a restart repeats nothing. Such state
    needs the store that keeps it on disk, which is set for the queries of the session that start from now on.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    names = [*keys, *[c for c in stream.columns if c not in keys]]
    others = [F.col(f"`{c}`") for c in names if c not in keys and c != "t"]
    written = F.to_json(F.struct(*others), {"ignoreNullFields": "false"}) if others else F.lit("")
    rows = stream.withWatermark("t", late).select(*[F.col(f"`{c}`") for c in names], F.unix_millis("t").alias("__ms"), F.sha2(written, 256).alias("__digest")).where("t is not null")
    out = StructType([*[stream.schema[c] for c in names], StructField("gone", BooleanType())])
    processor = _Changes(names, silent_ms)
    return rows.groupBy(*keys).transformWithState(processor, StructType([StructField(f.name, f.dataType, True) for f in out]), "append", "eventTime" if silent_ms is not None else "none")
