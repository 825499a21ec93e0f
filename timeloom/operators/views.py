"""State, freshness and readiness of jobs as views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(*cases: tuple[Column, str], otherwise: str) -> Column:
    """The name of the first case that holds."""
    out = F.when(F.lit(False), "")
    for test, name in cases:
        out = out.when(F.coalesce(test, F.lit(False)), name)
    return out.otherwise(otherwise)


def gated(items: DataFrame, reviews: DataFrame, key: str, passed: Column) -> DataFrame:
    """Items with their review and the gate: ``passed`` is over the review's columns; unreviewed items are unknown."""
    joined = items.join(reviews.withColumn("__seen", F.lit(True)), key, "left")
    return joined.withColumn("gate", first_match((F.col("__seen").isNull(), "unknown"), (passed, "pass"), otherwise="fail")).drop("__seen")


def review_passed(ok: Column, score: Column, identity: Column, scene: Column) -> Column:
    """The gate of a reviewed clip; a review that failed has no score and leaves the gate unknown."""
    return F.when(score.isNull(), F.lit(None).cast("boolean")).otherwise(ok & (score >= 7) & (identity >= 6) & (scene >= 6))


def confident(rows: DataFrame, key: str, logits: str, least: float, sharpness: float = 1.0) -> DataFrame:
    """The position of the largest logit with its softmax share; NULL below the least share."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(F.lit(sharpness) * (x.cast("double") - top.cast("double"))))
    share = 1 / total
    return rows.select(key, F.when(share >= least, F.array_position(logits, top).cast("int")).alias("best"), F.round(share, 6).alias("share"))


def rollup(rows: DataFrame, key: str, state: str, done: str, waiting: str, partial: str) -> DataFrame:
    """Counts of states per job, and whether all are done or any is partly so."""
    s = F.col(state)
    return rows.groupBy(F.col(key).alias("job_id")).agg(F.count("*").alias("n"), F.count_if(s == done).alias("done"), F.count_if(s == waiting).alias("open"), F.bool_and(s == done).alias("complete"), F.bool_or(s == partial).alias("partial"))


def staleness(rows: DataFrame, text: str, kept: str) -> DataFrame:
    """The hash of each text, and whether what was made of it is out of date; an empty or missing hash is."""
    now = F.sha1(F.col(text).cast("binary"))
    return rows.withColumn("prompt_hash", now).withColumn("dirty", F.coalesce(F.nullif(F.col(kept), F.lit("")) != now, F.lit(True)))


def clip_status(clips: DataFrame, progress: DataFrame, prompts: DataFrame) -> DataFrame:
    """Per clip and quality: done with a file, else running or error, else pending; dirty if the prompt has changed since."""
    joined = clips.select("job_id", "clip_id").join(progress, ["job_id", "clip_id"], "left").join(prompts.select("job_id", "clip_id", "prompt"), ["job_id", "clip_id"], "left")
    has_file = F.coalesce(F.col("file") != "", F.lit(False))
    status = first_match((has_file, "done"), (F.col("status") == "running", "running"), (F.col("status") == "error", "error"), otherwise="pending")
    dirty = has_file & F.col("prompt").isNotNull() & F.coalesce(F.nullif("prompt_hash", F.lit("")) != F.sha1(F.col("prompt").cast("binary")), F.lit(True))
    return joined.select("job_id", "clip_id", "quality", status.alias("status"), dirty.alias("dirty"))


def unpivoted(docs: DataFrame, key: str, clips: str) -> DataFrame:
    """A two-level map clip -> quality -> state as rows."""
    outer = docs.select(key, F.explode(clips).alias("clip_id", "__by_quality"))
    return outer.select(key, "clip_id", F.explode("__by_quality").alias("quality", "__s")).select(key, "clip_id", "quality", "__s.*")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last version of each key of an append-only log."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_entries(log: DataFrame, key: str, order: str, n: int = 50) -> DataFrame:
    """The last entries of each job's log."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def quality_ready(clips: DataFrame, status: DataFrame) -> DataFrame:
    """Whether all clips of a job are done in a quality; false for a job without clips in it."""
    joined = clips.select("job_id", "clip_id").join(status.where("status = 'done'").select("job_id", "clip_id", "quality").distinct(), ["job_id", "clip_id"], "left")
    total = clips.groupBy("job_id").agg(F.countDistinct("clip_id").alias("total"))
    done = joined.where("quality is not null").groupBy("job_id", "quality").agg(F.countDistinct("clip_id").alias("done"))
    return total.join(done, "job_id", "left").select("job_id", "quality", F.coalesce(F.col("done") == F.col("total"), F.lit(False)).alias("ready"))


def elapsed_seconds(started: Column, finished: Column, now: Column) -> Column:
    """Seconds since the start, up to now for what still runs; at least 0, and none before there is a start."""
    return F.when(started.isNotNull(), F.greatest(F.lit(0), F.unix_timestamp(F.coalesce(finished, now)) - F.unix_timestamp(started)))


def gauge_alerts(used: Column, total: Column, celsius: Column) -> Column:
    """Names of the gauges in alarm."""
    return F.filter(F.array(F.when(used >= 0.9 * total, "vram"), F.when(celsius >= 80, "temperature")), lambda x: x.isNotNull())
