"""Jobs: stages, what a job needs next, gates, batches, and lists of files that must be complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.operators.views import elapsed_seconds, first_match

# The stages before generation, in order, and the states that count as over.
PREPARATION = ("download", "pagemeta", "understand", "script", "precheck")
OVER = ("done", "skipped")


def stage_status(name: str) -> Column:
    return F.coalesce(F.try_element_at("stages", F.lit(name))["status"], F.lit(""))


def _open(name: str) -> tuple[Column, str]:
    return ~stage_status(name).isin(*OVER), name


def next_action() -> Column:
    """What a job (state, stages, dirty, running, drafts_ready, finals_ready) needs next; the first that applies."""
    state = F.lower("state")
    return first_match(
        (F.col("running"), "busy"),
        (state.isin("cancelled", "canceled"), "cancelled"),
        (state.isin("failed", "error"), "retry"),
        (F.col("dirty"), "redraft"),
        (state == "done", "done"),
        *[_open(n) for n in PREPARATION],
        (~F.col("drafts_ready"), "draft"),
        (~F.col("finals_ready"), "final"),
        (~stage_status("finish").isin(*OVER), "assemble"),
        otherwise="done",
    )


def shown_stage() -> Column:
    """The stage that a job's page shows."""
    generate, drafts = stage_status("generate"), F.col("drafts_ready")
    clips = F.when(drafts, "clips").otherwise("draft")
    shown = first_match(
        (stage_status("finish").isin("running", "done"), "finish"),
        ((generate == "running") & ((F.col("last_quality") == "final") | drafts), "clips"),
        (generate == "running", "draft"),
        (generate.isin("failed", "waiting"), "="),
        *[_open(n) for n in PREPARATION],
        (F.col("finals_ready"), "clips"),
        otherwise="draft",
    )
    return F.when(shown == "=", clips).otherwise(shown)


def summary(jobs: DataFrame, now: Column | None = None) -> DataFrame:
    """The row of a job in the list of jobs.

    ``jobs`` are (job_id, state, note, stages, options map, source, need_aspect_confirm, created_at, updated_at, chip, dirty,
    running, drafts_ready, finals_ready, last_quality); what is missing of the last six counts as false or none. A job that
    says no mode is a real one; a running one has been at it until ``now``.
    """
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = jobs.withColumns({c: no(c) for c in ("dirty", "running", "drafts_ready", "finals_ready")})
    end = F.when(F.col("state") == "running", F.current_timestamp() if now is None else now).otherwise(F.col("updated_at"))
    return rows.select(
        "job_id", F.coalesce(F.nullif(F.try_element_at("options", F.lit("mode")), F.lit("")), F.lit("real")).alias("mode"), "state", shown_stage().alias("stage"), "note", F.col("chip").alias("sub_progress"),
        "created_at", "updated_at", elapsed_seconds(F.col("created_at"), end, F.col("created_at")).alias("elapsed_sec"), "source", "options", no("need_aspect_confirm"), "drafts_ready", "finals_ready", next_action().alias("next_action"),
    )


def list_payload(jobs: DataFrame, clips: DataFrame, occupied: DataFrame, now: Column | None = None) -> DataFrame:
    """All jobs as summary() has them, the newest first, with what their clips say of drafts, finals and changed prompts, and
    whether they are the one that ``occupied`` (job_id) names."""
    from timeloom.operators.screen import clip_facts

    facts = clip_facts(clips).select("job_id", "dirty", "drafts_ready", "finals_ready")
    rows = jobs.join(facts, "job_id", "left").join(occupied.select("job_id", F.lit(True).alias("running")).distinct(), "job_id", "left")
    return summary(rows, now).orderBy(F.desc("job_id"))


def listed(jobs: DataFrame) -> DataFrame:
    """One summary row per job, the newest first."""
    failed = F.filter(F.map_entries("stages"), lambda e: e["value"]["status"] == "failed")
    return jobs.select("job_id", "state", shown_stage().alias("stage"), next_action().alias("next"), F.array_sort(F.transform(failed, lambda e: e["key"])).alias("failed")).orderBy(F.desc("job_id"))


def transitions(log: DataFrame) -> DataFrame:
    """The current stages of jobs from an append-only log (job_id, at, stage, status, error): when each began and ended, and the job's state."""
    per = log.groupBy("job_id", "stage").agg(
        F.max_by("status", "at").alias("status"),
        F.max_by("error", "at").alias("error"),
        F.max(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"),
        F.max(F.when(F.col("status").isin("done", "failed", "skipped"), F.col("at"))).alias("finished_at"),
        F.max("at").alias("at"),
    )
    state = first_match((F.bool_or(F.col("status") == "failed"), "failed"), (F.bool_or(F.col("status") == "running"), "running"), (F.bool_or(F.col("status") == "waiting"), "paused"), (F.bool_or((F.col("stage") == "finish") & (F.col("status") == "done")), "done"), otherwise="queued")
    entry = F.struct("stage", F.struct("status", "error", "started_at", "finished_at"))
    return per.groupBy("job_id").agg(state.alias("state"), F.max_by("stage", "at").alias("stage"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("stages"), F.max("at").alias("updated_at"))


def first_failed(steps: DataFrame, key: str) -> DataFrame:
    """The first failed step (key, ord, stage, status) of each job, or else the last step."""
    return steps.groupBy(key).agg(F.coalesce(F.min_by(F.when(F.col("status") == "failed", F.col("stage")), F.when(F.col("status") == "failed", F.col("ord"))), F.max_by("stage", "ord")).alias("stage"))


def batches_repaired(batches: DataFrame) -> DataFrame:
    """Batches (job_id, clip_id, state) left running: ready if any clip is done, else gone."""
    return batches.groupBy("job_id").agg(F.bool_or(F.col("state") == "done").alias("any"), F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "failed").alias("failed")).where("any").select("job_id", F.lit("ready").alias("state"), "done", "failed")


def reused(new: DataFrame, old: DataFrame, keys: list[str], value: str, failed: Column) -> DataFrame:
    """New rows with the value of the run before where their key is the same and it had not failed."""
    kept = old.where(~failed).select(*keys, F.col(value).alias("__old"))
    return new.join(kept, keys, "left").withColumn("reused", F.col("__old").isNotNull()).withColumn(value, F.coalesce("__old", value)).drop("__old")


def same_rows(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose ordered rows are the same on both sides."""
    digest = lambda d, name: d.groupBy(key).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("ord", *columns)))).cast("binary"), 256).alias(name))
    return digest(a, "x").join(digest(b, "y"), key).where("x = y").select(key)


def cache_valid(cached: DataFrame, clips: DataFrame, revision: int, tolerance: int = 20) -> DataFrame:
    """Cached prompts (key columns, path, writer_rev, t0, t1) that still fit their clips."""
    c = clips.select("job_id", "clip_id", F.col("path").alias("__p"), F.col("t0").alias("__a"), F.col("t1").alias("__b"))
    fits = (F.col("path") == F.col("__p")) & (F.col("writer_rev") == revision) & (F.abs(F.col("t0") - F.col("__a")) <= tolerance) & (F.abs(F.col("t1") - F.col("__b")) <= tolerance)
    return cached.join(c, ["job_id", "clip_id"]).where(fits).drop("__p", "__a", "__b")


def complete_sets(manifest: DataFrame, files: DataFrame, key: str, least: int = 1_000_000) -> DataFrame:
    """Sets whose files (key, path, size or NULL) are all there: with their size, or at least ``least`` bytes, and no partial one."""
    f = files.select("path", F.col("size").alias("__size"))
    have = manifest.join(f, "path", "left").withColumn("ok", F.coalesce(F.when(F.col("size").isNull(), F.col("__size") >= least).otherwise(F.col("__size") == F.col("size")), F.lit(False)))
    partial = files.where("path like '%.incomplete' or path like '%.part'").select(F.regexp_replace("path", r"\.(incomplete|part)$", "").alias("path"), F.lit(True).alias("__partial"))
    return have.join(partial, "path", "left").groupBy(key).agg(F.bool_and(F.col("ok") & F.col("__partial").isNull()).alias("ready"))


def selected(requested: Column, known: Column) -> Column:
    """Requested clips, and those of them that don't exist."""
    return F.struct(F.array_intersect(requested, known).alias("found"), F.array_except(requested, known).alias("unknown"))


def neighbours(clips: DataFrame, key: str) -> DataFrame:
    """Clips with the one before and the one after; a change of cast on either side ends the thread."""
    w = Window.partitionBy(key).orderBy("n")
    return clips.withColumn("before", F.lag("id").over(w)).withColumn("after", F.lead("id").over(w)).withColumn("thread", F.when(~F.col("cast_reset"), F.col("before")))
