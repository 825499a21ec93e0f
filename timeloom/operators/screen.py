"""What a page about a job shows: details, media, status of clips and stages, what can be chosen, what is recommended."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.operators import jobs, prompts
from timeloom.operators.views import first_match

# States in which a job may be deleted, and the steps of understanding a film in order.
DELETABLE = ("pending", "paused", "pause", "waiting", "done", "failed", "error", "cancelled", "canceled")
STEPS = ("shots", "ocr", "asr", "dialogue", "beats", "events")
COVERS = ("cover.jpg", "cover.png")


def clip_state(draft: Column, final: Column, quality: str, has_script: Column) -> Column:
    """What a clip's tile shows for a quality; ``draft`` and ``final`` are structs of status and dirty."""
    own = draft if quality == "draft" else final
    stale = own["dirty"] | draft["dirty"] if quality == "final" else own["dirty"]
    return first_match(
        (own["status"] == "running", "generating"),
        (own["status"] == "error", "failed"),
        (~has_script & (own["status"] == "done"), "stale"),
        (~has_script, "no_script"),
        ((own["status"] == "done") & stale, "stale"),
        (own["status"] == "done", "ready"),
        otherwise="pending",
    )


def needs_draft(draft: Column) -> Column:
    return (F.coalesce(draft["status"], F.lit("")) != "done") | F.coalesce(draft["dirty"], F.lit(False))


def needs_final(draft: Column, final: Column) -> Column:
    """Whether the final is to be made next: not before the draft is up to date."""
    return ~needs_draft(draft) & needs_draft(final)


def counted_states(clips: DataFrame) -> DataFrame:
    """How many clips (job_id, draft, final, has_script) of a job are pending, ready, failed and stale, per quality."""
    states = F.array(*[F.struct(F.lit(q).alias("quality"), clip_state(F.col("draft"), F.col("final"), q, F.col("has_script")).alias("state")) for q in ("draft", "final")])
    rows = clips.select("job_id", F.explode(states).alias("x")).select("job_id", "x.*")
    return rows.groupBy("job_id", "quality").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("pending", "ready", "failed", "stale", "generating", "no_script")])


def recommended(clips: DataFrame, kind: str, quality: str = "draft") -> DataFrame:
    """Clips (job_id, clip_id, draft, final, has_script) that a batch should take: without a script for ``scripts``; for ``ai``
    those that need work, or if a job has none all with a script; for ``videos`` those whose video is due in the quality;
    for ``rest`` the pending and failed ones."""
    state = clip_state(F.col("draft"), F.col("final"), "draft", F.col("has_script"))
    if kind == "scripts":
        return clips.where(~F.col("has_script")).select("job_id", "clip_id")
    if kind == "videos":
        due = needs_final(F.col("draft"), F.col("final")) if quality == "final" else needs_draft(F.col("draft"))
        return clips.where(due).select("job_id", "clip_id")
    if kind == "ai":
        work = state.isin("pending", "stale") | F.col("draft.dirty") | F.col("final.dirty")
        any_work = F.max(work.cast("int")).over(Window.partitionBy("job_id")) == 1
        return clips.withColumn("__work", work).withColumn("__any", any_work).where(F.when(F.col("__any"), F.col("__work")).otherwise(F.col("has_script"))).select("job_id", "clip_id")
    return clips.where(clip_state(F.col("draft"), F.col("final"), quality, F.col("has_script")).isin("pending", "failed")).select("job_id", "clip_id")


def clip_facts(clips: DataFrame) -> DataFrame:
    """Per job of clips (job_id, draft, final): whether drafts and finals are all there, whether any is due or out of date,
    and whether the film can be put together. A job without clips has none of these."""
    d, f = F.col("draft"), F.col("final")
    done = lambda q: F.bool_and(F.coalesce(q["status"] == "done", F.lit(False)))
    return clips.groupBy("job_id").agg(
        done(d).alias("drafts_ready"),
        done(f).alias("finals_ready"),
        F.bool_or(needs_draft(d)).alias("draft_due"),
        F.bool_or(needs_final(d, f)).alias("final_due"),
        F.bool_or(d["dirty"] | f["dirty"]).alias("dirty"),
        F.bool_and((f["status"] == "done") & ~f["dirty"] & ~d["dirty"]).alias("can_assemble"),
        F.count("*").alias("n_clips"),
    )


def _status(name: str) -> Column:
    return jobs.stage_status(name)


def progress_stage() -> Column:
    """The stage that a job (stages, last_quality, stage, drafts_ready, finals_ready, draft_due, final_due) is at."""
    generate, finish = _status("generate"), _status("finish")
    at_clips = (F.coalesce("last_quality", F.lit("")) == "final") | F.col("drafts_ready")
    busy = lambda n: (_status(n).isin("running", "waiting", "failed"), n)
    open_ = lambda n: (~_status(n).isin(*jobs.OVER), n)
    return first_match(
        (finish.isin("running", "waiting"), "finish"),
        (generate.isin("running", "waiting") & at_clips, "clips"),
        (generate.isin("running", "waiting"), "draft"),
        *[busy(n) for n in jobs.PREPARATION],
        *[open_(n) for n in jobs.PREPARATION],
        (F.col("draft_due"), "draft"),
        (F.col("final_due"), "clips"),
        (finish.isin("done", "failed") | F.col("finals_ready"), "finish"),
        ((generate == "failed") & F.col("drafts_ready"), "clips"),
        otherwise="draft",
    )


def stage_shown(stage: str) -> Column:
    """The status that a stage's tile shows for a job (the columns of progress_stage(), and dirty)."""
    generate = _status("generate")
    running = generate.isin("running", "waiting")
    final = F.coalesce("last_quality", F.lit("")) == "final"
    plain = F.coalesce(F.nullif(_status(stage), F.lit("")), F.lit("pending"))
    due = F.col("draft_due") | F.col("final_due")
    if stage == "script":
        return F.when(F.col("dirty"), "dirty").otherwise(plain)
    if stage == "draft":
        return F.when(F.col("draft_due"), F.when(running & ~final, generate).when(generate == "failed", "failed").otherwise("pending")).when(F.col("drafts_ready"), "done").otherwise("pending")
    if stage == "clips":
        return F.when(due, F.when(running & (final | F.col("drafts_ready")), generate).when((generate == "failed") & F.col("drafts_ready"), "failed").otherwise("pending")).when(F.col("finals_ready"), "done").otherwise("pending")
    if stage == "finish":
        return F.when(due, "pending").otherwise(plain)
    return plain


def primary_action(given: Column, inferred: Column, dirty: Column, actions: tuple[str, ...]) -> Column:
    """What the page offers: the given action if it is one, else the inferred one; a redraft instead where clips are out of
    date, unless the job is busy, cancelled or to be retried."""
    action = F.when(given.isin(*actions), given).otherwise(inferred)
    return F.when(F.coalesce(dirty, F.lit(False)) & ~action.isin("busy", "cancelled", "retry"), "redraft").otherwise(action)


def inferred_action() -> Column:
    """The action of a job whose stages are known, or else one for the stage that it names."""
    stage = F.coalesce(F.nullif("stage", F.lit("")), F.lit("download"))
    plain = first_match(*[(stage == n, n) for n in jobs.PREPARATION], (stage.isin("draft", "generate"), "draft"), (stage == "clips", "final"), (stage == "finish", "assemble"), otherwise="download")
    state = F.lower("state")
    over = first_match((F.col("running"), "busy"), (state.isin("cancelled", "canceled"), "cancelled"), (state.isin("failed", "error"), "retry"), (F.col("dirty"), "redraft"), (state == "done", "done"), otherwise="")
    return F.when(F.col("stages").isNotNull(), jobs.next_action()).otherwise(F.coalesce(F.nullif(over, F.lit("")), plain))


def deletable(state: Column, running: Column) -> Column:
    key = F.lower(F.trim(F.coalesce(state, F.lit("pending"))))
    return ~F.coalesce(running, F.lit(False)) & key.isin(*DELETABLE)


def chosen(jobs_: DataFrame, current: str | None, running: str | None) -> DataFrame:
    """The job that is open: the current one if it is listed (job_id, newest first), else the running one, else the newest."""
    rank = F.when(F.col("job_id") == F.lit(current), 0).when(F.col("job_id") == F.lit(running), 1).otherwise(2)
    return jobs_.select("job_id", rank.alias("__r")).orderBy("__r", F.desc("job_id")).limit(1).select("job_id")


def success_rate(jobs_: DataFrame, windows: DataFrame) -> DataFrame:
    """The share of windows that succeeded, in per cent: as stored, else from the stored counts, else counted; NULL if unknown."""
    good = F.count_if((F.coalesce("error", F.lit("")) == "") & (F.trim(F.coalesce("raw", F.lit(""))) != ""))
    counted = windows.groupBy("job_id").agg((good / F.count("*")).alias("__counted"))
    stored = F.when(F.col("total") > 0, F.col("ok") / F.col("total"))
    return jobs_.join(counted, "job_id", "left").select("job_id", F.round(100 * F.coalesce("rate", stored, "__counted")).cast("int").alias("rate"))


def step_states(rows: DataFrame, key: str) -> DataFrame:
    """The state of every step of jobs (key, step, wait, failed): done before the one at work, pending after it; an unknown step
    is the first."""
    order = F.array(*[F.lit(s) for s in STEPS])
    at = F.greatest(F.array_position(order, F.col("step")).cast("int"), F.lit(1))
    own = F.when(F.col("failed"), "failed").when(F.coalesce("wait", F.lit("")) != "", "waiting").otherwise("active")
    steps = F.transform(order, lambda s, i: F.struct(i.alias("n"), s.alias("id"), F.when(i + 1 < at, "done").when(i + 1 == at, own).otherwise("pending").alias("status")))
    return rows.select(key, F.explode(steps).alias("s")).select(key, "s.*")


def media(jobs_: DataFrame, files: DataFrame) -> DataFrame:
    """The media of jobs (job_id, video, path, finish) that are in the listing (job_id, file); the final film, its subtitles and
    the cover show only once the last stage is done."""
    names = {"source": F.coalesce("video", F.lit("source/video.mp4")), **{n: F.concat(F.lit("output/"), "path", F.lit(f"/{f}")) for n, f in (("draft", "draft.mp4"), ("final", "final.mp4"), ("ass", "final.ass"))}}
    covers = [F.lit(c) for c in COVERS] + [F.concat(F.lit("output/"), "path", F.lit("/cover.jpg"))]
    have = files.groupBy("job_id").agg(F.collect_set("file").alias("__files"))
    rows = jobs_.join(have, "job_id", "left").withColumn("__files", F.coalesce("__files", F.array().cast("array<string>")))
    there = lambda c: F.when(F.array_contains("__files", c), c)
    done = F.coalesce(F.col("finish") == "done", F.lit(False))
    return rows.select("job_id", there(names["source"]).alias("source"), there(names["draft"]).alias("draft"), F.when(done, there(names["final"])).alias("final"), F.when(done, F.coalesce(*[there(c) for c in covers])).alias("cover"), F.when(done, there(names["ass"])).alias("ass"))


def detail(jobs_: DataFrame, clips: DataFrame, media_: DataFrame, log: DataFrame, audits: DataFrame) -> DataFrame:
    """One wide row per job: the job, its clips with their status, what is ready and due, its media, the last 40 entries of its
    log (job_id, at, text), its violations (job_id, rule), the stage shown and the next action."""
    rows = clips.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("clip_id", "has_script", "draft", "final"))).alias("clips"), F.array_sort(F.collect_list(F.when(F.col("draft.dirty") | F.col("final.dirty"), F.col("clip_id")))).alias("dirty_clip_ids"))
    w = Window.partitionBy("job_id").orderBy(F.desc("at"))
    last = log.withColumn("__n", F.row_number().over(w)).where("__n <= 40").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("events"))
    errors = audits.groupBy("job_id").agg(F.array_sort(F.collect_list("rule")).alias("errors"))
    out = jobs_
    for part in (rows, clip_facts(clips), media_.select("job_id", F.struct(*[c for c in media_.columns if c != "job_id"]).alias("media")), last, errors):
        out = out.join(part, "job_id", "left")
    for c in ("drafts_ready", "finals_ready", "draft_due", "final_due", "dirty", "can_assemble"):
        out = out.withColumn(c, F.coalesce(c, F.lit(False)))
    return out.withColumn("shown_stage", jobs.shown_stage()).withColumn("next_action", jobs.next_action())


def editor(clips: DataFrame, lines: DataFrame, documents: DataFrame) -> DataFrame:
    """What the editor of a clip gets: its own lines, its prompt as text and as a document, and the text to edit.

    ``lines`` are (job_id, clip_id, t0, text, source), ``documents`` (job_id, clip_id, prompt, document, people, beats, parts)
    with a map of notes by section.
    """
    said = lines.groupBy("job_id", "clip_id").agg(F.array_sort(F.collect_list(F.struct("t0", "text", "source"))).alias("speech"))
    joined = clips.join(said, ["job_id", "clip_id"], "left").join(documents, ["job_id", "clip_id"], "left")
    parts = {n: F.try_element_at("parts", F.lit(n)) for n in ("Chain", "Scene", "Sound", "Note")}
    span = F.format_string("%.2f-%.2f", F.col("t0") / 1000, F.col("t1") / 1000)
    text = prompts.editor_text(F.col("clip_id"), span, F.col("seconds"), parts, F.col("people"), F.col("beats"))
    return joined.select("job_id", "clip_id", "speech", F.when(F.col("document").isNotNull(), text).otherwise("").alias("script"), F.coalesce("prompt", F.lit("")).alias("prompt"), F.col("document").isNotNull().alias("has_document"), F.col("prompt").isNotNull().alias("has_prompt"))


def gate_reasons(checks: DataFrame, key: str) -> DataFrame:
    """Why a job may not begin: the reasons (ord, reason) of its failing checks (ok), each once, in order; a job without any is
    not listed."""
    rows = checks.where(~F.coalesce("ok", F.lit(False))).groupBy(key, "reason").agg(F.min("ord").alias("ord"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "reason"))), lambda r: r["reason"]).alias("reasons"))


def failure_reasons(note: Column, detail: Column, error: Column, stages: Column) -> Column:
    """What a failed job says of itself, each reason once; a stage's error that a reason holds already isn't told again."""
    said = F.filter(F.array(F.when(~F.lower(note).isin("failed", "running", "error"), note), detail, error), lambda x: F.coalesce(x != "", F.lit(False)))
    failed = F.filter(F.map_entries(stages), lambda e: F.coalesce(e["value"]["error"] != "", F.lit(False)) & F.lower(e["value"]["status"]).isin("failed", "waiting", "error"))
    told = F.array_distinct(said)
    more = F.filter(F.transform(failed, lambda e: F.struct(e["value"]["error"].alias("error"), F.concat(e["key"], F.lit(" ("), F.lower(e["value"]["status"]), F.lit("): "), e["value"]["error"]).alias("text"))), lambda x: ~F.array_contains(told, x["error"]))
    return F.array_distinct(F.concat(told, F.transform(more, lambda x: x["text"])))


def foreign_runs(queue: DataFrame, own: DataFrame) -> DataFrame:
    """Runs in a queue (prompt_id, running) that no job started."""
    return queue.join(own.select("prompt_id").distinct(), "prompt_id", "left_anti")


def own_prompts(progress: DataFrame) -> DataFrame:
    """The runs that jobs (job_id, last_prompt_id, clips: clip -> quality -> state with prompt_id) started."""
    per = F.flatten(F.transform(F.map_values("clips"), lambda q: F.transform(F.map_values(q), lambda s: s["prompt_id"])))
    every = F.filter(F.concat(F.array("last_prompt_id"), F.coalesce(per, F.array().cast("array<string>"))), lambda p: F.coalesce(p != "", F.lit(False)))
    return progress.select("job_id", F.explode(F.array_distinct(every)).alias("prompt_id"))


def queue_summary(running: Column, pending: Column) -> Column:
    """How long a queue is, whether it runs, and the first run in it."""
    return F.struct((F.size(running) + F.size(pending)).cast("long").alias("length"), (F.size(running) > 0).alias("running"), F.get(running, F.lit(0)).alias("prompt_id"))


def in_queue(running: Column, pending: Column, prompt_id: Column) -> Column:
    return F.array_contains(F.concat(running, pending), prompt_id)


def ready_by_size(clips: DataFrame, files: DataFrame, least: int = 1000) -> DataFrame:
    """Whether each quality of a job has a file of at least ``least`` bytes for every clip: (job_id, drafts_ready, finals_ready);
    false for a job without clips."""
    big = files.where(F.col("size") >= least).select("job_id", "clip_id", "quality").distinct()
    ok = reduce(lambda d, q: d.join(big.where(F.col("quality") == q).select("job_id", "clip_id", F.lit(True).alias(q)), ["job_id", "clip_id"], "left"), ("draft", "final"), clips.select("job_id", "clip_id"))
    return ok.groupBy("job_id").agg(*[F.bool_and(F.coalesce(q, F.lit(False))).alias(f"{q}s_ready") for q in ("draft", "final")])


def ready_by_status(progress: DataFrame) -> DataFrame:
    """The same by the recorded status alone (job_id, clip_id, quality, status)."""
    return progress.groupBy("job_id", "quality").agg(F.bool_and(F.coalesce(F.col("status") == "done", F.lit(False))).alias("ready"))


def complete(clips: DataFrame, progress: DataFrame, prompts_: DataFrame, islands: DataFrame, quality: str, slack: int = 120) -> DataFrame:
    """Whether every clip of a job (job_id, clip_id, trim or NULL) has a file made of its present prompt, with no speech beyond
    its trim line unless its length was set by hand: (job_id, complete).

    ``progress`` are (job_id, clip_id, quality, file, prompt_hash, play), ``islands`` of speech (job_id, clip_id, t1) in ms.
    """
    p = progress.where(F.col("quality") == quality).select("job_id", "clip_id", "file", "prompt_hash", "play")
    last = islands.groupBy("job_id", "clip_id").agg(F.max("t1").alias("__last"))
    rows = clips.join(p, ["job_id", "clip_id"], "left").join(prompts_.select("job_id", "clip_id", "prompt"), ["job_id", "clip_id"], "left").join(last, ["job_id", "clip_id"], "left")
    over = F.col("trim").isNotNull() & F.col("play").isNull() & F.coalesce(F.col("__last") > F.col("trim") + slack, F.lit(False))
    good = (F.coalesce("file", F.lit("")) != "") & F.coalesce(F.col("prompt_hash") == F.sha1(F.col("prompt").cast("binary")), F.lit(False)) & ~over
    return rows.groupBy("job_id").agg(F.bool_and(good).alias("complete"))


def next_quality(drafts_complete: Column) -> Column:
    return F.when(F.coalesce(drafts_complete, F.lit(False)), "final").otherwise("draft")


def route(prompts_: Column, clips: Column, option: Column, aliases: dict[str, str], known: tuple[str, ...], default: str) -> Column:
    """How a job is rendered: as its prompts say, else its clips, else its options, else the default; NULL for an unknown name."""
    named = F.coalesce(F.nullif(prompts_, F.lit("")), F.nullif(clips, F.lit("")), F.nullif(option, F.lit("")), F.lit(default))
    now = F.coalesce(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[named], named) if aliases else named
    return F.when(now.isin(*known), now)


def quality_parameters(snapshot: Column, block: Column, shared_workflow: Column, megapixels: float = 0.4, steps: int = 6) -> Column:
    """The parameters of a quality (structs of workflow, megapixels, steps): the job's own if it names a workflow, else those of
    the configuration, whose workflow may be the shared one; NULL without a workflow."""
    filled = lambda q, workflow: F.struct(workflow.alias("workflow"), F.coalesce(F.nullif(q["megapixels"], F.lit(0.0)), F.lit(megapixels)).alias("megapixels"), F.coalesce(F.nullif(q["steps"], F.lit(0)), F.lit(steps)).alias("steps"))
    own = F.coalesce(snapshot["workflow"], F.lit("")) != ""
    other = F.coalesce(F.nullif(block["workflow"], F.lit("")), F.nullif(shared_workflow, F.lit("")))
    return F.when(own, filled(snapshot, snapshot["workflow"])).when(block.isNotNull() & other.isNotNull(), filled(block, other))


def valid_parameters(q: Column, workflows: tuple[str, ...]) -> Column:
    """Whether parameters name a known workflow, and positive megapixels and steps."""
    return F.coalesce(q["workflow"].isin(*workflows) & (q["megapixels"] > 0) & (q["steps"] >= 1), F.lit(False))


def overlaid_parameters(base: Column, overlay: Column, workflows: tuple[str, ...], fallback: Column) -> Column:
    """Parameters with what an overlay sets, field by field; the fallback where the base is no valid set, and NULL where the
    overlay makes it one that isn't."""
    good = F.when(valid_parameters(base, workflows), base).otherwise(fallback)
    merged = F.struct(*[F.coalesce(overlay[f], good[f]).alias(f) for f in ("workflow", "megapixels", "steps")])
    return F.when(overlay.isNull(), good).when(valid_parameters(merged, workflows), merged)


def created(requests: DataFrame, defaults: dict[str, str], stages: tuple[str, ...]) -> DataFrame:
    """New jobs from requests (job_id, at, kind, url, original_path, and options that may be NULL): every stage pending, options
    from the defaults where the request leaves them out."""
    option = lambda name, value: F.coalesce(F.nullif(F.col(name), F.lit("")) if name in requests.columns else F.lit(None).cast("string"), F.lit(value))
    blank = F.struct(F.lit("pending").alias("status"), *[F.lit(None).cast(t).alias(c) for c, t in (("error", "string"), ("started_at", "timestamp"), ("finished_at", "timestamp"))])
    return requests.select(
        "job_id", F.col("at").alias("created_at"), F.col("at").alias("updated_at"), F.lit("pending").alias("state"), F.lit(stages[0]).alias("stage"),
        F.create_map(*[x for s in stages for x in (F.lit(s), blank)]).alias("stages"),
        F.struct("kind", "url", "original_path", F.lit("source/video.mp4").alias("video")).alias("source"),
        F.struct(*[option(n, v).alias(n) for n, v in defaults.items()]).alias("options"),
    )


def patched_reviews(reviews: DataFrame, clips: DataFrame, prompts_: DataFrame) -> DataFrame:
    """Failed reviews of the latest round of each job with their clip and its prompt, for the next draft."""
    last = F.max("round").over(Window.partitionBy("job_id"))
    failed = reviews.withColumn("__last", last).where("round = __last and not coalesce(pass, false)").drop("__last")
    return failed.join(clips, ["job_id", "clip_id"]).join(prompts_, ["job_id", "clip_id"])


def round_passed(reviews: DataFrame) -> DataFrame:
    """Whether all clips passed in the latest round of a job: (job_id, round, passed)."""
    last = reviews.withColumn("__last", F.max("round").over(Window.partitionBy("job_id"))).where("round = __last")
    return last.groupBy("job_id", "round").agg(F.bool_and(F.coalesce("pass", F.lit(False))).alias("passed"))


def mail_ready(enabled: Column, user: Column, password: Column) -> Column:
    """Whether mail can be sent, as (ok, skipped, missing): a mail that is off is fine, and one that is on needs both."""
    off = ~F.coalesce(enabled, F.lit(False))
    lacks = F.filter(F.array(F.when(F.trim(F.coalesce(user, F.lit(""))) == "", "user"), F.when(F.trim(F.coalesce(password, F.lit(""))) == "", "password")), lambda x: x.isNotNull())
    missing = F.when(off, F.array().cast("array<string>")).otherwise(lacks)
    return F.struct((F.size(missing) == 0).alias("ok"), off.alias("skipped"), missing.alias("missing"))
