"""Prompts of clips: assembly, merging of patches, locks of speakers, bundles of rules, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions import text as tx
from timeloom.operators import audit


def assembled(style: Column, scene: Column, speakers: Column, shots: Column, sound: Column, music: Column) -> Column:
    """The text of a prompt: style and scene, a line per speaker (id, lock, voice), per shot (index, at in seconds, text), the sounds."""
    line = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))
    said = F.transform(speakers, lambda s: F.concat_ws(" ", F.concat(F.lit("("), s["id"], F.lit(")")), s["lock"], F.when(F.coalesce(s["voice"], F.lit("")) != "", F.concat(F.lit("Voice: "), s["voice"]))))
    seen = F.transform(F.array_sort(F.transform(shots, lambda s: F.struct(s["index"].alias("index"), s["at"].alias("at"), s["text"].alias("text")))), lambda s: F.concat(F.lit("["), tx.stamp(F.coalesce(s["at"], F.lit(0.0)) * 1000), F.lit("] "), s["text"]))
    return F.concat_ws("\n", line("Style", style), line("Scene", scene), F.array_join(said, "\n"), F.array_join(seen, "\n"), line("Overall soundscape", sound), line("Non-diegetic music", F.coalesce(F.nullif(music, F.lit("")), F.lit("N/A"))))


def merged_shots(base: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Shots of a patch (keys, index, at, text) with what it leaves out taken from the base; shots that only the base has go."""
    b = base.select(*keys, "index", F.col("at").alias("__at"), F.col("text").alias("__text"))
    return patch.join(b, [*keys, "index"], "left").select(*keys, "index", F.coalesce("at", "__at").alias("at"), F.coalesce("text", "__text").alias("text"))


def kept_locks(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Speakers with the lock that they had before, where they had one."""
    o = old.select(*keys, "id", F.col("lock").alias("__lock"))
    return new.join(o, [*keys, "id"], "left").withColumn("lock", F.coalesce(F.nullif("__lock", F.lit("")), "lock")).drop("__lock")


def differing_locks(speakers: DataFrame, key: str, group: str) -> DataFrame:
    """Speakers (key, group, n, id, lock) whose lock isn't the first one of their group, white space aside."""
    w = Window.partitionBy(key, group, "id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.nullif("lock", F.lit("")), ignorenulls=True).over(w)
    return speakers.withColumn("wanted", first).where((F.coalesce("lock", F.lit("")) != "") & (tx.unspaced(F.col("lock")) != tx.unspaced(F.col("wanted"))))


def speakers_of(text: Column) -> Column:
    """Dialogue of a prompt with its speaker: the last mark (S1) in the 400 characters before it (the first speaker of a joint
    mark), or else the speaker of the line before."""
    parts = F.split(text, r"(?s)<d>.*?</d>")
    lines = audit.payloads(text)
    found = F.transform(F.slice(parts, F.lit(1), F.size(lines)), lambda p: F.nullif(F.regexp_extract(F.substring(p, -400, 400), r"(?s).*\((S\d+)(?:,S\d+)*\)", 1), F.lit("")))
    start = F.array().cast("array<string>")
    carried = F.aggregate(found, start, lambda acc, s: F.array_append(acc, F.coalesce(s, F.try_element_at(acc, F.lit(-1)))))
    return F.arrays_zip(carried.alias("speaker"), lines.alias("line"))


def bundle(prompts: DataFrame, banned: tuple[str, ...], fields: tuple[str, ...], mark: str, key: str = "clip_id") -> DataFrame:
    """All one-row rules over prompts (key, text, seconds, speakers, wants_mark, sound, and style and music where there are
    such columns): (key, rule)."""
    t = F.col("text")
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {
        "han": audit.stray_han(t) > 0,
        "header": audit.header_off(t, F.col("seconds")),
        "speakers": F.size(audit.undefined_speakers(t, F.col("speakers"))) > 0,
        "burned": audit.burned_text(t) != "",
        "fields": F.size(audit.missing_fields(t, fields)) > 0,
        "mode": audit.wrong_mode(t, mark, F.col("wants_mark")),
        "sound": empty("sound"),
        **{f"banned:{w}": F.contains(F.lower(t), F.lit(w)) for w in banned},
    }
    if "style" in prompts.columns:
        rules["style"] = empty("style")
    if "music" in prompts.columns:
        rules |= {"music": empty("music"), "music:not N/A": ~empty("music") & (F.upper(F.trim("music")) != "N/A")}
    return audit.violations(prompts, key, rules)


def checked(prompts: DataFrame, shots: DataFrame, allowed: DataFrame, banned: tuple[str, ...], key: str = "clip_id") -> DataFrame:
    """Every rule on whole prompts: (key, rule, detail), one row per violation.

    ``prompts`` are (key, text, seconds, source_seconds, speakers, style, sound, music), ``shots`` (key, index, at, duration)
    in ms, ``allowed`` (key, line) what may be said in a clip. Rows of the rules stand one after another, repeats and all.
    """
    t = F.col("text")
    row = lambda df, rule, detail: df.select(key, F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    many = lambda rule, found: row(prompts.select(key, F.explode(found).alias("__x")), rule, F.col("__x"))
    stamps = audit.shot_stamps(shots, key, "index", "duration")
    beats = prompts.select(key, F.posexplode(F.arrays_zip(*[F.regexp_extract_all(t, F.lit(audit.BEAT), F.lit(i)).alias(c) for i, c in ((1, "a"), (2, "b"))])).alias("n", "x"), (F.col("seconds") * 1000).cast("long").alias("duration"))
    beats = beats.select(key, "duration", *[F.round(F.col(f"x.{c}").cast("double") * 1000).cast("long").alias(d) for c, d in (("a", "t0"), ("b", "t1"))])
    found = [
        stamps.select(key, F.concat(F.lit("shot:"), "rule").alias("rule"), F.col("index").cast("string").alias("detail")),
        row(prompts.join(shots.select(key).distinct(), key, "left_anti"), "shot:none", F.lit("")),
        row(prompts.where(~t.rlike(audit.BEAT)), "beat:none", F.lit("")),
        audit.untiled(beats, key, "duration").select(key, F.concat(F.lit("beat:"), "where").alias("rule"), F.concat_ws("-", "from", "to").alias("detail")),
        row(audit.late_dialogue(prompts, key, "text", "seconds", "source_seconds"), "dialogue:late", F.col("line")),
        row(audit.mistagged(prompts, key, "text"), "dialogue:tag", F.col("tag")),
        row(audit.unknown_dialogue(prompts, allowed, key, "text", "line"), "dialogue:unknown", F.col("said")),
        row(audit.uncovered_speech(prompts, allowed, key, "text", "line"), "dialogue:uncovered", F.col("line")),
        row(audit.repeats(prompts.select(key, F.explode(F.transform(audit.payloads(t), tx.bare_line)).alias("__line")).where("__line <> ''"), key, "__line"), "dialogue:repeated", F.col("__line")),
        row(prompts.where(audit.stray_han(t) > 0), "han", audit.first_han(t)),
        many("speaker", audit.undefined_speakers(t, F.col("speakers"))),
        many("banned", F.filter(F.array(*[F.when(F.contains(F.lower(t), F.lit(w)), F.lit(w)) for w in banned]), lambda x: x.isNotNull())),
        row(prompts.where(audit.burned_text(t) != ""), "burned", audit.burned_text(t)),
        many("thin", audit.thin(t, F.size("speakers") > 0)),
        *[row(prompts.where(F.coalesce(F.trim(c), F.lit("")) == ""), "empty", F.lit(c)) for c in ("style", "sound", "music")],
        row(prompts.where((F.trim("music") != "") & (F.upper(F.trim("music")) != "N/A")), "music", F.col("music")),
    ]
    return every(*found)


def editor_text(name: Column, source: Column, seconds: Column, parts: dict[str, Column], people: Column, beats: Column) -> Column:
    """The text that a person edits: a head, then a section for each of ``parts`` by name, the beats and the people as lists."""
    section = lambda head, body: F.concat(F.lit(f"## {head}\n"), F.coalesce(F.nullif(body, F.lit("")), F.lit("(nothing)")))
    listed = lambda items, f: F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), f(x))), "\n")
    head = F.concat(name, F.lit("\nsource "), source, F.lit(" | clip "), F.format_string("%.2fs", seconds))
    said = listed(people, lambda s: F.concat(F.lit("("), s["id"], F.lit(") "), F.coalesce(s["note"], F.lit(""))))
    return F.concat_ws("\n\n", head, section("Beats", listed(beats, lambda b: b)), *[section(k, v) for k, v in parts.items()], section("People", said))


def review_text(name: Column, parts: dict[str, Column], prompt: Column) -> Column:
    """The text that a reviewer reads: lists of facts (arrays) and notes by section, then the prompt itself."""
    section = lambda head, body: F.concat(F.lit(f"## {head}\n\n"), F.coalesce(F.nullif(body, F.lit("")), F.lit("- (none)")))
    listed = lambda items: F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat_ws("\n\n", F.concat(F.lit("# "), name), *[section(k, listed(v)) for k, v in parts.items()], F.concat(F.lit("## Prompt\n\n```text\n"), F.trim(prompt), F.lit("\n```\n")))


def every(*found: DataFrame, distinct: bool = False) -> DataFrame:
    """All violations one after another; repeated ones count unless ``distinct``."""
    rows = reduce(DataFrame.unionByName, found)
    return rows.distinct() if distinct else rows


def report(violations: DataFrame, key: str) -> DataFrame:
    """A markdown report per job of its violations (key, clip_id, rule)."""
    line = F.concat(F.lit("- "), F.col("clip_id"), F.lit(": "), F.col("rule"))
    return violations.withColumn("__line", line).groupBy(key).agg(F.concat(F.lit("# Audit\n\n"), F.array_join(F.array_sort(F.collect_list("__line")), "\n")).alias("document"))


def missing_files(expected: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Expected files that a listing lacks."""
    return expected.join(listing.select(path).distinct(), path, "left_anti")


def unmatched(clips: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Clips without an entry in the index of prompts, and entries without a clip: (keys, side)."""
    a, b = clips.select(*keys).distinct(), index.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("no prompt")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("no clip")))


def pack_statistics(clips: DataFrame, key: str) -> DataFrame:
    """Clips, those that came of a split, padded ones, and the largest drift."""
    return clips.groupBy(key).agg(F.count("*").alias("clips"), F.count_if(F.col("part") > 0).alias("splits"), F.count_if("padded").alias("pads"), F.max(F.abs("drift")).alias("worst_drift"))


def end_cards(events: DataFrame, key: str) -> DataFrame:
    """How many events of each job are end cards; 0 for a job without one."""
    return events.groupBy(key).agg(F.count_if(F.col("kind") == "endcard").alias("end_cards"))


def sections(text: Column) -> Column:
    """The sections of a markdown text by heading; placeholders in brackets are empty."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n#+[ \t]+"), lambda s: tx.trimmed(s) != "")
    entry = lambda s: F.struct(tx.trimmed(F.substring_index(s, "\n", 1)).alias("key"), F.regexp_replace(tx.trimmed(F.regexp_replace(s, r"^[^\n]*(\n|$)", "")), r"^[(（][^)）]*[)）]$", "").alias("value"))
    heads = F.filter(F.transform(parts, entry), lambda e: e["key"] != "")
    # of sections with the same heading the first counts
    first = F.aggregate(heads, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, e: F.when(F.exists(acc, lambda x: x["key"] == e["key"]), acc).otherwise(F.array_append(acc, e)))
    return F.map_from_entries(first)


def bullets(section: Column) -> Column:
    """The items of a list, without their marks."""
    return F.filter(F.transform(F.split(section, "\n"), lambda s: tx.trimmed(F.regexp_replace(s, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda s: s != "")
