"""Registered queries of the operators for clips, prompts, views and graphs, over rows made of the driver's tables, each with
equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeloom.functions import text as tx
from timeloom.functions import timegrid as tg
from timeloom.operators import audit, beats, boundaries, clips, delivery, dialogue, events, graph, intervals, jobs, metadata, prompts, retime, screen, views
from timeloom.operators.scans import dealt
from timeloom.plans.catalog import HOP, TIMELINE, TURNS, WIDE, query, table, timeline, turns

SLOT = 21_600_000

# Windows of six hours of a user's events: clicks are adults, sign-ups children, errors text.


def films(spark, sf):
    """The timeline dealt out by its key, as all that follows sorts and groups by it."""
    return dealt(timeline(spark, sf), "job_id")


def slots(tl: DataFrame) -> DataFrame:
    first = F.min("t").over(Window.partitionBy("job_id"))
    rel = tl.withColumn("r", F.col("t") - first)
    g = rel.groupBy("job_id", F.floor(F.col("r") / SLOT).alias("ord")).agg(
        F.count_if(F.col("kind") == "click").cast("int").alias("adults"),
        F.nullif(F.count_if(F.col("kind") == "signup"), F.lit(0)).cast("int").alias("children"),
        F.bool_or(F.col("kind") == "error").alias("has_text"),
        F.array_sort(F.collect_list(F.struct((F.col("r") / 1000.0).alias("t"), F.col("kind").alias("see")))).alias("cells"),
    )
    return g.select("*", (F.col("ord") * SLOT).alias("t0"), (F.col("ord") * SLOT + SLOT).alias("t1"), F.when(F.col("ord") % 29 == 7, "no answer").alias("error"))


def relative(tl: DataFrame) -> DataFrame:
    return tl.withColumn("t", F.col("t") - F.min("t").over(Window.partitionBy("job_id")))


REL = f"{TIMELINE}, rl AS (SELECT job_id, ord, kind, value, t - min(t) OVER (PARTITION BY job_id) AS t FROM tl)"
SLOTS = f"""{REL}, sl AS (SELECT job_id, t // {SLOT} AS ord, count(*) FILTER (kind = 'click') AS adults, nullif(count(*) FILTER (kind = 'signup'), 0) AS children, bool_or(kind = 'error') AS has_text,
t // {SLOT} * {SLOT} AS t0, t // {SLOT} * {SLOT} + {SLOT} AS t1, CASE WHEN t // {SLOT} % 29 = 7 THEN 'no answer' END AS error FROM rl GROUP BY job_id, t // {SLOT})"""


@query(f"""WITH {SLOTS}, pe AS (SELECT *, adults + coalesce(children, 0) AS p FROM sl), ch AS (SELECT *, p <> lag(p) OVER (PARTITION BY job_id ORDER BY ord) AS changed FROM pe),
cu AS (SELECT s.job_id, s.ord, count(*) AS n FROM sl s JOIN rl c ON c.job_id = s.job_id AND c.kind = 'purchase' AND c.t > s.t0 + 40 AND c.t < s.t1 - 40 GROUP BY ALL),
sp AS (SELECT s.job_id, s.ord, count(*) AS n FROM sl s JOIN rl c ON c.job_id = s.job_id AND c.kind = 'view' AND c.t < s.t1 AND s.t0 < c.t + 60000 GROUP BY ALL),
te AS (SELECT s.job_id, s.ord, count(*) AS n FROM sl s JOIN rl c ON c.job_id = s.job_id AND c.kind = 'error' AND c.ord % 3 <> 0 AND c.t < s.t1 AND s.t0 < c.t + 600000 GROUP BY ALL)
SELECT ch.job_id, ch.ord, CASE WHEN error IS NOT NULL THEN 'error' ELSE array_to_string(list_filter([CASE WHEN coalesce(cu.n, 0) > 0 THEN 'cut' END, CASE WHEN changed THEN 'people' END, CASE WHEN coalesce(sp.n, 0) >= 2 THEN 'speech' END, CASE WHEN (coalesce(te.n, 0) > 0) <> has_text THEN 'text' END], lambda x: x IS NOT NULL), ',') END AS flags
FROM ch LEFT JOIN cu USING (job_id, ord) LEFT JOIN sp USING (job_id, ord) LEFT JOIN te USING (job_id, ord)""")
def beat_flags(spark, sf):
    tl = films(spark, sf)
    r = relative(tl)
    spans = lambda kind, length: r.where(F.col("kind") == kind).select("job_id", F.col("t").alias("t0"), (F.col("t") + length).alias("t1"), F.when(F.col("ord") % 3 != 0, F.col("kind")).otherwise(" ").alias("text"))
    got = beats.flags(slots(tl), r.where("kind = 'purchase'").select("job_id", "t"), spans("view", 60_000), spans("error", 600_000), "job_id")
    return got.select("job_id", "ord", F.array_join("flags", ",").alias("flags"))


@query(f"""WITH {SLOTS}, e AS (SELECT job_id, max(t) + 1 AS duration FROM rl GROUP BY job_id), g AS (SELECT job_id, unnest(range(0, greatest(0, ceil(duration / {SLOT / 2})::BIGINT - 1) + 1)) * {SLOT // 2} AS t FROM e),
h AS (SELECT g.job_id, g.t, sl.ord, sl.adults, sl.children FROM g LEFT JOIN sl ON g.job_id = sl.job_id AND g.t >= sl.t0 AND g.t < sl.t1),
c AS (SELECT job_id, t // {SLOT} AS ord, t / 1000.0 AS ct, kind, ord AS o FROM rl), n AS (SELECT h.job_id, h.t, arg_min(kind, (abs(ct * 1000 - h.t), ct, kind)) AS see FROM h JOIN c ON c.job_id = h.job_id AND c.ord = h.ord AND abs(ct * 1000 - h.t) <= {SLOT / 4 + 10} GROUP BY ALL),
x AS (SELECT job_id, ord AS o, t AS x0, t + 600000 AS x1, 'text ' || ord % 3 AS text FROM rl WHERE kind = 'error'),
r AS (SELECT job_id, t, string_agg(text, ' / ' ORDER BY o, text) AS read FROM (SELECT g.job_id, g.t, text, min(o) AS o FROM g JOIN x ON g.job_id = x.job_id AND g.t >= x0 AND g.t < x1 + {SLOT // 4} GROUP BY ALL) GROUP BY ALL)
SELECT h.job_id, h.t, adults::INT AS adults, children::INT AS children, see, coalesce(read, '') AS read FROM h LEFT JOIN n USING (job_id, t) LEFT JOIN r USING (job_id, t)""")
def beat_ticks(spark, sf):
    tl = films(spark, sf)
    r = relative(tl)
    ends = r.groupBy("job_id").agg((F.max("t") + 1).alias("duration"))
    texts = r.where("kind = 'error'").select("job_id", "ord", F.col("t").alias("t0"), (F.col("t") + 600_000).alias("t1"), F.concat(F.lit("text "), (F.col("ord") % 3).cast("string")).alias("text"))
    return beats.ticks(ends, slots(tl), texts, "job_id", SLOT // 2)


@query(f"""WITH {SLOTS}, s AS (SELECT *, lead(t0) OVER (PARTITION BY job_id ORDER BY t0) - t0 AS gap FROM sl), e AS (SELECT job_id, max(t) AS duration FROM rl GROUP BY job_id)
SELECT e.job_id, coalesce(max(gap), 0) <= {SLOT} + 100 AND max(t1) >= any_value(duration) - 600 AND NOT bool_or(error IS NOT NULL) AS complete FROM e JOIN s USING (job_id) GROUP BY e.job_id""")
def beat_coverage(spark, sf):
    tl = films(spark, sf)
    ends = relative(tl).groupBy("job_id").agg(F.max("t").alias("duration"))
    return beats.complete(slots(tl).withColumn("raw", F.lit("x")), ends, "job_id", SLOT)


@query(f"WITH {SLOTS} SELECT job_id, count(*) AS n FROM sl WHERE error IS NOT NULL GROUP BY job_id")
def visual_gate(spark, sf):
    return audit.blocked(slots(films(spark, sf)), "job_id", beats.failed(F.lit("x"), F.col("error")))


# The five signals of a film from a user's events, and the times between purchases as what is not held in a window.


@query(f"""WITH {SLOTS}, sp AS (SELECT job_id, t AS t0, t + 60000 AS t1 FROM rl WHERE kind = 'view'), la AS (SELECT job_id, max(t1) AS z FROM sp GROUP BY job_id), en AS (SELECT job_id, max(t) + 1000 AS duration FROM rl GROUP BY job_id),
a AS (SELECT c.job_id, c.t, CASE WHEN coalesce(z, 0) > 200 AND c.t > coalesce(z, 0) + 500 THEN 'tail-cut' ELSE 'cut' END AS reason FROM rl c LEFT JOIN la USING (job_id) WHERE kind = 'purchase'),
b AS (SELECT job_id, t0 AS t, 'people' AS reason FROM (SELECT job_id, t0, adults + coalesce(children, 0) AS p, lag(adults + coalesce(children, 0)) OVER (PARTITION BY job_id ORDER BY ord) AS q FROM sl) WHERE p <> q),
c AS (SELECT job_id, (t0 + e) // 2 AS t, 'gap' AS reason FROM (SELECT *, lag(t1) OVER (PARTITION BY job_id ORDER BY t0, t1) AS e FROM sp) WHERE t0 - e >= 350),
ti AS (SELECT job_id, t, CASE WHEN ord % 2 = 0 THEN 'first title of the film' ELSE 'another one altogether' END AS text FROM rl WHERE kind = 'error'), bl AS (SELECT job_id, t, list_sort(list(DISTINCT text)) AS lines FROM ti GROUP BY ALL),
d AS (SELECT job_id, t, 'title' AS reason FROM (SELECT *, lag(lines) OVER (PARTITION BY job_id ORDER BY t) AS old FROM bl) WHERE old IS NOT NULL AND len(list_intersect(lines, old)) * 2 < len(lines)),
e AS (SELECT job_id, z AS t, 'tail-silent' AS reason FROM en JOIN la USING (job_id) WHERE duration - z >= 400)
SELECT job_id, t, reason FROM (FROM a UNION ALL FROM b UNION ALL FROM c UNION ALL FROM d UNION ALL FROM e)""")
def story_signals(spark, sf):
    tl = films(spark, sf)
    r = relative(tl)
    speech = r.where("kind = 'view'").select("job_id", F.col("t").alias("t0"), (F.col("t") + 60_000).alias("t1"))
    titles = r.where("kind = 'error'").select("job_id", "t", F.when(F.col("ord") % 2 == 0, "first title of the film").otherwise("another one altogether").alias("text"))
    ends = r.groupBy("job_id").agg((F.max("t") + 1000).alias("duration"))
    return boundaries.story_signals(r.where("kind = 'purchase'").select("job_id", "t"), speech, slots(tl), titles, ends)


@query(f"WITH {SLOTS} SELECT job_id, ord FROM sl WHERE EXISTS (SELECT 1 FROM rl WHERE rl.job_id = sl.job_id AND kind = 'purchase' AND rl.t > sl.t0 + 40 AND rl.t < sl.t1 - 40)")
def windows_with_cut(spark, sf):
    tl = films(spark, sf)
    return intervals.holding_point(slots(tl), relative(tl).where("kind = 'purchase'").select("job_id", "t"), "job_id").select("job_id", "ord")


# Clips of three turns of a conversation; a turn is spoken where it is laid out.

SPOKEN = f"{TURNS}, sc AS (SELECT *, (ord * 2500)::BIGINT AS t0, (ord * 2500 + play)::BIGINT AS t1 FROM tu), cp AS (SELECT job_id, ord // 3 AS clip, min(t0) AS t0, max(t1) AS t1, bool_or(role = 'system') AS cast_reset FROM sc GROUP BY job_id, ord // 3)"
OWNED = f"""{SPOKEN}, ow AS (SELECT s.job_id, s.ord, any_value(s.t0) AS t0, any_value(s.text) AS text, arg_min(c.clip, (-(least(s.t1, c.t1) - greatest(s.t0, c.t0)), c.t0, c.clip)) AS clip
FROM sc s JOIN cp c ON s.job_id = c.job_id AND least(s.t1, c.t1) - greatest(s.t0, c.t0) > 50 WHERE s.role <> 'system' GROUP BY s.job_id, s.ord),
ls AS (SELECT job_id, clip, coalesce(list(trim(text) ORDER BY t0, ord) FILTER (trim(coalesce(text, '')) <> ''), []) AS lines FROM ow GROUP BY job_id, clip)"""


def spoken(spark, sf):
    return turns(spark, sf).select("*", (F.col("ord") * 2500).alias("t0"), (F.col("ord") * 2500 + F.col("play")).alias("t1"))


def story_clips(spark, sf):
    g = spoken(spark, sf).groupBy("job_id", F.floor(F.col("ord") / 3).alias("clip"))
    return g.agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.bool_or(F.col("role") == "system").alias("cast_reset")).withColumn("n", F.col("clip"))


def owned_lines(spark, sf):
    lines = spoken(spark, sf).where("role <> 'system'").select("job_id", F.col("ord").alias("line"), "t0", "t1", "text")
    return clips.texts_of(clips.speech_of(story_clips(spark, sf), lines, "job_id"), "job_id")


@query(f"WITH {OWNED} SELECT job_id, clip, md5(array_to_string(lines, '|')) AS lines, len(lines) AS n FROM ls")
def clip_speech(spark, sf):
    return owned_lines(spark, sf).select("job_id", "clip", F.md5(F.array_join("lines", "|").cast("binary")).alias("lines"), F.size("lines").cast("long").alias("n"))


@query(f"""WITH {OWNED}, j AS (SELECT cp.job_id, cp.clip, cast_reset, md5(array_to_string(lines, '|')) AS m FROM cp LEFT JOIN ls USING (job_id, clip))
SELECT job_id, clip, lag(m) OVER w AS before, lead(m) OVER w AS after, CASE WHEN NOT cast_reset AND NOT coalesce(lag(cast_reset) OVER w, false) THEN lag(clip) OVER w END AS thread FROM j WINDOW w AS (PARTITION BY job_id ORDER BY clip)""")
def clip_neighbours(spark, sf):
    md5 = lambda c: F.md5(F.array_join(c, "|").cast("binary"))
    got = clips.neighbours(story_clips(spark, sf), owned_lines(spark, sf), "job_id")
    return got.select("job_id", "clip", md5("lines_before").alias("before"), md5("lines_after").alias("after"), "thread")


@query(f"""WITH {OWNED}, wi AS (SELECT job_id, ord AS w, t0 - 700 AS t0, t1 + 300 AS t1, CASE WHEN role = 'user' THEN ord % 3 END AS adults, CASE WHEN role = 'assistant' THEN length(text) % 2 END AS children FROM sc),
p AS (SELECT c.job_id, c.clip, w, least(c.t1, i.t1) - greatest(c.t0, i.t0) AS shared, greatest(400, c.t1 - c.t0) AS span, i.t0 >= c.t0 - 200 AND NOT (i.t1 > c.t1 + 200 AND i.t0 > c.t0 + 400) AS own, adults, children FROM cp c JOIN wi i ON i.job_id = c.job_id AND i.t0 < c.t1 AND c.t0 < i.t1),
q AS (SELECT *, CASE WHEN own AND shared >= least(1000, greatest(400, round_even(span * 45 / 100, 0))) THEN 1 WHEN own THEN 2 ELSE 3 END AS tier FROM p WHERE shared > 10),
r AS (SELECT *, min(tier) OVER (PARTITION BY job_id, clip) AS best, row_number() OVER (PARTITION BY job_id, clip ORDER BY shared DESC, w) AS n FROM q)
SELECT job_id, clip, max(adults)::BIGINT AS adults, max(children)::BIGINT AS children FROM r WHERE tier = best AND (tier < 3 OR n = 1) GROUP BY job_id, clip""")
def clip_people(spark, sf):
    w = spoken(spark, sf).select("job_id", F.col("ord").alias("window"), (F.col("t0") - 700).alias("t0"), (F.col("t1") + 300).alias("t1"), F.when(F.col("role") == "user", F.col("ord") % 3).cast("long").alias("adults"), F.when(F.col("role") == "assistant", F.length("text") % 2).cast("long").alias("children"))
    covering = intervals.tiered(story_clips(spark, sf), w, "job_id", "clip", "window").join(w.drop("t0", "t1"), ["job_id", "window"])
    return clips.most_people(covering, "job_id")


@query(f"""WITH {SPOKEN} SELECT job_id, array_to_string(list(t ORDER BY o), '|') AS terms FROM (SELECT job_id, t, o, row_number() OVER (PARTITION BY job_id ORDER BY o) AS n FROM (SELECT job_id, trim(role) AS t, min(ord) AS o FROM sc WHERE length(trim(role)) BETWEEN 2 AND 14 GROUP BY ALL)) WHERE n <= 2 GROUP BY job_id""")
def caption_vocabulary(spark, sf):
    return clips.vocabulary(spoken(spark, sf).select("job_id", "ord", F.col("role").alias("text")), "job_id", most=2).select("job_id", F.array_join("terms", "|").alias("terms"))


@query(f"""WITH {SPOKEN} SELECT job_id, md5(string_agg(printf('%.2f-%.2fs  ', t0 / 1000, t1 / 1000) || trim(text) || '  ' || role, chr(10) ORDER BY ord)) AS text FROM sc WHERE trim(coalesce(text, '')) <> '' GROUP BY job_id""")
def span_rendering(spark, sf):
    return clips.span_lines(spoken(spark, sf), "job_id", "role").select("job_id", F.md5(F.col("text").cast("binary")).alias("text"))


@query(f"""WITH {SPOKEN} SELECT job_id, array_to_string(list_sort(list(DISTINCT t1)), ',') AS ends FROM (SELECT job_id, t1 FROM sc WHERE role = 'user' UNION SELECT job_id, t1 FROM sc WHERE role = 'assistant') GROUP BY job_id""")
def sentence_ends(spark, sf):
    s = spoken(spark, sf)
    return clips.sentence_ends("job_id", s.where("role = 'user'"), s.where("role = 'assistant'")).groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_list("t1")), ",").alias("ends"))


# Prompts made of turns: every rule has texts that break it.

PROMPT = f"""{TURNS}, pr AS (SELECT job_id * 1000 + ord AS clip_id, 'The video aligns with the ' || CASE WHEN ord % 4 = 0 THEN '5.50' ELSE '4.50' END || '-second mark. ' || CASE WHEN ord % 3 = 0 THEN 'Identity lock: coat. ' ELSE '' END || 'Scene Lock: hall. ' ||
'(S1) stands. (S1,S2) look. From 0.00 to ' || CASE WHEN ord % 5 = 0 THEN '2.00' ELSE '4.50' END || ' they talk <d>[' || CASE WHEN ord % 6 = 0 THEN 'English' ELSE 'Chinese' END || '] line ' || ord % 3 || '</d> ' ||
CASE job_id % 5 WHEN 0 THEN 'a logo appears' WHEN 1 THEN 'no logo appears' WHEN 2 THEN 'four large Chinese characters' WHEN 3 THEN 'an on-screen text' ELSE 'beautiful light 好' END || CASE WHEN ord % 7 = 0 THEN ' <Picture 1>' ELSE '' END AS text,
CASE WHEN ord % 2 = 0 THEN ['S1', 'S2'] ELSE ['S1'] END AS speakers, job_id % 3 = 0 AS wants, CASE WHEN ord % 8 = 1 THEN ' ' ELSE 'wind' END AS sound, CASE WHEN ord % 9 = 2 THEN 'piano' ELSE 'N/A' END AS music, ord, job_id FROM tu)"""


def made_prompts(spark, sf):
    j, o = F.col("job_id"), F.col("ord")
    text = F.concat(
        F.lit("The video aligns with the "), F.when(o % 4 == 0, "5.50").otherwise("4.50"), F.lit("-second mark. "), F.when(o % 3 == 0, "Identity lock: coat. ").otherwise(""), F.lit("Scene Lock: hall. "),
        F.lit("(S1) stands. (S1,S2) look. From 0.00 to "), F.when(o % 5 == 0, "2.00").otherwise("4.50"), F.lit(" they talk <d>["), F.when(o % 6 == 0, "English").otherwise("Chinese"), F.lit("] line "), (o % 3).cast("string"), F.lit("</d> "),
        F.when(j % 5 == 0, "a logo appears").when(j % 5 == 1, "no logo appears").when(j % 5 == 2, "four large Chinese characters").when(j % 5 == 3, "an on-screen text").otherwise("beautiful light 好"), F.when(o % 7 == 0, " <Picture 1>").otherwise(""),
    )
    return turns(spark, sf).select(
        (j * 1000 + o).alias("clip_id"), text.alias("text"), F.lit(4.5).alias("seconds"), F.lit(3.0).alias("source_seconds"), F.when(o % 2 == 0, F.array(F.lit("S1"), F.lit("S2"))).otherwise(F.array(F.lit("S1"))).alias("speakers"), (j % 3 == 0).alias("wants_mark"),
        F.when(o % 8 == 1, " ").otherwise("wind").alias("sound"), F.when(o % 9 == 2, "piano").otherwise("N/A").alias("music"), F.lit("plain").alias("style"), "ord", "job_id",
    )


FIELDS = ("overall_soundscape:",)
BURNED = "(job_id % 5 = 0 OR job_id % 5 = 2)"


@query(f"""WITH {PROMPT} SELECT clip_id, rule FROM (SELECT clip_id, unnest(list_filter([CASE WHEN job_id % 5 = 4 THEN 'han' END, CASE WHEN ord % 4 = 0 THEN 'header' END, CASE WHEN len(speakers) < 2 THEN 'speakers' END, CASE WHEN {BURNED} THEN 'burned' END, 'fields',
CASE WHEN contains(text, '<Picture 1>') <> wants THEN 'mode' END, CASE WHEN trim(sound) = '' THEN 'sound' END, CASE WHEN contains(lower(text), 'on-screen text') THEN 'banned:on-screen text' END, CASE WHEN music <> 'N/A' THEN 'music:not N/A' END], lambda x: x IS NOT NULL)) AS rule FROM pr)""")
def prompt_bundle(spark, sf):
    return prompts.bundle(made_prompts(spark, sf), audit.BANNED, FIELDS, "<Picture 1>")


@query(f"""WITH {PROMPT} SELECT clip_id, array_to_string(list_filter([CASE WHEN NOT contains(lower(text), 'identity lock') THEN 'identity lock' END, CASE WHEN len(speakers) > 1 THEN 'voice lock' END, CASE WHEN contains(text, 'beautiful') THEN 'beautiful' END], lambda x: x IS NOT NULL), ',') AS thin FROM pr""")
def prompt_density(spark, sf):
    return made_prompts(spark, sf).select("clip_id", F.array_join(audit.thin(F.col("text"), F.size("speakers") > 1), ",").alias("thin"))


@query(f"WITH {PROMPT} SELECT clip_id, '[English]' AS tag FROM pr WHERE ord % 6 = 0")
def prompt_tags(spark, sf):
    return audit.mistagged(made_prompts(spark, sf), "clip_id", "text")


@query(f"WITH {PROMPT} SELECT clip_id, 'line ' || ord % 3 AS line, 4.5::DOUBLE AS ends FROM pr WHERE ord % 5 <> 0")
def dialogue_past_trim(spark, sf):
    return audit.late_dialogue(made_prompts(spark, sf), "clip_id", "text", "seconds", "source_seconds")


@query(f"WITH {PROMPT} SELECT clip_id, 'line ' || ord % 3 AS said FROM pr WHERE ord % 3 = 2")
def dialogue_unknown(spark, sf):
    p = made_prompts(spark, sf)
    allowed = p.select("clip_id", F.explode(F.array(F.lit("line 0"), F.lit(" line1"))).alias("line"))
    return audit.unknown_dialogue(p, allowed, "clip_id", "text", "line")


@query(f"WITH {PROMPT} SELECT clip_id, n AS line FROM pr, (VALUES ('line 0!'), ('line')) v(n) WHERE n <> 'line' AND ord % 3 <> 0")
def dialogue_uncovered(spark, sf):
    p = made_prompts(spark, sf)
    needed = p.select("clip_id", F.explode(F.array(F.lit("line 0!"), F.lit("line"))).alias("line"))
    return audit.uncovered_speech(p, needed, "clip_id", "text", "line").select("clip_id", "line")


@query(f"WITH {PROMPT} SELECT clip_id, 'S1' AS speaker, 'line ' || ord % 3 AS line FROM pr")
def dialogue_speakers(spark, sf):
    return made_prompts(spark, sf).select("clip_id", F.explode(prompts.speakers_of(F.col("text"))).alias("x")).select("clip_id", "x.speaker", "x.line")


SHOTS = """sh AS (SELECT l_orderkey AS clip_id, l_linenumber AS i, CASE WHEN l_linenumber = 1 AND l_orderkey % 3 <> 0 THEN NULL WHEN l_suppkey % 4 = 0 THEN NULL ELSE (l_linenumber - 1) * 800 + l_partkey % 5 * 300 END AS stamp FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey))"""


@query(f"""WITH {SHOTS}, n AS (SELECT *, row_number() OVER w AS n, lead(i) OVER w IS NULL AS last, CASE WHEN row_number() OVER w > 1 THEN stamp END AS a FROM sh WINDOW w AS (PARTITION BY clip_id ORDER BY i)),
b AS (SELECT *, coalesce(last_value(a IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(last_value(a IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto FROM n)
SELECT clip_id, i AS shot, unnest(list_filter([CASE WHEN n = 1 AND stamp IS NOT NULL THEN 'stamped' END, CASE WHEN n > 1 AND stamp IS NULL THEN 'unstamped' END, CASE WHEN a >= 4500 THEN 'late' END, CASE WHEN a < 4500 AND a - before < 600 THEN 'short' END, CASE WHEN last AND n > 1 AND 4500 - upto < 600 THEN 'tail' END], lambda x: x IS NOT NULL)) AS rule FROM b""")
def shot_stamps(spark, sf):
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey")
    rows = table(spark, sf, "lineitem").withColumn("n", F.row_number().over(w)).where("n = 1")
    at = F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 3 != 0), None).when(F.col("l_suppkey") % 4 == 0, None).otherwise((F.col("l_linenumber") - 1) * 800 + F.col("l_partkey") % 5 * 300)
    shots = rows.select(F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").alias("shot"), at.alias("at"), F.lit(4500).alias("duration"))
    return audit.shot_stamps(shots, "clip_id", "shot", "duration")


# Jobs of customers, clips of their orders.

CLIPS = """cl AS (SELECT o_custkey AS job_id, 'c' || o_orderkey AS clip_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'running' ELSE 'pending' END AS ds, o_orderkey % 7 = 0 AS dd,
CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'done' WHEN o_orderkey % 11 = 0 THEN 'error' ELSE 'pending' END AS fs, o_orderkey % 13 = 0 AS fd, o_orderkey % 5 <> 0 AS hs FROM orders)"""
TILE = """CASE WHEN {s} = 'running' THEN 'generating' WHEN {s} = 'error' THEN 'failed' WHEN NOT hs AND {s} = 'done' THEN 'stale' WHEN NOT hs THEN 'no_script' WHEN {s} = 'done' AND ({d}) THEN 'stale' WHEN {s} = 'done' THEN 'ready' ELSE 'pending' END"""
DRAFT, FINAL = TILE.format(s="ds", d="dd"), TILE.format(s="fs", d="fd OR dd")


def order_clips(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    status = F.col("o_orderstatus")
    draft = F.struct(F.when(status == "F", "done").when(status == "P", "running").otherwise("pending").alias("status"), (k % 7 == 0).alias("dirty"))
    final = F.struct(F.when((status == "F") & (k % 3 == 0), "done").when(k % 11 == 0, "error").otherwise("pending").alias("status"), (k % 13 == 0).alias("dirty"))
    return o.select(F.col("o_custkey").alias("job_id"), F.concat(F.lit("c"), k.cast("string")).alias("clip_id"), draft.alias("draft"), final.alias("final"), (k % 5 != 0).alias("has_script"))


@query(f"WITH {CLIPS} SELECT job_id, clip_id, {DRAFT} AS draft, {FINAL} AS final FROM cl")
def clip_tiles(spark, sf):
    tile = lambda q: screen.clip_state(F.col("draft"), F.col("final"), q, F.col("has_script"))
    return order_clips(spark, sf).select("job_id", "clip_id", tile("draft").alias("a"), tile("final").alias("b")).withColumnsRenamed({"a": "draft", "b": "final"})


@query(f"""WITH {CLIPS}, s AS (SELECT job_id, 'draft' AS quality, {DRAFT} AS s FROM cl UNION ALL SELECT job_id, 'final', {FINAL} FROM cl)
SELECT job_id, quality, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'ready') AS ready, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'stale') AS stale, count(*) FILTER (s = 'generating') AS generating, count(*) FILTER (s = 'no_script') AS no_script FROM s GROUP BY ALL""")
def tile_counts(spark, sf):
    return screen.counted_states(order_clips(spark, sf))


@query(f"""WITH {CLIPS}, t AS (SELECT *, {DRAFT} AS s, ds <> 'done' OR dd AS need, fs <> 'done' OR fd AS fneed FROM cl), a AS (SELECT *, s IN ('pending', 'stale') OR dd OR fd AS work, bool_or(s IN ('pending', 'stale') OR dd OR fd) OVER (PARTITION BY job_id) AS any_work FROM t)
SELECT 'scripts' AS batch, job_id, clip_id FROM a WHERE NOT hs UNION ALL SELECT 'ai', job_id, clip_id FROM a WHERE CASE WHEN any_work THEN work ELSE hs END UNION ALL SELECT 'drafts', job_id, clip_id FROM a WHERE need UNION ALL SELECT 'finals', job_id, clip_id FROM a WHERE NOT need AND fneed UNION ALL SELECT 'rest', job_id, clip_id FROM a WHERE s IN ('pending', 'failed')""")
def batch_recommended(spark, sf):
    c = order_clips(spark, sf)
    parts = {"scripts": ("scripts", "draft"), "ai": ("ai", "draft"), "drafts": ("videos", "draft"), "finals": ("videos", "final"), "rest": ("rest", "draft")}
    return prompts.every(*[screen.recommended(c, kind, quality).select(F.lit(name).alias("batch"), "job_id", "clip_id") for name, (kind, quality) in parts.items()])


FACTS = f"""{CLIPS}, fa AS (SELECT job_id, bool_and(ds = 'done') AS drafts_ready, bool_and(fs = 'done') AS finals_ready, bool_or(ds <> 'done' OR dd) AS draft_due, bool_or(NOT (ds <> 'done' OR dd) AND (fs <> 'done' OR fd)) AS final_due, bool_or(dd OR fd) AS dirty, bool_and(fs = 'done' AND NOT fd AND NOT dd) AS can_assemble, count(*) AS n_clips FROM cl GROUP BY job_id)"""


@query(f"WITH {FACTS} SELECT * FROM fa")
def clip_readiness(spark, sf):
    return screen.clip_facts(order_clips(spark, sf))


STATES = "['running', 'paused', 'failed', 'done', 'cancelled', 'queued']"
NAMES = ("download", "pagemeta", "understand", "script", "precheck", "generate", "finish")
STATUSES = ("done", "skipped", "running", "waiting", "failed", "pending")


def _status_sql(i: int, name: str) -> str:
    """The status of stage i of customer k: done for most, so that every stage is the first open one of some."""
    return f"CASE WHEN k % {i + 5} <> 0 THEN 'done' ELSE [{', '.join(repr(s) for s in STATUSES)}][k % 6 + 1] END AS {name}"


JOBS = f"""{FACTS}, jo AS (SELECT k AS job_id, {STATES}[k % 6 + 1] AS state, k % 17 = 0 AS running, {', '.join(_status_sql(i, n) for i, n in enumerate(NAMES))}, CASE WHEN k % 4 = 0 THEN 'final' END AS last_quality,
coalesce(drafts_ready, false) AS drafts_ready, coalesce(finals_ready, false) AS finals_ready, coalesce(draft_due, false) AS draft_due, coalesce(final_due, false) AS final_due, coalesce(dirty, false) AND k % 2 = 0 AS dirty FROM (SELECT c_custkey AS k FROM customer) LEFT JOIN fa ON fa.job_id = k)"""


def customer_jobs(spark, sf):
    k = F.col("job_id")
    pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i + 1).cast("int"))
    blank = lambda i: F.struct(F.when(k % (i + 5) != 0, "done").otherwise(pick(STATUSES, k % 6)).alias("status"), F.lit("").alias("error"))
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id")).select(
        "job_id", pick(("running", "paused", "failed", "done", "cancelled", "queued"), k % 6).alias("state"), (k % 17 == 0).alias("running"),
        F.create_map(*[x for i, n in enumerate(NAMES) for x in (F.lit(n), blank(i))]).alias("stages"), F.when(k % 4 == 0, "final").alias("last_quality"), F.lit("download").alias("stage"),
    )
    facts = base.join(screen.clip_facts(order_clips(spark, sf)), "job_id", "left")
    for c in ("drafts_ready", "finals_ready", "draft_due", "final_due", "dirty"):
        facts = facts.withColumn(c, F.coalesce(c, F.lit(False)))
    return facts.withColumn("dirty", F.col("dirty") & (k % 2 == 0))


EARLY = NAMES[:5]
OPEN = " ".join(f"WHEN {n} NOT IN ('done', 'skipped') THEN '{n}'" for n in EARLY)
ACTION = f"""CASE WHEN running THEN 'busy' WHEN state = 'cancelled' THEN 'cancelled' WHEN state = 'failed' THEN 'retry' WHEN dirty THEN 'redraft' WHEN state = 'done' THEN 'done' {OPEN} WHEN NOT drafts_ready THEN 'draft' WHEN NOT finals_ready THEN 'final' WHEN finish NOT IN ('done', 'skipped') THEN 'assemble' ELSE 'done' END"""


@query(f"""WITH {JOBS} SELECT job_id, {ACTION} AS action, CASE WHEN finish IN ('running', 'done') THEN 'finish' WHEN generate = 'running' THEN CASE WHEN last_quality = 'final' OR drafts_ready THEN 'clips' ELSE 'draft' END WHEN generate IN ('failed', 'waiting') THEN CASE WHEN drafts_ready THEN 'clips' ELSE 'draft' END {OPEN} WHEN finals_ready THEN 'clips' ELSE 'draft' END AS shown FROM jo""")
def job_next_action(spark, sf):
    return customer_jobs(spark, sf).select("job_id", jobs.next_action().alias("action"), jobs.shown_stage().alias("shown"))


BUSY = " ".join(f"WHEN {n} IN ('running', 'waiting', 'failed') THEN '{n}'" for n in EARLY)
RUNS = "generate IN ('running', 'waiting')"
LATE = "coalesce(last_quality, '') = 'final'"


@query(f"""WITH {JOBS} SELECT job_id, CASE WHEN finish IN ('running', 'waiting') THEN 'finish' WHEN {RUNS} THEN CASE WHEN {LATE} OR drafts_ready THEN 'clips' ELSE 'draft' END {BUSY} {OPEN} WHEN draft_due THEN 'draft' WHEN final_due THEN 'clips' WHEN finish IN ('done', 'failed') OR finals_ready THEN 'finish' WHEN generate = 'failed' AND drafts_ready THEN 'clips' ELSE 'draft' END AS progress,
CASE WHEN dirty THEN 'dirty' ELSE script END AS script, CASE WHEN draft_due THEN CASE WHEN {RUNS} AND NOT {LATE} THEN generate WHEN generate = 'failed' THEN 'failed' ELSE 'pending' END WHEN drafts_ready THEN 'done' ELSE 'pending' END AS draft,
CASE WHEN draft_due OR final_due THEN CASE WHEN {RUNS} AND ({LATE} OR drafts_ready) THEN generate WHEN generate = 'failed' AND drafts_ready THEN 'failed' ELSE 'pending' END WHEN finals_ready THEN 'done' ELSE 'pending' END AS clips, CASE WHEN draft_due OR final_due THEN 'pending' ELSE finish END AS finish FROM jo""")
def stage_tiles(spark, sf):
    return customer_jobs(spark, sf).select("job_id", screen.progress_stage().alias("progress"), *[screen.stage_shown(s).alias(s) for s in ("script", "draft", "clips", "finish")])


@query(f"""WITH {JOBS}, g AS (SELECT *, CASE WHEN job_id % 3 = 0 THEN ['draft', 'final', 'nonsense'][job_id % 9 // 3 + 1] END AS given, {ACTION} AS inferred FROM jo), a AS (SELECT *, CASE WHEN given IN ('draft', 'final') THEN given ELSE inferred END AS act FROM g)
SELECT job_id, CASE WHEN dirty AND act NOT IN ('busy', 'cancelled', 'retry') THEN 'redraft' ELSE act END AS action, NOT running AND state IN ('paused', 'failed', 'done', 'cancelled') AS deletable FROM a""")
def client_action(spark, sf):
    given = F.when(F.col("job_id") % 3 == 0, F.element_at(F.array(F.lit("draft"), F.lit("final"), F.lit("nonsense")), (F.floor(F.col("job_id") % 9 / 3) + 1).cast("int")))
    rows = customer_jobs(spark, sf)
    return rows.select("job_id", screen.primary_action(given, screen.inferred_action(), F.col("dirty"), ("draft", "final")).alias("action"), screen.deletable(F.col("state"), F.col("running")).alias("deletable"))


@query("""WITH w AS (SELECT conv_id AS job_id, count(*) FILTER (role <> 'system' AND trim(coalesce(text, '')) <> '') / count(*) AS counted FROM conversations GROUP BY conv_id)
SELECT job_id, round(100 * coalesce(CASE WHEN job_id % 3 = 0 THEN 0.375 END, CASE WHEN job_id % 3 = 1 THEN job_id % 7 / 7 END, counted))::INT AS rate FROM w""")
def visual_rate(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("job_id"), F.when(F.col("role") == "system", "no answer").alias("error"), F.col("text").alias("raw"))
    k = F.col("job_id")
    given = rows.select("job_id").distinct().select("job_id", F.when(k % 3 == 0, F.lit(0.375)).alias("rate"), F.when(k % 3 == 1, k % 7).alias("ok"), F.lit(7).alias("total"))
    return screen.success_rate(given.withColumn("total", F.when(k % 3 == 1, F.lit(7))), rows)


@query("""SELECT c_custkey AS job_id, i::INT AS n, ['shots', 'ocr', 'asr', 'dialogue', 'beats', 'events'][i + 1] AS id, CASE WHEN i < pos THEN 'done' WHEN i > pos THEN 'pending' WHEN c_custkey % 5 = 0 THEN 'failed' WHEN c_custkey % 4 = 0 THEN 'waiting' ELSE 'active' END AS status FROM (SELECT *, CASE WHEN c_custkey % 7 = 6 THEN 0 ELSE c_custkey % 7 END AS pos FROM customer), range(0, 6) r(i)""")
def step_states(spark, sf):
    k = F.col("c_custkey")
    step = F.element_at(F.array(*[F.lit(s) for s in (*screen.STEPS, "unknown")]), (k % 7 + 1).cast("int"))
    rows = table(spark, sf, "customer").select(k.alias("job_id"), step.alias("step"), F.when(k % 4 == 0, "visual").alias("wait"), (k % 5 == 0).alias("failed"))
    return screen.step_states(rows, "job_id")


@query("""WITH l AS (SELECT o_custkey AS job_id, o_orderdate AS tm, o_orderkey AS k, ['download', 'script', 'finish'][o_orderkey % 3 + 1] AS stage, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'running' END AS status FROM orders),
u AS (SELECT DISTINCT ON (job_id, stage, tm) * FROM l ORDER BY job_id, stage, tm, k), p AS (SELECT job_id, stage, arg_max(status, tm) AS status FROM u GROUP BY ALL)
SELECT job_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or(stage = 'finish' AND status = 'done') THEN 'done' ELSE 'queued' END AS state, count(*) AS n FROM p GROUP BY job_id""")
def stage_transitions(spark, sf):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderdate").alias("at"), k.alias("k"), F.element_at(F.array(F.lit("download"), F.lit("script"), F.lit("finish")), (k % 3 + 1).cast("int")).alias("stage"), F.when(status == "F", "done").when(status == "P", "failed").otherwise("running").alias("status"), F.lit("").alias("error"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("job_id", "stage", "at").orderBy("k"))).where("n = 1")
    return jobs.transitions(first).select("job_id", "state", F.size("stages").cast("long").alias("n"))


@query("SELECT l_orderkey AS job_id, coalesce(arg_min(l_shipdate, l_linenumber) FILTER (l_returnflag = 'R'), arg_max(l_shipdate, l_linenumber))::DATE::VARCHAR AS stage FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) GROUP BY l_orderkey")
def first_failed_step(spark, sf):
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey")
    rows = table(spark, sf, "lineitem").withColumn("n", F.row_number().over(w)).where("n = 1")
    steps = rows.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("ord"), F.col("l_shipdate").cast("date").cast("string").alias("stage"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("done").alias("status"))
    return jobs.first_failed(steps, "job_id")


@query("""WITH p AS (SELECT doc_id, sha1(coalesce(text, '')) AS h, coalesce(text, '') AS prompt FROM documents), g AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'f.mp4' ELSE '' END AS file, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'x' ELSE h END AS kept, ['running', 'error', 'other'][doc_id % 3 + 1] AS status FROM p)
SELECT doc_id AS clip_id, 'draft' AS quality, CASE WHEN file <> '' THEN 'done' WHEN status IN ('running', 'error') THEN status ELSE 'pending' END AS status, file <> '' AND coalesce(kept, '') <> h AS dirty FROM g JOIN p USING (doc_id)""")
def clip_quality_status(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("clip_id"), F.lit(1).alias("job_id"), F.coalesce("text", F.lit("")).alias("prompt"))
    k = F.col("clip_id")
    progress = d.select("job_id", "clip_id", F.lit("draft").alias("quality"), F.when(k % 4 != 0, "f.mp4").otherwise("").alias("file"), F.when(k % 7 == 0, None).when(k % 5 == 0, "x").otherwise(F.sha1(F.col("prompt").cast("binary"))).alias("prompt_hash"), F.element_at(F.array(F.lit("running"), F.lit("error"), F.lit("other")), (k % 3 + 1).cast("int")).alias("status"))
    return views.clip_status(d, progress, d).select("clip_id", "quality", "status", "dirty")


# Pages and texts.


@query(r"""WITH h AS (SELECT page_id, url, '<html><head><title lang="x">' || url || '</title>' || CASE page_id % 3 WHEN 0 THEN '<meta content="T ' || page_id || '" property="og:title"><meta property=''og:url'' content=''http://x/' || page_id || '''>' WHEN 1 THEN '<meta name="description" content="D">' ELSE '' END || '</head><body class="a"><h1 id="b">H <b>' || page_id || '</b></h1><video src=1></video><script>no</script><p>some  text</p></body></html>' AS html FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'T ' || page_id ELSE url END AS title, CASE WHEN page_id % 3 = 1 THEN 'D' END AS description, CASE WHEN page_id % 3 = 0 THEN 'http://x/' || page_id ELSE url END AS canonical, NULL::VARCHAR AS site, 'H ' || page_id AS h1, 1::INT AS videos, 'H ' || page_id || ' some text' AS preview FROM h""")
def shared_meta(spark, sf):
    p, k = table(spark, sf, "pages"), F.col("page_id")
    n = k.cast("string")
    meta = F.when(k % 3 == 0, F.concat(F.lit('<meta content="T '), n, F.lit("\" property=\"og:title\"><meta property='og:url' content='http://x/"), n, F.lit("'>"))).when(k % 3 == 1, '<meta name="description" content="D">').otherwise("")
    html = F.concat(F.lit('<html><head><title lang="x">'), "url", F.lit("</title>"), meta, F.lit('</head><body class="a"><h1 id="b">H <b>'), n, F.lit("</b></h1><video src=1></video><script>no</script><p>some  text</p></body></html>"))
    return metadata.shared_meta(p.select("page_id", "url", html.alias("html")))


@query("""SELECT page_id, regexp_matches(url, '^https?://([a-z0-9.-]*\\.)?example\\.com([:/?#]|$)') AS ours, regexp_extract(url, '/en/([0-9]+)/*([?#].*)?$', 1) AS item, CASE WHEN regexp_extract(url, '/en/([0-9]+)/*([?#].*)?$', 1) <> '' AND regexp_matches(url, '^https?://([a-z0-9.-]*\\.)?example\\.com([:/?#]|$)')
THEN 'https://share.example.com/' || regexp_extract(url, '/en/([0-9]+)/*([?#].*)?$', 1) || '|' || url ELSE url END AS tries FROM pages""")
def candidate_addresses(spark, sf):
    u, hosts = F.col("url"), ("example.com",)
    tries = metadata.candidate_urls(u, ("https://share.example.com/{}", "{url}"), hosts, "/en/")
    return table(spark, sf, "pages").select("page_id", metadata.host_in(u, hosts).alias("ours"), metadata.item_id(u, "/en/").alias("item"), F.array_join(tries, "|").alias("tries"))


@query("""SELECT doc_id, md5(lower(regexp_replace(text, '\\s+', '', 'g'))) AS squeezed, md5(regexp_replace(text, '\\s+', '', 'g')) AS unspaced, length(regexp_replace(text, '\\s', '', 'g')) >= 2 AND length(regexp_replace(text, '[^一-鿿]', '', 'g')) >= 2 AS caption,
(contains(text, '最') AND length(trim(text)) BETWEEN 6 AND 28) OR regexp_matches(text, '[《【「『][^》】」』]{4,30}[》】」』]') AS title, CASE WHEN length(trim(text)) > 60 THEN substring(trim(text), 1, 59) || '…' ELSE trim(text) END AS plain FROM (SELECT doc_id, coalesce(regexp_replace(text, '[\\x{00A0}\\x{3000}\\x{2000}-\\x{200A}]', ' ', 'g'), '') AS text FROM documents)""")
def text_predicates(spark, sf):
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x{00A0}\x{3000}\x{2000}-\x{200A}]", " ")
    d = table(spark, sf, "documents").select("doc_id", t.alias("text"))
    md5 = lambda c: F.md5(c.cast("binary"))
    t = F.col("text")
    plain = tx.plain_message(t, 60)
    return d.select("doc_id", md5(tx.squeezed(t)).alias("squeezed"), md5(tx.unspaced(t)).alias("unspaced"), tx.dialogue_caption(t).alias("caption"), tx.title_of_drama(t, "^$").alias("title"), plain.alias("plain"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || '|' || source WHEN 1 THEN lang WHEN 2 THEN lang || '|x' ELSE '' END AS topics FROM documents""")
def topic_lists(spark, sf):
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.to_json(F.array("lang", "source"))).when(k == 1, F.concat(F.lit(" "), "lang", F.lit(" "))).when(k == 2, F.to_json(F.array(F.to_json(F.array("lang", F.lit(" "), F.lit("x")))))).otherwise("")
    return table(spark, sf, "documents").select("doc_id", F.array_join(tx.topic_list(raw), "|").alias("topics"))


@query("""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id END AS cid, trim(left(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), 40)) AS t FROM documents) SELECT doc_id, cid::VARCHAR AS cid, t AS text, CASE WHEN doc_id % 2 = 0 THEN doc_id % 100 ELSE 0 END AS likes, 'by ' || doc_id % 10 AS author FROM c WHERE t <> ''""")
def comment_rows(spark, sf):
    k = F.col("doc_id")
    # the first 40 letters stand in the shortest beginning that has so many
    text = F.regexp_replace(F.regexp_extract("text", "^(?:[^a-zA-Z ]*+[a-zA-Z ]){0,40}", 0), "[^a-zA-Z ]+", "")
    item = F.to_json(F.struct(F.when(k % 3 != 0, k).alias("cid"), F.when(k % 5 != 0, text).alias("comment_text"), F.when(k % 5 == 0, text).alias("text"), F.when(k % 2 == 0, k % 100).alias("digg_count"), F.struct(F.concat(F.lit("by "), (k % 10).cast("string")).alias("nickname")).alias("user")))
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", F.parse_json(item).alias("item"))
    return metadata.comment_rows(rows, "item", ("doc_id",)).select("doc_id", "cid", "text", "likes", "author")


# Graphs of nations.

LINKS = "li AS (SELECT s_suppkey AS id, s_nationkey AS src, s_suppkey % 3 AS src_slot, (s_suppkey * 7 % 25)::INT AS dst, s_suppkey % 2 AS dst_slot FROM supplier)"


@query(f"WITH {LINKS} SELECT id::INT AS id, CASE WHEN id % 5 = 0 THEN 0 ELSE src END::INT AS src, src_slot::INT AS src_slot, dst, dst_slot::INT AS dst_slot, CASE WHEN id % 2 = 0 THEN 'IMAGE' ELSE '*' END AS type FROM li WHERE id % 7 <> 0")
def link_forms(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    values = {"id": k, "origin_id": F.col("s_nationkey"), "origin_slot": k % 3, "target_id": k * 7 % 25, "target_slot": k % 2}
    parts = [v.cast("string") for v in values.values()]
    row = F.concat(F.lit("["), F.concat_ws(",", parts[0], F.when(k % 5 == 0, "0").otherwise(parts[1]), *parts[2:]), F.when(k % 2 == 0, ',"IMAGE"').otherwise(""), F.lit("]"))
    entry = F.to_json(F.struct(*[(F.when(k % 5 != 0, v) if n == "origin_id" else v).alias(n) for n, v in values.items()], F.when(k % 2 == 0, "IMAGE").alias("type")))
    return graph.any_link_rows(s.select(F.lit("g").alias("graph"), F.when(k % 7 == 0, "[1, 2]").when(k % 3 == 0, row).otherwise(entry).alias("link")), "graph").drop("graph")


@query(f"""WITH {LINKS} SELECT node, way, slot, array_to_string(links, ',') AS links FROM (SELECT src AS node, 'out' AS way, src_slot AS slot, list_sort(list(id)) AS links FROM li GROUP BY ALL UNION ALL SELECT dst, 'in', dst_slot, [max(id)] FROM li GROUP BY ALL) WHERE node IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 4 <> 0)""")
def socket_links(spark, sf):
    k = F.col("s_suppkey")
    links = table(spark, sf, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("src"), (k % 3).alias("src_slot"), (k * 7 % 25).cast("int").alias("dst"), (k % 2).alias("dst_slot"))
    nodes = table(spark, sf, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("id"))
    return graph.socket_links(nodes, links).select("node", "way", "slot", F.array_join("links", ",").alias("links"))


@query("SELECT c_mktsegment AS graph, array_to_string(list_sort(list(DISTINCT n_name))[:3], ',') AS types FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey > 1 GROUP BY c_mktsegment")
def unknown_types(spark, sf):
    nodes = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("graph"), F.col("n_name").alias("type"))
    known = table(spark, sf, "nation").where("n_regionkey <= 1").select(F.col("n_name").alias("type"))
    return graph.unknown_types(nodes, known, 3).select("graph", F.array_join("types", ",").alias("types"))


# Workflows made of parts: a part that stands for a definition has the name of one as its type. A definition of level k holds
# the nations of region k, and where k > 0 the first of them stands for the definition of level k - 1. Links run from part to
# the next one, and inside definitions from the input through all nations to the output.

FLOW = """nd AS (SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 3 = 0 THEN 'sub' || p_partkey % 5 ELSE p_type END AS type FROM part),
li AS (SELECT a.p_partkey::VARCHAR AS src, 0 AS src_slot, b.p_partkey::VARCHAR AS dst, 0 AS dst_slot FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
ina AS (SELECT 'sub' || n_regionkey AS sub, n_nationkey::VARCHAR AS id, n_regionkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation),
inn AS (SELECT sub, id, i, n, CASE WHEN i = 1 AND k > 0 THEN 'sub' || (k - 1) ELSE 'nation' END AS type FROM ina)"""


@query(f"""WITH RECURSIVE {FLOW},
ex(id, type, used) AS (SELECT id, type, 0 FROM nd UNION ALL SELECT ex.id || '/' || inn.id, inn.type, used + 1 FROM ex JOIN inn ON inn.sub = ex.type),
entry(sub, path, type) AS (SELECT sub, id, type FROM inn WHERE i = 1 UNION ALL SELECT e.sub, e.path || '/' || inn.id, inn.type FROM entry e JOIN inn ON inn.sub = e.type WHERE inn.i = 1),
leave(sub, path, type) AS (SELECT sub, id, type FROM inn WHERE i = n UNION ALL SELECT e.sub, e.path || '/' || inn.id, inn.type FROM leave e JOIN inn ON inn.sub = e.type WHERE inn.i = inn.n),
raw AS (SELECT l.src, a.type AS st, l.dst, b.type AS dt FROM li l JOIN nd a ON a.id = l.src JOIN nd b ON b.id = l.dst
    UNION ALL SELECT ex.id || '/' || x.id, x.type, ex.id || '/' || y.id, y.type FROM ex JOIN inn x ON x.sub = ex.type JOIN inn y ON y.sub = x.sub AND y.i = x.i + 1),
links AS (SELECT r.src || coalesce('/' || o.path, '') AS src, r.dst || coalesce('/' || e.path, '') AS dst
    FROM raw r LEFT JOIN (SELECT * FROM leave WHERE type NOT LIKE 'sub%') o ON o.sub = r.st LEFT JOIN (SELECT * FROM entry WHERE type NOT LIKE 'sub%') e ON e.sub = r.dt)
SELECT 'node' AS what, id AS a, type AS b FROM ex WHERE type NOT LIKE 'sub%' UNION ALL SELECT 'link', src, dst FROM links""")
def expanded_workflows(spark, sf):
    part, nation = table(spark, sf, "part"), table(spark, sf, "nation")
    key = F.col("p_partkey")
    nodes = part.select(key.cast("string").alias("id"), F.when(key % 3 == 0, F.concat(F.lit("sub"), (key % 5).cast("string"))).otherwise(F.col("p_type")).alias("type"))
    following = part.select((key - 1).alias("before"), key.cast("string").alias("dst"))
    links = part.join(following, key == F.col("before")).select(key.cast("string").alias("src"), F.lit(0).alias("src_slot"), "dst", F.lit(0).alias("dst_slot"))
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    k = F.col("n_regionkey")
    inside = nation.select(F.concat(F.lit("sub"), k.cast("string")).alias("sub"), F.col("n_nationkey").alias("id"), F.lag("n_nationkey").over(w).alias("before"), F.lead("n_nationkey").over(w).alias("after"), k.alias("k"))
    kind = F.when(F.col("before").isNull() & (F.col("k") > 0), F.concat(F.lit("sub"), (F.col("k") - 1).cast("string"))).otherwise("nation")
    slots = [F.lit(0).alias("src_slot"), F.lit(0).alias("dst_slot")]
    entering = inside.where("before is null").select("sub", F.lit(-10).alias("src"), F.col("id").cast("int").alias("dst"), *slots)
    between = inside.select("sub", F.col("id").cast("int").alias("src"), F.coalesce("after", F.lit(-20)).cast("int").alias("dst"), *slots)
    got_nodes, got_links = graph.expanded(nodes, links, inside.select("sub", "id", kind.alias("type")), entering.unionByName(between))
    return got_nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("type").alias("b")).unionByName(got_links.select(F.lit("link").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b")))


# What the page of a job shows, over the jobs of customers: their files are made of the numbers of their orders, their log of
# the events of the user with their number, their violations of the priorities of orders in part.

FILES = ("source/video.mp4", "source/film.mp4", "output/p0/draft.mp4", "output/p1/draft.mp4", "output/p0/final.mp4", "output/p0/final.ass", "output/p1/cover.jpg", "cover.png")
MEDIA = f"""fi AS (SELECT DISTINCT o_custkey AS job_id, [{', '.join(repr(f) for f in FILES)}][o_orderkey % 8 + 1] AS file FROM orders),
mj AS (SELECT c_custkey AS job_id, CASE WHEN c_custkey % 4 = 1 THEN 'source/film.mp4' END AS video, 'p' || c_custkey % 2 AS path, CASE WHEN c_custkey % 3 = 0 THEN 'done' WHEN c_custkey % 3 = 1 THEN 'running' END AS finish FROM customer),
mh AS (SELECT mj.*, coalesce(fs, []) AS fs, coalesce(finish = 'done', false) AS over FROM mj LEFT JOIN (SELECT job_id, list(file) AS fs FROM fi GROUP BY job_id) USING (job_id)),
me AS (SELECT job_id, CASE WHEN list_contains(fs, coalesce(video, 'source/video.mp4')) THEN coalesce(video, 'source/video.mp4') END AS source, CASE WHEN list_contains(fs, 'output/' || path || '/draft.mp4') THEN 'output/' || path || '/draft.mp4' END AS draft,
CASE WHEN over AND list_contains(fs, 'output/' || path || '/final.mp4') THEN 'output/' || path || '/final.mp4' END AS final,
CASE WHEN over THEN CASE WHEN list_contains(fs, 'cover.jpg') THEN 'cover.jpg' WHEN list_contains(fs, 'cover.png') THEN 'cover.png' WHEN list_contains(fs, 'output/' || path || '/cover.jpg') THEN 'output/' || path || '/cover.jpg' END END AS cover,
CASE WHEN over AND list_contains(fs, 'output/' || path || '/final.ass') THEN 'output/' || path || '/final.ass' END AS ass FROM mh)"""


def customer_media(spark, sf):
    k = F.col("c_custkey")
    jobs_ = table(spark, sf, "customer").select(k.alias("job_id"), F.when(k % 4 == 1, "source/film.mp4").alias("video"), F.concat(F.lit("p"), (k % 2).cast("string")).alias("path"), F.when(k % 3 == 0, "done").when(k % 3 == 1, "running").alias("finish"))
    file = F.element_at(F.array(*[F.lit(f) for f in FILES]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return screen.media(jobs_, table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), file.alias("file")).distinct())


@query(f"WITH {MEDIA} SELECT * FROM me")
def job_media(spark, sf):
    return customer_media(spark, sf)


PAGE = JOBS.replace("coalesce(dirty, false) AND k % 2 = 0 AS dirty", "coalesce(dirty, false) AS dirty, coalesce(can_assemble, false) AS can_assemble")
SHOWN = f"CASE WHEN finish IN ('running', 'done') THEN 'finish' WHEN generate = 'running' THEN CASE WHEN last_quality = 'final' OR drafts_ready THEN 'clips' ELSE 'draft' END WHEN generate IN ('failed', 'waiting') THEN CASE WHEN drafts_ready THEN 'clips' ELSE 'draft' END {OPEN} WHEN finals_ready THEN 'clips' ELSE 'draft' END"


@query(f"""WITH {PAGE}, {MEDIA}, lg AS (SELECT user_id AS job_id, string_agg(event_id || ':' || event_type, ',' ORDER BY event_id) AS events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 40 GROUP BY user_id),
er AS (SELECT o_custkey AS job_id, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS errors FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey),
rw AS (SELECT job_id, string_agg(clip_id || ':' || ds || ':' || fs || ':' || hs, ',' ORDER BY clip_id) AS clips, string_agg(clip_id, ',' ORDER BY clip_id) FILTER (dd OR fd) AS dirty_clip_ids FROM cl GROUP BY job_id)
SELECT jo.job_id, state, clips, coalesce(dirty_clip_ids, CASE WHEN rw.job_id IS NOT NULL THEN '' END) AS dirty_clip_ids, drafts_ready, finals_ready, draft_due, final_due, dirty, can_assemble, source, draft, final, cover, ass, events, errors, {SHOWN} AS shown_stage, {ACTION} AS next_action
FROM jo LEFT JOIN rw USING (job_id) LEFT JOIN me USING (job_id) LEFT JOIN lg USING (job_id) LEFT JOIN er USING (job_id)""")
def job_details(spark, sf):
    jobs_ = customer_jobs(spark, sf).select("job_id", "state", "running", "stages", "last_quality", "stage")
    log = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("at"), F.col("event_type").alias("text"))
    audits = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("job_id"), F.col("o_orderpriority").alias("rule"))
    got = screen.detail(jobs_, order_clips(spark, sf), customer_media(spark, sf), log, audits)
    written = lambda c, *parts: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[p] if isinstance(p, str) else p(x) for p in parts])), ",")
    return got.select(
        "job_id", "state", written("clips", "clip_id", lambda x: x["draft"]["status"], lambda x: x["final"]["status"], lambda x: x["has_script"].cast("string")).alias("clips"), F.array_join("dirty_clip_ids", ",").alias("dirty_clip_ids"),
        "drafts_ready", "finals_ready", "draft_due", "final_due", "dirty", "can_assemble", "media.*", written("events", lambda x: x["at"].cast("string"), "text").alias("events"), F.array_join("errors", ",").alias("errors"), "shown_stage", "next_action",
    )


# Eight orders in a row are the clips of a job; speech ends where the lines of an order do.


@query("""WITH cl AS (SELECT o_orderkey // 8 AS job_id, o_orderkey AS clip_id, CASE WHEN o_orderkey % 3 = 0 THEN 6000 END AS trim, CASE WHEN o_orderkey % 97 <> 5 THEN 'f.mp4' ELSE '' END AS file, sha1('prompt ' || CASE WHEN o_orderkey % 101 = 7 THEN 0 ELSE o_orderkey END) AS kept,
CASE WHEN o_orderkey % 4 = 0 THEN 5.0 END AS play, CASE WHEN o_orderkey % 89 <> 3 THEN 'prompt ' || o_orderkey END AS prompt FROM orders), sp AS (SELECT l_orderkey AS clip_id, max(l_linenumber * 1000 + l_suppkey % 5 * 100) AS z FROM lineitem GROUP BY l_orderkey)
SELECT job_id, bool_and(file <> '' AND coalesce(kept = sha1(prompt), false) AND NOT (trim IS NOT NULL AND play IS NULL AND coalesce(z > trim + 120, false))) AS complete FROM cl LEFT JOIN sp USING (clip_id) GROUP BY job_id""")
def generation_complete(spark, sf):
    k = F.col("o_orderkey")
    own = F.concat(F.lit("prompt "), k.cast("string"))
    o = table(spark, sf, "orders").select(F.floor(k / 8).alias("job_id"), k.alias("clip_id"), "o_orderkey")
    clips_ = o.select("job_id", "clip_id", F.when(k % 3 == 0, 6000).alias("trim"))
    hashed = F.sha1(F.when(k % 101 == 7, F.lit("prompt 0")).otherwise(own).cast("binary"))
    progress = o.select("job_id", "clip_id", F.lit("final").alias("quality"), F.when(k % 97 != 5, "f.mp4").otherwise("").alias("file"), hashed.alias("prompt_hash"), F.when(k % 4 == 0, 5.0).alias("play"))
    texts = o.where(k % 89 != 3).select("job_id", "clip_id", own.alias("prompt"))
    speech = table(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / 8).alias("job_id"), F.col("l_orderkey").alias("clip_id"), (F.col("l_linenumber") * 1000 + F.col("l_suppkey") % 5 * 100).alias("t1"))
    return screen.complete(clips_, progress, texts, speech, "final")


@query(f"""WITH {SPOKEN}, ln AS (SELECT job_id, ord // 3 AS clip, string_agg(t0 || ':' || coalesce(text, '') || ':' || coalesce(role, ''), '|' ORDER BY t0, text, role) AS speech FROM sc GROUP BY ALL),
dc AS (SELECT job_id, clip, t0, t1, clip % 4 <> 3 AS has, clip % 5 <> 4 AS prompted FROM cp)
SELECT dc.job_id, dc.clip::VARCHAR AS clip_id, md5(speech) AS speech, CASE WHEN has THEN dc.clip || chr(10) || 'source ' || printf('%.2f-%.2f', t0 / 1000, t1 / 1000) || ' | clip ' || printf('%.2fs', (t1 - t0) / 1000) || chr(10) || chr(10)
|| '## Beats' || chr(10) || '- one' || chr(10) || '- beat ' || dc.clip || chr(10) || chr(10) || '## Chain' || chr(10) || '(nothing)' || chr(10) || chr(10) || '## Scene' || chr(10) || 'hall ' || dc.job_id || chr(10) || chr(10) || '## Sound' || chr(10) || CASE WHEN dc.clip % 2 = 0 THEN 'wind' ELSE '(nothing)' END || chr(10) || chr(10)
|| '## Note' || chr(10) || '(nothing)' || chr(10) || chr(10) || '## People' || chr(10) || '- (S1) tall' || chr(10) || '- (S2) ' ELSE '' END AS script, CASE WHEN prompted THEN 'prompt ' || dc.clip ELSE '' END AS prompt, has AS has_document, prompted AS has_prompt FROM dc JOIN ln ON ln.job_id = dc.job_id AND ln.clip = dc.clip""")
def clip_editors(spark, sf):
    c = story_clips(spark, sf).select("job_id", F.col("clip").cast("string").alias("clip_id"), "clip", "t0", "t1", ((F.col("t1") - F.col("t0")) / 1000).alias("seconds"))
    lines = spoken(spark, sf).select("job_id", F.floor(F.col("ord") / 3).cast("string").alias("clip_id"), "t0", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("source"))
    k = F.col("clip")
    people = F.array(F.struct(F.lit("S1").alias("id"), F.lit("tall").alias("note")), F.struct(F.lit("S2").alias("id"), F.lit(None).cast("string").alias("note")))
    parts = F.create_map(F.lit("Scene"), F.concat(F.lit("hall "), F.col("job_id").cast("string")), F.lit("Sound"), F.when(k % 2 == 0, "wind").otherwise(""))
    documents = c.select("job_id", "clip_id", F.when(k % 5 != 4, F.concat(F.lit("prompt "), "clip_id")).alias("prompt"), F.when(k % 4 != 3, "{}").alias("document"), people.alias("people"), F.array(F.lit("one"), F.concat(F.lit("beat "), "clip_id")).alias("beats"), parts.alias("parts"))
    got = screen.editor(c, lines, documents)
    said = F.md5(F.array_join(F.transform("speech", lambda x: F.concat_ws(":", x["t0"].cast("string"), x["text"], x["source"])), "|").cast("binary"))
    return got.select("job_id", "clip_id", said.alias("speech"), "script", "prompt", "has_document", "has_prompt")


# Final events of conversations: every second turn proposes an event, turns are the anchors, what a user says is spoken, and
# each kind of mark comes from turns of some places.

PROPOSED = f"""{TURNS}, st AS (SELECT *, (ord * 2500)::BIGINT AS began FROM tu),
pr AS (SELECT job_id, began + length(coalesce(text, '')) % 7 * 100 AS t0, began + length(coalesce(text, '')) % 7 * 100 + CASE WHEN ord % 22 = 10 THEN 0 ELSE 4800 END AS t1, CASE WHEN ord % 9 = 8 THEN 'EndCard' ELSE 'talk' END AS kind, CASE WHEN ord % 7 <> 6 THEN role = 'assistant' END AS cr FROM st WHERE ord % 2 = 0),
an AS (SELECT job_id, list(began + 400) AS ts FROM st WHERE ord % 8 <> 6 GROUP BY job_id), hd AS (SELECT job_id, began + 900 AS t FROM st WHERE ord % 6 = 5), sp AS (SELECT job_id, began AS t0, began + play AS t1 FROM st WHERE role = 'user'),
ti AS (SELECT job_id, began + 700 AS t FROM st WHERE ord % 5 = 3), pe AS (SELECT job_id, began + 700 AS t FROM st WHERE ord % 4 = 2), en AS (SELECT job_id, max(began + play) + 2600 AS duration FROM st GROUP BY job_id),
wi AS (SELECT job_id, began + 300 AS t0, began + 3300 AS t1, CASE WHEN role = 'assistant' THEN ord % 3 END AS adults, CASE WHEN job_id % 3 = 0 THEN 'end card' ELSE 'walks' END AS action FROM st),
tt AS (SELECT job_id, began + 1500 AS t0, began + 4000 AS t1 FROM st WHERE job_id % 5 = 1),
e0 AS (SELECT DISTINCT job_id, t0, t1, CASE WHEN lower(kind) = 'endcard' THEN 'endcard' ELSE 'story' END AS kind, coalesce(cr, false) AS cr FROM pr WHERE t1 > t0)"""


def _fold_sql(given: str, made: str, keep: str, state: tuple[str, str, str, str], more: str = "") -> str:
    """A fold of the events of each job: where ``keep`` holds the last event is given out and ``state`` follows it."""
    t0, t1, kind, cr = state
    return f"""{made}_n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t0, t1, kind, cr) AS n FROM {given}),
{made}_f(job_id, n, t0, t1, kind, cr, x0, x1, xk, xc) AS (SELECT job_id, n, t0, t1, kind, cr, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BOOLEAN FROM {made}_n WHERE n = 1 UNION ALL
SELECT job_id, n, {t0}, {t1}, {kind}, {cr}, CASE WHEN {keep} THEN l0 END, CASE WHEN {keep} THEN {more or 'l1'} END, lk, lc FROM
(SELECT e.*, f.t0 AS l0, f.t1 AS l1, f.kind AS lk, f.cr AS lc, a.ts, list_min(list_transform(list_filter(coalesce(a.ts, []), lambda t: abs(t - e.t0) <= 1500 AND t > f.t0), lambda t: abs(t - e.t0) * 10000000000 + t)) % 10000000000 AS best FROM {made}_f f JOIN {made}_n e ON e.job_id = f.job_id AND e.n = f.n + 1 LEFT JOIN an a ON a.job_id = e.job_id)),
{made} AS (SELECT job_id, x0 AS t0, x1 AS t1, xk AS kind, xc AS cr FROM {made}_f WHERE x0 IS NOT NULL UNION ALL SELECT job_id, t0, t1, kind, cr FROM (SELECT *, n = max(n) OVER (PARTITION BY job_id) AS final FROM {made}_f) WHERE final)"""


def _snapped_sql(given: str, made: str) -> str:
    moved = "ts IS NULL OR best IS NOT NULL"
    return _fold_sql(given, made, moved, (f"CASE WHEN ts IS NULL THEN t0 WHEN best IS NULL THEN l0 ELSE best END", "t1", f"CASE WHEN {moved} THEN kind ELSE lk END", f"CASE WHEN {moved} THEN cr ELSE lc END"), "CASE WHEN ts IS NULL THEN l1 ELSE best END")  # noqa: F541


def _merged_sql(given: str, made: str) -> str:
    beside = "lk <> 'endcard' AND kind <> 'endcard'"
    back, ahead = f"{beside} AND t1 - t0 < 2000", f"{beside} AND l1 - l0 < 2000"
    return _fold_sql(given, made, f"NOT (({back}) OR ({ahead}))", (f"CASE WHEN ({back}) OR ({ahead}) THEN l0 ELSE t0 END", "t1", f"CASE WHEN {back} THEN lk ELSE kind END", f"CASE WHEN ({back}) OR ({ahead}) THEN lc ELSE cr END"))


def _repaired_sql(given: str, made: str) -> str:
    return f"""{made}_n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t0, t1) AS n FROM {given}),
{made}_s AS (SELECT e.job_id, e.n, e.t0 AS cut, min([s.t0, s.t1]) AS s FROM {made}_n e JOIN sp s ON s.job_id = e.job_id AND e.t0 > s.t0 + 20 AND e.t0 < s.t1 - 20 WHERE e.n > 1 AND NOT EXISTS (SELECT 1 FROM hd WHERE hd.job_id = e.job_id AND abs(e.t0 - hd.t) <= 200) GROUP BY ALL),
{made}_m AS (SELECT e.*, CASE WHEN cut - s[1] <= s[2] - cut THEN s[1] ELSE s[2] END AS goes FROM {made}_n e LEFT JOIN {made}_s x ON x.job_id = e.job_id AND x.n = e.n),
{made} AS (SELECT job_id, coalesce(goes, t0) AS t0, z AS t1, kind, cr FROM (SELECT *, coalesce(lead(goes) OVER (PARTITION BY job_id ORDER BY n), t1) AS z FROM {made}_m) WHERE z - coalesce(goes, t0) >= 200)"""


def _covering_sql(given: str, made: str) -> str:
    return f"""{made}_g AS (SELECT e.*, duration, lag(t0) OVER w IS NULL AS first, lead(t0) OVER w AS next FROM {given} e JOIN en USING (job_id) WINDOW w AS (PARTITION BY job_id ORDER BY t0, t1)),
{made} AS (SELECT job_id, t0, t1, kind, cr AND n > 1 AS cr, 'e' || lpad(n::VARCHAR, 2, '0') AS id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t0) AS n FROM (SELECT job_id, CASE WHEN first THEN 0 ELSE t0 END AS t0, coalesce(next, duration) AS t1, kind, cr FROM {made}_g) WHERE t1 > t0))"""


FINAL_EVENTS = f"""WITH RECURSIVE {PROPOSED}, {_snapped_sql('e0', 'e1')}, {_repaired_sql('e1', 'e2')}, {_covering_sql('e2', 'e3')},
e4_x AS (SELECT e.job_id, e.t0, e.t1, e.kind, e.cr, coalesce(list_sort(list(DISTINCT ti.t) FILTER (ti.t IS NOT NULL)), []) AS ts FROM e3 e LEFT JOIN ti ON ti.job_id = e.job_id AND ti.t > e.t0 + 2000 AND ti.t < e.t1 - 2000 GROUP BY ALL),
e4 AS (SELECT job_id, p AS t0, q AS t1, kind, cr AND p = t0 AS cr FROM (SELECT *, unnest(list_concat([t0], ts)) AS p, unnest(list_concat(ts, [t1])) AS q FROM e4_x)),
{_merged_sql('e4', 'e5')}, {_repaired_sql('e5', 'e6')}, {_covering_sql('e6', 'e7')},
e8 AS (SELECT job_id, t0, t1, kind, n > 1 AND (cr OR EXISTS (SELECT 1 FROM pe WHERE pe.job_id = e.job_id AND abs(pe.t - e.t0) <= 1500)) AS cr FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t0, t1) AS n FROM e7) e),
la AS (SELECT job_id, max(t1) AS z FROM sp GROUP BY job_id), tl AS (SELECT job_id, z, duration FROM en JOIN la USING (job_id) WHERE z > 200 AND duration - z >= 300),
cd AS (SELECT job_id, z AS cut FROM (SELECT tl.job_id, z, duration, min(w.t0) FILTER (adults > 0) AS peopled, min(w.t0) FILTER (action = 'end card') AS shown, coalesce(bool_or(adults = 0), false) AS empty FROM tl LEFT JOIN wi w ON w.job_id = tl.job_id AND w.t0 < duration AND z < w.t1 GROUP BY ALL) f
WHERE EXISTS (SELECT 1 FROM tt WHERE tt.job_id = f.job_id AND tt.t0 < duration AND z < tt.t1) OR (shown IS NOT NULL AND (peopled IS NULL OR shown <= peopled)) OR (peopled IS NULL AND empty)),
e9_k AS (SELECT e.job_id, t0, t1, CASE WHEN kind = 'endcard' AND t0 < coalesce(z, 0) THEN 'story' ELSE kind END AS kind, cr, cut FROM e8 e LEFT JOIN la USING (job_id) LEFT JOIN cd USING (job_id)),
e9 AS (SELECT job_id, t0, t1, kind, cr FROM e9_k WHERE cut IS NULL OR t1 <= cut + 20 UNION ALL SELECT job_id, t0, t1, 'endcard', false FROM e9_k WHERE t1 > cut + 20 AND t0 >= cut - 20
UNION ALL SELECT job_id, t0, cut, 'story', cr FROM e9_k WHERE t1 > cut + 20 AND t0 < cut - 20 UNION ALL SELECT job_id, cut, t1, 'endcard', false FROM e9_k WHERE t1 > cut + 20 AND t0 < cut - 20),
{_merged_sql('e9', 'e10')}, {_covering_sql('e10', 'e11')} SELECT job_id, id, t0, t1, kind, cr AS cast_reset FROM e11"""


@query(FINAL_EVENTS)
def final_events(spark, sf):
    """All passes over events in their order, from what is proposed to what is packed into clips."""
    s = turns(spark, sf).select("*", (F.col("ord") * 2500).cast("long").alias("at"), F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    o = F.col("ord")
    begin = F.col("at") + F.col("size") % 7 * 100
    proposed = s.where(o % 2 == 0).select("job_id", begin.alias("t0"), (begin + F.when(o % 22 == 10, 0).otherwise(4800)).alias("t1"), F.when(o % 9 == 8, "EndCard").otherwise("talk").alias("kind"), F.when(o % 7 != 6, F.col("role") == "assistant").alias("cast_reset")).distinct()
    marks = lambda test, after: s.where(test).select("job_id", (F.col("at") + after).alias("t"))
    of = lambda test, reason: marks(test, 700).withColumn("reasons", F.array(F.lit(reason)))
    shortlist = of(o % 5 == 3, "title").unionByName(of(o % 4 == 2, "people"))
    speech = s.where("role = 'user'").select("job_id", F.col("at").alias("t0"), (F.col("at") + F.col("play")).alias("t1"))
    windows = s.select("job_id", (F.col("at") + 300).alias("t0"), (F.col("at") + 3300).alias("t1"), F.when(F.col("role") == "assistant", o % 3).alias("adults"), F.lit(None).cast("long").alias("children"), F.when(F.col("job_id") % 3 == 0, "end card").otherwise("walks").alias("action"))
    titles = s.where("job_id % 5 = 1").select("job_id", (F.col("at") + 1500).alias("t0"), (F.col("at") + 4000).alias("t1"), F.lit("words").alias("text"), F.lit("title").alias("region"))
    ends = s.groupBy("job_id").agg((F.max(F.col("at") + F.col("play")) + 2600).alias("duration"))
    got = events.finalised(proposed, marks(o % 8 != 6, 400), shortlist, marks(o % 6 == 5, 900), speech, windows, titles, ends)
    return got.select("job_id", "id", "t0", "t1", "kind", "cast_reset")


@query(f"""WITH RECURSIVE {OWNED}, cc AS (SELECT *, t1 - t0 + 500 AS h3, clip % 2 = 0 AS padded FROM cp),
wi AS (SELECT job_id, ord AS w, t0 - 700 AS t0, t1 + 300 AS t1, CASE WHEN role = 'user' THEN ord % 3 END AS adults, CASE WHEN role = 'assistant' THEN length(text) % 2 END AS children, CASE WHEN ord % 3 <> 1 THEN 'act ' || ord END AS action FROM sc),
p AS (SELECT c.job_id, c.clip, w, least(c.t1, i.t1) - greatest(c.t0, i.t0) AS shared, greatest(400, c.t1 - c.t0) AS span, i.t0 >= c.t0 - 200 AND NOT (i.t1 > c.t1 + 200 AND i.t0 > c.t0 + 400) AS own, adults, children, action, i.t0, i.t1 FROM cp c JOIN wi i ON i.job_id = c.job_id AND i.t0 < c.t1 AND c.t0 < i.t1),
q AS (SELECT *, CASE WHEN own AND shared >= least(1000, greatest(400, round_even(span * 45 / 100, 0))) THEN 1 WHEN own THEN 2 ELSE 3 END AS tier FROM p WHERE shared > 10),
r AS (SELECT *, min(tier) OVER (PARTITION BY job_id, clip) AS best, row_number() OVER (PARTITION BY job_id, clip ORDER BY shared DESC, w) AS n FROM q),
se AS (SELECT job_id, clip, coalesce(string_agg(printf('%.2f-%.2fs ', t0 / 1000, t1 / 1000) || action, '|' ORDER BY t0, printf('%.2f-%.2fs ', t0 / 1000, t1 / 1000) || action), '') AS actions, max(adults)::BIGINT AS adults, max(children)::BIGINT AS children FROM r WHERE tier = best AND (tier < 3 OR n = 1) GROUP BY job_id, clip),
tm AS (SELECT o.job_id, o.clip, trim(o.text) AS text, greatest(o.t0, c.t0) - c.t0 AS x, least(o.t0 + s.play, c.t1) - c.t0 AS y, c.* EXCLUDE (job_id, clip) FROM ow o JOIN cc c ON c.job_id = o.job_id AND c.clip = o.clip JOIN sc s ON s.job_id = o.job_id AND s.ord = o.ord WHERE trim(coalesce(o.text, '')) <> ''),
lc AS (SELECT job_id, clip, text, CASE WHEN padded THEN x ELSE least(h3, x * h3::DOUBLE / greatest(t1 - t0, 1)) END::DOUBLE AS a, CASE WHEN padded THEN y ELSE least(h3, y * h3::DOUBLE / greatest(t1 - t0, 1)) END::DOUBLE AS b FROM tm),
sa AS (SELECT job_id, clip, count(*) AS n_lines, round(sum(a), 3) AS begins, round(sum(b), 3) AS ends, md5(string_agg(text, '|' ORDER BY a, b, text)) AS texts FROM lc GROUP BY job_id, clip),
cu AS (SELECT DISTINCT c.job_id, c.clip, CASE WHEN padded THEN (s.t0 + d) - c.t0 ELSE least(h3, (s.t0 + d - c.t0) * h3::DOUBLE / greatest(c.t1 - c.t0, 1)) END::DOUBLE AS t, h3 FROM cc c JOIN sc s ON s.job_id = c.job_id CROSS JOIN (VALUES (700), (900), (2000)) v(d) WHERE s.t0 + d > c.t0 + 40 AND s.t0 + d < c.t1 - 40),
ct AS (SELECT * FROM cu WHERE t >= 1000 AND t <= h3 - 1000),
kp(job_id, clip, t) AS (SELECT job_id, clip, min(t) FROM ct GROUP BY job_id, clip UNION ALL SELECT k.job_id, k.clip, (SELECT min(c.t) FROM ct c WHERE c.job_id = k.job_id AND c.clip = k.clip AND c.t >= k.t + 1000) FROM kp k WHERE EXISTS (SELECT 1 FROM ct c WHERE c.job_id = k.job_id AND c.clip = k.clip AND c.t >= k.t + 1000)),
kc AS (SELECT job_id, clip, count(*) AS n_cuts, round(sum(t), 3) AS cuts FROM kp GROUP BY job_id, clip),
ne AS (SELECT job_id, clip, lag(clip) OVER w AS before, md5(array_to_string(lag(lines) OVER w, '|')) AS lines_before, lead(clip) OVER w AS after, md5(array_to_string(lead(lines) OVER w, '|')) AS lines_after, CASE WHEN NOT cast_reset AND NOT coalesce(lag(cast_reset) OVER w, false) THEN lag(clip) OVER w END AS thread
    FROM (SELECT cp.job_id, cp.clip, cast_reset, lines FROM cp LEFT JOIN ls USING (job_id, clip)) WINDOW w AS (PARTITION BY job_id ORDER BY clip))
SELECT cc.job_id, cc.clip, actions, adults, children, n_lines, begins, ends, texts, n_cuts, cuts, before, lines_before, after, lines_after, thread FROM cc LEFT JOIN se USING (job_id, clip) LEFT JOIN sa USING (job_id, clip) LEFT JOIN kc USING (job_id, clip) JOIN ne USING (job_id, clip)""")
def clip_facts(spark, sf):
    """All that the prompt of a clip is written from."""
    s, o = spoken(spark, sf), F.col("ord")
    c = story_clips(spark, sf).withColumn("h3", F.col("t1") - F.col("t0") + 500).withColumn("padded", F.col("clip") % 2 == 0)
    windows = s.select("job_id", o.alias("window"), (F.col("t0") - 700).alias("t0"), (F.col("t1") + 300).alias("t1"), F.when(F.col("role") == "user", o % 3).cast("long").alias("adults"), F.when(F.col("role") == "assistant", F.length("text") % 2).cast("long").alias("children"), F.when(o % 3 != 1, F.concat(F.lit("act "), o.cast("string"))).alias("action"))
    lines = s.where("role <> 'system'").select("job_id", o.alias("line"), "t0", "t1", "text")
    cuts = s.select("job_id", F.explode(F.array(*[(F.col("t0") + d).alias("t") for d in (700, 900, 2000)])).alias("t"))
    got = clips.facts(c, windows, lines, cuts, "job_id")
    total = lambda xs, f: F.round(F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x).cast("double")), 3)
    md5 = lambda xs: F.md5(F.array_join(xs, "|").cast("binary"))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    return got.select(
        "job_id", "clip", F.array_join("actions", "|").alias("actions"), "adults", "children", size("speech").alias("n_lines"), total("speech", lambda x: x["a"]).alias("begins"), total("speech", lambda x: x["b"]).alias("ends"),
        md5(F.col("speech.text")).alias("texts"), size("cuts").alias("n_cuts"), total("cuts", lambda x: x).alias("cuts"), "before", md5("lines_before").alias("lines_before"), "after", md5("lines_after").alias("lines_after"), "thread",
    )


NOW = "2026-01-01 00:00:00"


@query(f"""WITH {PAGE.replace("k % 17 = 0 AS running", "k = 17 AS running")}, ti AS (SELECT user_id AS job_id, min(ts) AS c, max(ts) AS u FROM events GROUP BY user_id)
SELECT jo.job_id, CASE WHEN jo.job_id % 3 = 0 THEN 'mock' ELSE 'real' END AS mode, state, {SHOWN} AS stage, CASE WHEN state = 'failed' THEN 'no' END AS note, CASE WHEN jo.job_id % 2 = 0 THEN 'window ' || jo.job_id END AS sub_progress,
CASE WHEN c IS NULL THEN NULL ELSE greatest(0, epoch(date_trunc('second', CASE WHEN state = 'running' THEN TIMESTAMP '{NOW}' ELSE u END))::BIGINT - epoch(date_trunc('second', c))::BIGINT) END AS elapsed_sec, 'film ' || jo.job_id AS source, jo.job_id % 7 = 0 AS need_aspect_confirm, drafts_ready, finals_ready, {ACTION} AS next_action
FROM jo LEFT JOIN ti ON ti.job_id = jo.job_id""")
def job_summaries(spark, sf):
    k = F.col("job_id")
    times = table(spark, sf, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.min("ts").cast("timestamp").alias("created_at"), F.max("ts").cast("timestamp").alias("updated_at"))
    mode = F.when(k % 3 == 0, F.create_map(F.lit("mode"), F.lit("mock"))).when(k % 3 == 1, F.create_map(F.lit("mode"), F.lit(""))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    base = customer_jobs(spark, sf).select("job_id", "state", "stages", "last_quality").join(times, "job_id", "left")
    rows = base.select("*", F.when(F.col("state") == "failed", "no").alias("note"), F.when(k % 2 == 0, F.concat(F.lit("window "), k.cast("string"))).alias("chip"), F.concat(F.lit("film "), k.cast("string")).alias("source"), mode.alias("options"), (k % 7 == 0).alias("need_aspect_confirm"))
    got = jobs.list_payload(rows, order_clips(spark, sf), spark.range(17, 18).select(F.col("id").alias("job_id")), F.lit(NOW).cast("timestamp"))
    return got.drop("created_at", "updated_at", "options")


# Parts as nodes in a row: three of five pass on what they get, some are notes, some are off.

CHAIN = """nd AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 3 THEN 'Note' WHEN p_partkey % 5 IN (1, 2, 3) THEN 'Reroute' ELSE 'Work' END AS type, CASE WHEN p_partkey % 13 = 0 THEN 4 WHEN p_partkey % 17 = 0 THEN 2 ELSE 0 END AS mode FROM part)"""


@query(f"""WITH RECURSIVE {CHAIN}, up(dst, src) AS (SELECT b.id, a.id FROM nd a JOIN nd b ON b.id = a.id + 1 UNION ALL SELECT up.dst, p.id FROM up JOIN nd a ON a.id = up.src AND a.type = 'Reroute' JOIN nd p ON p.id = a.id - 1),
ru AS (SELECT id FROM nd WHERE type = 'Work' AND mode = 0) SELECT dst, src FROM up WHERE src IN (SELECT id FROM ru) AND dst IN (SELECT id FROM ru)""")
def true_links(spark, sf):
    k = F.col("p_partkey")
    kind = F.when(k % 11 == 3, "Note").when((k % 5).isin(1, 2, 3), "Reroute").otherwise("Work")
    nodes = table(spark, sf, "part").select(k.alias("id"), kind.alias("type"), F.when(k % 13 == 0, 4).when(k % 17 == 0, 2).otherwise(0).alias("mode"))
    following = nodes.select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    links = following.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").select("src", F.lit(0).alias("src_slot"), "dst", F.lit(0).alias("dst_slot"))
    return graph.executable(nodes, links)[1].select("dst", "src")


KINDS = ("Video", "PrimitiveStringMultiline", "PrimitiveFloat", "PrimitiveInt", "BasicScheduler", "ResolutionSelector", "RandomNoise", "SaveVideo", "LoadImage", "Other")


@query(f"""WITH n AS (SELECT o_orderkey AS k, {list(KINDS)}[o_orderkey % 10 + 1] AS type, CASE WHEN o_orderkey % 3 = 0 THEN 'The Prompt, duration, STEPS' ELSE 'x' END AS title, [x FOR x IN ['a', 'b', 'c'] IF x <= ['', 'a', 'b', 'c'][o_orderkey % 4 + 1]] AS w FROM orders),
r AS (SELECT *, title <> 'x' AS named, len(w) AS n, CASE WHEN k % 2 = 0 THEN 'i' || k END AS image FROM n),
f AS (SELECT *, CASE WHEN type = 'Video' OR type = 'PrimitiveStringMultiline' AND named THEN 'p' || k WHEN type = 'PrimitiveFloat' AND named THEN '2.5' WHEN type = 'PrimitiveInt' AND named THEN '8' WHEN type = 'ResolutionSelector' AND n >= 2 THEN '16:9' WHEN type = 'RandomNoise' AND n > 0 THEN k::VARCHAR WHEN type = 'SaveVideo' AND n > 0 THEN 'out' WHEN type = 'LoadImage' AND image IS NOT NULL THEN image ELSE w[1] END AS w1,
CASE WHEN type = 'BasicScheduler' AND n >= 2 THEN '8' WHEN type = 'ResolutionSelector' AND n >= 2 THEN '0.4' WHEN type = 'RandomNoise' AND n > 0 THEN 'fixed' WHEN type = 'LoadImage' AND image IS NOT NULL THEN 'image' ELSE w[2] END AS w2 FROM r)
SELECT k, concat_ws('|', w1, w2, w[3]) AS widgets, ['videos', 'images', 'text'][k % 3 + 1] = 'videos' OR ['videos', 'images', 'text'][k % 3 + 1] = 'images' AND k % 4 < 2 AS shown,
CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN CASE WHEN k % 7 = 0 THEN 'broke ' || k ELSE 'the run failed' END END AS error, k % 6 = 0 OR k % 5 = 0 OR k % 7 = 0 AS over FROM f""")
def patched_nodes(spark, sf):
    """Values put into the nodes of runs, the files of runs that are videos, and what runs that failed say."""
    k = F.col("k")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    widgets = F.filter(F.array(F.lit("a"), F.lit("b"), F.lit("c")), lambda x: x <= F.element_at(F.array(F.lit(""), F.lit("a"), F.lit("b"), F.lit("c")), (k % 4 + 1).cast("int")))
    nodes = o.select("k", F.element_at(F.array(*[F.lit(x) for x in KINDS]), (k % 10 + 1).cast("int")).alias("type"), F.when(k % 3 == 0, "The Prompt, duration, STEPS").otherwise("x").alias("title"), widgets.alias("widgets"))
    rules = graph.standard_rules(F.concat(F.lit("p"), k.cast("string")), F.lit(2.5), F.lit(8), k, F.lit("out"), F.lit("16:9"), F.lit(0.4), F.when(k % 2 == 0, F.concat(F.lit("i"), k.cast("string"))), ("Video",))
    outputs = o.select("k", F.element_at(F.array(F.lit("videos"), F.lit("images"), F.lit("text")), (k % 3 + 1).cast("int")).alias("kind"), F.element_at(F.array(F.lit("a.MP4"), F.lit("b.webm"), F.lit("c.png"), F.lit(None)), (k % 4 + 1).cast("int")).alias("filename"))
    shown = graph.video_files(outputs).select("k", F.lit(True).alias("shown"))
    status, said = F.when(k % 5 == 0, "error").otherwise("success"), F.concat(F.lit(" broke "), k.cast("string"), F.lit(" "))
    messages = F.when(k % 7 == 0, F.array(F.struct(F.lit("execution_start").alias("name"), F.lit(" ").alias("text")), F.struct(F.lit("execution_error").alias("name"), said.alias("text"))))
    rows = graph.patched(nodes, rules).join(shown, "k", "left")
    return rows.select("k", F.array_join("widgets", "|").alias("widgets"), F.coalesce("shown", F.lit(False)).alias("shown"), graph.run_error(status, messages).alias("error"), graph.run_over(k % 6 == 0, status, messages).alias("over"))


# Reviews of the clips of orders in two rounds, and why jobs may not begin or have failed.

REVIEWS = """rv AS (SELECT l_orderkey AS job_id, l_linenumber AS clip_id, l_suppkey % 2 + 1 AS round, CASE WHEN l_partkey % 31 <> 0 THEN l_quantity > 2 AND 5 + l_partkey % 40 >= 7 AND 6 + l_suppkey % 9 >= 6 AND 5 + l_linenumber >= 6 END AS ok FROM lineitem)"""


def order_reviews(spark, sf):
    li, part = table(spark, sf, "lineitem"), F.col("l_partkey")
    passed = views.review_passed(F.col("l_quantity") > 2, F.when(part % 31 != 0, 5 + part % 40), 6 + F.col("l_suppkey") % 9, 5 + F.col("l_linenumber"))
    return li.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("clip_id"), (F.col("l_suppkey") % 2 + 1).alias("round"), passed.alias("pass"))


@query(f"WITH {REVIEWS} SELECT job_id, round, bool_and(coalesce(ok, false)) AS passed FROM (SELECT *, max(round) OVER (PARTITION BY job_id) AS last FROM rv) WHERE round = last GROUP BY job_id, round")
def review_rounds(spark, sf):
    return screen.round_passed(order_reviews(spark, sf))


@query(f"""WITH {REVIEWS} SELECT r.job_id, r.clip_id, o_orderdate AS begun, 'prompt ' || r.clip_id AS prompt FROM (SELECT *, max(round) OVER (PARTITION BY job_id) AS last FROM rv) r JOIN orders ON o_orderkey = r.job_id AND r.clip_id <= 5 WHERE round = last AND NOT coalesce(ok, false) AND r.clip_id % 4 <> 0""")
def reviews_to_redraft(spark, sf):
    places = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("clip_id")
    o = table(spark, sf, "orders")
    clips_ = o.select(F.col("o_orderkey").alias("job_id"), places, F.col("o_orderdate").alias("begun"))
    texts = o.select(F.col("o_orderkey").alias("job_id"), places).where("clip_id % 4 <> 0").withColumn("prompt", F.concat(F.lit("prompt "), F.col("clip_id").cast("string")))
    return screen.patched_reviews(order_reviews(spark, sf), clips_, texts).select("job_id", "clip_id", "begun", "prompt")


@query("SELECT job_id, string_agg(reason, ',' ORDER BY o, reason) AS reasons FROM (SELECT l_orderkey AS job_id, l_returnflag || l_linestatus || l_suppkey % 4 AS reason, min(l_linenumber) AS o FROM lineitem WHERE NOT (l_quantity < 25) GROUP BY ALL) GROUP BY job_id")
def start_gates(spark, sf):
    checks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("ord"), F.concat("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 4).cast("string")).alias("reason"), (F.col("l_quantity") < 25).alias("ok"))
    return screen.gate_reasons(checks, "job_id").select("job_id", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH j AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'Failed' WHEN c_custkey % 3 = 1 THEN 'note ' || c_custkey END AS note, CASE WHEN c_custkey % 4 = 0 THEN 'no page' ELSE '' END AS detail, CASE WHEN c_custkey % 5 = 0 THEN 'no page' WHEN c_custkey % 5 = 1 THEN 'late' END AS error,
CASE WHEN c_custkey % 2 = 0 THEN 'no page' ELSE 'lost' END AS said, CASE c_custkey % 7 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'done' ELSE 'waiting' END AS status FROM customer),
t AS (SELECT k, list_filter([CASE WHEN note <> 'Failed' THEN note END, nullif(detail, ''), CASE WHEN error = detail THEN NULL ELSE error END], lambda x: x IS NOT NULL) AS told, said, status FROM j)
SELECT k, array_to_string(CASE WHEN status <> 'done' AND NOT list_contains(told, said) THEN list_append(told, 'script (' || lower(status) || '): ' || said) ELSE told END, ' / ') AS reasons FROM t""")
def failures_told(spark, sf):
    k = F.col("k")
    note = F.when(k % 3 == 0, "Failed").when(k % 3 == 1, F.concat(F.lit("note "), k.cast("string")))
    error = F.when(k % 5 == 0, "no page").when(k % 5 == 1, "late")
    stage = F.struct(F.when(k % 7 == 0, "FAILED").when(k % 7 == 1, "done").otherwise("waiting").alias("status"), F.when(k % 2 == 0, "no page").otherwise("lost").alias("error"))
    fine = F.struct(F.lit("done").alias("status"), F.lit("").alias("error"))
    jobs_ = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return jobs_.select("k", F.array_join(screen.failure_reasons(note, F.when(k % 4 == 0, "no page").otherwise(""), error, F.create_map(F.lit("download"), fine, F.lit("script"), stage)), " / ").alias("reasons"))


@query("""SELECT DISTINCT l_suppkey || '-' || l_linenumber AS prompt_id, l_linenumber = 1 AS running FROM lineitem WHERE NOT (l_linenumber <= 2 AND l_suppkey % 3 = 0) AND NOT (l_linenumber IN (3, 4) AND l_suppkey % 4 = 1) AND NOT (l_linenumber = 5 AND l_suppkey % 5 = 0)""")
def foreign_queue(spark, sf):
    """What stands in a queue that no job of a supplier has started, by the last run that it names and those of its clips."""
    name = lambda n: F.concat(F.col("s_suppkey").cast("string"), F.lit(f"-{n}"))
    k = F.col("s_suppkey")
    run = lambda test, n: F.struct(F.when(test, name(n)).otherwise("").alias("prompt_id"))
    by_quality = lambda a, b, test: F.create_map(F.lit("draft"), run(test, a), F.lit("final"), run(test, b))
    progress = table(spark, sf, "supplier").select(k.alias("job_id"), F.when(k % 5 == 0, name(5)).alias("last_prompt_id"), F.create_map(F.lit("c1"), by_quality(1, 2, k % 3 == 0), F.lit("c2"), by_quality(3, 4, k % 4 == 1)).alias("clips"))
    queue = table(spark, sf, "lineitem").select(F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("prompt_id"), (F.col("l_linenumber") == 1).alias("running")).distinct()
    return screen.foreign_runs(queue, screen.own_prompts(progress))


@query("""WITH a AS (SELECT DISTINCT o_orderkey % 5000 AS clip_id, o_custkey % 2 AS part FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT DISTINCT l_orderkey % 5000 AS clip_id, l_linenumber % 2 AS part FROM lineitem WHERE l_orderkey % 4 <> 0)
SELECT *, 'no prompt' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'no clip' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def unmatched_prompts(spark, sf):
    a = table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select((F.col("o_orderkey") % 5000).alias("clip_id"), (F.col("o_custkey") % 2).alias("part"))
    b = table(spark, sf, "lineitem").where("l_orderkey % 4 <> 0").select((F.col("l_orderkey") % 5000).alias("clip_id"), (F.col("l_linenumber") % 2).alias("part"))
    return prompts.unmatched(a, b, ["clip_id", "part"])


SHOT_ROWS = """sh AS (SELECT job_id, coalesce(sum(d) OVER (PARTITION BY job_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS t0, (sum(d) OVER (PARTITION BY job_id ORDER BY i))::BIGINT AS t1, i, d FROM (SELECT l_orderkey AS job_id, l_linenumber AS i, max(l_partkey % 40 * 25 + 10) AS d FROM lineitem GROUP BY ALL))"""


@query(f"""WITH {SHOT_ROWS}, g AS (SELECT *, sum(CASE WHEN d >= 400 OR i = first THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY i) AS n FROM (SELECT *, min(i) OVER (PARTITION BY job_id) AS first FROM sh))
SELECT job_id, 'shot_' || lpad(n::BIGINT::VARCHAR, 3, '0') AS id, min(t0) AS t0, max(t1) AS t1 FROM g GROUP BY job_id, n""")
def merged_shots(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("i")).agg(F.max(F.col("l_partkey") % 40 * 25 + 10).alias("d"))
    w = Window.partitionBy("job_id").orderBy("i")
    end = F.sum("d").over(w).cast("long")
    return events.merged_shots(li.select("job_id", (end - F.col("d")).alias("t0"), end.alias("t1")), "job_id")
