"""Registered queries of the small operators: grids, forms of text, salvage, dialogue, delivery, events, caches, each with
equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from timeloom.functions import text as tx
from timeloom.functions import timegrid as tg
from timeloom.operators import audit, delivery, dialogue, events, jobs, metadata, prompts, retime, screen, views
from timeloom.operators.scans import dealt
from timeloom.plans.catalog import TURNS, order_spans, query, table, turns
from timeloom.plans.stories import SPOKEN, spoken

# Numbers of orders as durations in ms.


def joined(array):
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey * 37 % 60000 AS d, o_orderkey % 4000 AS len, o_orderkey % 12 AS n FROM orders)
SELECT k, array_to_string(CASE WHEN d > 50 THEN list_transform(range(0, (d - 51) // 2500 + 1), lambda i: i * 2500) ELSE [0] END, ',') AS hops, array_to_string(list_transform(range(0, least(12, greatest(1, ceil(len / 250.0)::BIGINT))), lambda i: d + i * 250), ',') AS cells,
array_to_string(CASE WHEN n <= 5 THEN range(0, n) ELSE list_transform(range(0, 5), lambda i: round_even(i * (n - 1) / 4, 0)::INT) END, ',') AS spread, array_to_string(list_transform(range(0, greatest(0, ceil((d * 50 - 240000) / 239600.0))::BIGINT + 1), lambda i: i * 239600), ',') AS chunks,
round(d + (len) * 0.5, 3) AS middle, round((2 + 0.5) / 4 * d, 3) AS third, greatest(1800, d * (n + 1) * 45 + 600, 3600) AS timeout, ('0x' || left(md5(k || ':x'), 8))::BIGINT AS seed FROM o""")
def grid_points(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(k.alias("k"), (k * 37 % 60000).alias("d"), (k % 4000).alias("len"), (k % 12).cast("int").alias("n"))
    d, n = F.col("d"), F.col("n")
    return o.select(
        "k", joined(tg.hop_starts(d)).alias("hops"), joined(tg.cell_starts(d, d + F.col("len"))).alias("cells"), joined(tg.spread(n, 5)).alias("spread"), joined(tg.chunk_starts(d * 50)).alias("chunks"),
        F.round(tg.probe_times(d, d + F.col("len"))[1], 3).alias("middle"), F.round(tg.bucket_middles(d, 4)[2], 3).alias("third"), tg.render_timeout(d, n + 1).alias("timeout"), tg.stable_seed(F.col("k").cast("string"), F.lit("x")).alias("seed"),
    )


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey * 7919 % 8000000 AS ms FROM orders), c AS (SELECT *, greatest(0, ms) AS m, round_even(ms / 10, 0)::BIGINT AS cs FROM o)
SELECT k, cs // 360000 || ':' || lpad((cs // 6000 % 60)::VARCHAR, 2, '0') || ':' || lpad((cs // 100 % 60)::VARCHAR, 2, '0') || '.' || lpad((cs % 100)::VARCHAR, 2, '0') AS subtitle, printf('%02d:%02d.%03d', ms // 60000, ms // 1000 % 60, ms % 1000) AS stamp,
CASE WHEN k % 3 = 0 THEN '' ELSE '&H' || upper(substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) || '&' END AS colour, CASE WHEN k % 3 = 0 THEN 'a\\{' ELSE '{\\c&H' || upper(substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)) || '&}a\\{' END || 'b\\N' || k AS styled,
CASE WHEN k % 4 = 0 THEN k / 2 END AS number, CASE k % 4 WHEN 0 THEN '16:9' WHEN 1 THEN '9:16' WHEN 2 THEN '10:7' ELSE '21:9' END AS aspect, CASE WHEN y >= 0.72 THEN 'bottom' WHEN y <= 0.22 THEN 'title' ELSE 'other' END AS region,
k % 5 NOT IN (0, 1) AS safe, 'a|b ' || k AS options, k % 6 = 0 AS memory FROM (SELECT *, left(md5(k::VARCHAR), 6) AS h, k % 100 / 100 AS y FROM c)""")
def text_forms(spark, sf):
    k = F.col("k")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).withColumn("ms", k * 7919 % 8_000_000).withColumn("h", F.substring(F.md5(k.cast("string").cast("binary")), 1, 6))
    colour = F.when(k % 3 == 0, "red").otherwise(F.concat(F.lit("#"), "h"))
    runs = F.array(F.struct(F.lit("a{").alias("text"), colour.alias("color")), F.struct(F.concat(F.lit("b\n"), k.cast("string")).alias("text"), F.lit("").alias("color")))
    number = F.when(k % 4 == 0, F.concat(F.lit("极"), (k / 2).cast("string"), F.lit("s"))).otherwise("none")
    width = F.when(k % 4 == 0, 1920).when(k % 4 == 1, 1080).when(k % 4 == 2, 1000).otherwise(1170)
    height = F.when(k % 4 == 0, 1080).when(k % 4 == 1, 1920).when(k % 4 == 2, 700).otherwise(500)
    path = F.when(k % 5 == 0, "/etc/x").when(k % 5 == 1, "a/../b").when(k % 5 == 2, "a..b/c").otherwise("a/b")
    return o.select(
        "k", tx.subtitle_time(F.col("ms")).alias("subtitle"), tx.stamp(F.col("ms")).alias("stamp"), tx.subtitle_colour(colour).alias("colour"), tx.styled(runs).alias("styled"), tx.salvaged_number(number).alias("number"), tx.aspect_label(width, height).alias("aspect"),
        tx.region(k % 100 / 100).alias("region"), tx.safe_path(path).alias("safe"), F.array_join(tx.option_list(F.concat(F.lit(" a;; b "), k.cast("string"), F.lit(","))), "|").alias("options"), tx.out_of_memory(F.when(k % 6 == 0, "CUDA OOM here").otherwise("fine")).alias("memory"),
    )


@query(f"""WITH {TURNS} SELECT job_id, ord, ord AS n, text AS said, CASE WHEN ord % 3 = 0 THEN NULL ELSE coalesce(nullif(left(text, ord::INT), ''), NULL) END AS action, CASE WHEN ord % 4 = 0 THEN NULL ELSE length(text) END::INT AS count,
CASE WHEN text IS NULL THEN '1.5:' ELSE '1.5:' || left(text, 9) END || '|2.0:y' AS cells FROM tu""")
def salvaged_documents(spark, sf):
    """What a model says of each turn: its text, thoughts, then a document that holds the turn, then more; and fields of the
    same document cut off in the middle."""
    said = F.coalesce("text", F.lit(""))
    written = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    action = F.when(F.col("ord") % 3 == 0, "").otherwise(F.concat(F.lit(', "action": '), written(F.substring(said, F.lit(1), F.col("ord").cast("int")))))
    count = F.when(F.col("ord") % 4 == 0, ', "adults": "few"').otherwise(F.concat(F.lit(', "adults": '), F.coalesce(F.length("text").cast("string"), F.lit("none"))))
    cells = F.concat(F.lit(', "cells": [{"t": "极1.5s", "see": '), written(F.left(said, F.lit(9))), F.lit('}, {"t": "2.0", "see": "y"}, {"t": 3, "see": "cut'))
    document = F.to_json(F.struct(F.col("ord").alias("n"), F.col("text").alias("said"), F.array(F.lit("{")).alias("marks")))
    raw = F.concat(said, F.lit(' <think>{"n": 0}</think> so: [no list] \n```json\n'), document, F.lit('\n```\n and not {"n": -1}'))
    t = turns(spark, sf).select("job_id", "ord", raw.alias("raw"), F.concat(F.lit('{"n": 1'), action, count, cells).alias("cut"))
    parsed = t.withColumn("doc", F.try_parse_json(tx.json_payload(F.col("raw"), "n")))
    unescaped = lambda c: F.regexp_replace(F.replace(c, F.lit("\\n"), F.lit("\n")), r'\\(["\\/])', "$1")
    shown = F.transform(tx.salvaged_cells(F.col("cut")), lambda c: F.concat_ws(":", c["t"].cast("string"), unescaped(c["see"])))
    return parsed.select(
        "job_id", "ord", F.try_variant_get("doc", "$.n", "bigint").alias("n"), F.try_variant_get("doc", "$.said", "string").alias("said"),
        unescaped(tx.salvaged_field(F.col("cut"), "action")).alias("action"), tx.salvaged_count(F.col("cut"), "adults").alias("count"), F.array_join(shown, "|").alias("cells"),
    )


# Words of turns, 300 ms apart, against captions that begin 400 ms after each turn.

WORDS = f"""{SPOKEN}, wo AS (SELECT job_id, ord * 100 + i AS ord, t0 + i * 300 AS w0, t0 + i * 300 + 250 AS w1, ws[i + 1] AS word FROM (SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z]+'), lambda x: x <> '')[:20] AS ws FROM sc), range(0, 20) r(i) WHERE i < len(ws))"""


def spoken_words(spark, sf):
    ws = F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), "[^A-Za-z]+"), lambda x: x != ""), 1, 20)
    w = spoken(spark, sf).select("job_id", F.col("ord").alias("o"), F.col("t0").alias("s"), F.posexplode(ws).alias("i", "word"))
    return w.select("job_id", (F.col("o") * 100 + F.col("i")).alias("ord"), (F.col("s") + F.col("i") * 300).alias("t0"), (F.col("s") + F.col("i") * 300 + 250).alias("t1"), "word")


@query(f"""WITH {WORDS}, ca AS (SELECT job_id, ord, t0 + 400 AS t0, CASE WHEN t1 - t0 - 400 < 200 THEN t0 + 850 ELSE t1 END AS t1 FROM sc), m AS (SELECT ca.job_id, ca.ord, min(w0) AS a, arg_max(w1, wo.ord) AS z, string_agg(word, '' ORDER BY wo.ord) AS said FROM ca JOIN wo ON wo.job_id = ca.job_id AND w0 < t1 AND t0 < w1
WHERE (least(t1, w1) - greatest(t0, w0)) / greatest(20, w1 - w0) >= 0.55 GROUP BY ALL) SELECT ca.job_id, ca.ord, coalesce(a, t0) AS t0, coalesce(z, t1) AS t1, md5(coalesce(said, '')) AS said FROM ca LEFT JOIN m USING (job_id, ord)""")
def caption_words(spark, sf):
    captions = spoken(spark, sf).select("job_id", "ord", (F.col("t0") + 400).alias("t0"), "t1", "text")
    return dialogue.caption_words(captions, spoken_words(spark, sf), "job_id").select("job_id", "ord", "t0", "t1", F.md5(F.col("said").cast("binary")).alias("said"))


@query(f"""WITH {SPOKEN}, mo AS (SELECT job_id, t0 + 1000 AS m0, t1 + 1000 AS m1, role AS who FROM sc WHERE ord % 2 = 0), s AS (SELECT sc.job_id, sc.ord, list_sort(list(DISTINCT who)) AS w FROM sc JOIN mo ON mo.job_id = sc.job_id AND least(t1, m1) - greatest(t0, m0) > 150 GROUP BY ALL)
SELECT job_id, ord, coalesce(array_to_string(w, ','), '') AS mouths FROM sc LEFT JOIN s USING (job_id, ord)""")
def mouth_evidence(spark, sf):
    s = spoken(spark, sf)
    mouths = s.select("job_id", (F.col("t0") + 1000).alias("t0"), (F.col("t1") + 1000).alias("t1"), F.col("role").alias("who"), F.when(F.col("ord") % 2 == 0, "open").otherwise("shut").alias("state"))
    return dialogue.mouth_evidence(s.select("job_id", "ord", "t0", "t1"), mouths, "job_id").select("job_id", "ord", F.array_join("mouths", ",").alias("mouths"))


@query(f"""WITH {SPOKEN} SELECT job_id, ord, CASE WHEN t1 - t0 >= 600 AND ord % 10 / 10 >= 0.45 AND ord % 4 <> 0 THEN 'mood ' || role END AS mood FROM sc""")
def copied_emotions(spark, sf):
    s = spoken(spark, sf)
    e = s.select("job_id", "t0", "t1", (F.col("ord") % 10 / 10).alias("score"), F.when(F.col("ord") % 4 == 0, "other").otherwise(F.concat(F.lit("mood "), "role")).alias("label"))
    return dialogue.with_emotions(s.select("job_id", "ord", "t0", "t1"), e, "job_id").select("job_id", "ord", F.col("emotion.label").alias("mood"))


@query(f"""WITH {SPOKEN}, h AS (SELECT job_id, lower(regexp_replace(CASE WHEN ord % 3 = 0 THEN '好' ELSE role END, '\\s+', '', 'g')) AS text, t0 AS t FROM sc WHERE ord % 5 <> 4) SELECT job_id, text FROM h WHERE length(regexp_replace(text, '[^一-鿿]', '', 'g')) <= 3 GROUP BY ALL HAVING max(t) - min(t) >= 3000""")
def persistent_labels(spark, sf):
    s = spoken(spark, sf)
    hits = s.select("job_id", F.when(F.col("ord") % 3 == 0, "好").otherwise(F.col("role")).alias("text"), F.col("t0").alias("t"), F.lit("bottom").alias("region"), (F.col("ord") % 5 == 4).alias("watermark"))
    return dialogue.persistent_labels(hits, "job_id")


LAID = f"""{SPOKEN}, pl AS (SELECT *, CASE WHEN ord % 4 = 0 THEN least(2.0, 3.0) ELSE least((t1 - t0) / 1000, 3.0) END AS p FROM sc), ps AS (SELECT *, round_even(p * 1000, 0)::BIGINT AS play_ms FROM pl), la AS (SELECT *, (sum(play_ms) OVER (PARTITION BY job_id ORDER BY ord))::BIGINT AS cat1 FROM ps)"""


def laid_spans(spark, sf):
    c = spoken(spark, sf).select("job_id", F.col("ord").alias("n"), F.col("ord").cast("string").alias("id"), "t0", "t1", F.lit(3.0).alias("seconds"))
    return delivery.concat_spans(c, c.where("n % 4 = 0").select("job_id", "id", F.lit(2.0).alias("play")), "job_id")


@query(f"WITH {LAID} SELECT job_id, ord AS n, t0 AS src0, t0 + play_ms AS src1, cat1 - play_ms AS cat0, cat1 FROM la")
def concat_spans(spark, sf):
    return laid_spans(spark, sf).select("job_id", "n", "src0", "src1", "cat0", "cat1")


@query(f"""WITH {LAID}, s AS (SELECT job_id, ord, t0 AS src0, t0 + play_ms AS src1, cat1 - play_ms AS cat0 FROM la), i AS (SELECT job_id, ord AS n, t0 + 900 AS t0, t1 + 2000 AS t1 FROM sc)
SELECT i.job_id, i.n, s.ord, cat0 + greatest(i.t0, src0) - src0 AS out0, cat0 + least(i.t1, src1) - src0 AS out1 FROM i JOIN s ON i.job_id = s.job_id AND i.t0 < src1 AND src0 < i.t1 WHERE least(i.t1, src1) - greatest(i.t0, src0) >= 120""")
def mapped_spans(spark, sf):
    items = spoken(spark, sf).select("job_id", F.col("ord").alias("n"), (F.col("t0") + 900).alias("t0"), (F.col("t1") + 2000).alias("t1"))
    return retime.mapped_spans(items, laid_spans(spark, sf).withColumnRenamed("n", "ord"), "job_id")


@query(f"""WITH {SPOKEN}, l AS (SELECT job_id, ord // 3 AS clip, max(t1) / 1000.0 AS last, CASE WHEN (ord // 3) % 2 = 0 THEN (ord // 3) * 7.5 + 5 END AS trim FROM sc GROUP BY job_id, ord // 3) SELECT job_id, clip, last, trim::DOUBLE AS trim FROM l WHERE trim IS NOT NULL AND last > trim + 0.12""")
def speech_over_trim(spark, sf):
    clip = F.floor(F.col("ord") / 3)
    islands = spoken(spark, sf).select("job_id", clip.alias("clip"), (F.col("t1") / 1000.0).alias("t1"))
    lines = islands.select("job_id", "clip").distinct().withColumn("trim", F.when(F.col("clip") % 2 == 0, F.col("clip") * 7.5 + 5))
    return delivery.speech_over_trim(islands, lines, ["job_id", "clip"])


# Orders as events of their customer, cut at the starts of others.

EVENTS = """ev AS (SELECT o_custkey AS job_id, o_orderkey AS id, epoch_ms(o_orderdate) // 86400 AS t0, epoch_ms(o_orderdate) // 86400 + o_orderkey % 11 * 3000 AS t1, o_orderstatus = 'P' AS cast_reset FROM orders)"""


def order_events(spark, sf):
    o = table(spark, sf, "orders")
    t0 = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000).cast("long")
    return o.select(F.col("o_custkey").alias("job_id"), t0.alias("t0"), (t0 + F.col("o_orderkey") % 11 * 3000).alias("t1"), F.lit("story").alias("kind"), (F.col("o_orderstatus") == "P").alias("cast_reset"))


@query(f"""WITH {EVENTS}, u AS (SELECT DISTINCT job_id, t0, t1, cast_reset FROM ev WHERE t1 > t0), m AS (SELECT DISTINCT job_id, t0 + 4000 AS t FROM ev), x AS (SELECT u.*, coalesce(list_sort(list(m.t) FILTER (m.t IS NOT NULL)), []) AS ts FROM u LEFT JOIN m ON m.job_id = u.job_id AND m.t > u.t0 + 2000 AND m.t < u.t1 - 2000 GROUP BY ALL),
y AS (SELECT job_id, t0, t1, cast_reset, list_concat([t0], ts) AS a, list_concat(ts, [t1]) AS z FROM x), w AS (SELECT *, unnest(a) AS p, unnest(z) AS q FROM y) SELECT job_id, p AS t0, q AS t1, cast_reset AND p = t0 AS cast_reset FROM w""")
def forced_splits(spark, sf):
    e = events.cleaned(order_events(spark, sf).distinct())
    marks = order_events(spark, sf).select("job_id", (F.col("t0") + 4000).alias("t"))
    return events.force_split(e, marks, "job_id").select("job_id", "t0", "t1", "cast_reset")


@query(f"""WITH {EVENTS}, u AS (SELECT DISTINCT job_id, t0, t1, cast_reset FROM ev WHERE t1 > t0), m AS (SELECT DISTINCT job_id, t0 + 1200 AS t FROM ev WHERE id % 3 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t0, t1) AS n FROM u)
SELECT job_id, t0, t1, n > 1 AND (cast_reset OR EXISTS (SELECT 1 FROM m WHERE m.job_id = n.job_id AND abs(m.t - n.t0) <= 1500)) AS cast_reset FROM n""")
def cast_changes(spark, sf):
    e = order_events(spark, sf).distinct()
    o = table(spark, sf, "orders").where("o_orderkey % 3 = 0")
    t = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000).cast("long") + 1200
    marks = o.select(F.col("o_custkey").alias("job_id"), t.alias("t"), F.array(F.lit("people")).alias("reasons")).distinct()
    return events.cast_changes(events.cleaned(e), marks, "job_id").select("job_id", "t0", "t1", "cast_reset")


# Runs before and after, from lineitem.

LINES = "ln AS (SELECT l_orderkey AS job_id, l_linenumber AS n, min(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL)"


def lines(spark, sf, *by):
    """Lines of orders, dealt out by the columns that the query then groups or joins by (job_id if none is named)."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("n"), "l_quantity")
    return dealt(rows, *(by or ("job_id",))).groupBy("job_id", "n").agg(F.min("l_quantity").cast("long").alias("q"))


@query(f"WITH {LINES} SELECT job_id, n, CASE WHEN q % 3 <> 0 THEN q + 100 ELSE q END AS q, q % 3 <> 0 AS reused FROM ln")
def reused_rows(spark, sf):
    rows = lines(spark, sf, "job_id", "n")
    old = rows.select("job_id", "n", (F.col("q") + 100).alias("q"), (F.col("q") % 3 == 0).alias("broken"))
    return jobs.reused(rows, old, ["job_id", "n"], "q", F.col("broken"))


@query(f"WITH {LINES} SELECT job_id FROM ln GROUP BY job_id HAVING NOT bool_or(q = 7)")
def same_rows(spark, sf):
    rows = lines(spark, sf).withColumnRenamed("n", "ord")
    other = rows.withColumn("q", F.when(F.col("q") == 7, 8).otherwise(F.col("q")))
    return jobs.same_rows(rows, other, "job_id", ["q"])


@query(f"WITH {LINES} SELECT job_id, n AS clip_id FROM ln WHERE q % 4 <> 0 AND q % 30 <= 20 AND q % 7 <> 0")
def valid_caches(spark, sf):
    rows = lines(spark, sf, "job_id", "n").withColumnRenamed("n", "clip_id")
    q = F.col("q")
    cached = rows.select("job_id", "clip_id", F.lit("p").alias("path"), F.when(q % 4 == 0, 2).otherwise(3).alias("writer_rev"), (q + q % 30).alias("t0"), (q + 5000).alias("t1"))
    return jobs.cache_valid(cached, rows.select("job_id", "clip_id", F.when(q % 7 == 0, "other").otherwise("p").alias("path"), q.alias("t0"), (q + 5000).alias("t1")), 3).select("job_id", "clip_id")


@query(f"WITH {LINES} SELECT job_id, bool_and(q % 9 <> 0 AND q % 11 <> 0 AND q <> 13) AS ready FROM ln GROUP BY job_id")
def complete_sets(spark, sf):
    rows, q = lines(spark, sf), F.col("q")
    named = rows.select("job_id", F.concat_ws("/", F.col("job_id").cast("string"), F.col("n").cast("string")).alias("path"), "q")
    files = named.where("q % 9 <> 0").select("path", F.when(q % 11 == 0, 10).when(q % 2 == 0, 2_000_000).otherwise(q).cast("long").alias("size"))
    partial = named.where("q = 13").select(F.concat("path", F.lit(".part")).alias("path"), F.lit(1).cast("long").alias("size"))
    manifest = named.select("job_id", "path", F.when(q % 2 == 0, None).otherwise(q).cast("long").alias("size"))
    return jobs.complete_sets(manifest, files.unionByName(partial), "job_id")


@query(f"WITH {LINES} SELECT job_id, 'ready' AS state, count(*) FILTER (q % 5 = 0) AS done, count(*) FILTER (q % 5 = 1) AS failed FROM ln GROUP BY job_id HAVING bool_or(q % 5 = 0)")
def repaired_batches(spark, sf):
    state = F.when(F.col("q") % 5 == 0, "done").when(F.col("q") % 5 == 1, "failed").otherwise("running")
    return jobs.batches_repaired(lines(spark, sf).select("job_id", F.col("n").alias("clip_id"), state.alias("state")))


@query(f"""WITH {LINES}, b AS (SELECT job_id, n, (n - 1) * 1000 + CASE WHEN q % 5 = 0 THEN 300 ELSE 0 END AS t0, n * 1000 + CASE WHEN q % 7 = 0 THEN 400 ELSE 0 END AS t1 FROM ln), s AS (SELECT *, lag(t1) OVER w AS p, lead(t0) OVER w AS x FROM b WINDOW w AS (PARTITION BY job_id ORDER BY t0, t1))
SELECT job_id, 'head' AS "where", 0 AS "from", t0 AS "to" FROM s WHERE p IS NULL AND t0 > 150 UNION ALL SELECT job_id, CASE WHEN t0 > p THEN 'gap' ELSE 'overlap' END, least(p, t0), greatest(p, t0) FROM s WHERE abs(t0 - p) > 150 UNION ALL SELECT job_id, 'tail', t1, 7000 FROM s WHERE x IS NULL AND 7000 - t1 > 150""")
def untiled_beats(spark, sf):
    q, n = F.col("q"), F.col("n")
    beats = lines(spark, sf).select("job_id", ((n - 1) * 1000 + F.when(q % 5 == 0, 300).otherwise(0)).alias("t0"), (n * 1000 + F.when(q % 7 == 0, 400).otherwise(0)).alias("t1"), F.lit(7000).alias("duration"))
    return audit.untiled(beats, "job_id", "duration")


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'missing' WHEN doc_id % 10 = 0 THEN 'extra' ELSE 'changed' END AS drift FROM d WHERE doc_id % 30 <> 0 AND (doc_id % 6 = 0 OR doc_id % 10 = 0 OR doc_id % 7 = 0)""")
def drifted_texts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("doc_id")
    stored = d.where(k % 6 != 0).select("doc_id", F.when(k % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.regexp_replace("text", "\n", "\r\n")).alias("text"))
    return audit.drifted(stored, d.where(k % 10 != 0), "doc_id", "text")


@query("SELECT o_custkey AS job_id, count(*) AS clips, count(*) FILTER (o_orderkey % 3 > 0) AS splits, count(*) FILTER (o_orderstatus = 'P') AS pads, max(abs(o_orderkey % 17 - 8)) AS worst_drift FROM orders GROUP BY o_custkey")
def pack_statistics(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), (F.col("o_orderkey") % 3).alias("part"), (F.col("o_orderstatus") == "P").alias("padded"), (F.col("o_orderkey") % 17 - 8).alias("drift"))
    return prompts.pack_statistics(o, "job_id")


@query(f"""WITH {TURNS}, o AS (SELECT job_id, ord, CASE WHEN ord % 3 = 0 THEN '' WHEN ord % 3 = 1 THEN 'old ' || role END AS lock FROM tu WHERE ord % 4 <> 3) SELECT tu.job_id, tu.ord, coalesce(nullif(o.lock, ''), 'new ' || role) AS lock FROM tu LEFT JOIN o USING (job_id, ord)""")
def kept_locks(spark, sf):
    t = turns(spark, sf)
    new = t.select("job_id", F.col("ord").alias("id"), F.concat(F.lit("new "), "role").alias("lock"))
    old = t.where("ord % 4 <> 3").select("job_id", F.col("ord").alias("id"), F.when(F.col("ord") % 3 == 0, "").when(F.col("ord") % 3 == 1, F.concat(F.lit("old "), "role")).alias("lock"))
    return prompts.kept_locks(new, old, ["job_id"]).withColumnRenamed("id", "ord").select("job_id", "ord", "lock")


@query(f"""WITH {TURNS} SELECT job_id, ord, 'hall' AS scene, CASE WHEN ord % 2 = 0 THEN NULL ELSE role END AS chain, 'a|b ' || ord AS beats FROM tu""")
def editor_sections(spark, sf):
    o = F.col("ord")
    text = F.concat(F.lit("head\n## Scene\nhall\n\n## Chain\n"), F.when(o % 2 == 0, "(nothing)").otherwise(F.col("role")), F.lit("\n## Beats\n- a\n* b "), o.cast("string"), F.lit("\n## Scene\nanother"))
    got = turns(spark, sf).select("job_id", "ord", prompts.sections(text).alias("s"))
    part = lambda n: F.try_element_at("s", F.lit(n))
    return got.select("job_id", "ord", part("Scene").alias("scene"), F.nullif(part("Chain"), F.lit("")).alias("chain"), F.array_join(prompts.bullets(part("Beats")), "|").alias("beats"))


@query(f"""WITH {TURNS} SELECT job_id, md5('# Audit' || chr(10) || chr(10) || string_agg('- ' || ord || ': ' || role, chr(10) ORDER BY '- ' || ord || ': ' || role)) AS document FROM tu GROUP BY job_id""")
def audit_report(spark, sf):
    found = turns(spark, sf).select("job_id", F.col("ord").cast("string").alias("clip_id"), F.col("role").alias("rule"))
    return prompts.report(found, "job_id").select("job_id", F.md5(F.col("document").cast("binary")).alias("document"))


@query(f"""WITH {TURNS} SELECT job_id, ord, md5(concat_ws(chr(10), 'Style: film', '(S1) ' || role || CASE WHEN ord % 2 = 0 THEN ' Voice: deep' ELSE '' END, '[00:00.000] first' || chr(10) || '[00:02.500] ' || role, 'Overall soundscape: wind', 'Non-diegetic music: N/A')) AS prompt FROM tu""")
def assembled_prompts(spark, sf):
    role, o = F.col("role"), F.col("ord")
    speakers = F.array(F.struct(F.lit("S1").alias("id"), role.alias("lock"), F.when(o % 2 == 0, "deep").otherwise("").alias("voice")))
    shots = F.array(F.struct(F.lit(2).alias("index"), F.lit(2.5).alias("at"), role.alias("text")), F.struct(F.lit(1).alias("index"), F.lit(None).cast("double").alias("at"), F.lit("first").alias("text")))
    text = prompts.assembled(F.lit("film"), F.lit(""), speakers, shots, F.lit("wind"), F.lit(""))
    return turns(spark, sf).select("job_id", "ord", F.md5(text.cast("binary")).alias("prompt"))


@query("""SELECT o_custkey AS job_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY epoch_ms(o_orderdate), o_orderkey) AS n, round(CASE WHEN o_orderkey % 3 = 0 THEN least(o_orderkey % 20, 9.0) ELSE least(o_orderkey % 13, 9.0) END, 3) AS plays, CASE WHEN 9.0 > o_orderkey % 13 + 0.05 THEN o_orderkey % 13 END::DOUBLE AS trim FROM orders WHERE o_orderkey % 20 > 0""")
def playing_times(spark, sf):
    o, k = table(spark, sf, "orders").where("o_orderkey % 20 > 0"), F.col("o_orderkey")
    source = (k % 13).cast("double")
    w = Window.partitionBy("o_custkey").orderBy(F.unix_micros(F.col("o_orderdate").cast("timestamp")), "o_orderkey")
    plays = delivery.play_seconds(source, F.lit(9.0), F.when(k % 3 == 0, (k % 20).cast("double")))
    return o.select(F.col("o_custkey").alias("job_id"), k.alias("id"), F.row_number().over(w).cast("long").alias("n"), F.round(plays, 3).alias("plays"), delivery.trim_line(source, F.lit(9.0)).alias("trim"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, o_orderkey % 40 AS size FROM orders),
g AS (SELECT job_id, ord, size <= 60 AS fits, CASE WHEN size <= 60 THEN size ELSE 0 END AS used FROM o WHERE ord = 1 UNION ALL SELECT o.job_id, o.ord, g.used + o.size <= 60, g.used + CASE WHEN g.used + o.size <= 60 THEN o.size ELSE 0 END FROM g JOIN o ON o.job_id = g.job_id AND o.ord = g.ord + 1) SELECT job_id, ord, fits FROM g""")
def mail_attachments(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    files = table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), F.row_number().over(w).alias("ord"), (F.col("o_orderkey") % 40).alias("size"))
    return delivery.fitting(files, "job_id", 60)


# Rules on texts: turns, cut and wrapped so that each rule holds for some and not for others.

RULES = f"""{TURNS}, ru AS (SELECT *, coalesce(text, '') AS s, ['bottom', 'title', 'other'][ord % 3 + 1] AS place, left(coalesce(text, ''), (ord * 3 % 28)::INT) || CASE WHEN ord % 4 = 0 THEN ' @me' ELSE '' END AS label FROM tu)"""


@query(f"""WITH {RULES} SELECT job_id, ord, md5(regexp_replace(s, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS title, md5(regexp_replace(regexp_replace(s, '\\s+', '', 'g'), '[,.!?;:，。！？；：、…—"''“”‘’()（）\\-]', '', 'g')) AS line,
place IN ('title', 'other') AND length(label) <= 2 OR contains(label, '@') AND place = 'title' AND length(label) < 24 AS marked,
CASE role WHEN 'user' THEN 'calm' WHEN 'assistant' THEN 'glad' ELSE lower(role) END AS feeling, ord % 3 <> 0 AND (CASE WHEN ord % 2 = 0 THEN '16:9' ELSE '9:16' END) <> '16:9' AS differs, CASE ord % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'slow' WHEN 2 THEN 'slow' END AS path,
contains(s, 'en ') OR contains(s, 'the') AS mentioned, CASE WHEN ord % 3 = 0 THEN 'ok' WHEN ord % 2 = 0 THEN 'red' ELSE 'yellow' END AS light,
CASE WHEN ord % 5 = 0 OR ord % 7 = 0 THEN 'login refused (535): ' || CASE WHEN ord % 7 = 0 THEN 'Login fail ' ELSE 'code ' END || ord WHEN ord % 3 = 0 THEN 'connection closed during login' ELSE 'code ' || ord END AS mail,
ord % 4 = 1 OR ord % 3 <> 0 AS stale, CASE WHEN ord % 6 = 0 THEN true WHEN ord % 6 = 1 THEN false WHEN ord % 6 = 2 THEN true WHEN ord % 6 = 3 THEN false ELSE trim(left(s, 5)) NOT IN ('', 'shell') END AS ready, 'layer.' || ord AS layer FROM ru""")
def text_rules(spark, sf):
    o = F.col("ord")
    s = F.coalesce("text", F.lit(""))
    t = turns(spark, sf).withColumn("s", s).withColumn("place", F.element_at(F.array(F.lit("bottom"), F.lit("title"), F.lit("other")), (o % 3 + 1).cast("int")))
    t = t.withColumn("label", F.concat(F.left("s", (o * 3 % 28).cast("int")), F.when(o % 4 == 0, " @me").otherwise("")))
    n = o.cast("string")
    name = F.element_at(F.array(F.lit("fast"), F.lit("old"), F.lit("slow"), F.lit("none")), (o % 4 + 1).cast("int"))
    message = F.concat(F.when(o % 7 == 0, " Login fail ").when(o % 5 == 0, "code ").when(o % 3 == 0, "server Unexpectedly closed ").otherwise("code "), n)
    made = F.when(o % 3 == 0, "org/Base-Large@2").otherwise("org/small")
    body = F.when(o % 6 == 0, "it failed").when(o % 6 == 1, "loading ...").otherwise("")
    videos = F.when(o % 6 == 2, 2).when(o % 6 == 3, 1)
    page = F.when(o % 6 == 2, "x").when(o % 6 == 3, " ").otherwise(F.left("s", F.lit(5)))
    return t.select(
        "job_id", "ord", F.md5(tx.bare_title(F.col("s")).cast("binary")).alias("title"), F.md5(tx.bare_line(F.col("s")).cast("binary")).alias("line"), tx.watermark(F.col("label"), F.col("place")).alias("marked"),
        tx.canonical_label(F.concat(F.lit("x/ "), F.upper("role")), {"user": "calm", "assistant": "glad"}).alias("feeling"), tx.aspect_differs(F.when(o % 3 == 0, " ").otherwise(F.when(o % 2 == 0, "16:9 ").otherwise("9:16")), F.lit("16:9")).alias("differs"),
        tx.canonical_name(name, {"old": "slow"}, ("fast", "slow")).alias("path"), tx.mentions(F.col("text"), ("en ", "the")).alias("mentioned"), tx.light(o % 3 == 0, o % 2 == 0).alias("light"), tx.mail_error(message, F.when(o % 5 == 0, 535)).alias("mail"),
        tx.made_by_another(F.when(o % 4 != 1, F.array(o)), made, F.lit("org/base-large")).alias("stale"), tx.page_ready(page, body, F.lit(None).cast("string"), videos, "failed", "loading", ("shell",)).alias("ready"),
        tx.without_prefixes(F.concat(F.when(o % 2 == 0, "module.model.module.").otherwise(""), F.lit("layer."), n), ("module.", "model.")).alias("layer"),
    )


# How jobs are rendered: choices by what a job, its prompts or the configuration say, over the orders of customers.


@query("""WITH o AS (SELECT o_custkey AS job_id, o_orderkey AS k FROM orders), q AS (SELECT k, job_id, CASE WHEN k % 4 = 0 THEN 'own.json' END AS own, CASE WHEN k % 3 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'block.json' ELSE '' END END AS block, CASE WHEN k % 5 <> 0 THEN 'shared.json' ELSE '' END AS shared FROM o),
w AS (SELECT *, CASE WHEN own IS NOT NULL THEN own WHEN block IS NOT NULL THEN coalesce(nullif(block, ''), nullif(shared, '')) END AS workflow, CASE WHEN own IS NOT NULL THEN CASE WHEN k % 7 = 0 THEN 0.4 ELSE k % 7 / 10 END ELSE 1.5 END AS mp, CASE WHEN own IS NOT NULL THEN CASE WHEN k % 9 = 0 THEN 6 ELSE k % 9 END ELSE 8 END AS steps FROM q)
SELECT k, CASE coalesce(CASE WHEN k % 3 = 0 THEN 'turbo' END, CASE WHEN k % 5 = 0 THEN 'old' END, CASE WHEN k % 7 = 0 THEN 'wrong' END, 'plain') WHEN 'old' THEN 'turbo' WHEN 'wrong' THEN NULL WHEN 'turbo' THEN 'turbo' ELSE 'plain' END AS route,
CASE WHEN k % 2 = 0 THEN 'final' ELSE 'draft' END AS quality, workflow, CASE WHEN workflow IS NOT NULL THEN mp END::DOUBLE AS megapixels, CASE WHEN workflow IS NOT NULL THEN steps END::INT AS steps, coalesce(workflow IN ('own.json', 'shared.json') AND mp > 0 AND steps >= 1, false) AS valid,
(k % 3 + k % 4)::BIGINT AS queued, k % 3 > 0 AS busy, CASE WHEN k % 3 > 0 THEN 'r0' END AS runs, k % 3 > 1 OR k % 4 > 1 AS waits FROM w""")
def render_choices(spark, sf):
    k = F.col("k")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    of = lambda workflow, mp, steps: F.struct(workflow.alias("workflow"), mp.cast("double").alias("megapixels"), steps.cast("int").alias("steps"))
    snapshot = of(F.when(k % 4 == 0, "own.json"), k % 7 / 10, k % 9)
    block = F.when(k % 3 != 0, of(F.when(k % 2 == 0, "block.json").otherwise(""), F.lit(1.5), F.lit(8)))
    parameters = screen.quality_parameters(snapshot, block, F.when(k % 5 != 0, "shared.json").otherwise(""))
    some = lambda n, name: F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i < n, F.concat(F.lit(name), i.cast("string")))), lambda x: x.isNotNull())
    running, pending = some(k % 3, "r"), some(k % 4, "p")
    summary = screen.queue_summary(running, pending)
    rows = o.select("k", screen.route(F.when(k % 3 == 0, "turbo").otherwise(""), F.when(k % 5 == 0, "old"), F.when(k % 7 == 0, "wrong"), {"old": "turbo"}, ("turbo", "plain"), "plain").alias("route"), screen.next_quality(k % 2 == 0).alias("quality"), parameters.alias("p"), summary.alias("s"), (screen.in_queue(running, pending, F.lit("r1")) | screen.in_queue(running, pending, F.lit("p1"))).alias("waits"))
    return rows.select("k", "route", "quality", "p.workflow", "p.megapixels", "p.steps", screen.valid_parameters(F.col("p"), ("own.json", "shared.json")).alias("valid"), F.col("s.length").alias("queued"), F.col("s.running").alias("busy"), F.col("s.prompt_id").alias("runs"), "waits")


@query("""WITH c AS (SELECT o_orderkey // 8 AS job_id, o_orderkey AS clip_id FROM orders), f AS (SELECT c.*, q.quality, CASE WHEN (clip_id * 7 + q.i) % 53 = 0 THEN 999 ELSE 1000 + clip_id % 5 END AS size, CASE WHEN (clip_id + q.i) % 47 = 0 THEN 'error' ELSE 'done' END AS status FROM c, (VALUES (0, 'draft'), (1, 'final')) q(i, quality))
SELECT job_id, bool_and(size >= 1000) FILTER (quality = 'draft') AS drafts_ready, bool_and(size >= 1000) FILTER (quality = 'final') AS finals_ready, bool_and(status = 'done') FILTER (quality = 'draft') AS drafts_done, bool_and(status = 'done') FILTER (quality = 'final') AS finals_done FROM f GROUP BY job_id""")
def files_ready(spark, sf):
    """Whether all clips are there, by the sizes of their files and by what is recorded."""
    k = F.col("o_orderkey")
    c = table(spark, sf, "orders").select(F.floor(k / 8).alias("job_id"), k.alias("clip_id"))
    each = c.select("*", F.posexplode(F.array(F.lit("draft"), F.lit("final"))).alias("i", "quality"))
    each = each.withColumn("size", F.when((F.col("clip_id") * 7 + F.col("i")) % 53 == 0, 999).otherwise(1000 + F.col("clip_id") % 5)).withColumn("status", F.when((F.col("clip_id") + F.col("i")) % 47 == 0, "error").otherwise("done"))
    done = screen.ready_by_status(each)
    by = lambda q: done.where(F.col("quality") == q).select("job_id", F.col("ready").alias(f"{q}s_done"))
    return screen.ready_by_size(c, each).join(by("draft"), "job_id").join(by("final"), "job_id")


# Cookies and files of suppliers: one for each line of an order, of few names, hosts and sizes.

COOKIES = """ck AS (SELECT l_suppkey AS k, (l_orderkey * 8 + l_linenumber)::BIGINT AS ord, ['sid', 'csrf', 'tz', ''][l_partkey % 4 + 1] AS name, 'v' || l_partkey % 97 AS value, ['.example.com', 'www.example.com', 'example.org', ''][l_orderkey % 4 + 1] AS domain, l_linenumber % 2 = 0 AS secure, CASE WHEN l_partkey % 3 = 0 THEN 'x' ELSE (l_orderkey - 500)::VARCHAR END AS expires,
'out/f' || l_linenumber || CASE WHEN l_partkey % 2 = 0 THEN '.mp4' ELSE '.part' END AS path, l_partkey % 13 AS size FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey))"""


def supplier_cookies(spark, sf):
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey")
    li = table(spark, sf, "lineitem").withColumn("n", F.row_number().over(w)).where("n = 1")
    o, p, i = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    pick = lambda words, at: F.element_at(F.array(*[F.lit(x) for x in words]), (at + 1).cast("int"))
    return li.select(
        F.col("l_suppkey").alias("k"), (o * 8 + i).alias("ord"), pick(("sid", "csrf", "tz", ""), p % 4).alias("name"), F.concat(F.lit("v"), (p % 97).cast("string")).alias("value"), pick((".example.com", "www.example.com", "example.org", ""), o % 4).alias("domain"), (i % 2 == 0).alias("secure"),
        F.when(p % 3 == 0, "x").otherwise((o - 500).cast("string")).alias("expires"), F.concat(F.lit("out/f"), i.cast("string"), F.when(p % 2 == 0, ".mp4").otherwise(".part")).alias("path"), (p % 13).alias("size"),
    )


@query(f"""WITH {COOKIES}, ow AS (SELECT k, name, arg_min(value, ord) AS value, min(ord) AS o FROM ck WHERE domain LIKE '%example.com' GROUP BY k, name), hd AS (SELECT k, md5(string_agg(name || '=' || value, '; ' ORDER BY o)) AS header FROM ow GROUP BY k),
nt AS (SELECT k, md5('# Netscape HTTP Cookie File' || chr(10) || chr(10) || string_agg(domain || chr(9) || CASE WHEN domain LIKE '.%' THEN 'TRUE' ELSE 'FALSE' END || chr(9) || '/' || chr(9) || CASE WHEN secure THEN 'TRUE' ELSE 'FALSE' END || chr(9) || greatest(coalesce(try_cast(expires AS BIGINT), 0), 0) || chr(9) || name || chr(9) || value, chr(10) ORDER BY ord) || chr(10)) AS document FROM ck WHERE name <> '' GROUP BY k),
lg AS (SELECT k, bool_or(name = 'sid') AS logged_in FROM ck WHERE k % 2 = 0 AND name <> 'csrf' OR name = 'tz' GROUP BY k), bg AS (SELECT k, arg_min(path, (-size, path)) AS path, max(size) AS size FROM ck WHERE path LIKE '%.mp4' GROUP BY k)
SELECT k, header, document, logged_in, path, size FROM hd FULL JOIN nt USING (k) FULL JOIN lg USING (k) FULL JOIN bg USING (k)""")
def cookies_and_files(spark, sf):
    c = supplier_cookies(spark, sf)
    md5 = lambda col: F.md5(F.col(col).cast("binary")).alias(col)
    jar = c.withColumn("file", F.col("path")).withColumn("path", F.lit("/"))
    out = metadata.cookie_header(jar, "k", "example.com").select("k", md5("header"))
    for part in (metadata.netscape_cookies(jar, "k").select("k", md5("document")), metadata.logged_in(jar.where("k % 2 = 0 and name <> 'csrf' or name = 'tz'"), "k", ("sid", "uid")), metadata.largest(c, "k", r"\.mp4$")):
        out = out.join(part, "k", "full")
    return out


POSTS = f"""{TURNS}, po AS (SELECT job_id, ord, coalesce(text, '') AS s, left(coalesce(text, ''), 12) AS d, ord % 5 AS shape FROM tu)"""


@query(f"""WITH {POSTS} SELECT job_id, ord, shape IN (0, 1, 2) AS found, CASE WHEN shape IN (0, 1, 2) THEN nullif(d, '') END AS description, CASE WHEN shape IN (0, 1, 2) THEN ord END::BIGINT AS likes, CASE WHEN shape IN (0, 1, 2) THEN nullif(d, '') END AS preview,
CASE WHEN ord % 3 = 0 THEN 'http://cdn.b/' || ord ELSE 'http://cdn.b/' || ord || ' https://a/1' END AS urls, CASE WHEN ord % 4 = 0 THEN 'api' WHEN ord % 4 = 1 THEN 'browser' ELSE 'download' END AS route FROM po""")
def posts_in_documents(spark, sf):
    """The part of a document that describes a post, wrapped in several ways, its fields, the addresses of its video that are
    picked, and how an address is fetched."""
    o = F.col("ord")
    t = turns(spark, sf).select("job_id", "ord", F.left(F.coalesce("text", F.lit("")), F.lit(12)).alias("d"))
    node = F.to_json(F.struct(F.col("d").alias("desc"), F.struct(o.alias("digg_count"), F.lit("x").alias("share_count")).alias("statistics"), F.struct(F.lit("").alias("nickname")).alias("author")))
    wrap = lambda *names: F.concat(*[F.lit('{"other": 1, "' + n + '": ') for n in names], node, F.lit("}" * len(names)))
    shape = o % 5
    document = F.when(shape == 0, node).when(shape == 1, wrap("data", "aweme_detail")).when(shape == 2, wrap("item")).when(shape == 3, F.lit('{"desc": "no numbers", "statistics": 3}')).otherwise("no document")
    video = F.concat(F.lit('{"video": {"play_addr": {"url_list": ["http://cdn.b/'), o.cast("string"), F.when(o % 3 == 0, '", "ftp://x"]}').otherwise('", "https://a/1"]}'), F.lit(', "download_addr": {"url_list": ["http://a/watermark=1"]}, "bit_rate": [{"play_addr": {"url_list": ["http://cdn.b/'), o.cast("string"), F.lit('"]}}, {"q": 1}]}}'))
    url = F.when(o % 4 == 0, "https://v.api.example/x").when(o % 4 == 1, "//user@www.page.example:80/x").when(o % 4 == 2, "https://notpage.example.org/").otherwise("page.example")
    rows = t.select("job_id", "ord", metadata.detail_node(document).alias("node"), metadata.play_urls(F.try_parse_json(video)).alias("urls"), metadata.ingest_route(url, ("api.example",), ("page.example",)).alias("route"))
    c = rows.withColumn("c", metadata.compact(F.try_parse_json("node")))
    return c.select("job_id", "ord", F.col("node").isNotNull().alias("found"), "c.description", "c.likes", "c.preview", F.array_join(metadata.picked_urls(F.col("urls"), "cdn.b"), " ").alias("urls"), "route")


# Captions and what was heard, in Han letters put in place of Latin ones, too short for a phrase to come three times.

LATIN, HAN = "abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这中大来上个国到说们为子和你地"
JUDGED = f"""{TURNS}, ca AS (SELECT job_id, ord AS id, translate(left(lower(coalesce(text, '')), (ord % 22)::INT), '{LATIN}', '{HAN}好') AS text, CASE ord % 5 WHEN 0 THEN '' WHEN 1 THEN 'latin letters only' WHEN 2 THEN translate(left(lower(coalesce(text, '')), (ord % 22)::INT), '{LATIN}', '{HAN}好') || ' ' WHEN 3 THEN '（（））））' ELSE '他们来了' END AS said, CASE WHEN ord % 7 = 3 THEN 'asr' ELSE 'ocr' END AS source FROM tu)"""


@query(f"""WITH {JUDGED}, u AS (SELECT *, [list_distinct(string_split(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '')) FOR x IN [text, said]] AS kinds, [regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN [text, said]] AS tr, [length(regexp_replace(x, '[^一-鿿]', '', 'g')) FOR x IN [text, said]] AS han, [length(regexp_replace(x, '[^A-Za-z]', '', 'g')) FOR x IN [text, said]] AS latin, [length(regexp_replace(x, '[^)）]', '', 'g')) FOR x IN [text, said]] AS closing FROM ca),
d AS (SELECT *, [tr[i] <> '' AND han[i] >= 2 AND closing[i] < 4 AND NOT (length(tr[i]) >= 8 AND len(kinds[i]) <= 2) AND NOT (latin[i] >= 10 AND han[i] < 3) FOR i IN [1, 2]] AS ok FROM u),
e AS (SELECT *, CASE WHEN source <> 'ocr' THEN 'keep' WHEN NOT ok[1] AND NOT ok[2] THEN 'drop' WHEN ok[1] AND NOT ok[2] THEN 'keep' WHEN ok[2] AND NOT ok[1] THEN 'use-asr' WHEN regexp_replace(text, '\\s+', '', 'g') = regexp_replace(said, '\\s+', '', 'g') THEN 'keep' ELSE 'judge' END AS decision FROM d)
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY id) AS id, CASE WHEN decision = 'use-asr' OR decision = 'judge' AND id % 2 = 0 THEN said ELSE text END AS text, decision FROM e WHERE decision <> 'drop'""")
def judged_captions(spark, sf):
    o = F.col("ord")
    shown = F.translate(F.left(F.lower(F.coalesce("text", F.lit(""))), (o % 22).cast("int")), LATIN, HAN + "好")
    said = F.when(o % 5 == 0, "").when(o % 5 == 1, "latin letters only").when(o % 5 == 2, F.concat(shown, F.lit(" "))).when(o % 5 == 3, "（（））））").otherwise("他们来了")
    segments = turns(spark, sf).select("job_id", o.alias("id"), shown.alias("text"), said.alias("said"), F.when(o % 7 == 3, "asr").otherwise("ocr").alias("source"))
    picks = segments.where("id % 2 = 0").select("job_id", "id", F.lit("asr").alias("pick"))
    return dialogue.adjudicated(segments, picks, "job_id").select("job_id", F.col("id").cast("long").alias("id"), "text", "decision")


# What customers ask for: a new job each, with options of their own or the default ones, over settings and gauges of a host.


@query("""WITH c AS (SELECT c_custkey AS k FROM customer), p AS (SELECT k, CASE WHEN k % 4 = 0 THEN 'none.json' ELSE 'a.json' END AS bw, CASE WHEN k % 4 = 0 THEN 'b.json' ELSE 'a.json' END AS gw, CASE WHEN k % 4 = 0 THEN 0.5 ELSE 0.3 END AS gm, CASE WHEN k % 4 = 0 THEN 4 ELSE k % 9 + 1 END AS gs, CASE WHEN k % 3 <> 0 THEN CASE WHEN k % 5 = 0 THEN 'wrong.json' WHEN k % 5 = 1 THEN 'b.json' END END AS ow, CASE WHEN k % 3 <> 0 AND k % 2 = 0 THEN k % 3 / 10 END AS om FROM c),
m AS (SELECT *, coalesce(ow, gw) AS mw, coalesce(om, gm) AS mm FROM p)
SELECT k AS job_id, 'pending' AS state, 'download' AS stage, 3 AS n_stages, 'source/video.mp4' AS video, CASE WHEN k % 3 = 1 THEN 'mock' ELSE 'real' END AS mode, CASE WHEN k % 2 = 0 THEN 'p' || k ELSE 'turbo' END AS path,
CASE WHEN k % 3 = 0 OR mw IN ('a.json', 'b.json') THEN mw END AS workflow, CASE WHEN k % 3 = 0 OR mw IN ('a.json', 'b.json') THEN mm END::DOUBLE AS megapixels, CASE WHEN k % 3 = 0 OR mw IN ('a.json', 'b.json') THEN gs END::INT AS steps,
CASE WHEN k % 2 = 0 THEN '' ELSE concat_ws(',', CASE WHEN k % 3 = 0 THEN 'user' END, CASE WHEN k % 5 = 0 THEN 'password' END) END AS missing, k % 2 = 0 AS skipped, concat_ws(',', CASE WHEN k % 100 >= 90 AND k % 7 <> 0 THEN 'vram' END, CASE WHEN k % 90 >= 80 THEN 'temperature' END) AS alerts FROM m""")
def created_jobs(spark, sf):
    k = F.col("job_id")
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id")).select(
        "job_id", F.lit("2026-01-01 00:00:00").cast("timestamp").alias("at"), F.lit("url").alias("kind"), F.lit("http://x").alias("url"), F.lit(None).cast("string").alias("original_path"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, "mock").alias("mode"), F.when(k % 2 == 0, F.concat(F.lit("p"), k.cast("string"))).alias("path"),
    )
    made = screen.created(asked, {"mode": "real", "path": "turbo"}, ("download", "script", "finish"))
    of = lambda workflow, mp, steps: F.struct(workflow.alias("workflow"), mp.cast("double").alias("megapixels"), steps.cast("int").alias("steps"))
    base = of(F.when(k % 4 == 0, "none.json").otherwise("a.json"), F.lit(0.3), k % 9 + 1)
    overlay = F.when(k % 3 != 0, of(F.when(k % 5 == 0, "wrong.json").when(k % 5 == 1, "b.json"), F.when(k % 2 == 0, k % 3 / 10), F.lit(None)))
    chosen = screen.overlaid_parameters(base, overlay, ("a.json", "b.json"), of(F.lit("b.json"), F.lit(0.5), F.lit(4)))
    mail = screen.mail_ready(k % 2 == 1, F.when(k % 3 == 0, " ").otherwise("me"), F.when(k % 5 != 0, "secret"))
    line = F.concat_ws(", ", F.lit("gpu"), F.when(k % 7 == 0, "[N/A]").otherwise((k % 100).cast("string")), F.lit("100"), F.lit("5"), (k % 90).cast("string"))
    cells = F.split(line, ",")
    used, total, celsius = (F.trim(F.element_at(cells, i)).try_cast("double") for i in (2, 3, 5))
    alerts = views.gauge_alerts(used, total, celsius)
    rows = made.withColumns({"p": chosen, "mail": mail, "alerts": alerts})
    return rows.select(
        "job_id", "state", "stage", F.size("stages").alias("n_stages"), "source.video", "options.mode", "options.path", "p.workflow", "p.megapixels", "p.steps",
        F.array_join("mail.missing", ",").alias("missing"), "mail.skipped", F.array_join("alerts", ",").alias("alerts"),
    )
