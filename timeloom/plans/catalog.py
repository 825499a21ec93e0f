"""Registered queries of the timeline operators over the driver's tables, each with equivalent DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom.functions import signal
from timeloom.functions import text as tx
from timeloom.functions import timegrid as tg
from timeloom.operators import audit, beats, boundaries, clips, graph, intervals, metadata, packing, prompts, retime, sequences, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Parameters of the queries over `events`, where a user is a timeline and events lie minutes apart.
GAP = 1_800_000
RADIUS = 600_000
JUMP = 40.0
HOP, WIDE = 9_000_000, 10_800_000


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Events as points: job_id, ord (unique), t in ms, kind, value."""
    e = table(spark, sf, "events")
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("ord"), t.alias("t"), F.col("event_type").alias("kind"), "value")


TIMELINE = "tl AS (SELECT user_id AS job_id, event_id AS ord, (epoch_us(ts) // 1000) AS t, event_type AS kind, value FROM events)"


def signals(tl: DataFrame) -> DataFrame:
    w = Window.partitionBy("job_id").orderBy("t", "ord")
    p = tl.select("job_id", "t", "kind", "value", F.lag("kind").over(w).alias("k0"), F.lag("t").over(w).alias("t0"), F.lag("value").over(w).alias("v0"))
    reasons = F.filter(
        F.array(
            F.when(F.col("kind") != F.col("k0"), F.struct("t", F.lit("people").alias("reason"))),
            F.when(F.col("t") - F.col("t0") >= GAP, F.struct(F.floor((F.col("t") + F.col("t0")) / 2).alias("t"), F.lit("gap").alias("reason"))),
            F.when(F.abs(F.col("value") - F.col("v0")) >= JUMP, F.struct("t", F.lit("cut").alias("reason"))),
        ),
        lambda x: x.isNotNull(),
    )
    return p.select("job_id", F.explode(reasons).alias("s")).select("job_id", "s.t", "s.reason")


SIGNALS = f"""{TIMELINE}, prev AS (SELECT *, lag(kind) OVER w AS k0, lag(t) OVER w AS t0, lag(value) OVER w AS v0 FROM tl WINDOW w AS (PARTITION BY job_id ORDER BY t, ord)),
sig AS (SELECT job_id, t, 'people' AS reason FROM prev WHERE kind <> k0 UNION ALL SELECT job_id, (t + t0) // 2, 'gap' FROM prev WHERE t - t0 >= {GAP}
UNION ALL SELECT job_id, t, 'cut' FROM prev WHERE abs(value - v0) >= {JUMP}),
cand AS (SELECT job_id, t, list_sort(list(DISTINCT reason)) AS reasons FROM sig GROUP BY job_id, t)"""
WEIGHT = "CASE r WHEN 'tail-cut' THEN 4 WHEN 'tail-silent' THEN 3 WHEN 'people' THEN 2 WHEN 'cut' THEN 2 WHEN 'title' THEN 2 ELSE 1 END"
SCORE = f"list_sum(list_transform(reasons, lambda r: {WEIGHT}))"


def anchors_sql(points: str, radius: int) -> str:
    """Anchors of (job_id, t) in the relation ``points``: the first point, then each first point beyond the radius."""
    return f"""anc AS (SELECT job_id, min(t) AS t FROM {points} GROUP BY job_id UNION ALL
        SELECT a.job_id, min(p.t) FROM anc a JOIN {points} p ON p.job_id = a.job_id AND p.t > a.t + {radius} GROUP BY a.job_id, a.t)"""


@query(f"WITH {SIGNALS} SELECT job_id, t, array_to_string(reasons, ',') AS reasons FROM cand")
def boundary_signals(spark, sf):
    return boundaries.candidates(signals(timeline(spark, sf)), "job_id").select("job_id", "t", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {SIGNALS} SELECT job_id, t, {SCORE}::INT AS score FROM cand")
def boundary_score(spark, sf):
    return boundaries.candidates(signals(timeline(spark, sf)), "job_id").select("job_id", "t", boundaries.score(F.col("reasons")).alias("score"))


@query(f"WITH RECURSIVE {TIMELINE}, {anchors_sql('tl', RADIUS)}, au AS (SELECT DISTINCT * FROM anc) SELECT tl.job_id, tl.ord, tl.t, au.t AS anchor FROM tl ASOF JOIN au ON tl.job_id = au.job_id AND tl.t >= au.t")
def anchored_clusters(spark, sf):
    return sequences.anchored_clusters(timeline(spark, sf).select("job_id", "ord", "t"), "job_id", RADIUS)


@query(f"""WITH RECURSIVE {SIGNALS}, {anchors_sql('cand', RADIUS)}, au AS (SELECT DISTINCT * FROM anc),
cl AS (SELECT c.*, au.t AS anchor, {SCORE} AS own, list_contains(reasons, 'cut') OR list_contains(reasons, 'tail-cut') AS hard FROM cand c ASOF JOIN au ON c.job_id = au.job_id AND c.t >= au.t),
mg AS (SELECT job_id, anchor, arg_min(t, (-own, NOT hard, t)) AS t, list_sort(list_distinct(flatten(list(reasons)))) AS reasons FROM cl GROUP BY job_id, anchor),
sc AS (SELECT job_id, t, reasons, {SCORE} AS score, list_has_any(reasons, ['title', 'cut', 'tail-cut']) AS always, list_has_any(reasons, ['title', 'cut', 'tail-cut', 'tail-silent']) AS exempt FROM mg),
kp AS (SELECT *, greatest(0, 40 - sum(exempt::INT) OVER (PARTITION BY job_id)) AS room, row_number() OVER (PARTITION BY job_id ORDER BY exempt, score DESC, t) AS n FROM sc WHERE always OR score >= 3)
SELECT job_id, t, array_to_string(reasons, ',') AS reasons, score::INT AS score FROM kp WHERE exempt OR n <= room""")
def boundary_shortlist(spark, sf):
    found = boundaries.candidates(signals(timeline(spark, sf)), "job_id")
    return boundaries.shortlist(found, "job_id", RADIUS).select("job_id", "t", F.array_join("reasons", ",").alias("reasons"), "score")


@query(f"WITH {SIGNALS} SELECT job_id, t, {SCORE}::INT AS score FROM cand WHERE list_contains(reasons, 'cut')")
def boundary_anchors(spark, sf):
    return boundaries.anchors(boundaries.candidates(signals(timeline(spark, sf)), "job_id")).select("job_id", "t", "score")


@query(f"""WITH {TIMELINE}, h AS (SELECT *, unnest([t // {HOP} * {HOP}, (t // {HOP} - 1) * {HOP}]) AS w0 FROM tl)
SELECT job_id, w0, w0 + {WIDE} AS w1, count(*) AS n, max(value) AS most, round(sum(value) * 1000)::BIGINT AS milli FROM h WHERE t < w0 + {WIDE} GROUP BY job_id, w0""")
def hopping_window_stats(spark, sf):
    tl = timeline(spark, sf).select("job_id", "value", F.timestamp_millis("t").alias("at"), "t")
    w = F.window("at", f"{WIDE} milliseconds", f"{HOP} milliseconds")
    g = tl.groupBy("job_id", w.alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("most"), F.round(F.sum("value") * 1000).cast("long").alias("milli"))
    return g.select("job_id", F.unix_millis("w.start").alias("w0"), F.unix_millis("w.end").alias("w1"), "n", "most", "milli")


@query(f"""WITH {TIMELINE}, p AS (SELECT *, lag(t) OVER w AS t0, lead(t) OVER w AS t1, lag(kind) OVER w AS k0, lead(kind) OVER w AS k1 FROM tl WINDOW w AS (PARTITION BY job_id ORDER BY t, ord))
SELECT job_id, ord, array_to_string(list_filter([CASE WHEN k0 <> kind THEN 'people' END, CASE WHEN t - t0 >= {GAP} THEN 'late' END, CASE WHEN t1 - t < 60000 THEN 'crowded' END, CASE WHEN kind = 'error' AND k1 <> 'error' THEN 'mismatch' END], lambda x: x IS NOT NULL), ',') AS flags FROM p""")
def window_flags(spark, sf):
    w = Window.partitionBy("job_id").orderBy("t", "ord")
    tl = timeline(spark, sf)
    flags = F.array(
        F.when(F.lag("kind").over(w) != F.col("kind"), "people"),
        F.when(F.col("t") - F.lag("t").over(w) >= GAP, "late"),
        F.when(F.lead("t").over(w) - F.col("t") < 60000, "crowded"),
        F.when((F.col("kind") == "error") & (F.lead("kind").over(w) != "error"), "mismatch"),
    )
    return tl.select("job_id", "ord", F.array_join(F.filter(flags, lambda x: x.isNotNull()), ",").alias("flags"))


TICK = 21_600_000


@query(f"""WITH {TIMELINE}, b AS (SELECT job_id, min(t) // {TICK} AS a, max(t) // {TICK} AS z FROM tl GROUP BY job_id), g AS (SELECT job_id, unnest(range(a, z + 1)) * {TICK} AS t FROM b),
m AS (SELECT job_id, t, arg_max(kind, ord) AS kind FROM tl GROUP BY job_id, t) SELECT g.job_id, g.t, m.kind FROM g ASOF LEFT JOIN m ON g.job_id = m.job_id AND g.t >= m.t""")
def tick_grid_asof(spark, sf):
    tl = timeline(spark, sf)
    grid = tl.groupBy("job_id").agg(F.floor(F.min("t") / TICK).alias("a"), F.floor(F.max("t") / TICK).alias("z")).select("job_id", F.explode(F.sequence("a", "z")).alias("i")).select("job_id", (F.col("i") * TICK).alias("t"))
    marks = tl.groupBy("job_id", "t").agg(F.max_by("kind", "ord").alias("kind"))
    return intervals.as_of(grid, marks, "job_id", "kind")


@query(f"""WITH {TIMELINE}, l AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY job_id ORDER BY t, ord) <= {GAP} THEN 0 ELSE 1 END AS far FROM tl),
s AS (SELECT *, sum(far) OVER (PARTITION BY job_id ORDER BY t, ord) AS n FROM l) SELECT job_id, n::BIGINT AS session, min(t) AS t0, max(t) AS t1, count(*) AS events FROM s GROUP BY job_id, n""")
def idle_sessions(spark, sf):
    cut = sequences.islands(timeline(spark, sf), "job_id", GAP)
    return cut.groupBy("job_id", F.col("island").alias("session")).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("events"))


@query(f"WITH RECURSIVE {TIMELINE}, {anchors_sql('tl', RADIUS - 1)} SELECT DISTINCT job_id, t FROM anc")
def min_gap_thinning(spark, sf):
    return sequences.thinned(timeline(spark, sf), "job_id", RADIUS)


@query(f"WITH {TIMELINE} SELECT job_id, t // 3600000 AS slot, arg_max(kind, (t, ord)) AS kind, max(t) AS t FROM tl GROUP BY job_id, t // 3600000")
def grid_last_wins(spark, sf):
    return sequences.last_per_slot(timeline(spark, sf), "job_id", 3_600_000, "ord").select("job_id", "slot", "kind", "t")


def order_spans(spark, sf):
    """Orders as spans of up to eleven days on their customer's timeline."""
    o = table(spark, sf, "orders")
    t0 = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("long")
    return o.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("id"), t0.alias("t0"), (t0 + (F.col("o_orderkey") % 11 + 1) * 86_400_000).alias("t1"))


SPANS = "sp AS (SELECT o_custkey AS job_id, o_orderkey AS id, epoch_ms(o_orderdate) AS t0, epoch_ms(o_orderdate) + (o_orderkey % 11 + 1) * 86400000 AS t1 FROM orders)"


@query(f"WITH {SPANS} SELECT a.job_id, a.id AS a, b.id AS b, least(a.t1, b.t1) - greatest(a.t0, b.t0) AS shared FROM sp a JOIN sp b ON a.job_id = b.job_id AND a.id < b.id AND a.t0 < b.t1 AND b.t0 < a.t1")
def overlap_pairs(spark, sf):
    s = order_spans(spark, sf)
    p = intervals.overlapping(s, s, "job_id").where("l_id < r_id")
    return p.select(F.col("l_job_id").alias("job_id"), F.col("l_id").alias("a"), F.col("r_id").alias("b"), intervals.overlap(F.col("l_t0"), F.col("l_t1"), F.col("r_t0"), F.col("r_t1")).alias("shared"))


ERRORS = "er AS (SELECT job_id, t AS t0, t + 600000 AS t1 FROM tl WHERE kind = 'error'), cl AS (SELECT job_id, ord, t AS t0, t + 60000 AS t1 FROM tl WHERE kind = 'click')"


def clicks_and_errors(spark, sf):
    tl = timeline(spark, sf)
    return tl.where("kind = 'click'").select("job_id", "ord", F.col("t").alias("t0"), (F.col("t") + 60_000).alias("t1")), tl.where("kind = 'error'").select("job_id", F.col("t").alias("t0"), (F.col("t") + 600_000).alias("t1"))


@query(f"WITH {TIMELINE}, {ERRORS} SELECT * FROM cl WHERE EXISTS (SELECT 1 FROM er WHERE er.job_id = cl.job_id AND er.t0 < cl.t1 AND cl.t0 < er.t1)")
def overlap_semi(spark, sf):
    return intervals.touching(*clicks_and_errors(spark, sf), "job_id")


@query(f"WITH {TIMELINE}, {ERRORS} SELECT * FROM cl WHERE NOT EXISTS (SELECT 1 FROM er WHERE er.job_id = cl.job_id AND er.t0 < cl.t1 AND cl.t0 < er.t1)")
def overlap_anti(spark, sf):
    return intervals.touching(*clicks_and_errors(spark, sf), "job_id", anti=True)


WINDOWS = f"""ev AS (SELECT job_id, ord, t AS t0, t + 120000 + ord % 7 * 900000 AS t1 FROM tl), wi AS (SELECT DISTINCT job_id, t // {HOP} AS w, t // {HOP} * {HOP} AS t0, t // {HOP} * {HOP} + {WIDE} AS t1 FROM tl)"""


def spans_and_windows(spark, sf):
    tl = timeline(spark, sf)
    spans = tl.select("job_id", "ord", F.col("t").alias("t0"), (F.col("t") + 120_000 + F.col("ord") % 7 * 900_000).alias("t1"))
    return spans, tl.select("job_id", F.floor(F.col("t") / HOP).alias("w")).distinct().select("job_id", "w", (F.col("w") * HOP).alias("t0"), (F.col("w") * HOP + WIDE).alias("t1"))


@query(f"""WITH {TIMELINE}, {WINDOWS}, p AS (SELECT ev.job_id, ord, w, least(ev.t1, wi.t1) - greatest(ev.t0, wi.t0) AS shared FROM ev JOIN wi ON ev.job_id = wi.job_id AND ev.t0 < wi.t1 AND wi.t0 < ev.t1),
b AS (SELECT job_id, ord, arg_min(w, (-shared, w)) AS owner, max(shared) AS shared FROM p WHERE shared > 50 GROUP BY job_id, ord) SELECT ev.job_id, ev.ord, owner, coalesce(shared, 0) AS shared FROM ev LEFT JOIN b USING (job_id, ord)""")
def span_owner_argmax(spark, sf):
    spans, windows = spans_and_windows(spark, sf)
    return intervals.owners(spans, windows, "job_id", "ord", "w").select("job_id", "ord", "owner", "shared")


@query(f"""WITH {TIMELINE}, {WINDOWS}, p AS (SELECT ev.job_id, ord, w, least(ev.t1, wi.t1) - greatest(ev.t0, wi.t0) AS shared, greatest(400, ev.t1 - ev.t0) AS span, wi.t0 >= ev.t0 - 200 AND NOT (wi.t1 > ev.t1 + 200 AND wi.t0 > ev.t0 + 400) AS own FROM ev JOIN wi ON ev.job_id = wi.job_id AND ev.t0 < wi.t1 AND wi.t0 < ev.t1),
q AS (SELECT *, CASE WHEN own AND shared >= least(1000, greatest(400, round_even(span * 45 / 100, 0))) THEN 1 WHEN own THEN 2 ELSE 3 END AS tier FROM p WHERE shared > 10),
r AS (SELECT *, min(tier) OVER (PARTITION BY job_id, ord) AS best, row_number() OVER (PARTITION BY job_id, ord ORDER BY shared DESC, w) AS n FROM q)
SELECT job_id, ord, w, tier, shared FROM r WHERE tier = best AND (tier < 3 OR n = 1)""")
def tiered_window_pick(spark, sf):
    spans, windows = spans_and_windows(spark, sf)
    return intervals.tiered(spans, windows, "job_id", "ord", "w")


@query(f"""WITH {TIMELINE}, a AS (SELECT job_id, t FROM tl WHERE kind = 'purchase'), p AS (SELECT job_id, ord, t FROM tl WHERE kind = 'view'),
b AS (SELECT p.job_id, ord, arg_min(a.t, (abs(a.t - p.t), a.t)) AS anchor FROM p JOIN a ON p.job_id = a.job_id AND abs(a.t - p.t) <= {GAP} GROUP BY p.job_id, ord) SELECT p.job_id, p.ord, p.t, anchor FROM p LEFT JOIN b USING (job_id, ord)""")
def nearest_anchor(spark, sf):
    tl = timeline(spark, sf)
    return intervals.nearest(tl.where("kind = 'view'").select("job_id", "ord", "t"), tl.where("kind = 'purchase'").select("job_id", "t"), "job_id", "ord", GAP)


@query("""WITH legal AS (SELECT n FROM range(107, 346) r(n) WHERE n % 17 = 5), q AS (SELECT DISTINCT l_quantity AS q, greatest(1, round_even(l_quantity / 3.0 * 24, 0))::INT AS f FROM lineitem),
s AS (SELECT q, f, arg_min(n, (abs(n - f), n)) AS snapped FROM q, legal GROUP BY q, f)
SELECT l_orderkey, l_linenumber, f::INT AS frames, snapped::INT AS legal, (snapped * 1000 // 24)::BIGINT AS legal_ms FROM lineitem JOIN s ON l_quantity = q""")
def legal_frame_snap(spark, sf):
    n = tg.frames(F.col("l_quantity") / 3.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", n.alias("frames"), tg.snapped(n).alias("legal"), F.floor(tg.snapped(n) * 1000 / 24).cast("long").alias("legal_ms"))


def turns(spark, sf):
    """Turns of conversations with a playing time: 50 ms a character, cut at 6 s."""
    c = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    return c.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("ord"), "role", "text", F.least(F.lit(6000).cast("long"), F.length("text").cast("long") * 50).alias("play"))


TURNS = "tu AS (SELECT conv_id AS job_id, turn AS ord, min(role) AS role, min(text) AS text, least(6000, length(min(text)) * 50) AS play FROM conversations GROUP BY conv_id, turn)"
LAID = f"{TURNS}, la AS (SELECT *, sum(play) OVER (PARTITION BY job_id ORDER BY ord)::BIGINT AS cat1 FROM tu)"


@query(f"WITH {LAID} SELECT job_id, ord, cat1 - play AS cat0, cat1 FROM la")
def retime_spans(spark, sf):
    return sequences.offsets(turns(spark, sf), "job_id", "ord", "play").select("job_id", "ord", "cat0", "cat1")


@query(f"""WITH {LAID}, src AS (SELECT job_id, ord, (ord * 6500)::BIGINT AS src0, (ord * 6500 + play)::BIGINT AS src1, cat1 - play AS cat0 FROM la),
pt AS (SELECT job_id, ord AS n, (ord * 6500 + ord * 397 % 6500)::BIGINT AS t FROM la) SELECT pt.job_id, pt.n, pt.t, arg_min(cat0 + greatest(0, least(src1, pt.t) - src0), src.ord)::BIGINT AS at FROM pt LEFT JOIN src ON pt.job_id = src.job_id AND pt.t BETWEEN src0 - 1 AND src1 + 1 GROUP BY pt.job_id, pt.n, pt.t""")
def retime_points(spark, sf):
    laid = sequences.offsets(turns(spark, sf), "job_id", "ord", "play")
    spans = laid.select("job_id", "ord", (F.col("ord") * 6500).alias("src0"), (F.col("ord") * 6500 + F.col("play")).alias("src1"), "cat0")
    points = laid.select("job_id", F.col("ord").alias("n"), (F.col("ord") * 6500 + F.col("ord") * 397 % 6500).alias("t"))
    return retime.mapped(points, spans, "job_id")


@query(f"WITH {TURNS} SELECT job_id, ord, sum((role = 'system')::INT) OVER (PARTITION BY job_id ORDER BY ord)::BIGINT AS group_id FROM tu")
def cast_groups(spark, sf):
    return sequences.groups_by_reset(turns(spark, sf), "job_id", "ord", F.col("role") == "system").select("job_id", "ord", "group_id")


@query(f"""WITH {TURNS}, g AS (SELECT *, sum((role = 'system')::INT) OVER (PARTITION BY job_id ORDER BY ord) AS g FROM tu)
SELECT job_id, ord, role, first_value(md5(nullif(text, '')) IGNORE NULLS) OVER w AS lock, first_value(nullif(text, '') IGNORE NULLS) OVER w IS DISTINCT FROM text AS differs FROM g WINDOW w AS (PARTITION BY job_id, g, role ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def canonical_lock(spark, sf):
    g = sequences.groups_by_reset(turns(spark, sf), "job_id", "ord", F.col("role") == "system")
    c = sequences.canonical(g, ["job_id", "group_id", "role"], "ord", "text", "lock")
    return c.select("job_id", "ord", "role", F.md5(F.col("lock").cast("binary")).alias("lock"), (~F.col("lock").eqNullSafe(F.col("text"))).alias("differs"))


@query(f"""WITH {TURNS}, rs AS (SELECT *, coalesce(role = 'system', false) AS reset FROM tu) SELECT job_id, ord, role, lag(ord) OVER w AS before, lead(ord) OVER w AS after, CASE WHEN NOT reset AND NOT coalesce(lag(reset) OVER w, false) THEN lag(ord) OVER w END AS thread FROM rs WINDOW w AS (PARTITION BY job_id ORDER BY ord)""")
def prev_turn_thread(spark, sf):
    """Turns as clips of their own, which a system's turn parts."""
    c = turns(spark, sf).select("job_id", F.col("ord").alias("clip"), F.col("ord").alias("n"), (F.col("role") == "system").alias("cast_reset"), "role")
    lines = turns(spark, sf).select("job_id", F.col("ord").alias("clip"), F.array("role").alias("lines"))
    return clips.neighbours(c, lines, "job_id").select("job_id", F.col("clip").alias("ord"), "role", "before", "after", "thread")


LINES = "li AS (SELECT doc_id, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '')"


def doc_lines(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line <> ''")


@query(f"WITH {LINES} SELECT doc_id, md5(line) AS line, count(*) AS n FROM li GROUP BY doc_id, line HAVING count(*) > 1")
def repeated_lines(spark, sf):
    return audit.repeats(doc_lines(spark, sf), "doc_id", "line").select("doc_id", F.md5(F.col("line").cast("binary")).alias("line"), "n")


@query(f"WITH {LINES} SELECT md5(line) AS line, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM li GROUP BY line HAVING count(DISTINCT doc_id) > 1")
def duplicate_lines(spark, sf):
    return audit.shared_lines(doc_lines(spark, sf), "doc_id", "line").select(F.md5(F.col("line").cast("binary")).alias("line"), F.col("owners").alias("docs"), F.col("first").alias("first_doc"))


@query(f"WITH {LINES}, b AS (SELECT item_id, trim(unnest(string_split(text, chr(10)))) AS line FROM benchmark) SELECT DISTINCT item_id, md5(line) AS line FROM b WHERE line <> '' AND line NOT IN (SELECT line FROM li)")
def line_coverage(spark, sf):
    need = table(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("line")).select("item_id", F.trim("line").alias("line")).where("line <> ''")
    return audit.uncovered(need, doc_lines(spark, sf), "line").select("item_id", F.md5(F.col("line").cast("binary")).alias("line")).distinct()


@query("""SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 10 AND length(regexp_replace(text, '[^一-鿿]', '', 'g')) < 3 AS foreign_line,
length(text) >= 8 AND len(list_distinct(string_split(text, ''))) <= 2 AS few_symbols, length(regexp_replace(text, '[^)）]', '', 'g')) >= 4 AS closing, length(regexp_replace(text, '[^一-鿿]', '', 'g'))::INT AS han FROM documents""")
def text_quality_flags(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", tx.foreign(t).alias("foreign_line"), tx.few_symbols(t).alias("few_symbols"), (tx.closing_count(t) >= 4).alias("closing"), tx.han_count(t).alias("han"))


@query()
def repeated_char_flag(spark, sf):
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").select("doc_id", F.col("text").rlike(r"(?s)(.)\1{5,}").alias("repeated"), tx.phrase_loop_of_text("text").alias("looping"), F.exists(lines, tx.usable_line).alias("usable"))


BANNED = ("idiot", "moron", "worthless", "clown", "pathetic")


@query("SELECT doc_id, w AS word FROM documents, (VALUES " + ", ".join(f"('{w}')" for w in BANNED) + ") v(w) WHERE contains(lower(text), w)")
def banned_terms(spark, sf):
    return audit.banned(table(spark, sf, "documents").select("doc_id", "text"), "text", BANNED).select("doc_id", "word")


@query("""SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::INT AS latin, length(regexp_replace(text, '[^一-鿿]', '', 'g'))::INT AS han, length(regexp_replace(text, '[^0-9]', '', 'g'))::INT AS digits,
length(regexp_replace(text, '[^\\x{00C0}-\\x{024F}]', '', 'g'))::INT AS accented FROM documents""")
def script_mix(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", tx.latin_count(t).alias("latin"), tx.han_count(t).alias("han"), (F.length(t) - F.length(F.regexp_replace(t, "[0-9]++", ""))).alias("digits"), (F.length(t) - F.length(F.regexp_replace(t, "[À-ɏ]++", ""))).alias("accented"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
length(html) - length(replace(html, '<p>', 'xx')) AS paragraphs, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links FROM pages""")
def page_meta(spark, sf):
    return metadata.page_meta(table(spark, sf, "pages")).select("page_id", "title", "h1", "lang", F.col("paragraphs").cast("long").alias("paragraphs"), F.col("links").cast("long").alias("links"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, CASE WHEN regexp_matches(url, '^https?://m\\.') THEN 'mobile' WHEN contains(url, '?') THEN 'query' WHEN contains(url, '#') THEN 'anchor' ELSE 'plain' END AS class,
try_cast(nullif(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1), '') AS BIGINT) AS id FROM pages""")
def url_class(spark, sf):
    return metadata.url_class(table(spark, sf, "pages"))


@query("""WITH r AS (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY coalesce(nullif(text, ''), doc_id::VARCHAR) ORDER BY n_chars DESC, doc_id) AS n FROM documents WHERE text <> '')
SELECT doc_id, n_chars FROM r WHERE n = 1 ORDER BY n_chars DESC, doc_id LIMIT 30""")
def comment_rank(spark, sf):
    return metadata.ranked_comments(table(spark, sf, "documents").select(F.col("doc_id").alias("cid"), "text", F.col("n_chars").alias("likes")), key="text").select(F.col("cid").alias("doc_id"), F.col("likes").alias("n_chars"))


@query("""SELECT d.doc_id, l.quality, l.toxic, CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN l.quality = 1 AND l.toxic = 0 THEN 'pass' ELSE 'fail' END AS gate FROM documents d LEFT JOIN labels l USING (doc_id)""")
def review_gate(spark, sf):
    return views.gated(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id", (F.col("quality") == 1) & (F.col("toxic") == 0))


@query("""WITH s AS (SELECT vec_id, label, embedding AS e, list_max(embedding) AS m FROM embeddings), z AS (SELECT vec_id, label, m, list_sum(list_transform(e, lambda x: exp(4.0 * (x::DOUBLE - m::DOUBLE)))) AS total, list_position(e, m) AS place FROM s)
SELECT vec_id, CASE WHEN 1 / total >= 0.1 THEN place::INT END AS best, round(1 / total, 6) AS share FROM z""")
def confidence_null_label(spark, sf):
    return views.confident(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.1, 4.0)


@query("""SELECT o_custkey AS job_id, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, bool_and(o_orderstatus = 'F') AS complete, bool_or(o_orderstatus = 'P') AS partial FROM orders GROUP BY o_custkey""")
def state_rollup(spark, sf):
    return views.rollup(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "F", "O", "P")


@query("""WITH r AS (SELECT o_custkey AS job_id, bool_and(o_orderstatus = 'F') AS complete, bool_or(o_orderstatus = 'P') AS partial, bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F') AS urgent FROM orders GROUP BY o_custkey)
SELECT c_custkey AS job_id, CASE WHEN r.job_id IS NULL THEN 'create' WHEN complete THEN 'done' WHEN urgent THEN 'retry' WHEN partial THEN 'resume' ELSE 'draft' END AS action FROM customer LEFT JOIN r ON r.job_id = c_custkey""")
def next_action(spark, sf):
    """What a customer's orders need next: the first that applies."""
    s = F.col("o_orderstatus")
    r = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("__k")).agg(F.bool_and(s == "F").alias("complete"), F.bool_or(s == "P").alias("partial"), F.bool_or((F.col("o_orderpriority") == "1-URGENT") & (s != "F")).alias("urgent"))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id")).join(r, F.col("job_id") == F.col("__k"), "left")
    action = views.first_match((F.col("__k").isNull(), "create"), (F.col("complete"), "done"), (F.col("urgent"), "retry"), (F.col("partial"), "resume"), otherwise="draft")
    return rows.select("job_id", action.alias("action"))


@query("""WITH v AS (SELECT doc_id, sha1(coalesce(text, '')) AS now, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN sha1(coalesce(text, '') || 'x') ELSE sha1(coalesce(text, '')) END AS kept FROM documents)
SELECT doc_id, now AS prompt_hash, kept IS NULL OR kept <> now AS dirty FROM v""")
def hash_staleness(spark, sf):
    d = table(spark, sf, "documents")
    now = F.sha1(F.coalesce("text", F.lit("")).cast("binary"))
    kept = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 5 == 0, F.sha1(F.concat(F.coalesce("text", F.lit("")), F.lit("x")).cast("binary"))).otherwise(now)
    return views.staleness(d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), kept.alias("kept")), "text", "kept").select("doc_id", "prompt_hash", "dirty")


def order_events(spark, sf):
    s = order_spans(spark, sf)
    events = s.select("job_id", F.col("id").cast("string").alias("id"), F.lit("story").alias("kind"), F.floor((F.col("t0") - F.lit(694224000000)) / 864000).alias("t0"), F.floor((F.col("t1") - F.lit(694224000000)) / 43200).alias("t1"), F.lit(False).alias("cast_reset")).withColumn("t1", F.col("t0") + (F.col("t1") - F.col("t0")) % 60000)
    return events


BEST = "(hard::INT, score, -abs(2 * t - a - b), -t)"
CUT = f"coalesce(arg_max(t, {BEST}) FILTER (hard), CASE WHEN b - a > 14375 THEN arg_max(t, {BEST}) END) AS cut"


@query(f"""WITH RECURSIVE {SPANS}, oe AS (SELECT job_id, id::VARCHAR AS event_id, (t0 - 694224000000) // 864000 AS a, (t1 - 694224000000) // 43200 AS z FROM sp), ev AS (SELECT job_id, event_id, a, a + (z - a) % 60000 AS b FROM oe),
po AS (SELECT DISTINCT job_id, a + 3000 AS t, a % 2 = 0 AS hard, CASE WHEN a % 2 = 0 THEN 2 ELSE 1 END AS score FROM ev),
s AS (SELECT e.job_id, event_id, a, b, {CUT} FROM ev e LEFT JOIN po ON po.job_id = e.job_id AND t BETWEEN a + 2000 AND b - 2000 WHERE b > a GROUP BY e.job_id, event_id, a, b
UNION ALL SELECT c.job_id, event_id, a, b, {CUT} FROM (SELECT job_id, event_id, unnest([a, cut]) AS a, unnest([cut, b]) AS b FROM s WHERE cut IS NOT NULL) c LEFT JOIN po ON po.job_id = c.job_id AND t BETWEEN a + 2000 AND b - 2000 GROUP BY c.job_id, event_id, a, b),
lf AS (SELECT *, CASE WHEN b - a > 14375 THEN floor((b - a) / 14375)::BIGINT + 1 ELSE 1 END AS n FROM s WHERE cut IS NULL), pa AS (SELECT job_id, event_id, a + round_even((b - a) * i / n, 0)::BIGINT AS t0, a + round_even((b - a) * (i + 1) / n, 0)::BIGINT AS t1 FROM (SELECT *, unnest(range(0, n)) AS i FROM lf)),
f AS (SELECT DISTINCT greatest(1, round_even((t1 - t0) / 1000 * 24, 0))::INT AS f FROM pa), g AS (SELECT f, arg_min(n, (abs(n - f), n))::INT AS frames FROM f, range(107, 346) r(n) WHERE n % 17 = 5 GROUP BY f)
SELECT job_id, event_id, (row_number() OVER (PARTITION BY job_id, event_id ORDER BY t0) - 1)::INT AS part, t0, t1, frames, frames / 24.0::DOUBLE AS seconds, (t1 - t0) / 1000 < 107 / 24 AS padded FROM pa JOIN g ON g.f = greatest(1, round_even((t1 - t0) / 1000 * 24, 0))::INT""")
def span_split_recursive(spark, sf):
    events = order_events(spark, sf)
    points = events.select("job_id", (F.col("t0") + 3000).alias("t"), F.array(F.when(F.col("t0") % 2 == 0, "cut").otherwise("gap")).alias("reasons")).distinct()
    return packing.pack(events, points).select("job_id", "event_id", "part", "t0", "t1", "frames", "seconds", "padded")


@query(f"""WITH {SPANS}, e AS (SELECT job_id, id, t0, t1, max(t1) OVER (PARTITION BY job_id) AS z, lag(t0) OVER w IS NULL AS f, lead(t0) OVER w AS nx FROM sp WINDOW w AS (PARTITION BY job_id ORDER BY t0, t1)),
g AS (SELECT job_id, id, CASE WHEN f THEN 0 ELSE t0 END AS t0, coalesce(nx, z) AS t1 FROM e) SELECT job_id, id, t0, t1, row_number() OVER (PARTITION BY job_id ORDER BY t0, t1) AS n FROM g WHERE t1 > t0""")
def coverage_repair(spark, sf):
    s = order_spans(spark, sf)
    ends = s.withColumn("z", F.max("t1").over(Window.partitionBy("job_id")))
    return sequences.gapless(ends, "job_id", "z", "id").select("job_id", "id", "t0", "t1", F.row_number().over(Window.partitionBy("job_id").orderBy("t0", "t1")).cast("long").alias("n"))


@query()
def ocr_sessions_fuzzy(spark, sf):
    hits = turns(spark, sf).select("job_id", F.lit("bottom").alias("region"), (F.col("ord") * 500).alias("t"), "text")
    return sequences.fuzzy_sessions(hits, ["job_id", "region"], 500)


@query()
def fuzzy_match_greedy(spark, sf):
    """Answers of a conversation as speech, its other turns as what is seen; a turn begins every 500 ms and plays its time."""
    spans = turns(spark, sf).select("job_id", F.col("ord").alias("id"), (F.col("ord") * 500).alias("t0"), (F.col("ord") * 500 + F.col("play")).alias("t1"), "role", "text")
    spoken = F.coalesce(F.col("role") == "assistant", F.lit(False))
    return sequences.greedy_match(spans.where(spoken), spans.where(~spoken), "job_id", tx.similarity, bound=lambda a, b: tx.bound(F.col(a), F.col(b)))


@query(f"""WITH {TIMELINE}, n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord) AS n FROM tl), h AS (SELECT job_id, ord, n FROM n WHERE value >= 50),
f AS (SELECT *, CASE WHEN n - lag(n) OVER (PARTITION BY job_id ORDER BY ord) <= 2 THEN 0 ELSE 1 END AS far FROM h), r AS (SELECT *, sum(far) OVER (PARTITION BY job_id ORDER BY ord) AS run FROM f)
SELECT job_id, min(ord) AS first, max(ord) AS last, max(n) - min(n) + 1 AS n FROM r GROUP BY job_id, run HAVING max(n) - min(n) + 1 >= 3""")
def gaps_and_islands(spark, sf):
    return sequences.boolean_islands(timeline(spark, sf).withColumn("loud", F.col("value") >= 50), "job_id", "loud", "ord", hole=1, least=3)


@query(f"WITH {TIMELINE} SELECT job_id, max(value) AS peak, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.7), 6) AS p70 FROM tl GROUP BY job_id")
def energy_percentiles(spark, sf):
    return timeline(spark, sf).groupBy("job_id").agg(*signal.energy_summary(F.col("value")))


EDGES = "ed AS (SELECT DISTINCT s_nationkey AS a, (s_suppkey * 7 % 25)::INT AS b FROM supplier)"


@query(f"""WITH RECURSIVE {EDGES}, cl AS (SELECT a, b, 1 AS d FROM ed UNION SELECT cl.a, ed.b, cl.d + 1 FROM cl JOIN ed ON cl.b = ed.a WHERE cl.d < (SELECT count(*) FROM (SELECT a FROM ed UNION SELECT b FROM ed))) SELECT a AS src, b AS dst, min(d)::INT AS depth FROM cl GROUP BY a, b""")
def graph_closure(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("src"), (F.col("s_suppkey") * 7 % 25).cast("int").alias("dst")).distinct()
    return graph.closure(s)


@query(f"WITH {EDGES} SELECT a AS src, array_to_string(list_sort(list(b)), ',') AS targets, count(*) AS n FROM ed GROUP BY a")
def graph_sockets(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("src"), (F.col("s_suppkey") * 7 % 25).cast("int").alias("dst")).distinct()
    return graph.sockets(s)


@query("""SELECT user_id AS job_id, (epoch_us(ts) // 1000) // 1000 AS second, lpad(floor((epoch_us(ts) // 1000) % 100000 / 10)::INT::VARCHAR, 5, '0') AS frame, ((epoch_us(ts) // 1000) // 10 % 6000000) // 360000 || ':' || lpad((((epoch_us(ts) // 1000) // 10 % 6000000) // 6000 % 60)::VARCHAR, 2, '0') || ':' || lpad((((epoch_us(ts) // 1000) // 10 % 6000000) // 100 % 60)::VARCHAR, 2, '0') || '.' || lpad(((epoch_us(ts) // 1000) // 10 % 100)::VARCHAR, 2, '0') AS at, event_id AS ord FROM events""")
def time_stamps(spark, sf):
    t = F.col("t")
    cs = F.floor(t / 10) * 10
    return timeline(spark, sf).select("job_id", F.floor(t / 1000).alias("second"), tg.frame_name(cs % 100000).alias("frame"), tx.subtitle_time(cs % 60_000_000).alias("at"), "ord")


@query("""SELECT doc_id, rule FROM (SELECT doc_id, 'digits' AS rule FROM documents WHERE regexp_matches(text, '[0-9]{4}') UNION ALL SELECT doc_id, 'shout' FROM documents WHERE contains(text, '!!') UNION ALL SELECT doc_id, 'table' FROM documents WHERE contains(text, ' | ')
UNION ALL SELECT doc_id, 'short' FROM documents WHERE n_chars < 40 UNION ALL SELECT doc_id, 'license' FROM documents WHERE contains(lower(text), 'license'))""")
def rule_audit(spark, sf):
    t = F.col("text")
    rules = {"digits": t.rlike("[0-9]{4}"), "shout": F.contains(t, F.lit("!!")), "table": F.contains(t, F.lit(" | ")), "short": F.col("n_chars") < 40, "license": F.contains(F.lower(t), F.lit("license"))}
    return audit.violations(table(spark, sf, "documents"), "doc_id", rules)


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, 5)) AS i, ((doc_id * 131) % 7 * 1000)::BIGINT AS base FROM documents), p AS (SELECT doc_id, i, base + i * 1000 * (1 + doc_id % 3) AS t0 FROM s),
n AS (SELECT *, coalesce(lead(t0) OVER (PARTITION BY doc_id ORDER BY i), 15000) AS nx FROM p) SELECT doc_id, i::INT AS ord, t0, nx - t0 AS length, nx - t0 < 600 OR t0 > 15000 AS bad FROM n""")
def shot_timing(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ord"))
    p = d.select("doc_id", "ord", ((F.col("doc_id") * 131) % 7 * 1000 + F.col("ord") * 1000 * (1 + F.col("doc_id") % 3)).alias("t0"))
    return audit.shot_lengths(p, "doc_id", "ord", 15_000, 600)


@query(f"""WITH {TURNS} SELECT job_id, count(*) AS total, count(*) FILTER (WHERE coalesce(text, '') = '' OR role = 'system') AS failed,
round(1 - count(*) FILTER (WHERE coalesce(text, '') = '' OR role = 'system') / count(*), 4) AS rate FROM tu GROUP BY job_id""")
def window_summary(spark, sf):
    windows = turns(spark, sf).select("job_id", F.col("text").alias("raw"), F.when(F.col("role") == "system", "no answer").alias("error"))
    return beats.summary(windows, "job_id")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem), p AS (SELECT l_orderkey, l_linenumber + 1 AS i, CASE WHEN l_quantity > 25 THEN l_quantity END AS new_at, CASE WHEN l_discount > 0.05 THEN 'new' END AS text FROM lineitem)
SELECT p.l_orderkey AS job_id, i AS "index", coalesce(new_at, l_quantity) AS "at", coalesce(text, l_returnflag) AS text FROM p LEFT JOIN b ON b.l_orderkey = p.l_orderkey AND b.l_linenumber = i""")
def patch_merge(spark, sf):
    rows = table(spark, sf, "lineitem")
    base = rows.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("index"), F.col("l_quantity").alias("at"), F.col("l_returnflag").alias("text"))
    patch = rows.select(F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") + 1).alias("index"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("at"), F.when(F.col("l_discount") > 0.05, "new").alias("text"))
    return prompts.merged_shots(base, patch, ["job_id"])


@query(f"""WITH {TURNS}, f AS (SELECT job_id, role, arg_min(text, ord) AS wanted FROM tu WHERE text <> '' GROUP BY job_id, role)
SELECT job_id, ord, role, md5(wanted) AS wanted FROM tu JOIN f USING (job_id, role) WHERE text <> '' AND regexp_replace(text, '\\s+', '', 'g') <> regexp_replace(wanted, '\\s+', '', 'g')""")
def lock_consistency(spark, sf):
    said = turns(spark, sf).select("job_id", F.lit(0).alias("group_id"), F.col("ord").alias("n"), F.col("role").alias("id"), F.col("text").alias("lock"))
    return prompts.differing_locks(said, "job_id", "group_id").select("job_id", F.col("n").alias("ord"), F.col("id").alias("role"), F.md5("wanted").alias("wanted"))


@query(f"""WITH {TIMELINE}, r AS (SELECT job_id, ord, kind, row_number() OVER (PARTITION BY job_id ORDER BY ord DESC) AS n FROM tl) SELECT job_id, ord, kind FROM r WHERE n <= 50""")
def log_tail(spark, sf):
    return views.last_entries(timeline(spark, sf).select("job_id", "ord", "kind"), "job_id", "ord").select("job_id", "ord", "kind")
