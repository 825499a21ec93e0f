"""Prefix scans: one long timeline gives the rows that it gives uncut, and no task has more than its share."""

import random

import pytest
from pyspark.sql import functions as F

from timeloom.operators import intervals, scans, sequences


@pytest.fixture
def cut(monkeypatch):
    """Timelines of more than 40 rows are cut."""

    def on():
        monkeypatch.setattr(scans, "MOST", 40)
        monkeypatch.setattr(scans, "TINY", 0)

    return on


def points(spark, keys=("hot", "hot", "hot", "cold", None), n=900, seed=1, most=4000):
    rng = random.Random(seed)
    rows = [(rng.choice(keys), rng.choice([rng.randint(0, most), rng.randint(0, 60)]), i, rng.randint(1, 9), rng.random() < 0.3) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, i int, v int, f boolean").repartition(3)


def same(make, cut):
    """Whether the operator gives equal rows uncut and cut."""
    sort = lambda df: sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    whole = sort(make())
    cut()
    assert sort(make()) == whole and whole


def test_islands(spark, cut):
    same(lambda: sequences.islands(points(spark), "k", 9), cut)


def test_running_totals_and_groups(spark, cut):
    rows = points(spark)
    same(lambda: sequences.groups_by_reset(rows, "k", "t", F.col("f")), cut)


def test_offsets_and_boolean_runs(spark, cut):
    rows = points(spark)
    same(lambda: sequences.offsets(rows, "k", "i", "v").unionByName(sequences.boolean_islands(rows, "k", "f", "i", 1, 2), allowMissingColumns=True), cut)


def test_as_of(spark, cut):
    marks = points(spark, n=300, seed=2).dropDuplicates(["k", "t"]).select("k", "t", F.when(F.col("i") % 7 > 0, F.col("i")).alias("m"))
    same(lambda: intervals.as_of(points(spark), marks, "k", "m"), cut)


def test_gapless(spark, cut):
    spans = points(spark).dropDuplicates(["k", "t"]).select("k", F.col("t").alias("t0"), (F.col("t") + F.col("v")).alias("t1"), F.lit(5000).cast("long").alias("z"))
    same(lambda: sequences.gapless(spans, "k", "z"), cut)


def test_touching_and_holding_point(spark, cut):
    spans = points(spark, n=500, seed=3).select("k", F.col("t").alias("t0"), (F.col("t") + F.col("v") * 10).alias("t1"), "i")
    right = points(spark, n=60, seed=4).select("k", F.col("t").alias("t0"), (F.col("t") + F.col("v") * 30).alias("t1"))
    marks = points(spark, n=80, seed=5).select("k", "t")
    same(lambda: intervals.touching(spans, right, "k").unionByName(intervals.touching(spans, right, "k", anti=True).withColumn("i", -F.col("i"))).unionByName(intervals.holding_point(spans, marks, "k", 3).withColumn("i", F.lit(0))), cut)


def test_one_key_for_all_rows_is_dealt_out(spark):
    rows = points(spark, keys=("hot",), n=3000, most=100_000)
    s = scans.spread(rows, "k", "i", most=100)
    sizes = [r["count"] for r in s.rows.groupBy("__chunk").count().collect()]
    assert s.cut and sum(sizes) == 3000 and len(sizes) > 50 and max(sizes) <= 100
    ordered = s.rows.groupBy("__chunk").agg(F.min("i").alias("a"), F.max("i").alias("z")).orderBy("__chunk").collect()
    assert all(x["z"] < y["a"] for x, y in zip(ordered, ordered[1:], strict=False))


def test_short_timelines_and_other_orders_stay_whole(spark):
    rows = points(spark)
    assert not scans.spread(rows, "k", "t").cut and not scans.spread(rows, "k", "t", most=5000).cut
    assert not scans.spread(rows.withColumn("t", F.col("t").cast("string")), "k", "t", most=10).cut
    assert sequences.islands(rows.where("false"), "k", 5).count() == 0


def test_overlapping_spans_of_all_lengths(spark):
    rng = random.Random(11)

    def spans(n, name):
        out = []
        for i in range(n):
            t0 = rng.randint(-50, 3000) * rng.choice([1, 1, 1000])
            out.append((rng.choice(["a", "a", "b", None]), t0, t0 + rng.choice([0, -5, 1, 3, 40, 900, 64, 10_000, 5_000_000]), i))
        return out + [("a", None, 5, 1000), ("a", 5, None, 1001)]

    left, right = spans(160, "l"), spans(140, "r")
    kinds = "k string, t0 long, t1 long, i int"
    got = sorted((r["l_i"], r["r_i"]) for r in intervals.overlapping(spark.createDataFrame(left, kinds), spark.createDataFrame(right, kinds), "k").collect())
    whole = lambda x: None not in x
    want = sorted((a[3], b[3]) for a in left if whole(a) for b in right if whole(b) and a[0] == b[0] and a[1] < b[2] and b[1] < a[2])
    assert got == want and len(want) > 500


def test_overlapping_rows_grow_with_the_logarithm(spark):
    long = spark.range(200).select(F.lit("k").alias("k"), (F.col("id") * 7).alias("t0"), (F.col("id") * 7 + F.pow(F.lit(2), F.col("id") % 40)).cast("long").alias("t1"))
    levelled = long.withColumn("__level", intervals._shift(long))
    stood = intervals._standing(levelled, "l", levelled, 1, 0, lambda x: x >= F.col("__level")).groupBy("l_t0").count()
    # two or three nodes at its own level, and two at most at each of the 21 that there are
    assert levelled.select("__level").distinct().count() <= 21 and stood.agg(F.max("count")).first()[0] <= 3 + 2 * 21


def test_rows_are_dealt_out_by_their_number(spark):
    rows = spark.range(1000).select((F.col("id") % 97).alias("k"), "id")
    got = scans.dealt(rows, "k", share=100)
    assert got.rdd.getNumPartitions() == 10 and got.count() == 1000
    assert got.groupBy("k").agg(F.count("*")).rdd.getNumPartitions() == 10  # groups by the key take them as they lie


def shape(spark, monkeypatch, name):
    """Partitions, windows and exchanges of a query on the smallest tables, where a task has a share of 500 rows."""
    from timeloom.plans import catalog, details, stories  # noqa: F401

    monkeypatch.setattr(scans, "SHARE", 500)
    found = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    parts = found.rdd.getNumPartitions()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return parts, plan.count("Window ["), plan.count("Exchange hashpartitioning")


def test_untiled_beats_sort_a_timeline_once(spark, monkeypatch):
    parts, windows, exchanges = shape(spark, monkeypatch, "untiled_beats")
    assert parts > 8 and windows == 1 and exchanges == 1


def test_valid_caches_meet_their_clips_as_they_were_dealt(spark, monkeypatch):
    parts, _, exchanges = shape(spark, monkeypatch, "valid_caches")
    assert parts > 8 and exchanges <= 2


def test_reused_rows_meet_as_they_were_dealt(spark, monkeypatch):
    parts, _, exchanges = shape(spark, monkeypatch, "reused_rows")
    assert parts > 8 and exchanges <= 2


def test_story_signals_are_dealt_out_by_their_number(spark, monkeypatch):
    parts, _, _ = shape(spark, monkeypatch, "story_signals")
    assert parts > 12


def test_story_signals_take_more_tasks_as_events_grow(spark, monkeypatch):
    from timeloom.plans import catalog, stories  # noqa: F401

    monkeypatch.setattr(scans, "SHARE", 50)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    # four signals of five at least keep the timeline as it was dealt, whatever number of partitions the session shuffles to
    assert catalog.QUERIES["story_signals"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * events // 50
