"""Streams against batches of the same rows."""

from pyspark.sql import functions as F

from timeloom.sources import documents
from timeloom.streaming import windows

SF = "/root/testdata/sf0.001"


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def streamed(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.write.mode("overwrite").parquet(str(tmp_path / "in"))
    return batch, windows.timed(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))


def test_hopping_windows(spark, tmp_path):
    batch, stream = streamed(spark, tmp_path)
    got = run(windows.hopping(stream, "user_id", "3 hours", "150 minutes"), "hops")
    want = windows.timed(batch).groupBy(F.window("t", "3 hours", "150 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("w0"), "n")
    assert got.select("user_id", "w0", "n").exceptAll(want).count() == 0 and want.count() - got.count() < 20


def test_sessions_and_duplicates(spark, tmp_path):
    batch, stream = streamed(spark, tmp_path)
    got = run(windows.sessions(stream, "user_id", "30 minutes"), "sess").count()
    want = windows.timed(batch).groupBy(F.session_window("t", "30 minutes"), "user_id").count().count()
    assert 0 <= want - got < 20
    assert run(windows.distinct(stream, ["user_id", "event_type"], "90 days"), "dups").count() == batch.select("user_id", "event_type").distinct().count()


def test_fuzzy_sessions_close_by_the_watermark(spark, tmp_path):
    rows = [("j", 60_000, "hello world"), ("j", 60_500, "hello worl"), ("j", 61_000, "other text"), ("k", 3_600_000, "late")]
    df = spark.createDataFrame(rows, "job_id string, ms long, text string").select("job_id", F.timestamp_millis("ms").alias("t"), "text")
    for i, part in enumerate(("ms", "x")):
        (df if i == 0 else df.where("false")).write.mode("append").parquet(str(tmp_path / "hits"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "hits"))
    got = run(windows.fuzzy_sessions(stream, "job_id", 1100, late="1 second"), "fuzzy")
    assert ("j", 60_000, 60_500, "hello world", 2) in [tuple(r) for r in got.collect()]


FEED = "v int, k string, t timestamp, w string"


def fed(spark, folder, parts, **options):
    """What comes out of a change feed for each part of rows (k, ms, v, w); the query starts anew for every part."""
    seen, out = [], []
    (folder / "feed").mkdir(exist_ok=True)
    for rows in parts:
        spark.createDataFrame(rows, "k string, t long, v int, w string").select("v", "k", F.timestamp_millis("t").alias("t"), "w").coalesce(1).write.mode("append").parquet(str(folder / "feed"))
        stream = spark.readStream.schema(FEED).parquet(str(folder / "feed"))
        q = windows.change_feed(stream, ["k"], late="1 second", **options).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp"))
        q.outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        now = sorted((tuple(r) for r in spark.read.parquet(str(folder / "out")).select("k", F.unix_millis("t"), "v", "w", "gone").collect()), key=repr)
        out.append([r for r in now if r not in seen])
        assert len(now) == len(seen) + len(out[-1])  # a restart repeats nothing
        seen = now
    return out


def test_a_feed_hands_over_differences_only(spark, tmp_path):
    parts = [
        [("a", 1, 1, None), ("a", 2, 2, None), ("b", 1, 5, "x"), ("n", 1, None, None)],
        [("a", 3, 2, None), ("b", 4, 5, None), ("c", 4, 7, "y"), ("n", 2, None, None)],
        [("a", 2, 9, "late"), ("b", 5, 5, None), ("n", 3, None, "null")],
        [(None, 1, 1, "no key"), ("a", 4, 2, None)],
        [(None, 2, 1, "no key"), ("a", 5, 3, None)],
    ]
    assert fed(spark, tmp_path, parts) == [
        [("a", 2, 2, None, False), ("b", 1, 5, "x", False), ("n", 1, None, None, False)],
        [("b", 4, 5, None, False), ("c", 4, 7, "y", False)],
        [("n", 3, None, "null", False)],
        [(None, 1, 1, "no key", False)],
        [("a", 5, 3, None, False)],
    ]


def test_silent_keys_are_gone_and_may_come_back(spark, tmp_path):
    parts = [[("a", 1_000, 1, "x"), ("b", 1_000, 1, "x")], [("b", 20_000, 1, "x")], [("b", 21_000, 1, "x")], [("a", 22_000, 1, "x")]]
    got = fed(spark, tmp_path, parts, silent_ms=5_000)
    assert got[0] == [("a", 1_000, 1, "x", False), ("b", 1_000, 1, "x", False)]
    flat = [r for part in got[1:] for r in part]
    assert [r for r in flat if r[0] == "a"] == [("a", None, None, None, True), ("a", 22_000, 1, "x", False)]


def test_a_late_hit_does_not_shorten_a_session(spark, tmp_path):
    rows = [[("j", 60_000, "hello world"), ("j", 61_000, "hello world")], [("j", 60_500, "hello worle")], [("k", 3_600_000, "later")], [("k", 3_700_000, "last")]]
    (tmp_path / "hits").mkdir()
    for part in rows:
        spark.createDataFrame(part, "job_id string, ms long, text string").select("job_id", F.timestamp_millis("ms").alias("t"), "text").coalesce(1).write.mode("append").parquet(str(tmp_path / "hits"))
    stream = spark.readStream.schema("job_id string, t timestamp, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "hits"))
    got = run(windows.fuzzy_sessions(stream, "job_id", 1100, late="10 seconds"), "late_hits")
    assert ("j", 60_000, 61_000, "hello world", 3) in [tuple(r) for r in got.collect()]


def test_documents(spark, tmp_path):
    for name, body in (("20240101-000000-aaaa", '{"state": "done", "stage": "finish"}'), ("20240102-000000-bbbb", '{"state": "paused"}'), ("20240103-000000-cccc", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "status.json").write_text(body)
    assert [r["job_id"][:8] for r in documents.jobs(spark, str(tmp_path)).collect()] == ["20240102", "20240101"]
    assert documents.job(spark, str(tmp_path), "20240101-000000-aaaa").first()["state"] == "done"
    assert documents.read_documents(spark, str(tmp_path / "none"), "x.json", documents.CUTS).count() == 0
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    new = spark.createDataFrame([("b", "z"), ("c", "w"), ("a", "x")], "k string, v string")
    assert documents.changed(old, new, ["k"], "v").count() == 2 and documents.upserted(old, new.where("k <> 'a'"), ["k"]).count() == 3
