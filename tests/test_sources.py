"""Folders of jobs as a source and as a sink."""

import os
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.functions import signal
from timeloom.sources import documents, folders

STATUS = "state string, n int"


@pytest.fixture
def root(spark, tmp_path):
    folders.register(spark)
    for name, text in (("a", '{"state": "done", "n": 1}'), ("b", '{"state": "paused"}'), ("c", "{broken"), ("d", ""), ("e", None)):
        (tmp_path / name).mkdir()
        if text is not None:
            (tmp_path / name / "status.json").write_text(text)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "status.json").write_bytes(b"\xff\xfe{")
    (tmp_path / "a file").write_text("{}")
    return tmp_path


def load(spark, root):
    return spark.read.format("job_documents").option("document", "status.json").load(str(root))


def test_documents_and_what_cannot_be_read(spark, root):
    got = load(spark, root)
    assert sorted((r["job_id"], r["state"], r["n"]) for r in folders.typed(got, STATUS).collect()) == [("a", "done", 1), ("b", "paused", None)]
    broken = {r["job_id"]: r["error"] for r in folders.unreadable(got, STATUS).collect()}
    assert broken.keys() == {"c", "d", "f"} and broken["d"] == "empty" and broken["f"].startswith("UnicodeDecodeError")


def test_a_lookup_opens_one_folder(spark, root):
    reader = folders._Reader(str(root), "status.json")
    rest = list(reader.pushFilters([folders.EqualTo(("job_id",), "b"), folders.EqualTo(("text",), "x")]))
    assert len(rest) == 1 and [p.names for p in reader.partitions()] == [["b"]]
    # other folders can't even be listed
    os.chmod(root, 0o311)
    try:
        assert [r["job_id"] for r in load(spark, root).where("job_id = 'b'").collect()] == ["b"]
        assert sorted(r["job_id"] for r in load(spark, root).where("job_id in ('a', 'b', 'nowhere', '../a')").collect()) == ["a", "b"]
    finally:
        os.chmod(root, 0o755)
    assert load(spark, root).where("job_id = 'b' and job_id = 'a'").count() == 0
    assert documents.job(spark, str(root), "b").first()["state"] == "paused"
    for unknown in ("nowhere", "*", "", "../a", "[ab]"):
        with pytest.raises(KeyError):
            documents.job(spark, str(root), unknown)


def test_a_stream_gives_documents_as_they_change(spark, root, tmp_path_factory):
    place = tmp_path_factory.mktemp("stream")

    def run():
        time.sleep(0.3)
        stream = spark.readStream.format("job_documents").option("document", "status.json").load(str(root))
        q = stream.select("job_id", "text").writeStream.format("parquet").option("path", str(place / "out")).option("checkpointLocation", str(place / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted((r["job_id"], r["text"]) for r in spark.read.parquet(str(place / "out")).collect() if r["text"])

    first = run()
    assert first == [("a", '{"state": "done", "n": 1}'), ("b", '{"state": "paused"}'), ("c", "{broken")]
    assert run() == first
    # a changed document, and a late one with an older date
    (root / "b" / "status.json").write_text('{"state": "done"}')
    (root / "e" / "status.json").write_text('{"state": "late"}')
    os.utime(root / "e" / "status.json", (1, 1))
    assert [x for x in run() if x not in first] == [("b", '{"state": "done"}'), ("e", '{"state": "late"}')]


def test_documents_are_published_whole_or_not_at_all(spark, root):
    write = lambda df: df.write.format("job_documents").option("document", "status.json").mode("append").save(str(root))
    before = (root / "a" / "status.json").stat().st_mtime_ns
    write(spark.createDataFrame([("a", '{"state": "done", "n": 1}'), ("b", '{"state": "new"}'), ("z", "{}")], "job_id string, text string").repartition(3))
    assert (root / "a" / "status.json").stat().st_mtime_ns == before  # says the same already
    assert (root / "b" / "status.json").read_text() == '{"state": "new"}' and (root / "z" / "status.json").read_text() == "{}"
    failing = spark.range(40).select(F.concat(F.lit("j"), F.col("id").cast("string")).alias("job_id"), F.when(F.col("id") == 33, F.raise_error(F.lit("no"))).otherwise("{}").alias("text")).repartition(4)
    for bad in (failing, spark.createDataFrame([("b", "1"), ("b", "2")], "job_id string, text string").repartition(2), spark.createDataFrame([("b", "1"), ("../x", "2")], "job_id string, text string")):
        with pytest.raises(Exception):  # noqa: B017
            write(bad)
        assert sorted(p.name for p in root.iterdir()) == ["a", "a file", "b", "c", "d", "e", "f", "z"]
        assert (root / "b" / "status.json").read_text() == '{"state": "new"}'


@pytest.mark.parametrize(("own", "width", "channels"), [(16_000, 2, 1), (44_100, 3, 2), (8_000, 1, 1)])
def test_chunks_of_a_long_sound_give_the_islands_of_the_whole(spark, tmp_path, own, width, channels):
    rng = np.random.default_rng(own)
    t = np.arange(own * 21) / own
    speaking = (np.sin(t * 1.7) > 0.9) | (np.abs(t - 10) < 0.4)  # on over a border of chunks
    x = 0.4 * np.sin(2 * np.pi * 440 * t) * speaking + 0.001 * rng.standard_normal(len(t))
    scaled = np.round(x * (2 ** (8 * width - 1) - 1)).astype(np.int64) + (128 if width == 1 else 0)
    raw = b"".join(int(v).to_bytes(width, "little", signed=width > 1) * channels for v in scaled)
    with wave.open(str(tmp_path / "a long one.wav"), "wb") as f:
        f.setnchannels(channels), f.setsampwidth(width), f.setframerate(own), f.writeframes(raw)
    (tmp_path / "none.wav").write_bytes(b"no sound")
    whole = documents.sounds(spark, str(tmp_path)).select("path", F.posexplode(signal.band_energy()("samples")).alias("i", "energy")).cache()
    want = {r["i"]: r["energy"] for r in whole.collect()}
    islands = lambda frames: sorted((r["t0"], r["t1"]) for r in signal.speech_islands(frames, "path").collect())
    for seconds in (2, 5, 60):
        frames = documents.sound_frames(spark, str(tmp_path), seconds)
        got = {r["i"]: r["energy"] for r in frames.collect()}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-4
        assert islands(frames) == islands(whole) and len(islands(frames)) > 2
