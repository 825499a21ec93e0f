"""Job folders of JSON documents as tables, and tables as documents."""

from __future__ import annotations

import io
import re
import wave
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.functions.signal import frame_energies

# Schemas of the documents (one table each; job_id comes from the folder).
STATUS = "state string, stage string, note string, created_at timestamp, updated_at timestamp, stages map<string,struct<status:string,error:string,started_at:timestamp,finished_at:timestamp>>"
SPEECH = "speech array<struct<t0:double,t1:double,text:string,source:string>>"
CLIPS = "clips array<struct<id:string,event_id:string,kind:string,t0:double,t1:double,source_seconds:double,h3_frames:int,h3_seconds:double,drift:double,padded:boolean,cast_reset:boolean>>"
CUTS = "cuts array<double>"
PROGRESS = "clips map<string,map<string,struct<status:string,file:string,prompt_id:string,prompt_hash:string,attempts:int,error:string,play:double>>>"
WORKFLOW = "nodes array<struct<id:int,type:string,mode:int>>, links array<array<string>>"
#: The stages of a job, in order.
STAGES = ("download", "pagemeta", "understand", "script", "precheck", "generate", "finish")


def read_documents(spark: SparkSession, root: str, name: str, schema: str, job_id: str | None = None) -> DataFrame:
    """One row per job folder under ``root`` that has the document ``name``; unreadable documents are left out, and a root
    without any gives an empty table. ``job_id`` is the folder's name; if one is given, no other folder is opened."""
    folder = "*" if job_id is None else re.sub(r"([\[\]{}*?\\])", r"\\\1", job_id)
    bad = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("__corrupt", T.StringType())])
    out = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("job_id", T.StringType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}/{name}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        return spark.createDataFrame([], out)
    read = spark.read.schema(bad).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__corrupt").json(f"{root}/{folder}/{name}")
    return read.withColumn("job_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).where("__corrupt is null").drop("__corrupt")


def jobs(spark: SparkSession, root: str) -> DataFrame:
    """All jobs, the newest first: ids sort by time."""
    return read_documents(spark, root, "status.json", STATUS).orderBy(F.desc("job_id"))


def job(spark: SparkSession, root: str, job_id: str) -> DataFrame:
    """One job; an unknown id is an error."""
    found = read_documents(spark, root, "status.json", STATUS, job_id)
    if not job_id or "/" in job_id or found.first() is None:
        raise KeyError(job_id)
    return found


def rows(documents: DataFrame, array: str) -> DataFrame:
    """The rows of a document's array with their place in it as ``ord``; rows that are no records are left out."""
    return documents.select("job_id", F.posexplode(array).alias("ord", "r")).where("r is not null").select("job_id", "ord", "r.*")


def milliseconds(seconds: str) -> Column:
    """Seconds as whole milliseconds; a missing time is 0."""
    return F.coalesce(F.bround(F.col(seconds) * 1000), F.lit(0)).cast("long")


def stills(spark: SparkSession, root: str, least: int = 1000) -> DataFrame:
    """Frames named fNNNNN.jpg (hundredths of a second) with their time in ms; files under ``least`` bytes are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "f[0-9]*.jpg").option("recursiveFileLookup", True).load(root).select("path", "length")
    number = F.regexp_extract("path", r"f(\d{5})\.jpg$", 1)
    return files.where((F.col("length") >= least) & (number != "")).select("path", (number.cast("long") * 10).alias("t"))


def listed_frames(frames: DataFrame, key: str, fps: float) -> DataFrame:
    """Frames (key, path) that were taken at a fixed rate, in order of their names, with their place and time in ms."""
    rows = frames.groupBy(key).agg(F.array_sort(F.collect_list("path")).alias("__paths"))
    return rows.select(key, F.posexplode("__paths").alias("ord", "path")).select(key, "ord", "path", F.bround(F.col("ord") * (1000.0 / fps)).cast("long").alias("t"))


def sounds(spark: SparkSession, root: str, rate: int = 16_000) -> DataFrame:
    """Sound files (WAV, 8, 16, 24 or 32 bits) under ``root`` as samples of one channel from -1 to 1 at ``rate``, and their length
    in ms; what isn't such a file is left out. Channels are averaged, other rates resampled by straight lines."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(root).select("path", "content")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as sound:
                        x = _samples(sound, rate, 0, int(sound.getnframes() * rate / sound.getframerate()))
                except _NO_SOUND:
                    continue
                yield pa.record_batch([pa.array([path]), pa.array([x.astype(np.float32)], pa.list_(pa.float32())), pa.array([round(1000 * len(x) / rate)], pa.int64())], ["path", "samples", "length"])

    return files.mapInArrow(decoded, "path string, samples array<float>, length long")


_NO_SOUND = (wave.Error, EOFError, ZeroDivisionError, ValueError)


def _samples(sound: wave.Wave_read, rate: int, first: int, end: int) -> np.ndarray:
    """Samples ``first`` to ``end`` of a sound at ``rate``, of which only the frames around them are read."""
    channels, width, own, n = sound.getnchannels(), sound.getsampwidth(), sound.getframerate(), sound.getnframes()
    places = np.arange(first, end) * (own / rate)
    begin, stop = (int(places[0]), min(n, int(places[-1]) + 2)) if len(places) else (0, 0)
    sound.setpos(begin)
    raw = np.frombuffer(sound.readframes(stop - begin), np.uint8)
    if width == 3:
        low = raw[: len(raw) // 3 * 3].reshape(-1, 3)
        x = (np.concatenate([np.zeros((len(low), 1), np.uint8), low], axis=1).reshape(-1).view("<i4") >> 8).astype(np.float64)
    else:
        x = raw[: len(raw) // width * width].view({1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    x = (x - 128) / 128 if width == 1 else x / 2 ** (8 * width - 1)
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)
    if own == rate or not len(x):
        return x
    at = places.astype(np.int64)
    low, high = (x[np.minimum(k - begin, len(x) - 1)] for k in (at, at + 1))
    return low + (high - low) * (places - at)


def sound_frames(spark: SparkSession, root: str, seconds: int = 240, rate: int = 16_000, frame: int = 160, size: int = 512) -> DataFrame:
    """The energies of the frames of sound files under ``root`` (WAV, 8 to 32 bits), as signal.band_energy() has them for
    whole files: ``path``, ``i``, ``energy``. What isn't such a file is left out.

    A task reads a chunk of so many seconds and what the last of its windows takes in behind it, so memory is bounded by a
    chunk, a long file is read by many tasks, and the frames at the borders are those of the whole. The folder is one that
    all executors have mounted.
    """
    each = seconds * rate // frame
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(root).select("path")

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                try:
                    with wave.open(_local(path)) as sound:
                        found.append((path, int(sound.getnframes() * rate / sound.getframerate()), sound.getsampwidth()))
                except _NO_SOUND:
                    continue
            found = [(path, n) for path, n, width in found if width in (1, 2, 3, 4)]
            yield pa.record_batch([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["path", "n"])

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count = min(each, n // frame - first)
                with wave.open(_local(path)) as sound:
                    x = _samples(sound, rate, first * frame, min(n, (first + count - 1) * frame + size))
                energy = frame_energies(x, rate, frame, size, most=count)
                yield pa.record_batch([pa.array([path] * count), pa.array(np.arange(first, first + count)), pa.array(energy)], ["path", "i", "energy"])

    lengths = files.mapInArrow(headed, "path string, n long").where(F.col("n") >= frame)
    chunks = lengths.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") / frame).cast("long") - 1), F.lit(each).cast("long"))))
    return chunks.repartition("path", "first").mapInArrow(framed, "path string, i long, energy double")


def _local(path: str) -> str:
    if not path.startswith("file:"):
        raise OSError(f"not in a mounted folder: {path}")
    return unquote(urlparse(path).path)


def workflow(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a graph document."""
    doc = spark.read.schema(WORKFLOW).option("multiLine", True).json(path)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    at = lambda i: F.try_element_at("l", F.lit(i))
    links = doc.select(F.explode("links").alias("l")).select(at(1).try_cast("int").alias("id"), at(2).try_cast("int").alias("src"), at(3).try_cast("int").alias("src_slot"), at(4).try_cast("int").alias("dst"), at(5).try_cast("int").alias("dst_slot"), at(6).alias("type"))
    return nodes, links


def gauges(lines: DataFrame, line: str = "line") -> DataFrame:
    """A line of host metrics ``name, used, total, load, celsius`` as columns; what isn't a number is NULL."""
    cell = lambda i: F.trim(F.try_element_at(F.split(F.col(line), ","), F.lit(i)))
    return lines.select(cell(1).alias("name"), *[cell(i).try_cast("double").alias(n) for i, n in ((2, "used"), (3, "total"), (4, "load"), (5, "celsius"))])


def write_documents(table: DataFrame, path: str) -> None:
    """One JSON line per row, in a folder per job. The folders of the jobs in the table are replaced when the write commits;
    those of other jobs stay."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").json(path)


def append_status(status: DataFrame, path: str) -> None:
    """Append a version of jobs' status, stamped with the time of the write."""
    status.withColumn("updated_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_texts(table: DataFrame, path: str, document: str = "document") -> None:
    """A text per row in a folder per job; the folders of other jobs stay."""
    table.select("job_id", F.col(document).alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").text(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old table with new rows in place of those with the same keys, and the rest of the new ones added."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def changed(old: DataFrame, new: DataFrame, keys: list[str], text: str) -> DataFrame:
    """New rows that the old table lacks or has with another text: what needs writing."""
    known = old.select(*keys, F.col(text).alias("__old"))
    return new.join(known, keys, "left").where(~F.col(text).eqNullSafe(F.col("__old"))).drop("__old")
