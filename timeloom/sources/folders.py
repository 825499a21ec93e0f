"""Folders of jobs as a data source: a document of each job's folder as a row, in batches and as a stream, and back.

    register(spark)
    spark.read.format("job_documents").option("document", "status.json").load(root)        # job_id, text, changed, error
    spark.readStream.format("job_documents").option("document", "status.json").load(root)  # documents as they change
    rows.write.format("job_documents").option("document", "status.json").mode("append").save(root)  # job_id, text

The root is a folder that all executors have mounted. ``typed`` and ``unreadable`` make columns of the documents.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualNullSafe, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "job_id string, text string, changed timestamp, error string"
#: Folders that one task reads.
FOLDERS = 256
#: A change counts for a stream once it is so old, as others may follow with the same time.
SETTLED_NS = 100_000_000
STAGING = ".staging-"


@dataclass
class Folders(InputPartition):
    names: list[str]


@dataclass
class Staged(WriterCommitMessage):
    """Documents that a task has staged: job and file."""

    files: list[tuple[str, str]]


def _is_folder_name(name: str | None) -> bool:
    return bool(name) and "/" not in name and "\0" not in name and not name.startswith(".")


def _dealt(names: list[str]) -> list[Folders]:
    return [Folders(names[k : k + FOLDERS]) for k in range(0, len(names), FOLDERS)]


class _Reader(DataSourceReader):
    """Folders without the document are left out; a document that can't be read is a row with an error and no text."""

    def __init__(self, root: str, document: str):
        self.root, self.document = root, document
        self.only: set[str] | None = None

    def pushFilters(self, filters):
        """Jobs that are asked for by id are looked up; no other folder is opened."""
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe)) and f.attribute == ("job_id",):
                asked = {f.value}
            elif isinstance(f, In) and f.attribute == ("job_id",):
                asked = set(f.value)
            else:
                yield f
                continue
            self.only = asked if self.only is None else self.only & asked

    def partitions(self) -> Sequence[InputPartition]:
        names = os.listdir(self.root) if self.only is None else self.only
        return _dealt(sorted(n for n in names if _is_folder_name(n))) or [Folders([])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for name in partition.names:
            path = os.path.join(self.root, name, self.document)
            try:
                changed = datetime.fromtimestamp(os.stat(path).st_mtime, UTC)
            except (FileNotFoundError, NotADirectoryError):
                continue
            try:
                with open(path, encoding="utf-8") as f:
                    yield name, f.read(), changed, None
            except (OSError, UnicodeDecodeError) as e:
                yield name, None, changed, f"{type(e).__name__}: {e}"


class _StreamReader(_Reader, DataSourceStreamReader):
    """Documents by the time at which their folder entry last changed, which a copy with an older date has too. A document
    that changes again before it is read comes once with each change, both times as it is by then."""

    def _changed(self) -> Iterator[tuple[str, int]]:
        for name in os.listdir(self.root):
            if _is_folder_name(name):
                try:
                    yield name, os.stat(os.path.join(self.root, name, self.document)).st_ctime_ns
                except (FileNotFoundError, NotADirectoryError):
                    continue

    def initialOffset(self) -> dict:
        return {"ns": 0}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - SETTLED_NS
        return {"ns": max((ns for _, ns in self._changed() if ns <= settled), default=0)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _dealt(sorted(name for name, ns in self._changed() if start["ns"] < ns <= end["ns"]))

    def commit(self, end: dict) -> None:
        pass


class _Writer(DataSourceWriter):
    """Tasks stage documents beside the folders; the commit puts each in its place by a rename, so whoever reads finds the old
    document or the new one whole. A write that fails changes nothing. A document that says the same already isn't written."""

    def __init__(self, root: str, document: str):
        self.root, self.document = root, document
        self.staging = os.path.join(root, STAGING + uuid.uuid4().hex)

    def write(self, iterator) -> Staged:
        mine = os.path.join(self.staging, uuid.uuid4().hex)
        files = []
        for row in iterator:
            if not _is_folder_name(row["job_id"]):
                raise ValueError(f"no name of a folder: {row['job_id']!r}")
            text = row["text"] or ""
            try:
                with open(os.path.join(self.root, row["job_id"], self.document), encoding="utf-8") as f:
                    if f.read() == text:
                        continue
            except (OSError, UnicodeDecodeError):
                pass
            os.makedirs(mine, exist_ok=True)
            path = os.path.join(mine, str(len(files)))
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
            files.append((row["job_id"], path))
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        files = [x for m in messages if m is not None for x in m.files]
        jobs = [j for j, _ in files]
        if len(set(jobs)) < len(jobs):
            self.abort(messages)
            raise ValueError(f"several documents for one job: {next(j for j in jobs if jobs.count(j) > 1)}")
        for job, path in files:
            os.makedirs(os.path.join(self.root, job), exist_ok=True)
            os.replace(path, os.path.join(self.root, job, self.document))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class JobDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "job_documents"

    def schema(self) -> str:
        return SCHEMA

    @property
    def _place(self) -> tuple[str, str]:
        return self.options["path"], self.options.get("document", "status.json")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(*self._place)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(*self._place)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("documents of other jobs stay: write in the mode append")
        return _Writer(*self._place)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let it see which jobs are asked for."""
    spark.dataSource.register(JobDocuments)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def typed(documents: DataFrame, schema: str) -> DataFrame:
    """The fields of the documents that are JSON objects, with ``job_id``."""
    parsed = _parsed(documents, schema)
    return parsed.where("error is null and __doc.__corrupt is null").select("__doc.*", "job_id").drop("__corrupt")


def unreadable(documents: DataFrame, schema: str) -> DataFrame:
    """(job_id, error) of the documents that typed() leaves out."""
    broken = F.when(F.col("__doc.__corrupt").isNotNull(), "no document of this schema")
    return _parsed(documents, schema).select("job_id", F.coalesce("error", broken).alias("error")).where("error is not null")


def _parsed(documents: DataFrame, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}
    doc = F.from_json("text", f"{schema}, __corrupt string", options)
    # an empty text parses to nothing at all
    return documents.withColumn("__doc", doc).withColumn("error", F.coalesce("error", F.when(F.col("__doc").isNull() | (F.trim("text") == ""), "empty")))
