"""Delivery of files to a store outside Spark, as a data source writer: each file tried with back-off, its status in a table.

A task delivers its rows one by one with ``upload``, a function ``(row, attempt)`` named ``module:function`` that raises where it fails, and writes what became of them
to a status file of its own. Which status files count is decided when the job commits: their names go into a manifest, so a task that
is run again, or a job that fails, leaves no second status of a file. A file that fails for good fails no task; it is a row with its error.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STATUS = "file_id string, status string, attempts int, error string"


@dataclass
class Delivered(WriterCommitMessage):
    """One task's status file, and how many files it uploaded and failed."""

    part: str
    uploaded: int
    failed: int


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class DeliveryWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.attempts, self.wait = int(options.get("attempts", "3")), float(options.get("backoff_seconds", "1"))

    def write(self, iterator: Iterator[Row]) -> Delivered:
        module, _, name = self.options["upload"].partition(":")
        upload = getattr(import_module(module), name)
        store, root = _store(self.options["status"])
        part, counts = f"part-{uuid.uuid4().hex}.json", {"uploaded": 0, "failed": 0}
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{part}") as out:
            for row in iterator:
                status = self._deliver(upload, row)
                counts[status["status"]] += 1
                out.write(json.dumps(status).encode() + b"\n")
        return Delivered(part, counts["uploaded"], counts["failed"])

    def _deliver(self, upload, row: Row) -> dict:
        for n in range(1, self.attempts + 1):
            try:
                upload(row.asDict(), n)
                return {"file_id": str(row[0]), "status": "uploaded", "attempts": n, "error": None}
            except Exception as error:
                if n == self.attempts:
                    return {"file_id": str(row[0]), "status": "failed", "attempts": n, "error": str(error)[:2000]}
                time.sleep(self.wait * 2 ** (n - 1))  # twice as long each time
        raise ValueError("attempts must be positive")

    def commit(self, messages: list[Delivered | None]) -> None:
        done = [m for m in messages if m is not None]
        store, root = _store(self.options["status"])
        store.create_dir(f"{root}/_committed", recursive=True)
        with store.open_output_stream(f"{root}/_committed/{time.time_ns():020d}.json") as out:
            for m in done:
                out.write(json.dumps({"part": m.part, "uploaded": m.uploaded, "failed": m.failed}).encode() + b"\n")

    def abort(self, messages: list[Delivered | None]) -> None:
        """Status files of a job that failed go; files that it had uploaded are uploaded again, so uploads must bear repeating."""
        store, root = _store(self.options["status"])
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.part}")


class DeliverySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "delivery"

    def writer(self, schema: StructType, overwrite: bool) -> DeliveryWriter:
        return DeliveryWriter(self.options)


def deliver(files: DataFrame, upload: str, status: str, attempts: int = 3, backoff_seconds: float = 1.0) -> None:
    """Delivers each row of ``files``, whose first column is its id, and appends to the status table in the folder ``status``."""
    files.sparkSession.dataSource.register(DeliverySource)
    files.write.format("delivery").option("upload", upload).option("status", status).option("attempts", attempts).option("backoff_seconds", backoff_seconds).mode("append").save()


def statuses(spark: SparkSession, status: str) -> DataFrame:
    """(file_id, status, attempts, error) of all committed deliveries, the last one of each file; without one, an empty table."""
    store, root = _store(status)
    from pyarrow import fs

    if not store.get_file_info(fs.FileSelector(f"{root}/_committed", allow_not_found=True)):
        return spark.createDataFrame([], STATUS)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    committed = spark.read.schema("part string").json(f"{status}/_committed").select("part", name.alias("committed"))
    rows = spark.read.schema(STATUS).option("pathGlobFilter", "part-*.json").json(status).select("*", name.alias("part"))
    last = rows.join(committed, "part").groupBy("file_id").agg(F.max_by(F.struct("status", "attempts", "error"), F.col("committed")).alias("s"))
    return last.select("file_id", "s.*")


def retries(files: DataFrame, key: str, done: DataFrame) -> DataFrame:
    """The files that are not uploaded: never tried, or failed."""
    return files.join(done.where("status = 'uploaded'").select(F.col("file_id").alias("_id")), F.col(key).cast("string") == F.col("_id"), "left_anti")
