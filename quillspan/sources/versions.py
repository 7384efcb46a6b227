"""Tables in versions: a snapshot and the changes since, named by a pointer that moves at once.

A version is a row of text in ``_pointer/version=n``: its snapshot's folder, the folders of changes since, and the last batch that is in it. Readers take
the greatest version. A write puts its data in a new folder and only then adds a pointer, which appears whole or not at all; one that breaks off leaves
folders that nothing names, and the version before stays what readers see. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def current(spark: SparkSession, path: str) -> dict | None:
    """The newest version: {version, snapshot, changes, batch}; None where there is none."""
    try:
        pointers = spark.read.schema("value string, version int").text(f"{path}/_pointer")
    except AnalysisException:
        return None
    last = pointers.agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version")).first()
    return json.loads(last.value) | {"version": last.version} if last.value else None


def _point(spark: SparkSession, path: str, before: dict | None, snapshot: str | None, changes: list[str], batch: int) -> None:
    version = before["version"] + 1 if before else 0
    text = json.dumps({"snapshot": snapshot, "changes": changes, "batch": batch})
    spark.range(1).coalesce(1).select(F.lit(text).alias("value")).write.mode("error").text(f"{path}/_pointer/version={version}")


def swap(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """A new snapshot in place of all: ``write(folder)`` makes it, and then it is the table."""
    folder, before = f"{path}/snapshot-{uuid.uuid4().hex}", current(spark, path)
    write(folder)
    _point(spark, path, before, folder, [], before["batch"] if before else -1)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders that make up the newest version."""
    now = current(spark, path)
    return [f for f in (now["snapshot"], *now["changes"]) if f] if now else []


def read(spark: SparkSession, path: str, keys: Sequence[str] | None = None, seq: str | None = None) -> DataFrame:
    """The newest version's rows; with ``keys`` the last row of each key by ``seq``."""
    rows = spark.read.parquet(*folders(spark, path))
    return _latest(rows, keys, seq) if keys else rows


def _latest(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("r")).select(*keys, "r.*")


def upsert(rows: DataFrame, path: str, keys: Sequence[str], seq: str, batch: int, every: int = 10) -> None:
    """The last row of each key in ``rows`` added as changes; after ``every`` of them, all is brought together in a new snapshot.

    So a read never takes up more than one snapshot and ``every`` folders of changes. A batch that is in the table already is left out, so it may be run again.
    """
    spark, before = rows.sparkSession, current(rows.sparkSession, path)
    if before and batch <= before["batch"]:
        return
    folder = f"{path}/changes-{uuid.uuid4().hex}"
    _latest(rows, keys, seq).write.parquet(folder)
    changes = [*(before["changes"] if before else []), folder]
    snapshot = before["snapshot"] if before else None
    if len(changes) >= every:
        whole = f"{path}/snapshot-{uuid.uuid4().hex}"
        _latest(spark.read.parquet(*[f for f in (snapshot, *changes) if f]), keys, seq).write.parquet(whole)
        snapshot, changes = whole, []
    _point(spark, path, before, snapshot, changes, batch)


def upsert_stream(stream: DataFrame, keys: Sequence[str], seq: str, path: str, checkpoint: str, every: int = 10) -> StreamingQuery:
    """A stream's rows upserted batch by batch, to the end of its input."""
    put = lambda batch, n: upsert(batch, path, keys, seq, n, every)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unused(spark: SparkSession, path: str, there: Sequence[str]) -> list[str]:
    """Of the folders ``there`` those that the newest version does not name: older versions and broken writes, which may be deleted once nobody reads them."""
    used = {f.rstrip("/").rsplit("/", 1)[-1] for f in folders(spark, path)}
    return [f for f in there if f.rstrip("/").rsplit("/", 1)[-1] not in used and not f.rstrip("/").endswith("_pointer")]
