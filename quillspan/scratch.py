"""Written intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster. A table written there survives a lost executor, cuts the
lineage, and has true sizes for the planner. Tables are removed when the driver's process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one of our own only in local mode, where no other machine reads it."""
    if path := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="quillspan-"))
    return _own[0]


#: Lets Spark drop a write's shuffle files when it is over; without it they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writes, _before = threading.Lock(), [0], ["false"]


def fresh(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing uses yet; what is written there goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/quillspan/{tag}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """While any write of ours runs its shuffle files go with it; the first of several at once sets that, the last puts back what was set before."""
    with _lock:
        _writes[0] += 1
        if _writes[0] == 1:
            _before[0] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            _writes[0] -= 1
            if _writes[0] == 0:
                spark.conf.set(CLEANUP, _before[0])


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back.

    Nothing reads the write's shuffle files once the table is there, so they go with it.
    """
    spark = df.sparkSession
    path = fresh(spark, tag)
    with _cleaning(spark):
        df.write.parquet(path)
    for used in getattr(df, "_holds", ()):
        release(used)
    table = spark.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def holding(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, which alone still reads ``tables``: ``save(df)`` deletes them, as its own table stands for them then."""
    df._holds = tables
    return df


def release(table: DataFrame) -> None:
    """Delete a table that ``save`` returned, once nothing will read it again."""
    for path, spark in list(_written.items()):
        if path == getattr(table, "_saved_at", None):
            drop(spark, path)
            del _written[path]


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_all() -> None:
    for path, spark in _written.items():
        with contextlib.suppress(Exception):  # the JVM may be gone already
            drop(spark, path)
