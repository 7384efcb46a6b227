"""Listing of folders by tasks: neither the driver nor a plan holds an entry for each file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspan.scratch import save

_ENTRY = "root string, uri string, rest string, length long"


def hidden(name: Column) -> Column:
    """Names that Spark's own listing leaves out, too."""
    return name.startswith(".") | name.endswith("._COPYING_") | (name.startswith("_") & ~name.contains("="))


def matching(spark: SparkSession, name: Column, pattern: str) -> Column:
    """Whether a file's name fits a pattern, as Hadoop reads patterns."""
    return name.rlike(f"^(?:{spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()})$")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in each folder; the length of a folder is null."""
    stores: dict[str, tuple[fs.FileSystem, str]] = {}
    names = ["root", "uri", "rest", "length"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64()]
    rows: list[tuple] = []

    def batch_of(some: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)

    for batch in batches:
        for root, uri, rest in zip(*(batch[c].to_pylist() for c in names[:3]), strict=True):
            if uri not in stores:
                stores[uri] = fs.FileSystem.from_uri(uri)
            store, base = stores[uri]
            for x in store.get_file_info(fs.FileSelector(base + rest, allow_not_found=True)):
                rows.append((root, uri, f"{rest}/{x.base_name}", None if x.type == fs.FileType.Directory else x.size))
                if len(rows) == 10_000:
                    yield batch_of(rows)
                    rows.clear()
    if rows:
        yield batch_of(rows)


def opened(uri: str) -> bool:
    """Whether tasks can list the store through pyarrow."""
    try:
        fs.FileSystem.from_uri(uri)
    except (ValueError, NotImplementedError, OSError):
        return False
    return True


def walk(spark: SparkSession, root: str) -> DataFrame | None:
    """(path, length) of all files below a folder, or those that a pattern names; None if only Hadoop knows the store.

    A level of folders is dealt over the tasks, listed and written, then the next one, so that many small folders in one large one are many tasks' work.
    """
    given = spark._jvm.org.apache.hadoop.fs.Path(root)
    roots = given.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(given)
    if not roots:
        raise FileNotFoundError(f"no folder matches {root}")
    rows = []
    for status in roots:
        where = status.getPath().toUri()
        uri = where.getPath() if where.getScheme() == "file" else where.toString()
        rows.append((status.getPath().toString(), uri, "", None if status.isDirectory() else status.getLen()))
    if not opened(rows[0][1]):
        return None
    level = spark.createDataFrame(rows, _ENTRY)
    files, most = level.where(F.col("length").isNotNull() & ~hidden(F.element_at(F.split("root", "/"), -1))), 2 * spark.sparkContext.defaultParallelism
    folders = sum(row[3] is None for row in rows)
    while folders:
        ahead = level.where("length is null")
        ahead = ahead.coalesce(1) if folders == 1 else ahead.repartition(min(folders, most), "root", "rest")
        seen = Observation()
        listed = ahead.mapInArrow(_entries, _ENTRY).where(~hidden(F.element_at(F.split("rest", "/"), -1)))
        level = save(listed.observe(seen, F.count_if(F.col("length").isNull()).alias("folders")), "walk")
        files, folders = files.unionByName(level.where("length is not null")), seen.get["folders"]
    return files.select(F.concat("root", "rest").alias("path"), "length")
