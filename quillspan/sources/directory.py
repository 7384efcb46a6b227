"""A Python data source for paged JSON services, such as a station directory or a dataset hub, read at once or as a stream.

The service is a function ``fetch(page, options) -> list of rows or None``, named ``module:function``; pages are read in
parallel by executors. Options such as ``tag`` are the service's own; ``limit`` rows at most are taken, ``page_rows`` to a page, which
also gives the number of pages. As a stream the offset is a page number: ``count``, a function of the options, says how many pages there are
by now, and each batch reads those that are new. A batch has no bound of its own: a run over what there is asks for the newest page once, and one that is told less
would end before the rest. Nothing here opens a connection; ``stored_page`` and ``stored_pages`` are a service over
pages that lie in a folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import import_module
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names, self.options = schema.fieldNames(), dict(options)
        self.page_rows = int(self.options.get("page_rows", "1000"))

    def partitions(self) -> list[Page]:
        if "limit" in self.options:
            return [Page(i) for i in range(-(-int(self.options["limit"]) // self.page_rows))]
        return [Page(i) for i in range(int(self.options.get("pages", "1")))]

    def read(self, partition: Page) -> Iterator[tuple]:
        module, _, name = self.options["fetch"].partition(":")
        rows = getattr(import_module(module), name)(partition.number, self.options) or ()
        left = int(self.options["limit"]) - partition.number * self.page_rows if "limit" in self.options else None
        for row in islice(rows, None if left is None else min(left, self.page_rows)):
            yield tuple(row.get(n) for n in self.names)


class PagedStreamReader(DataSourceStreamReader):
    """Pages as they come; what was read is told by the query's checkpoint, so a restart goes on at the page after."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.pages = PagedReader(schema, options)
        self.options = self.pages.options
        self.told = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": int(self.options.get("from_page", "0"))}

    def latestOffset(self) -> dict:  # noqa: N802
        """All pages there are, and never fewer than were told before."""
        module, _, name = self.options["count"].partition(":")
        return {"page": max(int(getattr(import_module(module), name)(self.options)), self.told)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.told = max(self.told, end["page"])
        return [Page(i) for i in range(start["page"], end["page"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.pages.read(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, self.options)

    def streamReader(self, schema: StructType) -> PagedStreamReader:  # noqa: N802
        return PagedStreamReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("paged").schema(...).option("fetch", "module:function").option("pages", n).load()`` known."""
    spark.dataSource.register(PagedSource)


def store_pages(df: DataFrame, order: str, root: str, page_rows: int) -> None:
    """Rows added as JSON pages of ``page_rows`` rows by a numeric ``order`` that counts from 0, a folder ``page=n`` each."""
    pages = df.withColumn("page", F.floor(F.col(order) / page_rows))
    pages.repartition("page").sortWithinPartitions("page", order).write.mode("append").partitionBy("page").json(root)


def stored_page(page: int, options: dict[str, str]) -> list[dict] | None:
    """Page ``page`` below the folder ``root``, in any store that pyarrow reads; None where there is none."""
    import json

    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(options["root"])
    files = store.get_file_info(fs.FileSelector(f"{path}/page={page}", allow_not_found=True))
    parts = sorted(f.path for f in files if f.base_name.startswith("part-"))
    return [json.loads(line) for p in parts for line in store.open_input_stream(p).read().splitlines()] if parts else None


def stored_pages(options: dict[str, str]) -> int:
    """How many pages lie below ``root``."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(options["root"])
    return sum(f.base_name.startswith("page=") for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)))
