"""Sinks: sharded Parquet, CSV, JSON by key, named files, append logs, per-label splits, and the aggregates of dataset cards."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.rank import shard_numbers
from quillspan.operators.rules import Rules, first_reason
from quillspan.sources import versions


def sharded_parquet(df: DataFrame, path: str, rows: int, order: str | None = None) -> None:
    """Parquet of at most ``rows`` rows a file, zstd; with ``order``, shard i of the ordered rows is folder shard=i."""
    if order is None:
        df.write.mode("overwrite").option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)
        return
    numbered = shard_numbers(df, [F.col(order)], rows)
    numbered.repartition("shard").sortWithinPartitions("shard", order).write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(path)


def numbered_shards(df: DataFrame, path: str, rows: int, order: str) -> int:
    """Parquet shards named ``train-00000-of-00003`` of ``rows`` ordered rows each (all in one for 0); at least one. How many there are.

    Rows are written in one job, a folder for each shard, which then get their names.
    """
    n = df.count()
    size = rows if rows > 0 else max(1, n)
    count = max(1, -(-n // size))
    name = F.format_string("train-%05d-of-%05d", "shard", F.lit(count).cast("long"))
    numbered = shard_numbers(df, [F.col(order)], size).withColumn("name", name)
    numbered.repartition("name").sortWithinPartitions("name", order).drop("shard").write.mode("overwrite").partitionBy("name").option("compression", "zstd").parquet(path)
    return count


def unit_shards(units: DataFrame, path: str, rows: int, order: str = "iu_id", most_segments: int | None = None, segment: str = "segment_id") -> None:
    """Unit-grain shards of ``rows`` rows; ``most_segments`` keeps the units of the first segments only."""
    if most_segments is not None:
        units = units.join(units.select(segment).distinct().orderBy(segment).limit(most_segments), segment, "left_semi")
    sharded_parquet(units, path, rows, order)


def write_json_document(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, written beside its place and moved there, through Hadoop's file systems."""
    jvm = spark._jvm
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(beside, True)
    try:
        out.write(bytearray(text, "utf-8"))
        out.hsync()
    finally:
        out.close()
    files.delete(target, False)
    if not files.rename(beside, target):
        raise OSError(f"could not move {path}.tmp to its place")


def checkpoint_lines(state: DataFrame, results: DataFrame, started_at: str, config: dict | None = None) -> DataFrame:
    """A checkpoint document in lines (section, uuid, value), one for each key: results (uuid, ...) of the completed, failures, and keys in progress."""
    failed = state.where("state in ('failed', 'retry') and attempts > 0").select("uuid", F.to_json(F.struct("attempts")).alias("value"))
    done = results.select("uuid", F.to_json(F.struct(*[c for c in results.columns if c != "uuid"])).alias("value"))
    started = state.where("state = 'in_progress'").select("uuid", F.lit(None).cast("string").alias("value"))
    end = json.dumps({"started_at": started_at, "config": config or {}}, sort_keys=True)[1:]
    marks = [(0, '{"completed": {'), (2, '}, "failed": {'), (4, '}, "in_progress": ['), (6, "], " + end)]
    out = state.sparkSession.createDataFrame([(n, "", text) for n, text in marks], "section int, uuid string, value string")
    for n, rows in ((1, done), (3, failed), (5, started)):
        first = F.coalesce(rows.agg(F.min("uuid")).scalar(), F.lit(""))
        name = F.expr("substr(to_json(array(uuid)), 2, length(to_json(array(uuid))) - 2)")
        entry = F.concat(F.when(F.col("uuid") == first, "").otherwise(","), name, F.coalesce(F.concat(F.lit(": "), "value"), F.lit("")))
        out = out.unionByName(rows.select(F.lit(n).alias("section"), "uuid", entry.alias("value")))
    return out


def write_checkpoint(state: DataFrame, results: DataFrame, path: str, started_at: str, config: dict | None = None) -> None:
    """The state of keys (uuid, state, attempts) and their results as one JSON document with sorted keys, a new version at ``path``.

    Tasks make the document's lines and one writes them in order, so it does not pass through the driver; until it is whole, the version before is what
    ``readers.checkpoint`` reads.
    """
    lines = checkpoint_lines(state, results, started_at, config)
    ordered = lines.repartitionByRange(1, "section", "uuid").sortWithinPartitions("section", "uuid").select("value")
    versions.swap(state.sparkSession, path, lambda folder: ordered.write.text(folder))


def write_package(df: DataFrame, path: str, rows: int, order: str, summary: DataFrame) -> None:
    """Shards, and their one-row summary as ``summary.json`` beside them."""
    sharded_parquet(df, f"{path}/data", rows, order)
    write_json_document(df.sparkSession, f"{path}/summary.json", summary.toJSON().first() or "{}")


def swap_package(df: DataFrame, path: str, rows: int, order: str, summary: DataFrame) -> str:
    """A package as ``write_package`` makes it, in place of the one at ``path`` once it is whole; its folder. The one before stays until it is cleared away."""
    versions.swap(df.sparkSession, path, lambda folder: write_package(df, folder, rows, order, summary))
    return versions.folders(df.sparkSession, path)[0]


def dataset_info(rows: DataFrame, language: str = "language", country: str = "country", seconds: str = "duration_seconds") -> DataFrame:
    """One row on a metadata table: rows, hours, and its languages and countries in order; both are small vocabularies."""
    names = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    return rows.agg(F.count("*").alias("num_rows"), names(language).alias("languages_covered"), names(country).alias("countries_covered"), F.coalesce(F.sum(seconds) / 3600, F.lit(0.0)).alias("total_hours_audio"))


def csv_dataset(rows: DataFrame, path: str) -> None:
    """Metadata as CSV with ``dataset_info.json`` and a card beside it."""
    csv_metadata(rows, f"{path}/metadata")
    info = dataset_info(rows)
    write_json_document(rows.sparkSession, f"{path}/dataset_info.json", info.toJSON().first())
    write_json_document(rows.sparkSession, f"{path}/README.md", card(info, "Radio recordings").first()["card"])


def card(info: DataFrame, title: str) -> DataFrame:
    """A dataset card (Markdown with its front matter) from the row of ``dataset_info``."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    return info.select(F.concat_ws("\n", F.lit(f"---\npretty_name: {title}\ntask_categories:\n- automatic-speech-recognition\n---"), F.lit(f"# {title}"), F.format_string("%d rows, %.3f hours.", "num_rows", "total_hours_audio"), F.lit("## Languages"), listed("languages_covered"), F.lit("## Countries"), listed("countries_covered")).alias("card"))


def split_card(splits: DataFrame, title: str, label: str) -> DataFrame:
    """A card that lists splits (label, rows, hours)."""
    line = F.format_string("- `%s`: %d rows, %.3f audio hours", label, "rows", "hours")
    lines = splits.select(F.col(label).alias("_l"), line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("_l", "line"))).alias("a"))
    return lines.select(F.concat_ws("\n", F.lit(f"# {title}"), F.array_join(F.transform("a", lambda x: x["line"]), "\n")).alias("card"))


def csv_metadata(df: DataFrame, path: str) -> None:
    kept = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**kept).csv(path)


def json_by_key(df: DataFrame, path: str, *keys: str) -> None:
    df.write.mode("append").partitionBy(*keys).json(path)


def named_files(files: DataFrame, root: str) -> int:
    """A small file for each row (path string, content string or binary) below the folder ``root``, in any store that pyarrow writes; how many.

    Spark's writers choose names themselves, and each file of theirs costs a folder, a checksum and a commit of its own; here tasks write under the names given. A task that
    is run again puts the same files in place of those before.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        last = None
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                folder, _, name = f"{base}/{path}".rpartition("/")
                if folder != last:
                    store.create_dir(folder, recursive=True)
                    last = folder
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = files.select("path", F.col("content").cast("binary").alias("content")).repartition(files.sparkSession.sparkContext.defaultParallelism, "path")
    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def label_splits(df: DataFrame, path: str, label: str, excluded: tuple[str, ...] = ("neutral",), dry_run: bool = False) -> DataFrame:
    """One partition for each label but the excluded ones; (split, rows) of what is written, or would be in a dry run."""
    kept = df.where(~F.col(label).isin(*excluded)).withColumn("split", F.col(label))
    if not dry_run:
        kept.write.mode("overwrite").partitionBy("split").parquet(path)
        kept = df.sparkSession.read.parquet(path)
    return kept.groupBy("split").agg(F.count("*").alias("rows"))


def publish(folder: str, upload: Callable[[str], None], attempts: int = 3) -> int:
    """The slot for an upload: ``upload(folder)`` until it succeeds, ``attempts`` times at most; how often it was tried."""
    for n in range(1, attempts + 1):
        try:
            upload(folder)
            return n
        except Exception:
            if n == attempts:
                raise
    raise ValueError("attempts must be positive")


def with_dead_letters(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and failed ones with their reason, for a table of failures."""
    marked = df.withColumn("error", reason)
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def write_counted(df: DataFrame, rules: Rules, path: str, names: Sequence[str] | None = None) -> dict[str, int]:
    """Writes the rows that no rule drops, and gives the rows by first fitting rule, ``kept`` ones too: all in the one pass that writes.

    Rules are counted under ``names``, by default their reasons; one whose reason is an expression needs a name. Counts are observed while rows
    pass, so the input is read once; a stage that is run again after a loss may count its rows again, ``rules.reason_counts`` never does.
    """
    names = list(names) if names else [r for r, _ in rules]
    if not all(isinstance(n, str) for n in names) or len(names) != len(rules):
        raise ValueError("each rule needs a name")
    which = first_reason([(F.lit(n), when) for n, (_, when) in zip(names, rules, strict=True)])
    seen = Observation()
    marked = df.withColumn("_why", F.coalesce(which, F.lit("kept")))
    counted = marked.observe(seen, *[F.count_if(F.col("_why") == n).alias(f"n{i}") for i, n in enumerate([*names, "kept"])])
    counted.where("_why = 'kept'").drop("_why").write.mode("overwrite").parquet(path)
    got = seen.get
    return {n: got[f"n{i}"] for i, n in enumerate([*names, "kept"])}


def package_summary(df: DataFrame, source: str, country: str, seconds: Column, payload: Column) -> DataFrame:
    """The one-row summary of a package: rows, sources, countries, hours and bytes."""
    named = lambda c: F.count_distinct(F.nullif(F.col(c), F.lit("")))
    return df.agg(F.count("*").alias("rows"), named(source).alias("sources"), named(country).alias("countries"), F.bround(F.coalesce(F.sum(seconds), F.lit(0.0)) / 3600, 6).alias("hours"), F.coalesce(F.sum(F.length(payload)), F.lit(0)).alias("bytes"))


def counter_json(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """By group, how often each value occurs, as JSON with sorted keys; values are counted before they are gathered."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "n"))))).alias("counts_json"))
