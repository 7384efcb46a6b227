"""Readers: JSON manifests and logs, Parquet, CSV, media files and checkpoints, always with a given schema."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import dates
from quillspan.functions import numbers as N
from quillspan.functions import text as T
from quillspan.operators.rank import latest_per_key
from quillspan.sources import folders, schemas, versions


#: The number of tasks that list folders; Spark's own is 10,000 for each folder that has many, which is more than the listing itself takes.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listers(spark: SparkSession) -> Iterator[None]:
    """Reads that start within list their folders in a few tasks for each core; a read lists when it is made."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def small_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length) of all files below a folder; contents are not read.

    Tasks list the folders. Spark's own listing, which holds every file on the driver and reads each as a part of a task, is for stores that only Hadoop knows.
    """
    files = folders.walk(spark, root)
    if files is None:
        with few_listers(spark):
            return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    return with_name(files, pattern)


def with_name(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose name fits a pattern."""
    return files.where(folders.matching(files.sparkSession, F.element_at(F.split("path", "/"), -1), pattern))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of sources; a malformed file fails the read."""
    return spark.read.schema(schemas.CATALOG).option("multiLine", True).option("mode", "FAILFAST").json(path)


def choose_sources(sources: DataFrame, ids: Sequence[str] | DataFrame = (), rights: Sequence[str] = ()) -> DataFrame:
    """Sources by id, a few named or a table of them, and by rights; without allowed rights none is chosen."""
    chosen = sources.where(F.col("rights_status").isin(*rights)) if rights else sources.limit(0)
    if isinstance(ids, DataFrame):
        return chosen.join(ids.select("id"), "id", "left_semi")
    return chosen.where(F.col("id").isin(*ids)) if ids else chosen


def first_audio(probe: Column) -> Column:
    return F.get(F.filter(probe["streams"], lambda s: s["codec_type"] == "audio"), F.lit(0))


def manifests(spark: SparkSession, root: str, source_ids: Sequence[str] = (), pattern: str = "*.json") -> DataFrame:
    """Captured segments whose manifest says they are valid; files that are no JSON are skipped.

    What a manifest leaves out comes from its path ``.../source/date/stem/manifest.json``; the duration is the probe's, else the one asked for.
    """
    with few_listers(spark):
        raw = spark.read.schema(schemas.MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("columnNameOfCorruptRecord", "_corrupt_record").json(root)
    parts = F.split(F.col("_metadata.file_path"), "/")
    from_path = lambda i: F.element_at(parts, i)
    probed = F.nullif(N.lenient(F.col("quality.output_probe.format.duration"), "double", 0.0), F.lit(0.0))
    out = raw.select(
        T.falsy(F.col("source.id"), None).alias("_id"), from_path(-4).alias("_path_id"), from_path(-2).alias("stem"), F.col("_metadata.file_path").alias("manifest_path"),
        F.col("source.name").alias("source_name"), F.col("source.country_code").alias("country_code"), F.col("source.rights_status").alias("rights_status"),
        F.col("capture.started_at").alias("started_at"), F.col("capture.completed_at").alias("completed_at"),
        F.when(F.col("capture.started_at").isNotNull(), dates.iso_date(F.col("capture.started_at"))).otherwise(from_path(-3)).alias("date"),
        F.coalesce(probed, F.col("capture.duration_requested_seconds").cast("double"), F.lit(0.0)).alias("duration_seconds"),
        F.coalesce(F.col("quality.valid"), F.lit(False)).alias("_valid"),
    )
    out = out.where("_valid").withColumn("source_id", F.coalesce("_id", "_path_id")).drop("_id", "_path_id", "_valid")
    out = out.withColumn("segment_id", F.concat_ws("/", "source_id", "date", "stem"))
    return out.where(F.col("source_id").isin(*source_ids)) if source_ids else out


def segment_records(spark: SparkSession, root: str, multi_line: bool = True) -> DataFrame:
    """Processed records, one a file (or, without ``multi_line``, one a line), in order."""
    raw = spark.read.schema(schemas.SEGMENT).option("multiLine", multi_line).option("recursiveFileLookup", True).json(root)
    return raw.where("status = 'ok'").orderBy("source_id", "started_at", "segment_id")


def parquet_paths(spark: SparkSession, path: str) -> str:
    """``path/data`` where it exists (a dataset folder), else ``path`` (folder, file or pattern), through Hadoop's file systems.

    Where nothing matches, FileNotFoundError says so.
    """
    hadoop = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    data, given = hadoop(path.rstrip("/") + "/data"), hadoop(path)
    files = given.getFileSystem(spark._jsc.hadoopConfiguration())
    if "*" not in path and files.exists(data):
        return data.toString()
    if not files.globStatus(given):
        raise FileNotFoundError(f"no Parquet file matches {path}")
    return path


def parquet_where(spark: SparkSession, path: str, column: str, values: Sequence, columns: Sequence[str] = ()) -> DataFrame:
    """Rows whose column is among a few literal values; the filter reaches the scan. For many values use a semi join."""
    df = spark.read.parquet(parquet_paths(spark, path)).where(F.col(column).isin(*values))
    return df.select(*columns) if columns else df


def parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    """(n_rows, columns) of a Parquet table from its footers: a count reads no column."""
    df = spark.read.parquet(parquet_paths(spark, path))
    return df.agg(F.count("*").alias("n_rows")).withColumn("columns", F.array(*[F.lit(c) for c in df.columns]))


def tokenized_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Tokenised training rows of several files: those whose text has a token, with it as a column."""
    df = spark.read.parquet(*[parquet_paths(spark, p) for p in paths])
    return df.withColumn("emotion", T.primary_token(F.col("text"))).where("emotion is not null")


def parquet(spark: SparkSession, path: str, columns: Sequence[str] = (), order: str | None = None, most: int | None = None) -> DataFrame:
    """A Parquet table, some columns of it, or its first rows by a key."""
    df = spark.read.parquet(parquet_paths(spark, path))
    df = df.select(*columns) if columns else df
    return df if most is None else df.orderBy(order or df.columns[0]).limit(most)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and quoted line ends; every column is read as text and cast, blank numbers to 0."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    want: StructType = _parse_datatype_string(schema)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    zero = {"int", "bigint", "double", "float"}
    return raw.select(*[(N.lenient(F.col(f.name), f.dataType.simpleString(), 0) if f.dataType.simpleString() in zero else F.col(f.name)).alias(f.name) for f in want.fields])


def jsonl_log(spark: SparkSession, path: str, schema: str, key: str, seq: str = "seq") -> DataFrame:
    """An append log; of each key the last line counts."""
    return latest_per_key(spark.read.schema(schema).json(path), [key], F.col(seq), seq)


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The completed recordings of a checkpoint document, with their key: the newest version at ``path``, or the file that it is."""
    schema = f"completed map<string, struct<{schemas.RECORDING.replace(' struct', ':struct').replace(' string', ':string').replace(' double', ':double').replace(' bigint', ':bigint').replace(' boolean', ':boolean')}>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(versions.folders(spark, path) or path)
    return raw.select(F.explode("completed").alias("uuid", "r")).select("uuid", "r.*")


def manifest_paths(spark: SparkSession, root: str, pattern: str = "*.json", files: DataFrame | None = None) -> DataFrame:
    """(path, length) of the manifests below a folder, in order; contents are not read. ``files`` is what ``small_files`` gave for the folder, for callers that have it."""
    return (small_files(spark, root, pattern) if files is None else with_name(files, pattern)).orderBy("path")


def folder_bytes(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """(files, bytes) below a folder; contents are not read. ``files`` as above."""
    return (small_files(spark, root) if files is None else files).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def media_files(spark: SparkSession, root: str, extensions: Sequence[str]) -> DataFrame:
    """(path, length) of files by extension; contents are not read."""
    return with_extension(small_files(spark, root), extensions)


def with_extension(files: DataFrame, extensions: Sequence[str]) -> DataFrame:
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))


def with_payload(df: DataFrame, files: DataFrame) -> DataFrame:
    """The audio payload: its bytes, else the file at its path, else null."""
    content = files.select(F.col("path").alias("_p"), "content")
    return df.join(content, df["audio.path"] == content["_p"], "left").withColumn("payload", F.coalesce(F.nullif(F.col("audio.bytes"), F.lit(b"")), "content")).drop("_p", "content")


def union_sources(loaders: dict[str, Callable[[], DataFrame]], name: str = "source") -> tuple[DataFrame | None, dict[str, str]]:
    """All sources under one schema by column name; a loader that fails is reported and left out."""
    good, failed = [], {}
    for source, load in loaders.items():
        try:
            good.append(load().withColumn(name, F.lit(source)))
        except Exception as error:  # a source's failure stays with it
            failed[source] = f"{type(error).__name__}: {error}"
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good) if good else None), failed


def units_of(segments: DataFrame) -> DataFrame:
    """A row for each boundary with text: times clamped to the segment, at least 40 ms where it has room."""
    one = segments.select("*", F.explode("boundaries").alias("b")).withColumn("text", T.collapse(F.col("b.text"))).where("text <> ''")
    seconds = F.coalesce("duration_seconds", F.lit(0.0))
    start = F.greatest(F.lit(0.0), F.least(seconds, F.coalesce("b.start_seconds", F.lit(0.0))))
    one = one.withColumn("_s", start).withColumn("_e", F.greatest(F.col("_s"), F.least(seconds, F.coalesce(F.nullif(F.col("b.end_seconds"), F.lit(0.0)), F.col("_s")))))
    one = one.withColumn("_e", F.when(F.col("_e") - F.col("_s") < 0.04, F.least(seconds, F.col("_s") + 0.04)).otherwise(F.col("_e")))
    index = F.coalesce("b.iu_index", F.lit(0))
    words = F.slice("words", F.coalesce("b.start_word_index", F.lit(0)) + 1, F.greatest(F.lit(0), F.coalesce(F.col("b.end_word_index_exclusive") - F.col("b.start_word_index"), F.lit(0))))
    return one.select(
        "segment_id", "source_id", "source_name", "country_code", "recording_date", "started_at", "text",
        F.format_string("%s#iu=%04d", "segment_id", index).alias("iu_id"), index.alias("iu_index"),
        F.concat_ws("/", "source_id", "recording_date", F.format_string("%s_iu%04d.flac", T.path_stem(F.col("audio_path")), index)).alias("path"),
        F.bround("_s", 3).alias("start_seconds"), F.bround("_e", 3).alias("end_seconds"), F.bround(F.greatest(F.lit(0.0), F.col("_e") - F.col("_s")), 3).alias("duration_seconds"),
        F.coalesce("b.start_word_index", F.lit(0)).alias("start_word_index"), F.coalesce("b.end_word_index_exclusive", F.lit(0)).alias("end_word_index_exclusive"),
        F.coalesce("b.boundary_after_word_index", F.lit(-1)).alias("boundary_after_word_index"),
        F.coalesce("b.alignment_score", F.lit(0.0)).alias("alignment_score"), F.coalesce("b.alignment_method", F.lit("")).alias("alignment_method"),
        F.coalesce("b.prosody.iu_word_count", F.lit(0)).alias("iu_word_count"), F.coalesce("b.prosody.speech_rate_wps", F.lit(0.0)).alias("speech_rate_wps"),
        F.coalesce("b.prosody.mean_energy_db", F.lit(0.0)).alias("mean_energy_db"), F.coalesce("b.prosody.pause_after_ms", F.lit(0.0)).alias("pause_after_ms"),
        F.to_json(F.coalesce(words, F.array())).alias("words_json"), "manifest_path",
    )


def station_rows(api: DataFrame) -> DataFrame:
    """Directory rows to stations: known fields only, with the canonical language."""
    known = [c.split()[0] for c in schemas.STATION.split(", ")]
    return api.withColumn("language_canonical", T.canonical_language(F.col("language"))).select(*[c for c in known if c in (*api.columns, "language_canonical")])
