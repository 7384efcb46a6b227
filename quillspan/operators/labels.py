"""The label store: append-only logs with latest-per-key views, a labelling queue, and coverage.

Built-in tables take no MERGE, so a write is an append with a sequence number and a read is a view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import dates
from quillspan.operators.rank import hash_order, latest_per_key


def latest_annotations(log: DataFrame, excluded_prefix: str = "codex-", include_all: bool = False) -> DataFrame:
    """One annotation for each item: the last by updated_at, then by sequence; stamps that cannot be read come first."""
    rows = log.where("iu_id is not null and iu_id <> ''")
    if not include_all:
        rows = rows.where(~F.coalesce(F.col("annotator"), F.lit("")).startswith(excluded_prefix))
    return latest_per_key(rows, ["iu_id"], dates.iso_timestamp(F.col("updated_at")), "seq")


def upserted(log: DataFrame, keys: list[str], seq: str, created: str) -> DataFrame:
    """The state after upserts that keep the first ``created``: one aggregation, no sort."""
    others = [c for c in log.columns if c not in (*keys, created)]
    return log.groupBy(*keys).agg(*[F.max_by(c, seq).alias(c) for c in others if c != seq], F.min_by(created, seq).alias(created), F.max(seq).alias(seq))


def seen_state(log: DataFrame, keys: list[str], at: str) -> DataFrame:
    """First and last time, and how often, each key was seen."""
    return log.groupBy(*keys).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), F.count("*").alias("seen_count"))


def unlabeled(samples: DataFrame, annotations: DataFrame, key: str, seen: DataFrame | None = None) -> DataFrame:
    """Samples that nobody has labelled and, with ``seen``, that this user has not seen."""
    left = samples.join(annotations.select(key), key, "left_anti")
    return left if seen is None else left.join(seen.select(key), key, "left_anti")


def next_sample(samples: DataFrame, annotations: DataFrame, key: str, seed: int, seen: DataFrame | None = None, n: int = 1) -> DataFrame:
    return unlabeled(samples, annotations, key, seen).orderBy(hash_order(seed, F.col(key)), key).limit(n)


def live_only(rows: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """Referential integrity as a view: rows whose sample is still there."""
    return rows.join(samples.select(key), key, "left_semi")


def merge_retranscripts(rows: DataFrame, cache: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their retranscript and label; a row without a retranscript fails the job when it is reached."""
    from quillspan.functions import text as T

    hit = cache.select("iu_id", F.col("text").alias("_clip"), F.col("elapsed_seconds").alias("_elapsed"), F.lit(True).alias("_hit"))
    label = labels.select("iu_id", "emotion", F.col("annotator").alias("annotation_annotator"), F.lit(True).alias("_labeled"))
    joined = rows.join(hit, "iu_id", "left").join(label, "iu_id", "left")
    clip = T.collapse(F.when(F.col("_hit"), F.col("_clip")).otherwise(F.raise_error(F.concat(F.lit("no retranscript for "), F.col("iu_id"))).cast("string")))
    from_words = T.text_from_words(F.col("words_json"))
    return joined.select(
        *[c for c in rows.columns if c not in ("text",)],
        T.collapse(F.col("text")).alias("original_text"),
        clip.alias("clip_text"),
        F.when(clip != "", clip).otherwise(from_words).alias("text"),
        F.when(clip != "", "clip_redecode").when(from_words != "", "word_offsets_fallback").otherwise("blank_decode").alias("transcript_source"),
        F.coalesce(F.nullif(F.col("_elapsed"), F.lit(0.0)), F.lit(float("nan"))).alias("retranscribe_seconds"),
        "emotion", F.coalesce("_labeled", F.lit(False)).alias("is_labeled"), "annotation_annotator",
    )


def coverage(samples: DataFrame, annotations: DataFrame, key: str, group: str, user: Column) -> DataFrame:
    """By group: samples, samples labelled by anyone, and by the user; each side is aggregated by key before the join."""
    by_key = annotations.groupBy(key).agg(F.max(user.cast("int")).alias("mine"))
    joined = samples.groupBy(group, key).agg(F.lit(1).alias("one")).join(by_key, key, "left")
    out = joined.groupBy(group).agg(F.count("*").alias("total"), F.count("mine").alias("labeled_any"), F.coalesce(F.sum("mine"), F.lit(0)).alias("labeled_me"))
    return out.withColumn("remaining", F.greatest(F.lit(0), F.col("total") - F.col("labeled_any"))).withColumn("completion", F.bround(F.coalesce(F.try_divide("labeled_any", "total"), F.lit(0.0)), 4))


def checkpoint_state(events: DataFrame, most_attempts: int) -> DataFrame:
    """State of each key from its events (uuid, kind, seq): completed wins; failures count; started and not ended is in progress."""
    last_end = F.max(F.when(F.col("kind").isin("completed", "failed"), F.col("seq")))
    out = events.groupBy("uuid").agg(
        F.max((F.col("kind") == "completed").cast("int")).alias("done"),
        F.sum((F.col("kind") == "failed").cast("int")).alias("attempts"),
        F.max(F.when(F.col("kind") == "started", F.col("seq"))).alias("last_start"), last_end.alias("last_end"),
    )
    state = F.when(F.col("done") == 1, "completed").when(F.col("attempts") >= most_attempts, "failed").when(F.col("last_start") > F.coalesce("last_end", F.lit(-1)), "in_progress").otherwise("retry")
    return out.select("uuid", state.alias("state"), F.when(F.col("done") == 1, 0).otherwise(F.col("attempts")).cast("long").alias("attempts"))


def remaining(keys: DataFrame, state: DataFrame) -> DataFrame:
    """Keys still to do: neither completed nor failed for good."""
    return keys.join(state.where("state in ('completed', 'failed')"), "uuid", "left_anti")


def meta_store(log: DataFrame, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """Key and value after upserts: the last value of each key."""
    return log.groupBy(key).agg(F.max_by(value, seq).alias(value))


def cleared(table: DataFrame) -> DataFrame:
    """The table with all rows deleted, as a forced import begins."""
    return table.limit(0)


def queue_state(events: DataFrame, key: str, seq: str, add: str, remove: str, kind: str) -> DataFrame:
    """Members of a set after additions and removals in order: those whose last event added them."""
    return events.where(F.col(kind).isin(add, remove)).groupBy(key).agg(F.max_by(kind, seq).alias("_last")).where(F.col("_last") == add).select(key)
