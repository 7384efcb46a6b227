"""Choosing what goes on: stations, segments, training rows and label-store requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions import vocab
from quillspan.operators import rank as R
from quillspan.operators import rules


def filter_stations(stations: DataFrame, least_votes: int = 0, languages: Sequence[str] | None = None, countries: Sequence[str] | None = None, most: int | None = None, order: str = "pos") -> DataFrame:
    """Stations with enough votes, of some languages (in any spelling) and countries (in any case), most votes first.

    None asks nothing; an empty list lets none pass. ``order`` decides among equal votes.
    """
    votes = F.coalesce(F.col("votes").cast("long"), F.lit(0))
    out = stations.where(votes >= least_votes)
    for column, wanted in ((F.col("language_canonical"), None if languages is None else [T.canonical_language(F.lit(x)) for x in languages]), (F.upper(F.coalesce("countrycode", F.lit(""))), None if countries is None else [F.lit(c.upper()) for c in countries])):
        if wanted is not None:
            out = out.where(column.isin(wanted) if wanted else F.lit(False))
    out = out.orderBy(votes.desc(), order)
    return out if most is None else out.limit(most)


def news_stations(stations: DataFrame, least_score: int = 1, order: str = "pos") -> DataFrame:
    """Of each language the station with the best news score, then the most votes; without a language, a URL or the score none."""
    language = T.collapse_language(T.canonical_language(F.trim(F.coalesce("language", F.lit("")))))
    scored = stations.withColumn("language_canonical", language).withColumn("score", T.news_score(F.col("name"), F.col("tags")))
    good = scored.where((F.trim(F.coalesce("language", F.lit(""))) != "") & (F.trim(F.coalesce("url_resolved", F.lit(""))) != "") & (F.col("language_canonical") != "") & (F.col("score") >= least_score))
    best = R.top_per_group(good, ["language_canonical"], [F.desc("score"), F.coalesce(F.col("votes"), F.lit(0)).desc(), F.col(order)])
    return best.drop("rn").orderBy("language_canonical")


def training_rows(rows: DataFrame, text: str, seconds: Column, least: float, most: float, prefiltered: bool = False) -> DataFrame:
    """Rows with an emotion token and words besides, and, unless done before, a duration in [least, most)."""
    kept = T.primary_token(F.col(text)).isNotNull() & (T.strip_tokens(F.col(text)) != "")
    return rows.where(kept if prefiltered else kept & (seconds >= least) & (seconds < most))


def accepted_up_to(rows: DataFrame, asked: rules.Rules, most: int | None, order: str) -> DataFrame:
    """Rows that no rule drops, of the first ``most`` rows read by ``order`` (None: of all)."""
    return rules.accepted(rows if most is None else rows.orderBy(order).limit(most), asked)


def mono_at_rate(ok: Column, streams: Column, rate: int) -> Column:
    """Whether a probe's first stream has this rate and one channel; what cannot be read has not."""
    first = F.get(streams, F.lit(0))
    good = (first["sample_rate"].cast("string").try_cast("int") == rate) & (first["channels"].cast("string").try_cast("int") == 1)
    return F.coalesce(ok, F.lit(False)) & F.coalesce(good, F.lit(False))


def local_first(segments: DataFrame, local: Column, source: str, order: Sequence[Column]) -> DataFrame:
    """Local segments in round robin over sources, then the others likewise; ``pos`` counts from 1."""
    here = R.interleave(segments.where(local), source, order, "_place").withColumn("_far", F.lit(0))
    there = R.interleave(segments.where(~local), source, order, "_place").withColumn("_far", F.lit(1))
    both = R.positions(here.unionByName(there), [F.col("_far"), F.col("_place")], "pos")
    return both.withColumn("pos", F.col("pos") + 1).drop("_place", "_far")


def request_fault(emotion: Column, user: Column, key: Column, notes: Column, confidence: Column) -> Column:
    """Why a label-store request is refused, or null."""
    said = F.lower(F.trim(F.coalesce(emotion, F.lit(""))))
    return rules.first_reason([
        ("key required", F.coalesce(key, F.lit("")) == ""),
        ("user key too long", F.length(F.coalesce(user, F.lit(""))) > 120),
        ("notes too long", F.length(F.coalesce(notes, F.lit(""))) > 2000),
        ("confidence out of range", ~F.coalesce(confidence, F.lit(3)).between(1, 5)),
        ("emotion must be one of: " + ", ".join(vocab.LABELS_WITH_LOW_QUALITY), ~said.isin(*vocab.LABELS_WITH_LOW_QUALITY)),
        ("user key required", F.trim(F.coalesce(user, F.lit(""))) == ""),
    ])


def point_lookup(rows: DataFrame, key: str, value: object) -> DataFrame:
    return rows.where(F.col(key) == F.lit(value))


def split_known(requests: DataFrame, samples: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests whose key exists, and those whose key does not."""
    return requests.join(samples.select(key), key, "left_semi"), requests.join(samples.select(key), key, "left_anti")


def label_id(text: Column, known: Sequence[str]) -> Column:
    """The position of the text's token among ``known``, from 0; a text without one fails the job when it is reached."""
    at = F.array_position(F.lit(list(known)), T.primary_token(text))
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("missing emotion token in text: "), F.coalesce(text, F.lit("null")))).cast("int"))


def duration_batches(rows: DataFrame, seconds: str, key: str, size: int) -> DataFrame:
    """Batches of rows of like duration, shortest first; ``batch`` counts from 0."""
    return R.shard_numbers(rows, [F.col(seconds), F.col(key)], size, "batch")


def listing(rows: DataFrame, order: Sequence[Column], line: Column, n: int = 20) -> DataFrame:
    """The first lines of a listing and, where there are more rows, how many."""
    head = rows.orderBy(*order).limit(n).select(line.alias("line"))
    rest = rows.agg((F.count("*") - n).alias("n")).where("n > 0").select(F.concat(F.lit("... and "), "n", F.lit(" more")).alias("line"))
    return head.unionByName(rest)


def refresh_needed(meta: DataFrame, revision: str, rows: Column) -> DataFrame:
    """Whether an imported table has to be read again: never imported, empty, or of another revision (an unknown one counts as the same)."""
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    done = F.coalesce(value("import_complete") == "1", F.lit(False)) & (rows > 0)
    same = F.lit(revision == "") | (F.coalesce(value("revision"), F.lit("")) == revision)
    return meta.agg(F.when(done & same, "complete").when(done, "refreshing").otherwise("downloading").alias("state"))


def migrated_annotations(old: DataFrame) -> DataFrame:
    """Annotations of the older layout: a low-quality flag becomes the label, and the flag is cleared."""
    flag = F.coalesce("low_quality", F.lit(0)) if "low_quality" in old.columns else F.lit(0)
    return old.withColumn("emotion", F.when(flag == 1, "low_quality").otherwise(F.col("emotion"))).withColumn("low_quality", F.lit(0))
