"""Reports: one-row and grouped summaries of captures, packages, splits and model output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import numbers as N
from quillspan.functions import sequences as S
from quillspan.functions import text as T
from quillspan.functions import vocab
from quillspan.operators import metrics as M
from quillspan.operators import rank as R


def inventory(df: DataFrame, source: str, seconds: Column, local: Column) -> DataFrame:
    """Segments, hours, and local and remote segments, by source and in total (source ``*``)."""
    out = df.rollup(source).agg(F.count("*").alias("segments"), F.bround(F.sum(seconds) / 3600, 6).alias("hours"), F.count_if(local).alias("local"), F.count_if(~local).alias("remote"))
    return out.withColumn(source, F.coalesce(source, F.lit("*")))


def processing_status(done: DataFrame, failures: DataFrame, shards: DataFrame, seconds: str) -> DataFrame:
    """One row: segments done, failures, packaged shards, and hours done."""
    counts = done.agg(F.count("*").alias("processed_ok"), F.bround(F.coalesce(F.sum(seconds), F.lit(0.0)) / 3600, 3).alias("hours"))
    for name, df in (("failures", failures), ("packaged_shards", shards)):
        counts = counts.withColumn(name, df.agg(F.count("*")).scalar())
    return counts


def run_stats(df: DataFrame, ok: Column, bytes_: Column, seconds: Column) -> DataFrame:
    """One row on a run: captures, how many succeeded, their bytes and seconds, and bytes a second."""
    total, lasted = F.coalesce(F.sum(F.when(ok, bytes_)), F.lit(0)), F.coalesce(F.sum(F.when(ok, seconds)), F.lit(0.0))
    return df.agg(F.count("*").alias("total"), F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"), total.alias("total_bytes"), lasted.alias("total_duration"), N.ratio(total, lasted).alias("avg_speed"))


def public_summary(public: DataFrame, units: DataFrame, most_seconds: float = 20.0) -> DataFrame:
    """(grouping, name, rows, hours): public rows by split, accent, source and country, in all, and the neutral rows left out."""
    sets = [[F.col(c)] for c in ("emotion", "accent", "source_id", "country_code")] + [[]]
    by = ["emotion", "accent", "source_id", "country_code"]
    out = public.groupingSets(sets, *by).agg(F.count("*").alias("rows"), F.bround(F.coalesce(F.sum("duration_seconds"), F.lit(0.0)) / 3600, 6).alias("hours"), F.grouping_id(*by).alias("g"))
    name = {7: "split", 11: "accent", 13: "source", 14: "country", 15: "all"}
    grouping = F.element_at(F.create_map(*[F.lit(x) for kv in name.items() for x in kv]), F.col("g").cast("int"))
    shown = out.select(grouping.alias("grouping"), F.coalesce(*by, F.lit("*")).alias("name"), "rows", "hours")
    neutral = units.where((F.col("emotion") == "neutral") & F.coalesce("is_labeled", F.lit(False)) & (F.trim(F.coalesce("text", F.lit(""))) != "") & (F.coalesce("duration_seconds", F.lit(0.0)) < most_seconds))
    removed = neutral.agg(F.lit("removed").alias("grouping"), F.lit("neutral").alias("name"), F.count("*").alias("rows"), F.bround(F.coalesce(F.sum("duration_seconds"), F.lit(0.0)) / 3600, 6).alias("hours"))
    return shown.unionByName(removed)


def bandwidth_profile(df: DataFrame, ok: Column, bytes_: Column, kbps: Column, seconds: float, duration: float) -> DataFrame:
    """Megabits per second, mean station rate (0.128 Mbit/s where none succeeded), and how many captures 70 % of it carries (1 to 200)."""
    mbps = F.coalesce(F.sum(F.when(ok, bytes_)), F.lit(0)) * 8 / 1e6 / seconds
    per = F.coalesce(F.avg(F.when(ok & (kbps > 0), kbps)) / 1000, F.lit(0.128))
    n = F.least(F.lit(200), F.greatest(F.lit(1), F.floor(mbps * 0.7 / per)))
    return df.agg(mbps.alias("mbps"), per.alias("station_mbps"), n.cast("int").alias("concurrent"), (F.ceil(F.count("*") / n) * duration / 3600).alias("hours"))


def concurrency_sweep(df: DataFrame, level: str, ok: Column, bytes_: Column, seconds: Column) -> DataFrame:
    """By concurrency level: Mbit/s, share of successes, and errors."""
    return df.groupBy(level).agg(
        N.ratio(F.sum(F.when(ok, bytes_)) * 8 / 1e6, F.max(seconds)).alias("mbps"), N.ratio(F.count_if(ok), F.count("*")).alias("success_rate"), F.count_if(~ok).alias("errors"),
    )


def validation_report(df: DataFrame, reason: str) -> DataFrame:
    """Files in all, valid and not; ``validation_rows`` lists them."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(reason).isNull()).alias("valid"), F.count_if(F.col(reason).isNotNull()).alias("invalid"))


def validation_rows(df: DataFrame, path: str, reason: str) -> DataFrame:
    """(path, is_valid, reason) in order of the path."""
    return df.select(path, F.col(reason).isNull().alias("is_valid"), F.coalesce(reason, F.lit("ok")).alias("reason")).orderBy(path)


def status_counts(df: DataFrame, status: Column, known: Sequence[str]) -> DataFrame:
    """Rows by status, zeros kept for known ones."""
    return M.vocab_counts(df.select(status.alias("status")), "status", list(known))


def split_report(df: DataFrame, label: str, seconds: Column, accent: str) -> DataFrame:
    """By label: rows, hours, and rows of each accent as JSON with sorted keys."""
    counts = df.groupBy(label, accent).agg(F.count("*").alias("n"), F.sum(seconds).alias("s"))
    maps = F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(accent, "n")))))
    return counts.groupBy(label).agg(F.sum("n").alias("rows"), F.bround(F.sum("s") / 3600, 6).alias("hours"), maps.alias("accents_json"))


def speech_report(df: DataFrame, ref: str, pred: str, compatible: bool = True) -> DataFrame:
    """One row on references and predictions with label tokens.

    Word and character error rates without tokens; how often the leading token is right and there; recall, precision
    and exact sequences of all tokens by longest common subsequence; macro and weighted F1 over the vocabulary.
    """
    rows = df.select(T.canonical_token_text(F.col(ref)).alias("r"), T.canonical_token_text(F.col(pred)).alias("p"), T.tokens_in(F.col(ref)).alias("rt"), T.tokens_in(F.col(pred)).alias("pt"))
    rows = rows.select("*", T.asr_normal(F.col("r"), compatible).alias("rn"), T.asr_normal(F.col("p"), compatible).alias("pn"), T.leading_token(F.col("r")).alias("rl"), T.leading_token(F.col("p")).alias("pl"))
    parts = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    rows = rows.select("*", S.edit_distance(parts("rn"), parts("pn")).alias("word_edits"), F.size(parts("rn")).alias("words"), F.levenshtein("rn", "pn").alias("char_edits"), F.length("rn").alias("chars"), S.common_length(F.col("rt"), F.col("pt")).alias("lcs"))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    main = rows.agg(
        N.ratio(F.sum("word_edits"), F.sum("words")).alias("wer"), N.ratio(F.sum("char_edits"), F.sum("chars")).alias("cer"),
        share(F.col("rl").eqNullSafe(F.col("pl"))).alias("leading_accuracy"), share(F.col("pl").isNotNull()).alias("leading_present"), (1 - share(F.col("pl").isNotNull())).alias("leading_invalid"),
        share(F.size("pt") > 0).alias("tokens_present"), F.try_divide(F.sum("lcs").cast("double"), F.sum(F.size("rt"))).alias("token_recall"), F.try_divide(F.sum("lcs").cast("double"), F.sum(F.size("pt"))).alias("token_precision"),
        share(F.col("rt") == F.col("pt")).alias("sequence_accuracy"), F.sum(F.size("rt")).alias("reference_tokens"), F.sum(F.size("pt")).alias("predicted_tokens"), F.count("*").alias("rows"),
    )
    classes = M.summary(M.prf(rows.na.fill("none", ["rl", "pl"]), "rl", "pl", list(vocab.TOKENS))).select("macro_f1", "weighted_f1")
    scalar = classes.select(F.struct("*")).scalar()
    return main.withColumn("_c", scalar).select("*", "_c.macro_f1", "_c.weighted_f1").drop("_c")


def bucket_counts(df: DataFrame, wer: Column) -> DataFrame:
    return M.vocab_counts(df.select(S.quality_bucket(wer).alias("bucket")), "bucket", ["good", "usable", "poor"])


def first_examples(df: DataFrame, key: str, n: int = 50) -> DataFrame:
    return df.orderBy(key).limit(n)


def spot_check(df: DataFrame, key: str, label: str, ref: str, pred: str, k: int, seed: int, compatible: bool = True) -> DataFrame:
    """A sample of ``k`` rows of each label to be looked at: (label, key, ref, pred, wer, bucket, leading, predicted, is_right), worst word error rate first.

    Rows are chosen before anything is compared. Error rates are without tokens; ``leading`` and ``predicted`` are the first tokens.
    """
    some = R.sample_per_group(df.select(key, label, F.col(ref).alias("ref"), F.col(pred).alias("pred")), [label], key, k, seed)
    parts = lambda c: F.filter(F.split(T.asr_normal(T.canonical_token_text(F.col(c)), compatible), " "), lambda x: x != "")
    words = some.select("*", parts("ref").alias("_r"), parts("pred").alias("_p"), T.leading_token(T.canonical_token_text(F.col("ref"))).alias("leading"), T.leading_token(T.canonical_token_text(F.col("pred"))).alias("predicted"))
    wer = S.word_error_rate(S.edit_distance(F.col("_r"), F.col("_p")), F.size("_r"), F.size("_p"))
    rows = words.withColumn("wer", wer).select(label, key, "ref", "pred", "wer", S.quality_bucket(F.col("wer")).alias("bucket"), "leading", "predicted", F.col("leading").eqNullSafe(F.col("predicted")).alias("is_right"))
    return rows.orderBy(label, F.desc("wer"), key)
