"""Reports over captures, packages and model output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import reports as P
from quillspan.operators import rules
from quillspan.plans.registry import query, table
from quillspan.plans.scalars import turn_pairs, _turn_words


@query("inventory_hours", """
select coalesce(source, '*') as source, count(*) as segments, round_even(sum(n_chars)::double / 3600, 6) as hours, count(*) filter (where doc_id % 3 = 0) as local, count(*) filter (where doc_id % 3 <> 0) as remote from documents group by rollup (source)""")
def inventory_hours(spark: SparkSession, d: str) -> DataFrame:
    return P.inventory(table(spark, d, "documents").select("source", "n_chars", "doc_id"), "source", F.col("n_chars"), F.col("doc_id") % 3 == 0)


@query("bandwidth_profile", """
with p as (select sum(case when value > 5 then event_id end) * 8 / 1e6 / 60 as mbps, avg(case when value > 5 then value end) / 1000 as per, count(*) as n from events),
c as (select *, least(200, greatest(1, floor(mbps * 0.7 / per))) as k from p)
select round(mbps, 6) as mbps, round(per, 6) as station_mbps, cast(k as int) as concurrent, round(ceil(n / k) * 1800 / 3600, 6) as hours from c""")
def bandwidth_profile(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("value") > 5
    out = P.bandwidth_profile(table(spark, d, "events"), ok, F.col("event_id"), F.col("value"), 60.0, 1800.0)
    return out.select(F.round("mbps", 6).alias("mbps"), F.round("station_mbps", 6).alias("station_mbps"), "concurrent", F.round("hours", 6).alias("hours"))


@query("concurrency_sweep", """
select event_type, round(coalesce(sum(case when value > 5 then event_id end) * 8 / 1e6 / nullif(max(value), 0), 0), 6) as mbps, round(count(*) filter (where value > 5)::double / count(*), 6) as success_rate,
  count(*) filter (where not value > 5) as errors from events group by 1""")
def concurrency_sweep(spark: SparkSession, d: str) -> DataFrame:
    out = P.concurrency_sweep(table(spark, d, "events"), "event_type", F.col("value") > 5, F.col("event_id"), F.col("value"))
    return out.select("event_type", F.round("mbps", 6).alias("mbps"), F.round("success_rate", 6).alias("success_rate"), "errors")


@query("validation_report", """
with v as (select case when n_chars * 2.0 < 1700 then 'short' when doc_id % 100 > 50 then 'silent' when doc_id % 97 = 0 then 'quiet' end as why from documents)
select count(*) as total, count(*) filter (where why is null) as valid, count(*) filter (where why is not null) as invalid from v""")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.col("n_chars") * 2.0
    why = rules.recording_gate(F.lit(True), F.col("n_chars"), seconds, seconds * (F.col("doc_id") % 100) / 100, F.when(F.col("doc_id") % 97 == 0, 0.0).otherwise(0.5))
    return P.validation_report(table(spark, d, "documents").select(why.alias("why")), "why")


@query("upload_status_counts", """
select v.status, count(e.event_id) as n from (values ('uploaded'), ('failed'), ('skipped'), ('pending')) v(status)
left join (select event_id, case event_type when 'purchase' then 'uploaded' when 'error' then 'failed' when 'view' then 'skipped' end as status from events) e on e.status = v.status group by 1""")
def upload_status_counts(spark: SparkSession, d: str) -> DataFrame:
    status = F.expr("case event_type when 'purchase' then 'uploaded' when 'error' then 'failed' when 'view' then 'skipped' end")
    return P.status_counts(table(spark, d, "events"), status, ["uploaded", "failed", "skipped", "pending"])


@query("split_report", """
select source, cast(sum(n) as bigint) as rows, round_even(sum(s)::double / 3600, 6) as hours, '{' || string_agg('"' || lang || '":' || n, ',' order by lang) || '}' as accents_json
from (select source, lang, count(*) as n, sum(n_chars) as s from documents group by all) group by 1""")
def split_report(spark: SparkSession, d: str) -> DataFrame:
    return P.split_report(table(spark, d, "documents"), "source", F.col("n_chars"), "lang")


@query("speech_report")
def speech_report(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive turns as reference and prediction, each with a label token."""
    tagged = lambda c, k: F.concat(F.lit("<|"), F.get(F.lit(["joy", "fear", "neutral"]), (F.col("conv_id") + k * F.col("turn")) % 3), F.lit("|> "), F.col(c))
    return P.speech_report(turn_pairs(spark, d).select(tagged("ref", 0).alias("r"), tagged("pred", 1).alias("p")), "r", "p")


@query("wer_buckets")
def wer_buckets(spark: SparkSession, d: str) -> DataFrame:
    from quillspan.functions import sequences as S

    rows = _turn_words(spark, d).select(S.edit_distance(F.col("r"), F.col("p")).alias("e"), F.size("r").alias("n"), F.size("p").alias("m"))
    return P.bucket_counts(rows, S.word_error_rate(F.col("e"), F.col("n"), F.col("m")))
