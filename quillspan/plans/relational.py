"""Joins, aggregates, set operations, rules and the label store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import numbers as N
from quillspan.functions import text as T
from quillspan.operators import labels as L
from quillspan.operators import rank as R
from quillspan.operators import rules
from quillspan.plans.registry import query, table
from quillspan.sources import readers, sinks

SCORE_SQL = """round(0.34*(least(n_chars/100.0,24.0)/24)+0.18*(least(n_chars/1000.0,4.0)/4)+0.18*coalesce(quality,0)
  +0.14*least(greatest((-(doc_id%60)+45)/30.0,0),1)+0.10*least(greatest(1-abs(n_chars%10-3.6)/4,0),1)
  +0.06*(least(length(text),120)/120.0)-0.03*(least(doc_id%900,800)/800.0),8)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Documents with labels and the quality score on stand-ins for the prosodic columns."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    n = F.col("n_chars").cast("double")
    score = N.quality_score(F.col("text"), n / 100, n / 1000, F.col("quality").cast("double"), -(F.col("doc_id") % 60).cast("double"), (F.col("n_chars") % 10).cast("double"), (F.col("doc_id") % 900).cast("double"))
    return docs.withColumn("score", F.round(score, 8))


SCORED_SQL = f"(select d.*, l.quality, l.toxic, {SCORE_SQL} as score from documents d left join labels l using (doc_id))"


@query("topk_quality_by_source", f"""
select source, doc_id, rn, score, quality, available from (
  select *, row_number() over (partition by source order by score desc, doc_id) as rn, count(*) over (partition by source) as available from {SCORED_SQL})
where rn <= 3""")
def topk_quality_by_source(spark: SparkSession, d: str) -> DataFrame:
    narrow = scored(spark, d).select("source", "doc_id", "score", "quality")
    size = narrow.groupBy("source").agg(F.count("*").alias("available"))
    return R.top_per_group(narrow, ["source"], [F.col("score").desc(), F.col("doc_id")], 3).join(size, "source").select("source", "doc_id", F.col("rn").cast("long").alias("rn"), "score", "quality", "available")


@query("sampled_pool_stats", f"""
with r as (select source, doc_id, score, row_number() over (partition by source order by score desc, doc_id) as pr, count(*) over (partition by source) as available from {SCORED_SQL}),
p as (select *, row_number() over (partition by source order by md5('917|'||doc_id), doc_id) as rn, count(*) over (partition by source) as pool from r where pr <= 15)
select source, max(available) as available, max(pool) as pool, count(*) as selected, min(score) as min_score, round(avg(score),6) as mean_score from p where rn <= 5 group by source""")
def sampled_pool_stats(spark: SparkSession, d: str) -> DataFrame:
    narrow = scored(spark, d).select("source", "doc_id", "score")
    size = narrow.groupBy("source").agg(F.count("*").alias("available"))
    chosen = R.sample_top_pool(narrow, ["source"], "score", "doc_id", 5, 3, 917)
    stats = chosen.groupBy("source").agg(F.count("*").alias("selected"), F.min("score").alias("min_score"), F.round(F.avg("score"), 6).alias("mean_score"))
    return stats.join(size, "source").select("source", "available", F.least("available", F.lit(15).cast("long")).alias("pool"), "selected", "min_score", "mean_score")


@query("label_left_join", "select d.doc_id, d.source, l.quality, l.toxic, l.doc_id is not null as is_labeled from documents d left join labels l using (doc_id)")
def label_left_join(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").withColumn("hit", F.lit(True))
    return table(spark, d, "documents").select("doc_id", "source").join(labels, "doc_id", "left").select("doc_id", "source", "quality", "toxic", F.coalesce("hit", F.lit(False)).alias("is_labeled"))


@query("unlabeled_anti_join", "select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def unlabeled_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return L.unlabeled(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("labeled_semi_join", "select doc_id, source, n_chars from documents where doc_id in (select doc_id from labels)")
def labeled_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return L.live_only(table(spark, d, "documents").select("doc_id", "source", "n_chars"), table(spark, d, "labels"), "doc_id")


@query("label_store_latest", """
select user_id, event_type, event_id as seq, value, strftime(created, '%Y-%m-%d %H:%M:%S') as created from (
  select *, row_number() over (partition by user_id, event_type order by event_id desc) as rn, first_value(ts) over (partition by user_id, event_type order by event_id) as created from events)
where rn = 1""")
def label_store_latest(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", F.col("ts").alias("created"))
    state = L.upserted(log, ["user_id", "event_type"], "event_id", "created")
    return state.select("user_id", "event_type", F.col("event_id").alias("seq"), "value", F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("label_store_stats", """
select source, count(distinct d.doc_id) as total, count(distinct l.doc_id) as labeled_any, count(distinct case when l.toxic = 1 then l.doc_id end) as labeled_me,
  greatest(0, count(distinct d.doc_id) - count(distinct l.doc_id)) as remaining, round_even(count(distinct l.doc_id)::double / count(distinct d.doc_id), 4) as completion
from documents d left join labels l on l.doc_id = d.doc_id group by source""")
def label_store_stats(spark: SparkSession, d: str) -> DataFrame:
    return L.coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "source", F.col("toxic") == 1)


@query("label_export", "select l.doc_id, l.quality, l.toxic, d.source, d.lang from labels l join documents d on d.doc_id = l.doc_id where l.quality = 0 order by l.doc_id desc")
def label_export(spark: SparkSession, d: str) -> DataFrame:
    bad = table(spark, d, "labels").where("quality = 0")
    return bad.join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id").orderBy(F.desc("doc_id"))


@query("seen_state_counters", "select user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_seen_at, count(*) as seen_count from events group by all")
def seen_state_counters(spark: SparkSession, d: str) -> DataFrame:
    state = L.seen_state(table(spark, d, "events"), ["user_id", "event_type"], "ts")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return state.select("user_id", "event_type", stamp("first_seen_at"), stamp("last_seen_at"), "seen_count")


@query("next_unlabeled_queue", """
select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id) and not exists (select 1 from events e where e.user_id = 7 and e.event_id = d.doc_id)
order by md5('11|' || doc_id), doc_id limit 20""")
def next_unlabeled_queue(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "events").where("user_id = 7").select(F.col("event_id").alias("doc_id"))
    return L.next_sample(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id", 11, seen, 20)


@query("drop_reason_counts", """
select case when l.doc_id is null then 'unlabeled' when l.quality = 0 then 'low_quality' when l.toxic = 1 then 'unknown_emotion:toxic' when n_chars/200.0 >= 20 then 'duration_gte_limit'
  when trim(text) = '' then 'empty_text' else 'kept' end as drop_reason, count(*) as n from documents d left join labels l using (doc_id) group by 1""")
def drop_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return rules.reason_counts(token_rows(spark, d), token_set_rules())


def token_rows(spark: SparkSession, d: str) -> DataFrame:
    emotion = F.when(F.col("quality").isNull(), "").when(F.col("quality") == 0, "low_quality").when(F.col("toxic") == 1, "toxic").otherwise("joy")
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.withColumn("emotion", emotion)


def token_set_rules() -> rules.Rules:
    return rules.token_rules(F.col("emotion"), F.col("text"), F.col("n_chars") / 200.0, F.encode("text", "UTF-8"), 20.0)


@query("accepted_rows", """
select doc_id, source, '<|joy|> ' || trim(text) as target from documents join labels using (doc_id) where quality = 1 and toxic = 0 and n_chars/200.0 < 20 and trim(text) <> ''""")
def accepted_rows(spark: SparkSession, d: str) -> DataFrame:
    kept = rules.accepted(token_rows(spark, d), token_set_rules())
    return kept.select("doc_id", "source", F.concat(T.token_of_label(F.col("emotion")), F.lit(" "), F.trim("text")).alias("target"))


@query("counter_grouping_sets", """
select coalesce(source, '*') as source, coalesce(label, '*') as label, count(*) as n from (
  select source, case when quality is null then 'unlabeled' when quality = 1 then 'good' else 'bad' end as label from documents left join labels using (doc_id))
group by grouping sets ((source, label), (source), (label), ())""")
def counter_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("quality").isNull(), "unlabeled").when(F.col("quality") == 1, "good").otherwise("bad")
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left").select("source", label.alias("label"))
    sets = [[F.col("source"), F.col("label")], [F.col("source")], [F.col("label")], []]
    return rows.groupingSets(sets, "source", "label").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("label", F.lit("*")).alias("label"), "n")


@query("rollup_hours", """
select coalesce(n_name, '*') as n_name, coalesce(o_orderstatus, '*') as o_orderstatus, count(*) as n_orders, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by rollup (n_name, o_orderstatus)""")
def rollup_hours(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    out = joined.rollup("n_name", "o_orderstatus").agg(F.count("*").alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return out.select(F.coalesce("n_name", F.lit("*")).alias("n_name"), F.coalesce("o_orderstatus", F.lit("*")).alias("o_orderstatus"), "n_orders", "total")


@query("recording_stats", """
select event_type, count(*) as total, count(*) filter (where value > 0) as successful, count(*) filter (where not value > 0) as failed,
  round(cast(sum(cast(value as decimal(18,2))) filter (where value > 0) as double) / 3600, 6) as hours,
  round(coalesce(cast(sum(cast(value as decimal(18,2))) filter (where value > 0) as double) / nullif(count(*) filter (where value > 0), 0), 0), 6) as mean_seconds
from events group by 1""")
def recording_stats(spark: SparkSession, d: str) -> DataFrame:
    good = F.col("value") > 0
    total = F.sum(F.when(good, F.col("value").cast("decimal(18,2)"))).cast("double")
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("total"), F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"),
        F.round(total / 3600, 6).alias("hours"), F.round(N.ratio(total, F.count_if(good)), 6).alias("mean_seconds"),
    )


_STATE_SQL = """
(select cast(user_id as varchar) as uuid, max(case when event_type = 'purchase' and value > 90 then 1 else 0 end) as done, count(*) filter (where event_type = 'error') as attempts,
  max(case when event_type = 'view' then event_id end) as last_start, max(case when event_type = 'error' or (event_type = 'purchase' and value > 90) then event_id end) as last_end from events group by 1)"""
_KIND_SQL = "case when done = 1 then 'completed' when attempts >= 12 then 'failed' when last_start > coalesce(last_end, -1) then 'in_progress' else 'retry' end"


def checkpoint_events(spark: SparkSession, d: str) -> DataFrame:
    """Starts, failures and completions of each key, made from the events."""
    kind = F.when((F.col("event_type") == "purchase") & (F.col("value") > 90), "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "started")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("uuid"), kind.alias("kind"), F.col("event_id").alias("seq"), "ts").na.fill({"kind": "other"})


@query("retry_state_machine", f"select uuid, {_KIND_SQL} as state, case when done = 1 then 0 else attempts end as attempts from {_STATE_SQL}")
def retry_state_machine(spark: SparkSession, d: str) -> DataFrame:
    return L.checkpoint_state(checkpoint_events(spark, d), 12)


@query("checkpoint_progress", f"""
select cast(count(*) filter (where state = 'completed') as bigint) as completed, cast(count(*) filter (where state = 'failed') as bigint) as failed, cast(count(*) filter (where state = 'in_progress') as bigint) as in_progress,
  cast(count(*) filter (where state = 'completed') + sum(attempts) as bigint) as total_attempted from (select {_KIND_SQL} as state, case when done = 1 then 0 else attempts end as attempts from {_STATE_SQL})""")
def checkpoint_progress(spark: SparkSession, d: str) -> DataFrame:
    state = L.checkpoint_state(checkpoint_events(spark, d), 12)
    n = lambda s: F.count_if(F.col("state") == s)
    return state.agg(n("completed").alias("completed"), n("failed").alias("failed"), n("in_progress").alias("in_progress"), (n("completed") + F.sum("attempts")).alias("total_attempted"))


@query("remaining_keys", f"select uuid from {_STATE_SQL} where {_KIND_SQL} not in ('completed', 'failed')")
def remaining_keys(spark: SparkSession, d: str) -> DataFrame:
    events = checkpoint_events(spark, d)
    return L.remaining(events.select("uuid").distinct(), L.checkpoint_state(events, 12))


@query("storage_estimate", """
select count(*) as stations, round(coalesce(avg(case when p_size > 0 then p_size end), 128), 6) as mean_kbps, round(count(*) * 1800.0 * 16000 * 2 / pow(1024, 3), 6) as pcm_gb,
  round(count(*) * 1800.0 * 16000 * 2 / pow(1024, 3) * 0.5, 6) as flac_gb, round(1800 * (coalesce(avg(case when p_size > 0 then p_size end), 128) * 1000 / 8) * count(*) / pow(1024, 3), 6) as mp3_gb,
  round(ceil(count(*) / 50.0) * 1800 / 3600, 6) as finish_hours from part""")
def storage_estimate(spark: SparkSession, d: str) -> DataFrame:
    n, kbps = F.count("*"), F.coalesce(F.avg(F.when(F.col("p_size") > 0, F.col("p_size"))), F.lit(128.0))
    pcm = n * 1800.0 * 16000 * 2 / float(1024**3)
    return table(spark, d, "part").agg(
        n.alias("stations"), F.round(kbps, 6).alias("mean_kbps"), F.round(pcm, 6).alias("pcm_gb"), F.round(pcm * 0.5, 6).alias("flac_gb"),
        F.round(1800 * (kbps * 1000 / 8) * n / float(1024**3), 6).alias("mp3_gb"), F.round(F.ceil(n / 50.0) * 1800 / 3600, 6).alias("finish_hours"),
    )


@query("source_union", """
select source, count(*) as n, cast(sum(length(text)) as bigint) as chars from (
  select 'documents' as source, text from documents union all select 'conversations', text from conversations union all select 'benchmark', text from benchmark) group by 1""")
def source_union(spark: SparkSession, d: str) -> DataFrame:
    rows, failed = readers.union_sources({name: (lambda name=name: table(spark, d, name).select("text")) for name in ("documents", "conversations", "benchmark")})
    if failed:
        raise RuntimeError(str(failed))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("counter_map_json", """
select source, '{' || string_agg('"' || lang || '":' || n, ',' order by lang) || '}' as counts_json from (select source, lang, count(*) as n from documents group by all) group by source""")
def counter_map_json(spark: SparkSession, d: str) -> DataFrame:
    return sinks.counter_json(table(spark, d, "documents"), ["source"], "lang")


@query("package_summary", "select count(*) as rows, count(distinct source) as sources, count(distinct lang) as countries, round_even(sum(n_chars)::double / 3600, 6) as hours, cast(sum(strlen(text)) as bigint) as bytes from documents")
def package_summary(spark: SparkSession, d: str) -> DataFrame:
    return sinks.package_summary(table(spark, d, "documents"), "source", "lang", F.col("n_chars"), F.encode("text", "UTF-8"))


@query("late_materialized_fetch", f"""
select doc_id, rn, score, length(text) as chars from (select *, row_number() over (partition by lang order by score desc, doc_id) as rn from {SCORED_SQL}) where rn <= 2""")
def late_materialized_fetch(spark: SparkSession, d: str) -> DataFrame:
    narrow = scored(spark, d).select("doc_id", "lang", "score")
    chosen = R.top_per_group(narrow, ["lang"], [F.col("score").desc(), F.col("doc_id")], 2)
    wide = table(spark, d, "documents").select("doc_id", "text")
    return R.late_fetch(wide, chosen, "doc_id", "rn", "score").select("doc_id", F.col("rn").cast("long").alias("rn"), "score", F.length("text").cast("long").alias("chars"))


@query("set_operations", """
select 'union' as op, count(*) as n from (select user_id from events where event_type = 'view' union select user_id from events where event_type = 'error')
union all select 'intersect', count(*) from (select user_id from events where event_type = 'view' intersect select user_id from events where event_type = 'error')
union all select 'except', count(*) from (select c_custkey from customer except select user_id from events where event_type = 'error')""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    a, b = (events.where(F.col("event_type") == x).select("user_id") for x in ("view", "error"))
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": keys.subtract(b)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("star_revenue", """
select n_name, year(o_orderdate) as order_year, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18,4))) as double) as revenue
from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where r_name = 'ASIA' group by all""")
def star_revenue(spark: SparkSession, d: str) -> DataFrame:
    li, o, s, n, r = (table(spark, d, x) for x in ("lineitem", "orders", "supplier", "nation", "region"))
    joined = (
        li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"])
        .join(r, n["n_regionkey"] == r["r_regionkey"]).where("r_name = 'ASIA'")
    )
    revenue = F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("double")
    return joined.groupBy("n_name", F.year("o_orderdate").alias("order_year")).agg(revenue.alias("revenue")).select("n_name", F.col("order_year").cast("long").alias("order_year"), "revenue")


@query("running_share", """
select source, lang, n, round(n::double / sum(n) over (partition by source), 6) as share, cast(rank() over (partition by source order by n desc) as bigint) as rank_in_source
from (select source, lang, count(*) as n from documents group by all)""")
def running_share(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source")
    return counts.select("source", "lang", "n", F.round(F.col("n") / F.sum("n").over(by), 6).alias("share"), F.rank().over(by.orderBy(F.desc("n"))).cast("long").alias("rank_in_source"))
