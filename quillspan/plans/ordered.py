"""Runs, islands, frames, intervals, matches and metrics over ordered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import boundaries as B
from quillspan.operators import metrics as M
from quillspan.operators import sequential
from quillspan.operators import signal as G
from quillspan.operators.scan import scan
from quillspan.plans.registry import query, table
from quillspan.plans.relational import SCORED_SQL, scored
from quillspan.streaming import ingest

_POS = "(select user_id, event_id, event_type, value, ts, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events)"


def _pos(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], sums={"n": F.lit(1)})
    return rows.select("user_id", "event_id", "event_type", "value", "ts", (F.col("n") - 1).alias("pos"))


@query("boundary_events_islands", f"""
with a as (select user_id, pos, value, pos - row_number() over (partition by user_id order by pos) as island from {_POS} where value >= 60),
m as (select user_id, pos, value, count(*) over (partition by user_id, island) as frames, row_number() over (partition by user_id, island order by value desc, pos) as rn from a)
select user_id, pos, value, frames from m where rn = 1""")
def boundary_events_islands(spark: SparkSession, d: str) -> DataFrame:
    return G.island_peaks(_pos(spark, d), ["user_id"], "pos", "value", 60.0)


@query("leading_run_silence", f"""
select user_id, cast(coalesce(min(case when value > 40 then pos end), count(*)) as bigint) as run from {_POS} group by 1""")
def leading_run_silence(spark: SparkSession, d: str) -> DataFrame:
    return G.leading_run(_pos(spark, d), ["user_id"], [F.col("pos")], F.col("value") > 40)


@query("silence_around_boundaries", f"""
with f as (select user_id, pos / 10.0 as t, value as rms from {_POS}), b as (select user_id, pos as boundary_id, pos / 10.0 as mark from {_POS} where pos % 8 = 4),
n as (select b.user_id, boundary_id, mark, t, rms from b join f on f.user_id = b.user_id and abs(t - mark) <= 0.85),
a as (select user_id, boundary_id, mark, count(*) as n, min(case when rms > 50 then t end) as loud from n where t >= mark group by all),
z as (select user_id, boundary_id, mark, max(case when rms > 50 then t end) as loud from n where t <= mark group by all)
select b.user_id, b.boundary_id, (select count(*) from n where n.user_id = b.user_id and n.boundary_id = b.boundary_id and n.t <= n.mark and n.t > coalesce(z.loud, -1)) * 10.0::double as pause_before_ms,
  (select count(*) from n where n.user_id = b.user_id and n.boundary_id = b.boundary_id and n.t >= n.mark and n.t < coalesce(a.loud, 1e9)) * 10.0::double as pause_after_ms
from b left join a using (user_id, boundary_id) left join z using (user_id, boundary_id)""")
def silence_around_boundaries(spark: SparkSession, d: str) -> DataFrame:
    rows = _pos(spark, d)
    frames = rows.select("user_id", (F.col("pos") / 10.0).alias("t"), F.col("value").alias("rms"))
    at = rows.where("pos % 8 = 4").select("user_id", F.col("pos").alias("boundary_id"), (F.col("pos") / 10.0).alias("at"))
    return G.silence_around(frames, at, "user_id", 50.0, reach=0.85)


@query("sliding_rms", f"""
select user_id, pos, round(rms, 6) as rms from (select user_id, pos, count(*) over w as n, sqrt(avg(value * value) over w) as rms from {_POS} window w as (partition by user_id order by pos rows between current row and 4 following))
where pos % 2 = 0 and n = 5""")
def sliding_rms(spark: SparkSession, d: str) -> DataFrame:
    out = G.sliding_rms(_pos(spark, d), ["user_id"], "pos", "value", 5, 2)
    return out.select("user_id", "pos", F.round("rms", 6).alias("rms"))


@query("tumbling_chunks", f"select user_id, cast(pos // 10 as bigint) as chunk, count(*) as n, round(sum(value), 4) as total from {_POS} group by all having count(*) >= 3")
def tumbling_chunks(spark: SparkSession, d: str) -> DataFrame:
    return G.tumbling(_pos(spark, d), ["user_id"], "pos", 10, 3, [F.round(F.sum("value"), 4).alias("total")])


@query("silence_threshold_stats", """
with s as (select user_id, quantile_cont(value, 0.2) as p20, median(value) as p50, avg(value) as mean_rms, max(value) as peak from events group by 1),
t as (select *, greatest(p20 * 1.5, p50 * 0.25, 1e-4) as threshold from s)
select t.user_id, round(max(threshold), 6) as threshold, round(avg(case when value <= threshold then 1.0 else 0.0 end), 6) as silence_ratio, round(max(20 * log10(greatest(mean_rms, 1e-8))), 6) as mean_rms_db, round(max(20 * log10(greatest(peak, 1e-8))), 6) as peak_db
from t join events e on e.user_id = t.user_id group by 1""")
def silence_threshold_stats(spark: SparkSession, d: str) -> DataFrame:
    out = G.silence_stats(table(spark, d, "events").select("user_id", "value"), ["user_id"], "value")
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("threshold", "silence_ratio", "mean_rms_db", "peak_db")])


@query("interval_pairing", f"""
with k as (select user_id, pos, value, event_type, lead(event_type) over (partition by user_id order by pos) as nk, lead(pos) over (partition by user_id order by pos) as np from {_POS} where event_type in ('view', 'error'))
select user_id, pos as interval_start, case when nk = 'error' then np when nk is null then 1000 end as interval_end from k where event_type = 'view' and (nk = 'error' or nk is null)""")
def interval_pairing(spark: SparkSession, d: str) -> DataFrame:
    return G.pair_intervals(_pos(spark, d), ["user_id"], [F.col("pos")], "event_type", "pos", "view", "error", F.lit(1000).cast("long"))


@query("boundary_target_expand", f"""
with p as (select *, count(*) over (partition by user_id) as n from {_POS}), e as (select user_id, pos, n from p where value >= 90) select distinct user_id, cast(unnest(range(greatest(0, pos - 2), least(n - 1, pos + 2) + 1)) as bigint) as frame from e""")
def boundary_target_expand(spark: SparkSession, d: str) -> DataFrame:
    rows = _pos(spark, d)
    sizes = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    rows = rows.where("value >= 90").join(sizes, "user_id")
    return G.spread_targets(rows, ["user_id"], "pos", "n", 2)


@query("fraction_frames", f"select user_id, event_id, cast(least(99, greatest(0, round_even(value / 100 * 99, 0))) as bigint) as frame from {_POS}")
def fraction_frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", G.frame_of(F.col("value") / 100, F.lit(100)).alias("frame"))


@query("running_offsets", """
select conv_id, turn, end_at - length(text) as start_at, end_at from (select conv_id, turn, text, cast(sum(length(text) + 8) over (partition by conv_id order by turn rows unbounded preceding) - 8 as bigint) as end_at from conversations)""")
def running_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return G.running_offsets(rows, ["conv_id"], "turn", "n", 8).select("conv_id", "turn", "start_at", "end_at")


@query("even_timed_words", r"""
with w as (select conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from conversations),
e as (select conv_id, turn, len(w) as n, unnest(w) as word, unnest(range(len(w))) as word_index from w)
select conv_id, turn, word, cast(word_index as int) as word_index, round(10.0 * word_index / n, 6) as start_seconds, round(10.0 * (word_index + 1) / n, 6) as end_seconds from e""")
def even_timed_words(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.lit(10.0).alias("seconds"))
    return G.even_words(rows, ["conv_id", "turn"], "text", "seconds").select("conv_id", "turn", "word", "word_index", *[F.round(c, 6).alias(c) for c in ("start_seconds", "end_seconds")])


@query("token_times_to_words", r"""
with c as (select conv_id, turn, unnest(string_split(text, '')) as c, unnest(range(len(string_split(text, '')))) as i, length(text) as n from conversations where text <> ''),
t as (select *, i // 6 as token, least(6, n - (i // 6) * 6) as size from c),
w as (select *, regexp_matches(c, '\s') as blank, (token + (i % 6)::double / size) * 0.5 as a, (token + (i % 6 + 1)::double / size) * 0.5 as b from t),
g as (select *, sum(blank::int) over (partition by conv_id, turn order by i) as word from w),
x as (select conv_id, turn, word, string_agg(c, '' order by i) as text, min(a) as a, max(b) as b from g where not blank group by all)
select conv_id, turn, text as word, cast(row_number() over (partition by conv_id, turn order by word) - 1 as int) as word_index, round_even(a, 3) as start_seconds, round_even(b, 3) as end_seconds from x""")
def token_times_to_words(spark: SparkSession, d: str) -> DataFrame:
    """Six-character tokens of half a second each, joined back to words."""
    parts = F.regexp_extract_all("text", F.lit("((?s).{1,6})"), 0)
    rows = table(spark, d, "conversations").where("text <> ''").select("conv_id", "turn", F.posexplode(parts).alias("pos", "token"))
    timed = rows.withColumn("start", F.col("pos") * 0.5).withColumn("end", F.col("pos") * 0.5 + 0.5)
    return G.chars_to_words(timed, ["conv_id", "turn"], "pos", "token", "start", "end")


@query("embedding_pooling", """
select label, cast(dim as int) as dim, round(avg(x), 5) as mean, round(stddev_pop(x), 5) as std, round(max(x), 5) as max from (
  select label, unnest(range(64)) as dim, cast(unnest(embedding) as double) as x from embeddings) group by all""")
def embedding_pooling(spark: SparkSession, d: str) -> DataFrame:
    out = G.pool_embeddings(table(spark, d, "embeddings"), ["label"], "embedding")
    return out.select("label", "dim", *[F.round(c, 5).alias(c) for c in ("mean", "std", "max")])


_PRED = "case when vec_id % 7 = 0 then (label + 1) % 10 when vec_id % 11 = 0 then 3 else label end"


def _pred(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.expr(_PRED).cast("int").alias("pred"))


_PRF_SQL = f"""
(select v.label, t.tp, t.fp, t.fn, t.support, t.precision, t.recall, case when t.precision + t.recall > 0 then 2 * t.precision * t.recall / (t.precision + t.recall) else 0 end as f1 from range(12) v(label),
 lateral (select count(*) filter (where e.label = v.label and p = v.label) as tp, count(*) filter (where e.label <> v.label and p = v.label) as fp, count(*) filter (where e.label = v.label and p <> v.label) as fn,
   count(*) filter (where e.label = v.label) as support, coalesce(count(*) filter (where e.label = v.label and p = v.label)::double / nullif(count(*) filter (where p = v.label), 0), 0) as precision,
   coalesce(count(*) filter (where e.label = v.label and p = v.label)::double / nullif(count(*) filter (where e.label = v.label), 0), 0) as recall from (select label, {_PRED} as p from embeddings) e) t)"""


@query("prf_report", f"select cast(label as int) as label, tp, fp, fn, support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from {_PRF_SQL}")
def prf_report(spark: SparkSession, d: str) -> DataFrame:
    out = M.prf(_pred(spark, d), "label", "pred", list(range(12)))
    return out.select("label", "tp", "fp", "fn", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("prf_summary", f"""
select round(sum(tp)::double / sum(support), 6) as accuracy, round(avg(f1), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1, round(max(support)::double / sum(support), 6) as majority_accuracy from {_PRF_SQL}""")
def prf_summary(spark: SparkSession, d: str) -> DataFrame:
    out = M.summary(M.prf(_pred(spark, d), "label", "pred", list(range(12))))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("confusion_vocab_counts", f"select cast(label as int) as truth, cast({_PRED} as int) as pred, count(*) as n from embeddings group by all")
def confusion_vocab_counts(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(_pred(spark, d), "label", "pred").select(F.col("t").alias("truth"), F.col("p").alias("pred"), "n")


@query("class_weights", """
with c as (select cast(v.label as int) as label, count(e.label) as n from range(12) v(label) left join embeddings e on e.label = v.label group by 1), r as (select label, n, pow(sum(n) over () / (12 * greatest(1, n)), 0.5) as raw from c)
select label, n, round(raw / avg(raw) over (), 6) as weight from r""")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    out = M.class_weights(table(spark, d, "embeddings").select("label"), "label", list(range(12)), 0.5)
    return out.select("label", "n", F.round("weight", 6).alias("weight"))


@query("threshold_sweep_best", f"""
with s as (select score, quality = 0 as y from {SCORED_SQL} where quality is not null), t as (select unnest([0.3, 0.4, 0.5, 0.6, 0.7])::double as threshold),
m as (select threshold, count(*) filter (where score >= threshold and y) as tp, count(*) filter (where score >= threshold) as predicted, count(*) filter (where y) as support from t, s group by 1),
p as (select *, coalesce(tp::double / nullif(predicted, 0), 0) as precision, coalesce(tp::double / nullif(support, 0), 0) as recall from m),
f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from p)
select threshold, tp, predicted, support, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from f order by f1 desc, recall desc, precision desc, threshold limit 1""")
def threshold_sweep_best(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).where("quality is not null")
    best = M.best_threshold(M.threshold_sweep(rows, F.col("score"), F.col("quality") == 0, [0.3, 0.4, 0.5, 0.6, 0.7]))
    return best.select("threshold", "tp", "predicted", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("interval_match_candidates", f"""
with p as (select * from {_POS}) select r.user_id, r.pos as ref, q.pos as pred, abs(r.pos - q.pos) as distance from p r join p q on q.user_id = r.user_id and q.pos between r.pos - 3 and r.pos + 3
where r.event_type = 'view' and q.event_type = 'error'""")
def interval_match_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = _pos(spark, d)
    r = rows.where("event_type = 'view'").select("user_id", F.col("pos").alias("ref"))
    q = rows.where("event_type = 'error'").select("user_id", F.col("pos").alias("pred"))
    return G.near_join(r, q, ["user_id"], "ref", "pred", 3).select("user_id", "ref", "pred", F.abs(F.col("ref") - F.col("pred")).alias("distance"))


_MATCH_SQL = """
e as (select {keys}, coalesce(list(pos order by pos) filter (where is_ref), []) as refs, coalesce(list(pos order by pos) filter (where not is_ref), []) as preds from ev group by all),
m as (select {keys}, 0 as k, refs, preds, []::bigint[] as used, null::bigint as ref, null::bigint as pred from e union all
  select {keys}, k + 1, refs, preds, case when b is null then used else list_append(used, b) end, case when b is null then null else refs[k + 1] end, b from (
    select *, list_min(list_transform(list_filter(preds, lambda p: abs(p - refs[k + 1]) <= {tolerance} and not list_contains(used, p)), lambda p: {{'d': abs(p - refs[k + 1]), 'p': p}})).p as b from m where k < len(refs)))"""


@query("interval_match_tolerance", f"""
with recursive ev as (select user_id, pos, event_type = 'view' as is_ref from {_POS} where event_type in ('view', 'error')), {_MATCH_SQL.format(keys='user_id', tolerance=3)}
select user_id, ref, pred from m where pred is not null""")
def interval_match_tolerance(spark: SparkSession, d: str) -> DataFrame:
    rows = _pos(spark, d).where("event_type in ('view', 'error')")
    return sequential.match_events(rows.select("user_id", "pos", (F.col("event_type") == "view").alias("is_ref")), ["user_id"], 3)


_SWEEP = (30.0, 60.0, 90.0)


_SWEEP_SQL = f"""
with recursive t as (select unnest([30.0, 60.0, 90.0])::double as threshold),
act as (select threshold, user_id, pos, value, pos - row_number() over (partition by threshold, user_id order by pos) as island from {_POS}, t where value >= threshold),
pk as (select threshold, user_id, pos, row_number() over (partition by threshold, user_id, island order by value desc, pos) as rn from act),
ev as (select threshold, user_id, pos, false as is_ref from pk where rn = 1 union all select threshold, user_id, pos, true from {_POS}, t where event_type = 'error'),
{_MATCH_SQL.format(keys='threshold, user_id', tolerance=2)},
c as (select threshold, count(*) filter (where is_ref) as reference_boundaries, count(*) filter (where not is_ref) as predicted_boundaries from ev group by 1),
h as (select threshold, count(pred) as matched_boundaries from m group by 1),
r as (select *, coalesce(matched_boundaries::double / nullif(predicted_boundaries, 0), 0) as precision, coalesce(matched_boundaries::double / nullif(reference_boundaries, 0), 0) as recall from c join h using (threshold))
select threshold, reference_boundaries, predicted_boundaries, matched_boundaries, round(precision, 6) as precision, round(recall, 6) as recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) as f1 from r"""


@query("boundary_sweep", _SWEEP_SQL)
def boundary_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = _pos(spark, d)
    out = B.boundary_metrics(rows.select("user_id", "pos", "value"), rows.where("event_type = 'error'").select("user_id", "pos"), ["user_id"], "pos", "value", _SWEEP, 2)
    return out.select("threshold", "reference_boundaries", "predicted_boundaries", "matched_boundaries", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("boundary_best", f"select * from ({_SWEEP_SQL}) order by f1 desc, recall desc, precision desc, threshold limit 1")
def boundary_best(spark: SparkSession, d: str) -> DataFrame:
    """The sweep's best row by F1, recall and precision, the lowest threshold on ties."""
    return M.best_threshold(boundary_sweep(spark, d))


_UNITS = "(select user_id, pos as unit_no, pos / 10.0 as start_seconds, (pos + 6) / 10.0 as end_seconds, cast(pos as int) as start_word_index, cast(pos + event_id % 5 as int) as end_word_index_exclusive from {} where pos % 8 = 4)"


@query("prosody_labels", f"""
with f as (select user_id, pos / 10.0 as t, value as rms from {_POS}), u as {_UNITS.format(_POS)},
s as (select user_id, greatest(quantile_cont(rms, 0.2) * 1.5, median(rms) * 0.25, 1e-4) as threshold, avg(rms) as mean_rms from f group by 1),
g as (select u.user_id, unit_no, avg(rms) as m from u join f on f.user_id = u.user_id and t between start_seconds and end_seconds group by all),
n as (select u.user_id, unit_no, side, spot, t, rms > threshold as loud from (select *, 'before' as side, start_seconds as spot from u union all select *, 'after', end_seconds from u) u join f on f.user_id = u.user_id and abs(t - spot) <= 0.8
  and (side = 'before' and t <= spot or side = 'after' and t >= spot) join s on s.user_id = u.user_id),
r as (select user_id, unit_no, side, count(*) filter (where dist < coalesce(stop, 1e9)) * 10.0::double as ms from (select *, abs(t - spot) as dist, min(case when loud then abs(t - spot) end) over (partition by user_id, unit_no, side) as stop from n) group by all),
w as (select u.*, coalesce(b.ms, 0) as pause_before_ms, coalesce(a.ms, 0) as pause_after_ms, coalesce(m, mean_rms) as energy from u join s using (user_id) left join g using (user_id, unit_no)
  left join r b on b.user_id = u.user_id and b.unit_no = u.unit_no and b.side = 'before' left join r a on a.user_id = u.user_id and a.unit_no = u.unit_no and a.side = 'after')
select user_id, unit_no, round_even(greatest(end_seconds - start_seconds, 0.01), 3) as unit_seconds, greatest(0, end_word_index_exclusive - start_word_index) as word_count,
  round_even(greatest(0, end_word_index_exclusive - start_word_index) / greatest(end_seconds - start_seconds, 0.01), 3) as speech_rate_wps, round_even(20 * log10(greatest(energy, 1e-8)), 2) as mean_energy_db,
  pause_before_ms, pause_after_ms, case when pause_after_ms >= 400 then 'major' when pause_after_ms >= 150 then 'minor' else 'continuing' end as strength from w""")
def prosody_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = _pos(spark, d)
    frames = rows.select("user_id", (F.col("pos") / 10.0).alias("t"), F.col("value").alias("rms"))
    units = rows.where("pos % 8 = 4").select(
        "user_id", F.col("pos").alias("unit_no"), (F.col("pos") / 10.0).alias("start_seconds"), ((F.col("pos") + 6) / 10.0).alias("end_seconds"),
        F.col("pos").cast("int").alias("start_word_index"), (F.col("pos") + F.col("event_id") % 5).cast("int").alias("end_word_index_exclusive"),
    )
    return B.prosody(frames, units, "user_id")


@query("events_tumbling", """
select strftime(time_bucket(interval 6 hour, ts, timestamp '2024-01-01'), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ingest.windowed(rows, "ts", "6 hours", None, ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "total")


@query("events_sliding", """
select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n from (select time_bucket(interval 6 hour, ts, timestamp '2024-01-01') - k * interval 6 hour as w from events, range(2) r(k)) group by 1""")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ingest.windowed(rows, "ts", "12 hours", "6 hours", [], [F.count("*").alias("n")])
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@query("events_session", """
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hour then 1 else 0 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, count(*) as n from s group by user_id, s""")
def events_session(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ingest.sessions(rows, "ts", "6 hours", ["user_id"], [F.count("*").alias("n")])
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")
