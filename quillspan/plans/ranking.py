"""Deduplication, interleaving, sampling, splitting and sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import grouping
from quillspan.operators import metrics as M
from quillspan.operators import rank as R
from quillspan.plans.registry import query, table


@query("dedup_keep_best", """
select host, page_id, votes from (select *, row_number() over (partition by host order by votes desc, page_id) as rn from (
  select page_id, length(html) as votes, regexp_extract(url, '://([^/?#]*)', 1) as host from pages) where trim(host) <> '') where rn = 1""")
def dedup_keep_best(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("votes"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return R.keep_best(pages, F.trim("host"), [F.col("votes").desc(), F.col("page_id")]).select("host", "page_id", "votes")


@query("best_per_group", "select lang, doc_id, n_chars from (select *, row_number() over (partition by lang order by n_chars desc, doc_id) as rn from documents) where rn = 1")
def best_per_group(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", "doc_id", "n_chars")
    return R.top_per_group(docs, ["lang"], [F.col("n_chars").desc(), F.col("doc_id")]).drop("rn")


@query("best_per_group_composite", """
select s_nationkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice from (
  select s_nationkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, row_number() over (partition by s_nationkey order by l_quantity desc, l_extendedprice desc, l_orderkey, l_linenumber) as rn
  from lineitem join supplier on l_suppkey = s_suppkey) where rn = 1""")
def best_per_group_composite(spark: SparkSession, d: str) -> DataFrame:
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    rows = li.join(s, li["l_suppkey"] == s["s_suppkey"]).select("s_nationkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return R.top_per_group(rows, ["s_nationkey"], [F.desc("l_quantity"), F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]).drop("rn")


@query("round_robin_interleave", """
select event_id, user_id, row_number() over (order by turn, user_id) as pos from (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as turn from events)""")
def round_robin_interleave(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "ts")
    return R.interleave(rows, "user_id", [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", F.col("pos").cast("long").alias("pos"))


_SPLIT_SQL = """
(select doc_id, lang, case when rn <= round_even(n * 0.7, 0) then 'train' when rn <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) then 'val' else 'test' end as split from (
  select doc_id, lang, row_number() over (partition by lang order by md5('917|' || doc_id), doc_id) as rn, count(*) over (partition by lang) as n from documents))"""


def _split(spark: SparkSession, d: str) -> DataFrame:
    return R.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.7, 0.15, 0.15, 917)


@query("stratified_split", f"select * from {_SPLIT_SQL}")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d)


@query("split_label_counts", f"""
select v.lang, count(s.doc_id) filter (where split = 'train') as train, count(s.doc_id) filter (where split = 'val') as val, count(s.doc_id) filter (where split = 'test') as test
from (values ('de'), ('en'), ('es'), ('fr'), ('xx')) v(lang) left join {_SPLIT_SQL} s on s.lang = v.lang group by 1""")
def split_label_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = _split(spark, d).groupBy("lang").agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")])
    return M.vocabulary(spark, ["de", "en", "es", "fr", "xx"], "lang").join(counts, "lang", "left").na.fill(0)


@query("oversample_minority", """
with c as (select lang, count(*) as n from documents group by 1), t as (select cast(floor(n * 0.5) as bigint) as t from c where lang = 'en'),
w as (select lang, n, greatest(0, least((select t from t), n * 3) - n) as extra from c where lang <> 'en'),
e as (select lang, n, unnest(range(1, extra + 1)) as copy from w where extra > 0),
r as (select doc_id, lang, row_number() over (partition by lang order by md5('934|' || doc_id), doc_id) as rn from documents)
select doc_id, lang, cast(0 as bigint) as copy from documents union all
select r.doc_id, r.lang, e.copy from e join r on r.lang = e.lang and r.rn = cast(('0x' || substr(md5('934|' || e.lang || '|' || e.copy), 1, 8)) as bigint) % e.n + 1""")
def oversample_minority(spark: SparkSession, d: str) -> DataFrame:
    return R.oversample(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", "en", 0.5, 3, 934)


@query("cap_per_source", "select doc_id, source from (select *, row_number() over (partition by source order by md5('948|' || doc_id), doc_id) as rn from documents) where rn <= 10 or source = 'src0'")
def cap_per_source(spark: SparkSession, d: str) -> DataFrame:
    return R.cap_per_source(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 10, 948, ["src0"])


@query("sample_k_per_label", "select vec_id, label from (select *, row_number() over (partition by label order by md5('5|' || vec_id), vec_id) as rn from embeddings) where rn <= 3")
def sample_k_per_label(spark: SparkSession, d: str) -> DataFrame:
    return R.sample_per_group(table(spark, d, "embeddings").select("vec_id", "label"), ["label"], "vec_id", 3, 5)


@query("deterministic_shuffle", "select doc_id, row_number() over (order by md5('917|' || doc_id), doc_id) as pos from documents")
def deterministic_shuffle(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id").withColumn("h", R.hash_order(917, F.col("doc_id")))
    return R.shard_numbers(docs, [F.col("h"), F.col("doc_id")], 1, "pos").select("doc_id", (F.col("pos") + 1).alias("pos"))


@query("shard_assignment", "select doc_id, cast((row_number() over (order by doc_id) - 1) // 128 as bigint) as shard from documents")
def shard_assignment(spark: SparkSession, d: str) -> DataFrame:
    return R.shard_numbers(table(spark, d, "documents").select("doc_id"), [F.col("doc_id")], 128)


@query("order_statistics_by_index", """
with s as (select list(n_chars order by n_chars) as v, count(*) as n, sum(n_chars) as total from documents)
select v[1] as min, v[n // 2 + 1] as p50, v[cast(floor((n - 1) * 0.95) as bigint) + 1] as p95, v[n] as max, round(total::double / 3600, 6) as total_hours from s""")
def order_statistics_by_index(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("n_chars")
    at = {"min": lambda n: F.lit(0), "p50": lambda n: F.floor(n / 2), "p95": lambda n: F.floor((n - 1) * F.lit(0.95)), "max": lambda n: n - 1}
    return R.order_statistics(docs, "n_chars", at).withColumn("total_hours", docs.agg(F.round(F.sum("n_chars") / 3600, 6)).scalar())


def _item(k: int) -> str:
    """SQL for the k-th item of the group that starts at a row: whether it joins."""
    joins = f"s{k} is not null and size = {k - 1} and want <> {k - 1} and not ({k - 1} >= 2 and (lasts >= 28 or lasts + (s{k} + 0.08) > 55))"
    return f"g{k} as (select * replace (case when {joins} then {k} else size end as size, case when {joins} then lasts + (s{k} + 0.08) else lasts end as lasts) from g{k - 1})"


@query("bin_pack_groups", f"""
with recursive r as (select doc_id, n_chars / 200.0::double as s1, 2 + cast('0x' || substr(md5('917|want|' || doc_id), 1, 8) as bigint) % 5 as want, row_number() over (order by md5('917|' || doc_id), doc_id) as pos from documents where n_chars / 200.0::double between 0.35 and 20),
g1 as (select *, 1 as size, s1 as lasts, {", ".join(f"lead(s1, {k - 1}) over (order by pos) as s{k}" for k in range(2, 7))} from r), {", ".join(_item(k) for k in range(2, 7))},
c as (select pos, size, 0 as group_no from g6 where pos = 1 union all select g.pos, g.size, c.group_no + 1 from c join g6 g on g.pos = c.pos + c.size)
select cast(group_no as bigint) as group_no, cast(r.pos - c.pos as bigint) as item_no, doc_id, s1 as seconds from c join r on r.pos between c.pos and c.pos + c.size - 1 where size >= 2""")
def bin_pack_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 200.0).alias("seconds")).where(F.col("seconds").between(0.35, 20.0))
    return grouping.pack_groups(docs, "doc_id", "seconds", 917)


@query("top_stations", "select page_id, votes, host from (select page_id, length(html) as votes, regexp_extract(url, '://([^/?#]*)', 1) as host from pages) where votes >= 100 order by votes desc, page_id limit 25")
def top_stations(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("votes"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return pages.where("votes >= 100").orderBy(F.desc("votes"), "page_id").limit(25)


@query("path_sources", "select regexp_extract(url, '://([^/?#]*)', 1) as host, case when strpos(url, '/') > 0 then split_part(url, '/', 1) else 'unknown' end as scheme, count(*) as n from pages group by all")
def path_sources(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return pages.groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), T.path_source(F.col("url")).alias("scheme")).agg(F.count("*").alias("n"))
