"""Text, date, number and JSON expressions on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import dates, vocab
from quillspan.functions import numbers as N
from quillspan.functions import sequences as S
from quillspan.functions import text as T
from quillspan.operators import sequential
from quillspan.plans.registry import query, table

BLANK = r"[ \t\n\r\f\v]+"


@query("text_clean", r"select doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) as clean_md5, length(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) as chars from documents")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    clean = T.collapse(F.col("text"), unicode=False)
    return table(spark, d, "documents").select("doc_id", F.md5(clean).alias("clean_md5"), F.length(clean).cast("long").alias("chars"))


@query("deep_clean", r"select doc_id, md5(trim(regexp_replace(nfc_normalize(text), '[ \t\n\r\f\v]+', ' ', 'g'))) as clean_md5 from documents")
def deep_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.deep_clean(F.col("text"))).alias("clean_md5"))


_WORDS_SQL = "list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?'), lambda x: lower(x))"


@query("tokenize_words", f"select doc_id, len(w) as n_words, len(list_distinct(w)) as n_distinct, md5(array_to_string(w, ' ')) as words_md5 from (select doc_id, {_WORDS_SQL} as w from documents)")
def tokenize_words(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("words_md5"))


_RAW = "case doc_id % 6 when 0 then 'xx, Engilsh' when 1 then 'O''neil-land' when 2 then '' when 3 then ' fr ' when 4 then 'nederland' else lang end"


@query("title_case_language", f"""
with r as (select doc_id, {_RAW} as raw from documents),
p as (select doc_id, raw, list_transform(string_split(raw, ','), lambda x: trim(lower(x))) as parts from r),
q as (select doc_id, raw, list_filter(list_transform(parts, lambda x: case x when 'engilsh' then 'English' when 'en' then 'English' when 'fr' then 'French' when 'de' then 'German' when 'es' then 'Spanish' end), lambda y: y is not null) as hits from p)
select doc_id, case when len(hits) > 0 then hits[1] when trim(raw) = 'O''neil-land' then 'O''Neil-Land' when trim(raw) = 'nederland' then 'Dutch' else trim(raw) end as language from q""")
def title_case_language(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr(_RAW.replace("'O''neil-land'", '"O\'neil-land"'))
    return table(spark, d, "documents").select("doc_id", T.collapse_language(T.canonical_language(raw)).alias("language"))


_SPELLINGS = list(vocab.LANGUAGE_SPELLINGS)


@query("language_spellings", f"""
with m as (select unnest({_SPELLINGS}) as spelling, unnest({list(vocab.LANGUAGE_SPELLINGS.values())}) as language, unnest(range({len(_SPELLINGS)})) as i)
select doc_id, language from documents join m on m.i = doc_id % {len(_SPELLINGS)}""")
def language_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling there is, in capitals behind a part that is none."""
    spelling = F.element_at(F.array(*[F.lit(x) for x in _SPELLINGS]), (F.col("doc_id") % len(_SPELLINGS) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", T.canonical_language(F.concat(F.lit("Xx, "), F.initcap(spelling))).alias("language"))


_TAGGED = "case conv_id % 4 when 0 then '<|joy|> ' || text when 1 then text || ' <|fear|> and <|anger|>' when 2 then '  <|sadness|>' else text end"
_TOK = r"<\|(?:neutral|low_quality|joy|surprise|sadness|anger|disgust|fear)\|>"


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.expr(_TAGGED).alias("t"))


@query("emotion_token_extract", f"""
select conv_id, turn, nullif(regexp_extract(t, '^\\s*({_TOK})', 1), '') as leading, nullif(regexp_extract(t, '{_TOK}'), '') as first_token, len(regexp_extract_all(t, '{_TOK}')) as n_tokens,
  trim(regexp_replace(regexp_replace(t, '{_TOK}', ' ', 'g'), '\\s+', ' ', 'g')) as body from (select conv_id, turn, {_TAGGED} as t from conversations)""")
def emotion_token_extract(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return _tagged(spark, d).select("conv_id", "turn", T.leading_token(t).alias("leading"), T.any_token(t).alias("first_token"), F.size(T.tokens_in(t)).cast("long").alias("n_tokens"), T.strip_tokens(t).alias("body"))


@query("token_placement", f"""
with r as (select conv_id, turn, t, nullif(regexp_extract(t, '{_TOK}'), '') as tok, trim(regexp_replace(regexp_replace(t, '{_TOK}', ' ', 'g'), '\\s+', ' ', 'g')) as body from (select conv_id, turn, {_TAGGED} as t from conversations))
select conv_id, turn, case when tok is null then t else trim(tok || ' ' || tok || ' ' || body) end as prefix2, case when tok is null then t else trim(body || ' ' || tok) end as suffix1,
  case when tok is null then t else trim(tok || ' ' || body || ' ' || tok) end as both1 from r""")
def token_placement(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return _tagged(spark, d).select("conv_id", "turn", T.place_token(t, "prefix", 2).alias("prefix2"), T.place_token(t, "suffix").alias("suffix1"), T.place_token(t, "both").alias("both1"))


@query("label_synonyms", """
select doc_id, case doc_id % 5 when 0 then '<|joy|>' when 1 then '<|low_quality|>' when 2 then '<|anger|>' when 3 then null else '<|surprise|>' end as token from documents""")
def label_synonyms(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("case doc_id % 5 when 0 then ' Happy' when 1 then 'bad-quality' when 2 then 'FRUSTRATED' when 3 then 'bored' else 'pleasant surprise' end")
    return table(spark, d, "documents").select("doc_id", T.token_of_label(raw).alias("token"))


_TAGS = "case doc_id % 4 when 0 then 'News, talk ,pop' when 1 then 'music,music,Rock' when 2 then null else 'noticias,,all news' end"
_NAME = "source || case doc_id % 3 when 0 then ' Info News' when 1 then ' Nachrichten' else '' end"


@query("news_score", """
select doc_id, case doc_id % 4 when 0 then 2 - 3 when 1 then -6 when 2 then 0 else 2 end + case doc_id % 3 when 0 then 4 when 1 then 2 else 0 end as score from documents""")
def news_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.news_score(F.expr(_NAME), F.expr(_TAGS)).cast("int").alias("score"))


@query("json_props_extract", """select event_type, cast(props->>'k' as bigint) % 10 as bucket, count(*) as n from events group by all""")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type", (k % 10).alias("bucket")).agg(F.count("*").alias("n"))


_LOG = """'Duration: 0' || page_id % 3 || ':1' || page_id % 7 || ':05.25, start' || chr(10) || '  Stream #0: Audio: mp3, ' || (16000 + page_id % 2 * 28100) || ' Hz, ' || case page_id % 3 when 0 then 'mono' when 1 then 'stereo' else '6 channels' end
 || chr(10) || 'silence_start: 1.5' || chr(10) || 'silence_end: ' || (page_id % 9 + 2) || '.25' || case when page_id % 2 = 0 then chr(10) || 'silence_start: 20.0' else '' end || chr(10) || 'max_volume: -' || (page_id % 40) || '.5 dB'"""


@query("html_log_regex", f"""
with r as (select page_id, {_LOG} as log from pages)
select page_id, cast(regexp_extract(log, 'Duration:\\s*(\\d{{2}}):(\\d{{2}}):(\\d{{2}}\\.\\d+)', 1) as double) * 3600 + cast(regexp_extract(log, 'Duration:\\s*(\\d{{2}}):(\\d{{2}}):(\\d{{2}}\\.\\d+)', 2) as double) * 60
    + cast(regexp_extract(log, 'Duration:\\s*(\\d{{2}}):(\\d{{2}}):(\\d{{2}}\\.\\d+)', 3) as double) as seconds,
  cast(regexp_extract(log, '(\\d+)\\s+Hz', 1) as int) as rate, case page_id % 3 when 0 then 1 when 1 then 2 else 6 end as channels,
  cast(page_id % 9 + 0.75 as double) as silence, cast(page_id % 9 + 0.75 + case when page_id % 2 = 0 then 5.0 else 0.0 end as double) as silence_closed,
  round(case when -(page_id % 40 + 0.5) <= -100 then 0 else pow(10, -(page_id % 40 + 0.5) / 20) end, 9) as peak from r""")
def html_log_regex(spark: SparkSession, d: str) -> DataFrame:
    log = F.col("log")
    rows = table(spark, d, "pages").select("page_id", F.expr(_LOG).alias("log"))
    return rows.select(
        "page_id", T.log_duration(log).alias("seconds"), T.log_sample_rate(log).alias("rate"), T.log_channels(log).alias("channels"),
        T.silence_seconds(log).alias("silence"), T.silence_seconds(log, F.lit(25.0)).alias("silence_closed"), F.round(N.linear(F.get(T.log_numbers(log, "max_volume"), F.lit(0))), 9).alias("peak"),
    )


@query("iso_date_parse", """
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as plain, case o_orderkey % 3 when 0 then 'unknown-date' else strftime(o_orderdate, '%Y-%m-%d') end as mixed,
  strftime(o_orderdate - interval 2 hour, '%Y-%m-%d %H:%M:%S') as utc from orders""")
def iso_date_parse(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    mixed = F.when(F.col("o_orderkey") % 3 == 0, F.lit("none")).when(F.col("o_orderkey") % 3 == 1, F.concat(stamp, F.lit("Z"))).otherwise(F.concat(stamp, F.lit("+05:00")))
    utc = F.date_format(dates.iso_timestamp(F.concat(stamp, F.lit("+02:00"))), "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "orders").select("o_orderkey", dates.iso_date(stamp).alias("plain"), dates.iso_date(mixed).alias("mixed"), utc.alias("utc"))


@query("lenient_math", """
select event_id, coalesce(try_cast(case event_id % 3 when 0 then '3.7' when 1 then '12' else 'x' end as double), 0) as as_double, round(20 * log10(greatest(value / 100, 1e-8)), 6) as db,
  case when value >= 400 then 'major' when value >= 150 then 'minor' else 'continuing' end as strength, cast(least(96, greatest(16, ceil(value * 1.6) + 8)) as int) as budget, round(greatest(0.0, least(50.0, value)), 6) as clamped from events""")
def lenient_math(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("case event_id % 3 when 0 then '3.7' when 1 then '12' else 'x' end")
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", N.lenient(raw, "double", 0.0).alias("as_double"), F.round(N.decibel(v / 100), 6).alias("db"), N.strength(v).alias("strength"),
        N.generation_budget(v, 1.6, 16, 96, 8).alias("budget"), F.round(N.clamp(v, 0.0, 50.0), 6).alias("clamped"),
    )


_ODD = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
#: SQL's distance goes by bytes: the tables' letters beyond ASCII become single bytes that no text holds, which keeps every distance by characters.
_PAIRS = f"""
(select conv_id, turn, translate(text, '{_ODD}', list_aggregate(list_transform(range(1, {len(_ODD)} + 3), lambda i: case when i in (9, 10) then '' else chr(i::int) end), 'string_agg', '')) as ref,
  translate(nxt, '{_ODD}', list_aggregate(list_transform(range(1, {len(_ODD)} + 3), lambda i: case when i in (9, 10) then '' else chr(i::int) end), 'string_agg', '')) as pred
 from (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as nxt from conversations) where nxt is not null)"""


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's whole text with that of the next."""
    from pyspark.sql import Window

    ahead = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").withColumn("nxt", ahead).where("nxt is not null").select("conv_id", "turn", F.col("text").alias("ref"), F.col("nxt").alias("pred"))


@query("char_error_rate", f"""
select conv_id, cast(sum(levenshtein(ref, pred)) as bigint) as edits, cast(sum(length(ref)) as bigint) as chars, round(coalesce(sum(levenshtein(ref, pred))::double / nullif(sum(length(ref)), 0), 0), 6) as cer from {_PAIRS} group by 1""")
def char_error_rate(spark: SparkSession, d: str) -> DataFrame:
    edits, chars = F.sum(F.levenshtein("ref", "pred").cast("long")), F.sum(F.length("ref").cast("long"))
    return turn_pairs(spark, d).groupBy("conv_id").agg(edits.alias("edits"), chars.alias("chars"), F.round(N.ratio(edits, chars), 6).alias("cer"))


def _turn_words(spark: SparkSession, d: str) -> DataFrame:
    return turn_pairs(spark, d).select("conv_id", "turn", T.words(F.col("ref")).alias("r"), T.words(F.col("pred")).alias("p"))


@query("word_error_rate")
def word_error_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = _turn_words(spark, d).select("conv_id", "turn", S.edit_distance(F.col("r"), F.col("p")).alias("edits"), F.size("r").alias("ref_words"), F.size("p").alias("pred_words"))
    wer = S.word_error_rate(F.col("edits"), F.col("ref_words"), F.col("pred_words"))
    return rows.select("conv_id", "turn", "edits", "ref_words", F.round(wer, 6).alias("wer"), S.quality_bucket(wer).alias("bucket"))


@query("token_lcs")
def token_lcs(spark: SparkSession, d: str) -> DataFrame:
    return turn_pairs(spark, d).select("conv_id", "turn", S.common_length(T.words(F.col("ref")), T.words(F.col("pred"))).alias("lcs"))


@query("span_alignment")
def span_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of a turn as units, aligned with the turn's own words at even times."""
    rows = table(spark, d, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("key"),
        F.transform(F.filter(F.split("text", r"[.\n]+"), lambda s: F.trim(s) != ""), T.words).alias("units"),
        T.words(F.col("text")).alias("words"), (F.length("text") / 15.0).alias("seconds"),
    )
    n = F.size("words")
    timed = rows.withColumn("starts", F.transform("words", lambda w, i: F.col("seconds") * i / n)).withColumn("ends", F.transform("words", lambda w, i: F.col("seconds") * (i + 1) / n))
    return sequential.align_units(timed, "key")


@query("asr_normalise", r"""
select doc_id, md5(trim(regexp_replace(translate(lower(trim(regexp_replace(regexp_replace(text, '<\|(?:neutral|low_quality|joy|surprise|sadness|anger|disgust|fear)\|>', ' ', 'g'), '\s+', ' ', 'g'))),
  '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+', ' ', 'g'))) as norm_md5 from documents""")
def asr_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.asr_normal(F.col("text"))).alias("norm_md5"))


@query("unit_split", r"""
select conv_id, turn, len(u) as n_units, coalesce(array_to_string(u, '|'), '') as units from (select conv_id, turn, list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(text || '!!!!! ' || role || ' <x> !!!!!!', '\s+', ' ', 'g')), '!{5,}'),
  lambda x: trim(x)), lambda y: y <> '') as u from conversations)""")
def unit_split(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("text", F.lit("!!!!! "), F.col("role"), F.lit(" <x> !!!!!!"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.split_units(raw).alias("u"))
    return rows.select("conv_id", "turn", F.size("u").cast("long").alias("n_units"), F.array_join("u", "|").alias("units"))


@query("acted_sources", """
select doc_id, case doc_id % 3 when 0 then 'Say the word ab cd.' when 1 then 'That is exactly what happened.' else 'Dogs are sitting by the door.' end as text, case doc_id % 3 when 1 then 'fear' else null end as emotion from documents""")
def acted_sources(spark: SparkSession, d: str) -> DataFrame:
    path = F.lit("x/OAF_ab-cd_angry.wav")
    text = F.when(F.col("doc_id") % 3 == 0, T.say_the_word(path)).when(F.col("doc_id") % 3 == 1, T.lookup(vocab.ACTED_SENTENCES, F.lit("TIE"))).otherwise(T.lookup(vocab.ACTED_STATEMENTS, F.lit("02")))
    return table(spark, d, "documents").select("doc_id", text.alias("text"), F.when(F.col("doc_id") % 3 == 1, T.lookup(vocab.ACTED_EMOTIONS, F.lit("FEA"))).alias("emotion"))
