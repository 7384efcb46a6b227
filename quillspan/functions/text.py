"""String expressions; each takes and gives Columns, and all but ``nfkc`` stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspan.functions import vocab


def lookup(values: Mapping[str, str], key: Column) -> Column:
    """The value of a literal map, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def falsy(c: Column, default: object) -> Column:
    """``c`` unless it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def collapse(c: Column, unicode: bool = True) -> Column:
    """White space runs to one space, ends trimmed; null is empty."""
    blank = r"(?U)\s+" if unicode else r"\s+"
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), blank, " "))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC with all but printing characters and white space dropped; Arrow batches, as no built-in normalises."""
    def one(x: str | None) -> str:
        return "".join(c for c in unicodedata.normalize("NFKC", x or "") if c.isprintable() or c.isspace())

    return s.map(one)


def deep_clean(c: Column) -> Column:
    """Windows-1252 quotes and dashes mended, NFKC, only printing characters, white space collapsed."""
    mended = F.translate(F.coalesce(c, F.lit("")), "\x91\x92\x93\x94\x96\x97", "''\"\"--")
    return collapse(nfkc(mended))


def words(c: Column) -> Column:
    """Lower-cased ASCII words, with one inner apostrophe at most."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(vocab.WORD_RE), F.lit(0)), F.lower)


def title_case(c: Column) -> Column:
    """A capital after each character that is not a letter, the rest lower: ``O'Neil-Land``."""
    pieces = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def canonical_language(c: Column, spellings: Mapping[str, str] = vocab.LANGUAGE_SPELLINGS) -> Column:
    """The first comma part that has a known spelling, else the whole in title case; callers may pass their own spellings."""
    known = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.element_at(known, collapse(F.lower(p))))
    return F.coalesce(F.get(F.filter(parts, lambda p: p.isNotNull()), F.lit(0)), title_case(F.trim(F.coalesce(c, F.lit("")))))


def collapse_language(c: Column, variants: Mapping[str, str] = vocab.LANGUAGE_COLLAPSE) -> Column:
    return F.coalesce(lookup(variants, c), c)


def merged(*maps: Column) -> Column:
    """Maps as one; where several have a key the last one's value stays."""
    def two(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)

    return reduce(two, maps)


def accent_of_country(c: Column) -> Column:
    return F.coalesce(lookup(vocab.ACCENTS, F.upper(F.coalesce(c, F.lit("")))), F.lit("unknown"))


def clean_annotator(c: Column) -> Column:
    """A user name trimmed and cut to 120 characters; ``anonymous`` where nothing is left."""
    return falsy(F.left(F.trim(falsy(c, "anonymous")), F.lit(120)), "anonymous")


def absolute_path(c: Column, base: str) -> Column:
    """Relative paths below ``base``; empty and absolute ones stay."""
    return F.when((F.coalesce(c, F.lit("")) == "") | c.startswith("/"), c).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), c))


def relative_path(c: Column, base: str) -> Column:
    """Paths below ``base`` relative to it; others stay."""
    root = base.rstrip("/") + "/"
    return F.when(c.startswith(root), F.substring(c, len(root) + 1, 1 << 30)).otherwise(c)


def audio_target(source: Column, key: Column) -> Column:
    """``source/sha1-of-key.flac`` with a file-safe source."""
    return F.concat(safe_name(falsy(source, "source")), F.lit("/"), F.sha1(F.encode(F.coalesce(key, F.lit("")), "UTF-8")), F.lit(".flac"))


def station_label(name: Column, uuid: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), uuid)


def news_score(name: Column, tags: Column) -> Column:
    """Distinct news tags, plus two for each news word in the name, minus three for each music tag."""
    parts = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != ""))
    in_name = sum((F.when(F.instr(F.lower(F.coalesce(name, F.lit(""))), w) > 0, 2).otherwise(0) for w in vocab.NEWS_NAME_WORDS), F.lit(0))
    return F.size(F.array_intersect(parts, F.lit(list(vocab.NEWS_TAGS)))) + in_name - 3 * F.size(F.array_intersect(parts, F.lit(list(vocab.MUSIC_TAGS))))


def leading_token(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(" + vocab.TOKEN_RE + ")", 1), F.lit(""))


def tokens_in(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(vocab.TOKEN_RE), F.lit(0))


def any_token(c: Column) -> Column:
    return F.get(tokens_in(c), F.lit(0))


def primary_token(c: Column) -> Column:
    return F.coalesce(leading_token(c), any_token(c))


def strip_leading_token(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*" + vocab.TOKEN_RE + r"\s*", ""))


def strip_tokens(c: Column) -> Column:
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), vocab.TOKEN_RE, " "), unicode=False)


def canonical_token_text(c: Column) -> Column:
    return F.trim(F.concat_ws(" ", any_token(c), strip_tokens(c)))


def place_token(c: Column, position: str, repeat: int = 1) -> Column:
    """The text's token before, after, or on both sides of the text without tokens; unchanged where there is none."""
    token, body = primary_token(c), strip_tokens(c)
    several = F.array_join(F.array_repeat(token, max(1, repeat)), " ")
    placed = {"prefix": (several, body), "suffix": (body, several), "both": (token, body, several)}
    if position not in placed:
        raise ValueError(f"position is one of {', '.join(placed)}")
    return F.when(token.isNull(), c).otherwise(F.trim(F.concat_ws(" ", *placed[position])))


def label_key(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), "- ", "__")


def normal_label(c: Column) -> Column:
    return lookup(vocab.LABEL_SYNONYMS, label_key(c))


def token_of_label(c: Column) -> Column:
    return F.concat(F.lit("<|"), normal_label(c), F.lit("|>"))


def asr_normal(c: Column, compatible: bool = True) -> Column:
    """Tokens stripped, lower case, ASCII punctuation dropped, white space collapsed; NFKC first if ``compatible``."""
    base = strip_tokens(nfkc(c) if compatible else c)
    return collapse(F.translate(F.lower(base), vocab.PUNCTUATION, ""))


def split_units(c: Column) -> Column:
    """Units between runs of five or more exclamation marks, control tokens blanked, empty ones dropped."""
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), vocab.CONTROL_RE, " ")
    return F.filter(F.transform(F.split(collapse(clean), vocab.IU_SEPARATOR_RE), lambda x: collapse(x)), lambda x: x != "")


def text_from_words(c: Column) -> Column:
    """Text of a JSON list of {word}, without spaces before punctuation; broken JSON is empty."""
    parsed = F.from_json(c, "array<struct<word:string>>")
    kept = F.filter(F.transform(parsed, lambda w: collapse(w["word"])), lambda w: w != "")
    return F.regexp_replace(F.coalesce(F.array_join(kept, " "), F.lit("")), r"\s+([,.;:?!])", "$1")


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")


def csv_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def path_source(c: Column, unknown: str | None = "unknown") -> Column:
    """The first path component; ``unknown`` where there is no slash (None: the path itself)."""
    return F.when(F.instr(c, "/") > 0, F.substring_index(c, "/", 1)).otherwise(F.lit(unknown) if unknown is not None else c)


def path_stem(c: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?<=.)\.[^.]*$", "")


def say_the_word(path: Column) -> Column:
    """``speaker_word_emotion.wav`` to its spoken sentence; empty where there are fewer than three parts."""
    parts = F.split(path_stem(path), "_")
    return F.when(F.size(parts) >= 3, F.concat(F.lit("Say the word "), F.translate(F.get(parts, F.lit(1)), "-", " "), F.lit("."))).otherwise("")


# Media logs


def log_duration(c: Column) -> Column:
    """Seconds of the first ``Duration: HH:MM:SS.ff``; 0 where there is none."""
    part = lambda i: F.coalesce(F.regexp_extract(c, r"Duration:\s*(\d{2}):(\d{2}):(\d{2}\.\d+)", i).try_cast("double"), F.lit(0.0))
    return part(1) * 3600 + part(2) * 60 + part(3)


def log_sample_rate(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?im)^.*(?:Audio:|Stream #).*?(\d+)\s+Hz,\s*(?:mono|stereo|\d+\s+channels?)", 1)
    return F.coalesce(found.try_cast("int"), F.lit(0))


def log_channels(c: Column) -> Column:
    found = F.lower(F.regexp_extract(c, r"(?im)^.*(?:Audio:|Stream #).*?\d+\s+Hz,\s*(mono|stereo|\d+)", 1))
    return F.when(found == "mono", 1).when(found == "stereo", 2).otherwise(F.coalesce(found.try_cast("int"), F.lit(0)))


def log_stream(c: Column) -> Column:
    """struct(codec, sample_rate, bitrate) of a stream probe's log, null where it does not say."""
    said = lambda pattern, i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    stream = r"Stream #\d+:\d+.*Audio:\s*(\w+).*?(\d+)\s*Hz"
    return F.struct(said(stream, 1).alias("codec"), said(stream, 2).try_cast("int").alias("sample_rate"), (said(r"bitrate:\s*(\d+)\s*kb/s", 1).try_cast("int") * 1000).alias("bitrate"))


def log_numbers(c: Column, key: str) -> Column:
    """All numbers after ``key:``."""
    return F.transform(F.regexp_extract_all(c, F.lit(key + r":\s*(-?[\d.]+)"), F.lit(1)), lambda x: x.try_cast("double"))


def silence_seconds(c: Column, close_at: Column | None = None) -> Column:
    """Total of silence_start/silence_end pairs; an open last one ends at ``close_at``, or is left out."""
    starts, ends = log_numbers(c, "silence_start"), log_numbers(c, "silence_end")
    if close_at is not None:
        ends = F.when(F.size(starts) > F.size(ends), F.concat(ends, F.array(close_at))).otherwise(ends)
    both = F.zip_with(starts, ends, lambda s, e: F.greatest(F.lit(0.0), e - s))
    return F.aggregate(both, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
