"""Expressions on the rows that are easy to get wrong."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.functions import dates, sequences
from quillspan.functions import numbers as N
from quillspan.functions import text as T


def one(spark, column, **values):
    names = list(values) or ["x"]
    return spark.createDataFrame([tuple(values.values()) or (None,)], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double'}" for n, v in zip(names, values.values() or [None], strict=True))).select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("xx, Engilsh", "English"), ("O'neil-land", "O'Neil-Land"), ("", ""), ("  fr ", "French"), ("éclair du nord", "Éclair Du Nord"), ("british   english", "English"), (None, "")],
)
def test_language(spark, raw, want):
    assert one(spark, T.canonical_language(F.col("x")), x=raw) == want


def test_collapse_takes_unicode_blanks(spark):
    assert one(spark, T.collapse(F.col("x")), x=" a \n b ") == "a b"
    assert one(spark, T.collapse(F.col("x")), x=None) == ""


def test_deep_clean(spark):
    assert one(spark, T.deep_clean(F.col("x")), x="\x93Ｆull\x94 \x92s\x07 \x96") == "\"Full\" 's -"


@pytest.mark.parametrize(
    ("text", "lead", "first", "body"),
    [(" <|joy|> hi", "<|joy|>", "<|joy|>", "hi"), ("hi <|fear|> and <|joy|>", None, "<|fear|>", "hi and"), ("<|bored|> x", None, None, "<|bored|> x"), ("<|joy|>", "<|joy|>", "<|joy|>", ""), (None, None, None, "")],
)
def test_tokens(spark, text, lead, first, body):
    x = F.col("x")
    assert (one(spark, T.leading_token(x), x=text), one(spark, T.any_token(x), x=text), one(spark, T.strip_tokens(x), x=text)) == (lead, first, body)


def test_place_token(spark):
    x = F.col("x")
    assert one(spark, T.place_token(x, "prefix", 2), x="a <|joy|> b") == "<|joy|> <|joy|> a b"
    assert one(spark, T.place_token(x, "both", 2), x="a <|joy|>") == "<|joy|> a <|joy|> <|joy|>"
    assert one(spark, T.place_token(x, "suffix"), x="plain") == "plain"
    with pytest.raises(ValueError):
        T.place_token(x, "middle")


@pytest.mark.parametrize(("label", "token"), [(" Happy", "<|joy|>"), ("bad-quality", "<|low_quality|>"), ("pleasant surprise", "<|surprise|>"), ("bored", None), (None, None)])
def test_label(spark, label, token):
    assert one(spark, T.token_of_label(F.col("x")), x=label) == token


def test_news_score(spark):
    score = T.news_score(F.col("n"), F.col("t"))
    assert one(spark, score, n="Info News", t="News, talk,pop,news") == 2 + 4 - 3
    assert one(spark, score, n="x", t="") == 0


def test_units_and_words(spark):
    assert one(spark, T.split_units(F.col("x")), x="<|en|> a  b!!!!! !!!!!! c!!!! d") == ["a b", "c!!!! d"]
    assert one(spark, T.words(F.col("x")), x="Don't STOP-me 'now'") == ["don't", "stop", "me", "now"]
    assert one(spark, T.text_from_words(F.col("x")), x='[{"word": "Hi"}, {"word": ","}, {"word": " you "}, {}]') == "Hi, you"
    assert one(spark, T.text_from_words(F.col("x")), x="{broken") == ""


def test_media_log(spark):
    log = "Duration: 01:02:03.500, x\n  Stream #0: Audio: mp3, 44100 Hz, 6 channels\nsilence_start: 1.0\nsilence_end: 2.5\nsilence_start: 9"
    x = F.col("x")
    assert one(spark, T.log_duration(x), x=log) == 3723.5
    assert (one(spark, T.log_sample_rate(x), x=log), one(spark, T.log_channels(x), x=log)) == (44100, 6)
    assert (one(spark, T.silence_seconds(x), x=log), one(spark, T.silence_seconds(x, F.lit(12.0)), x=log)) == (1.5, 4.5)
    assert (one(spark, T.log_duration(x), x="none"), one(spark, T.log_channels(x), x="none")) == (0.0, 0)


def test_paths(spark):
    x = F.col("x")
    assert one(spark, T.say_the_word(x), x="a/OAF_come-on_angry.wav") == "Say the word come on."
    assert one(spark, T.say_the_word(x), x="a/b.wav") == ""
    assert one(spark, T.path_source(x), x="plain") == "unknown"
    assert one(spark, T.safe_name(x), x="a b/é.1") == "a_b_é_1"
    assert one(spark, T.csv_list(x), x=" a, ,b ") == ["a", "b"]


def test_dates(spark):
    x = F.col("x")
    assert one(spark, dates.iso_date(x), x="2024-05-01T23:30:00+02:00") == "2024-05-01"
    assert one(spark, dates.iso_date(x), x="2024-13-99 junk") == "2024-13-99"
    assert one(spark, dates.iso_date(x), x="") == "unknown-date"
    assert one(spark, dates.iso_timestamp(x).cast("string"), x="2024-05-01T01:00:00+02:00") == "2024-04-30 23:00:00"
    assert one(spark, dates.iso_timestamp(x).cast("string"), x="soon") == "0001-01-01 00:00:00"


def test_numbers(spark):
    x = F.col("x")
    assert one(spark, N.lenient(x, "int", 0), x="3.7") == 0
    assert one(spark, N.linear(x), x=-100.0) == 0.0
    assert one(spark, N.decibel(x), x=0.0) == pytest.approx(-160)
    assert [one(spark, N.strength(x), x=v) for v in (399.9, 400.0, 150.0, 149.0)] == ["minor", "major", "minor", "continuing"]
    assert one(spark, N.ratio(x, F.lit(0)), x=1.0) == 0.0


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, before = [0], row
        for j, y in enumerate(b, 1):
            row.append(before[j - 1] + 1 if x == y else max(before[j], row[j - 1]))
    return row[-1]


def test_folds_equal_tables(spark):
    import random

    random.seed(4)
    rows = [([random.choice("abc") for _ in range(random.randint(0, 7))], [random.choice("abc") for _ in range(random.randint(0, 7))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select("a", "b", sequences.edit_distance(F.col("a"), F.col("b")).alias("d"), sequences.common_length(F.col("a"), F.col("b")).alias("c")).collect()
    assert all(r.d == _distance(r.a, r.b) and r.c == _common(r.a, r.b) for r in got)


def plain_span(unit, words, cursor):
    """Every start tried in turn: how much of the unit a walk over the words that it may look at meets in order."""
    if not unit or not words:
        return cursor, cursor, 0.0, "empty"
    scored = []
    for start in range(cursor, min(len(words), cursor + sequences.REACH)):
        left, end = list(unit), start + 1
        for at, word in enumerate(words[start : start + len(unit) + sequences.SLACK], start):
            if left and left[0] == word:
                left.pop(0)
                end = at + 1
        scored.append(((len(unit) - len(left)) / len(unit) - sequences.LATER * (start - cursor), -start, end))
    score, start, end = max(scored, default=(0.0, -cursor, cursor))
    if score >= sequences.ACCEPT:
        return -start, end, round(score, 3), "token_match"
    return cursor, min(len(words), cursor + len(unit)), round(max(0.0, score), 3), "word_count_fallback"


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=8), st.lists(st.sampled_from("abcdefgh"), max_size=200), st.integers(0, 60))
def test_word_span_by_posting_lists_equals_every_start(unit, words, cursor):
    places = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    assert sequences.word_span(unit, places, len(words), cursor) == plain_span(unit, words, cursor)


def test_all_languages_are_known_by_their_code(spark):
    from quillspan.functions import vocab

    known = vocab.LANGUAGE_SPELLINGS
    codes = {v: k for k, v in known.items() if len(k) == 2 and k.isascii()}
    assert set(codes) == set(known.values()) and codes["Hebrew"] == "he" and "uk" not in known and known["ua"] == "Ukrainian"
