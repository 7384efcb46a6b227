"""Queries without SQL against brute force on turns longer than any prefix."""

from __future__ import annotations

import random
import re

import pytest

from quillspan.plans import registry


@pytest.fixture(scope="module")
def long_turns(spark, tmp_path_factory):
    random.seed(7)
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", " ".join(random.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(40 + i))) for i in range(4)]
    path = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path), [r[3] for r in rows]


def rows_of(a, b, step):
    row = list(range(len(b) + 1)) if step == "edits" else [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1 if step == "edits" else 0]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1) if step == "edits" else row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_length_of_whole_turns(spark, long_turns):
    path, texts = long_turns
    got = {r.turn: r.lcs for r in registry.QUERIES["token_lcs"](spark, path).collect()}
    words = [re.findall("[a-z]+", t) for t in texts]
    assert got == {i: rows_of(words[i], words[i + 1], "lcs") for i in range(3)}


def test_speech_report_of_whole_turns(spark, long_turns):
    path, texts = long_turns
    got = registry.QUERIES["speech_report"](spark, path).first()
    words = [t.split() for t in texts]
    edits = sum(rows_of(words[i], words[i + 1], "edits") for i in range(3))
    assert got.wer == pytest.approx(edits / sum(len(w) for w in words[:3])) and got.rows == 3
    assert got.cer == pytest.approx(sum(rows_of(texts[i], texts[i + 1], "edits") for i in range(3)) / sum(len(t) for t in texts[:3]))


def test_word_error_rate_of_whole_turns(spark, long_turns):
    path, texts = long_turns
    words = [re.findall("[a-z]+", t) for t in texts]
    want = {i: (rows_of(words[i], words[i + 1], "edits"), len(words[i])) for i in range(3)}
    got = {r.turn: (r.edits, r.ref_words, r.wer, r.bucket) for r in registry.QUERIES["word_error_rate"](spark, path).collect()}
    bucket = lambda wer: "good" if wer <= 0.15 else "usable" if wer <= 0.3 else "poor"
    assert got == {i: (e, n, round(e / n, 6), bucket(e / n)) for i, (e, n) in want.items()}
    counts = {r.bucket: r.n for r in registry.QUERIES["wer_buckets"](spark, path).collect()}
    assert counts == {b: sum(bucket(e / n) == b for e, n in want.values()) for b in ("good", "usable", "poor")}


def test_distances_with_many_distinct_words(spark):
    from pyspark.sql import functions as F

    from quillspan.functions.sequences import common_length, edit_distance

    random.seed(3)
    a = [f"w{i}" for i in range(60_000)]
    b = [x for x in a if random.random() < 0.999]
    df = spark.createDataFrame([(a, b), ([], ["x"]), (["x"], []), ([], []), (None, ["x"])], "a array<string>, b array<string>")
    got = df.where("size(a) < 100 or a is null").select(edit_distance(F.col("a"), F.col("b")), common_length(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(1, 0), (1, 0), (0, 0), (None, None)]
    assert df.where("size(a) > 100").select(common_length(F.col("a"), F.col("b"))).first()[0] == len(b)
    few = spark.createDataFrame([([f"w{i}" for i in range(3000)], [f"w{i}" for i in range(3000) if i % 100])], "a array<string>, b array<string>")
    assert few.select(edit_distance(F.col("a"), F.col("b"))).first()[0] == 30


def test_span_alignment_equals_every_start_tried(spark, sf_dir):

    from test_functions import plain_span

    words = lambda s: [w.lower() for w in re.findall(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?", s)]
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        cursor, said = 0, words(r.text)
        for i, unit in enumerate(u for u in re.split(r"[.\n]+", r.text) if u.strip(" ")):
            start, end, score, method = plain_span(words(unit), said, cursor)
            cursor = max(cursor, end)
            want[f"{r.conv_id}/{r.turn}", i] = (start, end, score, method)
    got = registry.QUERIES["span_alignment"](spark, sf_dir).collect()
    assert {(r.key, r.unit_no): (r.start_word, r.end_word, r.score, r.method) for r in got} == want and len(got) == len(want)
