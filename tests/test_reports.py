"""Reports, the paged source, and the remaining readers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillspan.operators import reports as P
from quillspan.operators import signal as G
from quillspan.sources import directory, readers
from quillspan.streaming import ingest


def test_speech_report(spark):
    rows = [("<|joy|> a b c", "<|joy|> a b c"), ("<|fear|> a b", "<|joy|> a x <|fear|>"), ("plain", ""), ("", "")]
    got = P.speech_report(spark.createDataFrame(rows, "r string, p string"), "r", "p").first()
    assert (got.rows, got.reference_tokens, got.predicted_tokens) == (4, 2, 3)
    assert got.wer == pytest.approx(2 / 6) and got.leading_accuracy == pytest.approx(3 / 4) and got.leading_present == 0.5
    assert got.token_recall == 1.0 and got.token_precision == pytest.approx(2 / 3) and got.sequence_accuracy == pytest.approx(3 / 4)
    assert got.macro_f1 == pytest.approx((2 / 3) / 8)
    empty = P.speech_report(spark.createDataFrame([], "r string, p string"), "r", "p").first()
    assert empty.rows == 0 and empty.wer == 0.0


def test_bandwidth_without_success(spark):
    df = spark.createDataFrame([(False, 10, 128.0)], "ok boolean, b long, k double")
    got = P.bandwidth_profile(df, F.col("ok"), F.col("b"), F.col("k"), 10.0, 1800.0).first()
    assert (got.mbps, got.station_mbps, got.concurrent, got.hours) == (0.0, 0.128, 1, 0.5)


def test_status_counts_keep_zeros(spark):
    df = spark.createDataFrame([("a",), ("a",)], "s string")
    assert {r.status: r.n for r in P.status_counts(df, F.col("s"), ["a", "b"]).collect()} == {"a": 2, "b": 0}


def test_paged_source(spark):
    directory.register(spark)
    df = spark.read.format("paged").schema("name string, votes int, country string").options(fetch="pages:fetch", pages="4", size="2").load()
    assert sorted(tuple(r) for r in df.collect()) == [(f"s{p}-{i}", i, None) for p in range(3) for i in range(2)]


def test_checkpoint_reader(spark, tmp_path):
    body = {"completed": {"u1": {"station": {"name": "n", "votes": 3}, "success": True, "duration_actual": 2.5, "file_size_bytes": 7}, "u2": {"success": False}}, "failed": {}}
    (tmp_path / "c.json").write_text(json.dumps(body))
    got = {r.uuid: (r.success, r.duration_actual, r.station.votes if r.station else None) for r in readers.checkpoint(spark, str(tmp_path / "c.json")).collect()}
    assert got == {"u1": (True, 2.5, 3), "u2": (False, None, None)}


def test_catalog_and_choice(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"id": "a", "rights_status": "open", "probe": {"sample_rate_hz": 48000}}, {"id": "b", "rights_status": "unknown"}]))
    sources = readers.catalog(spark, str(tmp_path / "s.json"))
    assert [r.id for r in readers.choose_sources(sources, rights=["open"]).collect()] == ["a"]
    assert readers.choose_sources(sources).count() == 0 and readers.choose_sources(sources, ["b"], ["open"]).count() == 0


def test_stations_media_and_paths(spark, tmp_path):
    api = spark.createDataFrame([("u", "fr, x", 1, "no")], "stationuuid string, language string, votes int, other string")
    assert readers.station_rows(api).columns == ["stationuuid", "language", "language_canonical", "votes"]
    (tmp_path / "a.WAV").write_bytes(b"123")
    (tmp_path / "b.txt").write_bytes(b"1")
    assert [r.length for r in readers.media_files(spark, str(tmp_path), ["wav", "mp3"]).collect()] == [3]
    spark.range(5).write.parquet(str(tmp_path / "set" / "data"))
    assert readers.parquet(spark, str(tmp_path / "set"), ["id"], "id", 2).count() == 2


def test_even_words_and_frames(spark):
    df = spark.createDataFrame([("k", " a  b ", 0.0), ("m", "", 5.0)], "k string, t string, s double")
    assert [(r.word, r.start_seconds) for r in G.even_words(df, ["k"], "t", "s").orderBy("word_index").collect()] == [("a", 0.0), ("b", 0.005)]
    frames = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,)], "f double").select(G.frame_of(F.col("f"), F.lit(6)).alias("i"))
    assert [r.i for r in frames.collect()] == [0, 2, 5, 5]


def test_retry_selection(spark):
    rows = [{"capture": {"started_at": f"2024-01-0{i}"}, "local": {"metadata_path": "p"}, "gcs": {"audio_upload": {"ok": i == 1}, "metadata_upload": {"ok": True}}} for i in (3, 1, 2)]
    schema = "capture struct<started_at:string>, local struct<metadata_path:string>, gcs struct<audio_upload:struct<ok:boolean>,metadata_upload:struct<ok:boolean>>"
    df = spark.createDataFrame(rows, schema)
    assert [r.capture.started_at for r in ingest.retry_selection(df, 5).collect()] == ["2024-01-02", "2024-01-03"]


def test_sessions_and_pending(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (1, "2024-01-01 09:00:00")], "u int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in ingest.sessions(df, "ts", "1 hour", ["u"], [F.count("*").alias("n")]).collect()) == [1, 2]
    seen = []
    ingest.process_pending(spark.range(5), spark.range(3), "id", lambda x: x, lambda x: seen.extend(r.id for r in x.collect()))
    assert sorted(seen) == [3, 4]
