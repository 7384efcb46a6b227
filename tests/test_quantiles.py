"""Quantiles to the last digit: where a threshold meets a value, the digit decides who is silent."""

from __future__ import annotations

import datetime as dt

import duckdb

from quillspan.plans import registry


def test_thresholds_that_meet_a_value_are_as_in_sql(spark, tmp_path):
    found = [(24, 4, 7.39, 7.54, 11.22), (34, 6, 24.15, 24.4, 36.45), (15, 2, 35.8, 35.9, 53.82), (10, 1, 23.0, 23.2, 34.74), (34, 6, 31.76, 32.16, 48.0)]
    rows = [(g, v) for g, (n, f, low, high, loud) in enumerate(found) for v in [low] * (f + 1) + [high] + [loud] * (n - f - 2)]
    spark.createDataFrame([(i, g, v, dt.datetime(2024, 1, 1)) for i, (g, v) in enumerate(rows)], "event_id long, user_id long, value double, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["silence_threshold_stats"](spark, str(tmp_path)).select("user_id", "threshold", "silence_ratio").collect()
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(f"select user_id, threshold, silence_ratio from ({registry.ORACLES['silence_threshold_stats']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 5
