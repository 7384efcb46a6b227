"""Operators on small tables with ties, nulls, empty groups and boundary rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillspan.functions import vocab
from quillspan.operators import labels as L
from quillspan.operators import metrics as M
from quillspan.operators import rank as R
from quillspan.operators import rules, scan, sequential
from quillspan.operators import signal as G
from quillspan.sources import readers, schemas, sinks, versions
from quillspan.streaming import ingest


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_keep_best_first_wins_ties(spark):
    df = spark.createDataFrame([(0, " u ", 3), (1, "u", 3), (2, "", 9), (3, None, 9), (4, "v", None)], "pos int, url string, votes int")
    best = R.keep_best(df, F.trim("url"), [F.desc_nulls_last("votes"), F.col("pos")])
    assert rows(best.select("pos")) == [(0,), (4,)]


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    plan = R.top_per_group(df, ["g"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_anti_join_plan(spark):
    a, b = spark.range(10).withColumnRenamed("id", "k"), spark.range(5).withColumnRenamed("id", "k")
    plan = L.unlabeled(a, b, "k")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan


def test_interleave_is_a_permutation(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1), ("c", 2)], "s string, t int")
    out = [(r.s, r.t) for r in R.interleave(df, "s", [F.col("t")]).orderBy("pos").collect()]
    assert out == [("a", 1), ("b", 1), ("c", 1), ("a", 2), ("c", 2), ("a", 3)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 15, 30])
def test_split_sizes_round_half_even(spark, n):
    out = R.stratified_split(spark.range(n).withColumn("l", F.lit("x")), "l", "id", 0.7, 0.15, 0.15, 1)
    got = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    train, val = round(n * 0.7), round(n * 0.15)
    assert (got.get("train", 0), got.get("val", 0), got.get("test", 0)) == (train, val, n - train - val)
    with pytest.raises(ValueError):
        R.stratified_split(spark.range(1), "id", "id", 0.5, 0.1, 0.1, 1)


def test_oversample_sizes(spark):
    df = spark.createDataFrame([(i, "neutral") for i in range(10)] + [(100, "a"), (101, "a"), (200, "b")], "id int, l string")
    got = {r["l"]: r["count"] for r in R.oversample(df, "l", "id", "neutral", 0.55, 4, 3).groupBy("l").count().collect()}
    assert got == {"neutral": 10, "a": 5, "b": 4}


def test_cap_and_shards(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") < 700, "big").otherwise("other"))
    assert {r["s"]: r["count"] for r in R.cap_per_source(df, "s", "id", 20, 1, ["big"]).groupBy("s").count().collect()} == {"big": 700, "other": 20}
    assert R.cap_per_source(df, "s", "id", 0, 1).count() == 1000
    shards = R.shard_numbers(df, [F.col("id")], 128)
    assert shards.where("shard <> floor(id / 128)").isEmpty() and shards.agg(F.max("shard")).first()[0] == 7


@pytest.mark.parametrize("n", [1, 2, 10, 20])
def test_order_statistics_by_index(spark, n):
    df = spark.createDataFrame([(v,) for v in range(n)], "v int")
    at = {"min": lambda n: F.lit(0), "p50": lambda n: F.floor(n / 2), "p95": lambda n: F.floor((n - 1) * F.lit(0.95)), "max": lambda n: n - 1}
    got = R.order_statistics(df, "v", at).first()
    ordered = sorted(r.v for r in df.collect())
    assert tuple(got) == (ordered[0], ordered[n // 2], ordered[int((n - 1) * 0.95)], ordered[-1])


def test_rules_keep_their_order_and_lose_nothing(spark):
    df = spark.createDataFrame(
        [("", "t", 1.0, b"x"), ("low_quality", "", 99.0, None), ("bored", "t", 1.0, b"x"), ("joy", "t", 20.0, b"x"), ("joy", " ", 1.0, b"x"), ("joy", "t", 1.0, None), ("joy", "t", None, b"x"), (None, "t", 1.0, b"x")],
        "e string, t string, s double, a binary",
    )
    got = {r.drop_reason: r.n for r in rules.reason_counts(df, rules.token_rules(F.col("e"), F.col("t"), F.col("s"), F.col("a"), 20.0)).collect()}
    assert got == {"unlabeled": 2, "low_quality": 1, "unknown_emotion:bored": 1, "duration_gte_limit": 1, "empty_text": 1, "missing_audio": 1, "kept": 1}


def test_duration_bounds_differ(spark):
    df = spark.createDataFrame([(0.34,), (0.35,), (19.99,), (20.0,), (None,)], "s double").withColumn("a", F.lit(b"x")).withColumn("t", F.lit("<|joy|> hi"))
    s, a, t = F.col("s"), F.col("a"), F.col("t")
    assert rules.accepted(df, rules.mixture_rules(F.lit("joy"), t, s, a, 0.35, 20.0)).count() == 2
    assert rules.accepted(df, rules.concat_rules(a, a, t, s, 0.35, 20.0)).count() == 3


def test_gates(spark):
    df = spark.createDataFrame([(True, "", 48000, "pcm_s24le", 24, 0.0), (True, "", 48000, "pcm_s16le", 16, 300.0), (True, "", 16000, "pcm_s24le", 24, 300.0), (True, "", 48000, "x", 24, 269.0), (False, None, 0, "", 0, 0.0)], "ok boolean, e string, r int, c string, b int, s double")
    got = [r[0] for r in df.select(rules.output_gate(*[F.col(c) for c in ("ok", "e", "r", "c", "b", "s")], F.lit(300), 48000, 0.9)).collect()]
    assert got == [None, "codec=pcm_s16le, bits_per_sample=16; expected 24-bit PCM", "sample_rate=16000, expected 48000", "duration=269.00s below minimum 270.00s", "probe failed"]
    gate = spark.range(1).select(rules.source_gate(F.lit(0), F.lit(16000), 44100).alias("g")).first().g
    assert tuple(gate) == (False, "source sample_rate=16000, below minimum 44100", 16000)
    why = spark.range(1).select(rules.recording_gate(F.lit(True), F.lit(5), F.lit(1800.0), F.lit(1000.0), F.lit(0.5)).alias("w")).first().w
    assert why == "silence ratio 0.56 exceeds max 0.5"


def test_latest_annotation(spark):
    log = spark.createDataFrame(
        [("i", "ann", "joy", "2024-01-01T00:00:00Z", 1), ("i", "bob", "fear", "2024-01-01T02:00:00+02:00", 2), ("i", "eve", "sad", "soon", 3), ("j", "codex-x", "joy", "2024-01-01T00:00:00Z", 4), ("", "a", "joy", "", 5)],
        "iu_id string, annotator string, emotion string, updated_at string, seq long",
    )
    assert [(r.iu_id, r.emotion) for r in L.latest_annotations(log).collect()] == [("i", "fear")]
    assert {r.iu_id for r in L.latest_annotations(log, include_all=True).collect()} == {"i", "j"}


def test_upsert_keeps_created_and_is_idempotent(spark):
    log = spark.createDataFrame([("k", "a", "t1", 1), ("k", "b", "t2", 2), ("m", "c", "t3", 3)], "key string, v string, created string, seq long")
    once = L.upserted(log, ["key"], "seq", "created")
    assert rows(once.select("key", "v", "created")) == [("k", "b", "t1"), ("m", "c", "t3")]
    assert rows(L.upserted(once.select(log.columns), ["key"], "seq", "created")) == rows(once)


def test_retranscript_merge(spark):
    unit = spark.createDataFrame([("a", " x ", '[{"word":"w"},{"word":"."}]'), ("b", "y", "{bad"), ("c", "z", None)], "iu_id string, text string, words_json string")
    cache = spark.createDataFrame([("a", " ", 0.0), ("b", "", 1.5), ("c", " new  text", 2.0)], "iu_id string, text string, elapsed_seconds double")
    labels = spark.createDataFrame([("c", "joy", "ann")], "iu_id string, emotion string, annotator string")
    got = {r.iu_id: r for r in L.merge_retranscripts(unit, cache, labels).collect()}
    assert [(got[k].text, got[k].transcript_source, got[k].is_labeled) for k in "abc"] == [("w.", "word_offsets_fallback", False), ("", "blank_decode", False), ("new text", "clip_redecode", True)]
    assert str(got["a"].retranscribe_seconds) == "nan"
    with pytest.raises(Exception, match="no retranscript for c"):
        L.merge_retranscripts(unit, cache.where("iu_id <> 'c'"), labels).collect()


def test_checkpoint_states(spark):
    events = [("a", "failed", 1), ("a", "completed", 2), ("b", "failed", 1), ("b", "failed", 2), ("b", "failed", 3), ("c", "started", 1), ("d", "completed", 1), ("d", "completed", 2), ("e", "failed", 1)]
    state = L.checkpoint_state(spark.createDataFrame(events, "uuid string, kind string, seq long"), 3)
    assert {r.uuid: (r.state, r.attempts) for r in state.collect()} == {"a": ("completed", 0), "b": ("failed", 3), "c": ("in_progress", 0), "d": ("completed", 0), "e": ("retry", 1)}
    keys = spark.createDataFrame([(x,) for x in "abcdef"], "uuid string")
    assert rows(L.remaining(keys, state)) == [("c",), ("e",), ("f",)]


def test_islands(spark):
    p = [0.5, 0.5, 0.1, 0.7, 0.9, 0.9, 0.2, 0.6]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(p)], "k string, i int, p double")
    assert rows(G.island_peaks(df, ["k"], "i", "p", 0.5).select("i", "frames")) == [(0, 2), (4, 3), (7, 1)]
    assert G.island_peaks(df, ["k"], "i", "p", 2.0).isEmpty()


def test_leading_run(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.2), ("a", 2, 0.9), ("a", 3, 0.1), ("b", 0, 0.9), ("c", 0, 0.1)], "k string, i int, x double")
    assert rows(G.leading_run(df, ["k"], [F.col("i")], F.col("x") > 0.5)) == [("a", 2), ("b", 0), ("c", 1)]


def test_silence_around(spark):
    frames = spark.createDataFrame([("k", i / 100, 1.0 if i == 20 else 0.0) for i in range(100)], "k string, t double, rms double")
    at = spark.createDataFrame([("k", 0, 0.0), ("k", 1, 0.5), ("k", 2, 0.2)], "k string, boundary_id int, at double")
    assert rows(G.silence_around(frames, at, "k", 0.5)) == [("k", 0, 10.0, 200.0), ("k", 1, 300.0, 500.0), ("k", 2, 0.0, 0.0)]


def test_intervals(spark):
    df = spark.createDataFrame([("a", 0, "s", 1.0), ("a", 1, "e", 2.0), ("a", 2, "e", 3.0), ("a", 3, "s", 5.0)], "k string, i int, t string, v double")
    args = (df, ["k"], [F.col("i")], "t", "v", "s", "e")
    assert rows(G.pair_intervals(*args)) == [("a", 1.0, 2.0)]
    assert rows(G.pair_intervals(*args, F.lit(9.0))) == [("a", 1.0, 2.0), ("a", 5.0, 9.0)]


def test_words_from_token_times(spark):
    df = spark.createDataFrame([("k", 0, " he", 0.0, 0.3), ("k", 1, "y ", 0.3, 0.5), ("k", 2, "", 0.5, 0.6), ("k", 3, "you", 0.6, 0.9)], "k string, pos int, token string, a double, b double")
    assert rows(G.chars_to_words(df, ["k"], "pos", "token", "a", "b").select("word", "start_seconds", "end_seconds", "word_index")) == [("hey", 0.1, 0.4, 0), ("you", 0.6, 0.9, 1)]


def words_char_by_char(tokens):
    """One pass over (token, start, end) in order."""
    out, letters = [], []
    for token, start, end in [*tokens, (" ", 0.0, 0.0)]:
        for i, c in enumerate(token or ""):
            if not c.isspace():
                letters.append((c, start + max(end - start, 0.0) * i / len(token), start + max(end - start, 0.0) * (i + 1) / len(token)))
            elif letters:
                out.append(("".join(x[0] for x in letters), letters[0][1], letters[-1][2], len(out)))
                letters = []
    return out


def test_words_of_whole_tokens_are_those_of_single_characters(spark, monkeypatch):
    tokens = {"a": [" \t", "be", "", "e\u00a0\n", "\U0001f600x y", None, "z", "  v w", "ab"], "b": ["one"], "c": ["\n", "  "], "d": ["p q r s", " ", "t", "\u2003u"]}
    data = [(k, i, t, i * 0.5, i * 0.5 + (0.5 if i % 3 else -0.1)) for k, ts in tokens.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(data, "k string, pos int, token string, a double, b double").repartition(4)
    want = [(k, w, pytest.approx(s, abs=6e-4), pytest.approx(e, abs=6e-4), n) for k in tokens for w, s, e, n in words_char_by_char([(t, s, e) for x, _, t, s, e in data if x == k])]
    for most in (1_000_000, 1):  # plain windows, and range parts
        monkeypatch.setattr(scan, "TASK_ROWS", most)
        got = G.chars_to_words(df, ["k"], "pos", "token", "a", "b")
        assert [tuple(r) for r in got.orderBy("k", "word_index").collect()] == want


def test_characters_of_tokens_are_not_rows(spark):
    df = spark.range(200).select(F.lit("k").alias("k"), F.col("id").alias("pos"), F.lit("abc def").alias("token"), F.col("id").cast("double").alias("a"), (F.col("id") + 1.0).alias("b"))
    plan = G.chars_to_words(df, ["k"], "pos", "token", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "spark_partition_id" not in plan.lower() and "FileScan" not in plan  # nothing but a row for each token is shuffled


def test_prf_counts_labels_without_support(spark):
    df = spark.createDataFrame([("joy", "joy"), ("joy", "fear"), ("fear", "fear")], "t string, p string")
    got = {r.label: r for r in M.prf(df, "t", "p", list(vocab.TOKEN_LABELS)).collect()}
    assert len(got) == 8 and got["neutral"].f1 == 0 and got["joy"].recall == 0.5 and got["fear"].precision == 0.5
    s = M.summary(M.prf(df, "t", "p", list(vocab.TOKEN_LABELS))).first()
    assert s.accuracy == pytest.approx(2 / 3) and s.macro_f1 == pytest.approx((2 / 3 + 2 / 3) / 8)
    with pytest.raises(ValueError):
        M.require({"f1": 0.1}, {"f1": 0.2})


def test_sweep_takes_the_lowest_threshold_on_ties(spark):
    df = spark.createDataFrame([(0.9, True), (0.2, False)], "s double, y boolean")
    best = M.best_threshold(M.threshold_sweep(df, F.col("s"), F.col("y"), [0.8, 0.5, 0.3])).first()
    assert best.threshold == 0.3 and best.f1 == 1


def pack_one_by_one(rows, least, most, target, longest, gap):
    """One pass over rows (key, seconds, want) in order."""
    groups, group, lasts = [], [], 0.0
    for key, seconds, want in rows:
        adds = seconds + (gap if group else 0.0)
        if group and (len(group) == wanted or len(group) >= least and (lasts >= target or lasts + adds > longest)):
            groups.append(group)
            group, lasts, adds = [], 0.0, seconds
        if not group:
            wanted = want
        group.append((key, seconds))
        lasts += adds
    groups.append(group)
    return [(g, i, *item) for g, group in enumerate(x for x in groups if len(x) >= least) for i, item in enumerate(group)]


@pytest.mark.parametrize(("n", "block", "fan"), [(0, 8, 2), (1, 8, 2), (2, 8, 2), (300, 7, 3), (300, 1000, 4), (301, 1, 5)])
def test_one_ordered_packing(spark, many_parts, n, block, fan):
    import hashlib
    import random

    from quillspan.operators import grouping

    draw = random.Random(n)
    table = [(i, draw.choice([0.5, 5.0, 9.0, 20.0, 60.0, None])) for i in range(n)]
    limits = {"least": 2, "most": 6, "target": 28.0, "longest": 55.0, "gap": 0.08}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    order = sorted(table, key=lambda r: (md5(f"9|{r[0]}"), r[0]))
    want = pack_one_by_one([(k, s or 0.0, 2 + int(md5(f"9|want|{k}")[:8], 16) % 5) for k, s in order], **limits)
    got = grouping.pack_groups(spark.createDataFrame(table, "k long, s double"), "k", "s", 9, block=block, fan=fan, **limits)
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.fixture
def many_parts(spark, monkeypatch):
    """Small tables are scanned in parts, and dealt out to as many as large ones."""
    from quillspan.operators import scan

    monkeypatch.setattr(scan, "TASK_ROWS", 0)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_running_values_of_a_hot_key(spark, many_parts, monkeypatch):
    """One key has all rows but a few; parts stay small, and the values are those of one pass."""
    from pyspark.sql import Window

    from quillspan.operators.scan import parts, scan

    df = spark.range(4000).select(F.when(F.col("id") % 500 == 7, F.col("id")).when(F.col("id") % 500 != 8, F.lit(-1)).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("t"), "id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("x"))
    sizes = [r["count"] for r in parts(df, ["k"], [F.col("t"), F.col("id")]).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000
    line = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("id", F.coalesce(F.sum("x").over(line.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("s"), F.lag("x").over(line).alias("b"), F.lead("x").over(line).alias("a"))
    for most in (0, 10**6):
        monkeypatch.setattr("quillspan.operators.scan.TASK_ROWS", most)
        got = scan(df, ["k"], [F.col("t"), F.col("id")], sums={"s": F.col("x")}, before={"b": F.col("x")}, after={"a": F.col("x")})
        assert rows(got.select("id", "s", "b", "a")) == rows(want)
    assert scan(df.limit(0), ["k"], [F.col("id")], sums={"s": F.col("x")}).isEmpty()


def test_frames_reach_into_the_next_block(spark):
    df = spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("pos"), (F.col("id") * F.col("id") % 17).cast("double").alias("x"))
    want = rows(G.sliding_rms(df, ["k"], "pos", "x", 7, 2))
    assert len(want) == 47
    for block in (7, 10, 33):
        assert rows(G.sliding_rms(df, ["k"], "pos", "x", 7, 2, block)) == want


def test_align_units(spark):
    df = spark.createDataFrame([("k", [["a", "b"], ["zz"], []], ["a", "b", "c", "d"], [0.0, 1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0], 4.0)], "k string, units array<array<string>>, words array<string>, starts array<double>, ends array<double>, seconds double")
    got = [tuple(r)[1:] for r in sequential.align_units(df, "k").collect()]
    assert got[0] == (0, 0, 2, 0.0, 2.0, 1.0, "token_match")
    assert got[1] == (1, 2, 3, 2.0, 3.0, 0.0, "word_count_fallback") and got[2][-1] == "empty"


def test_decode_halves_failing_batches(spark):
    def decode(batch):
        if len(batch) > 1 and any(r["id"] == 3 for r in batch):
            raise RuntimeError("too large")
        return [{"id": r["id"], "text": str(r["id"])} for r in batch]

    assert sequential.decode_batched(spark.range(10), decode, "id long, text string").count() == 10


def test_manifests(spark, tmp_path):
    def put(source, stem, body):
        folder = tmp_path / source / "2024-01-02" / stem
        folder.mkdir(parents=True)
        (folder / "manifest.json").write_text(body if isinstance(body, str) else json.dumps(body))

    good = {"source": {"id": "s1"}, "capture": {"started_at": "2024-01-02T03:00:00Z", "duration_requested_seconds": 300}, "quality": {"valid": True, "output_probe": {"format": {"duration": "0"}}}}
    put("s1", "a", good)
    put("s2", "b", {"quality": {"valid": True, "output_probe": {"format": {"duration": "12.5"}}}})
    put("s3", "c", {"source": {"id": "s3"}, "quality": {"valid": False}})
    put("s4", "d", {"source": {"id": "s4"}})
    put("s5", "e", "{broken")
    got = {r.segment_id: r.duration_seconds for r in readers.manifests(spark, str(tmp_path)).collect()}
    assert got == {"s1/2024-01-02/a": 300.0, "s2/2024-01-02/b": 12.5}


def test_units_of_segments(spark):
    boundary = "iu_index int, text string, start_seconds double, end_seconds double, start_word_index int, end_word_index_exclusive int, boundary_after_word_index int, alignment_score double, alignment_method string"
    body = {"segment_id": "s", "source_id": "src", "recording_date": "2024-01-01", "duration_seconds": 10.0, "audio_path": "x/y.flac", "status": "ok", "words": [{"word": "a"}, {"word": "b"}], "boundaries": [
        {"iu_index": 0, "text": " a  b ", "start_seconds": 1.0, "end_seconds": 1.01, "start_word_index": 0, "end_word_index_exclusive": 2}, {"iu_index": 1, "text": " "}, {"iu_index": 7, "text": "c", "start_seconds": 9.5, "end_seconds": 12.0}]}
    df = spark.read.schema(schemas.SEGMENT).json(spark.sparkContext.parallelize([json.dumps(body)]))
    got = {r.iu_id: r for r in readers.units_of(df).collect()}
    assert boundary and set(got) == {"s#iu=0000", "s#iu=0007"}
    assert (got["s#iu=0000"].end_seconds, got["s#iu=0000"].boundary_after_word_index, got["s#iu=0007"].end_seconds) == (1.04, -1, 10.0)
    assert json.loads(got["s#iu=0000"].words_json)[1]["word"] == "b" and got["s#iu=0000"].path == "src/2024-01-01/y_iu0000.flac"


def test_sinks_round_trip(spark, tmp_path):
    df = spark.range(1000).withColumn("l", F.when(F.col("id") % 2 == 0, "neutral").otherwise("joy"))
    sinks.sharded_parquet(df, str(tmp_path / "p"), 300, "id")
    back = readers.parquet(spark, str(tmp_path / "p"))
    assert back.count() == 1000 and {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
    sinks.label_splits(df, str(tmp_path / "s"), "l")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 500
    sinks.append_log(df.limit(1).withColumn("seq", F.lit(1)), str(tmp_path / "log"))
    sinks.append_log(df.limit(1).withColumn("seq", F.lit(2)), str(tmp_path / "log"))
    assert [r.seq for r in readers.jsonl_log(spark, str(tmp_path / "log"), "id long, l string, seq long", "id").collect()] == [2]
    sinks.csv_metadata(spark.createDataFrame([("a\nb", "x"), ('q"', "")], "t string, n string"), str(tmp_path / "c"))
    assert rows(readers.csv(spark, str(tmp_path / "c"), "t string, n int")) == [('a\nb', 0), ('q"', 0)]
    good, failed = sinks.with_dead_letters(df, F.when(F.col("id") == 5, "bad"))
    assert (good.count(), failed.count()) == (999, 1)


def test_union_keeps_failures_apart(spark):
    df, failed = readers.union_sources({"a": lambda: spark.range(2), "b": lambda: spark.createDataFrame([("x",)], "t string"), "c": lambda: 1 / 0})
    assert df.count() == 3 and set(failed) == {"c"} and set(df.columns) == {"id", "source", "t"}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    rows_of = lambda df: rows(df.select(F.col("window_start").cast("string"), "event_type", "n"))
    stream = ingest.event_time(ingest.file_stream(spark, f"{sf_dir}/", schemas.EVENT, pattern="events.parquet"))
    counted = ingest.windowed(stream, "ts", "6 hours", None, ["event_type"], [F.count("*").alias("n")])
    q = counted.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    ingest.run_to_end(q)
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows_of(spark.table("windows")) == rows_of(ingest.windowed(batch, "ts", "6 hours", None, ["event_type"], [F.count("*").alias("n")]))


def test_shards_and_upserts_from_a_stream(spark, sf_dir, tmp_path):
    stream = lambda: ingest.file_stream(spark, f"{sf_dir}/", schemas.EVENT, pattern="events.parquet")
    ingest.run_to_end(ingest.write_shards(stream(), str(tmp_path / "out"), str(tmp_path / "ck"), 400))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000
    ingest.run_to_end(versions.upsert_stream(stream(), ["user_id"], "event_id", str(tmp_path / "log"), str(tmp_path / "ck2")))
    users = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    assert rows(versions.read(spark, str(tmp_path / "log"), ["user_id"], "event_id").select("user_id", "event_id")) == rows(users)


def test_quantiles_by_group(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g in range(4) for v in rng.integers(0, 12, int(rng.integers(1, 40)))]
    df = spark.createDataFrame([*rows, (9, None), (9, 2.5)], "g int, v double")
    got = {r.g: (r.p20, r.p50) for r in R.group_quantiles(df, ["g"], "v", {"p20": 0.2, "p50": 0.5}).collect()}
    for g in range(4):
        values = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx((np.percentile(values, 20), np.median(values)))
    assert got[9] == (2.5, 2.5)


def test_samples_with_and_without_replacement(spark):
    df = spark.range(6).withColumnRenamed("id", "k")
    assert R.sample_rows(df, "k", 4, 1).count() == 4 and R.sample_rows(df, "k", 9, 1).count() == 6
    again = [r.k for r in R.sample_rows(df, "k", 20, 1, replace=True).collect()]
    assert len(again) == 20 and set(again) <= set(range(6))
    assert len({r.k for r in R.sample_rows(df, "k", 4, 1, replace=True).collect()}) == 4


def test_near_join_equals_the_comparison_of_all(spark):
    import random

    from quillspan.operators import signal as G

    random.seed(1)
    left = [(random.randint(0, 1), i, random.uniform(-5, 5)) for i in range(60)]
    right = [(random.randint(0, 1), i, random.uniform(-5, 5)) for i in range(60)]
    a, b = spark.createDataFrame(left, "k int, i int, x double"), spark.createDataFrame(right, "k int, j int, y double")
    got = {(r.i, r.j) for r in G.near_join(a, b, ["k"], "x", "y", 0.7).collect()}
    assert got == {(i, j) for k, i, x in left for m, j, y in right if k == m and abs(x - y) <= 0.7}
    spans = a.select("k", "i", F.col("x").alias("s"), (F.col("x") + F.col("i") / 20 - 0.2).alias("e"))
    got = {(r.i, r.j) for r in G.within_spans(spans, b, ["k"], "s", "e", "y", 0.9).collect()}
    assert got == {(i, j) for k, i, x in left for m, j, y in right if k == m and x <= y <= x + i / 20 - 0.2}


def test_matches_in_stretches_equal_one_pass(spark, many_parts):
    import random

    from quillspan.operators import sequential

    def match_nearest(refs, preds, tolerance):
        """Each reference in turn takes the nearest prediction that is left."""
        left, out = list(enumerate(preds)), []
        for ref in refs:
            near = min(((abs(p - ref), i, p) for i, p in left if abs(p - ref) <= tolerance), default=None)
            if near:
                left.remove(near[1:])
                out.append((ref, near[2]))
        return out

    random.seed(2)
    want, rows = [], []
    for k in range(5):
        refs, preds = (sorted(random.choices(range(120), k=25)) if k else sorted(random.sample(range(120), 90)) for _ in range(2))
        want += [(k, *p) for p in match_nearest(refs, preds, 2)]
        rows += [(k, p, True) for p in refs] + [(k, p, False) for p in preds]
    got = sequential.match_events(spark.createDataFrame(rows, "k int, pos long, is_ref boolean"), ["k"], 2).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_best_boundary_threshold(spark, sf_dir):
    from quillspan.plans import registry

    sweep = [r.asDict() for r in registry.QUERIES["boundary_sweep"](spark, sf_dir).collect()]
    best = max(sorted(sweep, key=lambda r: r["threshold"]), key=lambda r: (r["f1"], r["recall"], r["precision"]))
    assert registry.QUERIES["boundary_best"](spark, sf_dir).first().asDict() == best


def test_missing_files_and_tokens_are_errors(spark, tmp_path):
    from quillspan.operators import intake
    from quillspan.sources import readers, sinks

    with pytest.raises(FileNotFoundError, match="no Parquet file"):
        readers.parquet_paths(spark, f"{tmp_path}/nothing")
    row = spark.createDataFrame([("no token",)], "t string")
    with pytest.raises(Exception, match="missing emotion token"):
        row.select(intake.label_id(F.col("t"), ["<|joy|>"])).collect()
    tries = []

    def upload(folder):
        tries.append(folder)
        if len(tries) < 3:
            raise OSError("try again")

    assert sinks.publish("f", upload) == 3
    with pytest.raises(OSError):
        sinks.publish("f", lambda folder: (_ for _ in ()).throw(OSError()), attempts=2)


def test_callback_for_each_batch(spark, tmp_path):
    from quillspan.streaming import ingest

    spark.range(30).repartition(3).write.parquet(f"{tmp_path}/in")
    seen = []
    stream = ingest.file_stream(spark, f"{tmp_path}/in", "id long", 1)
    ingest.run_to_end(ingest.with_callback(stream, f"{tmp_path}/checkpoint", lambda batch, i: seen.append((i, batch.count()))))
    assert [i for i, _ in seen] == [0, 1, 2] and sum(n for _, n in seen) == 30
