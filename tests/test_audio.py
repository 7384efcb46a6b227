"""Audio payloads against plain versions, and what is no audio."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.functions import audio as A
from quillspan.operators import clips


@pytest.mark.parametrize(("bits", "floats"), [(8, False), (16, False), (24, False), (32, False), (32, True), (64, True)])
@pytest.mark.parametrize("channels", [1, 2, 3])
def test_round_trip(bits, floats, channels):
    x = np.random.default_rng(bits).uniform(-1, 1, 60)
    x[:3] = -1.0, 1.0, 0.0
    payload = A.wave(x, 8000, bits, channels, floats)
    h = A.header(payload)
    assert (h.format, h.rate, h.channels, h.bits, h.frames, h.seconds) == ("wav", 8000, channels, bits, 60 // channels, 60 // channels / 8000)
    got = A.samples(payload, h)
    assert got.shape == (60 // channels, channels) and np.abs(got.ravel() - x).max() <= (1e-7 if floats else 1 / 2 ** (bits - 1))
    assert A.wave(got.ravel(), 8000, bits, channels, floats) == payload  # decoding and encoding again changes nothing
    assert np.allclose(A.mono(payload), got.mean(axis=1), atol=1e-7)


def test_other_chunks_and_extensible():
    x = np.array([0.5, -0.5, 0.25])
    plain = A.wave(x, 8000)
    body = plain[12:]
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    assert np.array_equal(A.mono(b"RIFF\xff\xff\xff\xffWAVE" + odd + body + odd), x.astype(np.float32))
    wide = struct.pack("<HHIIHHHHIH", A.EXTENSIBLE, 1, 8000, 16000, 2, 16, 22, 16, 4, A.PCM) + A.GUID
    extensible = b"RIFF\0\0\0\0WAVE" + b"fmt " + struct.pack("<I", len(wide)) + wide + plain[36:]
    assert np.array_equal(A.mono(extensible), x.astype(np.float32))
    assert A.header(extensible.replace(A.GUID, bytes(14))) is None
    stream = plain[:40] + b"\xff\xff\xff\xff" + plain[44:]
    assert A.header(stream).frames == 3 and A.header(plain[:-1]).frames == 2  # an unknown size, and a file cut short


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 60), st.sampled_from([b"", b"RIFF", b"fLaC"]))
def test_damaged_payloads_never_crash(noise, at, head):
    whole = A.wave(np.zeros(4), 8000)
    for p in (head + noise, whole[:at], whole[:at] + noise + whole[at + len(noise) :]):
        A.mono(p, 16000) if (h := A.header(p)) is None or h.rate < 10**6 else None
    assert A.mono(None) is None and A.mono(b"") is None


def plain_resample(x, rate, target):
    """Each output as the sum over all inputs of the windowed sinc, written out."""
    cutoff = A.ROLLOFF * min(1.0, target / rate)
    reach = int(np.ceil(A.ZEROS / cutoff))
    out = []
    for i in range(-(-len(x) * target // rate)):
        at = i * rate / target
        base = i * rate // target
        k = np.arange(base - reach, base + reach + 1)
        t = k - at
        w = cutoff * np.sinc(cutoff * t) * np.i0(A.BETA * np.sqrt(np.maximum(0, 1 - (t / (reach + 1)) ** 2))) / np.i0(A.BETA)
        inside = (k >= 0) & (k < len(x))
        out.append((w[inside] * x[k[inside]]).sum() / w.sum())
    return np.array(out)


@pytest.mark.parametrize(("rate", "target"), [(8000, 16000), (16000, 8000), (44100, 16000), (22050, 16000), (16000, 44100), (7, 3), (11025, 11024)])
@pytest.mark.parametrize("n", [1, 2, 50, 333])
def test_resampling_equals_the_sum_written_out(rate, target, n):
    x = np.random.default_rng(n).normal(size=n)
    assert np.allclose(A.resample(x, rate, target), plain_resample(x, rate, target), atol=1e-9)


def test_resampling_keeps_tones_below_the_band_and_drops_those_above():
    t = np.arange(44100) / 44100
    low, high = np.sin(2 * np.pi * 1000 * t), np.sin(2 * np.pi * 12000 * t)
    out = A.resample(low, 44100, 16000)
    assert len(out) == 16000 and np.abs(out[500:-500] - np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)[500:-500]).max() < 1e-3
    assert np.abs(A.resample(high, 44100, 16000)[500:-500]).max() < 1e-3
    assert np.allclose(A.resample(np.ones(2000), 8000, 11025)[200:-200], 1.0)


def test_bounds():
    assert A.bounds(0.1, 0.2, 1.0, 100, 100) == (10, 20)
    assert A.bounds(0.1, 0.11, 1.0, 100, 100) == (10, 14)  # 40 ms at least
    assert A.bounds(None, None, 1.0, 100, 100) == (0, 4)
    assert A.bounds(5.0, 9.0, 1.0, 100, 100) == (100, 101)
    assert A.bounds(-3.0, 9.0, None, 100, 100) == (0, 1)


def test_not_a_number_and_loud_samples(spark):
    x = spark.createDataFrame([(1, [float("nan"), float("inf"), 7.0, -7.0, None])], "id int, x array<double>")
    got = x.select(A.decoded(A.encoded(F.col("x"), F.lit(8000), 32, 1, True), 8000).alias("y"), A.decoded(F.lit(None).cast("binary"), 8000).alias("z"), A.encoded(F.lit(None).cast("array<double>"), F.lit(1)).alias("e")).first()
    assert got.y == [0.0, 0.0, 1.0, -1.0, 0.0] and got.z is None and got.e is None


def test_clips_of_odd_recordings(spark):
    wav = A.wave(np.arange(100) / 200, 100)
    recordings = spark.createDataFrame([("a", "s", "d", "x/y.z.flac", wav, 1.0), ("b", "s", "d", "b", b"none", 1.0), ("c", "s", "d", "c", None, None), ("e", "s", "d", "e", A.wave(np.zeros(0), 100), 1.0)], "key string, source string, date string, path string, payload binary, seconds double")
    units = spark.createDataFrame([("a", 2, "two", 0.5, None), ("a", 1, " one\n1 ", 0.1, 0.3), ("a", 3, " ", 0.1, 0.3), ("b", 1, "t", 0.1, 0.3), ("c", 1, "t", 0.1, 0.3), ("e", 1, "t", 0.1, 0.3), ("f", 1, "t", 0.1, 0.3)], "key string, unit int, text string, start double, end double")
    got = clips.unit_clips(recordings, units, "key").orderBy("unit").collect()
    assert [(r.key, r.unit, r.text, r.audio.path, r.duration_seconds) for r in got] == [("a", 1, "one 1", "s/d/y.z_iu0001.wav", 0.2), ("a", 2, "two", "s/d/y.z_iu0002.wav", 0.04)]
    assert np.array_equal(A.mono(bytes(got[0].audio.bytes)), np.rint(np.arange(10, 30) / 200 * 32768).astype(np.float32) / 32768)


def test_concat_with_silence(spark):
    a, b = A.wave(np.full(10, 0.5), 1000), A.wave(np.full(20, -0.5), 1000)
    rows = spark.createDataFrame([(1, 2, b), (1, 1, a), (2, 1, a), (3, 1, a), (3, 2, b"no audio"), (4, 1, None)], "g long, o int, p binary")
    got = {r.g: r for r in clips.concat_clips(rows, "g", "o", "p", 1000, 5.0).collect()}
    assert A.mono(bytes(got[1].audio.bytes)).tolist() == [0.5] * 10 + [0.0] * 5 + [-0.5] * 20
    assert (got[1].duration_seconds, got[1].iu_count, got[1].audio.path) == (0.035, 2, "concat_iu/0000001.wav") and got[2].duration_seconds == 0.01
    assert got[3].audio is None and got[3].duration_seconds is None and got[4].audio is None


def test_decoded_batch_holds_its_samples_once():
    import tracemalloc

    import pyarrow as pa

    one = A.wave(np.zeros(20_000), 16000)
    batch = pa.array([one, None, b"no audio", *[one] * 500], pa.binary())
    tracemalloc.start()
    got = A.mono_array(batch, 16000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [got[i].as_py() is None for i in range(4)] == [False, True, True, False] and len(got[502]) == 20_000
    assert peak < 1.2 * 501 * 20_000 * 4
