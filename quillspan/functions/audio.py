"""Audio payloads: RIFF/WAVE headers and samples, band-limited resampling, and encoding, batched by Arrow.

The small functions work on one payload with numpy; the Column functions at the end give them to tasks a batch at a time. What is not
WAVE, or breaks off before its samples, is null and never an error. Of FLAC the header alone is read.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# WAVE's format tags, and the end of the GUID that an extensible format has after the tag.
PCM, FLOATS, EXTENSIBLE = 1, 3, 0xFFFE
GUID = bytes.fromhex("0000000010008000 00aa00389b71")
#: Zero crossings of the sinc on each side, and the window's shape: some 80 dB of rejection.
ZEROS, BETA = 32, 9.0
#: Part of the lower rate's band that passes in full.
ROLLOFF = 0.95


@dataclass
class Header:
    """What a payload says of itself; for WAVE ``start`` and ``size`` say where its whole frames lie."""

    format: str
    rate: int
    channels: int
    bits: int
    frames: int
    floats: bool = False
    start: int = 0
    size: int = 0

    @property
    def seconds(self) -> float:
        return self.frames / self.rate


def header(payload: bytes | None) -> Header | None:
    """The header of a WAVE or FLAC payload; None for anything else."""
    if payload is None:
        return None
    if payload[:4] == b"fLaC":
        return _flac(payload)
    if payload[:4] != b"RIFF" or payload[8:12] != b"WAVE":
        return None
    at, kind = 12, None
    while at + 8 <= len(payload):
        name, size = struct.unpack_from("<4sI", payload, at)
        at += 8
        if name == b"fmt " and kind is None:
            kind = _format(payload[at : at + size])
            if kind is None:
                return None
        elif name == b"data":
            if kind is None:
                return None
            tag, channels, rate, block, bits = kind
            frames = min(size, len(payload) - at) // block  # a stream's size may be unknown, and a file cut short
            return Header("wav", rate, channels, bits, frames, tag == FLOATS, at, frames * block)
        at += size + size % 2  # chunks are padded to an even size
    return None


def _format(chunk: bytes) -> tuple[int, int, int, int, int] | None:
    """Tag, channels, rate, bytes of a frame and bits of a sample, if they make sense together."""
    if len(chunk) < 16:
        return None
    tag, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", chunk)
    if tag == EXTENSIBLE:
        if len(chunk) < 40 or chunk[26:40] != GUID:
            return None
        tag = struct.unpack_from("<H", chunk, 24)[0]
    known = tag == PCM and bits in (8, 16, 24, 32) or tag == FLOATS and bits in (32, 64)
    return (tag, channels, rate, block, bits) if known and channels and rate and block == channels * bits // 8 else None


def _flac(payload: bytes) -> Header | None:
    """From the first metadata block, STREAMINFO: 20 bits rate, 3 channels, 5 bits of a sample, 36 samples; each but the first and last less one."""
    if len(payload) < 42 or payload[4] & 0x7F or int.from_bytes(payload[5:8], "big") != 34:
        return None
    packed = int.from_bytes(payload[18:26], "big")
    rate, channels, bits, frames = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    return Header("flac", rate, channels, bits, frames) if rate and frames else None


def samples(payload: bytes, h: Header) -> np.ndarray:
    """A WAVE payload's samples as doubles, (frames, channels), full scale at 1."""
    raw = payload[h.start : h.start + h.size]
    if h.floats:
        x = np.frombuffer(raw, "<f4" if h.bits == 32 else "<f8").astype(np.float64)
    elif h.bits == 8:
        x = np.frombuffer(raw, np.uint8).astype(np.float64) - 128
    elif h.bits == 24:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) >> 8).astype(np.float64)
    else:
        x = np.frombuffer(raw, f"<i{h.bits // 8}").astype(np.float64)
    if not h.floats:
        x = x / 2.0 ** (h.bits - 1)
    return x.reshape(-1, h.channels)


@lru_cache(maxsize=32)
def _bank(up: int, down: int) -> tuple[np.ndarray, int]:
    """Filters of each of ``up`` phases, and how many inputs lie on each side: a Kaiser-windowed sinc below both rates' bands."""
    cutoff = ROLLOFF * min(1.0, up / down)
    reach = int(np.ceil(ZEROS / cutoff))
    t = np.arange(-reach, reach + 1)[None, :] - (np.arange(up) / up)[:, None]
    inside = np.maximum(0.0, 1 - (t / (reach + 1)) ** 2)
    bank = cutoff * np.sinc(cutoff * t) * np.i0(BETA * np.sqrt(inside)) / np.i0(BETA)
    return bank / bank.sum(axis=1, keepdims=True), reach  # a constant stays as it is


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """``x`` at another rate, ceil(n * target / rate) samples; beyond the ends there is silence."""
    if rate == target or not len(x):
        return x
    g = int(np.gcd(rate, target))
    up, down = target // g, rate // g
    bank, reach = _bank(up, down)
    n = -(-len(x) * up // down)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, (reach, reach + 1)), 2 * reach + 1)
    out = np.empty(n)
    for first in range(min(up, n)):  # outputs first, first + up, ... share a phase
        whole, phase = divmod(first * down, up)
        mine = len(range(first, n, up))
        out[first::up] = windows[whole : whole + (mine - 1) * down + 1 : down] @ bank[phase]
    return out


def mono(payload: bytes | None, target: int | None = None) -> np.ndarray | None:
    """The payload as one channel in [-1, 1] at the target rate, its channels' mean; not-a-number and infinite samples are silence."""
    h = header(payload)
    if h is None or h.format != "wav":
        return None
    x = samples(payload, h).mean(axis=1) if h.channels > 1 else samples(payload, h)[:, 0]
    x = np.where(np.isfinite(x), x, 0.0)
    return np.clip(resample(x, h.rate, target or h.rate), -1.0, 1.0).astype(np.float32)


def wave(x: np.ndarray, rate: int, bits: int = 16, channels: int = 1, floats: bool = False) -> bytes:
    """Samples as WAVE: whole numbers, rounded half to even, or floats. What was decoded is encoded as it was. ``x`` has the channels interleaved."""
    x = np.clip(np.where(np.isfinite(x), x, 0.0), -1.0, 1.0)
    if floats:
        raw = x.astype(f"<f{bits // 8}").tobytes()
    else:
        whole = np.minimum(np.rint(x * 2.0 ** (bits - 1)), 2.0 ** (bits - 1) - 1)
        if bits == 8:
            raw = (whole + 128).astype(np.uint8).tobytes()
        elif bits == 24:
            raw = whole.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        else:
            raw = whole.astype(f"<i{bits // 8}").tobytes()
    block = channels * bits // 8
    head = struct.pack("<HHIIHH", FLOATS if floats else PCM, channels, rate, rate * block, block, bits)
    body = b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def joined(parts: list[np.ndarray], rate: int, gap_ms: float) -> np.ndarray:
    """Clips end to end with silence between them."""
    silence = np.zeros(round(rate * gap_ms / 1000), np.float32)
    line = [p for part in parts for p in (silence, part)][1:]
    return np.concatenate(line) if line else np.zeros(0, np.float32)


def bounds(start: float | None, end: float | None, seconds: float | None, rate: int, n: int) -> tuple[int, int]:
    """The samples of a unit's clip: inside the recording, 40 ms at least where there is room, one sample at least."""
    whole = seconds or 0.0
    a = max(0.0, min(whole, start or 0.0))
    b = max(a, min(whole, end or a))
    if b - a < 0.04:
        b = min(whole, a + 0.04)
    first = max(0, min(n, round(a * rate)))
    return first, max(first + 1, min(n, round(b * rate)))


PROBE = "struct<format: string, sample_rate: int, channels: int, bits: int, frames: bigint, duration_seconds: double>"
_PROBE = pa.struct([("format", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("frames", pa.int64()), ("duration_seconds", pa.float64())])


def probe(payload: Column) -> Column:
    """struct(format, sample_rate, channels, bits, frames, duration_seconds) of a WAVE or FLAC payload; null for others."""

    @F.arrow_udf(PROBE)
    def read(payloads: pa.Array) -> pa.Array:
        found = (header(p) for p in payloads.to_pylist())
        return pa.array([h and {"format": h.format, "sample_rate": h.rate, "channels": h.channels, "bits": h.bits, "frames": h.frames, "duration_seconds": h.seconds} for h in found], _PROBE)

    return read(payload)


def mono_array(payloads: pa.Array, rate: int) -> pa.Array:
    """``mono`` of each payload; headers say how many samples there will be, so the batch's samples are written once, where they stay."""
    sizes = []
    for p in payloads:
        h = header(p.as_py())
        sizes.append(None if h is None or h.format != "wav" else -(-h.frames * rate // h.rate))
    ends = np.cumsum([0, *(n or 0 for n in sizes)])
    values = np.empty(ends[-1], np.float32)
    for i, p in enumerate(payloads):
        if sizes[i]:
            values[ends[i] : ends[i + 1]] = mono(p.as_py(), rate)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=pa.array([n is None for n in sizes], pa.bool_()))


def decoded(payload: Column, rate: int) -> Column:
    """A WAVE payload as array<float>: one channel at ``rate``, within [-1, 1]; null if it is not WAVE."""

    @F.arrow_udf("array<float>")
    def decode(payloads: pa.Array) -> pa.Array:
        return mono_array(payloads, rate)

    return decode(payload)


def encoded(x: Column, rate: Column, bits: int = 16, channels: int = 1, floats: bool = False) -> Column:
    """Samples, an array of numbers with channels interleaved, as WAVE; null without samples or a rate."""

    @F.arrow_udf("binary")
    def encode(xs: pa.Array, rates: pa.Array) -> pa.Array:
        both = zip(xs, rates.to_pylist(), strict=True)
        return pa.array([wave(np.asarray(x.values.cast(pa.float64()).fill_null(np.nan)), r, bits, channels, floats) if x.is_valid and r else None for x, r in both], pa.binary())

    return encode(x.cast("array<double>"), rate.cast("int"))


def clips(payload: Column, spans: Column, seconds: Column) -> Column:
    """Parts of a recording as an array of WAVE payloads at the recording's rate, one for each of ``spans``, array<struct<start, end>>.

    ``bounds`` says which samples. The recording is decoded once. A part of which nothing is left is null, and so is the array where the
    payload is not WAVE.
    """

    @F.arrow_udf("array<binary>")
    def cut(payloads: pa.Array, spans: pa.Array, lengths: pa.Array) -> pa.Array:
        out = []
        for p, parts, length in zip(payloads.to_pylist(), spans.to_pylist(), lengths.to_pylist(), strict=True):
            x = mono(p)
            if x is None or parts is None:
                out.append(None)
                continue
            rate = header(p).rate
            at = [bounds(s and s["start"], s and s["end"], length, rate, len(x)) for s in parts]
            out.append([wave(x[a:b], rate) if a < len(x) else None for a, b in at])
        return pa.array(out, pa.list_(pa.binary()))

    return cut(payload, spans.cast("array<struct<start: double, end: double>>"), seconds.cast("double"))


def concatenated(payloads: Column, rate: int, gap_ms: float = 80.0) -> Column:
    """An array of WAVE payloads as struct(bytes, duration_seconds): decoded at ``rate``, laid end to end with silence between. Null if one cannot be decoded."""
    kind = pa.struct([("bytes", pa.binary()), ("duration_seconds", pa.float64())])

    @F.arrow_udf("struct<bytes: binary, duration_seconds: double>")
    def join(groups: pa.Array) -> pa.Array:
        out = []
        for group in groups.to_pylist():
            parts = [mono(p, rate) for p in group or []]
            good = group is not None and all(p is not None for p in parts)
            line = joined(parts, rate, gap_ms) if good else None
            out.append({"bytes": wave(line, rate), "duration_seconds": len(line) / rate} if good else None)
        return pa.array(out, kind)

    return join(payloads)
