"""Waveforms: WAV decoding in Python batches, array operators in expressions."""

from __future__ import annotations

import io
import math
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.skew import with_groups
from ..session import Scratch, ship


def crop_pad(samples: Column, n: int) -> Column:
    """The middle ``n`` values, or the values and zeros behind them."""
    size = F.size(samples)
    start = F.floor((size - n) / 2).cast("int")
    zero = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(n) - size, F.lit(0)))
    return F.when(size >= n, F.slice(samples, F.greatest(start, F.lit(0)) + 1, F.lit(n))).otherwise(F.concat(samples, zero))


def moments(values: Column) -> Column:
    """Struct of ``n``, ``mean`` and ``m2`` (squared distances from the mean) of an array; nulls don't count, an empty one has a null mean.

    The mean comes first and the distances from it second, with a correction for its rounding, so large offsets cancel nothing.
    """
    own = F.filter(values, lambda x: x.isNotNull())
    n = F.size(own).cast("long")
    rough = F.aggregate(own, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.nullif(n, F.lit(0).cast("long"))
    far = F.aggregate(
        F.transform(own, lambda x: x.cast("double") - rough), F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q")), lambda a, d: F.struct((a.d + d).alias("d"), (a.q + d * d).alias("q"))
    )
    return F.when(values.isNotNull(), F.struct(n.alias("n"), (rough + far.d / n).alias("mean"), (far.q - F.try_divide(far.d * far.d, n)).alias("m2")))


def merged(a: Column, b: Column) -> Column:
    """The moments of two sets together (Chan's formula); an empty set changes nothing."""
    n, d = a.n + b.n, b.mean - a.mean
    both = F.struct(n.alias("n"), (a.mean + d * b.n / n).alias("mean"), (a.m2 + b.m2 + d * d * a.n * b.n / n).alias("m2"))
    return F.when(b.n == 0, a).when(a.n == 0, b).otherwise(both)


def mean_std(values: Column) -> Column:
    """Struct of mean and sample deviation (n - 1) of an array; the mean is null for an empty one, the deviation for fewer than two values."""
    m = moments(values)
    return F.struct(m.mean.alias("mean"), F.when(m.n > 1, F.sqrt(m.m2 / (m.n - 1))).alias("std"))


def pooled(rows: DataFrame, key: str, values: str) -> DataFrame:
    """``key, n, mean, std`` over all values of all arrays of a key: one triple a row, merged as distances from one mean of the key.

    Aggregates are combined before the shuffle and no array is exploded; nulls in ``key`` are left out.
    """
    with Scratch(rows.sparkSession) as scratch:
        own = scratch.cut(rows.select(F.col(key).alias("key"), F.inline(F.array(moments(F.col(values))))).where("n > 0"))
        near = with_groups(own, "key", own.count(), scratch, base=F.min("mean"))
        n, d = F.sum("n"), F.col("mean") - F.col("base")
        sums = near.groupBy("key").agg(n.alias("n"), F.first("base").alias("base"), F.sum(F.col("n") * d).alias("d"), F.sum(F.col("m2") + F.col("n") * d * d).alias("q"))
        m2 = F.greatest(F.col("q") - F.col("d") * F.col("d") / F.col("n"), F.lit(0.0))
        return scratch.keep(sums.select(F.col("key").alias(key), "n", (F.col("base") + F.col("d") / F.col("n")).alias("mean"), F.when(F.col("n") > 1, F.sqrt(m2 / (F.col("n") - 1))).alias("std")))


def _sigmoid(x: float) -> float:
    try:
        return 1 / (1 + math.exp(-x))
    except OverflowError:  # of exp, for a logit far below 0
        return 0.0


@F.arrow_udf(DoubleType())
def _sigmoid_udf(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else _sigmoid(v) for v in x.to_pylist()], pa.float64())


def sigmoid(x: Column) -> Column:
    """By the C library's exp, as Python and DuckDB have it: Spark's own differs in the last bit of one value in ten."""
    ship(SparkSession.getActiveSession())
    return _sigmoid_udf(x.cast("double"))


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono float samples of 16-bit PCM."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2 or not 1 <= w.getnchannels() <= 8:
            raise ValueError("16-bit PCM with one to eight channels is supported")
        raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
        return w.getframerate(), (raw.astype(np.float32) / 32768).mean(axis=1)


def probe(files: DataFrame) -> DataFrame:
    """``path, sample_rate, duration_sec, error`` of binary files; a file that can't be read gives an error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rate, samples = decode_wav(bytes(content))
                    out.append((path, rate, len(samples) / rate, None if len(samples) else "empty"))
                except (ValueError, EOFError, wave.Error) as e:
                    out.append((path, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "sample_rate", "duration_sec", "error"]).astype({"sample_rate": "Int32"})

    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, sample_rate int, duration_sec double, error string")


def mel_filters(rate: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangles equally spaced on the mel scale 2595 log10(1 + f / 700)."""
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), n_mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (f - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(samples: np.ndarray, rate: int, n_fft: int = 512, hop: int = 160, n_mels: int = 64) -> np.ndarray:
    padded = np.pad(samples, (0, max(0, n_fft - len(samples))))
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    power = np.abs(np.fft.rfft(frames * np.hanning(n_fft + 1)[:-1], axis=1)) ** 2
    out = np.log(power @ mel_filters(rate, n_fft, n_mels).T + 1e-6)
    return ((out - out.mean()) / (out.std() + 1e-6)).T


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Rational resampling with a Kaiser-windowed sinc (beta 5, ten zero crossings a side), phase by phase."""
    divisor = math.gcd(rate, to)
    up, down = to // divisor, rate // divisor
    if up == down or not len(samples):
        return samples.astype(np.float32)
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    out = np.zeros(-(-len(samples) * up // down))
    at = np.arange(len(out)) * down  # places on the finer grid
    for phase in range(min(up, len(out))):
        here = at[phase::up]  # equal remainders modulo up
        p = here[0] % up
        reach = np.arange(-((half + p) // up), (half - p) // up + 1)
        index = here[:, None] // up - reach[None, :]
        inside = (index >= 0) & (index < len(samples))
        weight = taps[half + p + reach * up]
        out[phase::up] = (np.where(inside, samples[np.clip(index, 0, len(samples) - 1)], 0.0) * weight).sum(axis=1)
    return out.astype(np.float32)


def encode_float_wav(samples: np.ndarray, rate: int) -> bytes:
    """Mono 32-bit float WAV: amplitudes stay as they are."""
    data = samples.astype("<f4").tobytes()
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 3, 1, rate, rate * 4, 4, 32) + struct.pack("<4sI", b"data", len(data))
    return b"RIFF" + struct.pack("<I", 4 + len(head) + len(data)) + b"WAVE" + head + data


def preprocess(files: DataFrame, *, sample_rate: int, max_seconds: float, max_bytes: int) -> DataFrame:
    """``path, wav, sample_rate, duration_sec, error``: mono float WAVs at one rate; a file beyond a limit gives an error row."""

    def one(path: str, content: bytes) -> tuple:
        if len(content) > max_bytes:
            raise ValueError("file size limit")
        rate, samples = decode_wav(content)
        if not len(samples):
            raise ValueError("empty")
        if len(samples) / rate > max_seconds:
            raise ValueError("duration limit")
        out = resample(samples, rate, sample_rate)
        return path, encode_float_wav(out, sample_rate), sample_rate, len(out) / sample_rate, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out.append(one(path, bytes(content)))
                except (ValueError, EOFError, wave.Error) as e:
                    out.append((path, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "wav", "sample_rate", "duration_sec", "error"]).astype({"sample_rate": "Int32"})

    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, wav binary, sample_rate int, duration_sec double, error string")


def tone_frequency(text_id: Column, voice_id: Column, seed: Column) -> Column:
    """The fixture tone of a job in Hz: 220 and up, by the first two digest bytes of its identity; nulls read ``None``."""
    none = F.lit("None")
    key = F.concat_ws("\0", text_id, F.coalesce(voice_id.cast("string"), none), F.coalesce(seed.cast("string"), none))
    return F.conv(F.substring(F.sha2(key, 256), 1, 4), 16, 10).cast("int") % 440 + 220


def tones(jobs: DataFrame, rate: int = 16_000, seconds: float = 0.08) -> DataFrame:
    """``job_id, frequency_hz, samples`` of the fixture generator, without Python."""
    n = max(1, round(rate * seconds))
    own = jobs.select("job_id", tone_frequency(F.col("text_id"), F.col("voice_id"), F.col("seed")).alias("frequency_hz"))
    wave_at = lambda i: (0.05 * F.sin(2 * math.pi * F.col("frequency_hz") * i / rate)).cast("float")
    return own.withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), wave_at))
