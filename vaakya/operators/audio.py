"""Audio: bounds and checks as native arithmetic, waveforms as arrays, bytes in Arrow UDFs."""

from __future__ import annotations

import io
import sys
import wave

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaakya.functions import fixed


def clip_bounds(start: Column, end: Column, total: Column, buffer: float = fixed.CLIP_BUFFER, rate: int = fixed.SAMPLE_RATE) -> Column:
    """struct<first, last> sample indices of a clip, with its buffer inside the recording; null if it is empty."""
    first = (F.greatest(F.lit(0.0), start - buffer) * rate).cast("long")
    last = (F.least(total, end + buffer) * rate).cast("long")
    stop = F.least(last, (total * rate).cast("long"))
    return F.when(stop > first, F.struct(first.alias("first"), last.alias("last")))


def file_check(exists: Column, size: Column, duration: Column) -> Column:
    """``OK`` or why a recording cannot be used; a duration that cannot be read is -1."""
    return (
        F.when(~exists, F.lit("File does not exist"))
        .when(size == 0, F.lit("File is empty"))
        .when(F.coalesce(duration, F.lit(-1.0)) <= 0, F.lit("Cannot determine duration or zero-length"))
        .when(duration > fixed.MAX_AUDIO, F.lit("Unusually long"))
        .otherwise(F.lit("OK"))
    )


def frame_rms(wave_: Column, rate: int = fixed.SAMPLE_RATE) -> Column:
    """Root mean square of frames of 25 ms every 10 ms, frames centred and padded with zeros."""
    size, hop = int(0.025 * rate), int(0.010 * rate)
    pad = F.array_repeat(F.lit(0.0), size // 2)
    padded = F.concat(pad, F.transform(wave_, lambda x: x.cast("double")), pad)
    frames = F.floor((F.size(padded) - size) / hop).cast("int")
    square = lambda p, k: F.aggregate(F.slice(p, k * hop + 1, size), F.lit(0.0), lambda a, x: a + x * x)
    return F.element_at(
        F.transform(F.array(padded), lambda p: F.transform(F.sequence(F.lit(0), frames), lambda k: F.sqrt(square(p, k) / size))), 1
    )


def snr(wave_: Column, rate: int = fixed.SAMPLE_RATE) -> Column:
    """Decibels between the loudest and the quietest tenth of frames; -Infinity under ten frames."""

    def of(levels: Column) -> Column:
        tenth = F.greatest(F.lit(1), (F.size(levels) / 10).cast("int"))
        mean = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / tenth + 1e-10
        loud, quiet = mean(F.slice(levels, -tenth, tenth)), mean(F.slice(levels, F.lit(1), tenth))
        return F.when(F.size(levels) >= 10, 20 * F.log10(loud / quiet)).otherwise(F.lit(float("-inf")))

    return F.element_at(F.transform(F.array(F.array_sort(frame_rms(wave_, rate))), of), 1)


def _read(data: bytes) -> tuple[np.ndarray, int]:
    with wave.open(io.BytesIO(data)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        raw = f.readframes(f.getnframes())
    kinds = {1: (np.uint8, 128.0, 128.0), 2: ("<i2", 0.0, 32768.0), 4: ("<i4", 0.0, 2147483648.0)}
    kind, zero, full = kinds[width]
    values = (np.frombuffer(raw, kind).astype(np.float64) - zero) / full
    return values.reshape(-1, channels).mean(1), rate


def resample(values: np.ndarray, rate: int, target: int = fixed.SAMPLE_RATE) -> np.ndarray:
    """Linear resampling; the same array if the rates are equal."""
    if rate == target or not len(values):
        return values
    n = int(np.ceil(len(values) * target / rate))
    return np.interp(np.arange(n) * rate / target, np.arange(len(values)), values)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def load(content: pd.Series) -> pd.Series:
    """Mono samples at 16 kHz of PCM files; null if a file cannot be read."""

    def one(data):
        try:
            return resample(*_read(bytes(data)))
        except (wave.Error, EOFError, KeyError, TypeError, ValueError):
            return None

    return content.map(one)


@F.pandas_udf(T.DoubleType())
def duration(content: pd.Series) -> pd.Series:
    """Seconds, by the header; -1 if it cannot be read."""

    def one(data):
        try:
            with wave.open(io.BytesIO(bytes(data))) as f:
                return f.getnframes() / f.getframerate()
        except (wave.Error, EOFError, TypeError, ZeroDivisionError):
            return -1.0

    return content.map(one)


@F.pandas_udf(T.BinaryType())
def clip(content: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    """A 16 kHz mono PCM file of the part between two times and their buffer; null if it is empty."""

    def one(data, begin, stop):
        try:
            values = resample(*_read(bytes(data)))
        except (wave.Error, EOFError, KeyError, TypeError, ValueError):
            return None
        rate = fixed.SAMPLE_RATE
        total = len(values) / rate
        part = values[int(max(0.0, begin - fixed.CLIP_BUFFER) * rate) : int(min(total, stop + fixed.CLIP_BUFFER) * rate)]
        if not len(part):
            return None
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(2)
            f.setframerate(rate)
            f.writeframes((np.clip(part, -1, 1 - 2**-15) * 32768).astype("<i2").tobytes())
        return out.getvalue()

    return pd.Series([one(*x) for x in zip(content, start, end)])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
