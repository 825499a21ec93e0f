"""Frames of sound: energies in a band, speech thresholds, silence, fades."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.operators.sequences import boolean_islands


def band_energy(rate: int = 16_000, frame: int = 160, size: int = 512, low: int = 180, high: int = 3800):
    """A column function: samples -> energy of the band in every frame (10 ms at 16 kHz)."""

    @F.pandas_udf("array<double>")
    def energies(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: frame_energies(np.asarray(x if x is not None else [], np.float64), rate, frame, size, low, high).tolist())

    return energies


def frame_energies(x: np.ndarray, rate: int = 16_000, frame: int = 160, size: int = 512, low: int = 180, high: int = 3800, most: int | None = None) -> np.ndarray:
    """The energy of the band in every whole frame of samples, or in the first ``most``; behind the end there is silence."""
    n = len(x) // frame if most is None else most
    bins = np.fft.rfftfreq(size, 1 / rate)
    band, window = (bins >= low) & (bins <= high), np.hanning(size)
    x = np.concatenate([x, np.zeros(max(0, n * frame + size - len(x)))])
    out = np.zeros(n)
    for k in range(0, n, 1024):  # no more spectra at once
        views = np.lib.stride_tricks.sliding_window_view(x, size)[k * frame : min(k + 1024, n) * frame : frame][: n - k]
        out[k : k + len(views)] = np.sqrt(np.mean(np.abs(np.fft.rfft(views * window, axis=1)[:, band]) ** 2, axis=1))
    return out


def speech_islands(frames: DataFrame, key: str, hole: int = 18, least: int = 15) -> DataFrame:
    """Islands of speech from frames (key, i, energy): loud frames by an adaptive threshold, holes of up to ``hole`` frames
    closed, islands of at least ``least`` frames kept. Frames are 10 ms."""
    levels = frames.groupBy(key).agg(F.max("energy").alias("peak"), F.percentile("energy", 0.25).alias("p25"), F.percentile("energy", 0.7).alias("p70"))
    line = F.greatest(F.lit(0.04) * F.col("peak"), F.lit(1.15) * F.col("p70"), F.lit(8.0) * F.col("p25"))
    loud = frames.join(levels, key).withColumn("loud", (F.col("energy") > 0) & (F.col("energy") >= line)).select(key, "i", "loud")
    return boolean_islands(loud, key, "loud", "i", hole, least).select(key, (F.col("first") * 10).alias("t0"), ((F.col("last") + 1) * 10).alias("t1"))


def leading_silence(energies: Column, line: float, most: int = 8) -> Column:
    """Silent frames at the head, at most so many."""
    first = F.array_min(F.filter(F.transform(energies, lambda x, i: F.when(x > line, i)), lambda i: i.isNotNull()))
    return F.least(F.coalesce(first, F.size(energies)), F.lit(most))


def room_tone(energies: Column, block: int = 6, tail: int = 80) -> Column:
    """Where the quietest block of the last frames that isn't silent begins; NULL if all are."""
    start = F.greatest(F.lit(0), F.size(energies) - tail)
    blocks = F.transform(F.sequence(start, F.greatest(start, F.size(energies) - block)), lambda i: F.struct(F.aggregate(F.slice(energies, i + 1, block), F.lit(0.0), lambda a, x: a + x).alias("sum"), i.alias("i")))
    return F.array_min(F.filter(blocks, lambda b: b["sum"] > 0))["i"]


def faded(samples: Column, n: int) -> Column:
    """Samples with linear fades of n samples at both ends."""
    size = F.size(samples)
    return F.transform(samples, lambda x, i: x * F.least(F.lit(1.0), (i + 1) / n, (size - i) / n))


def tiled(tone: Column, size: Column) -> Column:
    """A tone repeated to a length."""
    return F.slice(F.flatten(F.array_repeat(tone, F.ceil(size / F.greatest(F.size(tone), F.lit(1))).cast("int"))), F.lit(1), size)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(logits, lambda x: F.exp(x - top) / total)


def pooled(frames: Column) -> Column:
    """The mean of frames (arrays of one length), place by place."""
    n = F.size(frames)
    first = F.transform(frames[0], lambda x: F.lit(0.0))
    return F.transform(F.aggregate(frames, first, lambda acc, f: F.zip_with(acc, f, lambda a, b: a + b)), lambda x: x / n)


def energy_summary(energy: Column) -> list[Column]:
    """Aggregates of frame energies: the peak, and the 25th and 70th percentile."""
    return [F.max(energy).alias("peak"), F.round(F.percentile(energy, 0.25), 6).alias("p25"), F.round(F.percentile(energy, 0.7), 6).alias("p70")]


def capped(samples: Column, most: float = 0.84) -> Column:
    """Samples scaled down so that the loudest is at ``most``; quieter ones stay as they are."""
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    return F.when(peak > most, F.transform(samples, lambda x: x * most / peak)).otherwise(samples)


def without_holes(samples: Column, tone: Column, least: int) -> Column:
    """Samples with every run of at least ``least`` zeros filled by the tone, over and over; shorter runs stay.

    A run is told by where it ends: a zero belongs to the last sample that isn't one, and the run behind that sample is as
    long as the way to the next one.
    """
    size = F.size(samples)
    loud = F.filter(F.transform(samples, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    edges = F.concat(F.array(F.lit(-1)), loud, F.array(size))
    holes = F.filter(F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.size(edges) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda h: h["b"] - h["a"] - 1 >= least)
    fill = lambda i: F.get(tone, ((i - F.array_max(F.transform(F.filter(holes, lambda h: h["a"] < i), lambda h: h["a"])) - 1) % F.size(tone)).cast("int"))
    return F.transform(samples, lambda x, i: F.when((x == 0) & F.exists(holes, lambda h: (h["a"] < i) & (i < h["b"])), fill(i)).otherwise(x))


def resampled(samples: Column, rate: int, wanted: int = 16_000) -> Column:
    """Samples of one rate at another, by straight lines between neighbours."""
    n = F.size(samples)
    count = F.floor(n * wanted / rate).cast("int")

    def at(i: Column) -> Column:
        place = i * (rate / wanted)
        low = F.least(F.floor(place).cast("int"), n - 1)
        high = F.least(low + 1, n - 1)
        return F.get(samples, low) + (F.get(samples, high) - F.get(samples, low)) * (place - low)

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(F.array().cast("array<double>"))
