"""Grids on a timeline: legal durations, windows, cells, even samples and names of frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FrameGrid:
    """Frames per second, and the legal frame counts: those with ``remainder`` modulo ``modulus`` in range."""

    fps: int = 24
    modulus: int = 17
    remainder: int = 5
    least: int = 107
    most: int = 345

    @property
    def legal(self) -> list[int]:
        return [n for n in range(self.least, self.most + 1) if n % self.modulus == self.remainder]

    @property
    def shortest(self) -> float:
        return self.least / self.fps

    @property
    def longest(self) -> float:
        return self.most / self.fps


GRID = FrameGrid()


def frames(seconds: Column, grid: FrameGrid = GRID) -> Column:
    """Seconds as a number of frames, at least one; halves go to the even number."""
    return F.greatest(F.lit(1), F.bround(seconds * grid.fps).cast("int"))


def snapped(count: Column, grid: FrameGrid = GRID) -> Column:
    """The nearest legal number of frames, the smaller one of two equally near."""
    steps = (grid.most - grid.least) // grid.modulus
    below = F.least(F.lit(steps), F.greatest(F.lit(0), F.floor((count - grid.least) / grid.modulus).cast("int")))
    low = F.lit(grid.least) + below * grid.modulus
    high = F.least(F.lit(grid.least + steps * grid.modulus), low + grid.modulus)
    return F.when(F.abs(high - count) < F.abs(count - low), high).otherwise(low).cast("int")


def snapped_seconds(seconds: Column, grid: FrameGrid = GRID) -> Column:
    return snapped(frames(seconds, grid), grid) / F.lit(float(grid.fps))


def cell_starts(start: Column, end: Column, step: int = 250, most: int = 12) -> Column:
    """Starts of the cells of a span, ``step`` ms apart, at most so many and at least one."""
    count = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil((end - start) / step).cast("int")))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: start + i * step)


def hop_starts(duration: Column, hop: int = 2500, tail: int = 50) -> Column:
    """Starts of the hopping windows of a timeline: multiples of ``hop`` up to ``tail`` ms before its end."""
    return F.when(duration > tail, F.transform(F.sequence(F.lit(0).cast("long"), F.floor((duration - tail - 1) / hop)), lambda i: i * hop)).otherwise(F.array(F.lit(0).cast("long")))


def window_starts(duration: Column, cuts: Column, hop: int = 2500, near: int = 250) -> Column:
    """Hopping starts and, of the cuts inside the timeline, those not within ``near`` ms of a start or of a cut taken before."""
    grid = hop_starts(duration, hop)
    inside = F.filter(F.array_sort(F.array_distinct(cuts)), lambda c: (c > 0) & (c < duration))
    taken = F.aggregate(inside, grid, lambda acc, c: F.when(F.exists(acc, lambda s: F.abs(s - c) < near), acc).otherwise(F.array_append(acc, c)))
    return F.array_sort(taken)


def spread(n: Column, limit: int) -> Column:
    """Positions 0..n-1, or ``limit`` of them spread evenly with both ends."""
    if limit <= 1:
        return F.when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    even = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (n - 1) / (limit - 1)).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= limit, F.sequence(F.lit(0), n - 1)).otherwise(even)


def probe_times(start: Column, end: Column) -> Column:
    """Three probes of a span, at 8, 50 and 92 hundredths."""
    return F.array(*[start + (end - start) * share for share in (0.08, 0.5, 0.92)])


def chunk_starts(length: Column, size: int = 240_000, hop: int = 239_600) -> Column:
    """Starts of overlapping chunks that cover a length."""
    return F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil((length - size) / hop)).cast("long")), lambda i: i * hop)


def bucket_middles(duration: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i + 0.5) / n * duration)


def frame_name(ms: Column) -> Column:
    """Centiseconds, zero-padded to five digits."""
    return F.lpad(F.bround(ms / 10).cast("long").cast("string"), 5, "0")


def render_timeout(seconds: Column, steps: Column, configured: int = 1800) -> Column:
    return F.greatest(F.lit(configured), seconds * steps * 45 + 600, F.lit(3600))


def stable_seed(*parts: Column) -> Column:
    """A repeatable 32-bit seed: the first eight hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")
