"""Sample arithmetic on array columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int16(x: Column) -> Column:
    """Float sample to 16 bits: scaled by 32768, clipped, truncated toward zero."""
    return F.least(F.greatest(x.cast("double") * 32768, F.lit(-32768.0)), F.lit(32767.0)).cast("smallint")


def to_float(x: Column) -> Column:
    return x / F.lit(32768.0)


def downmix(samples: Column, channels: int) -> Column:
    """Mean over channels of whole frames, truncated; a partial frame at the end is dropped."""
    frames = F.floor(F.size(samples) / channels).cast("int")
    mean = lambda i: F.aggregate(F.slice(samples, i * channels + 1, F.lit(channels)), F.lit(0), lambda a, x: a + x.cast("int")) / channels
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), lambda i: mean(i).cast("smallint"))).otherwise(F.expr("array()").cast("array<smallint>"))


def resample(samples: Column, source: int, target: int) -> Column:
    """Linear interpolation at int(n * target / source) evenly spaced places from first to last sample."""
    n = F.size(samples)
    m = F.floor(n * F.lit(target) / source).cast("int")
    place = lambda i: F.when(m > 1, i * (n - 1) / (m - 1)).otherwise(F.lit(0.0))
    low = lambda i: F.least(F.floor(place(i)).cast("int"), F.greatest(n - 2, F.lit(0)))
    at = lambda k: F.get(samples, F.least(k, n - 1)).cast("double")
    value = lambda i: at(low(i)) + (at(low(i) + 1) - at(low(i))) * (place(i) - low(i))
    return F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), value)).otherwise(F.expr("array()").cast("array<double>"))


def frames(samples: Column, size: int) -> Column:
    """Whole frames; the remainder is dropped."""
    whole = F.floor(F.size(samples) / size).cast("int")
    return F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.slice(samples, i * size + 1, F.lit(size)))).otherwise(F.array())


def energy(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def rms(samples: Column) -> Column:
    return F.sqrt(energy(samples) / F.size(samples))


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
