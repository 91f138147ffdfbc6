"""Features and comparisons of sample arrays, as higher-order column expressions.

A sound is a struct of sample_rate, channels, bits_per_sample and samples (an
array of channels).  Sums are in double precision.  NaN never matches: Spark
orders it above every number, so comparisons test for it first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the comparison.
SILENT = 0.001
TINY = 1e-10
NEAR_ZERO = 1e-9
RMS_LOW, RMS_HIGH = 0.8, 1.25
QUIET, QUIET_TO = 0.001, 0.002
TARGET_RMS = 0.5


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, v: a + v)


def clamp(r: Column) -> Column:
    """``r`` within -1 and 1; NaN stays NaN."""
    return F.when(F.isnan(r), r).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def rms(samples: Column) -> Column:
    """Root mean square over all channels, in single precision."""
    flat = F.flatten(samples)
    return F.sqrt(F.try_divide(dot(flat, flat), F.size(flat))).cast("float")


def rms_step(value: Column) -> Column:
    """Hundredths of an RMS, cut off, in single precision."""
    return (value.cast("float") * F.lit(100).cast("float")).cast("float").cast("int")


def rms_band(value: Column) -> Column:
    """Low and high RMS of what may match."""
    quiet = value < QUIET
    return F.struct(F.when(quiet, 0.0).otherwise(value * RMS_LOW).alias("low"), F.when(quiet, QUIET_TO).otherwise(value * RMS_HIGH).alias("high"))


def normalized(x: Column) -> Column:
    """A channel with mean 0 and norm 1; zeros if it hardly varies."""
    mean = F.try_divide(total(x), F.size(x))
    # A single-element array binds a value that several lambdas use.
    centred = F.transform(F.array(mean), lambda m: F.transform(x, lambda v: v.cast("double") - m))[0]
    return F.transform(F.array(centred), lambda c: F.transform(F.array(F.sqrt(dot(c, c))), lambda n: F.transform(c, lambda v: F.when(n < TINY, 0.0).otherwise(v / n)))[0])[0]


def _with(value: Column, use) -> Column:
    """``use(value)``, with the value computed once: a single-element array binds it for the lambdas inside."""
    return F.transform(F.array(value), use)[0]


def peak_normalized(samples: Column) -> Column:
    """All channels by their common peak; unchanged if there is hardly any."""
    peak = F.aggregate(samples, F.lit(0.0), lambda a, c: F.greatest(a, F.coalesce(F.aggregate(c, F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v.cast("double")))), F.lit(0.0))))
    return _with(peak, lambda p: F.transform(samples, lambda c: F.transform(c, lambda v: F.when(p < TINY, v.cast("double")).otherwise(v.cast("double") / p))))


def rms_normalized(samples: Column, target: float = TARGET_RMS) -> Column:
    return _with(rms(samples).cast("double"), lambda level: F.transform(samples, lambda c: F.transform(c, lambda v: F.when(level < TINY, v.cast("double")).otherwise(v.cast("double") * target / level))))


def by_mode(samples: Column, mode: str) -> Column:
    """Samples after a normalisation 'none', 'peak' or 'rms'."""
    return {"none": samples, "peak": peak_normalized(samples), "rms": rms_normalized(samples)}[mode]


def leading_silence(samples: Column) -> Column:
    """Frames before the first in which some channel is louder than SILENT; 0 if none is."""
    loud = F.aggregate(F.slice(samples, 2, F.greatest(F.size(samples) - 1, F.lit(0))), F.transform(samples[0], lambda v: F.abs(v) > SILENT), lambda a, c: F.zip_with(a, c, lambda was, v: was | (F.abs(v) > SILENT)))
    return F.greatest(F.array_position(loud, F.lit(True)) - 1, F.lit(0)).cast("int")


def deinterleaved(x: Column, channels: Column) -> Column:
    """An array for each channel; frames that aren't whole are cut off."""
    frames = F.floor(F.size(x) / channels).cast("int")
    return F.transform(F.sequence(F.lit(0), channels - 1), lambda c: F.filter(F.slice(x, 1, frames * channels), lambda v, i: i % channels == c))


def total_samples(samples: Column) -> Column:
    return F.coalesce(F.size(F.get(samples, 0)), F.lit(0))


def effective_length(samples: Column) -> Column:
    return total_samples(samples) - leading_silence(samples)


def megabytes(*arrays: Column) -> Column:
    """Memory of arrays of channels of 4-byte samples."""
    cells = [F.coalesce(F.aggregate(x, F.lit(0).cast("long"), lambda a, c: a + F.size(c)), F.lit(0).cast("long")) for x in arrays]
    return sum(cells[1:], cells[0]) * 4 / float(1 << 20)


def pearson_of_normalized(x: Column, y: Column) -> Column:
    # The clamp is the last step of the sum, so that it doesn't repeat the sum.
    r = F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, v: a + v, clamp)
    return F.when((F.size(x) != F.size(y)) | (F.size(x) == 0), 0.0).otherwise(r)


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation, with fixed answers for short and constant input."""
    n = F.size(x).cast("double")
    sx, sy, sxx, syy, sxy = total(x), total(y), dot(x, x), dot(y, y), dot(x, y)
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    same = F.forall(F.zip_with(x, y, lambda a, b: F.abs(a.cast("double") - b.cast("double")) <= 1e-6), lambda s: s)
    return (
        F.when((F.size(x) != F.size(y)) | (F.size(x) == 0), 0.0)
        .when((F.size(x) < 4) & same, 1.0)
        .when((vx < TINY) & (vy < TINY), F.when(F.abs(sx / n - sy / n) < 1e-6, 1.0).otherwise(0.0))
        .when((vx < TINY) | (vy < TINY), 0.0)
        .otherwise(clamp((sxy - sx * sy / n) / F.sqrt(F.when((vx >= TINY) & (vy >= TINY), vx * vy).otherwise(F.lit(1.0)))))
    )


def r_squared(x: Column, y: Column) -> Column:
    """Coefficient of determination of ``y`` against ``x``, within 0 and 1."""
    n = F.size(x).cast("double")
    error = F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") - b.cast("double")), F.lit(0.0), lambda a, v: a + v * v)
    spread = dot(x, x) - total(x) * total(x) / n
    fit = 1 - error / F.when(spread >= TINY, spread).otherwise(F.lit(1.0))
    return F.when((F.size(x) != F.size(y)) | (F.size(x) == 0) | (spread < TINY), 0.0).when(F.isnan(fit), fit).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fit)))


def all_zero(x: Column) -> Column:
    """Whether no value is off zero; NaN isn't."""
    return F.forall(x, lambda v: F.isnan(v) | (F.abs(v) <= NEAR_ZERO))


def same_format(a: Column, b: Column) -> Column:
    return (a["sample_rate"] == b["sample_rate"]) & (a["channels"] == b["channels"]) & (a["bits_per_sample"] == b["bits_per_sample"]) & (total_samples(a["samples"]) == total_samples(b["samples"]))


def correlation(a: Column, b: Column) -> Column:
    """Correlation of the first channels of two sounds; 0 where formats differ or one alone is constant."""
    x, y = a["samples"][0], b["samples"][0]
    nx, ny = normalized(x), normalized(y)
    zx, zy = all_zero(nx), all_zero(ny)
    return F.when(~same_format(a, b), 0.0).when(zx & zy, pearson(x, y)).when(zx | zy, 0.0).otherwise(pearson_of_normalized(nx, ny))


def matches(r: Column, threshold: Column | float) -> Column:
    """Whether a correlation reaches a threshold; NaN doesn't."""
    return F.nanvl(r, F.lit(-2.0)) >= threshold
