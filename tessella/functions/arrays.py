"""Array columns: padding with masks, codes, waveforms, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padding_ratio(total: Column, largest: Column, count: Column) -> Column:
    """Share of a padded batch that is padding; 0 of an empty one."""
    padded = (largest * count).cast("double")
    return F.when(padded == 0, F.lit(0.0)).otherwise((padded - total) / padded)


def pad(values: Column, length: Column, fill: Column) -> Column:
    """``values`` filled up to ``length``."""
    return F.concat(values, F.array_repeat(fill, F.greatest(length - F.size(values), F.lit(0)).cast("int")))


def pad_mask(values: Column, length: Column) -> Column:
    """true where :func:`pad` keeps a value."""
    return F.concat(F.array_repeat(F.lit(True), F.size(values)), F.array_repeat(F.lit(False), F.greatest(length - F.size(values), F.lit(0)).cast("int")))


def pad_channels(wave: Column, length: Column) -> Column:
    """Pad each channel of [channel][time]."""
    return F.transform(wave, lambda c: pad(c, length, F.lit(0.0).cast("float")))


def pad_frames(codes: Column, length: Column) -> Column:
    """Pad the frame axis of [frame][codebook] with zero frames."""
    width = F.coalesce(F.size(F.get(codes, F.lit(0))), F.lit(0))
    return pad(codes, length, F.array_repeat(F.lit(0), width))


def masked_length(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda x: x)).cast("long")


def mono(wave: Column) -> Column:
    """Mean of the channels of [channel][time]."""
    n = F.size(wave)
    first = F.transform(F.get(wave, F.lit(0)), lambda x: x.cast("double"))
    total = F.aggregate(F.slice(wave, 2, F.greatest(n - 1, F.lit(0))), first, lambda a, c: F.zip_with(a, c, lambda x, y: x + y))
    return F.transform(total, lambda x: (x / n).cast("float"))


def resample(wave: Column, rate: Column, target: Column) -> Column:
    """Linear interpolation of a mono wave to another sample rate; index arithmetic only."""
    n = F.size(wave)
    m = F.floor((n.cast("double") * target + rate / 2) / rate).cast("int")
    position = lambda i: F.least(i.cast("double") * rate / target, (n - 1).cast("double"))

    def at(i: Column) -> Column:
        lo = F.floor(position(i)).cast("int")
        hi = F.least(lo + 1, n - 1)
        part = position(i) - lo
        return (F.get(wave, lo) * (1 - part) + F.get(wave, hi) * part).cast("float")

    return F.when((rate == target) | (n == 0), wave).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), at))


def duration_seconds(wave: Column, rate: Column) -> Column:
    n = F.coalesce(F.size(F.get(wave, F.lit(0))), F.lit(0))
    return F.when((F.size(wave) == 0) | (n == 0), F.lit(0.0)).otherwise(n.cast("double") / rate)


def peak_amplitude(wave: Column) -> Column:
    top = F.array_max(F.transform(wave, lambda c: F.array_max(F.transform(c, F.abs))))
    return F.coalesce(top.cast("double"), F.lit(0.0))


def all_finite(wave: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return ~F.exists(wave, lambda c: F.exists(c, bad))


def codes_in_range(codes: Column, sizes: list[int]) -> Column:
    """Every frame has one code for each codebook, each within the codebook's size."""
    limits = F.array(*map(F.lit, sizes))
    return F.forall(codes, lambda f: (F.size(f) == len(sizes)) & F.forall(F.zip_with(f, limits, lambda x, top: (x >= 0) & (x < top)), lambda ok: F.coalesce(ok, F.lit(False))))


def fixed_shape(values: Column) -> Column:
    """``values``, or an error unless all its arrays have one size."""
    same = F.size(F.array_distinct(F.transform(values, F.size))) <= 1
    return F.when(same, values).otherwise(F.raise_error(F.lit("values of one batch must have one shape")))
