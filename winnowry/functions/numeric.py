"""Numbers that may be missing, vectors and weighted means."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(x) with x bound to a value that's computed once; a function's body over an array would compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def finite(value: Column) -> Column:
    """As a double; null where it can't be read, isn't a number or is infinite."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def or_default(x: Column, default: float) -> Column:
    """The default where x is null or zero."""
    return F.coalesce(F.nullif(x, F.lit(0).cast("double")), F.lit(default))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column, eps: float = 1e-12) -> Column:
    return let(F.greatest(F.sqrt(dot(v, v)), F.lit(eps)), lambda norm: F.transform(v, lambda x: x.cast("double") / norm))


def weighted_mean(parts: Mapping[str, Column], weights: Mapping[str, float], scale: float = 100.0) -> Column:
    total = sum(weights.values())
    if total <= 0:
        return F.lit(0.0)
    out = F.lit(0.0)
    for name, weight in weights.items():
        out = out + F.lit(float(weight)) * parts[name]
    return F.lit(scale) * out / F.lit(float(total))


def three_way(lower: Column, upper: Column, accept: Column, reject: Column, reject_enabled: Column) -> Column:
    return F.when(lower >= accept, "accept").when(reject_enabled & (upper <= reject), "reject").otherwise("uncertain")


def longest_run(flags: Column) -> Column:
    """struct(start, length) of the longest run of true; the first of equals."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("run"), F.lit(0).alias("start"), F.lit(0).alias("length"))

    def fold(a: Column, x: Column) -> Column:
        run = F.when(F.coalesce(x, F.lit(False)), a.run + 1).otherwise(F.lit(0))
        longer = run > a.length
        return F.struct((a.i + 1).alias("i"), run.alias("run"), F.when(longer, a.i - run + 1).otherwise(a.start).alias("start"), F.when(longer, run).otherwise(a.length).alias("length"))

    return F.aggregate(flags, start, fold, lambda a: F.struct(a.start.alias("start"), a.length.alias("length")))


def mean_of(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs))


def variation(xs: Column) -> Column:
    """Population standard deviation over the mean's absolute value; null for an empty array or a mean of 0."""
    spread = lambda mean: F.sqrt(mean_of(F.transform(xs, lambda x: (x - mean) * (x - mean))))
    return let(mean_of(xs), lambda mean: F.when(mean != 0, spread(mean) / F.abs(mean)))


def rms_db(samples: Column) -> Column:
    rms = F.sqrt(mean_of(F.transform(samples, lambda x: x.cast("double") * x.cast("double"))))
    return F.lit(20.0) * F.log10(F.greatest(F.coalesce(rms, F.lit(0.0)), F.lit(1e-12)))


def quantile_of(xs: Column, q: float) -> Column:
    """Linear interpolation between the order statistics of an array."""
    s = F.sort_array(xs)
    at = (F.size(s) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.coalesce(F.get(s, low + 1), F.get(s, low))
    return a + (b - a) * (at - low)
