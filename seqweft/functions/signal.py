"""Signals as arrays: normalising, masking, stretching, noise, padding, features, duration loss."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import let


def lower_median(values: Column) -> Column:
    """The lower of the two middle values of an even number; null for an empty array."""
    s = F.sort_array(values)
    return F.get(s, F.floor((F.size(values) - 1) / 2).cast("int"))


def robust_normalised(values: Column, eps: float = 1e-6) -> Column:
    """(x - median) / max(median absolute deviation, eps), with lower medians."""
    return let(lower_median(values), lambda m: let(F.greatest(lower_median(F.transform(values, lambda x: F.abs(x - m))), F.lit(eps)), lambda d: F.transform(values, lambda x: (x - m) / d)))


def _spans(seed: int, n: int, spans: int, longest: int) -> list[tuple[int, int]]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(spans):
        size = int(rng.integers(0, min(longest, n) + 1))
        at = int(rng.integers(0, n - size + 1))
        out.append((at, at + size))
    return out


def time_masked(values, seed, spans: int = 2, longest: int = 20) -> Column:
    """Values with random spans set to 0; the spans follow from the seed column, so a row's result does not depend on its task."""

    def run(v: pd.Series, s: pd.Series) -> pd.Series:
        rows = []
        for x, k in zip(v, s, strict=True):
            y = np.array(x, float)
            for a, b in _spans(int(k), len(y), spans, longest):
                y[a:b] = 0
            rows.append(y)
        return pd.Series(rows)

    return F.pandas_udf(run, "array<double>")(values, seed)


def time_stretched(values, factor) -> Column:
    """Linear interpolation to round(n * factor) values and back to n."""

    def run(v: pd.Series, f: pd.Series) -> pd.Series:
        rows = []
        for x, k in zip(v, f, strict=True):
            y = np.asarray(x, float)
            m = max(1, round(len(y) * float(k)))
            if len(y) > 1:
                up = np.interp(np.linspace(0, len(y) - 1, m), np.arange(len(y)), y)
                y = np.interp(np.linspace(0, m - 1, len(y)), np.arange(m), up)
            rows.append(y)
        return pd.Series(rows)

    return F.pandas_udf(run, "array<double>")(values, factor)


def resampled(values, n) -> Column:
    """Linear interpolation to n values."""

    def run(v: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([np.interp(np.linspace(0, len(x) - 1, int(m)), np.arange(len(x)), np.asarray(x, float)) for x, m in zip(v, k, strict=True)])

    return F.pandas_udf(run, "array<double>")(values, n)


def noisy(values, seed, scale: float) -> Column:
    """Values with Gaussian noise that follows from the seed column."""

    def run(v: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x, float) + np.random.default_rng(int(k)).normal(0, scale, len(x)) for x, k in zip(v, s, strict=True)])

    return F.pandas_udf(run, "array<double>")(values, seed)


def padding_mask(length: Column, n: Column) -> Column:
    """True where a padded array has no value."""
    return F.transform(F.sequence(F.lit(1), n), lambda i: i > length)


def common_padding(masks: Column) -> Column:
    """A step is padding only if it is padding in all rows of array<array<boolean>>."""
    return F.transform(F.sequence(F.lit(0), F.size(F.get(masks, F.lit(0))) - 1), lambda i: F.forall(masks, lambda m: F.get(m, i)))


def fourier_features(tau: Column, frequencies: list[float]) -> Column:
    """[tau, tau^2, sin(2 pi f tau), ..., cos(2 pi f tau), ...]."""
    w = [F.lit(2 * np.pi * f) * tau for f in frequencies]
    return F.array(tau, tau * tau, *(F.sin(x) for x in w), *(F.cos(x) for x in w))


def weighted_mean(values: Column, weights: Column) -> Column:
    """Sum of w * x over the sum of w; null without weight."""
    pairs = F.zip_with(values, weights, lambda x, w: F.struct((x * w).alias("p"), w.alias("w")))
    total = F.aggregate(pairs, F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("w")), lambda a, z: F.struct((a["p"] + z["p"]).alias("p"), (a["w"] + z["w"]).alias("w")))
    return let(total, lambda t: F.try_divide(t["p"], t["w"]))


def duration_loss(logits: Column, targets: Column) -> Column:
    """Mean binary cross-entropy of logits against targets in 0..1."""
    each = F.zip_with(logits, targets, lambda x, t: F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x))))
    return F.try_divide(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), F.size(each))


def enter_rates(states: Column) -> Column:
    """struct(enter, extend, enter_rate, reentered) of a path over states 0-3 (enter) and 4-7 (extend)."""
    enter = F.size(F.filter(states, lambda s: s < 4))
    again = F.size(F.filter(states, lambda s, i: (s < 4) & (i > 0) & F.coalesce(F.get(states, i - 1) % 4 == s, F.lit(False))))
    n = F.size(states)
    return F.struct(enter.alias("enter"), (n - enter).alias("extend"), (enter / F.greatest(n, F.lit(1))).alias("enter_rate"), again.alias("reentered"))
