"""Entropy, fractal and complexity measures of one series per row.

What sums and sorts can express stays an expression; measures with loops that depend on the data
are Arrow-batched pandas functions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as A


def value_entropy(a: Column) -> Column:
    """Entropy of the elements' shares of the sum of absolute values."""
    return A.let(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x)) + F.lit(1e-9), lambda t: -A.total(F.transform(a, lambda x: F.abs(x) / t * F.ln(F.abs(x) / t + F.lit(1e-9)))))


def hurst(a: Column) -> Column:
    """Rescaled range of the cumulated deviations, as an exponent of the length."""

    def over(c: Column) -> Column:
        path = A.cumulate(c)
        reach = A.let(path, lambda p: F.array_max(p) - F.array_min(p))
        return F.ln(reach / (F.sqrt(A.mean(F.transform(c, lambda x: x * x))) + F.lit(A.EPS)) + F.lit(A.EPS)) / F.ln(A.length(c))

    return A.let(A.centre(a), over)


def permutation_entropy(a: Column) -> Column:
    """Entropy of the order patterns of three consecutive elements, 1 if all six are as frequent.
    Equal elements count in the order in which they stand."""
    triples = F.transform(F.sequence(F.lit(0), F.size(a) - 3), lambda i: F.sort_array(F.array(*[F.struct(F.get(a, i + k).alias("x"), F.lit(k).alias("k")) for k in range(3)])))
    codes = F.transform(triples, lambda t: F.get(t, 0)["k"] * 9 + F.get(t, 1)["k"] * 3 + F.get(t, 2)["k"])

    def over(c: Column) -> Column:
        parts = [_share(c, p[0] * 9 + p[1] * 3 + p[2]) for p in permutations(range(3))]
        return -A.total(F.transform(F.array(*parts), lambda s: F.when(s > 0, s * F.ln(s)).otherwise(0.0))) / F.lit(math.log(6))

    return F.when(F.size(a) < 3, F.lit(0.0)).otherwise(A.let(codes, over))


def _share(codes: Column, code: int) -> Column:
    return A.count_if(codes, lambda x: x == code) / A.length(codes)


def _per_row(measure):
    """A vectorised function of a list column that applies ``measure`` to each series."""

    @F.pandas_udf("double")
    def run(series: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else float(measure(np.asarray(x, float))) for x in series], dtype="float64")

    return run


def sample_entropy(a: Column, m: int = 2, tolerance: float = 0.2) -> Column:
    """Log ratio of the shares of template pairs that stay alike for ``m`` and ``m`` + 1 elements; 0 without any."""

    def measure(x: np.ndarray) -> float:
        reach, shares = tolerance * (x.std() + A.EPS), []
        for k in (m, m + 1):
            if len(x) <= k:
                return 0.0
            t = np.lib.stride_tricks.sliding_window_view(x, k)
            near = np.abs(t[:, None] - t[None]).max(2) <= reach
            shares.append(near[np.triu_indices(len(t), 1)].mean())
        return -math.log(shares[1] / shares[0] + A.EPS) if all(shares) else 0.0

    return _per_row(measure)(a)


def _fluctuation(path: np.ndarray, width: int, order: int) -> float:
    """Root mean square around the polynomials of consecutive segments."""
    segments = path[: len(path) // width * width].reshape(-1, width)
    basis = np.vander(np.arange(width), order + 1)
    fit, *_ = np.linalg.lstsq(basis, segments.T, rcond=None)
    return float(np.sqrt(((segments.T - basis @ fit) ** 2).mean()))


def detrended_fluctuation(a: Column, scales: Sequence[int], order: int = 1, floor: float = A.EPS) -> Column:
    """Slope of log fluctuation against log scale; 0 with fewer than two usable scales.

    Scales between ``order`` + 1 and the length are usable. With ``floor`` 0 those without fluctuation aren't."""

    def measure(x: np.ndarray) -> float:
        path, points = np.cumsum(x - x.mean()), []
        for w in sorted({s for s in scales if order + 1 <= s <= len(x)}):
            f = _fluctuation(path, w, order) + floor
            if f > 0:
                points.append((math.log(w), math.log(f)))
        return float(np.polyfit(*zip(*points), 1)[0]) if len(points) > 1 else 0.0

    return _per_row(measure)(a)


def two_scale_fluctuation(a: Column, n: int) -> Column:
    """The same from two scales, 4 and half the length ``n`` (3 and 5 for short series); 0 if one is flat."""
    scales = (4, n // 2) if n // 2 > 4 else (3, 5)

    def measure(x: np.ndarray) -> float:
        if len(x) < max(scales):
            return 0.0
        path = np.cumsum(x - x.mean())
        low, high = (_fluctuation(path, w, 1) for w in scales)
        return math.log(high / low) / math.log(scales[1] / scales[0]) if low > 0 and high > 0 else 0.0

    return _per_row(measure)(a)


def higuchi_dimension(a: Column, kmax: int) -> Column:
    """Slope of log curve length against log inverse stride."""

    def measure(x: np.ndarray) -> float:
        points = []
        for k in range(1, kmax + 1):
            lengths = []
            for m in range(k):
                seg = x[m::k]
                if len(seg) > 1:
                    lengths.append(np.abs(np.diff(seg)).sum() * (len(x) - 1) / ((len(seg) - 1) * k) / k)
            if lengths:
                points.append((math.log(1 / k), math.log(np.mean(lengths) + A.EPS)))
        return float(np.polyfit(*zip(*points), 1)[0]) if len(points) > 1 else 0.0

    return _per_row(measure)(a)


def phrase_complexity(a: Column) -> Column:
    """Number of phrases of the series cut at its median, over n / log2(n).

    A phrase is as long as what stands at its start agrees with what stands one place before
    (1 at least); the last is one whose rest occurs from any earlier place."""

    def measure(x: np.ndarray) -> float:
        b, n = x >= np.median(x), len(x)
        if n < 2:
            return 0.0

        def agree(i: int, j: int) -> int:
            differs = np.flatnonzero(b[i : i + n - j] != b[j:])
            return int(differs[0]) if len(differs) else n - j

        phrases, at = 1, 1
        while at < n:
            phrases += 1
            if any(agree(i, at) == n - at for i in range(at)):
                break
            at += max(1, agree(at - 1, at))
        return phrases / (n / math.log2(n))

    return _per_row(measure)(a)
