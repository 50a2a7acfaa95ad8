"""Spectrum and period of one series of known length per row.

The length fixes the cosine and sine bases, which are written into the plan as constants; a power
spectrum is then a few dot products per row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as A


def _basis(n: int, period: float) -> tuple[list[float], list[float]]:
    w = 2 * math.pi / period
    return [math.cos(w * t) for t in range(n)], [math.sin(w * t) for t in range(n)]


def dft(a: Column, n: int) -> Column:
    """Bins 0 to n / 2 of the centred series as structs ``re``, ``im``."""

    def bins(c: Column) -> Column:
        out = []
        for k in range(n // 2 + 1):
            cos, sin = ([f(2 * math.pi * k * t / n) for t in range(n)] for f in (math.cos, math.sin))
            out.append(F.struct(A.dot(c, A.const(cos)).alias("re"), (-A.dot(c, A.const(sin))).alias("im")))
        return F.array(*out)

    return A.let(A.centre(a), bins)


def power(a: Column, n: int) -> Column:
    return F.transform(dft(a, n), lambda z: z["re"] * z["re"] + z["im"] * z["im"])


def _without_dc(p: Column, dc: float) -> Column:
    return F.transform(p, lambda x, i: F.when(i == 0, F.lit(dc)).otherwise(x))


def dominant_bin(p: Column) -> Column:
    """First strongest bin of a power spectrum, its mean left out."""
    return A.let(_without_dc(p, -1.0), lambda q: (F.array_position(q, F.array_max(q)) - 1).cast("int"))


def dominant_period(a: Column, n: int) -> Column:
    return A.let(dominant_bin(power(a, n)), lambda k: F.when(k > 0, F.lit(float(n)) / k).otherwise(F.lit(0.0)))


def phase(a: Column, n: int, k: int) -> Column:
    return A.let(F.get(dft(a, n), F.lit(k)), lambda z: F.atan2(z["im"], z["re"]))


def fit_power(c: Column, n: int, period: float) -> Column:
    """Power that the sinusoid of ``period`` takes from a centred series."""
    cos, sin = _basis(n, period)
    cc, ss = sum(x * x for x in cos) + A.EPS, sum(x * x for x in sin) + A.EPS
    return F.pow(A.dot(c, A.const(cos)), F.lit(2)) / F.lit(cc) + F.pow(A.dot(c, A.const(sin)), F.lit(2)) / F.lit(ss)


def best_period(a: Column, n: int, periods: Sequence[float], start: float = -1.0) -> Column:
    """Of ``periods`` the one whose sinusoid takes most power, the first on ties: ``period`` and ``share``.

    Below or at the power ``start`` none counts and the period is 0."""

    def search(c: Column) -> Column:
        tries = F.array(*[F.struct(fit_power(c, n, p).alias("power"), F.lit(-float(i)).alias("order"), F.lit(float(p)).alias("period")) for i, p in enumerate(periods)])
        return A.let(F.array_max(tries), lambda b: F.struct(F.when(b["power"] > start, b["period"]).otherwise(0.0).alias("period"), (b["power"] / (A.square_sum(c) + F.lit(A.EPS))).alias("share")))

    return A.let(A.centre(a), search)


def fit_share(a: Column, n: int, period: float) -> Column:
    """Share of the variance that the sinusoid of ``period`` takes."""
    return A.let(A.centre(a), lambda c: fit_power(c, n, period) / (A.square_sum(c) + F.lit(A.EPS)))


def energy_at(a: Column, n: int, period: float) -> Column:
    """Squared product sums with the sinusoids of an exact period, per element."""
    cos, sin = _basis(n, period)
    return A.let(A.centre(a), lambda c: (F.pow(A.dot(c, A.const(cos)), F.lit(2)) + F.pow(A.dot(c, A.const(sin)), F.lit(2))) / F.lit(float(n)))


def band_power(p: Column, n: int, period: float) -> Column:
    """Power at ``period``, interpolated between the two bins beside it."""
    at = min(max(n / period, 0.0), float(n // 2))
    lo = min(int(math.ceil(at)) - 1 if at > 0 else 0, n // 2 - 1)
    lo = max(lo, 0)
    f = at - lo
    return F.get(p, F.lit(lo)) * F.lit(1 - f) + F.get(p, F.lit(lo + 1)) * F.lit(f)


def band_ratio(a: Column, n: int, first: float, second: float) -> Column:
    return A.let(power(a, n), lambda p: band_power(p, n, first) / (band_power(p, n, second) + F.lit(A.EPS)))


def _weighted(p: Column, weights: Sequence[float]) -> Column:
    return A.let(_without_dc(p, 0.0), lambda q: A.dot(q, A.const(weights)) / (A.total(q) + F.lit(A.EPS)))


def centroid(p: Column, n: int) -> Column:
    return _weighted(p, [k / n for k in range(n // 2 + 1)])


def spread(p: Column, n: int) -> Column:
    """Deviation of the frequency around the centroid."""
    freqs = A.const([k / n for k in range(n // 2 + 1)])

    def over(s: Column) -> Column:
        return F.sqrt(A.total(F.zip_with(s["q"], freqs, lambda x, f: x * (f - s["m"]) * (f - s["m"]))) / (A.total(s["q"]) + F.lit(A.EPS)))

    return A.let(F.struct(_without_dc(p, 0.0).alias("q"), centroid(p, n).alias("m")), over)


def period_centroid(p: Column, n: int) -> Column:
    return _weighted(p, [n / k if k else 0.0 for k in range(n // 2 + 1)])


def high_fraction(p: Column, n: int, above: float = 0.25) -> Column:
    """Share of the power at frequencies above ``above``."""
    return _weighted(p, [1.0 if k / n > above else 0.0 for k in range(n // 2 + 1)])


def entropy(p: Column) -> Column:
    def over(q: Column) -> Column:
        return A.let(A.total(q) + F.lit(A.EPS), lambda t: -A.total(F.transform(q, lambda x: A.let(F.greatest(x / t, F.lit(A.EPS)), lambda y: y * F.ln(y)))))

    return A.let(_without_dc(p, 0.0), over)


def parabolic_period(a: Column, n: int) -> Column:
    """Period at the top of the parabola through the log power of the strongest bin and its neighbours."""

    def peak(s: Column) -> Column:
        k = s["k"]
        log = lambda i: F.ln(F.get(s["p"], i) + F.lit(A.EPS))
        x, y, z = log(F.greatest(k - 1, F.lit(0))), log(k), log(F.least(k + 1, F.lit(n // 2)))
        bend = x - 2 * y + z
        move = F.lit(0.5) * (x - z) / F.when(F.abs(bend) < 1e-9, 1e-9).otherwise(bend)
        move = F.when((k >= 1) & (k <= n // 2 - 1), F.least(F.greatest(move, F.lit(-0.5)), F.lit(0.5))).otherwise(0.0)
        return F.lit(float(n)) / F.greatest(k + move, F.lit(1e-6))

    return A.let(power(a, n), lambda p: A.let(F.struct(p.alias("p"), dominant_bin(p).alias("k")), peak))


def acf_period(a: Column, max_lag: int = 8) -> Column:
    """First local maximum of the autocorrelation at lag 2 or more, ``max_lag`` if there is none."""
    from .autocorrelation import acf_list

    def first(r: Column) -> Column:
        peaks = F.filter(F.sequence(F.lit(2), F.lit(max_lag - 1)), lambda k: (F.get(r, k - 1) > F.get(r, k - 2)) & (F.get(r, k - 1) >= F.get(r, k)))
        return F.coalesce(F.get(peaks, F.lit(0)), F.lit(max_lag)).cast("double")

    return A.let(acf_list(a, max_lag, A.EPS), first)


def acf_trough(a: Column, max_lag: int = 8) -> Column:
    """Lag of the least autocorrelation."""
    from .autocorrelation import acf_list

    return A.let(acf_list(a, max_lag, A.EPS), lambda r: F.array_position(r, F.array_min(r)).cast("double"))


def period_drift(a: Column, n: int, periods: Sequence[float]) -> Column:
    """Best period of the second half less that of the first."""
    h = n // 2
    return best_period(A.tail_from(a, h), n - h, periods)["period"] - best_period(A.head(a, h), h, periods)["period"]
