"""Sequence functions against NumPy, on random and on degenerate series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.functions import arrays as A, autocorrelation as C, complexity as X, level as L, runs as R, spectral as S

N = 16


@pytest.fixture(scope="module")
def matrix():
    r = np.random.default_rng(4)
    m = r.normal(size=(40, N))
    m[1] = 5.0
    m[2] = np.arange(N)
    m[3] = np.round(m[3])
    m[4] = 0.0
    return m


@pytest.fixture(scope="module")
def frame(spark, matrix):
    r = np.random.default_rng(5)
    return spark.createDataFrame([(i, [float(x) for x in row], [float(x) for x in r.normal(size=12)]) for i, row in enumerate(matrix)], "id int, a array<double>, b array<double>").orderBy("id").cache()


def values(frame, column):
    return [r[0] for r in frame.orderBy("id").select(column).collect()]


def per_row(f):
    return lambda m: np.array([f(x) for x in m], float)


def run(x, ok):
    best = now = 0
    for v in x:
        now = now + 1 if ok(v) else 0
        best = max(best, now)
    return best


def c(x):
    return x - x.mean()


def acf(x, k, eps=1e-9):
    return (c(x)[:-k] * c(x)[k:]).sum() / ((c(x) ** 2).sum() + eps)


def signs(x):
    return np.where(c(x) >= 0, 1, -1)


EXPECTED = {
    "slope": (L.slope, lambda x: np.polyfit(np.arange(N), x, 1)[0]),
    "std1": (lambda a: A.std(a, 1), lambda x: x.std(ddof=1)),
    "median": (lambda a: A.quantile(a, 0.5), np.median),
    "iqr": (L.iqr, lambda x: np.subtract(*np.percentile(x, [75, 25]))),
    "late_early": (L.late_minus_early, lambda x: x[8:].mean() - x[:8].mean()),
    "trimmed": (lambda a: L.trimmed_mean(a, 2), lambda x: np.sort(x)[2:-2].mean()),
    "trimmed_all": (lambda a: L.trimmed_mean(a, 8), np.mean),
    "mad": (L.mad, lambda x: np.median(np.abs(x - np.median(x)))),
    "skew": (L.skew, lambda x: (c(x) ** 3).mean() / (x.std() + 1e-12) ** 3),
    "kurtosis": (L.kurtosis, lambda x: (c(x) ** 4).mean() / (x.std() + 1e-12) ** 4 - 3),
    "spikes": (L.spikes, lambda x: (x > np.median(x) + np.subtract(*np.percentile(x, [75, 25]))).sum()),
    "curvature": (lambda a: L.curvature(a, (6, 10), 6), lambda x: x[-4:].mean() - 2 * x[6:10].mean() + x[:6].mean()),
    "gini": (L.gini_of_steps, lambda x: (lambda d: ((2 * np.arange(1, N) - N) * d).sum() / ((N - 1) * d.sum() + 1e-12))(np.sort(np.abs(np.diff(x))))),
    "roughness": (L.roughness, lambda x: np.abs(np.diff(x, 2)).mean() / (x.std() + 1e-12)),
    "cum_range": (lambda a: L.cumulative(a)["cum_range"], lambda x: np.ptp(np.cumsum(x))),
    "drawdown": (lambda a: L.drawdown(a)["worst"], lambda x: (np.maximum.accumulate(np.cumsum(x)) - np.cumsum(x)).max()),
    "longest_up": (lambda a: R.longest_step_run(a, 1), lambda x: run(np.diff(x), lambda v: v > 0)),
    "above_median": (R.longest_above_median, lambda x: run(x, lambda v: v > np.median(x))),
    "turning": (R.turning_points, lambda x: (np.diff(np.sign(np.diff(x))) != 0).sum()),
    "crossings": (R.mean_crossings, lambda x: (np.diff(signs(x)) != 0).sum()),
    "sign_changes": (R.sign_changes, lambda x: (np.diff(np.sign(x)) != 0).sum()),
    "maxima": (R.local_maxima, lambda x: ((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])).sum()),
    "peak": (R.peak_position, lambda x: np.argmax(x) / (N - 1)),
    "trough": (lambda a: R.trough_position(a, False), np.argmin),
    "acf3": (lambda a: C.acf(a, 3), lambda x: acf(x, 3)),
    "acf_list": (lambda a: F.get(C.acf_list(a, 6), F.lit(5)), lambda x: acf(x, 6)),
    "pairwise": (lambda a: C.acf_pairwise(a, 2), lambda x: (c(x)[:-2] * c(x)[2:]).sum() / (math.sqrt((c(x)[:-2] ** 2).sum() * (c(x)[2:] ** 2).sum()) + 1e-9)),
    "ols": (lambda a: C.ar_no_intercept(a, 1), lambda x: (c(x)[:-1] * c(x)[1:]).sum() / ((c(x)[:-1] ** 2).sum() + 1e-9)),
    "resample": (lambda a: F.get(C.resample(a, 12), F.lit(7)), lambda x: np.interp(np.linspace(0, 1, 12), np.linspace(0, 1, N), x)[7]),
    "power": (lambda a: F.get(S.power(a, N), F.lit(3)), lambda x: abs(np.fft.rfft(c(x))[3]) ** 2),
    "centroid": (lambda a: S.centroid(S.power(a, N), N), lambda x: (lambda p: (p * np.arange(9) / N).sum() / (p.sum() + 1e-12))(np.r_[0, np.abs(np.fft.rfft(c(x)))[1:] ** 2])),
    "energy": (lambda a: S.energy_at(a, N, 3.0), lambda x: abs((c(x) * np.exp(2j * np.pi / 3 * np.arange(N))).sum()) ** 2 / N),
    "share": (lambda a: S.fit_share(a, N, 5.0), lambda x: sum((c(x) @ b) ** 2 / (b @ b + 1e-12) for b in (np.cos(2 * np.pi / 5 * np.arange(N)), np.sin(2 * np.pi / 5 * np.arange(N)))) / ((c(x) ** 2).sum() + 1e-12)),
    "entropy": (X.value_entropy, lambda x: (lambda p: -(p * np.log(p + 1e-9)).sum())(np.abs(x) / (np.abs(x).sum() + 1e-9))),
    "hurst": (X.hurst, lambda x: math.log(np.ptp(np.cumsum(c(x))) / (x.std() + 1e-12) + 1e-12) / math.log(N)),
}
FLAT_IS_UNSTABLE = {"skew", "kurtosis", "share", "centroid", "hurst", "crossings", "maxima", "spikes", "above_median"}


@pytest.mark.parametrize("name", EXPECTED)
def test_against_numpy(frame, matrix, name):
    build, want = EXPECTED[name]
    got = np.array(values(frame, build(F.col("a"))), float)
    keep = np.ones(len(matrix), bool)
    if name in FLAT_IS_UNSTABLE:
        keep[[1, 4]] = False
    np.testing.assert_allclose(got[keep], per_row(want)(matrix)[keep], atol=1e-8)


def test_summary_has_its_names(frame):
    assert len(L.summary(F.col("a"))) == 14 and len(L.summary(F.col("a"), 1, True)) == 21


def test_short_and_empty_series(spark):
    df = spark.createDataFrame([(1, [], []), (2, [1.0], [2.0]), (3, [1.0, 2.0], [1.0, 1.0]), (4, None, None)], "id int, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    columns = [*L.summary(a, 1, True).values(), *R.run_statistics(a).values(), R.mean_crossings(a), R.local_maxima(a), C.acf(a, 3), C.acf_pearson(a, 1), C.pearson(a, b), C.pacf(a), C.ar3(a), C.lead_minus_lag(a, b), X.value_entropy(a), X.permutation_entropy(a), L.mad(a), L.detrend(a), L.gini_of_steps(a), R.peak_position(a)]
    rows = df.orderBy("id").select(*[x.alias(f"c{i}") for i, x in enumerate(columns)]).collect()
    assert len(rows) == 4


def test_pacf_and_ar3(frame, matrix):
    got = values(frame, C.pacf(F.col("a")))
    a3 = values(frame, C.ar3(F.col("a")))
    for i, x in enumerate(matrix):
        if i in (1, 4):
            continue
        r = np.r_[1, [acf(x, k, 1e-12) for k in (1, 2, 3)]]
        for k in (1, 2, 3):
            t = np.array([[r[abs(p - q)] for q in range(k)] for p in range(k)])
            assert got[i][k - 1] == pytest.approx(np.linalg.solve(t, r[1 : k + 1])[-1], abs=1e-6)
        y, z = c(x)[3:], np.stack([c(x)[2:-1], c(x)[1:-2], c(x)[:-3]], 1)
        assert a3[i] == pytest.approx(np.linalg.solve(z.T @ z + 1e-9 * np.eye(3), z.T @ y)[2], abs=1e-5)


def test_best_period_and_ties(frame, matrix):
    periods = [2 + i / 4 for i in range(1, 28)]
    got = values(frame, S.best_period(F.col("a"), N, periods))
    t = np.arange(N)
    for i, x in enumerate(matrix):
        if i in (1, 4):
            assert got[i]["period"] in (periods[0], 0.0)
            continue
        p = [sum((c(x) @ b) ** 2 / (b @ b + 1e-12) for b in (np.cos(2 * np.pi / q * t), np.sin(2 * np.pi / q * t))) for q in periods]
        assert got[i]["period"] == periods[int(np.argmax(p))]
    assert values(frame, S.best_period(F.col("a"), N, periods, start=0.0)["period"])[4] == 0.0


def test_cross_and_coherence(frame):
    rows = frame.select(C.lead_minus_lag(F.col("b"), F.col("a")).alias("x"), C.cross_pearson(F.col("b"), C.resample(F.col("a"), 12), -1).alias("y"), "a", "b").collect()
    for r in rows[5:]:
        a, b = np.array(r["a"]), np.array(r["b"])
        d = np.interp(np.linspace(0, 1, 12), np.linspace(0, 1, N), c(a))
        w = c(b)
        n = math.sqrt((w**2).sum() * (d**2).sum()) + 1e-9
        assert r["x"] == pytest.approx((w[1:] * d[:-1]).sum() / n - (w[:-1] * d[1:]).sum() / n, abs=1e-8)
        assert r["y"] == pytest.approx(np.corrcoef(b[1:], np.interp(np.linspace(0, 1, 12), np.linspace(0, 1, N), a)[:-1])[0, 1], abs=1e-8)


def test_complexity_measures(frame, matrix):
    a = F.col("a")
    rows = frame.orderBy("id").select(X.sample_entropy(a).alias("se"), X.detrended_fluctuation(a, (3, 4, 5, 6, 8)).alias("dfa"), X.two_scale_fluctuation(a, N).alias("two"), X.higuchi_dimension(a, 4).alias("hfd"), X.phrase_complexity(a).alias("lz"), X.permutation_entropy(a).alias("pe")).collect()
    for r, x in list(zip(rows, matrix))[5:]:
        logs = []
        for w in (3, 4, 5, 6, 8):
            path, res = np.cumsum(c(x)), []
            for s in range(N // w):
                seg = path[s * w : (s + 1) * w]
                res.append(seg - np.polyval(np.polyfit(np.arange(w), seg, 1), np.arange(w)))
            logs.append(math.log(math.sqrt((np.concatenate(res) ** 2).mean()) + 1e-12))
        assert r["dfa"] == pytest.approx(np.polyfit(np.log([3, 4, 5, 6, 8]), logs, 1)[0], abs=1e-8)
        patterns = [tuple(np.argsort(x[i : i + 3], kind="stable")) for i in range(N - 2)]
        p = np.array([patterns.count(q) for q in set(patterns)]) / len(patterns)
        assert r["pe"] == pytest.approx(-(p * np.log(p)).sum() / math.log(6))
        assert r["se"] > -1e-9 and 0 < r["lz"] < 4 and math.isfinite(r["two"]) and r["hfd"] > 0.5
    assert rows[1]["se"] == pytest.approx(0, abs=1e-9) and rows[1]["two"] == 0.0
