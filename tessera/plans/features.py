"""Named feature sets: functions from a frame of packed series to a frame of features.

A frame has ``id``, series ``w`` (12) and ``d`` (16), the latent scores, the task counters ``done`` and
``given``, ``room``, ``exam_order``, ``tryout`` and, for labelled rows, ``target``. What must be learnt
from a whole frame (medians, frequencies, ranks, moments) can be fitted on one and applied to another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A, autocorrelation as C, complexity as X, level as L, runs as R, spectral as S
from ..operators.cleaning import balance, finite_or, frequency, harmonic, impute_median, medians, products, ratio, scrub
from ..operators.ranks import moments, with_ranks, zscore
from ..operators.statistics import unpivot
from ..session import pin

KEEP = ("id", "target")
LATENT = ("motivation", "discipline", "distance", "activities", "attendance", "literacy", "siblings", "interest")
DAY_PERIODS = tuple(2 + i / 4 for i in range(28))
NW, ND = 12, 16


def w() -> Column:
    return F.col("w")


def d() -> Column:
    return F.col("d")


def named(prefix: str, columns: Mapping[str, Column]) -> dict[str, Column]:
    return {f"{prefix}_{k}": v.cast("double") for k, v in columns.items()}


def select_features(df: DataFrame, features: Mapping[str, Column], extra: Iterable[str] = ()) -> DataFrame:
    """Id, label and features. What isn't finite becomes 0."""
    kept = [c for c in (*KEEP, *extra) if c in df.columns]
    return scrub(df.select(*kept, *[v.cast("double").alias(k) for k, v in features.items()]), features)


def signal_features() -> dict[str, Column]:
    r = ratio(F.col("done"), F.col("given"), "zero")
    vol, reach, change = A.std(w()), L.amplitude(w()), L.abs_sum(w())
    return {
        "compl_ratio": r, "compl_diff": F.col("done") - F.col("given"), "compl_remaining": F.col("given") - F.col("done"), "w_std": vol, "w_range": reach, "w_iqr": L.iqr(w()), "abs_change_sum": change, "abs_change_mean": L.abs_mean(w()),
        **L.cumulative(w()), "tryout": F.col("tryout"), "vol_x_compl": vol * r, "range_x_compl": reach * r, "tryout_x_compl": F.col("tryout") * r, "abschg_x_compl": change * r,
    }


def set_features(kind: str = "full") -> dict[str, Column]:
    out = signal_features()
    if kind in ("lean", "full"):
        out |= named("w", L.summary(w())) | {"cum_std2": out["cum_std"]}
    if kind == "full":
        out |= named("d", L.summary(d())) | {c: F.col(c) for c in (*LATENT, "exam_order")} | {"room_freq": frequency("room"), "room_mod10": F.pmod("room", F.lit(10))}
    return out


def build(df: DataFrame, kind: str = "full") -> DataFrame:
    """``signal`` (17 columns), ``lean`` (29) or ``full`` (54)."""
    return select_features(df, set_features(kind))


def baseline(df: DataFrame, fitted: Mapping | None = None, more: Mapping[str, Column] | None = None) -> DataFrame:
    """Raw columns, both series' 21 statistics (sample deviation), completion, interactions and the room's
    frequency; what isn't finite becomes the median, of this frame or as ``fitted``. Features ``more`` stand beside them,
    0 where they aren't finite; names that the baseline has too stay the baseline's."""
    more = more or {}
    r = ratio(F.col("done"), F.col("given"), "null")
    out = {f"w{i + 1:02d}": F.get("w", F.lit(i)) for i in range(NW)} | {f"d{i + 1:02d}": F.get("d", F.lit(i)) for i in range(ND)}
    out |= {c: F.col(c) for c in (*LATENT, "done", "given", "room", "exam_order", "tryout")}
    out |= named("w", L.summary(w(), 1, True)) | named("d", L.summary(d(), 1, True))
    out |= {"compl_ratio": r, "compl_remaining": F.col("given") - F.col("done")}
    out |= {
        "tryout_x_attendance": F.col("tryout") * F.col("attendance"), "motivation_x_interest": F.col("motivation") * F.col("interest"), "discipline_x_compl": F.col("discipline") * r, "literacy_x_tryout": F.col("literacy") * F.col("tryout"),
        "slope_x_tryout": out["w_slope"] * F.col("tryout"), "consistency": -out["d_std"], "room_frequency": frequency("room"), "room_mod_10": F.pmod("room", F.lit(10)), "room_mod_100": F.pmod("room", F.lit(100)),
    }
    more = {k: v for k, v in more.items() if k not in out}
    rows = df.select(*[c for c in KEEP if c in df.columns], *[v.cast("double").alias(k) for k, v in (out | more).items()])
    if fitted is None:  # a pass over what is written once, not over the formulas again
        rows = pin(rows)
        fitted = medians(rows, out)
        fitted["compl_gap"] = 0.0 if fitted["compl_ratio"] is not None else None
    rows = rows.withColumn("compl_gap", F.col("compl_ratio") - F.lit(fitted["compl_ratio"]))
    rows = scrub(impute_median(rows, [*out, "compl_gap"], fitted), more)
    return rows.select(*[c for c in KEEP if c in df.columns], *out, "compl_gap", *more)


def augmented(df: DataFrame) -> DataFrame:
    """The baseline with eight more volatility and completion terms."""
    more = {k: v for k, v in signal_features().items() if k in ("abs_change_sum", "abs_change_mean", "cum_range", "cum_std", "vol_x_compl", "range_x_compl", "tryout_x_compl", "abschg_x_compl")}
    return baseline(df, more=more)


def boundary_features() -> dict[str, Column]:
    late = L.segment_mean(w(), 9)
    short = F.lit(1.0) - ratio(F.col("done"), F.col("given"), "zero")
    return {
        "tryout_minus_w_mean": F.col("tryout") - A.mean(w()), "late_minus_early": late - L.segment_mean(w(), 0, 3), "late_minus_middle": late - L.segment_mean(w(), 3, 9), "recovery": late - F.array_min(A.part(w(), 0, 9)),
        "shortfall": short, "shortfall_x_vol": short * A.std(w(), 1), "tryout_x_shortfall": F.col("tryout") * short, "spikes": L.spikes(d()), "spike_ratio": L.spikes(d()) / A.length(d()),
    }


def robust_features() -> dict[str, Column]:
    return {
        "w_trimmed": L.trimmed_mean(w()), "d_trimmed": L.trimmed_mean(d()), "w_mad": L.mad(w()), "d_mad": L.mad(d()), "w_turning": R.turning_points(w()), "d_turning": R.turning_points(d()),
        "w_longest_up": R.longest_step_run(w(), 1), "w_longest_down": R.longest_step_run(w(), -1), "w_vol_ratio": L.volatility_ratio(w()),
    }


RANKED = ("compl_ratio", "w_mean", "w_std", "w_iqr", "w_range", "tryout", "attendance", "literacy")


def extended(df: DataFrame) -> DataFrame:
    """The baseline with boundary, robust and rank features.

    The eight columns are ranked in one long frame and brought back by one join on a row number."""
    base = pin(baseline(df, more=boundary_features() | robust_features()).withColumn("__row", F.monotonically_increasing_id()))
    long = unpivot(base, ["__row"], RANKED)
    ranked = with_ranks(long, "x", "__row", ["feature"]).groupBy("__row").pivot("feature", list(RANKED)).agg(F.first("r_pct"))
    out = base.join(ranked.withColumnsRenamed({c: f"rank_{c}" for c in RANKED}), "__row").drop("__row")
    return out.withColumn("rank_composite", sum((F.col(f"rank_{c}") for c in RANKED[1:]), F.col(f"rank_{RANKED[0]}")) / len(RANKED))


def interaction(df: DataFrame) -> DataFrame:
    """The full set without room columns, the main interaction and daily patterns."""
    more = {"motiv_x_disc": F.col("motivation") * F.col("discipline"), "d_sign_changes": R.mean_crossings(d(), zero_is_positive=False), "d_longest_high": R.longest_above_median(d()), "d_entropy": X.value_entropy(d())}
    return select_features(df, {k: v for k, v in set_features().items() if not k.startswith("room")} | more)


def temporal_features(lags: int = 6) -> dict[str, Column]:
    out = {"motiv_x_disc": F.col("motivation") * F.col("discipline")}
    for name, a in (("d", d()), ("w", w())):
        out |= {f"{name}_ac{k}": C.acf(a, k) for k in range(1, lags + 1)}
    return out


def temporal_set(lags: int = 6, spectrum: bool = False) -> dict[str, Column]:
    out = {k: v for k, v in set_features().items() if not k.startswith(("room", "d_"))} | temporal_features(lags)
    if spectrum:
        out |= {f"d_amp{k}": F.sqrt(F.get(S.power(d(), ND), F.lit(k))) for k in range(1, 6)} | {"d_dominant": S.dominant_bin(S.power(d(), ND))}
    return out


def temporal(df: DataFrame, lags: int = 6, spectrum: bool = False) -> DataFrame:
    """The full set without room columns and daily statistics, and autocorrelations of both series."""
    return select_features(df, temporal_set(lags, spectrum))


def gate_term(df: DataFrame, gate: str = "interest", fitted: dict | None = None, eps: float = 1e-9) -> Column:
    """The product of two z-scores, of a latent score and of how the weekly series
    follows the daily one. Moments come from ``df`` or are ``fitted``."""
    terms = {"g": F.col(gate), "c": C.lead_minus_lag(w(), d())}
    fitted = fitted or moments(df.select(*[v.alias(k) for k, v in terms.items()]), list(terms))
    z = lambda c: (terms[c] - F.lit(fitted[c][0])) / F.lit((fitted[c][1] or 0.0) + eps)
    return finite_or(z("g") * z("c"), 0.0)


def gated_coupling(df: DataFrame, gate: str = "interest", fitted: dict | None = None, eps: float = 1e-9) -> DataFrame:
    """``id`` and ``gated``."""
    return df.select("id", gate_term(df, gate, fitted, eps).alias("gated"))


def production_set(df: DataFrame) -> dict[str, Column]:
    more = {"d_dominant_period": S.dominant_period(d(), ND), "d_best_period": S.best_period(d(), ND, DAY_PERIODS)["period"], "w_ar1": C.ar_no_intercept(w()), "w_pacf1": C.acf(w(), 1, 1e-12)}
    return temporal_set() | more | {"gated": gate_term(df)}


def production(df: DataFrame) -> DataFrame:
    """The temporal set with periods, autoregression and the gated coupling."""
    return select_features(df, production_set(df))


def production_with_order(df: DataFrame) -> DataFrame:
    """The production set and exam order times completion."""
    return select_features(df, production_set(df) | {"order_x_completion": F.col("exam_order") * ratio(F.col("done"), F.col("given"), "floor1")})


#: Columns of the production set that a correction of its errors is learnt from.
CORRECTION = (
    "compl_ratio", "compl_remaining", "w_std", "w_range", "w_iqr", "abs_change_mean", "cum_range", "cum_std", "tryout", "vol_x_compl", "tryout_x_compl", "w_slope",
    "motivation", "discipline", "attendance", "literacy", "interest", "exam_order", "motiv_x_disc", "d_ac1", "w_ac1", "d_best_period", "w_ar1", "gated",
)


def correction(df: DataFrame) -> DataFrame:
    """24 chosen columns of the production set."""
    found = production_set(df)
    return select_features(df, {c: found[c] for c in CORRECTION})


def daily_lags(df: DataFrame) -> DataFrame:
    p = S.power(d(), ND)
    out = {f"d_ac{k}": C.acf(d(), k) for k in range(1, 7)} | {"d_ac1_minus_ac3": C.acf(d(), 1) - C.acf(d(), 3)}
    return select_features(df, out | {f"d_amp{k}": F.sqrt(F.get(p, F.lit(k))) for k in range(1, 6)} | {"d_dominant": S.dominant_bin(p)})


def pair_expansion(df: DataFrame, which: str) -> DataFrame:
    """All pair products within weekly values (66), daily values (120) or ten behaviour columns (45)."""
    if which == "behaviour":
        return select_features(df, products((*LATENT, "exam_order", "tryout")))
    n, series = (NW, "w") if which == "w" else (ND, "d")
    flat = df.select(*[c for c in KEEP if c in df.columns], *[F.get(series, F.lit(i)).alias(f"{series}{i + 1:02d}") for i in range(n)])
    return select_features(flat, products([f"{series}{i + 1:02d}" for i in range(n)]))


def symbolic(df: DataFrame) -> DataFrame:
    """Candidate formulas, free of the label: measures of the series, and factors times measures or other factors."""
    c = F.col
    latent = {"motivation": c("motivation"), "discipline": c("discipline")}
    measures = {"shape": C.pearson(w(), C.resample(d(), NW))}
    for name, a, n, periods, middle in (("w", w(), NW, (2, 3, 4), ()), ("d", d(), ND, (2, 3, 4, 5), ((6, 10), 6))):
        measures |= {f"{name}_energy{p}": S.energy_at(a, n, float(p)) for p in periods}
        measures |= {f"{name}_late_early": L.segment_mean(a, -4) - L.segment_mean(a, 0, 4), f"{name}_curvature": L.curvature(a, *middle), f"{name}_vol": A.std(a), f"{name}_range": L.amplitude(a), f"{name}_slope": L.slope(a)}
    factors = {"compl": ratio(c("done"), c("given"), "floor1"), "tryout": c("tryout"), "order": c("exam_order"), "room": c("room"), "literacy": c("literacy"), "md": latent["motivation"] * latent["discipline"], "interest_x_attendance": c("interest") * c("attendance")}
    values = measures | factors
    grid = {
        "compl": ("w_vol", "w_range", "w_slope", "d_vol", "d_slope", "shape"), "tryout": ("w_slope", "w_vol", "d_energy3"), "room": ("w_vol", "tryout"), "order": ("tryout", "compl"), "literacy": ("tryout",), "md": ("compl",), "interest_x_attendance": ("compl",),
    }
    out = {k: v for k, v in measures.items() if not k.endswith(("_vol", "_range", "_slope"))}
    out |= {f"{f}_x_{m}": factors[f] * values[m] for f, of in grid.items() for m in of}
    out |= {"slope_product": measures["d_slope"] * measures["w_slope"], "vol_ratio": measures["d_vol"] / (measures["w_vol"] + F.lit(1e-6)), "md_balance": balance(*latent.values()), "md_harmonic": harmonic(*latent.values())}
    return select_features(df, out)


def generator(df: DataFrame) -> DataFrame:
    """Parameters that a generator of such series might have."""
    r = ratio(F.col("done"), F.col("given"), "floor1")
    c = F.col
    out = {}
    for name, a, n, curve in (("w", w(), NW, L.curvature(w())), ("d", d(), ND, L.curvature(d(), (6, 10), 6))):
        out |= {f"{name}_mean": A.mean(a), f"{name}_std": A.std(a), f"{name}_range": L.amplitude(a), f"{name}_slope": L.slope(a), f"{name}_curvature": curve, f"{name}_entropy": X.value_entropy(a)}
        out |= {f"{name}_energy{p}": S.energy_at(a, n, float(p)) for p in ((2, 3, 4) if name == "w" else (2, 3, 4, 5))}
    out |= {"w_longest_positive": R.longest_run(w(), lambda x: x > 0), "w_longest_negative": R.longest_run(w(), lambda x: x < 0), "d_longest_high": R.longest_above_median(d())}
    out |= {
        "compl_ratio": r, "compl_remaining": c("given") - c("done"), "motiv_x_disc": c("motivation") * c("discipline"), "tryout_x_compl": c("tryout") * r, "attendance_x_compl": c("attendance") * r, "literacy_x_interest": c("literacy") * c("interest"),
        "order_x_compl": c("exam_order") * r,
    }
    return select_features(df, out)


def log_ratio(df: DataFrame) -> DataFrame:
    """Ratio and log variants of both series' statistics (logs are of the distance from the frame's least)."""
    out = {}
    for name, a in (("w", w()), ("d", d())):
        s = L.summary(a, 1, True)
        out |= {
            f"{name}_cv": ratio(s["std"], s["mean"]), f"{name}_mean": s["mean"], f"{name}_log_range": F.log1p(s["range"]), f"{name}_late_early": ratio(s["late_mean"], s["early_mean"]), f"{name}_log_slope": F.log1p(F.abs(s["slope"])),
            f"{name}_range_mean": ratio(s["range"], F.abs(s["mean"])), f"{name}_diff_cv": ratio(s["diff_std"], s["diff_abs_mean"]), f"{name}_step_ratio": ratio(s["positive_steps"], s["negative_steps"]), f"{name}_q75_q25": ratio(s["q75"], s["q25"]),
        }
    rows = select_features(df, out)
    low = rows.agg(*[F.min(f"{n}_mean").alias(n) for n in ("w", "d")]).first()
    return rows.withColumns({f"{n}_log_mean": F.log1p(F.col(f"{n}_mean") - F.lit(low[n]) + 1) for n in ("w", "d")}).drop("w_mean", "d_mean")


def all_tables(df: DataFrame) -> DataFrame:
    """Raw columns, baseline and production features side by side, their names told apart by prefix."""
    raw = {f"raw__w{i + 1:02d}": F.get("w", F.lit(i)) for i in range(NW)} | {f"raw__d{i + 1:02d}": F.get("d", F.lit(i)) for i in range(ND)}
    raw |= {f"raw__{c}": F.col(c) for c in (*LATENT, "done", "given", "room", "exam_order", "tryout")}
    side = baseline(df, more=raw | {f"prod__{k}": v for k, v in production_set(df).items()})
    return side.withColumnsRenamed({c: f"fe__{c}" for c in side.columns if c not in KEEP and not c.startswith(("raw__", "prod__"))})


def segments(df: DataFrame) -> DataFrame:
    """Second half against first of both series: differences and ratios of lag-1 autocorrelation, amplitude and level."""
    out = {}
    for name, a in (("w", w()), ("d", d())):
        early, late = A.head(a, L.half(a)), A.tail_from(a, L.half(a))
        for what, f in (("acf1", lambda x: C.acf(x, 1)), ("amplitude", L.amplitude), ("level", A.mean)):
            out |= {f"{name}_{what}_delta": f(late) - f(early), f"{name}_{what}_ratio": ratio(f(late), F.abs(f(early)) + F.lit(1e-9), "zero")}
        out[f"{name}_diff2_std"] = A.std(A.diff(A.diff(a)))
    return select_features(df, out)


def coupling(df: DataFrame) -> DataFrame:
    """How the two series follow each other: cross-correlations at lags -3 to 3 and of their steps at -1 to 1, early against late means,
    their asymmetry and whether their slopes agree."""
    b = C.resample(d(), NW)
    name = lambda k: f"m{-k}" if k < 0 else str(k)
    out = {f"cross_{name(k)}": C.cross_pearson(w(), b, k) for k in range(-3, 4)}
    out |= {f"step_cross_{name(k)}": C.cross_pearson(A.diff(w()), A.diff(b), k) for k in (-1, 0, 1)}
    ed, lw, ew, ld = L.segment_mean(b, 0, 4), L.segment_mean(w(), -4), L.segment_mean(w(), 0, 4), L.segment_mean(b, -4)
    out |= {"d_leads": ed * lw, "w_leads": ew * ld, "lead_asymmetry": ed * lw - ew * ld, "slopes_agree": (F.signum(L.slope(w())) == F.signum(L.slope(b))).cast("double")}
    return select_features(df, out)


def gates(df: DataFrame) -> DataFrame:
    """Latent scores as gates of the coupling and of the weekly slope: their sign times the term's size, their size times the term and the
    product of two scores times the term; scores and terms as z-scores over the frame."""
    latent, terms = LATENT[:4], {"coupling": C.lead_minus_lag(w(), d()), "slope": L.slope(w())}
    base = zscore(df.select(*[c for c in KEEP if c in df.columns], *latent, *[v.alias(k) for k, v in terms.items()]), [*latent, *terms])
    z = lambda c: F.col(f"{c}_z")
    out = {}
    for t in terms:
        for c in latent:
            out |= {f"sign_{c}_x_{t}": F.signum(z(c)) * F.abs(z(t)), f"size_{c}_x_{t}": F.abs(z(c)) * z(t)}
        out[f"{latent[0]}_{latent[1]}_x_{t}"] = z(latent[0]) * z(latent[1]) * z(t)
    return select_features(base, out)


def lag_estimators(df: DataFrame) -> DataFrame:
    """Four estimates of the daily series' lag-1 dependence, the sum of their z-scores over the frame, and a sum with weights."""
    found = {"acf": C.acf(d(), 1), "pairwise": C.acf_pairwise(d(), 1), "pearson": C.acf_pearson(d(), 1), "ar": C.ar_no_intercept(d())}
    base = zscore(df.select(*[c for c in KEEP if c in df.columns], *[v.alias(k) for k, v in found.items()]), list(found))
    total = lambda weights: sum((F.col(f"{c}_z") * v for c, v in list(weights.items())[1:]), F.col(f"{list(weights)[0]}_z") * list(weights.values())[0])
    return select_features(base, {c: F.col(c) for c in found} | {"z_sum": total(dict.fromkeys(found, 1.0)), "weighted": total({"acf": 0.4, "pairwise": 0.2, "pearson": 0.2, "ar": 0.2})})


def block_ranks(df: DataFrame) -> DataFrame:
    """Sums over both series of the percentile ranks of roughness, turning points and complexity."""
    measures = {"roughness": L.roughness, "turning": R.turning_points, "complexity": L.complexity}
    rows = pin(df.select(*[c for c in KEEP if c in df.columns], F.monotonically_increasing_id().alias("__row"), *[F.round(f(a).cast("double"), 9).alias(f"{n}_{s}") for n, f in measures.items() for s, a in (("w", w()), ("d", d()))]))
    names = [f"{n}_{s}" for n in measures for s in "wd"]
    ranked = with_ranks(unpivot(rows, ["__row"], names), "x", "__row", ["feature"]).groupBy("__row").pivot("feature", names).agg(F.first("r_pct"))
    both = rows.drop(*names).join(ranked, "__row")
    return select_features(both, {f"{n}_rank_sum": F.col(f"{n}_w") + F.col(f"{n}_d") for n in measures})


#: Feature sets by name; entries may be added.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "signal": lambda df: build(df, "signal"), "lean": lambda df: build(df, "lean"), "full": build, "baseline": baseline, "augmented": augmented, "extended": extended, "interaction": interaction, "temporal": temporal, "production": production,
    "production_with_order": production_with_order, "daily_lags": daily_lags, "pairs_w": lambda df: pair_expansion(df, "w"), "pairs_d": lambda df: pair_expansion(df, "d"), "pairs_behaviour": lambda df: pair_expansion(df, "behaviour"),
    "symbolic": symbolic, "generator": generator, "log_ratio": log_ratio, "correction": correction, "segments": segments, "coupling": coupling, "gates": gates, "lag_estimators": lag_estimators, "block_ranks": block_ranks,
}


def build_set(name: str, df: DataFrame) -> DataFrame:
    return REGISTRY[name](df)
