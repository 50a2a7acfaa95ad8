"""Queries over the driver's tables, each with SQL that gives the same rows.

The SQL never follows the Spark plan: series are taken apart into long rows and put together again
with plain aggregates and windows.
"""

from __future__ import annotations



from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import feature_sql
from .functions import arrays as A, autocorrelation as C, complexity as X, level as L, runs as R, spectral as S
from .operators import aggregates as G, audits as U, cleaning as K, models as M, ranks, relations as J, statistics as T, thresholds as H
from .plans import features as P
from .sources import files, series
from .sources.series import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "flagship"

#: Long rows of the two series of ``embeddings``.
W_ROWS = "w AS (SELECT vec_id, t, CAST(embedding[CAST(t AS INTEGER) + 1] AS DOUBLE) AS v, CAST(label AS INTEGER) % 4 AS tgt FROM embeddings, range(12) r(t))"
D_ROWS = "d AS (SELECT vec_id, t, CAST(embedding[CAST(t AS INTEGER) + 13] AS DOUBLE) AS v, CAST(label AS INTEGER) % 4 AS tgt FROM embeddings, range(16) r(t))"
WC_ROWS = f"{W_ROWS}, wc AS (SELECT vec_id, t, tgt, v, v - avg(v) OVER (PARTITION BY vec_id) AS c FROM w)"
DC_ROWS = f"{D_ROWS}, dc AS (SELECT vec_id, t, tgt, v, v - avg(v) OVER (PARTITION BY vec_id) AS c FROM d)"
#: Scalar features of the first series, by name.
FEATS = """feats AS (SELECT vec_id, max(tgt) AS tgt, avg(v) AS mean, stddev_pop(v) AS std, max(v) - min(v) AS range, regr_slope(v, t) AS slope, quantile_cont(v, 0.5) AS median FROM w GROUP BY vec_id)"""
FEATURES = ("mean", "std", "range", "slope", "median")
FOLD = "CAST(('0x' || substr(md5(CAST({id} AS VARCHAR) || '|{seed}'), 1, 8)) AS BIGINT) % {k}"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(**columns: Column) -> list[Column]:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.embedding_series(spark, sf_dir)


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    return emb(spark, sf_dir).select("vec_id", "tgt", A.mean(w).alias("mean"), A.std(w).alias("std"), L.amplitude(w).alias("range"), L.slope(w).alias("slope"), A.quantile(w, 0.5).alias("median"))



# -- sequences -----------------------------------------------------------------------------------


@query(f"""WITH {WC_ROWS}, f AS (
  SELECT a.vec_id, max(a.tgt) AS tgt, stddev_pop(a.v) AS sd, regr_slope(a.v, a.t) AS slope, sum(a.c * b.c) / (sum(a.c * a.c) + 1e-9) AS ac1
  FROM wc a LEFT JOIN wc b ON a.vec_id = b.vec_id AND b.t = a.t + 1 GROUP BY a.vec_id),
 s AS (SELECT vec_id, tgt, round(ac1, 6) AS ac1, round(sd, 6) AS std, round(slope, 6) AS slope, round(ac1 + sd + slope, 9) AS score FROM f),
 q AS (SELECT *, row_number() OVER (ORDER BY score, vec_id) AS r, count(*) OVER () AS n FROM s)
SELECT vec_id, ac1, std, slope, CAST(least(3, floor(r / (n + 1.0) * 4)) AS INTEGER) AS label, tgt FROM q""")
def flagship(spark, sf_dir):
    a = F.col("w")
    rows = emb(spark, sf_dir).select("vec_id", "tgt", C.acf(a, 1).alias("a"), A.std(a).alias("s"), L.slope(a).alias("b"))
    rows = ranks.with_ranks(rows.withColumn("score", F.round(F.col("a") + F.col("s") + F.col("b"), 9)), "score", "vec_id")
    return rows.select("vec_id", *r6(ac1=F.col("a"), std=F.col("s"), slope=F.col("b")), ranks.quartile_bin(F.col("r_first"), F.col("n_ranked")).alias("label"), "tgt")


LEVEL_SQL = """SELECT {id}, round(avg(v), 6) AS mean, round({sd}(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(max(v) - min(v), 6) AS range, round(quantile_cont(v, 0.5), 6) AS median,
 round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(max(v) FILTER (t = 11) - max(v) FILTER (t = 0), 6) AS last_minus_first, round(avg(v) FILTER (t >= 6) - avg(v) FILTER (t < 6), 6) AS late_minus_early,
 round(stddev_pop(dv), 6) AS diff_std, round(avg(abs(dv)), 6) AS diff_abs_mean, count(*) FILTER (dv > 0) AS positive_steps, count(*) FILTER (dv < 0) AS negative_steps, round(regr_slope(v, t), 6) AS slope{more}
 FROM (SELECT *, v - lag(v) OVER (PARTITION BY {id} ORDER BY t) AS dv FROM {src}) GROUP BY {id}"""
FULL_SQL = """, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v) FILTER (t = 0), 6) AS first, round(max(v) FILTER (t = 11), 6) AS last, round(avg(v) FILTER (t < 6), 6) AS early_mean,
 round(avg(v) FILTER (t >= 6), 6) AS late_mean, round(avg(dv), 6) AS diff_mean"""
EVENT_ROWS = """e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS v FROM events), ev AS (SELECT * FROM e WHERE t < 12 AND user_id IN (SELECT user_id FROM e WHERE t = 11))"""


def _summary(stats: dict[str, Column], digits: int = 6) -> list[Column]:
    return [c.alias(n) if n.endswith("steps") else F.round(c, digits).alias(n) for n, c in stats.items()]


@query(f"WITH {W_ROWS} " + LEVEL_SQL.format(id="vec_id", sd="stddev_pop", src="w", more=""))
def seq_level_pop(spark, sf_dir):
    return emb(spark, sf_dir).select("vec_id", *_summary(L.summary(F.col("w"))))


@query(f"WITH {EVENT_ROWS} " + LEVEL_SQL.format(id="user_id", sd="stddev_samp", src="ev", more=FULL_SQL))
def seq_level_samp(spark, sf_dir):
    return series.event_series(spark, sf_dir).select("user_id", *_summary(L.summary(F.col("a"), 1, True)))


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS v, count(*) OVER (PARTITION BY user_id) AS n FROM events),
 x AS (SELECT *, n // 2 AS half, v - lag(v) OVER (PARTITION BY user_id ORDER BY t) AS dv FROM e)
SELECT user_id, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS std, round(min(v), 9) AS min, round(max(v), 9) AS max, round(max(v) - min(v), 9) AS range, round(quantile_cont(v, 0.5), 9) AS median,
 round(quantile_cont(v, 0.25), 9) AS q25, round(quantile_cont(v, 0.75), 9) AS q75, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 9) AS iqr, round(max(v) FILTER (t = 0), 9) AS first, round(max(v) FILTER (t = n - 1), 9) AS last,
 round(max(v) FILTER (t = n - 1) - max(v) FILTER (t = 0), 9) AS last_minus_first, round(avg(v) FILTER (t < half), 9) AS early_mean, round(avg(v) FILTER (t >= half), 9) AS late_mean, round(avg(v) FILTER (t >= half) - avg(v) FILTER (t < half), 9) AS late_minus_early,
 round(avg(dv), 9) AS diff_mean, round(stddev_pop(dv), 9) AS diff_std, round(avg(abs(dv)), 9) AS diff_abs_mean, count(*) FILTER (dv > 0) AS positive_steps, count(*) FILTER (dv < 0) AS negative_steps, CASE WHEN count(*) > 1 THEN round(regr_slope(v, t), 9) END AS slope
FROM x GROUP BY user_id""")
def seq_level_samp_whole(spark, sf_dir):
    """Every event of every user; null where a statistic is undefined."""
    return series.event_series(spark, sf_dir, None).select("user_id", *_summary(L.summary(F.col("a"), 1, True), 9))


@query(f"""WITH {W_ROWS}, c AS (SELECT vec_id, t, sum(v) OVER (PARTITION BY vec_id ORDER BY t) AS s FROM w), p AS (SELECT *, max(s) OVER (PARTITION BY vec_id ORDER BY t) AS peak FROM c)
SELECT vec_id, round(max(s) - min(s), 6) AS cum_range, round(stddev_pop(s), 6) AS cum_std, round(max(s), 6) AS cum_max, round(min(s), 6) AS cum_min, round(max(peak - s), 6) AS drawdown FROM p GROUP BY vec_id""")
def seq_cum_path(spark, sf_dir):
    a = F.col("w")
    return emb(spark, sf_dir).select("vec_id", *r6(**L.cumulative(a), drawdown=L.drawdown(a)["worst"]))


ORDER_ROWS = """o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS t, o_totalprice AS v, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), os AS (SELECT * FROM o WHERE n >= 12)"""


@query(f"""WITH {ORDER_ROWS}, q AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY v) AS r FROM os), m AS (SELECT o_custkey, quantile_cont(v, 0.5) AS med, 2 * quantile_cont(v, 0.5) - 0 * min(v) AS x, quantile_cont(v, 0.5) + quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS thr,
 avg(v) FILTER (r > 1 AND r < n) AS trimmed FROM q GROUP BY o_custkey)
SELECT o_custkey, round(max(trimmed), 4) AS trimmed_mean, round(quantile_cont(abs(v - med), 0.5), 4) AS mad, count(*) FILTER (v > thr) AS spikes FROM os JOIN m USING (o_custkey) GROUP BY o_custkey""")
def seq_robust(spark, sf_dir):
    a = F.col("a")
    return series.order_series(spark, sf_dir).select("o_custkey", F.round(L.trimmed_mean(a), 4).alias("trimmed_mean"), F.round(L.mad(a), 4).alias("mad"), L.spikes(a).alias("spikes"))


@query("""WITH q AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
 m AS (SELECT o_custkey, quantile_cont(v, 0.5) AS med, round(quantile_cont(v, 0.5) + quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS thr, CASE WHEN count(*) > 2 THEN avg(v) FILTER (r > 1 AND r < n) ELSE avg(v) END AS trimmed FROM q GROUP BY o_custkey)
SELECT q.o_custkey, round(max(trimmed), 6) AS trimmed_mean, round(quantile_cont(abs(v - med), 0.5), 6) AS mad, count(*) FILTER (v > thr) AS spikes FROM q JOIN m ON q.o_custkey IS NOT DISTINCT FROM m.o_custkey GROUP BY q.o_custkey""")
def seq_robust_whole(spark, sf_dir):
    """Every order of every customer."""
    a = F.col("a")
    return series.order_series(spark, sf_dir, 1).select("o_custkey", *r6(trimmed_mean=L.trimmed_mean(a), mad=L.mad(a)), L.spikes(a, 6).alias("spikes"))


@query(f"""WITH {WC_ROWS}, m AS (SELECT vec_id, avg(c * c) AS m2, avg(c * c * c) AS m3, avg(c * c * c * c) AS m4 FROM wc GROUP BY vec_id),
 k AS (SELECT vec_id, m3 / pow(sqrt(m2) + 1e-12, 3) AS s, m4 / pow(sqrt(m2) + 1e-12, 4) - 3 AS k FROM m)
SELECT vec_id, round(s, 6) AS skew_pop, round(k, 6) AS kurt_pop, round(sqrt(12.0 * 11) / 10 * s, 6) AS skew_adj, round(11.0 / (10 * 9) * (13 * k + 6), 6) AS kurt_adj FROM k""")
def seq_moments(spark, sf_dir):
    a = F.col("w")
    return emb(spark, sf_dir).select("vec_id", *r6(skew_pop=L.skew(a), kurt_pop=L.kurtosis(a), skew_adj=L.skew_corrected(a), kurt_adj=L.kurtosis_corrected(a)))


@query(f"""WITH {W_ROWS}, x AS (SELECT *, v - lag(v) OVER (PARTITION BY vec_id ORDER BY t) AS d1 FROM w), y AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY vec_id ORDER BY t) AS d2 FROM x),
 g AS (SELECT vec_id, abs(d1) AS a, row_number() OVER (PARTITION BY vec_id ORDER BY abs(d1)) AS i FROM x WHERE d1 IS NOT NULL), gi AS (SELECT vec_id, sum((2 * i - 12) * a) / (11 * sum(a) + 1e-12) AS gini FROM g GROUP BY vec_id),
 s AS (SELECT vec_id, var_pop(v) AS v0, var_pop(d1) AS v1, var_pop(d2) AS v2, avg(abs(d2)) AS r FROM y GROUP BY vec_id)
SELECT vec_id, round(gini, 6) AS gini, round(v1 / (v0 + 1e-12), 6) AS var_ratio, round(sqrt(v2 / (v1 + 1e-12) + 1e-12) / (sqrt(v1 / (v0 + 1e-12) + 1e-12) + 1e-12), 6) AS complexity, round(r / (sqrt(v0) + 1e-12), 6) AS roughness FROM s JOIN gi USING (vec_id)""")
def seq_gini_hjorth(spark, sf_dir):
    a = F.col("w")
    return emb(spark, sf_dir).select("vec_id", *r6(gini=L.gini_of_steps(a), var_ratio=L.difference_variance_ratio(a), complexity=L.complexity(a), roughness=L.roughness(a)))


@query(f"""WITH {W_ROWS} SELECT vec_id, round(quantile_cont(v, 0.9) - quantile_cont(v, 0.1), 6) AS spread, round((quantile_cont(v, 0.75) + quantile_cont(v, 0.25) - 2 * quantile_cont(v, 0.5)) / (quantile_cont(v, 0.75) - quantile_cont(v, 0.25) + 1e-12), 6) AS bowley,
 round(avg(v) FILTER (t >= 8) - 2 * avg(v) FILTER (t >= 4 AND t < 8) + avg(v) FILTER (t < 4), 6) AS curvature, round(coalesce(stddev_samp(v) FILTER (t >= 6) / nullif(stddev_samp(v) FILTER (t < 6), 0), 0), 6) AS vol_ratio, round(sum(abs(v)), 6) AS abs_sum FROM w GROUP BY vec_id""")
def seq_shape(spark, sf_dir):
    a = F.col("w")
    return emb(spark, sf_dir).select("vec_id", *r6(spread=L.quantile_spread(a), bowley=L.bowley_skew(a), curvature=L.curvature(a), vol_ratio=L.volatility_ratio(a), abs_sum=L.abs_sum(a)))


def _islands(src: str, cond: str, name: str) -> str:
    return f"{name} AS (SELECT vec_id, max(n) AS n FROM (SELECT vec_id, count(*) AS n FROM (SELECT vec_id, t, {cond} AS ok, t - row_number() OVER (PARTITION BY vec_id, {cond} ORDER BY t) AS g FROM {src}) WHERE ok GROUP BY vec_id, g) GROUP BY vec_id)"


@query(f"""WITH {DC_ROWS}, x AS (SELECT *, v - lag(v) OVER (PARTITION BY vec_id ORDER BY t) AS d1 FROM dc), steps AS (SELECT * FROM x WHERE d1 IS NOT NULL), z AS (SELECT *, sign(d1) <> lag(sign(d1)) OVER (PARTITION BY vec_id ORDER BY t) AS turn FROM steps),
 cr AS (SELECT *, (c >= 0) <> lag(c >= 0) OVER (PARTITION BY vec_id ORDER BY t) AS cross_ FROM dc), {_islands("dc", "(v > 0)", "pos")}, {_islands("steps", "(d1 > 0)", "up")}, {_islands("steps", "(d1 < 0)", "down")}, {_islands("dc", "(c > 0)", "above")},
 tp AS (SELECT vec_id, count(*) FILTER (turn) AS turning FROM z GROUP BY vec_id), mc AS (SELECT vec_id, count(*) FILTER (cross_) AS crossings FROM cr GROUP BY vec_id)
SELECT vec_id, coalesce(pos.n, 0) AS longest_pos, coalesce(up.n, 0) AS longest_up, coalesce(up.n, 0) - coalesce(down.n, 0) AS asymmetry, coalesce(above.n, 0) AS longest_above, turning, crossings, round(16 / (crossings + 1.0), 6) AS mean_run
FROM tp JOIN mc USING (vec_id) LEFT JOIN pos USING (vec_id) LEFT JOIN up USING (vec_id) LEFT JOIN down USING (vec_id) LEFT JOIN above USING (vec_id)""")
def seq_runs(spark, sf_dir):
    a = F.col("d")
    return emb(spark, sf_dir).select(
        "vec_id", R.longest_run(a, lambda x: x > 0).alias("longest_pos"), R.longest_step_run(a, 1).alias("longest_up"), R.step_run_asymmetry(a).alias("asymmetry"), R.longest_above_mean(a).alias("longest_above"), R.turning_points(a).alias("turning"),
        R.mean_crossings(a).alias("crossings"), *r6(mean_run=R.mean_run_length(a)),
    )


@query(f"""WITH {D_ROWS}, steps AS (SELECT * FROM (SELECT *, sign(v - lag(v) OVER (PARTITION BY vec_id ORDER BY t)) AS s FROM d) WHERE s IS NOT NULL),
 st AS (SELECT *, CASE WHEN s <> 0 AND s = lag(s) OVER (PARTITION BY vec_id ORDER BY t) THEN 0 ELSE 1 END AS new FROM steps), g AS (SELECT *, sum(new) OVER (PARTITION BY vec_id ORDER BY t) AS run FROM st), n AS (SELECT vec_id, run, max(s) AS s, count(*) AS len FROM g GROUP BY vec_id, run)
SELECT vec_id, coalesce(max(len) FILTER (s > 0), 0) AS longest_up, coalesce(max(len) FILTER (s < 0), 0) AS longest_down, count(*) AS n_runs, round(avg(len), 6) AS mean_run, greatest(1, coalesce(max(len) FILTER (s <> 0), 1)) AS longest_monotone FROM n GROUP BY vec_id""")
def seq_step_runs(spark, sf_dir):
    a = F.col("d")
    s = R.run_statistics(a)
    return emb(spark, sf_dir).select("vec_id", s["longest_up"].alias("longest_up"), s["longest_down"].alias("longest_down"), s["n_runs"].alias("n_runs"), F.round(s["mean_run"], 6).alias("mean_run"), R.longest_monotone_run(a).alias("longest_monotone"))


@query(f"""WITH {DC_ROWS}, n AS (SELECT *, lag(v) OVER (PARTITION BY vec_id ORDER BY t) AS p, lead(v) OVER (PARTITION BY vec_id ORDER BY t) AS q FROM dc)
SELECT vec_id, round(count(*) FILTER (c > 0) / 16.0, 6) AS frac_above, count(*) FILTER (v > p AND v > q) AS n_max, round(count(*) FILTER ((v > p AND v > q) OR (v < p AND v < q)) / 16.0, 6) AS extrema_frac,
 round(arg_max(t, v) / 15.0, 6) AS peak_pos, round(arg_min(t, v) / 15.0, 6) AS trough_pos FROM n GROUP BY vec_id""")
def seq_extrema(spark, sf_dir):
    a = F.col("d")
    return emb(spark, sf_dir).select("vec_id", R.local_maxima(a).alias("n_max"), *r6(frac_above=R.fraction_above_mean(a), extrema_frac=R.extrema_fraction(a), peak_pos=R.peak_position(a), trough_pos=R.trough_position(a)))


LAGS_SQL = ", ".join(f"round(sum(CASE WHEN b.t = a.t + {k} THEN a.c * b.c END) / (max(ss) + 1e-9), 6) AS ac{k}" for k in range(1, 7))


@query(f"""WITH {DC_ROWS}, n AS (SELECT vec_id, sum(c * c) AS ss FROM dc GROUP BY vec_id) SELECT a.vec_id, {LAGS_SQL} FROM dc a JOIN dc b ON a.vec_id = b.vec_id AND b.t BETWEEN a.t + 1 AND a.t + 6 JOIN n ON n.vec_id = a.vec_id GROUP BY a.vec_id""")
def seq_acf(spark, sf_dir):
    return emb(spark, sf_dir).select("vec_id", C.acf_list(F.col("d"), 6).alias("r")).select("vec_id", *r6(**{f"ac{k}": F.get("r", F.lit(k - 1)) for k in range(1, 7)}))


@query(f"""WITH {DC_ROWS}, p AS (SELECT a.vec_id, a.v AS x, b.v AS y, a.c AS cx, b.c AS cy FROM dc a JOIN dc b ON a.vec_id = b.vec_id AND b.t = a.t + 2)
SELECT vec_id, round(sum(cx * cy) / (sqrt(sum(cx * cx) * sum(cy * cy)) + 1e-9), 6) AS pairwise, round(corr(x, y), 6) AS pearson, round(sum(cx * cy) / (sum(cx * cx) + 1e-9), 6) AS ols FROM p GROUP BY vec_id""")
def seq_acf_variants(spark, sf_dir):
    a = F.col("d")
    return emb(spark, sf_dir).select("vec_id", *r6(pairwise=C.acf_pairwise(a, 2), pearson=C.acf_pearson(a, 2), ols=C.ar_no_intercept(a, 2)))


@query(f"""WITH {DC_ROWS}, n AS (SELECT vec_id, sum(c * c) + 1e-12 AS ss FROM dc GROUP BY vec_id),
 r AS (SELECT a.vec_id, sum(a.c * b.c) FILTER (b.t = a.t + 1) / max(ss) AS r1, sum(a.c * b.c) FILTER (b.t = a.t + 2) / max(ss) AS r2, sum(a.c * b.c) FILTER (b.t = a.t + 3) / max(ss) AS r3 FROM dc a JOIN dc b ON a.vec_id = b.vec_id JOIN n ON n.vec_id = a.vec_id GROUP BY a.vec_id),
 p AS (SELECT vec_id, r1, r2, r3, (r2 - r1 * r1) / (1 - r1 * r1 + 1e-12) AS p2 FROM r), q AS (SELECT *, r1 - p2 * r1 AS f1 FROM p),
 ar AS (SELECT a.vec_id, regr_slope(b.v, a.v) AS coef, sqrt(var_pop(b.v) - pow(covar_pop(a.v, b.v), 2) / var_pop(a.v)) AS innov FROM d a JOIN d b ON a.vec_id = b.vec_id AND b.t = a.t + 1 GROUP BY a.vec_id)
SELECT vec_id, round(r1, 6) AS pacf1, round(p2, 6) AS pacf2, round((r3 - f1 * r2 - p2 * r1) / (1 - f1 * r1 - p2 * r2 + 1e-12), 6) AS pacf3, round(coef, 6) AS coef, round(innov, 6) AS innovation FROM q JOIN ar USING (vec_id)""")
def seq_ar_pacf(spark, sf_dir):
    rows = emb(spark, sf_dir).select("vec_id", C.pacf(F.col("d")).alias("p"), C.ar_intercept(F.col("d")).alias("ar"))
    return rows.select("vec_id", *r6(pacf1=F.get("p", F.lit(0)), pacf2=F.get("p", F.lit(1)), pacf3=F.get("p", F.lit(2)), coef=F.col("ar.coef"), innovation=F.col("ar.innovation")))


@query(f"""WITH {DC_ROWS}, x AS (SELECT a.vec_id, a.c AS y, b.c AS x1, e.c AS x2, g.c AS x3 FROM dc a JOIN dc b ON a.vec_id = b.vec_id AND b.t = a.t - 1 JOIN dc e ON a.vec_id = e.vec_id AND e.t = a.t - 2 JOIN dc g ON a.vec_id = g.vec_id AND g.t = a.t - 3),
 m AS (SELECT vec_id, sum(x1*x1)+1e-9 AS a, sum(x1*x2) AS b, sum(x1*x3) AS c, sum(x2*x2)+1e-9 AS e, sum(x2*x3) AS f, sum(x3*x3)+1e-9 AS i, sum(y*x1) AS p, sum(y*x2) AS q, sum(y*x3) AS s FROM x GROUP BY vec_id)
SELECT vec_id, round((a*(e*s - q*f) - b*(b*s - q*c) + p*(b*f - e*c)) / (a*(e*i - f*f) - b*(b*i - f*c) + c*(b*f - e*c)), 6) AS a3 FROM m""")
def seq_ar3(spark, sf_dir):
    return emb(spark, sf_dir).select("vec_id", *r6(a3=C.ar3(F.col("d"))))


RESAMPLED = """g AS (SELECT vec_id, i, lo, i * 15 / 11.0 - lo AS f FROM (SELECT DISTINCT vec_id FROM dc), (SELECT CAST(range AS INTEGER) AS i, CAST(floor(range * 15 / 11.0) AS INTEGER) AS lo FROM range(12))),
 dr AS (SELECT g.vec_id, i, a.c + f * (coalesce(b.c, a.c) - a.c) AS c FROM g JOIN dc a ON a.vec_id = g.vec_id AND a.t = lo LEFT JOIN dc b ON b.vec_id = g.vec_id AND b.t = lo + 1)"""


@query(f"""WITH {WC_ROWS}, {DC_ROWS}, {RESAMPLED}, nw AS (SELECT vec_id, sum(c * c) AS n FROM wc GROUP BY vec_id), nd AS (SELECT vec_id, sum(c * c) AS n FROM dr GROUP BY vec_id),
 x AS (SELECT a.vec_id, sum(a.c * b.c) FILTER (b.i = a.t - 1) AS p, sum(a.c * b.c) FILTER (b.i = a.t + 1) AS m, corr(a.c, b.c) FILTER (b.i = a.t) AS z, corr(a.c, b.c) FILTER (b.i = a.t + 1) AS lag1 FROM wc a JOIN dr b ON a.vec_id = b.vec_id GROUP BY a.vec_id)
SELECT vec_id, round((p - m) / (sqrt(nw.n * nd.n) + 1e-9), 6) AS lead_minus_lag, round(z, 6) AS ccf_0, round(lag1, 6) AS ccf_p1 FROM x JOIN nw USING (vec_id) JOIN nd USING (vec_id)""")
def seq_cross(spark, sf_dir):
    rows = emb(spark, sf_dir).select("vec_id", "w", "d", C.resample(F.col("d"), 12).alias("d12"))
    a, b = F.col("w"), F.col("d12")
    return rows.select("vec_id", *r6(lead_minus_lag=C.lead_minus_lag(a, F.col("d")), ccf_0=C.cross_pearson(a, b, 0), ccf_p1=C.cross_pearson(a, b, 1)))


@query(f"""WITH {W_ROWS}, {D_ROWS}, p AS (SELECT w.vec_id, w.v AS x, d.v AS y, row_number() OVER (PARTITION BY w.vec_id ORDER BY w.v, d.v) AS r, avg(w.v) OVER (PARTITION BY w.vec_id) AS mx, stddev_pop(w.v) OVER (PARTITION BY w.vec_id) AS sx,
 avg(d.v) OVER (PARTITION BY w.vec_id) AS my, stddev_pop(d.v) OVER (PARTITION BY w.vec_id) AS sy FROM w JOIN d ON w.vec_id = d.vec_id AND w.t = d.t)
SELECT vec_id, round(avg(y) FILTER (r > 9) - avg(y) FILTER (r <= 3), 6) AS contrast, round(avg((x - mx) / sx * (y - my) / sy), 6) AS coherence FROM p GROUP BY vec_id""")
def seq_gather(spark, sf_dir):
    a, b = F.col("w"), A.head(F.col("d"), 12)
    return emb(spark, sf_dir).select("vec_id", *r6(contrast=C.gather_contrast(a, b), coherence=C.coherence(a, b)))


@query(f"""WITH {WC_ROWS}, {DC_ROWS}, {RESAMPLED}, nw AS (SELECT vec_id, sum(c * c) AS n FROM wc GROUP BY vec_id), nd AS (SELECT vec_id, sum(c * c) AS n FROM dr GROUP BY vec_id),
 x AS (SELECT a.vec_id, sum(a.c * b.c) FILTER (b.i = a.t - 1) - sum(a.c * b.c) FILTER (b.i = a.t + 1) AS p FROM wc a JOIN dr b ON a.vec_id = b.vec_id GROUP BY a.vec_id),
 y AS (SELECT vec_id, p / (sqrt(nw.n * nd.n) + 1e-9) AS c, CAST(embedding[36] AS DOUBLE) AS g FROM x JOIN nw USING (vec_id) JOIN nd USING (vec_id) JOIN embeddings USING (vec_id))
SELECT vec_id AS id, round((g - avg(g) OVER ()) / (stddev_pop(g) OVER () + 1e-9) * (c - avg(c) OVER ()) / (stddev_pop(c) OVER () + 1e-9), 6) AS gated FROM y""")
def seq_gated(spark, sf_dir):
    return P.gated_coupling(series.student_frame(spark, sf_dir)).select("id", *r6(gated=F.col("gated")))


DFT_ROWS = f"{DC_ROWS}, b AS (SELECT vec_id, k, pow(sum(c * cos(2 * pi() * k * t / 16)), 2) + pow(sum(c * sin(2 * pi() * k * t / 16)), 2) AS p FROM dc, range(1, 9) q(k) GROUP BY vec_id, k)"


@query(f"""WITH {DFT_ROWS}, s AS (SELECT vec_id, arg_max(k, p) AS k, sum(p) AS t, sum(p * k / 16.0) / (sum(p) + 1e-12) AS m, sum(p * 16.0 / k) / (sum(p) + 1e-12) AS pc FROM b GROUP BY vec_id)
SELECT vec_id, CAST(max(s.k) AS INTEGER) AS dom_bin, round(16.0 / max(s.k), 6) AS dom_period, round(max(m), 6) AS centroid, round(sqrt(sum(p * pow(b.k / 16.0 - m, 2)) / (max(t) + 1e-12)), 6) AS spread, round(-sum(greatest(p / (t + 1e-12), 1e-12) * ln(greatest(p / (t + 1e-12), 1e-12))) - 1e-12 * ln(1e-12), 6) AS entropy,
 round(max(pc), 6) AS period_centroid FROM b JOIN s USING (vec_id) GROUP BY vec_id""")
def seq_dft(spark, sf_dir):
    rows = emb(spark, sf_dir).select("vec_id", S.power(F.col("d"), 16).alias("p"), S.dominant_period(F.col("d"), 16).alias("dp"))
    p = F.col("p")
    return rows.select("vec_id", S.dominant_bin(p).alias("dom_bin"), *r6(dom_period=F.col("dp"), centroid=S.centroid(p, 16), spread=S.spread(p, 16), entropy=S.entropy(p), period_centroid=S.period_centroid(p, 16)))


@query(f"""WITH {DC_ROWS}, g AS (SELECT vec_id, 2 + i / 4.0 AS period, pow(sum(c * cos(2 * pi() / (2 + i / 4.0) * t)), 2) / (sum(pow(cos(2 * pi() / (2 + i / 4.0) * t), 2)) + 1e-12) + pow(sum(c * sin(2 * pi() / (2 + i / 4.0) * t)), 2) / (sum(pow(sin(2 * pi() / (2 + i / 4.0) * t), 2)) + 1e-12) AS p, sum(c * c) AS ss
 FROM dc, range(1, 28) q(i) GROUP BY vec_id, i)
SELECT vec_id, round(max(p / (ss + 1e-12)), 6) AS share, round(max(p / (ss + 1e-12)) FILTER (period = 3), 6) AS share3, CAST(arg_max(period, p) AS DOUBLE) AS best_period FROM g GROUP BY vec_id""")
def seq_best_period(spark, sf_dir):
    # period 2 is left out: its sine is zero but for rounding, whose square no two engines agree on
    best = S.best_period(F.col("d"), 16, P.DAY_PERIODS[1:])
    return emb(spark, sf_dir).select("vec_id", best.alias("b"), F.round(S.fit_share(F.col("d"), 16, 3.0), 6).alias("share3")).select("vec_id", F.round("b.share", 6).alias("share"), "share3", F.col("b.period").alias("best_period"))


@query(f"""WITH {DFT_ROWS}, n AS (SELECT vec_id, sum(c * c) + 1e-12 AS ss FROM dc GROUP BY vec_id), a AS (SELECT x.vec_id, CAST(y.t - x.t AS INTEGER) AS k, sum(x.c * y.c) / max(ss) AS r FROM dc x JOIN dc y ON x.vec_id = y.vec_id AND y.t - x.t BETWEEN 1 AND 8 JOIN n ON n.vec_id = x.vec_id GROUP BY x.vec_id, y.t - x.t),
 l AS (SELECT *, lag(r) OVER (PARTITION BY vec_id ORDER BY k) AS p, lead(r) OVER (PARTITION BY vec_id ORDER BY k) AS q FROM a), ap AS (SELECT vec_id, coalesce(min(k) FILTER (k BETWEEN 2 AND 7 AND r > p AND r >= q), 8) AS acf_period, arg_min(k, r) AS acf_trough FROM l GROUP BY vec_id),
 e AS (SELECT vec_id, (pow(sum(c * cos(2 * pi() / 3 * t)), 2) + pow(sum(c * sin(2 * pi() / 3 * t)), 2)) / 16 AS energy3 FROM dc GROUP BY vec_id), br AS (SELECT vec_id, (max(p) FILTER (k = 5) * (6 - 16 / 3.0) + max(p) FILTER (k = 6) * (16 / 3.0 - 5)) / (max(p) FILTER (k = 4) + 1e-12) AS ratio FROM b GROUP BY vec_id)
SELECT vec_id, CAST(acf_period AS DOUBLE) AS acf_period, CAST(acf_trough AS DOUBLE) AS acf_trough, round(energy3, 6) AS energy3, round(ratio, 5) AS band_ratio FROM ap JOIN e USING (vec_id) JOIN br USING (vec_id)""")
def seq_period(spark, sf_dir):
    a = F.col("d")
    return emb(spark, sf_dir).select("vec_id", S.acf_period(a).alias("acf_period"), S.acf_trough(a).alias("acf_trough"), F.round(S.energy_at(a, 16, 3.0), 6).alias("energy3"), F.round(S.band_ratio(a, 16, 3.0, 4.0), 5).alias("band_ratio"))


@query(f"""WITH {DC_ROWS}, n AS (SELECT vec_id, sum(abs(v)) + 1e-9 AS s FROM d GROUP BY vec_id), e AS (SELECT vec_id, -sum(abs(v) / s * ln(abs(v) / s + 1e-9)) AS entropy FROM d JOIN n USING (vec_id) GROUP BY vec_id),
 c AS (SELECT vec_id, t, c, sum(c) OVER (PARTITION BY vec_id ORDER BY t) AS z FROM dc), h AS (SELECT vec_id, ln((max(z) - min(z)) / (sqrt(avg(c * c)) + 1e-12) + 1e-12) / ln(16) AS hurst FROM c GROUP BY vec_id),
 tr AS (SELECT a.vec_id, (a.v > b.v)::INT * 4 + (a.v > g.v)::INT * 2 + (b.v > g.v)::INT AS code FROM d a JOIN d b ON a.vec_id = b.vec_id AND b.t = a.t + 1 JOIN d g ON a.vec_id = g.vec_id AND g.t = a.t + 2), tc AS (SELECT vec_id, code, count(*) / 14.0 AS p FROM tr GROUP BY vec_id, code), pe AS (SELECT vec_id, -sum(p * ln(p)) / ln(6) AS pe FROM tc GROUP BY vec_id)
SELECT vec_id, round(entropy, 6) AS entropy, round(hurst, 6) AS hurst, round(pe, 6) AS permutation_entropy FROM e JOIN h USING (vec_id) JOIN pe USING (vec_id)""")
def seq_value_entropy(spark, sf_dir):
    a = F.col("d")
    return emb(spark, sf_dir).select("vec_id", *r6(entropy=X.value_entropy(a), hurst=X.hurst(a), permutation_entropy=X.permutation_entropy(a)))


@query()
def seq_complexity(spark, sf_dir):
    a = F.col("d")
    return emb(spark, sf_dir).select(
        "vec_id", X.sample_entropy(a).alias("sample_entropy"), X.two_scale_fluctuation(a, 16).alias("dfa2"), X.detrended_fluctuation(a, (3, 4, 5, 6, 8)).alias("dfa"), X.detrended_fluctuation(a, (4, 5, 6), 2).alias("dfa_order2"),
        X.higuchi_dimension(a, 5).alias("higuchi"), X.phrase_complexity(a).alias("phrases"),
    )


# -- ranks, bins and thresholds ----------------------------------------------------------------------


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r_first, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r_avg,
 round((rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0) / count(*) OVER (), 9) AS r_pct, round((rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 - 0.5) / count(*) OVER (), 9) AS r_mid FROM orders""")
def rank_family(spark, sf_dir):
    rows = ranks.with_ranks(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")
    return rows.select("o_orderkey", "r_first", "r_avg", F.round("r_pct", 9).alias("r_pct"), F.round("r_mid", 9).alias("r_mid"))


@query(f"""WITH {W_ROWS}, {FEATS}, r AS (SELECT vec_id, row_number() OVER (ORDER BY round(std, 9), vec_id) AS r, count(*) OVER () AS n, round(std, 9) AS s FROM feats)
SELECT vec_id, CAST(least(3, floor(r / (n + 1.0) * 4)) AS INTEGER) AS qb, CAST(least(3, floor((r - 1) * 4.0 / n)) AS INTEGER) AS ql, CAST(ntile(4) OVER (ORDER BY r) - 1 AS INTEGER) AS nt FROM r""")
def quartile_variants(spark, sf_dir):
    rows = ranks.with_ranks(scalars(spark, sf_dir).select("vec_id", F.round("std", 9).alias("s")), "s", "vec_id")
    r, n = F.col("r_first"), F.col("n_ranked")
    base, extra = F.floor(n / 4), F.pmod(n, F.lit(4))
    big = extra * (base + 1)
    nt = F.when(r <= big, F.floor((r - 1) / (base + 1))).otherwise(extra + F.floor((r - 1 - big) / base))
    return rows.select("vec_id", ranks.quartile_bin(r, n).alias("qb"), ranks.quartile_label(r, n).alias("ql"), nt.cast("int").alias("nt"))


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer)
SELECT c_custkey, (c_acctbal > a)::INT + (c_acctbal > b)::INT + (c_acctbal > c)::INT AS right_closed, (c_acctbal >= a)::INT + (c_acctbal >= b)::INT + (c_acctbal >= c)::INT AS left_closed FROM customer, q""")
def thresholds_apply(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    cuts = H.quartile_thresholds(rows, "c_acctbal")
    return rows.select("c_custkey", H.apply_thresholds(F.col("c_acctbal"), cuts).alias("right_closed"), H.apply_thresholds(F.col("c_acctbal"), cuts, False).alias("left_closed"))


OFFSETS = (-8, 0, 8)


@query(f"""WITH {W_ROWS}, {FEATS}, r AS (SELECT vec_id, tgt, row_number() OVER (ORDER BY round(std, 9), vec_id) AS r, count(*) OVER () AS n FROM feats), o AS (SELECT CAST(unnest([-8, 0, 8]) AS INTEGER) AS o),
 g AS (SELECT a.o AS o1, b.o AS o2, c.o AS o3 FROM o a, o b, o c), x AS (SELECT o1, o2, o3, vec_id, tgt, (r > n // 4 + o1)::INT + (r > 2 * n // 4 + o2)::INT + (r > 3 * n // 4 + o3)::INT AS p FROM r, g)
SELECT o1, o2, o3, round(avg((p = tgt)::INT), 6) AS accuracy, max(c) <= 140 AND min(c) >= 110 AS balanced FROM (SELECT *, count(*) OVER (PARTITION BY o1, o2, o3, p) AS c FROM x) GROUP BY o1, o2, o3""")
def threshold_grid(spark, sf_dir):
    rows = scalars(spark, sf_dir).select("vec_id", "tgt", F.round("std", 9).alias("s"))
    got = H.offset_accuracy(rows, "s", "tgt", "vec_id", H.offset_grid(OFFSETS))
    return got.select("o1", "o2", "o3", F.round("accuracy", 6).alias("accuracy"), H.passes_balance(F.col("counts"), 125.0, 15.0).alias("balanced"))


TWO = f"WITH {W_ROWS}, {FEATS}, p AS (SELECT vec_id, tgt, CAST(least(3, floor(row_number() OVER (ORDER BY round(std, 9), vec_id) / (count(*) OVER () + 1.0) * 4)) AS INTEGER) AS old, CAST(least(3, floor(row_number() OVER (ORDER BY round(range, 9), vec_id) / (count(*) OVER () + 1.0) * 4)) AS INTEGER) AS new, mean, std, range FROM feats)"


def _two_predictions(spark, sf_dir) -> DataFrame:
    rows = scalars(spark, sf_dir)

    def labels(score: str, name: str) -> DataFrame:
        ranked = ranks.with_ranks(rows.select("vec_id", F.round(score, 9).alias("s")), "s", "vec_id")
        return ranked.select("vec_id", ranks.quartile_bin(F.col("r_first"), F.col("n_ranked")).alias("label"))

    return J.compare_predictions(labels("std", "old"), labels("range", "new"), "vec_id", "label").join(rows, "vec_id")


@query(TWO + ", g AS (SELECT CAST(a.range AS INTEGER) AS old, CAST(b.range AS INTEGER) AS new FROM range(4) a, range(4) b) SELECT g.old, g.new, count(p.vec_id) AS n FROM g LEFT JOIN p ON p.old = g.old AND p.new = g.new GROUP BY g.old, g.new")
def submission_diff(spark, sf_dir):
    return G.crosstab(_two_predictions(spark, sf_dir), "old", "new", range(4))


@query(TWO + " SELECT new - old AS delta, count(*) AS n FROM p GROUP BY new - old")
def delta_counts(spark, sf_dir):
    return G.delta_counts(_two_predictions(spark, sf_dir), "old", "new")


@query(TWO + """, l AS (UNPIVOT p ON mean, std, range INTO NAME feature VALUE x) SELECT feature, round(avg(x) FILTER (old <> new), 6) AS mean_in, round(avg(x) FILTER (old = new), 6) AS mean_out, round(quantile_cont(x, 0.5) FILTER (old <> new), 6) AS median_in,
 round(quantile_cont(x, 0.5) FILTER (old = new), 6) AS median_out, round(avg(x) FILTER (old <> new) - avg(x) FILTER (old = new), 6) AS delta FROM l GROUP BY feature""")
def changed_contrast(spark, sf_dir):
    rows = G.contrast(_two_predictions(spark, sf_dir), ["mean", "std", "range"], F.col("changed"))
    return rows.select("feature", *r6(**{c: F.col(c) for c in rows.columns[1:]}))


@query(TWO + " SELECT round(avg((old = tgt)::INT), 6) AS accuracy, round(avg((abs(old - tgt) <= 1)::INT), 6) AS within_one, count(*) FILTER (abs(new - old) = 1) AS adjacent, count(*) FILTER (abs(new - old) > 1) AS far FROM p")
def accuracy_summary(spark, sf_dir):
    old, new, y = F.col("old"), F.col("new"), F.col("tgt")
    return _two_predictions(spark, sf_dir).agg(*r6(accuracy=G.accuracy(old, y), within_one=G.within_one(old, y)), F.count_if(F.abs(new - old) == 1).alias("adjacent"), F.count_if(F.abs(new - old) > 1).alias("far"))


@query(TWO + " SELECT tgt, count(*) AS n, count(*) FILTER (old <> tgt) AS errors FROM p GROUP BY tgt")
def error_counts(spark, sf_dir):
    return G.errors_by(_two_predictions(spark, sf_dir), "tgt", "old", "tgt")


@query(TWO + f", f AS (SELECT *, CAST({FOLD.format(id='vec_id', seed=7, k=5)} AS INTEGER) AS fold FROM p) SELECT fold, round(avg((old = tgt)::INT), 6) AS accuracy, count(*) AS n FROM f GROUP BY ROLLUP (fold)")
def fold_accuracy(spark, sf_dir):
    rows = _two_predictions(spark, sf_dir).withColumn("fold", T.hash_fold("vec_id", 5, 7))
    return G.fold_scores(rows, "fold", "old", "tgt").select("fold", F.round("accuracy", 6).alias("accuracy"), "n")


# -- aggregates, joins and sets ----------------------------------------------------------------------


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey) AS freq FROM lineitem")
def freq_encode(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    counts = rows.groupBy("l_suppkey").agg(F.count("*").alias("freq"))
    return J.lookup(rows, "l_suppkey", counts, "freq", 0)


@query("WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) SELECT d.s AS o_orderstatus, coalesce(n, 0) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS s) d LEFT JOIN c ON d.s = c.o_orderstatus")
def class_counts(spark, sf_dir):
    return G.value_counts(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


TE = ", ".join(f"round((kc{c} - kfc{c} + 10 * (tc{c} - fc{c}) / (tn - fn)) / (kn - kfn + 10), 6) AS te_{c}" for c in range(4))
TE_COUNTS = ", ".join(f"sum((tgt = {c})::INT) OVER (PARTITION BY key) AS kc{c}, sum((tgt = {c})::INT) OVER (PARTITION BY key, fold) AS kfc{c}, sum((tgt = {c})::INT) OVER (PARTITION BY fold) AS fc{c}, sum((tgt = {c})::INT) OVER () AS tc{c}" for c in range(4))


@query(f"""WITH e AS (SELECT vec_id, label % 4 AS tgt, vec_id % 37 AS key, {FOLD.format(id='vec_id', seed=1, k=5)} AS fold FROM embeddings),
 c AS (SELECT *, count(*) OVER (PARTITION BY key) AS kn, count(*) OVER (PARTITION BY key, fold) AS kfn, count(*) OVER (PARTITION BY fold) AS fn, count(*) OVER () AS tn, {TE_COUNTS} FROM e) SELECT vec_id, {TE} FROM c""")
def target_encode_oof(spark, sf_dir):
    rows = emb(spark, sf_dir).select("vec_id", "tgt", F.pmod("vec_id", F.lit(37)).alias("key"), T.hash_fold("vec_id", 5, 1).alias("fold"))
    got = G.encode_out_of_fold(rows, "key", "tgt", "fold", range(4))
    return got.select("vec_id", *r6(**{f"te_{c}": F.col(f"te_{c}") for c in range(4)}))


@query("""WITH s AS (SELECT text, md5(CAST(doc_id AS VARCHAR)) < '4' AS test FROM documents), c AS (SELECT text, count(*) FILTER (NOT test) AS a, count(*) FILTER (test) AS b FROM s GROUP BY text)
SELECT CAST(sum(CASE WHEN a > 0 AND b > 0 THEN a ELSE 0 END) AS BIGINT) AS overlap_train, CAST(sum(CASE WHEN a > 0 AND b > 0 THEN b ELSE 0 END) AS BIGINT) AS overlap_test, CAST(sum(CASE WHEN a > 1 THEN a ELSE 0 END) AS BIGINT) AS duplicates_train, CAST(sum(CASE WHEN b > 1 THEN b ELSE 0 END) AS BIGINT) AS duplicates_test FROM c""")
def exact_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("text", (F.md5(F.col("doc_id").cast("string").cast("binary")) < "4").alias("test"))
    return J.overlap(rows.where("not test"), rows.where("test"), ["text"])


@query("""WITH s AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e, vec_id % 5 = 0 AS test FROM embeddings),
 p AS (SELECT a.vec_id, b.vec_id AS nn_id, sqrt(list_sum([pow(a.e[i] - b.e[i], 2) FOR i IN range(1, 65)])) AS dist FROM s a JOIN s b ON a.test AND NOT b.test)
SELECT vec_id, arg_min(nn_id, (dist, nn_id)) AS nn_id, round(min(dist), 9) AS dist FROM p GROUP BY vec_id""")
def nearest_neighbor(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    test = F.pmod("vec_id", F.lit(5)) == 0
    return J.nearest(rows.where(~test), rows.where(test), "vec_id", "embedding").select("vec_id", "nn_id", F.round("dist", 9).alias("dist"))


GRID = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"""WITH l AS (SELECT DISTINCT feature, x FROM (UNPIVOT (SELECT {", ".join(GRID)} FROM lineitem) ON {", ".join(GRID)} INTO NAME feature VALUE x)), s AS (SELECT *, x - lag(x) OVER (PARTITION BY feature ORDER BY x) AS step FROM l)
SELECT feature, count(*) AS n_distinct, max(length(regexp_replace(split_part(printf('%.10f', x), '.', 2), '0+$', ''))) AS max_decimals, round(min(step) FILTER (step > 1e-12), 6) AS min_step, bool_and(x = floor(x)) AS is_integer FROM s GROUP BY feature""")
def grid_profile(spark, sf_dir):
    rows = G.grid_profile(table(spark, sf_dir, "lineitem"), GRID)
    return rows.select("feature", "n_distinct", F.col("max_decimals").cast("long").alias("max_decimals"), F.round("min_step", 6).alias("min_step"), "is_integer")


@query(f"""WITH l AS (UNPIVOT (SELECT {", ".join(GRID)} FROM lineitem) ON {", ".join(GRID)} INTO NAME feature VALUE x)
SELECT feature, count(*) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, min(x) AS min, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, max(x) AS max, CAST(0 AS BIGINT) AS missing, count(DISTINCT x) AS n_distinct FROM l GROUP BY feature""")
def frame_profile(spark, sf_dir):
    rows = G.profile(table(spark, sf_dir, "lineitem"), GRID)
    return rows.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(f"WITH {DC_ROWS}, n AS (SELECT vec_id, sum(c * c) + 1e-9 AS ss FROM dc GROUP BY vec_id), a AS (SELECT x.vec_id, max(x.tgt) AS tgt, y.t - x.t AS k, sum(x.c * y.c) / max(ss) AS r FROM dc x JOIN dc y ON x.vec_id = y.vec_id AND y.t - x.t BETWEEN 1 AND 3 JOIN n ON n.vec_id = x.vec_id GROUP BY x.vec_id, y.t - x.t) SELECT tgt, "
       + ", ".join(f"round(avg(r) FILTER (k = {k}), 6) AS mean_ac{k}" for k in (1, 2, 3)) + " FROM a GROUP BY tgt")
def class_profile(spark, sf_dir):
    rows = emb(spark, sf_dir).select("tgt", C.acf_list(F.col("d"), 3).alias("r"))
    return rows.groupBy("tgt").agg(*r6(**{f"mean_ac{k}": F.avg(F.get("r", F.lit(k - 1))) for k in (1, 2, 3)}))


@query(f"WITH {D_ROWS}, p AS (SELECT a.tgt, a.v AS x, b.v AS y FROM d a JOIN d b ON a.vec_id = b.vec_id AND b.t = a.t + 1) SELECT tgt, round(regr_slope(y, x), 6) AS coef, round(sqrt(var_pop(y) - pow(covar_pop(x, y), 2) / var_pop(x)), 6) AS innovation_std FROM p GROUP BY tgt")
def pooled_ar1(spark, sf_dir):
    return G.pooled_ar1(emb(spark, sf_dir), "d", "tgt").select("tgt", *r6(coef=F.col("coef"), innovation_std=F.col("innovation_std")))


@query("""WITH c AS (SELECT label AS cluster, vec_id % 4 AS y, count(*) AS n FROM embeddings GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, y) AS i, sum(n) OVER (PARTITION BY cluster) AS size FROM c)
SELECT cluster, CAST(size AS BIGINT) AS size, y AS majority, n AS majority_n, round(n / size, 6) AS purity FROM r WHERE i = 1""")
def cluster_purity(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), F.pmod("vec_id", F.lit(4)).alias("y"))
    return G.cluster_majority(rows, "cluster", "y").withColumn("purity", F.round(F.col("majority_n") / F.col("size"), 6))


@query("SELECT c_custkey, c_custkey % 7 AS c_custkey_mod_7, c_custkey // 10 AS c_custkey_div_10, (row_number() OVER (ORDER BY c_custkey) - 1) % 7 AS row_mod_7, (row_number() OVER (ORDER BY c_custkey) - 1) // 10 AS row_div_10 FROM customer")
def id_patterns(spark, sf_dir):
    return K.id_patterns(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 7, 10).drop("row_index")


@query("""SELECT o_custkey, count(*) AS given, count(*) FILTER (o_orderstatus = 'F') AS done, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS ratio, CAST(count(*) - count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS remaining, round(1 - count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS shortfall FROM orders GROUP BY o_custkey""")
def completion(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("given"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    c = K.completion(F.col("done"), F.col("given"))
    return rows.select("o_custkey", "given", "done", F.round(c["ratio"], 6).alias("ratio"), c["remaining"].alias("remaining"), F.round(c["shortfall"], 6).alias("shortfall"))


@query("WITH a AS (SELECT DISTINCT n_regionkey AS k FROM nation), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier) SELECT k FROM a INTERSECT SELECT k FROM b")
def set_intersection(spark, sf_dir):
    return J.rows_common(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_custkey AS id, c_acctbal AS x FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def set_union(spark, sf_dir):
    return J.stacked(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x")), table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("x"), F.col("s_suppkey").alias("id")))


@query("SELECT count(*) AS n_rows, count(*) FILTER (c_custkey % 10 = 0) AS unexpected, CAST(0 AS BIGINT) AS missing, count(*) FILTER (c_nationkey > 20) AS bad_labels FROM customer")
def contract(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    wanted = rows.where(F.pmod("c_custkey", F.lit(10)) != 0).select("c_custkey")
    return files.contract_report(rows, wanted, "c_custkey", "c_nationkey", range(21))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25")
def limited_scan(spark, sf_dir):
    return files.first_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 25)


# -- screens and shift ---------------------------------------------------------------------------------


LONG = f"WITH {W_ROWS}, {FEATS}, l AS (UNPIVOT (SELECT vec_id, tgt, round(mean, 9) AS mean, round(std, 9) AS std, round(range, 9) AS range, round(slope, 9) AS slope, round(median, 9) AS median, CAST(vec_id % 50 AS DOUBLE) AS base FROM feats) ON mean, std, range, slope, median INTO NAME feature VALUE x)"


def _rank_sql(column: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {column}) + (count(*) OVER (PARTITION BY {by}, {column}) - 1) / 2.0"


def _rounded(spark, sf_dir) -> DataFrame:
    return scalars(spark, sf_dir).select("vec_id", "tgt", *[F.round(c, 9).alias(c) for c in FEATURES], F.pmod("vec_id", F.lit(50)).cast("double").alias("base"))


@query(LONG + f", r AS (SELECT feature, {_rank_sql('x', 'feature')} AS rx, {_rank_sql('tgt', 'feature')} AS ry FROM l) SELECT feature, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY feature")
def spearman_screen(spark, sf_dir):
    return T.spearman(T.unpivot(_rounded(spark, sf_dir), ["vec_id", "tgt"], FEATURES), "tgt").select("feature", *r6(spearman=F.col("spearman")))


PARTIAL = "(corr(rx, ry) - corr(rx, rc) * corr(ry, rc)) / sqrt((1 - pow(corr(rx, rc), 2)) * (1 - pow(corr(ry, rc), 2)))"


@query(LONG + f", r AS (SELECT feature, {_rank_sql('x', 'feature')} AS rx, {_rank_sql('tgt', 'feature')} AS ry, {_rank_sql('base', 'feature')} AS rc FROM l) SELECT feature, round(corr(rx, ry), 6) AS spearman, round({PARTIAL}, 6) AS partial, abs({PARTIAL}) >= 0.04 AS flag FROM r GROUP BY feature")
def partial_screen(spark, sf_dir):
    got = T.screen(_rounded(spark, sf_dir), "vec_id", FEATURES, "tgt", "base")
    return got.select("feature", *r6(spearman=F.col("spearman"), partial=F.col("partial")), "flag")


@query(LONG + f", f AS (SELECT *, CAST({FOLD.format(id='vec_id', seed=3, k=2)} AS INTEGER) AS fold FROM l), r AS (SELECT feature, fold, {_rank_sql('x', 'feature, fold')} AS rx, {_rank_sql('tgt', 'feature, fold')} AS ry, {_rank_sql('base', 'feature, fold')} AS rc FROM f) SELECT feature, fold, round({PARTIAL}, 6) AS partial FROM r GROUP BY feature, fold")
def fold_stability(spark, sf_dir):
    return T.stability(_rounded(spark, sf_dir), "vec_id", FEATURES, "tgt", "base", 2, 3).select("feature", "fold", *r6(partial=F.col("partial")))


@query(LONG + " SELECT feature, round(corr(x, tgt), 6) AS r FROM l GROUP BY feature")
def pearson_screen(spark, sf_dir):
    return T.pearson_with(_rounded(spark, sf_dir), FEATURES, "tgt").select("feature", *r6(r=F.col("r")))


@query(LONG + ", q AS (SELECT feature, tgt, least(3, floor((row_number() OVER (PARTITION BY feature ORDER BY x, vec_id) - 1) * 4.0 / count(*) OVER (PARTITION BY feature))) AS p FROM l) SELECT feature, round(greatest(avg((p = tgt)::INT), avg((3 - p = tgt)::INT)), 6) AS accuracy FROM q GROUP BY feature")
def monotone_screen(spark, sf_dir):
    return M.monotone_accuracy(T.unpivot(_rounded(spark, sf_dir), ["vec_id", "tgt"], FEATURES), "vec_id", "tgt").select("feature", *r6(accuracy=F.col("accuracy")))


SHIFT_ROWS = "s AS (SELECT o_totalprice AS price, CAST(o_custkey AS DOUBLE) AS cust, CAST(month(o_orderdate) AS DOUBLE) AS month, o_orderdate >= TIMESTAMP '1998-01-01' AS test FROM orders), l AS (UNPIVOT s ON price, cust, month INTO NAME feature VALUE x)"
PSI_SQL = """e AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FILTER (NOT test))) AS e FROM l GROUP BY feature),
 b AS (SELECT feature, test, x, len(list_filter(e[2:len(e) - 1], lambda q: q < x)) AS bin, len(e) - 1 AS nb FROM l JOIN e USING (feature)), g AS (SELECT DISTINCT feature, CAST(unnest(range(nb)) AS BIGINT) AS bin FROM b),
 c AS (SELECT g.feature, g.bin, count(*) FILTER (NOT test) AS n0, count(*) FILTER (test) AS n1 FROM g LEFT JOIN b ON b.feature = g.feature AND b.bin = g.bin GROUP BY g.feature, g.bin),
 h AS (SELECT feature, greatest(n0 / sum(n0) OVER (PARTITION BY feature), 1e-6) AS p, greatest(n1 / sum(n1) OVER (PARTITION BY feature), 1e-6) AS q FROM c), psi AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM h GROUP BY feature)"""


def _shift_frame(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("cust"), F.month("o_orderdate").cast("double").alias("month"), (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("test"))


@query(f"WITH {SHIFT_ROWS}, {PSI_SQL} SELECT feature, round(psi, 6) AS psi FROM psi")
def psi_shift(spark, sf_dir):
    long = T.unpivot(_shift_frame(spark, sf_dir), ["test"], ["price", "cust", "month"])
    return T.psi(long, F.col("test")).select("feature", *r6(psi=F.col("psi")))


@query(f"""WITH {SHIFT_ROWS}, {PSI_SQL}, m AS (SELECT feature, avg(x) FILTER (NOT test) AS m0, avg(x) FILTER (test) AS m1, (avg(x) FILTER (test) - avg(x) FILTER (NOT test)) / sqrt((var_pop(x) FILTER (test) + var_pop(x) FILTER (NOT test)) / 2) AS smd,
 quantile_cont(x, 0.1) FILTER (test) - quantile_cont(x, 0.1) FILTER (NOT test) AS q10, quantile_cont(x, 0.5) FILTER (test) - quantile_cont(x, 0.5) FILTER (NOT test) AS q50, quantile_cont(x, 0.9) FILTER (test) - quantile_cont(x, 0.9) FILTER (NOT test) AS q90 FROM l GROUP BY feature)
SELECT feature, round(m0, 4) AS train_mean, round(m1, 4) AS test_mean, round(smd, 6) AS smd, round(q10, 4) AS q10_delta, round(q50, 4) AS q50_delta, round(q90, 4) AS q90_delta, round(psi, 6) AS psi,
 CASE WHEN psi >= 0.25 OR abs(smd) >= 0.5 THEN 'high' WHEN psi >= 0.1 OR abs(smd) >= 0.25 THEN 'medium' ELSE 'low' END AS risk FROM m JOIN psi USING (feature)""")
def shift_table(spark, sf_dir):
    got = T.shift_table(_shift_frame(spark, sf_dir), ["price", "cust", "month"], F.col("test"))
    four = {c: F.round(c, 4) for c in ("train_mean", "test_mean", "q10_delta", "q50_delta", "q90_delta")}
    return got.withColumns(four | {"smd": F.round("smd", 6), "psi": F.round("psi", 6)})


PAIR_SQL = " UNION ALL ".join(f"SELECT '{a}*{b}' AS feature, l_extendedprice AS y, {a} * {b} AS x FROM lineitem" for i, a in enumerate(GRID[:1] + GRID[2:]) for b in (GRID[:1] + GRID[2:])[i + 1 :])


@query(f"WITH l AS ({PAIR_SQL}), r AS (SELECT feature, {_rank_sql('x', 'feature')} AS rx, {_rank_sql('y', 'feature')} AS ry FROM l) SELECT feature, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY feature")
def pair_interactions(spark, sf_dir):
    terms = K.products(GRID[:1] + GRID[2:])
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), *[c.alias(n) for n, c in terms.items()])
    long = rows.select("y", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("x")) for n in terms])).alias("r")).select("y", "r.feature", "r.x")
    return T.spearman(long, "y").select("feature", *r6(spearman=F.col("spearman")))


SEEDS_SQL = f"WITH {W_ROWS}, {FEATS}, s AS (SELECT vec_id, tgt, CAST(seed AS INTEGER) AS seed, round(std + 0.05 * (CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '|' || seed), 1, 8)) AS BIGINT) % 1000) / 1000.0, 9) AS score, round(slope, 9) AS extra FROM feats, range(42, 45) q(seed))"


def _seed_scores(spark, sf_dir) -> DataFrame:
    rows = scalars(spark, sf_dir).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in (42, 43, 44)])))
    noise = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.col("vec_id"), F.col("seed")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(1000)) / F.lit(1000.0)
    return rows.select("vec_id", "tgt", "seed", F.round(F.col("std") + F.lit(0.05) * noise, 9).alias("score"), F.round("slope", 9).alias("extra"))


@query(SEEDS_SQL + ", r AS (SELECT vec_id, row_number() OVER (PARTITION BY seed ORDER BY score, vec_id) AS r FROM s), a AS (SELECT vec_id, round(avg(r), 6) AS avg_rank FROM r GROUP BY vec_id) SELECT vec_id, avg_rank, CAST(least(3, floor(row_number() OVER (ORDER BY avg_rank, vec_id) / (count(*) OVER () + 1.0) * 4)) AS INTEGER) AS label FROM a")
def rank_average(spark, sf_dir):
    got = ranks.rank_average(_seed_scores(spark, sf_dir), "vec_id", "seed", "score").withColumn("avg_rank", F.round("avg_rank", 6))
    got = ranks.with_ranks(got, "avg_rank", "vec_id")
    return got.select("vec_id", "avg_rank", ranks.quartile_bin(F.col("r_first"), F.col("n_ranked")).alias("label"))


@query(SEEDS_SQL + """, z AS (SELECT vec_id, tgt, seed, (score - avg(score) OVER (PARTITION BY seed)) / (stddev_pop(score) OVER (PARTITION BY seed) + 1e-12) AS b, (extra - avg(extra) OVER (PARTITION BY seed)) / (stddev_pop(extra) OVER (PARTITION BY seed) + 1e-12) AS e FROM s),
 a AS (SELECT unnest([-0.5, 0.0, 0.5, 1.0]) AS alpha, unnest([0, 1, 2, 3]) AS ord), o AS (SELECT h.seed AS held, vec_id, max(tgt) AS tgt, avg(b) AS b, avg(e) AS e FROM z JOIN (SELECT DISTINCT seed FROM z) h ON z.seed <> h.seed GROUP BY h.seed, vec_id),
 x AS (SELECT held, alpha, ord, tgt, least(3, floor((row_number() OVER (PARTITION BY held, alpha ORDER BY round(b + alpha * e, 9), vec_id) - 1) * 4.0 / count(*) OVER (PARTITION BY held, alpha))) AS p FROM o, a), sc AS (SELECT held, alpha, ord, avg((p = tgt)::INT) AS acc FROM x GROUP BY ALL),
 best AS (SELECT held, alpha FROM (SELECT *, row_number() OVER (PARTITION BY held ORDER BY acc DESC, ord) AS i FROM sc) WHERE i = 1),
 y AS (SELECT seed AS held, alpha, tgt, least(3, floor((row_number() OVER (PARTITION BY seed, alpha ORDER BY round(b + alpha * e, 9), vec_id) - 1) * 4.0 / count(*) OVER (PARTITION BY seed, alpha))) AS p FROM z, a)
SELECT held, CAST(alpha AS DOUBLE) AS alpha, round(avg((p = tgt)::INT), 6) AS accuracy FROM y JOIN best USING (held, alpha) GROUP BY held, alpha""")
def alpha_transfer(spark, sf_dir):
    return T.transfer(_seed_scores(spark, sf_dir), "vec_id", "seed", "score", "extra", "tgt", [-0.5, 0.0, 0.5, 1.0]).select("held", "alpha", F.round("accuracy", 6).alias("accuracy"))


SUBSETS = [(a, b) for i, a in enumerate(FEATURES[:4]) for b in FEATURES[i + 1 : 4]] + [(a, b, c) for i, a in enumerate(FEATURES[:4]) for j, b in enumerate(FEATURES[i + 1 : 4], i + 1) for c in FEATURES[j + 1 : 4]]
SUBSET_SQL = " UNION ALL ".join(f"SELECT '{'+'.join(s)}' AS subset, vec_id, tgt, round(({' + '.join('z_' + c for c in s)}) / {len(s)}, 9) AS x FROM z" for s in SUBSETS)


@query(f"WITH {W_ROWS}, {FEATS}, z AS (SELECT vec_id, tgt, " + ", ".join(f"({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-12) AS z_{c}" for c in FEATURES[:4]) + f" FROM feats), s AS ({SUBSET_SQL}), p AS (SELECT subset, tgt, least(3, floor(row_number() OVER (PARTITION BY subset ORDER BY x, vec_id) / (count(*) OVER (PARTITION BY subset) + 1.0) * 4)) AS p FROM s) SELECT subset, round(avg((p = tgt)::INT), 6) AS accuracy FROM p GROUP BY subset")
def blend_subsets(spark, sf_dir):
    return M.blend_subsets(scalars(spark, sf_dir), "vec_id", FEATURES[:4], "tgt").select("subset", F.round("accuracy", 6).alias("accuracy"))


@query("""WITH p AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: exp(CAST(x AS DOUBLE))) AS a, list_transform(embedding[5:8], lambda x: exp(CAST(x AS DOUBLE))) AS b FROM embeddings), s AS (SELECT vec_id, a, b, list_sum(a) AS sa, list_sum(b) AS sb FROM p),
 v AS (SELECT vec_id, [(0.75 * a[i] / sa + 0.25 * b[i] / sb) FOR i IN range(1, 5)] AS p FROM s) SELECT vec_id, round(p[2] + 2 * p[3] + 3 * p[4], 6) AS ev, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS label FROM v""")
def soft_vote(spark, sf_dir):
    share = lambda a: A.let(F.transform(a, lambda x: F.exp(x)), lambda e: A.let(A.total(e), lambda t: F.transform(e, lambda x: x / t)))
    e = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", share(F.slice(e, 1, 4)).alias("a"), share(F.slice(e, 5, 4)).alias("b"))
    rows = rows.select("vec_id", M.soft_vote([F.col("a"), F.col("b")], [3.0, 1.0]).alias("p"))
    return rows.select("vec_id", *r6(ev=M.expected_value(F.col("p"))), M.argmax(F.col("p")).alias("label"))


@query("""WITH f AS (SELECT vec_id, label % 4 AS tgt, (row_number() OVER (PARTITION BY label % 4 ORDER BY md5(CAST(vec_id AS VARCHAR) || '|42'), vec_id) - 1) % 5 AS fold FROM embeddings) SELECT vec_id, CAST(tgt AS INTEGER) AS tgt, CAST(fold AS INTEGER) AS fold FROM f""")
def stratified_folds(spark, sf_dir):
    return M.stratified_folds(emb(spark, sf_dir).select("vec_id", "tgt"), "vec_id", "tgt")


@query(f"WITH {W_ROWS}, {FEATS}, r AS (SELECT vec_id, tgt, (row_number() OVER (ORDER BY round(std, 9), vec_id) - 0.5) / count(*) OVER () AS p FROM feats) SELECT vec_id, round((tgt + 0.5) / 4 - p, 9) AS residual, round(least(abs(p - 0.25), abs(p - 0.5), abs(p - 0.75)), 9) AS boundary, round(least(greatest(p + 0.5 * ((tgt + 0.5) / 4 - p), 0), 1), 9) AS corrected FROM r")
def residual_targets(spark, sf_dir):
    rows = ranks.with_ranks(scalars(spark, sf_dir).select("vec_id", "tgt", F.round("std", 9).alias("s")), "s", "vec_id")
    p = (F.col("r_first") - 0.5) / F.col("n_ranked")
    res = ranks.midpoint(F.col("tgt")) - p
    return rows.select("vec_id", F.round(res, 9).alias("residual"), F.round(ranks.boundary_distance(p), 9).alias("boundary"), F.round(H.shift_labels(p, res, 0.5), 9).alias("corrected"))


@query(f"""WITH {W_ROWS}, {FEATS}, f AS (SELECT vec_id, round(mean, 9) AS mean, round(std, 9) AS std, round(range, 9) AS range, round(slope, 9) AS slope FROM feats),
 p AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM f" for i, a in enumerate(FEATURES[:4]) for b in FEATURES[i + 1 : 4])}),
 r AS (SELECT a, b, {_rank_sql('x', 'a, b')} AS rx, {_rank_sql('y', 'a, b')} AS ry FROM p) SELECT a, b, round(corr(rx, ry), 6) AS r FROM r GROUP BY a, b""")
def rank_diversity(spark, sf_dir):
    return U.rank_correlation(_rounded(spark, sf_dir), FEATURES[:4]).select("a", "b", *r6(r=F.col("r")))


@query(SEEDS_SQL + f""", p AS (SELECT seed, extra AS x, (tgt + 0.5) / 4 - ({_rank_sql('score', 'seed')} - 0.5) / count(*) OVER (PARTITION BY seed) AS res FROM s), q AS (SELECT seed, x, round(res, 9) AS res, round(abs(res), 9) AS size FROM p),
 a AS (SELECT corr(rx, ry) AS signed, corr(rx, rs) AS absolute FROM (SELECT {_rank_sql('x', '1')} AS rx, {_rank_sql('res', '1')} AS ry, {_rank_sql('size', '1')} AS rs FROM q)),
 e AS (SELECT seed, corr(rx, ry) AS c FROM (SELECT seed, {_rank_sql('x', 'seed')} AS rx, {_rank_sql('res', 'seed')} AS ry FROM q) GROUP BY seed)
SELECT 'extra' AS feature, round(any_value(signed), 6) AS signed, round(any_value(absolute), 6) AS absolute, round(avg(c), 6) AS seed_mean, round(stddev_pop(c), 6) AS seed_std, round(avg((sign(c) = sign(signed))::INT), 6) AS sign_agreement FROM e, a""")
def residual_audit(spark, sf_dir):
    rows = ranks.with_ranks(_seed_scores(spark, sf_dir), "score", "vec_id", within=["seed"])
    rows = rows.withColumn("res", F.round(ranks.midpoint(F.col("tgt")) - (F.col("r_avg") - 0.5) / F.col("n_ranked"), 9))
    got = U.residual_audit(rows.select("vec_id", "seed", "extra", "res"), "vec_id", "seed", ["extra"], "res")
    return got.select("feature", *r6(**{c: F.col(c) for c in ("signed", "absolute", "seed_mean", "seed_std", "sign_agreement")}))


# -- properties only: draws, trees and clusters --------------------------------------------------------


@query()
def mixup(spark, sf_dir):
    rows = scalars(spark, sf_dir).select("vec_id", "tgt", *FEATURES)
    return J.mixup(rows, "vec_id", "tgt", FEATURES, factor=0.25, seed=42)


@query()
def ordinal_ranker(spark, sf_dir):
    rows = M.stratified_folds(scalars(spark, sf_dir), "vec_id", "tgt", 3)
    score = lambda a, b: M.ordinal_score(a, b, FEATURES, "tgt", "vec_id", make=lambda seed: M.classifier("gbt", seed, 5, 3))
    return M.out_of_fold(rows, "fold", 3, score)


@query()
def ridge_correction(spark, sf_dir):
    rows = ranks.with_ranks(scalars(spark, sf_dir), "std", "vec_id").withColumn("pct", F.col("r_mid"))
    return M.nested_correction(rows.select("vec_id", "tgt", "pct", *FEATURES), "vec_id", FEATURES, "pct", "tgt", 3)


@query()
def cluster_majority_cv(spark, sf_dir):
    return M.cluster_majority_cv(scalars(spark, sf_dir), "vec_id", FEATURES, "tgt", 8, 3)


def _feature_query(name: str):
    def run(spark, sf_dir):
        found = P.build_set(name, series.student_frame(spark, sf_dir))
        return found.select(*P.KEEP, *[(F.round(F.col(f"`{c}`"), 6) + 0.0).alias(c) for c in found.columns if c not in P.KEEP])

    run.__name__ = f"features_{name}"
    return run


for _name in P.REGISTRY:
    query(feature_sql.sql(_name))(_feature_query(_name))
