"""DuckDB SQL for the feature sets, written with list functions over the two series of a row.

Formulas are those of the sets' descriptions, said again in another dialect: nothing here is made from the Spark columns.
"""

from __future__ import annotations

LATENT = ("motivation", "discipline", "distance", "activities", "attendance", "literacy", "siblings", "interest")
N = {"w": 12, "d": 16, "b": 12}
FRAME = f"""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS INTEGER) % 4 AS target FROM embeddings),
 s AS (SELECT vec_id AS id, target, e[1:12] AS w, e[13:28] AS d, {", ".join(f"e[{29 + i}] AS {c}" for i, c in enumerate(LATENT))}, CAST(vec_id * 5 % (vec_id % 7 + 4) AS DOUBLE) AS done, CAST(vec_id % 7 + 3 AS DOUBLE) AS given,
  CAST(vec_id * 37 % 101 AS DOUBLE) AS room, (vec_id * 17 % 100) / 100.0::DOUBLE AS exam_order, list_sum(e[1:12]) * 10 + 50 AS tryout FROM e),
 c AS (SELECT *, list_transform(w, lambda x: x - list_avg(w)) AS wc, list_transform(d, lambda x: x - list_avg(d)) AS dc, done / given AS r FROM s),
 f AS (SELECT *, list_transform(range(1, 12), lambda i: w[i + 1] - w[i]) AS wd, list_transform(range(1, 16), lambda i: d[i + 1] - d[i]) AS dd, list_transform(range(1, 13), lambda i: list_sum(w[1:i])) AS run,
  list_transform(range(0, 12), lambda i: CASE WHEN i = 11 THEN d[16] ELSE d[1 + i * 15 // 11] + (i * 15 / 11.0::DOUBLE - i * 15 // 11) * (d[2 + i * 15 // 11] - d[1 + i * 15 // 11]) END) AS b,
  list_transform(range(0, 9), lambda k: pow(list_sum(list_transform(range(0, 16), lambda t: dc[t + 1] * cos(2 * pi() * k * t / 16))), 2) + pow(list_sum(list_transform(range(0, 16), lambda t: dc[t + 1] * sin(2 * pi() * k * t / 16))), 2)) AS p FROM c)"""


def agg(a: str, name: str, *more: float) -> str:
    return f"list_aggregate({a}, '{name}'{''.join(f', {m}' for m in more)})"


def mean(a: str) -> str:
    return f"list_avg({a})"


def total(a: str, body: str) -> str:
    return f"list_sum(list_transform({a}, lambda x: {body}))"


def over(lo: int, hi: int, body: str) -> str:
    """Sum of ``body`` for i from lo to hi, both included."""
    return f"list_sum(list_transform(range({lo}, {hi + 1}), lambda i: {body}))"


def std(a: str, sample: bool = False) -> str:
    return agg(a, "stddev_samp" if sample else "stddev_pop")


def quantile(a: str, p: float) -> str:
    return agg(a, "quantile_cont", p)


def iqr(a: str) -> str:
    return f"({quantile(a, 0.75)} - {quantile(a, 0.25)})"


def reach(a: str) -> str:
    return f"(list_max({a}) - list_min({a}))"


def slope(a: str, n: int) -> str:
    mid = (n - 1) / 2
    return f"({over(1, n, f'(i - {mid + 1}) * {a}[i]')} / {sum((i - mid) ** 2 for i in range(n))})"


def diffs(s: str) -> str:
    return {"w": "wd", "d": "dd"}[s]


def summary(s: str, sample: bool = False, full: bool = False) -> dict[str, str]:
    n, dv = N[s], diffs(s)
    early, late = mean(f"{s}[1:{n // 2}]"), mean(f"{s}[{n // 2 + 1}:{n}]")
    out = {"mean": mean(s), "std": std(s, sample), "min": f"list_min({s})", "max": f"list_max({s})", "range": reach(s), "median": quantile(s, 0.5), "iqr": iqr(s), "last_minus_first": f"{s}[{n}] - {s}[1]", "late_minus_early": f"{late} - {early}"}
    if full:
        out |= {"q25": quantile(s, 0.25), "q75": quantile(s, 0.75), "first": f"{s}[1]", "last": f"{s}[{n}]", "early_mean": early, "late_mean": late, "diff_mean": mean(dv)}
    count = lambda sign: f"len(list_filter({dv}, lambda x: x {sign} 0))"
    return out | {"diff_std": std(dv), "diff_abs_mean": f"{total(dv, 'abs(x)')} / {n - 1}", "positive_steps": count(">"), "negative_steps": count("<"), "slope": slope(s, n)}


def prefixed(p: str, columns: dict[str, str]) -> dict[str, str]:
    return {f"{p}_{k}": v for k, v in columns.items()}


def signal() -> dict[str, str]:
    change = total("w", "abs(x)")
    return {
        "compl_ratio": "r", "compl_diff": "done - given", "compl_remaining": "given - done", "w_std": std("w"), "w_range": reach("w"), "w_iqr": iqr("w"), "abs_change_sum": change, "abs_change_mean": f"{change} / 12",
        "cum_range": reach("run"), "cum_std": std("run"), "cum_max": "list_max(run)", "cum_min": "list_min(run)", "tryout": "tryout", "vol_x_compl": f"{std('w')} * r", "range_x_compl": f"{reach('w')} * r", "tryout_x_compl": "tryout * r", "abschg_x_compl": f"{change} * r",
    }


def lean() -> dict[str, str]:
    return signal() | prefixed("w", summary("w")) | {"cum_std2": std("run")}


def full() -> dict[str, str]:
    return lean() | prefixed("d", summary("d")) | {c: c for c in (*LATENT, "exam_order")} | {"room_freq": "count(*) OVER (PARTITION BY room)", "room_mod10": "room % 10"}


def acf(c: str, n: int, k: int, eps: str = "1e-9") -> str:
    return f"({over(1, n - k, f'{c}[i] * {c}[i + {k}]')} / ({total(c, 'x * x')} + {eps}))"


def changes(signs: str, n: int) -> str:
    return f"len(list_filter(range(1, {n}), lambda i: ({signs})[i] <> ({signs})[i + 1]))"


def longest(a: str, test: str) -> str:
    """Longest run of elements x that pass a test."""
    marks = f"array_to_string(list_transform({a}, lambda x: CASE WHEN {test} THEN '1' ELSE '0' END), '')"
    return f"list_max(list_transform(string_split({marks}, '0'), lambda x: len(x)))"


def entropy(s: str) -> str:
    t = f"({total(s, 'abs(x)')} + 1e-9)"
    return f"(-{total(s, f'abs(x) / {t} * ln(abs(x) / {t} + 1e-9)')})"


def energy(c: str, n: int, period: float) -> str:
    part = lambda f: f"pow({over(0, n - 1, f'{c}[i + 1] * {f}(2 * pi() * i / {period})')}, 2)"
    return f"(({part('cos')} + {part('sin')}) / {n})"


def without(columns: dict[str, str], *prefixes: str) -> dict[str, str]:
    return {k: v for k, v in columns.items() if not k.startswith(prefixes)}


def interaction() -> dict[str, str]:
    return without(full(), "room") | {"motiv_x_disc": "motivation * discipline", "d_sign_changes": changes("list_transform(dc, lambda x: sign(x))", 16), "d_longest_high": longest("d", f"x > {quantile('d', 0.5)}"), "d_entropy": entropy("d")}


def temporal() -> dict[str, str]:
    lags = {f"{s}_ac{k}": acf(f"{s}c", N[s], k) for s in "dw" for k in range(1, 7)}
    return without(full(), "room", "d_") | {"motiv_x_disc": "motivation * discipline"} | lags


def spectrum() -> dict[str, str]:
    return {f"d_amp{k}": f"sqrt(p[{k + 1}])" for k in range(1, 6)} | {"d_dominant": "list_position(p[2:9], list_max(p[2:9]))"}


def daily_lags() -> dict[str, str]:
    return {f"d_ac{k}": acf("dc", 16, k) for k in range(1, 7)} | {"d_ac1_minus_ac3": f"{acf('dc', 16, 1)} - {acf('dc', 16, 3)}"} | spectrum()


def lead_minus_lag() -> str:
    bc = "list_transform(b, lambda x: x - list_avg(d))"  # the centred series at the same places
    norm = f"(sqrt({total('wc', 'x * x')} * {total(bc, 'x * x')}) + 1e-9)"
    return f"({over(1, 11, f'wc[i + 1] * ({bc})[i]')} / {norm} - {over(1, 11, f'wc[i] * ({bc})[i + 1]')} / {norm})"


def z(x: str, eps: str = "1e-12") -> str:
    return f"(({x} - avg({x}) OVER ()) / (stddev_pop({x}) OVER () + {eps}))"


def best_period() -> str:
    powers = []
    for i in range(28):
        p = 2 + i / 4
        part = lambda f: f"pow({over(0, 15, f'dc[i + 1] * {f}(2 * pi() * i / {p})')}, 2) / ({over(0, 15, f'pow({f}(2 * pi() * i / {p}), 2)')} + 1e-12)"  # noqa: E731, B023
        powers.append(f"{part('cos')} + {part('sin')}")
    q = f"[{', '.join(powers)}]"
    return f"(2 + (list_position({q}, list_max({q})) - 1) / 4.0)"


def production() -> dict[str, str]:
    return temporal() | {"d_dominant_period": "16.0 / list_position(p[2:9], list_max(p[2:9]))", "d_best_period": best_period(), "w_ar1": f"{over(1, 11, 'wc[i] * wc[i + 1]')} / ({over(1, 11, 'wc[i] * wc[i]')} + 1e-9)", "w_pacf1": acf("wc", 12, 1, "1e-12"), "gated": f"{z('interest', '1e-9')} * {z(lead_minus_lag(), '1e-9')}"}


def production_with_order() -> dict[str, str]:
    return production() | {"order_x_completion": "exam_order * r"}


def pairs(names: list[str], values: list[str]) -> dict[str, str]:
    return {f"{names[i]}*{names[j]}": f"{values[i]} * {values[j]}" for i in range(len(names)) for j in range(i + 1, len(names))}


def baseline() -> dict[str, str]:
    out = {f"{s}{i:02d}": f"{s}[{i}]" for s in "wd" for i in range(1, N[s] + 1)} | {c: c for c in (*LATENT, "done", "given", "room", "exam_order", "tryout")}
    out |= prefixed("w", summary("w", True, True)) | prefixed("d", summary("d", True, True))
    return out | {
        "compl_ratio": "r", "compl_remaining": "given - done", "tryout_x_attendance": "tryout * attendance", "motivation_x_interest": "motivation * interest", "discipline_x_compl": "discipline * r", "literacy_x_tryout": "literacy * tryout",
        "slope_x_tryout": f"{slope('w', 12)} * tryout", "consistency": f"-{std('d', True)}", "room_frequency": "count(*) OVER (PARTITION BY room)", "room_mod_10": "room % 10", "room_mod_100": "room % 100", "compl_gap": "r - median(r) OVER ()",
    }


def augmented() -> dict[str, str]:
    return baseline() | {k: v for k, v in signal().items() if k in ("abs_change_sum", "abs_change_mean", "cum_range", "cum_std", "vol_x_compl", "range_x_compl", "tryout_x_compl", "abschg_x_compl")}


def extended() -> dict[str, str]:
    late, trimmed = mean("w[10:12]"), lambda s: mean(f"list_sort({s})[2:{N[s] - 1}]")
    mad = lambda s: quantile(f"list_transform({s}, lambda x: abs(x - {quantile(s, 0.5)}))", 0.5)
    spikes = f"len(list_filter(d, lambda x: x > {quantile('d', 0.5)} + {iqr('d')}))"
    turns = lambda s: changes(f"list_transform({diffs(s)}, lambda x: sign(x))", N[s] - 1)
    out = baseline() | {
        "tryout_minus_w_mean": f"tryout - {mean('w')}", "late_minus_early": f"{late} - {mean('w[1:3]')}", "late_minus_middle": f"{late} - {mean('w[4:9]')}", "recovery": f"{late} - list_min(w[1:9])", "shortfall": "1 - r",
        "shortfall_x_vol": f"(1 - r) * {std('w', True)}", "tryout_x_shortfall": "tryout * (1 - r)", "spikes": spikes, "spike_ratio": f"{spikes} / 16.0", "w_trimmed": trimmed("w"), "d_trimmed": trimmed("d"), "w_mad": mad("w"), "d_mad": mad("d"),
        "w_turning": turns("w"), "d_turning": turns("d"), "w_longest_up": longest("wd", "x > 0"), "w_longest_down": longest("wd", "x < 0"), "w_vol_ratio": f"{std('w[7:12]', True)} / {std('w[1:6]', True)}",
    }
    ranked = ("compl_ratio", "w_mean", "w_std", "w_iqr", "w_range", "tryout", "attendance", "literacy")
    ranks = {f"rank_{c}": f"(rank() OVER (ORDER BY {out[c]}) + (count(*) OVER (PARTITION BY {out[c]}) - 1) / 2.0) / count(*) OVER ()" for c in ranked}
    return out | ranks | {"rank_composite": f"({' + '.join(ranks.values())}) / 8"}


def curvature(s: str) -> str:
    n, middle = N[s], {"w": "5:8", "d": "7:10"}[s]
    first = {"w": 4, "d": 6}[s]
    return f"{mean(f'{s}[{n - 3}:{n}]')} - 2 * {mean(f'{s}[{middle}]')} + {mean(f'{s}[1:{first}]')}"


def correlation(a: str, b: str, n: int) -> str:
    x, y = f"({a})[i] - list_avg({a})", f"({b})[i] - list_avg({b})"
    return f"coalesce({over(1, n, f'({x}) * ({y})')} / nullif(sqrt({over(1, n, f'pow({x}, 2)')} * {over(1, n, f'pow({y}, 2)')}), 0), 0)"


def symbolic() -> dict[str, str]:
    shape, ws, ds, wv, dv = correlation("w", "b", 12), slope("w", 12), slope("d", 16), std("w"), std("d")
    tail = lambda s: f"{mean(f'{s}[{N[s] - 3}:{N[s]}]')} - {mean(f'{s}[1:4]')}"
    m, k = "motivation", "discipline"
    out = {f"compl_x_{n}": f"r * {v}" for n, v in (("w_vol", wv), ("w_range", reach("w")), ("w_slope", ws), ("d_vol", dv), ("d_slope", ds), ("shape", shape))}
    out |= {f"d_energy{p}": energy("dc", 16, p) for p in (2, 3, 4, 5)} | {f"w_energy{p}": energy("wc", 12, p) for p in (2, 3, 4)}
    out |= {f"tryout_x_{n}": f"tryout * {v}" for n, v in (("w_slope", ws), ("w_vol", wv), ("d_energy3", energy("dc", 16, 3)))}
    return out | {
        "w_late_early": tail("w"), "d_late_early": tail("d"), "w_curvature": curvature("w"), "d_curvature": curvature("d"), "shape": shape, "slope_product": f"{ds} * {ws}", "vol_ratio": f"{dv} / ({wv} + 1e-6)", "md_balance": f"({m} - {k}) / (abs({m}) + abs({k}) + 1e-6)",
        "md_harmonic": f"2 * {m} * {k} / ({m} + {k} + 1e-6)", "md_x_compl": f"{m} * {k} * r", "interest_x_attendance_x_compl": "interest * attendance * r", "literacy_x_tryout": "literacy * tryout", "order_x_tryout": "exam_order * tryout", "order_x_compl": "exam_order * r",
        "room_x_tryout": "room * tryout", "room_x_w_vol": f"room * {wv}",
    }


def generator() -> dict[str, str]:
    out = {}
    for s in "wd":
        out |= prefixed(s, {"mean": mean(s), "std": std(s), "range": reach(s), "slope": slope(s, N[s]), "curvature": curvature(s), "entropy": entropy(s)} | {f"energy{p}": energy(f"{s}c", N[s], p) for p in ((2, 3, 4) if s == "w" else (2, 3, 4, 5))})
    return out | {
        "w_longest_positive": longest("w", "x > 0"), "w_longest_negative": longest("w", "x < 0"), "d_longest_high": longest("d", f"x > {quantile('d', 0.5)}"), "compl_ratio": "r", "compl_remaining": "given - done", "motiv_x_disc": "motivation * discipline",
        "tryout_x_compl": "tryout * r", "attendance_x_compl": "attendance * r", "literacy_x_interest": "literacy * interest", "order_x_compl": "exam_order * r",
    }


def log_ratio() -> dict[str, str]:
    out = {}
    for s in "wd":
        v = summary(s, True, True)
        over_ = lambda a, b: f"({a}) / nullif({b}, 0)"
        out |= {
            f"{s}_cv": over_(v["std"], v["mean"]), f"{s}_log_range": f"ln(1 + {v['range']})", f"{s}_late_early": over_(v["late_mean"], v["early_mean"]), f"{s}_log_slope": f"ln(1 + abs({v['slope']}))", f"{s}_range_mean": over_(v["range"], f"abs({v['mean']})"),
            f"{s}_diff_cv": over_(v["diff_std"], v["diff_abs_mean"]), f"{s}_step_ratio": over_(v["positive_steps"], v["negative_steps"]), f"{s}_q75_q25": over_(v["q75"], v["q25"]), f"{s}_log_mean": f"ln(2 + {v['mean']} - min({v['mean']}) OVER ())",
        }
    return out


CORRECTION = (
    "compl_ratio compl_remaining w_std w_range w_iqr abs_change_mean cum_range cum_std tryout vol_x_compl tryout_x_compl w_slope motivation discipline attendance literacy interest exam_order motiv_x_disc d_ac1 w_ac1 d_best_period w_ar1 gated"
).split()


def segments() -> dict[str, str]:
    out = {}
    for s in "wd":
        h = N[s] // 2
        early, late = f"{s}[1:{h}]", f"{s}[{h + 1}:{2 * h}]"
        centred = lambda a: f"list_transform({a}, lambda x: x - list_avg({a}))"
        for what, f in (("acf1", lambda a: acf(f"({centred(a)})", h, 1)), ("amplitude", reach), ("level", mean)):  # noqa: B023
            out |= {f"{s}_{what}_delta": f"{f(late)} - {f(early)}", f"{s}_{what}_ratio": f"{f(late)} / (abs({f(early)}) + 1e-9)"}
        out[f"{s}_diff2_std"] = std(f"list_transform(range(1, {N[s] - 1}), lambda i: {diffs(s)}[i + 1] - {diffs(s)}[i])")
    return out


def coupling() -> dict[str, str]:
    bd = "list_transform(range(1, 12), lambda i: b[i + 1] - b[i])"
    name = lambda k: f"m{-k}" if k < 0 else str(k)

    def cross(a: str, b: str, n: int, k: int) -> str:
        x, y = (a, b) if k >= 0 else (b, a)
        return correlation(f"({x})[1:{n - abs(k)}]", f"({y})[{abs(k) + 1}:{n}]", n - abs(k))

    out = {f"cross_{name(k)}": cross("w", "b", 12, k) for k in range(-3, 4)} | {f"step_cross_{name(k)}": cross("wd", bd, 11, k) for k in (-1, 0, 1)}
    dl, wl = f"{mean('b[1:4]')} * {mean('w[9:12]')}", f"{mean('w[1:4]')} * {mean('b[9:12]')}"
    return out | {"d_leads": dl, "w_leads": wl, "lead_asymmetry": f"{dl} - {wl}", "slopes_agree": f"CASE WHEN sign({slope('w', 12)}) = sign({slope('b', 12)}) THEN 1 ELSE 0 END"}


def gates() -> dict[str, str]:
    out = {}
    for t, v in (("coupling", lead_minus_lag()), ("slope", slope("w", 12))):
        for c in LATENT[:4]:
            out |= {f"sign_{c}_x_{t}": f"sign({z(c)}) * abs({z(v)})", f"size_{c}_x_{t}": f"abs({z(c)}) * {z(v)}"}
        out[f"{LATENT[0]}_{LATENT[1]}_x_{t}"] = f"{z(LATENT[0])} * {z(LATENT[1])} * {z(v)}"
    return out


def lag_estimators() -> dict[str, str]:
    cross = over(1, 15, "dc[i] * dc[i + 1]")
    found = {"acf": acf("dc", 16, 1), "pairwise": f"({cross} / (sqrt({over(1, 15, 'dc[i] * dc[i]')} * {over(2, 16, 'dc[i] * dc[i]')}) + 1e-9))", "pearson": correlation("d[1:15]", "d[2:16]", 15), "ar": f"({cross} / ({over(1, 15, 'dc[i] * dc[i]')} + 1e-9))"}
    return found | {"z_sum": " + ".join(z(v) for v in found.values()), "weighted": " + ".join(f"{k} * {z(v)}" for k, v in zip((0.4, 0.2, 0.2, 0.2), found.values()))}


def block_ranks() -> dict[str, str]:
    out = {}
    second = lambda s: f"list_transform(range(1, {N[s] - 1}), lambda i: {diffs(s)}[i + 1] - {diffs(s)}[i])"
    third = lambda s: std(second(s))
    mobility = lambda a, b: f"sqrt(pow({b}, 2) / (pow({a}, 2) + 1e-12) + 1e-12)"
    measures = {
        "roughness": lambda s: f"{total(second(s), 'abs(x)')} / {N[s] - 2} / ({std(s)} + 1e-12)",
        "turning": lambda s: changes(f"list_transform({diffs(s)}, lambda x: sign(x))", N[s] - 1),
        "complexity": lambda s: f"{mobility(std(diffs(s)), third(s))} / ({mobility(std(s), std(diffs(s)))} + 1e-12)",
    }
    for n, f in measures.items():
        ranks = []
        for s in "wd":
            v = f"round({f(s)}, 9)"
            ranks.append(f"(rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0) / count(*) OVER ()")
        out[f"{n}_rank_sum"] = " + ".join(ranks)
    return out


def sets() -> dict[str, dict[str, str]]:
    names = {s: [f"{s}{i:02d}" for i in range(1, N[s] + 1)] for s in "wd"}
    behaviour = [*LATENT, "exam_order", "tryout"]
    own = (signal, lean, full, baseline, augmented, extended, interaction, temporal, production, production_with_order, daily_lags, symbolic, generator, log_ratio, segments, coupling, gates, lag_estimators, block_ranks)
    found = {f.__name__: f() for f in own} | {f"pairs_{s}": pairs(names[s], [f"{s}[{i}]" for i in range(1, N[s] + 1)]) for s in "wd"}
    return found | {"pairs_behaviour": pairs(behaviour, behaviour), "correction": {c: v for c, v in production().items() if c in CORRECTION}}


def sql(name: str, digits: int = 6) -> str:
    """Id, target and every feature, rounded; what is null is 0."""
    columns = [f'round(coalesce(CAST({v} AS DOUBLE), 0), {digits}) + 0.0 AS "{k}"' for k, v in sets()[name].items()]
    return f"WITH {FRAME} SELECT id, target, {', '.join(columns)} FROM f"
