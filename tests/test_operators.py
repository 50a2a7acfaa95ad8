"""Operators on small frames, degenerate ones included."""

import json

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tessera import catalog
from tessera.operators import aggregates as G, audits as U, cleaning as K, models as M, ranks, relations as J, statistics as T, thresholds as H, vectors
from tessera.plans import features as P
from tessera.sources import files, series


def one(df):
    return df.first().asDict()


def test_ratio_modes(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 4.0), (None, 1.0)], "a double, b double")
    got = {m: [r[0] for r in df.select(K.ratio(F.col("a"), F.col("b"), m)).collect()] for m in ("null", "zero", "floor1", "eps")}
    assert got["null"] == [None, 0.5, None] and got["zero"] == [0.0, 0.5, 0.0] and got["floor1"] == [1.0, 0.5, None]
    assert got["eps"][0] == pytest.approx(1e9)


def test_scrub_and_impute(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, float("inf")), (4, None), (5, 3.0)], "id int, x double")
    assert [r["x"] for r in K.scrub(df, ["x"]).orderBy("id").collect()] == [1.0, 0.0, 0.0, 0.0, 3.0]
    assert [r["x"] for r in K.impute_median(df, ["x"]).orderBy("id").collect()] == [1.0, 2.0, 2.0, 2.0, 3.0]
    assert [r["x"] for r in K.impute_median(df, ["x"], {"x": 9.0}).orderBy("id").collect()][1] == 9.0


def test_projections(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a_y int, b int, a_x int")
    assert K.with_prefix(df, "a_").columns == ["a_x", "a_y"] and K.without_prefix(df, "a_").columns == ["b"]
    assert K.namespaced(df, "n__", ["b"]).columns == ["n__a_y", "b", "n__a_x"] and K.without(df, "b").columns == ["a_y", "a_x"]
    assert len(K.products(["a_y", "b", "a_x"])) == 3 and len(K.products(["a_y", "b", "a_x"], 3)) == 1 and len(K.pair_terms("b", "a_x")) == 7
    assert one(df.select(*[c.alias(n) for n, c in K.diagonal_terms("b", "a_x").items()]))["abs_sum"] == 5


def test_ranks_and_percentiles(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([3.0, 1.0, 2.0, 4.0])] + [(9, None)], "id int, x double")
    rows = {r["id"]: r for r in ranks.with_ranks(df, "x", "id").collect()}
    assert [rows[i]["r_mid"] for i in range(4)] == [0.625, 0.125, 0.375, 0.875] and rows[9]["r_first"] is None
    tied = spark.createDataFrame([(i, 1.0) for i in range(5)], "id int, x double")
    got = ranks.with_ranks(tied, "x", "id").collect()
    assert sorted(r["r_first"] for r in got) == [1, 2, 3, 4, 5] and {r["r_avg"] for r in got} == {3.0}
    assert ranks.with_ranks(tied.limit(0), "x", "id").count() == 0


@pytest.mark.parametrize("n, bins, labels", [(8, [2, 2, 2, 2], [2, 2, 2, 2]), (10, [2, 3, 3, 2], [3, 2, 3, 2])])
def test_quartile_formulas(spark, n, bins, labels):
    r = spark.range(1, n + 1).withColumn("n", F.lit(n))
    count = lambda f: [r["count"] for r in r0.groupBy(f(F.col("id"), F.col("n")).alias("q")).count().orderBy("q").collect()]
    r0 = r
    assert count(ranks.quartile_bin) == bins and count(ranks.quartile_label) == labels


def test_zscore(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "x double")
    assert {r["x_z"] for r in ranks.zscore(df, ["x"], guarded=True).collect()} == {0.0}
    assert one(ranks.zscore(df, ["x"], fitted={"x": (4.0, 2.0)}))["x_z"] == pytest.approx(0.5)


def test_thresholds(spark):
    scores = spark.createDataFrame([(i, x) for i, x in enumerate([-10.0, 0.0, 1.0, 2.0, 99.0])], "id int, x double").orderBy("id")
    cut = lambda right: [r[0] for r in scores.select(H.apply_thresholds(F.col("x"), [0.0, 1.0, 2.0], right)).collect()]
    assert cut(True) == [0, 0, 1, 2, 3] and cut(False) == [0, 1, 2, 3, 3]
    with pytest.raises(ValueError):
        H.apply_thresholds(F.col("x"), [1.0, 0.0])
    forty = spark.range(40).select("id", F.col("id").cast("double").alias("x"), F.floor(F.col("id") / 10).cast("int").alias("y"))
    cuts = H.quartile_thresholds(forty, "x")
    assert len(cuts) == 3 and {r["count"] for r in forty.groupBy(H.apply_thresholds(F.col("x"), cuts)).count().collect()} == {10}
    grid = H.offset_grid([-8, 0, 8])
    assert len(grid) == 27 and grid[0] == (0, 0, 0)
    table = H.offset_accuracy(forty, "x", "y", "id", grid)
    assert H.learn_offsets(table) == (0, 0, 0) and table.where("o1 = 0 and o2 = 0 and o3 = 0").first()["accuracy"] == 1.0
    ok = spark.createDataFrame([([200, 184, 216, 200],), ([201, 184, 152, 263],)], "c array<int>")
    assert [r[0] for r in ok.select(H.passes_balance(F.col("c"), 200, 16)).collect()] == [True, False]


def test_residuals_and_corrections(spark):
    df = spark.createDataFrame([(0.05, -1.0), (0.5, 0.2), (0.95, 1.0)], "p double, c double")
    assert [round(r[0], 9) for r in df.select(H.shift_labels(F.col("p"), F.col("c"), 0.5)).collect()] == [0.0, 0.6, 1.0]
    y = spark.createDataFrame([(0, 0.1), (1, 0.4), (2, 0.6), (3, 0.9)], "y int, p double")
    assert [round(r[0], 9) for r in y.select(ranks.midpoint(F.col("y")) - F.col("p")).collect()] == [0.025, -0.025, 0.025, -0.025]
    assert one(y.where("y = 0").select(ranks.boundary_distance(F.lit(0.5)).alias("d")))["d"] == 0


def test_best_config(spark):
    df = spark.createDataFrame([("hgb", 0.2, 0.6, 0.01), ("ridge", 0.1, 0.6, 0.01), ("ridge", 0.4, 0.5, 0.0)], "method string, alpha double, mean double, std double")
    assert one(H.best_config(df, "mean", "std", "alpha", "method", ["ridge", "hgb"]))["alpha"] == 0.1


def test_promotion(spark):
    rows = [("base", s, 0.6) for s in range(5)] + [("new", s, 0.6 + (0.01 if s < 3 else -0.001)) for s in range(5)]
    got = one(H.promoted(spark.createDataFrame(rows, "c string, s int, a double"), "c", "s", "a", "base"))
    assert got["promoted"] and got["improved"] == 3


def test_counts_and_purity(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (1, 3), (1, 3)], "c int, y int")
    assert one(G.purity(df, "c", "y")) == {"purity": 0.8, "n_clusters": 2}
    assert {(r["c"], r["y"]): r["n"] for r in G.crosstab(df, "c", "y", range(4)).collect()}[(0, 2)] == 1
    assert G.crosstab(df, "c", "y", range(4)).count() == 16
    tie = spark.createDataFrame([(0, 2), (0, 1)], "c int, y int")
    assert one(G.group_mode(tie, "c", "y"))["majority"] == 1


def test_decimals_and_grid(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.5, 2.0), (2.25, 3.0)], "a double, b double")
    got = {r["feature"]: r for r in G.grid_profile(df, ["a", "b"]).collect()}
    assert got["a"]["max_decimals"] == 2 and got["b"]["max_decimals"] == 0 and got["b"]["is_integer"] and got["a"]["min_step"] == 0.5


def test_target_encoding(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "k string, y int")
    table, prior = G.target_encoding(df, "k", "y", [0, 1])
    assert {r["k"]: r["te_1"] for r in table.collect()}["b"] == pytest.approx((1 + 10 * 2 / 3) / 11)
    unseen = G.encode(spark.createDataFrame([("z",)], "k string"), "k", table, prior)
    assert one(unseen)["te_0"] == pytest.approx(1 / 3)


def test_overlap_and_duplicates(spark):
    train = spark.createDataFrame([(1, 10, 0.5, 0), (2, 20, 0.7, 1)], "id int, a int, b double, y int")
    test = spark.createDataFrame([(99, 20, 0.7), (100, 30, 0.9)], "id int, a int, b double")
    assert one(J.overlap(train, test, ["a", "b"])) == {"overlap_train": 1, "overlap_test": 1, "duplicates_train": 0, "duplicates_test": 0}
    nulls = spark.createDataFrame([(None,), (None,)], "a int")
    assert one(J.overlap(nulls, nulls, ["a"]))["duplicates_train"] == 2
    assert one(J.overlap(nulls.limit(0), nulls.limit(0), ["a"]))["overlap_train"] == 0


def test_zip_guard(spark):
    a, b = spark.range(3), spark.range(4)
    with pytest.raises(ValueError):
        J.zip_by_id(a, b, "id")
    assert J.zip_by_id(a, a.withColumn("x", F.lit(1)), "id").count() == 3
    assert J.is_subset(a, b) and not J.is_subset(b, a) and not J.are_disjoint(a, b)


def test_nearest_in_blocks(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(size=3)]) for i in range(60)]
    train, test = spark.createDataFrame(rows[:40], "id int, v array<double>"), spark.createDataFrame(rows[40:], "id int, v array<double>")
    got = {x["id"]: (x["nn_id"], x["dist"]) for x in J.nearest(train, test, "id", "v", block=7).collect()}
    for i, v in rows[40:]:
        far = [np.linalg.norm(np.array(v) - np.array(u)) for _, u in rows[:40]]
        assert got[i][0] == int(np.argmin(far)) and got[i][1] == pytest.approx(min(far))


def test_nearest_plan_is_one_whatever_the_blocks(spark):
    rows = spark.range(60).select("id", F.array(F.sin("id"), F.cos("id")).alias("v"))
    lines = [len(J.nearest(rows, rows, "id", "v", block=b)._jdf.queryExecution().executedPlan().toString().splitlines()) for b in (3, 100)]
    assert lines[0] == lines[1]


def searched(test, train, block):
    """Best rows of ``vectors.searcher`` for (id, vector) rows that are packed in the order given."""
    batch = lambda rows: iter([pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([v for _, v in rows], pa.list_(pa.float32()))], ["id", "v"])])
    side = lambda p, x: [pa.RecordBatch.from_arrays(y.columns, [f"{p}_{c}" for c in y.schema.names]) for y in x]
    b, a = side("b", vectors.packer(block, "<f4", True)(batch(train))), side("a", vectors.packer(len(test), "<f4", False)(batch(test)))[0]
    both = (pa.RecordBatch.from_arrays([*a.columns, pa.array([0]), *x.columns], [*a.schema.names, "a_k", *x.schema.names]) for x in b)
    return pa.Table.from_batches(vectors.searcher("<f4")(both)).to_pandas().sort_values(["id", "dist", "nn"]).drop_duplicates("id")


@pytest.mark.parametrize("far_off", [0, 1000])
def test_nearest_measures_few_pairs(monkeypatch, far_off):
    pairs, measure = [], vectors._Best._measure
    monkeypatch.setattr(vectors._Best, "_measure", lambda self, right, d, i, j: pairs.append(len(i)) or measure(self, right, d, i, j))
    v = np.random.default_rng(2).normal(size=(3000, 64)).astype("<f4")
    v[2000:] += far_off  # differences are small beside the vectors
    v[1000:1500] = v[1500:2000]
    rows = list(enumerate(v))
    got = searched(rows[2400:], rows[:2400], 700)
    far = np.linalg.norm(v[2400:, None].astype(float) - v[None, :2400], axis=2)
    assert list(got.nn) == list(far.argmin(axis=1)) and np.allclose(got.dist, far.min(axis=1)) and sum(pairs) < 600 * 2400 / 50


def test_nearest_tie_that_a_row_of_its_block_beats():
    got = searched([(0, [1.0] * 4)], [(1, [2.0] * 4), (2, [9.0] * 4), (3, [2.0] * 4), (4, [1.5])], 2)
    assert (list(got.nn), list(got.dist)) == ([4], [0.5])


@pytest.mark.parametrize("block", [3, 2048])
def test_nearest_of_odd_rows_equals_sql(spark, tmp_path, block):
    r, nan, inf = np.random.default_rng(3), float("nan"), float("inf")
    whole = [[float(np.float32(x)) for x in r.normal(size=64)] for _ in range(12)]
    odd = [None, [], [None] * 64, [None] * 9 + whole[0][9:], whole[1][:5], [nan] * 64, [inf] + whole[2][1:], [-inf] + whole[2][1:], [3e38] * 64, [1e-30] * 64, [0.0] * 64, [-0.0] * 64]
    cells = whole + odd + whole + odd  # tests and others of equal vectors
    ids = [i if i < 24 else 4 - i for i in range(48)]
    for name, rows in (("odd", [*zip(ids, cells), (5, whole[3]), (1, whole[4]), (None, whole[5])]), ("null", [(0, whole[0]), (5, None), (1, None), (2, None)]), ("unmet", [(0, whole[0]), (5, whole[1])])):
        (tmp_path / name).mkdir()
        pq.write_table(pa.table({"vec_id": pa.array([x for x, _ in rows], pa.int64()), "embedding": pa.array([x for _, x in rows], pa.list_(pa.float32()))}), tmp_path / name / "embeddings.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/{name}/embeddings.parquet'")
        df, test = spark.read.parquet(f"{tmp_path}/{name}/embeddings.parquet"), F.pmod("vec_id", F.lit(5)) == 0
        got = J.nearest(df.where(~test), df.where(test), "vec_id", "embedding", block).select("vec_id", "nn_id", F.round("dist", 9))
        want = con.execute(catalog.ORACLES["nearest_neighbor"]).fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_mixup(spark):
    rows = [(i, i % 4, float(i), float(i % 3), i % 5, 5) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, y int, x double, c double, done int, given int")
    out = J.mixup(df, "id", "y", ["x"], ["c"], ("done", "given"), factor=0.5, seed=1)
    new = out.where("id < 0").collect()
    assert len(new) == 20 and out.count() == 60 and len({r["id"] for r in new}) == 20
    assert all(r["done"] <= r["given"] and 0 <= r["x"] <= 39 for r in new) and {r["y"] for r in new} <= set(range(4))
    assert J.mixup(df, "id", "y", ["x"], factor=0).count() == 40


def test_partial_correlation(spark):
    rows = [(i, i % 4, float(i), 10.0 * i + 5) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, y int, base double, f double")
    assert abs(T.screen(df, "id", ["f"], "y", "base").first()["partial"]) < 1e-9
    flat = df.withColumn("f", F.lit(1.0))
    assert T.screen(flat, "id", ["f"], "y", "base").first()["spearman"] == 0.0
    r = np.random.default_rng(1)
    data = spark.createDataFrame([(i, *map(float, r.normal(size=4))) for i in range(80)], "id int, x double, y double, c double, d double")
    got = T.partial_of_two(T.unpivot(data, ["y", "c", "d"], ["x"]), "y", ("c", "d")).first()["partial"]
    m = np.array(data.select("x", "y", "c", "d").collect())
    k = m.argsort(0).argsort(0).astype(float)
    z = np.c_[np.ones(80), k[:, 2:]]
    res = k[:, :2] - z @ np.linalg.lstsq(z, k[:, :2], rcond=None)[0]
    assert got == pytest.approx(np.corrcoef(res.T)[0, 1])


def test_shift(spark):
    same = spark.createDataFrame([(float(x), t) for x in (1, 2, 3) for t in (True, False)], "x double, t boolean")
    row = T.shift_table(same, ["x"], F.col("t")).first()
    assert row["smd"] == 0 and row["psi"] == 0 and row["risk"] == "low"
    r = np.random.default_rng(2)
    far = spark.createDataFrame([(float(x), False, 1.0) for x in r.normal(size=200)] + [(float(x), True, 1.0) for x in r.normal(2, 1, 200)], "x double, t boolean, flat double")
    rows = {x["feature"]: x for x in T.shift_table(far, ["x", "flat"], F.col("t")).collect()}
    assert rows["x"]["risk"] == "high" and rows["x"]["smd"] > 1 and rows["flat"]["psi"] == 0
    train = np.array([x[0] for x in far.where("not t").select("x").collect()])
    test = np.array([x[0] for x in far.where("t").select("x").collect()])
    e = np.unique(np.quantile(train, np.linspace(0, 1, 11)))[1:-1]
    p, q = (np.maximum(np.bincount(np.searchsorted(e, v, "left"), minlength=10) / len(v), 1e-6) for v in (train, test))
    assert rows["x"]["psi"] == pytest.approx(((q - p) * np.log(q / p)).sum())


def test_votes(spark):
    df = spark.createDataFrame([([0.6, 0.4], [0.1, 0.9], 1), ([0.9, 0.1], [0.4, 0.6], 0)], "a array<double>, b array<double>, y int").coalesce(1)
    got = df.withColumns({"e": M.soft_vote([F.col("a"), F.col("b")]), "w": M.soft_vote([F.col("a"), F.col("b")], [1, 3])})
    assert [r[0] for r in got.select(M.argmax(F.col("e"))).collect()] == [1, 0] and M.better_vote(got, "e", "w", "y") == "e"
    assert one(got.select(M.expected_value(F.col("a")).alias("v")))["v"] == pytest.approx(0.4)
    assert one(got.select(M.one_hot(F.col("y"), 3).alias("h")))["h"] == [0.0, 1.0, 0.0]


def test_folds_and_models(spark):
    df = spark.range(80).select(F.col("id").cast("int").alias("id"), (F.col("id") % 4).cast("int").alias("y"), (F.col("id") % 4 + F.rand(1) / 2).alias("x"), F.rand(2).alias("z")).cache()
    folds = M.stratified_folds(df, "id", "y", 5)
    assert {r["count"] for r in folds.groupBy("fold", "y").count().collect()} == {4}
    scores = M.ordinal_score(folds.where("fold > 0"), folds.where("fold = 0"), ["x", "z"], "y", "id", make=lambda s: M.classifier("forest", s, 5, 3))
    ranked = scores.join(df, "id").withColumn("seed", F.lit(1))
    assert M.quartile_accuracy(ranked, "id", "score", "y").first()["accuracy"] > 0.7
    r2, coefs = M.linear_r2(df.withColumn("t", 2 * F.col("x") - F.col("z")), ["x", "z"], "t")
    assert r2 == pytest.approx(1) and coefs == pytest.approx([2, -1])
    got = M.permutation_importance(df.withColumn("t", F.col("x")), "id", ["x", "z"], lambda f: f.withColumn("score", F.col("x")), "t", 2)
    imp = {r["feature"]: r["importance"] for r in got.collect()}
    assert imp["x"] > 0.5 and abs(imp["z"]) < 1e-9
    sweep = {r["w"]: r["accuracy"] for r in M.rank_blend_sweep(df, "id", "x", "z", "y", [0.0, 1.0]).collect()}
    assert sweep[0.0] > 0.9 > sweep[1.0]


def test_searches():
    score = lambda p, seeds: -abs(p["a"] - 3) + 0 * len(seeds)
    best = M.random_search({"a": range(6)}, score, 40, [1, 2], [3])
    assert best["params"]["a"] == 3 and best["held_out"] == 0
    assert M.grid_search([{"a": 1}, {"a": 3}], lambda c: score(c, []))[0][0] == {"a": 3}
    assert M.ablation(["a"], ["b"], len) == {"b": 1}


def test_transfer_and_average(spark):
    rows = [(i, s, float(i), float(-i), i // 5) for i in range(20) for s in (1, 2)]
    df = spark.createDataFrame(rows, "id int, seed int, base double, extra double, y int")
    got = T.transfer(df, "id", "seed", "base", "extra", "y", [0.0, 2.0]).collect()
    assert {(r["alpha"], r["accuracy"]) for r in got} == {(0.0, 1.0)}
    avg = {r["id"]: r["avg_rank"] for r in ranks.rank_average(df, "id", "seed", "base").collect()}
    assert avg[0] == 1.0 and avg[19] == 20.0


@pytest.mark.parametrize("name, columns", [("signal", 17), ("lean", 29), ("full", 54), ("baseline", 95), ("augmented", 103), ("extended", 122), ("interaction", 56), ("temporal", 51), ("production", 56), ("production_with_order", 57), ("pairs_w", 66), ("pairs_behaviour", 45), ("pairs_d", 120), ("symbolic", 32), ("generator", 29)])
def test_feature_sets(spark, sf_dir, name, columns):
    df = series.student_frame(spark, sf_dir).limit(20)
    got = P.build_set(name, df)
    assert len(got.columns) == columns + 2 and got.count() == 20
    assert not [r for r in got.limit(5).collect() for v in r if v is None or v != v]


def test_fit_and_transform(spark, sf_dir):
    df = series.student_frame(spark, sf_dir)
    train, test = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    fitted = K.medians(P.baseline(train), [c for c in P.baseline(train).columns if c not in P.KEEP])
    got = P.baseline(test, fitted)
    row = got.select("compl_gap", "compl_ratio").first()
    assert row["compl_gap"] == pytest.approx(row["compl_ratio"] - fitted["compl_ratio"])


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,target\n11,3\n22,1\n")
    ids = spark.createDataFrame([(11,), (22,)], "id long")
    got = files.read_predictions(spark, str(tmp_path / "p.csv"), ids)
    assert sorted(map(tuple, got.collect())) == [(11, 3), (22, 1)]
    with pytest.raises(ValueError):
        files.check_predictions(got, ids.limit(1))
    with pytest.raises(ValueError):
        files.check_predictions(got.withColumn("target", F.lit(7)), ids)
    with pytest.raises(ValueError):
        files.check_predictions(got.select("target", "id"), ids)
    files.write_predictions(got, str(tmp_path / "out"), ids)
    assert files.read_csv(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "pages.json").write_text(json.dumps([{"name": "a", "text": "x"}, {"name": "b"}]))
    assert sorted(r["text"] for r in files.read_pages(spark, str(tmp_path / "pages.json")).collect()) == ["", "x"]
    assert files.read_config(str(tmp_path / "none.json"), {"a": 1}) == {"a": 1}
    (tmp_path / "queue.json").write_text(json.dumps({"experiments": [{"id": "e1", "priority": "high"}, {"id": "e2", "priority": "low"}]}))
    queue = files.read_queue(spark, str(tmp_path / "queue.json"))
    assert files.queue_entry(queue, "e2").count() == 1 and files.read_queue(spark, str(tmp_path / "queue.json"), priority="high").count() == 1
    calls = []

    def compute(seeds):
        calls.append(tuple(seeds))
        return spark.createDataFrame([(s, 1, 0.5) for s in seeds], "seed int, id int, score double")

    path = str(tmp_path / "scores")
    for seeds in ([1, 2], [1, 2], [1, 3]):
        files.cached_scores(spark, path, seeds, compute)
    assert calls == [(1, 2), (1, 3)]
    files.write_report(str(tmp_path / "r.md"), "T", {"A": got, "B": "text"})
    assert "| id | target |" in (tmp_path / "r.md").read_text()
    assert sum(r["n"] for r in files.histogram(got, "target", 3).collect()) == 2
    assert "No obvious row overlap" in files.interpret(0.48, 0.27, 0)[0]


def test_audits(spark):
    r = np.random.default_rng(3)
    rows = [(i, i % 4, float(i % 4 + r.normal() / 9), *map(float, r.normal(size=2))) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, y int, x double, z double, base double").cache()
    assert U.linear_probe(df, "id", ["x", "z"], "y", "base", 4) > 0.8
    best = U.combined_score(df, "id", ["x", "z"], "y", "base", 1)
    assert best.agg(F.corr("combined", "x")).first()[0] == pytest.approx(1)
    assert U.planted_products(df.withColumn("one", F.lit(1.0)), ["x", "z", "one"], "y", 1).first()["feature"] == "x*one"
    got = U.pattern_search(df, "id", "y", [3, 4], lambda d, f: d.agg(F.abs(F.corr("mod", "y"))).first()[0]).first()
    assert got["modulus"] == 4 and got["score"] == pytest.approx(1)
    flags = spark.createDataFrame([("a", 0.05, 0.01), ("b", 0.2, 0.01), ("c", 0.0, 0.0)], "f string, smd double, gain double")
    assert [x["f"] for x in U.stable(flags).collect()] == ["a"]
    seeds = df.withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("res", F.col("x"))
    audit = U.residual_audit(seeds, "id", "seed", ["x", "z"], "res", F.col("id") % 8 < 4).where("feature = 'x'").first()
    assert audit["signed"] == pytest.approx(1) and audit["sign_agreement"] == 1 and audit["risk"] == "low"
    assert U.seed_vote(seeds, "id", "seed", "x").agg(F.max("spread")).first()[0] == 0


def test_ranks_within_groups_of_any_size(spark):
    r = np.random.default_rng(3)
    rows = [(i, None if i % 7 == 0 else "ab"[i % 5 == 0], float(r.integers(0, 4)) if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, x double")
    got = {x["id"]: x for x in ranks.with_ranks(df, "x", "id", ["g"]).collect()}
    for g in (None, "a", "b"):
        own = pd.DataFrame([t for t in rows if t[1] == g and t[2] is not None], columns=["id", "g", "x"])
        own["avg"], own["first"] = own.x.rank(), own.sort_values(["x", "id"]).x.rank(method="first")
        for t in own.itertuples():
            assert (got[t.id]["r_avg"], got[t.id]["r_first"], got[t.id]["n_ranked"]) == (t.avg, t.first, len(own))
    assert all(got[i]["r_avg"] is None for i, _, x in rows if x is None) and len(got) == 300
    whole = pd.Series({t[0]: t[2] for t in rows}).rank()
    assert {x["id"]: x["r_avg"] for x in ranks.with_ranks(df, "x", "id").where("x is not null").collect()} == whole.dropna().to_dict()
    plan = ranks.with_ranks(df, "x", "id", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "__p" in plan


def test_exact_quantiles(spark):
    r = np.random.default_rng(4)
    values = {"a": r.normal(size=501), "b": r.integers(0, 5, 40).astype(float), "c": np.array([2.5]), "d": np.full(30, 7.0)}
    long = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("e", None)], "feature string, x double")
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {x["feature"]: x for x in ranks.exact_quantiles(long, ps).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        assert got[k]["q"] == pytest.approx(np.quantile(v, ps).tolist()) and got[k]["n"] == len(v) and got[k]["n_distinct"] == len(set(v))
    one = T.quantiles(long.where("feature = 'a'"), "x", [0.5, 0.75]).collect()
    assert [x["value"] for x in one] == pytest.approx(np.quantile(values["a"], [0.5, 0.75]).tolist())


def test_mixup_ids_are_new(spark):
    df = spark.createDataFrame([(i - 5, i % 60, float(i)) for i in range(600)], "id int, y int, x double")
    ids = [x["id"] for x in J.mixup(df, "id", "y", ["x"], factor=0.5, seed=2).collect()]
    assert len(ids) == 900 and len(set(ids)) == 900


def test_rank_then_z_and_family_blend(spark):
    rows = [(i, f, s, float((i * 7 + len(f)) % 10) + s) for i in range(20) for f in ("x", "yy") for s in (0, 1)]
    df = spark.createDataFrame(rows, "id int, family string, seed int, score double")
    one = pd.DataFrame([t for t in rows if t[1] == "x" and t[2] == 0], columns=["id", "family", "seed", "score"])
    want = (one.score.rank() - one.score.rank().mean()) / one.score.rank().std(ddof=0)
    got = ranks.rank_then_z(df.where("family = 'x' and seed = 0"), "score", "id").orderBy("id").toPandas()
    assert got.rank_z.tolist() == pytest.approx(want.tolist())
    means = pd.DataFrame(rows, columns=["id", "family", "seed", "score"]).groupby(["family", "id"]).score.mean()
    z = means.groupby(level=0).transform(lambda v: (v.rank() - v.rank().mean()) / v.rank().std(ddof=0))
    blend = M.family_rank_blend(df, "id", "family", "seed", "score").orderBy("id").toPandas()
    assert blend.blend.tolist() == pytest.approx(z.groupby(level=1).mean().tolist())


def test_several_classes_from_boosted_trees(spark):
    r = np.random.default_rng(5)
    rows = [(i, i % 4, float(i % 4) + 0.1 * float(r.normal()), float(r.normal())) for i in range(160)]
    df = spark.createDataFrame(rows, "id int, y int, a double, b double")
    got = M.one_against_rest(df.where("id < 120"), df.where("id >= 120"), ["a", "b"], "y", "id", make=lambda seed: M.classifier("gbt", seed, 3, 2))
    out = got.join(df, "id").collect()
    assert len(out) == 40 and all(abs(sum(x["score"]) - 1) < 1e-9 and len(x["score"]) == 4 for x in out)
    assert np.mean([int(np.argmax(x["score"])) == x["y"] for x in out]) > 0.9
    grid = M.correction_grid(df.withColumn("pct", F.col("id") / 160), "id", ["a", "b"], "pct", "y", alphas=(1.0, 20.0), kinds=("ridge",), folds=2)
    assert {x["config"]: x["count"] for x in grid.groupBy("config").count().collect()} == {"ridge-1": 160, "ridge-20": 160}


def test_partials(spark):
    r = np.random.default_rng(6)
    data = r.normal(size=(90, 5))
    df = spark.createDataFrame([tuple(map(float, x)) for x in data], "x double, y double, c double, d double, e double")
    long = T.unpivot(df, ["y", "c", "d", "e"], ["x"])
    k = data.argsort(0).argsort(0).astype(float)
    z = np.c_[np.ones(90), k[:, 2:]]
    res = k[:, :2] - z @ np.linalg.lstsq(z, k[:, :2], rcond=None)[0]
    assert T.partial_of_many(long, "y", ["c", "d", "e"]).first()["partial"] == pytest.approx(np.corrcoef(res.T)[0, 1])
    z = np.c_[np.ones(90), data[:, 2]]
    res = data[:, :2] - z @ np.linalg.lstsq(z, data[:, :2], rcond=None)[0]
    assert T.partial_of_fits(long, "y", "c").first()["partial"] == pytest.approx(np.corrcoef(res.T)[0, 1])


def test_small_operators(spark):
    df = spark.createDataFrame([(1, 1.0, -4.0, 0), (2, 3.0, 9.0, 1), (3, 3.0, 9.0, 1)], "id int, a double, b double, y int")
    got = df.select(*[v.alias(k) for k, v in K.unary_terms("b").items()]).collect()
    assert [tuple(x) for x in got] == [(16.0, 4.0, -2.0), (81.0, 9.0, 3.0), (81.0, 9.0, 3.0)]
    assert [x[0] for x in df.select(K.log_shifted(df, "a")).collect()] == pytest.approx([np.log(2.0), np.log(4.0), np.log(4.0)])
    m = {(x["a"], x["b"]): x["r"] for x in T.correlation_matrix(df, ["a", "b"]).collect()}
    assert m["a", "b"] == pytest.approx(np.corrcoef([1, 3, 3], [-4, 9, 9])[0, 1]) and m["a", "a"] == pytest.approx(1)
    assert G.duplicate_rows(df, ["a", "b"]).first()["duplicates"] == 2 and G.duplicate_rows(df, ["id"]).first()["duplicates"] == 0
    s = {x["y"]: x for x in G.score_summary(df, ["y"], "b").collect()}
    assert (s[1]["mean"], s[1]["std"], s[1]["min"]) == (9.0, 0.0, 9.0)
    shifted = spark.createDataFrame([(i, float(i), float(i + 50 * (i % 2)), float(i % 3), i % 2 == 1) for i in range(60)], "id int, p double, q double, r double, t boolean")
    table = T.shift_table(shifted, ["p", "q", "r"], F.col("t")).collect()
    assert [x["feature"] for x in table] == [x["feature"] for x in sorted(table, key=lambda x: (-x["psi"], -abs(x["smd"]), x["feature"]))] and table[0]["feature"] == "q"
