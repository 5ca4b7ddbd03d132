import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from foldline.functions.metrics import fold_means, regression_metrics
from foldline.operators.gram import gram, outside_fold, solve_elastic_net, solve_ridge
from foldline.operators.group_means import oof_group_mean
from foldline.operators.groups import cv_scores_by_alpha, fit_global, fit_groups, group_sizes, route_to_group, tune_by_group
from foldline.operators.learners import DEFAULTS, fit_learner
from foldline.operators.moments import Moments, moments, total_moments
from foldline.operators.space import PRESETS, Param, build_preset, params_for, sample_params, sample_space, space_table, stack_from, whole
from foldline.operators.stack import Member, Stack, cross_validate, fit_preprocessed_stack, oof_predict

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.random((200, 3))
    y = x @ [3.0, -2.0, 0.5] + 1 + rng.normal(size=200) * 0.1
    pdf = pd.DataFrame(x, columns=X)
    pdf["y"], pdf["fold"], pdf["key"] = y, np.arange(200) % 5, [str(i) for i in range(200)]
    pdf["g"] = np.where(np.arange(200) < 150, "big", np.where(np.arange(200) < 195, "mid", "few"))
    return pdf, spark.createDataFrame(pdf).persist()


def ridge(pdf, alpha):
    x, y = pdf[X].to_numpy(), pdf["y"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    return y.mean() - x.mean(0) @ w, w


def enet(pdf, alpha, ratio):
    x, y = pdf[X].to_numpy(), pdf["y"].to_numpy()
    xc, yc, n, w = x - x.mean(0), y - y.mean(), len(y), np.zeros(3)
    for _ in range(5000):
        for j in range(3):
            rho = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j])
            w[j] = np.sign(rho) * max(abs(rho) - n * alpha * ratio, 0) / (xc[:, j] @ xc[:, j] + n * alpha * (1 - ratio))
    return y.mean() - x.mean(0) @ w, w


def linear_part(model):
    return model.stages[1]


def test_metric_goldens(spark):
    df = spark.createDataFrame(
        [("m", 1.0, 1.0), ("m", 2.0, 2.0), ("m", 3.0, 5.0), ("c1", 2.0, 2.0), ("c1", 2.0, 2.0), ("c0", 2.0, 2.0), ("c0", 2.0, 3.0), ("one", 1.0, 2.0)],
        "g string, y double, p double",
    )
    got = {r["g"]: r for r in regression_metrics(df, ["g"]).collect()}
    assert np.allclose([got["m"]["MAE"], got["m"]["RMSE"], got["m"]["R2"]], [2 / 3, 1.154701, -1], atol=1e-6)
    assert (got["c1"]["R2"], got["c0"]["R2"], got["one"]["R2"]) == (1, 0, None)


def test_mean_of_folds_is_not_pooled(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0), (0, 0.0, 1.0), (0, 0.0, 1.0), (1, 0.0, 4.0)], "fold int, y double, p double")
    assert fold_means(regression_metrics(df, ["fold"])).first()["MAE"] == 2.5


def test_gram_ridge_closed_form(data):
    pdf, df = data
    row = solve_ridge(gram(df, X, "y"), X, [7.0]).first()
    b0, w = ridge(pdf, 7.0)
    assert np.allclose([row["intercept"], *row["coef"]], [b0, *w], atol=1e-10)
    for r in solve_ridge(outside_fold(gram(df, X, "y", ["fold"]), X, "fold"), X, [0.5], ["fold"]).collect():
        b0, w = ridge(pdf[pdf["fold"] != r["fold"]], 0.5)
        assert np.allclose([r["intercept"], *r["coef"]], [b0, *w], atol=1e-9)


def test_gram_elastic_net(data):
    pdf, df = data
    row = solve_elastic_net(gram(df, X, "y"), X, [(0.05, 0.3)]).first()
    b0, w = enet(pdf, 0.05, 0.3)
    assert np.allclose([row["intercept"], *row["coef"]], [b0, *w], atol=1e-9)


@pytest.mark.parametrize("alpha", [0.01, 7.0])
def test_mllib_ridge_mapping(data, alpha):
    pdf, df = data
    model = linear_part(fit_learner("Ridge", {"alpha": alpha, "solver": "l-bfgs"}, df, X))
    b0, w = ridge(pdf, alpha)
    assert np.allclose([model.intercept, *model.coefficients], [b0, *w], atol=1e-8)


@pytest.mark.parametrize("alpha,ratio", [(0.05, 0.3), (0.01, 0.9)])
def test_mllib_elastic_net_mapping(data, alpha, ratio):
    pdf, df = data
    model = linear_part(fit_learner("ElasticNet", {"alpha": alpha, "l1_ratio": ratio, "solver": "l-bfgs"}, df, X))
    b0, w = enet(pdf, alpha, ratio)
    assert np.allclose([model.intercept, *model.coefficients], [b0, *w], atol=1e-5)


@pytest.mark.parametrize("name, params", [("Ridge", {"alpha": 7.0}), ("ElasticNet", {"alpha": 0.05, "l1_ratio": 0.3})])
def test_exact_linear_learners(data, name, params):
    pdf, df = data
    b0, w = ridge(pdf, 7.0) if name == "Ridge" else enet(pdf, 0.05, 0.3)
    got = fit_learner(name, params, df, X).transform(df).toPandas()
    assert np.allclose(got["prediction"], b0 + got[X].to_numpy() @ np.asarray(w), atol=1e-9)
    with pytest.raises(ValueError):
        fit_learner(name, {"solver": "guess"}, df, X)
    with pytest.raises(ValueError):
        fit_learner(name, params, df.where("false"), X)


def test_ridge_of_500_columns_far_from_zero(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 500)) + 1e6
    y = x[:, :40].sum(1) - 40e6 + rng.normal(size=900)
    names = [f"c{i}" for i in range(500)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(y=y)).repartition(6)
    model = fit_learner("Ridge", {"alpha": 2.0}, df, names)
    model.write().overwrite().save(str(tmp_path / "wide"))
    off = x - x.mean(0)
    w = np.linalg.solve(off.T @ off + 2.0 * np.eye(500), off.T @ (y - y.mean()))
    got = PipelineModel.load(str(tmp_path / "wide")).transform(df).select("c0", "prediction").toPandas().sort_values("c0")["prediction"]
    want = (y.mean() + off @ w)[np.argsort(x[:, 0])]
    assert np.allclose(got, want, atol=1e-5)


def test_moments_by_group(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.normal(50, 1, 400), "b": rng.normal(size=400), "g": rng.choice(["x", "y", None], 400), "h": rng.integers(0, 3, 400)})
    pdf.loc[::17, "b"] = np.nan
    df = spark.createDataFrame(pdf).repartition(7)
    got = {(r.g, r.h): Moments.unpacked(bytes(r.moments), 2) for r in moments(df, ["a", "b"], ["g", "h"]).collect()}
    whole = pdf.dropna(subset=["b"])
    assert len(got) == 9 and sum(m.n for m in got.values()) == len(whole)
    for (g, h), m in got.items():
        part = whole[(whole.g.isna() if g is None else whole.g == g) & (whole.h == h)][["a", "b"]].to_numpy()
        off = part - part.mean(0)
        assert m.n == len(part) and np.allclose(m.mean, part.mean(0)) and np.allclose(m.products, off.T @ off)
    assert total_moments(df.where("false"), ["a"]).n == 0


SMALL = {
    "RandomForestRegressor": {"n_estimators": 5, "max_depth": 5},
    "GradientBoostingRegressor": {"n_estimators": 8},
    "HistGradientBoostingRegressor": {"n_estimators": 8, "max_bins": 64},
    "ExtraTreesRegressor": {"n_estimators": 4, "max_depth": 5},
    "XGBRegressor": {"n_estimators": 8, "max_depth": 3},
    "LGBMRegressor": {"n_estimators": 8, "num_leaves": 7},
    "CatBoostRegressor": {"iterations": 8, "depth": 3, "learning_rate": 0.3},
    "Ridge": {"alpha": 0.1},
    "ElasticNet": {"alpha": 0.01},
    "SVR": {"n_components": 16, "C": 100.0, "gamma": 0.3},
}


@pytest.mark.parametrize("name", sorted(DEFAULTS))
def test_learners_beat_the_mean(data, name):
    _, df = data
    model = fit_learner(name, SMALL[name], df, X, prediction="p")
    out = model.transform(df)
    assert set(out.columns) == {*df.columns, "p"}
    assert regression_metrics(out).first()["R2"] > 0.5


def test_learner_parameters(data):
    _, df = data
    with pytest.raises(KeyError):
        fit_learner("RandomForestRegressor", {"nonsense": 1}, df, X)
    with pytest.raises(KeyError):
        fit_learner("Nobody", {}, df, X)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        fit_learner("HistGradientBoostingRegressor", {"n_estimators": 1, "l2_regularization": 0.1}, df, X)
    assert any("l2_regularization" in str(w.message) for w in seen)


BASES = [Member("tree", "RandomForestRegressor", {"n_estimators": 3, "max_depth": 3}), Member("line", "Ridge", {"alpha": 0.1})]


def test_own_label_does_not_reach_own_prediction(data):
    _, df = data
    changed = df.withColumn("y", F.when(F.col("key") == "17", 1e6).otherwise(F.col("y")))
    for bases in (BASES,):
        a = oof_predict(bases, df, X, "y", "fold", 5).where("key = '17'").first()
        b = oof_predict(bases, changed, X, "y", "fold", 5).where("key = '17'").first()
        assert (a["p_tree"], a["p_line"]) == (b["p_tree"], b["p_line"])
    a = oof_group_mean(df, ["g"], "y", "fold", "m").where("key = '17'").first()["m"]
    b = oof_group_mean(changed, ["g"], "y", "fold", "m").where("key = '17'").first()["m"]
    assert abs(a - b) < 1e-6


def test_group_mean_of_a_group_in_one_fold(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 9.0)], "g string, fold int, y double")
    got = {(r["g"], r["fold"]): r["m"] for r in oof_group_mean(df, ["g"], "y", "fold", "m").collect()}
    assert got == {("a", 0): 3.0, ("a", 1): 1.0, ("b", 0): 3.0}


@pytest.mark.parametrize("passthrough", [False, True])
def test_stack(data, passthrough):
    pdf, df = data
    stack = Stack(BASES, Member("ridge", "Ridge", {"alpha": 0.1}), passthrough, k=3)
    model = fit_preprocessed_stack(df, {c: "num" for c in X}, stack, "key")
    out = model.transform(df).withColumn("p", F.col("prediction"))
    assert regression_metrics(out).first()["R2"] > 0.9
    inputs = stack.meta_inputs(["x"])
    assert inputs == ["p_tree", "p_line"] + (["x"] if passthrough else [])


def test_cross_validate(data):
    pdf, df = data
    per_fold, mean, oof = cross_validate(lambda rows: fit_learner("Ridge", {"alpha": 1.0}, rows, X), df, k=6, threads=3)
    assert oof.count() == 200 and per_fold.count() == 5  # the sixth fold has no rows
    again = {r.fold: r for r in regression_metrics(oof, ["fold"]).collect()}
    assert all(np.isclose(r[m], again[r.fold][m]) for r in per_fold.collect() for m in ("MAE", "RMSE", "R2"))
    want = []
    for k in range(5):
        b0, w = ridge(pdf[pdf["fold"] != k], 1.0)
        part = pdf[pdf["fold"] == k]
        want.append(np.abs(part["y"] - b0 - part[X].to_numpy() @ w).mean())
    got = per_fold.orderBy("fold").toPandas()["MAE"]
    assert np.allclose(got, want) and np.isclose(mean.first()["MAE"], np.mean(want))
    scores = cv_scores_by_alpha(df, X, "y", "fold", [1.0, 5.0]).where("alpha = 1").orderBy("fold").toPandas()["mae"]
    assert np.allclose(scores, want)


def test_groups(data):
    pdf, df = data
    sizes = {r["g"]: (r["n_rows"], r["n_trials"]) for r in group_sizes(df, ["g"]).collect()}
    assert sizes == {"big": (150, 30), "mid": (45, 30), "few": (5, 10)}
    models = fit_groups(df, X, "y", ["g"], 1.0)
    assert {r["g"] for r in models.collect()} == {"big", "mid"}
    routed = route_to_group(df, models, ["g"], X, fit_global(df, X, "y")).toPandas().set_index("key")
    for name, part in pdf.groupby("g"):
        b0, w = ridge(pdf if name == "few" else part, 1.0)
        assert np.allclose(routed.loc[part["key"], "p"], b0 + part[X].to_numpy() @ w)
        assert set(routed.loc[part["key"], "routed"]) == {"global" if name == "few" else "group"}
    tuned = tune_by_group(df, X, "y", ["g"], "fold", [0.01, 100.0]).toPandas()
    assert set(tuned["g"]) == {"big", "mid"} and set(tuned["alpha"]) == {0.01}


def test_space(spark):
    p = whole("n", 50, 500, 20)
    assert p.at(0.999999) == 490 and p.at(0.0) == 50
    assert Param("x", "float", 0.01, 100.0, 0.0, True).at(0.5) == pytest.approx(1.0)
    assert params_for("gbr", {"gbr_max_depth": 3, "rf_max_depth": 4}) == {"max_depth": 3}
    with pytest.raises(KeyError):
        build_preset(7)
    table = sample_space(spark.range(20).selectExpr("id as trial", "1 as preset"), space_table(spark), ["trial"], 5)
    for r in table.collect():
        assert r["draw"] == pytest.approx(sample_params(PRESETS[1].space, r["trial"], 5)[r["param"]], rel=1e-12)
    for n, preset in PRESETS.items():
        stack = stack_from(preset, sample_params(preset.space, 0))
        given = sum(len(m.params) for m in [*stack.bases, stack.meta])
        assert given == len(preset.space), n
