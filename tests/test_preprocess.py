import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from foldline.operators.learners import fit_learner
from foldline.operators.preprocess import Preprocessor, most_frequent, transform_by_fold
from foldline.operators.roles import categorical_columns, column_roles, features_by_target, numeric_columns, usable_targets


@pytest.fixture(scope="module")
def small(spark):
    """Forty rows in four groups, one NULL and one NaN per numeric column, one constant."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(40):
        rows.append((21.0 + 3 * (i % 4), 300.0, 500.0 + i, *[float(v) for v in rng.random(4) * 10], "rect" if i % 3 else "tee", i % 5))
    rows[3] = (*rows[3][:3], None, None, None, None, None, 3)
    rows[9] = (*rows[9][:3], *[float("nan")] * 4, "rect", 4)
    schema = "f_idx double, width double, height double, Sm double, bd double, rho double, phi_mn double, shape string, fold int"
    return spark.createDataFrame(rows, schema)


def test_roles(small):
    roles = column_roles(small, ["Sm", "rho", "phi_mn", "shape"])
    assert roles == {"Sm": "num", "rho": "exp", "phi_mn": "log", "shape": "cat"}
    assert categorical_columns(small) == ["shape"] and "rho" in numeric_columns(small)


def test_feature_map():
    got = features_by_target(["a", "b", "c"], ["a", "b"], {"a": ["c"]})
    assert got == {"a": ["b"], "b": ["a", "c"]}


def test_usable_targets(spark):
    df = spark.createDataFrame([(1.0, 1, None), (1.0, 2, 3.0), (float("nan"), 3, None)], "a double, b int, c double")
    assert usable_targets(df, ["a", "b", "c"]) == ["b"]
    assert usable_targets(df, ["a", "b", "c"], 1) == ["a", "b", "c"]


def test_minmax_goldens(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    model = Preprocessor({"x": "num", "c": "num"}).fit(df)
    got = model.transform(df).orderBy("x").toPandas()
    assert got["x__num"].tolist() == [0, 0.5, 1] and got["c__num"].tolist() == [0, 0, 0]
    beyond = spark.createDataFrame([(5.0, 6.0)], "x double, c double")
    assert model.transform(beyond).first()["x__num"] == 2.0


def test_unknown_category_gives_zeros(spark):
    df = spark.createDataFrame([("a",), ("b",), ("it's",)], "s string")
    model = Preprocessor({"s": "cat"}).fit(df)
    got = model.transform(spark.createDataFrame([("z",), ("a",), ("it's",), (None,)], "s string")).toPandas()
    assert got.iloc[:, 1:].to_numpy().tolist() == [[0, 0, 0], [1, 0, 0], [0, 0, 1], [1, 0, 0]]


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(v,) for v in "babac"], "s string")
    assert most_frequent(df, ["s"]).first()["value"] == "a"
    assert Preprocessor({"s": "cat"}).fit(df).stats["s"].fill == "a"


def test_ten_thousand_categories_fit_and_score(spark, tmp_path):
    """Values a_i with a mean of their own: a linear model on the sparse column finds them, saved and loaded too."""
    df = spark.range(30_000).select(
        F.concat(F.lit("a_"), (F.col("id") % 10_000).cast("string")).alias("s"), (F.col("id") % 7).cast("double").alias("x"),
        ((F.col("id") % 10_000) % 50 + F.col("id") % 7).cast("double").alias("y"),
    )
    pre = Preprocessor({"s": "cat", "x": "num"}).fit(df)
    assert pre.columns == ["x__num", "s__onehot"] and pre.stats["s"].size == 10_000
    fitted = fit_learner("Ridge", {"alpha": 0.01}, pre.transform(df), pre.columns)
    PipelineModel([*pre.stages()[:-1], *fitted.stages]).write().overwrite().save(str(tmp_path / "m"))
    got = PipelineModel.load(str(tmp_path / "m")).transform(df.limit(2000)).toPandas()
    assert np.abs(got["prediction"] - got["y"]).max() < 0.5


def test_wide_columns_are_the_dense_ones_in_one_vector(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"s": rng.choice(["a", "b", "it's", "d", "e", None], 300), "t": rng.choice(["u", "v"], 300), "fold": np.arange(300) % 3})
    df = spark.createDataFrame(pdf)
    new = spark.createDataFrame([("z", "u", 0), (None, "v", 1), ("it's", None, 2), ("", "", 0)], df.schema)
    roles = {"s": "cat", "t": "cat"}
    for fit in (lambda p: p.fit(df), lambda p: p.fit_by_fold(df, "fold", 3)[1]):
        dense, wide = fit(Preprocessor(roles)), fit(Preprocessor(roles, dense_categories=2))
        assert wide.columns == ["t__is0", "t__is1", "s__onehot"] and wide.stats["s"].fill == dense.stats["s"].fill
        order = sorted(dense.stats["s"].categories, key=lambda v: (hashlib.md5(v.encode()).hexdigest(), v))
        for table in (df, new):
            a, b = dense.transform(table).collect(), wide.transform(table).collect()
            key = lambda r: tuple(map(repr, (r.s, r.t, r.fold)))
            for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
                assert [y.s__onehot[i] for i in range(5)] == [x[f"s__is{dense.stats['s'].categories.index(v)}"] for v in order]
    none = Preprocessor({"s": "cat"}, dense_categories=0).fit(df.where("false"))
    assert none.columns == []


def test_branch_order_and_values(small):
    roles = column_roles(small, ["shape", "rho", "phi_mn", "Sm", "width"])
    model = Preprocessor(roles).fit(small)
    assert model.columns == ["Sm__num", "width__num", "phi_mn__log", "rho__exp", "shape__is0", "shape__is1"]
    pdf = small.toPandas()
    out = model.transform(small).toPandas()
    for col, f in (("Sm", lambda v: v), ("phi_mn", np.log1p), ("rho", np.exp)):
        x = f(pdf[col].fillna(pdf[col].median()))
        assert np.allclose(out[f"{col}__{roles[col]}"], (x - x.min()) / (x.max() - x.min()))


@pytest.mark.parametrize("scaler", ["standard", "robust"])
def test_other_scalers(small, scaler):
    out = Preprocessor({"bd": "num"}, scaler).fit(small).transform(small).toPandas()["bd__num"]
    x = small.toPandas()["bd"]
    x = x.fillna(x.median())
    if scaler == "standard":
        want = (x - x.mean()) / x.std(ddof=0)
    else:
        want = (x - x.median()) / (x.quantile(0.75) - x.quantile(0.25))
    assert np.allclose(out, want)


def test_passthrough_and_sql_stage(small, tmp_path):
    pre = Preprocessor({"Sm": "num", "shape": "cat"}, remainder="passthrough").fit(small, others=["height"])
    assert pre.columns[-1] == "height__raw"
    pipe = PipelineModel(pre.stages())
    pipe.write().overwrite().save(str(tmp_path / "pre"))
    got = PipelineModel.load(str(tmp_path / "pre")).transform(small).toPandas()
    assert np.allclose(np.stack(got["features"].map(lambda v: v.toArray())), pre.transform(small).toPandas()[pre.columns])


def test_statistics_come_from_the_other_folds(small):
    roles = {"Sm": "num", "rho": "exp", "shape": "cat"}
    by_fold = Preprocessor(roles).fit_by_fold(small, "fold", 5)
    for k, model in by_fold.items():
        alone = Preprocessor(roles).fit(small.where(F.col("fold") != k))
        assert model.stats == alone.stats
    moved = small.withColumn("Sm", F.when(F.col("fold") == 2, F.col("Sm") * 1000).otherwise(F.col("Sm")))
    assert Preprocessor(roles).fit_by_fold(moved, "fold", 5)[2].stats == by_fold[2].stats
    assert transform_by_fold(small, by_fold, "fold").count() == 40


def test_all_missing_column_is_left_out(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert Preprocessor({"a": "num", "b": "num"}).fit(df).columns == ["a__num"]
