"""What fits read and hold as tables grow, with the results of the plain way."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from foldline.operators import learners
from foldline.operators.learners import fit_learner


def _rows(spark, n=4000, seed=5):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"a": rng.random(n), "b": rng.integers(0, 5, n) / 4.0})
    pdf["y"], pdf["key"] = 100 + 10 * pdf["a"] ** 2 + 3 * pdf["b"] + rng.normal(size=n), [str(i) for i in range(n)]
    return pdf, spark.createDataFrame(pdf).repartition(4).persist()


@pytest.fixture
def fitted_rows(monkeypatch):
    """Rows that MLlib's trees are given."""
    seen = []
    for cls in {type(learners.tree_estimator(n, {})) for n in ("RandomForestRegressor", "XGBRegressor")} | {DecisionTreeRegressor}:
        plain = cls.fit
        monkeypatch.setattr(cls, "fit", lambda self, df, *a, _plain=plain: (seen.append(df.count()), _plain(self, df, *a))[1])
    return seen


@pytest.mark.parametrize("least", [1, 40])
def test_extra_trees_grow_on_cells_as_on_rows(spark, fitted_rows, least):
    _, df = _rows(spark)
    x, cuts, n = ["a", "b"], 6, df.count()
    got = fit_learner("ExtraTreesRegressor", {"n_estimators": 2, "max_depth": 4, "n_cuts": cuts, "min_samples_leaf": least}, df, x, prediction="p")
    assert max(fitted_rows) <= (cuts + 1) ** 2 < n
    splits = [s.getSplitsArray() for s in got.stages if isinstance(s, Bucketizer)]
    out = got.transform(df)
    for t, cut in enumerate(splits):
        rows = Bucketizer(splitsArray=cut, inputCols=x, outputCols=["pa", "pb"], handleInvalid="keep").transform(out)
        rows = VectorAssembler(inputCols=["pa", "pb"], outputCol="v").transform(rows)
        tree = DecisionTreeRegressor(featuresCol="v", labelCol="y", predictionCol=f"t{t}", maxDepth=4, minInstancesPerNode=least, maxBins=cuts + 2)
        out = tree.fit(rows).transform(rows).drop("pa", "pb", "v")
    assert out.where(F.abs(F.col("p") - (F.col("t0") + F.col("t1")) / 2) > 1e-9).count() == 0


def test_extra_trees_refuse_a_missing_label(spark):
    _, df = _rows(spark, 50)
    with pytest.raises(Exception, match="(?i)label|null"):
        fit_learner("ExtraTreesRegressor", {"n_estimators": 1}, df.withColumn("y", F.when(F.col("key") != "7", F.col("y"))), ["a"])


def test_huber_fit_reads_raw_columns_a_few_times(spark, monkeypatch):
    """The expanded rows are never handed to an iterative solver, and the optimum is MLlib's."""
    from pyspark.ml.regression import LinearRegression

    from foldline.operators import huber

    pdf, df = _rows(spark, 2000)
    rng = np.random.default_rng(1)
    noise = df.withColumn("y", F.col("y") + F.when(F.pmod(F.xxhash64("key"), F.lit(9)) == 0, 40.0).otherwise(0.0)).persist()
    w, b = rng.normal(0, 1, (6, 2)), rng.uniform(0, 6, 6)
    scans, plain = [], huber._scan
    monkeypatch.setattr(huber, "_scan", lambda *a: (scans.append(a[0].columns), plain(*a))[1])
    intercept, coef = huber.fit_huber(noise, ["a", "b"], "y", w, b, 1e-3)
    assert 2 < len(scans) < 20 and all(len(c) == 3 for c in scans)
    waves = [F.cos(F.col("a") * float(w[j, 0]) + F.col("b") * float(w[j, 1]) + float(b[j])).alias(f"z{j}") for j in range(6)]
    z = VectorAssembler(inputCols=[f"z{j}" for j in range(6)], outputCol="z").transform(noise.select("y", *waves))
    model = LinearRegression(featuresCol="z", labelCol="y", loss="huber", regParam=1e-3, maxIter=1000, tol=1e-12).fit(z)
    want = np.array([r["prediction"] for r in model.transform(z).select("prediction").collect()])
    x = np.array([[r["a"], r["b"]] for r in noise.select("a", "b").collect()])
    assert np.abs(intercept + np.cos(x @ w.T + b) @ coef - want).max() < 0.02

    monkeypatch.setattr(LinearRegression, "fit", None)
    model = fit_learner("SVR", {"n_components": 4}, noise, ["a", "b"])
    assert model.transform(noise).where("prediction is null").count() == 0
    flat = fit_learner("SVR", {"n_components": 4}, noise.withColumn("y", F.lit(2.5)), ["a", "b"])
    assert flat.transform(noise).agg(F.min("prediction"), F.max("prediction")).first() == (2.5, 2.5)
    with pytest.raises(Exception, match="missing"):
        fit_learner("SVR", {"n_components": 4}, noise.withColumn("a", F.when(F.col("key") != "7", F.col("a"))), ["a", "b"])


def test_late_passes_read_only_rows_inside_brackets(spark, monkeypatch):
    from foldline.operators import quantiles

    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 30_000), "v": rng.normal(size=30_000), "d": rng.integers(0, 9, 30_000) / 2.0})
    df = spark.createDataFrame(pdf).repartition(4).persist()
    exprs = {f"{c}{g}": F.when(F.col("g") == g, F.col(c)) for g in (0, 1) for c in ("v", "d")}
    read, plain = [], quantiles._pass
    monkeypatch.setattr(quantiles, "HANDFUL", 2)  # as brackets hold more values than that in large tables
    monkeypatch.setattr(quantiles, "_pass", lambda rows, *a: (read.append(rows.count()), plain(rows, *a))[1])
    got = quantiles.exact_quantiles(df, exprs, [0.25, 0.5, 0.9])
    for name in exprs:
        want = np.quantile(pdf.loc[pdf["g"] == int(name[1]), name[0]], [0.25, 0.5, 0.9])
        assert np.allclose(got[name], want, rtol=0, atol=1e-12)
    assert read[0] == 30_000 and len(read) > 1 and max(read[1:]) < 3_000


@pytest.mark.parametrize("name, params", [("GradientBoostingRegressor", {"n_estimators": 4, "max_depth": 3}),
                                          ("RandomForestRegressor", {"n_estimators": 2, "max_depth": 4, "bootstrap": False, "min_samples_leaf": 30})])
def test_trees_without_draws_grow_on_cells_as_on_rows(spark, fitted_rows, monkeypatch, name, params):
    _, df = _rows(spark)
    rows = df.withColumn("a", F.floor(F.col("a") * 7) / 7).persist()
    plain = fit_learner(name, params, rows, ["a", "b"], prediction="p")
    monkeypatch.setattr(learners, "SAMPLED_ROWS", 1000)
    cells = fit_learner(name, params, rows, ["a", "b"], prediction="q")
    assert fitted_rows == [4000, 35]
    both = cells.transform(plain.transform(rows))
    assert set(both.columns) == {*rows.columns, "p", "q"} and both.where("abs(p - q) > 1e-9").count() == 0


def test_boosted_trees_bin_a_column_of_many_values(spark, fitted_rows, monkeypatch):
    pdf, df = _rows(spark)
    monkeypatch.setattr(learners, "SAMPLED_ROWS", 3000)
    model = fit_learner("HistGradientBoostingRegressor", {"n_estimators": 12, "max_depth": 3, "max_bins": 16}, df, ["a", "b"], prediction="p")
    assert fitted_rows == [16 * 5]
    out = model.transform(df).select("y", "p").toPandas()
    assert 1 - ((out["y"] - out["p"]) ** 2).sum() / ((out["y"] - out["y"].mean()) ** 2).sum() > 0.8
    fitted_rows.clear()
    fit_learner("XGBRegressor", {"n_estimators": 1, "subsample": 0.5}, df, ["a"])
    fit_learner("RandomForestRegressor", {"n_estimators": 1, "max_depth": 2}, df, ["a"])
    assert fitted_rows == [4000, 4000]  # these draw rows


def test_fits_of_many_rows_do_not_hold_them_side_by_side(spark, monkeypatch):
    from foldline.operators import stack as st

    _, df = _rows(spark, 300)
    threads, plain = [], st.oof_predict
    monkeypatch.setattr(st, "oof_predict", lambda *a: (threads.append(a[-1]), plain(*a))[1])
    fit = lambda: st.Stack([st.Member("a", "Ridge")], st.Member("m", "Ridge"), k=2).fit(df, ["a", "b"], "key")
    fit()
    monkeypatch.setattr(st, "PARALLEL_ROWS", 500)
    fit()
    assert threads == [4, 1]


@pytest.mark.parametrize("kind", ["plain", "nulls", "repeats"])
def test_exact_folds_of_a_staged_table_need_no_join(spark, monkeypatch, kind):
    from foldline.functions.hashing import hash32
    from foldline.operators import splits

    key = {"plain": "cast(id as string)", "nulls": "case when id > 0 then cast(id as string) end", "repeats": "cast(id div 300 as string)"}[kind]
    df = spark.range(1001).selectExpr("id", f"{key} as key", "id % 7 as other").persist()
    joins, plain = [], splits.null_safe_join
    monkeypatch.setattr(splits, "null_safe_join", lambda *a, **k: (joins.append(a), plain(*a, **k))[1])
    monkeypatch.setattr(splits, "EDGE_BITS", 27)  # few buckets, so that changes lie inside of them
    out = splits.with_folds(df, ["key", "other"] if kind == "nulls" else "key", 4, 43, exact=True, staged=True)
    assert out.columns == ["id", "key", "other", "fold"]
    keys = ["key", "other"] if kind == "nulls" else ["key"]
    got = out.withColumn("h", hash32(keys, 43)).toPandas()
    assert got.groupby("fold").size().tolist() == [251, 250, 250, 250] and got["id"].nunique() == 1001
    got["key"] = got["key"].fillna("")
    for f in range(3):  # folds follow the order of hash and key
        a, b = got[got["fold"] == f], got[got["fold"] == f + 1]
        assert max(map(tuple, a[["h", *keys]].values)) <= min(map(tuple, b[["h", *keys]].values))
    assert bool(joins) == (kind == "repeats")


@pytest.mark.parametrize("kind", ["plain", "repeats", "deeper"])
def test_folds_of_groups_are_dealt_at_once_and_few_rows_sorted(spark, monkeypatch, kind):
    from foldline.functions.hashing import hash32
    from foldline.operators import splits
    from foldline.operators.linear_stack import tune_stacks_by_group

    if kind == "deeper":  # boundaries outside their brackets, and stretches that are cut before they are sorted
        monkeypatch.setattr(splits, "MARGIN", 0.2)
    key = "cast(id div 40 as string)" if kind == "repeats" else "cast(id as string)"
    df = spark.range(9000).selectExpr("id", f"{key} as key", "case when id % 3 > 0 then 'a' when id < 600 then 'b' end as g").persist()
    written, plain = [], splits.stage_table
    monkeypatch.setattr(splits, "stage_table", lambda d, name, *a: (written.append(name), plain(d, name, *a))[1])
    out = splits.with_folds_by_group(df, "key", ["g"], {"outer": (5, 43), "inner": (3, 1043)}, **({"limit": 20} if kind == "deeper" else {}))
    assert written == ["dealt"] * 3 and out.columns == ["id", "key", "g", "outer", "inner"]
    got = out.select("*", hash32("key", 43).alias("h0"), hash32("key", 1043).alias("h1")).toPandas()
    got["g"] = got["g"].fillna("-")
    assert len(got) == got["id"].nunique() == 9000
    for _, part in got.groupby("g"):
        for name, h, k in (("outer", "h0", 5), ("inner", "h1", 3)):
            part = part.sort_values([h, "key", name])
            want = np.repeat(range(k), [len(a) for a in np.array_split(np.arange(len(part)), k)])
            assert part[name].tolist() == want.tolist()
    assert splits.with_folds(df, "key", 5, 43, ["g"], exact=True).where("g = 'b'").count() == 200
    assert "with_folds_by_group" in tune_stacks_by_group.__code__.co_names


@pytest.mark.parametrize("large", [False, True])
def test_forests_with_bootstrap_grow_on_drawn_cells(spark, fitted_rows, monkeypatch, tmp_path, large):
    from pyspark.ml import PipelineModel

    pdf, df = _rows(spark)
    rows = df.withColumn("a", F.when(F.col("a") < 0.5, 0.0).otherwise(F.floor(F.col("a") * 20) / 20)).persist()
    monkeypatch.setattr(learners, "BAGGED_ROWS", 1000)
    monkeypatch.setattr(learners, "DRAWN_TREES", 4)
    if large:  # cells of more rows than a task draws for
        monkeypatch.setattr(learners, "DRAWN_ROWS", 150)
    drawn, plain = [], learners._drawn_cells
    monkeypatch.setattr(learners, "_drawn_cells", lambda *a: (drawn.append(plain(*a)), drawn[-1])[1])
    fit = lambda d, seed=42: fit_learner("RandomForestRegressor", {"n_estimators": 6, "max_depth": 5}, d, ["a", "b"], seed=seed)
    model = fit(rows)
    cells = rows.select("a", "b").distinct().count()
    assert len(fitted_rows) == 6 and max(fitted_rows) < (800 if large else 2 * cells)
    ends = rows.groupBy("a", "b").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.avg("y").alias("all"))
    for part, trees in zip(drawn, (4, 2)):
        got = part.join(ends, ["a", "b"]).toPandas()
        for t in range(trees):
            n, mean = got[f"__n{t}"], got[f"__mean{t}"]
            assert 3700 < n.sum() < 4300  # four thousand draws, give or take sixty-three
            some = n > 0
            assert ((mean >= got["lo"] - 1e-9) & (mean <= got["hi"] + 1e-9))[some].all()
            whole = got.assign(n=n, s=n * mean).groupby(["a", "b"]).agg({"n": "sum", "s": "sum", "all": "first"})
            off = (whole["s"] / whole["n"] - whole["all"]).abs().max()
            assert 1e-6 < off < 1.5  # drawn rows, not whole cells
        assert (got["__n0"] != got["__n1"]).any()
    out = model.transform(rows)
    assert set(out.columns) == {*rows.columns, "prediction"}
    scored = out.select("y", "prediction").toPandas()
    assert 1 - ((scored["y"] - scored["prediction"]) ** 2).sum() / ((scored["y"] - scored["y"].mean()) ** 2).sum() > 0.7
    single = rows.select("a", "b").distinct()
    by_row = lambda m: [r["prediction"] for r in m.transform(single).orderBy("a", "b").select("prediction").collect()]
    model.save(f"{tmp_path}/m")
    assert by_row(PipelineModel.load(f"{tmp_path}/m")) == by_row(model) == by_row(fit(rows.repartition(7)))
    assert by_row(fit(rows, 7)) != by_row(model)


def test_forests_with_bootstrap_keep_rows_where_cells_are_many_or_labels_missing(spark, fitted_rows, monkeypatch):
    _, df = _rows(spark)
    monkeypatch.setattr(learners, "BAGGED_ROWS", 1000)
    monkeypatch.setattr(learners, "SAMPLED_ROWS", 4000)
    fit_learner("RandomForestRegressor", {"n_estimators": 2, "max_depth": 2}, df, ["a", "b"])  # 255 bins by 5 values
    assert fitted_rows == [4000]
    with pytest.raises(Exception, match="(?i)label|null"):
        fit_learner("RandomForestRegressor", {"n_estimators": 2}, df.withColumn("y", F.when(F.col("key") != "7", F.col("y"))), ["b"])


@pytest.mark.parametrize("kind", ["plain", "repeats"])
def test_folds_of_groups_sort_hashes_and_keys_only_where_these_decide(spark, monkeypatch, kind):
    from foldline.operators import linear_stack, splits

    key = "cast(id div 40 as string)" if kind == "repeats" else "case when id <> 5 then cast(id as string) end"
    df = spark.range(6000).selectExpr("id", f"{key} as key", "case when id % 3 > 0 then 'a' when id < 600 then 'b' end as g", "id / 6000 as x", "id % 11 as y").persist()
    found, plain = [], splits.sized
    monkeypatch.setattr(splits, "sized", lambda d: (found.append(d), plain(d))[1])
    out = splits.with_folds_by_group(df, "key", ["g"], {"outer": (5, 43), "inner": (3, 1043)}, staged=True)
    rows = [d.schema["__row"].dataType.names for d in found if "__row" in d.columns]
    more = ["__k0", "__id"] if kind == "repeats" else []
    assert rows[-1] == ["__h1", *more] and ["__h0"] in rows and len(rows) == (4 if more else 2)
    sizes = out.groupBy("g", "outer").count().groupBy("g").agg(F.min("count").alias("lo"), F.max("count").alias("hi"), F.count("*").alias("k")).collect()
    assert len(sizes) == 3 and all(r["k"] == 5 and r["hi"] - r["lo"] <= 1 for r in sizes)
    assert splits.with_folds_by_group(df.where("false"), "key", ["g"], {"outer": (5, 43)}).count() == 0
    counted = df.groupBy("g").agg(F.count("*").alias("__total"))
    again = splits.with_folds_by_group(df, "key", ["g"], {"outer": (5, 43)}, staged=True, sizes=counted)
    if kind == "plain":
        assert again.exceptAll(out.drop("inner")).count() == 0

    dealt, deal = [], linear_stack.with_folds_by_group
    monkeypatch.setattr(linear_stack, "with_folds_by_group", lambda *a, **k: (dealt.append(a[2]), deal(*a, **k))[1])
    best = linear_stack.tune_stacks_by_group(df, ["x"], "y", "key", ["g"], [linear_stack.LinearStack([([0], 1.0)], 1.0)])
    assert dealt == [["__group"]] and sorted((r["g"] or "", r["n_rows"]) for r in best.collect()) == [("", 1800), ("a", 4000), ("b", 200)]


def test_rows_meet_their_groups_by_plain_columns(spark, monkeypatch):
    """Folds of groups come from one number a fold, groups that are numbered meet by plain equality, also where folds are fewer or rows are."""
    from foldline.functions.hashing import HASH_RANGE, hash32, hash_below
    from foldline.operators import splits
    from foldline.registry import search_queries

    df = spark.range(4000).selectExpr("cast(id as string) as key", "case when id < 3 then 1L when id < 10 then 2L when id < 700 then 3L else 4L end as g").persist()
    found, plain, joins, safe = [], splits.sized, [], splits.null_safe_join
    monkeypatch.setattr(splits, "sized", lambda d: (found.append(d), plain(d))[1])
    monkeypatch.setattr(splits, "null_safe_join", lambda *a, **k: (joins.append(a), safe(*a, **k))[1])
    deals = {"outer": (5, 43), "one": (1, 7), "inner": (3, 1043)}
    got = splits.with_folds_by_group(df, "key", ["g"], deals, staged=True, known=True).select("*", *[hash32("key", s).alias(f"h_{n}") for n, (_, s) in deals.items()]).toPandas()
    assert not joins and {t for c, t in found[-1].dtypes if c != "g"} == {"bigint"}
    assert len(got) == 4000
    for _, part in got.groupby("g"):
        for name, (k, _) in deals.items():
            want = np.repeat(range(k), [len(a) for a in np.array_split(np.arange(len(part)), k)])
            assert part.sort_values([f"h_{name}", "key"])[name].tolist() == want.tolist()

    for limit in (-1, 0, 1, 858993459, HASH_RANGE - 1, HASH_RANGE):
        assert df.where(hash_below("key", 42, limit) != (hash32("key", 42) < limit)).isEmpty()
    written, stage = [], search_queries.stage_table
    monkeypatch.setattr(search_queries, "stage_table", lambda d, *a: (written.append((d.columns, a[1:])), stage(d, *a))[1])
    search_queries.grouped_rows(spark, "/root/testdata/sf0.001")
    assert [("dataset" in c, "fold" in c, a) for c, a in written] == [(True, False, ())]


@pytest.mark.parametrize("passthrough", [False, True])
def test_linear_stacks_of_staged_rows_write_none(spark, monkeypatch, passthrough):
    from foldline.operators import stack as st

    _, df = _rows(spark, 900)
    df = df.withColumn("y", F.when(F.col("key") != "7", F.col("y"))).persist()
    bases = [st.Member("r", "Ridge", {"alpha": 2.0}), st.Member("e", "ElasticNet", {"alpha": 0.05, "l1_ratio": 0.3})]
    fit = lambda d=df, **k: st.Stack(bases, st.Member("m", "Ridge", {"alpha": 3.0}), passthrough, k=4).fit(d, ["a", "b"], "key", **k)
    plain = fit().transform(df).toPandas().sort_values("key")
    monkeypatch.setattr(st, "stage_table", None)
    sums = fit(staged=True).transform(df).toPandas().sort_values("key")
    for c in ("p_r", "p_e", "prediction"):
        assert np.allclose(plain[c], sums[c], rtol=0, atol=1e-8) and sums[c].nunique() > 100
    with pytest.raises(ValueError, match="no rows"):
        fit(df.limit(1), staged=True)


def test_training_keeps_one_copy_of_its_rows(spark, tmp_path, monkeypatch):
    """Searches by group and over all rows, and fits, leave no other table of all rows behind, nor write many."""
    from pathlib import Path

    from foldline import session
    from foldline.operators.space import Preset, real
    from foldline.plans.training import SearchSettings, train
    from foldline.session import shared_dir
    from foldline.sources.trial_store import TrialStore

    _, df = _rows(spark, 2000)
    rows = df.withColumn("g", F.col("b") > 0.5).withColumn("z", F.col("y") + F.col("b"))
    preset = Preset(101, [("r", "Ridge"), ("s", "Ridge")], ("m", "Ridge"), False, [real("r_alpha", 0.1, 9.0)])
    here, before = Path(shared_dir(spark).removeprefix("file:")), set()
    before = set(here.iterdir())
    written, plain = [], session.drop_staged
    for module in ("foldline.operators.splits", "foldline.operators.linear_stack"):
        monkeypatch.setattr(f"{module}.drop_staged", lambda d: (written.append(d.count()), plain(d))[1])
    made = train(rows, ["a", "b"], ["y", "z"], "key", preset, TrialStore(spark, str(tmp_path)), grouped=["y"], group_keys=["g"], settings=SearchSettings(n_trials=1, inner=3, sampler="random"))
    assert made.report.count() == 4
    left = [(p.name.rsplit("-", 1)[0], spark.read.parquet(str(p)).count()) for p in set(here.iterdir()) - before if any(p.rglob("*.parquet"))]
    assert [(n, size) for n, size in left if size > 100 and n != "side"] == [("train", 2000)]  # sides: counts of buckets, as many as there are rows here
    assert len(written) == 2 and max(written) < 2000  # the training rows with hashes, and with folds


def _members():
    from foldline.operators.stack import Member

    return [Member("g", "GradientBoostingRegressor", {"n_estimators": 3, "max_depth": 3}),
            Member("h", "RandomForestRegressor", {"n_estimators": 2, "max_depth": 4, "bootstrap": False, "min_samples_leaf": 30}),
            Member("r", "RandomForestRegressor", {"n_estimators": 5, "max_depth": 4})]


@pytest.mark.parametrize("large", [False, True])
def test_trees_of_all_folds_grow_on_one_table_of_cells(spark, fitted_rows, monkeypatch, tmp_path, large):
    from pyspark.ml import PipelineModel
    from foldline.operators import fold_trees as ft

    pdf, df = _rows(spark)
    x, bases = ["a", "b", "one"], _members()
    rows = df.selectExpr("floor(a * 7) / 7 as a", "b", "1.0d as one", "y", "key", "pmod(xxhash64(key), 3) as f").persist()
    monkeypatch.setattr(ft, "TREES_AT_ONCE", 3)
    if large:  # cells of more rows than a task draws for, and passes of few trees
        monkeypatch.setattr(learners, "DRAWN_ROWS", 100)
        monkeypatch.setattr(ft, "HELD_BYTES", 1000)
    made, plain = [], ft.stage_table
    monkeypatch.setattr(ft, "stage_table", lambda *a: (made.append(a[1]), plain(*a))[1])
    models = ft.fit_by_fold(bases, rows, x, "y", "f", 3)
    assert made == ["cells"] * 2 and not fitted_rows and len(models) == 4  # the second for trees four and five
    single = rows.select(*x).distinct()
    by_row = lambda m, *c: [tuple(r) for r in m.transform(single).orderBy(*x).select(*c).collect()]
    for f, model in enumerate(models):
        train = rows.where(F.col("f") != f)
        out = model.transform(rows)
        for b in bases[:2]:
            out = fit_learner(b.learner, b.params, train, x, prediction=f"q_{b.alias}").transform(out)
        assert out.where("abs(p_g - q_g) > 1e-9 or abs(p_h - q_h) > 1e-9").isEmpty()
        scored = out.select("y", "p_r", "p_h").toPandas()
        assert 1 - ((scored["y"] - scored["p_r"]) ** 2).mean() / scored["y"].var() > 0.8
        assert 1e-3 < (scored["p_r"] - scored["p_h"]).abs().max() < 2  # drawn rows, and leaves of fewer
    names = [b.column for b in bases]
    models[0].save(f"{tmp_path}/m")
    assert by_row(PipelineModel.load(f"{tmp_path}/m"), *names) == by_row(models[0], *names)
    # Labels of a fold do not reach the models that predict it.
    other = rows.withColumn("y", F.when(F.col("f") == 0, -F.col("y")).otherwise(F.col("y")))
    again = ft.fit_by_fold(bases[:2], other, x, "y", "f", 3)
    assert np.allclose(by_row(again[0], *names[:2]), by_row(models[0], *names[:2]), rtol=0, atol=1e-9)
    assert not np.allclose(by_row(again[1], *names[:2]), by_row(models[1], *names[:2]), rtol=0, atol=1)


def test_stacks_of_many_staged_rows_fit_their_trees_at_once(spark, fitted_rows, monkeypatch):
    from foldline.operators import fold_trees as ft, stack as st

    _, df = _rows(spark)
    rows = df.withColumn("a", F.floor(F.col("a") * 7) / 7).persist()
    fit = lambda d, **k: st.Stack(_members(), st.Member("m", "Ridge"), True, k=3).fit(d, ["a", "b"], "key", **k).transform(d).select("y", "prediction").toPandas()
    monkeypatch.setattr(st, "BAGGED_ROWS", 1000)
    plain = fit(rows)
    assert len(fitted_rows) == 12
    fitted_rows.clear()
    made = fit(rows, staged=True)
    assert not fitted_rows
    assert abs((made["y"] - made["prediction"]).abs().mean() - (plain["y"] - plain["prediction"]).abs().mean()) < 0.02

    def whole(d, x=("a", "b"), bases=_members()):
        return ft.fit_by_fold(bases, d.withColumn("f", F.pmod(F.xxhash64("key"), F.lit(2))), list(x), "y", "f", 2)

    assert whole(df) is None  # 255 bins by five values are more than a quarter of the rows
    assert whole(rows.withColumn("y", F.when(F.col("key") != "7", F.col("y")))) is None
    assert whole(rows.withColumn("b", F.when(F.col("key") != "7", F.col("b")))) is None
    assert whole(rows, bases=[st.Member("r", "RandomForestRegressor", {"n_estimators": 1})]) is None  # as deep as rows allow
    assert whole(rows, bases=[st.Member("r", "Ridge")]) is None


def test_pieces_of_columns_of_many_values_are_those_of_some_rows(spark):
    from foldline.operators import fold_trees as ft

    pdf, df = _rows(spark)
    some = pdf[["a", "b"]].to_numpy()
    wide, few = ft._edges(df, ["a", "b"], 16, [4000, 5], some)
    assert len(wide) == 15 and np.ptp(np.bincount(np.searchsorted(wide, some[:, 0], "right"))) <= 2
    assert few.tolist() == [0.125, 0.375, 0.625, 0.875]
    assert ft._edges(df.where("false"), ["b"], 16, [0], some[:, 1:])[0].tolist() == []
