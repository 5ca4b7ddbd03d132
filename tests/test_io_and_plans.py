import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from foldline.operators.learners import fit_learner
from foldline.operators.preprocess import Preprocessor
from foldline.operators.search import Study, random_proposals, run_trials
from foldline.operators.space import Preset, build_preset, real, whole
from foldline.plans.single_model import search_single_models
from foldline.plans.training import SearchSettings, train
from foldline.session import shared_dir, stage_table
from foldline.sources.bundle import Bundle, TargetMeta, load_bundle, save_bundle, score_batch
from foldline.sources.params import load_params, save_params
from foldline.sources.tables import read_checked_csv, read_table, write_scores
from foldline.sources.trial_store import TrialStore
from foldline.streaming.scoring import score_stream, write_available


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    out = []
    for i in range(240):
        w, h = [(200.0, 400.0), (300.0, 500.0), (250.0, 450.0)][i % 3]
        x, z = rng.random(2)
        out.append((f"k{i}", w, h, float(x), float(z), float(3 * x + z + w / 100 + rng.normal() * 0.05)))
    return spark.createDataFrame(out, "key string, width double, height double, rho double, Sm double, bd double").persist()


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes("﻿a,b\n1.5,x\nNaN,y\n,z\n".encode())
    df = read_table(spark, str(path))
    assert df.columns == ["a", "b"] and df.where(F.col("a").isNull()).count() == 2
    typed = read_table(spark, str(path), "a double, b string")
    assert typed.dtypes == [("a", "double"), ("b", "string")]
    with pytest.raises(AnalysisException):
        read_table(spark, str(tmp_path / "absent.csv"), "a int").count()


@pytest.mark.parametrize("bom", [False, True])
def test_write_scores(spark, tmp_path, bom):
    df = spark.createDataFrame([(0.5, 1.0, 2.0, "test", "t")], "R2 double, MAE double, RMSE double, dataset string, target string")
    write_scores(df, str(tmp_path / "s"), bom=bom)
    parts = [p.read_bytes().decode("utf-8") for p in (tmp_path / "s").glob("part-*.csv")]
    text = max(parts, key=len)
    assert text.startswith("﻿" if bom else "target") and "target,dataset,MAE,RMSE,R2\nt,test,1.0,2.0,0.5" in text


def test_params(spark, tmp_path):
    df = spark.createDataFrame([("a", {"x": 1.0}), ("b", {"x": 2.5})], "target string, params map<string,double>")
    save_params(df, str(tmp_path / "p"))
    assert {r["target"]: r["params"] for r in load_params(spark, str(tmp_path / "p"), ["a"]).collect()} == {"a": {"x": 1.0}}
    with pytest.raises(ValueError, match="c"):
        load_params(spark, str(tmp_path / "p"), ["a", "c"])
    with pytest.raises(AnalysisException):
        load_params(spark, str(tmp_path / "none"), ["a"])


def test_stage_table_keeps_rows_and_columns(spark, rows):
    staged = stage_table(rows.withColumn("dataset", F.lit("train")), "t", ["dataset"])
    assert staged.columns[-1] == "dataset" and staged.count() == rows.count()
    assert spark.conf.get("spark.checkpoint.dir").rstrip("/") == shared_dir(spark)


def bundle_of(spark, rows, path):
    models, meta = {}, {}
    for target, roles in {"bd": {"rho": "exp", "Sm": "num"}, "Sm": {"rho": "num"}}.items():
        pre = Preprocessor(roles).fit(rows)
        fitted = fit_learner("Ridge", {"alpha": 1.0}, pre.transform(rows), pre.columns, target)
        models[target] = PipelineModel([pre.stages()[0], *fitted.stages])
        meta[target] = TargetMeta(list(roles), {c: "double" for c in roles}, {"ridge_alpha": 1.0})
    save_bundle(Bundle(models, meta), spark, path)
    return load_bundle(spark, path)


def test_bundle_batch_and_stream(spark, rows, tmp_path):
    bundle = bundle_of(spark, rows, str(tmp_path / "b"))
    assert bundle.targets == ["bd", "Sm"] and bundle.meta["bd"].params == {"ridge_alpha": 1.0}
    texts = rows.select("key", F.col("rho").cast("string").alias("rho"), "Sm")
    batch = score_batch(bundle, texts)
    assert batch.columns == ["key", "rho", "Sm", "pred_bd", "pred_Sm"] and dict(batch.dtypes)["rho"] == "string"
    with pytest.raises(ValueError, match="rho"):
        score_batch(bundle, rows.select("key", "Sm"))
    texts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        write_available(score_stream(bundle, stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(batch.collect())
    with pytest.raises(ValueError):
        score_stream(bundle, texts)


TINY = [whole("rf_n_estimators", 2, 3), whole("rf_max_depth", 2, 3), whole("gbr_n_estimators", 2, 3), real("ridge_alpha", 0.01, 10.0, True)]


def test_train_by_group_and_resume(spark, rows, tmp_path):
    store = TrialStore(spark, str(tmp_path))
    s = SearchSettings(n_trials=1, folds=2, inner=2, space=TINY)
    keys = ["width", "height"]
    args = (["width", "height", "rho", "Sm", "bd"], ["bd"], "key", build_preset(1))
    got = train(rows.where("width < 300"), *args, store=store, grouped=["bd"], group_keys=keys, settings=s)
    names = {r["study"] for r in store.trials().select("study").distinct().collect()}
    assert names == {"bd_group_200.0_400.0", "bd_group_250.0_450.0"} and store.trials().count() == 2
    report = {r["dataset"]: r for r in got.report.collect()}
    assert report["train"]["R2"] > 0.3 and got.bundle.meta["bd"].features == ["width", "height", "rho", "Sm"]
    again = train(rows.where("width < 300"), *args, store=store, grouped=["bd"], group_keys=keys, settings=s)
    assert store.trials().count() == 2 and again.params == got.params
    state = {g.group: g.state for g in got.groups["bd"]}
    assert set(state.values()) == {"searched"}


def test_corrupt_csv_rows_are_kept_apart(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,2.5,x\n2,oops,y\n3,NaN,z\n4,1.5\n5,1.0,q,more\n\n6,,w\n")
    good, bad, counts = read_checked_csv(spark, str(tmp_path / "t.csv"), "a int, b double, c string")
    assert sorted((r.a, r.b, r.c) for r in good.collect()) == [(1, 2.5, "x"), (3, None, "z"), (6, None, "w")]
    assert sorted(r.record for r in bad.collect()) == ["2,oops,y", "4,1.5", "5,1.0,q,more"] and counts == {"n_rows": 6, "n_corrupt": 3}
    inferred, none, counts = read_checked_csv(spark, str(tmp_path / "t.csv"), sample=1.0)
    assert dict(inferred.dtypes) == {"a": "int", "b": "string", "c": "string"} and counts["n_corrupt"] == none.count() == 2
    with pytest.raises(ValueError):
        read_checked_csv(spark, str(tmp_path / "t.csv"), "a int, _corrupt_record string")


LINEAR = Preset(9, [("a", "Ridge"), ("b", "Ridge")], ("m", "Ridge"), False, [real("m_alpha", 0.01, 10.0, True)])


def test_small_groups_are_searched_or_reported(spark, tmp_path):
    """Groups of 7, 10 and 25 rows have no empty fold at the default five by five; smaller ones are named."""
    data = [(100 * g + i, float(g), float(i), float((7 * i) % 5), float(2 * i + g)) for g, n in enumerate((7, 10, 25, 6)) for i in range(n)]
    df = spark.createDataFrame(data, "key long, g double, a double, b double, y0 double")
    store = TrialStore(spark, str(tmp_path))
    s = SearchSettings(n_trials=1, test=0.0, group_job=False)
    got = train(df, ["a", "b", "y0"], ["y0"], "key", LINEAR, store=store, grouped=["y0"], group_keys=["g"], settings=s)
    assert [(g.rows, g.state) for g in got.groups["y0"]] == [(7, "searched"), (10, "searched"), (25, "searched"), (6, "too_small")]
    assert all(g.params == got.params["y0"] for g in got.groups["y0"] if g.state == "too_small")
    assert store.steps().count() == 15


def test_linear_groups_are_searched_in_one_job(spark, tmp_path):
    data = [(100 * g + i, float(g), float(i), float((7 * i) % 5), float(2 * i + g)) for g, n in enumerate((7, 10, 25, 6)) for i in range(n)]
    df = spark.createDataFrame(data, "key long, g double, a double, b double, y0 double")
    store = TrialStore(spark, str(tmp_path))
    got = train(df, ["a", "b", "y0"], ["y0"], "key", LINEAR, store=store, grouped=["y0"], group_keys=["g"], settings=SearchSettings(n_trials=3, test=0.0))
    table = {r["g"]: r for r in got.group_tables["y0"].collect()}
    assert {g: r["n_rows"] for g, r in table.items()} == {0.0: 7, 1.0: 10, 2.0: 25}  # six rows are too few
    best = min(table.values(), key=lambda r: (r["mae"], r["g"]))
    saved = {r["study"]: r for r in store.trials().collect()}
    assert set(saved) == {"y0_group_0.0", "y0_group_1.0", "y0_group_2.0"} and saved[f"y0_group_{best['g']}"]["params"] == got.params["y0"]
    assert got.report.count() == 1 and not got.groups
    few = train(df.where("g = 3"), ["a", "b", "y0"], ["y0"], "key", LINEAR, store=store, grouped=["y0"], group_keys=["g"], settings=SearchSettings(n_trials=1, test=0.0, folds=2, inner=2))
    assert few.params["y0"] and not few.group_tables  # the target's global study


def test_failed_trial_is_on_record_and_the_rest_resumes(spark, tmp_path):
    store = TrialStore(spark, str(tmp_path))
    space = [real("x", 0.0, 1.0)]

    def objective(params, report, broken=()):
        if len(store.open("s", 6).trials) in broken:
            raise RuntimeError("lost")
        report(params["x"])
        return params["x"]

    run = lambda f, n: run_trials(store.open("s", 6), f, random_proposals(space), n, finished=lambda done: store.save("s", done), stop=False)
    with pytest.raises(RuntimeError):
        run(lambda p, r: objective(p, r, {3}), 6)
    assert [t.state for t in store.open("s", 6).trials] == ["COMPLETE"] * 3 + ["FAIL"]
    run(objective, 3)
    whole_run = run_trials(Study("s"), lambda p, r: p["x"], random_proposals(space), 7, stop=False)
    again = store.open("s", 6).trials
    assert [t.params for t in again] == [t.params for t in whole_run.trials] and sum(t.state == "COMPLETE" for t in again) == 6
    other = run_trials(Study("t"), lambda p, r: p["x"], random_proposals(space), 1, stop=False)
    assert other.trials[0].params != whole_run.trials[0].params


def test_read_faults_are_not_an_empty_history(spark, tmp_path):
    (tmp_path / "trials").mkdir()
    (tmp_path / "trials" / "bucket=0").mkdir()
    (tmp_path / "trials" / "bucket=0" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        TrialStore(spark, str(tmp_path)).trials().collect()


def test_train_with_given_params(spark, rows):
    got = train(rows, ["width", "rho", "Sm", "bd"], ["bd"], "key", build_preset(1),
                params={"bd": {"rf_n_estimators": 2, "gbr_n_estimators": 2}}, settings=SearchSettings(inner=2))
    assert got.report.count() == 2
    with pytest.raises(ValueError):
        train(rows, ["width", "rho", "bd"], ["bd"], "key", build_preset(1))
    with pytest.raises(ValueError, match="bd"):
        train(rows, ["width", "rho", "bd"], ["bd"], "key", build_preset(1), params={})


def test_single_model_search(spark, rows):
    table = rows.withColumn("flat", F.lit(1.0))
    bundle, scores = search_single_models(
        table, ["width", "rho", "Sm", "bd"], ["bd", "flat"], "key", n_trials=2, folds=2,
        space=[whole("n_estimators", 4, 8), whole("max_depth", 2, 3), real("learning_rate", 0.2, 0.5)],
    )
    row = scores.collect()
    assert [r["target"] for r in row] == ["bd"] and row[0]["R2"] > 0.5
    assert row[0]["cv_best_score"] < 0 and row[0]["n_features"] == 3 and set(row[0]["best_params"]) == {"n_estimators", "max_depth", "learning_rate"}
    assert "pred_bd" in score_batch(bundle, table).columns
