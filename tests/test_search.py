"""Searches fold by fold, their log, and stacks of all groups, against plain fits of the same stacks."""

import subprocess
import sys
import textwrap
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldline.functions.metrics import metric_columns
from foldline.operators.linear_stack import LinearFolds, LinearStack, tune_stacks_by_group
from foldline.operators.search import Study, random_proposals, run_folds, stack_folds, tune
from foldline.operators.space import Preset, real, stack_from
from foldline.operators.stack import fit_preprocessed_stack
from foldline.plans.training import SearchSettings, run_study
from foldline.sources.trial_store import TrialStore

ROLES = {"a": "num", "b": "exp", "c": "num"}
SPACE = [real("p_alpha", 0.01, 1.0, True), real("q_alpha", 10.0, 1e3, True), real("m_alpha", 0.1, 1e3, True)]


def preset(passthrough=False):
    return Preset(77, [("p", "Ridge"), ("q", "Ridge")], ("m", "Ridge"), passthrough, SPACE)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(21)
    x = rng.random((240, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["y"] = 300 + 50 * x[:, 0] - 20 * x[:, 1] ** 2 + rng.normal(size=240)
    pdf.loc[::13, "a"] = np.nan
    pdf["fold"], pdf["key"] = np.arange(240) % 4, [f"k{i}" for i in range(240)]
    pdf["g"] = [None if i < 60 else "big" if i < 180 else "s7" if i < 187 else "s10" if i < 197 else "s25" if i < 222 else "few" if i < 226 else f"one{i}" for i in range(240)]
    return spark.createDataFrame(pdf).persist()


@pytest.mark.parametrize("passthrough", [False, True])
def test_sums_of_products_are_the_fitted_stack(rows, passthrough):
    trials = [{"p_alpha": 0.1, "q_alpha": 40.0, "m_alpha": 2.0}, {"p_alpha": 1.0, "q_alpha": 900.0, "m_alpha": 300.0}]
    fast = LinearFolds(rows, ROLES, preset(passthrough), "key", k=4, inner=3)
    slow = stack_folds(rows, ROLES, preset(passthrough), "key", inner=3)
    for fold in (0, 3):
        for f, s in zip(fast(fold, trials), slow(fold, trials), strict=True):
            assert all(np.isclose(f[m], s[m], rtol=1e-7) for m in ("MAE", "RMSE", "R2"))


def test_losers_leave_between_folds():
    level = {0: 5.0, 1: 4.0, 2: 6.0, 3: 9.0, 4: 1.0, 5: 8.0}
    asked = []

    def scores(fold, trials):
        asked.append((fold, [int(p["n"]) for p in trials]))
        return [{"MAE": level[int(p["n"])] + fold, "RMSE": 1.0, "R2": 0.5} for p in trials]

    study = run_folds(Study("s"), scores, lambda s, n: {"n": float(n)}, 6, k=4, batch=3, startup=3)
    assert [t.state for t in study.trials] == ["COMPLETE"] * 3 + ["PRUNED", "COMPLETE", "PRUNED"]
    assert asked == [(i, [0, 1, 2]) for i in range(4)] + [(0, [3, 4, 5]), (1, [3, 4, 5]), (2, [4]), (3, [4])]
    assert study.best.number == 4 and [len(t.folds) for t in study.trials] == [4, 4, 4, 2, 4, 2] and study.trials[3].value is None
    assert study.trials[4].value == pytest.approx(2.5)


def test_not_finite_and_broken_folds_fail():
    def scores(fold, trials):
        if fold == 1 and len(trials) == 1:
            raise RuntimeError("lost")
        return [{"MAE": float("nan") if p["n"] == 1 else 1.0, "RMSE": 1.0, "R2": None} for p in trials]

    saved = []
    with pytest.raises(RuntimeError):
        run_folds(Study("s"), scores, lambda s, n: {"n": float(n)}, 4, k=2, batch=2, finished=lambda d: saved.append([t.state for t in d]))
    assert saved == [["FAIL", "FAIL"]]


def test_search_of_other_learners(rows):
    trees = Preset(78, [("t", "RandomForestRegressor"), ("p", "Ridge")], ("m", "Ridge"), False, [real("p_alpha", 0.1, 1.0)])
    params = lambda s, n: {"t_n_estimators": 2, "t_max_depth": 2 + n, "p_alpha": 0.5}
    study = run_folds(Study("t"), stack_folds(rows, ROLES, trees, "key", inner=2), params, 2, k=2, batch=2)
    assert [t.state for t in study.trials] == ["COMPLETE"] * 2
    model = fit_preprocessed_stack(rows.where("fold != 1"), ROLES, stack_from(trees, params(study, 0), 2), "key")
    want = model.transform(rows.where("fold = 1")).agg(*metric_columns("y", "prediction")).first().asDict()
    assert study.trials[0].folds[1] == pytest.approx(want)


def test_a_study_goes_on_where_it_ended(spark, rows, tmp_path):
    whole = tune(rows, ROLES, preset(), "key", "s", k=4, inner=3, n_trials=6, batch=2)
    store = TrialStore(spark, str(tmp_path), lease=0)
    settings = lambda n: SearchSettings(n_trials=n, folds=4, inner=3, space=SPACE, sampler="random", batch=2)
    run_study(rows, ROLES, preset(), "key", "s", store, settings(4))
    assert len(run_study(rows, ROLES, preset(), "key", "s", store, settings(6)).trials) == 4  # its own goal
    store.set_goal("s", 6)
    store.compact()
    assert len(list((tmp_path / "trials").rglob("*.parquet"))) == 1 and not (tmp_path / "trials-old").exists()
    again = run_study(rows, ROLES, preset(), "key", "s", TrialStore(spark, str(tmp_path)), settings(6))
    assert [(t.number, t.params, t.state) for t in again.trials] == [(t.number, t.params, t.state) for t in whole.trials]
    assert [t.value for t in again.trials] == pytest.approx([t.value for t in whole.trials])
    assert run_study(rows, ROLES, preset(), "key", "s", store, settings(6)).trials[-1].number == 5
    assert store.folds("s").count() == 24 and {r.study for r in store.studies().collect()} == {"s"}


def test_broken_compaction_is_taken_up(spark, tmp_path):
    store = TrialStore(spark, str(tmp_path))
    run_folds(store.open("s", 3), lambda f, ts: [{"MAE": 1.0 + t["x"], "RMSE": 1.0, "R2": 0.0} for t in ts], random_proposals([real("x", 0, 1)]), 3, k=2, stop=False, finished=lambda d: store.save("s", d))
    want = sorted(map(tuple, store.steps("s").collect()))
    (tmp_path / "steps").rename(tmp_path / "steps-old")  # broken off between the two renames
    store.compact()
    assert sorted(map(tuple, store.steps("s").collect())) == want and not (tmp_path / "steps-old").exists()


def test_claims_of_threads_and_processes_never_meet(spark, tmp_path):
    store, got = TrialStore(spark, str(tmp_path)), []
    threads = [threading.Thread(target=lambda: got.extend(store.claim("s", 1)[0] for _ in range(8))) for _ in range(4)]
    other = subprocess.Popen([sys.executable, "-c", textwrap.dedent(f"""
        from foldline.session import build_session
        from foldline.sources.trial_store import TrialStore
        spark = build_session("other", "local[1]", spark__ui__enabled="false")
        store = TrialStore(spark, {str(tmp_path)!r})
        print("claimed", *[store.claim("s", 1)[0] for _ in range(8)])
        """)], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True)
    [t.start() for t in threads]
    [t.join() for t in threads]
    theirs = next(line for line in other.communicate(timeout=120)[0].splitlines() if line.startswith("claimed")).split()[1:]
    assert sorted([*got, *map(int, theirs)]) == list(range(40))


def test_lost_claims_become_failed_trials(spark, tmp_path):
    store = TrialStore(spark, str(tmp_path), lease=3600)
    assert store.claim("s", 2) == [0, 1] and store.recover("s") == [] and store.open("s", 5).trials == []
    store.alive("s", [1])
    quick = TrialStore(spark, str(tmp_path), lease=0)
    assert [(t.number, t.state) for t in quick.open("s", 5).trials] == [(0, "FAIL"), (1, "FAIL")]
    assert quick.recover("s") == [] and store.claim("s", 1) == [2]
    run_folds(quick.open("s", 5), lambda f, ts: [{"MAE": 1.0, "RMSE": 1.0, "R2": 0.0}] * len(ts), random_proposals([real("x", 0, 1)]), 1, k=2, claim=lambda n: store.claim("s", n), finished=lambda d: quick.save("s", d))
    assert [t.number for t in quick.open("s", 5).trials] == [0, 1, 2, 3]


def test_stacks_of_all_groups_in_one_job(rows):
    x = rows.select("key", "g", "y", F.coalesce("a", F.lit(0.5)).alias("a"), "b", "c")
    candidates = [LinearStack([([0, 1, 2], 0.1), ([1], 3.0)], 5.0), LinearStack([([0, 2], 1.0), ([1], 0.2)], 0.5, True)]
    got = {r.g: r for r in tune_stacks_by_group(x, ["a", "b", "c"], "y", "key", ["g"], candidates, small=1, inner=3).collect()}
    assert {g: (r.n_rows, r.n_trials) for g, r in got.items()} == {None: (60, 2), "big": (120, 2), "s7": (7, 1), "s10": (10, 1), "s25": (25, 1)}
    assert all(r.trial < r.n_trials and r.mae > 0 and len(r.coef) == 3 for r in got.values())
    # One group by itself has the same result, and beats the mean where there are rows enough.
    alone = tune_stacks_by_group(x.where("g = 'big'"), ["a", "b", "c"], "y", "key", ["g"], candidates, inner=3).first()
    assert (alone.trial, alone.n_rows) == (got["big"].trial, 120) and np.isclose(alone.mae, got["big"].mae) and got["big"].r2 > 0.8
    assert tune_stacks_by_group(x.where("false"), ["a", "b", "c"], "y", "key", ["g"], candidates).count() == 0
