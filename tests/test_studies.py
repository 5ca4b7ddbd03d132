import numpy as np
import pytest
from pyspark.sql import functions as F

from foldline.operators import studies as st
from foldline.operators.pruning import first_prune, median_prune
from foldline.operators.reports import residual_histogram, param_importance
from foldline.operators.search import (
    TRIAL_SCHEMA, StopRules, Study, Trial, propose_tpe, random_proposals, run_trials, should_prune, space_of, tpe_proposals,
)
from foldline.operators.space import real, whole
from foldline.sources.trial_store import TrialStore

LETTER = {"C": "COMPLETE", "P": "PRUNED", "F": "FAIL"}


def history(spark, letters, values=None, name="s"):
    values = values or [1.0] * len(letters)
    rows = [(name, i, LETTER[c], float(v) if c == "C" else None, {"a": float(i)}) for i, (c, v) in enumerate(zip(letters, values))]
    return spark.createDataFrame(rows, TRIAL_SCHEMA)


def test_stop_on_pruned(spark):
    df = history(spark, "CPPFPPPC", [9, 0, 0, 0, 0, 0, 0, 5])
    assert st.pruned_streaks(df).first()["stop_trial"] == 6
    assert st.until_stop(df, st.stop_trial(df)).count() == 7


@pytest.mark.parametrize("seed", range(3))
def test_stop_rules_equal_the_counters(spark, seed):
    rng = np.random.default_rng(seed)
    letters = "".join(rng.choice(list("CCCPF"), 60))
    values = [float(v) for v in rng.integers(0, 4, 60)]
    df = history(spark, letters, values)
    rules, want = StopRules(tol=0.5), None
    for i, (c, v) in enumerate(zip(letters, values)):
        if rules.see(Trial(i, {}, LETTER[c], v if c == "C" else None)):
            want = i
            break
    got = st.stop_trial(df, tol=0.5).first()
    assert (got["stop_trial"] if got else None) == want


def test_resume(spark):
    summary = st.inspect_studies(history(spark, "CCCCCPPPFF").unionByName(history(spark, "C" * 30, name="full")))
    goals = spark.createDataFrame([("s", None), ("full", None), ("new", 4)], "study string, goal_n_trials int")
    got = {r["study"]: (r["finished"], r["remaining"], r["should_run"]) for r in st.resume_decision(summary, goals).collect()}
    assert got == {"s": (8, 22, True), "full": (30, 0, False), "new": (0, 4, True)}
    numbers = st.next_trials(st.resume_decision(summary, goals)).where("study = 's'").toPandas()["trial"]
    assert sorted(numbers) == list(range(10, 32))


def test_best_group_takes_the_first_key(spark):
    df = spark.createDataFrame([("t", "a", 2.0), ("t", "b", 1.0), ("t", "c", 1.0), ("t", "d", float("nan"))], "target string, g string, score double")
    assert st.best_group(df, "target", "score", ["g"]).first()["g"] == "b"


def test_study_best_ties_and_missing(spark):
    df = history(spark, "FCCC", [0, 3.0, 1.0, 1.0]).unionByName(history(spark, "PF", name="none"))
    assert st.study_best(df).collect()[0]["best_trial"] == 2
    row = st.inspect_studies(df).where("study = 'none'").first()
    assert (row["best_value"], row["best_params"], row["n_complete"]) == (None, None, 0)


@pytest.mark.parametrize("range_values", [3, 2_000])
def test_median_prune_brute_force(spark, range_values):
    rng = np.random.default_rng(4)
    trials, steps = [], []
    for s, n in (("hot", 130), ("b", 9), ("c", 30)):
        for t in range(n):
            trials.append((s, t, str(rng.choice(["COMPLETE", "COMPLETE", "PRUNED", "FAIL"])), 1.0, {}))
            # Steps of few values, one of them nearly always the same.
            steps += [(s, t, i, float(v)) for i, v in enumerate([*rng.integers(0, 40, 3), max(30, rng.integers(0, 40))], 1)]
    tdf, sdf = spark.createDataFrame(trials, TRIAL_SCHEMA), spark.createDataFrame(steps, "study string, trial long, step int, step_value double")
    got = {(r["study"], r["trial"]): r["step"] for r in first_prune(median_prune(sdf, tdf, range_values=range_values)).collect()}
    by = {}
    for s, t, i, v in steps:
        by.setdefault((s, t), []).append(v)
    want = {}
    for s, t, *_ in trials:
        earlier = [Trial(u, {}, state, 1.0, by[s, u]) for r, u, state, *_ in trials if r == s and u < t]
        for i in range(1, 5):
            if should_prune(earlier, by[s, t][:i]):
                want[s, t] = i
                break
    assert got == want and got


def test_run_trials_prunes_and_numbers_on():
    values = iter([[5, 5, 5]] * 5 + [[9, 9, 9], [1, 1, 1]] + [[9, 9, 9]] * 10)

    def objective(params, report):
        seen = next(values)
        for v in seen:
            report(v)
        return seen[-1]

    study = run_trials(Study("s"), objective, random_proposals([real("a", 0, 1)]), 7, stop=False)
    assert [t.state for t in study.trials] == ["COMPLETE"] * 5 + ["PRUNED", "COMPLETE"]
    assert study.best.number == 6 and len(study.trials[5].steps) == 2
    run_trials(study, objective, random_proposals([real("a", 0, 1)]), 10)
    assert [t.number for t in study.trials] == list(range(10)) and study.trials[-1].state == "PRUNED"


def test_resume_equals_an_unbroken_run(spark, tmp_path):
    objective = lambda params, report: (params["a"] - 0.3) ** 2
    propose = random_proposals([real("a", 0, 1)])
    whole_run = run_trials(Study("s"), objective, propose, 8, stop=False)
    store = TrialStore(spark, str(tmp_path))
    for n in (3, 5):
        study = store.open("s", 8)
        known = len(study.trials)
        run_trials(study, objective, propose, n, stop=False)
        store.save(study.name, study.trials[known:])
    again = store.open("s", 99)
    assert [(t.number, t.params, t.value) for t in again.trials] == [(t.number, t.params, t.value) for t in whole_run.trials]
    assert store.studies().first()["goal_n_trials"] == 8
    store.set_goal("s", 5)
    assert store.studies().collect()[0]["goal_n_trials"] == 5
    assert store.trials("other").count() == 0


def test_tpe_moves_to_good_values(spark):
    rng = np.random.default_rng(5)
    a = rng.random(200)
    rows = [("s", i, "COMPLETE", float(abs(v - 0.7)), {"a": float(v), "n": float(i % 5)}) for i, v in enumerate(a)]
    table = space_of(spark, [real("a", 0, 1), whole("n", 0, 4)])
    got = {r["param"]: r["draw"] for r in propose_tpe(spark.createDataFrame(rows, TRIAL_SCHEMA), table).collect()}
    assert abs(got["a"] - 0.7) < 0.12 and got["n"] in range(5)
    study = Study("s", [Trial(i, {"a": float(v)}, "COMPLETE", float(abs(v - 0.7))) for i, v in enumerate(a[:12])])
    assert 0 <= tpe_proposals(spark, [real("a", 0, 1)])(study, 12)["a"] <= 1


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([("t", "d", float(i), 0.0) for i in range(61)], "target string, dataset string, y double, p double")
    got = residual_histogram(df).orderBy("bin").toPandas()
    assert got["n"].tolist() == np.histogram(np.arange(61), 30)[0].tolist()
    same = spark.createDataFrame([("t", "d", 1.0, 0.0)] * 3, df.schema)
    assert residual_histogram(same).first()["n"] == 3


def test_importance_of_a_constant_is_zero(spark):
    df = history(spark, "CCC", [1.0, 2.0, 3.0]).withColumn("params", F.create_map(F.lit("a"), F.col("trial").cast("double"), F.lit("k"), F.lit(1.0)))
    got = {r["param"]: r["importance"] for r in param_importance(df).collect()}
    assert got["k"] == 0 and got["a"] == pytest.approx(1)
