"""Search history as tables: counts, bests, pruning, stop rules, resume.

``trials(study, trial, state, value, params)`` with trial numbers 0, 1, 2, ...
per study, ``trial_steps(study, trial, step, step_value)``,
``studies(study, goal_n_trials)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldline.functions.numeric import is_finite
from foldline.operators.scans import running_min, streak_ends

COMPLETE, PRUNED, FAIL = "COMPLETE", "PRUNED", "FAIL"


def in_state(*states: str) -> Column:
    return F.col("state").isin(*states)


def study_name(target: Column | str, *group: Column) -> Column:
    """``target_study`` or ``target_group_a_b_c``."""
    target = F.lit(target) if isinstance(target, str) else target
    if not group:
        return F.concat(target, F.lit("_study"))
    return F.concat_ws("_", target, F.lit("group"), *[g.cast("string") for g in group])


def inspect_studies(trials: DataFrame, by: Sequence[str] = ("study",)) -> DataFrame:
    """Counts per state, best value and its parameters, all in one aggregation."""
    done = in_state(COMPLETE) & F.col("value").isNotNull()
    rank = F.when(done, F.struct("value", "trial"))
    return trials.groupBy(*by).agg(
        F.count_if(in_state(COMPLETE)).alias("n_complete"),
        F.count_if(in_state(PRUNED)).alias("n_pruned"),
        F.count_if(in_state(FAIL)).alias("n_fail"),
        F.count("*").alias("n_total"),
        F.min(rank)["value"].alias("best_value"),
        F.min(rank)["trial"].alias("best_trial"),
        F.min_by("params", rank).alias("best_params"),
    )


def study_best(trials: DataFrame, by: Sequence[str] = ("study",)) -> DataFrame:
    """Best COMPLETE trial per study, the earliest on ties."""
    done = trials.where(in_state(COMPLETE) & F.col("value").isNotNull())
    return done.groupBy(*by).agg(F.min_by(F.struct("trial", "value", "params"), F.struct("value", "trial")).alias("b")).select(
        *by, F.col("b.trial").alias("best_trial"), F.col("b.value").alias("best_value"), F.col("b.params").alias("best_params")
    )


def finished_studies(trials: DataFrame) -> DataFrame:
    """Studies with at least one COMPLETE trial."""
    return trials.where(in_state(COMPLETE)).select("study").distinct()


def studies_to_run(wanted: DataFrame, finished: DataFrame) -> DataFrame:
    return wanted.join(finished, "study", "left_anti")


def resume_decision(summary: DataFrame, studies: DataFrame, default_goal: int = 30) -> DataFrame:
    """Finished = COMPLETE + PRUNED; a study's own goal overrides the default."""
    finished = F.coalesce(F.col("n_complete") + F.col("n_pruned"), F.lit(0))
    goal = F.coalesce(F.col("goal_n_trials").cast("bigint"), F.lit(default_goal).cast("bigint"))
    joined = summary.join(studies.select("study", "goal_n_trials"), "study", "full_outer")
    return (
        joined.withColumn("finished", finished)
        .withColumn("goal", goal)
        .withColumn("remaining", F.greatest(F.lit(0).cast("bigint"), F.col("goal") - F.col("finished")))
        .withColumn("should_run", F.col("remaining") > 0)
    )


def next_trials(decision: DataFrame) -> DataFrame:
    """The trial numbers still to run, continuing after the last one."""
    todo = decision.where("should_run").withColumn("first", F.coalesce(F.col("n_total"), F.lit(0)))
    return todo.select("study", F.explode(F.sequence("first", F.col("first") + F.col("remaining") - 1)).alias("trial"))


def best_group(scores: DataFrame, target: str, score: str, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Per target the group with the smallest finite score, the first key on ties."""
    return (
        scores.where(is_finite(F.col(score)))
        .groupBy(target)
        .agg(F.min_by(F.struct(*keys, score, *keep), F.struct(score, *keys)).alias("b"))
        .select(target, "b.*")
    )


def winner_or_fallback(targets: DataFrame, winners: DataFrame, fallback: DataFrame) -> DataFrame:
    """Group winner where its score is finite, else the target's global study.

    ``winners`` and ``fallback`` are (target, score, params) with one row per target.
    """
    w = winners.where(is_finite(F.col("score"))).select("target", F.struct("score", "params").alias("w"))
    f = fallback.where(is_finite(F.col("score"))).select("target", F.struct("score", "params").alias("f"))
    chosen = F.coalesce(F.col("w"), F.col("f"))
    origin = F.when(F.col("w").isNotNull(), "group").when(F.col("f").isNotNull(), "global")
    return targets.join(w, "target", "left").join(f, "target", "left").select(
        "target", origin.alias("origin"), chosen["score"].alias("score"), chosen["params"].alias("params")
    )


def running_fold_mean(steps: DataFrame) -> DataFrame:
    """Mean of the step values so far: what a trial reports after each fold."""
    w = W.partitionBy("study", "trial").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return steps.withColumn("running_mean", F.avg("step_value").over(w))


def optimization_history(trials: DataFrame) -> DataFrame:
    """COMPLETE trials with the best value up to each."""
    done = trials.where(in_state(COMPLETE))
    return running_min(done, ["study"], "trial", "value", "best_so_far")


def pruned_streaks(trials: DataFrame, patience: int = 3) -> DataFrame:
    """First trial that completes ``patience`` PRUNED in a row; any other state resets."""
    return _first(streak_ends(trials, ["study"], "trial", in_state(PRUNED), patience))


def small_value_streaks(trials: DataFrame, tol: float = 1e-5, patience: int = 3) -> DataFrame:
    """First trial that completes ``patience`` COMPLETE values at or under ``tol`` in a row."""
    hit = in_state(COMPLETE) & (F.col("value") <= tol)
    return _first(streak_ends(trials, ["study"], "trial", hit, patience))


def stalled_streaks(trials: DataFrame, tol: float = 1e-5, patience: int = 3) -> DataFrame:
    """First trial that completes ``patience`` values in a row within ``tol`` of the best before each.

    Other states break the streak; the best value is kept across them.
    """
    done = trials.withColumn("__v", F.when(in_state(COMPLETE), F.col("value")))
    tagged = running_min(done, ["study"], "trial", "__v", "__best", before_only=True)
    hit = F.col("__v").isNotNull() & F.col("__best").isNotNull() & (F.abs(F.col("__v") - F.col("__best")) <= tol)
    return _first(streak_ends(tagged, ["study"], "trial", hit, patience))


def _first(ends: DataFrame) -> DataFrame:
    return ends.groupBy("study").agg(F.min("trial").alias("stop_trial"))


def stop_trial(trials: DataFrame, patience: int = 3, tol: float = 1e-5) -> DataFrame:
    """Where each study would stop: the earliest of the three rules."""
    rules = {
        "pruned": pruned_streaks(trials, patience),
        "small": small_value_streaks(trials, tol, patience),
        "stalled": stalled_streaks(trials, tol, patience),
    }
    parts = [df.withColumn("rule", F.lit(name)) for name, df in rules.items()]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("study").agg(
        F.min("stop_trial").alias("stop_trial"),
        F.min_by("rule", F.struct("stop_trial", "rule")).alias("rule"),
    )


def until_stop(trials: DataFrame, stops: DataFrame) -> DataFrame:
    """The trials a study would have run: those up to its stop."""
    joined = trials.join(stops.select("study", "stop_trial"), "study", "left")
    return joined.where(F.col("stop_trial").isNull() | (F.col("trial") <= F.col("stop_trial"))).drop("stop_trial")


def lowered_goals(trials: DataFrame, studies: DataFrame, stops: DataFrame, default_goal: int = 30) -> DataFrame:
    """Goals after early stops: a stopped study that fell short keeps what it finished as its goal."""
    decision = resume_decision(inspect_studies(until_stop(trials, stops)), studies, default_goal)
    stopped = decision.join(stops.select("study", "stop_trial"), "study", "left")
    lower = F.col("stop_trial").isNotNull() & (F.col("finished") < F.col("goal"))
    return stopped.withColumn("new_goal", F.when(lower, F.col("finished")).otherwise(F.col("goal")))
