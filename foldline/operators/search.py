"""Hyperparameter search: a loop of trials on the driver over jobs on the cluster."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from statistics import median
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from foldline.functions.hashing import hash_unit
from foldline.functions.metrics import METRICS, metric_columns
from foldline.operators.gram import linear_prediction
from foldline.operators.learners import fit_learner, is_exact, solve_linear
from foldline.operators.linear_stack import LinearFolds, is_linear, side_by_side
from foldline.operators.moments import total_moments
from foldline.operators.preprocess import Preprocessor
from foldline.operators.scans import bucket_offsets, null_safe_join
from foldline.operators.space import Param, Preset, sample_params, stack_from, value_at
from foldline.operators.stack import fit_preprocessed_stack
from foldline.operators.studies import COMPLETE, FAIL, PRUNED, in_state
from foldline.session import sized, stage_table

TRIAL_SCHEMA = T.StructType(
    [
        T.StructField("study", T.StringType()),
        T.StructField("trial", T.LongType()),
        T.StructField("state", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
STEP_SCHEMA = T.StructType(
    [
        T.StructField("study", T.StringType()),
        T.StructField("trial", T.LongType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("step_value", T.DoubleType()),
    ]
)


FOLD_SCHEMA = T.StructType(
    [
        T.StructField("study", T.StringType()),
        T.StructField("trial", T.LongType()),
        T.StructField("fold", T.IntegerType()),
        *[T.StructField(m, T.DoubleType()) for m in METRICS],
    ]
)


class TrialPruned(Exception):
    """Raised by a report to end a losing trial."""


@dataclass
class Trial:
    number: int
    params: dict[str, float]
    state: str = COMPLETE
    value: float | None = None
    steps: list[float] = field(default_factory=list)
    folds: list[dict[str, float]] = field(default_factory=list)


@dataclass
class Study:
    """The history of one search; small, as every trial is one driver step."""

    name: str
    trials: list[Trial] = field(default_factory=list)

    @property
    def best(self) -> Trial:
        done = [t for t in self.trials if t.state == COMPLETE and t.value is not None]
        if not done:
            raise ValueError(f"study {self.name} has no COMPLETE trial")
        return min(done, key=lambda t: (t.value, t.number))

    def trials_df(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, t.number, t.state, t.value, {k: float(v) for k, v in t.params.items()}) for t in self.trials]
        return spark.createDataFrame(rows, TRIAL_SCHEMA)

    def steps_df(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, t.number, i, v) for t in self.trials for i, v in enumerate(t.steps, 1)]
        return spark.createDataFrame(rows, STEP_SCHEMA)

    def folds_df(self, spark: SparkSession) -> DataFrame:
        """The metrics of every fold that a trial reached."""
        rows = [(self.name, t.number, i, *(m[c] for c in METRICS)) for t in self.trials for i, m in enumerate(t.folds)]
        return spark.createDataFrame(rows, FOLD_SCHEMA)


def should_prune(earlier: Sequence[Trial], steps: Sequence[float], startup: int = 5, warmup: int = 2) -> bool:
    """The median rule for one running trial; ``steps`` are its reports so far."""
    done = [t.steps for t in earlier if t.state == COMPLETE]
    at = len(steps)
    if len(done) < startup or at < warmup:
        return False
    peers = [s[at - 1] for s in done if len(s) >= at]
    return bool(peers) and min(steps) > median(peers)


@dataclass
class StopRules:
    """Counters over finished trials, started afresh for each run of a study."""

    patience: int = 3
    tol: float = 1e-5
    pruned: int = 0
    small: int = 0
    stalled: int = 0
    best: float = math.inf

    def see(self, trial: Trial) -> bool:
        self.pruned = self.pruned + 1 if trial.state == PRUNED else 0
        if trial.state != COMPLETE or trial.value is None:
            self.small = self.stalled = 0
        else:
            self.small = self.small + 1 if trial.value <= self.tol else 0
            self.stalled = self.stalled + 1 if abs(trial.value - self.best) <= self.tol else 0
            self.best = min(self.best, trial.value)
        return max(self.pruned, self.small, self.stalled) >= self.patience


Objective = Callable[[dict[str, float], Callable[[float], None]], float]


def run_trials(
    study: Study,
    objective: Objective,
    propose: Callable[[Study, int], dict[str, float]],
    n_trials: int,
    prune: bool = True,
    stop: bool = True,
    batch: int = 1,
    startup: int = 5,
    warmup: int = 2,
    finished: Callable[[Sequence[Trial]], None] | None = None,
) -> Study:
    """Run up to ``n_trials`` more trials, numbered on from the last one.

    ``objective(params, report)`` calls ``report`` after each fold with the
    running mean. Trials of a batch run in parallel threads and are judged
    against the trials finished before the batch. ``finished`` gets the trials
    of every batch as it ends, so that a broken run loses no more than one. An
    objective that raises leaves a FAIL trial there before the error goes on.
    """
    rules = StopRules()
    left = n_trials
    while left > 0:
        first = max((t.number for t in study.trials), default=-1) + 1
        size = min(batch, left)
        earlier = list(study.trials)
        errors: list[Exception] = []

        def run(number: int) -> Trial:
            trial = Trial(number, propose(study, number))

            def report(value: float) -> None:
                trial.steps.append(value)
                if prune and should_prune(earlier, trial.steps, startup, warmup):
                    raise TrialPruned

            try:
                trial.value = float(objective(trial.params, report))
                if not math.isfinite(trial.value):
                    trial.state, trial.value = FAIL, None
            except TrialPruned:
                trial.state, trial.value = PRUNED, None
            except Exception as e:
                trial.state, trial.value = FAIL, None
                errors.append(e)
            return trial

        numbers = range(first, first + size)
        if size == 1:
            done = [run(first)]
        else:
            with ThreadPoolExecutor(size) as pool:
                done = list(pool.map(run, numbers))
        for trial in done:
            study.trials.append(trial)
            left -= 1
        if finished:
            finished(done)
        if errors:
            raise errors[0]
        if stop and any([rules.see(t) for t in done]):
            break
    return study


def random_proposals(space: Sequence[Param], seed: int = 42) -> Callable[[Study, int], dict[str, float]]:
    """Draws fixed by seed, study and trial number: every study searches points of its own."""
    return lambda study, number: sample_params(space, number, seed, study.name)


def tpe_proposals(
    spark: SparkSession, space: Sequence[Param], seed: int = 42, startup: int = 10
) -> Callable[[Study, int], dict[str, float]]:
    """Draws at random first, then where good trials are denser than the others."""

    def propose(study: Study, number: int) -> dict[str, float]:
        if sum(t.state == COMPLETE for t in study.trials) < startup:
            return sample_params(space, number, seed, study.name)
        table = space_of(spark, space)
        rows = propose_tpe(study.trials_df(spark), table, seed=seed + number).collect()
        return {r["param"]: r["draw"] for r in rows}

    return propose


def space_of(spark: SparkSession, space: Sequence[Param]) -> DataFrame:
    rows = [(p.name, p.kind, float(p.low), float(p.high), float(p.step), p.log) for p in space]
    return spark.createDataFrame(rows, "param string, kind string, low double, high double, step double, log boolean")


FoldScores = Callable[[int, Sequence[Mapping[str, float]]], Sequence[Mapping[str, float]]]


def stack_folds(
    df: DataFrame, roles: Mapping[str, str], preset: Preset, key: str, label: str = "y", fold: str = "fold", inner: int = 5,
    threads: int = 4,
) -> FoldScores:
    """Scores any preset's stacks on one outer fold: the fits of all given trials share a bounded pool."""

    def scores(i: int, trials: Sequence[Mapping[str, float]]) -> list[dict[str, float]]:
        train, test = df.where(F.col(fold) != i), df.where(F.col(fold) == i)

        def one(params: Mapping[str, float]) -> dict[str, float]:
            model = fit_preprocessed_stack(train, roles, stack_from(preset, params, inner), key, label)
            return model.transform(test).agg(*metric_columns(label, "prediction")).first().asDict()

        with ThreadPoolExecutor(threads) as pool:
            return list(pool.map(one, trials))

    return scores


def run_folds(
    study: Study,
    scores: FoldScores,
    propose: Callable[[Study, int], dict[str, float]],
    n_trials: int,
    k: int = 5,
    prune: bool = True,
    stop: bool = True,
    batch: int = 1,
    startup: int = 5,
    warmup: int = 2,
    claim: Callable[[int], Sequence[int]] | None = None,
    alive: Callable[[Sequence[int]], None] | None = None,
    finished: Callable[[Sequence[Trial]], None] | None = None,
) -> Study:
    """Run up to ``n_trials`` more trials in batches, fold by fold.

    ``scores(fold, params of the live trials)`` gives each trial's metrics on
    one outer fold. After every fold the running mean MAE is a trial's step,
    and trials that the median rule sets against those finished before the
    batch go before the next fold begins: losers cost the folds they reached.
    ``claim`` reserves trial numbers in a shared log, else they go on from the
    last; ``alive`` gets the numbers after every fold. ``finished`` gets the trials of every batch as it ends. Where a fold
    raises, the open trials of the batch are FAIL there before the error goes on.
    """
    rules, left = StopRules(), n_trials
    while left > 0:
        size = min(batch, left)
        earlier = list(study.trials)
        first = max((t.number for t in earlier), default=-1) + 1
        done = [Trial(n, propose(study, n)) for n in (claim(size) if claim else range(first, first + size))]
        error = None
        try:
            for i in range(k):
                live = [t for t in done if t.state == COMPLETE]
                if not live:
                    break
                for t, m in zip(live, scores(i, [t.params for t in live]), strict=True):
                    t.folds.append(dict(m))
                    if m["MAE"] is None or not math.isfinite(m["MAE"]):
                        t.state = FAIL
                        continue
                    t.steps.append(sum(f["MAE"] for f in t.folds) / len(t.folds))
                    if prune and should_prune(earlier, t.steps, startup, warmup):
                        t.state = PRUNED
                if alive:
                    alive([t.number for t in done])
        except Exception as e:
            error = e
        for t in done:
            if t.state == COMPLETE and error is not None:
                t.state = FAIL
            elif t.state == COMPLETE:
                t.value = t.steps[-1]
        study.trials.extend(done)
        left -= size
        if finished:
            finished(done)
        if error is not None:
            raise error
        if stop and any([rules.see(t) for t in done]):
            break
    return study


def tune(
    df: DataFrame,
    roles: dict[str, str],
    preset: Preset,
    key: str,
    name: str,
    label: str = "y",
    fold: str = "fold",
    k: int = 5,
    inner: int = 5,
    n_trials: int = 30,
    space: Sequence[Param] | None = None,
    study: Study | None = None,
    seed: int = 42,
    sampler: str = "random",
    staged: bool = False,
    **rules: Any,
) -> Study:
    """Search a preset's parameters on the rows of ``df``; pass a study to go on with it.

    Presets of linear members only are scored from sums of products, all live
    trials of a batch in one scan of the fold; others are fitted. ``staged``:
    the rows come from files, and are not written once more.
    """
    space = preset.space if space is None else space
    # Every fold of every trial scans these rows, over hours.
    rows = df.select(*dict.fromkeys([key, label, fold, *roles]))
    rows = rows if staged else stage_table(rows, "tune")
    if is_linear(preset):
        scores = LinearFolds(rows, roles, preset, key, label, fold, k, inner)
    else:
        scores = stack_folds(rows, roles, preset, key, label, fold, inner)
    propose = random_proposals(space, seed) if sampler == "random" else tpe_proposals(df.sparkSession, space, seed)
    return run_folds(study or Study(name), scores, propose, n_trials, k, **rules)


def cv_search(
    df: DataFrame,
    roles: dict[str, str],
    learner: str,
    grid: Sequence[dict[str, Any]],
    label: str = "y",
    fold: str = "fold",
    k: int = 5,
    parallelism: int = 4,
    **prep: Any,
) -> tuple[PipelineModel, list[float], int]:
    """Search any learner over given folds and refit the winner on all rows.

    Every fold is scaled and imputed with the statistics of its own training
    rows. Returns the fitted pipeline from raw columns, ``-MAE`` per candidate
    (mean over the folds) and the winner's index.
    """
    rows = stage_table(df.select(*dict.fromkeys([label, fold, *roles])), "cv")
    models = Preprocessor(roles, **prep).fit_by_fold(rows, fold, k)

    def linear(i: int) -> list[float]:
        """The whole grid on one fold: the moments of the other rows, then one scan of the fold."""
        x = models[i].columns
        sums = total_moments(models[i].transform(rows.where(F.col(fold) != i)), [*x, label])
        functions = [solve_linear(learner, params, sums) for params in grid]
        columns = [linear_prediction(x, F.lit(b), F.array(*map(F.lit, w.tolist()))) for b, w in functions]
        return [m["MAE"] for m in side_by_side(models[i].transform(rows.where(F.col(fold) == i)), label, columns)]

    def judge(job: tuple[int, int]) -> float:
        at, i = job
        pre = models[i]
        model = fit_learner(learner, grid[at], pre.transform(rows.where(F.col(fold) != i)), pre.columns, label)
        scored = model.transform(pre.transform(rows.where(F.col(fold) == i)))
        return scored.agg(F.avg(F.abs(F.col(label) - F.col("prediction")))).first()[0]

    with ThreadPoolExecutor(parallelism) as pool:
        if is_exact(learner, grid) and not any(m.wide for m in models.values()):
            errors = [e for of_trial in zip(*pool.map(linear, range(k))) for e in of_trial]
        else:
            errors = list(pool.map(judge, [(at, i) for at in range(len(grid)) for i in range(k)]))
    scores = [-sum(errors[at * k : (at + 1) * k]) / k for at in range(len(grid))]
    best = max(range(len(grid)), key=lambda at: scores[at])
    pre = Preprocessor(roles, **prep).fit(rows)
    fitted = fit_learner(learner, grid[best], pre.transform(rows), pre.columns, label)
    return PipelineModel([*pre.stages()[:-1], *fitted.stages]), scores, best


GOOD_SHARE = 0.1
NARROWEST = 100  # parts of a parameter's range: no kernel is narrower than one of them


def _in_order(df: DataFrame, by: Sequence[str], x: str, pieces: int) -> DataFrame:
    """``__piece`` for every row: by approximate quantiles of ``x`` in its group, so no window has to hold a whole group."""
    probs = [i / pieces for i in range(1, pieces)]
    edges = df.groupBy(*by).agg(F.array_distinct(F.percentile_approx(x, probs, 1_000)).alias("__edges"))
    return null_safe_join(df, sized(edges), by).withColumn("__piece", F.expr(f"size(filter(__edges, e -> e < `{x}`))")).drop("__edges")


def parzen_widths(points: DataFrame, by: Sequence[str], pieces: int = 64) -> DataFrame:
    """(by, x, low, high, width): a kernel width for every point, from the gaps to its sorted neighbours.

    The larger of both gaps, where the range's ends stand in for missing
    neighbours, but no less than the range over the number of points and one
    (``NARROWEST`` at most) and no more than the range. Sorting happens inside
    pieces of a group; a row for each piece carries its ends to the next.
    """
    by = list(by)
    placed = _in_order(points, by, "x", pieces)
    ends = placed.groupBy(*by, "__piece").agg(F.min("x").alias("__min"), F.max("x").alias("__max"), F.count("*").alias("__n"))
    over = W.partitionBy(*by).orderBy("__piece")
    carried = ends.select(
        *by, "__piece", F.lag("__max").over(over).alias("__before"), F.lead("__min").over(over).alias("__after"), F.sum("__n").over(W.partitionBy(*by)).alias("__points")
    )
    inside = W.partitionBy(*by, "__piece").orderBy("x")
    joined = null_safe_join(placed, sized(carried), [*by, "__piece"])
    left = F.col("x") - F.coalesce(F.lag("x").over(inside), F.col("__before"), F.col("low"))
    right = F.coalesce(F.lead("x").over(inside), F.col("__after"), F.col("high")) - F.col("x")
    span = F.col("high") - F.col("low")
    floor = span / F.least(F.lit(NARROWEST), F.col("__points") + 1)
    return joined.select(*by, "x", "low", "high", F.least(F.greatest(left, right, floor), span).alias("width"))


def propose_tpe(
    trials: DataFrame, space: DataFrame, by: Sequence[str] = ("study",), n_candidates: int = 24, seed: int = 42, pieces: int = 64
) -> DataFrame:
    """One proposal per study and parameter from its history, all studies at once.

    Good trials are the best tenth, however many. Both sides are Parzen
    estimates: a kernel on every COMPLETE trial, as wide as its neighbours are
    far (``parzen_widths``), and a prior over the whole range; on a logarithmic
    scale where the parameter has one. Candidates are fixed by hash, one small
    row for each study and parameter, and the one with the largest ratio of
    good to other density wins. Kernels are summed side by side for all
    candidates, so rows are not multiplied and sums combine before the shuffle.
    """
    by, keys = list(by), [*by, "param"]
    done = trials.where(in_state(COMPLETE) & F.col("value").isNotNull()).select(*by, "trial", "value", "params")
    ordered = _in_order(stage_table(done, "done"), by, "value", pieces)
    counts = bucket_offsets(ordered, by, "__piece")
    rank = F.row_number().over(W.partitionBy(*by, "__piece").orderBy("value", "trial")) + F.col("__start")
    marked = null_safe_join(ordered, sized(counts), [*by, "__piece"]).withColumn("good", rank <= F.ceil(F.col("__total") * GOOD_SHARE))
    scale = lambda v: F.when(F.col("log"), F.log(v)).otherwise(v)
    spaced = marked.select(*by, "good", F.explode("params").alias("param", "pvalue")).join(F.broadcast(space), "param")
    seen = F.least(F.greatest(F.col("pvalue"), F.col("low")), F.col("high"))
    points = stage_table(spaced.select(*keys, "good", scale(seen).alias("x"), scale(F.col("low")).alias("low"), scale(F.col("high")).alias("high")), "points")
    kernels = parzen_widths(points, [*keys, "good"], pieces)
    # A study's candidates are a row of its own.
    u = hash_unit(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.col("param"), F.col("cand").cast("string")))
    cand = points.select(*keys).distinct().join(F.broadcast(space), "param").withColumn("cand", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))))
    cand = cand.withColumn("draw", value_at(u)).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("cand", "draw", scale(F.col("draw")).alias("at")))).alias("draws")
    )
    met = null_safe_join(kernels, sized(cand), keys)
    density = lambda i, mean, width: F.exp(-0.5 * F.pow((F.get("draws", F.lit(i))["at"] - mean) / width, 2)) / width
    prior = lambda i: density(i, (F.col("low") + F.col("high")) / 2, F.col("high") - F.col("low"))
    sides = {"g": F.col("good"), "o": ~F.col("good")}
    sums = [F.sum(F.when(side, density(i, F.col("x"), F.col("width"))).otherwise(0.0)).alias(f"{name}{i}") for name, side in sides.items() for i in range(n_candidates)]
    sums += [F.count_if(side).alias(f"n{name}") for name, side in sides.items()]
    sums += [F.first("draws").alias("draws"), *[F.first(prior(i)).alias(f"p{i}") for i in range(n_candidates)]]
    wide = met.groupBy(*keys).agg(*sums)
    score = lambda i: ((F.col(f"g{i}") + F.col(f"p{i}")) / (F.col("ng") + 1)) / ((F.col(f"o{i}") + F.col(f"p{i}")) / (F.col("no") + 1))
    options = F.array(*[F.struct(score(i).alias("score"), F.lit(-i).alias("cand"), F.get("draws", F.lit(i))["draw"].alias("draw")) for i in range(n_candidates)])
    return wide.withColumn("b", F.array_max(options)).select(*keys, "b.draw", "b.score")
