"""Regression learners by name, on MLlib.

Each learner takes the parameter names users of the usual tabular libraries
know (``n_estimators``, ``max_depth``, ...) and maps them to MLlib. Where
MLlib has no counterpart for a parameter it is ignored with a warning.
"""

from __future__ import annotations

import math
import uuid
import warnings
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    DecisionTreeRegressor,
    GBTRegressionModel,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldline.functions.numeric import sql_double, sql_name
from foldline.operators.huber import fit_huber
from foldline.operators.moments import Moments, elastic_net, ridge, total_moments
from foldline.operators.scans import null_safe_join
from foldline.session import sized, stage_table

MAX_DEPTH = 30  # MLlib's limit
BOOSTED_DEPTH = 6  # of histogram boosting where no depth is given: MLlib has no growth by leaves
TREE_MEMORY_MB = 512
PARALLEL_TREES = 8
BINS = 255
SAMPLED_ROWS = BINS**2  # rows beyond which MLlib takes its cut points from a sample
BAGGED_ROWS = 5_000_000  # rows beyond which a forest's draws are added up by cell
BAGGED_SHARE = 0.25  # cells of a row, at most, where they are: more would take more room than MLlib's rows
DRAWN_ROWS = 250_000  # of a task that draws
DRAWN_TREES = 50  # that a row is drawn for at once
TASK_CELLS = 10_000  # cells that a tree grows on in one task, so that it rounds alike every time

# Parameters used when none are given.
DEFAULTS: dict[str, dict[str, Any]] = {
    "RandomForestRegressor": {"n_estimators": 300, "max_depth": None, "min_samples_leaf": 2, "bootstrap": True},
    "GradientBoostingRegressor": {"n_estimators": 300, "learning_rate": 0.1, "max_depth": 3},
    "HistGradientBoostingRegressor": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": None, "max_bins": 255},
    "ExtraTreesRegressor": {"n_estimators": 100, "max_depth": None, "min_samples_leaf": 1, "n_cuts": 32},
    "XGBRegressor": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.3, "subsample": 1.0},
    "LGBMRegressor": {"n_estimators": 100, "num_leaves": 31, "max_depth": -1, "learning_rate": 0.1},
    "CatBoostRegressor": {"iterations": 1000, "depth": 6, "learning_rate": 0.03},
    "Ridge": {"alpha": 1.0, "solver": "exact"},
    "ElasticNet": {"alpha": 1.0, "l1_ratio": 0.5, "solver": "exact"},
    "SVR": {"C": 1.0, "gamma": 1.0, "epsilon": 0.1, "n_components": 64},
}
# Parameters of the fixed part of a preset that concern threads, logs or seeds only.
SILENT = {"n_jobs", "verbose", "random_state", "random_seed"}


def _take(name: str, params: Mapping[str, Any], ignored: Sequence[str] = ()) -> dict[str, Any]:
    known = DEFAULTS[name]
    for p in params:
        if p in ignored:
            warnings.warn(f"{name}: {p} has no MLlib counterpart and is ignored", stacklevel=3)
        elif p not in known and p not in SILENT:
            raise KeyError(f"{name} has no parameter {p}")
    return {p: params.get(p, v) if params.get(p) is not None else v for p, v in known.items()}


def _depth(value: Any) -> int:
    if value is not None and int(value) > MAX_DEPTH:
        warnings.warn(f"max_depth {value} is more than MLlib grows; trees stop at {MAX_DEPTH}", stacklevel=3)
    return MAX_DEPTH if value is None else max(1, min(MAX_DEPTH, int(value)))


def _boosted(n: Any, rate: float, depth: int, seed: int, bins: int = 255, subsample: float = 1.0) -> GBTRegressor:
    # The first MLlib tree weighs 1, later ones the step size.
    if rate > 1.0:
        warnings.warn(f"learning_rate {rate} is more than MLlib allows and becomes 1", stacklevel=3)
    return GBTRegressor(
        maxIter=int(n),
        stepSize=float(min(rate, 1.0)),
        maxDepth=depth,
        maxBins=int(bins),
        subsamplingRate=float(subsample),
        seed=seed,
        maxMemoryInMB=TREE_MEMORY_MB,
    )


def tree_estimator(name: str, params: Mapping[str, Any], seed: int = 42):
    """The MLlib estimator for a tree learner."""
    if name == "RandomForestRegressor":
        p = _take(name, params)
        return RandomForestRegressor(
            numTrees=int(p["n_estimators"]),
            maxDepth=_depth(p["max_depth"]),
            minInstancesPerNode=int(p["min_samples_leaf"]),
            featureSubsetStrategy="all",
            bootstrap=bool(p["bootstrap"]),
            maxBins=BINS,
            seed=seed,
            maxMemoryInMB=TREE_MEMORY_MB,
        )
    if name == "GradientBoostingRegressor":
        p = _take(name, params)
        return _boosted(p["n_estimators"], p["learning_rate"], _depth(p["max_depth"]), seed)
    if name == "HistGradientBoostingRegressor":
        p = _take(name, params, ignored=("l2_regularization",))
        if p["max_depth"] is None:
            warnings.warn(f"{name}: boosted trees without a depth limit become {BOOSTED_DEPTH} deep", stacklevel=3)
        return _boosted(p["n_estimators"], p["learning_rate"], _depth(p["max_depth"] or BOOSTED_DEPTH), seed, p["max_bins"])
    if name == "XGBRegressor":
        p = _take(name, params)
        return _boosted(p["n_estimators"], p["learning_rate"], _depth(p["max_depth"]), seed, subsample=p["subsample"])
    if name == "LGBMRegressor":
        p = _take(name, params)
        depth = math.ceil(math.log2(max(2, int(p["num_leaves"]))))
        if int(p["max_depth"]) > 0:
            depth = min(depth, int(p["max_depth"]))
        return _boosted(p["n_estimators"], p["learning_rate"], _depth(depth), seed)
    if name == "CatBoostRegressor":
        p = _take(name, params, ignored=("l2_leaf_reg",))
        return _boosted(p["iterations"], p["learning_rate"], _depth(p["depth"]), seed)
    raise KeyError(f"unknown tree learner: {name}")


def _label_stats(df: DataFrame, label: str) -> tuple[int, float]:
    row = df.agg(F.count(label).alias("n"), F.stddev_samp(label).alias("sd")).first()
    return row["n"], row["sd"] or 0.0


def linear_estimator(
    df: DataFrame, features: str, label: str, prediction: str, alpha: float, l1_ratio: float
) -> LinearRegression:
    """MLlib's iterative solver (``solver="l-bfgs"``); it stops short of the last digits.

    Penalties on the scale of a squared-error sum (ridge) or mean (elastic
    net). MLlib divides the label by its sample standard deviation first, so the
    mapping needs n and that deviation.
    """
    n, sd = _label_stats(df, label)
    if l1_ratio is None:
        reg, mix = (alpha / n) * (sd or 1.0), 0.0
    else:
        lasso, ridge = alpha * l1_ratio, alpha * (1 - l1_ratio) * (sd or 1.0)
        reg = lasso + ridge
        mix = lasso / reg if reg else 0.0
    return LinearRegression(
        featuresCol=features,
        labelCol=label,
        predictionCol=prediction,
        regParam=reg,
        elasticNetParam=mix,
        standardization=False,
        solver="l-bfgs",
        tol=1e-10,
        maxIter=1000,
    )


PLAIN_TERMS = 100  # of a prediction that is written out as a sum


def linear_stage(x: Sequence[str], intercept: float, coef: Sequence[float], prediction: str) -> SQLTransformer:
    """A linear model as a persistable stage: plain SQL over the columns, inside generated code."""
    if len(x) <= PLAIN_TERMS:
        terms = " + ".join([sql_double(intercept), *(f"{sql_double(float(b))} * {sql_name(c)}" for c, b in zip(x, coef))])
    else:  # a sum of that many terms would not compile
        values, weights = ", ".join(map(sql_name, x)), ", ".join(sql_double(float(b)) for b in coef)
        terms = f"aggregate(zip_with(array({values}), array({weights}), (v, b) -> v * b), {sql_double(intercept)}, (s, t) -> s + t)"
    return SQLTransformer(statement=f"SELECT *, {terms} AS {sql_name(prediction)} FROM __THIS__")


def is_exact(name: str, grid: Sequence[Mapping[str, Any]]) -> bool:
    """Whether all candidates of a learner follow from the same moments."""
    return name in ("Ridge", "ElasticNet") and all(p.get("solver", "exact") == "exact" for p in grid)


def solve_linear(name: str, params: Mapping[str, Any], sums: Moments) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of a ridge or elastic net; the label is the last column of the moments."""
    p = _take(name, params)
    return ridge(sums, float(p["alpha"])) if name == "Ridge" else elastic_net(sums, float(p["alpha"]), float(p["l1_ratio"]))


def _fit_linear(name, params, df, x, label, prediction) -> PipelineModel:
    """Ridge and elastic net, solved exactly on the moments of one scan; rows with a NULL are left out."""
    p = _take(name, params)
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    if p["solver"] == "l-bfgs" or any("udt" in kinds[c] for c in x):  # sparse columns have no small matrix
        join = VectorAssembler(inputCols=list(x), outputCol="__x")
        est = linear_estimator(df, "__x", label, prediction, float(p["alpha"]), float(p["l1_ratio"]) if "l1_ratio" in p else None)
        return PipelineModel([join, est.fit(join.transform(df)), SQLTransformer(statement="SELECT * EXCEPT (__x) FROM __THIS__")])
    if p["solver"] != "exact":
        raise ValueError(f"{name}: solver is exact or l-bfgs, not {p['solver']}")
    sums = total_moments(df, [*x, label])
    if not sums.n:
        raise ValueError(f"{name}: no rows to fit on")
    intercept, coef = solve_linear(name, params, sums)
    return PipelineModel([linear_stage(x, intercept, coef, prediction)])


def _cells(df: DataFrame, x: Sequence[str], label: str) -> DataFrame:
    """One row for all rows of equal ``x``: their number ``__rows`` and mean label, written once.

    Trees that split by squared error grow alike on rows and on weighted cells: no split parts a cell, so what the labels
    vary inside it adds the same to both sides of every gain. A missing label stays missing, for MLlib to refuse.
    """
    mean = F.when(F.count(label) == F.count("*"), F.avg(label))
    return stage_table(df.groupBy(*map(sql_name, x)).agg(F.count("*").cast("double").alias("__rows"), mean.alias(label)), "cells")


def _on_cells(tree, n_rows: int):
    """The estimator for cells of ``n_rows`` rows in all: the least rows of a leaf become their weight."""
    least = tree.getMinInstancesPerNode()
    if least > 1:  # half a row below, as weights are compared as a share of all rows
        tree.setMinInstancesPerNode(1).setMinWeightFractionPerNode(min((least - 0.5) / max(n_rows, 1), 0.4999999))
    return tree.setWeightCol("__rows")


def _bins(df: DataFrame, x: Sequence[str], bins: int, n_rows: int, seed: int) -> tuple[list, list[str]]:
    """(stages, their output columns): columns of more than ``bins`` values cut at quantiles, the others as they are.

    Cut points come from as many rows as MLlib takes them from; what falls between them is read off all rows.
    """
    counts = df.agg(*[F.approx_count_distinct(sql_name(c), 0.03).alias(f"n{i}") for i, c in enumerate(x)]).first()
    near = [i for i in range(len(x)) if 0.8 * bins < counts[f"n{i}"] <= 1.2 * bins]  # to be counted one by one
    sets = df.agg(*[F.size(F.collect_set(sql_name(x[i]))).alias(f"n{i}") for i in near]).first() if near else {}
    wide = [i for i in range(len(x)) if (sets[f"n{i}"] if i in near else counts[f"n{i}"]) > bins]
    if not wide:
        return [], list(x)
    some = df.select(*[sql_name(x[i]) for i in wide]).sample(min(1.0, SAMPLED_ROWS / n_rows), seed)
    probs = [i / bins for i in range(1, bins)]
    found = some.agg(*[f(sql_name(x[i])).alias(f"{n}{i}") for i in wide for n, f in (("lo", F.min), ("q", lambda c: F.percentile_approx(c, probs, 10_000)))]).first()
    names = [f"__piece{i}" if i in wide else c for i, c in enumerate(x)]
    cuts = [[-math.inf, *sorted({float(v) for v in found[f"q{i}"]} - {float(found[f"lo{i}"])}), math.inf] for i in wide]
    return [Bucketizer(splitsArray=cuts, inputCols=[x[i] for i in wide], outputCols=[names[i] for i in wide])], names


def _weighs_cells(est, df: DataFrame, x: Sequence[str]) -> bool:
    """Whether a tree learner draws no rows at random and its columns are plain numbers, so that it may grow on cells."""
    whole = not est.getBootstrap() if isinstance(est, RandomForestRegressor) else True
    kinds = dict(df.dtypes)
    return whole and est.getSubsamplingRate() == 1.0 and all(kinds[c] == "double" for c in x)


def _fit_on_cells(est, df: DataFrame, x: Sequence[str], label: str, n_rows: int) -> PipelineModel:
    """A tree learner on the cells of its bins: MLlib would bin the rows alike and pass all of them once for every level of every tree."""
    stages, names = _bins(df, x, est.getMaxBins(), n_rows, est.getSeed())
    cells = _cells(PipelineModel(stages).transform(df), names, label)
    join = VectorAssembler(inputCols=names, outputCol="__x")
    model = _on_cells(est, n_rows).fit(join.transform(cells))
    drop = ", ".join(["__x", *(c for c in names if c not in x)])
    return PipelineModel([*stages, join, model, SQLTransformer(statement=f"SELECT * EXCEPT ({drop}) FROM __THIS__")])


def _drawn_cells(rows: DataFrame, names: Sequence[str], label: str, trees: int, seed: int, counts: DataFrame, n_rows: int) -> DataFrame:
    """``__n<t>`` and ``__mean<t>`` for every tree t: how often a cell's rows were drawn for it, and their mean label; written once.

    Every row is drawn a Poisson number of times with mean 1 for every tree, as MLlib draws with replacement. Rows meet by
    cell, those of a cell of more than ``DRAWN_ROWS`` rows in pieces by label; a cell may take up more than one row here.
    The same rows give the same draws: a task draws in the order of its cells and labels.
    """
    large = counts.where(F.col("__rows") > DRAWN_ROWS).select(*names, F.ceil(F.col("__rows") / DRAWN_ROWS).alias("__pieces"))
    piece = F.lit(0)
    if not large.isEmpty():
        rows, piece = null_safe_join(rows, sized(large), names, "left"), F.pmod(F.xxhash64(label), F.coalesce("__pieces", F.lit(1)))
    src = rows.select(*[F.col(c).alias(f"__x{i}") for i, c in enumerate(names)], F.col(label).cast("double").alias("__y"), piece.alias("__piece"))
    order = [f"__x{i}" for i in range(len(names))]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in order])
            starts = np.concatenate([[0], np.flatnonzero((x[:, 1:] != x[:, :-1]).any(axis=0)) + 1])
            taken = rng.poisson(1.0, (trees, b.num_rows))
            n = np.add.reduceat(taken, starts, axis=1)
            sums = np.add.reduceat(taken * b.column("__y").to_numpy(zero_copy_only=False), starts, axis=1)
            cols = [*x[:, starts], *n.astype(np.int32), *(sums / np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[f"c{i}" for i in range(len(cols))])

    spec = ", ".join([f"c{i} {'int' if len(names) <= i < len(names) + trees else 'double'}" for i in range(len(names) + 2 * trees)])
    met = src.repartition(max(1, math.ceil(n_rows / DRAWN_ROWS)), *order, "__piece").sortWithinPartitions(*order, "__y")
    out = [*names, *(f"__n{t}" for t in range(trees)), *(f"__mean{t}" for t in range(trees))]
    return stage_table(met.mapInArrow(draw, spec).toDF(*out), "drawn")


def _draws_cells(est, df: DataFrame, x: Sequence[str]) -> bool:
    """Whether a tree learner is a forest with bootstrap over columns of plain numbers."""
    kinds = dict(df.dtypes)
    return isinstance(est, RandomForestRegressor) and est.getBootstrap() and est.getSubsamplingRate() == 1.0 and all(kinds[c] == "double" for c in x)


def _mean_of_trees(trees: Sequence[DecisionTreeRegressionModel], features: str, prediction: str) -> GBTRegressionModel:
    """One model for the mean of the trees, in one pass of a row; MLlib makes no forest of given trees, but a weighted sum of them."""
    jvm, name = SparkSession.active().sparkContext._jvm, "org.apache.spark.ml.regression"
    members = JavaWrapper._new_java_array([t._java_obj for t in trees], jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel)
    weights = JavaWrapper._new_java_array([1.0 / len(trees)] * len(trees), jvm.double)
    model = GBTRegressionModel(JavaWrapper._new_java_obj(f"{name}.GBTRegressionModel", f"mean_{uuid.uuid4().hex}", members, weights))
    return model.setFeaturesCol(features).setPredictionCol(prediction)


def _fit_bagged_on_cells(est: RandomForestRegressor, df: DataFrame, x: Sequence[str], label: str, n_rows: int) -> PipelineModel | None:
    """A forest with bootstrap on the cells of its bins; None where these are not far fewer than the rows.

    MLlib holds a count for every row and tree and passes all of them for every level. Here every row is drawn once for each
    tree, its draws are added up by cell, and every tree grows on its own weighted cells: the splits are those of the drawn rows.
    """
    stages, names = _bins(df, x, est.getMaxBins(), n_rows, est.getSeed())
    rows = PipelineModel(stages).transform(df).select(*map(sql_name, names), sql_name(label))
    counts = stage_table(rows.groupBy(*map(sql_name, names)).agg(F.count("*").alias("__rows")), "cells")
    if counts.count() > BAGGED_SHARE * n_rows:
        return None
    join = VectorAssembler(inputCols=names, outputCol="__x")
    trees: list = []
    while len(trees) < est.getNumTrees():
        size = min(DRAWN_TREES, est.getNumTrees() - len(trees))
        drawn = _drawn_cells(rows, names, label, size, est.getSeed() + len(trees), counts, n_rows)
        totals = drawn.agg(F.count("*").alias("cells"), *[F.sum(f"__n{t}").alias(f"n{t}") for t in range(size)]).first()
        held = drawn.coalesce(1) if totals["cells"] <= TASK_CELLS else drawn

        def grow(t: int):
            tree = DecisionTreeRegressor(
                featuresCol="__x",
                labelCol=label,
                maxDepth=est.getMaxDepth(),
                minInstancesPerNode=est.getMinInstancesPerNode(),
                maxBins=est.getMaxBins(),
                maxMemoryInMB=est.getMaxMemoryInMB(),
            )
            cells = held.where(F.col(f"__n{t}") > 0).select(*map(sql_name, names), F.col(f"__n{t}").cast("double").alias("__rows"), F.col(f"__mean{t}").alias(label))
            return _on_cells(tree, totals[f"n{t}"]).fit(join.transform(cells))

        with ThreadPoolExecutor(PARALLEL_TREES) as pool:
            trees += pool.map(grow, range(size))
    drop = ", ".join(["__x", *(c for c in names if c not in x)])
    return PipelineModel([*stages, join, _mean_of_trees(trees, "__x", est.getPredictionCol()), SQLTransformer(statement=f"SELECT * EXCEPT ({drop}) FROM __THIS__")])


def _random_cuts(rng: np.random.Generator, row, k: int, n: int) -> list[list[float]]:
    """Per feature, sorted uniform cut points inside its range."""
    out = []
    for i in range(k):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        cuts = np.unique(rng.uniform(lo, hi, n)) if hi > lo else np.array([lo])
        out.append([-math.inf, *[float(v) for v in cuts], math.inf])
    return out


def _fit_extra_trees(params, df, x, label, prediction, seed) -> PipelineModel:
    """Trees on randomly cut features: per tree, every feature is cut at uniform
    random points of its range and a tree grows on the piece numbers, without
    bootstrap. Cuts are random per tree, not per node. Each tree reads the rows
    once, into cells of equal pieces: the passes of its growth and what it holds
    in memory follow the number of cells, which the cuts bound."""
    p = _take("ExtraTreesRegressor", params)
    ends = [f(c).alias(f"{n}{i}") for i, c in enumerate(x) for n, f in (("lo", F.min), ("hi", F.max))]
    row = df.agg(F.count("*").alias("n"), *ends).first()
    rng = np.random.default_rng(seed)
    cuts_of = [_random_cuts(rng, row, len(x), int(p["n_cuts"])) for _ in range(int(p["n_estimators"]))]

    def grow(t: int) -> list:
        pieces = [f"__piece{i}" for i in range(len(x))]
        cut = Bucketizer(splitsArray=cuts_of[t], inputCols=list(x), outputCols=pieces, handleInvalid="keep")
        join = VectorAssembler(inputCols=pieces, outputCol="__pieces")
        tree = DecisionTreeRegressor(
            featuresCol="__pieces",
            labelCol=label,
            predictionCol=f"__tree{t}",
            maxDepth=_depth(p["max_depth"]),
            minInstancesPerNode=int(p["min_samples_leaf"]),
            maxBins=max(int(p["n_cuts"]) + 2, 4),
            maxMemoryInMB=TREE_MEMORY_MB,
        )
        cells = _cells(cut.transform(df), pieces, label)
        model = _on_cells(tree, row["n"]).fit(join.transform(cells))
        tidy = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join([*pieces, '__pieces'])}) FROM __THIS__")
        return [cut, join, model, tidy]

    with ThreadPoolExecutor(PARALLEL_TREES) as pool:
        stages = [stage for part in pool.map(grow, range(len(cuts_of))) for stage in part]
    names = [f"__tree{t}" for t in range(len(cuts_of))]
    mean = f"({' + '.join(names)}) / {len(names)}"
    stages.append(
        SQLTransformer(
            statement=f"SELECT * EXCEPT ({', '.join(names)}), {mean} AS {sql_name(prediction)} FROM __THIS__"
        )
    )
    return PipelineModel(stages)


def _fit_svr(params, df, x, label, prediction, seed) -> PipelineModel:
    """Stand-in for RBF support-vector regression: random Fourier features and a
    Huber loss, solved over scans that hold no row. Kernel and loss are
    approximations; epsilon is ignored."""
    p = _take("SVR", params)
    rng = np.random.default_rng(seed)
    d = int(p["n_components"])
    w = rng.normal(0.0, math.sqrt(2 * float(p["gamma"])), (d, len(x)))
    b = rng.uniform(0.0, 2 * math.pi, d)
    n, _ = _label_stats(df, label)
    intercept, coef = fit_huber(df, x, label, w, b, 1.0 / (float(p["C"]) * max(n, 1)))
    waves = []
    for j in range(d):
        inner = " + ".join(f"{sql_double(float(w[j, i]))} * {sql_name(c)}" for i, c in enumerate(x))
        waves.append(f"cos({inner} + {sql_double(float(b[j]))}) AS __wave{j}")
    names = [f"__wave{j}" for j in range(d)]
    expand = SQLTransformer(statement=f"SELECT *, {', '.join(waves)} FROM __THIS__")
    line = linear_stage(names, intercept, coef, prediction)
    missing = f"{sql_name(prediction)} IS NULL OR isnan({sql_name(prediction)})"
    whole = f"CASE WHEN {missing} THEN raise_error('SVR: missing values in the features') ELSE {sql_name(prediction)} END"
    tidy = SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join([*names, sql_name(prediction)])}), {whole} AS {sql_name(prediction)} FROM __THIS__")
    return PipelineModel([expand, line, tidy])


def fit_learner(
    name: str,
    params: Mapping[str, Any],
    df: DataFrame,
    x: Sequence[str],
    label: str = "y",
    prediction: str = "prediction",
    seed: int = 42,
) -> PipelineModel:
    """Fit one learner on double columns ``x``; the result adds ``prediction`` and can be saved."""
    if name not in DEFAULTS:
        raise KeyError(f"unknown learner: {name}")
    if name == "ExtraTreesRegressor":
        return _fit_extra_trees(params, df, x, label, prediction, seed)
    if name == "SVR":
        return _fit_svr(params, df, x, label, prediction, seed)
    if name in ("Ridge", "ElasticNet"):
        return _fit_linear(name, params, df, x, label, prediction)
    join = VectorAssembler(inputCols=list(x), outputCol="__x")
    est = tree_estimator(name, params, seed)
    est.setFeaturesCol("__x").setLabelCol(label).setPredictionCol(prediction)
    if _weighs_cells(est, df, x):
        n_rows = df.count()
        if n_rows > SAMPLED_ROWS:
            return _fit_on_cells(est, df, x, label, n_rows)
    if _draws_cells(est, df, x):
        found = df.agg(F.count("*").alias("n"), F.count_if(F.col(label).isNull() | F.isnan(label)).alias("missing")).first()
        # A missing label is for MLlib to refuse.
        model = _fit_bagged_on_cells(est, df, x, label, found["n"]) if found["n"] > BAGGED_ROWS and not found["missing"] else None
        if model is not None:
            return model
    model = est.fit(join.transform(df))
    tidy = SQLTransformer(statement="SELECT * EXCEPT (__x) FROM __THIS__")
    return PipelineModel([join, model, tidy])
