"""One boosted-tree model per usable target, searched by cross-validation."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from foldline.functions.metrics import METRICS, regression_metrics
from foldline.operators.roles import as_target, column_roles, dtypes_of, features_by_target, usable_targets
from foldline.operators.search import cv_search
from foldline.operators.space import XGB_SPACE, Param, sample_params
from foldline.operators.splits import with_folds, with_split
from foldline.session import stage_table
from foldline.sources.bundle import Bundle, TargetMeta


def search_single_models(
    df: DataFrame,
    columns: Sequence[str],
    targets: Sequence[str],
    key: str,
    learner: str = "XGBRegressor",
    space: Sequence[Param] = tuple(XGB_SPACE),
    n_trials: int = 30,
    folds: int = 5,
    seed: int = 42,
    exclusions: Mapping[str, Sequence[str]] | None = None,
    log: Sequence[str] = (),
    exp: Sequence[str] = (),
) -> tuple[Bundle, DataFrame]:
    """Models and one score row per (target, model), sorted.

    Targets with fewer than three distinct values are left out. ``cv_best_score``
    is the negative mean absolute error over the folds.
    """
    rows = df.select(*dict.fromkeys([key, *columns, *targets]))
    rows = stage_table(with_folds(with_split(rows, key, seed=seed), key, folds, seed + 1), "single", ["dataset"])
    features = features_by_target(columns, targets, exclusions)
    models: dict[str, PipelineModel] = {}
    meta: dict[str, TargetMeta] = {}
    parts: list[DataFrame] = []
    for target in usable_targets(rows, targets):
        table = as_target(rows, target)
        train = table.where((F.col("dataset") == "train") & F.col("y").isNotNull())
        start = time.perf_counter()
        grid = [sample_params(space, i, seed, target) for i in range(n_trials)]
        found, scores, best = cv_search(train, column_roles(rows, features[target], log, exp), learner, grid, k=folds)
        seconds = round(time.perf_counter() - start, 3)
        models[target] = found
        meta[target] = TargetMeta(features[target], dtypes_of(rows, features[target]), grid[best])
        test = models[target].transform(table.where(F.col("dataset") == "test")).withColumn("p", F.col("prediction"))
        parts.append(
            regression_metrics(test).select(
                F.lit(target).alias("target"),
                F.lit(learner).alias("model"),
                *METRICS,
                F.lit(scores[best]).alias("cv_best_score"),
                F.create_map(*[F.lit(v) for kv in grid[best].items() for v in (kv[0], float(kv[1]))]).alias("best_params"),
                F.lit(n_trials).alias("n_trials"),
                F.lit(seconds).alias("fit_sec"),
                F.lit(len(features[target])).alias("n_features"),
            )
        )
    if not parts:
        raise ValueError("no usable target")
    return Bundle(models, meta), reduce(DataFrame.unionByName, parts).orderBy("target", "model")
