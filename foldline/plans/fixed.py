"""Training without search: one stack per target from given parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from foldline.operators.reports import holdout_report
from foldline.operators.roles import as_target, column_roles
from foldline.operators.space import Preset, stack_from
from foldline.operators.stack import StackModel, fit_preprocessed_stack


def fit_with_params(
    rows: DataFrame,
    features: Mapping[str, Sequence[str]],
    params: Mapping[str, Mapping[str, float]],
    preset: Preset,
    key: str,
    inner: int = 5,
    log: Sequence[str] = (),
    exp: Sequence[str] = (),
    staged: bool = False,
) -> tuple[dict[str, StackModel], DataFrame]:
    """Fit every target on the rows marked 'train'; returns the models and the hold-out report. ``staged``: the rows come from files."""
    lost = [t for t in features if t not in params]
    if lost:
        raise ValueError(f"no parameters for targets: {lost}")
    models: dict[str, StackModel] = {}
    parts = []
    for target, cols in features.items():
        table = as_target(rows, target)
        roles = column_roles(rows, cols, log, exp)
        stack = stack_from(preset, params[target], inner)
        models[target] = fit_preprocessed_stack(table.where(F.col("dataset") == "train"), roles, stack, key, staged=staged)
        scored = models[target].transform(table)
        parts.append(scored.select(F.lit(target).alias("target"), "dataset", "y", F.col("prediction").alias("p")))
    return models, holdout_report(reduce(DataFrame.unionByName, parts))
