"""Regression scores as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

METRICS = ("MAE", "RMSE", "R2")


def metric_columns(y: str = "y", p: str = "p") -> list[Column]:
    """MAE, RMSE and R2 in one pass.

    R2 of a constant label is 1 if every prediction is exact, else 0; R2 of a
    single row is undefined.
    """
    err = F.col(y) - F.col(p)
    sse = F.sum(err * err)
    n = F.count(F.when(err.isNotNull(), 1))
    sst = F.var_pop(F.when(err.isNotNull(), F.col(y))) * n
    r2 = (
        F.when(n < 2, F.lit(None).cast("double"))
        .when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(1 - sse / sst)
    )
    return [F.avg(F.abs(err)).alias("MAE"), F.sqrt(F.avg(err * err)).alias("RMSE"), r2.alias("R2")]


def regression_metrics(pred: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    return pred.groupBy(*by).agg(*metric_columns(y, p))


def fold_means(fold_scores: DataFrame, by: Sequence[str] = (), metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean of the fold scores (not of the pooled rows)."""
    return fold_scores.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])
