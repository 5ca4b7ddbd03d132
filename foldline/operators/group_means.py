"""Group means as a base learner: its out-of-fold form needs no refit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from foldline.operators.scans import null_safe_join
from foldline.session import sized


def oof_group_mean(df: DataFrame, keys: Sequence[str], y: str, fold: str, name: str) -> DataFrame:
    """Mean label of the row's group over the other folds.

    Sums per (group, fold) are formed once; a fold's complement is the group
    total less its own part. Groups seen in one fold only take the mean of all
    rows outside that fold.
    """
    parts = df.groupBy(*keys, fold).agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
    w = W.partitionBy(*keys)
    outside = parts.select(
        *keys,
        fold,
        (F.sum("__s").over(w) - F.col("__s")).alias("__so"),
        (F.sum("__n").over(w) - F.col("__n")).alias("__no"),
    )
    totals = df.groupBy(fold).agg(F.sum(y).alias("s"), F.count(y).alias("n")).collect()  # one row per fold
    s, n = sum(r["s"] or 0.0 for r in totals), sum(r["n"] for r in totals)
    general = F.lit(None).cast("double")
    for r in totals:
        if n > r["n"]:
            general = F.when(F.col(fold) == r[fold], F.lit((s - (r["s"] or 0.0)) / (n - r["n"]))).otherwise(general)
    own = F.when(F.col("__no") > 0, F.col("__so") / F.col("__no"))
    joined = null_safe_join(df, sized(outside), [*keys, fold])
    return joined.withColumn(name, F.coalesce(own, general)).drop("__so", "__no")


def fit_group_mean(df: DataFrame, keys: Sequence[str], y: str) -> tuple[DataFrame, float]:
    """(keys, mean) over all rows, and the mean of everything."""
    means = df.groupBy(*keys).agg(F.avg(y).alias("mean"))
    return means, df.agg(F.avg(y)).first()[0]


def predict_group_mean(df: DataFrame, model: tuple[DataFrame, float], keys: Sequence[str], name: str) -> DataFrame:
    means, general = model
    joined = null_safe_join(df, sized(means), keys, "left")
    return joined.withColumn(name, F.coalesce(F.col("mean"), F.lit(general))).drop("mean")
