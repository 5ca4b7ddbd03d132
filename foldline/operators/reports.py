"""Report tables: the data behind each score table and chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, Window as W

from foldline.functions.metrics import METRICS, regression_metrics
from foldline.operators.scans import null_safe_join
from foldline.operators.studies import COMPLETE, in_state
from foldline.session import sized


def holdout_report(pred: DataFrame) -> DataFrame:
    """(target, dataset, MAE, RMSE, R2) from long predictions."""
    return regression_metrics(pred, ["target", "dataset"]).select("target", "dataset", *METRICS)


def test_metrics(report: DataFrame) -> DataFrame:
    """Test rows of a report, one row per (target, metric), sorted by target."""
    rows = report.where(F.col("dataset") == "test")
    return rows.unpivot(["target"], list(METRICS), "metric", "score").orderBy("target", "metric")


def compare_models(*parts: DataFrame) -> DataFrame:
    """Score rows of several models, sorted by (target, model)."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("target", "model")


def parity_extents(pred: DataFrame, by: Sequence[str] = ("target", "dataset")) -> DataFrame:
    """Common axis limits of actual and predicted values."""
    return pred.groupBy(*by).agg(
        F.least(F.min("y"), F.min("p")).alias("low"), F.greatest(F.max("y"), F.max("p")).alias("high")
    )


def residual_rows(pred: DataFrame) -> DataFrame:
    return pred.withColumn("residual", F.col("y") - F.col("p"))


def residual_histogram(pred: DataFrame, bins: int = 30, by: Sequence[str] = ("target", "dataset")) -> DataFrame:
    """Counts in ``bins`` equal bins between the smallest and the largest residual; the last bin is closed."""
    rows = residual_rows(pred).where(F.col("residual").isNotNull())
    ends = rows.groupBy(*by).agg(F.min("residual").alias("lo"), F.max("residual").alias("hi"))
    width = F.col("hi") - F.col("lo")
    place = F.when(width > 0, F.floor((F.col("residual") - F.col("lo")) / width * bins)).otherwise(F.lit(bins // 2))
    binned = null_safe_join(rows, sized(ends), by).withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
    return binned.groupBy(*by, "bin").agg(
        F.count("*").alias("n"),
        F.min(F.col("lo") + F.col("bin") * width / bins).alias("left"),
    )


def _long_params(trials: DataFrame, by: Sequence[str]) -> DataFrame:
    done = trials.where(in_state(COMPLETE) & F.col("value").isNotNull())
    return done.select(*by, "trial", "value", F.explode("params").alias("param", "pvalue"))


def param_slice(trials: DataFrame, by: Sequence[str] = ("study",)) -> DataFrame:
    """One row per COMPLETE trial and parameter: (param, pvalue, value)."""
    return _long_params(trials, by)


def param_importance(trials: DataFrame, by: Sequence[str] = ("study",)) -> DataFrame:
    """Absolute correlation of each parameter with the value; 0 where either is constant."""
    spread = F.stddev_pop("pvalue") * F.stddev_pop("value")
    strength = F.abs(F.try_divide(F.covar_pop("pvalue", "value"), spread))
    return _long_params(trials, by).groupBy(*by, "param").agg(
        F.coalesce(strength, F.lit(0.0)).alias("importance"), F.count("*").alias("n_trials")
    )


def top_params(trials: DataFrame, by: Sequence[str] = ("study",), n: int = 2) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.desc("importance"), "param")
    ranked = param_importance(trials, by).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= n)


def param_contour(trials: DataFrame, by: Sequence[str] = ("study",), bins: int = 5) -> DataFrame:
    """Mean value per cell of the two most important parameters of each study."""
    top = top_params(trials, by).groupBy(*by).agg(
        F.min_by("param", "rank").alias("px"), F.max_by("param", "rank").alias("py"), F.count("*").alias("k")
    )
    done = trials.where(in_state(COMPLETE) & F.col("value").isNotNull())
    rows = null_safe_join(done, sized(top.where(F.col("k") == 2).drop("k")), by).select(
        *by, "px", "py", "value",
        F.element_at("params", F.col("px")).alias("x"),
        F.element_at("params", F.col("py")).alias("y"),
    )
    ends = rows.groupBy(*by).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )

    def cell(v: str, lo: str, hi: str):
        width = F.col(hi) - F.col(lo)
        return F.when(width > 0, F.least(F.floor((F.col(v) - F.col(lo)) / width * bins), F.lit(bins - 1))).otherwise(0)

    binned = null_safe_join(rows, sized(ends), by)
    return binned.groupBy(
        *by, "px", "py", cell("x", "x0", "x1").cast("int").alias("bx"), cell("y", "y0", "y1").cast("int").alias("by")
    ).agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))


def intermediate_values(steps: DataFrame, trials: DataFrame) -> DataFrame:
    """Reported values with the final state of their trial."""
    return steps.join(trials.select("study", "trial", "state"), ["study", "trial"])
