"""One linear model per group, all groups in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from foldline.operators.gram import gram, linear_prediction, outside_fold, solve_ridge
from foldline.operators.scans import null_safe_join
from foldline.operators.studies import best_group
from foldline.session import sized

MIN_GROUP_ROWS = 7  # five outer folds of five inner folds need seven rows
FULL_BUDGET_ROWS = 25


def group_sizes(df: DataFrame, keys: Sequence[str], n_trials: int = 30, small_trials: int = 10) -> DataFrame:
    """Rows per group and its trial budget: groups of 25 rows or fewer get the small one."""
    sized = df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    budget = F.when(F.col("n_rows") > FULL_BUDGET_ROWS, F.lit(n_trials)).otherwise(F.lit(small_trials))
    return sized.withColumn("n_trials", budget)


def fit_groups(
    df: DataFrame, x: Sequence[str], y: str, keys: Sequence[str], alpha: float = 1.0, min_rows: int = MIN_GROUP_ROWS
) -> DataFrame:
    """(keys, n, intercept, coef) per group of at least ``min_rows`` rows."""
    sums = gram(df, x, y, keys).where(F.col("n") >= min_rows)
    return solve_ridge(sums, x, [alpha], [*keys, "n"]).drop("alpha")


def fit_global(df: DataFrame, x: Sequence[str], y: str, alpha: float = 1.0) -> tuple[float, list[float]]:
    """Intercept and coefficients over all rows."""
    row = solve_ridge(gram(df, x, y), x, [alpha]).first()
    return row["intercept"], list(row["coef"])


def route_to_group(
    df: DataFrame,
    models: DataFrame,
    keys: Sequence[str],
    x: Sequence[str],
    fallback: tuple[float, Sequence[float]],
    name: str = "p",
) -> DataFrame:
    """Score each row with its group's model, or the global one where there is none.

    A left equi join on the group keys; Spark broadcasts the models when they
    are small and splits skewed groups otherwise.
    """
    joined = null_safe_join(df, sized(models.select(*keys, "intercept", "coef")), keys, "left")
    intercept = F.coalesce(F.col("intercept"), F.lit(fallback[0]))
    coef = F.coalesce(F.col("coef"), F.array(*[F.lit(float(v)) for v in fallback[1]]))
    return (
        joined.withColumn(name, linear_prediction(x, intercept, coef))
        .withColumn("routed", F.when(F.col("coef").isNotNull(), "group").otherwise("global"))
        .drop("intercept", "coef")
    )


def cv_scores_by_alpha(
    df: DataFrame, x: Sequence[str], y: str, fold: str, alphas: Sequence[float], keys: Sequence[str] = (),
    min_rows: int = 1,
) -> DataFrame:
    """(keys, alpha, fold, mae) for every group, fold and penalty from two scans.

    One scan sums products per (group, fold), the other measures all penalties
    side by side as separate columns, so rows are not multiplied.
    """
    sums = gram(df, x, y, [*keys, fold])
    big = outside_fold(sums, x, fold, keys)
    solved = solve_ridge(big.where(F.col("n") >= min_rows), x, alphas, [*keys, fold])
    one = F.struct("alpha", "intercept", "coef")
    models = solved.groupBy(*keys, fold).agg(F.array_sort(F.collect_list(one)).alias("models"))
    rows = null_safe_join(df.select(*keys, fold, y, *x), sized(models), [*keys, fold])
    ordered = sorted(float(a) for a in alphas)
    errors = []
    for i in range(len(ordered)):
        m = F.get(F.col("models"), F.lit(i))
        errors.append(F.avg(F.abs(F.col(y) - linear_prediction(x, m["intercept"], m["coef"]))).alias(f"e{i}"))
    wide = rows.groupBy(*keys, fold).agg(*errors)
    pairs = F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"e{i}").alias("mae")) for i, a in enumerate(ordered)])
    return wide.select(*keys, fold, F.explode(pairs).alias("s")).select(*keys, fold, "s.alpha", "s.mae")


def tune_alpha(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, alpha, mae): mean of the fold errors per penalty."""
    return scores.groupBy(*keys, "alpha").agg(F.avg("mae").alias("mae"))


def tune_by_group(
    df: DataFrame, x: Sequence[str], y: str, keys: Sequence[str], fold: str, alphas: Sequence[float],
    min_rows: int = MIN_GROUP_ROWS,
) -> DataFrame:
    """Best penalty per group: (keys, alpha, mae), smallest penalty on ties."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= min_rows)
    means = tune_alpha(cv_scores_by_alpha(df, x, y, fold, alphas, keys), keys)
    best = means.groupBy(*keys).agg(F.min_by(F.struct("alpha", "mae"), F.struct("mae", "alpha")).alias("b"))
    return null_safe_join(best, sizes, keys).select(*keys, "n_rows", "b.*")


def winning_group(tuned: DataFrame, target: str, keys: Sequence[str]) -> DataFrame:
    """The group whose penalty the final model of the target takes."""
    return best_group(tuned.withColumn("target", F.lit(target)), "target", "mae", keys, ["alpha"])
