"""Linear models from sums of products: one scan for all groups, folds and penalties."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T


def _pairs(x: Sequence[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(x)) for j in range(i, len(x))]


def sum_columns(x: Sequence[str]) -> list[str]:
    k = len(x)
    return ["n", "sy", "syy", *[f"s_{i}" for i in range(k)], *[f"q_{i}" for i in range(k)], *[f"p_{i}_{j}" for i, j in _pairs(x)]]


def gram(df: DataFrame, x: Sequence[str], y: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts, sums and sums of products per ``by``; rows with a NULL are left out.

    Expects columns near [0, 1] (as the preprocessor makes them): the solver
    subtracts means from raw sums.
    """
    ok = df.where(F.col(y).isNotNull())
    for c in x:
        ok = ok.where(F.col(c).isNotNull())
    aggs = [F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy")]
    aggs += [F.sum(c).alias(f"s_{i}") for i, c in enumerate(x)]
    aggs += [F.sum(F.col(c) * F.col(y)).alias(f"q_{i}") for i, c in enumerate(x)]
    aggs += [F.sum(F.col(x[i]) * F.col(x[j])).alias(f"p_{i}_{j}") for i, j in _pairs(x)]
    return ok.groupBy(*by).agg(*aggs)


def outside_fold(sums: DataFrame, x: Sequence[str], fold: str, by: Sequence[str] = ()) -> DataFrame:
    """Per fold, the sums over all other folds: total minus own."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return sums.select(*by, fold, *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in sum_columns(x)])


def _centered(pdf: pd.DataFrame, k: int) -> tuple[np.ndarray, ...]:
    n = pdf["n"].to_numpy(float)
    mean = np.stack([pdf[f"s_{i}"].to_numpy(float) for i in range(k)], 1) / n[:, None]
    ybar = pdf["sy"].to_numpy(float) / n
    xx = np.empty((len(pdf), k, k))
    for i in range(k):
        for j in range(i, k):
            xx[:, i, j] = xx[:, j, i] = pdf[f"p_{i}_{j}"].to_numpy(float)
    xx -= n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    xy = np.stack([pdf[f"q_{i}"].to_numpy(float) for i in range(k)], 1) - n[:, None] * mean * ybar[:, None]
    return n, mean, ybar, xx, xy


def _solve(sums: DataFrame, k: int, keys: Sequence[str], penalties: list[dict[str, float]], solver) -> DataFrame:
    schema = T.StructType(
        [sums.schema[c] for c in keys]
        + [T.StructField(p, T.DoubleType()) for p in penalties[0]]
        + [T.StructField("intercept", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType()))]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            n, mean, ybar, xx, xy = _centered(pdf, k)
            for penalty in penalties:
                w = solver(n, xx, xy, **penalty)
                out = pdf[list(keys)].copy()
                for name, value in penalty.items():
                    out[name] = value
                out["intercept"] = ybar - (mean * w).sum(1)
                out["coef"] = list(w)
                yield out

    return sums.where(F.col("n") > 0).mapInPandas(run, schema)


def _ridge(n: np.ndarray, xx: np.ndarray, xy: np.ndarray, alpha: float) -> np.ndarray:
    k = xx.shape[1]
    lhs = xx + alpha * np.eye(k)
    try:
        return np.linalg.solve(lhs, xy[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        return np.stack([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(lhs, xy)])


def _elastic_net(n: np.ndarray, xx: np.ndarray, xy: np.ndarray, alpha: float, l1_ratio: float) -> np.ndarray:
    """Coordinate descent on the sums, all rows of the batch at once."""
    k = xx.shape[1]
    w = np.zeros_like(xy)
    l1, l2 = alpha * l1_ratio * n, alpha * (1 - l1_ratio) * n
    for _ in range(10_000):
        step = 0.0
        for i in range(k):
            rho = xy[:, i] - (xx[:, i, :] * w).sum(1) + xx[:, i, i] * w[:, i]
            den = xx[:, i, i] + l2
            new = np.where(den > 0, np.sign(rho) * np.maximum(np.abs(rho) - l1, 0) / np.where(den > 0, den, 1), 0.0)
            step = max(step, float(np.abs(new - w[:, i]).max()))
            w[:, i] = new
        if step <= 1e-12 * max(1.0, float(np.abs(w).max())):
            break
    return w


def solve_ridge(sums: DataFrame, x: Sequence[str], alphas: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, alpha, intercept, coef) for every row of sums and every alpha; the intercept is not penalised."""
    return _solve(sums, len(x), keys, [{"alpha": float(a)} for a in alphas], _ridge)


def solve_elastic_net(
    sums: DataFrame, x: Sequence[str], penalties: Sequence[tuple[float, float]], keys: Sequence[str] = ()
) -> DataFrame:
    """The same for pairs (alpha, l1_ratio)."""
    grid = [{"alpha": float(a), "l1_ratio": float(r)} for a, r in penalties]
    return _solve(sums, len(x), keys, grid, _elastic_net)


def linear_prediction(x: Sequence[str], intercept: Column, coef: Column) -> Column:
    """intercept + coef . x with the coefficients in an array column."""
    out = intercept
    for i, c in enumerate(x):
        out = out + F.get(coef, F.lit(i)) * F.col(c)
    return out
