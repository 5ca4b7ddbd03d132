"""Stacks of linear members from sums of products: no rows are read to fit one.

The out-of-fold predictions of a linear base are linear in the features inside
every inner fold, so the meta model's sums follow from the features' sums by
inner fold. A whole stack is one linear function of the features.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foldline.operators.gram import linear_prediction
from foldline.operators.groups import FULL_BUDGET_ROWS, MIN_GROUP_ROWS
from foldline.operators.moments import Moments, moments
from foldline.operators.preprocess import Preprocessor
from foldline.operators.scans import null_safe_join
from foldline.operators.space import Preset, params_for
from foldline.operators.splits import with_folds, with_folds_by_group
from foldline.operators.stack import INNER_SEED_OFFSET
from foldline.session import drop_staged, sized, stage_table


@dataclass(frozen=True)
class LinearStack:
    """Ridge members by their columns' places and penalties; meta penalty; whether the meta model sees the features."""

    bases: Sequence[tuple[Sequence[int], float]]
    meta_alpha: float
    passthrough: bool = False


def raw_sums(m: Moments, center: np.ndarray) -> np.ndarray:
    """Sums of products of (1, columns - center)."""
    gap = m.mean - center
    inner = m.products + m.n * np.outer(gap, gap)
    return np.block([[np.full((1, 1), float(m.n)), m.n * gap[None]], [m.n * gap[:, None], inner]])


def _ridge(sums: np.ndarray, places: Sequence[int], alpha: float) -> np.ndarray:
    """(constant, coefficients of all features) for a stack of sums matrices; the last column is the label. No rows: zeros."""
    n = np.maximum(sums[..., 0, 0], 1)[..., None]
    mean = sums[..., 0, 1:] / n
    spread = sums[..., 1:, 1:] - n[..., None] * mean[..., :, None] * mean[..., None, :]
    at = np.asarray(places, int)
    xx = spread[..., at[:, None], at] + alpha * np.eye(len(at))
    xy = spread[..., at, -1]
    try:
        w = np.linalg.solve(xx, xy[..., None])[..., 0]
    except np.linalg.LinAlgError:
        w = (np.linalg.pinv(xx, hermitian=True) @ xy[..., None])[..., 0]
    out = np.zeros((*sums.shape[:-2], sums.shape[-1] - 1))
    out[..., 1 + at] = w
    out[..., 0] = mean[..., -1] - (mean[..., at] * w).sum(-1)
    return out


def stack_function(cells: np.ndarray, stack: LinearStack) -> np.ndarray:
    """(constant, coefficients) of the stack fitted on the rows of all inner folds; cells[..., j]: the sums of inner fold j."""
    total = cells.sum(axis=-3)
    rest = total[..., None, :, :] - cells
    k = cells.shape[-1]
    n_inputs = len(stack.bases) + (k - 2 if stack.passthrough else 0)
    to_meta = np.zeros((*cells.shape[:-2], n_inputs + 2, k))  # (1, base predictions, features, label) of (1, features, label)
    to_meta[..., 0, 0] = to_meta[..., -1, -1] = 1
    whole = np.zeros((*total.shape[:-2], n_inputs, k - 1))
    for b, (places, alpha) in enumerate(stack.bases):
        to_meta[..., 1 + b, :-1] = _ridge(rest, places, alpha)
        whole[..., b, :] = _ridge(total, places, alpha)
    for f in range(k - 2 if stack.passthrough else 0):
        to_meta[..., 1 + len(stack.bases) + f, 1 + f] = 1
        whole[..., len(stack.bases) + f, 1 + f] = 1
    meta = _ridge((to_meta @ cells @ np.swapaxes(to_meta, -1, -2)).sum(axis=-3), range(n_inputs), stack.meta_alpha)
    out = (meta[..., None, 1:] @ whole)[..., 0, :]
    out[..., 0] += meta[..., 0]
    return out


def uncentred(function: np.ndarray, center: np.ndarray) -> np.ndarray:
    """The same function of the columns themselves; the last of ``center`` is the label's."""
    out = function.copy()
    out[..., 0] += center[-1] - (function[..., 1:] * center[:-1]).sum(-1)
    return out


def is_linear(preset: Preset) -> bool:
    return all(learner == "Ridge" for _, learner in [*preset.bases, preset.meta])


def stack_of(preset: Preset, params: Mapping[str, float], n_features: int) -> LinearStack:
    alpha = lambda alias: float(params_for(alias, params).get("alpha", 1.0))
    return LinearStack([(range(n_features), alpha(a)) for a, _ in preset.bases], alpha(preset.meta[0]), preset.passthrough)


class LinearFolds:
    """Scores stacks of a linear preset on one outer fold, any number of them in one scan of that fold's rows.

    Every outer fold's rows are scaled by the statistics of the rows outside
    it, which are dealt into exact inner folds as ``Stack.fit`` does. Their
    sums, one small matrix for each pair of folds, serve all trials.
    """

    def __init__(self, rows: DataFrame, roles: Mapping[str, str], preset: Preset, key: str, label: str = "y", fold: str = "fold", k: int = 5, inner: int = 5, seed: int = 43):
        if not is_linear(preset):
            raise ValueError("every member of the preset must be a Ridge")
        self.rows, self.preset, self.label, self.fold, self.k, self.inner = rows, preset, label, fold, k, inner
        self.key, self.seed = key, seed
        self.pre = Preprocessor(roles).fit_by_fold(rows, fold, k)
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _sums(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums by inner fold of the rows outside fold i, and the point they are centred on."""
        if i not in self.sums:
            x = self.pre[i].columns
            outside = self.pre[i].transform(self.rows.where(F.col(self.fold) != i)).select(*dict.fromkeys([self.key, self.label, *x]))
            dealt = with_folds(outside, self.key, self.inner, self.seed + INNER_SEED_OFFSET, exact=True, name="inner_fold", staged=True)
            # One row for each inner fold.
            found = {r["inner_fold"]: Moments.unpacked(bytes(r["moments"]), len(x) + 1) for r in moments(dealt, [*x, self.label], ["inner_fold"]).collect()}
            whole = Moments(len(x) + 1)
            for m in found.values():
                whole.add(m.n, m.mean, m.products)
            cells = np.stack([raw_sums(found.get(j, Moments(len(x) + 1)), whole.mean) for j in range(self.inner)])
            self.sums[i] = cells, whole.mean
        return self.sums[i]

    def __call__(self, i: int, trials: Sequence[Mapping[str, float]]) -> list[dict[str, float]]:
        cells, center = self._sums(i)
        x = self.pre[i].columns
        functions = [uncentred(stack_function(cells, stack_of(self.preset, p, len(x))), center) for p in trials]
        scored = self.pre[i].transform(self.rows.where(F.col(self.fold) == i))
        return side_by_side(scored, self.label, [_linear(x, f) for f in functions])


def _linear(x: Sequence[str], function: np.ndarray) -> Column:
    return linear_prediction(x, F.lit(float(function[0])), F.array(*[F.lit(float(v)) for v in function[1:]]))


def side_by_side(rows: DataFrame, label: str, predictions: Sequence[Column]) -> list[dict[str, float]]:
    """MAE, RMSE and R2 of several predictions from one aggregate over the rows."""
    y = F.col(label)
    known = rows.where(y.isNotNull()).select(y.alias("y"), *(p.alias(f"p{t}") for t, p in enumerate(predictions)))
    sums = [F.count("*").alias("n"), (F.var_pop("y") * F.count("*")).alias("sst")]
    for t in range(len(predictions)):
        err = F.col("y") - F.col(f"p{t}")
        sums += [F.avg(F.abs(err)).alias(f"mae{t}"), F.sum(err * err).alias(f"sse{t}")]
    r = known.agg(*sums).first()
    out = []
    for t in range(len(predictions)):
        sse = r[f"sse{t}"]
        r2 = None if r["n"] < 2 else (float(sse == 0) if r["sst"] == 0 else 1 - sse / r["sst"])
        out.append({"MAE": r[f"mae{t}"], "RMSE": (sse / r["n"]) ** 0.5 if r["n"] else None, "R2": r2})
    return out


def tune_stacks_by_group(
    df: DataFrame,
    x: Sequence[str],
    y: str,
    key: str,
    keys: Sequence[str],
    candidates: Sequence[LinearStack],
    small: int | None = None,
    k: int = 5,
    inner: int = 5,
    seed: int = 43,
    min_rows: int = MIN_GROUP_ROWS,
    full_rows: int = FULL_BUDGET_ROWS,
    staged: bool = False,
) -> DataFrame:
    """(keys, n_rows, n_trials, trial, mae, rmse, r2, intercept, coef): every group's best stack, all groups in one job.

    Outer and inner folds are exact inside each group. The sums of a group, one
    matrix for each pair of folds, give its stacks for every candidate and
    outer fold; then one scan measures all of them side by side. Groups of
    ``full_rows`` rows or fewer try the first ``small`` candidates only. The
    best has the smallest mean fold MAE, the first on a tie; its function is
    fitted on all rows of the group. Metrics are means over folds. Groups of
    fewer than ``min_rows`` rows have no row here; rows with a NULL in x or y
    are left out. No group passes the driver. ``staged``: the rows come from
    files, and are read again rather than written once more. Copies of the rows
    are gone when this returns.
    """
    keys, n, small = list(keys), len(candidates), len(candidates) if small is None else small
    size = len(x) + 1
    ok = df.where(" and ".join(f"`{c}` is not null" for c in [*x, y])).select(*dict.fromkeys([*keys, key, y, *x]))
    ok = ok if staged else stage_table(ok, "grouped")
    # Groups go by number: one join by their keys.
    groups = sized(ok.groupBy(*keys).agg(F.count("*").alias("__total")).withColumn("__group", F.monotonically_increasing_id()))
    numbered = null_safe_join(ok, groups.select(*keys, "__group"), keys).select(*dict.fromkeys(["__group", key, y, *x]))
    folds = {"outer_fold": (k, seed), "inner_fold": (inner, seed + INNER_SEED_OFFSET)}
    rows = with_folds_by_group(numbered, key, ["__group"], folds, True, list(dict.fromkeys(["__group", y, *x])), sizes=groups.select("__group", "__total"), known=True)
    # Sums around the overall means: one centre for all groups.
    means = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate([*x, y])]).first()
    center = np.array([v or 0.0 for v in means])
    z = [F.col(c) - F.lit(float(m)) for c, m in zip([*x, y], center)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [F.count("*").cast("double"), *[F.sum(v) for v in z], *[F.sum(z[i] * z[j]) for i, j in pairs]]
    cells = rows.groupBy("__group", "outer_fold", "inner_fold").agg(F.array(*sums).alias("sums"))
    # At most k * inner cells a group.
    grouped = cells.groupBy("__group").agg(F.collect_list(F.struct("outer_fold", "inner_fold", "sums")).alias("cells"))
    spec = "__group long, n_rows long, outer array<array<double>>, final array<array<double>>"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.array([(i + 1, j + 1) for i, j in pairs])
        for pdf in batches:
            out = pdf[["__group"]].copy()
            n_rows, outer, final = [], [], []
            for found in pdf["cells"]:
                grid = np.zeros((k, inner, size + 1, size + 1))
                for c in found:
                    flat = np.asarray(c["sums"], float)
                    g = np.zeros((size + 1, size + 1))
                    g[0, : size + 1] = g[: size + 1, 0] = flat[: size + 1]
                    g[upper[:, 0], upper[:, 1]] = g[upper[:, 1], upper[:, 0]] = flat[size + 1 :]
                    grid[c["outer_fold"], c["inner_fold"]] = g
                whole = grid.sum(axis=0)
                rest = whole[None] - grid  # by outer fold: the rows outside it
                n_rows.append(int(round(whole[:, 0, 0].sum())))
                outer.append([f.tolist() for s in candidates for f in uncentred(stack_function(rest, s), center)])
                final.append([uncentred(stack_function(whole, s), center).tolist() for s in candidates])
            yield out.assign(n_rows=n_rows, outer=outer, final=final)

    models = stage_table(grouped.mapInPandas(solve, spec).where(F.col("n_rows") >= min_rows), "group_models")
    joined = rows.select("__group", "outer_fold", y, *x).join(sized(models.select("__group", "outer")), "__group")
    errors = [F.count("*").alias("n"), (F.var_pop(y) * F.count("*")).alias("sst")]
    for t in range(n):
        f = F.get("outer", F.col("outer_fold") + t * k)
        p = f[0]
        for i, c in enumerate(x):
            p = p + f[i + 1] * F.col(c)
        joined = joined.withColumn(f"__e{t}", F.col(y) - p)
        errors += [F.avg(F.abs(f"__e{t}")).alias(f"mae{t}"), F.sum(F.col(f"__e{t}") * F.col(f"__e{t}")).alias(f"sse{t}")]
    folds = joined.groupBy("__group", "outer_fold").agg(*errors)
    r2 = lambda t: F.when(F.col("n") > 1, F.when(F.col("sst") == 0, (F.col(f"sse{t}") == 0).cast("double")).otherwise(1 - F.col(f"sse{t}") / F.col("sst")))
    means = folds.groupBy("__group").agg(
        F.array(*[F.struct(F.avg(f"mae{t}").alias("mae"), F.lit(t).alias("trial"), F.avg(F.sqrt(F.col(f"sse{t}") / F.col("n"))).alias("rmse"), F.avg(r2(t)).alias("r2")) for t in range(n)]).alias("tried")
    )
    means = sized(means)
    drop_staged(rows)
    budget = F.when(F.col("n_rows") > full_rows, F.lit(n)).otherwise(F.lit(small))
    best = means.join(models.select("__group", "n_rows", "final"), "__group").join(groups.select(*keys, "__group"), "__group").withColumn("n_trials", budget)
    best = best.withColumn("b", F.array_min(F.slice("tried", 1, F.col("n_trials")))).withColumn("f", F.get("final", F.col("b.trial")))
    return best.select(*keys, "n_rows", "n_trials", "b.trial", "b.mae", "b.rmse", "b.r2", F.get("f", F.lit(0)).alias("intercept"), F.slice("f", 2, size).alias("coef"))
