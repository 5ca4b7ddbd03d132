"""Stacking: a meta model on out-of-fold predictions of base models."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, functions as F

from foldline.functions.metrics import METRICS, fold_means, metric_columns
from foldline.operators.fold_trees import fit_by_fold
from foldline.operators.learners import BAGGED_ROWS, fit_learner, is_exact, linear_stage, solve_linear
from foldline.operators.moments import Moments, moments
from foldline.operators.preprocess import Preprocessor
from foldline.operators.splits import with_folds
from foldline.session import drop_staged, stage_table

INNER_SEED_OFFSET = 1000
PARALLEL_ROWS = 4_000_000  # of fits that run side by side: each holds its rows in memory, and more keep all cores busy alone


@dataclass(frozen=True)
class Member:
    """A learner in a stack: alias, learner name, parameters."""

    alias: str
    learner: str
    params: Mapping[str, Any] = field(default_factory=dict)

    @property
    def column(self) -> str:
        return f"p_{self.alias}"


def _parallel(jobs: Sequence[Callable[[], Any]], threads: int) -> list[Any]:
    if threads <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda job: job(), jobs))


def _added(parts: Sequence[Moments], size: int) -> Moments:
    out = Moments(size)
    for m in parts:
        out.add(m.n, m.mean, m.products)
    return out


def _solved(member: Member, sums: Moments) -> tuple[float, np.ndarray]:
    if not sums.n:
        raise ValueError(f"{member.learner}: no rows to fit on")
    return solve_linear(member.learner, member.params, sums)


def fit_members(bases: Sequence[Member], df: DataFrame, x: Sequence[str], label: str, threads: int = 1) -> PipelineModel:
    jobs = [lambda b=b: fit_learner(b.learner, b.params, df, x, label, b.column) for b in bases]
    return PipelineModel(_parallel(jobs, threads))


def oof_predict(
    bases: Sequence[Member],
    df: DataFrame,
    x: Sequence[str],
    label: str = "y",
    fold: str = "inner_fold",
    k: int = 5,
    threads: int = 4,
) -> DataFrame:
    """Each row's base predictions come from models that have not seen its fold."""

    def part(i: int) -> DataFrame:
        model = fit_members(bases, df.where(F.col(fold) != i), x, label)
        return model.transform(df.where(F.col(fold) == i))

    parts = _parallel([lambda i=i: part(i) for i in range(k)], threads)
    return reduce(DataFrame.unionByName, parts)


@dataclass
class StackModel:
    """Fitted pipeline; ``transform`` adds ``prediction`` and the base columns."""

    pipeline: PipelineModel
    prediction: str = "prediction"

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df)


@dataclass
class Stack:
    bases: Sequence[Member]
    meta: Member
    passthrough: bool = False
    k: int = 5
    threads: int = 4

    def fit(self, df: DataFrame, x: Sequence[str], key: str, label: str = "y", seed: int = 43, staged: bool = False) -> StackModel:
        """Inner folds are exact ranks of a hash with its own seed, independent of the outer folds: none is empty
        from ``k`` rows on. Rows and out-of-fold predictions are written once each; a lost executor re-reads them.
        ``staged``: the rows come from files; a stack of linear members then reads them again and writes none, and one of
        trees grows those of all folds at once beyond ``BAGGED_ROWS`` rows."""
        rows = df.select(*dict.fromkeys([key, label, *x]))
        kinds = {f.name: f.dataType.typeName() for f in rows.schema}
        if staged and all(is_exact(m.learner, [m.params]) for m in [*self.bases, self.meta]) and not any("udt" in kinds[c] for c in x):
            return self._fit_on_sums(rows, x, key, label, seed)
        if staged and rows.count() > BAGGED_ROWS:
            dealt = with_folds(rows, key, self.k, seed + INNER_SEED_OFFSET, exact=True, name="inner_fold", staged=True)
            rows = stage_table(dealt.select(label, *x, "inner_fold"), "stack", (), True)
            models = fit_by_fold(self.bases, rows, x, label, "inner_fold", self.k)
            if models:
                return self._with_meta(rows, models, x, label, kinds)
            return self._fit_folds(rows, x, label)
        return self._fit_folds(stage_table(with_folds(rows, key, self.k, seed + INNER_SEED_OFFSET, exact=True, name="inner_fold"), "stack"), x, label)

    def _fit_folds(self, rows: DataFrame, x: Sequence[str], label: str) -> StackModel:
        """A fit of every member for each inner fold, and on all rows."""
        threads = max(1, min(self.threads, PARALLEL_ROWS // max(1, rows.count())))
        oof = oof_predict(self.bases, rows, x, label, "inner_fold", self.k, threads)
        meta = self.fit_meta(stage_table(oof.select(label, *self.meta_inputs(x)), "oof"), x, label)
        bases = fit_members(self.bases, rows, x, label, threads)
        return StackModel(PipelineModel([*bases.stages, *meta.stages]))

    def _with_meta(self, rows: DataFrame, models: Sequence[PipelineModel], x: Sequence[str], label: str, kinds: Mapping[str, str]) -> StackModel:
        """The meta model on what the models of every fold predict there; the last model is the one on all rows."""
        parts = [m.transform(rows.where(F.col("inner_fold") == i)) for i, m in enumerate(models[:-1])]
        oof = reduce(DataFrame.unionByName, parts).select(label, *self.meta_inputs(x))
        once = is_exact(self.meta.learner, [self.meta.params]) and not any("udt" in kinds[c] for c in x)  # one scan
        meta = self.fit_meta(oof if once else stage_table(oof, "oof"), x, label)
        drop_staged(rows)
        return StackModel(PipelineModel([*models[-1].stages, *meta.stages]))

    def _fit_on_sums(self, rows: DataFrame, x: Sequence[str], key: str, label: str, seed: int) -> StackModel:
        """The same for linear members, from the moments of every inner fold: out-of-fold predictions are linear in the
        features inside a fold, so the moments of the meta model's inputs follow from those of the features."""
        size, inputs = len(x) + 1, self.meta_inputs(x)
        dealt = with_folds(rows, key, self.k, seed + INNER_SEED_OFFSET, exact=True, name="inner_fold", staged=True)
        found = {r["inner_fold"]: Moments.unpacked(bytes(r["moments"]), size) for r in moments(dealt, [*x, label], ["inner_fold"]).collect()}
        seen = []
        for i in range(self.k):
            rest = _added([m for j, m in found.items() if j != i], size)
            matrix, offset = np.zeros((len(inputs) + 1, size)), np.zeros(len(inputs) + 1)
            for b, base in enumerate(self.bases):
                offset[b], matrix[b, :-1] = _solved(base, rest)
            matrix[len(self.bases) :, size - (len(inputs) + 1 - len(self.bases)) :] = np.eye(len(inputs) + 1 - len(self.bases))
            seen += [found[i].mapped(matrix, offset)] if i in found else []
        whole = _added(list(found.values()), size)
        stages = [linear_stage(x, *_solved(b, whole), b.column) for b in self.bases]
        stages.append(linear_stage(inputs, *_solved(self.meta, _added(seen, len(inputs) + 1)), "prediction"))
        return StackModel(PipelineModel(stages))

    def meta_inputs(self, x: Sequence[str]) -> list[str]:
        return [b.column for b in self.bases] + (list(x) if self.passthrough else [])

    def fit_meta(self, oof: DataFrame, x: Sequence[str], label: str = "y") -> PipelineModel:
        return fit_learner(self.meta.learner, self.meta.params, oof, self.meta_inputs(x), label, "prediction")


def fit_preprocessed_stack(
    df: DataFrame, roles: Mapping[str, str], stack: Stack, key: str, label: str = "y", staged: bool = False, **prep: Any
) -> StackModel:
    """Preprocessor outside, stack inside: inner folds share the statistics of all given rows. ``staged``: these come from files."""
    pre = Preprocessor(roles, **prep).fit(df)
    fitted = stack.fit(pre.transform(df), pre.columns, key, label, staged=staged)
    return StackModel(PipelineModel([*pre.stages()[:-1], *fitted.pipeline.stages]))


def cross_validate(
    fit: Callable[[DataFrame], Any], df: DataFrame, fold: str = "fold", k: int = 5, label: str = "y", threads: int = 1
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A fresh ``fit`` per outer fold: (scores per fold, mean over folds, out-of-fold predictions).

    The predictions are written once, and the metrics are observed in that very
    pass: no second scan, no shuffle. Folds without rows have no score.
    """
    spark = df.sparkSession

    def part(i: int) -> tuple[DataFrame, dict[str, Any]]:
        scored = fit(df.where(F.col(fold) != i)).transform(df.where(F.col(fold) == i))
        seen = Observation(f"fold {i}")
        rows = scored.select(fold, F.col(label).alias("y"), F.col("prediction").alias("p"))
        staged = stage_table(rows.observe(seen, F.count("*").alias("n"), *metric_columns()), "oof")
        return staged, seen.get

    parts = _parallel([lambda i=i: part(i) for i in range(k)], threads)
    rows = [(i, *(m[c] for c in METRICS)) for i, (_, m) in enumerate(parts) if m["n"]]
    per_fold = spark.createDataFrame(rows, f"{fold} int, {', '.join(f'{c} double' for c in METRICS)}")
    return per_fold, fold_means(per_fold), reduce(DataFrame.unionByName, [p for p, _ in parts])
