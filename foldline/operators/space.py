"""Search spaces, presets and draws from them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from foldline.functions.hashing import HASH_RANGE, hash_unit
from foldline.operators.stack import Member, Stack


@dataclass(frozen=True)
class Param:
    """An integer range with a step, or a real range, linear or logarithmic."""

    name: str
    kind: str
    low: float
    high: float
    step: float = 1.0
    log: bool = False

    def at(self, u: float) -> float:
        """The value at uniform position ``u`` in [0, 1)."""
        if self.kind == "int":
            return self.low + self.step * math.floor(u * (math.floor((self.high - self.low) / self.step) + 1))
        if self.log:
            return math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        return self.low + u * (self.high - self.low)


def whole(name: str, low: int, high: int, step: int = 1) -> Param:
    return Param(name, "int", low, high, step)


def real(name: str, low: float, high: float, log: bool = False) -> Param:
    return Param(name, "float", low, high, 0.0, log)


@dataclass(frozen=True)
class Preset:
    number: int
    bases: Sequence[tuple[str, str]]
    meta: tuple[str, str]
    passthrough: bool
    space: Sequence[Param] = field(default_factory=tuple)


# The six model presets and their search spaces.
PRESETS: dict[int, Preset] = {
    p.number: p
    for p in (
        Preset(
            1,
            [("rf", "RandomForestRegressor"), ("gbr", "GradientBoostingRegressor")],
            ("ridge", "Ridge"),
            True,
            [
                whole("rf_n_estimators", 50, 200, 10),
                whole("rf_max_depth", 3, 12),
                whole("rf_min_samples_leaf", 1, 5),
                whole("gbr_n_estimators", 50, 200, 10),
                real("gbr_learning_rate", 0.01, 1.0, log=True),
                whole("gbr_max_depth", 3, 6),
                real("ridge_alpha", 0.001, 100.0, log=True),
            ],
        ),
        Preset(
            2,
            [("hgbr", "HistGradientBoostingRegressor"), ("etr", "ExtraTreesRegressor")],
            ("ridge", "Ridge"),
            True,
            [
                whole("hgbr_max_depth", 3, 20),
                real("hgbr_learning_rate", 0.01, 1.0, log=True),
                real("hgbr_l2_regularization", 0.00001, 0.1, log=True),
                whole("etr_n_estimators", 50, 200, 10),
                whole("etr_max_depth", 3, 12),
                real("ridge_alpha", 0.001, 100.0, log=True),
            ],
        ),
        Preset(
            3,
            [("lgbm", "LGBMRegressor"), ("etr", "ExtraTreesRegressor")],
            ("enet", "ElasticNet"),
            True,
            [
                whole("lgbm_num_leaves", 15, 255),
                real("lgbm_learning_rate", 0.01, 1.0, log=True),
                whole("lgbm_n_estimators", 50, 200, 10),
                whole("lgbm_max_depth", -1, 20),
                whole("etr_n_estimators", 50, 200, 10),
                whole("etr_max_depth", 3, 12),
                real("enet_alpha", 0.001, 10.0, log=True),
                real("enet_l1_ratio", 0.05, 0.95),
            ],
        ),
        Preset(
            4,
            [("cbr", "CatBoostRegressor")],
            ("ridge", "Ridge"),
            False,
            [
                whole("cbr_depth", 3, 16),
                real("cbr_learning_rate", 0.001, 1.0, log=True),
                real("cbr_l2_leaf_reg", 1.0, 10.0),
                whole("cbr_iterations", 300, 1200, 100),
                real("ridge_alpha", 0.001, 100.0, log=True),
            ],
        ),
        Preset(
            5,
            [("hgbr", "HistGradientBoostingRegressor"), ("gbr", "GradientBoostingRegressor")],
            ("enet", "ElasticNet"),
            True,
            [
                whole("hgbr_max_depth", 2, 20),
                real("hgbr_learning_rate", 0.05, 0.5, log=True),
                whole("hgbr_max_bins", 32, 255),
                whole("gbr_n_estimators", 50, 500, 25),
                real("gbr_learning_rate", 0.001, 1.0, log=True),
                whole("gbr_max_depth", 3, 8),
                real("enet_alpha", 0.001, 10.0, log=True),
                real("enet_l1_ratio", 0.05, 0.95),
            ],
        ),
        Preset(
            6,
            [("rf", "RandomForestRegressor"), ("etr", "ExtraTreesRegressor")],
            ("ridge", "Ridge"),
            True,
            [
                whole("rf_n_estimators", 50, 500, 25),
                whole("rf_max_depth", 3, 20),
                whole("rf_min_samples_leaf", 1, 5),
                whole("etr_n_estimators", 50, 500, 25),
                whole("etr_max_depth", 3, 12),
                real("ridge_alpha", 0.001, 100.0, log=True),
            ],
        ),
    )
}

# Spaces used outside the presets.
STACK_SPACE = [
    whole("rf_n_estimators", 100, 700, 50),
    whole("rf_max_depth", 3, 20),
    whole("rf_min_samples_leaf", 2, 5),
    whole("gbr_n_estimators", 100, 700, 50),
    real("gbr_learning_rate", 0.01, 0.2, log=True),
    whole("gbr_max_depth", 2, 6),
    real("ridge_alpha", 0.01, 10.0, log=True),
]
GROUP_SPACE = [
    whole("rf_n_estimators", 50, 500, 20),
    whole("rf_max_depth", 3, 20),
    whole("rf_min_samples_leaf", 2, 5),
    whole("gbr_n_estimators", 50, 500, 20),
    real("gbr_learning_rate", 0.01, 0.2, log=True),
    whole("gbr_max_depth", 2, 6),
    real("ridge_alpha", 0.01, 100.0, log=True),
]
XGB_SPACE = [
    whole("n_estimators", 50, 350, 10),
    whole("max_depth", 3, 20),
    real("learning_rate", 0.01, 0.2, log=True),
    real("subsample", 0.6, 1.0),
]
SVR_SPACE = [real("C", 0.05, 300.0, log=True), real("gamma", 0.05, 20.0), real("epsilon", 0.05, 3.0)]

SPACE_SCHEMA = T.StructType(
    [
        T.StructField("preset", T.IntegerType()),
        T.StructField("param", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("step", T.DoubleType()),
        T.StructField("log", T.BooleanType()),
    ]
)


def build_preset(number: int) -> Preset:
    if number not in PRESETS:
        raise KeyError(f"unknown preset: {number}")
    return PRESETS[number]


def space_rows(spaces: Mapping[int, Iterable[Param]]) -> list[tuple]:
    return [
        (n, p.name, p.kind, float(p.low), float(p.high), float(p.step), p.log)
        for n, space in spaces.items()
        for p in space
    ]


def space_table(spark: SparkSession, spaces: Mapping[int, Iterable[Param]] | None = None) -> DataFrame:
    """The spaces as rows; by default those of the presets."""
    return spark.createDataFrame(space_rows(spaces or {n: p.space for n, p in PRESETS.items()}), SPACE_SCHEMA)


def value_at(u: Column) -> Column:
    """The table form of ``Param.at`` over the columns kind, low, high, step, log."""
    low, high, step = F.col("low"), F.col("high"), F.col("step")
    on_grid = low + step * F.floor(u * (F.floor((high - low) / step) + 1))
    on_log = F.exp(F.log(low) + u * (F.log(high) - F.log(low)))
    return F.when(F.col("kind") == "int", on_grid).when(F.col("log"), on_log).otherwise(low + u * (high - low))


def sample_space(draws: DataFrame, space: DataFrame, draw_key: Sequence[str], seed: int = 42) -> DataFrame:
    """One value per (row of ``draws``, parameter of its preset), fixed by hash.

    ``space`` is configuration of a few dozen rows, so it is broadcast.
    """
    u = hash_unit(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in draw_key], F.col("param")))
    return draws.join(F.broadcast(space), "preset").withColumn("draw", value_at(u))


def sample_params(space: Iterable[Param], number: int, seed: int = 42, study: str = "") -> dict[str, float]:
    """The same draw for one trial number, for search loops; a study's name makes the draws its own."""
    out = {}
    for p in space:
        digest = hashlib.md5("|".join([str(seed), *([study] if study else []), str(number), p.name]).encode()).hexdigest()
        out[p.name] = p.at(int(digest[:8], 16) / HASH_RANGE)
    return out


def params_for(alias: str, params: Mapping[str, Any]) -> dict[str, Any]:
    """Parameters written ``alias_name`` for one member, without the alias."""
    prefix = f"{alias}_"
    return {k[len(prefix) :]: v for k, v in params.items() if k.startswith(prefix)}


def stack_from(preset: Preset, params: Mapping[str, Any], k: int = 5, threads: int = 4) -> Stack:
    bases = [Member(a, learner, params_for(a, params)) for a, learner in preset.bases]
    alias, learner = preset.meta
    return Stack(bases, Member(alias, learner, params_for(alias, params)), preset.passthrough, k, threads)


def split_by_alias(params: DataFrame, preset_aliases: Mapping[str, str]) -> DataFrame:
    """Rows (.., param, ..) with the member alias and the bare parameter name split off."""
    alias = F.lit(None).cast("string")
    for a in preset_aliases:
        alias = F.when(F.startswith(F.col("param"), F.lit(f"{a}_")), F.lit(a)).otherwise(alias)
    learner = F.lit(None).cast("string")
    for a, name in preset_aliases.items():
        learner = F.when(F.col("alias") == a, F.lit(name)).otherwise(learner)
    return (
        params.withColumn("alias", alias)
        .withColumn("learner", learner)
        .withColumn("name", F.expr("substring(param, length(alias) + 2)"))
    )
