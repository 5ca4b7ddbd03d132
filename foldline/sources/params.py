"""Best parameters per target as JSON rows (target, params)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

PARAMS_SCHEMA = "target string, params map<string,double>"


def save_params(df: DataFrame, path: str) -> None:
    df.select("target", "params").write.mode("overwrite").json(path)


def missing_targets(targets: DataFrame, params: DataFrame) -> DataFrame:
    """Targets without parameters."""
    return targets.select("target").distinct().join(params, "target", "left_anti")


def load_params(spark: SparkSession, path: str, targets: Sequence[str]) -> DataFrame:
    """Parameters of ``targets``; an error if the path is absent or a target is missing."""
    params = spark.read.schema(PARAMS_SCHEMA).json(path)
    wanted = spark.createDataFrame([(t,) for t in targets], "target string")
    missing = sorted(r["target"] for r in missing_targets(wanted, params).collect())
    if missing:
        raise ValueError(f"no parameters for targets: {missing}")
    return params.join(wanted, "target", "left_semi")
