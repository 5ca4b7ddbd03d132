"""Saved models with what is needed to score new rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldline.operators.gram import linear_prediction

META_SCHEMA = (
    "target string, features array<string>, dtypes map<string,string>, params map<string,double>, version string"
)


GROUP_SCHEMA = "keys array<string>, columns array<string>"


@dataclass
class TargetMeta:
    features: list[str]
    dtypes: dict[str, str] = field(default_factory=dict)
    params: dict[str, float] = field(default_factory=dict)


@dataclass
class GroupModels:
    """One linear model for each group, as a table (keys, intercept, coef) over columns that the target's pipeline makes."""

    keys: list[str]
    columns: list[str]
    table: DataFrame


@dataclass
class Bundle:
    """Pipelines by target; a target may have models by group, and its pipeline then serves the other rows."""

    models: dict[str, PipelineModel]
    meta: dict[str, TargetMeta]
    groups: dict[str, GroupModels] = field(default_factory=dict)

    @property
    def targets(self) -> list[str]:
        return list(self.models)


def save_bundle(bundle: Bundle, spark: SparkSession, path: str) -> None:
    for target, model in bundle.models.items():
        model.write().overwrite().save(f"{path}/models/{target}")
    rows = [(t, m.features, m.dtypes, m.params, spark.version) for t, m in bundle.meta.items()]
    spark.createDataFrame(rows, META_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    for target, g in bundle.groups.items():
        g.table.select(*g.keys, "intercept", "coef").write.mode("overwrite").parquet(f"{path}/groups/{target}/table")
        spark.createDataFrame([(g.keys, g.columns)], GROUP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/groups/{target}/meta")
    spark.createDataFrame([(t,) for t in bundle.groups], "target string").coalesce(1).write.mode("overwrite").parquet(f"{path}/grouped")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    rows = spark.read.parquet(f"{path}/meta").collect()
    meta = {r["target"]: TargetMeta(list(r["features"]), dict(r["dtypes"] or {}), dict(r["params"] or {})) for r in rows}
    groups = {}
    for r in spark.read.schema("target string").parquet(f"{path}/grouped").collect():  # one row for each target
        at = f"{path}/groups/{r['target']}"
        g = spark.read.parquet(f"{at}/meta").first()
        groups[r["target"]] = GroupModels(list(g["keys"]), list(g["columns"]), spark.read.parquet(f"{at}/table"))
    return Bundle({t: PipelineModel.load(f"{path}/models/{t}") for t in meta}, meta, groups)


def score_batch(bundle: Bundle, df: DataFrame) -> DataFrame:
    """Add ``pred_<target>`` for every target, keeping the columns of ``df``.

    Features are cast to their recorded types; a missing feature is an error.
    Rows of a group that has a model get that model's prediction, all others
    the pipeline's. The table of models is read from files, so Spark broadcasts
    it where it is small and splits hot groups where it is not; it may join a
    stream. Group keys must be columns of ``df``.
    """
    keep = df.columns
    out = df
    for target, model in bundle.models.items():
        meta = bundle.meta[target]
        lost = [c for c in meta.features if c not in keep]
        if lost:
            raise ValueError(f"{target}: missing features {lost}")
        typed = out.select(
            *[F.col(c) for c in out.columns],
            *[F.col(c).cast(meta.dtypes.get(c, "double")).alias(f"__f_{c}") for c in meta.features],
        )
        # The model reads the feature names; the caller's own columns come back afterwards.
        aside = {c: f"__k_{c}" for c in meta.features}
        shaped = typed.select(
            *[F.col(c).alias(aside.get(c, c)) for c in out.columns],
            *[F.col(f"__f_{c}").alias(c) for c in meta.features],
        )
        scored = model.transform(shaped)
        prediction = F.col("prediction")
        if target in bundle.groups:
            g = bundle.groups[target]
            named = g.table.select(*[F.col(k).alias(f"__g_{k}") for k in g.keys], F.col("intercept").alias("__intercept"), F.col("coef").alias("__coef"))
            same = [F.col(aside.get(k, k)).eqNullSafe(F.col(f"__g_{k}")) for k in g.keys]
            scored = scored.join(named, same, "left")
            prediction = F.coalesce(linear_prediction(g.columns, F.col("__intercept"), F.col("__coef")), prediction)
        out = scored.select(*[F.col(aside.get(c, c)).alias(c) for c in out.columns], prediction.alias(f"pred_{target}"))
    return out
