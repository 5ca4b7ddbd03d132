"""The library's inputs, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldline.operators.scans import row_numbers
from foldline.session import spread

TARGETS = ("charge", "unit_price", "retail", "disc")
EXCLUSIONS = {"charge": ["unit_price"], "unit_price": ["charge"]}
COLUMNS = ("qty", "price", "disc", "tax", "size", "retail", "const1", "charge", "unit_price", "flag", "status", "brand_gap")
LOG, EXP = ("charge",), ("disc",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their part: numeric, log, exp and categorical columns, with gaps."""
    li, part = spread(table(spark, sf_dir, "lineitem")), table(spark, sf_dir, "part")
    micros = F.expr(
        "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST(l_shipdate AS TIMESTAMP_NTZ))"
    )
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")], micros.cast("string"))
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        key.alias("row_key"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("ptype"),
        F.when(~((F.col("l_linenumber") == 3) & (F.col("l_suppkey") % 5 == 0)), F.col("l_quantity")).alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
        F.col("p_size").cast("double").alias("size"),
        F.when(F.col("p_size") % 17 != 0, F.col("p_brand")).alias("brand_gap"),
        F.col("p_retailprice").alias("retail"),
        F.lit(1.0).alias("const1"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search history: one study per user, one trial per event in time order.

    Trial numbers are counted per (user, day) with carried offsets, so a busy
    user's events are not sorted in one task.
    """
    ev = spread(table(spark, sf_dir, "events"))
    numbered = row_numbers(ev, ["user_id"], F.to_date("ts"), ["ts", "event_id"], "__n")
    state = F.when(F.col("event_type") == "signup", "PRUNED").when(F.col("event_type") == "error", "FAIL").otherwise("COMPLETE")
    return numbered.select(
        F.concat(F.lit("study_"), F.col("user_id").cast("string")).alias("study"),
        (F.col("__n") - 1).alias("trial"),
        state.alias("state"),
        F.when(~F.col("event_type").isin("signup", "error"), F.col("value")).alias("value"),
        F.create_map(
            F.lit("p_k"), F.get_json_object("props", "$.k").cast("double"), F.lit("p_m"), (F.col("event_id") % 7).cast("double")
        ).alias("params"),
        F.concat(F.lit("target_"), (F.col("user_id") % 3).cast("string")).alias("target"),
        (F.col("user_id") % 6 + 1).cast("int").alias("preset"),
        F.col("value").alias("raw_value"),
        "event_id",
        "user_id",
    )


def trial_steps(history: DataFrame) -> DataFrame:
    """Five fold values per trial."""
    return history.select(
        "study",
        "trial",
        F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"),
        "raw_value",
        "event_id",
    ).select(
        "study",
        "trial",
        "step",
        (F.col("raw_value") * (1 + 0.05 * ((F.col("event_id") + F.col("step") * 3) % 7))).alias("step_value"),
    )


def studies(history: DataFrame) -> DataFrame:
    """Own goals for every fourth study."""
    return history.select("study", "user_id").distinct().select(
        "study", F.when(F.col("user_id") % 4 == 0, F.lit(60)).alias("goal_n_trials")
    )
