"""Ordered logic per group without a window over a whole group.

A group (a study, a split stratum) may hold a third of the table, so no window
here is partitioned by the group alone. Rows are cut into buckets that follow
the order; windows run inside (group, bucket); one small row per bucket carries
what the earlier buckets contribute.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` where NULL matches NULL; keeps the left keys."""
    tagged = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(tagged, cond, how).drop(*[f"__r_{k}" for k in keys])


def bucket_offsets(df: DataFrame, by: Sequence[str], bucket: str) -> DataFrame:
    """Per (by, bucket): rows in it, rows before it, rows in the whole group."""
    counts = df.groupBy(*by, bucket).agg(F.count("*").alias("__cnt"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = w.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(
        *by,
        bucket,
        "__cnt",
        F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__start"),
        F.sum("__cnt").over(w).alias("__total"),
    )


def row_numbers(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str], name: str) -> DataFrame:
    """``row_number()`` per group, counted inside buckets that follow ``order``."""
    tagged = df.withColumn("__bucket", bucket)
    offsets = bucket_offsets(tagged, by, "__bucket").select(*by, "__bucket", "__start")
    w = W.partitionBy(*by, "__bucket").orderBy(*order)
    return (
        null_safe_join(tagged, offsets, [*by, "__bucket"])
        .withColumn(name, F.row_number().over(w) + F.col("__start"))
        .drop("__bucket", "__start")
    )


def running_min(
    df: DataFrame, by: Sequence[str], order: str, value: str, name: str, before_only: bool = False, chunk: int = 10_000
) -> DataFrame:
    """Smallest ``value`` so far by the integer column ``order``; NULL values are skipped."""
    tagged = df.withColumn("__chunk", F.floor(F.col(order) / chunk))
    firsts = tagged.groupBy(*by, "__chunk").agg(F.min(value).alias("__cmin"))
    over_chunks = W.partitionBy(*by).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = firsts.select(*by, "__chunk", F.min("__cmin").over(over_chunks).alias("__carry"))
    inside = W.partitionBy(*by, "__chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1 if before_only else 0)
    return (
        null_safe_join(tagged, carried, [*by, "__chunk"], "left")
        .withColumn(name, F.least(F.min(value).over(inside), F.col("__carry")))
        .drop("__chunk", "__carry")
    )


def streak_ends(df: DataFrame, by: Sequence[str], order: str, hit: Column, length: int) -> DataFrame:
    """Positions where the last ``length`` consecutive rows all satisfy ``hit``.

    ``order`` must count 0, 1, 2, ... per group. Each hit votes for the
    positions it can help to complete; a position with ``length`` votes ends a
    streak. The shuffle key is (group, position), so a large group stays spread.
    """
    votes = df.where(hit).select(*by, F.explode(F.sequence(F.col(order), F.col(order) + (length - 1))).alias(order))
    return votes.groupBy(*by, order).agg(F.count("*").alias("__votes")).where(F.col("__votes") == length).drop("__votes")
