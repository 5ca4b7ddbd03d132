"""Median pruning over a whole search history.

Rule: a trial is pruned at a step (not before ``warmup``, and only once
``startup`` earlier trials are COMPLETE) if its best reported value so far is
greater than the median of the values that earlier COMPLETE trials reported at
the same step.

The median over "all earlier trials" differs for every trial. Instead of
building it, each trial counts the earlier values below its own. The trials
before t are the union of at most log2(t) aligned blocks (one per set bit of
t), so every value is listed once per block it belongs to, and every trial asks
its blocks. That is n log n rows, no pairs; inside a block of a large group, rows
are cut again by value ranges, with one small carry row per range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from foldline.operators.scans import null_safe_join
from foldline.operators.studies import COMPLETE
from foldline.session import sized, stage_table

GROUP = ["study", "step"]
BLOCK = [*GROUP, "level", "block"]
CELL = [*BLOCK, "range"]


def _with_best(reported: DataFrame) -> DataFrame:
    w = W.partitionBy("study", "trial").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return reported.withColumn("best", F.min("step_value").over(w))


def earlier_value_ranks(values: DataFrame, asks: DataFrame, range_values: int = 2_000, fan_out: int = 255) -> DataFrame:
    """For each ask (study, step, trial, x): among values (study, step, trial, x) of
    smaller trial numbers, ``m`` in all, ``below`` under x, the largest under x
    (``lo``) and the smallest not under x (``hi``).

    Groups of up to ``range_values`` values are one value range. Larger ones
    are cut into up to ``fan_out`` ranges, and these again until they are
    small, as their own counts ask; ranges of one repeated value stay whole.
    Only groups with several ranges carry anything from one to the next. A
    group is listed at no more levels than its own trial numbers have bits.
    """
    both = values.withColumn("is_value", F.lit(1)).unionByName(asks.withColumn("is_value", F.lit(0)))
    bits = F.greatest(F.lit(1), F.length(F.bin(F.max("trial")))).alias("levels")
    groups = sized(both.groupBy(*GROUP).agg(bits, F.sum("is_value").alias("n")))
    rows = both.join(groups.select(*GROUP, "levels", (F.col("n") > range_values).alias("large")), GROUP)
    if groups.where(F.col("n") > range_values).isEmpty():
        return _answers(_inside(rows.withColumn("range", F.lit(""))))
    cut = _ranged(stage_table(rows.where("large"), "large"), range_values, fan_out)
    listed = _listed(cut)
    whole = _answers(_inside(rows.where("not large").withColumn("range", F.lit(""))))
    parts = _with_carry(_inside(cut, listed).drop("in_block"), listed.withColumn("own", F.when(F.col("is_value") == 1, F.col("x"))))
    return whole.unionByName(_answers(parts))


def _ranged(rows: DataFrame, range_values: int, fan_out: int) -> DataFrame:
    """``range`` for every row, in order of x: one letter code for each time its range was cut."""
    rows = rows.withColumn("range", F.lit(""))
    probs = [i / fan_out for i in range(1, fan_out)]
    own = F.when(F.col("is_value") == 1, F.col("x"))
    while True:
        counts = rows.groupBy(*GROUP, "range").agg(F.sum("is_value").alias("n"), F.min(own).alias("low"), F.max(own).alias("high"))
        over = sized(counts.where((F.col("n") > 2 * range_values) & (F.col("low") < F.col("high"))).select(*GROUP, "range", "n", "high"))
        if over.isEmpty():
            return rows
        known = rows.join(over, [*GROUP, "range"])
        found = known.groupBy(*GROUP, "range", "n", "high").agg(F.percentile_approx(own, probs, 10_000).alias("fine"), F.max(F.when(own < F.col("high"), own)).alias("second"))
        stride = F.greatest(F.lit(1), F.floor(F.lit(fan_out) / F.ceil(F.col("n") / range_values))).cast("int")
        # The second largest value is always an edge, so that a range loses its most repeated ends even where all other edges are one value.
        cut = F.expr("array_distinct(concat(filter(fine, (e, i) -> (i + 1) % stride = 0 and e < high), array(second)))")
        edges = found.withColumn("stride", stride).select(*GROUP, "range", cut.alias("edges"))
        # Two hexadecimal digits a cut keep the order of the ranges as texts; an edge's own value is the last of its range.
        sub = F.lpad(F.hex(F.expr("coalesce(size(filter(edges, e -> e < x)), 0)")), 2, "0")
        placed = rows.join(sized(edges), [*GROUP, "range"], "left").withColumn("sub", F.when(F.col("edges").isNotNull(), sub).otherwise("00"))
        rows = stage_table(placed.withColumn("range", F.concat("range", "sub")).drop("edges", "sub"), "ranged")


def _listed(rows: DataFrame) -> DataFrame:
    """Values at the blocks they belong to, asks at the blocks before their trial."""
    leveled = rows.withColumn("level", F.explode(F.expr("sequence(0, levels - 1)"))).drop("levels", "large")
    odd = F.expr("shiftright(trial, level) % 2 = 1")
    block = F.expr("shiftright(trial, level) - (1 - is_value)")
    return leveled.where(odd == (F.col("is_value") == 0)).withColumn("block", block)


def _inside(ranged: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Each ask's answer inside its own range of every block."""
    rows = _listed(ranged) if listed is None else listed
    own = F.when(F.col("is_value") == 1, F.col("x"))
    up = W.partitionBy(*CELL).orderBy("x", "is_value").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*CELL).orderBy(F.desc("x"), F.desc("is_value")).rowsBetween(W.unboundedPreceding, 0)
    return rows.select(
        *CELL,
        "trial",
        "is_value",
        F.sum("is_value").over(up).alias("below"),
        F.max(own).over(up).alias("lo"),
        F.min(own).over(down).alias("hi"),
        F.sum("is_value").over(W.partitionBy(*CELL)).alias("in_block"),
    ).where(F.col("is_value") == 0)


def _answers(inside: DataFrame) -> DataFrame:
    return inside.groupBy("study", "trial", "step").agg(
        F.sum("in_block").alias("m"), F.sum("below").alias("below"), F.max("lo").alias("lo"), F.min("hi").alias("hi")
    )


def _with_carry(inside: DataFrame, rows: DataFrame) -> DataFrame:
    """Add what the other value ranges of a block contribute."""
    cells = rows.groupBy(*CELL).agg(F.sum("is_value").alias("n"), F.max("own").alias("top"), F.min("own").alias("bottom"))
    block = W.partitionBy(*BLOCK)
    before = block.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    after = block.orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)
    carry = cells.select(
        *CELL,
        F.sum("n").over(block).alias("in_block"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.max("top").over(before).alias("lo_before"),
        F.min("bottom").over(after).alias("hi_after"),
    )
    return null_safe_join(inside, carry, CELL).select(
        "study",
        "trial",
        "step",
        "in_block",
        (F.col("below") + F.col("n_before")).alias("below"),
        F.greatest("lo", "lo_before").alias("lo"),
        F.least("hi", "hi_after").alias("hi"),
    )


def median_prune(reported: DataFrame, trials: DataFrame, startup: int = 5, warmup: int = 2, range_values: int = 2_000) -> DataFrame:
    """(study, trial, step, best, pruned) for every reported value from step ``warmup`` on."""
    done = trials.where(F.col("state") == COMPLETE).select("study", "trial")
    tagged = _with_best(reported)
    values = reported.join(done, ["study", "trial"], "left_semi").select(
        "study", "step", "trial", F.col("step_value").alias("x")
    )
    asks = tagged.where(F.col("step") >= warmup).select("study", "step", "trial", F.col("best").alias("x"))
    ranks = earlier_value_ranks(values, asks, range_values)
    half = F.floor(F.col("m") / 2)
    above = (
        F.when(F.col("m") < startup, F.lit(False))
        .when(F.col("m") % 2 == 1, F.col("below") > half)
        .when(F.col("below") == half, F.col("best") > (F.col("lo") + F.col("hi")) / 2)
        .otherwise(F.col("below") > half)
    )
    return (
        asks.withColumnRenamed("x", "best")
        .join(ranks, ["study", "trial", "step"], "left")
        .select("study", "trial", "step", "best", F.coalesce(above, F.lit(False)).alias("pruned"))
    )


def first_prune(decisions: DataFrame) -> DataFrame:
    """(study, trial, step) where each pruned trial stops."""
    return decisions.where("pruned").groupBy("study", "trial").agg(F.min("step").alias("step"))
