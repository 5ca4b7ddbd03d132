"""Imputation, log/exp transforms, scaling and one-hot columns by role.

``fit`` reduces the table to a few numbers per column; ``transform`` is plain
column expressions, also available as a persistable SQL stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldline.functions.numeric import clean, sql_double, sql_name, sql_string
from foldline.operators.quantiles import exact_quantiles
from foldline.operators.wide import save_dictionary, wide_one_hot
from foldline.session import stage_table

BRANCH_ORDER = ("num", "log", "exp", "cat")
SCALERS = ("minmax", "standard", "robust")
TRANSFORMS = {"num": "{}", "log": "log1p({})", "exp": "exp({})"}


@dataclass
class ColumnStats:
    role: str
    fill: float | str
    shift: float = 0.0
    scale: float = 1.0
    categories: list[str] = field(default_factory=list)
    dictionary: str = ""  # path of a wide column's dictionary
    size: int = 0


@dataclass
class PreprocessorModel:
    """Statistics per column; ``columns`` lists the outputs in branch order."""

    stats: dict[str, ColumnStats]
    passthrough: list[str] = field(default_factory=list)

    def imputed_sql(self, col: str) -> str:
        s = self.stats[col]
        if s.role in ("cat", "wide"):
            return f"coalesce(CAST({sql_name(col)} AS STRING), {sql_string(s.fill)})"
        x = f"CAST({sql_name(col)} AS DOUBLE)"
        return f"coalesce(nanvl({x}, CAST(NULL AS DOUBLE)), {sql_double(s.fill)})"

    def column_sql(self) -> dict[str, str]:
        """``{output column: SQL expression}``."""
        out: dict[str, str] = {}
        for role in BRANCH_ORDER:
            for col, s in self.stats.items():
                if s.role != role:
                    continue
                if role == "cat":
                    for i, value in enumerate(s.categories):
                        out[f"{col}__is{i}"] = f"CAST({self.imputed_sql(col)} = {sql_string(value)} AS DOUBLE)"
                else:
                    x = TRANSFORMS[role].format(self.imputed_sql(col))
                    out[f"{col}__{role}"] = f"({x} - {sql_double(s.shift)}) / {sql_double(s.scale)}"
        for col in self.passthrough:
            out[f"{col}__raw"] = f"CAST({sql_name(col)} AS DOUBLE)"
        return out

    @property
    def wide(self) -> dict[str, str]:
        """Output column of every column that became one sparse vector."""
        return {c: f"{c}__onehot" for c, s in self.stats.items() if s.role == "wide"}

    @property
    def columns(self) -> list[str]:
        return [*self.column_sql(), *self.wide.values()]

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.select("*", *[F.expr(sql).alias(name) for name, sql in self.column_sql().items()])
        for stage in self.wide_stages():
            out = stage.transform(out)
        return out

    def wide_stages(self) -> list:
        return [s for c, name in self.wide.items() for s in wide_one_hot(self.imputed_sql(c), name, self.stats[c].dictionary, self.stats[c].size)]

    def stages(self, features: str = "features") -> list:
        """The same as pipeline stages, ending in a feature vector; the first one makes all plain columns."""
        exprs = "".join(f", {sql} AS {sql_name(name)}" for name, sql in self.column_sql().items())
        return [
            SQLTransformer(statement=f"SELECT *{exprs} FROM __THIS__"),
            *self.wide_stages(),
            VectorAssembler(inputCols=self.columns, outputCol=features),
        ]


class Preprocessor:
    """Column roles, scaler (``minmax``, ``standard``, ``robust``) and what to do with other columns.

    A categorical column of up to ``dense_categories`` values becomes a column
    for each; a wider one becomes one sparse vector with the same places, whose
    dictionary is a table that never passes the driver.
    """

    def __init__(
        self,
        roles: Mapping[str, str],
        scaler: str = "minmax",
        remainder: str = "drop",
        dense_categories: int = 1000,
    ):
        if scaler not in SCALERS:
            raise ValueError(f"unknown scaler: {scaler}")
        if remainder not in ("drop", "passthrough"):
            raise ValueError(f"unknown remainder: {remainder}")
        self.roles = dict(roles)
        self.scaler = scaler
        self.remainder = remainder
        self.dense_categories = dense_categories

    def fit(self, df: DataFrame, others: Sequence[str] = ()) -> PreprocessorModel:
        """Statistics over all rows; ``others`` are the columns a passthrough keeps."""
        return self._fit(df, {None: None}, others)[None]

    def fit_by_fold(self, df: DataFrame, fold: str, k: int, others: Sequence[str] = ()) -> dict[int, PreprocessorModel]:
        """One model per fold, each from the rows outside that fold, all from the same scans."""
        masks = {i: F.col(fold) != i for i in range(k)}
        return self._fit(df, masks, others, fold)

    def _fit(self, df, masks: dict, others: Sequence[str], fold: str | None = None) -> dict:
        numeric = [c for c, r in self.roles.items() if r != "cat"]
        categorical = [c for c, r in self.roles.items() if r == "cat"]
        keep = list(others) if self.remainder == "passthrough" else []

        def masked(x: Column, m) -> Column:
            return x if masks[m] is None else F.when(masks[m], x)

        stats: dict = {m: {} for m in masks}
        if numeric:
            wanted = {f"{m}|{c}": masked(clean(F.col(c)), m) for m in masks for c in numeric}
            # The fill lies between the extremes and the transforms are monotone, so the
            # extremes before imputation are those after it and need no pass of their own.
            ends: dict = {}
            extra = {}
            if self.scaler == "minmax":
                for m in masks:
                    for c in numeric:
                        x = F.expr(TRANSFORMS[self.roles[c]].format(f"CAST({sql_name(c)} AS DOUBLE)"))
                        x = masked(clean(x), m)
                        extra[f"lo|{m}|{c}"], extra[f"hi|{m}|{c}"] = F.min(x), F.max(x)
            medians = exact_quantiles(df, wanted, [0.5], extra=extra, found=ends)
            for m in masks:
                for c in numeric:
                    fill = medians[f"{m}|{c}"][0]
                    # A column without any value has nothing to learn from and is left out.
                    if fill is not None:
                        stats[m][c] = ColumnStats(self.roles[c], fill)
                        if self.scaler == "minmax":
                            lo, hi = ends[f"lo|{m}|{c}"], ends[f"hi|{m}|{c}"]
                            stats[m][c].shift, stats[m][c].scale = lo, (hi - lo) if hi > lo else 1.0
            if self.scaler != "minmax":
                self._fit_scale(df, stats, masked)
        if categorical:
            self._fit_categories(df, categorical, stats, fold)
        order = list(self.roles)
        return {
            m: PreprocessorModel({c: stats[m][c] for c in order if c in stats[m]}, keep) for m in masks
        }

    def _fit_scale(self, df: DataFrame, stats: dict, masked) -> None:
        def branch(m, c) -> Column:
            model = PreprocessorModel(stats[m])
            return F.expr(TRANSFORMS[stats[m][c].role].format(model.imputed_sql(c)))

        slots = [(m, c) for m in stats for c in stats[m]]
        if not slots:
            return
        exprs = {f"{i}": masked(branch(m, c), m) for i, (m, c) in enumerate(slots)}
        if self.scaler == "robust":
            spread = exact_quantiles(df, exprs, [0.25, 0.5, 0.75])
            found = [(spread[k][1], spread[k][2] - spread[k][0]) for k in exprs]
        else:
            aggs = [f(x).alias(f"{n}{k}") for k, x in exprs.items() for n, f in (("a", F.avg), ("b", F.stddev_pop))]
            row = df.agg(*aggs).first()
            found = [(row[f"a{k}"], row[f"b{k}"]) for k in exprs]
        for (m, c), (shift, scale) in zip(slots, found):
            stats[m][c].shift, stats[m][c].scale = shift, scale if scale > 0 else 1.0

    def _fit_categories(self, df: DataFrame, cols: list[str], stats: dict, fold: str | None) -> None:
        keyed = df.select(
            (F.col(fold) if fold else F.lit(0)).alias("fold"),
            F.explode(
                F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])
            ).alias("v"),
        )
        # Counts combine before the shuffle; a wide column's stay a table.
        counts = stage_table(keyed.where(F.col("v.value").isNotNull()).groupBy("v.col", "v.value", "fold").count(), "categories")
        widths = {r["col"]: r["n"] for r in counts.groupBy("col").agg(F.count_distinct("value").alias("n")).collect()}
        narrow = [c for c in cols if widths.get(c, 0) <= self.dense_categories]
        rows = counts.where(F.col("col").isin(narrow)).collect() if narrow else []
        for m in stats:
            for c in narrow:
                tally: dict[str, int] = {}
                for r in rows:
                    if r["col"] == c and (m is None or r["fold"] != m):
                        tally[r["value"]] = tally.get(r["value"], 0) + r["count"]
                if tally:
                    fill = min(tally, key=lambda v: (-tally[v], v))
                    stats[m][c] = ColumnStats("cat", fill, categories=sorted(tally))
        for c in cols:
            if c in narrow:
                continue
            mine = counts.where(F.col("col") == c)
            for m in stats:
                known = mine if m is None else mine.where(F.col("fold") != m)
                tally = known.groupBy("value").agg(F.sum("count").alias("n"))
                # The most frequent value, the smallest on a tie, as an aggregate.
                most = tally.agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("most")).first()["most"]
                if most is None:
                    continue
                fill = most["value"]
                path, size = save_dictionary(known.select("value").distinct())
                stats[m][c] = ColumnStats("wide", fill, dictionary=path, size=size)


def transform_by_fold(df: DataFrame, models: Mapping[int, PreprocessorModel], fold: str) -> DataFrame:
    """Each row by the statistics of the rows outside its own fold."""
    names = sorted({n for m in models.values() for n in m.columns})
    exprs = []
    for name in names:
        whens = " ".join(f"WHEN {i} THEN {m.column_sql()[name]}" for i, m in models.items() if name in m.column_sql())
        exprs.append(F.expr(f"CASE {sql_name(fold)} {whens} END").alias(name))
    return df.select("*", *exprs)


def most_frequent(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, count) of the most frequent value, the smallest on ties."""
    pairs = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
        ).alias("v")
    ).select("v.*")
    counts = pairs.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    w = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return counts.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r")
