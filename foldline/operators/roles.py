"""Which columns feed which target, and how each is treated."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from foldline.functions.numeric import clean

# Columns that take the log and exp branch unless roles say otherwise.
LOG_COLUMNS = ("phi_mn",)
EXP_COLUMNS = ("rho",)


def features_by_target(
    cols: Sequence[str], targets: Sequence[str], exclusions: Mapping[str, Sequence[str]] | None = None
) -> dict[str, list[str]]:
    """Every column but the target itself and the columns excluded for it."""
    exclusions = exclusions or {}
    return {t: [c for c in cols if c != t and c not in exclusions.get(t, ())] for t in targets}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c not in numeric]


def column_roles(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    log: Iterable[str] = LOG_COLUMNS,
    exp: Iterable[str] = EXP_COLUMNS,
) -> dict[str, str]:
    """``{column: 'num' | 'log' | 'exp' | 'cat'}`` by type and lower-cased name."""
    log, exp = {c.lower() for c in log}, {c.lower() for c in exp}
    numeric = set(numeric_columns(df))

    def role(c: str) -> str:
        if c not in numeric:
            return "cat"
        return "log" if c.lower() in log else "exp" if c.lower() in exp else "num"

    return {c: role(c) for c in (cols or df.columns)}


def dtypes_of(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    types = dict(df.dtypes)
    return {c: types[c] for c in cols}


def as_target(df: DataFrame, target: str, name: str = "y") -> DataFrame:
    return df.withColumn(name, clean(F.col(target)))


def usable_targets(df: DataFrame, candidates: Sequence[str], min_unique: int = 3) -> list[str]:
    """Candidates with at least ``min_unique`` distinct non-missing values.

    Finds the smallest value, then the next smallest, and so on: ``min_unique``
    scans of the candidate columns and no shuffle of distinct values.
    """
    last: dict[str, object] = {c: None for c in candidates}
    alive = list(candidates)
    types = dict(df.dtypes)

    def value(c):
        return clean(F.col(c)) if types[c] in ("double", "float") else F.col(c)

    for step in range(min_unique):
        if not alive:
            break
        aggs = [
            F.min(value(c) if step == 0 else F.when(value(c) > F.lit(last[c]), value(c))).alias(f"m{i}")
            for i, c in enumerate(alive)
        ]
        row = df.agg(*aggs).first()
        last = {c: row[f"m{i}"] for i, c in enumerate(alive)}
        alive = [c for c in alive if last[c] is not None]
    return alive
