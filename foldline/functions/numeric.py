"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean(x: Column) -> Column:
    """Double with NaN turned into NULL, so that it counts as missing."""
    d = x.cast("double")
    return F.when(~F.isnan(d), d)


def round_half_up(x: Column, places: int) -> Column:
    """Decimal rounding in plain double arithmetic, equal in every IEEE engine."""
    scale = float(10**places)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def sql_double(value: float) -> str:
    """A double literal for Spark SQL text."""
    return f"CAST('{value!r}' AS DOUBLE)" if value != value or abs(value) == float("inf") else f"({value!r}D)"


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
