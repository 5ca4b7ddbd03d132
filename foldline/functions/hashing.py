"""Portable row hashes: the same value in any engine that has MD5."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

HASH_RANGE = 1 << 32


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def hash_text(text: Column) -> Column:
    """First 32 bits of MD5 as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _seeded(key: str | Sequence[str], seed: int) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in as_list(key)])


def hash32(key: str | Sequence[str], seed: int) -> Column:
    return hash_text(_seeded(key, seed))


def hash_below(key: str | Sequence[str], seed: int, limit: int) -> Column:
    """``hash32(key, seed) < limit``; hexadecimal digits are in the order of their numbers, and need not become any."""
    if not 0 <= limit < HASH_RANGE:
        return hash32(key, seed) < limit
    return F.substring(F.md5(_seeded(key, seed)), 1, 8) < F.lit(f"{limit:08x}")


def hash_unit(text: Column) -> Column:
    """Uniform value in [0, 1)."""
    return hash_text(text).cast("double") / F.lit(float(HASH_RANGE))
