"""Exact quantiles of many expressions at once, bounded in memory.

Spark's exact ``percentile`` keeps every distinct value of a column in one
buffer, which a continuous column at full size cannot afford; the approximate
form is not exact. Here a sketch brackets each wanted rank, and the next pass
counts the rows below and inside the bracket. Every pass shrinks the bracket to
0.06 % of what it held, until a handful of values is left to sort. Rows inside
brackets are written once they are few, and later passes read no others. Only
bracket ends reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from foldline.functions.numeric import clean
from foldline.session import stage_table

ACCURACY = 10_000
SLACK = 2.0 / ACCURACY
INSIDE_SHARE = 2 * SLACK + 2.0 / ACCURACY  # bracket width plus the sketch error at both ends
HANDFUL = 1_000  # values that a last bracket may hold
STAGED_SHARE = 0.1  # of the rows that may be written for the last passes
BATCH = 48  # searches per aggregation, to keep generated code and buffers small


def _bracket(x: Column, *probs: float) -> Column:
    """Both ends for every probability, from one sketch."""
    return F.percentile_approx(x, [end for q in probs for end in (max(0.0, q - SLACK), min(1.0, q + SLACK))], ACCURACY)


@dataclass
class _Search:
    """One wanted rank, counted among the rows strictly between lo and hi."""

    x: Column
    rank: int
    size: int
    lo: float | None = None
    hi: float | None = None
    answer: float | None = None

    def inside(self) -> Column:
        cond = self.x.isNotNull()
        if self.lo is not None:
            cond = cond & (self.x > self.lo)
        if self.hi is not None:
            cond = cond & (self.x < self.hi)
        return cond

    def sketch(self) -> Column:
        return _bracket(F.when(self.inside(), self.x), self.rank / max(self.size - 1, 1))

    def narrow(self, a: float, b: float, below: int, at_a: int, mid: int, at_b: int) -> None:
        """Move to the part that holds the rank."""
        r = self.rank
        if r < below:
            self.hi, self.size = a, below
        elif r < below + at_a:
            self.answer = a
        elif r < below + at_a + mid:
            self.lo, self.hi, self.rank, self.size = a, b, r - below - at_a, mid
        elif r < below + at_a + mid + at_b:
            self.answer = b
        else:
            done = below + at_a + mid + at_b
            self.lo, self.rank, self.size = b, r - done, self.size - done


def exact_quantiles(
    df: DataFrame,
    exprs: Mapping[str, Column],
    probs: Sequence[float],
    extra: Mapping[str, Column] | None = None,
    found: dict | None = None,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per expression; NULL and NaN are left out.

    ``extra`` aggregates ride along in the first pass; their values go to ``found``.
    """
    out: dict[str, list[float | None]] = {}
    names = list(exprs)
    step = max(1, BATCH // max(len(probs), 1))
    for at in range(0, len(names), step):
        part = {c: clean(exprs[c]) for c in names[at : at + step]}
        out.update(_quantiles(df, part, probs, extra if at == 0 else None, found))
    if extra and not names:
        found.update(df.agg(*[c.alias(n) for n, c in extra.items()]).first().asDict())
    return out


def _quantiles(df, values: dict[str, Column], probs, extra, found) -> dict[str, list[float | None]]:
    names = list(values)
    aggs = [F.count(x).alias(f"n{i}") for i, x in enumerate(values.values())]
    aggs += [_bracket(x, *probs).alias(f"s{i}") for i, x in enumerate(values.values()) if probs]
    first = df.agg(*aggs, *[c.alias(f"x_{n}") for n, c in (extra or {}).items()]).first()
    if extra:
        found.update({n: first[f"x_{n}"] for n in extra})
    sizes = {c: first[f"n{i}"] for i, c in enumerate(names)}
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in names if sizes[c] == 0}

    searches: dict[tuple[str, int], _Search] = {}
    ends: dict[tuple[str, int], tuple[float, float]] = {}
    for i, c in enumerate(names):
        if sizes[c] == 0:
            continue
        for j, p in enumerate(probs):
            pos = p * (sizes[c] - 1)
            for rank in {math.floor(pos), math.ceil(pos)}:
                searches[c, rank] = _Search(values[c], rank, sizes[c])
                ends[c, rank] = tuple(first[f"s{i}"][2 * j : 2 * j + 2])
    todo = list(searches)
    _pass(df, [searches[k] for k in todo], [ends[k] for k in todo])
    few = False
    while True:
        left = [s for s in searches.values() if s.answer is None]
        if not left:
            break
        if not few and sum(s.size for s in left) <= STAGED_SHARE * max(sizes.values()):
            df, few = _inside_rows(df, left), True
        row = df.agg(*[s.sketch().alias(f"s{i}") for i, s in enumerate(left)]).first()
        _pass(df, left, [tuple(row[f"s{i}"]) for i in range(len(left))])
    for c in names:
        if sizes[c] == 0:
            continue
        out[c] = []
        for p in probs:
            pos = p * (sizes[c] - 1)
            lo, hi = searches[c, math.floor(pos)].answer, searches[c, math.ceil(pos)].answer
            out[c].append(lo + (hi - lo) * (pos - math.floor(pos)))
    return out


def _inside_rows(df: DataFrame, left: list[_Search]) -> DataFrame:
    """The values that are still searched, written once: rows that are inside of any search."""
    columns: dict[int, tuple[Column, Column]] = {}
    for s in left:
        columns.setdefault(id(s.x), (s.x.alias(f"__x{len(columns)}"), F.col(f"__x{len(columns)}")))
    part = df.select(*[x for x, _ in columns.values()])
    for s in left:
        s.x = columns[id(s.x)][1]
    return stage_table(part.where(reduce(or_, [s.inside() for s in left])), "inside")


def _pass(df: DataFrame, todo: list[_Search], ends: list[tuple[float, float]]) -> None:
    """Count around every bracket, and read the answer off its inside where that is small.

    Neighbouring ranks of a column share a bracket and its counts.
    """
    aggs, first, like = [], {}, []
    for i, (s, (a, b)) in enumerate(zip(todo, ends)):
        like.append(first.setdefault((id(s.x), s.lo, s.hi, a, b), i))
        inside = s.inside()
        below, at_a = F.count_if(inside & (s.x < a)), F.count_if(inside & (s.x == a))
        mid = inside & (s.x > a) & (s.x < b)
        if like[i] == i:
            aggs += [
                below.alias(f"below{i}"),
                at_a.alias(f"a{i}"),
                F.count_if(mid).alias(f"mid{i}"),
                F.count_if(inside & (s.x == b) & (s.x > a)).alias(f"b{i}"),
            ]
        if s.size * INSIDE_SHARE <= HANDFUL:
            place = (F.lit(s.rank) - below - at_a).cast("int")
            aggs.append(F.get(F.sort_array(F.collect_list(F.when(mid, s.x))), place).alias(f"v{i}"))
    row = df.agg(*aggs).first().asDict()
    for i, (s, (a, b)) in enumerate(zip(todo, ends)):
        s.narrow(a, b, *[row[f"{n}{like[i]}"] for n in ("below", "a", "mid", "b")])
        if s.answer is None and (s.lo, s.hi) == (a, b) and row.get(f"v{i}") is not None:
            s.answer = row[f"v{i}"]
