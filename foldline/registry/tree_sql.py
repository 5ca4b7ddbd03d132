"""SQL of regression trees and boosting on a few features of few values.

All rows with equal features get the same prediction, so trees grow on cells:
one row per combination of feature values with the count and label sum of its
training rows. Every cut lies midway between neighbouring values of all
training rows, the best one has the largest gain (ties: first feature, lowest
cut).
"""

from __future__ import annotations

from collections.abc import Sequence


def tree(name: str, cells: str, x: Sequence[str], depth: int, least: int = 1) -> list[str]:
    """CTEs from ``cells`` (x..., n, s) to ``name`` (x..., p): one tree."""
    values = " union all ".join(f"select {j} as j, {c} as v from {cells} where n > 0 group by 2" for j, c in enumerate(x))
    out = [f"{name}_u as materialized (select j, v, (v + lead(v) over (partition by j order by v)) / 2 as cut from ({values}))"]
    out += [f"{name}_0 as materialized (select {', '.join(x)}, n, s, 1 as node from {cells})"]
    for level in range(depth):
        rows = f"{name}_{level}"
        sides = " union all ".join(f"select node, {j} as j, {c} as v, sum(n) as n, sum(s) as s from {rows} where n > 0 group by 1, 3" for j, c in enumerate(x))
        out += [
            f"{name}_v{level} as materialized ({sides})",
            f"""{name}_g{level} as materialized (
              select node, j, u.cut, sum(n) over w as nl, sum(s) over w as sl,
                     sum(n) over (partition by node, j) as n, sum(s) over (partition by node, j) as s
              from {name}_v{level} join {name}_u u using (j, v) window w as (partition by node, j order by v))""",
            f"""{name}_b{level} as materialized (
              select node, j, cut from (
                select *, row_number() over (partition by node order by score desc, j, cut) as r from (
                  select *, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) as score
                  from {name}_g{level} where cut is not null and nl >= {least} and n - nl >= {least})
                where score > s * s / n * (1 + 1e-12)) where r = 1)""",
            f"""{name}_{level + 1} as materialized (
              select {', '.join('t.' + c for c in x)}, t.n, t.s,
                     2 * t.node + case when b.cut is not null and (case b.j {' '.join(f'when {j} then t.{c}' for j, c in enumerate(x))} end) > b.cut
                                  then 1 else 0 end as node
              from {rows} t left join {name}_b{level} b using (node))""",
        ]
    last = f"{name}_{depth}"
    out.append(
        f"{name} as materialized (select {', '.join(x)}, l.p from {last} join (select node, sum(s) / sum(n) as p from {last} group by 1) l using (node))"
    )
    return out


def boosted(name: str, cells: str, x: Sequence[str], rounds: int, depth: int, rate: float) -> list[str]:
    """CTEs to ``name`` (x..., p): the first tree as it is, then trees on twice the residuals, each times the rate."""
    cols = ", ".join(x)
    out = tree(f"{name}_t0", cells, x, depth) + [f"{name}_f0 as materialized (select * from {name}_t0)"]
    for m in range(1, rounds):
        before = f"{name}_f{m - 1}"
        out.append(f"{name}_c{m} as materialized (select {cols}, c.n, 2 * (c.s - c.n * f.p) as s from {cells} c join {before} f using ({cols}))")
        out += tree(f"{name}_t{m}", f"{name}_c{m}", x, depth)
        out.append(f"{name}_f{m} as materialized (select {cols}, f.p + {rate}::double * t.p as p from {before} f join {name}_t{m} t using ({cols}))")
    out.append(f"{name} as (select * from {name}_f{rounds - 1})")
    return out


def cells(name: str, rows: str, x: Sequence[str], inside: str) -> str:
    """One row per feature combination of ``rows``, with count and label sum of the rows that are ``inside``."""
    cols = ", ".join(x)
    return f"{name} as materialized (select {cols}, count(*) filter ({inside}) as n, coalesce(sum(y) filter ({inside}), 0)::double as s from {rows} group by {cols})"
