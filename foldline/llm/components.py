"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foldline.llm.common import stage


def _signature(df: DataFrame) -> tuple:
    mixed = F.xxhash64("hi", "lo")
    return tuple(df.agg(F.count("*"), F.sum(mixed % 1_000_003), F.sum(F.shiftright(mixed, 20) % 1_000_003)).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the smallest node reachable.

    Every step replaces links by links to a smaller neighbour: minima by a
    grouped aggregate and a join, so that no neighbourhood is ever gathered.
    Steps are written to the shared folder. Self links and repeated links are
    allowed; an empty table gives an empty table.
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi != lo").distinct()
    edges = stage(edges, "links")
    seen = _signature(edges)
    while seen[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pair = F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))))
        small = large.join(low, "hi").select(pair.alias("e")).select("e.hi", "e.lo").where("hi != lo").distinct()
        edges = stage(small, "links")
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
