"""Train/test splits and folds as columns.

The default assigns by hash and needs no shuffle. ``exact=True`` gives exact
sizes: rows are ranked by (hash, key), but only rows in the few hash buckets
that a boundary falls into are ever sorted; all others follow from bucket
counts. The key must identify a row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldline.functions.hashing import HASH_RANGE, as_list, hash32, hash_below
from foldline.operators.quantiles import exact_quantiles
from foldline.operators.scans import bucket_offsets, null_safe_join
from foldline.session import drop_staged, sized, stage_table


LIMIT = 10_000  # rows of a bucket that are ranked in one task, on average
MOST_BITS = 16  # of one histogram


def _bits(count: Column, limit: int) -> Column:
    """Bits of the hash that cut so many rows into buckets of about ``limit``."""
    return F.least(F.greatest(F.ceil(F.log2(count / limit)), F.lit(0)), F.lit(MOST_BITS)).cast("int")


EDGE_BITS = 16  # of the hash that a bucket keeps to itself where rows are not grouped
PLAIN_KEYS = ("string", "tinyint", "smallint", "int", "bigint", "boolean")  # that a literal repeats exactly


def _label_by_edges(tagged: DataFrame, key: str | Sequence[str], label: Callable[[Column, Column], Column], name: str) -> DataFrame | None:
    """Labels of the whole table by comparing (hash, key) with the lowest one of every label.

    Bucket counts say where labels change; only rows of those buckets are
    sorted, and one row a label comes back. Nothing is joined or written. None
    where equal keys lie on both sides of a change, or a key has no literal.
    """
    keys = as_list(key)
    kinds = dict(tagged.dtypes)
    if any(kinds[c] not in PLAIN_KEYS for c in keys):
        return None
    rows = tagged.select("__h", *keys).withColumn("__bucket", F.shiftright("__h", EDGE_BITS))
    first, last = label(F.col("__start") + 1, F.col("__total")), label(F.col("__start") + F.col("__cnt"), F.col("__total"))
    counts = sized(bucket_offsets(rows, [], "__bucket").select("*", first.alias("__first"), last.alias("__last")))
    whole = counts.where(F.col("__first") == F.col("__last")).groupBy(F.col("__first").alias("label")).agg(F.min("__bucket").alias("at")).collect()
    lowest = {r["label"]: (r["at"] << EDGE_BITS, None) for r in whole}
    edges = counts.where(F.col("__first") != F.col("__last")).select("__bucket", "__start", "__total").collect()  # fewer than labels
    if edges:
        start = F.create_map(*[F.lit(v) for e in edges for v in (e["__bucket"], e["__start"])])
        near = rows.where(F.col("__bucket").isin([e["__bucket"] for e in edges]))
        rank = F.row_number().over(W.partitionBy("__bucket").orderBy("__h", *keys)) + start[F.col("__bucket")]
        row = F.struct("__h", *keys)
        found = near.select(label(rank, F.lit(edges[0]["__total"])).alias("label"), row.alias("row")).groupBy("label").agg(F.min("row").alias("low"), F.max("row").alias("high"))
        found = found.collect()
        lows = {tuple(r["low"]): r["label"] for r in found}
        if len(lows) < len(found) or any(lows.get(tuple(r["high"]), r["label"]) != r["label"] for r in found):
            return None
        for r in found:
            at = (r["low"]["__h"], tuple(r["low"])[1:])
            if r["label"] not in lowest or at[0] < lowest[r["label"]][0]:
                lowest[r["label"]] = at
    ordered = sorted(lowest, key=lambda v: lowest[v][0])
    if len({lowest[v][0] for v in ordered}) < len(ordered):  # two changes at one hash
        return None
    out = F.lit(ordered[0]) if ordered else F.lit(None)
    for value in ordered[1:]:
        h, rest = lowest[value]
        above = F.col("__h") >= h
        if rest is not None:
            same = F.struct(*keys) >= F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for v, c in zip(rest, keys)])
            above = (F.col("__h") > h) | ((F.col("__h") == h) & same)
        out = F.when(above, F.lit(value)).otherwise(out)
    return tagged.withColumn(name, out) if ordered else None


def _label_by_rank(
    df: DataFrame,
    key: str | Sequence[str],
    seed: int,
    by: Sequence[str],
    label: Callable[[Column, Column], Column],
    name: str,
    limit: int = LIMIT,
    staged: bool = False,
) -> DataFrame:
    """Label rows by their hash rank; ``label(rank, total)`` must be monotone in rank.

    A radix in two levels: every group is cut by as many bits of the hash as
    its own count asks for, and bucket counts settle all buckets that no
    boundary falls into. Buckets with a boundary that are still large are cut
    by the next bits. Only rows of the last few buckets are sorted. The input
    is written once; a small group is one bucket, so counts stay far fewer
    than rows however many groups there are.
    """
    cols, by = df.columns, list(by)
    tagged = df.withColumn("__h", hash32(key, seed))
    plain = _label_by_edges(tagged, key, label, name) if staged and not by else None
    if plain is not None:
        return plain.select(*[c for c in cols if c != name], name)
    tagged = stage_table(tagged, "ranked")
    if by:
        sizes = tagged.groupBy(*by).agg(F.count("*").alias("__n"))
        tagged = null_safe_join(tagged, sized(sizes.select(*by, _bits(F.col("__n"), limit).alias("__bits"))), by)
    else:
        tagged = tagged.withColumn("__bits", _bits(F.lit(max(1, tagged.count())), limit))
    tagged = tagged.withColumn("__bucket", F.expr("shiftright(__h, 32 - __bits)"))

    def cut(rows: DataFrame, keys: list[str], bucket: str, start: Column, total: Column | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rows of settled buckets, labelled; rows of the others with their bucket's start; their counts)."""
        offsets = bucket_offsets(rows, keys, bucket)
        if total is not None:  # inside a bucket: its own start comes first
            outer = rows.select(*keys, start.alias("__s"), total.alias("__t")).distinct()
            offsets = null_safe_join(offsets.drop("__total"), outer, keys).withColumn("__start", F.col("__start") + F.col("__s")).withColumnRenamed("__t", "__total").drop("__s")
        first, last = label(F.col("__start") + 1, F.col("__total")), label(F.col("__start") + F.col("__cnt"), F.col("__total"))
        counts = sized(offsets.select(*keys, bucket, "__start", "__total", "__cnt", first.alias("__first"), last.alias("__last")))
        joined = null_safe_join(rows.drop("__start", "__total"), counts, [*keys, bucket])
        settled = joined.where(F.col("__first") == F.col("__last")).select(*cols, F.col("__first").alias(name))
        edge = joined.where(F.col("__first") != F.col("__last")).drop("__first", "__last")
        return settled, edge, counts.where(F.col("__first") != F.col("__last"))

    settled, edge, counts = cut(tagged, by, "__bucket", F.lit(0), None)
    last = ["__bucket"]
    if not counts.where(F.col("__cnt") > 4 * limit).isEmpty():
        deeper = edge.withColumn("__more", _bits(F.col("__cnt"), limit)).drop("__cnt")
        deeper = deeper.withColumn("__inner", F.expr("shiftright(__h & (shiftleft(1L, 32 - __bits) - 1), greatest(32 - __bits - __more, 0))"))
        more, edge, _ = cut(deeper, [*by, "__bucket"], "__inner", F.col("__start"), F.col("__total"))
        settled, last = settled.unionByName(more), ["__bucket", "__inner"]
    w = W.partitionBy(*by, *last).orderBy("__h", *as_list(key))
    rank = F.row_number().over(w) + F.col("__start")
    return settled.unionByName(edge.select(*cols, label(rank, F.col("__total")).alias(name)))


BRACKET_FROM = 1_000  # rows of a group from where its folds' boundaries are looked for in brackets
MARGIN = 4  # standard deviations of a boundary's place among uniform hashes that its bracket reaches to either side


def _tile(k: int) -> Callable[[Column, Column], Column]:
    """The exact fold of a row by its rank (from 1) of n."""

    def tile(rank: Column, n: Column) -> Column:
        base, extra = F.floor(n / k), n % k
        big = extra * (base + 1)
        return (
            F.when(rank <= big, F.floor((rank - 1) / (base + 1)))
            .otherwise(extra + F.floor((rank - 1 - big) / F.greatest(base, F.lit(1))))
            .cast("int")
        )

    return tile


def _brackets(n: Column, k: int) -> Column:
    """Hashes in order that cut a group of n rows into stretches; each of its k - 1 boundaries lies, but for chance, in a narrow one."""
    ends = []
    for p in (i / k for i in range(1, k)):
        reach = (F.sqrt(n * (p * (1 - p))) * MARGIN + 2) / n
        ends += [F.greatest(p - reach, F.lit(0.0)), F.least(p + reach, F.lit(1.0))]
    edges = F.array_sort(F.array(*[F.floor(v * HASH_RANGE).cast("long") for v in ends])) if ends else F.array().cast("array<bigint>")
    return F.when(n > BRACKET_FROM, edges).otherwise(F.array().cast("array<bigint>"))


def with_folds_by_group(
    df: DataFrame, key: str | Sequence[str], by: Sequence[str], folds: Mapping[str, tuple[int, int]], staged: bool = False, keep: Sequence[str] | None = None,
    limit: int = LIMIT, sizes: DataFrame | None = None, known: bool = False,
) -> DataFrame:
    """Exact folds inside every group, any number of them at once: ``folds`` has (k, seed) for each new column.

    Hashes are uniform, so the size of a group says nearly where its folds
    change. Rows are counted in the brackets around these places and in the
    stretches between them, one row a group; only hashes of stretches with a
    change are sorted, some 7 % of a group of 50,000 rows and fewer of a larger
    one, for the first hash of every fold. All rows get their folds by comparing
    with these, and with keys where a change lies between equal hashes. A change
    outside its bracket costs a longer sort, not a row. Groups of up to
    ``BRACKET_FROM`` rows are one stretch; stretches of more than ``4 * limit``
    rows are cut by their hashes and counts before they are sorted. Rows are
    written with their hashes and with their folds, and the input before that
    unless it is ``staged``, which says that it comes from files, and is read
    twice; the earlier copies are deleted when the next is whole. ``keep``: the columns wanted. ``sizes``: the groups and their number
    of rows ``__total``, where they are counted already. ``known``: no group key
    is NULL, so that rows meet their groups by plain equality.
    """
    by, deals, key_cols = list(by), list(folds.values()), as_list(key)
    cols = [c for c in (df.columns if keep is None else keep) if c not in folds]
    rows = df if staged else stage_table(df, "dealt")
    n = F.col("__total")
    meet = (lambda left, right, how="inner": left.join(right, by, how)) if known else (lambda left, right, how="inner": null_safe_join(left, right, by, how))
    edges = [_brackets(n, k).alias(f"__edges{i}") for i, (k, _) in enumerate(deals)]
    counted = rows.groupBy(*by).agg(F.count("*").alias("__total")) if sizes is None else sizes
    sizes = sized(counted.select(*by, "__total", *edges))

    # A row's stretch of every deal: how many ends of stretches are not above its hash.
    at = [[F.coalesce((F.col(f"__h{i}") >= F.get(f"__edges{i}", F.lit(j))).cast("int"), F.lit(0)) for j in range(2 * (k - 1))] for i, (k, _) in enumerate(deals)]
    hashed = rows.select(*dict.fromkeys([*by, *cols]), *[F.col(c).alias(f"__k{j}") for j, c in enumerate(key_cols)], *[hash32(key, seed).alias(f"__h{i}") for i, (_, seed) in enumerate(deals)])
    placed = meet(hashed, sizes).select(*hashed.columns, F.monotonically_increasing_id().alias("__id"), *[sum(v, F.lit(0)).alias(f"__at{i}") for i, v in enumerate(at)])
    dealt = stage_table(placed, "dealt", (), True)
    if not staged:
        drop_staged(rows)

    counts = [F.count_if(F.col(f"__at{i}") == j).alias(f"__n{i}_{j}") for i, (k, _) in enumerate(deals) for j in range(2 * k - 1)]
    found = []
    for i, (k, _) in enumerate(deals):
        here = [F.col(f"__n{i}_{j}") for j in range(2 * k - 1)]
        starts = [sum(here[:j], F.lit(0).cast("long")) for j in range(len(here))]
        ends = [(_tile(k)(s + 1, n), _tile(k)(s + c, n)) for s, c in zip(starts, here)]
        found += [F.array(*starts).alias(f"__starts{i}"), F.array(*here).alias(f"__counts{i}"), F.array(*[a for a, _ in ends]).alias(f"__folds{i}")]
        found += [F.array(*[(a != b) & (c > 0) for (a, b), c in zip(ends, here)]).alias(f"__open{i}")]
        found.append(F.greatest(*[F.when(a != b, c).otherwise(0) for (a, b), c in zip(ends, here)], F.lit(0)).alias(f"__most{i}"))
    groups = sized(meet(dealt.groupBy(*by).agg(*counts), sizes).select(*by, "__total", *[f"__edges{i}" for i in range(len(deals))], *found))
    most = groups.agg(*[F.max(f"__most{i}") for i in range(len(deals))]).first()

    def firsts(i: int, k: int, order: list[str]) -> DataFrame:
        """(by, ``__row``, ``__fold``, ``__tied``): the first row of every fold that begins inside a stretch, and whether its hash is not the first of its kind."""
        h, cut = F.col(f"__h{i}"), most[i] is not None and most[i] > 4 * limit
        of_group = groups.where(F.col(f"__most{i}") > 0).select(*by, "__total", *[f"__{c}{i}" for c in ("edges", "starts", "counts", "open")])
        near = meet(dealt.select(*by, f"__at{i}", f"__h{i}", *order), of_group).where(F.get(f"__open{i}", F.col(f"__at{i}")))
        inside, before = [*by, f"__at{i}"], F.get(f"__starts{i}", F.col(f"__at{i}"))
        if cut:
            low, high = F.coalesce(F.get(f"__edges{i}", F.col(f"__at{i}") - 1), F.lit(0)), F.coalesce(F.get(f"__edges{i}", F.col(f"__at{i}")), F.lit(HASH_RANGE))
            near = near.withColumn("__piece", F.floor((h - low) / (high - low) * F.pow(F.lit(2.0), _bits(F.get(f"__counts{i}", F.col(f"__at{i}")), limit))))
        near = near.select(*inside, *(["__piece"] if cut else []), f"__h{i}", *order, "__total", before.alias("__before"))
        if cut:
            offsets = sized(bucket_offsets(near, inside, "__piece").select(*inside, "__piece", F.col("__start").alias("__more")))
            inside = [*inside, "__piece"]
            near = null_safe_join(near, offsets, inside).withColumn("__before", F.col("__before") + F.col("__more"))
        w = W.partitionBy(*inside).orderBy(h, *order)
        ranked = near.select(*by, F.struct(h, *order).alias("__row"), "__total", (F.row_number().over(w) + F.col("__before")).alias("__rank"), F.lag(h).over(w).alias("__last"))
        rank = F.col("__rank")
        begins = (rank > 1) & (_tile(k)(rank, n) != _tile(k)(rank - 1, n))
        return sized(ranked.where(begins).select(*by, "__row", _tile(k)(rank, n).alias("__fold"), F.coalesce(F.col("__last") == F.col(f"__row.__h{i}"), F.lit(False)).alias("__tied")))

    # A fold's first row: inside a stretch, or where a stretch begins with it. Rows compare with plain columns, one a fold.
    by_group, fold = groups.select(*by, *[f"__{c}{i}" for c in ("edges", "counts", "folds") for i in range(len(deals))]), []
    for i, (k, _) in enumerate(deals):
        order: list[str] = []
        first = firsts(i, k, order)
        if not first.where("__tied").isEmpty():  # equal hashes go by key
            order = [*[f"__k{j}" for j in range(len(key_cols))], "__id"]
            first = firsts(i, k, order)
        steps = []
        if k > 1:
            inside = first.groupBy(*by).agg(*[F.min(F.when(F.col("__fold") == j, F.col("__row"))).alias(f"__first{i}_{j}") for j in range(1, k)])
            by_group = meet(by_group, inside, "left")
        for j in range(1, k):
            found, h = F.col(f"__first{i}_{j}"), F.col(f"__h{i}")
            begins = [F.when((F.get(f"__folds{i}", F.lit(at)) == j) & (F.get(f"__counts{i}", F.lit(at)) > 0), F.get(f"__edges{i}", F.lit(at - 1))) for at in range(1, 2 * k - 1)]
            by_group = by_group.withColumn(f"__low{i}_{j}", F.coalesce(found[f"__h{i}"], *begins))
            low = F.col(f"__low{i}_{j}")
            reached = h >= low
            if order:  # where the fold begins between equal hashes, by key
                reached = F.when(found.isNull() | (h != low), reached).otherwise(F.struct(h, *order) >= found)
            else:
                by_group = by_group.drop(f"__first{i}_{j}")
            steps.append(F.when(reached, 1).otherwise(0))
        fold.append(sum(steps, F.lit(0)))
        by_group = by_group.drop(*[f"__{c}{i}" for c in ("edges", "counts", "folds")])
    out = stage_table(meet(dealt, sized(by_group)).select(*cols, *[f.alias(name) for f, name in zip(fold, folds)]), "dealt")
    drop_staged(dealt)
    return out


def with_split(
    df: DataFrame,
    key: str | Sequence[str],
    test: float = 0.2,
    seed: int = 42,
    exact: bool = False,
    strata: Sequence[str] = (),
    name: str = "dataset",
) -> DataFrame:
    """Mark rows 'test' or 'train'. Exact mode puts ``ceil(test * n)`` rows (per stratum) into test."""
    if not exact and not strata:
        return df.withColumn(name, F.when(hash_below(key, seed, int(test * HASH_RANGE)), "test").otherwise("train"))
    side = lambda rank, n: F.when(rank <= F.ceil(n * F.lit(test)), "test").otherwise("train")
    return _label_by_rank(df, key, seed, list(strata), side, name)


def with_folds(
    df: DataFrame,
    key: str | Sequence[str],
    k: int = 5,
    seed: int = 43,
    by: Sequence[str] = (),
    exact: bool = False,
    name: str = "fold",
    staged: bool = False,
) -> DataFrame:
    """Fold number 0..k-1; exact mode gives sizes that differ by at most one (per group of ``by``).

    ``staged``: the rows come from files, and are read again rather than written once more and joined.
    """
    if not exact and not by:
        return df.withColumn(name, (hash32(key, seed) % k).cast("int"))

    if by:
        return with_folds_by_group(df, key, by, {name: (k, seed)}, staged)
    return _label_by_rank(df, key, seed, [], _tile(k), name, staged=staged)


def with_quantile_bins(df: DataFrame, col: str, bins: int, name: str = "bin") -> DataFrame:
    """Bin number by exact quantile edges, right-closed, equal edges merged."""
    probs = [i / bins for i in range(1, bins)]
    edges = sorted(set(exact_quantiles(df, {col: F.col(col)}, probs)[col]))
    number = sum([F.when(F.col(col) > e, 1).otherwise(0) for e in edges], F.lit(0))
    return df.withColumn(name, F.when(F.col(col).isNotNull(), number))


def stratified_split(
    df: DataFrame, key: str | Sequence[str], col: str, bins: int = 5, test: float = 0.2, seed: int = 42
) -> DataFrame:
    """Exact split inside quantile bins of ``col``."""
    return with_split(with_quantile_bins(df, col, bins, "bin"), key, test, seed, exact=True, strata=["bin"])
