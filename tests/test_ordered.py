"""Prefix scans, quantiles and splits against brute force, with one dominant group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldline.functions.hashing import hash32
from foldline.operators import quantiles, splits
from foldline.operators.quantiles import exact_quantiles
from foldline.operators.scans import row_numbers, running_min, streak_ends
from foldline.operators.splits import with_folds, with_quantile_bins, with_split


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(1)
    group = np.where(rng.random(3000) < 0.6, "hot", rng.choice(["a", "b", None], 3000))
    pdf = pd.DataFrame({"g": group, "id": np.arange(3000), "v": np.round(rng.normal(size=3000), 2)})
    pdf["t"] = pdf.groupby("g", dropna=False).cumcount()
    return pdf, spark.createDataFrame(pdf, "g string, id long, v double, t long")


def test_row_numbers_equal_a_full_window(hot):
    pdf, df = hot
    got = row_numbers(df, ["g"], F.floor(F.col("v")), ["v", "id"], "rn").toPandas()
    want = pdf.sort_values(["v", "id"]).groupby("g", dropna=False).cumcount() + 1
    assert dict(zip(got["id"], got["rn"])) == dict(zip(pdf.loc[want.index, "id"], want))


@pytest.mark.parametrize("before", [False, True])
def test_running_min(hot, before):
    pdf, df = hot
    got = running_min(df, ["g"], "t", "v", "m", before, chunk=7).toPandas().set_index("id")["m"]
    best = pdf.groupby("g", dropna=False)["v"].cummin()
    if before:
        best = best.groupby(pdf["g"].fillna("-")).shift()
    for i, want in zip(pdf["id"], best):
        assert (np.isnan(want) and (got[i] is None or np.isnan(got[i]))) or got[i] == want


def test_streaks(hot):
    pdf, df = hot
    df, pdf = df.where(F.col("g").isNotNull()), pdf[pdf["g"].notna()]
    got = {(r["g"], r["t"]) for r in streak_ends(df, ["g"], "t", F.col("v") > 0, 4).collect()}
    want = set()
    for g, part in pdf.sort_values("t").groupby("g"):
        run = 0
        for t, v in zip(part["t"], part["v"]):
            run = run + 1 if v > 0 else 0
            if run >= 4:
                want.add((g, t))
    assert got == want


@pytest.mark.parametrize("handful", [3, 1_000])
@pytest.mark.parametrize("kind", ["smooth", "ties", "constant", "outlier", "tiny"])
def test_exact_quantiles(spark, kind, handful, monkeypatch):
    monkeypatch.setattr(quantiles, "HANDFUL", handful)
    rng = np.random.default_rng(2)
    x = {
        "smooth": rng.normal(size=40_000),
        "ties": rng.integers(0, 5, 30_000).astype(float),
        "constant": np.full(1000, 5.0),
        "outlier": np.r_[rng.random(25_000), 1e300, -1e300],
        "tiny": np.array([1.0, 2, 3, 10]),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": np.r_[x, np.nan]}))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, {"x": F.col("x"), "none": F.lit(None).cast("double")}, probs)
    assert np.allclose(got["x"], np.quantile(x, probs), rtol=1e-14, atol=0)
    assert got["none"] == [None] * 5


def test_median_ignores_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,), (float("nan"),)], "x double")
    assert exact_quantiles(df, {"x": F.col("x")}, [0.5])["x"] == [2.5]


def test_fold_sizes(spark):
    df = spark.range(13).withColumn("k", F.col("id").cast("string"))
    sizes = with_folds(df, "k", 5, exact=True).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [3, 3, 3, 2, 2]


@pytest.mark.parametrize("n,k", [(3, 5), (5, 5), (1000, 7)])
def test_exact_folds_follow_the_hash_order(spark, n, k):
    df = spark.range(n).withColumn("k", F.col("id").cast("string"))
    got = with_folds(df, "k", k, exact=True).withColumn("h", hash32("k", 43)).toPandas().sort_values(["h", "k"])
    sizes = [n // k + (i < n % k) for i in range(k)]
    assert got["fold"].tolist() == [i for i in range(k) for _ in range(sizes[i])]


def test_exact_split_per_stratum(hot):
    _, df = hot
    got = with_split(df, "id", 0.2, exact=True, strata=["g"]).groupBy("g", "dataset").count().toPandas()
    for _, part in got.groupby("g", dropna=False):
        n = part["count"].sum()
        assert part.loc[part["dataset"] == "test", "count"].item() == int(np.ceil(0.2 * n))


def test_splits_do_not_depend_on_partitioning(hot):
    _, df = hot
    a = with_split(df.repartition(7), "id", exact=True).orderBy("id").collect()
    assert a == with_split(df.coalesce(1), "id", exact=True).orderBy("id").collect()


def test_quantile_bins_match_pandas(hot):
    pdf, df = hot
    got = with_quantile_bins(df, "v", 4).orderBy("id").toPandas()["bin"]
    assert got.tolist() == pd.qcut(pdf["v"], 4, labels=False).tolist()


@pytest.mark.parametrize("bits", [2, 16])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_two_level_radix_ranks_few_rows(hot, monkeypatch, by, bits):
    """With two bits a level the boundaries fall into large buckets, which the second level cuts again."""
    pdf, df = hot
    monkeypatch.setattr(splits, "MOST_BITS", bits)
    third = lambda rank, n: F.floor((rank - 1) * 3 / n).cast("int")
    got = splits._label_by_rank(df, "id", 9, by, third, "part", limit=20)
    assert got.columns == [*df.columns, "part"]
    h = df.select("id", hash32("id", 9).alias("h")).toPandas()
    whole = pdf.merge(h, on="id").sort_values(["h", "id"])
    groups = whole.groupby(whole["g"].fillna("-").to_numpy() if by else np.zeros(len(whole)))
    rank, size = groups.cumcount(), groups["id"].transform("size")
    want = dict(zip(whole["id"], np.floor(rank * 3 / size).astype(int)))
    assert {r["id"]: r["part"] for r in got.collect()} == want
    assert splits._label_by_rank(df.where("false"), "id", 9, by, third, "part").count() == 0
