"""Queries on the feature rows: roles, splits, preprocessing, scores and reports."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from foldline import fixtures as fx
from foldline.functions.metrics import fold_means, metric_columns, regression_metrics
from foldline.functions.numeric import round_half_up as r
from foldline.operators import reports
from foldline.operators.group_means import fit_group_mean, oof_group_mean, predict_group_mean
from foldline.operators.groups import group_sizes
from foldline.operators.preprocess import Preprocessor, most_frequent, transform_by_fold
from foldline.operators.quantiles import exact_quantiles
from foldline.operators.roles import column_roles, features_by_target, usable_targets
from foldline.operators.splits import stratified_split, with_folds, with_split
from foldline.session import shared_dir, stage_table
from foldline.sources.tables import read_checked_csv, read_table, write_scores
from foldline.registry.base import FEATURE_ROWS, SPLIT_ROWS, hash_sql, query, rnd


def split_rows(spark, sf) -> DataFrame:
    return with_folds(with_split(fx.feature_rows(spark, sf), "row_key"), "row_key")


def prepared(spark, sf, *cols: str) -> DataFrame:
    """Split rows staged once: fits scan them several times, and 'train' is a partition."""
    rows = split_rows(spark, sf).select("row_key", "fold", *cols, "dataset")
    return stage_table(rows, "rows", ["dataset"])


@query(
    "feature_rows",
    f"""with {FEATURE_ROWS}
    select * exclude (charge, unit_price), {rnd('charge', 6)} as charge, {rnd('unit_price', 6)} as unit_price
    from feature_rows""",
)
def q_feature_rows(spark, sf):
    rows = fx.feature_rows(spark, sf)
    return rows.withColumn("charge", r(F.col("charge"), 6)).withColumn("unit_price", r(F.col("unit_price"), 6))


@query(
    "features_by_target",
    f"""with {FEATURE_ROWS},
    cols as (select unnest(['qty', 'price', 'disc', 'tax', 'size', 'retail', 'const1', 'charge', 'unit_price',
                            'flag', 'status', 'brand_gap']) as feature),
    targets as (select unnest(['charge', 'unit_price', 'retail', 'disc']) as target),
    excluded as (select * from (values ('charge', 'unit_price'), ('unit_price', 'charge')) v(target, feature)),
    filled as (
      select row_key, unnest(['qty', 'price', 'disc', 'tax', 'size', 'retail', 'const1', 'charge', 'unit_price',
                              'flag', 'status', 'brand_gap']) as feature,
             unnest([qty is not null, price is not null, disc is not null, tax is not null, size is not null,
                     retail is not null, const1 is not null, charge is not null, unit_price is not null,
                     flag is not null, status is not null, brand_gap is not null]) as has
      from feature_rows),
    labelled as (
      select row_key, unnest(['charge', 'unit_price', 'retail', 'disc']) as target,
             unnest([charge is not null, unit_price is not null, retail is not null, disc is not null]) as has
      from feature_rows),
    counts as (select l.target, f.feature, count(*) filter (where f.has and l.has) as n_usable
               from filled f join labelled l using (row_key) group by 1, 2)
    select t.target, c.feature, n.n_usable,
           case when c.feature in ('flag', 'status', 'brand_gap') then 'cat' when c.feature = 'charge' then 'log'
                when c.feature = 'disc' then 'exp' else 'num' end as role
    from targets t cross join cols c join counts n on n.feature = c.feature and n.target = t.target
    where c.feature <> t.target
      and not exists (select 1 from excluded e where e.target = t.target and e.feature = c.feature)
      and exists (select 1 from labelled l where l.target = t.target and l.has)""",
)
def q_features_by_target(spark, sf):
    rows = fx.feature_rows(spark, sf)
    roles = column_roles(rows, fx.COLUMNS, fx.LOG, fx.EXP)
    pairs = [(t, f) for t, fs in features_by_target(fx.COLUMNS, fx.TARGETS, fx.EXCLUSIONS).items() for f in fs]
    both = rows.agg(
        *[F.count_if(F.col(f).isNotNull() & F.col(t).isNotNull()).alias(f"n{i}") for i, (t, f) in enumerate(pairs)]
    )
    entries = [
        F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"), F.lit(roles[f]).alias("role"), F.col(f"n{i}").alias("n_usable"))
        for i, (t, f) in enumerate(pairs)
    ]
    return both.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


@query(
    "usable_targets",
    f"""with {FEATURE_ROWS}
    select 'charge' as target, count(charge) as n_rows, count(distinct charge) >= 3 as usable from feature_rows
    union all select 'unit_price', count(unit_price), count(distinct unit_price) >= 3 from feature_rows
    union all select 'retail', count(retail), count(distinct retail) >= 3 from feature_rows
    union all select 'disc', count(disc), count(distinct disc) >= 3 from feature_rows
    union all select 'qty', count(qty), count(distinct qty) >= 3 from feature_rows
    union all select 'status', count(status), count(distinct status) >= 3 from feature_rows
    union all select 'const1', count(const1), count(distinct const1) >= 3 from feature_rows""",
)
def q_usable_targets(spark, sf):
    rows = stage_table(fx.feature_rows(spark, sf).select("charge", "unit_price", "retail", "disc", "qty", "status", "const1"), "rows")
    names = ["charge", "unit_price", "retail", "disc", "qty", "status", "const1"]
    usable = usable_targets(rows, names)
    counts = rows.agg(*[F.count(c).alias(c) for c in names])
    entries = [
        F.struct(F.lit(c).alias("target"), F.col(c).alias("n_rows"), F.lit(c in usable).alias("usable")) for c in names
    ]
    return counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


@query("dedup_rows", f"with {FEATURE_ROWS} select distinct flag, status, brand, disc, tax from feature_rows")
def q_dedup_rows(spark, sf):
    return fx.feature_rows(spark, sf).select("flag", "status", "brand", "disc", "tax").dropDuplicates()


@query(
    "group_sizes",
    """select p_brand as brand, cast(p_size % 3 as integer) as size_class, count(*) as n_rows,
              case when count(*) > 25 then 30 else 10 end as n_trials
       from part group by 1, 2""",
)
def q_group_sizes(spark, sf):
    part = fx.table(spark, sf, "part")
    keyed = part.select(F.col("p_brand").alias("brand"), (F.col("p_size") % 3).alias("size_class"))
    return group_sizes(keyed, ["brand", "size_class"])


# Splits and folds


@query("hash_split", f"with {SPLIT_ROWS} select row_key, dataset, fold from split_rows")
def q_hash_split(spark, sf):
    return split_rows(spark, sf).select("row_key", "dataset", "fold")


@query(
    "exact_split",
    f"""with {FEATURE_ROWS}, ranked as (
      select row_key, row_number() over (order by {hash_sql(42)}, row_key) as rk, count(*) over () as n from feature_rows)
    select row_key, case when rk <= ceil(n * 0.2::double) then 'test' else 'train' end as dataset from ranked""",
)
def q_exact_split(spark, sf):
    return with_split(fx.feature_rows(spark, sf).select("row_key"), "row_key", exact=True)


@query(
    "fold_sizes",
    f"""with {FEATURE_ROWS}, folded as (
      select cast({hash_sql(43)} % 5 as integer) as by_hash,
             cast(ntile(5) over (order by {hash_sql(43)}, row_key) - 1 as integer) as by_rank from feature_rows)
    select h.fold, n_hash, n_exact from (select by_hash as fold, count(*) as n_hash from folded group by 1) h
    join (select by_rank as fold, count(*) as n_exact from folded group by 1) e on e.fold = h.fold""",
)
def q_fold_sizes(spark, sf):
    keys = fx.feature_rows(spark, sf).select("row_key")
    by_hash = with_folds(keys, "row_key").groupBy("fold").agg(F.count("*").alias("n_hash"))
    exact = with_folds(keys, "row_key", exact=True).groupBy("fold").agg(F.count("*").alias("n_exact"))
    return by_hash.join(exact, "fold")


@query(
    "group_folds",
    f"""with {FEATURE_ROWS}
    select row_key, flag, status,
           cast(ntile(5) over (partition by flag, status order by {hash_sql(43)}, row_key) - 1 as integer) as fold
    from feature_rows""",
)
def q_group_folds(spark, sf):
    keys = fx.feature_rows(spark, sf).select("row_key", "flag", "status")
    return with_folds(keys, "row_key", by=["flag", "status"], exact=True)


@query(
    "nested_fold_sizes",
    f"""with {SPLIT_ROWS}
    select fold, cast({hash_sql(1043)} % 5 as integer) as inner_fold, count(*) as n
    from split_rows where dataset = 'train' group by 1, 2""",
)
def q_nested_fold_sizes(spark, sf):
    train = split_rows(spark, sf).where(F.col("dataset") == "train")
    inner = with_folds(train, "row_key", seed=1043, name="inner_fold")
    return inner.groupBy("fold", "inner_fold").agg(F.count("*").alias("n"))


@query(
    "stratified_split",
    f"""with {FEATURE_ROWS},
    edges as (select quantile_cont(charge, [0.2, 0.4, 0.6, 0.8]) as q from feature_rows),
    binned as (
      select row_key, cast((charge > q[1])::int + (charge > q[2])::int + (charge > q[3])::int + (charge > q[4])::int
                           as integer) as bin
      from feature_rows, edges),
    ranked as (
      select row_key, bin, row_number() over (partition by bin order by {hash_sql(42)}, row_key) as rk,
             count(*) over (partition by bin) as n
      from binned)
    select row_key, bin, case when rk <= ceil(n * 0.2::double) then 'test' else 'train' end as dataset from ranked""",
)
def q_stratified_split(spark, sf):
    rows = stage_table(fx.feature_rows(spark, sf).select("row_key", "charge"), "rows")
    return stratified_split(rows, "row_key", "charge").drop("charge")


# Preprocessing


@query(
    "impute_median",
    f"""with {SPLIT_ROWS},
    med as (select median(qty) as m_qty, median(price) as m_price from split_rows where dataset = 'train')
    select row_key, coalesce(qty, m_qty) as qty, coalesce(price, m_price) as price,
           {rnd('m_price', 6)} as fill_price
    from split_rows, med""",
)
def q_impute_median(spark, sf):
    rows = prepared(spark, sf, "qty", "price")
    model = Preprocessor({"qty": "num", "price": "num"}).fit(rows.where(F.col("dataset") == "train"))
    return rows.select(
        "row_key",
        F.expr(model.imputed_sql("qty")).alias("qty"),
        F.expr(model.imputed_sql("price")).alias("price"),
        r(F.lit(model.stats["price"].fill), 6).alias("fill_price"),
    )


@query(
    "impute_mode",
    f"""with {SPLIT_ROWS},
    counts as (select brand_gap, count(*) as n from split_rows where dataset = 'train' and brand_gap is not null group by 1),
    top as (select brand_gap as fill, n as n_fill from counts order by n desc, brand_gap limit 1)
    select row_key, coalesce(brand_gap, fill) as brand_gap, n_fill from split_rows, top""",
)
def q_impute_mode(spark, sf):
    rows = prepared(spark, sf, "brand_gap")
    train = rows.where(F.col("dataset") == "train")
    model = Preprocessor({"brand_gap": "cat"}).fit(train)
    n = most_frequent(train, ["brand_gap"]).first()["n"]
    return rows.select("row_key", F.expr(model.imputed_sql("brand_gap")).alias("brand_gap"), F.lit(n).alias("n_fill"))


def _scaled(spark, sf, roles, scaler="minmax") -> DataFrame:
    rows = prepared(spark, sf, *roles)
    model = Preprocessor(roles, scaler).fit(rows.where(F.col("dataset") == "train"))
    out = model.transform(rows)
    return out.select("row_key", *[r(F.col(c), 6).alias(c) for c in model.columns])


def _scale_sql(cols: dict[str, tuple[str, str]], center: str, spread: str) -> str:
    """{column: (output, transform with {})} scaled by train-row statistics after imputation."""
    parts = [f"with {SPLIT_ROWS}"]
    meds = ", ".join(f"median({c}) as {c}" for c in cols)
    parts.append(f"med as (select {meds} from split_rows where dataset = 'train')")
    filled = ", ".join(f"{t.format(f'coalesce(s.{c}, m.{c})')} as {c}" for c, (_, t) in cols.items())
    parts.append(f"filled as (select row_key, dataset, {filled} from split_rows s, med m)")
    stats = ", ".join(f"{center.format(c)} as a_{c}, {spread.format(c)} as b_{c}" for c in cols)
    parts.append(f"stats as (select {stats} from filled where dataset = 'train')")
    out = ", ".join(
        f"{rnd(f'(f.{c} - a_{c}) / (case when b_{c} > 0 then b_{c} else 1 end)', 6)} as {name}" for c, (name, _) in cols.items()
    )
    return ", ".join(parts) + f" select row_key, {out} from filled f, stats"


@query(
    "minmax_scale",
    _scale_sql({"qty": ("qty__num", "{}"), "retail": ("retail__num", "{}"), "const1": ("const1__num", "{}")},
               "min({0})", "max({0}) - min({0})"),
)
def q_minmax_scale(spark, sf):
    return _scaled(spark, sf, {"qty": "num", "retail": "num", "const1": "num"})


@query(
    "log_exp_features",
    _scale_sql({"charge": ("charge__log", "ln(1 + {})"), "disc": ("disc__exp", "exp({})"), "qty": ("qty__log", "ln(1 + {})")},
               "min({0})", "max({0}) - min({0})"),
)
def q_log_exp_features(spark, sf):
    return _scaled(spark, sf, {"charge": "log", "disc": "exp", "qty": "log"})


@query(
    "standard_scale",
    _scale_sql({"qty": ("qty__num", "{}"), "charge": ("charge__log", "ln(1 + {})"), "const1": ("const1__num", "{}")},
               "avg({0})", "stddev_pop({0})"),
)
def q_standard_scale(spark, sf):
    return _scaled(spark, sf, {"qty": "num", "charge": "log", "const1": "num"}, "standard")


@query(
    "robust_scale",
    _scale_sql({"qty": ("qty__num", "{}"), "retail": ("retail__num", "{}"), "price": ("price__num", "{}")},
               "median({0})", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"),
)
def q_robust_scale(spark, sf):
    return _scaled(spark, sf, {"qty": "num", "retail": "num", "price": "num"}, "robust")


ONE_HOT_BRANDS = ", ".join(
    f"(coalesce(brand_gap, fill) = (select brand_gap from gaps where i = {i}))::double as brand_is{i}" for i in range(25)
)


@query(
    "one_hot",
    f"""with {SPLIT_ROWS},
    cats as (select flag, row_number() over (order by flag) - 1 as i
             from (select distinct flag from split_rows where dataset = 'train' and flag is not null)),
    gaps as (select brand_gap, row_number() over (order by brand_gap) - 1 as i
             from (select distinct brand_gap from split_rows
                   where dataset = 'train' and brand_gap is not null)),
    top as (select brand_gap as fill from split_rows where dataset = 'train' and brand_gap is not null
            group by 1 order by count(*) desc, 1 limit 1),
    few as (select distinct brand_gap from split_rows where dataset = 'train' and brand_gap < 'Brand#2'),
    few_top as (select brand_gap as few_fill from split_rows where dataset = 'train' and brand_gap < 'Brand#2'
                group by 1 order by count(*) desc, 1 limit 1)
    select row_key,
           (flag = (select flag from cats where i = 0))::double as flag__is0,
           (flag = (select flag from cats where i = 1))::double as flag__is1,
           (flag = (select flag from cats where i = 2))::double as flag__is2,
           {ONE_HOT_BRANDS},
           coalesce((coalesce(brand_gap, few_fill) in (select brand_gap from few))::int, 0)::double as known_of_few
    from split_rows, top, few_top""",
)
def q_one_hot(spark, sf):
    rows = prepared(spark, sf, "flag", "brand_gap")
    train = rows.where(F.col("dataset") == "train")
    flags = Preprocessor({"flag": "cat"}).fit(train)
    brands = Preprocessor({"brand_gap": "cat"}).fit(train)
    # Fitted on a part of the brands: the others are unknown to it and give all zeros.
    few = Preprocessor({"brand_gap": "cat"}).fit(train.where(F.col("brand_gap") < "Brand#2"))
    known = sum([F.expr(x) for x in few.column_sql().values()], F.lit(0.0)).alias("known_of_few")
    out = brands.transform(flags.transform(rows))
    none = F.lit(None).cast("double")  # there are at most 25 brands
    columns = [(F.col(brands.columns[i]) if i < len(brands.columns) else none).alias(f"brand_is{i}") for i in range(25)]
    return out.select("row_key", *flags.columns, *columns, known)


@query(
    "wide_one_hot",
    f"""with {SPLIT_ROWS},
    kinds as (select row_key, dataset, brand_gap || '|' || size::bigint as kind from split_rows),
    known as (select distinct kind from kinds where dataset = 'train' and kind is not null),
    places as (select kind, row_number() over (order by md5(kind), kind) - 1 as place from known),
    top as (select kind as fill from kinds where dataset = 'train' and kind is not null group by 1 order by count(*) desc, 1 limit 1)
    select row_key, place, (select count(*) from known) as width
    from (select row_key, coalesce(kind, fill) as kind from kinds, top) left join places using (kind)""",
)
def q_wide_one_hot(spark, sf):
    """A column of many values as one sparse vector: where it is 1; nowhere for values the fit has not seen."""
    kind = F.concat_ws("|", "brand_gap", F.col("size").cast("bigint").cast("string"))
    rows = prepared(spark, sf, "brand_gap", "size").withColumn("kind", F.when(F.col("brand_gap").isNotNull(), kind))
    model = Preprocessor({"kind": "cat"}, dense_categories=20).fit(rows.where(F.col("dataset") == "train"))
    hot = F.array_position(vector_to_array(model.wide["kind"]), 1.0)
    width = F.lit(model.stats["kind"].size).cast("long").alias("width")
    return model.transform(rows).select("row_key", F.when(hot > 0, hot - 1).alias("place"), width)


@query(
    "fold_safe_scaling",
    f"""with {SPLIT_ROWS},
    train as (select * from split_rows where dataset = 'train'),
    folds as (select unnest([0, 1, 2, 3, 4]) as k),
    med as (select k, median(qty) as m_qty, median(charge) as m_charge from folds join train on fold <> k group by k),
    stats as (
      select k, min(coalesce(qty, m_qty)) as lo_q, max(coalesce(qty, m_qty)) as hi_q, any_value(m_qty) as m_qty,
             min(ln(1 + charge)) as lo_c, max(ln(1 + charge)) as hi_c
      from med join train on fold <> k group by k)
    select row_key, fold, {rnd('(coalesce(qty, m_qty) - lo_q) / (hi_q - lo_q)', 6)} as qty__num,
           {rnd('(ln(1 + charge) - lo_c) / (hi_c - lo_c)', 6)} as charge__log
    from train join stats on fold = k""",
)
def q_fold_safe_scaling(spark, sf):
    rows = prepared(spark, sf, "qty", "charge").where(F.col("dataset") == "train")
    models = Preprocessor({"qty": "num", "charge": "log"}).fit_by_fold(rows, "fold", 5)
    out = transform_by_fold(rows, models, "fold")
    return out.select("row_key", "fold", *[r(F.col(c), 6).alias(c) for c in ("qty__num", "charge__log")])


# Out-of-fold means, scores, reports

BANDED = f"""{SPLIT_ROWS},
banded as (select *, cast(floor(price / 10000) as bigint) as band from split_rows),
train as (select * from banded where dataset = 'train'),
bf as (select band, fold, sum(charge) as s, count(*) as n from train group by 1, 2),
b as (select band, sum(s) as s, sum(n) as n from bf group by 1),
ff as (select fold, sum(s) as s, sum(n) as n from bf group by 1),
oof as (
  select t.*, coalesce((b.s - bf.s) / nullif(b.n - bf.n, 0),
                       ((select sum(s) from ff) - ff.s) / ((select sum(n) from ff) - ff.n)) as p
  from train t join bf on bf.band = t.band and bf.fold = t.fold join b on b.band = t.band join ff on ff.fold = t.fold),
quantized as (select *, floor(price / unit_price + 0.5::double) as q from banded),
general as (select avg(charge) as g_charge, avg(unit_price) as g_unit from train),
preds as (
  select row_key, 'charge' as target, dataset, flag, fold, charge as y, coalesce(m, g_charge) as p
  from general, banded left join (select band, avg(charge) as m from train group by 1) using (band)
  union all
  select row_key, 'unit_price', dataset, flag, fold, unit_price, coalesce(m, g_unit)
  from general, quantized left join (
    select q, avg(unit_price) as m from quantized where dataset = 'train' group by 1) using (q))"""


def banded(spark, sf) -> DataFrame:
    rows = prepared(spark, sf, "price", "disc", "flag", "charge", "unit_price")
    return rows.withColumn("band", F.floor(F.col("price") / 10000))


def oof_rows(spark, sf) -> DataFrame:
    train = banded(spark, sf).where(F.col("dataset") == "train")
    return oof_group_mean(train, ["band"], "charge", "fold", "p").withColumn("y", F.col("charge"))


def predictions(spark, sf) -> DataFrame:
    """Long hold-out predictions of two targets by group means."""
    rows = banded(spark, sf).withColumn("q", F.floor(F.col("price") / F.col("unit_price") + 0.5))
    train = rows.where(F.col("dataset") == "train")
    parts = []
    for target, keys in (("charge", ["band"]), ("unit_price", ["q"])):
        scored = predict_group_mean(rows, fit_group_mean(train, keys, target), keys, "p")
        parts.append(scored.select("row_key", F.lit(target).alias("target"), "dataset", "flag", "fold", F.col(target).alias("y"), "p"))
    return parts[0].unionByName(parts[1])


def _rounded_scores(places: int = 4):
    return [r(F.col(m), places).alias(m) for m in ("MAE", "RMSE", "R2")]


SCORES = """avg(abs(y - p)) as "MAE", sqrt(avg((y - p) * (y - p))) as "RMSE",
       1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) as "R2" """
ROUNDED = f"""{rnd('"MAE"', 4)} as "MAE", {rnd('"RMSE"', 4)} as "RMSE", {rnd('"R2"', 4)} as "R2" """


@query("oof_group_mean", f"with {BANDED} select row_key, fold, {rnd('p', 3)} as p from oof")
def q_oof_group_mean(spark, sf):
    return oof_rows(spark, sf).select("row_key", "fold", r(F.col("p"), 3).alias("p"))


@query(
    "regression_metrics",
    f"with {BANDED}, s as (select flag, count(*) as n, {SCORES} from oof group by flag) "
    f"select flag, n, {ROUNDED} from s".replace("y - p", "charge - p").replace("var_pop(y)", "var_pop(charge)"),
)
def q_regression_metrics(spark, sf):
    scored = oof_rows(spark, sf).groupBy("flag").agg(F.count("*").alias("n"), *metric_columns())
    return scored.select("flag", "n", *_rounded_scores())


@query(
    "cv_fold_metrics",
    f"with {BANDED}, s as (select fold, {SCORES} from (select fold, charge as y, p from oof) group by fold), "
    """m as (select -1 as fold, avg("MAE") as "MAE", avg("RMSE") as "RMSE", avg("R2") as "R2" from s) """
    f"select fold, {ROUNDED} from (select * from s union all select * from m)",
)
def q_cv_fold_metrics(spark, sf):
    per_fold = regression_metrics(oof_rows(spark, sf), ["fold"])
    mean = fold_means(per_fold).withColumn("fold", F.lit(-1))
    return per_fold.unionByName(mean).select("fold", *_rounded_scores())


@query(
    "holdout_report",
    f"with {BANDED}, s as (select target, dataset, {SCORES} from preds group by 1, 2) select target, dataset, {ROUNDED} from s",
)
def q_holdout_report(spark, sf):
    return reports.holdout_report(predictions(spark, sf)).select("target", "dataset", *_rounded_scores())


@query(
    "csv_round_trip",
    f"with {BANDED}, s as (select target, dataset, {SCORES} from preds group by 1, 2) select target, dataset, {ROUNDED} from s",
)
def q_csv_round_trip(spark, sf):
    """The report written as CSV with a byte-order mark, and read back."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    write_scores(reports.holdout_report(predictions(spark, sf)), path, bom=True)
    return read_table(spark, path, "target string, dataset string, MAE double, RMSE double, R2 double", format="csv").select(
        "target", "dataset", *_rounded_scores()
    )


@query(
    "csv_corrupt_rows",
    f"""with rows as (
      select l_linenumber, l_extendedprice as price, l_suppkey % 10 as kind from lineitem),
    good as (select l_linenumber, count(*) as n_good, sum(price) as s from rows where kind not in (3, 7, 9) group by 1)
    select l_linenumber as line, n_good, {rnd('s', 2)} as price, (select count(*) from rows) as n_rows,
           (select count(*) from rows where kind in (3, 7, 9)) as n_corrupt, (select count(*) from rows where kind = 7) as n_long
    from good""",
)
def q_csv_corrupt_rows(spark, sf):
    """Line items as CSV, some with text for a number, a field too many or too few; read back with the bad rows apart."""
    kind = F.col("l_suppkey") % 10
    fields = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_extendedprice")]
    line = F.when(kind == 3, F.concat_ws(",", *fields[:2], F.lit("n/a"))).when(kind == 7, F.concat_ws(",", *fields, F.lit("more"))).when(kind == 9, fields[0])
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    fx.table(spark, sf, "lineitem").select(F.coalesce(line, F.concat_ws(",", *fields)).alias("value")).write.text(path)
    good, bad, counts = read_checked_csv(spark, path, "order long, line int, price double", header=False)
    n_long = bad.where(F.endswith("record", F.lit("more"))).count()
    by_line = good.groupBy("line").agg(F.count("*").alias("n_good"), r(F.sum("price"), 2).alias("price"))
    return by_line.select("line", "n_good", "price", *[F.lit(v).alias(k) for k, v in (*counts.items(), ("n_long", n_long))])


@query(
    "remainder_columns",
    f"""with {SPLIT_ROWS},
    ends as (select min(price) as p0, max(price) - min(price) as pw, min(ln(1 + charge)) as c0, max(ln(1 + charge)) - min(ln(1 + charge)) as cw,
                    min(exp(disc)) as d0, max(exp(disc)) - min(exp(disc)) as dw from split_rows where dataset = 'train')
    select row_key, 'price__num,charge__log,disc__exp,tax__raw,size__raw' as order_of_columns, {rnd('(price - p0) / pw', 6)} as price__num,
           {rnd('(ln(1 + charge) - c0) / cw', 6)} as charge__log, {rnd('(exp(disc) - d0) / dw', 6)} as disc__exp, tax as tax__raw, size as size__raw
    from split_rows, ends""",
)
def q_remainder_columns(spark, sf):
    """Branches in their fixed order, then the columns without a role as they are."""
    rows = prepared(spark, sf, "price", "charge", "disc", "tax", "size")
    pre = Preprocessor({"disc": "exp", "charge": "log", "price": "num"}, remainder="passthrough")
    model = pre.fit(rows.where(F.col("dataset") == "train"), ["tax", "size"])
    scaled = [r(F.col(c), 6).alias(c) for c in model.columns[:3]]
    return model.transform(rows).select("row_key", F.lit(",".join(model.columns)).alias("order_of_columns"), *scaled, *model.columns[3:])


@query(
    "test_metrics_sorted",
    f"with {BANDED}, s as (select target, {SCORES} from preds where dataset = 'test' group by 1) "
    f"""select target, 'MAE' as metric, {rnd('"MAE"', 4)} as score from s
    union all select target, 'RMSE', {rnd('"RMSE"', 4)} from s
    union all select target, 'R2', {rnd('"R2"', 4)} from s order by target, metric""",
)
def q_test_metrics_sorted(spark, sf):
    return reports.test_metrics(reports.holdout_report(predictions(spark, sf))).withColumn("score", r(F.col("score"), 4))


@query(
    "parity_extents",
    f"with {BANDED} select target, dataset, {rnd('least(min(y), min(p))', 4)} as low, "
    f"{rnd('greatest(max(y), max(p))', 4)} as high from preds group by 1, 2",
)
def q_parity_extents(spark, sf):
    ends = reports.parity_extents(predictions(spark, sf))
    return ends.select("target", "dataset", r(F.col("low"), 4).alias("low"), r(F.col("high"), 4).alias("high"))


@query(
    "residual_rows",
    f"with {BANDED} select row_key, target, dataset, {rnd('p', 3)} as fitted, {rnd('y - p', 3)} as residual from preds",
)
def q_residual_rows(spark, sf):
    rows = reports.residual_rows(predictions(spark, sf))
    return rows.select("row_key", "target", "dataset", r(F.col("p"), 3).alias("fitted"), r(F.col("residual"), 3).alias("residual"))


@query(
    "residual_histogram",
    f"""with {BANDED},
    e as (select target, dataset, min(y - p) as lo, max(y - p) as hi from preds group by 1, 2)
    select target, dataset, cast(least(floor((y - p - lo) / (hi - lo) * 30), 29) as integer) as bin, count(*) as n
    from preds join e using (target, dataset) group by 1, 2, 3""",
)
def q_residual_histogram(spark, sf):
    return reports.residual_histogram(predictions(spark, sf)).select("target", "dataset", "bin", "n")


@query(
    "scores_sorted",
    f"""with {BANDED},
    flat as (select 'charge' as target, avg(charge) as a from train union all select 'unit_price', avg(unit_price) from train),
    all_preds as (
      select target, 'group_mean' as model, y, p from preds where dataset = 'test'
      union all
      select target, 'mean', y, a from preds join flat using (target) where dataset = 'test'),
    s as (select target, model, {SCORES} from all_preds group by 1, 2)
    select target, model, {ROUNDED}, case when model = 'mean' then 0 else 1 end as n_features
    from s order by target, model""",
)
def q_scores_sorted(spark, sf):
    pred = predictions(spark, sf)
    means = pred.where(F.col("dataset") == "train").groupBy("target").agg(F.avg("y").alias("a"))
    test = pred.where(F.col("dataset") == "test")
    flat = test.join(means, "target").withColumn("p", F.col("a")).drop("a")
    parts = [
        regression_metrics(rows.withColumn("model", F.lit(name)), ["target", "model"]).withColumn("n_features", F.lit(n))
        for name, rows, n in (("group_mean", test, 1), ("mean", flat, 0))
    ]
    return reports.compare_models(*parts).select("target", "model", *_rounded_scores(), "n_features")


@query(
    "exact_quantiles",
    f"""with {FEATURE_ROWS}
    select flag, {rnd('quantile_cont(charge, 0.25)', 4)} as q1, {rnd('median(charge)', 4)} as q2,
           {rnd('quantile_cont(charge, 0.9)', 4)} as q3, quantile_cont(qty, 0.5) as qty
    from feature_rows group by flag""",
)
def q_exact_quantiles(spark, sf):
    rows = stage_table(fx.feature_rows(spark, sf).select("flag", "charge", "qty"), "rows")
    flags = [x["flag"] for x in rows.select("flag").distinct().orderBy("flag").collect()]
    exprs = {f"{c}|{f}": F.when(F.col("flag") == f, F.col(c)) for f in flags for c in ("charge", "qty")}
    found = exact_quantiles(rows, exprs, [0.25, 0.5, 0.9])
    counts = rows.groupBy("flag").count()
    for i, name in enumerate(("q1", "q2", "q3")):
        value = F.lit(None).cast("double")
        for f in flags:
            value = F.when(F.col("flag") == f, F.lit(found[f"charge|{f}"][i])).otherwise(value)
        counts = counts.withColumn(name, r(value, 4))
    out = F.lit(None).cast("double")
    for f in flags:
        out = F.when(F.col("flag") == f, F.lit(found[f"qty|{f}"][1])).otherwise(out)
    return counts.withColumn("qty", out).drop("count")
