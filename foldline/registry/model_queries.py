"""Queries that fit models."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from foldline import fixtures as fx
from foldline.functions.numeric import round_half_up as r
from foldline.operators import groups as gr
from foldline.operators.gram import gram, linear_prediction, outside_fold, solve_elastic_net, solve_ridge
from foldline.operators.group_means import fit_group_mean, oof_group_mean, predict_group_mean
from foldline.operators.learners import fit_learner
from foldline.operators.preprocess import Preprocessor
from foldline.operators.search import cv_search
from foldline.operators.space import build_preset, stack_from
from foldline.operators.stack import Member, Stack, fit_preprocessed_stack
from foldline.functions.metrics import regression_metrics
from foldline.plans.fixed import fit_with_params
from foldline.registry import tree_sql
from foldline.registry.base import SPLIT_ROWS, hash_sql, query, rnd
from foldline.registry.data_queries import BANDED, ROUNDED, SCORES, banded, prepared, _rounded_scores
from foldline.session import shared_dir, spread
from foldline.sources.bundle import Bundle, TargetMeta, load_bundle, save_bundle, score_batch
from foldline.sources.params import load_params, save_params
from foldline.streaming.scoring import score_stream, write_available

X = ["price__num", "disc__exp"]
ALPHAS = [0.1, 1.0, 10.0, 100.0, 1000.0]

# Two scaled features, so that every linear fit has a closed form in SQL.
LINEAR = f"""{SPLIT_ROWS},
ends as (
  select min(price) as p0, max(price) - min(price) as pw, min(exp(disc)) as d0, max(exp(disc)) - min(exp(disc)) as dw
  from split_rows where dataset = 'train'),
lin as (
  select row_key, flag, status, brand, ptype, dataset, fold, charge as y, retail,
         (price - p0) / pw as x1, (exp(disc) - d0) / dw as x2
  from split_rows, ends)"""

SUMS = """count(*)::double as n, sum(y) as sy, sum(x1) as s1, sum(x2) as s2, sum(x1 * x1) as p11, sum(x1 * x2) as p12,
  sum(x2 * x2) as p22, sum(x1 * y) as q1, sum(x2 * y) as q2"""
ALPHA_ROWS = "alphas as (select unnest([0.1, 1.0, 10.0, 100.0, 1000.0]::double[]) as alpha)"


def ridge_sql(name: str, source: str, keys: str) -> str:
    """CTEs that solve the centred two-feature ridge for every row of ``source`` with a column alpha."""
    k = f"{keys}, " if keys else ""
    return f"""{name}_c as (
      select {k}n, alpha, s1 / n as m1, s2 / n as m2, sy / n as my, p11 - s1 * s1 / n + alpha as a11, p12 - s1 * s2 / n as a12,
             p22 - s2 * s2 / n + alpha as a22, q1 - s1 * sy / n as c1, q2 - s2 * sy / n as c2 from {source}),
    {name}_b as (
      select *, (c1 * a22 - c2 * a12) / (a11 * a22 - a12 * a12) as b1, (c2 * a11 - c1 * a12) / (a11 * a22 - a12 * a12) as b2
      from {name}_c),
    {name} as (select {k}n, alpha, my - b1 * m1 - b2 * m2 as b0, b1, b2 from {name}_b)"""


def linear_rows(spark, sf) -> DataFrame:
    rows = prepared(spark, sf, "flag", "status", "brand", "ptype", "price", "disc", "charge")
    model = Preprocessor({"price": "num", "disc": "exp"}).fit(rows.where(F.col("dataset") == "train"))
    return model.transform(rows).withColumn("y", F.col("charge"))


def linear_train(spark, sf) -> DataFrame:
    return linear_rows(spark, sf).where(F.col("dataset") == "train")


# Linear models by sums of products


@query(
    "gram_by_group_fold",
    f"""with {LINEAR}, g as (select flag, status, fold, {SUMS} from lin where dataset = 'train' group by 1, 2, 3)
    select flag, status, fold, n::bigint as n, {rnd('sy', 3)} as sy, {rnd('s1', 4)} as s1, {rnd('s2', 4)} as s2,
           {rnd('p11', 4)} as p11, {rnd('p12', 4)} as p12, {rnd('p22', 4)} as p22, {rnd('q1', 3)} as q1, {rnd('q2', 3)} as q2
    from g""",
)
def q_gram_by_group_fold(spark, sf):
    g = gram(linear_train(spark, sf), X, "y", ["flag", "status", "fold"])
    names = [("sy", "sy", 3), ("s_0", "s1", 4), ("s_1", "s2", 4), ("p_0_0", "p11", 4), ("p_0_1", "p12", 4), ("p_1_1", "p22", 4), ("q_0", "q1", 3), ("q_1", "q2", 3)]
    return g.select("flag", "status", "fold", "n", *[r(F.col(a), p).alias(b) for a, b, p in names])


def _coefs(df: DataFrame, *keys: str, places: int = 3) -> DataFrame:
    return df.select(
        *keys,
        r(F.col("intercept"), places).alias("b0"),
        *[r(F.get("coef", F.lit(i)), places).alias(f"b{i + 1}") for i in range(2)],
    )


@query(
    "ridge_coefficients",
    f"""with {LINEAR}, {ALPHA_ROWS},
    g as (select * from (select fold, {SUMS} from lin where dataset = 'train' group by 1), alphas),
    t as (select alpha, sum(n) as n, sum(sy) as sy, sum(s1) as s1, sum(s2) as s2, sum(p11) as p11, sum(p12) as p12,
                 sum(p22) as p22, sum(q1) as q1, sum(q2) as q2 from g group by alpha),
    o as (select g.fold, alpha, t.n - g.n as n, t.sy - g.sy as sy, t.s1 - g.s1 as s1, t.s2 - g.s2 as s2, t.p11 - g.p11 as p11,
                 t.p12 - g.p12 as p12, t.p22 - g.p22 as p22, t.q1 - g.q1 as q1, t.q2 - g.q2 as q2 from g join t using (alpha)),
    {ridge_sql('w', 'o', 'fold')}
    select fold, alpha, {rnd('b0', 3)} as b0, {rnd('b1', 3)} as b1, {rnd('b2', 3)} as b2 from w""",
)
def q_ridge_coefficients(spark, sf):
    sums = outside_fold(gram(linear_train(spark, sf), X, "y", ["fold"]), X, "fold")
    return _coefs(solve_ridge(sums, X, ALPHAS, ["fold"]), "fold", "alpha")


ENET = [(0.5, 0.5), (5.0, 0.2), (50.0, 0.9)]


@query(
    "elasticnet_coefficients",
    f"""with recursive {LINEAR},
    g as (select {SUMS} from lin where dataset = 'train'),
    c as (
      select n, alpha, ratio, s1 / n as m1, s2 / n as m2, sy / n as my, p11 - s1 * s1 / n as a11, p12 - s1 * s2 / n as a12,
             p22 - s2 * s2 / n as a22, q1 - s1 * sy / n as c1, q2 - s2 * sy / n as c2
      from g, (values (0.5::double, 0.5::double), (5.0, 0.2), (50.0, 0.9)) v(alpha, ratio)),
    walk as (
      select 0 as i, alpha, ratio, 0.0::double as w1, 0.0::double as w2 from c
      union all
      select i + 1, alpha, ratio, v1,
             sign(c2 - a12 * v1) * greatest(abs(c2 - a12 * v1) - alpha * ratio * n, 0) / (a22 + alpha * (1 - ratio) * n)
      from (select walk.*, c.* exclude (alpha, ratio),
                   sign(c1 - a12 * w2) * greatest(abs(c1 - a12 * w2) - c.alpha * c.ratio * n, 0) / (a11 + c.alpha * (1 - c.ratio) * n) as v1
            from walk join c on c.alpha = walk.alpha and c.ratio = walk.ratio where i < 300))
    select alpha, ratio as l1_ratio, {rnd('my - w1 * m1 - w2 * m2', 3)} as b0, {rnd('w1', 3)} as b1, {rnd('w2', 3)} as b2
    from walk join c using (alpha, ratio) where i = 300""",
)
def q_elasticnet_coefficients(spark, sf):
    return _coefs(solve_elastic_net(gram(linear_train(spark, sf), X, "y"), X, ENET), "alpha", "l1_ratio")


GROUP_MODELS = f"""{LINEAR},
    g as (select brand, ptype, 1.0::double as alpha, {SUMS} from lin where dataset = 'train' group by 1, 2 having count(*) >= 7),
    sizes as (select brand, ptype, count(*) as n_rows from lin where dataset = 'train' group by 1, 2),
    {ridge_sql('w', 'g', 'brand, ptype')},
    t as (select 1.0::double as alpha, {SUMS} from lin where dataset = 'train'),
    {ridge_sql('f', 't', '')}"""


def group_models(train: DataFrame) -> DataFrame:
    return gr.fit_groups(train, X, "y", ["brand", "ptype"], 1.0)


@query(
    "group_linear_models",
    f"""with {GROUP_MODELS}
    select brand, ptype, n_rows, case when w.brand is null then 'global' else 'group' end as route,
           {rnd('coalesce(w.b0, f.b0)', 2)} as b0, {rnd('coalesce(w.b1, f.b1)', 2)} as b1, {rnd('coalesce(w.b2, f.b2)', 2)} as b2
    from sizes cross join f left join w using (brand, ptype)""",
)
def q_group_linear_models(spark, sf):
    """Every group with its model; groups under the documented minimum have the global one."""
    train = linear_train(spark, sf)
    keys = ["brand", "ptype"]
    sizes = train.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    b0, coef = gr.fit_global(train, X, "y")
    joined = sizes.join(group_models(train).select(*keys, "intercept", "coef"), keys, "left")
    route = F.when(F.col("coef").isNull(), "global").otherwise("group").alias("route")
    filled = joined.select(*keys, "n_rows", route, F.coalesce("intercept", F.lit(b0)).alias("intercept"),
                           F.coalesce("coef", F.array(*map(F.lit, coef))).alias("coef"))
    return _coefs(filled, *keys, "n_rows", "route", places=2)


@query(
    "group_routing",
    f"""with {GROUP_MODELS}
    select row_key, case when w.brand is null then 'global' else 'group' end as routed,
           {rnd('coalesce(w.b0, f.b0) + coalesce(w.b1, f.b1) * x1 + coalesce(w.b2, f.b2) * x2', 2)} as p
    from lin cross join f left join w on w.brand = lin.brand and w.ptype = lin.ptype""",
)
def q_group_routing(spark, sf):
    rows = linear_rows(spark, sf)
    train = rows.where(F.col("dataset") == "train")
    fallback = gr.fit_global(train, X, "y")
    routed = gr.route_to_group(rows, group_models(train), ["brand", "ptype"], X, fallback)
    return routed.select("row_key", "routed", r(F.col("p"), 2).alias("p"))


def _cv_sql(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    using = f"using ({keys})" if keys else "on true"
    return f"""{LINEAR}, {ALPHA_ROWS}, train as (select * from lin where dataset = 'train'),
    g as (select {k}fold, {SUMS} from train group by all),
    t as (select {k}sum(n) as n, sum(sy) as sy, sum(s1) as s1, sum(s2) as s2, sum(p11) as p11, sum(p12) as p12,
                 sum(p22) as p22, sum(q1) as q1, sum(q2) as q2 from g {'group by all' if keys else ''}),
    o as (select {', '.join('g.' + c for c in keys.split(', ')) + ', ' if keys else ''}g.fold, alpha, t.n - g.n as n, t.sy - g.sy as sy, t.s1 - g.s1 as s1, t.s2 - g.s2 as s2,
                 t.p11 - g.p11 as p11, t.p12 - g.p12 as p12, t.p22 - g.p22 as p22, t.q1 - g.q1 as q1, t.q2 - g.q2 as q2
          from g join t {using} cross join alphas),
    {ridge_sql('w', 'o', k + 'fold')},
    errs as (select {k}fold, alpha, avg(abs(y - b0 - b1 * x1 - b2 * x2)) as mae from train join w using ({k}fold) group by all),
    cv as (select {k}alpha, avg(mae) as mae from errs group by all)"""


@query("tune_ridge_alpha", f"with {_cv_sql('')} select alpha, {rnd('mae', 4)} as mae, mae = min(mae) over () as best from cv")
def q_tune_ridge_alpha(spark, sf):
    means = gr.tune_alpha(gr.cv_scores_by_alpha(linear_train(spark, sf), X, "y", "fold", ALPHAS))
    low = means.agg(F.min("mae")).first()[0]
    return means.select("alpha", r(F.col("mae"), 4).alias("mae"), (F.abs(F.col("mae") - low) < 1e-9 * abs(low)).alias("best"))


@query(
    "tune_by_group",
    f"""with {_cv_sql('flag, status')},
    best as (
      select *, row_number() over (partition by flag, status order by mae, alpha) as rk from cv),
    sizes as (select flag, status, count(*) as n_rows from train group by 1, 2)
    select flag, status, n_rows, alpha, {rnd('mae', 4)} as mae,
           row_number() over (order by mae, flag, status) = 1 as winner
    from best join sizes using (flag, status) where rk = 1""",
)
def q_tune_by_group(spark, sf):
    tuned = gr.tune_by_group(linear_train(spark, sf), X, "y", ["flag", "status"], "fold", ALPHAS)
    winner = gr.winning_group(tuned, "y", ["flag", "status"]).first()
    is_winner = (F.col("flag") == winner["flag"]) & (F.col("status") == winner["status"])
    return tuned.select("flag", "status", "n_rows", "alpha", r(F.col("mae"), 4).alias("mae"), is_winner.alias("winner"))


# Stacks


def _stack_linear(spark, sf) -> DataFrame:
    rows = banded(spark, sf).withColumn("y", F.col("charge"))
    train = rows.where(F.col("dataset") == "train")
    bases = {"p1": ["band"], "p2": ["disc"]}
    oof, scored = train, rows
    for name, keys in bases.items():
        oof = oof_group_mean(oof, keys, "y", "fold", name)
        scored = predict_group_mean(scored, fit_group_mean(train, keys, "y"), keys, name)
    # Sums of products want columns near zero; a shift leaves the slopes as they are.
    level = train.agg(F.avg("y")).first()[0]
    names = [f"{c}_off" for c in bases]
    oof, scored = (df.select("*", *[(F.col(c) - level).alias(n) for c, n in zip(bases, names)]) for df in (oof, scored))
    meta = solve_ridge(gram(oof, names, "y"), names, [1.0]).first()
    coef = F.array(*[F.lit(c) for c in meta["coef"]])
    return scored.withColumn("p", linear_prediction(names, F.lit(meta["intercept"]), coef))


@query(
    "stack_linear",
    f"""with {BANDED},
    df as (select disc, fold, sum(charge) as s, count(*) as n from train group by 1, 2),
    d as (select disc, sum(s) as s, sum(n) as n from df group by 1),
    lin as (
      select o.charge as y, o.p as x1, (d.s - df.s) / (d.n - df.n) as x2
      from oof o join df on df.disc = o.disc and df.fold = o.fold join d on d.disc = o.disc),
    g as (select 1.0::double as alpha, {SUMS} from lin),
    {ridge_sql('w', 'g', '')},
    final as (
      select dataset, charge as y, b0 + b1 * coalesce(bm, g_charge) + b2 * coalesce(dm, g_charge) as p
      from general, w, banded left join (select band, avg(charge) as bm from train group by 1) using (band)
      left join (select disc, avg(charge) as dm from train group by 1) using (disc)),
    s as (select dataset, count(*) as n, {SCORES} from final group by 1)
    select dataset, n, {ROUNDED} from s""",
)
def q_stack_linear(spark, sf):
    scored = _stack_linear(spark, sf)
    n = scored.groupBy("dataset").agg(F.count("*").alias("n"))
    return regression_metrics(scored, ["dataset"]).join(n, "dataset").select("dataset", "n", *_rounded_scores())


ROLES = {"qty": "num", "price": "num", "disc": "exp", "tax": "num", "flag": "cat"}
SMALL = {"rf_n_estimators": 20, "rf_max_depth": 5, "gbr_n_estimators": 10, "gbr_max_depth": 3, "gbr_learning_rate": 0.1}
# Few values each, so that every cut a tree can make is known to SQL.
CELLS = ["disc", "tax", "q"]


def small_rows(spark, sf) -> DataFrame:
    return prepared(spark, sf, *ROLES, "charge").withColumn("y", F.col("charge"))


def cell_rows(spark, sf) -> DataFrame:
    rows = prepared(spark, sf, "disc", "tax", "qty", "charge")
    return rows.select("row_key", "dataset", "disc", "tax", F.coalesce("qty", F.lit(0.0)).alias("q"), F.col("charge").alias("y"))


CELL_ROWS = f"{SPLIT_ROWS}, rows as materialized (select row_key, dataset, disc, tax, coalesce(qty, 0)::double as q, charge as y from split_rows)"


inside_train = "where dataset = 'train'"


ROUNDED_1 = ", ".join(f'{rnd(chr(34) + m + chr(34), p)} as "{m}"' for m, p in (("MAE", 1), ("RMSE", 1), ("R2", 4)))


def _on_cells(ctes: list[str]) -> str:
    return f"with {CELL_ROWS}, {tree_sql.cells('cells', 'rows', CELLS, inside_train)}, " + ", ".join(ctes)


def _stack_sql() -> str:
    """Trees for every inner fold and for all rows, then the ridge on the out-of-fold predictions."""
    n_folds = 5
    ctes = [f"with {CELL_ROWS}", f"""ranked as (
      select row_key, disc, tax, q, y, row_number() over (order by {hash_sql(1043)}, row_key) - 1 as i, count(*) over () as n
      from rows where dataset = 'train')""", f"""inner_rows as materialized (
      select row_key, disc, tax, q, y,
             case when i < (n % {n_folds}) * (n // {n_folds} + 1) then i // (n // {n_folds} + 1)
                  else n % {n_folds} + (i - (n % {n_folds}) * (n // {n_folds} + 1)) // (n // {n_folds}) end as f from ranked)"""]
    parts = []
    for f in [*range(n_folds), "all"]:
        inside = f"where dataset = 'train' and coalesce(f, -1) <> {f}" if f != "all" else inside_train
        ctes.append(tree_sql.cells(f"c{f}", "(select rows.*, f from rows left join (select row_key, f from inner_rows) using (row_key))", CELLS, inside))
        ctes += tree_sql.tree(f"rf{f}", f"c{f}", CELLS, 4, 2) + tree_sql.boosted(f"gb{f}", f"c{f}", CELLS, 4, 2, 0.3)
        if f != "all":
            parts.append(f"select y, a.p as x1, b.p as x2 from inner_rows r join rf{f} a using (disc, tax, q) join gb{f} b using (disc, tax, q) where f = {f}")
    ctes += [f"oof as ({' union all '.join(parts)})", f"g as (select 1.0::double as alpha, {SUMS} from oof)", ridge_sql("w", "g", ""),
             "final as (select dataset, y, b0 + b1 * a.p + b2 * b.p as p from rows join rfall a using (disc, tax, q) join gball b using (disc, tax, q), w)",
             f"s as (select dataset, {SCORES} from final group by 1)"]
    return ", ".join(ctes) + f" select dataset, {ROUNDED_1} from s"




def _scores_1(df: DataFrame) -> DataFrame:
    return df.select("dataset", r(F.col("MAE"), 1).alias("MAE"), r(F.col("RMSE"), 1).alias("RMSE"), r(F.col("R2"), 4).alias("R2"))


@query("stack_rf_gbt", _stack_sql())
def q_stack_rf_gbt(spark, sf):
    """Forest and boosted trees under a ridge on five exact inner folds; without bootstrap, so that SQL grows the same trees."""
    rows = cell_rows(spark, sf)
    bases = [Member("rf", "RandomForestRegressor", {"n_estimators": 20, "max_depth": 4, "bootstrap": False}),
             Member("gbr", "GradientBoostingRegressor", {"n_estimators": 4, "max_depth": 2, "learning_rate": 0.3})]
    model = Stack(bases, Member("ridge", "Ridge", {"alpha": 1.0}), k=5).fit(rows.where(F.col("dataset") == "train"), CELLS, "row_key")
    return _scores_1(regression_metrics(model.transform(rows).withColumn("p", F.col("prediction")), ["dataset"]))


@query("stack_passthrough")
def q_stack_passthrough(spark, sf):
    rows = small_rows(spark, sf)
    stack = stack_from(build_preset(1), SMALL, k=5)
    stack.passthrough = True
    model = fit_preprocessed_stack(rows.where(F.col("dataset") == "train"), ROLES, stack, "row_key", staged=True)
    scored = model.transform(rows).withColumn("p", F.col("prediction"))
    return regression_metrics(scored, ["dataset"]).select("dataset", *_rounded_scores(2))


@query("fit_fixed_params")
def q_fit_fixed_params(spark, sf):
    """Parameters from a JSON table, one stack per target, no search."""
    rows = small_rows(spark, sf).withColumn("tax_due", F.col("charge") * F.col("tax"))
    targets = {"charge": ["qty", "price", "disc", "tax"], "tax_due": ["price", "disc", "tax"]}
    path = f"{shared_dir(spark)}/params-{uuid.uuid4().hex}"
    per_target = rows.agg(F.count("*").alias("n")).select(
        F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"),
        F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(float(v))) for k, v in {**SMALL, "ridge_alpha": 1.0}.items()])).alias("params"),
    )
    save_params(per_target, path)
    params = {x["target"]: dict(x["params"]) for x in load_params(spark, path, list(targets)).collect()}
    return fit_with_params(rows, targets, params, build_preset(1), "row_key", inner=5)[1].select(
        "target", "dataset", *_rounded_scores(2)
    )


# Learners


def _cell_learner(spark, sf, name: str, params: dict) -> DataFrame:
    rows = cell_rows(spark, sf)
    model = fit_learner(name, params, rows.where(F.col("dataset") == "train"), CELLS)
    return model.transform(rows).select("row_key", "dataset", r(F.col("prediction"), 2).alias("p"))


def _predicted(ctes: list[str], name: str) -> str:
    return _on_cells(ctes) + f" select row_key, dataset, {rnd('p', 2)} as p from rows join {name} using ({', '.join(CELLS)})"


@query("rf_predictions", _predicted(tree_sql.tree("t", "cells", CELLS, 6, 2), "t"))
def q_rf_predictions(spark, sf):
    """Without bootstrap every tree of the forest is the same, and SQL grows it."""
    return _cell_learner(spark, sf, "RandomForestRegressor", {"n_estimators": 20, "max_depth": 6, "bootstrap": False})


@query("gbt_predictions", _predicted(tree_sql.boosted("t", "cells", CELLS, 20, 3, 0.1), "t"))
def q_gbt_predictions(spark, sf):
    return _cell_learner(spark, sf, "GradientBoostingRegressor", {"n_estimators": 20, "max_depth": 3})


@query("hist_gbt_predictions", _predicted(tree_sql.boosted("t", "cells", CELLS, 12, 3, 0.1), "t"))
def q_hist_gbt_predictions(spark, sf):
    return _cell_learner(spark, sf, "HistGradientBoostingRegressor", {"n_estimators": 12, "max_depth": 3})


@query("xgb_predictions", _predicted(tree_sql.boosted("t", "cells", CELLS, 10, 3, 0.3), "t"))
def q_xgb_predictions(spark, sf):
    return _cell_learner(spark, sf, "XGBRegressor", {"n_estimators": 10, "max_depth": 3})


@query("lgbm_predictions", _predicted(tree_sql.boosted("t", "cells", CELLS, 10, 3, 0.1), "t"))
def q_lgbm_predictions(spark, sf):
    return _cell_learner(spark, sf, "LGBMRegressor", {"n_estimators": 10, "num_leaves": 8})


@query("catboost_predictions", _predicted(tree_sql.boosted("t", "cells", CELLS, 10, 3, 0.3), "t"))
def q_catboost_predictions(spark, sf):
    return _cell_learner(spark, sf, "CatBoostRegressor", {"iterations": 10, "depth": 3, "learning_rate": 0.3})


def _properties(spark, sf, name: str, params: dict) -> DataFrame:
    """Rows predicted, rows predicted within the labels' training range, and whether the test error is below the mean's."""
    rows = small_rows(spark, sf)
    pre = Preprocessor(ROLES).fit(rows.where(F.col("dataset") == "train"))
    scaled = pre.transform(rows).select("row_key", "dataset", "y", *pre.columns)
    model = fit_learner(name, params, scaled.where(F.col("dataset") == "train"), pre.columns)
    ends = rows.where(F.col("dataset") == "train").agg(F.min("y"), F.max("y"), F.avg("y")).first()
    p, slack = F.col("prediction"), 1e-6
    scored = model.transform(scaled)
    return scored.agg(
        F.count("*").alias("n_rows"),
        F.count_if(p.between(ends[0] - slack, ends[1] + slack)).alias("n_inside"),
        (F.sum(F.when(F.col("dataset") == "test", (F.col("y") - p) ** 2)) < F.sum(F.when(F.col("dataset") == "test", (F.col("y") - ends[2]) ** 2))).alias("beats_mean"),
    )


PROPERTIES = f"with {SPLIT_ROWS} select count(*) as n_rows, count(*) as n_inside, true as beats_mean from split_rows"


@query("rf_bootstrap", PROPERTIES)
def q_rf_bootstrap(spark, sf):
    return _properties(spark, sf, "RandomForestRegressor", {"n_estimators": 50, "max_depth": 6})


@query("extra_trees_predictions", PROPERTIES)
def q_extra_trees_predictions(spark, sf):
    return _properties(spark, sf, "ExtraTreesRegressor", {"n_estimators": 16, "max_depth": 6})


@query("rff_regression", f"with {SPLIT_ROWS} select count(*) as n_rows, true as beats_mean from split_rows")
def q_rff_regression(spark, sf):
    return _properties(spark, sf, "SVR", {"n_components": 64, "gamma": 0.5, "C": 10.0}).drop("n_inside")


RIDGE_ROWS = f"""{LINEAR},
    g as (select 5.0::double as alpha, {SUMS} from lin where dataset = 'train'),
    {ridge_sql('w', 'g', '')}"""


@query(
    "ridge_predictions",
    f"with {RIDGE_ROWS} select row_key, dataset, {rnd('b0 + b1 * x1 + b2 * x2', 1)} as p from lin, w",
)
def q_ridge_predictions(spark, sf):
    rows = linear_rows(spark, sf)
    model = fit_learner("Ridge", {"alpha": 5.0}, rows.where(F.col("dataset") == "train"), X)
    return model.transform(rows).select("row_key", "dataset", r(F.col("prediction"), 1).alias("p"))


@query(
    "elasticnet_predictions",
    f"""with recursive {LINEAR},
    g as (select {SUMS} from lin where dataset = 'train'),
    c as (
      select n, s1 / n as m1, s2 / n as m2, sy / n as my, p11 - s1 * s1 / n as a11, p12 - s1 * s2 / n as a12,
             p22 - s2 * s2 / n as a22, q1 - s1 * sy / n as c1, q2 - s2 * sy / n as c2, 2.0::double * n as l1, 0.5::double * n as l2 from g),
    walk as (
      select 0 as i, 0.0::double as w1, 0.0::double as w2
      union all
      select i + 1, v1, sign(c2 - a12 * v1) * greatest(abs(c2 - a12 * v1) - l1, 0) / (a22 + l2)
      from (select walk.*, c.*, sign(c1 - a12 * w2) * greatest(abs(c1 - a12 * w2) - l1, 0) / (a11 + l2) as v1 from walk, c where i < 300))
    select row_key, dataset, {rnd('my + w1 * (x1 - m1) + w2 * (x2 - m2)', 1)} as p from lin, c, walk where i = 300""",
)
def q_elasticnet_predictions(spark, sf):
    """The learner itself, fitted on the moments of the training rows."""
    rows = linear_rows(spark, sf)
    model = fit_learner("ElasticNet", {"alpha": 2.5, "l1_ratio": 0.8}, rows.where(F.col("dataset") == "train"), X)
    return model.transform(rows).select("row_key", "dataset", r(F.col("prediction"), 1).alias("p"))


CV_ALPHAS = [round(10 ** (-2 + i / 6), 6) for i in range(30)]


@query(
    "cv_search_refit",
    f"""with {SPLIT_ROWS},
    train as (select * from split_rows where dataset = 'train'),
    folds as (select unnest([0, 1, 2, 3, 4]) as k),
    ends as (
      select k, min(price) as p0, max(price) - min(price) as pw, min(exp(disc)) as d0, max(exp(disc)) - min(exp(disc)) as dw
      from folds join train on fold <> k group by k
      union all
      select 9, min(price), max(price) - min(price), min(exp(disc)), max(exp(disc)) - min(exp(disc)) from train),
    lin as (
      select k, fold, dataset, charge as y, (price - p0) / pw as x1, (exp(disc) - d0) / dw as x2
      from split_rows, ends),
    alphas as (select unnest({CV_ALPHAS}::double[]) as alpha),
    g as (select * from (select k, {SUMS} from lin where dataset = 'train' and fold <> k group by k), alphas),
    {ridge_sql('w', 'g', 'k')},
    errs as (select k, alpha, avg(abs(y - b0 - b1 * x1 - b2 * x2)) as mae from lin join w using (k)
             where dataset = 'train' and fold = k group by all),
    cv as (select alpha, -avg(mae) as score from errs group by alpha),
    best as (select alpha, score from cv order by score desc, alpha limit 1),
    s as (select dataset, y, b0 + b1 * x1 + b2 * x2 as p from lin join w using (k) join best using (alpha) where k = 9),
    m as (select dataset, {SCORES} from s group by 1)
    select dataset, {ROUNDED}, {rnd('score', 2)} as cv_best_score, alpha as best_alpha, 30 as n_trials, 2 as n_features from m, best""",
)
def q_cv_search_refit(spark, sf):
    """Cross-validated search by -MAE with statistics per fold, refit, scored on the hold-out."""
    rows = prepared(spark, sf, "price", "disc", "charge").withColumn("y", F.col("charge"))
    grid = [{"alpha": a} for a in CV_ALPHAS]
    roles = {"price": "num", "disc": "exp"}
    model, scores, best = cv_search(rows.where(F.col("dataset") == "train"), roles, "Ridge", grid, parallelism=8)
    metrics = regression_metrics(model.transform(rows).withColumn("p", F.col("prediction")), ["dataset"])
    return metrics.select(
        "dataset",
        *_rounded_scores(),
        r(F.lit(scores[best]), 2).alias("cv_best_score"),
        F.lit(grid[best]["alpha"]).alias("best_alpha"),
        F.lit(len(grid)).alias("n_trials"),
        F.lit(len(roles)).alias("n_features"),
    )


# Saved models


def _linear_bundle(spark, train: DataFrame, roles: dict[str, str], target: str, alpha: float) -> Bundle:
    pre = Preprocessor(roles).fit(train)
    fitted = fit_learner("Ridge", {"alpha": alpha}, pre.transform(train).withColumn("y", F.col(target)), pre.columns)
    pipeline = PipelineModel([pre.stages()[0], *fitted.stages])
    types = dict(train.dtypes)
    meta = TargetMeta(list(roles), {c: types[c] for c in roles}, {"ridge_alpha": alpha})
    path = f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"
    save_bundle(Bundle({target: pipeline}, {target: meta}), spark, path)
    return load_bundle(spark, path)


@query("score_batch", f"with {RIDGE_ROWS} select row_key, {rnd('b0 + b1 * x1 + b2 * x2', 1)} as pred_charge from lin, w")
def q_score_batch(spark, sf):
    rows = prepared(spark, sf, "price", "disc", "charge")
    bundle = _linear_bundle(spark, rows.where(F.col("dataset") == "train"), {"price": "num", "disc": "exp"}, "charge", 5.0)
    scored = score_batch(bundle, rows.select("row_key", "price", "disc"))
    return scored.select("row_key", r(F.col("pred_charge"), 1).alias("pred_charge"))


def _line_items(df: DataFrame) -> DataFrame:
    return df.select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("disc"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"),
    )


@query(
    "score_stream",
    f"""with li as (
      select l_orderkey, l_linenumber, l_suppkey, l_extendedprice as price, l_discount as disc,
             l_extendedprice * (1 - l_discount) * (1 + l_tax) as y from lineitem),
    ends as (select min(price) as p0, max(price) - min(price) as pw, min(exp(disc)) as d0, max(exp(disc)) - min(exp(disc)) as dw from li),
    lin as (select li.*, (price - p0) / pw as x1, (exp(disc) - d0) / dw as x2 from li, ends),
    g as (select 5.0::double as alpha, {SUMS} from lin),
    {ridge_sql('w', 'g', '')}
    select l_orderkey, l_linenumber, l_suppkey, {rnd('b0 + b1 * x1 + b2 * x2', 1)} as pred_charge from lin, w""",
)
def q_score_stream(spark, sf):
    """The line-item files read as a stream and scored with a saved model."""
    static = fx.table(spark, sf, "lineitem")
    bundle = _linear_bundle(spark, _line_items(spread(static)), {"price": "num", "disc": "exp"}, "charge", 5.0)
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "lineitem*.parquet").parquet(sf)
    scored = score_stream(bundle, _line_items(stream).drop("charge"))
    base = f"{shared_dir(spark)}/scored-{uuid.uuid4().hex}"
    write_available(scored, f"{base}/rows", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/rows").select(
        "l_orderkey", "l_linenumber", "l_suppkey", r(F.col("pred_charge"), 1).alias("pred_charge")
    )
