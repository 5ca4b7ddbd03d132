"""Queries that search stacks: fold by fold, after a break, and for all groups at once."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from foldline.fixtures import feature_rows
from foldline.functions.metrics import METRICS
from foldline.functions.numeric import round_half_up as r
from foldline.operators.learners import fit_learner
from foldline.operators.linear_stack import LinearFolds, LinearStack, tune_stacks_by_group
from foldline.operators.preprocess import Preprocessor
from foldline.operators.search import Study, random_proposals, run_folds, tune
from foldline.operators.space import Preset, real
from foldline.operators.splits import with_split
from foldline.operators.stack import cross_validate
from foldline.plans.fixed import fit_with_params
from foldline.plans.training import SearchSettings, run_study
from foldline.registry.base import SPLIT_ROWS, hash_sql, query, rnd
from foldline.registry.data_queries import ROUNDED, SCORES, _rounded_scores, prepared
from foldline.registry.model_queries import LINEAR, SUMS, X as X_TWO, linear_train, ridge_sql
from foldline.session import shared_dir, stage_table
from foldline.sources.bundle import Bundle, GroupModels, TargetMeta, load_bundle, save_bundle, score_batch
from foldline.sources.trial_store import TrialStore
from foldline.streaming.scoring import score_stream, write_available

ROLES = {"price": "num", "disc": "exp"}
K, INNER, BATCH, STARTUP, WARMUP = 5, 3, 3, 3, 2
SPACE = [real("a_alpha", 0.01, 100.0, True), real("b_alpha", 1e3, 1e6, True), real("m_alpha", 1e9, 1e14, True)]
STACK = Preset(101, [("a", "Ridge"), ("b", "Ridge")], ("m", "Ridge"), False, SPACE)
RULES = dict(k=K, inner=INNER, batch=BATCH, startup=STARTUP, warmup=WARMUP)


def search_rows(spark, sf) -> DataFrame:
    rows = prepared(spark, sf, "price", "disc", "charge").where(F.col("dataset") == "train")
    return rows.withColumn("y", F.col("charge"))


# SQL: every trial on every fold, then the search replayed batch by batch.


def folds_sql(k: int) -> str:
    """Number of the exact fold of a row with rank i (from 0) of n."""
    return f"""case when i < (n % {k}) * (n // {k} + 1) then i // (n // {k} + 1)
                 else (n % {k}) + (i - (n % {k}) * (n // {k} + 1)) // greatest(n // {k}, 1) end"""


def stack_ctes(uses: Sequence[tuple[str, str]]) -> str:
    """From dealt(g, o, j, x1, x2, y), held(g, o, x1, x2, y), params(t, a1, a2, am): fn(g, o, t, c0, c1, c2), scores(g, o, t, mae, rmse, r2).

    ``uses``: for each base which of the features it sees. Bases are ridges on
    the rows of other inner folds, the meta model a ridge on their predictions.
    """

    def one(name: str, source: str, alpha: str, sees: tuple[str, str], keys: str) -> str:
        a, b = sees
        if a and b:
            det = "(s11 + al) * (s22 + al) - s12 * s12"
            w1, w2 = f"(c1 * (s22 + al) - c2 * s12) / ({det})", f"(c2 * (s11 + al) - c1 * s12) / ({det})"
        else:
            w1, w2 = ("c1 / (s11 + al)", "0") if a else ("0", "c2 / (s22 + al)")
        return f"""{name}_w as (
      select {keys}, t, m1, m2, my, {w1} as w1, {w2} as w2 from (select {source}.*, t, {alpha} as al from {source}, params)),
    {name} as (select {keys}, t, my - w1 * m1 - w2 * m2 as c0, w1 as c1, w2 as c2 from {name}_w)"""

    centred = """sx1 / n as m1, sx2 / n as m2, sy / n as my, p11 - sx1 * sx1 / n as s11, p22 - sx2 * sx2 / n as s22,
      p12 - sx1 * sx2 / n as s12, q1 - sx1 * sy / n as c1, q2 - sx2 * sy / n as c2"""
    sums = ["n", "sx1", "sx2", "sy", "p11", "p22", "p12", "q1", "q2"]
    return f"""cell as (
      select g, o, j, count(*)::double as n, sum(x1) as sx1, sum(x2) as sx2, sum(y) as sy, sum(x1 * x1) as p11, sum(x2 * x2) as p22,
             sum(x1 * x2) as p12, sum(x1 * y) as q1, sum(x2 * y) as q2 from dealt group by 1, 2, 3),
    sums as (select g, o, {', '.join(f'sum({c}) as {c}' for c in sums)} from cell group by 1, 2),
    rest as (select cell.g, cell.o, j, {', '.join(f'sums.{c} - cell.{c} as {c}' for c in sums)} from cell join sums using (g, o)),
    rest_c as (select g, o, j, {centred} from rest),
    sums_c as (select g, o, {centred} from sums),
    {one('in_a', 'rest_c', 'a1', uses[0], 'g, o, j')},
    {one('in_b', 'rest_c', 'a2', uses[1], 'g, o, j')},
    {one('all_a', 'sums_c', 'a1', uses[0], 'g, o')},
    {one('all_b', 'sums_c', 'a2', uses[1], 'g, o')},
    oof as (
      select g, o, t, y, a.c0 + a.c1 * x1 + a.c2 * x2 as pa, b.c0 + b.c1 * x1 + b.c2 * x2 as pb
      from dealt join in_a a using (g, o, j) join in_b b using (g, o, j, t)),
    meta_c as (
      select g, o, t, am, avg(pa) as ma, avg(pb) as mb, avg(y) as my, var_pop(pa) * count(*) + am as saa, var_pop(pb) * count(*) + am as sbb,
             covar_pop(pa, pb) * count(*) as sab, covar_pop(pa, y) * count(*) as ca, covar_pop(pb, y) * count(*) as cb
      from oof join params using (t) group by 1, 2, 3, 4),
    meta as (
      select g, o, t, ma, mb, my, (ca * sbb - cb * sab) / (saa * sbb - sab * sab) as wa, (cb * saa - ca * sab) / (saa * sbb - sab * sab) as wb from meta_c),
    fn as (
      select g, o, t, my + wa * (a.c0 - ma) + wb * (b.c0 - mb) as c0, wa * a.c1 + wb * b.c1 as c1, wa * a.c2 + wb * b.c2 as c2
      from meta join all_a a using (g, o, t) join all_b b using (g, o, t)),
    scores as (
      select g, o, t, avg(abs(e)) as mae, sqrt(avg(e * e)) as rmse,
             case when count(*) < 2 then null when var_pop(y) = 0 then (sum(e * e) = 0)::double else 1 - sum(e * e) / (var_pop(y) * count(*)) end as r2
      from (select g, o, t, y, y - c0 - c1 * x1 - c2 * x2 as e from held join fn using (g, o)) group by 1, 2, 3)"""


def params_sql(study: str, n: int, space=SPACE) -> str:
    draws = ", ".join(
        f"exp(ln({p.low!r}::double) + ('0x' || substr(md5('42|{study}|' || t || '|{p.name}'), 1, 8))::bigint / 4294967296.0::double * (ln({p.high!r}::double) - ln({p.low!r}::double))) as {c}"
        for p, c in zip(space, ("a1", "a2", "am"))
    )
    return f"params as (select t, {draws} from (select unnest(range({n})) as t))"


def search_sql(study: str, n: int) -> str:
    """scores and steps of all trials on all outer folds; every fold scaled by the rows outside it."""
    return f"""{SPLIT_ROWS},
    train as (select row_key, fold, price, exp(disc) as ed, charge as y, {hash_sql(1043)} as h from split_rows where dataset = 'train'),
    ends as (select o, min(price) as p0, max(price) - min(price) as pw, min(ed) as d0, max(ed) - min(ed) as dw
             from train, (select unnest(range({K})) as o) where fold <> o group by 1),
    lin as (select 0 as g, o, fold = o as is_held, row_key, h, (price - p0) / pw as x1, (ed - d0) / dw as x2, y from train, ends),
    held as (select * from lin where is_held),
    ranked as (select *, row_number() over (partition by o order by h, row_key) - 1 as i, count(*) over (partition by o) as n from lin where not is_held),
    dealt as materialized (select g, o, x1, x2, y, {folds_sql(INNER)} as j from ranked),
    {params_sql(study, n)},
    {stack_ctes([('x1', 'x2'), ('x1', 'x2')])},
    steps as materialized (
      select t, o + 1 as s, mae, rmse, r2, avg(mae) over (partition by t order by o rows unbounded preceding) as step from scores)"""


def replay_sql(batches: Sequence[Mapping]) -> str:
    """tried(t, state, n_steps): batches of trials {first, size, failed_at, run}; three PRUNED in a row end a run."""
    ctes, seen = [], []
    for b, spec in enumerate(batches):
        numbers = list(range(spec["first"], spec["first"] + spec["size"]))
        known = " union all ".join(f"select t, state, n_steps, {batches[x]['run']} as run from state_{x}" for x in seen) or "select 0 as t, '' as state, 0 as n_steps, 0 as run where false"
        ctes.append(f"known_{b} as ({known})")
        if spec.get("failed_at") is not None:
            ctes.append(f"state_{b} as (select unnest({numbers}) as t, 'FAIL' as state, {spec['failed_at']} as n_steps)")
        else:
            ctes.append(f"""done_{b} as (select t from known_{b} where state = 'COMPLETE'),
    cut_{b} as (
      select t, min(s) as s from (select t, s, min(step) over (partition by t order by s) as low from steps where t in {tuple(numbers)})
      join (select s, median(step) as m from steps where t in (select t from done_{b}) group by s) using (s)
      where s >= {WARMUP} and low > m and (select count(*) from done_{b}) >= {STARTUP} group by t),
    stop_{b} as (select count(*) > 0 as yes from known_{b} x join known_{b} y on y.t = x.t + 1 join known_{b} z on z.t = x.t + 2
      where x.run = {spec['run']} and x.state = 'PRUNED' and y.state = 'PRUNED' and z.state = 'PRUNED'),
    state_{b} as (
      select t, case when s is null then 'COMPLETE' else 'PRUNED' end as state, coalesce(s, {K}) as n_steps
      from (select unnest({numbers}) as t) left join cut_{b} using (t) where not (select yes from stop_{b}))""")
        seen.append(b)
    whole = " union all ".join(f"select * from state_{x}" for x in seen)
    return ",\n    ".join(ctes) + f",\n    tried as ({whole})"


N_TRIALS = 9
BATCHES = [dict(first=i, size=BATCH, run=0) for i in range(0, N_TRIALS, BATCH)]
TRIED = f"{search_sql('stack', N_TRIALS)}, {replay_sql(BATCHES)}"
VALUES = "left join (select t, n as n_steps, v from (select t, s as n, step as v from steps)) using (t, n_steps)"
ALPHAS = ["a_alpha", "b_alpha", "m_alpha"]


def searched(spark, sf) -> Study:
    return tune(search_rows(spark, sf), ROLES, STACK, "row_key", "stack", n_trials=N_TRIALS, **RULES)


def _trials(study: DataFrame, steps: DataFrame) -> DataFrame:
    reached = steps.groupBy("trial").agg(F.count("*").cast("int").alias("n_steps"))
    rows = study.join(reached, "trial", "left")
    return rows.select("trial", "state", F.coalesce("n_steps", F.lit(0)).alias("n_steps"), r(F.col("value"), 2).alias("value"),
                       *[r(F.log10(F.col("params")[a]), 6).alias(f"log_{a}") for a in ALPHAS])


LOGS = ", ".join(f"{rnd(f'log10({c})', 6)} as log_{a}" for a, c in zip(ALPHAS, ("a1", "a2", "am")))


@query(
    "tune_trials",
    f"""with {TRIED}
    select t as trial, state, n_steps, {rnd("case when state = 'COMPLETE' then v end", 2)} as value, {LOGS}
    from tried {VALUES} join params using (t)""",
)
def q_tune_trials(spark, sf):
    """Every trial of a searched stack: batches of three, each fold for all live trials at once, losers out by the median rule."""
    study = searched(spark, sf)
    return _trials(study.trials_df(spark), study.steps_df(spark))


@query(
    "tune_steps",
    f"""with {TRIED}
    select t as trial, s::integer - 1 as fold, {rnd('mae', 2)} as "MAE", {rnd('rmse', 2)} as "RMSE", {rnd('r2', 6)} as "R2", {rnd('step', 2)} as running
    from steps join tried using (t) where s <= n_steps""",
)
def q_tune_steps(spark, sf):
    """Three metrics of every fold that a trial reached, and the running mean that pruning looks at."""
    study = searched(spark, sf)
    folds = study.folds_df(spark).join(study.steps_df(spark).withColumn("fold", F.col("step") - 1), ["trial", "fold"])
    return folds.select("trial", "fold", r(F.col("MAE"), 2).alias("MAE"), r(F.col("RMSE"), 2).alias("RMSE"), r(F.col("R2"), 6).alias("R2"), r(F.col("step_value"), 2).alias("running"))


def fixed_sql(params: str) -> str:
    """final(dataset, y, p): the stack with one row of ``params``, fitted on all training rows."""
    return f"""{LINEAR}, {params},
    ranked as (select row_key, x1, x2, y, row_number() over (order by {hash_sql(1043)}, row_key) - 1 as i, count(*) over () as n from lin where dataset = 'train'),
    dealt as materialized (select 0 as g, 0 as o, x1, x2, y, {folds_sql(INNER)} as j from ranked),
    held as (select 0 as g, 0 as o, x1, x2, y from lin where false),
    {stack_ctes([('x1', 'x2'), ('x1', 'x2')])},
    final as (select dataset, y, c0 + c1 * x1 + c2 * x2 as p from lin, fn)"""


FIXED = {"a_alpha": 0.5, "b_alpha": 2e4, "m_alpha": 1e11}


@query(
    "fixed_stack",
    f"""with {fixed_sql("params as (select 0 as t, 0.5::double as a1, 2e4::double as a2, 1e11::double as am)")},
    s as (select dataset, count(*) as n, {SCORES} from final group by 1)
    select 'charge' as target, dataset, {ROUNDED} from s""",
)
def q_fixed_stack(spark, sf):
    """Training with given parameters, the preprocessor, inner folds and refit as everywhere, and the hold-out report."""
    rows = prepared(spark, sf, *ROLES, "charge")
    _, report = fit_with_params(rows, {"charge": list(ROLES)}, {"charge": FIXED}, STACK, "row_key", INNER, exp=["disc"])
    return report.select("target", "dataset", *_rounded_scores())


@query(
    "tune_best",
    f"""with {TRIED}
    select t as trial, {rnd('v', 2)} as value, {rnd('(select avg(rmse) from steps x where x.t = b.t)', 2)} as "RMSE",
           {rnd('(select avg(r2) from steps x where x.t = b.t)', 6)} as "R2", {LOGS}
    from (select t, v from tried {VALUES} where state = 'COMPLETE' order by v, t limit 1) b join params using (t)""",
)
def q_tune_best(spark, sf):
    study = searched(spark, sf)
    best = study.best
    one = spark.createDataFrame([(best.number, best.value, *(sum(f[m] for f in best.folds) / K for m in METRICS[1:]), *(best.params[a] for a in ALPHAS))],
                                f"trial long, value double, RMSE double, R2 double, {', '.join(f'{a} double' for a in ALPHAS)}")
    return one.select("trial", r(F.col("value"), 2).alias("value"), r(F.col("RMSE"), 2).alias("RMSE"), r(F.col("R2"), 6).alias("R2"),
                      *[r(F.log10(a), 6).alias(f"log_{a}") for a in ALPHAS])


# The first batch ends, the second breaks in its second fold, trial 6 is claimed by a session that dies; then the study goes on.
RESUMED = [dict(first=0, size=3, run=0), dict(first=3, size=3, run=0, failed_at=1), dict(first=6, size=1, run=0, failed_at=0),
           dict(first=7, size=3, run=1), dict(first=10, size=3, run=1)]


@query(
    "resumed_study",
    f"""with {search_sql('resumed', 13)}, {replay_sql(RESUMED)}
    select t as trial, state, n_steps, {rnd("case when state = 'COMPLETE' then v end", 2)} as value,
           {', '.join(f"case when t <> 6 then {rnd(f'log10({c})', 6)} end as log_{a}" for a, c in zip(ALPHAS, ('a1', 'a2', 'am')))}
    from tried {VALUES} join params using (t)""",
)
def q_resumed_study(spark, sf):
    """A study that broke twice and was resumed from its log: goal, remaining trials and numbers as the log has them."""
    rows = search_rows(spark, sf)
    store = TrialStore(spark, f"{shared_dir(spark)}/study-{uuid.uuid4().hex}", lease=0)
    staged = stage_table(rows, "resumed")
    scores, begun = LinearFolds(staged, ROLES, STACK, "row_key", k=K, inner=INNER), []

    def breaks(i, trials):
        begun.append(i)
        if len(begun) == K + 2:
            raise InterruptedError("the second batch ends in its second fold")
        return scores(i, trials)

    name = "resumed"
    try:
        run_folds(store.open(name, N_TRIALS), breaks, random_proposals(SPACE), N_TRIALS, K, batch=BATCH, startup=STARTUP, warmup=WARMUP,
                  claim=lambda size: store.claim(name, size), finished=lambda done: store.save(name, done))
    except InterruptedError:
        store.claim(name, 1)
    settings = SearchSettings(n_trials=N_TRIALS, folds=K, inner=INNER, space=SPACE, sampler="random", batch=BATCH, startup=STARTUP, warmup=WARMUP)
    run_study(staged, ROLES, STACK, "row_key", name, store, settings)
    store.compact()
    return _trials(store.trials(name), store.steps(name))


@query(
    "cv_three_metrics",
    f"""with {LINEAR}, train as (select * from lin where dataset = 'train'),
    g as (select f as fold, 3.0::double as alpha, {SUMS} from train, (select unnest(range({K})) as f) where fold <> f group by 1),
    {ridge_sql('w', 'g', 'fold')},
    s as (select fold, count(*) as n, {SCORES} from (select fold, y, b0 + b1 * x1 + b2 * x2 as p from train join w using (fold)) group by 1),
    m as (select fold::varchar as fold, n, "MAE", "RMSE", "R2" from s union all select 'mean', sum(n), avg("MAE"), avg("RMSE"), avg("R2") from s)
    select fold, n::bigint as n, {ROUNDED} from m""",
)
def q_cv_three_metrics(spark, sf):
    """Three metrics of every fold and their means, observed while the out-of-fold predictions are written."""
    rows = stage_table(linear_train(spark, sf).select("fold", "y", *X_TWO), "cv")
    per_fold, mean, oof = cross_validate(lambda part: fit_learner("Ridge", {"alpha": 3.0}, part, X_TWO), rows, "fold", K)
    counts = oof.groupBy("fold").agg(F.count("*").alias("n"))
    folds = per_fold.join(counts, "fold").select(F.col("fold").cast("string").alias("fold"), "n", *METRICS)
    whole = mean.select(F.lit("mean").alias("fold"), F.lit(oof.count()).alias("n"), *METRICS)
    return folds.unionByName(whole).select("fold", "n", *_rounded_scores())


# All groups at once

GROUPS = ["brand", "ptype", "flag", "status", "band"]
X = X_TWO
CANDIDATES = [(0.01, 0.02, 1e6), (0.01, 0.5, 1e8), (0.3, 0.02, 1e7), (1.0, 1.0, 1e9)]
SMALL = 2
CANDIDATE_ROWS = ", ".join(f"({t}, {a!r}::double, {b!r}::double, {m!r}::double)" for t, (a, b, m) in enumerate(CANDIDATES))

GROUP_STACKS = f"""{LINEAR},
    lin2 as (select lin.*, concat_ws('|', brand, ptype, flag, status, floor((x1 * pw + p0) / 30000)::bigint) as g from lin, ends),
    folded as (
      select *, {folds_sql(K)} as outer_fold from (
        select *, row_number() over (partition by g order by {hash_sql(43)}, row_key) - 1 as i, count(*) over (partition by g) as n from lin2 where dataset = 'train')),
    both_folds as materialized (
      select g, outer_fold, x1, x2, y, n, {folds_sql(INNER)} as j from (
        select g, outer_fold, x1, x2, y, n, row_number() over (partition by g order by {hash_sql(1043)}, row_key) - 1 as i from folded) where n >= 7),
    outers as (select unnest(range({K + 1})) as o),
    dealt as materialized (select g, o, x1, x2, y, j from both_folds, outers where o <> outer_fold),
    held as (select g, outer_fold as o, x1, x2, y from both_folds),
    params as (select * from (values {CANDIDATE_ROWS}) v(t, a1, a2, am)),
    {stack_ctes([('x1', ''), ('', 'x2')])},
    sizes as (select g, count(*) as n_rows from both_folds group by 1),
    means as (select g, t, avg(mae) as mae, avg(rmse) as rmse, avg(r2) as r2 from scores group by 1, 2),
    best as (
      select *, row_number() over (partition by g order by mae, t) as rk
      from means join sizes using (g) where n_rows > 25 or t < {SMALL}),
    chosen as (select g, t, n_rows, mae, rmse, r2, c0, c1, c2 from best join fn using (g, t) where rk = 1 and o = {K})"""


def grouped_rows(spark, sf) -> DataFrame:
    """Raw and scaled columns of all rows, with five group keys; groups have 1 to some 60 rows at the smaller scales."""
    columns = ["row_key", "flag", "status", "brand", "ptype", "price", "disc", "charge", "dataset"]
    # Not by partition: four fifths are 'train', and rows need not be sorted by it to be written.
    rows = stage_table(with_split(feature_rows(spark, sf), "row_key").select(*columns), "rows").withColumn("band", F.floor(F.col("price") / 30000))
    pre = Preprocessor(ROLES).fit(rows.where(F.col("dataset") == "train"))
    return pre.transform(rows).withColumn("y", F.col("charge"))


def group_stacks(rows: DataFrame) -> DataFrame:
    candidates = [LinearStack([([0], a), ([1], b)], m) for a, b, m in CANDIDATES]
    return tune_stacks_by_group(rows.where(F.col("dataset") == "train"), X, "y", "row_key", GROUPS, candidates, SMALL, K, INNER, staged=True)


@query(
    "group_stack_search",
    f"""with {GROUP_STACKS}
    select g, n_rows, case when n_rows > 25 then {len(CANDIDATES)} else {SMALL} end as n_trials, t as trial, {rnd('mae', 2)} as mae, {rnd('rmse', 2)} as rmse,
           case when r2 > -1e4 then {rnd('r2', 4)} end as r2 from chosen""",
)
def q_group_stack_search(spark, sf):
    """The best stack of every group of seven rows or more by nested folds, all groups in one job."""
    found = group_stacks(grouped_rows(spark, sf))
    return found.select(F.concat_ws("|", *[F.col(c).cast("string") for c in GROUPS]).alias("g"), "n_rows", "n_trials", "trial", r(F.col("mae"), 2).alias("mae"),
                        r(F.col("rmse"), 2).alias("rmse"), F.when(F.col("r2") > -1e4, r(F.col("r2"), 4)).alias("r2"))


GROUP_SCORES = f"""{GROUP_STACKS},
    t as (select 5.0::double as alpha, {SUMS} from lin where dataset = 'train'),
    {ridge_sql('w', 't', '')}"""


def _group_bundle(spark, rows: DataFrame) -> Bundle:
    """Group stacks over a global ridge, saved and loaded again."""
    train = rows.where(F.col("dataset") == "train")
    pre = Preprocessor(ROLES).fit(train)
    fitted = fit_learner("Ridge", {"alpha": 5.0}, train, X)
    kinds = dict(train.dtypes)
    bundle = Bundle(
        {"charge": PipelineModel([pre.stages()[0], *fitted.stages])},
        {"charge": TargetMeta(list(ROLES), {c: kinds[c] for c in ROLES}, {"ridge_alpha": 5.0})},
        {"charge": GroupModels(GROUPS, X, group_stacks(rows))},
    )
    path = f"{shared_dir(spark)}/groups-{uuid.uuid4().hex}"
    save_bundle(bundle, spark, path)
    return load_bundle(spark, path)


@query(
    "score_by_group",
    f"""with {GROUP_SCORES}
    select row_key, case when c.g is null then 'global' else 'group' end as route,
           {rnd('coalesce(c.c0 + c.c1 * x1 + c.c2 * x2, w.b0 + w.b1 * x1 + w.b2 * x2)', 0)} as pred_charge
    from lin2 cross join w left join chosen c using (g)""",
)
def q_score_by_group(spark, sf):
    """Raw rows scored with their group's stack from the model table, the global model where there is none."""
    rows = grouped_rows(spark, sf)
    bundle = _group_bundle(spark, rows)
    raw = rows.select("row_key", *ROLES, *GROUPS)
    scored = score_batch(bundle, raw)
    known = bundle.groups["charge"].table.select(*GROUPS).withColumn("route", F.lit("group"))
    routed = scored.join(known, GROUPS, "left")
    return routed.select("row_key", F.coalesce("route", F.lit("global")).alias("route"), r(F.col("pred_charge"), 0).alias("pred_charge"))


@query(
    "score_by_group_stream",
    f"""with {GROUP_SCORES}
    select row_key, {rnd('coalesce(c.c0 + c.c1 * x1 + c.c2 * x2, w.b0 + w.b1 * x1 + w.b2 * x2)', 0)} as pred_charge
    from lin2 cross join w left join chosen c using (g)""",
)
def q_score_by_group_stream(spark, sf):
    """The same on a stream: rows meet the table of group models as they arrive."""
    rows = grouped_rows(spark, sf)
    bundle = _group_bundle(spark, rows)
    base = f"{shared_dir(spark)}/arriving-{uuid.uuid4().hex}"
    rows.select("row_key", *ROLES, *GROUPS).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    write_available(score_stream(bundle, stream), f"{base}/rows", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/rows").select("row_key", r(F.col("pred_charge"), 0).alias("pred_charge"))
