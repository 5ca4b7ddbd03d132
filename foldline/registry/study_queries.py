"""Queries on the search history."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foldline import fixtures as fx
from foldline.functions.numeric import round_half_up as r
from foldline.operators import reports, space as sp, studies as st
from foldline.operators.pruning import first_prune, median_prune
from foldline.operators.search import propose_tpe, space_of
from foldline.registry.base import STEPS, STUDIES, TRIALS, query, rnd
from foldline.session import shared_dir, stage_table
from foldline.sources.params import load_params, missing_targets, save_params

TOL = 5.0  # the smallest value in the history is 0.01, so the stop rules get a wide tolerance


def _best(cols: str = "study") -> str:
    return f"""best as (
      select {cols}, trial as best_trial, value as best_value, p_k, p_m from (
        select *, row_number() over (partition by {cols} order by value, trial) as rk
        from trials where state = 'COMPLETE' and value is not null) where rk = 1)"""


COUNTS = """counts as (
  select study, count(*) filter (where state = 'COMPLETE') as n_complete, count(*) filter (where state = 'PRUNED') as n_pruned,
         count(*) filter (where state = 'FAIL') as n_fail, count(*) as n_total from trials group by study)"""


def history_of(spark, sf):
    """The history staged once, for queries that scan it several times."""
    return stage_table(fx.trials(spark, sf).drop("raw_value", "event_id"), "trials")


def flat_params(df, col="best_params"):
    return df.withColumn("p_k", F.element_at(col, "p_k")).withColumn("p_m", F.element_at(col, "p_m")).drop(col)


@query(
    "study_summary",
    f"with {TRIALS}, {COUNTS}, {_best()} select study, n_complete, n_pruned, n_fail, n_total, best_trial, best_value, p_k, p_m "
    "from counts left join best using (study)",
)
def q_study_summary(spark, sf):
    return flat_params(st.inspect_studies(fx.trials(spark, sf)))


@query("study_best", f"with {TRIALS}, {_best()} select * from best")
def q_study_best(spark, sf):
    return flat_params(st.study_best(fx.trials(spark, sf)))


@query("finished_studies", "select distinct 'study_' || user_id as study from events where event_type not in ('signup', 'error')")
def q_finished_studies(spark, sf):
    return st.finished_studies(fx.trials(spark, sf))


@query(
    "finished_sample",
    "select distinct 'study_' || user_id as study from events where event_type not in ('signup', 'error') order by 1 limit 5",
)
def q_finished_sample(spark, sf):
    return st.finished_studies(fx.trials(spark, sf)).orderBy("study").limit(5)


def wanted_studies(spark, sf):
    return fx.table(spark, sf, "customer").select(F.concat(F.lit("study_"), F.col("c_custkey").cast("string")).alias("study"))


@query(
    "studies_to_run",
    f"with {TRIALS} select 'study_' || c_custkey as study from customer "
    "where 'study_' || c_custkey not in (select study from trials where state = 'COMPLETE')",
)
def q_studies_to_run(spark, sf):
    return st.studies_to_run(wanted_studies(spark, sf), st.finished_studies(fx.trials(spark, sf)))


@query(
    "study_best_lookup",
    f"with {TRIALS}, {_best()} select w.study, best_value, p_k, p_m from (select 'study_' || c_custkey as study from customer) w "
    "left join best b on b.study = w.study",
)
def q_study_best_lookup(spark, sf):
    best = flat_params(st.study_best(fx.trials(spark, sf))).drop("best_trial")
    return wanted_studies(spark, sf).join(best, "study", "left")


@query(
    "best_group",
    f"with {TRIALS}, {_best('target, study')} select target, study, best_value from ("
    "select *, row_number() over (partition by target order by best_value, study) as rk2 from best) where rk2 = 1",
)
def q_best_group(spark, sf):
    scores = st.study_best(fx.trials(spark, sf), ["target", "study"])
    return st.best_group(scores, "target", "best_value", ["study"])


WINNERS = f"""{TRIALS}, {_best('target, study')},
    winners as (
      select target, case when target = 'target_1' then 'nan'::double else score end as score, p_k from (
        select target, best_value as score, p_k, row_number() over (partition by target order by best_value, study) as rk2
        from best) where rk2 = 1),
    overall as (select value as score, p_k from trials where state = 'COMPLETE' order by value, study, trial limit 1)"""


@query(
    "winner_guard",
    f"""with {WINNERS}
    select target, case when isnan(w.score) then 'global' else 'group' end as origin,
           case when isnan(w.score) then o.score else w.score end as score,
           case when isnan(w.score) then o.p_k else w.p_k end as p_k
    from winners w, overall o""",
)
def q_winner_guard(spark, sf):
    history = history_of(spark, sf)
    per_group = st.study_best(history, ["target", "study"])
    best = st.best_group(per_group, "target", "best_value", ["study"], ["best_params"])
    # One target's group search is made to end without a usable score.
    broken = F.when(F.col("target") == "target_1", F.lit(float("nan"))).otherwise(F.col("best_value"))
    winners = best.select("target", broken.alias("score"), F.col("best_params").alias("params"))
    done = history.where(st.in_state(st.COMPLETE))
    overall = done.orderBy("value", "study", "trial").limit(1).select(F.col("value").alias("score"), "params").first()
    targets = history.select("target").distinct()
    params = F.create_map(*[F.lit(x) for kv in overall["params"].items() for x in kv])
    fallback = targets.select("target", F.lit(overall["score"]).alias("score"), params.alias("params"))
    return st.winner_or_fallback(targets, winners, fallback).select(
        "target", "origin", "score", F.element_at("params", "p_k").alias("p_k")
    )


@query(
    "params_by_target",
    f"""with {TRIALS}, {_best('target')}
    select study, trial, t.target, b.p_k, b.p_m, {rnd('value - best_value', 6)} as gap
    from trials t join best b on b.target = t.target where state = 'COMPLETE'""",
)
def q_params_by_target(spark, sf):
    history = fx.trials(spark, sf)
    best = flat_params(st.study_best(history, ["target"])).drop("best_trial")
    done = history.where(st.in_state(st.COMPLETE)).select("study", "trial", "target", "value")
    return done.join(best, "target").select(
        "study", "trial", "target", "p_k", "p_m", r(F.col("value") - F.col("best_value"), 6).alias("gap")
    )


@query(
    "params_missing_targets",
    """select distinct 'target_' || user_id || '_' || (event_id % 7) as target from events
    where 'target_' || user_id || '_' || (event_id % 7) not in (
      select 'target_' || user_id || '_' || (event_id % 7) from events where event_type not in ('signup', 'error'))""",
)
def q_params_missing_targets(spark, sf):
    """Targets of which no trial has ended well."""
    own = F.concat_ws("_", F.lit("target"), F.col("user_id"), F.col("event_id") % 7)
    history = fx.trials(spark, sf).withColumn("target", own)
    params = st.study_best(history, ["target"]).select("target", F.col("best_params").alias("params"))
    return missing_targets(history, params)


@query("params_round_trip", f"with {TRIALS}, {_best('target')} select target, p_k, p_m from best")
def q_params_round_trip(spark, sf):
    """The best parameters of every target, saved as a table of parameters and loaded again."""
    best = st.study_best(fx.trials(spark, sf), ["target"]).select("target", F.col("best_params").alias("params"))
    path = f"{shared_dir(spark)}/params-{uuid.uuid4().hex}"
    save_params(best, path)
    targets = [x["target"] for x in best.select("target").collect()]
    return flat_params(load_params(spark, path, targets), "params").select("target", "p_k", "p_m")


@query(
    "study_names",
    """select p_brand as brand, cast(p_size % 3 as integer) as size_class, 'retail_study' as global_name,
              'retail_group_' || p_brand || '_' || (p_size % 3) as group_name, count(*) as n
       from part group by 1, 2, 3, 4""",
)
def q_study_names(spark, sf):
    part = fx.table(spark, sf, "part").select(F.col("p_brand").alias("brand"), (F.col("p_size") % 3).alias("size_class"))
    named = part.select(
        "brand",
        "size_class",
        st.study_name("retail").alias("global_name"),
        st.study_name("retail", F.col("brand"), F.col("size_class")).alias("group_name"),
    )
    return named.groupBy("brand", "size_class", "global_name", "group_name").agg(F.count("*").alias("n"))


@query(
    "running_fold_mean",
    f"with {STEPS} select study, trial, step, {rnd('avg(step_value) over (partition by study, trial order by step)', 6)} "
    "as running_mean from trial_steps",
)
def q_running_fold_mean(spark, sf):
    means = st.running_fold_mean(fx.trial_steps(fx.trials(spark, sf)))
    return means.select("study", "trial", "step", r(F.col("running_mean"), 6).alias("running_mean"))


@query(
    "median_prune",
    f"""with {STEPS},
    reported as (
      select study, trial, step, step_value,
             min(step_value) over (partition by study, trial order by step) as best
      from (select study, trial, step, avg(step_value) over (partition by study, trial order by step) as step_value from trial_steps)),
    done as (select study, trial from trials where state = 'COMPLETE'),
    peers as (select r.study, r.trial, r.step, r.step_value from reported r join done using (study, trial)),
    judged as (
      select r.study, r.trial, r.step, r.best, count(p.trial) as m, median(p.step_value) as med
      from reported r left join peers p on p.study = r.study and p.step = r.step and p.trial < r.trial
      where r.step >= 2 group by 1, 2, 3, 4)
    select study, trial, cast(min(step) as integer) as step from judged where m >= 5 and best > med group by 1, 2""",
)
def q_median_prune(spark, sf):
    history = stage_table(fx.trials(spark, sf).select("study", "trial", "state", "raw_value", "event_id"), "trials")
    means = st.running_fold_mean(fx.trial_steps(history)).select("study", "trial", "step", F.col("running_mean").alias("step_value"))
    return first_prune(median_prune(stage_table(means, "means"), history))


def _streak_sql(hit: str, source: str = "trials") -> str:
    return f"""marked as (
      select study, trial, ({hit}) as hit,
             trial - row_number() over (partition by study, ({hit}) order by trial) as island from {source}),
    runs as (
      select study, trial, row_number() over (partition by study, island order by trial) as len from marked where hit),
    stops as (select study, min(trial) as stop_trial from runs where len >= 3 group by study)"""


BEST_BEFORE = """tagged as (
      select *, min(case when state = 'COMPLETE' then value end) over (
        partition by study order by trial rows between unbounded preceding and 1 preceding) as best_before from trials)"""
PRUNED_HIT = "state = 'PRUNED'"
SMALL_HIT = f"coalesce(state = 'COMPLETE' and value <= {TOL}, false)"
STALLED_HIT = f"coalesce(state = 'COMPLETE' and abs(value - best_before) <= {TOL}, false)"


@query("stop_pruned_streak", f"with {TRIALS}, {_streak_sql(PRUNED_HIT)} select * from stops")
def q_stop_pruned_streak(spark, sf):
    return st.pruned_streaks(fx.trials(spark, sf))


@query("stop_small_value", f"with {TRIALS}, {_streak_sql(SMALL_HIT)} select * from stops")
def q_stop_small_value(spark, sf):
    return st.small_value_streaks(fx.trials(spark, sf), TOL)


@query("stop_stalled", f"with {TRIALS}, {BEST_BEFORE}, {_streak_sql(STALLED_HIT, 'tagged')} select * from stops")
def q_stop_stalled(spark, sf):
    return st.stalled_streaks(fx.trials(spark, sf), TOL)


def _renamed(sql: str, tag: str) -> str:
    for name in ("marked", "runs", "stops"):
        sql = sql.replace(f"{name} ", f"{name}_{tag} ")
    return sql


ALL_STOPS = f"""{BEST_BEFORE}, {_renamed(_streak_sql(PRUNED_HIT), 'a')}, {_renamed(_streak_sql(SMALL_HIT), 'b')},
    {_renamed(_streak_sql(STALLED_HIT, 'tagged'), 'c')},
    every_stop as (
      select *, 'pruned' as rule from stops_a union all select *, 'small' from stops_b union all select *, 'stalled' from stops_c),
    first_stop as (
      select study, stop_trial, rule from (
        select *, row_number() over (partition by study order by stop_trial, rule) as rk from every_stop) where rk = 1)"""


@query("study_stop_trial", f"with {TRIALS}, {ALL_STOPS} select * from first_stop")
def q_study_stop_trial(spark, sf):
    return st.stop_trial(history_of(spark, sf), tol=TOL)


@query(
    "lowered_goals",
    f"""with {TRIALS}, {STUDIES}, {ALL_STOPS},
    kept as (select t.* from trials t left join first_stop f on f.study = t.study where f.study is null or t.trial <= f.stop_trial),
    fin as (select study, count(*) filter (where state in ('COMPLETE', 'PRUNED')) as finished from kept group by study)
    select s.study, finished, coalesce(goal_n_trials, 30)::bigint as goal,
           case when f.study is not null and finished < coalesce(goal_n_trials, 30) then finished
                else coalesce(goal_n_trials, 30)::bigint end as new_goal
    from studies s join fin using (study) left join first_stop f on f.study = s.study""",
)
def q_lowered_goals(spark, sf):
    history = history_of(spark, sf)
    goals = st.lowered_goals(history, fx.studies(history), st.stop_trial(history, tol=TOL))
    return goals.select("study", "finished", "goal", "new_goal")


DECISION = f"""{TRIALS}, {STUDIES}, {COUNTS},
    decision as (
      select study, n_total, n_complete + n_pruned as finished, coalesce(goal_n_trials, 30)::bigint as goal,
             greatest(0, coalesce(goal_n_trials, 30) - (n_complete + n_pruned))::bigint as remaining
      from counts join studies using (study))"""


@query("resume_decision", f"with {DECISION} select study, finished, goal, remaining, remaining > 0 as should_run from decision")
def q_resume_decision(spark, sf):
    history = fx.trials(spark, sf)
    decision = st.resume_decision(st.inspect_studies(history), fx.studies(history))
    return decision.select("study", "finished", "goal", "remaining", "should_run")


@query("next_trials", f"with {DECISION} select study, unnest(range(n_total, n_total + remaining)) as trial from decision where remaining > 0")
def q_next_trials(spark, sf):
    history = fx.trials(spark, sf)
    return st.next_trials(st.resume_decision(st.inspect_studies(history), fx.studies(history)))


# Reports on the history


@query(
    "optimization_history",
    f"with {TRIALS} select study, trial, value, min(value) over (partition by study order by trial) as best_so_far "
    "from trials where state = 'COMPLETE'",
)
def q_optimization_history(spark, sf):
    return st.optimization_history(fx.trials(spark, sf)).select("study", "trial", "value", "best_so_far")


LONG = f"""{TRIALS}, long as (
      select study, trial, value, 'p_k' as param, p_k as pvalue from trials where state = 'COMPLETE'
      union all select study, trial, value, 'p_m', p_m from trials where state = 'COMPLETE'),
    strength as (
      select study, param, count(*) as n_trials,
             case when stddev_pop(pvalue) > 0 and stddev_pop(value) > 0 then abs(corr(pvalue, value)) else 0 end as importance
      from long group by 1, 2),
    ranked as (select *, row_number() over (partition by study order by importance desc, param) as rank from strength)"""


@query("param_slice", f"with {LONG} select study, trial, param, pvalue, value from long")
def q_param_slice(spark, sf):
    return reports.param_slice(fx.trials(spark, sf))


@query("param_importance", f"with {LONG} select study, param, n_trials, {rnd('importance', 6)} as importance from strength")
def q_param_importance(spark, sf):
    return reports.param_importance(fx.trials(spark, sf)).withColumn("importance", r(F.col("importance"), 6))


@query(
    "top_params",
    f"with {LONG} select study, param, cast(rank as integer) as rank, n_trials, {rnd('importance', 6)} as importance from ranked where rank <= 2",
)
def q_top_params(spark, sf):
    return reports.top_params(fx.trials(spark, sf)).withColumn("importance", r(F.col("importance"), 6))


@query(
    "param_contour",
    f"""with {LONG},
    pair as (select study, max(param) filter (where rank = 1) as px, max(param) filter (where rank = 2) as py from ranked group by 1),
    pts as (
      select study, px, py, value, case px when 'p_k' then p_k else p_m end as x, case py when 'p_k' then p_k else p_m end as y
      from trials join pair using (study) where state = 'COMPLETE'),
    ends as (select study, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from pts group by 1)
    select study, px, py, cast(least(floor((x - x0) / (x1 - x0) * 5), 4) as integer) as bx,
           cast(least(floor((y - y0) / (y1 - y0) * 5), 4) as integer) as "by", {rnd('avg(value)', 6)} as mean_value, count(*) as n
    from pts join ends using (study) group by 1, 2, 3, 4, 5""",
)
def q_param_contour(spark, sf):
    return reports.param_contour(history_of(spark, sf)).withColumn("mean_value", r(F.col("mean_value"), 6))


@query("intermediate_values", f"with {STEPS} select study, trial, step, {rnd('step_value', 6)} as step_value, state from trial_steps join trials using (study, trial)")
def q_intermediate_values(spark, sf):
    history = fx.trials(spark, sf)
    out = reports.intermediate_values(fx.trial_steps(history), history)
    return out.select("study", "trial", "step", r(F.col("step_value"), 6).alias("step_value"), "state")


# Search spaces


def space_sql() -> str:
    rows = ", ".join(
        f"({n}, '{p}', '{k}', {lo!r}::double, {hi!r}::double, {s!r}::double, {str(lg).lower()})"
        for n, p, k, lo, hi, s, lg in sp.space_rows({n: p.space for n, p in sp.PRESETS.items()})
    )
    return f'space as (select * from (values {rows}) v(preset, param, kind, low, high, step, "log"))'


DRAWS = f"""{TRIALS}, {space_sql()},
    u as (
      select study, trial, preset, param, kind, low, high, step, "log" as is_log,
             (('0x' || substr(md5(concat_ws('|', '42', study, trial, param)), 1, 8))::bigint)::double / 4294967296.0::double as u
      from trials join space using (preset)),
    draws as (
      select *, case when kind = 'int' then low + step * floor(u * (floor((high - low) / step) + 1))
                     when is_log then exp(ln(low) + u * (ln(high) - ln(low))) else low + u * (high - low) end as draw from u)"""


def draws(spark, sf):
    history = fx.trials(spark, sf).select("study", "trial", "preset")
    return sp.sample_space(history, sp.space_table(spark), ["study", "trial"])


@query("sample_space", f"with {DRAWS} select study, trial, param, {rnd('draw', 6)} as draw from draws")
def q_sample_space(spark, sf):
    return draws(spark, sf).select("study", "trial", "param", r(F.col("draw"), 6).alias("draw"))


@query(
    "preset_space",
    f"""with {DRAWS}
    select preset, param, kind, low, high, step, is_log, count(*) as n_draws, count(distinct {rnd('draw', 6)}) as n_values,
           {rnd('min(draw)', 6)} as lowest, {rnd('max(draw)', 6)} as highest
    from draws group by 1, 2, 3, 4, 5, 6, 7""",
)
def q_preset_space(spark, sf):
    rounded = draws(spark, sf).withColumnRenamed("log", "is_log").withColumn("draw", r(F.col("draw"), 6))
    return rounded.groupBy("preset", "param", "kind", "low", "high", "step", "is_log").agg(
        F.count("*").alias("n_draws"),
        F.count_distinct("draw").alias("n_values"),
        F.min("draw").alias("lowest"),
        F.max("draw").alias("highest"),
    )


LEARNER_OF = {a: name for p in sp.PRESETS.values() for a, name in [*p.bases, p.meta]}
ALIAS_SQL = "(values " + ", ".join(f"('{a}', '{n}')" for a, n in LEARNER_OF.items()) + ") a(alias, learner)"


@query(
    "params_by_alias",
    f"""with {DRAWS}
    select preset, alias, learner, substr(param, length(alias) + 2) as name, count(*) as n, {rnd('avg(draw)', 4)} as mean_draw
    from draws join {ALIAS_SQL} on split_part(param, '_', 1) = alias group by 1, 2, 3, 4""",
)
def q_params_by_alias(spark, sf):
    split = sp.split_by_alias(draws(spark, sf), LEARNER_OF)
    return split.groupBy("preset", "alias", "learner", "name").agg(
        F.count("*").alias("n"), r(F.avg("draw"), 4).alias("mean_draw")
    )


HISTORY_SPACE = [sp.real("p_k", 1.0, 100.0, log=True), sp.whole("p_m", 0, 6)]


@query(
    "propose_tpe",
    f"""with {TRIALS},
    sp as (select * from (values ('p_k', 'float', 1.0::double, 100.0::double, 0.0::double, true),
                                 ('p_m', 'int', 0.0::double, 6.0::double, 1.0::double, false)) v(param, kind, low, high, step, lg)),
    done as (
      select *, row_number() over (partition by study order by value, trial) as rk, count(*) over (partition by study) as n
      from trials where state = 'COMPLETE'),
    hist as (
      select study, 'p_k' as param, ln(least(greatest(p_k, 1), 100)) as x, ln(1.0::double) as lo, ln(100.0::double) as hi, rk <= ceil(n * 0.1::double) as good from done
      union all select study, 'p_m', least(greatest(p_m, 0), 6), 0, 6, rk <= ceil(n * 0.1::double) from done),
    gaps as (
      select *, x - coalesce(lag(x) over w, lo) as to_left, coalesce(lead(x) over w, hi) - x as to_right, count(*) over (partition by study, param, good) as points
      from hist window w as (partition by study, param, good order by x)),
    kernels as (select study, param, x, lo, hi, good, least(greatest(to_left, to_right, (hi - lo) / least(100, points + 1)), hi - lo) as width from gaps),
    cand as (
      select study, param, kind, lg, low, high, step, cand,
             (('0x' || substr(md5(concat_ws('|', '42', study, param, cand)), 1, 8))::bigint)::double / 4294967296.0::double as u
      from (select distinct study from done), sp, (select unnest(range(24)) as cand)),
    drawn as (
      select *, case when kind = 'int' then low + step * floor(u * (floor((high - low) / step) + 1))
                     else exp(ln(low) + u * (ln(high) - ln(low))) end as draw from cand),
    placed as (select *, case when lg then ln(draw) else draw end as spot from drawn),
    scored as (
      select study, param, cand, any_value(draw) as draw,
             ((coalesce(sum(k) filter (where good), 0) + any_value(prior)) / (count(*) filter (where good) + 1))
             / ((coalesce(sum(k) filter (where not good), 0) + any_value(prior)) / (count(*) filter (where not good) + 1)) as score
      from (select study, param, cand, draw, good, exp(-0.5::double * pow((spot - x) / width, 2)) / width as k,
                   exp(-0.5::double * pow((spot - (lo + hi) / 2) / (hi - lo), 2)) / (hi - lo) as prior
            from placed join kernels using (study, param))
      group by 1, 2, 3)
    select study, param, {rnd('draw', 6)} as draw from (
      select *, row_number() over (partition by study, param order by score desc, cand) as rk from scored) where rk = 1""",
)
def q_propose_tpe(spark, sf):
    proposals = propose_tpe(history_of(spark, sf), space_of(spark, HISTORY_SPACE))
    return proposals.select("study", "param", r(F.col("draw"), 6).alias("draw"))
