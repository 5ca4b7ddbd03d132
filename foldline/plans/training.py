"""Search, refit, report: the whole way from a table to scored models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from foldline.operators.groups import MIN_GROUP_ROWS, group_sizes
from foldline.operators.linear_stack import is_linear, stack_of, tune_stacks_by_group
from foldline.operators.preprocess import Preprocessor
from foldline.operators.roles import as_target, column_roles, dtypes_of, features_by_target
from foldline.operators.search import Study, tune
from foldline.operators.space import Param, Preset, sample_params
from foldline.operators.splits import with_folds, with_split
from foldline.operators.studies import COMPLETE, PRUNED, inspect_studies, resume_decision
from foldline.plans.fixed import fit_with_params
from foldline.session import stage_and_release, stage_table
from foldline.sources.bundle import Bundle, TargetMeta
from foldline.sources.trial_store import TrialStore


@dataclass
class SearchSettings:
    n_trials: int = 30
    folds: int = 5
    inner: int = 5
    seed: int = 42
    test: float = 0.2
    space: Sequence[Param] | None = None
    sampler: str = "tpe"
    prune: bool = True
    startup: int = 5
    warmup: int = 2
    stop: bool = True
    batch: int = 1
    min_group_rows: int = MIN_GROUP_ROWS
    group_threads: int = 4
    group_job: bool = True  # linear stacks of all groups in one job; else a study for each group, with pruning
    dedup: bool = False


@dataclass
class Training:
    bundle: Bundle
    params: dict[str, dict[str, float]]
    report: DataFrame
    groups: dict[str, list[GroupStudy]] = field(default_factory=dict)
    group_tables: dict[str, DataFrame] = field(default_factory=dict)


def run_study(
    rows: DataFrame, roles: Mapping[str, str], preset: Preset, key: str, name: str, store: TrialStore, s: SearchSettings,
    n_trials: int | None = None, staged: bool = False,
) -> Study:
    """Open or create a study, run what its goal still asks for, and record every trial as it ends.

    A study that a stop rule ends early keeps the number it finished as its goal. ``staged``: the rows come from files.
    """
    study = store.open(name, n_trials or s.n_trials)
    known = len(study.trials)
    summary = inspect_studies(store.trials(name))
    decision = resume_decision(summary, store.studies().where(F.col("study") == name), n_trials or s.n_trials).first()
    left = decision["remaining"] if decision else n_trials or s.n_trials
    if left == 0:
        return study
    tune(
        rows, dict(roles), preset, key, name, "y", "fold", s.folds, s.inner, left, s.space, study, s.seed, s.sampler, staged,
        prune=s.prune, startup=s.startup, warmup=s.warmup, stop=s.stop, batch=s.batch,
        claim=lambda size: store.claim(name, size), alive=lambda numbers: store.alive(name, numbers),
        finished=lambda done: store.save(name, done),
    )
    finished = sum(t.state in (COMPLETE, PRUNED) for t in study.trials)
    if len(study.trials) - known < left and finished < decision["goal"]:
        store.set_goal(name, finished)
    return study


@dataclass
class GroupStudy:
    """The outcome for one group; ``too_small`` ones have the parameters of the target's fallback."""

    group: tuple
    rows: int
    state: str
    value: float | None = None
    params: dict[str, float] | None = None


def group_studies(
    rows: DataFrame, target: str, roles, preset: Preset, key: str, keys: Sequence[str], store: TrialStore, s: SearchSettings
) -> list[GroupStudy]:
    """A study for every group of at least ``min_group_rows`` rows, in key order.

    Outer folds are exact inside each group, so that none is empty. Rows are
    written by group, and a group's study reads its own files. A bounded pool
    runs the studies; groups of few rows have the small trial budget.
    """
    folded = with_folds(rows.drop("fold"), key, s.folds, s.seed + 1, by=list(keys), exact=True)
    number = F.pmod(F.xxhash64(*keys), F.lit(1 << 10)).cast("int")
    staged = stage_table(folded.withColumn("group_part", number), "groups", ["group_part"])
    sizes = group_sizes(staged.withColumn("part", F.col("group_part")), [*keys, "part"], s.n_trials, min(s.n_trials, 10)).orderBy(*keys).collect()

    def study(r) -> GroupStudy:
        group = tuple(r[k] for k in keys)
        if r["n_rows"] < s.min_group_rows:
            return GroupStudy(group, r["n_rows"], "too_small")
        part = staged.where(F.col("group_part") == r["part"])
        for k, v in zip(keys, group):
            part = part.where(F.col(k).eqNullSafe(F.lit(v)))
        name = "_".join([target, "group", *[str(v) for v in group]])
        found = run_study(part.drop("group_part"), roles, preset, key, name, store, s, r["n_trials"], staged=True)
        if not any(t.state == COMPLETE for t in found.trials):
            return GroupStudy(group, r["n_rows"], "no_result")
        return GroupStudy(group, r["n_rows"], "searched", found.best.value, found.best.params)

    with ThreadPoolExecutor(s.group_threads) as pool:
        return list(pool.map(study, sizes))


def best_params_by_group(
    rows: DataFrame, target: str, roles, preset: Preset, key: str, keys: Sequence[str], store: TrialStore, s: SearchSettings
) -> tuple[dict[str, float], list[GroupStudy]]:
    """The parameters of the group with the smallest cross-validated error, and every group's outcome.

    Falls back to the target's global study where no group has a result. The rows come from files.
    """
    found = group_studies(rows, target, roles, preset, key, keys, store, s)
    searched = [g for g in found if g.state == "searched"]
    if searched:
        best = min(searched, key=lambda g: (g.value, str(g.group))).params
    else:
        best = run_study(rows, roles, preset, key, f"{target}_study", store, s, staged=True).best.params
    return best, [g if g.state == "searched" else replace(g, params=best) for g in found]


def linear_group_params(
    rows: DataFrame, target: str, roles, preset: Preset, key: str, keys: Sequence[str], store: TrialStore, s: SearchSettings
) -> tuple[dict[str, float], DataFrame] | None:
    """The same for presets of linear members, all groups in one job: (best parameters, every group's best stack).

    Every group tries the same draws, scaled by the statistics of all given
    rows, without pruning: all folds of all draws are one scan. Each group's
    best goes into the store as one trial of its own study. None if no group
    is large enough. The rows come from files, and no copy of them stays.
    """
    space = preset.space if s.space is None else s.space
    draws = [sample_params(space, i, s.seed, target) for i in range(s.n_trials)]
    pre = Preprocessor(roles).fit(rows)
    x = pre.columns
    found = tune_stacks_by_group(
        pre.transform(rows), x, "y", key, keys, [stack_of(preset, d, len(x)) for d in draws], min(s.n_trials, 10), s.folds, s.inner, s.seed + 1, s.min_group_rows, staged=True
    )
    table = stage_table(found, "best_by_group")
    name = F.concat_ws("_", F.lit(target), F.lit("group"), *[F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in keys])
    tried = F.array(*[F.create_map(*[F.lit(v) for kv in d.items() for v in (kv[0], float(kv[1]))]) for d in draws])
    trials = table.select(name.alias("study"), F.col("trial").cast("long"), F.lit(COMPLETE).alias("state"), F.col("mae").alias("value"), F.get(tried, F.col("trial")).alias("params"))
    store.append_trials(trials)
    best = table.orderBy("mae", *keys).select("trial").first()
    return (draws[best["trial"]], table) if best else None


def train(
    df: DataFrame,
    columns: Sequence[str],
    targets: Sequence[str],
    key: str,
    preset: Preset,
    store: TrialStore | None = None,
    params: Mapping[str, Mapping[str, float]] | None = None,
    grouped: Sequence[str] = (),
    group_keys: Sequence[str] = (),
    exclusions: Mapping[str, Sequence[str]] | None = None,
    log: Sequence[str] = (),
    exp: Sequence[str] = (),
    settings: SearchSettings | None = None,
) -> Training:
    """Models for all targets, from given ``params`` or from a search recorded in ``store``.

    Targets in ``grouped`` are searched per group of ``group_keys``; every final
    model is fitted on all training rows. Presets of linear members on numeric
    columns search all groups in one job; others run one study for each group
    from a bounded pool on the driver.
    """
    s = settings or SearchSettings()
    if params is None and store is None:
        raise ValueError("give params or a store for the search")
    kept = list(dict.fromkeys([key, *columns, *targets, *group_keys]))
    rows = df.select(*kept)
    if s.dedup:  # the smallest key stays, so that split and folds repeat
        rows = rows.groupBy(*[c for c in kept if c != key]).agg(F.min(key).alias(key)).select(*kept)
    # The one copy that stays: searches, fits and the report read these files.
    rows = stage_and_release(with_folds(with_split(rows, key, s.test, s.seed), key, s.folds, s.seed + 1), "train", ["dataset"])
    features = features_by_target(columns, targets, exclusions)
    groups: dict[str, list[GroupStudy]] = {}
    tables: dict[str, DataFrame] = {}
    if params is None:
        params = {}
        for target in targets:
            table = as_target(rows.where(F.col("dataset") == "train"), target)
            roles = column_roles(rows, features[target], log, exp)
            linear = s.group_job and is_linear(preset) and all(r != "cat" for r in roles.values())
            found = linear_group_params(table, target, roles, preset, key, group_keys, store, s) if target in grouped and linear else None
            if found:
                params[target], tables[target] = found
            elif target in grouped and not linear:
                params[target], groups[target] = best_params_by_group(table, target, roles, preset, key, group_keys, store, s)
            else:
                params[target] = run_study(table, roles, preset, key, f"{target}_study", store, s, staged=True).best.params
    models, report = fit_with_params(rows, features, params, preset, key, s.inner, log, exp, staged=True)
    meta = {t: TargetMeta(features[t], dtypes_of(rows, features[t]), dict(params[t])) for t in targets}
    return Training(Bundle({t: m.pipeline for t, m in models.items()}, meta), {t: dict(params[t]) for t in targets}, report, groups, tables)
