"""Queries that go through whole plans, and the small operators around them."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from foldline import fixtures as fx
from foldline.operators.roles import as_target, categorical_columns, column_roles, dtypes_of, numeric_columns
from foldline.operators.space import real
from foldline.plans.fixed import fit_with_params
from foldline.plans.single_model import search_single_models
from foldline.plans.training import SearchSettings, train
from foldline.registry.base import FEATURE_ROWS, query
from foldline.registry.data_queries import ROUNDED, SCORES, _rounded_scores, prepared, split_rows
from foldline.registry.model_queries import LINEAR, SUMS, ridge_sql
from foldline.registry.search_queries import INNER, K, ROLES, SPACE, STACK, fixed_sql, params_sql
from foldline.session import shared_dir
from foldline.sources.tables import read_table
from foldline.sources.trial_store import TrialStore

KINDS = [("Row_Key", "row_key", "string"), ("Qty", "qty", "double"), ("CHARGE", "charge", "double"), ("Disc", "disc", "double"), ("Suppkey", "suppkey", "bigint"),
         ("Flag", "flag", "string"), ("Brand_Gap", "brand_gap", "string")]


def _kinds_sql() -> str:
    role = {"charge": "log", "disc": "exp"}
    one = "select '{0}' as \"column\", '{2}' as dtype, '{3}' as kind, '{4}' as role, count({1}) as n_present from rows"
    parts = [one.format(a, b, c, "categorical" if c == "string" else "numeric", "cat" if c == "string" else role.get(b, "num")) for a, b, c in KINDS]
    return f"with {FEATURE_ROWS}, rows as (select *, split_part(row_key, '|', 3)::bigint as suppkey from feature_rows) " + " union all ".join(parts)


@query("column_kinds", _kinds_sql())
def q_column_kinds(spark, sf):
    """Types, numeric or categorical, role by name whatever its case, and values present, of columns in mixed case."""
    rows = fx.feature_rows(spark, sf).withColumn("suppkey", F.split("row_key", r"\|")[2].cast("bigint"))
    rows = rows.select(*[F.col(b).alias(a) for a, b, _ in KINDS])
    types, roles = dtypes_of(rows, rows.columns), column_roles(rows, log=fx.LOG, exp=fx.EXP)
    numeric, categorical = numeric_columns(rows), categorical_columns(rows)
    kind = {**dict.fromkeys(numeric, "numeric"), **dict.fromkeys(categorical, "categorical")}
    counts = rows.agg(*[F.count(c).alias(c) for c in rows.columns])
    entries = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.lit(kind[c]).alias("kind"), F.lit(roles[c]).alias("role"), F.col(c).alias("n_present")) for c in rows.columns]
    return counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


@query(
    "target_cast",
    f"""with {FEATURE_ROWS}
    select row_key, case when size::bigint % 7 <> 0 then size end as from_text, split_part(row_key, '|', 4)::double as from_int from feature_rows""",
)
def q_target_cast(spark, sf):
    """Targets given as text, some of it NaN, and as whole numbers, cast to doubles."""
    rows = fx.feature_rows(spark, sf)
    text = F.when(F.col("size").cast("bigint") % 7 == 0, F.lit("NaN")).otherwise(F.col("size").cast("string"))
    rows = rows.select("row_key", text.alias("t"), F.split("row_key", r"\|")[3].cast("int").alias("i"))
    return as_target(as_target(rows, "t", "from_text"), "i", "from_int").select("row_key", "from_text", "from_int")


@query(
    "missing_source",
    """select 'part' as source, 'read' as outcome, count(*) as n_rows from part
    union all select 'supplier', 'read', count(*) from supplier union all select 'absent', 'PATH_NOT_FOUND', 0""",
)
def q_missing_source(spark, sf):
    """What reading says of tables that are there and of one that is not, before any work starts."""
    found = []
    for name in ("part", "supplier", "absent"):
        try:
            table = read_table(spark, f"{sf}/{name}.parquet")
            found.append(table.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("source"), F.lit("read").alias("outcome"), "n_rows"))
        except AnalysisException as e:
            found.append(spark.createDataFrame([(name, e.getCondition(), 0)], "source string, outcome string, n_rows long"))
    return found[0].unionByName(found[1]).unionByName(found[2])


def _report_sql(target: str, params: str, y: str) -> str:
    return f"""select '{target}' as target, dataset, {ROUNDED} from (
      with {fixed_sql(params).replace("charge as y, retail", f"{y} as y, retail")} select dataset, count(*) as n, {SCORES} from final group by 1)"""


@query("default_stack", f"""with {fixed_sql("params as (select 0 as t, 1.0::double as a1, 2e4::double as a2, 1.0::double as am)")},
    s as (select dataset, count(*) as n, {SCORES} from final group by 1) select 'charge' as target, dataset, {ROUNDED} from s""")
def q_default_stack(spark, sf):
    """A stack with one parameter given: the other members take their documented defaults."""
    rows = prepared(spark, sf, *ROLES, "charge")
    _, report = fit_with_params(rows, {"charge": list(ROLES)}, {"charge": {"b_alpha": 2e4}}, STACK, "row_key", INNER, exp=["disc"])
    return report.select("target", "dataset", *_rounded_scores())


@query("train_grouped_targets", _report_sql("charge", params_sql("charge", 1), "charge") + " union all " + _report_sql("retail", params_sql("retail_study", 1), "retail"))
def q_train_grouped_targets(spark, sf):
    """The whole way from a table to scored models: one target searched by group, one globally, one trial each."""
    rows = split_rows(spark, sf).select("row_key", "flag", "status", *ROLES, "charge", "retail")  # train writes them
    store = TrialStore(spark, f"{shared_dir(spark)}/train-{uuid.uuid4().hex}")
    settings = SearchSettings(n_trials=1, folds=K, inner=INNER, space=SPACE, sampler="random")
    made = train(rows, list(ROLES), ["charge", "retail"], "row_key", STACK, store, grouped=["charge"], group_keys=["flag", "status"], exp=["disc"], settings=settings)
    return made.report.select("target", "dataset", *_rounded_scores())


ONE_ALPHA = [real("alpha", 0.5, 50.0, True)]


@query(
    "single_model_report",
    f"""with {LINEAR},
    p as (select exp(ln(0.5::double) + ('0x' || substr(md5('42|charge|0|alpha'), 1, 8))::bigint / 4294967296.0::double * (ln(50.0::double) - ln(0.5::double))) as alpha),
    g as (select alpha, {SUMS} from lin, p where dataset = 'train' group by 1),
    {ridge_sql('w', 'g', '')},
    s as (select count(*) as n, {SCORES} from (select y, b0 + b1 * x1 + b2 * x2 as p from lin, w where dataset = 'test'))
    select 'charge' as target, 'Ridge' as model, {ROUNDED}, 1 as n_trials, 2 as n_features, true as rounded from s""",
)
def q_single_model_report(spark, sf):
    """The score row of a searched single model: test metrics, trials, features, and seconds to three places."""
    rows = prepared(spark, sf, *ROLES, "charge").drop("dataset", "fold").withColumn("flat", F.lit(1.0))
    _, scores = search_single_models(rows, list(ROLES), ["charge", "flat"], "row_key", "Ridge", ONE_ALPHA, n_trials=1, folds=K, exp=["disc"])
    rounded = (F.col("fit_sec") > 0) & (F.abs(F.col("fit_sec") * 1000 - F.round(F.col("fit_sec") * 1000)) < 1e-6)
    return scores.select("target", "model", *_rounded_scores(), "n_trials", "n_features", rounded.alias("rounded"))
