"""Collects queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rnd(expr: str, places: int) -> str:
    return f"floor(({expr}) * 1e{places} + 0.5) / 1e{places}"


def hash_sql(seed: int, key: str = "row_key") -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {key})), 1, 8))::bigint"


FEATURE_ROWS = """feature_rows as (
  select concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, epoch_us(l_shipdate)) as row_key,
         l_returnflag as flag, l_linestatus as status, p_brand as brand, p_type as ptype,
         case when l_linenumber = 3 and l_suppkey % 5 = 0 then null else l_quantity end as qty,
         l_extendedprice as price, l_discount as disc, l_tax as tax, cast(p_size as double) as size,
         case when p_size % 17 = 0 then null else p_brand end as brand_gap,
         p_retailprice as retail, cast(1.0 as double) as const1,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge,
         l_extendedprice / l_quantity as unit_price
  from lineitem join part on l_partkey = p_partkey)"""

SPLIT_ROWS = f"""{FEATURE_ROWS},
split_rows as (
  select *, case when {hash_sql(42)} < 858993459 then 'test' else 'train' end as dataset,
         cast({hash_sql(43)} % 5 as integer) as fold
  from feature_rows)"""

TRIALS = """trials as (
  select 'study_' || user_id as study,
         row_number() over (partition by user_id order by ts, event_id) - 1 as trial,
         case event_type when 'signup' then 'PRUNED' when 'error' then 'FAIL' else 'COMPLETE' end as state,
         case when event_type in ('signup', 'error') then null else value end as value,
         cast(json_extract_string(props, '$.k') as double) as p_k,
         cast(event_id % 7 as double) as p_m,
         'target_' || (user_id % 3) as target,
         cast(user_id % 6 + 1 as integer) as preset,
         value as raw_value, event_id, user_id
  from events)"""

STEPS = f"""{TRIALS},
trial_steps as (
  select study, trial, step, raw_value * (1 + 0.05::double * ((event_id + step * 3) % 7)) as step_value
  from trials, (select unnest([1, 2, 3, 4, 5]) as step))"""

STUDIES = """studies as (
  select distinct study, case when user_id % 4 = 0 then 60 end as goal_n_trials from trials)"""
