"""The driver's tables as a retention problem: customers who order, and lapse.

A customer starts with the first order. The last one, if before LAPSE, is the end.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import panel as panels
from ..plans.spec import Column, Filter, Group, Spec, merged, DEFAULTS, Log
from ..plans.timeline import Timeline

LAPSE = dt.date(2000, 8, 1)
START = dt.date(1995, 1, 1)
EXPORT = dt.date(2001, 8, 1)
DATES = [dt.date(y, m, 1) for y in (1998, 1999) for m in (1, 4, 7, 10)] + [dt.date(2000, 1, 1)]
HORIZON, EMBARGO = 180, 7

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spec(**over) -> Spec:
    options = merged(DEFAULTS, {"panel": {"horizon_days": HORIZON, "embargo_days": EMBARGO}})
    base = {"entity_path": "customer", "id_column": "id", "start_column": "start_date", "event_column": "end_date", "observation_start": START, "observation_end": LAPSE, "data_export": EXPORT, "options": options, "logs": {"orders": Log("orders", "orders", "o_custkey", "o_orderdate")}}
    return Spec(**(base | over))


def timeline(**over) -> Timeline:
    return Timeline(**({"observation_start": START, "observation_end": LAPSE, "data_export": EXPORT, "feature_start": START} | over))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date")).withColumnRenamed("o_custkey", "id")


def entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, start_date, last_date, end_date, segment, balance, nation."""
    o = orders(spark, sf_dir).groupBy("id").agg(F.min("o_orderdate").alias("start_date"), F.max("o_orderdate").alias("last_date"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    return o.join(c, "id").withColumn("end_date", F.when(F.col("last_date") < F.lit(LAPSE), F.col("last_date")))


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel over DATES."""
    return panels.at_risk(panels.base(entity(spark, sf_dir), spec(), timeline()), DATES, HORIZON, EMBARGO)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with recency (days since the last order before the window's end), balance, segment, nation and a score made of recency."""
    g = Group("orders", "time_varying", "orders", (), (730,), unfiltered=True)
    from ..operators import features

    out, _ = features.from_events(frame(spark, sf_dir), orders(spark, sf_dir), g, "o_orderdate", "id", DATES, EMBARGO, [], "o_orderkey")
    e = entity(spark, sf_dir).select(F.col("id").alias("entity_id"), "segment", "balance", "nation")
    recency = F.col("orders__recency_days_730d")
    return out.join(e, "entity_id").select("entity_id", "snapshot_date", "label", recency.alias("recency"), F.col("orders__event_count_730d").alias("orders"), "balance", "segment", "nation", F.least(F.coalesce(recency, F.lit(999.0)) / 1000, F.lit(0.999)).alias("score"))


def lifetimes(spark: SparkSession, sf_dir: str, s: Spec | None = None, t: Timeline | None = None) -> DataFrame:
    e = entity(spark, sf_dir)
    return panels.survival(e, s or spec(), t or timeline(), ("segment", "balance", "nation"))


# SQL of the same.
ENT = """ent as (
  select c_custkey as id, min(cast(o_orderdate as date)) as start_date, max(cast(o_orderdate as date)) as last_date,
    case when max(o_orderdate) < date '2000-08-01' then max(cast(o_orderdate as date)) end as end_date,
    any_value(c_mktsegment) as segment, any_value(c_acctbal) as balance, any_value(c_nationkey) as nation
  from customer join orders on o_custkey = c_custkey group by c_custkey)"""
DAYS = "dates as (select unnest([" + ", ".join(f"date '{d}'" for d in DATES) + "]) as t)"
PANEL = """panel as (
  select id as entity_id, t as snapshot_date, start_date, start_date < date '1995-01-01' as left_truncated,
    cast(end_date is not null and end_date <= t + 180 as int) as label, date_diff('day', start_date, t) as tenure_days, t - 7 as feature_end
  from ent, dates where start_date <= t and (end_date is null or end_date > t))"""
WITH = f"with {ENT},\n{DAYS},\n{PANEL}"
ORD = "ord as (select *, cast(o_orderdate as date) as d from orders)"
SCORED = f"""{WITH}, {ORD},
rec as (
  select p.entity_id, p.snapshot_date, p.label, cast(date_diff('day', max(o.d), any_value(p.feature_end)) as double) as recency, nullif(count(o.d), 0)::double as orders
  from panel p left join ord o on o.o_custkey = p.entity_id and o.d < p.feature_end and o.d >= p.feature_end - 730
  group by 1, 2, 3),
scored as (
  select rec.*, balance, segment, nation, least(coalesce(recency, 999.0) / 1000, 0.999) as score from rec join ent on id = entity_id)"""
LIFE = f"""with {ENT},
life as (
  select id as entity_id, cast(end_date is not null and end_date <= date '2000-08-01' as int) as event, start_date,
    date_diff('day', start_date, case when end_date <= date '2000-08-01' then end_date else date '2000-08-01' end) as duration_days, 0 as entry_days, segment, balance, nation
  from ent where start_date >= date '1995-01-01'),
alive as (select * from life where duration_days > entry_days)"""
