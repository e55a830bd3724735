"""Sources, timeline, calendar, panel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..plans import panel as panels
from ..plans import timeline as time
from ..plans.spec import merged
from ..sources import readers
from . import base
from .base import DAYS, ENT, PANEL, WITH, Query

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def entry(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


@entry("""select year(d) as y, count(*) as n, sum(case when bad then 1 else 0 end)::bigint as n_failed from (
  select case when o_orderkey % 5 = 0 then null else cast(o_orderdate as date) end as d, o_orderkey % 5 = 0 as bad from orders) group by 1""")
def scan_coerce_dates(spark, sf):
    mixed = F.when(F.col("o_orderkey") % 5 == 0, F.lit("soon")).otherwise(F.col("o_orderdate").cast("date").cast("string"))
    o = base.table(spark, sf, "orders").select(mixed.alias("raw"))
    o = o.withColumn("d", readers.as_day("raw"))
    return o.groupBy(F.year("d").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"), readers.unread(F.col("raw"), F.col("d")).alias("n_failed"))


@entry(f"with {ENT} select id, start_date, last_date, end_date, segment, balance, nation from ent")
def entity_build(spark, sf):
    return base.entity(spark, sf)


@entry("select l_orderkey, count(*) as n from lineitem group by 1 having count(*) > 1")
def duplicate_ids(spark, sf):
    return readers.duplicates(base.table(spark, sf, "lineitem"), "l_orderkey")


@entry("select event_type, count(*) as n from events where user_id not in (select c_custkey from customer) group by 1")
def orphan_events(spark, sf):
    people = base.table(spark, sf, "customer").withColumnRenamed("c_custkey", "user_id")
    return readers.orphans(base.table(spark, sf, "events"), people, "user_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@entry(f"""with {ENT} select 'entity' as "table", min(start_date) as first, greatest(max(start_date), max(end_date)) as last from ent
union all select 'orders', min(cast(o_orderdate as date)), max(cast(o_orderdate as date)) from orders""")
def timeline_bounds(spark, sf):
    return time.bounds(base.entity(spark, sf), {"orders": base.orders(spark, sf)}, base.spec())


def _calendar(**over):
    s = base.spec(options=merged(base.spec().options, {"panel": over}))
    return time.calendar(s, base.timeline())


@entry("""select cast(d as date) as snapshot_date from generate_series(timestamp '1995-01-08', timestamp '2000-02-03', interval 1 day) as g(d)
where day(d) = 1""")
def snapshot_calendar(spark, sf):
    return spark.createDataFrame([(d,) for d in _calendar().dates], "snapshot_date date")


@entry("""select date '1995-01-01' as snapshot_date, 'feature window opens before the history' as reason
union all select date '2000-06-01', 'label window closes after the observation end'""")
def snapshot_rejections(spark, sf):
    found = _calendar(snapshot_mode="single", snapshot_dates=["1995-01-01", "1998-01-01", "2000-06-01"])
    return spark.createDataFrame(found.rejected, "snapshot_date date, reason string")


@entry(f"{WITH} select entity_id, snapshot_date, start_date, tenure_days, feature_end from panel")
def panel_at_risk(spark, sf):
    return base.frame(spark, sf).select("entity_id", "snapshot_date", "start_date", F.col("tenure_days").cast("long").alias("tenure_days"), "feature_end")


@entry(f"{WITH} select entity_id, snapshot_date, cast(label as bigint) as label from panel")
def panel_labels(spark, sf):
    return base.frame(spark, sf).select("entity_id", "snapshot_date", F.col("label").cast("long").alias("label"))


@entry(f"""with {ENT}, moved as (select * replace (end_date - 60 as end_date) from ent),
{DAYS}, {PANEL.replace("from ent, dates", "from moved, dates")} select entity_id, snapshot_date, cast(label as bigint) as label from panel""")
def panel_decision_lead(spark, sf):
    people = panels.base(base.entity(spark, sf), base.spec(decision_lead_days=60), base.timeline())
    return panels.at_risk(people, base.DATES, base.HORIZON, base.EMBARGO).select("entity_id", "snapshot_date", F.col("label").cast("long").alias("label"))


@entry(f"{WITH} select snapshot_date, count(*) as n_at_risk, sum(label)::bigint as n_churned, round(avg(label), 6) as churn_rate from panel group by 1")
def panel_by_snapshot(spark, sf):
    return panels.by_date(base.frame(spark, sf)).select("snapshot_date", "n_at_risk", "n_churned", F.round("churn_rate", 6).alias("churn_rate"))


@entry(f"""with {ENT} select id as entity_id, start_date, start_date < date '1996-01-01' as left_truncated from ent""")
def panel_left_truncation(spark, sf):
    t = base.timeline(observation_start=dt.date(1996, 1, 1))
    return panels.base(base.entity(spark, sf), base.spec(left_truncation="keep_flagged"), t).select("entity_id", "start_date", "left_truncated")


@entry(f"with {ENT} select id as entity_id, start_date from ent where start_date >= date '1996-01-01'")
def panel_left_truncation_drop(spark, sf):
    t = base.timeline(observation_start=dt.date(1996, 1, 1))
    return panels.base(base.entity(spark, sf), base.spec(), t).select("entity_id", "start_date")


@entry(f"""with {ENT} select id as entity_id, date '2000-08-01' as snapshot_date, cast(coalesce(segment = 'BUILDING', false) as bigint) as label,
  date_diff('day', start_date, date '2000-08-01') as tenure_days from ent where start_date >= date '1995-01-01'""")
def panel_label_mode(spark, sf):
    s = base.spec(target_mode="label", label_column="segment", churn_value="BUILDING", event_column=None)
    e = base.entity(spark, sf)
    out = panels.labelled(panels.base(e, s, base.timeline()), e, s, base.timeline(), base.EMBARGO)
    return out.select("entity_id", "snapshot_date", F.col("label").cast("long").alias("label"), F.col("tenure_days").cast("long").alias("tenure_days"))


@entry(f"{WITH} select snapshot_date, count(*) as n from panel where start_date <= snapshot_date - 900 group by 1")
def panel_min_tenure(spark, sf):
    people = panels.base(base.entity(spark, sf), base.spec(), base.timeline())
    return panels.at_risk(people, base.DATES, base.HORIZON, base.EMBARGO, 900).groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n"))


@entry(f"{WITH} select entity_id, least(count(*), 3) as n from panel group by 1")
def panel_snapshot_cap(spark, sf):
    return panels.capped(base.frame(spark, sf), 3, 42).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@entry(f"{WITH} select count(*) as rows, count(distinct entity_id) as entities, sum(label)::bigint as events, round(avg(label), 6) as rate from panel")
def panel_summary(spark, sf):
    about = panels.summary(panels.Panel(base.frame(spark, sf), base.DATES, base.timeline(), base.HORIZON, base.EMBARGO))
    return spark.createDataFrame([(about["rows"], about["entities"], about["events"], round(about["rate"], 6))], "rows long, entities long, events long, rate double")


@entry(f"with {ENT} select id as entity_id, date_diff('day', start_date, coalesce(end_date, date '2000-08-01')) as duration_days, cast(end_date is not null as bigint) as event, cast(greatest(0, date_diff('day', start_date, date '1996-01-01')) as bigint) as entry_days from ent where date_diff('day', start_date, coalesce(end_date, date '2000-08-01')) > greatest(0, date_diff('day', start_date, date '1996-01-01'))")
def survival_frame(spark, sf):
    t = base.timeline(observation_start=dt.date(1996, 1, 1))
    out = base.lifetimes(spark, sf, base.spec(left_truncation="keep_flagged"), t)
    return out.select("entity_id", F.col("duration_days").cast("long").alias("duration_days"), F.col("event").cast("long").alias("event"), F.col("entry_days").cast("long").alias("entry_days"))
