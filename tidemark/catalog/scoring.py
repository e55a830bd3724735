"""Scans, splits, folds, metrics of a score, effects and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, drivers, metrics, splits
from ..operators.features import Meta
from . import base
from .base import DAYS, ENT, PANEL, SCORED, WITH, Query

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
NUMERIC, OTHER = ["recency", "orders", "balance"], ["segment", "nation"]
TIE = ["entity_id", "snapshot_date"]


def _entry(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _round(df, *names: str, digits: int = 6):
    return df.withColumns({n: F.round(n, digits) for n in names})


_LONG = "long as (" + " union all ".join(f"select '{n}' as feature, cast({n} as double) as value, label from scored" for n in NUMERIC) + ")"
_SCAN = f"""{SCORED}, {_LONG},
counts as (select feature, value, sum(label) as pos, sum(1 - label) as neg, count(*) as c from long group by 1, 2),
ranked as (select feature, pos, neg, coalesce(sum(neg) over (partition by feature order by value rows between unbounded preceding and 1 preceding), 0) as below from counts where value is not null),
areas as (select feature, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) as area from ranked group by 1),
tot as (select feature, sum(c) as n, sum(case when value is not null then c end) as there, sum(case when value is null then pos else 0 end) as np, sum(case when value is null then neg else 0 end) as nn,
  sum(pos) as ap, sum(neg) as an, count(value) as n_unique, sum(case when value <> round(value) then c else 0 end) as fr from counts group by 1)"""

_entry(
    "scan_numeric_auc",
    lambda spark, sf: _round(metrics.numeric_scan(base.scored(spark, sf), NUMERIC, "label").select("feature", "auc", "n"), "auc"),
    f"{_SCAN} select feature, round(greatest(area, 1 - area), 6) as auc, cast(n as bigint) as n from tot join areas using (feature)",
)
_entry(
    "scan_missingness_auc",
    lambda spark, sf: _round(metrics.numeric_scan(base.scored(spark, sf), NUMERIC, "label").select("feature", "auc_missing", "null_share"), "auc_missing", "null_share"),
    f"{_SCAN} select feature, case when np + nn > 0 and (np + nn) / n <= 0.999 then round(0.5 + 0.5 * abs(np / ap - nn / an), 6) end as auc_missing, round(1 - there / n, 6) as null_share from tot",
)
_entry(
    "scan_cardinality",
    lambda spark, sf: _round(metrics.numeric_scan(base.scored(spark, sf), NUMERIC, "label").select("feature", "n_unique", "cardinality_ratio"), "cardinality_ratio"),
    f"{_SCAN} select feature, cast(n_unique as bigint) as n_unique, round(case when fr > 0.01 * there then 0.0 else n_unique / there end, 6) as cardinality_ratio from tot",
)
_CAT = "lc as (" + " union all ".join(f"select '{n}' as feature, cast({n} as varchar) as value, label, entity_id % 5 as fold from scored" for n in OTHER) + ")"
_entry(
    "scan_categorical_auc",
    lambda spark, sf: _round(metrics.categorical_scan(base.scored(spark, sf), OTHER, "label", (F.col("entity_id") % 5).cast("int")).select("feature", "auc", "n_unique"), "auc"),
    f"""{SCORED}, {_CAT},
cells as (select feature, value, fold, sum(label) as pos, count(*) as c from lc where value is not null group by 1, 2, 3),
outs as (select *, sum(pos) over (partition by feature, value) - pos as op, sum(c) over (partition by feature, value) - c as oc, sum(pos) over (partition by feature) - sum(pos) over (partition by feature, fold) as rp, sum(c) over (partition by feature) - sum(c) over (partition by feature, fold) as rc from cells),
sc as (select feature, coalesce(op / nullif(oc, 0), rp / rc) as s, sum(pos) as pos, sum(c - pos) as neg from outs group by 1, 2),
r as (select *, coalesce(sum(neg) over (partition by feature order by s rows between unbounded preceding and 1 preceding), 0) as below from sc),
a as (select feature, sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) as area from r group by 1),
u as (select feature, count(distinct value) as n_unique from cells group by 1)
select feature, round(greatest(area, 1 - area), 6) as auc, n_unique from a join u using (feature)""",
)


def audit_findings(spark, sf):
    """Findings of the statistical screens with planted columns: a leak, a constant, an identifier, a telling gap."""
    rows = base.scored(spark, sf).withColumns({"leak": F.col("label") * 0.98 + 0.01, "one": F.lit(1.0), "ident": F.pmod(F.xxhash64("entity_id", "snapshot_date"), F.lit(1_000_000_007)).cast("double"), "gap": F.when(F.col("label") == 0, 1.0)})
    names = [*NUMERIC, "leak", "one", "ident", "gap"]
    meta = {n: Meta(n, "g", "entity", "numeric", "static", None, "normal", "", True) for n in names}
    report = audit.Report()
    audit.statistics(base.spec(), rows, meta, report)
    planted = {"leak", "one", "ident", "gap"}
    listed = [(f.level, f.code, c) for f in report.ordered() for c in f.columns if c in planted]
    return spark.createDataFrame(listed, "level string, code string, feature string")


_entry("audit_findings", audit_findings, """select * from (values ('BLOCK', 'SINGLE_FEATURE_SEPARATION', 'leak'), ('INFO', 'CONSTANT_FEATURE', 'one'), ('WARN', 'IDENTIFIER_LIKE_FEATURE', 'ident'), ('WARN', 'MISSINGNESS_PREDICTS_TARGET', 'gap')) as t(level, code, feature)""")

_CUT = base.DATES[len(base.DATES) - splits.test_dates(base.DATES, 0.25)]


def _split(purge: int):
    def query(spark, sf):
        s = splits.out_of_time(base.frame(spark, sf), base.DATES, 0.25, base.HORIZON, purge)
        return s.frame.groupBy("snapshot_date", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("events"))

    return query


for _name, _purge in (("split_out_of_time", 0), ("split_purge", 240)):
    _entry(_name, _split(_purge), f"""{WITH} select snapshot_date, case when snapshot_date >= date '{_CUT}' then 'test' when snapshot_date < date '{_CUT}' - {_purge} and snapshot_date <= date '{_CUT}' - 180 then 'train' else 'purged' end as split,
  count(*) as n, cast(sum(label) as bigint) as events from panel group by 1, 2""")

_FOLDS = f"""{WITH}, people as (select entity_id, max(label) as ever from panel group by 1),
folds as (select entity_id, (row_number() over (partition by ever order by entity_id) - 1) % {{}} as fold from people)"""
_entry("cv_fold_assignment", lambda spark, sf: splits.entity_folds(base.frame(spark, sf), 4, key=F.col("entity_id")).select("entity_id", F.col("fold").cast("long").alias("fold")), _FOLDS.format(4) + " select entity_id, fold from folds")


def split_grouped(spark, sf):
    """Entities on one side only, and both sides with events."""
    s = splits.grouped_random(base.frame(spark, sf), 0.25)
    per = s.frame.groupBy("entity_id").agg(F.count_distinct("split").alias("sides"))
    return per.agg(F.max("sides").alias("most_sides"), F.count(F.lit(1)).alias("entities")).join(s.frame.filter("label = 1").agg(F.count_distinct("split").alias("sides_with_events")))


_entry("split_grouped", split_grouped, f"{WITH} select 1::bigint as most_sides, count(distinct entity_id) as entities, 2::bigint as sides_with_events from panel")
_entry(
    "entity_span",
    lambda spark, sf: splits.spanning(splits.out_of_time(base.frame(spark, sf), base.DATES, 0.25, base.HORIZON).frame),
    f"""{WITH}, k as (select entity_id, bool_or(snapshot_date >= date '{_CUT}') as t, bool_or(snapshot_date <= date '{_CUT}' - 180) as r from panel group by 1)
select count(*) filter (t) as n_test, count(*) filter (t and r) as n_both from k""",
)

_entry(
    "metrics_auc_ap",
    lambda spark, sf: _round(metrics.auc(base.scored(spark, sf), "score", "label").select("area", "n_values").join(metrics.average_precision(base.scored(spark, sf), "score", "label")), "area", "ap"),
    f"""{SCORED}, g as (select score, sum(label) as pos, count(*) as c from scored group by 1),
a as (select pos, c, coalesce(sum(c - pos) over (order by score rows between unbounded preceding and 1 preceding), 0) as below, sum(pos) over (order by score desc rows unbounded preceding) as tp, sum(c) over (order by score desc rows unbounded preceding) as k from g)
select round(sum(pos * (below + (c - pos) / 2.0)) / (sum(pos) * sum(c - pos)), 6) as area, count(*) as n_values, round(sum(tp / k * pos) / sum(pos), 6) as ap from a""",
)
_entry(
    "metrics_brier_logloss",
    lambda spark, sf: _round(metrics.headline(base.scored(spark, sf), "score", "label"), "base_rate", "brier", "log_loss"),
    f"""{SCORED} select count(*) as n, round(avg(label), 6) as base_rate, round(avg((score - label) ** 2), 6) as brier,
  round(-avg(case when label = 1 then ln(greatest(least(score, 1 - 1e-6), 1e-6)) else ln(1 - greatest(least(score, 1 - 1e-6), 1e-6)) end), 6) as log_loss from scored""",
)
_entry(
    "metrics_topk_lift",
    lambda spark, sf: _round(metrics.capture(base.scored(spark, sf), "score", "label", TIE), "capture", "lift").withColumn("share", F.col("share").cast("long")),
    f"""{SCORED}, r as (select label, row_number() over (order by score desc, entity_id, snapshot_date) as i, count(*) over () as n, sum(label) over () as e from scored),
s as (select unnest([5, 10, 20]) as share)
select cast(share as bigint) as share, cast(max(greatest(1, n * share // 100)) as bigint) as k, round(sum(label) / max(e), 6) as capture, round(avg(label) / max(e / n), 6) as lift from r, s where i <= greatest(1, n * share // 100) group by 1""",
)
_entry(
    "calibration_bins",
    lambda spark, sf: _round(metrics.calibration(base.scored(spark, sf), "score", "label"), "mean_predicted", "observed").withColumn("bin", F.col("bin").cast("long")),
    f"""{SCORED}, q as (select list_sort(list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e from scored)
select cast(len(list_filter(e[2:len(e) - 1], lambda c: score >= c)) as bigint) as bin, count(*) as n, round(avg(score), 6) as mean_predicted, round(avg(label), 6) as observed from scored, q where len(e) >= 3 group by 1""",
)
_entry(
    "lift_deciles",
    lambda spark, sf: _round(metrics.lift_deciles(base.scored(spark, sf), "score", "label", TIE), "rate").withColumn("decile", F.col("decile").cast("long")),
    f"""{SCORED}, r as (select label, row_number() over (order by score desc, entity_id, snapshot_date) - 1 as i, count(*) over () as n from scored)
select cast(i * 10 // n as bigint) as decile, count(*) as n, round(avg(label), 6) as rate from r group by 1""",
)
_META = {n: Meta(n, "g", "entity", "numeric" if n in NUMERIC else "categorical", "static", None, "normal", "", True) for n in (*NUMERIC, *OTHER)}
_entry(
    "driver_direction",
    lambda spark, sf: drivers.direction(base.scored(spark, sf), _META),
    f"{_SCAN} select feature, case when area > 0.5 then 'raises risk' when area < 0.5 then 'lowers risk' else 'none' end as direction from areas",
)
_entry(
    "driver_spread",
    lambda spark, sf: _round(drivers.effects(base.scored(spark, sf), _META), "low_rate", "high_rate", "spread"),
    f"""{SCORED}, {_LONG}, q as (select feature, quantile_cont(value, 0.2) as a, quantile_cont(value, 0.8) as b from long where value is not null group by 1),
num as (select feature, avg(label) filter (value <= a) as low_rate, avg(label) filter (value >= b) as high_rate from long join q using (feature) where value is not null group by 1),
{_CAT}, lv as (select feature, value, count(*) as n, avg(label) as rate from lc where value is not null group by 1, 2),
cat as (select feature, min(rate) as low_rate, max(rate) as high_rate from (select *, sum(n) over (partition by feature) as t from lv) where n >= greatest(20, 0.01 * t) group by 1)
select feature, round(low_rate, 6) as low_rate, round(high_rate, 6) as high_rate, round(high_rate - low_rate, 6) as spread from (from num union all from cat)""",
)
_entry(
    "driver_profile",
    lambda spark, sf: _round(drivers.profiles(base.scored(spark, sf), _META, ["balance", "segment"]), "rate"),
    f"""{SCORED}, q as (select list_sort(list_distinct(quantile_cont(balance, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e from scored)
select 'balance' as feature, cast(len(list_filter(e[2:len(e) - 1], lambda c: balance > c)) as varchar) as bucket, count(*) as n, round(avg(label), 6) as rate from scored, q where balance is not null group by 2
union all select 'segment', segment, count(*), round(avg(label), 6) from scored where segment is not null group by 2 having count(*) >= 20""",
)
