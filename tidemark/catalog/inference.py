"""Survival, experiments, causal estimates, models."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import causal, drivers, experiment, metrics, modeling, shap, splits, survival
from ..operators.features import Meta
from ..plans import panel as panels
from . import base
from .base import ENT, LIFE, SCORED, Query

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _entry(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _curve(df, *by):
    return df.select(*by, F.col("t").cast("long").alias("t"), F.col("events").cast("long").alias("events"), F.col("n_at_risk").cast("long").alias("n_at_risk"), *[F.round(c, 6).alias(c) for c in ("survival", "se", "ci_low", "ci_high")])


def _km_rows(source: str, by: str = "") -> str:
    """Table expressions up to km: t, events, n, s (survival), v (Greenwood's sum)."""
    part, on = (f"partition by {by} ", f"{by}, ") if by else ("", "")
    match = f"and i.{by} = d.{by}" if by else ""
    return f"""risk as (select {'d.' + by + ', ' if by else ''}d.t, any_value(d.events) as events, count(*) as n from (select {on}duration_days as t, sum(event) as events from {source} group by all having sum(event) > 0) d
  join {source} i on i.duration_days >= d.t and i.entry_days < d.t {match} group by all),
km as (select {on}t, events, n, exp(sum(case when n > events then ln(1 - events / n) else -1e300 end) over w) as s, sum(events / (n * greatest(n - events, 1))) over w as v from risk window w as ({part}order by t rows unbounded preceding))"""


def _km(source: str, by: str = "") -> str:
    on = f"{by}, " if by else ""
    return f"""{_km_rows(source, by)}
select {on}cast(t as bigint) as t, cast(events as bigint) as events, n as n_at_risk, round(s, 6) as survival, round(s * sqrt(v), 6) as se, round(greatest(0, s - 1.96 * s * sqrt(v)), 6) as ci_low, round(least(1, s + 1.96 * s * sqrt(v)), 6) as ci_high from km"""


_entry("km_overall", lambda spark, sf: _curve(survival.kaplan_meier(base.lifetimes(spark, sf))), f"{LIFE}, {_km('alive')}")
_LATE = f"""with {ENT}, alive as (select * from (select id as entity_id, cast(end_date is not null as int) as event, date_diff('day', start_date, coalesce(end_date, date '2000-08-01')) as duration_days,
  greatest(0, date_diff('day', start_date, date '1996-01-01')) as entry_days, segment from ent) where duration_days > entry_days)"""


def km_left_truncated(spark, sf):
    t = base.timeline(observation_start=dt.date(1996, 1, 1))
    return _curve(survival.kaplan_meier(base.lifetimes(spark, sf, base.spec(left_truncation="keep_flagged"), t)))


_entry("km_left_truncated", km_left_truncated, f"{_LATE}, {_km('alive')}")
_entry("km_strata", lambda spark, sf: _curve(survival.stratified(base.lifetimes(spark, sf), "segment"), "segment"), f"{LIFE}, {_km('alive', 'segment')}")
_entry(
    "km_median",
    lambda spark, sf: survival.median_lifetime(survival.kaplan_meier(base.lifetimes(spark, sf))).select(F.col("median_days").cast("long").alias("median_days")),
    f"{LIFE}, {_km_rows('alive')} select cast(min(t) filter (s <= 0.5) as bigint) as median_days from km",
)
_entry("large_strata", lambda spark, sf: survival.large_strata(base.lifetimes(spark, sf), "nation", 30, 8).select("nation", "n"), f"{LIFE} select nation, count(*) as n from alive group by 1 having count(*) >= 30 order by n desc, nation limit 8")


def logrank(spark, sf):
    rows = base.lifetimes(spark, sf).withColumn("arm", F.when(F.col("segment").isin("BUILDING", "MACHINERY"), "a").otherwise("b"))
    found = survival.logrank(rows, "arm")
    return spark.createDataFrame([(round(found.statistic, 6), found.df)], "statistic double, df long")


_entry("logrank", logrank, f"""{LIFE}, g as (select *, case when segment in ('BUILDING', 'MACHINERY') then 1 else 0 end as a from alive),
ev as (select duration_days as t, sum(event) as d, sum(event * a) as da from g group by 1 having sum(event) > 0),
r as (select ev.t, any_value(d) as d, any_value(da) as da, count(*) as n, sum(a) as na from ev join g on g.duration_days >= ev.t group by ev.t)
select round(power(sum(da - d * na / n), 2) / sum(case when n > 1 then d * (na / n) * (1 - na / n) * (n - d) / (n - 1) else 0 end), 6) as statistic, 1::bigint as df from r""")

_ARM = "case id % 3 when 0 then 'control' when 1 then 'a' else 'b' end"


def _entity(spark, sf):
    k = F.col("id") % 3
    return base.entity(spark, sf).withColumn("arm", F.when(k == 0, "control").when(k == 1, "a").otherwise("b"))


def _cohort(spark, sf, **window):
    return experiment.cohort(_entity(spark, sf), "arm", "start_date", "end_date", base.LAPSE, 700, **window).filter("complete")


_SNAP = f"""with {ENT}, coh as (select *, {_ARM} as variant, cast(end_date is not null and end_date > date '1998-06-01' and end_date <= date '1998-06-01' + 700 as int) as churned from ent
  where start_date <= date '1998-06-01' and (end_date is null or end_date > date '1998-06-01') and date '1998-06-01' + 700 <= date '2000-08-01')"""
_AT = {"assigned": dt.date(1998, 6, 1)}


def experiment_itt(spark, sf):
    by = {r["variant"]: r.asDict() for r in experiment.arms(_cohort(spark, sf, **_AT)).collect()}
    rows = []
    for v in sorted(set(by) - {"control"}):
        found = experiment.lift(by["control"], by[v])
        rows.append((v, by[v]["n"], by[v]["churned"], round(by[v]["rate"], 6), round(found["lift_pp"], 5), round(found["ci_low_pp"], 5), round(found["ci_high_pp"], 5)))
    return spark.createDataFrame(rows, "variant string, n long, churned long, rate double, lift_pp double, ci_low_pp double, ci_high_pp double")


_entry("experiment_itt", experiment_itt, f"""{_SNAP}, a as (select variant, count(*) as n, sum(churned) as churned, avg(churned) as rate from coh group by 1),
x as (select a.*, a.rate - c.rate as g, sqrt(a.rate * (1 - a.rate) / a.n + c.rate * (1 - c.rate) / c.n) as se from a, (select * from a where variant = 'control') c where a.variant <> 'control')
select variant, n, cast(churned as bigint) as churned, round(rate, 6) as rate, round(100 * g, 5) as lift_pp, round(100 * (g - 1.96 * se), 5) as ci_low_pp, round(100 * (g + 1.96 * se), 5) as ci_high_pp from x""")


def experiment_rolling(spark, sf):
    rows = _cohort(spark, sf, opens=dt.date(1995, 1, 15), closes=dt.date(1996, 6, 30))
    return experiment.arms(rows).select("variant", "n", "churned", F.round("rate", 6).alias("rate"))


_entry("experiment_rolling", experiment_rolling, f"""with {ENT} select {_ARM} as variant, count(*) as n, cast(sum(cast(end_date is not null and end_date > start_date and end_date <= start_date + 700 as int)) as bigint) as churned,
  round(avg(cast(end_date is not null and end_date > start_date and end_date <= start_date + 700 as int)), 6) as rate from ent where start_date between date '1995-01-15' and date '1996-06-30' and start_date + 700 <= date '2000-08-01' group by 1""")


def experiment_srm(spark, sf):
    found = experiment.sample_ratio([r.asDict() for r in experiment.arms(_cohort(spark, sf, **_AT)).collect()])
    return spark.createDataFrame([(round(found["statistic"], 6), found["passed"])], "statistic double, passed boolean")


_entry("experiment_srm", experiment_srm, f"""{_SNAP}, a as (select count(*) as n from coh group by variant) select round(sum(power(n - t / 3, 2) / (t / 3)), 6) as statistic, sum(power(n - t / 3, 2) / (t / 3)) < 13.815511 as passed from a, (select sum(n) as t from a)""")


def experiment_balance(spark, sf):
    found = experiment.balance(_cohort(spark, sf, **_AT), ["balance", "segment"])
    return spark.createDataFrame([(c["check"], round(c["statistic"], 5)) for c in found], "check string, statistic double")


_entry("experiment_balance", experiment_balance, f"""{_SNAP}, p as (select variant, count(*) as n, avg(balance) as m, var_pop(balance) as v from coh group by 1),
t as (select sum(n) as n, count(*) as k, sum(n * m) / sum(n) as m from p),
c as (select variant, segment, count(*) as o from coh group by 1, 2), e as (select r.variant, s.segment, r.n * s.n / t.n as e from (select variant, sum(o) as n from c group by 1) r, (select segment, sum(o) as n from c group by 1) s, (select sum(o) as n from c) t)
select 'balance:balance' as "check", round((sum(p.n * power(p.m - t.m, 2)) / (any_value(t.k) - 1)) / (sum(p.n * p.v) / (any_value(t.n) - any_value(t.k))), 5) as statistic from p, t
union all select 'balance:segment', round(sum(power(coalesce(o, 0) - e, 2) / e), 5) from e left join c using (variant, segment)""")


def experiment_adjusted(spark, sf):
    found = experiment.adjusted(_cohort(spark, sf, **_AT), "a", "control", ["balance"])
    return spark.createDataFrame([(round(found, 6),)], "adjusted double")


_entry("experiment_adjusted", experiment_adjusted, f"""{_SNAP}, b as (select cast(variant = 'a' as int) as t, balance as x, churned as y from coh where variant in ('a', 'control'))
select round((covar_pop(t, y) * var_pop(x) - covar_pop(x, y) * covar_pop(t, x)) / (var_pop(t) * var_pop(x) - power(covar_pop(t, x), 2)), 6) as adjusted from b""")

_TREAT = "cast(coalesce(recency > 120, false) as int)"


def _treated(spark, sf):
    rows = base.scored(spark, sf)
    return rows.withColumn("treated", causal.binarise(rows, "recency", "threshold", 120))


def causal_binarise(spark, sf):
    rows = base.scored(spark, sf)
    kinds = {"threshold": causal.binarise(rows, "recency", "threshold", 120), "below": causal.binarise(rows, "recency", "threshold", 120, "less"), "binary": causal.binarise(rows, "balance", "binary"), "split": causal.binarise(rows, "balance", "continuous_median_split")}
    return rows.agg(*[F.sum(c).cast("long").alias(n) for n, c in kinds.items()])


_entry("causal_binarise", causal_binarise, f"""{SCORED} select count(*) filter (recency > 120) as threshold, count(*) filter (recency < 120) as below, count(*) filter (balance > 0) as "binary", count(*) filter (balance > (select median(balance) from scored)) as split from scored""")
_entry("causal_naive_diff", lambda spark, sf: causal.naive_difference(_treated(spark, sf)).select(F.round("naive_diff", 6).alias("naive_diff")), f"{SCORED} select round(avg(label) filter (recency > 120) - avg(label) filter (not coalesce(recency > 120, false)), 6) as naive_diff from scored")
_entry("causal_smd", lambda spark, sf: metrics.smd(_treated(spark, sf), ["balance", "orders"], "treated").select("feature", F.round("smd", 6).alias("smd")),
    f"""{SCORED}, l as (select 'balance' as feature, balance as v, {_TREAT} as t from scored union all select 'orders', orders, {_TREAT} from scored)
select feature, round(abs(avg(v) filter (t = 1) - avg(v) filter (t = 0)) / sqrt((var_pop(v) filter (t = 1) + var_pop(v) filter (t = 0)) / 2), 6) as smd from l group by 1""")


def causal_aipw_stratified(spark, sf):
    rows = causal.stratified(_treated(spark, sf), ["segment"])
    found = causal.estimate(rows, clip=0.001)
    return spark.createDataFrame([(found["n"], round(found["ate"], 6), round(found["se"], 6))], "n long, ate double, se double")


_entry("causal_aipw_stratified", causal_aipw_stratified, f"""{SCORED}, r as (select segment, label as y, {_TREAT} as t from scored), c as (select segment, avg(t) as e, coalesce(avg(y) filter (t = 1), 0) as m1, coalesce(avg(y) filter (t = 0), 0) as m0 from r group by 1),
p as (select m1 - m0 + t * (y - m1) / e - (1 - t) * (y - m0) / (1 - e) as psi from r join c using (segment) where e > 0.0015 and e < 0.9985)
select count(*) as n, round(avg(psi), 6) as ate, round(stddev_samp(psi) / sqrt(count(*)), 6) as se from p""")

_NUM, _CAT = ["recency", "orders", "balance"], ["segment"]
_META = {n: Meta(n, "g", "entity", "numeric" if n in _NUM else "categorical", "static", None, "normal", "", True) for n in (*_NUM, *_CAT)}
_OPTIONS = {"class_weight": "balanced", "max_iter": 5, "learning_rate": 0.1, "max_leaf_nodes": 7, "calibrate": True}


def _sides(spark, sf):
    out = splits.out_of_time(base.scored(spark, sf).drop("score", "nation"), base.DATES, 0.25, base.HORIZON).frame.cache()
    return out.filter("split = 'train'").drop("split"), out.filter("split = 'test'").drop("split")


def model_gbt_scores(spark, sf):
    train, test = _sides(spark, sf)
    return modeling.score_tree(modeling.fit_tree(train, _META, _OPTIONS, 42), test, _META).select("entity_id", "snapshot_date", "label", "score")


def model_logistic(spark, sf):
    train, test = _sides(spark, sf)
    model, _ = modeling.fit_linear(train, _META, _OPTIONS)
    return modeling.score_linear(model, test, _META).select("entity_id", "snapshot_date", "label", "baseline")


def model_calibrated(spark, sf):
    train, test = _sides(spark, sf)
    fitted = modeling.fit(train, test, _META, _OPTIONS, 2, 42)
    return fitted.scored.select("entity_id", "snapshot_date", "label", "raw_score", "score")


def permutation_importance(spark, sf):
    train, test = _sides(spark, sf)
    found = drivers.permutation(modeling.fit_tree(train, _META, _OPTIONS, 42), test, _META, 1, 42)
    return spark.createDataFrame(sorted(found.items()), "feature string, importance double")


def shap_importance(spark, sf):
    train, test = _sides(spark, sf)
    found = shap.importance(modeling.fit_tree(train, _META, _OPTIONS, 42), test, _META)
    return spark.createDataFrame(sorted(found.items()), "feature string, importance double")


def _cox_design(spark, sf):
    made = survival.design(base.lifetimes(spark, sf), ["balance"], ["segment"])
    made.frame = made.frame.cache()
    return made


def cox_ph(spark, sf):
    fit = survival.cox(_cox_design(spark, sf))
    return spark.createDataFrame([(r["covariate"], r["coef"], r["se"], r["p_value"]) for r in fit.table()], "covariate string, coef double, se double, p_value double")


def cox_proportionality(spark, sf):
    made = _cox_design(spark, sf)
    found = survival.proportionality(made, survival.cox(made))
    return spark.createDataFrame([(r["covariate"], r["statistic"], r["proportional"]) for r in found], "covariate string, statistic double, proportional boolean")


def aipw_effect(spark, sf):
    rows = _treated(spark, sf).select("entity_id", "snapshot_date", "label", "treated", "balance", "segment")
    meta = {n: _META[n] for n in ("balance", "segment")}
    found = causal.estimate(causal.nuisances(rows, meta, _OPTIONS | {"max_iter": 3}, 2, 42), 0.02)
    return spark.createDataFrame([(found["n"], found["ate"], found["se"], found["overlap"])], "n long, ate double, se double, overlap double")


for _f in (model_gbt_scores, model_logistic, model_calibrated, permutation_importance, shap_importance, cox_ph, cox_proportionality, aipw_effect):
    _entry(_f.__name__, _f)
