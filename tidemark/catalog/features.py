"""Windows, filters, attributes, versions, derived expressions, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ast_columns import expression
from ..operators import audit, features
from ..plans.panel import Panel
from ..plans.spec import Column, Derived, Filter, Group
from . import base
from .base import ENT, ORD, WITH, Query

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _entry(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


#: Added before rounding, here and in SQL: means of cents often lie just between two roundings, and which side they fall on would hang on the order of the sum.
_NUDGE = 1e-7


def _rounded(df, digits: int = 4, nudge: float = 0.0):
    return df.select(*[F.round(F.col(n) + nudge, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def _built(spark, sf, group: Group, tie: str = "o_orderkey"):
    log = base.orders(spark, sf)
    out, meta = features.from_events(base.frame(spark, sf), log, group, "o_orderdate", "id", base.DATES, base.EMBARGO, [], tie)
    return out.select("entity_id", "snapshot_date", *meta), meta


#: SQL of each aggregate over x, of events o under the guard {g}; k orders ties.
_AGG = {
    "sum": "case when count(*) filter ({g}) > 0 then coalesce(sum({x}) filter ({g}), 0) end",
    "mean": "avg({x}) filter ({g})",
    "max": "max({x}) filter ({g})",
    "min": "min({x}) filter ({g})",
    "count": "case when count(*) filter ({g}) > 0 then cast(count({x}) filter ({g}) as double) end",
    "median": "median({x}) filter ({g})",
    "std": "stddev_samp({x}) filter ({g})",
    "nunique": "case when count(*) filter ({g}) > 0 then cast(count(distinct {x}) filter ({g}) as double) end",
    "last": "arg_max({x}, (o.d, o.o_orderkey)) filter ({g} and {x} is not null)",
    "first": "arg_min({x}, (o.d, o.o_orderkey)) filter ({g} and {x} is not null)",
}


def _window_sql(group: Group, conditions: dict[str, str]) -> str:
    """conditions: SQL of each filter by name."""
    longest = max(group.windows)
    columns = []
    for name, condition in ([("", "true")] if group.unfiltered or not group.filters else []) + [(f.name, conditions[f.name]) for f in group.filters]:
        for w in group.windows:
            g = f"o.d is not null and o.d >= p.feature_end - {w} and ({condition})"

            def put(column, suffix, text, name=name, w=w):
                columns.append(f"round({text} + {_NUDGE}, 4) as {features.named(group.name, name, column, f'{suffix}_{w}d')}")

            put(None, "event_count", f"cast(nullif(count(*) filter ({g}), 0) as double)")
            put(None, "recency_days", f"cast(date_diff('day', max(o.d) filter ({g}), any_value(p.feature_end)) as double)")
            for c in group.columns:
                if c.type != "numeric" or w not in (c.windows or group.windows):
                    continue
                for a in c.aggs or group.aggs:
                    put(c.name, a, _AGG[a].format(g=g, x=f"o.{c.name}"))
                if group.trends:
                    late, early = (f"coalesce(sum(o.{c.name}) filter ({g} and o.d {op} p.feature_end - {w // 2}), 0)" for op in (">=", "<"))
                    there = f"count(*) filter ({g}) > 0"
                    put(c.name, "trend_delta", f"case when {there} then {late} - {early} end")
                    put(c.name, "trend_ratio", f"case when {there} and {early} > 0 then {late} / {early} end")
            for c in group.columns:
                if c.type == "datetime" and w in (c.windows or group.windows):
                    put(c.name, "recency_days", f"cast(date_diff('day', max(cast(o.{c.name} as date)) filter ({g}), any_value(p.feature_end)) as double)")
    return f"""{WITH}, {ORD} select p.entity_id, p.snapshot_date, {', '.join(columns)}
from panel p left join ord o on o.o_custkey = p.entity_id and o.d < p.feature_end and o.d >= p.feature_end - {longest} group by 1, 2"""


def _window(name: str, group: Group, conditions: dict[str, str] | None = None) -> None:
    _entry(name, lambda spark, sf: _rounded(_built(spark, sf, group)[0], nudge=_NUDGE), _window_sql(group, conditions or {}))


def _group(columns=(), windows=(365,), **more) -> Group:
    return Group("orders", "time_varying", "orders", tuple(columns), tuple(windows), **more)


_price = "o_totalprice"
_window("window_count_recency", _group(windows=(90, 365)))
_window("window_sum_mean", _group([Column(_price, aggs=("sum", "mean"))], (180, 365)))
_window("window_min_max", _group([Column(_price, aggs=("min", "max"))]))
_window("window_first_last", _group([Column(_price, aggs=("first", "last"))], (365, 730)))
_window("window_median_std", _group([Column(_price, aggs=("median", "std"))], (730,)))
_window("window_nunique", _group([Column(_price, aggs=("nunique", "count"))], (365,)))
_window("window_multi", _group([Column(_price, aggs=("sum", "max"))], (30, 90, 365)))
_window("window_column_override", _group([Column(_price, aggs=("sum",)), Column("o_orderkey", aggs=("count",), windows=(365,))], (90, 365), aggs=("mean",)))
_window("window_datetime_recency", _group([Column("o_orderdate", "datetime")], (365,)))
_window("trend_delta_ratio", _group([Column(_price, aggs=("sum",))], (90, 365), trends=True))
_window("trend_odd_window", _group([Column(_price, aggs=("sum",))], (91,), trends=True))
_status = (Filter("finished", "o_orderstatus == 'F'"), Filter("open", "o_orderstatus == 'O'"), Filter("pending", "o_orderstatus == 'P'"))
_sql = {"finished": "o.o_orderstatus = 'F'", "open": "o.o_orderstatus = 'O'", "pending": "o.o_orderstatus = 'P'"}
_window("filter_family", _group([Column(_price, aggs=("sum",))], (365,), filters=_status[:2]), _sql)
_window("filter_only", _group([Column(_price, aggs=("mean",))], (365,), filters=_status[:1], unfiltered=False), _sql)
_window("filter_partition_invariant", _group(windows=(365,), filters=_status), _sql)
_logic = (Filter("large", "o_totalprice > 100000 and not (o_orderstatus in ['F', 'P'])"), Filter("urgent", "`o_orderpriority` == '1-URGENT' | o_totalprice * 2 <= 30000"))
_window("filter_logic", _group(windows=(365,), filters=_logic), {"large": "o.o_totalprice > 100000 and o.o_orderstatus not in ('F', 'P')", "urgent": "o.o_orderpriority = '1-URGENT' or o.o_totalprice * 2 <= 30000"})
_flagship = _group([Column(_price, aggs=("sum", "mean", "median", "std", "last", "nunique"))], (365, 730), filters=_status[:1])


def panel_features(spark, sf):
    """The flagship: features of all orders and of finished ones, with the label of each customer and date."""
    out, meta = features.from_events(base.frame(spark, sf), base.orders(spark, sf), _flagship, "o_orderdate", "id", base.DATES, base.EMBARGO, [], "o_orderkey")
    return _rounded(out.select("entity_id", "snapshot_date", F.col("label").cast("long").alias("label"), *meta), nudge=_NUDGE)


_entry("panel_features", panel_features, _window_sql(_flagship, _sql).replace("select p.entity_id, p.snapshot_date, ", "select p.entity_id, p.snapshot_date, cast(any_value(p.label) as bigint) as label, "))


def filter_null_semantics(spark, sf):
    """A comparison with null is false, and != with null is true."""
    from ..functions.ast_columns import predicate

    o = base.table(spark, sf, "orders").withColumn("s", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")))
    return o.agg(*[F.count_if(predicate(t, o.columns)).alias(n) for n, t in (("eq", "s == 'F'"), ("ne", "s != 'F'"), ("neg", "not (s == 'F')"), ("isin", "s in ['F', 'O']"), ("notin", "s not in ['F', 'O']"))])


_entry("filter_null_semantics", filter_null_semantics, """select count(*) filter (coalesce(s = 'F', false)) as eq, count(*) filter (coalesce(s <> 'F', true)) as ne,
  count(*) filter (not coalesce(s = 'F', false)) as neg, count(*) filter (coalesce(s in ('F', 'O'), false)) as isin, count(*) filter (not coalesce(s in ('F', 'O'), false)) as notin
from (select case when o_orderkey % 4 <> 0 then o_orderstatus end as s from orders)""")


def window_lineitem_wide(spark, sf):
    """A second log, through a join: quantities and ship dates of ordered lines, by flag."""
    lines = base.table(spark, sf, "lineitem").join(base.orders(spark, sf).select(F.col("o_orderkey").alias("l_orderkey"), "id", "o_orderdate"), "l_orderkey")
    g = Group("lines", "time_varying", "lines", (Column("l_quantity", aggs=("sum", "max")),), (365,), filters=(Filter("returned", "l_returnflag == 'R'"),))
    out, meta = features.from_events(base.frame(spark, sf), lines, g, "o_orderdate", "id", base.DATES, base.EMBARGO, [])
    return _rounded(out.select("entity_id", "snapshot_date", *meta))


def _lines(cond: str, prefix: str) -> str:
    g = f"o.d is not null and o.d >= p.feature_end - 365 and {cond}"
    return f"""cast(nullif(count(*) filter ({g}), 0) as double) as {prefix}event_count_365d,
  cast(date_diff('day', max(o.d) filter ({g}), any_value(p.feature_end)) as double) as {prefix}recency_days_365d,
  round({_AGG['sum'].format(g=g, x='o.l_quantity')}, 4) as {prefix}l_quantity__sum_365d, round(max(o.l_quantity) filter ({g}), 4) as {prefix}l_quantity__max_365d"""


_entry("window_lineitem_wide", window_lineitem_wide, f"""{WITH}, ord as (select l.*, o_custkey, cast(o_orderdate as date) as d from lineitem l join orders on o_orderkey = l_orderkey)
select p.entity_id, p.snapshot_date, {_lines('true', 'lines__')}, {_lines("o.l_returnflag = 'R'", 'lines__returned__')}
from panel p left join ord o on o.o_custkey = p.entity_id and o.d < p.feature_end and o.d >= p.feature_end - 365 group by 1, 2""")


def _static(spark, sf, group: Group, **over):
    s = base.spec(groups=[group], **over)
    e = base.entity(spark, sf).withColumns({"vip": F.when(F.col("id") % 3 == 0, "Yes").when(F.col("id") % 3 == 1, "no"), "balance_text": F.when(F.col("id") % 7 == 0, "n/a").otherwise(F.col("balance").cast("string"))})
    notes: list[str] = []
    out, meta = features.from_entity(features.in_force(base.frame(spark, sf), e, s), e, group, s, [], notes)
    return out.select("entity_id", "snapshot_date", *meta)


_entry(
    "entity_features",
    lambda spark, sf: _rounded(_static(spark, sf, Group("who", columns=(Column("balance_text"), Column("segment", "categorical"), Column("last_date", "datetime"))))),
    f"""{WITH} select entity_id, snapshot_date, case when entity_id % 7 <> 0 then round(balance, 4) end as who__balance_text, segment as who__segment,
  cast(date_diff('day', last_date, feature_end) as double) as who__last_date__days_before_T from panel join ent on id = entity_id""",
)
_entry("entity_boolean", lambda spark, sf: _static(spark, sf, Group("who", columns=(Column("vip", "boolean"),))), f"{WITH} select entity_id, snapshot_date, case entity_id % 3 when 0 then 1.0::double when 1 then 0.0::double end as who__vip from panel")
_entry("tenure_recomputed", lambda spark, sf: _static(spark, sf, Group("who", columns=(Column("tenure_days"),))), f"{WITH} select entity_id, snapshot_date, cast(tenure_days as double) as who__tenure_days from panel")


def scd2_asof(spark, sf):
    """Versions of a customer from one order to the next; the one in force before each date."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("valid_from")
    days = base.orders(spark, sf).groupBy("id", F.col("o_orderdate").alias("valid_from")).agg(F.max("o_totalprice").alias("price"))
    versions = days.withColumn("valid_to", F.lead("valid_from").over(w))
    s = base.spec(valid_from="valid_from", valid_to="valid_to")
    out = features.in_force(base.frame(spark, sf), versions, s)
    return out.select("entity_id", "snapshot_date", F.col("_entity.valid_from").alias("valid_from"), F.round("_entity.price", 4).alias("price"))


_entry("scd2_asof", scd2_asof, f"""{WITH}, v as (select o_custkey as id, cast(o_orderdate as date) as valid_from, max(o_totalprice) as price from orders group by 1, 2)
select p.entity_id, p.snapshot_date, v.valid_from, round(v.price, 4) as price
from panel p asof left join v on v.id = p.entity_id and v.valid_from <= p.feature_end""")


def _derived(text: str):
    def query(spark, sf):
        g = _group([Column(_price, aggs=("sum", "count", "min"))], (365,))
        out, meta = _built(spark, sf, g)
        short = {"n": "orders__event_count_365d", "total": "orders__o_totalprice__sum_365d", "rec": "orders__recency_days_365d", "low": "orders__o_totalprice__min_365d"}
        renamed = out.select("entity_id", "snapshot_date", *[F.col(v).alias(k) for k, v in short.items()])
        return renamed.select("entity_id", "snapshot_date", F.round(expression(text, list(short))[0], 4).alias("value"))

    return query


_BASE = f"""{WITH}, {ORD}, b as (select p.entity_id, p.snapshot_date, nullif(count(o.d), 0)::double as n, sum(o.o_totalprice) as total, cast(date_diff('day', max(o.d), any_value(p.feature_end)) as double) as rec, min(o.o_totalprice) as low
from panel p left join ord o on o.o_custkey = p.entity_id and o.d < p.feature_end and o.d >= p.feature_end - 365 group by 1, 2)
select entity_id, snapshot_date, round({{}}, 4) as value from b"""
for _name, _text, _same in (
    ("derived_ratio", "total / n", "total / n"),
    ("derived_clip_where", "where(rec > 100, clip(total, 50000, 200000), fillna(n, 0) * 2)", "case when coalesce(rec > 100, false) then case when total is not null then least(greatest(total, 50000), 200000) end else coalesce(n, 0) * 2 end"),
    ("derived_div_zero", "total / (rec - rec) + n", "cast(null as double)"),
    ("derived_fillna", "fillna(log1p(total), -1) + sqrt(abs(fillna(rec, -4)))", "coalesce(ln(1 + total), -1) + sqrt(abs(coalesce(rec, -4)))"),
    ("derived_floor_mod", "(0 - rec) // 7 * 1000 + (0 - rec) % 7", "floor(-rec / 7) * 1000 + (-rec - floor(-rec / 7) * 7)"),
    ("derived_minmax", "maximum(n, rec) - minimum(n, 2) + sign(rec) * exp(0 - n)", "case when n is not null and rec is not null then greatest(n, rec) - least(n, 2) + sign(rec) * exp(-n) end"),
    ("derived_logic", "where((n > 1 and rec < 90) or isnull(total), 1, 0) + (2 if notnull(low) and not low > 30000 else 3) + n ** 2 * 0", "case when n is not null then 0.0::double + case when (coalesce(n > 1, false) and coalesce(rec < 90, false)) or total is null then 1 else 0 end + case when low is not null and not coalesce(low > 30000, false) then 2 else 3 end end"),
):
    _entry(_name, _derived(_text), _BASE.format(_same))


def _matrix(spark, sf) -> features.Features:
    groups = [
        _group([Column(_price, aggs=("sum", "mean"))], (365,), filters=_status[:1]),
        Group("who", columns=(Column("segment", "categorical"), Column("balance"), Column("end_date", "datetime"))),
        Group("ratios", "derived", "derived", derived=(Derived("share", "orders__finished__event_count_365d / orders__event_count_365d"),)),
        Group("more", "derived", "derived", derived=(Derived("twice", "ratios__share * 2"),)),
    ]
    s = base.spec(groups=groups)
    return features.build(base.frame(spark, sf), base.entity(spark, sf), {"orders": base.orders(spark, sf)}, s, base.DATES, {"orders": "o_orderkey"})


def feature_dictionary(spark, sf):
    return _matrix(spark, sf).dictionary(spark)


def lineage_closure(spark, sf):
    made = _matrix(spark, sf)
    return spark.createDataFrame([(n,) for n in sorted(made.dependents({"orders__finished__event_count_365d"}))], "feature string")


_entry(
    "feature_dictionary",
    feature_dictionary,
    """select 'orders' as "group", 'orders__' || fam || col || agg || '_365d' as feature, 'orders' as source, 'numeric' as kind, 'time_varying' as temporal, 365 as window_days,
  'normal' as leakage_review, about || ' of events' || cond || ' in [T - embargo - 365d, T - embargo)' as derivation, true as point_in_time, true as in_model, '' as depends_on
from (values ('', ''), ('finished__', ' where finished')) f(fam, cond),
  (values ('', 'event_count', 'number'), ('', 'recency_days', 'days since the last'), ('o_totalprice__', 'sum', 'sum of o_totalprice'), ('o_totalprice__', 'mean', 'mean of o_totalprice')) a(col, agg, about)
union all select 'who', 'who__' || name, 'entity', kind, 'static', null, 'normal', about, true, true, ''
from (values ('segment', 'categorical', 'value in force'), ('balance', 'numeric', 'value in force'), ('end_date__days_before_T', 'numeric', 'days from the value to T - embargo')) w(name, kind, about)
union all select split_part(name, '__', 1), name, 'derived', 'numeric', 'derived', 365, 'normal', formula, true, true, heirs
from (values ('ratios__share', 'orders__finished__event_count_365d / orders__event_count_365d', 'orders__finished__event_count_365d, orders__event_count_365d'),
  ('more__twice', 'ratios__share * 2', 'ratios__share')) d(name, formula, heirs)""",
)
_entry("lineage_closure", lineage_closure, "select unnest(['more__twice', 'ratios__share']) as feature")


def audit_denylist(spark, sf):
    names = ["who__region", "billing__failed__event_count_90d", "crm__churn_reason", "who__end_date__days_before_T", "plan__cancellation_fee__sum_90d", "usage__last_closed__max_30d", "who__Winback_offer"]
    rules = base.spec().options["leakage"]
    return spark.createDataFrame(sorted(audit.denied(names, rules["denylist_patterns"], ["who__winback_offer"]).items()), "feature string, pattern string")


_entry("audit_denylist", audit_denylist, """select * from (values ('crm__churn_reason', 'churn'), ('plan__cancellation_fee__sum_90d', 'cancel'), ('usage__last_closed__max_30d', 'closed'), ('who__end_date__days_before_T', '(^|_)end_date$')) as t(feature, pattern)""")


def audit_structure(spark, sf):
    made = _matrix(spark, sf)
    report = audit.Report()
    s = base.spec(groups=[])
    audit.structure(s, Panel(made.frame, base.DATES, base.timeline(), base.HORIZON, base.EMBARGO, True), made.meta, report)
    return report.table(spark).select("level", "code", "columns")


_entry("audit_structure", audit_structure, """select * from (values ('BLOCK', 'OUTCOME_DERIVED_FEATURE', 'who__end_date__days_before_T'), ('BLOCK', 'TARGET_COLUMN_AS_FEATURE', 'who__end_date__days_before_T'), ('INFO', 'CENSORING_HANDLED', ''), ('INFO', 'SURVIVORSHIP_HANDLED', '')) as t(level, code, columns)""")


def audit_enforce(spark, sf):
    """What is left after quarantine of the findings about structure, and of what derives from it."""
    made = _matrix(spark, sf)
    report = audit.Report()
    report.add(audit.BLOCK, "PLANTED", "a planted leak", ["orders__finished__event_count_365d"])
    left = audit.enforce(base.spec(), made, report)
    rows = [(n, n in left.meta) for n in made.meta]
    return spark.createDataFrame(rows, "feature string, kept boolean")


_entry("audit_enforce", audit_enforce, """select f as feature, f not in ('orders__finished__event_count_365d', 'ratios__share', 'more__twice') as kept from (select unnest([
'orders__event_count_365d', 'orders__recency_days_365d', 'orders__o_totalprice__sum_365d', 'orders__o_totalprice__mean_365d',
'orders__finished__event_count_365d', 'orders__finished__recency_days_365d', 'orders__finished__o_totalprice__sum_365d', 'orders__finished__o_totalprice__mean_365d',
'who__segment', 'who__balance', 'who__end_date__days_before_T', 'ratios__share', 'more__twice']) as f)""")


def audit_model_checks(spark, sf):
    """Findings for pairs of cross-validated and held-out areas under the curve."""
    rows = []
    for i, (cv, hold) in enumerate([(0.98, 0.74), (0.85, 0.72), (0.72, 0.70), (0.999, 0.999), (0.96, 0.96)]):
        report = audit.Report()
        audit.model_checks(base.spec(), cv, hold, report)
        rows += [(i, f.level, f.code) for f in report.findings]
    return spark.createDataFrame(rows, "pair long, level string, code string")


_entry("audit_model_checks", audit_model_checks, "select * from (values (0::bigint, 'BLOCK', 'CV_HOLDOUT_GAP'), (1, 'WARN', 'CV_HOLDOUT_GAP'), (3, 'BLOCK', 'MODEL_TOO_GOOD'), (4, 'WARN', 'MODEL_SUSPICIOUSLY_GOOD')) as t(pair, level, code)")


def column_audit(spark, sf):
    """Configured columns that their source lacks."""
    from ..cli import lacking

    groups = [Group("who", columns=(Column("segment"), Column("colour"), Column("tenure_days"))), _group([Column(_price), Column("o_colour")], (90,))]
    gaps = lacking(base.spec(groups=groups), base.entity(spark, sf).columns, {"orders": base.orders(spark, sf).columns})
    return spark.createDataFrame(gaps, "group string, column string")


_entry("column_audit", column_audit, """select * from (values ('who', 'colour'), ('orders', 'o_colour')) as t("group", "column")""")


def window_order_free(spark, sf):
    """The order of configured windows and aggregates does not matter, and doubles are dropped."""
    g = _group([Column(_price, aggs=("sum",))], (365, 90))
    return _rounded(_built(spark, sf, g)[0], nudge=_NUDGE)


_entry("window_order_free", window_order_free, _window_sql(_group([Column(_price, aggs=("sum",))], (90, 365)), {}))
