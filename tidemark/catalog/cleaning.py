"""Parsers on values made dirty in known ways, the ingest adapter, a whole run, and streaming."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..plans import pipeline
from ..plans import spec as specs
from ..sources import ingest, synthetic
from ..streaming import windows
from . import base
from .base import Query

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _entry(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _part(spark, sf):
    return base.table(spark, sf, "part")


def parse_numbers(spark, sf):
    """Prices in four styles and with a currency, read back."""
    p, k = F.format_number("p_retailprice", 2), F.col("p_partkey") % 5
    swapped = F.translate(p, ",.", ".,")
    raw = F.when(k == 0, F.concat(F.lit("€"), swapped)).when(k == 1, F.concat(F.lit("USD "), p)).when(k == 2, F.concat(F.lit("("), p, F.lit(")"))).when(k == 3, F.lit("N/A")).otherwise(F.concat(F.lit(" "), F.translate(F.replace(p, F.lit(","), F.lit("")), ".", ","), F.lit(" ")))
    return _part(spark, sf).select("p_partkey", C.number(raw)["value"].alias("value"))


_entry("parse_numbers", parse_numbers, "select p_partkey, case p_partkey % 5 when 3 then null when 2 then -round(p_retailprice, 2) else round(p_retailprice, 2) end as value from part")


def parse_ambiguous(spark, sf):
    raw = F.concat(F.lit("1"), F.when(F.col("p_partkey") % 2 == 0, ",").otherwise("."), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"))
    n = C.number(raw)
    return _part(spark, sf).select("p_partkey", n["value"].alias("value"), n["ambiguous"].alias("ambiguous"))


_entry("parse_ambiguous", parse_ambiguous, "select p_partkey, cast(1000 + p_partkey % 1000 as double) as value, true as ambiguous from part")


def _choices(spark, sf, texts: list[str], column):
    raw = F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % len(texts) + 1).cast("int"))
    return _part(spark, sf).select("p_partkey", *column(raw))


def _sql_choice(values: list[str], names: tuple[str, ...] = ("value",)) -> str:
    cases = [" ".join(f"when {i} then {v}" for i, v in enumerate(own)) for own in zip(*[x.split("|") for x in values], strict=True)]
    n = len(values)
    return "select p_partkey, " + ", ".join(f"case p_partkey % {n} {c} end as {name}" for c, name in zip(cases, names, strict=True)) + " from part"


_entry("parse_bool", lambda s, d: _choices(s, d, ["Y", "no", "TRUE", "nee", "NA", "3", "maybe"], lambda r: [C.boolean(r).cast("long").alias("value")]), _sql_choice(["1::bigint", "0", "1", "0", "null", "1", "null"]))
_entry("parse_capped", lambda s, d: _choices(s, d, ["10+", "5", "missing", "0"], lambda r: [C.capped_count(r)["count"].alias("value"), C.capped_count(r)["capped"].cast("long").alias("capped")]), _sql_choice(["10.0::double|1::bigint", "5.0|0", "null|null", "0.0|0"], ("value", "capped")))
_entry("keyed_number", lambda s, d: _choices(s, d, ['{"email_opens": "5"}', "opens=3", "{'email_opens': 7}", "missing"], lambda r: [C.keyed_number(r, ingest.OPENS).alias("value")]), _sql_choice(["5.0::double", "3.0", "7.0", "null"]))
_entry("postcode_prefix", lambda s, d: _choices(s, d, ["1012", "SE-123 45", "ec1a 1bb", "?"], lambda r: [C.postcode_area(r).alias("value")]), _sql_choice(["'10'", "'SE'", "'EC'", "null"]))
_entry("normalise_category", lambda s, d: _choices(s, d, ["Direct Mail", " DM ", "Paid-Online", "word of mouth", "n/a"], lambda r: [C.category(r, ingest.CHANNELS).alias("value")]), _sql_choice(["'direct_mail'", "'direct_mail'", "'online_paid'", "'word_of_mouth'", "null"]))
_entry("split_dates", lambda s, d: _choices(s, d, ["2022-03-04;2021-05-06", '["2022-01-01", "2022-01-02", "2022-01-03"]', "2020-01-01|NA", "NA"], lambda r: [F.size(C.dates_in(r)).cast("long").alias("value")]), _sql_choice(["2::bigint", "3", "1", "0"]))


def parse_dates(spark, sf):
    """Order dates written in six ways, read back."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "d MMMM yyyy")).when(k == 3, F.date_format(d, "MMM yyyy")).when(k == 4, F.date_format(d, "yyyy/MM/dd")).otherwise(F.lit("unknown"))
    return base.table(spark, sf, "orders").select("o_orderkey", C.date(raw, True).alias("value"))


_entry("parse_dates", parse_dates, "select o_orderkey, case o_orderkey % 6 when 5 then null when 3 then cast(date_trunc('month', o_orderdate) as date) else cast(o_orderdate as date) end as value from orders")


def infer_dayfirst(spark, sf):
    o = base.table(spark, sf, "orders")
    rows = [C.day_first(o.select(F.date_format("o_orderdate", p).alias("raw")), "raw").withColumn("pattern", F.lit(p)) for p in ("dd/MM/yyyy", "MM/dd/yyyy")]
    return rows[0].unionByName(rows[1])


_entry("infer_dayfirst", infer_dayfirst, "select * from (values (true, 'day-first', 'dd/MM/yyyy'), (false, 'month-first', 'MM/dd/yyyy')) as t(day_first, verdict, pattern)")


def coercion_report(spark, sf):
    raw = F.when(F.col("p_partkey") % 4 == 0, F.lit("oops")).when(F.col("p_partkey") % 4 == 1, F.lit("NA")).otherwise(F.col("p_retailprice").cast("string"))
    df = _part(spark, sf).select(raw.alias("price"))
    return C.report(df, [C.Parsed("price", "numeric", C.number("price")["value"])]).withColumn("pct_lost", F.round("pct_lost", 6))


_entry("coercion_report", coercion_report, """select 'price' as "column", 'numeric' as parsed_as, count(*) as n_rows, count(*) filter (p_partkey % 4 > 1) as n_parsed, count(*) filter (p_partkey % 4 < 2) as n_null_or_failed,
  round(100.0 * count(*) filter (p_partkey % 4 = 0) / count(*) filter (p_partkey % 4 <> 1), 6) as pct_lost, 'many values could not be read' as notes from part""")
_entry("dedupe_keep_first", lambda s, d: C.keep_first(base.orders(s, d).select("id", "o_orderdate", "o_orderkey", F.round("o_totalprice", 2).alias("price")), "id", ["o_orderdate", "o_orderkey"]),
    "select o_custkey as id, cast(o_orderdate as date) as o_orderdate, o_orderkey, round(o_totalprice, 2) as price from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1")


def _raw_export(spark, sf):
    """An export as text made from customers; one in ten subscriptions comes twice, the second time spoilt."""
    o = base.entity(spark, sf).withColumn("k", F.col("id") % 4)
    date = lambda c: F.when(F.col("k") == 0, F.date_format(c, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(c, "dd/MM/yyyy"))
    rows = o.select(
        F.concat(F.lit(" S"), F.col("id").cast("string"), F.lit(" ")).alias("subscription_id"), F.concat(F.lit("C"), (F.col("id") / 2).cast("long").cast("string")).alias("customer_id"), date("start_date").alias("subscription_date"), date("end_date").alias("churn_date"),
        F.when(F.col("end_date").isNotNull(), "Y").otherwise("0").alias("churned"), F.element_at(F.array(*map(F.lit, ["DM", "organic", "TV", "Referral"])), (F.col("k") + 1).cast("int")).alias("marketing_channel"),
        F.when(F.col("k") == 1, "Unknown").otherwise((F.col("id") % 90).cast("string")).alias("participant_age"), F.concat(F.lit("€"), F.translate(F.format_number("balance", 2), ",.", ".,")).alias("monthly_spend_estimated"),
        F.element_at(F.array(*map(F.lit, ["Control", "variant a", "B"])), (F.col("id") % 3 + 1).cast("int")).alias("campaign_cohort"), F.when(F.col("id") % 3 == 0, "0").otherwise("yes").alias("treatment_sent_flag"),
        date("last_date").alias("last_contact_date"), F.when(F.col("k") == 2, "Offer question").otherwise("billing").alias("last_contact_reason"), F.concat_ws(";", date("start_date"), date("last_date")).alias("win_dates"), F.col("id").alias("_row"))
    again = rows.filter("_row % 10 = 0").withColumns({"monthly_spend_estimated": F.lit("?"), "_row": F.col("_row") + 10_000_000})
    return rows.unionByName(again)


def ingest_subscriptions(spark, sf):
    out = ingest.ingest(_raw_export(spark, sf), dt.date(1999, 1, 1)).subscriptions
    return out.select("subscription_id", "customer_id", "subscription_date", F.col("churned").cast("long").alias("churned"), "churn_date", "marketing_channel", "participant_age", "monthly_spend_eur", "campaign_cohort")


_entry("ingest_subscriptions", ingest_subscriptions, f"""with {base.ENT} select 'S' || id as subscription_id, 'C' || (id // 2) as customer_id, start_date as subscription_date, cast(end_date is not null as bigint) as churned, end_date as churn_date,
  case id % 4 when 0 then 'direct_mail' when 1 then 'online_organic' when 2 then 'tv' else 'referral' end as marketing_channel, case when id % 4 <> 1 and id % 90 between 16 and 110 then cast(id % 90 as double) end as participant_age,
  round(balance, 2) as monthly_spend_eur, case id % 3 when 0 then 'Control' when 1 then 'Variant_A' else 'Variant_B' end as campaign_cohort from ent""")


def ingest_events(spark, sf):
    logs = ingest.ingest(_raw_export(spark, sf), dt.date(1999, 1, 1)).events
    contacts = logs["contact_events"].agg(F.lit("contact").alias("log"), F.count(F.lit(1)).alias("n"), F.sum("is_offer_question").cast("long").alias("flagged"), F.max("event_date").alias("last"))
    wins = logs["win_events"].agg(F.lit("win").alias("log"), F.count(F.lit(1)).alias("n"), F.sum("win").cast("long").alias("flagged"), F.max("event_date").alias("last"))
    return contacts.unionByName(wins)


_entry("ingest_events", ingest_events, f"""with {base.ENT} select 'contact' as log, count(*) as n, count(*) filter (id % 4 = 2) as flagged, max(last_date) as last from ent
union all select 'win', 2 * count(*), 2 * count(*), max(last_date) from ent""")
_entry("ingest_compliance", lambda s, d: ingest.compliance(ingest.ingest(_raw_export(s, d), dt.date(1999, 1, 1)).subscriptions),
    f"""with {base.ENT} select case id % 3 when 0 then 'Control' when 1 then 'Variant_A' else 'Variant_B' end as campaign_cohort, count(*) as n, cast(count(*) filter (id % 3 > 0) as bigint) as n_sent, cast(any_value(case when id % 3 > 0 then 1 else 0 end) as double) as share_sent from ent group by 1""")
_entry("ingest_clustering", lambda s, d: ingest.clustering(ingest.ingest(_raw_export(s, d), dt.date(1999, 1, 1)).subscriptions),
    f"with {base.ENT}, k as (select id // 2 as c, count(*) as k from ent group by 1) select count(*) filter (k > 1) as n_multi, count(*) as n_customers from k")


def contact_reasons(spark, sf):
    logs = ingest.ingest(_raw_export(spark, sf), dt.date(1999, 1, 1)).events
    return logs["contact_events"].agg(*[F.sum(c).cast("long").alias(c) for c in sorted(ingest.CONTACTS.values())])


_entry("contact_reasons", contact_reasons, f"with {base.ENT} select count(*) filter (id % 4 <> 2) as is_billing_issue, 0::bigint as is_cancellation_inquiry, count(*) filter (id % 4 = 2) as is_offer_question, 0::bigint as is_prize_claim from ent")


def streaming_windows(spark, sf):
    """Tumbling windows of the event log: the plan that a stream would run, on the table."""
    out = windows.counts_by_window(base.table(spark, sf, "events"), "ts", ["event_type"], "value", "1 day")
    return out.select(F.col("window_start").cast("date").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


_entry("streaming_windows", streaming_windows, "select cast(ts as date) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")

_RAW = {
    "data": {"entity": {"path": "customers.parquet"}, "events": {"usage": {"path": "usage_events.parquet"}, "billing": {"path": "billing_events.parquet"}}, "segments": ["plan_tier"]},
    "target": {"target": {"event_date_column": "contract_end_date", "observation_end_date": "2025-06-30"}},
    "survivorship": {"data_export_date": "2025-06-30", "observation_starting_date": "2022-01-01"},
    "feature": {
        "profile": {"temporal": "static", "columns": [{"name": "region", "type": "categorical"}, {"name": "birthyear"}]},
        "usage": {"temporal": "time_varying", "windows": [90], "aggs": ["sum"], "columns": ["sessions", "spend"]},
        "billing": {"temporal": "time_varying", "windows": [90], "aggs": ["max"], "filters": {"failed": "status == 'failed'"}, "columns": ["days_past_due"]},
        "ratios": {"temporal": "derived", "features": [{"name": "spend_per_session", "expression": "usage__spend__sum_90d / usage__sessions__sum_90d"}]},
    },
    "pipeline": {"panel": {"snapshot_frequency": "QS"}, "model": {"max_iter": 3, "max_leaf_nodes": 5}, "split": {"cv_folds": 2}, "drivers": {"n_permutation_repeats": 1}, "causal": {"enabled": False}},
}


def demo_spec(folder: str) -> specs.Spec:
    return specs.build(_RAW, folder)


def pipeline_summary(spark, sf):
    """The whole engine on a small made-up business, read from memory: its summary, as names and values."""
    made = synthetic.make(spark, 300)
    own = demo_spec("demo")
    done = pipeline.run(spark, own, tables={"entity": made["customers"], "usage": made["usage_events"], "billing": made["billing_events"]})
    return spark.createDataFrame([(k, str(v)) for k, v in done.summary.items()], "name string, value string")


_entry("pipeline_summary", pipeline_summary)


def synthetic_tables(spark, sf):
    made = synthetic.make(spark, 200)
    rows = [made[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in sorted(made)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


_entry("synthetic_tables", synthetic_tables)
