"""A messy subscription export to clean tables: one row per subscription, event logs, a report."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError
from ..functions import cleaning as C

ENCODINGS = ("utf-8", "utf-8-sig", "cp1252", "latin-1")
SEPARATORS = (",", ";", "\t", "|")
SNIFF = 1 << 16
#: cp1252 differs from latin-1 in these bytes only: the latter's controls, and what they stand for.
_KNOWN = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
_WINDOWS = ("".join(map(chr, _KNOWN)), bytes(_KNOWN).decode("cp1252"))

# Spellings of channels, payment methods, cohorts, risk bands and contact reasons.
CHANNELS = {"dm": "direct_mail", "direct mail": "direct_mail", "directmail": "direct_mail", "direct_mail": "direct_mail", "online paid": "online_paid", "paid online": "online_paid", "online_paid": "online_paid", "paid_online": "online_paid", "ppc": "online_paid", "online organic": "online_organic", "organic": "online_organic", "tv": "tv", "television": "tv", "door to door": "door_to_door", "d2d": "door_to_door", "referral": "referral", "partner": "partner", "telemarketing": "telemarketing"}
PAYMENTS = {"direct debit": "direct_debit", "directdebit": "direct_debit", "dd": "direct_debit", "automatische incasso": "direct_debit", "credit card": "credit_card", "creditcard": "credit_card", "cc": "credit_card", "ideal": "ideal", "paypal": "paypal", "bank transfer": "bank_transfer", "invoice": "invoice", "acceptgiro": "invoice"}
COHORTS = {"control": "Control", "ctrl": "Control", "c": "Control", "variant_a": "Variant_A", "variant a": "Variant_A", "varianta": "Variant_A", "a": "Variant_A", "treatment_a": "Variant_A", "variant_b": "Variant_B", "variant b": "Variant_B", "variantb": "Variant_B", "b": "Variant_B", "treatment_b": "Variant_B"}
RISK_BANDS = {"low": "low", "medium": "medium", "med": "medium", "high": "high", "very high": "very_high", "very_high": "very_high", "veryhigh": "very_high"}
CONTACTS = {"billing": "is_billing_issue", "cancellation_inquiry": "is_cancellation_inquiry", "offer_question": "is_offer_question", "prize_claim": "is_prize_claim"}
OPENS = ["email_opens", "opens", "email_open", "openings"]

NUMBERS = {"extra_draws_per_year": "extra_draws_per_year", "Add-ons": "add_ons", "add_ons": "add_ons", "failed_payments_12m": "failed_payments_12m", "c_service_contacts_12m": "c_service_contacts_12m", "complaints_12m": "complaints_12m", "lifetime_wins": "lifetime_wins", "monthly_spend_estimated": "monthly_spend_eur", "historic_revenue_12m": "historic_revenue_12m_eur"}
CATEGORIES = {"legacy_system_id": ("legacy_system_id", None), "marketing_channel": ("marketing_channel", CHANNELS), "payment_method": ("payment_method", PAYMENTS), "baseline_churn_risk_band": ("baseline_churn_risk_band", RISK_BANDS)}
MONEY = ("monthly_spend_estimated", "historic_revenue_12m", "offer_cost_eur")
SENTINEL = 90


@dataclass
class Ingested:
    subscriptions: DataFrame
    events: dict[str, DataFrame]
    report: DataFrame
    warnings: list[str] = field(default_factory=list)


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """Encoding and separator from the first bytes: the first pair under which the header has several columns."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, SNIFF).alias("c")).first()["c"]
    for encoding in ENCODINGS:
        try:
            line = bytes(head).decode(encoding, "strict" if encoding != "utf-8" or len(head) < SNIFF else "ignore").splitlines()[0]
        except (UnicodeDecodeError, IndexError):
            continue
        best = max(SEPARATORS, key=line.count)
        if line.count(best):
            return encoding, best
    raise DataError(f"{path}: no encoding and separator give more than one column")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Everything as text; headers without blanks around them; `_row` numbers rows by file order."""
    encoding, separator = sniff(spark, path)
    known = "utf-8" if encoding.startswith("utf-8") else "iso-8859-1"
    reader = spark.read.option("header", True).option("sep", separator).option("encoding", known).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = reader.csv(path)
    if encoding == "cp1252":
        df = df.toDF(*[c.translate(str.maketrans(*_WINDOWS)) for c in df.columns])
        df = df.select(*[F.translate(f"`{c}`", *_WINDOWS).alias(c) for c in df.columns])
    df = df.toDF(*[c.strip().lstrip("\ufeff") for c in df.columns])
    return df.withColumn("_row", F.monotonically_increasing_id())


def outcome(raw: DataFrame, dates: dict[str, Column], prediction: dt.date) -> tuple[Column, Column, list[str]]:
    """The flag and the date. Reconciles the flag with the date of the outcome; conflicts are counted in one pass and reported."""
    flag, gone = C.boolean("churned"), dates["churn_date"]
    ends = dates.get("observation_end_date")
    tests = {
        "flagged as churned without a date": (flag == 1) & gone.isNull(),
        "dated but flagged as retained": (flag == 0) & gone.isNotNull(),
        "churned before the prediction date": gone < F.lit(prediction),
    }
    row = raw.agg(*[F.count_if(t).alias(f"t{i}") for i, t in enumerate(tests.values())], (F.count_distinct(ends) if ends is not None else F.lit(1)).alias("ends")).first()
    notes = [f"{row[f't{i}']} rows {name}" for i, name in enumerate(tests) if row[f"t{i}"]]
    if row["ends"] > 1:
        notes.append(f"{row['ends']} different observation ends")
    return F.when(gone.isNotNull(), 1).otherwise(F.coalesce(flag, F.lit(0))), gone, notes


def ingest(raw: DataFrame, prediction: dt.date, key: str = "subscription_id") -> Ingested:
    """raw: text columns and `_row`. Unknown columns are left out; missing ones are passed over."""
    if key not in raw.columns:
        raise DataError(f"the export has no column {key}")
    have, warnings, parsed = set(raw.columns), [], []
    raw = raw.withColumn(key, F.trim(key))
    dates: dict[str, Column] = {}
    for name in ("subscription_date", "churn_date", "observation_end_date", "survey_date", "last_contact_date", "service_tier_upgrade_date"):
        if name in have:
            order = C.day_first(raw, name).first()
            if order["verdict"] in ("MIXED", "month-first"):
                warnings.append(f"{name}: day and month order is {order['verdict']}")
            dates[name] = C.date(f"`{name}`", order["day_first"])
            parsed.append(C.Parsed(name, "date", dates[name]))
    out: dict[str, Column] = {key: F.col(key)}
    if "customer_id" in have:
        out["customer_id"] = F.trim("customer_id")
    if "subscription_date" in dates:
        out["subscription_date"] = dates["subscription_date"]
    for source, (target, aliases) in CATEGORIES.items():
        if source in have:
            out[target] = C.category(f"`{source}`", aliases)
            parsed.append(C.Parsed(source, "category", out[target]))
    if "country_code" in have:
        out["country_code"] = F.upper(C.category("country_code"))
    if "postcode_area" in have:
        out["postcode_prefix"] = C.postcode_area("postcode_area")
        parsed.append(C.Parsed("postcode_area", "category (leading part)", out["postcode_prefix"]))
    if "participant_age" in have:
        out["participant_age"] = C.age("participant_age")
        parsed.append(C.Parsed("participant_age", "numeric", C.number("participant_age")["value"]))
    for source, target in NUMBERS.items():
        if source in have and target not in out:
            out[target] = C.number(f"`{source}`")["value"]
            parsed.append(C.Parsed(source, "numeric", out[target]))
    if "donation_share_charity" in have:
        out["donation_share_charity"] = C.share("donation_share_charity")
        parsed.append(C.Parsed("donation_share_charity", "numeric (share)", out["donation_share_charity"]))
    if "engagement_history" in have:
        out["email_opens"] = C.keyed_number("engagement_history", OPENS)
        parsed.append(C.Parsed("engagement_history", "numeric (email_opens)", out["email_opens"]))
    if "web_sessions_90d_raw" in have:
        pair = C.capped_count("web_sessions_90d_raw")
        out["web_sessions_90d"], out["web_sessions_capped"] = pair["count"], pair["capped"]
        parsed.append(C.Parsed("web_sessions_90d_raw", "numeric and capped flag", pair["count"]))
    if "campaign_cohort" in have:
        out["campaign_cohort"] = C.category("campaign_cohort", COHORTS)
    if "treatment_sent_flag" in have:
        out["treatment_sent_flag"] = C.boolean("treatment_sent_flag")
    if {"churned", "churn_date"} <= have:
        out["churned"], out["churn_date"], notes = outcome(raw, dates, prediction)
        warnings += notes
    rows = raw.select("_row", *[c.alias(n) for n, c in out.items()])
    table = C.keep_first(rows, key, ["_row"]).drop("_row")
    warnings += _notes(raw, table, have, out)
    events = logs(raw, have, dates, key)
    for name, log in events.items():
        late = log.filter(F.col("event_date") >= F.lit(prediction)).count()
        if late:
            warnings.append(f"{name}: {late} events on or after {prediction}; feature windows leave them out")
    return Ingested(table, events, C.report(raw, parsed), warnings)


def _notes(raw: DataFrame, table: DataFrame, have: set[str], out: dict[str, Column]) -> list[str]:
    tests: dict[str, Column] = {}
    for m in MONEY:
        if m in have:
            tests[f"{m}: values with another currency's sign, read as euros"] = F.count_if(F.col(f"`{m}`").rlike(r"(?i)\$|USD|£|GBP"))
    if "participant_age" in have:
        n = C.number("participant_age")["value"]
        tests["participant_age: values outside 16 to 110 set to null"] = F.count_if((n < 16) | (n > 110))
    for c in ("c_service_contacts_12m", "complaints_12m"):
        if c in have:
            tests[f"{c}: values of {SENTINEL} or more, kept, may mean unknown"] = F.count_if(C.number(c)["value"] >= SENTINEL)
    found = raw.agg(*[t.alias(f"t{i}") for i, t in enumerate(tests.values())]).first() if tests else ()
    notes = [f"{found[i]} {name}" for i, name in enumerate(tests) if found[i]]
    if "campaign_cohort" in out and "treatment_sent_flag" in out:
        by = {r["campaign_cohort"]: r for r in compliance(table).collect()}
        sent = by.get("Control")
        if sent and sent["n_sent"]:
            notes.append(f"{sent['n_sent']} control rows were sent the treatment")
        low = [r["campaign_cohort"] for k, r in by.items() if k not in (None, "Control") and (r["share_sent"] or 0) < 0.95]
        if low:
            notes.append(f"not all of {sorted(low)} were sent the treatment; effects are of the assignment")
    if "customer_id" in out and (n := clustering(table).first()["n_multi"]):
        notes.append(f"{n} customers have more than one subscription; standard errors are optimistic")
    return notes


def compliance(table: DataFrame) -> DataFrame:
    """campaign_cohort, n, n_sent, share_sent."""
    return table.groupBy("campaign_cohort").agg(F.count(F.lit(1)).alias("n"), F.sum("treatment_sent_flag").cast("long").alias("n_sent"), F.avg("treatment_sent_flag").alias("share_sent"))


def clustering(table: DataFrame, key: str = "customer_id") -> DataFrame:
    return table.groupBy(key).agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_multi"), F.count(F.lit(1)).alias("n_customers"))


def logs(raw: DataFrame, have: set[str], dates: dict[str, Column], key: str) -> dict[str, DataFrame]:
    """Event logs from dated columns of each subscription's first row."""
    first = C.keep_first(raw, key, ["_row"])
    out = {}
    if "survey_date" in dates and "satisfaction_score" in have:
        out["survey_events"] = first.select(key, dates["survey_date"].alias("event_date"), C.number("satisfaction_score")["value"].alias("satisfaction_score"))
    if "last_contact_date" in dates:
        reason = C.category("last_contact_reason") if "last_contact_reason" in have else F.lit(None).cast("string")
        flags = [F.coalesce(reason.isin([k for k, v in CONTACTS.items() if v == flag]), F.lit(False)).cast("double").alias(flag) for flag in sorted(CONTACTS.values())]
        out["contact_events"] = first.select(key, dates["last_contact_date"].alias("event_date"), F.lit(1.0).alias("contact"), *flags)
    if "win_dates" in have:
        listed = first.select(key, F.explode(C.dates_in("win_dates")).alias("part"))
        order = C.day_first(listed, "part").first()["day_first"]
        out["win_events"] = listed.select(key, C.date("part", order).alias("event_date"), F.lit(1.0).alias("win"))
    if "service_tier_upgrade_date" in dates:
        out["upgrade_events"] = first.select(key, dates["service_tier_upgrade_date"].alias("event_date"), F.lit(1.0).alias("upgrade"))
    return {n: d.filter("event_date is not null") for n, d in out.items()}


def write(found: Ingested, folder: str, dry_run: bool = False) -> list[str]:
    """Tables as CSV folders; with dry_run nothing is written."""
    tables = {"subscriptions": found.subscriptions, **found.events, "ingest_report": found.report}
    if not dry_run:
        for name, df in tables.items():
            df.write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}.csv")
    return list(tables)
