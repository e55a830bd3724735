"""A made-up subscription business to try the engine on; like in shape, not in bits, to any other."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = dt.date(2022, 1, 1), dt.date(2025, 6, 30)
MONTHS = 42


def _u(seed: int, *keys: Column | str) -> Column:
    """Uniform in [0, 1) from a hash of the keys: the same however the rows are dealt."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def _pick(u: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def make(spark: SparkSession, customers: int = 3000, seed: int = 7) -> dict[str, DataFrame]:
    """customers, usage_events, billing_events, support_events."""
    c = spark.range(customers).withColumn("customer_id", F.format_string("C%06d", F.col("id")))
    c = c.withColumns({
        "signup_date": F.date_add(F.lit(START), F.floor(_u(seed, "id") * 1100).cast("int")),
        "birthyear": (F.lit(1945) + F.floor(_u(seed + 1, "id") * 60)).cast("int"),
        "gender": _pick(_u(seed + 2, "id"), ["f", "m", "x"]),
        "region": _pick(_u(seed + 3, "id"), ["north", "south", "east", "west"]),
        "acquisition_channel": _pick(_u(seed + 4, "id"), ["search", "social", "referral", "partner", "direct"]),
        "plan_tier": _pick(_u(seed + 5, "id"), ["basic", "standard", "premium"]),
        "contract_type": _pick(_u(seed + 6, "id"), ["monthly", "annual"]),
        "auto_renew": _u(seed + 7, "id") < 0.7,
        "payment_method": _pick(_u(seed + 8, "id"), ["card", "debit", "invoice", "wallet"]),
        "plan_change_count": F.floor(_u(seed + 9, "id") * 4).cast("int"),
        "prior_winback": _u(seed + 10, "id") < 0.1,
        "health": _u(seed + 11, "id"),
    })
    base = F.when(F.col("plan_tier") == "basic", 15.0).when(F.col("plan_tier") == "standard", 30.0).otherwise(60.0)
    trial = (F.col("signup_date") >= F.lit(dt.date(2024, 1, 1))) & (F.col("signup_date") <= F.lit(dt.date(2024, 9, 30)))
    c = c.withColumn("mrr", F.round(base * (0.8 + 0.4 * _u(seed + 12, "id")), 2)).withColumn("variant", F.when(trial, _pick(_u(seed + 13, "id"), ["control", "treatment"])))
    # The hazard of a month falls with health and with an annual contract, and less so with the treatment.
    hazard = 0.005 + 0.06 * (1 - F.col("health")) ** 2 * F.when(F.col("contract_type") == "annual", 0.6).otherwise(1.2) * F.when(F.col("variant") == "treatment", 0.8).otherwise(1.0)
    life = (F.ln(1 - _u(seed + 14, "id")) / F.ln(1 - hazard) * 30).cast("int") + 20
    ends = F.date_add("signup_date", life)
    c = c.withColumn("contract_end_date", F.when(ends <= F.lit(END), ends)).withColumn("tenure_days", F.datediff(F.coalesce("contract_end_date", F.lit(END)), "signup_date"))
    months = c.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(MONTHS - 1)))).withColumn("event_date", F.date_add(F.add_months("signup_date", F.col("m")), F.floor(_u(seed + 15, "id", "m") * 28).cast("int")))
    months = months.filter((F.col("event_date") < F.coalesce("contract_end_date", F.date_add(F.lit(END), 1))) & (F.col("event_date") <= F.lit(END)))
    left = F.coalesce(F.datediff("contract_end_date", "event_date"), F.lit(999))
    fading = F.when(left < 75, 0.45).otherwise(1.0)
    usage = months.select("customer_id", "event_date", F.date_sub("event_date", F.floor(_u(seed + 16, "id", "m") * 5).cast("int")).alias("last_active_date"), F.floor((4 + 20 * F.col("health") * _u(seed + 17, "id", "m")) * fading).cast("int").alias("sessions"), F.round(100 * F.col("health") * _u(seed + 18, "id", "m") * fading, 2).alias("usage_volume"), F.round(F.col("mrr") * (0.5 + _u(seed + 19, "id", "m")) * fading, 2).alias("spend"))
    failed = _u(seed + 20, "id", "m") < F.when(left < 75, 0.25).otherwise(0.04)
    billing = months.select("customer_id", "event_date", F.when(_u(seed + 21, "id", "m") < 0.02, None).when(failed, "failed").otherwise("paid").alias("status"), F.when(_u(seed + 21, "id", "m") >= 0.02, F.col("mrr")).alias("amount"), failed.cast("int").alias("failed_payments"), F.when(failed, F.floor(_u(seed + 22, "id", "m") * 30)).otherwise(0).cast("int").alias("days_past_due"))
    support = months.filter(_u(seed + 23, "id", "m") < F.when(left < 75, 0.35).otherwise(0.12)).select("customer_id", "event_date", _pick(_u(seed + 24, "id", "m"), ["phone", "email", "chat"]).alias("channel"), F.lit(1).alias("ticket_count"), (_u(seed + 25, "id", "m") < F.when(left < 75, 0.6).otherwise(0.2)).cast("int").alias("complaints"), F.floor(_u(seed + 26, "id", "m") * 11 * (0.5 + F.col("health") / 2)).cast("int").alias("nps"))
    return {"customers": c.drop("id", "health"), "usage_events": usage, "billing_events": billing, "support_events": support}


def write(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}.parquet")
