"""Reading a randomised experiment: who counts, whether the arms are comparable, and the lift."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi_square_tail, f_tail, normal_two_sided
from ..plans.spec import Spec, as_date
from ..plans.timeline import Timeline

COVARIATES = 10
SRM_LEVEL, BALANCE_LEVEL = 0.001, 0.01


@dataclass
class Report:
    enabled: bool
    results: list[dict] = field(default_factory=list)
    checks: list[dict] = field(default_factory=list)
    control: str = ""
    horizon: int = 0
    notes: list[str] = field(default_factory=list)

    @property
    def trustworthy(self) -> bool:
        return all(c["passed"] for c in self.checks)


def cohort(entity: DataFrame, variant: str, start: str, end: str | None, observation_end: dt.date, horizon: int, assigned: dt.date | None = None, opens: dt.date | None = None, closes: dt.date | None = None, label: str | None = None, churn_value=1) -> DataFrame:
    """entity with variant (as text), assigned, window_end, complete and churned; all eligible rows.

    With an assignment date, everyone active on it; else those who began between opens and closes,
    assigned when they began. `complete` tells whether the outcome window closes by the observation end.
    """
    rows = entity.filter(F.col(variant).isNotNull())
    if assigned is not None:
        rows = rows.filter(F.col(start) <= F.lit(assigned))
        if end:
            rows = rows.filter(F.col(end).isNull() | (F.col(end) > F.lit(assigned)))
        at = F.lit(assigned)
    else:
        if opens:
            rows = rows.filter(F.col(start) >= F.lit(opens))
        if closes:
            rows = rows.filter(F.col(start) <= F.lit(closes))
        at = F.col(start)
    until = F.date_add(at, horizon)
    if end:
        gone = F.col(end).isNotNull() & (F.col(end) > at) & (F.col(end) <= until)
    else:
        gone = F.coalesce(F.col(label).cast("string") == F.lit(str(churn_value)), F.lit(False))
    return rows.withColumns({"variant": F.col(variant).cast("string"), "assigned": at, "window_end": until, "complete": until <= F.lit(observation_end), "churned": gone.cast("int")})


def arms(rows: DataFrame) -> DataFrame:
    """variant, n, churned, rate."""
    return rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.sum("churned").cast("long").alias("churned"), F.avg("churned").alias("rate"))


def lift(control: dict, arm: dict) -> dict:
    """Difference in percentage points with its 95 % interval, from unpooled standard errors."""
    gap = arm["rate"] - control["rate"]
    se = math.sqrt(arm["rate"] * (1 - arm["rate"]) / max(arm["n"], 1) + control["rate"] * (1 - control["rate"]) / max(control["n"], 1))
    z = gap / se if se > 0 else 0.0
    return {"lift_pp": 100 * gap, "ci_low_pp": 100 * (gap - 1.96 * se), "ci_high_pp": 100 * (gap + 1.96 * se), "se_pp": 100 * se, "p_value": normal_two_sided(z)}


def sample_ratio(rows: list[dict]) -> dict:
    counts = [r["n"] for r in rows]
    even = sum(counts) / len(counts)
    statistic = sum((c - even) ** 2 / even for c in counts)
    p = chi_square_tail(statistic, len(counts) - 1)
    return {"check": "sample_ratio_mismatch", "statistic": statistic, "p_value": p, "passed": p >= SRM_LEVEL, "detail": str({r["variant"]: r["n"] for r in rows})}


def numeric_balance(rows: DataFrame, column: str) -> tuple[float, float, float] | None:
    """F statistic and degrees of freedom between variants, from counts, means and variances."""
    parts = rows.filter(F.col(column).isNotNull()).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(column).cast("double")).alias("m"), F.var_pop(F.col(column).cast("double")).alias("v")).filter("n > 5").collect()
    if len(parts) < 2:
        return None
    n = sum(r["n"] for r in parts)
    mean = sum(r["n"] * r["m"] for r in parts) / n
    between = sum(r["n"] * (r["m"] - mean) ** 2 for r in parts) / (len(parts) - 1)
    within = sum(r["n"] * r["v"] for r in parts) / (n - len(parts))
    return (between / within if within else math.inf, len(parts) - 1, n - len(parts))


def contingency(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy("variant", F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def chi_square(cells: list) -> tuple[float, int] | None:
    """Statistic of independence; a two by two table gets the continuity correction."""
    left, right = sorted({c["variant"] for c in cells}), sorted({c["value"] for c in cells})
    if len(right) < 2 or len(left) < 2:
        return None
    table = np.zeros((len(left), len(right)))
    for c in cells:
        table[left.index(c["variant"]), right.index(c["value"])] = c["n"]
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    gap = np.abs(table - expected)
    if table.shape == (2, 2):
        gap = gap - np.minimum(0.5, gap)
    return float((gap**2 / expected).sum()), (len(left) - 1) * (len(right) - 1)


def independence(rows: DataFrame, column: str) -> tuple[float, int] | None:
    """chi_square of the whole crosstab, by aggregates per value; only the totals reach the driver."""
    cells = contingency(rows, column)
    left = {r["variant"]: r["n"] for r in cells.groupBy("variant").agg(F.sum("n").alias("n")).collect()}
    total = sum(left.values())
    counts = {v: F.sum(F.when(F.col("variant") == v, F.col("n")).otherwise(0)).cast("double") for v in left}
    values = cells.groupBy("value").agg(F.sum("n").alias("of"), *[c.alias(f"o{i}") for i, c in enumerate(counts.values())])
    parts = F.lit(0.0)
    for i, n in enumerate(left.values()):
        expected = F.col("of") * F.lit(n / total)
        parts = parts + (F.col(f"o{i}") - expected) ** 2 / expected
    found = values.agg(F.count(F.lit(1)).alias("n"), F.sum(parts).alias("statistic")).first() if left else None
    if found is None or found["n"] < 2 or len(left) < 2:
        return None
    if found["n"] == len(left) == 2:
        return chi_square(cells.collect())
    return found["statistic"], (len(left) - 1) * (found["n"] - 1)


def balance(rows: DataFrame, columns: list[str]) -> list[dict]:
    out, types = [], dict(rows.dtypes)
    for column in columns[:COVARIATES]:
        if types[column] in ("string", "boolean", "date"):
            found = independence(rows, column)
            if found is None:
                continue
            statistic, p = found[0], chi_square_tail(*found)
        else:
            test = numeric_balance(rows, column)
            if test is None:
                continue
            statistic, p = test[0], f_tail(*test)
        out.append({"check": f"balance:{column}", "statistic": statistic, "p_value": p, "passed": p >= BALANCE_LEVEL, "detail": column})
    return out


def adjusted(rows: DataFrame, variant: str, control: str, columns: list[str], categories: bool = True) -> float | None:
    """Coefficient of the treatment in least squares with covariates; null numbers take the mean, null categories are a level.

    Every level of every category takes part. The category of most levels is absorbed by means within its levels,
    which is exact; the others give a column for each level but one. From one aggregate of cross products.
    """
    both = rows.filter(F.col("variant").isin(variant, control))
    types, parts, named = dict(rows.dtypes), [], []
    for c in columns:
        if types[c] not in ("string", "boolean"):
            parts.append(F.col(c).cast("double"))
        elif categories:
            named.append(c)
    levels = both.agg(F.count(F.lit(1)), *[F.count_distinct(F.struct(c)).alias(c) for c in named]).first().asDict()
    named = sorted((c for c in named if levels[c] > 1), key=lambda c: -levels[c])
    for c in named[1:]:
        values = sorted((r[c] for r in both.select(c).distinct().collect()), key=lambda v: (v is not None, str(v)))
        parts += [F.col(c).eqNullSafe(F.lit(v)).cast("double") for v in values[1:]]
    if not parts and not named:
        return None
    usable = []
    if parts:
        means = both.agg(*[F.avg(p).alias(f"m{i}") for i, p in enumerate(parts)], *[F.stddev_samp(p).alias(f"s{i}") for i, p in enumerate(parts)]).first()
        usable = [(F.coalesce(p, F.lit(means[f"m{i}"])) - F.lit(means[f"m{i}"])) / F.lit(means[f"s{i}"]) for i, p in enumerate(parts) if means[f"s{i}"]]
    if not usable and not named:
        return None
    x = [(F.col("variant") == variant).cast("double"), *usable, F.col("churned").cast("double")]
    k = len(x)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    level = F.col(named[0]) if named else F.lit(0)
    within = both.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i, j in pairs])
    row = within.agg(F.sum("n").alias("n"), *[F.sum(F.col(f"x{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")).alias(f"x{i}_{j}") for i, j in pairs]).first()
    cross = np.array([[row[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float) / row["n"]
    return float((np.linalg.pinv(cross[:-1, :-1], rcond=1e-10, hermitian=True) @ cross[:-1, -1])[0])


def run(spec: Spec, entity: DataFrame, timeline: Timeline) -> Report:
    own = spec.experiment
    if not own.get("enabled"):
        return Report(False, notes=["no experiment is configured"])
    variant = own.get("variant_column")
    if variant not in entity.columns:
        return Report(False, notes=[f"the entity table has no variant column {variant!r}"])
    horizon = int(own.get("horizon_days") or spec.panel["horizon_days"])
    assigned, opens, closes = (as_date(own.get(k), f"experiment.yaml: {k}") for k in ("assignment_date", "start_date", "end_date"))
    end = spec.event_column if spec.target_mode == "event_date" else None
    rows = cohort(entity, variant, spec.start_column, end, timeline.observation_end, horizon, assigned, opens, closes, spec.label_column, spec.churn_value)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("complete").alias("c")).first()
    if not counts["n"]:
        return Report(False, notes=["nobody is in the experiment's window; if all were assigned on one day, set assignment_date: start_date and end_date select by the start of the customer"])
    report = Report(True, horizon=horizon)
    if counts["c"] < counts["n"]:
        report.notes.append(f"{counts['n'] - counts['c']} customers without a complete outcome window are left out")
    if not counts["c"]:
        return Report(False, notes=[*report.notes, f"no customer has a complete window of {horizon} days yet"])
    rows = rows.filter("complete")
    by = {r["variant"]: r.asDict() for r in arms(rows).collect()}
    wanted = own.get("control_value")
    report.control = str(wanted) if wanted is not None and str(wanted) in by else min(by)
    checks = own.get("checks") or {}
    if checks.get("sample_ratio_mismatch", True):
        report.checks.append(sample_ratio(list(by.values())))
    covariates = [c for c in own.get("covariates") or [] if c in entity.columns]
    if checks.get("pre_period_balance", True):
        report.checks += balance(rows, covariates or [c for c in spec.segments if c in entity.columns])
    if not report.trustworthy:
        report.notes.append("randomisation checks failed: read the comparison as observational")
    base = by[report.control]
    report.results.append(dict(base))
    for name in sorted(set(by) - {report.control}):
        found = lift(base, by[name])
        change = adjusted(rows, name, report.control, covariates)
        report.results.append(by[name] | found | {"adjusted_lift_pp": None if change is None else 100 * change})
        if found["p_value"] >= float(own.get("alpha", 0.05)):
            report.notes.append(f"{name}: no significant difference; an effect below about {2.8 * found['se_pp']:.2f} points would not show")
    return report
