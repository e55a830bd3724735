"""Survival curves, their comparison, and proportional hazards, from counts per day of duration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi_square_tail, normal_two_sided

LEVELS = 8


def risk_table(frame: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, t, events, n_at_risk (durations of t or more, entered before t), at each time with an event.

    Counts per day of entering and leaving come first; cumulative sums run over days, not people.
    """
    by = by or []
    enter = F.struct(F.col("entry_days").cast("long").alias("t"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0).alias("d"))
    leave = F.struct(F.col("duration_days").cast("long").alias("t"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.col("event").cast("int").alias("d"))
    moves = frame.select(*by, F.explode(F.array(enter, leave)).alias("m"))
    days = moves.groupBy(*by, F.col("m.t").alias("t")).agg(F.sum("m.i").alias("i"), F.sum("m.o").alias("o"), F.sum("m.d").alias("events"))
    before = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("i").over(before), F.lit(0)) - F.coalesce(F.sum("o").over(before), F.lit(0))
    return days.withColumn("n_at_risk", at).filter("events > 0").select(*by, "t", "events", "n_at_risk")


def kaplan_meier(frame: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, t, events, n_at_risk, survival, se, ci_low, ci_high."""
    by = by or []
    run = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    d, n = F.col("events"), F.col("n_at_risk")
    out = risk_table(frame, by).withColumn("survival", F.product(1 - d / n).over(run))
    out = out.withColumn("se", F.col("survival") * F.sqrt(F.sum(d / (n * F.greatest(n - d, F.lit(1)))).over(run)))
    half = 1.96 * F.col("se")
    return out.withColumns({"ci_low": F.greatest(F.lit(0.0), F.col("survival") - half), "ci_high": F.least(F.lit(1.0), F.col("survival") + half)})


def median_lifetime(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, median_days: the first time at which survival is a half or less; null if it stays above."""
    return curve.groupBy(*(by or [])).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median_days"))


def large_strata(frame: DataFrame, stratum: str, least: int = 30, most: int = LEVELS) -> DataFrame:
    """stratum, n: the largest groups of at least `least`, `most` of them, as configured by max_strata."""
    sizes = frame.filter(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    return sizes.filter(F.col("n") >= least).orderBy(F.col("n").desc(), stratum).limit(most)


def stratified(frame: DataFrame, stratum: str, most: int = LEVELS) -> DataFrame:
    kept = frame.join(F.broadcast(large_strata(frame, stratum, most=most).select(stratum)), stratum)  # at most max_strata rows
    return kaplan_meier(kept, [stratum])


def logrank_table(frame: DataFrame, group: str) -> DataFrame:
    """t, group, d, n (of the group), all_d, all_n, expected: the pieces of the log-rank test; entry times are not used."""
    plain = frame.withColumn("entry_days", F.lit(-1))
    groups = plain.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    days = plain.groupBy(group, F.col("duration_days").alias("t")).agg(F.sum("event").alias("d"), F.count(F.lit(1)).alias("c"))
    times = days.groupBy("t").agg(F.sum("d").alias("all_d"), F.sum("c").alias("all_c"))
    down = Window.orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    times = times.withColumn("all_n", F.sum("all_c").over(down)).filter("all_d > 0")
    # Every event time with every group: as many rows as days times groups, both small and known.
    grid = times.join(F.broadcast(groups.select(group)), how="inner")
    own = Window.partitionBy(group).orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.select("t", group).unionByName(days.select("t", group)).distinct().join(days, ["t", group], "left")
    filled = filled.withColumns({"d": F.coalesce("d", F.lit(0)), "n": F.sum(F.coalesce("c", F.lit(0))).over(own)})
    expected = F.col("all_d") * F.col("n") / F.col("all_n")
    return filled.join(times.select("t", "all_d", "all_n"), "t").select("t", group, "d", "n", "all_d", "all_n", expected.alias("expected"))


@dataclass
class LogRank:
    statistic: float
    df: int
    p_value: float


def logrank(frame: DataFrame, group: str) -> LogRank | None:
    rows = logrank_table(frame, group).collect()  # days x groups
    names = sorted({r[group] for r in rows}, key=str)
    if len(names) < 2:
        return None
    place = {g: i for i, g in enumerate(names)}
    gap, cov = np.zeros(len(names)), np.zeros((len(names), len(names)))
    at: dict = {}
    for r in rows:
        gap[place[r[group]]] += r["d"] - r["expected"]
        at.setdefault(r["t"], [np.zeros(len(names)), r["all_d"], r["all_n"]])[0][place[r[group]]] = r["n"]
    for n, d, total in at.values():
        if total > 1:
            share = n / total
            cov += d * (total - d) / (total - 1) * (np.diag(share) - np.outer(share, share))
    z = float(gap[:-1] @ np.linalg.pinv(cov[:-1, :-1]) @ gap[:-1])
    return LogRank(z, len(names) - 1, chi_square_tail(z, len(names) - 1))


@dataclass
class CoxFit:
    """beta and its errors are per standard deviation, as fitted; coefficients and errors are per unit of the covariate."""

    names: list[str]
    beta: np.ndarray
    beta_errors: np.ndarray
    scales: np.ndarray
    concordance: float
    n: int
    events: int

    @property
    def coefficients(self) -> np.ndarray:
        return self.beta / self.scales

    @property
    def errors(self) -> np.ndarray:
        return self.beta_errors / self.scales

    def table(self) -> list[dict]:
        out = []
        for n, b, s in zip(self.names, self.coefficients, self.errors, strict=True):
            low, high = np.exp(b - 1.96 * s), np.exp(b + 1.96 * s)
            p = normal_two_sided(b / s) if s > 0 else float("nan")
            out.append({"covariate": n, "coef": float(b), "hazard_ratio": float(np.exp(b)), "se": float(s), "ci_low": float(low), "ci_high": float(high), "p_value": p})
        return out


@dataclass
class Design:
    """frame: with an array x of standardised covariates; names and scales (standard deviations) of these."""

    frame: DataFrame
    names: list[str]
    scales: np.ndarray


def design(frame: DataFrame, numeric: list[str], categorical: list[str], levels: int = LEVELS) -> Design:
    """Numbers, and 0/1 columns of the commonest levels but the first, all standardised; rows with nulls and constant columns go."""
    rows = frame.dropna(subset=[*numeric, *categorical])
    columns: dict[str, Column] = {c: F.col(c).cast("double") for c in numeric}
    for c in categorical:
        counts = rows.groupBy(c).count().orderBy(F.col("count").desc(), c).limit(levels + 1).collect()
        top = [r[c] for r in counts[:levels]]
        value = F.when(F.col(c).isin(top), F.col(c).cast("string")).otherwise("__other__")
        for level in sorted([*map(str, top), *(["__other__"] if len(counts) > levels else [])])[1:]:
            columns[f"{c}={level}"] = (value == level).cast("double")
    if columns:
        parts = [(F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")) for i, x in enumerate(columns.values())]
        stats = rows.agg(*[a for both in parts for a in both]).first()
    kept = {n: (x, stats[f"m{i}"], stats[f"s{i}"]) for i, (n, x) in enumerate(columns.items()) if stats[f"s{i}"]}
    x = F.array(*[(x - F.lit(float(m))) / F.lit(float(s)) for x, m, s in kept.values()]) if kept else F.array().cast("array<double>")
    return Design(rows.withColumn("x", x), list(kept), np.array([s for _, _, s in kept.values()]))


@dataclass
class _Day:
    """What one day adds: sums of w, w x, w x x' with w = exp(beta x), of all rows and of those with the event; and the events' number and sum of x."""

    all: tuple
    died: tuple
    deaths: int
    x: np.ndarray


def _sums(rows: DataFrame, beta: np.ndarray, day: str) -> dict[int, _Day]:
    """One aggregate; rows on the driver are days."""
    p = len(beta)
    eta = sum((F.lit(float(b)) * F.col("x")[i] for i, b in enumerate(beta)), F.lit(0.0))
    source = rows.select(F.col(day).alias("t"), F.exp(eta).alias("w"), "x", (F.col("event") == 1).alias("e"))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    parts = [F.count_if("e").alias("deaths"), *[F.sum(F.when(F.col("e"), F.col("x")[i])).alias(f"x{i}") for i in range(p)]]
    for kind, w in (("a", F.col("w")), ("d", F.when(F.col("e"), F.col("w")))):
        parts.append(F.sum(w).alias(f"{kind}w"))
        parts += [F.sum(w * F.col("x")[i]).alias(f"{kind}{i}") for i in range(p)]
        parts += [F.sum(w * F.col("x")[i] * F.col("x")[j]).alias(f"{kind}{i}_{j}") for i, j in pairs]

    def moments(r, kind: str) -> tuple:
        second = np.zeros((p, p))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"{kind}{i}_{j}"] or 0.0
        return r[f"{kind}w"] or 0.0, np.array([r[f"{kind}{i}"] or 0.0 for i in range(p)]), second

    return {r["t"]: _Day(moments(r, "a"), moments(r, "d"), r["deaths"], np.array([r[f"x{i}"] or 0.0 for i in range(p)])) for r in source.groupBy("t").agg(*parts).collect()}


def _tied(c: int, w: float, dw: float, block: int = 1 << 20) -> np.ndarray:
    """Sums over k < c of s^a / z^b for (a, b) in (0,1) (1,1) (0,2) (1,2) (2,2), with s = k / c and z = w - s dw; in blocks, so memory is bounded."""
    out = np.zeros(5)
    for at in range(0, c, block):
        s = np.arange(at, min(c, at + block)) / c
        z = w - s * dw
        out += [(1 / z).sum(), (s / z).sum(), (1 / z**2).sum(), (s / z**2).sum(), (s**2 / z**2).sum()]
    return out


def cox(made: Design, penalty: float = 0.1, rounds: int = 25) -> CoxFit:
    """Newton steps of the partial likelihood with ties after Efron and a ridge of penalty per row; delayed entry is honoured.

    made.frame: duration_days, event, entry_days, x. Each round reads one row per day of leaving and of entering.
    """
    frame, p = made.frame, len(made.names)
    totals = frame.agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("e"), F.max("entry_days").alias("late")).first()
    n, events = totals["n"], int(totals["e"] or 0)
    beta, information = np.zeros(p), np.eye(p)
    for _ in range(rounds):
        leave = _sums(frame, beta, "duration_days")
        enter = _sums(frame.filter("entry_days > 0"), beta, "entry_days") if (totals["late"] or 0) > 0 else {}
        gradient, information = np.zeros(p), np.zeros((p, p))
        w, a, b = 0.0, np.zeros(p), np.zeros((p, p))
        for t, kind in sorted([(t, 1) for t in leave] + [(t, 0) for t in enter], key=lambda x: (-x[0], x[1])):
            # Going down in time: those entering at t or later were not yet at risk at t.
            own, sign = (enter[t], -1.0) if kind == 0 else (leave[t], 1.0)
            w, a, b = w + sign * own.all[0], a + sign * own.all[1], b + sign * own.all[2]
            if kind == 1 and own.deaths:
                dw, da, db = own.died
                z1, s1, z2, s2, ss2 = _tied(own.deaths, w, dw)
                gradient += own.x - a * z1 + da * s1
                information += b * z1 - db * s1
                information -= np.outer(a, a) * z2 - (np.outer(a, da) + np.outer(da, a)) * s2 + np.outer(da, da) * ss2
        gradient -= penalty * n * beta
        information += penalty * n * np.eye(p)
        step = np.linalg.solve(information, gradient) if p else np.zeros(0)
        beta = beta + step
        if p == 0 or np.abs(step).max() < 1e-7:
            break
    errors = np.sqrt(np.diag(np.linalg.inv(information))) if p else np.zeros(0)
    return CoxFit(made.names, beta, errors, made.scales, concordance(frame, beta), n, events)


def concordance(frame: DataFrame, beta: np.ndarray, parts: int = 200) -> float:
    """Share of comparable pairs in which the shorter life had the higher risk; risks in `parts` quantile bins, so ties count half.

    From counts per day and risk bin: at most days x parts rows reach the driver.
    """
    eta = sum((F.lit(float(b)) * F.col("x")[i] for i, b in enumerate(beta)), F.lit(0.0))
    rows = frame.select("duration_days", "event", eta.alias("r"))
    cuts = sorted(set(rows.agg(F.percentile_approx("r", [i / parts for i in range(1, parts)], 10 * parts).alias("q")).first()["q"] or []))
    bins = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("r"))) if cuts else F.lit(0)
    counts = rows.groupBy("duration_days", bins.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.sum("event").alias("d")).collect()
    by: dict = {}
    for r in counts:
        by.setdefault(r["duration_days"], []).append((r["b"], r["c"], r["d"]))
    after, good, pairs = np.zeros(len(cuts) + 1), 0.0, 0.0
    for t in sorted(by, reverse=True):
        for b, _, d in by[t]:
            good += d * (after[:b].sum() + after[b] / 2)
            pairs += d * after.sum()
        for b, c, _ in by[t]:
            after[b] += c
    return good / pairs if pairs else 0.5


def proportionality(made: Design, fit: CoxFit) -> list[dict]:
    """For each covariate, the correlation of its Schoenfeld residuals with the rank of time; p below 0.01 speaks against proportional hazards."""
    leave = _sums(made.frame, fit.beta, "duration_days")
    w, a = 0.0, np.zeros(len(fit.names))
    residuals, counts = [], []
    for t in sorted(leave, reverse=True):
        own = leave[t]
        w, a = w + own.all[0], a + own.all[1]
        if own.deaths:
            residuals.append(own.x - own.deaths * a / w)
            counts.append(own.deaths)
    if len(residuals) < 3:
        return []
    r, c = np.array(residuals[::-1]), np.array(counts[::-1], float)
    rank = np.cumsum(c) - (c - 1) / 2
    rank = rank - (rank * c).sum() / c.sum()
    out = []
    for i, name in enumerate(fit.names):
        spread = np.sqrt(((r[:, i] ** 2) / c).sum() / c.sum() * (c * rank**2).sum())
        z = float((r[:, i] * rank).sum() / spread) if spread > 0 else 0.0
        p = chi_square_tail(z * z, 1)
        out.append({"covariate": name, "statistic": z * z, "p_value": p, "proportional": p >= 0.01})
    return out
