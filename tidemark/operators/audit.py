"""The leakage audit: findings about structure and statistics, and quarantine with lineage."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LeakageError
from ..plans.panel import ID, Panel
from ..plans.spec import Spec
from . import metrics, splits
from .features import Features, Meta, segments

BLOCK, WARN, INFO = "BLOCK", "WARN", "INFO"
LEVELS = (BLOCK, WARN, INFO)
#: A panel in label mode ends at the observation end by construction; the finding stays, but does not abort.
LABEL_MODE = "label mode"


@dataclass(frozen=True)
class Finding:
    level: str
    code: str
    message: str
    columns: tuple[str, ...] = ()
    evidence: tuple[tuple[str, object], ...] = ()
    remedy: str = ""


@dataclass
class Report:
    findings: list[Finding] = field(default_factory=list)
    quarantined: list[str] = field(default_factory=list)
    scan: DataFrame | None = None

    def add(self, level: str, code: str, message: str, columns=(), remedy: str = "", **evidence) -> None:
        self.findings.append(Finding(level, code, message, tuple(columns), tuple(evidence.items()), remedy))

    def ordered(self) -> list[Finding]:
        return sorted(self.findings, key=lambda f: (LEVELS.index(f.level), f.code))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(f.level, f.code, f.message, ", ".join(f.columns), "; ".join(f"{k}={v}" for k, v in f.evidence), f.remedy) for f in self.ordered()]
        return spark.createDataFrame(rows, "level string, code string, message string, columns string, evidence string, remedy string")

    def blocking(self) -> list[Finding]:
        return [f for f in self.findings if f.level == BLOCK and (LABEL_MODE, True) not in f.evidence]


def denied(names: list[str], patterns: list[str], allowed: list[str]) -> dict[str, str]:
    """Names of which the whole or a part matches a pattern, with the first such pattern; allowed names and parts are exempt."""
    rules, free = [re.compile(p, re.IGNORECASE) for p in patterns], {a.lower() for a in allowed}
    out = {}
    for name in names:
        parts = [name, *segments(name)]
        if free.isdisjoint(p.lower() for p in parts):
            hit = next((r.pattern for r in rules if any(map(r.search, parts))), None)
            if hit is not None:
                out[name] = hit
    return out


def structure(spec: Spec, panel: Panel, meta: dict[str, Meta], report: Report, truncated_share: float = 0.0) -> None:
    """Checks of names, windows and dates; no data are read."""
    names = list(meta)
    hits = denied(names, spec.options["leakage"]["denylist_patterns"], spec.options["leakage"]["allowlist_columns"] or [])
    if hits:
        report.add(BLOCK, "OUTCOME_DERIVED_FEATURE", "features named like the outcome or what follows it", sorted(hits), "allowlist those that are known at the prediction date", patterns=sorted(set(hits.values())))
    targets = {c for c in (spec.event_column, spec.label_column) if c}
    own = [n for n in names if "__" in n and targets & set(segments(n))]
    if own:
        report.add(BLOCK, "TARGET_COLUMN_AS_FEATURE", "the target column is a feature", own, "take it out of feature.yaml")
    if panel.embargo <= 0:
        strict = [n for n, m in meta.items() if m.review == "strict"]
        report.add(BLOCK if strict else WARN, "NO_EMBARGO", "features reach up to the prediction date, when a decision may already be taken", strict, "an embargo of 7 to 14 days", embargo_days=0)
    wide = [g.name for g in spec.groups if g.temporal == "time_varying" and max(g.windows, default=0) > 4 * panel.horizon]
    if wide:
        report.add(INFO, "LONG_FEATURE_WINDOW", "windows of more than four horizons: neighbouring dates share most of their history", wide)
    closes = max(panel.dates) + dt.timedelta(days=panel.horizon)
    end = panel.timeline.observation_end
    if closes > end:
        report.add(BLOCK, "CENSORED_AS_RETAINED", f"the last label window closes on {closes}, after the observation end {end}", overrun_days=(closes - end).days, **({LABEL_MODE: True} if spec.target_mode == "label" else {}))
    else:
        report.add(INFO, "CENSORING_HANDLED", f"every label window closes by {end}")
    if panel.truncated_dropped:
        report.add(INFO, "SURVIVORSHIP_HANDLED", "entities that began before the observation were dropped")
    elif truncated_share > 0:
        report.add(WARN, "SURVIVORSHIP_BIAS", "rows of entities that began before the observation: those who left early were never seen", remedy="left_truncation: drop", share_of_rows=round(truncated_share, 4))
    stale = sorted(n for n, m in meta.items() if not m.point_in_time)
    if stale:
        report.add(WARN, "NOT_POINT_IN_TIME", "features as of the export, not of the prediction date", stale, "an event log, or validity columns")


def scan(frame: DataFrame, meta: dict[str, Meta], label: str = "label") -> DataFrame:
    """One row per feature: feature, auc, auc_missing, n_unique, null_share, cardinality_ratio, n."""
    numeric = [n for n, m in meta.items() if m.kind == "numeric"]
    other = [n for n, m in meta.items() if m.kind != "numeric"]
    parts = []
    if numeric:
        parts.append(metrics.numeric_scan(frame, numeric, label))
    if other:
        parts.append(metrics.categorical_scan(frame, other, label, metrics.fold(F.struct(ID, "snapshot_date"), 5, 1)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def statistics(spec: Spec, frame: DataFrame, meta: dict[str, Meta], report: Report) -> None:
    kinds = frame.agg(F.count_distinct("label").alias("k")).first()["k"]
    if kinds < 2:
        report.add(BLOCK, "SINGLE_CLASS", "the label has one value only")
        return
    report.scan = scan(frame, meta)
    screened(spec, [r.asDict() for r in report.scan.collect()], meta, report)


def screened(spec: Spec, rows: list[dict], meta: dict[str, Meta], report: Report) -> None:
    """Findings from the scan's rows; a feature under strict review is blocked at the warning level."""
    limits = spec.options["leakage"]
    block, warn = float(limits["single_feature_auc_block"]), float(limits["single_feature_auc_warn"])

    def names(test) -> list[str]:
        return sorted(r["feature"] for r in rows if test(r))

    def blocked(r: dict) -> bool:
        return r["auc"] is not None and r["auc"] >= (warn if meta[r["feature"]].review == "strict" else block)

    if hit := names(blocked):
        report.add(BLOCK, "SINGLE_FEATURE_SEPARATION", "one feature alone tells the classes apart", hit, "look where it comes from")
    if hit := names(lambda r: r["auc"] is not None and r["auc"] >= warn and not blocked(r)):
        report.add(WARN, "STRONG_SINGLE_FEATURE", "one feature alone is very strong", hit)
    if hit := names(lambda r: r["auc_missing"] is not None and r["auc_missing"] >= float(limits["missingness_auc_warn"])):
        report.add(WARN, "MISSINGNESS_PREDICTS_TARGET", "whether the value is there predicts the outcome", hit)
    if hit := names(lambda r: r["n_unique"] == 0 or (r["n_unique"] <= 1 and r["null_share"] == 0)):
        report.add(INFO, "CONSTANT_FEATURE", "features without variation are dropped", hit)
    if hit := names(lambda r: r["cardinality_ratio"] >= float(limits["id_cardinality_ratio_warn"]) and r["n_unique"] > 50):
        report.add(WARN, "IDENTIFIER_LIKE_FEATURE", "nearly every value is its own: an identifier", hit)


def split_checks(split: splits.Split, report: Report) -> None:
    row = splits.spanning(split.frame).first()
    if row["n_both"]:
        share = row["n_both"] / row["n_test"]
        report.add(WARN if share >= 0.5 else INFO, "ENTITY_SPANS_SPLIT", "entities of the test side are in training too, on earlier dates", share=round(share, 4))


def model_checks(spec: Spec, cv_auc: float | None, holdout_auc: float | None, report: Report) -> None:
    if cv_auc is not None and holdout_auc is not None and (gap := cv_auc - holdout_auc) >= 0.10:
        report.add(BLOCK if gap >= 0.20 else WARN, "CV_HOLDOUT_GAP", "cross-validation promises more than the held-out dates keep", gap=round(gap, 4))
    if holdout_auc is not None and holdout_auc >= float(spec.options["leakage"]["model_auc_block"]):
        report.add(BLOCK, "MODEL_TOO_GOOD", "no honest model is that good", auc=round(holdout_auc, 4))
    elif holdout_auc is not None and holdout_auc >= 0.95:
        report.add(WARN, "MODEL_SUSPICIOUSLY_GOOD", "rarely is an honest model that good", auc=round(holdout_auc, 4))


def enforce(spec: Spec, features: Features, report: Report) -> Features:
    """Drop what blocking findings and constants name, and all that derives from it; or abort, under `fail`."""
    bad = {c for f in report.blocking() for c in f.columns if c in features.meta}
    bad |= {c for f in report.findings if f.code == "CONSTANT_FEATURE" for c in f.columns}
    if spec.options["leakage"]["on_block"] == "fail" and report.blocking():
        raise LeakageError("; ".join(f"{f.code}: {', '.join(f.columns) or f.message}" for f in report.blocking()))
    heirs = features.dependents(bad)
    if heirs:
        report.add(BLOCK, "DERIVED_FROM_BLOCKED_FEATURE", "features that derive from dropped ones", sorted(heirs))
    report.quarantined = sorted(bad | heirs)
    left = features.without(bad | heirs)
    if not left.meta:
        raise LeakageError("no feature is left after quarantine")
    return left
