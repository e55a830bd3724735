"""The stages in order, each on the lazy results of those before."""

from __future__ import annotations

import contextlib
import logging
import time as clock
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LeakageError
from ..operators import audit, causal, drivers, experiment, features, metrics, modeling, splits, survival
from ..sources import readers
from . import panel as panels
from . import timeline as time
from .spec import Spec

log = logging.getLogger("tidemark")


@contextlib.contextmanager
def stage(title: str) -> Iterator[None]:
    """A banner, and how long the stage took on the driver; plans that are read later take their time there."""
    log.info("── %s %s", title, "─" * max(0, 60 - len(title)))
    began = clock.perf_counter()
    yield
    log.info("   %s: %.1f s", title, clock.perf_counter() - began)


@dataclass
class Run:
    spark: SparkSession
    summary: dict[str, Any] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    report: audit.Report = field(default_factory=audit.Report)
    by_date: DataFrame | None = None
    dictionary: DataFrame | None = None
    fitted: modeling.Fitted | None = None
    calibration: DataFrame | None = None
    deciles: DataFrame | None = None
    drivers: DataFrame | None = None
    profiles: DataFrame | None = None
    effects: list[causal.Effect] = field(default_factory=list)
    experiment: experiment.Report | None = None
    curve: DataFrame | None = None
    strata: dict[str, DataFrame] = field(default_factory=dict)
    logrank: list[dict] = field(default_factory=list)
    cox: survival.CoxFit | None = None

    def tables(self) -> dict[str, DataFrame | list[dict] | None]:
        return {
            "leakage_findings": self.report.table(self.spark) if self.report.findings else None,
            "leakage_scan": self.report.scan,
            "feature_dictionary": self.dictionary,
            "panel_by_snapshot": self.by_date,
            "risk_drivers": self.drivers,
            "risk_scores_holdout": self.fitted.scored.select("entity_id", "snapshot_date", "label", "score") if self.fitted else None,
            "cv_metrics": self.fitted.cv if self.fitted else None,
            "survival_curve": self.curve,
            "survival_logrank": self.logrank,
            "survival_cox": self.cox.table() if self.cox else None,
            "causal_effects": [{"treatment": e.treatment, "verdict": e.verdict, "n": e.n, "ate": e.ate, "se": e.se, "p_value": e.p_value, "naive": e.naive, "overlap": e.overlap, "max_smd": e.max_smd} for e in self.effects],
            "experiment_results": self.experiment.results if self.experiment else None,
        }


def run(spark: SparkSession, spec: Spec, tables: dict[str, DataFrame] | None = None) -> Run:
    """tables: `entity` and the event logs, where these are not to be read from the paths of the specification."""
    out = Run(spark)
    seed = int(spec.options["run"]["random_seed"])
    model_options = spec.options["model"]
    with stage("Data"):
        data = readers.dataset(spark, spec, tables=tables)
        when = time.resolve(data.entity, data.events, spec)
        days = time.calendar(spec, when)
        entity = readers.current(data.entity, spec)
    with stage("Panel"):
        panel = panels.build(entity, spec, when, days.dates)
        about = panels.summary(panel)
        out.by_date = panels.by_date(panel.frame)
        out.notes += [*data.notes, *when.notes, *panel.notes, *(f"{d} is left out: {why}" for d, why in days.rejected)]
        log.info("panel: %s rows, %s entities", about["rows"], about["entities"])
    with stage("Features"):
        made = features.build(panel.frame, data.entity, data.events, spec, days.dates)
        made.frame = made.frame.cache()
        log.info("%s features, %s columns skipped", len(made.meta), len(made.skipped))
    with stage("Leakage audit"):
        share = panel.frame.selectExpr("avg(cast(left_truncated as int)) as s").first()["s"] or 0.0
        audit.structure(spec, panel, made.meta, out.report, share)
        audit.statistics(spec, made.frame, made.meta, out.report)
        kept = audit.enforce(spec, made, out.report)
        out.dictionary = made.dictionary(spark, set(kept.meta))
        out.notes += [*made.notes, *(f"{s['group']}.{s['column']}: {s['reason']}" for s in made.skipped)]
        log.info("%s findings, %s features kept", len(out.report.findings), len(kept.meta))
    with stage("Model"):
        split = splits.checked(splits.make(kept.frame, days.dates, spec.options["split"], panel.horizon, seed))
        audit.split_checks(split, out.report)
        train, test = split.frame.filter("split = 'train'").drop("split"), split.frame.filter("split = 'test'").drop("split")
        folds = int(spec.options["split"]["cv_folds"])
        out.fitted = modeling.fit(train, test, kept.meta, model_options, folds, seed)
        out.notes += [*split.notes, *out.fitted.notes]
        out.calibration = metrics.calibration(out.fitted.scored, "score", "label")
        out.deciles = metrics.lift_deciles(out.fitted.scored, "score", "label", [panels.ID, panels.AT])
        aucs = [c["auc"] for c in out.fitted.cv if c["auc"] is not None]
        cv = sum(aucs) / len(aucs) if aucs else None
        audit.model_checks(spec, cv, out.fitted.metrics["auc"], out.report)
        if spec.options["leakage"]["on_block"] == "fail" and out.report.blocking():
            raise LeakageError("; ".join(f"{f.code}: {f.message}" for f in out.report.blocking()))
        log.info("area under the curve: %s held out, %s by folds", out.fitted.metrics["auc"], cv)
    with stage("Drivers"):
        o = spec.options["drivers"]
        importance, how = drivers.importances(o["method"], out.fitted.model, test, kept.meta, int(o["n_permutation_repeats"]), seed)
        out.notes.append(f"importance of drivers: {how}")
        stable = drivers.stability(train, kept.meta, model_options, folds, seed, int(o["top_k"]))
        out.drivers = drivers.table(importance, test, kept.meta, stable, float(o["min_stability"])).filter(f"rank <= {int(o['top_k'])}").cache()
        out.profiles = drivers.profiles(test, kept.meta, sorted(importance, key=lambda n: (-importance[n], n)))
    if spec.options["causal"]["enabled"]:
        with stage("Effects"):
            for treatment in spec.causal.get("treatments") or []:
                out.effects.append(causal.run(kept, treatment, spec.causal, model_options, seed))
                log.info("%s: %s", out.effects[-1].treatment, out.effects[-1].verdict)
    with stage("Experiment"):
        out.experiment = experiment.run(spec, entity, when)
        out.notes += out.experiment.notes
    with stage("Survival"):
        _survival(out, spec, entity, when)
    found = {"auc": out.fitted.metrics["auc"], "baseline_auc": out.fitted.baseline["auc"], "cv_auc": cv, "features": len(made.meta), "features_kept": len(kept.meta)}
    ends = {"cutoff": str(split.cutoff), "blocking_findings": len(out.report.blocking()), "observation_end": str(when.observation_end)}
    out.summary = about | found | ends
    made.frame.unpersist()
    return out


def _survival(out: Run, spec: Spec, entity: DataFrame, when: time.Timeline) -> None:
    o = spec.options["survival"]
    if not o["enabled"] or spec.target_mode != "event_date":
        return
    static = [c for g in spec.groups if g.temporal == "static" for c in g.columns if c.name in entity.columns and c.type in ("numeric", "categorical")]
    strata = [s for s in ([o["by"]] if isinstance(o["by"], str) else o["by"] or spec.segments) if s in entity.columns]
    keep = tuple(dict.fromkeys([*strata, *(c.name for c in static)]))
    frame = panels.survival(entity, spec, when, keep).cache()
    out.curve = survival.kaplan_meier(frame)
    for s in strata:
        out.strata[s] = survival.stratified(frame, s, int(o["max_strata"]))
        large = frame.join(F.broadcast(survival.large_strata(frame, s, most=int(o["max_strata"])).select(s)), s)  # at most max_strata rows
        if test := survival.logrank(large, s):
            out.logrank.append({"column": s, "statistic": test.statistic, "df": test.df, "p_value": test.p_value, "significant": test.p_value < 0.05})
    if o["cox"] and static:
        ready = survival.design(frame, [c.name for c in static if c.type == "numeric"], [c.name for c in static if c.type == "categorical"])
        if ready.names:
            ready.frame = ready.frame.cache()
            out.cox = survival.cox(ready, 0.1)
            bad = [r["covariate"] for r in survival.proportionality(ready, out.cox) if not r["proportional"]]
            if bad:
                out.notes.append(f"hazards are not proportional in {bad}")
