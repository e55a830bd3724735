"""The four dates that bound what can be known, and the calendar of prediction dates."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, InsufficientDataError
from .spec import Spec

DAY = dt.timedelta(days=1)


@dataclass
class Timeline:
    observation_start: dt.date
    observation_end: dt.date
    data_export: dt.date
    feature_start: dt.date
    notes: list[str] = field(default_factory=list)


def bounds(entity: DataFrame, logs: dict[str, DataFrame], spec: Spec) -> DataFrame:
    """table, first, last: one row per table, from one aggregate each."""
    ends = [F.max(spec.event_column)] if spec.target_mode == "event_date" else []
    last = F.greatest(F.max(spec.start_column), *ends) if ends else F.max(spec.start_column)
    out = entity.agg(F.lit("entity").alias("table"), F.min(spec.start_column).alias("first"), last.alias("last"))
    for name, log in logs.items():
        date = spec.logs[name].date_column
        out = out.unionByName(log.agg(F.lit(name).alias("table"), F.min(date).alias("first"), F.max(date).alias("last")))
    return out


def resolve(entity: DataFrame, logs: dict[str, DataFrame], spec: Spec) -> Timeline:
    rows = {r["table"]: r for r in bounds(entity, logs, spec).collect()}
    if rows["entity"]["first"] is None:
        raise InsufficientDataError("the entity table has no row with a start date")
    notes = []
    export = spec.data_export or max(r["last"] for r in rows.values() if r["last"])
    end = spec.observation_end or export
    start = spec.observation_start or rows["entity"]["first"]
    if not spec.observation_end:
        notes.append("observation_end_date is not given; the end of the data is taken")
    if end > export:
        notes.append(f"observation_end_date {end} is after the export of {export}")
    first = spec.history_start or start
    known = [r["first"] for n, r in rows.items() if n != "entity" and r["first"]]
    if known and min(known) > first:
        notes.append(f"event logs begin on {min(known)}, after {first}: early windows are short")
    if start >= end:
        raise ConfigError(f"observation starts on {start}, not before its end on {end}")
    return Timeline(start, end, export, first, notes)


@dataclass
class Calendar:
    dates: list[dt.date]
    rejected: list[tuple[dt.date, str]]


def calendar(spec: Spec, timeline: Timeline) -> Calendar:
    """Prediction dates whose label window closes in time and whose feature windows are whole."""
    p = spec.panel
    horizon, embargo = int(p["horizon_days"]), int(p["embargo_days"])
    lead = spec.longest_window + embargo
    if p["snapshot_mode"] == "single":
        wanted = [pd.Timestamp(d).date() for d in p["snapshot_dates"] or []] or [timeline.observation_end - horizon * DAY]
    else:
        first = pd.Timestamp(p["snapshot_start"]) if p["snapshot_start"] else pd.Timestamp(timeline.feature_start + lead * DAY)
        last = pd.Timestamp(p["snapshot_end"]) if p["snapshot_end"] else pd.Timestamp(timeline.observation_end - horizon * DAY)
        if first > last:
            raise InsufficientDataError(f"no prediction date fits: the first would be {first.date()}, the last {last.date()}")
        wanted = [t.date() for t in pd.date_range(first.normalize(), last.normalize(), freq=p["snapshot_frequency"])] or [first.date()]
    kept, rejected = [], []
    for day in sorted(set(wanted)):
        if day + horizon * DAY > timeline.observation_end:
            rejected.append((day, "label window closes after the observation end"))
        elif day - lead * DAY < timeline.feature_start:
            rejected.append((day, "feature window opens before the history"))
        else:
            kept.append(day)
    if not kept:
        raise InsufficientDataError("every prediction date was rejected: " + "; ".join(f"{d} {why}" for d, why in rejected))
    return Calendar(kept, rejected)
