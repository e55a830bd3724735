"""The panel: one row per entity and prediction date at which it was at risk."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataError, InsufficientDataError
from .spec import Spec
from .timeline import Timeline

ID, AT, END = "entity_id", "snapshot_date", "feature_end"


@dataclass
class Panel:
    frame: DataFrame
    dates: list[dt.date]
    timeline: Timeline
    horizon: int
    embargo: int
    truncated_dropped: bool = False
    notes: list[str] = field(default_factory=list)


def dates_array(dates: list[dt.date]) -> Column:
    return F.array(*[F.lit(d) for d in sorted(dates)])


def base(entity: DataFrame, spec: Spec, timeline: Timeline, keep: tuple[str, ...] = ()) -> DataFrame:
    """entity_id, start_date, end_date (moved forward by the decision lead), left_truncated."""
    if spec.target_mode == "event_date":
        end = F.date_sub(F.col(spec.event_column), spec.decision_lead_days)
    else:
        end = F.lit(None).cast("date")
    out = entity.select(F.col(spec.id_column).alias(ID), F.col(spec.start_column).alias("start_date"), end.alias("end_date"), *keep)
    out = out.withColumn("left_truncated", F.col("start_date") < F.lit(timeline.observation_start))
    return out.filter("not left_truncated") if spec.left_truncation == "drop" else out


def at_risk(people: DataFrame, dates: list[dt.date], horizon: int, embargo: int, min_tenure: int = 0) -> DataFrame:
    """Each entity with the dates at which it had begun and not yet ended; label: ended within the horizon.

    The dates are an array in the plan: each row keeps those that fit and is exploded once. No join, no loop.
    """
    fits = F.filter(dates_array(dates), lambda t: (F.col("start_date") <= F.date_sub(t, min_tenure)) & (F.col("end_date").isNull() | (F.col("end_date") > t)))
    out = people.withColumn(AT, F.explode(fits))
    label = F.col("end_date").isNotNull() & (F.col("end_date") <= F.date_add(AT, horizon))
    return out.withColumns({"label": label.cast("int"), "tenure_days": F.datediff(AT, "start_date"), END: F.date_sub(AT, embargo)}).drop("end_date")


def labelled(people: DataFrame, entity: DataFrame, spec: Spec, timeline: Timeline, embargo: int) -> DataFrame:
    """Label mode: one cross-section at the observation end; a missing label is 0."""
    value = F.coalesce(F.col(spec.label_column).cast("string") == F.lit(str(spec.churn_value)), F.lit(False)).cast("int")
    flags = entity.select(F.col(spec.id_column).alias(ID), value.alias("label"))
    at = F.lit(timeline.observation_end)
    out = people.drop("end_date").join(flags, ID, "left")
    return out.withColumns({AT: at, "label": F.coalesce("label", F.lit(0)), "tenure_days": F.datediff(at, "start_date"), END: F.date_sub(at, embargo)})


def capped(frame: DataFrame, per_entity: int, seed: int) -> DataFrame:
    """At most so many dates of each entity, drawn by a hash. This is the configured max_snapshots_per_entity."""
    order = Window.partitionBy(ID).orderBy(F.xxhash64(ID, AT, F.lit(seed)), AT)
    return frame.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_entity).drop("_n")


def build(entity: DataFrame, spec: Spec, timeline: Timeline, dates: list[dt.date]) -> Panel:
    p = spec.panel
    horizon, embargo = int(p["horizon_days"]), int(p["embargo_days"])
    people = base(entity, spec, timeline)
    notes = []
    if spec.left_truncation == "drop" and people.limit(1).count() == 0:
        raise DataError("every entity began before observation_starting_date; keep_flagged would keep them")
    if spec.target_mode == "label":
        return Panel(labelled(people, entity, spec, timeline, embargo), [timeline.observation_end], timeline, horizon, embargo, spec.left_truncation == "drop", notes)
    frame = at_risk(people, dates, horizon, embargo, int(p["min_tenure_days"] or 0))
    if p["max_snapshots_per_entity"]:
        frame = capped(frame, int(p["max_snapshots_per_entity"]), int(spec.options["run"]["random_seed"]))
    return Panel(frame, dates, timeline, horizon, embargo, spec.left_truncation == "drop", notes)


def by_date(frame: DataFrame) -> DataFrame:
    """Rows at risk and ended per date; of the panel before any cap."""
    return frame.groupBy(AT).agg(F.count(F.lit(1)).alias("n_at_risk"), F.sum("label").alias("n_churned"), F.avg("label").alias("churn_rate"))


def summary(panel: Panel) -> dict:
    row = panel.frame.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(ID).alias("entities"), F.sum("label").alias("events"), F.avg("label").alias("rate")).first().asDict()
    if not row["rows"]:
        raise InsufficientDataError("the panel is empty: nobody was at risk on any prediction date")
    if row["events"] < 50:
        panel.notes.append(f"only {row['events']} events; estimates will be unstable")
    rates = [r["churn_rate"] for r in by_date(panel.frame).collect() if r["churn_rate"]]
    if rates and max(rates) > 3 * min(rates):
        panel.notes.append("the event rate more than triples between dates")
    return row


def survival(entity: DataFrame, spec: Spec, timeline: Timeline, keep: tuple[str, ...] = ()) -> DataFrame:
    """entity_id, duration_days, event, start_date, left_truncated, entry_days; those who left before they were seen go."""
    out = base(entity, spec, timeline, keep)
    event = F.col("end_date").isNotNull() & (F.col("end_date") <= F.lit(timeline.observation_end))
    until = F.when(event, F.col("end_date")).otherwise(F.lit(timeline.observation_end))
    late = F.greatest(F.lit(0), F.datediff(F.lit(timeline.observation_start), "start_date")) if spec.left_truncation == "keep_flagged" else F.lit(0)
    out = out.withColumns({"event": event.cast("int"), "duration_days": F.datediff(until, "start_date"), "entry_days": late})
    return out.filter("duration_days > entry_days").select(ID, "duration_days", "event", "start_date", "left_truncated", "entry_days", *keep)
