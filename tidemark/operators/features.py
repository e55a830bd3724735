"""Point-in-time features: event windows, entity attributes, versions in force, derived expressions.

Events are combined by entity and day. Each day is sent to the dates whose look-back window it falls
in, by an array of dates in the plan; then one grouped pass per event log computes every filter,
window and aggregate as a guarded expression. Features are keyed by entity and date, never by position.
"""

from __future__ import annotations

import datetime as dt
import functools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.ast_columns import expression, finite, predicate
from ..plans.panel import AT, END, ID, dates_array
from ..plans.spec import Group, Spec
from . import aggregates

KEYS = [ID, AT]
#: Beyond so many aggregates, generated code of one pass outgrows a method; passes are then joined.
PASS = 100
WIDE = 500
RECOMPUTED = ("tenure_days", "recency_days")
LAST_SEEN = ("last_active_date", "last_seen_date", "last_login_date")

# Texts read as true and false.
TRUE = ["true", "yes", "1", "y", "t"]
FALSE = ["false", "no", "0", "n", "f"]


@dataclass(frozen=True)
class Meta:
    """What is known of a feature besides its values."""

    name: str
    group: str
    source: str
    kind: str
    temporal: str
    window_days: int | None
    review: str
    derivation: str
    point_in_time: bool
    depends_on: tuple[str, ...] = ()


@dataclass
class Features:
    frame: DataFrame
    meta: dict[str, Meta]
    skipped: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def names(self, kind: str | None = None) -> list[str]:
        return [n for n, m in self.meta.items() if kind in (None, m.kind)]

    def dependents(self, names: set[str]) -> set[str]:
        """Features that derive from any of names, directly or not; not names themselves."""
        found = set(names)
        while more := {n for n, m in self.meta.items() if n not in found and found & set(m.depends_on)}:
            found |= more
        return found - set(names)

    def without(self, names: set[str]) -> Features:
        gone = [n for n in names if n in self.meta]
        return Features(self.frame.drop(*gone), {n: m for n, m in self.meta.items() if n not in names}, self.skipped, self.notes)

    def dictionary(self, spark: SparkSession, used: set[str] | None = None) -> DataFrame:
        rows = [(m.group, m.name, m.source, m.kind, m.temporal, m.window_days, m.review, m.derivation, m.point_in_time, used is None or m.name in used, ", ".join(m.depends_on)) for m in self.meta.values()]
        schema = "group string, feature string, source string, kind string, temporal string, window_days int, leakage_review string, derivation string, point_in_time boolean, in_model boolean, depends_on string"
        return spark.createDataFrame(rows, schema).orderBy("group", "feature")


def as_flag(c: Column) -> Column:
    """1, 0 or null from a boolean, a number or a text."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin(TRUE), 1.0).when(text.isin(FALSE), 0.0).otherwise(finite(c.cast("string")))


def named(*parts: str | None) -> str:
    return "__".join(p for p in parts if p)


def onto_dates(events: DataFrame, dates: list[dt.date], date: str, longest: int, embargo: int) -> DataFrame:
    """Each event, or day of events, once per date T with T - embargo - longest <= event < T - embargo; feature_end is T - embargo."""
    fits = F.filter(dates_array(dates), lambda t: (F.col(date) < F.date_sub(t, embargo)) & (F.col(date) >= F.date_sub(t, embargo + longest)))
    return events.withColumn(AT, F.explode(fits)).withColumn(END, F.date_sub(AT, embargo))


def _numbers(group: Group, events: DataFrame, skipped: list[dict]) -> tuple[list, list]:
    """Numeric (name, aggs, windows) and datetime (name, windows) columns; others are recorded as skipped."""
    numeric, dated = [], []
    for c in group.columns:
        spans = [w for w in c.windows or group.windows if w in group.windows]
        if c.windows and len(spans) < len(c.windows):
            skipped.append({"group": group.name, "column": c.name, "reason": f"windows {sorted(set(c.windows) - set(spans))} are not among the group's"})
        if c.name not in events.columns:
            if c.name not in RECOMPUTED:
                skipped.append({"group": group.name, "column": c.name, "reason": f"column not found in {group.source}"})
        elif c.type == "categorical":
            skipped.append({"group": group.name, "column": c.name, "reason": "categories are counted by filters, not aggregated"})
        elif c.type == "datetime":
            dated.append((c.name, spans))
        else:
            numeric.append((c.name, c.type, c.aggs or group.aggs, spans))
    return numeric, dated


def families(group: Group, events: DataFrame) -> list[tuple[str, Column]]:
    """(name, condition) of the unfiltered family and of each filter; an empty name is the former."""
    plain = [("", F.lit(True))] if group.unfiltered or not group.filters else []
    return plain + [(f.name, predicate(f.where, events.columns, f"feature.yaml: filter {group.name}.{f.name}")) for f in group.filters]


@dataclass
class Windows:
    """A group's features on one event log: aggregates of an entity's day, of windows over days, and of windows over events."""

    days: aggregates.Days = field(default_factory=aggregates.Days)
    by_day: dict[str, Column] = field(default_factory=dict)
    by_event: dict[str, Column] = field(default_factory=dict)
    meta: dict[str, Meta] = field(default_factory=dict)


def window_aggregates(group: Group, events: DataFrame, date: str, skipped: list[dict], tie: Column) -> Windows:
    """Every feature of a group on one event log; tie orders the events of a day."""
    numeric, dated = _numbers(group, events, skipped)
    out = Windows()
    for family, condition in families(group, events):
        every = aggregates.Events(out.days, family, condition, tie)
        for w in group.windows:
            on_day = F.col(aggregates.DAY) >= F.date_sub(END, w)
            on_event = condition & (F.col(date) >= F.date_sub(END, w))
            about = f"events{f' where {family}' if family else ''} in [T - embargo - {w}d, T - embargo)"

            def add(column: str | None, suffix: str, value: Column, text: str, raw: bool = False, family: str = family, w: int = w, about: str = about) -> None:
                name = named(group.name, family, column, f"{suffix}_{w}d")
                (out.by_event if raw else out.by_day)[name] = value
                out.meta[name] = Meta(name, group.name, group.source, "numeric", group.temporal, w, group.review, f"{text} of {about}", True)

            add(None, "event_count", aggregates.event_count(every, on_day), "number")
            add(None, "recency_days", aggregates.recency(every, on_day, F.col(END)), "days since the last")
            for column, kind, aggs, spans in numeric:
                if w not in spans:
                    continue
                x = as_flag(F.col(f"`{column}`")) if kind == "boolean" else finite(F.col(f"`{column}`"))
                own = aggregates.Events(out.days, family, condition, tie, column, x)
                for a in aggs:
                    raw = a in aggregates.BY_EVENT
                    add(column, a, aggregates.BY_EVENT[a](on_event, x) if raw else aggregates.BY_DAY[a](own, on_day), f"{a} of {column}", raw)
                if group.trends:
                    delta, ratio = aggregates.halves(own, on_day, F.col(END), w)
                    add(column, "trend_delta", delta, f"recent less earlier half of {column}")
                    add(column, "trend_ratio", ratio, f"recent to earlier half of {column}")
            for column, spans in dated:
                if w in spans:
                    # The column may be text; it is read before the latest is taken.
                    day = F.col(f"`{column}`").cast("string").try_cast("timestamp_ntz").cast("date")
                    own = aggregates.Events(out.days, family, condition, tie, f"{column} as a date", day)
                    add(column, "recency_days", aggregates.latest(own, on_day, F.col(END)), f"days since {column}")
    return out


def aggregate(events: DataFrame, wanted: dict[str, Column], keys: list[str] = KEYS) -> DataFrame:
    """All aggregates by keys; in several passes over the same events if they are very many."""
    names = list(wanted)
    passes = [names[i : i + PASS] for i in range(0, len(names), PASS)]
    blocks = [events.groupBy(*keys).agg(*[wanted[n].alias(n) for n in part]) for part in passes]
    return functools.reduce(lambda a, b: a.join(b, keys, "full"), blocks)


def from_events(
    frame: DataFrame, events: DataFrame, group: Group, date: str, id_column: str, dates: list[dt.date], embargo: int, skipped: list[dict], tie: str | None = None
) -> tuple[DataFrame, dict[str, Meta]]:
    """The panel's frame with the group's features joined to it.

    Events meet by entity and day first, combined before the shuffle; so an entity with very many events
    is as many rows as it has days. Days are then dealt by entity, and sent to dates and aggregated
    where they are: what is copied to dates is not shuffled. Only features that need the events
    themselves (median, standard deviation) send these to dates.
    """
    events = events.withColumnRenamed(id_column, ID) if id_column != ID else events
    longest, known = max(group.windows), dict(events.dtypes)[date] == "date"
    last = F.col(tie) if tie else F.xxhash64(*sorted(events.columns))
    made = window_aggregates(group, events, date, skipped, last if known else F.struct(F.col(date), last))
    reach = (F.col(date) >= F.date_sub(F.lit(min(dates)), embargo + longest)) & (F.col(date) < F.date_sub(F.lit(max(dates)), embargo))
    near = events.filter(reach)
    days = aggregate(near.withColumn(aggregates.DAY, F.col(date).cast("date")), made.days.wanted, [ID, aggregates.DAY]).repartition(ID)
    blocks = [aggregate(onto_dates(days, dates, aggregates.DAY, longest, embargo), made.by_day)]
    if made.by_event:
        blocks.append(aggregate(onto_dates(near, dates, date, longest, embargo), made.by_event))
    for block in blocks:
        frame = frame.join(block, KEYS, "left")
    return frame, made.meta


def in_force(frame: DataFrame, entity: DataFrame, spec: Spec) -> DataFrame:
    """frame with the entity's columns: of versions, the latest that had begun by feature_end and not ended."""
    renamed = entity.withColumnRenamed(spec.id_column, ID)
    taken = [c for c in renamed.columns if c != ID]
    inner = renamed.select(ID, F.struct(*taken).alias("_entity"))
    if not spec.valid_from:
        return frame.join(inner, ID, "left")
    begun, ended = F.col(f"_entity.{spec.valid_from}"), F.col(f"_entity.{spec.valid_to}") if spec.valid_to in taken else F.lit(None)
    valid = (begun <= F.col(END)) & (ended.isNull() | (ended > F.col(END)))
    best = frame.select(ID, AT, END).join(inner, ID).filter(valid).groupBy(ID, AT).agg(F.max_by("_entity", F.struct(begun, F.xxhash64("_entity"))).alias("_entity"))
    return frame.join(best, KEYS, "left")


def from_entity(frame: DataFrame, entity: DataFrame, group: Group, spec: Spec, skipped: list[dict], notes: list[str]) -> tuple[DataFrame, dict[str, Meta]]:
    """frame (with `_entity`, from in_force) and the group's attributes as of the date."""
    versions = bool(spec.valid_from)
    if group.temporal == "time_varying" and not versions:
        notes.append(f"group {group.name!r} varies in time but is read from the entity table, which has no versions: values are as of the export")
    out, meta = {}, {}
    for c in group.columns:
        name, there = f"{group.name}__{c.name}", c.name in entity.columns
        value, kind, text, timely = None, "numeric", "value in force", versions or group.temporal == "static"
        source = "entity"
        if c.name in RECOMPUTED:
            if there:
                notes.append(f"the stored column {c.name!r} is not read; it is recomputed at each date")
            source, timely = "derived", True
            if c.name == "tenure_days":
                value, text = F.col("tenure_days").cast("double"), "days since the start"
            else:
                seen = next((s for s in LAST_SEEN if s in entity.columns), None)
                if seen:
                    value, text = F.datediff(END, F.col(f"_entity.{seen}").cast("string").try_cast("timestamp_ntz").cast("date")).cast("double"), f"days since {seen}"
            if value is None:
                skipped.append({"group": group.name, "column": c.name, "reason": "neither in the data nor derivable"})
                continue
        elif not there:
            skipped.append({"group": group.name, "column": c.name, "reason": "column not found in the entity table"})
            continue
        else:
            raw = F.col(f"_entity.`{c.name}`")
            if c.type == "datetime":
                name += "__days_before_T"
                seconds = F.unix_seconds(F.col(END).cast("timestamp")) - F.unix_seconds(raw.cast("string").try_cast("timestamp_ntz").cast("timestamp"))
                value, text = (seconds / 86400.0), "days from the value to T - embargo"
            elif c.type == "boolean":
                value = as_flag(raw)
            elif c.type == "categorical":
                value, kind = raw.cast("string"), "categorical"
            else:
                value = finite(raw.cast("string")) if dict(entity.dtypes)[c.name] == "string" else finite(raw)
        out[name] = value
        meta[name] = Meta(name, group.name, source, kind, group.temporal, None, group.review, text, timely)
    return frame.withColumns(out) if out else frame, meta


def derive(frame: DataFrame, group: Group, known: dict[str, Meta]) -> tuple[DataFrame, dict[str, Meta]]:
    """The group's expressions over features built before; features of one group do not see each other."""
    out, meta = {}, {}
    for d in group.derived:
        name = f"{group.name}__{d.name}"
        out[name], used = expression(d.expression, known, f"feature.yaml: {group.name}.{d.name}")
        spans = [known[u].window_days for u in used if known[u].window_days]
        meta[name] = Meta(name, group.name, "derived", "numeric", "derived", max(spans, default=None), group.review, " ".join(d.expression.split()), all(known[u].point_in_time for u in used), tuple(used))
    return frame.withColumns(out), meta


def build(frame: DataFrame, entity: DataFrame, events: dict[str, DataFrame], spec: Spec, dates: list[dt.date], tie: dict[str, str] | None = None) -> Features:
    """All features on the panel's frame, base groups first, then derived ones in their order."""
    meta: dict[str, Meta] = {}
    skipped: list[dict] = []
    notes: list[str] = []
    embargo = int(spec.panel["embargo_days"])
    keep = frame.columns
    if any(g.source == "entity" and g.temporal != "derived" for g in spec.groups):
        frame = in_force(frame, entity, spec)
    for g in spec.groups:
        if g.temporal == "derived":
            continue
        if g.source == "entity":
            frame, new = from_entity(frame, entity, g, spec, skipped, notes)
        else:
            log = spec.logs[g.source]
            frame, new = from_events(frame, events[g.source], g, log.date_column, spec.id_column, dates, embargo, skipped, (tie or {}).get(g.source))
        meta |= new
    for g in spec.groups:
        if g.temporal == "derived":
            frame, new = derive(frame, g, meta)
            meta |= new
    if not meta:
        raise ConfigError("no feature could be built: " + "; ".join(f"{s['group']}.{s['column']}: {s['reason']}" for s in skipped))
    if len(meta) > WIDE:
        notes.append(f"{len(meta)} features; consider fewer windows or aggregates")
    clean = [finite(F.col(f"`{n}`")).alias(n) if m.kind == "numeric" else F.col(f"`{n}`").cast("string").alias(n) for n, m in meta.items()]
    return Features(frame.select(*keep, *clean), meta, skipped, notes)


def segments(name: str) -> list[str]:
    return re.split("__", name)
