"""Aggregates over events of a look-back window, in two steps where that is exact.

First an entity's day: sums, counts, extremes, sets, and first and last values of its events. Then,
from these, the windows that a day falls in, as guarded expressions of one grouped pass. Standard
deviation and median need the events themselves, and are taken from events sent to dates.

Nulls follow these rules: without events in the window everything is null; with events whose values
are all null, sum and count are 0 and the rest null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = "_day"


@dataclass
class Days:
    """Aggregates of an entity's day, each kept once under a name of its own."""

    wanted: dict[str, Column] = field(default_factory=dict)
    _names: dict[tuple, str] = field(default_factory=dict)

    def of(self, key: tuple, value: Column) -> Column:
        """The column of the day's aggregate known by key; made from value if it is new."""
        if key not in self._names:
            self._names[key] = f"_d{len(self._names)}"
            self.wanted[self._names[key]] = value
        return F.col(self._names[key])


@dataclass(frozen=True)
class Events:
    """Some events of a day and of the windows: which (family, condition), of what value, in what order within the day."""

    days: Days
    family: str
    condition: Column
    tie: Column
    column: str = ""
    value: Column | None = None

    def _day(self, kind: str, make: Callable[[], Column]) -> Column:
        return self.days.of((self.family, self.column, kind), make())

    @property
    def number(self) -> Column:
        return self.days.of((self.family, "", "n"), F.count_if(self.condition))

    def _only(self) -> Column:
        return F.when(self.condition, self.value)

    def any(self, guard: Column) -> Column:
        return F.coalesce(F.sum(F.when(guard, self.number)), F.lit(0)) > 0

    def total(self, guard: Column) -> Column:
        return F.sum(F.when(guard, self._day("sum", lambda: F.sum(self._only()))))

    def known(self, guard: Column) -> Column:
        """How many values are not null."""
        return F.coalesce(F.sum(F.when(guard, self._day("count", lambda: F.count(self._only())))), F.lit(0))

    def edge(self, guard: Column, pick: Callable) -> Column:
        """The value that is not null at the least or largest (date, tie-break)."""
        there = self.condition & self.value.isNotNull()
        own = self._day(pick.__name__, lambda: pick(F.when(there, self.value), F.when(there, self.tie)))
        there = guard & own.isNotNull()
        return pick(F.when(there, own), F.when(there, F.col(DAY)))

    def extreme(self, guard: Column, pick: Callable) -> Column:
        return pick(F.when(guard, self._day(pick.__name__, lambda: pick(self._only()))))

    def distinct(self, guard: Column) -> Column:
        sets = F.collect_list(F.when(guard, self._day("set", lambda: F.collect_set(self._only()))))
        return F.size(F.array_distinct(F.flatten(sets)))


BY_DAY: dict[str, Callable[[Events, Column], Column]] = {
    "sum": lambda e, g: F.when(e.any(g), F.coalesce(e.total(g), F.lit(0.0))),
    "mean": lambda e, g: e.total(g) / F.nullif(e.known(g), F.lit(0)),
    "max": lambda e, g: e.extreme(g, F.max),
    "min": lambda e, g: e.extreme(g, F.min),
    "count": lambda e, g: F.when(e.any(g), e.known(g)).cast("double"),
    "nunique": lambda e, g: F.when(e.any(g), e.distinct(g)).cast("double"),
    "last": lambda e, g: e.edge(g, F.max_by),
    "first": lambda e, g: e.edge(g, F.min_by),
}

#: Over the events themselves: guard and value.
BY_EVENT: dict[str, Callable[[Column, Column], Column]] = {
    "median": lambda g, x: F.median(F.when(g, x)),
    "std": lambda g, x: F.stddev_samp(F.when(g, x)),
}


def event_count(events: Events, guard: Column) -> Column:
    return F.nullif(F.sum(F.when(guard, events.number)), F.lit(0)).cast("double")


def recency(events: Events, guard: Column, end: Column) -> Column:
    """Days from the latest date to the end of the window."""
    return F.datediff(F.max(end), F.max(F.when(guard & (events.number > 0), F.col(DAY)))).cast("double")


def latest(events: Events, guard: Column, end: Column) -> Column:
    """Days from the latest value, a date, to the end of the window."""
    return F.datediff(F.max(end), events.extreme(guard, F.max)).cast("double")


def halves(events: Events, guard: Column, end: Column, days: int) -> tuple[Column, Column]:
    """Change and ratio of the sums of the recent half of the window and the half before it; an odd day is in the earlier half."""
    recent = F.col(DAY) >= F.date_sub(end, days // 2)
    late, early = (F.coalesce(events.total(guard & half), F.lit(0.0)) for half in (recent, ~recent))
    seen = events.any(guard)
    return F.when(seen, late - early), F.when(seen & (early > 0), late / F.nullif(early, F.lit(0.0)))
