"""The declarative specification: seven YAML files to checked dataclasses."""

from __future__ import annotations

import copy
import datetime as dt
import logging
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from ..errors import ConfigError

log = logging.getLogger("tidemark")

FILES = ("data", "target", "survivorship", "feature", "experiment", "causal", "pipeline")
AGGREGATES = ("sum", "mean", "max", "min", "last", "first", "count", "median", "std", "nunique")
DEFAULT_AGGREGATES = ("sum", "mean", "max", "last")
TYPES = ("numeric", "categorical", "boolean", "datetime")

# Defaults of pipeline.yaml, and the name patterns of outcome columns.
DEFAULTS: dict[str, dict[str, Any]] = {
    "run": {"output_dir": "output", "random_seed": 42},
    "panel": {"snapshot_mode": "rolling", "snapshot_frequency": "MS", "snapshot_start": None, "snapshot_end": None, "snapshot_dates": [], "horizon_days": 90, "embargo_days": 7, "min_tenure_days": 0, "max_snapshots_per_entity": None},
    "split": {"strategy": "out_of_time", "test_fraction": 0.25, "cv_folds": 4, "purge_days": 0},
    "model": {"primary": "hist_gradient_boosting", "calibrate": True, "class_weight": "balanced", "max_iter": 300, "learning_rate": 0.06, "max_leaf_nodes": 31},
    "drivers": {"top_k": 20, "method": "auto", "n_permutation_repeats": 10, "min_stability": 0.5},
    "leakage": {
        "on_block": "quarantine",
        "denylist_patterns": ["churn", "cancel", "terminat", r"(^|_)end_date$", "expir", r"(^|_)exit", "reason", "refund", "final_", "closed", "win_?back", "retention_offer", "save_?desk", "survival", "is_active", "status"],
        "allowlist_columns": [],
        "single_feature_auc_block": 0.90,
        "single_feature_auc_warn": 0.80,
        "missingness_auc_warn": 0.75,
        "model_auc_block": 0.995,
        "id_cardinality_ratio_warn": 0.9,
    },
    "survival": {"enabled": True, "cox": True, "by": None, "max_strata": 8},
    "causal": {"enabled": True},
}


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "numeric"
    aggs: tuple[str, ...] | None = None
    windows: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Filter:
    name: str
    where: str
    description: str = ""


@dataclass(frozen=True)
class Derived:
    name: str
    expression: str
    description: str = ""


@dataclass(frozen=True)
class Group:
    name: str
    temporal: str = "static"
    source: str = "entity"
    columns: tuple[Column, ...] = ()
    windows: tuple[int, ...] = ()
    aggs: tuple[str, ...] = DEFAULT_AGGREGATES
    filters: tuple[Filter, ...] = ()
    derived: tuple[Derived, ...] = ()
    trends: bool = False
    unfiltered: bool = True
    review: str = "normal"


@dataclass(frozen=True)
class Log:
    """An event log."""

    name: str
    path: str
    id_column: str
    date_column: str = "event_date"
    format: str = "auto"


@dataclass
class Spec:
    entity_path: str
    entity_format: str = "auto"
    id_column: str = "customer_id"
    start_column: str = "signup_date"
    valid_from: str | None = None
    valid_to: str | None = None
    logs: dict[str, Log] = field(default_factory=dict)
    segments: tuple[str, ...] = ()
    target_mode: str = "event_date"
    event_column: str | None = None
    label_column: str | None = None
    churn_value: Any = 1
    observation_end: dt.date | None = None
    decision_lead_days: int = 0
    data_export: dt.date | None = None
    observation_start: dt.date | None = None
    history_start: dt.date | None = None
    left_truncation: str = "drop"
    groups: list[Group] = field(default_factory=list)
    options: dict[str, dict[str, Any]] = field(default_factory=lambda: copy.deepcopy(DEFAULTS))
    causal: dict[str, Any] = field(default_factory=dict)
    experiment: dict[str, Any] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)

    @property
    def panel(self) -> dict[str, Any]:
        return self.options["panel"]

    @property
    def longest_window(self) -> int:
        """Of the time-varying groups that read an event log."""
        every = [w for g in self.groups if g.temporal == "time_varying" and g.source != "entity" for w in (*g.windows, *(x for c in g.columns for x in c.windows or () if x in g.windows))]
        return max(every, default=0)


def merged(base: dict, over: dict | None) -> dict:
    """over laid on base; a blank does not wipe a mapping or a list."""
    out = dict(base)
    for key, value in (over or {}).items():
        kept = out.get(key)
        if value is None and isinstance(kept, (dict, list)):
            continue
        out[key] = merged(kept, value) if isinstance(kept, dict) and isinstance(value, dict) else value
    return out


def as_date(value: Any, where: str) -> dt.date | None:
    if value in (None, ""):
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    try:
        return dt.datetime.fromisoformat(str(value).strip()).date()
    except ValueError as error:
        raise ConfigError(f"{where}: {value!r} is no date") from error


def aggregates(value: Any, where: str) -> tuple[str, ...] | None:
    if value is None:
        return None
    listed = [value] if isinstance(value, str) else value
    if not isinstance(listed, list) or not listed:
        raise ConfigError(f"feature.yaml: {where} has to be a list that is not empty")
    if wrong := [a for a in listed if a not in AGGREGATES]:
        raise ConfigError(f"feature.yaml: {where} has unknown aggregations {wrong}; there are {sorted(AGGREGATES)}")
    return tuple(dict.fromkeys(listed))


def windows(value: Any, where: str) -> tuple[int, ...]:
    if value is None:
        return ()
    listed = value if isinstance(value, list) else [value]
    out = set()
    for item in listed:
        try:
            days = int(item)
        except (TypeError, ValueError) as error:
            raise ConfigError(f"feature.yaml: {where}: {item!r} is no number of days") from error
        if days <= 0:
            raise ConfigError(f"feature.yaml: {where}: {days} days are not positive")
        out.add(days)
    return tuple(sorted(out))


def _filters(group: str, value: Any) -> tuple[Filter, ...]:
    if isinstance(value, dict):
        value = [{"name": n, "where": w} for n, w in value.items()]
    if not isinstance(value or [], list):
        raise ConfigError(f"feature.yaml: {group}.filters has to be a list of {{name, where}}")
    out = []
    for item in value or []:
        if not isinstance(item, dict) or not {"name", "where"} <= item.keys():
            raise ConfigError(f"feature.yaml: {group}.filters: {item!r} lacks `name` or `where`")
        if not re.fullmatch(r"[A-Za-z0-9_]+", str(item["name"])):
            raise ConfigError(f"feature.yaml: {group}.filters: the name {item['name']!r} may have letters, digits and underscores only")
        out.append(Filter(str(item["name"]), str(item["where"]), item.get("description", "")))
    return tuple(out)


def _columns(group: str, value: Any) -> tuple[Column, ...]:
    out = []
    for item in value or []:
        if isinstance(item, str):
            out.append(Column(item))
        elif isinstance(item, dict) and "name" in item:
            kind = item.get("type", "numeric")
            if kind not in TYPES:
                raise ConfigError(f"feature.yaml: {group}.{item['name']}: unknown type {kind!r}; there are {list(TYPES)}")
            out.append(Column(item["name"], kind, aggregates(item.get("aggs"), f"{group}.{item['name']}.aggs"), windows(item.get("windows"), f"{group}.{item['name']}.windows") or None))
        else:
            raise ConfigError(f"feature.yaml: {group}.columns: {item!r} is neither a name nor {{name, type, aggs, windows}}")
    return tuple(out)


def _derived(group: str, value: Any) -> tuple[Derived, ...]:
    if not value:
        raise ConfigError(f"feature.yaml: the derived group {group!r} has no `features`")
    out = []
    for item in value:
        if not isinstance(item, dict) or not {"name", "expression"} <= item.keys():
            raise ConfigError(f"feature.yaml: {group}.features: {item!r} lacks `name` or `expression`")
        if not str(item["name"]).isidentifier() or not str(item["name"]).isascii():
            raise ConfigError(f"feature.yaml: {group}.features: the name {item['name']!r} is no identifier")
        out.append(Derived(str(item["name"]), str(item["expression"]), item.get("description", "")))
    return tuple(out)


def parse_groups(raw: dict | None, notes: list[str]) -> list[Group]:
    if not raw:
        raise ConfigError("feature.yaml is empty; it needs a feature group")
    out = []
    for name, body in raw.items():
        if not isinstance(body, dict):
            raise ConfigError(f"feature.yaml: the group {name!r} has to be a mapping")
        temporal = body.get("temporal", "static")
        review = body.get("leakage_review", "normal")
        if temporal == "derived":
            out.append(Group(name, temporal, "derived", derived=_derived(name, body.get("features") or body.get("derived")), review=review))
            continue
        if temporal not in ("static", "time_varying"):
            raise ConfigError(f"feature.yaml: {name}.temporal is {temporal!r}, not static, time_varying or derived")
        columns, filters = _columns(name, body.get("columns")), _filters(name, body.get("filters"))
        if not columns and not filters:
            notes.append(f"group {name!r} has neither columns nor filters and is left out")
            continue
        spans = body.get("windows", body.get("aggregation_window_days"))
        out.append(Group(name, temporal, body.get("source", "entity" if temporal == "static" else name), columns, windows(spans, f"{name}.windows"), aggregates(body.get("aggs"), f"{name}.aggs") or DEFAULT_AGGREGATES, filters, (), bool(body.get("generate_trends", False)), bool(body.get("include_unfiltered", True)), review))
    return out


def build(raw: dict[str, dict], root: str | Path = ".") -> Spec:
    """raw: the contents of the files by name, as in FILES."""
    data = raw.get("data") or {}
    entity = data.get("entity") or {}
    if not entity.get("path"):
        raise ConfigError("data.yaml: `entity.path` is missing")

    def located(path: str) -> str:
        return path if "://" in path else str((Path(root) / path).resolve())

    spec = Spec(located(entity["path"]), entity.get("format", "auto"), entity.get("id_column", "customer_id"), entity.get("start_date_column", "signup_date"), entity.get("valid_from_column"), entity.get("valid_to_column"))
    for name, body in (data.get("events") or {}).items():
        if not (body or {}).get("path"):
            raise ConfigError(f"data.yaml: events.{name} has no `path`")
        spec.logs[name] = Log(name, located(body["path"]), body.get("id_column", spec.id_column), body.get("date_column", "event_date"), body.get("format", "auto"))
    spec.segments = tuple(data.get("segments") or ())
    target = (raw.get("target") or {}).get("target") or {}
    spec.target_mode = target.get("mode", "event_date")
    spec.event_column, spec.label_column, spec.churn_value = target.get("event_date_column"), target.get("label_column"), target.get("churn_value", 1)
    spec.observation_end = as_date(target.get("observation_end_date"), "target.yaml: observation_end_date")
    spec.decision_lead_days = int(target.get("decision_lead_days") or 0)
    life = raw.get("survivorship") or {}
    spec.data_export, spec.observation_start, spec.history_start = (as_date(life.get(k), f"survivorship.yaml: {k}") for k in ("data_export_date", "observation_starting_date", "event_history_starts"))
    spec.left_truncation = life.get("left_truncation", "drop")
    spec.groups = parse_groups(raw.get("feature"), spec.notes)
    spec.options = merged(DEFAULTS, raw.get("pipeline"))
    spec.causal, spec.experiment = raw.get("causal") or {}, raw.get("experiment") or {}
    return validated(spec)


def _one_of(value: Any, allowed: tuple, where: str) -> None:
    if value not in allowed:
        raise ConfigError(f"{where} is {value!r}; it may be {' or '.join(map(str, allowed))}")


def validated(spec: Spec) -> Spec:
    """Checks within and across files; groups of unknown logs fall back to the entity table."""
    _one_of(spec.target_mode, ("event_date", "label"), "target.yaml: mode")
    if spec.target_mode == "event_date" and not spec.event_column:
        raise ConfigError("target.yaml: mode event_date needs `event_date_column`")
    if spec.target_mode == "label" and not spec.label_column:
        raise ConfigError("target.yaml: mode label needs `label_column`")
    _one_of(spec.left_truncation, ("drop", "keep_flagged"), "survivorship.yaml: left_truncation")
    p, leak, split = spec.panel, spec.options["leakage"], spec.options["split"]
    _one_of(p["snapshot_mode"], ("rolling", "single"), "pipeline.yaml: panel.snapshot_mode")
    if int(p["horizon_days"]) <= 0:
        raise ConfigError("pipeline.yaml: panel.horizon_days has to be positive")
    if int(p["embargo_days"]) < 0:
        raise ConfigError("pipeline.yaml: panel.embargo_days cannot be negative")
    if int(p["embargo_days"]) == 0:
        spec.notes.append("without an embargo, signs of a decision already taken will look like causes")
    _one_of(leak["on_block"], ("quarantine", "fail"), "pipeline.yaml: leakage.on_block")
    for pattern in leak["denylist_patterns"]:
        try:
            re.compile(pattern)
        except re.error as error:
            raise ConfigError(f"pipeline.yaml: leakage.denylist_patterns: {pattern!r} is no regular expression: {error}") from error
    _one_of(split["strategy"], ("out_of_time", "grouped_random"), "pipeline.yaml: split.strategy")
    _one_of(spec.options["drivers"]["method"], ("auto", "shap", "permutation"), "pipeline.yaml: drivers.method")
    _one_of(spec.options["model"]["primary"], ("hist_gradient_boosting", "gradient_boosting"), "pipeline.yaml: model.primary")
    _one_of(spec.options["model"]["class_weight"] or None, ("balanced", None), "pipeline.yaml: model.class_weight")
    for source in (spec.entity_format, *(x.format for x in spec.logs.values())):
        _one_of(source, ("auto", "csv", "parquet"), "data.yaml: format")
    if not 0 < float(split["test_fraction"]) < 1:
        raise ConfigError("pipeline.yaml: split.test_fraction has to be between 0 and 1")
    if int(split["cv_folds"]) < 2:
        raise ConfigError("pipeline.yaml: split.cv_folds has to be 2 or more")
    if spec.observation_start and spec.observation_end and spec.observation_start >= spec.observation_end:
        raise ConfigError("observation_starting_date has to be before observation_end_date")
    fixed = []
    for g in spec.groups:
        if g.temporal != "derived" and g.source != "entity" and g.source not in spec.logs:
            spec.notes.append(f"group {g.name!r}: there is no event log {g.source!r}; the entity table is read as of the export, without filters")
            g = Group(g.name, g.temporal, "entity", g.columns, g.windows, g.aggs, (), g.derived, g.trends, g.unfiltered, g.review)
        elif g.temporal == "time_varying" and g.source != "entity" and not g.windows:
            g = Group(g.name, g.temporal, g.source, g.columns, (90,), g.aggs, g.filters, g.derived, g.trends, g.unfiltered, g.review)
        fixed.append(g)
    spec.groups = fixed
    if all(g.temporal == "derived" for g in fixed):
        raise ConfigError("feature.yaml has derived groups only; they need others to derive from")
    return spec


def load(folder: str | Path, root: str | Path | None = None) -> Spec:
    """Read the seven files of a folder; those that are missing are empty."""
    folder, raw = Path(folder), {}
    for name in FILES:
        path = folder / f"{name}.yaml"
        body = yaml.safe_load(path.read_text()) if path.exists() else None
        if body is not None and not isinstance(body, dict):
            raise ConfigError(f"{path.name} has to be a mapping")
        raw[name] = body or {}
    spec = build(raw, root or folder.parent)
    if "://" not in spec.entity_path and not Path(spec.entity_path).exists():
        raise ConfigError(f"data.yaml: there is no entity file at {spec.entity_path}; `demo` makes one to try")
    return spec
