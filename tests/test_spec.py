import datetime as dt

import pytest

from tidemark.errors import ConfigError
from tidemark.plans import spec

BASE = {
    "data": {"entity": {"path": "c.csv"}, "events": {"billing": {"path": "b.csv"}}},
    "target": {"target": {"event_date_column": "end"}},
    "feature": {"profile": {"columns": ["a"]}, "billing": {"temporal": "time_varying", "columns": [{"name": "amount", "aggs": "sum"}]}},
}


def made(**over):
    return spec.build({**BASE, **over}, "/tmp")


def test_defaults_and_fallbacks():
    s = made()
    assert s.panel["horizon_days"] == 90 and s.groups[1].windows == (90,) and s.groups[1].columns[0].aggs == ("sum",)
    lost = made(feature={"x": {"temporal": "time_varying", "source": "nowhere", "filters": {"f": "a == 1"}, "columns": ["a"]}})
    assert lost.groups[0].source == "entity" and lost.groups[0].filters == () and any("nowhere" in n for n in lost.notes)


def test_blank_does_not_wipe_a_list():
    s = made(pipeline={"leakage": {"denylist_patterns": None}, "panel": None})
    assert "churn" in s.options["leakage"]["denylist_patterns"] and s.panel["embargo_days"] == 7


@pytest.mark.parametrize(
    "over",
    [
        {"data": {}},
        {"data": {"entity": {"path": "c"}, "events": {"b": {}}}},
        {"target": {"target": {"mode": "label"}}},
        {"target": {"target": {}}},
        {"feature": {}},
        {"feature": {"g": {"columns": [{"name": "a", "aggs": ["average"]}]}}},
        {"feature": {"g": {"columns": [3]}}},
        {"feature": {"g": {"temporal": "weekly", "columns": ["a"]}}},
        {"feature": {"g": {"windows": [0], "columns": ["a"]}}},
        {"feature": {"g": {"windows": ["x"], "columns": ["a"]}}},
        {"feature": {"g": {"filters": [{"name": "a b", "where": "x == 1"}]}}},
        {"feature": {"g": {"temporal": "derived"}}},
        {"feature": {"g": {"temporal": "derived", "features": [{"name": "1x", "expression": "a"}]}}},
        {"feature": {"g": {"temporal": "derived", "features": [{"name": "x", "expression": "a"}]}}},
        {"survivorship": {"left_truncation": "maybe"}},
        {"survivorship": {"observation_starting_date": "never"}},
        {"survivorship": {"observation_starting_date": "2024-01-01"}, "target": {"target": {"event_date_column": "e", "observation_end_date": "2023-01-01"}}},
        {"pipeline": {"panel": {"horizon_days": 0}}},
        {"pipeline": {"panel": {"embargo_days": -1}}},
        {"pipeline": {"split": {"test_fraction": 1}}},
        {"pipeline": {"split": {"cv_folds": 1}}},
        {"pipeline": {"split": {"strategy": "odd"}}},
        {"pipeline": {"leakage": {"on_block": "shrug"}}},
        {"pipeline": {"leakage": {"denylist_patterns": ["("]}}},
    ],
)
def test_errors(over):
    with pytest.raises(ConfigError):
        made(**over)


def test_windows_are_sorted_and_distinct():
    assert spec.windows([90, 30, 90], "x") == (30, 90) and spec.windows(7, "x") == (7,)


def test_dates():
    assert spec.as_date("2024-02-03", "x") == dt.date(2024, 2, 3) and spec.as_date("", "x") is None


def test_load(tmp_path):
    (tmp_path / "config").mkdir()
    (tmp_path / "c.csv").write_text("customer_id,signup_date,end\n1,2024-01-01,\n")
    (tmp_path / "config/data.yaml").write_text("entity: {path: c.csv}\n")
    (tmp_path / "config/target.yaml").write_text("target: {event_date_column: end}\n")
    (tmp_path / "config/feature.yaml").write_text("profile: {columns: [a]}\n")
    assert spec.load(tmp_path / "config").groups[0].name == "profile"
    (tmp_path / "config/data.yaml").write_text("entity: {path: gone.csv}\n")
    with pytest.raises(ConfigError):
        spec.load(tmp_path / "config")
