import datetime as dt

import pytest

from tidemark.errors import DataError, InsufficientDataError
from tidemark.plans import panel, timeline
from tidemark.plans.spec import DEFAULTS, Spec, merged
from tidemark.sources import readers

D = dt.date


def spec(**over):
    options = merged(DEFAULTS, {"panel": {"horizon_days": 30} | over.pop("panel", {})})
    return Spec("x", id_column="id", start_column="signup", event_column="gone", options=options, **over)


def when(**over):
    return timeline.Timeline(**({"observation_start": D(2023, 1, 1), "observation_end": D(2023, 12, 31), "data_export": D(2023, 12, 31), "feature_start": D(2023, 1, 1)} | over))


def people(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, signup date, gone date")


def test_labels(spark):
    df = people(spark, ("A", D(2023, 1, 10), D(2023, 6, 16)), ("B", D(2023, 1, 10), D(2023, 7, 31)), ("C", D(2023, 1, 10), None))
    made = panel.build(df, spec(), when(), [D(2023, 6, 1)])
    assert {r["entity_id"]: r["label"] for r in made.frame.collect()} == {"A": 1, "B": 0, "C": 0}


def test_not_at_risk_after_the_end(spark):
    df = people(spark, ("A", D(2023, 1, 10), D(2023, 3, 1)))
    dates = [D(2023, m, 1) for m in range(2, 7)]
    assert [r["snapshot_date"] for r in panel.build(df, spec(), when(), dates).frame.collect()] == [D(2023, 2, 1)]


@pytest.mark.parametrize("lead,label", [(0, 0), (20, 1)])
def test_decision_lead(spark, lead, label):
    df = people(spark, ("A", D(2023, 1, 10), D(2023, 7, 10)))
    row = panel.build(df, spec(decision_lead_days=lead), when(), [D(2023, 6, 5)]).frame.first()
    assert row["label"] == label and row["tenure_days"] == 146 and row["feature_end"] == D(2023, 5, 29)


def test_truncation(spark):
    df = people(spark, ("A", D(2022, 1, 10), None), ("B", D(2023, 1, 10), None))
    assert panel.build(df, spec(), when(), [D(2023, 6, 1)]).frame.count() == 1
    kept = panel.build(df, spec(left_truncation="keep_flagged"), when(), [D(2023, 6, 1)]).frame
    assert {r["entity_id"]: r["left_truncated"] for r in kept.collect()} == {"A": True, "B": False}
    life = {r["entity_id"]: r["entry_days"] for r in panel.survival(df, spec(left_truncation="keep_flagged"), when()).collect()}
    assert life == {"A": 356, "B": 0}
    with pytest.raises(DataError):
        panel.build(df.filter("id = 'A'"), spec(), when(), [D(2023, 6, 1)])


def test_calendar():
    s = spec(groups=[])
    found = timeline.calendar(s, when())
    assert found.dates[0] == D(2023, 2, 1) and found.dates[-1] == D(2023, 12, 1)
    with pytest.raises(InsufficientDataError):
        timeline.calendar(spec(groups=[], panel={"snapshot_mode": "single", "snapshot_dates": ["2024-06-01"]}), when())


def test_label_mode(spark):
    df = spark.createDataFrame([("A", D(2023, 1, 1), "yes"), ("B", D(2023, 1, 1), None)], "id string, signup date, left string")
    s = spec(target_mode="label", label_column="left", churn_value="yes")
    assert {r["entity_id"]: r["label"] for r in panel.build(df, s, when(), []).frame.collect()} == {"A": 1, "B": 0}


def test_entities(spark):
    raw = spark.createDataFrame([("A", "2023-01-01", "2022-01-01"), ("B", "soon", None), ("C", "2023-02-01 10:00:00", "2023-03-01")], "id string, signup string, gone string")
    notes = []
    got = {r["id"]: (r["signup"], r["gone"]) for r in readers.entities(raw, spec(), notes).collect()}
    assert got == {"A": (D(2023, 1, 1), None), "C": (D(2023, 2, 1), D(2023, 3, 1))} and any("1 values of signup" in n for n in notes)
    with pytest.raises(DataError):
        readers.entities(raw.union(raw), spec())
    with pytest.raises(DataError):
        readers.entities(raw.drop("gone"), spec())


def test_cap(spark):
    df = people(spark, *[(f"{i}", D(2023, 1, 2), None) for i in range(5)])
    made = panel.build(df, spec(panel={"max_snapshots_per_entity": 2}), when(), [D(2023, m, 1) for m in range(2, 8)])
    assert made.frame.count() == 10


def test_csv_ids_keep_zeros(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n00123,1\n")
    assert readers.read(spark, str(tmp_path / "a.csv"), text_columns=("id",)).first()["id"] == "00123"


def test_orphans_are_events_without_an_entity(spark):
    from tidemark.sources import readers

    events = spark.createDataFrame([("a", 1), ("b", 2), ("zz", 3), ("zz", 4), (None, 5)], "id string, n int")
    people = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert sorted(r["n"] for r in readers.orphans(events, people, "id").collect() if r["id"] is not None) == [3, 4]
    assert readers.orphans(events.filter("id in ('a', 'b')"), people, "id").count() == 0
