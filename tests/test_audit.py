import datetime as dt

import pytest

from tidemark.errors import LeakageError
from tidemark.operators import audit, metrics, splits
from tidemark.operators.features import Features, Meta
from tidemark.plans.panel import Panel
from tidemark.plans.spec import DEFAULTS, Group, Spec, merged
from tidemark.plans.timeline import Timeline

D = dt.date


def spec(**leak):
    return Spec("x", event_column="contract_end_date", options=merged(DEFAULTS, {"leakage": leak}))


def meta(name, review="normal", timely=True, kind="numeric"):
    return Meta(name, name.split("__")[0], "entity", kind, "static", None, review, "", timely)


def panel(frame=None, embargo=7, last=D(2023, 6, 1), **more):
    return Panel(frame, [D(2023, 5, 1), last], Timeline(D(2023, 1, 1), D(2023, 12, 31), D(2023, 12, 31), D(2023, 1, 1)), 90, embargo, **more)


def codes(report):
    return {f.code: f for f in report.findings}


def structure(names, s=None, p=None, share=0.0):
    report = audit.Report()
    audit.structure(s or spec(), p or panel(), {n: meta(n) if isinstance(n, str) else n for n in names}, report, share)
    return codes(report)


def test_names_like_the_outcome():
    found = structure(["profile__cancellation_reason", "profile__region"])
    assert found["OUTCOME_DERIVED_FEATURE"].columns == ("profile__cancellation_reason",)
    assert "OUTCOME_DERIVED_FEATURE" not in structure(["profile__winback_offer_seen"], spec(allowlist_columns=["profile__winback_offer_seen"]))


def test_target_embargo_windows_dates():
    found = structure(["p__contract_end_date__days_before_T"])
    assert found["TARGET_COLUMN_AS_FEATURE"].level == "BLOCK" and found["CENSORING_HANDLED"].level == "INFO"
    strict = Meta("b__x", "b", "log", "numeric", "time_varying", 90, "strict", "", True)
    report = audit.Report()
    audit.structure(spec(), panel(embargo=0), {"b__x": strict, "p__y": meta("p__y", timely=False)}, report)
    assert codes(report)["NO_EMBARGO"].level == "BLOCK" and codes(report)["NO_EMBARGO"].columns == ("b__x",) and codes(report)["NOT_POINT_IN_TIME"].columns == ("p__y",)
    assert structure(["a__b"], p=panel(embargo=0))["NO_EMBARGO"].level == "WARN"
    assert structure(["a__b"], p=panel(last=D(2023, 12, 1)))["CENSORED_AS_RETAINED"].level == "BLOCK"
    assert structure(["a__b"], share=0.2)["SURVIVORSHIP_BIAS"].level == "WARN" and "SURVIVORSHIP_HANDLED" in structure(["a__b"], p=panel(truncated_dropped=True))
    wide = Spec("x", event_column="e", groups=[Group("g", "time_varying", "log", windows=(400,))])
    assert structure(["a__b"], wide)["LONG_FEATURE_WINDOW"].columns == ("g",)


def test_label_mode_does_not_abort():
    s = Spec("x", target_mode="label", label_column="l", options=merged(DEFAULTS, {"leakage": {"on_block": "fail"}}))
    report = audit.Report()
    audit.structure(s, panel(last=D(2023, 12, 31)), {"a__b": meta("a__b")}, report)
    assert codes(report)["CENSORED_AS_RETAINED"].level == "BLOCK" and not report.blocking()


def test_screens(spark):
    rows = [(f"e{i}", i % 2, float(i % 2) * 0.98, 0.5 + (i % 2) * 0.35 * ((i % 20) > 2) + (i % 7) / 10, 1.0, None if i % 2 else 3.0, 1.0 if i % 3 else None, float(i), "k" + str(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "entity_id string, label int, leak double, strong double, one double, gap double, maybe double, ident double, cat string").selectExpr("*", "date'2023-01-01' as snapshot_date")
    names = {n: meta(n, kind="categorical" if n == "cat" else "numeric") for n in ("leak", "strong", "one", "gap", "maybe", "ident", "cat")}
    report = audit.Report()
    audit.statistics(spec(), df, names, report)
    found = codes(report)
    assert set(found["SINGLE_FEATURE_SEPARATION"].columns) == {"leak", "cat"}
    assert found["MISSINGNESS_PREDICTS_TARGET"].columns == ("gap",) and found["CONSTANT_FEATURE"].columns == ("one",) and found["IDENTIFIER_LIKE_FEATURE"].columns == ("ident",)
    single = audit.Report()
    audit.statistics(spec(), df.filter("label = 1"), names, single)
    assert "SINGLE_CLASS" in codes(single)


def test_strict_review_and_levels():
    rows = [{"feature": n, "auc": 0.85, "auc_missing": None, "n_unique": 9, "null_share": 0.0, "cardinality_ratio": 0.0} for n in ("a", "b")]
    report = audit.Report()
    audit.screened(spec(), rows, {"a": meta("a", "strict"), "b": meta("b")}, report)
    assert codes(report)["SINGLE_FEATURE_SEPARATION"].columns == ("a",) and codes(report)["STRONG_SINGLE_FEATURE"].columns == ("b",)


@pytest.mark.parametrize("cv,hold,want", [(0.98, 0.74, ("CV_HOLDOUT_GAP", "BLOCK")), (0.85, 0.72, ("CV_HOLDOUT_GAP", "WARN")), (0.72, 0.70, None), (0.999, 0.999, ("MODEL_TOO_GOOD", "BLOCK")), (0.96, 0.96, ("MODEL_SUSPICIOUSLY_GOOD", "WARN"))])
def test_model_checks(cv, hold, want):
    report = audit.Report()
    audit.model_checks(spec(), cv, hold, report)
    assert [(f.code, f.level) for f in report.findings] == ([want] if want else [])


def test_fail_policy():
    report = audit.Report()
    report.add(audit.BLOCK, "X", "m", ["a__b"])
    with pytest.raises(LeakageError, match="a__b"):
        audit.enforce(spec(on_block="fail"), Features(None, {"a__b": meta("a__b")}), report)


def test_auc_by_hand(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 2.0), (1, 3.0)], "label int, s double")
    assert metrics.auc(df, "s", "label").first()["area"] == pytest.approx(0.875)
    assert metrics.average_precision(df, "s", "label").first()["ap"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_splits(spark):
    dates = [D(2023, m, 1) for m in range(1, 13)]
    rows = [(f"e{i}", d, int((i + d.month) % 5 == 0)) for i in range(40) for d in dates]
    df = spark.createDataFrame(rows, "entity_id string, snapshot_date date, label int")
    s = splits.out_of_time(df, dates, 0.25, 60, 0)
    by = {r["split"]: r for r in s.frame.groupBy("split").agg({"snapshot_date": "max"}).collect()}
    assert s.cutoff == D(2023, 10, 1) and by["train"]["max(snapshot_date)"] == D(2023, 8, 1)
    folds = splits.entity_folds(df, 4)
    assert folds.count() == 40 and folds.groupBy("fold").count().count() == 4
    g = splits.grouped_random(df, 0.25).frame
    assert g.groupBy("entity_id").agg({"split": "count"}).count() == 40 and splits.spanning(g).first()["n_both"] == 0
