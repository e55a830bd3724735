import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.errors import ConfigError, LeakageError
from tidemark.functions.ast_columns import expression, predicate
from tidemark.operators import audit, features
from tidemark.plans import panel
from tidemark.plans.spec import Column, DEFAULTS, Derived, Filter, Group, Log, Spec, merged
from tidemark.plans.timeline import Timeline

D = dt.date
WHEN = Timeline(D(2023, 1, 1), D(2023, 12, 31), D(2023, 12, 31), D(2023, 1, 1))
DATES = [D(2023, 5, 1), D(2023, 6, 1)]


def spec(groups, embargo=7, **over):
    return Spec("x", id_column="id", start_column="signup", event_column="gone", groups=groups, logs={"log": Log("log", "log", "id")}, options=merged(DEFAULTS, {"panel": {"horizon_days": 30, "embargo_days": embargo}}), **over)


def built(spark, groups, events, people=None, embargo=7, **over):
    people = people or [("A", D(2023, 1, 1), None, "north")]
    entity = spark.createDataFrame(people, "id string, signup date, gone date, region string")
    s = spec(groups, embargo, **over)
    frame = panel.build(entity, s, WHEN, DATES).frame
    log = spark.createDataFrame(events, "id string, event_date date, status string, amount double")
    return features.build(frame, entity, {"log": log}, s, DATES)


def usage(**more):
    return Group("use", "time_varying", "log", (Column("amount", aggs=("max", "sum", "count", "last", "first", "std")),), (30,), **more)


def test_the_window_ends_at_the_embargo(spark):
    days = [("A", D(2023, 1, 1) + dt.timedelta(days=i), "x", float(i)) for i in range(365)]
    for row in built(spark, [usage()], days).frame.collect():
        last = row["snapshot_date"] - dt.timedelta(days=8)
        assert row["use__amount__max_30d"] == (last - D(2023, 1, 1)).days and row["use__recency_days_30d"] == 1 and row["use__event_count_30d"] == 30


def test_nothing_in_the_window_is_null(spark):
    row = built(spark, [usage()], [("A", D(2023, 1, 2), "x", 9999.0)]).frame.first()
    assert all(row[c] is None for c in row.asDict() if c.startswith("use__"))


def test_only_nulls_in_the_window(spark):
    row = built(spark, [usage()], [("A", D(2023, 4, 20), "x", None)]).frame.filter("snapshot_date = '2023-05-01'").first()
    assert (row["use__amount__sum_30d"], row["use__amount__count_30d"], row["use__amount__max_30d"], row["use__event_count_30d"]) == (0.0, 0.0, None, 1.0)


def test_first_last_skip_nulls_and_one_row_has_no_std(spark):
    events = [("A", D(2023, 4, 10), "x", 1.0), ("A", D(2023, 4, 12), "x", 2.0), ("A", D(2023, 4, 14), "x", None)]
    row = built(spark, [usage()], events).frame.filter("snapshot_date = '2023-05-01'").first()
    assert (row["use__amount__first_30d"], row["use__amount__last_30d"]) == (1.0, 2.0)
    alone = built(spark, [usage()], events[:1]).frame.filter("snapshot_date = '2023-05-01'").first()
    assert alone["use__amount__std_30d"] is None


def test_families_part_the_whole(spark):
    events = [("A", D(2023, 4, 1) + dt.timedelta(days=i), ("failed", "paid", None)[i % 3], 1.0) for i in range(22)]
    g = Group("b", "time_varying", "log", (), (90,), filters=(Filter("failed", "status == 'failed'"), Filter("rest", "status != 'failed'")))
    row = built(spark, [g], events).frame.filter("snapshot_date = '2023-05-01'").first()
    assert row["b__failed__event_count_90d"] + row["b__rest__event_count_90d"] == row["b__event_count_90d"] == 22


def test_bad_filter_names_columns(spark):
    with pytest.raises(ConfigError, match="amount"):
        built(spark, [Group("b", "time_varying", "log", (), (90,), filters=(Filter("f", "nope == 1"),))], [("A", D(2023, 4, 1), "x", 1.0)])


def test_skipped_columns_are_told(spark):
    g = Group("b", "time_varying", "log", (Column("status", "categorical"), Column("gone_column"), Column("amount", windows=(30, 60))), (30,))
    made = built(spark, [g, Group("p", columns=(Column("nothing"),))], [("A", D(2023, 4, 1), "x", 1.0)])
    assert {s["column"] for s in made.skipped} == {"status", "gone_column", "amount", "nothing"}


def test_scd2_takes_the_version_in_force(spark):
    rows = [("A", D(2023, 1, 1), None, "north", D(2023, 1, 1), D(2023, 5, 10)), ("A", D(2023, 1, 1), None, "south", D(2023, 5, 10), None)]
    entity = spark.createDataFrame(rows, "id string, signup date, gone date, region string, f date, t date")
    s = spec([Group("p", columns=(Column("region", "categorical"),))], valid_from="f", valid_to="t")
    from tidemark.sources.readers import current

    frame = panel.build(current(entity, s), s, WHEN, DATES).frame
    got = {r["snapshot_date"]: r["p__region"] for r in features.build(frame, entity, {}, s, DATES).frame.collect()}
    assert got == {DATES[0]: "north", DATES[1]: "south"}


def test_derived_lineage_and_quarantine(spark):
    g = Group("b", "time_varying", "log", (Column("amount", aggs=("sum",)),), (30, 90))
    r = Group("r", "derived", "derived", derived=(Derived("ratio", "b__amount__sum_30d / b__amount__sum_90d"),))
    q = Group("q", "derived", "derived", derived=(Derived("more", "r__ratio + 1"),))
    made = built(spark, [g, r, q], [("A", D(2023, 4, 1), "x", 2.0)])
    assert made.meta["q__more"].depends_on == ("r__ratio",) and made.meta["r__ratio"].window_days == 90
    report = audit.Report()
    report.add(audit.BLOCK, "X", "", ["b__amount__sum_90d"])
    left = audit.enforce(spec([]), made, report)
    assert set(report.quarantined) == {"b__amount__sum_90d", "r__ratio", "q__more"} and "b__amount__sum_30d" in left.meta
    with pytest.raises(LeakageError):
        audit.enforce(spec([], **{}), features.Features(made.frame, {"b__amount__sum_90d": made.meta["b__amount__sum_90d"]}), report)
    with pytest.raises(ConfigError):
        built(spark, [g, Group("r", "derived", "derived", derived=(Derived("a", "b__amount__sum_30d"), Derived("b", "r__a")))], [("A", D(2023, 4, 1), "x", 2.0)])


@pytest.mark.parametrize("text", ["__import__('os').system('true')", "x.values", "(lambda: 1)()", "open('/etc/passwd')", "x if", "[1]", "x & 1", "abs(x=1)", "log(x, x)", "y + 1"])
def test_unsafe_expressions(text):
    with pytest.raises(ConfigError):
        expression(text, ["x"])


@pytest.mark.parametrize("text,want", [("x / 0", None), ("-7 % 3 + n * 0", 2.0), ("7 % (0 - 3) + n * 0", -2.0), ("maximum(x, m)", None), ("fillna(m, 4)", 4.0), ("where(m > 1, 1, 2)", 2.0), ("where(m != 1, 1, 2)", 1.0), ("sqrt(0 - n)", None), ("exp(1000 * n)", None), ("log(0 * n)", None), ("clip(x, 0, 2)", 2.0), ("isnull(m) + notnull(m)", 1.0), ("1 < n < 3", 1.0), ("n // 0", None)])
def test_expression_values(spark, text, want):
    row = spark.createDataFrame([(5.0, 2.0, None)], "x double, n double, m double")
    assert row.select(expression(text, row.columns)[0].alias("v")).first()["v"] == want


@pytest.mark.parametrize("text,want", [("a == 'x'", 1), ("a != 'x'", 2), ("not a == 'x'", 2), ("a in ['x', 'y']", 2), ("a not in ['x']", 2), ("n > 1 and a == 'y'", 1), ("(n > 1) & (a == 'y') | (n == 1)", 2), ("~(n > 1)", 2), ("`odd name` == 3", 1), ("n * 2 >= 4", 1)])
def test_predicates(spark, text, want):
    df = spark.createDataFrame([("x", 1, 3), ("y", 2, 4), (None, None, None)], "a string, n int, `odd name` int")
    assert df.filter(predicate(text, df.columns)).count() == want


def test_flags_and_dictionary(spark):
    df = spark.createDataFrame([("Yes",), ("f",), ("0.5",), ("?",), (None,)], "c string")
    assert [r["v"] for r in df.select(features.as_flag(F.col("c")).alias("v")).collect()] == [1.0, 0.0, 0.5, None, None]
    made = built(spark, [usage()], [("A", D(2023, 4, 1), "x", 1.0)])
    table = made.dictionary(spark, {"use__event_count_30d"}).collect()
    assert [r["feature"] for r in table] == sorted(made.meta) and sum(r["in_model"] for r in table) == 1
