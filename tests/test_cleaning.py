import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cleaning as C
from tidemark.sources import ingest

D = dt.date


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "c string").select(make("c").alias("v")).first()["v"]


NUMBERS = {"€15,50": 15.5, "EUR 15.50": 15.5, "$15.50": 15.5, "15,50": 15.5, "1.200,00": 1200.0, "1,200.00": 1200.0, "€180,00": 180.0, "0,0": 0.0, "0": 0.0, "3": 3.0, "-12,5": -12.5, "1.234.567": 1234567.0, "": None, "Unknown": None, "N/A": None, "(3.5)": -3.5, "abc": None}
DATES = {"2022-03-04 00:00:00": D(2022, 3, 4), "2022-03-04": D(2022, 3, 4), "July 2018": D(2018, 7, 1), "Jul 2018": D(2018, 7, 1), "15 March 2022": D(2022, 3, 15), "3/15/2022": D(2022, 3, 15), "15.03.2022": D(2022, 3, 15), "2022-03-04T10:00:00": D(2022, 3, 4), "NA": None, "": None}


def table(spark, make, cases, kind):
    rows = [(k,) for k in cases]
    return {r["c"]: r["v"] for r in spark.createDataFrame(rows, "c string").select("c", make("c").alias("v")).collect()}


def test_numbers(spark):
    assert table(spark, lambda c: C.number(c)["value"], NUMBERS, "double") == NUMBERS
    assert tuple(one(spark, C.number, "1,250")) == (1250.0, True) and tuple(one(spark, C.number, "0.125")) == (0.125, False)


def test_dates(spark):
    assert table(spark, C.date, DATES, "date") == DATES
    assert one(spark, lambda c: C.date(c, True), "01/02/2022") == D(2022, 2, 1) and one(spark, lambda c: C.date(c, False), "01/02/2022") == D(2022, 1, 2)


@pytest.mark.parametrize("values,want", [(["01/02/2022", "25/12/2022", "13/06/2022"], (True, "day-first")), (["01/02/2022", "12/25/2022", "06/13/2022"], (False, "month-first")), (["25/12/2022", "12/25/2022"], (True, "MIXED"))])
def test_day_first(spark, values, want):
    assert tuple(C.day_first(spark.createDataFrame([(v,) for v in values], "c string"), "c").first()) == want


@pytest.mark.parametrize("value,want", [("Y", 1), ("no", 0), ("1", 1), ("FALSE", 0), ("NA", None), ("2,5", 1)])
def test_boolean(spark, value, want):
    assert one(spark, C.boolean, value) == want


@pytest.mark.parametrize("value,want", [('{"email_opens": "5"}', 5.0), ("opens=3", 3.0), ("{'email_opens': 7}", 7.0), ("missing", None)])
def test_keyed(spark, value, want):
    assert one(spark, lambda c: C.keyed_number(c, ingest.OPENS), value) == want


@pytest.mark.parametrize("value,want", [("10+", (10.0, 1)), ("5", (5.0, 0)), ("missing", (None, None))])
def test_capped(spark, value, want):
    assert tuple(one(spark, C.capped_count, value)) == want


@pytest.mark.parametrize("value,want", [("1012", "10"), ("SE-123 45", "SE"), ("EC1A 1BB", "EC"), (None, None)])
def test_postcode(spark, value, want):
    assert one(spark, C.postcode_area, value) == want


@pytest.mark.parametrize("value,n", [("2022-03-04;2021-05-06", 2), ('["2022-01-01", "2022-01-02"]', 2), ("NA", 0), (None, 0)])
def test_many_dates(spark, value, n):
    assert len(one(spark, C.dates_in, value)) == n


def test_age_share_category(spark):
    assert one(spark, C.age, "12") is None and one(spark, C.age, "30") == 30.0
    assert one(spark, C.share, "25") == 0.25 and one(spark, C.share, "0,25") == 0.25
    assert one(spark, lambda c: C.category(c, {"dm": "direct_mail"}), " DM ") == "direct_mail" and one(spark, C.category, "Very  Odd!") == "very_odd"


RAW = """customer_id;subscription_id;subscription_date;participant_age;marketing_channel;monthly_spend_estimated;campaign_cohort;treatment_sent_flag;churned;churn_date;c_service_contacts_12m;win_dates;survey_date;satisfaction_score;last_contact_date;last_contact_reason;offer_cost_eur
1; A ;13/06/2022;30;DM;€1.200,00;control;1;0;;99;2022-03-04|2021-05-06;2022-07-01;8;2022-08-01;Offer question;$3
1;B;July 2022;Unknown;PPC;EUR 15,50;variant a;Y;1;25/12/2022;1;NA;;;2022-08-02;billing;4
2;C;2022-01-05 00:00:00;12;TV;?;b;no;Y;;0;;2022-07-02;9;;;
2;A;14/06/2022;31;DM;1;control;0;0;;1;;;;;;
"""


def test_ingest(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_bytes(RAW.encode("cp1252"))
    assert ingest.sniff(spark, str(path)) == ("cp1252", ";")
    out = ingest.ingest(ingest.read_text(spark, str(path)), D(2022, 7, 2))
    rows = {r["subscription_id"]: r for r in out.subscriptions.collect()}
    assert set(rows) == {"A", "B", "C"} and rows["A"]["monthly_spend_eur"] == 1200.0 and rows["A"]["participant_age"] == 30.0
    assert (rows["B"]["churned"], rows["B"]["churn_date"], rows["B"]["campaign_cohort"], rows["B"]["subscription_date"]) == (1, D(2022, 12, 25), "Variant_A", D(2022, 7, 1))
    assert not {"offer_cost_eur", "satisfaction_score", "last_contact_reason"} & set(out.subscriptions.columns)
    assert out.events["win_events"].count() == 2 and out.events["survey_events"].count() == 2
    contact = {r["subscription_id"]: r for r in out.events["contact_events"].collect()}
    assert contact["A"]["is_offer_question"] == 1.0 and contact["B"]["is_billing_issue"] == 1.0
    text = " ".join(out.warnings)
    for part in ("flagged as churned without a date", "control rows were sent", "more than one subscription", "another currency", "may mean unknown", "on or after"):
        assert part in text
    report = {r["column"]: r for r in out.report.collect()}
    assert report["monthly_spend_estimated"]["n_rows"] == 4 and report["participant_age"]["n_parsed"] == 3
    assert ingest.write(out, str(tmp_path / "o"), dry_run=True) and not (tmp_path / "o").exists()
    ingest.write(out, str(tmp_path / "o"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o/subscriptions.csv")).count() == 3


def test_day_first_reads_the_whole_column(spark):
    early = spark.range(20_000).selectExpr("'03/04/2024' as c")
    assert tuple(C.day_first(early.union(spark.createDataFrame([("03/25/2024",)], "c string")), "c").first()) == (False, "month-first")
