"""Period KPIs and narrative."""

import pytest

from conftest import HC_SCHEMA, leavers_df
from pyspark.sql import functions as F

from staffwise.operators import classify as H
from staffwise.operators import periods as P
from staffwise.plans import kpis as KP


@pytest.fixture()
def f9(spark):
    hc = spark.createDataFrame([("Site M", "2026-05", 100), ("Site L", "2026-05", 200),
                                ("Site M", "2026-06", 100), ("Site L", "2026-06", 200)], HC_SCHEMA)
    lv = leavers_df(spark, [
        ("1", "a", "Site M", "F&B", "Waiter", "2024-01-01", "2026-05-03", 28.3, "Resigned", "Better package", None, "2026-05"),
        ("2", "b", "Site L", "Kitchen", "Chef", "2024-06-01", "2026-05-04", 23.5, "Resigned", "Better package", None, "2026-05"),
        ("3", "c", "Site L", "HR", "Officer", "2025-03-01", "2026-05-05", 14.6, "Resigned", "Health reasons", None, "2026-05"),
        ("4", "d", "Site M", "F&B", "Waiter", "2026-03-01", "2026-06-06", 3.3, "Resigned", "Supervisor behavior", None, "2026-06"),
        ("5", "e", "Site M", "F&B", "Waiter", "2026-04-01", "2026-06-07", 2.5, "Resigned", "Supervisor behavior", None, "2026-06"),
        ("6", "f", "Site L", "Kitchen", "Chef", "2024-01-01", "2026-06-08", 29.8, "Resigned", "Better package", None, "2026-06"),
    ])
    return hc, H.classify_unprocessed(lv).drop("processed")


def test_period_kpis(spark, f9):
    hc, lv = f9
    per = P.period_calendar(lv, types=("Monthly",))
    k = {r["period_key"]: r for r in KP.period_kpis(hc, lv, per).collect()}["2026-06"]
    assert k["previous_label"] == "2026-05"
    assert (k["current_turnover"], k["previous_turnover"], k["difference"]) == (1.0, 1.0, 0.0)
    assert k["total_departures"] == 3
    assert k["highest_turnover_project"] == "Site M"
    assert (k["highest_dept"], k["highest_dept_count"]) == ("F&B", 2)
    assert (k["most_common_reason"], k["most_common_reason_count"]) == ("Supervisor / Management Issue", 2)
    assert k["early_turnover_count"] == 2
    text = {r["period_key"]: r["narrative"] for r in KP.period_narrative(KP.period_kpis(hc, lv, per)).collect()}
    t = text["2026-06"]
    for phrase in ["Executive Summary - 2026-06", "Site M", "F&B", "Supervisor / Management Issue",
                   "**2** early departures", "1) department F&B: ", "it lost 2", "2) reason Supervisor",
                   "3) first months: 2 stayed under half a year"]:
        assert phrase in t
    calm = KP.period_narrative(KP.period_kpis(hc, lv, per).withColumn("early_turnover_count", F.lit(0)))
    assert "3) first months: nobody left early" in calm.where("period_key = '2026-06'").first()["narrative"]


def test_empty_period_narrative(spark, f9):
    hc, lv = f9
    empty = P.custom_period(spark, "2030-01", "2030-01")
    t = KP.period_narrative(KP.period_kpis(hc, lv, empty)).collect()[0]["narrative"]
    assert t == "Executive Summary - 2030-01\nNothing recorded."


def test_report_and_dashboard(spark, f9):
    hc, lv = f9
    per = P.period_calendar(lv, types=("Monthly",))
    r = {x["period_key"]: x for x in KP.report_kpis(hc, lv, per).collect()}["2026-06"]
    assert (r["total_headcount"], r["total_departures"], r["turnover_rate"], r["projects_analyzed"]) == (300, 3, 1.0, 2)
    assert r["change_text"] == "0.0%"
    d = {x["period_key"]: x for x in KP.dashboard_kpis(hc, lv, per, ["Site M"]).collect()}["2026-06"]
    assert (d["headcount"], d["headcount_adjusted"], d["leavers"], d["early_turnover"]) == (100, 100.0, 2, 2)
    assert d["turnover"] == 2.0
