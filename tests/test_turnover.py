"""Turnover fixtures (F6) and invariants."""

import pytest
from pyspark.sql import functions as F

from conftest import HC_SCHEMA, leavers_df
from staffwise.operators import periods as P
from staffwise.operators import turnover as T


@pytest.fixture()
def f6(spark):
    hc = spark.createDataFrame([("Site M", "2026-05", 100), ("Site L", "2026-05", 200),
                                ("Site M", "2026-06", 110), ("Site L", "2026-06", 190)], HC_SCHEMA)
    lv = leavers_df(spark, [
        ("EMP1", "A", "Site M", "F&B", "Waiter", "2025-01-01", "2026-05-10", 16.3, "Resigned", "Career growth", None, "2026-05"),
        ("EMP2", "B", "Site L", "Kitchen", "Chef", "2024-06-01", "2026-05-15", 23.5, "Resigned", "Better package", None, "2026-05"),
        ("EMP3", "C", "Site L", "HR", "Officer", "2025-03-01", "2026-05-20", 14.6, "Resigned", "Health reasons", None, "2026-05"),
        ("EMP4", "D", "Site M", "Kitchen", "Helper", "2025-09-01", "2026-06-05", 9.1, "Resigned", "Moving abroad", None, "2026-06"),
        ("EMP5", "E", "Site M", "F&B", "Steward", "2026-01-01", "2026-06-12", 5.4, "Resigned", "Better opportunities", None, "2026-06"),
        ("EMP6", "F", "Site L", "F&B", "Waiter", "2025-11-01", "2026-06-25", 7.8, "Resigned", "Personal reasons", None, "2026-06"),
    ])
    return hc, lv


def _custom(spark, s, e):
    return P.custom_period(spark, s, e)


def test_overall_turnover(spark, f6):
    hc, lv = f6
    both = _custom(spark, "2026-05", "2026-06").unionByName(_custom(spark, "2026-05", "2026-05"))
    r = {x["start_month"] + x["end_month"]: x["turnover_rate"]
         for x in T.overall_turnover(hc, lv, both).collect()}
    assert r["2026-052026-06"] == pytest.approx(2.0, abs=1e-2)
    assert r["2026-052026-05"] == pytest.approx(1.0, abs=1e-2)


def test_project_turnover(spark, f6):
    hc, lv = f6
    r = {x["project_name"]: x for x in T.project_turnover(hc, lv, _custom(spark, "2026-05", "2026-06")).collect()}
    assert r["Site M"]["turnover_rate"] == pytest.approx(2.93, abs=1e-2)
    assert r["Site M"]["avg_headcount"] == pytest.approx(102.5)
    assert r["Site L"]["turnover_rate"] == pytest.approx(1.52, abs=1e-2)
    assert r["Site L"]["avg_headcount"] == pytest.approx(197.5)


def test_monthly_comparison(spark, f6):
    hc, lv = f6
    pairs = spark.createDataFrame([("2026-06", "2026-05")], "current_month string, compare_month string")
    r = {x["project_name"]: x for x in T.monthly_comparison(hc, lv, pairs).collect()}
    assert (r[None]["current_rate"], r[None]["compare_rate"], r[None]["difference"]) == (1.0, 1.0, 0.0)
    assert r["Site M"]["difference"] == pytest.approx(0.90, abs=1e-2)
    assert r["Site L"]["difference"] == pytest.approx(-0.49, abs=1e-2)


def test_rolling_12m(spark, f6):
    hc, lv = f6
    r = {x["end_month"]: x for x in T.rolling_12m(hc, lv).collect()}["2026-06"]
    assert (r["leavers_count"], r["avg_headcount"], r["turnover_rate"]) == (6, 300.0, 2.0)
    assert r["period"] == "2025-07 to 2026-06"
    p = {(x["end_month"], x["project_name"]): x for x in T.rolling_12m_by_project(hc, lv).collect()}
    assert p[("2026-06", "Site M")]["leavers_count"] == 3


def test_previous_month_is_calendar_not_row(spark):
    hc = spark.createDataFrame([("S", "2026-01", 10), ("S", "2026-02", 20), ("S", "2026-05", 50)], HC_SCHEMA)
    r = {x["record_month"]: x for x in T.adjusted_headcount(hc).collect()}
    assert r["2026-01"]["prev_headcount"] is None and r["2026-01"]["adj_headcount"] == 10.0
    assert r["2026-02"]["prev_headcount"] == 10 and r["2026-02"]["adj_headcount"] == 15.0
    assert r["2026-05"]["prev_headcount"] is None and r["2026-05"]["adj_headcount"] == 50.0


def test_mean_and_sum_denominators_agree_on_one_month(spark, f6):
    hc, lv = f6
    per = P.period_calendar(lv, types=("Monthly",))
    a = {(x["period_key"], x["project_name"]): x["turnover_rate"] for x in T.project_turnover(hc, lv, per).collect()}
    b = {(x["period_key"], x["project_name"]): x["turnover_rate"]
         for x in T.project_turnover(hc, lv, per, denominator="sum").collect()}
    assert a == b


def test_calendar_and_previous_period(spark, f6):
    _, lv = f6
    cal = {x["period_key"]: x for x in P.previous_period(P.period_calendar(lv)).collect()}
    assert set(cal) == {"2026-05", "2026-06", "2026 Q2", "2026 H1", "2026 Full Year"}
    assert (cal["2026 Q2"]["start_month"], cal["2026 Q2"]["end_month"]) == ("2026-04", "2026-06")
    assert (cal["2026 Q2"]["prev_start_month"], cal["2026 Q2"]["prev_end_month"]) == ("2026-01", "2026-03")
    assert cal["2026-06"]["prev_range_label"] == "2026-05"


def test_annual_trend_has_twelve_months(spark, f6):
    hc, lv = f6
    rows = T.annual_trend(hc, lv).collect()
    assert len(rows) == 12
    r = {x["month"]: x for x in rows}
    assert r["2026-06"]["headcount"] == 300 and r["2026-06"]["leavers"] == 3
    assert r["2026-01"]["turnover_rate"] == 0.0


def test_malformed_month_raises():
    with pytest.raises(ValueError):
        P.assert_month("2026-13")
