"""Distribution fixtures (F7) and invariants."""

import pytest
from pyspark.sql import functions as F

from conftest import leavers_df
from staffwise.operators import dist as DI
from staffwise.operators import filters as FI
from staffwise.operators import periods as P


@pytest.fixture()
def f7(spark):
    return leavers_df(spark, [
        ("EMP1", "P1", "Site M", "F&B", "Waiter", "2026-01-01", "2026-06-01", 2.5, "Resigned", "Better package", None, "2026-06"),
        ("EMP2", "P2", "Site M", "Kitchen", "Chef", "2026-01-01", "2026-06-02", 5.5, "Terminated", "Moving abroad", None, "2026-06"),
        ("EMP3", "P3", "Site L", "F&B", "Waiter", "2025-09-01", "2026-06-03", 9.5, None, "Supervisor behavior", None, "2026-06"),
        ("EMP4", "P4", "Site I", "HR", "Manager", "2024-01-01", "2026-06-04", 29.5, "Resigned", "Health reasons", None, "2026-06"),
    ])


def test_summary_and_distribution(spark, f7):
    per = P.period_calendar(f7, types=("Monthly",))
    s = DI.summary_metrics(f7, per).collect()[0]
    assert s["total_leavers"] == 4 and s["average_service_length_months"] == 11.75
    d = {(x["dimension"], x["value"]): x["departures"] for x in DI.distribution(f7, per).collect()}
    assert d[("department", "F&B")] == 2 and d[("project_name", "Site M")] == 2
    # invariant: per dimension, totals equal row count minus nulls
    tot = {}
    for (dim, _), n in d.items():
        tot[dim] = tot.get(dim, 0) + n
    assert tot["department"] == 4 and "ai_category" not in tot


def test_brackets(spark, f7):
    per = P.period_calendar(f7, types=("Monthly",))
    a = {x["service_bracket"]: x["departures"] for x in DI.bracket_counts_present(f7, per).collect()}
    assert a == {"< 3 Months": 1, "3 - 6 Months": 1, "6 - 12 Months": 1, "> 2 Years": 1}
    b = {x["service_bracket"]: x for x in DI.bracket_counts(f7, per).collect()}
    assert len(b) == 5 and b["1 - 2 Years"]["departures"] == 0 and b["< 3 Months"]["share_pct"] == 25.0
    e = DI.early_share(f7, per).collect()[0]
    assert (e["early_count"], e["early_pct"]) == (2, 50.0)


def test_top_affected(spark, f7):
    per = P.period_calendar(f7, types=("Monthly",))
    t = {(x["dimension"], x["rank"]): x for x in DI.top_affected(f7, per).collect()}
    assert (t[("department", 1)]["name"], t[("department", 1)]["count"], t[("department", 1)]["percentage"]) == \
        ("F&B", 2, 50.0)
    assert t[("position", 1)]["name"] == "Waiter" and t[("position", 1)]["count"] == 2
    # no category anywhere -> reasons come from the original text
    assert t[("reason", 1)]["name"] in {"Better package", "Health reasons", "Moving abroad", "Supervisor behavior"}


def test_early_leavers_and_splits(spark, f7):
    names = sorted(x["employee_id"] for x in FI.early_leavers(f7).collect())
    assert names == ["EMP1", "EMP2"]
    per = P.period_calendar(f7, types=("Monthly",))
    v = {x["separation_type"]: x["departures"] for x in DI.voluntary_split(f7, per).collect()}
    assert v == {"Involuntary (Terminated)": 1, "Voluntary (Resigned)": 3}
    s = FI.separation_split(f7, per).collect()[0]
    assert (s["total_separations"], s["terminations"], s["resignations"]) == (4, 1, 3)
    t = FI.terminations_detail(f7).collect()
    assert [x["employee_id"] for x in t] == ["EMP2"] and t[0]["tenure"] == "5.5 mo"
    assert t[0]["date_of_leaving"] == "02 Jun 2026"


def test_filters(spark, f7):
    assert FI.filter_dept_position(f7, " f&b ", "WAITER").count() == 2
    assert FI.filter_multiselect(f7, ["All"], ["F&B"], None).count() == 2
    assert FI.employee_search(f7, "p[12]").count() == 2
    assert FI.filter_project_month(f7, "Site M", "2026-06", "2026-06").count() == 2
