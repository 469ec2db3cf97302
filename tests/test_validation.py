"""Validation fixtures F1-F4 and own additions."""

from pyspark.sql import functions as F

from staffwise.functions import constants as K
from staffwise.operators import validate as VA

LV_COLS = ["file_name", "row_num"] + K.LEAVER_COLUMNS


def hc_raw(spark, name, rows):
    data = [(name, i + 2, p, h) for i, (p, h) in enumerate(rows)]
    return spark.createDataFrame(data, "file_name string, row_num int, Project string, Headcount string")


def lv_raw(spark, name, rows):
    data = [(name, i + 2, *r) for i, r in enumerate(rows)]
    schema = ", ".join(f"`{c}` string" if c not in ("row_num",) else "row_num int" for c in LV_COLS)
    return spark.createDataFrame(data, schema)


def report_of(res):
    return res["report"].collect()[0]


def test_f1_headcount_valid(spark, registry):
    raw = hc_raw(spark, "headcount_2026_06.csv", [("Site M", "350"), ("Site I", "520"), ("Site L", "280")])
    res = VA.validate_headcount(raw, registry)
    r = report_of(res)
    assert r["is_valid"] and r["error_count"] == 0 and r["total_rows"] == 3 and r["valid_rows_count"] == 3
    assert r["record_month"] == "2026-06"


def test_f2_headcount_invalid(spark, registry):
    raw = hc_raw(spark, "headcount_2026_06.csv",
                 [("Site M", "350"), ("", "100"), ("Site L", "-10"), ("Site R", "Ten")])
    res = VA.validate_headcount(raw, registry)
    r = report_of(res)
    assert not r["is_valid"] and r["error_count"] == 3
    errs = sorted(x["row_num"] for x in res["issues"].where("severity = 'error'").collect())
    assert errs == [3, 4, 5]


F3 = [("EMP001", "A", "Site M", "F&B", "Waiter", "2024-01-15", "2026-06-15", "29.0", "Resigned", "Got new job"),
      ("EMP002", "B", "Site L", "Kitchen", "Chef", "2025-03-01", "2026-06-01", "15.0", "Resigned", "Personal reasons")]


def test_f3_leavers_valid(spark, registry):
    res = VA.validate_leavers(lv_raw(spark, "leavers_2026_06.csv", F3), registry)
    r = report_of(res)
    assert r["is_valid"] and r["error_count"] == 0 and r["valid_rows_count"] == 2


def test_f4_leavers_invalid(spark, registry):
    rows = [F3[0], F3[0],
            ("EMP003", "C", "Site M", "", "Chef", "2025-05-01", "2024-05-01", "-12.0", "Resigned", "")]
    res = VA.validate_leavers(lv_raw(spark, "leavers_2026_06.csv", rows), registry)
    r = report_of(res)
    assert not r["is_valid"]
    assert r["error_count"] == 4
    cols = sorted(x["column"] for x in res["issues"].where("severity = 'error'").collect())
    assert cols == ["Date of Leaving", "Department", "Employee ID", "Length of Service"]
    warns = [x["column"] for x in res["issues"].where("severity = 'warning'").collect()]
    assert "Reason" in warns


def test_filename_month(spark):
    df = spark.createDataFrame([("headcount_2026-13.csv",), ("leavers_2026_06.csv",), ("nomonth.csv",)],
                               "file_name string")
    r = {x["file_name"]: x for x in VA.month_from_filename(df).collect()}
    assert r["headcount_2026-13.csv"]["record_month"] is None
    assert r["headcount_2026-13.csv"]["file_error"]["column"] == "Filename"
    assert r["leavers_2026_06.csv"]["record_month"] == "2026-06"
    assert r["nomonth.csv"]["file_error"] is not None


def test_headcount_number_rules(spark, registry):
    raw = hc_raw(spark, "headcount_2026_06.csv",
                 [("Site M", "10d"), ("Site M", "NaN"), ("Site M", "12.5"), ("Site M", "350.0")])
    res = VA.validate_headcount(raw, registry, materialize=False)
    bad = sorted(x["row_num"] for x in res["issues"].where("severity = 'error'").collect())
    assert bad == [2, 3, 4]
    assert [x["headcount"] for x in res["valid"].collect()] == [350]


def test_date_spellings(spark, registry):
    rows = [("E1", "A", "Site M", "F&B", "Waiter", "3/4/2024", "01/15/2025", None, None, "x"),
            ("E2", "A", "Site M", "F&B", "Waiter", "31/02/2024", "2025-01-01", None, None, "x")]
    checked = VA.leaver_checks(lv_raw(spark, "leavers_2025_01.csv", rows))
    r = {x["_eid"]: x for x in checked.collect()}
    assert str(r["E1"]["_doj"]) == "2024-04-03" and str(r["E1"]["_dol"]) == "2025-01-15"
    assert r["E2"]["_doj"] is None
    clean = {x["employee_id"]: x for x in VA.clean_leaver_rows(checked).collect()}
    assert clean["E1"]["status"] == "Resigned"          # B13 default
    assert clean["E1"]["length_of_service_months"] == round(287 / 30.4375, 2)  # B9 fill


def test_autocorrect_and_unrecognized(spark, registry):
    rows = [("E1", "A", "site  m", "kot", "waiter", "2024-01-01", "2025-01-01", "12", "Resigned", "x"),
            ("E2", "B", "Site M", "front desk", "Waiter", "2024-01-01", "2025-01-01", "12", "Resigned", "x")]
    res = VA.validate_leavers(lv_raw(spark, "leavers_2025_01.csv", rows), registry)
    valid = {x["employee_id"]: x for x in res["valid"].collect()}
    assert (valid["E1"]["project_name"], valid["E1"]["department"], valid["E1"]["position"]) == \
        ("Site M", "KOT", "Waiter")
    assert "E2" not in valid
    cand = {(x["column"], x["value"]) for x in VA.unrecognized_candidates(res["issues"]).collect()}
    assert cand == {("Department", "front desk")}
    fixes = {(x["column"], x["original"], x["normalized"]) for x in VA.autocorrections(res["issues"]).collect()}
    assert ("Department", "kot", "KOT") in fixes
