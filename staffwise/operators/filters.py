"""Joins with the project dimension and row filters.

Filters stay plain Catalyst predicates on the stored string columns so they
reach the Parquet scan (pushed filters, partition pruning on record_month).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import (is_terminated_status, mentions_termination, r1, strip_ws)

LEAVER_DETAIL_COLUMNS = ["employee_id", "employee_name", "project_name", "department", "position",
                         "date_of_joining", "date_of_leaving", "length_of_service_months",
                         "original_reason", "ai_category", "record_month"]


def project_dimension(*facts: DataFrame) -> DataFrame:
    """Distinct trimmed project names of the given facts, by name."""
    u = None
    for f in facts:
        s = f.select(strip_ws("project_name").alias("name"))
        u = s if u is None else u.union(s)
    return u.where(F.col("name") != "").distinct().orderBy("name")


def _names(projects: DataFrame) -> DataFrame:
    """The dimension's names, stored: it has no proven size bound, so its measured
    size decides on broadcast before the fact's rows move. Adaptive execution
    decides after that, and not for a table that fills few partitions: the rows
    of a project then meet in one task."""
    from ..session import materialize
    return materialize(projects.select(F.col("name").alias("project_name")), "projects")


def headcount_with_project(headcount: DataFrame, projects: DataFrame,
                           project=None, start=None, end=None) -> DataFrame:
    """Fact joined to the (small) project dimension, ordered by month, name."""
    h = filter_project_month(headcount, project, start, end)
    j = h.join(_names(projects), "project_name")
    return j.select("project_name", "record_month", "headcount").orderBy("record_month", "project_name")


def leavers_with_project(leavers: DataFrame, projects: DataFrame,
                         project=None, start=None, end=None) -> DataFrame:
    """Same for leavers, ordered by month, leaving date."""
    l = filter_project_month(leavers, project, start, end)
    j = l.join(_names(projects), "project_name")
    return j.orderBy("record_month", "date_of_leaving")


def filter_project_month(df: DataFrame, project=None, start=None, end=None) -> DataFrame:
    """Optional project (trimmed equality), optional inclusive month
    bounds compared as text; empty string means no filter."""
    if project:
        df = df.where(F.col("project_name") == project.strip())
    if start:
        df = df.where(F.col("record_month") >= start)
    if end:
        df = df.where(F.col("record_month") <= end)
    return df


def filter_dept_position(df: DataFrame, department=None, position=None) -> DataFrame:
    """Trimmed, case-insensitive equality."""
    if department:
        df = df.where(F.lower(strip_ws("department")) == department.strip().lower())
    if position:
        df = df.where(F.lower(strip_ws("position")) == position.strip().lower())
    return df


def filter_multiselect(df: DataFrame, projects=None, departments=None, positions=None) -> DataFrame:
    """IN filters; 'All' or empty = off; a filter whose column is absent
    is skipped (so department/position never shrink headcount)."""
    for colname, values in (("project_name", projects), ("department", departments),
                            ("position", positions)):
        if values and "All" not in values and colname in df.columns:
            df = df.where(F.col(colname).isin(list(values)))
    return df


def employee_search(df: DataFrame, query: str) -> DataFrame:
    """Name or id contains ``query`` (a regular expression),
    case-insensitive, NULL never matches; 11 detail columns."""
    pat = "(?i)" + query
    m = F.coalesce(F.col("employee_name").rlike(pat), F.lit(False)) | \
        F.coalesce(F.col("employee_id").rlike(pat), F.lit(False))
    return df.where(m).select(*LEAVER_DETAIL_COLUMNS)


def unclassified(df: DataFrame) -> DataFrame:
    """E5: category NULL, '' or 'Other'."""
    c = F.col("ai_category")
    return df.where(c.isNull() | (c == "") | (c == "Other"))


def early_leavers(df: DataFrame) -> DataFrame:
    """Service strictly below 6 months; 7 detail columns."""
    return df.where(F.col("length_of_service_months") < K.EARLY_SERVICE_MONTHS).select(
        "employee_id", "employee_name", "project_name", "department", "position",
        "length_of_service_months", "original_reason")


def terminations_detail(df: DataFrame, fill_category: str = "Other / Unclassified") -> DataFrame:
    """Status or category mentions terminat/dismiss/discharg; detail with
    tenure 'x.x mo', dates 'dd Mon YYYY', reason cut to 47 chars + '...'."""
    cat = F.coalesce(F.col("ai_category"), F.lit(fill_category)) if fill_category else F.col("ai_category")
    d = df.withColumn("_cat", cat)
    d = d.where(mentions_termination(F.col("status")) | mentions_termination(F.col("_cat")))
    orig = F.col("original_reason")
    reason = (F.when(orig.isNotNull() & (orig != ""), orig)
               .when(F.col("_cat").isNotNull() & (F.col("_cat") != ""), F.col("_cat"))
               .otherwise(F.lit("N/A")))
    reason = F.when(F.length(reason) > 50, F.concat(F.substring(reason, 1, 47), F.lit("..."))) \
              .otherwise(reason)
    return d.select(
        "employee_id", "employee_name", "project_name", "department", "position",
        F.date_format("date_of_joining", "dd MMM yyyy").alias("date_of_joining"),
        F.date_format("date_of_leaving", "dd MMM yyyy").alias("date_of_leaving"),
        F.concat(r1("length_of_service_months").cast("string"), F.lit(" mo")).alias("tenure"),
        reason.alias("reason"))


def separation_detail(df: DataFrame) -> DataFrame:
    """Per leaver the 11 display columns, tenure 1 dp, and the E8 flag
    (trimmed lower status == 'terminated'); consumers split on the flag."""
    return df.select(
        F.col("employee_id").alias("Employee ID"),
        F.col("employee_name").alias("Employee Name"),
        F.col("project_name").alias("Project"),
        F.col("department").alias("Department"),
        F.col("position").alias("Position"),
        F.col("date_of_joining").alias("Date of Joining"),
        F.col("date_of_leaving").alias("Date of Leaving"),
        r1("length_of_service_months").alias("Tenure (Months)"),
        F.col("status").alias("Status"),
        F.col("ai_category").alias("Separation Category"),
        F.col("original_reason").alias("Original Reason"),
        is_terminated_status("status").alias("is_termination"),
        "record_month")


def separation_split(df: DataFrame, periods: DataFrame) -> DataFrame:
    """Per period total separations, terminations, resignations."""
    from .dist import _pm, _with_mi
    m = (_with_mi(df).groupBy("mi").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(is_terminated_status("status"), 1).otherwise(0)).alias("t")))
    a = m.join(_pm(periods), "mi").groupBy("period_key").agg(
        F.sum("n").alias("n"), F.sum("t").alias("t"))
    j = periods.select("period_key").join(a, "period_key", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    t = F.coalesce("t", F.lit(0)).cast("long")
    return j.select("period_key", n.alias("total_separations"), t.alias("terminations"),
                    (n - t).alias("resignations"))


def separation_split_by_category(df: DataFrame) -> DataFrame:
    """E8 fallback when no status column exists: category in
    (Termination, Attendance / Discipline)."""
    return df.withColumn("is_termination",
                         F.coalesce(F.col("ai_category").isin(*K.TERMINATION_CATEGORIES), F.lit(False)))


def facet_values(df: DataFrame) -> DataFrame:
    """(facet, value) for months, departments, positions, non-null
    categories and years; display order asc (months/years desc)."""
    facets = {"month": F.col("record_month"), "department": F.col("department"),
              "position": F.col("position"), "category": F.col("ai_category"),
              "year": F.split("record_month", "-")[0]}
    # one scan: each row gives its five facets
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in facets.items()]))
    u = df.select(each.alias("f")).select("f.*").where("facet <> 'category' OR value IS NOT NULL").distinct()
    return u.orderBy("facet", F.when(F.col("facet").isin("month", "year"), F.col("value")).desc_nulls_last(),
                     "value")


def reason_detail(df: DataFrame, start=None, end=None, projects=None, departments=None,
                  positions=None, null_label: str = "Other") -> DataFrame:
    """Per leaver name, original reason, assigned category (NULL -> Other)."""
    d = filter_multiselect(filter_project_month(df, None, start, end), projects, departments, positions)
    return d.select(F.col("employee_id"), F.col("employee_name").alias("Employee"),
                    F.col("original_reason").alias("Original Reason"),
                    F.coalesce(F.col("ai_category"), F.lit(null_label)).alias("Assigned Category"))
