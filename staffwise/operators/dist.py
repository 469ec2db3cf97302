"""Distributions and aggregates over leavers and headcount.

Every period-level aggregate is computed for all periods in one plan: the
leavers fact is first reduced to counts per (month, dimension value) -- a
partial aggregate before the shuffle -- and only those small rows are joined
to the period months (D5). A value that holds a third of all rows is one
pre-aggregated row per month, so hot keys never reach a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import (month_index, r1, r2, service_bracket, service_bracket_ordinal)
from .cube import ALL, BRACKET, DIMENSIONS, TERMINATED, exact_sum, is_cube, of, stored_cube
from .periods import range_months


def _pm(periods: DataFrame) -> DataFrame:
    # bounded by the calendar (<= 48 period-months per data month)
    return F.broadcast(range_months(periods, "period_key"))


def _with_mi(df: DataFrame) -> DataFrame:
    return df.withColumn("mi", month_index("record_month"))


def _stack(lv: DataFrame, dims) -> DataFrame:
    """(mi, dimension, value) for every listed dimension, one scan."""
    args = ", ".join(f"'{d}', CAST(`{d}` AS STRING)" for d in dims)
    return _with_mi(lv).select("mi", F.expr(f"stack({len(dims)}, {args}) AS (dimension, value)"))


def dim_counts(lv: DataFrame, periods: DataFrame, dims=DIMENSIONS) -> DataFrame:
    """(period_key, dimension, value, departures), NULL values dropped."""
    if is_cube(lv):
        monthly = lv.where(F.col("dimension").isin(*dims) & F.col("value").isNotNull()) \
                    .select("mi", "dimension", "value", "n")
    else:
        monthly = (_stack(lv, dims).where(F.col("value").isNotNull())
                   .groupBy("mi", "dimension", "value").agg(F.count(F.lit(1)).alias("n")))
    return (monthly.join(_pm(periods), "mi")
                   .groupBy("period_key", "dimension", "value")
                   .agg(F.sum("n").cast("long").alias("departures")))


def period_totals(lv: DataFrame, periods: DataFrame) -> DataFrame:
    """(period_key, total_leavers, service_sum, service_n, early_n) for every
    period (0 when it has no leavers)."""
    if is_cube(lv):
        monthly = of(lv, ALL).select("mi", "n", F.col("service_sum").alias("ss"), F.col("service_n").alias("sn"),
                                     F.col("early_n").alias("early"))
    else:
        s = F.col("length_of_service_months")
        monthly = (_with_mi(lv).groupBy("mi").agg(
            F.count(F.lit(1)).alias("n"), exact_sum(s).alias("ss"), F.count(s).alias("sn"),
            F.sum(F.when(s < K.EARLY_SERVICE_MONTHS, 1).otherwise(0)).alias("early")))
    agg = (monthly.join(_pm(periods), "mi").groupBy("period_key")
                  .agg(F.sum("n").alias("total_leavers"), F.sum("ss").alias("service_sum"),
                       F.sum("sn").alias("service_n"), F.sum("early").alias("early_n")))
    out = periods.select("period_key").join(agg, "period_key", "left")
    return out.select("period_key",
                      F.coalesce("total_leavers", F.lit(0)).cast("long").alias("total_leavers"),
                      F.col("service_sum").cast("double").alias("service_sum"), "service_n",
                      F.coalesce("early_n", F.lit(0)).cast("long").alias("early_n"))


# -------------------------------------------------------------- F1 - F3

def avg_headcount(headcount: DataFrame, periods: DataFrame) -> DataFrame:
    """F1: AVG of raw headcount rows in each period; 0.0 when none."""
    a = (_with_mi(headcount).join(_pm(periods), "mi").groupBy("period_key")
         .agg((F.sum("headcount") / F.count("headcount")).alias("a")))
    return periods.select("period_key").join(a, "period_key", "left").select(
        "period_key", r2(F.coalesce("a", F.lit(0.0))).alias("avg_headcount"))


def project_avg_headcount(headcount: DataFrame, periods: DataFrame) -> DataFrame:
    """AVG per (period, project); display order is avg desc."""
    return (_with_mi(headcount).join(_pm(periods), "mi").groupBy("period_key", "project_name")
            .agg(r2(F.sum("headcount") / F.count("headcount")).alias("avg_headcount"))
            .orderBy("period_key", F.desc("avg_headcount"), "project_name"))


def leaver_counts_project_month(lv: DataFrame) -> DataFrame:
    """COUNT per (project, month)."""
    return lv.groupBy("project_name", "record_month").agg(F.count(F.lit(1)).alias("leaver_count"))


# -------------------------------------------------------------- F4 - F8

SERIES = 15  # values that a chart shows


def distribution(lv: DataFrame, periods: DataFrame, dims=DIMENSIONS, most: int | None = None) -> DataFrame:
    """departures by each dimension value, per period; with ``most`` only
    that many of each series, largest first, ties in order of the value."""
    counts = dim_counts(lv, periods, dims)
    if most is None:
        return counts
    order = Window.partitionBy("period_key", "dimension").orderBy(F.desc("departures"), F.asc_nulls_last("value"))
    return counts.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most).drop("_place")


def summary_metrics(lv: DataFrame, periods: DataFrame) -> DataFrame:
    """total leavers and mean service (2 dp, 0.0 when empty) per period."""
    t = period_totals(lv, periods)
    mean = F.when(F.col("service_n") > 0, F.col("service_sum") / F.col("service_n"))
    return t.select("period_key", "total_leavers",
                    r2(F.coalesce(mean, F.lit(0.0))).alias("average_service_length_months"))


def service_brackets(lv: DataFrame) -> DataFrame:
    """per leaver its tenure bracket."""
    s = F.col("length_of_service_months")
    return lv.select("employee_id", s, service_bracket(s).alias("service_bracket"))


def _bracket_monthly(lv):
    if is_cube(lv):
        return of(lv, BRACKET).select("mi", F.col("value").cast("int").alias("ordinal"), "n")
    s = F.col("length_of_service_months")
    return (_with_mi(lv).groupBy("mi", service_bracket_ordinal(s).alias("ordinal"))
                        .agg(F.count(F.lit(1)).alias("n")))


def bracket_counts_present(lv: DataFrame, periods: DataFrame) -> DataFrame:
    """F7 (a): brackets present in the period, fixed order, Unknown included."""
    labels = F.create_map(*[x for o, lab, _ in K.BRACKETS + [K.UNKNOWN_BRACKET]
                            for x in (F.lit(o), F.lit(lab))])
    c = (_bracket_monthly(lv).join(_pm(periods), "mi").groupBy("period_key", "ordinal")
         .agg(F.sum("n").cast("long").alias("departures")))
    return c.select("period_key", "ordinal", labels[F.col("ordinal")].alias("service_bracket"),
                    "departures")


def bracket_counts(lv: DataFrame, periods: DataFrame) -> DataFrame:
    """F7 (b): the five brackets, zero-filled, Unknown dropped, share of all
    departures (1 dp) and implication text."""
    spine = F.array(*[F.struct(F.lit(o).alias("ordinal"), F.lit(lab).alias("service_bracket"),
                               F.lit(imp).alias("implication")) for o, lab, imp in K.BRACKETS])
    s = periods.select("period_key", F.explode(spine).alias("b")).select("period_key", "b.*")
    c = (_bracket_monthly(lv).join(_pm(periods), "mi").groupBy("period_key", "ordinal")
         .agg(F.sum("n").alias("departures")))
    t = period_totals(lv, periods).select("period_key", "total_leavers")
    j = s.join(c, ["period_key", "ordinal"], "left").join(t, "period_key", "left")
    dep = F.coalesce("departures", F.lit(0)).cast("long")
    share = F.when(F.col("total_leavers") > 0, r1(dep / F.col("total_leavers") * 100)).otherwise(0.0)
    return j.select("period_key", "ordinal", "service_bracket", dep.alias("departures"),
                    share.alias("share_pct"), "implication")


def early_share(lv: DataFrame, periods: DataFrame) -> DataFrame:
    """first two brackets (Unknown excluded), percent of all (1 dp)."""
    b = bracket_counts(lv, periods)
    e = b.where(F.col("ordinal") <= 2).groupBy("period_key").agg(F.sum("departures").alias("early_count"))
    t = period_totals(lv, periods).select("period_key", "total_leavers")
    j = t.join(e, "period_key", "left")
    ec = F.coalesce("early_count", F.lit(0)).cast("long")
    return j.select("period_key", ec.alias("early_count"),
                    F.when(F.col("total_leavers") > 0, r1(ec / F.col("total_leavers") * 100))
                    .otherwise(0.0).alias("early_pct"))


def _ranked(counts: DataFrame, part_cols, n=None):
    w = Window.partitionBy(*part_cols).orderBy(F.col("departures").desc(), F.col("value"))
    r = counts.withColumn("rank", F.row_number().over(w))
    return r.where(F.col("rank") <= n) if n is not None else r


def top_affected(lv: DataFrame, periods: DataFrame, top_n: int = 3) -> DataFrame:
    """F8: top-N departments, positions and reasons per period, with count
    and share of all rows (2 dp). Reason = category when any category in the
    period is non-null, else the original reason. Ties: count desc, value asc."""
    lv = stored_cube(lv)
    c = dim_counts(lv, periods, ["department", "position", "ai_category", "original_reason"])
    has_cat = (c.where(F.col("dimension") == "ai_category").groupBy("period_key")
                .agg(F.lit(True).alias("has_cat")))
    c = c.join(has_cat, "period_key", "left")
    has = F.coalesce("has_cat", F.lit(False))
    keep = (F.col("dimension").isin("department", "position")
            | ((F.col("dimension") == "ai_category") & has)
            | ((F.col("dimension") == "original_reason") & ~has))
    c = c.where(keep).withColumn(
        "dimension", F.when(F.col("dimension").isin("ai_category", "original_reason"), "reason")
        .otherwise(F.col("dimension")))
    t = period_totals(lv, periods).select("period_key", "total_leavers")
    r = _ranked(c, ["period_key", "dimension"], top_n).join(t, "period_key")
    return r.select("period_key", "dimension", "rank", F.col("value").alias("name"),
                    F.col("departures").alias("count"),
                    r2(F.col("departures") / F.col("total_leavers") * 100).alias("percentage"))


# ------------------------------------------------------------- F9 - F14

def _single_dim_share(lv, periods, dimension, label, name):
    """Share of each label; ``label`` makes it from the dimension's value."""
    monthly = (of(lv, dimension).select("mi", label(F.col("value")).alias("value"), "n")
               .where(F.col("value").isNotNull()))
    c = (monthly.join(_pm(periods), "mi").groupBy("period_key", "value")
                .agg(F.sum("n").cast("long").alias("departures")))
    t = period_totals(lv, periods).select("period_key", "total_leavers")
    j = c.join(t, "period_key")
    return j.select("period_key", F.col("value").alias(name), "departures",
                    r1(F.col("departures") / F.col("total_leavers") * 100).alias("share_pct"))


def department_risk(lv: DataFrame, periods: DataFrame) -> DataFrame:
    """departures per department, share (1 dp), risk level, top flag."""
    d = _single_dim_share(stored_cube(lv), periods, "department", lambda v: v, "department")
    top = d.groupBy("period_key").agg(F.min_by("department", F.struct(
        (-F.col("departures")).alias("n"), F.col("department").alias("d"))).alias("_top"))
    risk = (F.when(F.col("share_pct") > K.DEPT_RISK_HIGH, "High")
             .when(F.col("share_pct") > K.DEPT_RISK_MEDIUM, "Medium").otherwise("Low"))
    return d.join(top, "period_key").select(
        *d.columns, risk.alias("risk_level"), (F.col("department") == F.col("_top")).alias("is_top"))


def position_top10(lv: DataFrame, periods: DataFrame, n: int = 10) -> DataFrame:
    """top positions by departures per period (rank <= n)."""
    c = dim_counts(lv, periods, ["position"])
    r = _ranked(c, ["period_key"], n)
    return r.select("period_key", "rank", F.col("value").alias("position"), "departures")


def reason_share(lv: DataFrame, periods: DataFrame,
                 null_label: str = "Other / Unclassified") -> DataFrame:
    """category share (1 dp); NULL category shown as ``null_label``
    ('Other / Unclassified' in the report, 'Other' on screen)."""
    return _single_dim_share(stored_cube(lv), periods, "ai_category",
                             lambda v: F.coalesce(v, F.lit(null_label)), "category")


def voluntary_split(lv: DataFrame, periods: DataFrame) -> DataFrame:
    """Involuntary when trimmed lower status == 'terminated', else
    Voluntary (NULL status too); share (1 dp)."""
    return _single_dim_share(
        stored_cube(lv), periods, TERMINATED, lambda v: F.when(v == "true", "Involuntary (Terminated)")
        .otherwise("Voluntary (Resigned)"), "separation_type")


def total_person_months(headcount: DataFrame, periods: DataFrame) -> DataFrame:
    """sum of raw headcount over every month of the period."""
    s = (_with_mi(headcount).join(_pm(periods), "mi").groupBy("period_key")
         .agg(F.sum("headcount").alias("s")))
    return periods.select("period_key").join(s, "period_key", "left").select(
        "period_key", F.coalesce("s", F.lit(0)).cast("long").alias("total_headcount"))
