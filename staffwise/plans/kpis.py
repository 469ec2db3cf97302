"""Period KPI tables and the deterministic narrative.

One row per period for *all* periods in one plan; each block (rates,
summary, top areas, highest project) is a small per-period aggregate joined
by period_key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import r1, r2, ratio_pct
from ..operators import dist as DI
from ..operators import filters as FI
from ..operators import turnover as T
from ..operators.cube import stored_cube
from ..operators.periods import previous_period, range_months


def _current_previous_rates(headcount, leavers, periods) -> DataFrame:
    adj, lvc = T.adjusted_headcount(headcount), T.leaver_counts(leavers)
    pp = previous_period(periods)
    ranges = (pp.select("period_key", F.lit("current").alias("role"), "start_mi", "end_mi")
                .unionByName(pp.select("period_key", F.lit("previous").alias("role"),
                                       F.col("prev_start_mi").alias("start_mi"),
                                       F.col("prev_end_mi").alias("end_mi"))))
    ov = T.overall_rates(adj, lvc, ranges, ["period_key", "role"])
    return ov.groupBy("period_key").agg(
        F.max(F.when(F.col("role") == "current", F.col("turnover_rate"))).alias("current_turnover"),
        F.max(F.when(F.col("role") == "previous", F.col("turnover_rate"))).alias("previous_turnover"))


def period_kpis(headcount: DataFrame, leavers: DataFrame, periods: DataFrame) -> DataFrame:
    """Per period current/previous rate, difference, departures, mean
    service, highest-rate project, top department and reason, early count,
    period labels; 'N/A' / 0 defaults."""
    leavers = stored_cube(leavers)  # one scan of the fact for all that follows
    pp = previous_period(periods).select("period_key", F.col("range_label").alias("current_label"),
                                         F.col("prev_range_label").alias("previous_label"))
    rates = _current_previous_rates(headcount, leavers, periods)
    tot = DI.period_totals(leavers, periods)  # one aggregate for mean service and early count
    mean = F.when(F.col("service_n") > 0, F.col("service_sum") / F.col("service_n"))
    summ = tot.select("period_key", "total_leavers",
                      r2(F.coalesce(mean, F.lit(0.0))).alias("average_service_length_months"),
                      F.col("early_n").alias("early_turnover_count"))
    high = T.highest_turnover_project(T.project_turnover(headcount, leavers, periods), periods)
    top = DI.top_affected(leavers, periods, top_n=1)
    tops = top.groupBy("period_key").agg(
        F.max(F.when(F.col("dimension") == "department", F.col("name"))).alias("highest_dept"),
        F.max(F.when(F.col("dimension") == "department", F.col("count"))).alias("highest_dept_count"),
        F.max(F.when(F.col("dimension") == "reason", F.col("name"))).alias("most_common_reason"),
        F.max(F.when(F.col("dimension") == "reason", F.col("count"))).alias("most_common_reason_count"))
    j = (pp.join(rates, "period_key", "left").join(summ, "period_key", "left")
           .join(high, "period_key", "left")
           .join(tops, "period_key", "left"))
    cur = F.coalesce("current_turnover", F.lit(0.0))
    prv = F.coalesce("previous_turnover", F.lit(0.0))
    return j.select(
        "period_key", "current_label", "previous_label",
        cur.alias("current_turnover"), prv.alias("previous_turnover"), r2(cur - prv).alias("difference"),
        F.col("total_leavers").alias("total_departures"), "average_service_length_months",
        "highest_turnover_project", "highest_turnover_rate",
        F.coalesce("highest_dept", F.lit("N/A")).alias("highest_dept"),
        F.coalesce("highest_dept_count", F.lit(0)).cast("long").alias("highest_dept_count"),
        F.coalesce("most_common_reason", F.lit("N/A")).alias("most_common_reason"),
        F.coalesce("most_common_reason_count", F.lit(0)).cast("long").alias("most_common_reason_count"),
        "early_turnover_count")


def dashboard_kpis(headcount: DataFrame, leavers: DataFrame, periods: DataFrame,
                   projects=None, departments=None, positions=None) -> DataFrame:
    """Per period filtered raw headcount, adjusted headcount (1 dp),
    leavers, rate on the *sum* of adjusted headcount, early count. The
    department/position filters do not apply to headcount (no such column)."""
    pm = F.broadcast(range_months(periods, "period_key"))
    hc = FI.filter_multiselect(headcount, projects, departments, positions)
    adj = FI.filter_multiselect(T.adjusted_headcount(headcount).drop("headcount")
                                .withColumnRenamed("adj_headcount", "adj"),
                                projects, departments, positions)
    lv = FI.filter_multiselect(leavers, projects, departments, positions)
    raw = (DI._with_mi(hc).join(pm, "mi").groupBy("period_key")
           .agg(F.sum("headcount").alias("hc")))
    ad = adj.join(pm, "mi").groupBy("period_key").agg(F.sum("adj").alias("adj"))
    l = (DI._with_mi(lv).groupBy("mi").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(F.col("length_of_service_months") < K.EARLY_SERVICE_MONTHS, 1)
                  .otherwise(0)).alias("e"))
         .join(pm, "mi").groupBy("period_key").agg(F.sum("n").alias("n"), F.sum("e").alias("e")))
    j = (periods.select("period_key").join(raw, "period_key", "left")
         .join(ad, "period_key", "left").join(l, "period_key", "left"))
    adj_val = r1(F.coalesce("adj", F.lit(0.0)))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return j.select("period_key", F.coalesce("hc", F.lit(0)).cast("long").alias("headcount"),
                    adj_val.alias("headcount_adjusted"), n.alias("leavers"),
                    r2(ratio_pct(n, adj_val)).alias("turnover"),
                    F.coalesce("e", F.lit(0)).cast("long").alias("early_turnover"))


def report_kpis(headcount: DataFrame, leavers: DataFrame, periods: DataFrame) -> DataFrame:
    """Report header per period: person-months of headcount (F14),
    departures, rate (G2), change against the previous period and its text,
    number of known projects."""
    leavers = stored_cube(leavers)
    rates = _current_previous_rates(headcount, leavers, periods)
    pm_tot = DI.total_person_months(headcount, periods)
    dep = DI.period_totals(leavers, periods).select("period_key", "total_leavers")
    # one number, looked up as a scalar
    n_proj = (FI.project_dimension(headcount, T.leaver_counts(leavers))
              .agg(F.count(F.lit(1)).alias("projects_analyzed")))
    j = (periods.select("period_key").join(pm_tot, "period_key", "left")
         .join(dep, "period_key", "left").join(rates, "period_key", "left")
         .withColumn("projects_analyzed", n_proj.scalar()))
    cur = F.coalesce("current_turnover", F.lit(0.0))
    chg = r2(cur - F.coalesce("previous_turnover", F.lit(0.0)))
    return j.select("period_key", "total_headcount", F.col("total_leavers").alias("total_departures"),
                    cur.alias("turnover_rate"), chg.alias("turnover_change"),
                    F.concat(F.when(chg > 0, F.lit("+")).otherwise(F.lit("")), chg.cast("string"),
                             F.lit("%")).alias("change_text"),
                    F.col("projects_analyzed").cast("long").alias("projects_analyzed"))


def _num(c):
    return F.col(c).cast("string")


def period_narrative(kpis: DataFrame) -> DataFrame:
    """A text per period made of its KPI row: the rate and how it moved,
    where departures concentrate, and three recommendations, the third by
    whether there were early departures; a short note where nothing was
    recorded."""
    c = F.col
    moved = (F.when(c("difference") > 0, F.concat(F.lit("up "), _num("difference")))
              .when(c("difference") < 0, F.concat(F.lit("down "), F.abs(c("difference")).cast("string")))
              .otherwise(F.lit("unchanged")))
    early = F.when(c("early_turnover_count") > 0, F.concat(
        F.lit("first months: "), _num("early_turnover_count"),
        F.lit(" stayed under half a year; follow new colleagues through their first weeks"))).otherwise(
        F.lit("first months: nobody left early; keep the introduction of new colleagues as it is"))
    lines = [
        F.concat(F.lit("Executive Summary - "), c("current_label")),
        F.concat_ws(" | ", F.concat(F.lit("rate: "), _num("current_turnover"), F.lit("%")),
                    F.concat(F.lit("against "), c("previous_label"), F.lit(" ("), _num("previous_turnover"),
                             F.lit("%): "), moved),
                    F.concat(F.lit("departures: "), _num("total_departures")),
                    F.concat(F.lit("mean service in months: "), _num("average_service_length_months"))),
        F.concat(F.lit("by project: "), c("highest_turnover_project"), F.lit(" "),
                 _num("highest_turnover_rate"), F.lit("%")),
        F.concat(F.lit("by department: "), c("highest_dept"), F.lit(" "), _num("highest_dept_count")),
        F.concat(F.lit("by reason: "), c("most_common_reason"), F.lit(" "), _num("most_common_reason_count")),
        F.concat(F.lit("**"), _num("early_turnover_count"), F.lit("** early departures")),
        F.lit("recommended:"),
        F.concat(F.lit("1) department "), c("highest_dept"), F.lit(": ask there first why people go, it lost "),
                 _num("highest_dept_count")),
        F.concat(F.lit("2) reason "), c("most_common_reason"), F.lit(": check what can be changed about it, "),
                 _num("most_common_reason_count"), F.lit(" named it")),
        F.concat(F.lit("3) "), early),
    ]
    empty = F.concat(lines[0], F.lit("\nNothing recorded."))
    none = (c("total_departures") == 0) & (c("current_turnover") == 0.0)
    return kpis.select("period_key", F.when(none, empty).otherwise(F.concat_ws("\n", *lines)).alias("narrative"))


def report_marts(headcount: DataFrame, leavers: DataFrame, periods: DataFrame) -> dict:
    """Every report section as a DataFrame keyed by period_key; all
    sections read one stored cube of the leavers."""
    leavers = stored_cube(leavers)
    return {
        "kpis": report_kpis(headcount, leavers, periods),
        "net_change": T.headcount_net_change(headcount, T.period_end_pairs(periods))
                       .withColumnRenamed("key", "period_key"),
        "project_rates": T.period_comparison(headcount, leavers, periods),
        "departments": DI.department_risk(leavers, periods),
        "positions": DI.position_top10(leavers, periods),
        "reasons": DI.reason_share(leavers, periods),
        "voluntary": DI.voluntary_split(leavers, periods),
        "tenure": DI.bracket_counts(leavers, periods),
        "monthly_trend": T.monthly_turnover_trend(headcount, leavers),
    }


def write_report_marts(marts: dict, root: str) -> dict:
    """Persist each section as one Parquet table in order of its period (or
    month): sections are aggregates of a few thousand rows, so a folder per
    period would be mostly file listing; a reader of one period skips by the
    statistics of row groups and, in larger tables, by ranges of files."""
    paths = {}
    for name, df in marts.items():
        path = f"{root.rstrip('/')}/{name}"
        key = "period_key" if "period_key" in df.columns else df.columns[0]
        df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
        paths[name] = path
    return paths


def mart_digest(mart: DataFrame) -> DataFrame:
    """(rows, digest) of a section: the sum of a hash of each row, its numbers
    in hundredths (they have two decimals at most), columns in order of name."""
    def text(name, kind):
        if kind == "boolean":
            return F.col(name).cast("int").cast("string")
        if kind == "string":
            return F.col(name)
        return F.round(F.col(name) * 100).cast("long").cast("string")

    row = F.concat_ws("|", *(F.coalesce(text(n, k), F.lit("-")) for n, k in sorted(mart.dtypes)))
    return mart.agg(F.count(F.lit(1)).alias("rows"),
                    F.coalesce(F.sum(F.conv(F.substring(F.md5(row), 1, 10), 16, 10).cast("long")),
                               F.lit(0)).alias("digest"))
