"""Adjusted headcount and turnover rates.

Shape of every plan: the leavers fact is reduced first to counts per
(project, month) -- a map-side partial aggregate, so the only large scan is
pruned to two columns and the shuffle carries at most P x M rows. Headcount
history is one row per (project, month). Ranges (periods, rolling windows,
comparison pairs) are small tables exploded to their months (D5) and
equi-joined on the month index, so one plan evaluates every period at once.

Rates: leavers / denominator * 100, rounded to 2 places (ties to even), 0.0 when
the denominator is missing or not positive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import month_index, month_text, r1, r2, ratio_pct
from .cube import is_cube, of
from .periods import previous_period, range_months


# ------------------------------------------------------------ base pieces

def adjusted_headcount(headcount: DataFrame) -> DataFrame:
    """G1/D3: adj(p, m) = (hc(p, m) + hc(p, m-1)) / 2, or hc(p, m) when the
    calendar previous month has no row (a gap is not the previous row)."""
    h = headcount.select("project_name", "record_month",
                         F.col("headcount").cast("long").alias("headcount"),
                         month_index("record_month").alias("mi"))
    prev = h.select("project_name", (F.col("mi") + 1).alias("mi"),
                    F.col("headcount").alias("prev_headcount"))
    j = h.join(prev, ["project_name", "mi"], "left")
    adj = F.when(F.col("prev_headcount").isNull(), F.col("headcount").cast("double")) \
           .otherwise((F.col("headcount") + F.col("prev_headcount")) / 2.0)
    return j.select("project_name", "record_month", "mi", "headcount", "prev_headcount",
                    adj.alias("adj_headcount"))


def leaver_counts(leavers: DataFrame) -> DataFrame:
    """Leavers per (project, month): the only pass over the fact table (or its
    cube)."""
    if is_cube(leavers):
        return of(leavers, "project_name").select(
            F.col("value").alias("project_name"), "record_month", F.col("n").alias("leavers"), "mi")
    return (leavers.groupBy("project_name", "record_month").agg(F.count(F.lit(1)).alias("leavers"))
                   .withColumn("mi", month_index("record_month")))


def _monthly_adj(adj: DataFrame) -> DataFrame:
    return adj.groupBy("mi").agg(F.sum("adj_headcount").alias("adj_total"))


def _monthly_leavers(lvc: DataFrame) -> DataFrame:
    return lvc.groupBy("mi").agg(F.sum("leavers").alias("leavers"))


def overall_rates(adj: DataFrame, lvc: DataFrame, ranges: DataFrame, keys) -> DataFrame:
    """Per range: leavers in range / mean over months *with data* of the
    monthly adjusted total (G2). Leavers of projects without headcount count."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rm = range_months(ranges, keys)
    den = (rm.join(_monthly_adj(adj), "mi")
             .groupBy(*keys).agg((F.sum("adj_total") / F.count("adj_total")).alias("avg_headcount")))
    num = rm.join(_monthly_leavers(lvc), "mi").groupBy(*keys).agg(F.sum("leavers").alias("leavers"))
    out = ranges.select(*keys).join(den, keys, "left").join(num, keys, "left")
    return out.select(*keys, F.coalesce("leavers", F.lit(0)).cast("long").alias("leavers"),
                      F.col("avg_headcount"),
                      r2(ratio_pct(F.coalesce("leavers", F.lit(0)), F.col("avg_headcount")))
                      .alias("turnover_rate"))


def project_rates(adj: DataFrame, lvc: DataFrame, ranges: DataFrame, keys,
                  denominator: str = "mean") -> DataFrame:
    """Per (range, project): G3 (``mean`` of the project's adjusted headcount
    over its months with data) or G4 (``sum`` over the range). Every project
    that is known from either table has a row in every range, with zeros
    where it has neither headcount nor leavers there."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rm = range_months(ranges, keys)
    den = (rm.join(adj.select("project_name", "mi", "adj_headcount"), "mi")
             .groupBy(*keys, "project_name")
             .agg(F.sum("adj_headcount").alias("_s"), F.count("adj_headcount").alias("_n")))
    num = (rm.join(lvc.select("project_name", "mi", "leavers"), "mi")
             .groupBy(*keys, "project_name").agg(F.sum("leavers").alias("leavers")))
    j = (project_spine(adj, lvc, ranges.select(*keys))
         .join(den, keys + ["project_name"], "left").join(num, keys + ["project_name"], "left"))
    d = F.col("_s") / F.col("_n") if denominator == "mean" else F.col("_s")
    lv = F.coalesce("leavers", F.lit(0)).cast("long")
    return j.select(*keys, "project_name", lv.alias("leavers"),
                    d.alias("headcount_denominator"),
                    r2(ratio_pct(lv, d)).alias("turnover_rate"))


def project_spine(adj: DataFrame, lvc: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ranges`` with every known project: the list of names, one row, is
    looked up as a scalar and exploded in each range."""
    names = (adj.select("project_name").union(lvc.select("project_name")).distinct()
             .where(F.col("project_name").isNotNull())
             .agg(F.collect_list("project_name").alias("_names")))
    return ranges.withColumn("_names", names.scalar()).withColumn(
        "project_name", F.explode("_names")).drop("_names")


def _small(df: DataFrame, tag: str) -> DataFrame:
    """Materialize a range table derived from the distinct months (bounded
    by the calendar): it is used several times in a plan, and each use would
    otherwise enumerate the facts' rows again."""
    from ..session import materialize
    return materialize(df, tag)


def known_months(headcount: DataFrame, leavers: DataFrame) -> DataFrame:
    """Distinct months present in either table (bounded by the calendar)."""
    return (headcount.select("record_month").union(leavers.select("record_month")).distinct()
                     .withColumn("mi", month_index("record_month")).where(F.col("mi").isNotNull()))


# ---------------------------------------------------------------- queries

def overall_turnover(headcount, leavers, periods) -> DataFrame:
    """G2 for every period of ``periods``."""
    r = overall_rates(adjusted_headcount(headcount), leaver_counts(leavers), periods, "period_key")
    return (periods.select("period_key", "period_type", "start_month", "end_month")
                   .join(r, "period_key")
                   .withColumn("avg_headcount", r2(F.coalesce("avg_headcount", F.lit(0.0)))))


def project_turnover(headcount, leavers, periods, denominator="mean") -> DataFrame:
    """G3 (mean denominator) / G4 (sum denominator) for every period."""
    r = project_rates(adjusted_headcount(headcount), leaver_counts(leavers), periods,
                      "period_key", denominator)
    name = "avg_headcount" if denominator == "mean" else "adjusted_headcount"
    rnd = r2 if denominator == "mean" else r1
    return r.select("period_key", "project_name", "leavers",
                    rnd(F.coalesce("headcount_denominator", F.lit(0.0))).alias(name),
                    "turnover_rate")


def monthly_comparison(headcount, leavers, pairs: DataFrame | None = None) -> DataFrame:
    """Overall and per-project one-month rates for (current, compare)
    month pairs, with difference. Default pairs: every month with data
    against its calendar previous month. Overall rows have project_name NULL."""
    adj, lvc = adjusted_headcount(headcount), leaver_counts(leavers)
    if pairs is None:
        km = known_months(headcount, leavers)
        pairs = km.select(F.col("mi").alias("current_mi"), (F.col("mi") - 1).alias("compare_mi"))
    else:
        pairs = pairs.select(month_index("current_month").alias("current_mi"),
                             month_index("compare_month").alias("compare_mi"))
    pairs = _small(pairs, "pairs")
    months = (pairs.select(F.col("current_mi").alias("m"))
                   .union(pairs.select(F.col("compare_mi").alias("m"))).distinct()
                   .select(F.col("m").alias("start_mi"), F.col("m").alias("end_mi"),
                           F.col("m").alias("k")))
    ov = overall_rates(adj, lvc, months, "k")
    pr = project_rates(adj, lvc, months, "k")
    cur_o = ov.select(F.col("k").alias("current_mi"), F.col("turnover_rate").alias("current_rate"))
    cmp_o = ov.select(F.col("k").alias("compare_mi"), F.col("turnover_rate").alias("compare_rate"))
    overall = (pairs.join(cur_o, "current_mi", "left").join(cmp_o, "compare_mi", "left")
                    .withColumn("project_name", F.lit(None).cast("string")))
    cur_p = pr.select(F.col("k").alias("current_mi"), "project_name",
                      F.col("turnover_rate").alias("current_rate"))
    cmp_p = pr.select(F.col("k").alias("compare_mi"), "project_name",
                      F.col("turnover_rate").alias("compare_rate"))
    pc = pairs.join(cur_p, "current_mi")
    pp = pairs.join(cmp_p, "compare_mi")
    proj = pc.join(pp, ["current_mi", "compare_mi", "project_name"], "full")
    out = overall.unionByName(proj)
    cur = F.coalesce("current_rate", F.lit(0.0))
    cmpv = F.coalesce("compare_rate", F.lit(0.0))
    return out.select(month_text("current_mi").alias("current_month"),
                      month_text("compare_mi").alias("compare_month"),
                      "project_name", cur.alias("current_rate"), cmpv.alias("compare_rate"),
                      r2(cur - cmpv).alias("difference"))


def annual_trend(headcount, leavers) -> DataFrame:
    """For every year with data, its 12 calendar months: truncated sum of
    adjusted headcount, leavers, rate; zeros for empty months."""
    km = known_months(headcount, leavers)
    years = km.select(F.floor(F.col("mi") / 12).cast("int").alias("y")).distinct()
    spine = years.select(F.explode(F.sequence(F.col("y") * 12, F.col("y") * 12 + 11)).alias("mi"))
    spine = _small(spine.select(F.col("mi").alias("start_mi"), F.col("mi").alias("end_mi"),
                                F.col("mi").alias("k")), "year-spine")
    adj = adjusted_headcount(headcount)
    ov = overall_rates(adj, leaver_counts(leavers), spine, "k")
    tot = _monthly_adj(adj).select(F.col("mi").alias("k"), "adj_total")
    return (ov.join(tot, "k", "left")
              .select(month_text("k").alias("month"),
                      F.floor(F.coalesce("adj_total", F.lit(0.0))).cast("long").alias("headcount"),
                      "leavers", "turnover_rate"))


def _rolling_windows(headcount, leavers):
    km = known_months(headcount, leavers)
    return _small(km.select(F.col("mi").alias("end_mi"), (F.col("mi") - 11).alias("start_mi"),
                            F.col("mi").alias("k")), "rolling-windows")


def rolling_12m(headcount, leavers) -> DataFrame:
    """G7 overall, for every end month with data: leavers in the 12 calendar
    months ending there / mean monthly adjusted total over months with data."""
    adj, lvc = adjusted_headcount(headcount), leaver_counts(leavers)
    r = overall_rates(adj, lvc, _rolling_windows(headcount, leavers), "k")
    return r.select(month_text("k").alias("end_month"),
                    F.concat_ws(" to ", month_text(F.col("k") - 11), month_text("k")).alias("period"),
                    r2(F.coalesce("avg_headcount", F.lit(0.0))).alias("avg_headcount"),
                    F.col("leavers").alias("leavers_count"), "turnover_rate")


def rolling_12m_by_project(headcount, leavers) -> DataFrame:
    """G7 per project."""
    adj, lvc = adjusted_headcount(headcount), leaver_counts(leavers)
    r = project_rates(adj, lvc, _rolling_windows(headcount, leavers), "k")
    return r.select(month_text("k").alias("end_month"), "project_name",
                    F.col("leavers").alias("leavers_count"),
                    r2(F.coalesce("headcount_denominator", F.lit(0.0))).alias("avg_headcount"),
                    "turnover_rate")


def rate_band(rolling: DataFrame) -> DataFrame:
    """Gauge band of a rolling rate; > 30 stays in the top band."""
    r = F.col("turnover_rate")
    band = F.when(r < K.RATE_BANDS[0][1], K.RATE_BANDS[0][2]) \
            .when(r < K.RATE_BANDS[1][1], K.RATE_BANDS[1][2]).otherwise(K.RATE_BANDS[2][2])
    return rolling.select("end_month", "turnover_rate", band.alias("rate_band"))


def period_comparison(headcount, leavers, periods) -> DataFrame:
    """Each period against its previous period of equal length, overall
    (project_name NULL) and per project, with trend label."""
    adj, lvc = adjusted_headcount(headcount), leaver_counts(leavers)
    pp = previous_period(periods)
    ranges = (pp.select("period_key", F.lit("current").alias("role"), "start_mi", "end_mi")
                .unionByName(pp.select("period_key", F.lit("previous").alias("role"),
                                       F.col("prev_start_mi").alias("start_mi"),
                                       F.col("prev_end_mi").alias("end_mi"))))
    keys = ["period_key", "role"]
    ov = overall_rates(adj, lvc, ranges, keys).withColumn("project_name", F.lit(None).cast("string"))
    pr = project_rates(adj, lvc, ranges, keys)
    both = ov.select(*keys, "project_name", "turnover_rate").unionByName(
        pr.select(*keys, "project_name", "turnover_rate"))
    g = both.groupBy("period_key", "project_name").agg(
        F.max(F.when(F.col("role") == "current", F.col("turnover_rate"))).alias("current_rate"),
        F.max(F.when(F.col("role") == "previous", F.col("turnover_rate"))).alias("previous_rate"))
    cur = F.coalesce("current_rate", F.lit(0.0))
    prv = F.coalesce("previous_rate", F.lit(0.0))
    diff = r2(cur - prv)
    return g.select("period_key", "project_name", cur.alias("current_rate"),
                    prv.alias("previous_rate"), diff.alias("difference"),
                    F.when(diff > 0, "Increase").when(diff < 0, "Decrease").otherwise("Stable")
                    .alias("trend"))


def headcount_net_change(headcount, pairs: DataFrame | None = None) -> DataFrame:
    """Raw headcount of a current month against a previous month, total
    (project_name NULL) and per project. ``pairs`` has (key, cur_mi, prev_mi);
    default: every headcount month against its calendar previous month."""
    h = headcount.select("project_name", F.col("headcount").cast("long").alias("headcount"),
                         month_index("record_month").alias("mi"))
    if pairs is None:
        pairs = (h.select("mi").distinct()
                  .select(month_text("mi").alias("key"), F.col("mi").alias("cur_mi"),
                          (F.col("mi") - 1).alias("prev_mi")))
    cur = pairs.join(h.withColumnRenamed("mi", "cur_mi"), "cur_mi") \
               .groupBy("key", "project_name").agg(F.sum("headcount").alias("current_headcount"))
    prv = pairs.join(h.withColumnRenamed("mi", "prev_mi"), "prev_mi") \
               .groupBy("key", "project_name").agg(F.sum("headcount").alias("previous_headcount"))
    spine = project_spine(h, h.limit(0), pairs.select("key").distinct())
    proj = spine.join(cur, ["key", "project_name"], "left").join(prv, ["key", "project_name"], "left")
    tot = (proj.groupBy("key").agg(F.sum("current_headcount").alias("current_headcount"),
                                   F.sum("previous_headcount").alias("previous_headcount"))
               .withColumn("project_name", F.lit(None).cast("string")))
    tot = pairs.select("key").join(tot, "key", "left").withColumn(
        "project_name", F.lit(None).cast("string"))
    out = proj.unionByName(tot)
    c = F.coalesce("current_headcount", F.lit(0)).cast("long")
    p = F.coalesce("previous_headcount", F.lit(0)).cast("long")
    net = c - p
    return out.select("key", "project_name", p.alias("previous_headcount"),
                      c.alias("current_headcount"), net.alias("net_change"),
                      F.when(p > 0, r1(net / p * 100)).otherwise(F.lit(0.0)).alias("pct_change"),
                      F.when(net > 0, "Increase").when(net < 0, "Decrease").otherwise("No Change")
                      .alias("direction"))


def period_end_pairs(periods: DataFrame) -> DataFrame:
    """Report form of G11: end month against the end of the previous period."""
    return periods.select(F.col("period_key").alias("key"), F.col("end_mi").alias("cur_mi"),
                          (F.col("start_mi") - 1).alias("prev_mi"))


def headcount_trend(headcount) -> DataFrame:
    """Per month raw total and adjusted total (1 dp)."""
    adj = adjusted_headcount(headcount)
    return adj.groupBy("record_month").agg(F.sum("headcount").alias("raw_headcount"),
                                           r1(F.sum("adj_headcount")).alias("adjusted_headcount"))


def monthly_turnover_trend(headcount, leavers) -> DataFrame:
    """Every month that has leavers: adjusted total, departures, rate,
    alert when the rate is above 5."""
    adj = adjusted_headcount(headcount)
    lm = leaver_counts(leavers).groupBy("mi").agg(F.sum("leavers").alias("departures"))
    j = lm.join(_monthly_adj(adj), "mi", "left")
    hc = F.coalesce("adj_total", F.lit(0.0))
    rate = r2(ratio_pct(F.col("departures"), hc))
    return j.select(month_text("mi").alias("month"), hc.alias("adjusted_headcount"),
                    "departures", rate.alias("turnover_rate"),
                    (rate > K.MONTHLY_ALERT_RATE).alias("alert"))


def project_month_matrix(headcount, leavers) -> DataFrame:
    """G14 long form: per (project, month) one-month rate, label Mon-YY."""
    km = known_months(headcount, leavers)
    months = _small(km.select(F.col("mi").alias("start_mi"), F.col("mi").alias("end_mi"),
                              F.col("mi").alias("k")), "months")
    r = project_rates(adjusted_headcount(headcount), leaver_counts(leavers), months, "k")
    return r.select("project_name", month_text("k").alias("record_month"),
                    F.date_format(F.to_date(F.concat(month_text("k"), F.lit("-01"))), "MMM-yy")
                    .alias("month_label"), "turnover_rate")


def matrix_view(matrix: DataFrame) -> DataFrame:
    """Wide display of G14 (one column per month label); months come from the
    data, so pivot values are computed by Spark, not listed on the driver."""
    return matrix.groupBy("project_name").pivot("month_label").agg(F.first("turnover_rate")).fillna(0.0)


def highest_turnover_project(project_rates_df: DataFrame, periods: DataFrame) -> DataFrame:
    """Per period the project with the largest rate (ties: first by
    name); 'None' / 0.0 unless the best rate is > 0."""
    best = (project_rates_df.groupBy("period_key").agg(
        F.min_by("project_name", F.struct((-F.col("turnover_rate")).alias("a"),
                                          F.col("project_name").alias("b"))).alias("_p"),
        F.max("turnover_rate").alias("_r")))
    j = periods.select("period_key").join(best, "period_key", "left")
    ok = F.coalesce(F.col("_r"), F.lit(0.0)) > 0
    return j.select("period_key",
                    F.when(ok, F.col("_p")).otherwise(F.lit("None")).alias("highest_turnover_project"),
                    F.when(ok, F.col("_r")).otherwise(F.lit(0.0)).alias("highest_turnover_rate"))
