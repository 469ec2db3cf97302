"""Period calendar (G9), previous period (G8) and period -> months.

Periods are derived from the distinct months that carry data, so their number
is bounded by the calendar (at most four periods per month with data); that
bound is what makes broadcasting them safe at any data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import month_index, month_text

PERIOD_COLUMNS = ["period_key", "period_type", "period_label", "start_month", "end_month",
                  "start_mi", "end_mi"]


def _finish(df: DataFrame) -> DataFrame:
    return (df.withColumn("start_month", month_text("start_mi"))
              .withColumn("end_month", month_text("end_mi"))
              .withColumn("period_key", F.col("period_label"))
              .select(*PERIOD_COLUMNS))


def period_calendar(leavers: DataFrame, types=("Monthly", "Quarterly", "Semi-Annual",
                                               "Annual")) -> DataFrame:
    """Monthly, quarterly, semi-annual and annual periods containing data months.

    Quarter / half / year ends are calendar ends even without data there.
    One aggregation (distinct months) feeds all period kinds: each month is
    exploded to the (at most four) periods that contain it, then deduplicated.
    """
    m = (leavers.select(month_index("record_month").alias("mi")).distinct()
                .where(F.col("mi").isNotNull())
                .withColumn("y", F.floor(F.col("mi") / 12).cast("int"))
                .withColumn("mo", (F.col("mi") - F.col("y") * 12).cast("int")))  # 0-based
    q = F.floor(F.col("mo") / 3).cast("int")
    h = F.when(F.col("mo") < 6, 0).otherwise(1)
    y12 = F.col("y") * 12
    kinds = {
        "Monthly": (month_text("mi"), F.col("mi"), F.col("mi")),
        "Quarterly": (F.format_string("%d Q%d", F.col("y"), q + 1), y12 + q * 3, y12 + q * 3 + 2),
        "Semi-Annual": (F.format_string("%d H%d", F.col("y"), h + 1), y12 + h * 6, y12 + h * 6 + 5),
        "Annual": (F.format_string("%d Full Year", F.col("y")), y12, y12 + 11),
    }
    structs = [F.struct(F.lit(t).alias("period_type"), lab.alias("period_label"),
                        s_.cast("int").alias("start_mi"), e_.cast("int").alias("end_mi"))
               for t, (lab, s_, e_) in kinds.items() if t in types]
    out = m.select(F.explode(F.array(*structs)).alias("p")).select("p.*").distinct()
    return _finish(out)


def custom_period(spark: SparkSession, start_month: str, end_month: str) -> DataFrame:
    """A 'Custom Range' period; both ends are required (a half-open range is
    rejected, see README)."""
    if not start_month or not end_month:
        raise ValueError("custom period needs both start and end month (YYYY-MM)")
    if assert_month(start_month) > assert_month(end_month):
        raise ValueError(f"custom period ends before it starts: {start_month}, {end_month}")
    df = spark.range(1).select(
        F.lit("Custom").alias("period_type"),
        F.lit(f"{start_month} → {end_month}").alias("period_label"),
        month_index(F.lit(start_month)).cast("int").alias("start_mi"),
        month_index(F.lit(end_month)).cast("int").alias("end_mi"))
    return _finish(df)


def previous_period(periods: DataFrame) -> DataFrame:
    """Preceding range of equal length, plus display labels."""
    n = F.col("end_mi") - F.col("start_mi") + 1
    p = (periods.withColumn("prev_start_mi", (F.col("start_mi") - n).cast("int"))
                .withColumn("prev_end_mi", (F.col("start_mi") - 1).cast("int"))
                .withColumn("prev_start_month", month_text("prev_start_mi"))
                .withColumn("prev_end_month", month_text("prev_end_mi")))
    single = F.col("start_mi") == F.col("end_mi")
    return (p.withColumn("range_label", F.when(single, F.col("start_month")).otherwise(
                F.concat_ws(" to ", "start_month", "end_month")))
             .withColumn("prev_range_label", F.when(single, F.col("prev_end_month")).otherwise(
                F.concat_ws(" to ", "prev_start_month", "prev_end_month"))))


def range_months(ranges: DataFrame, keys, start="start_mi", end="end_mi") -> DataFrame:
    """(keys..., mi) for every month of every range; no nested-loop join."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return ranges.select(*keys, F.explode(F.sequence(F.col(start), F.col(end))).alias("mi"))


def assert_month(month: str) -> str:
    """Malformed months raise (the reference falls back silently in places)."""
    import re
    if not isinstance(month, str) or not re.fullmatch(r"\d{4}-\d{2}", month) \
            or not 1 <= int(month[5:]) <= 12:
        raise ValueError(f"Invalid month '{month}'. Expected YYYY-MM.")
    return month
