"""Monthly cube of the leavers: one scan for reports that need many aggregates.

Rows (mi, record_month, dimension, value, n, service_sum, service_n, early_n):
leavers per month and value of each dimension, nulls included. Map-side
aggregation leaves a row per month and value, whatever the size of the fact.
The aggregates of ``dist`` and ``turnover`` take the cube in place of the
fact; queries that use several of them store it first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import is_terminated_status, month_index, service_bracket_ordinal

ALL, BRACKET, TERMINATED = "(all)", "(bracket)", "(terminated)"
DIMENSIONS = ["project_name", "department", "position", "original_reason", "ai_category", "record_month"]


def exact_sum(c) -> Column:
    """Sum of months as a decimal: a sum of doubles would depend on the order
    in which tasks add, and a mean that lies on a rounding tie with it. Values
    of 10^24 and more are left out."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.try_cast("decimal(30, 6)"))


def monthly_cube(leavers: DataFrame) -> DataFrame:
    s = F.col("length_of_service_months")
    values = {d: F.col(d).cast("string") for d in DIMENSIONS}
    values |= {ALL: F.lit(None).cast("string"), BRACKET: service_bracket_ordinal(s).cast("string"),
               TERMINATED: is_terminated_status("status").cast("string")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("value"))
                               for k, v in values.items()]))
    return (leavers.select("record_month", s.alias("_s"), each.alias("_d"))
            .groupBy("record_month", F.col("_d.dimension").alias("dimension"), F.col("_d.value").alias("value"))
            .agg(F.count(F.lit(1)).alias("n"), exact_sum("_s").alias("service_sum"),
                 F.count("_s").alias("service_n"),
                 F.sum(F.when(F.col("_s") < K.EARLY_SERVICE_MONTHS, 1).otherwise(0)).alias("early_n"))
            .withColumn("mi", month_index("record_month")))


def is_cube(df: DataFrame) -> bool:
    return {"dimension", "value", "n"} <= set(df.columns)


def stored_cube(leavers: DataFrame) -> DataFrame:
    """The cube of a fact, written once; a cube is returned as it is."""
    from ..session import materialize
    return leavers if is_cube(leavers) else materialize(monthly_cube(leavers), "cube")


def of(cube: DataFrame, dimension: str) -> DataFrame:
    return cube.where(F.col("dimension") == dimension)
