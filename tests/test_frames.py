"""Skew-safe row numbering equals row_number() (one group holds most rows)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from staffwise.functions.frames import row_number_within


def test_row_number_within_matches_window(spark):
    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise((F.col("id") % 10).cast("string")).alias("g"),
        ((F.col("id") * 7919) % 5003).alias("k"), "id")
    got = {(r["g"], r["id"]): r["rn"] for r in row_number_within(df, "g", ["k", "id"], "rn").collect()}
    w = Window.partitionBy("g").orderBy("k", "id")
    want = {(r["g"], r["id"]): r["rn"] for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == want


def test_no_row_is_lost_at_size(spark):
    n = 2_000_000
    df = spark.range(0, n, 1, 16).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise((F.col("id") % 2).cast("string")).alias("g"),
        ((F.col("id") * 7919) % 1_000_003).alias("k"), "id", F.repeat(F.lit("x"), 60).alias("payload"))
    got = row_number_within(df, "g", ["k", "id"], "rn").select("id", "rn", "payload")
    w = Window.partitionBy("g").orderBy("k", "id")
    want = df.select("id", F.row_number().over(w).alias("want"))
    bad = got.join(want, "id", "full").where("rn IS NULL OR want IS NULL OR rn <> want OR payload IS NULL")
    assert got.count() == n and bad.isEmpty()
