"""Skew-safe row numbering.

``row_number() over (partition by g order by k)`` sends every row of a group
to one task; a landing file or month that holds a third of all rows would
then be sorted by a single task. The helpers below number rows without that:
rows are range-partitioned on the full sort key (so a hot group spreads over
many partitions), counted per (group, partition), the few counts are
prefix-summed, and each row adds its position inside its partition. The dealt
rows are written once before they are counted: dealing them twice could draw
other range bounds, and counts would not fit the rows any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def computed(df: DataFrame) -> DataFrame:
    """The same rows, with their columns computed once a row. A later filter
    would else be moved below and repeat every expression that its columns stand
    for; it does not pass a row id."""
    return df.withColumn("_row", F.monotonically_increasing_id()).where("_row >= 0").drop("_row")


def dealt(df: DataFrame, group: str, order_cols: list[str]) -> DataFrame:
    """Rows dealt by ranges of (group, order) and sorted inside each, marked for
    ``placed``: to be written once before it reads them."""
    return (df.repartitionByRange(group, *order_cols).sortWithinPartitions(group, *order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))


RANGE_ROWS = 250_000  # rows of a range; fewer where cores would be idle
DRAWN = 100  # rows drawn a range to find its bounds


def dealt_like(df: DataFrame, keys: DataFrame, group: str, order_cols: list[str]) -> DataFrame:
    """As ``dealt``, with ranges of (group, first of the order) drawn from
    ``keys``, which holds these two columns of about the same rows and costs less
    to read: finding the ranges in ``df`` would compute it twice. For few groups
    and an order that begins with a whole number."""
    first, spark = order_cols[0], df.sparkSession
    keys = keys.select(group, first)
    n = keys.count()
    ranges = max(-(-n // RANGE_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // (RANGE_ROWS // 10))), 1)
    drawn = keys if n <= DRAWN * ranges else keys.sample(DRAWN * ranges / n, seed=1)
    low = lambda v: (v is not None, v or 0)
    rows = sorted(map(tuple, drawn.collect()), key=lambda r: (low(r[0]), low(r[1])))
    cuts = [rows[len(rows) * i // ranges] for i in range(1, ranges)] if rows else []
    bounds = {g: [c for h, c in cuts if h == g and c is not None] for g, _ in rows}
    begun, table = 0, []
    for g, cs in bounds.items():
        of_group = ", ".join(f"{c}L" for c in cs)
        table.append(f"struct(CAST({'NULL' if g is None else g} AS LONG) AS _g, {begun} AS _begun, "
                     f"CAST(array({of_group}) AS ARRAY<LONG>) AS _bounds)")
        begun += len(cs)
    if not table:
        return dealt(df, group, order_cols)
    at = F.broadcast(spark.range(1).select(F.expr(f"inline(array({', '.join(table)}))")))
    place = F.col("_begun") + F.size(F.filter("_bounds", lambda b: b <= F.col(first)))
    # a group that was not drawn is small: it stands in one range
    placed_at = F.coalesce(place, F.pmod(F.hash(group), F.lit(ranges))).cast("int")
    return (df.join(at, F.col(group).cast("long").eqNullSafe(F.col("_g")), "left").withColumn("_to", placed_at)
              .repartitionById(ranges, "_to").drop("_g", "_begun", "_bounds", "_to")
              .sortWithinPartitions(group, *order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))


def placed(df: DataFrame, group: str, out: str = "row_num", seq: str = "_pid", few: bool = False) -> DataFrame:
    """Stored rows with their number inside the group. Rows are already in order
    inside each chunk of a group identified by ``seq``; ``_mid`` increases with
    that order inside a chunk. Dealt rows have no more chunks than groups and
    tasks together: where groups are ``few`` (months), the offsets go to the
    rows, and the rows stay in place."""
    chunks = (df.groupBy(group, seq)
                .agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0")))
    w = Window.partitionBy(group).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"d.{c}")) for c in (group, seq)]
    offsets = offsets.select(group, seq, "_off", "_m0")
    offsets = F.broadcast(offsets) if few else offsets
    j = df.alias("d").join(offsets.alias("o"), same).select("d.*", "o._off", "o._m0")
    return (j.withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).cast("int"))
             .drop("_off", "_m0", "_mid", seq))


def row_number_within(df: DataFrame, group: str, order_cols: list[str], out: str = "row_num") -> DataFrame:
    """Same values as row_number() over (partition by group order by order_cols),
    computed without collecting a group into one task. ``order_cols`` must
    make the order total."""
    from ..session import materialize
    return placed(materialize(dealt(df, group, order_cols), "numbered"), group, out)


def row_number_in_file(df: DataFrame, file_col: str = "file_name",
                       block_col: str = "_blk", out: str = "row_num") -> DataFrame:
    """Line order inside each file as read: splits ordered by their start
    offset, rows in read order inside a split (``_mid`` must be a
    monotonically_increasing_id taken right after the scan). A split is one
    chunk, so the offsets go to the rows."""
    from ..session import materialize
    return placed(materialize(df, "numbered"), file_col, out, block_col, few=True)
