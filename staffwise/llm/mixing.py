"""Mixing sources to target weights by systematic sampling.

Size of a document: its number of words; null texts count as empty. Sources in
order of code points, the null source last, carry the weights 5, 2, 1,
repeating, and share the total of all sizes by them; a source's target stops
at ``most`` times its size and what it cannot take is shared by weight among
the others, until none is above.

Each document of a source expects target / source size copies. Prefix sums of
these along the source's documents, plus one random offset of the source, are
cut at the integers: a document is emitted once for each integer that its own
stretch crosses, so each is emitted its expected number of times, rounded up
or down, and any run of documents gets its expected number to within one.
Along a source, one random half of the documents ascends by size and the
other half then descends (ties by a hash of the id): neighbours are of like
size, so the words taken follow the documents taken, and what the rising half
gains by its offset the falling half loses.

Sums are whole numbers of 2^-40 copies, so results do not depend on the order
in which Spark adds; offsets and order are hashes with ``seed``, so reruns
agree.

Null in any column, empty tables and extra columns of any name are fine. A
null or blank text has size 0: it is emitted by the same rule but takes no
words. A source without words has target 0 and is not taken. Rows with one id
are documents of their own; rows alike in all columns are interchangeable.

No source is gathered in one task: rows are dealt by ranges of (source, order),
written once, counted by (source, range), and the few counts summed. What is
joined back has a row for each source and range; Spark broadcasts it by its
measured size or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged, unstage

SPACE = r"\x20\x09-\x0D"
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix"
UNIT = 1 << 40


def n_words(text: Column) -> Column:
    """Number of words of a text without holding them: each word with the
    space behind it becomes one letter."""
    start = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACE}]++", "")
    return F.octet_length(F.regexp_replace(start, f"[^{SPACE}]++[{SPACE}]*+", "w")).cast("long")


def _share(*parts: Column) -> Column:
    """A hash of the parts as a whole number of 2^-40."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 10), 16, 10).cast("long")


def _dealt(rows: DataFrame, group: list[Column], order: list[Column], tag: str) -> DataFrame:
    """``rows`` in order over many partitions, written once; ``_range`` is the
    partition, and ``_place`` ascends with the order inside it."""
    keys = [*group, *order]
    return staged(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys)
                  .sortWithinPartitions(*keys)
                  .withColumn("_range", F.spark_partition_id())
                  .withColumn("_place", F.monotonically_increasing_id()), tag)


def _before(dealt: DataFrame, group: list[str]) -> DataFrame:
    """Per group and range: rows of the group in earlier ranges, and the place
    of its first row in the range."""
    counts = dealt.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"),
                                                 F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*group, "_range", "_first",
                         F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows_before"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of a table (source, size).

    The level that all sources below their limit share, per unit of weight, is
    found by rounds of one aggregate over the sources; each round takes the
    sources above their limit out, and the last finds no further one."""
    totals = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    dealt = _dealt(totals, [], [F.col("source").isNull(), F.col("source")], "mix-ordered")
    number = F.col("_rows_before") + F.col("_place") - F.col("_first")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(number, F.lit(len(weights))).cast("int"))
    weighed = staged(dealt.join(_before(dealt, []), "_range").select(
        "source", "source_size", weight.cast("long").alias("weight"),
        (F.lit(most) * F.col("source_size")).alias("limit")), "mix-weights")
    unstage(dealt)
    unstage(totals)
    level, out = 0.0, -1  # sources taken out
    while True:
        above = F.col("limit") < F.lit(level) * F.col("weight")
        r = weighed.agg(F.sum("source_size").alias("all"),
                        F.coalesce(F.sum(F.when(above, F.col("limit"))), F.lit(0)).alias("given"),
                        F.sum(F.when(~above, F.col("weight"))).alias("left"),
                        F.count(F.when(above, 1)).alias("n")).first()
        if r["n"] == out or not r["left"]:
            break
        level, out = (r["all"] - r["given"]) / r["left"], r["n"]
    share = F.lit(level) * F.col("weight")
    return weighed.select("source", "source_size", F.when(F.col("limit") < share, F.col("limit").cast("double"))
                          .otherwise(share).alias("target"))


def with_copies(rows: DataFrame, ties: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS,
                most: int = MOST, seed: str = SEED) -> DataFrame:
    """``rows`` (stored; source, size, id and further columns, those of
    ``ties`` to order rows of one id) plus source_size, target and ``copies``
    long: how often the mix emits each."""
    lot = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    falls = F.substring(lot, 1, 1) >= "8"
    dealt = _dealt(rows, [F.col("source")],
                   [falls, F.when(falls, -F.col("size")).otherwise(F.col("size")), lot,
                    *map(F.col, ties)], "mix-dealt")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = _share(F.lit(seed), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    sources = targets(rows.select("source", "size"), weights, most).select(
        F.col("source").alias("_source"), "source_size", "target", F.floor(rate).alias("_whole"),
        F.floor((rate - F.floor(rate)) * UNIT).alias("_part"), offset.alias("_offset"))
    ranges = _before(dealt, ["source"])
    ranges = staged(ranges.join(sources, F.col("source").eqNullSafe(F.col("_source")))
                    .drop("_source").withColumnsRenamed({"source": "_source", "_range": "_in"}), "mix-ranges")
    joined = dealt.join(ranges, (F.col("_range") == F.col("_in"))
                        & F.col("source").eqNullSafe(F.col("_source")))
    before = "cast(_rows_before + _place - _first as decimal(20, 0))"
    crossed = " - ".join(f"(({k}) * cast(_part as decimal(13, 0)) + _offset) div {UNIT}"
                         for k in (f"{before} + 1", before))
    return joined.select(*rows.columns, "source_size", "target",
                         (F.col("_whole") + F.expr(crossed)).cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **how) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words that the
    mix takes of it, repeats counted)."""
    rows = staged(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                              n_words(F.col(text_col)).alias("size")), "mix-sizes")
    return with_copies(rows, **how).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          **how) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as
    often as it is emitted. Texts are written once and dealt once; sampling
    moves keys only."""
    kept = staged(docs.select(F.monotonically_increasing_id().alias("key"),
                              F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), "mix-rows")
    rows = staged(kept.select(F.col("row")[id_col].alias("id"), F.col("row")[source_col].alias("source"),
                              n_words(F.col("row")[text_col]).alias("size"),
                              "key", F.xxhash64("row").alias("hash")), "mix-sizes")
    emitted = with_copies(rows, ("hash",), **how)
    copies = emitted.filter("copies > 0").select(F.col("key").alias("_k"), "copies")
    return (kept.join(copies, F.col("key") == F.col("_k"))
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(*(F.col("row")[c].alias(c) for c in docs.columns)))
