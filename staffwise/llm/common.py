"""Helpers shared by the operators: staged tables, shipped code, row keys."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffles_dropped, staging_path

# words are runs of anything but space, tab, line feed, vertical tab, form
# feed and carriage return
WORD = r"[^\x20\x09-\x0D]+"
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, as
    ``--py-files`` does (once per application, through Spark's file server)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    d = os.path.realpath(tempfile.mkdtemp(prefix="staffwise-ship-"))
    atexit.register(shutil.rmtree, d, ignore_errors=True)  # served until the application ends
    src = os.path.join(d, "src")
    shutil.copytree(package, os.path.join(src, os.path.basename(package)),
                    ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(
        shutil.make_archive(os.path.join(d, "staffwise-package"), "zip", src))
    _SHIPPED.add(app)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder the cluster names
    (spark.checkpoint.dir) and read back: cuts the lineage and survives the
    loss of executors. A computation whose row ids or random choices must not
    change between uses is staged before they are used."""
    spark = df.sparkSession
    path = staging_path(spark, "llm", tag)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(df, "_staged_path", None)
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_key(col: str = "text") -> Column:
    """A 128-bit key of a text (null counts as empty)."""
    return F.unhex(F.md5(F.coalesce(F.col(col), F.lit(""))))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(divisor: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text (a null id counts as empty text), modulo."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def labelled_sample(rows: DataFrame, label: str, per_label: int, longest: int) -> list[tuple]:
    """(label, text) of at most ``per_label`` rows of each label, for fitting a
    classifier on the driver: those with the least hash of their text, among
    texts of at most ``longest`` characters. ``rows`` has that label column
    and ``text``. The hash limit follows each label's count of distinct texts
    (by hash), so about twice the bound is collected, whatever the size of the
    input and however many copies it holds."""
    rows = (rows.filter(F.col(label).isNotNull() & F.col("text").isNotNull()
                        & (F.char_length("text") <= longest))
            .select(F.col(label).alias("label"), "text",
                    F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("_h")))
    counts = {r["label"]: r["n"] for r in rows.select("label", "_h").distinct()
              .groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    limit = F.lit(0)
    for k, n in sorted(counts.items()):
        share = min(1.0, (2 * per_label + 50) / n)
        limit = F.when(F.col("label") == F.lit(k), int(share * (1 << 30))).otherwise(limit)
    got = sorted({(r["label"], r["_h"], r["text"]) for r in rows.filter(F.col("_h") < limit)
                  .dropDuplicates(["label", "_h"]).collect()}, key=lambda x: (str(x[0]), x[1], x[2]))
    out, taken = [], {}
    for k, _, text in got:
        taken[k] = taken.get(k, 0) + 1
        if taken[k] <= per_label:
            out.append((k, text))
    return out


def sampled_texts(labels: DataFrame, label: str, counts: dict, texts: DataFrame, per_label: int,
                  longest: int) -> list[tuple]:
    """``labelled_sample`` where labels (doc_id, label) and texts (doc_id, text)
    are two tables: about twice ``per_label`` ids of each label, those of least
    hash, are broadcast to the texts - a number of rows that the parameter
    bounds. ``counts`` has the rows of each label."""
    limit = F.lit(0)
    for k, n in sorted(counts.items()):
        share = min(1.0, (2 * per_label + 50) / n)
        limit = F.when(F.col(label) == F.lit(k), int(share * (1 << 30))).otherwise(limit)
    ids = (labels.select("doc_id", label, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("_h"))
           .filter(F.col("_h") < limit))
    got = texts.join(F.broadcast(ids), "doc_id").filter(
        F.col("text").isNotNull() & (F.char_length("text") <= longest))
    rows = sorted({(r[label], r["_h"], r["text"]) for r in got.collect()},
                  key=lambda x: (str(x[0]), x[1], x[2]))
    out, taken, seen = [], {}, set()
    for k, _, text in rows:
        if (k, text) not in seen and taken.get(k, 0) < per_label:
            seen.add((k, text))
            taken[k] = taken.get(k, 0) + 1
            out.append((k, text))
    return out
