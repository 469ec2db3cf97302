"""License scans by canonical digest (DataFrame functions only).

A text is brought to a canonical form - lower case, equivalent spellings made
one, copyright lines dropped, punctuation and white space reduced to single
spaces - and the digest of the whole form is joined to the digests of known
licence texts, canonicalised by the same functions. The lines of a document
are looked up in the same way, each as a text of its own, since notices
usually stand on a line of their own.

Only digests are joined; the table of known texts is small (its rows are
counted before it is broadcast) and never grows with the corpus.

Defined results: a null, empty or punctuation-only text has an empty canonical
form, which matches nothing; repeated rows get a result each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged
from .license_texts import NOTICES, SPELLINGS, TEXTS, full_texts

# a larger table of known texts is joined by shuffle
BROADCAST_ROWS = 100_000


def canonical(line: Column) -> Column:
    """Canonical form of one line; empty for a copyright line."""
    plain = F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))
    one = functools.reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, plain)
    return F.when(is_copyright(line), "").otherwise(one)


def is_copyright(line: Column) -> Column:
    """A line that begins with a copyright mark and names a year or holder,
    or reserves all rights."""
    return line.rlike(r"^[^\p{L}\p{N}(©]*(?i:copyright|\(c\)|©|all rights reserved)(?![\p{L}])") \
        & ~line.rlike(r"(?i)copyright (notice|holder|owner|licen[cs]e)")


def canonical_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), canonical),
                    lambda x: x != "")


def digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def known_licenses(spark: SparkSession, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """(license, digest) of known texts and notices; one licence per digest."""
    if not texts:
        full = full_texts()
        texts = {k: [*TEXTS.get(k, []), *full.get(k, []), *NOTICES.get(k, [])] for k in {**TEXTS, **full, **NOTICES}}
    rows = spark.createDataFrame([(k, t) for k, ts in sorted(texts.items()) for t in ts],
                                 "license string, text string")
    form = F.array_join(canonical_lines(F.col("text")), " ")
    return (rows.select("license", form.alias("f")).filter("f != ''")
            .groupBy(digest(F.col("f")).alias("digest")).agg(F.min("license").alias("license")))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per document: doc_id, canonical_sha256 and license of its whole text
    (null if unknown), n_license_lines, licenses (distinct names found in the
    whole text or a line, sorted, comma-joined)."""
    lines = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id",
                        canonical_lines(F.col("text")).alias("_lines"))
    rows = staged(lines.select(
        "_row", "doc_id", digest(F.array_join("_lines", " ")).alias("canonical_sha256"),
        F.transform("_lines", lambda x: F.unhex(digest(x))).alias("_digests")), "licenses")
    known = staged(known.select("license", "digest"), "known-licenses")
    table = known if known.count() > BROADCAST_ROWS else F.broadcast(known)
    line = (rows.select("_row", F.explode("_digests").alias("_d"))
            .join(table.withColumn("_d", F.unhex("digest")), "_d")
            .groupBy("_row").agg(F.count(F.lit(1)).alias("n_license_lines"),
                                 F.collect_set("license").alias("_in_lines")))
    whole = rows.join(table.select(F.col("digest").alias("canonical_sha256"), "license"),
                      "canonical_sha256", "left")
    own = F.when(F.col("license").isNull(), F.array().cast("array<string>")).otherwise(F.array("license"))
    return whole.join(line, "_row", "left").select(
        "doc_id", "canonical_sha256", "license",
        F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"),
        F.array_join(F.array_sort(F.array_union(
            own, F.coalesce("_in_lines", F.array().cast("array<string>")))), ",").alias("licenses"))
