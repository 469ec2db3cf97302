"""Document fingerprints: one-permutation MinHash, densified, b bits a bin.

A text's distinct five-word shingles are hashed once; the hash's high part
picks one of ``BINS`` bins and the least low part of a bin is its value. Empty
bins take the value of the bin that a fixed random sequence (one per bin, the
same for all texts) first leads to a filled one: optimal densification, so
every bin still agrees with the Jaccard similarity as probability. The lowest
``BITS`` bits of each bin are packed. Two packed fingerprints agree by chance
in 1 / 2^BITS of the remaining bins, which ``likeness`` corrects for.

Defined results: words are runs without ASCII white space, A-Z lower-cased; a
text with fewer than five words is one shingle; a text without words has the
empty fingerprint, which is like another empty one (1.0) and unlike the rest
(0.0).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import mapped
from .common import ship, shuffle_partitions
from .shingles import shingle_hashes

BINS = 512
BITS = 4
SHINGLE = 5
_PROBES: list[np.ndarray] = []


def _probe(round_: int) -> np.ndarray:
    """The bin that each empty bin asks in a round (a fixed hash of both)."""
    while len(_PROBES) <= round_:
        x = np.arange(BINS, dtype=np.uint64) + np.uint64(len(_PROBES) * BINS + 1)
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        _PROBES.append((x % np.uint64(BINS)).astype(np.int64))
    return _PROBES[round_]


def bins_of(hashes: np.ndarray) -> np.ndarray:
    """Densified bin values of the sorted distinct shingle hashes."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    which = (hashes >> shift).astype(np.int64)
    first = np.flatnonzero(np.diff(which, prepend=-1))  # sorted: the least of a bin comes first
    filled = np.zeros(BINS, bool)
    filled[which[first]] = True
    value = np.zeros(BINS, np.uint64)
    value[which[first]] = hashes[first]
    todo = np.flatnonzero(~filled)
    round_ = 0
    while len(todo):
        asked = _probe(round_)[todo]
        hit = filled[asked]
        value[todo[hit]] = value[asked[hit]]
        todo = todo[~hit]
        round_ += 1
    return value


def packed(hashes: np.ndarray) -> bytes:
    """The fingerprint: b low bits of a mix of each bin's value, packed."""
    if not len(hashes):
        return b""
    v = bins_of(hashes)
    with np.errstate(over="ignore"):
        v = (v ^ (v >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    low = (v >> np.uint64(64 - BITS)).astype(np.uint8)
    bits = (low[:, None] >> np.arange(BITS, dtype=np.uint8)) & 1
    return np.packbits(bits).tobytes()


def fingerprint(text: str) -> bytes:
    return packed(shingle_hashes(text, SHINGLE))


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of two packed fingerprints, corrected for
    bins that agree by chance, within 0 and 1."""
    if not a or not b:
        return float(a == b)
    x = np.unpackbits(np.frombuffer(a, np.uint8)) == np.unpackbits(np.frombuffer(b, np.uint8))
    same = x.reshape(-1, BITS).all(axis=1).mean()
    chance = 1.0 / (1 << BITS)
    return float(min(1.0, max(0.0, (same - chance) / (1.0 - chance))))


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by the beginning of another."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """Documents by descending doc_id (null ids last, ties by text) dealt to
    contiguous stretches, each with the first document of the next stretch
    (of the first one, after the last) as its guard row.

    Stretch bounds are quantiles of the ids, at most ``parts`` numbers, and the
    table of stretches that is broadcast has as many rows. One guard per
    stretch is found from the ids alone and its row is doubled."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    cut = base.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1.0 / (4 * parts))
    inner = sorted(set(cut)) or [0.0]
    splits = [float("-inf"), *inner, float("inf")]
    bucket = Bucketizer(splits=splits, inputCol="_id", outputCol="_bucket", handleInvalid="keep")
    # buckets ascend with the ids; null ids come last in the order
    tagged = (bucket.transform(base.withColumn("_id", F.col("doc_id").cast("double")))
              .withColumn("stretch", F.when(F.col("doc_id").isNull(), F.lit(len(splits)))
                          .otherwise(len(splits) - 2 - F.col("_bucket")).cast("int"))
              .select("stretch", "doc_id", "text"))
    heads = sorted((r["stretch"], r["top"]) for r in tagged.groupBy("stretch")
                   .agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("top")).collect())
    spark = docs.sparkSession
    guards = spark.createDataFrame(
        [(s, top, heads[i - 1][0]) for i, (s, top) in enumerate(heads)],
        "stretch int, top long, guards int")
    is_head = F.coalesce("doc_id", F.lit(0)) == F.col("top")
    return (tagged.join(F.broadcast(guards), "stretch")
            .withColumn("_to", F.explode(F.when(is_head, F.array(F.col("stretch"), -1 - F.col("guards")))
                                         .otherwise(F.array("stretch"))))
            .select(F.when(F.col("_to") < 0, -1 - F.col("_to")).otherwise(F.col("_to")).alias("stretch"),
                    (F.col("_to") < 0).alias("guard"), "doc_id", "text"))


def with_next(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (hex), near_edited, near_next.

    One shuffle of the texts, into stretches of neighbouring ids sorted within
    tasks; each task streams its rows once and holds two texts at a time."""
    spark = docs.sparkSession
    ship(spark)
    n = shuffle_partitions(spark)
    rows = (in_order(docs, 4 * n).repartition(n, "stretch")
            .sortWithinPartitions("stretch", "guard", F.desc_nulls_last("doc_id"), "text"))

    def stream(ordered):
        held = None  # the row before waits for the text that follows
        for stretch, guard, doc, text in ordered:
            if held and held[0] != stretch:
                held = None  # that row has met its guard
            if guard and not held:
                continue  # one guard text is enough
            mark = fingerprint(text)
            if held:
                _, last_doc, last_text, last_mark = held
                change = edited(last_text, text)
                changed = fingerprint(change)
                yield (last_doc, len(last_text), hashlib.sha256(change.encode("utf-8")).hexdigest(),
                       last_mark.hex(), changed.hex(),
                       likeness(last_mark, changed), likeness(last_mark, mark))
            held = None if guard else (stretch, doc, text, mark)

    return mapped(rows, stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
                                " edited_fingerprint string, near_edited double, near_next double")
