"""Best-fit packing by sum of squares.

Documents become token sequences (ids of the tokenizer plus an end id), cut
only where longer than the capacity. Pieces are dealt by a hash of their row
number into groups of about ``group_pieces`` pieces, however large the input;
each group packs its pieces, longest first, into bins of its own: a piece goes
where the sum over residual gaps of (open bins with that gap) squared becomes
smallest. The number of groups follows the input, so the work spreads and no
task grows with it; what a group wastes is a part of a thousandth.

Defined results: a null text counts as empty (the end id alone); repeated rows
are packed once each; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import mapped
from .common import ship, staged
from .tokens import broadcast_tokenizer, encoder

# pieces of a packing group: the larger, the less is wasted per group and the
# longer its one task runs (about 20 microseconds a piece)
GROUP_PIECES = 8192

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens."""
    spark = docs.sparkSession
    ship(spark)
    spec = broadcast_tokenizer(spark, tokenizer_path)
    end = int(end_id).to_bytes(4, "little")

    def cut(rows):
        enc = encoder(spec.value)
        for doc, text in rows:
            ids = memoryview(enc.ids(text or "") + end)
            n = len(ids) // 4
            for piece, start in enumerate(range(0, n, capacity)):
                stop = min(n, start + capacity)
                yield doc, piece, start, stop - start, zlib.crc32(ids[4 * start:4 * stop])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece, placed in the order given.

    ``open_bins[g]`` is the number of open bins with a gap of g tokens. Moving
    a bin from gap g to g - s changes the sum of squares by
    2 (open_bins[g-s] - open_bins[g] + 1), opening a bin by
    2 open_bins[capacity-s] + 1; full bins no longer count. Ties go to the
    smallest gap, and to an open bin before a new one.
    """
    open_bins = np.zeros(capacity + 1, np.int64)
    waiting: dict[int, list[int]] = {}
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n_bins = 0
    for i, s in enumerate(lengths.tolist()):
        place, gap = -1, capacity
        gaps = np.flatnonzero(open_bins[s:capacity]) + s
        if len(gaps):
            after = open_bins[gaps - s]
            change = 2 * (after - open_bins[gaps] + 1)
            change[gaps == s] -= 1  # the bin is closed: it leaves the sum by 1 - 2 n
            j = int(np.argmin(change))
            fresh = 2 * open_bins[capacity - s] + 1 if s < capacity else 0
            if change[j] <= fresh:
                gap = int(gaps[j])
                place = waiting[gap].pop()
                open_bins[gap] -= 1
        if place < 0:
            place, n_bins = n_bins, n_bins + 1
        left = gap - s
        bins[i], offsets[i] = place, capacity - gap
        if left:
            open_bins[left] += 1
            waiting.setdefault(left, []).append(place)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to capacity) plus
    ``sequence_id`` and ``offset``. A sequence's pieces follow each other
    without gaps; sequence ids are any distinct numbers."""
    spark = pieces.sparkSession
    ship(spark)
    rows = staged(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // group_pieces))
    keyed = rows.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))

    def fill(key, frame):
        frame = frame.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
        bins, offsets = sum_of_squares(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = (int(key[0]) << 32) + bins
        frame["offset"] = offsets
        return frame[["_row", "sequence_id", "offset"]]

    places = (keyed.select("_group", "_row", "length").groupBy("_group")
              .applyInPandas(fill, "_row long, sequence_id long, offset long"))
    return rows.join(places, "_row").drop("_row")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1,
                   group_pieces: int = GROUP_PIECES) -> DataFrame:
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id), capacity, group_pieces)
