"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last 16 characters has nine zero
bits (the place depends on content only, so equal passages are cut alike
wherever they stand). A chunk that occurs in several texts is encoded once and
its ids are joined to every text that holds it; the other chunks are encoded
where they are. Ids next to a chunk's ends may differ in context, so each
join is repaired: a window around it is encoded again and widened until its
ids agree with those of the chunks on both sides.

Shuffles: chunk hashes (a few hundredths of the text), the distinct texts once
(that exchange feeds both the chunks' first owners and the final pass), and
the ids of reused chunks. A chunk, text or passage that a third of all rows
hold is one key in a join that adaptive execution splits, and is counted after
map-side aggregation.

Defined results: a null text counts as empty (no tokens); repeated rows give
repeated results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import mapped
from .common import ship, staged, text_key
from .tokens import Encoder, broadcast_tokenizer, encoder

WINDOW = 16          # characters under the rolling hash
CUT_BITS = 9         # a cut every 512 characters on average
LEAST = 128          # no cut sooner than so many characters after another
MULTIPLIER = 0x9E3779B97F4A7C15
SPACE = re.compile("[ \n]")


def cuts(text: str) -> list[int]:
    """End places of the chunks of ``text`` (the last is its length)."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        factor, width = np.uint64(MULTIPLIER), 1
        while width < WINDOW:  # hash of 2w characters from two hashes of w
            longer = h * factor
            longer[:width] = 0
            longer[width:] = h[:-width] * factor + h[width:]
            h, factor, width = longer, factor * factor, 2 * width
        h = h * np.uint64(0xFF51AFD7ED558CCD)
    places = np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + 1
    out, last = [], 0
    for p in places.tolist():
        if p - last >= LEAST and p < n:
            out.append(p)
            last = p
    return [*out, n]


def chunks(text: str) -> list[str]:
    ends = cuts(text)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def chunk_hash(chunk: str) -> bytes:
    return hashlib.blake2b(chunk.encode("utf-8"), digest_size=16).digest()


def inner(chunk: str) -> tuple[int, int]:
    """The part of a chunk from its first to its last white space; ids of what
    lies outside depend on the neighbours. (-1, -1) if there is none."""
    m = SPACE.search(chunk)
    if not m:
        return -1, -1
    return m.start(), max(chunk.rfind(" "), chunk.rfind("\n")) + 1


def _words(text: str, n: int, last: bool) -> str:
    """The first or last n words of a text, with the white space around them."""
    parts = text.split(" ")
    return text if len(parts) <= n else " ".join(parts[-n:] if last else parts[:n])


def repaired(enc: Encoder, left: str, left_ids: bytes, fragment: str, right: str) -> tuple[bytes, bytes]:
    """Ids of ``left + fragment`` when followed by ``right``: those of left,
    perhaps fewer, and those made anew for the join. The window starts with two
    words on each side and doubles until its ids begin with left's own and end
    with right's own; at its widest it holds both parts whole."""
    n = 2
    while True:
        a, b = _words(left, n, last=True), _words(right, n, last=False)
        a_ids, b_ids = enc.ids(a), enc.ids(b)
        window = enc.ids(a + fragment + b)
        if (left_ids.endswith(a_ids) and window.startswith(a_ids) and window.endswith(b_ids)
                and len(window) >= len(a_ids) + len(b_ids)):
            return left_ids, window[len(a_ids):len(window) - len(b_ids)]
        if a == left and b == right:
            cut = len(window) - len(b_ids) if window.endswith(b_ids) else len(window)
            return b"", window[:cut]
        n *= 2


def join_chunks(enc: Encoder, parts: list[str], known: dict[int, bytes]) -> bytes:
    """Ids of the whole text: inner parts from ``known`` (by chunk number) or
    encoded here, and a repair at each join."""
    out: list[bytes] = []
    left, left_ids, fragment = "", b"", ""
    for i, chunk in enumerate(parts):
        a, b = inner(chunk)
        if a < 0:  # the chunk lies within a word: it all belongs to the join
            fragment += chunk
            continue
        middle = chunk[a:b]
        ids = known.get(i)
        if ids is None:
            ids = enc.ids(middle)
        keep, made = repaired(enc, left, left_ids, fragment + chunk[:a], middle)
        out += [keep, made]
        left, left_ids, fragment = middle, ids, chunk[b:]
    out += repaired(enc, left, left_ids, fragment, "")
    return b"".join(out)


def chunk_rows(keyed: DataFrame) -> DataFrame:
    """(key, at, chunk): each chunk's hash by text and number; a text that a
    task meets again is cut once."""
    def cut(rows):
        seen = set()
        for key, text in rows:
            if key not in seen:
                seen.add(key)
                for at, chunk in enumerate(chunks(text)):
                    yield key, at, chunk_hash(chunk)

    return mapped(keyed, cut, "key binary, at int, chunk binary")


def distinct_texts(keyed: DataFrame) -> DataFrame:
    """(key, packed): each distinct text once, compressed, since it is what
    the shuffle carries."""
    def pack(rows):
        import zstandard
        squeeze, seen = zstandard.ZstdCompressor(level=3).compress, set()
        for key, text in rows:
            if key not in seen:
                seen.add(key)
                yield key, squeeze(text.encode("utf-8"))

    # keys are never null; saying so keeps inner and outer joins on one exchange
    return (mapped(keyed, pack, "key binary, packed binary").filter("key is not null")
            .dropDuplicates(["key"]))


def unpacked(blob: bytes) -> str:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(blob).decode("utf-8")


def encode_texts(keyed: DataFrame, tokenizer_path: str) -> DataFrame:
    """Of a table (key, text), key the 128-bit key of a text without nulls, per
    distinct text: key, n_tokens, ids (packed little-endian unsigned 32-bit),
    decoded, n_chunks, n_reused (chunks whose ids came from another place)."""
    spark = keyed.sparkSession
    ship(spark)
    spec = broadcast_tokenizer(spark, tokenizer_path)
    keyed = keyed.select("key", "text")
    texts = distinct_texts(keyed)

    # a chunk is reused if its first and last occurrence differ
    rows = staged(chunk_rows(keyed), "chunks")
    place = F.struct("key", "at")
    shared = (rows.groupBy("chunk").agg(F.min(place).alias("first"), F.max(place).alias("last"))
              .filter("first <> last").select("chunk", "first"))
    owners = (shared.groupBy(F.col("first.key").alias("key"))
              .agg(F.collect_list(F.struct(F.col("first.at").alias("at"), "chunk")).alias("todo")))

    def encode_owned(owned):
        enc = encoder(spec.value)
        for _, packed, todo in owned:
            parts = chunks(unpacked(packed))
            for item in todo:
                part = parts[item["at"]]
                a, b = inner(part)
                yield item["chunk"], enc.ids(part[max(a, 0):max(b, 0)])

    encoded = mapped(texts.join(owners, "key"), encode_owned, "chunk binary, ids binary")
    known = (rows.join(encoded, "chunk").dropDuplicates(["key", "at"]).groupBy("key")
             .agg(F.collect_list(F.struct("at", "ids")).alias("known")))

    def finish(joined):
        enc = encoder(spec.value)
        for key, packed, have in joined:
            parts = chunks(unpacked(packed))
            reused = {x["at"]: x["ids"] for x in have or []}
            ids = join_chunks(enc, parts, reused)
            yield key, len(ids) // 4, ids, enc.text_of(ids), len(parts), len(reused)

    return mapped(texts.join(known, "key", "left"), finish,
                  "key binary, n_tokens long, ids binary, decoded string, n_chunks int, n_reused int")


def keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key().alias("key"))


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document: doc_id and the columns of ``encode_texts``."""
    keyed = keyed_texts(docs)
    return keyed.select("doc_id", "key").join(encode_texts(keyed, tokenizer_path), "key").drop("key")
