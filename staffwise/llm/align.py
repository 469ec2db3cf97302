"""Alignment of two tokenizers' tokens over the same bytes.

Tokenizer A (``tokenizers`` JSON, byte-level) encodes a space and the text,
tokenizer B (``sentencepiece`` model) the text, to which it adds the space
itself; special tokens' strings are plain text for both. Token bytes are A's
entry byte-level decoded, and B's piece in UTF-8 with U+2581 as a space and
<0xHH> as that byte. A batch of documents becomes two frames of tokens (document,
start byte, token); ``merge_asof`` keyed by document gives each token start the
other side's token that covers it, in both directions. The union of the two
holds every pair of overlapping tokens; pairs whose ends are equal are links,
and cut a document's tokens into groups.

``overlaps`` returns all overlapping pairs, ``summary`` a row per document with
its groups' digest and corpus-wide counts of linked id pairs.

Null, empty texts, and texts that either tokenizer does not give back byte for
byte (a literal U+2581) have no tokens. Repeated ids and texts are documents of
their own. Other columns are not read, so their names and types are free.

Distinct words are encoded once per worker: no token of either tokenizer
reaches over a single space between two other characters (A's word pattern
starts a word at it; no piece of B has U+2581 behind another character, which
is checked before it is relied on). The store holds at most MEMO_PIECES words.
Texts are processed in slices of about SLICE characters that end at such a
space, so memory does not grow with the text (but with its longest word).
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import rows_in
from .common import ship, staged

SLICE = 1 << 20
MEMO_PIECES = 300_000
GAP = re.compile(r" (?=\S)(?<=\S )")
SEPARATORS = ",|;"


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1
    characters stand for themselves, the other bytes for characters from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Pair:
    """Both tokenizers, and the tokens of the words they have met."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_json)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_model)
        letters = byte_alphabet()
        self.a_bytes = {i: bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode()
                        for w, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        n = max(max(self.a_bytes), len(pieces)) + 1
        self.said = [f"{i}{s}" for i in range(n) for s in SEPARATORS]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.exact = np.empty(0, bool)
        self.sides = [_Side(), _Side()]

    def words(self, text: str) -> list[str]:
        return GAP.split(text) if self.by_word else [text]

    def numbers(self, words: list[str]) -> np.ndarray:
        """Rows of the store for these words."""
        got = list(map(self.known.get, words))
        if None in got:
            new = list(dict.fromkeys(w for w, i in zip(words, got) if i is None))
            a = [e.ids for e in self.a.encode_batch_fast([" " + w for w in new], add_special_tokens=False)]
            b = self.b.encode(new, num_threads=1)
            exact = []
            for side, lists, name in ((0, a, self.a_bytes), (1, b, self.b_bytes)):
                parts = [[name[i] for i in ids] for ids in lists]
                self.sides[side].add(lists, parts)
                exact.append([b"".join(p) == b" " + w.encode() for p, w in zip(parts, new)])
            self.exact = np.concatenate([self.exact, np.logical_and(*map(np.array, exact))])
            start = len(self.known)
            self.known.update(zip(new, range(start, start + len(new))))
            got = list(map(self.known.__getitem__, words))
        return np.array(got, np.int64)


class _Side:
    """Token ids and byte lengths of all stored words, one behind the other."""

    def __init__(self):
        self.first = self.count = self.ids = self.sizes = np.empty(0, np.int64)

    def add(self, lists: list[list[int]], parts: list[list[bytes]]) -> None:
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in lists for i in x), np.int64, count.sum())])
        self.sizes = np.concatenate([self.sizes, np.fromiter((len(p) for x in parts for p in x),
                                                             np.int64, count.sum())])

    def tokens(self, rows: np.ndarray, doc: np.ndarray) -> pd.DataFrame:
        """Tokens of the words ``rows``, in order, with their documents and
        the bytes at which they start and end."""
        n = self.count[rows]
        at = np.repeat(self.first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        end = np.cumsum(self.sizes[at])
        return pd.DataFrame({"doc": np.repeat(doc, n), "id": self.ids[at], "start": end - self.sizes[at],
                             "end": end, "token": np.arange(len(at))})


def overlapping(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """All pairs (a, b) of tokens of one document that share a byte, in order,
    and whether they end together."""
    key = ["doc", "start", "token"]
    under = pd.merge_asof(a[key], b[key], on="start", by="doc", suffixes=("_a", "_b"))
    over = pd.merge_asof(b[key], a[key], on="start", by="doc", suffixes=("_b", "_a"))
    later = a["start"].to_numpy()[over["token_a"]] < over["start"]  # both start here: found above
    both = pd.DataFrame({"a": np.concatenate([under["token_a"], over["token_a"][later]]),
                         "b": np.concatenate([under["token_b"], over["token_b"][later]])})
    both = both.iloc[np.argsort(both["a"].to_numpy() + both["b"].to_numpy(), kind="stable")]
    both["linked"] = a["end"].to_numpy()[both["a"]] == b["end"].to_numpy()[both["b"]]
    return both.reset_index(drop=True)


class Slice:
    """Tokens and overlaps of some documents' texts or parts of texts."""

    def __init__(self, pair: Pair, texts: list[list[str]]):
        words = [w for t in texts for w in t]
        rows = pair.numbers(words)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        doc = np.repeat(np.arange(len(texts)), n)
        # documents that a tokenizer does not give back have no tokens
        bad = np.bincount(doc, ~pair.exact[rows], len(texts)) > 0
        self.exact = ~bad
        rows, doc = rows[~bad[doc]], doc[~bad[doc]]
        self.a, self.b = (s.tokens(rows, doc) for s in pair.sides)
        self.pairs = overlapping(self.a, self.b)
        links = self.pairs[self.pairs["linked"]]
        self.link_a, self.link_b = links["a"].to_numpy(), links["b"].to_numpy()
        docs = np.arange(len(texts) + 1)
        self.a_at, self.b_at = (np.searchsorted(x["doc"], docs) for x in (self.a, self.b))
        self.link_at = np.searchsorted(self.a["doc"].to_numpy()[self.link_a], docs)
        self.keys = (self.a["id"].to_numpy()[self.link_a] << 32) | self.b["id"].to_numpy()[self.link_b]

    def spelled(self) -> np.ndarray:
        """3 * id + separator of all tokens, group by group: the group's A
        tokens, then its B tokens."""
        a, b = self.a["id"].to_numpy(), self.b["id"].to_numpy()
        out = np.empty(len(a) + len(b), np.int64)
        group = np.searchsorted(self.link_a, np.arange(len(a)))
        out[np.arange(len(a)) + np.concatenate([[0], self.link_b + 1])[group]] = 3 * a
        group = np.searchsorted(self.link_b, np.arange(len(b)))
        out[np.arange(len(b)) + np.concatenate([self.link_a + 1, [0]])[group]] = 3 * b
        ends = self.link_a + self.link_b + 2  # tokens up to the end of each group
        starts = np.concatenate([[0], ends])[:len(ends)]
        out[starts + np.diff(self.link_a, prepend=-1) - 1] += 1
        out[ends - 1] += 2
        return out


def _parts(pair: Pair, text: str) -> Iterator[tuple[list[str], bool]]:
    """A text's words, of long texts in parts, and whether they are the last."""
    at = 0
    while True:
        gap = GAP.search(text, at + SLICE) if pair.by_word and len(text) - at > SLICE else None
        part = text[at:gap.start() if gap else None]
        yield pair.words(part) if part else [], gap is None
        if gap is None:
            return
        at = gap.end()


def _slices(pair: Pair, rows: Iterable[tuple]) -> Iterator[tuple[list[tuple], Slice]]:
    """Rows (key, text) as slices of about SLICE characters: [(key, is the
    text's last part)] and the slice's tokens."""
    held, texts, size = [], [], 0
    for key, text in rows:
        for words, last in _parts(pair, text or ""):
            held.append((key, last))
            texts.append(words)
            size += 64 + (len(text) if text and last and len(text) <= SLICE else sum(map(len, words)) + len(words))
            if size > SLICE:
                yield held, Slice(pair, texts)
                held, texts, size = [], [], 0
                if len(pair.known) > MEMO_PIECES:
                    pair.clear()
    if held:
        yield held, Slice(pair, texts)


class _Document:
    """What is kept of a document's parts until the last."""

    def __init__(self):
        self.exact, self.n_a, self.n_b, self.n_links = True, 0, 0, 0
        self.sha = hashlib.sha256()
        self.pairs = self.times = np.empty(0, np.int64)

    def add(self, s: Slice, d: int, said: str) -> None:
        links = slice(s.link_at[d], s.link_at[d + 1])
        # the last separator waits for the next part
        self.sha.update((";" * (self.n_links > 0 and bool(said)) + said[:-1]).encode())
        self.exact &= bool(s.exact[d])
        self.n_a += int(s.a_at[d + 1] - s.a_at[d])
        self.n_b += int(s.b_at[d + 1] - s.b_at[d])
        self.n_links += links.stop - links.start
        pairs, times = np.unique(s.keys[links], return_counts=True)
        if len(self.pairs):
            both = np.concatenate([self.pairs, pairs])
            pairs, at = np.unique(both, return_inverse=True)
            times = np.bincount(at, np.concatenate([self.times, times])).astype(np.int64)
        self.pairs, self.times = pairs, times

    def row(self, key) -> tuple:
        if not (self.exact and self.n_links):
            return key, 0, 0, 0, 0, "", [], []
        # every token has a byte, so an end that both sides share is one link
        n = int(self.n_links)
        return key, self.n_a, self.n_b, n, n, self.sha.hexdigest(), self.pairs, self.times


def _documents(pair: Pair, rows: Iterable[tuple]) -> Iterator[tuple]:
    doc = _Document()
    for held, s in _slices(pair, rows):
        codes = s.spelled()
        at = s.a_at + s.b_at
        for d, (key, last) in enumerate(held):
            doc.add(s, d, "".join(map(pair.said.__getitem__, codes[at[d]:at[d + 1]].tolist())))
            if last:
                yield doc.row(key)
                doc = _Document()


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 500) -> Iterator[pa.RecordBatch]:
    while held := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_PAIRS: dict[int, Pair] = {}


def _pair(files) -> Pair:
    """This worker's tokenizers (kept between tasks)."""
    key = hash(files.value)
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = Pair(*files.value)
    return _PAIRS[key]


def _tokenizers(spark, a_path: str, b_path: str):
    """Both files (a few MB, bounded by the vocabularies), read on the driver."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("key"), "text")


def overlaps(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id") -> DataFrame:
    """All overlapping token pairs: doc_id (the key), a_place, b_place (numbers
    of the tokens in the text, from 0), a_id, b_id, linked (they end together).
    With a key that repeats, its documents' rows cannot be told apart."""
    spark = docs.sparkSession
    ship(spark)
    files = _tokenizers(spark, a_path, b_path)
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("a_place", "b_place", "a_id", "b_id")),
                        ("linked", pa.bool_())])

    def found(batches):
        parts, exact, a_at, b_at = [], True, 0, 0
        for held, s in _slices(_pair(files), rows_in(batches)):
            of = s.a["doc"].to_numpy()[s.pairs["a"]] if len(s.pairs) else np.empty(0, np.int64)
            bounds = np.searchsorted(of, np.arange(len(held) + 1))
            for d, (k, last) in enumerate(held):
                p = s.pairs.iloc[bounds[d]:bounds[d + 1]]
                parts.append((p["a"].to_numpy() - s.a_at[d] + a_at, p["b"].to_numpy() - s.b_at[d] + b_at,
                              s.a["id"].to_numpy()[p["a"]], s.b["id"].to_numpy()[p["b"]], p["linked"].to_numpy()))
                exact &= bool(s.exact[d])
                a_at, b_at = a_at + s.a_at[d + 1] - s.a_at[d], b_at + s.b_at[d + 1] - s.b_at[d]
                if last:
                    for x in parts if exact else []:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k] * len(x[0]), pa.int64()), *map(pa.array, x)], schema=schema)
                    parts, exact, a_at, b_at = [], True, 0, 0

    return _keyed(docs, key).mapInArrow(found, "doc_id long, a_place long, b_place long, a_id long, b_id long,"
                                               " linked boolean")


def summary(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and, by
    the corpus-wide number of links of each (A id, B id): n_best (links whose
    pair is the most frequent of its B id, ties included) and count_sum.

    Texts are encoded once; a document's distinct id pairs with their numbers
    are written with its row, and counted and looked up by joins on the pair,
    which no single pair can make uneven by more than one row a document."""
    spark = docs.sparkSession
    ship(spark)
    files = _tokenizers(spark, a_path, b_path)
    ddl = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
           " pairs array<long>, times array<long>")
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")),
                        ("groups_sha256", pa.string()), ("pairs", longs), ("times", longs)])
    aligned = staged(
        _keyed(docs, key).mapInArrow(lambda b: _batched(_documents(_pair(files), rows_in(b)), schema), ddl)
        .withColumn("row", F.monotonically_increasing_id()), "aligned")
    pairs = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = staged(pairs.groupBy("pair").agg(F.sum("times").alias("n")), "pair-counts")
    counts = counts.withColumn("b_id", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    best = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    known = staged(counts.join(best, "b_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best")),
                   "pair-best")
    sums = (pairs.join(known.hint("shuffle_hash"), "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                 F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
