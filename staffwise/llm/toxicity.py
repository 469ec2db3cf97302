"""Toxicity by compression distance.

Two zstandard dictionaries are trained from labelled texts, one on toxic and
one on ordinary text. Both hold the same base, trained on windows of ordinary
text; the toxic one also holds a part trained on the words
and stems that are over-represented in toxic texts. A lower-cased text is cut
into short overlapping windows of bytes and each is compressed with either
dictionary: what the toxic one saves tells how much toxic wording it holds. The largest savings,
their mean and their sum make a few features, and a logistic curve fitted on
texts that the dictionaries were not trained on turns them into a probability,
with the class share of all labelled rows as prior.

Fitting uses a bounded sample (SAMPLE rows per class, of at most LONGEST
characters each) on the driver; scoring is one pass without a shuffle, in
which whole texts are read in blocks of windows.

Defined results: a null text counts as empty; an empty text has one empty
window; without labelled rows of both classes every score is the share of
toxic labels (0.0 without labels); repeated rows get a score each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import mapped_more
from .common import id_remainder, sampled_texts, ship

SAMPLE = 1500         # labelled rows per class at most
LONGEST = 20_000      # characters of a sampled text at most
WINDOW, STEP = 40, 24
BASE_BYTES, TOXIC_BYTES = 32_768, 1536  # the toxic part is longer where more stands out
LEVEL = 13
CHANCE = 0.1          # expected words and stems of a round that stand out by chance
STEMS = (7, 6, 5, 4)  # characters of a word's beginnings
BLOCK = 4096          # windows scored at once
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def windows(data: bytes, begin: int = 0, count: int | None = None) -> list[bytes]:
    """Overlapping windows of a text; the last one reaches its end."""
    total = max(1, -(-(len(data) - WINDOW) // STEP) + 1)
    end = total if count is None else min(total, begin + count)
    return [data[i * STEP:i * STEP + WINDOW] for i in range(begin, end)]


def compressor(content: bytes):
    import zstandard as zs
    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    p = zs.ZstdCompressionParameters.from_level(LEVEL, min_match=4, write_content_size=False,
                                                write_dict_id=False, write_checksum=False)
    d.precompute_compress(compression_params=p)
    return zs.ZstdCompressor(dict_data=d, compression_params=p).compress


class Scorer:
    """Features and scores of texts with a fitted model."""

    def __init__(self, model: dict):
        self.model = model
        self.toxic = compressor(model["toxic"])
        self.ordinary = compressor(model["ordinary"])

    def features(self, text: str) -> list[float]:
        data, begin = text.lower().encode("utf-8"), 0
        toxic, ordinary = self.toxic, self.ordinary
        n, total, strong, top = 0, 0, 0, np.empty(0, np.int64)
        while part := windows(data, begin, BLOCK):
            saved = (np.fromiter(map(len, map(ordinary, part)), np.int64, len(part))
                     - np.fromiter(map(len, map(toxic, part)), np.int64, len(part)))
            n, total, strong = n + len(saved), total + int(saved.sum()), strong + int((saved >= 3).sum())
            top = np.sort(np.concatenate([top, saved]))[::-1][:8]
            begin += BLOCK
        root = math.sqrt(n)
        return [float(top[0]), float(top[:3].mean()), float(top.sum()) / 8, total / n, total / root,
                strong / root, 1 / root]

    def score(self, text: str) -> float:
        m = self.model
        x = (np.array(self.features(text)) - m["mean"]) / m["scale"]
        return float(1 / (1 + math.exp(-max(-60.0, min(60.0, float(x @ m["weights"]) + m["bias"])))))


def units(word: str) -> list[str]:
    """A word with its bounds, and its beginnings."""
    return [f" {word} ", *(f" {word[:n]}" for n in STEMS if n < len(word))]


def chance(n: int, b: int, na: int, nb: int) -> float:
    """Probability that of n + b texts drawn from na toxic and nb ordinary ones
    n or more are toxic (hypergeometric)."""
    def ways(total, taken):
        return math.lgamma(total + 1) - math.lgamma(taken + 1) - math.lgamma(total - taken + 1)
    whole = ways(na + nb, n + b)
    return sum(math.exp(ways(na, i) + ways(nb, n + b - i) - whole) for i in range(n, min(na, n + b) + 1))


def fragments(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """What is over-represented in toxic texts: for each of their words that
    it holds of, the word or its longest beginning that stands out. Texts that
    hold nothing of it are compared again by themselves until nothing more
    stands out, so rare wording counts among the texts that it alone marks."""
    def held(t):
        return {u for w in set(WORDS.findall(t)) for u in units(w)}

    b, nb = Counter(), len(ordinary)
    for t in ordinary:
        b.update(held(t))
    stands_out, left, tested = set(), toxic, 0
    while left:
        a, na = Counter(), len(left)
        for t in left:
            a.update(held(t))
        tested = tested or len(a)
        new = {u for u, n in a.items() if u not in stands_out and n * nb > b[u] * na
               and chance(n, b[u], na, nb) * tested < CHANCE}
        if not new:
            break
        stands_out |= new
        left = [t for t in left if stands_out.isdisjoint(held(t))]
    out = []
    for t in toxic:
        for w in WORDS.findall(t):
            best = next((u for u in units(w) if u in stands_out), None)
            if best:
                out.append(best.encode("utf-8"))
    return out


def trained(size: int, samples: list[bytes]) -> bytes:
    """Content of a trained dictionary; too few samples are taken as they are."""
    import zstandard as zs
    try:
        return zs.train_dictionary(size, samples, level=3).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]


def completed(content: bytes, samples: list[bytes]) -> bytes:
    """A trained dictionary's content, with the samples that it lacks in front,
    the most frequent ones nearest to it."""
    for x, _ in Counter(samples).most_common():
        if x not in content:
            content = x + content
    return content


def fit(sample: list[tuple[int, str]], n_toxic: int, n_ordinary: int) -> dict | None:
    """The model, from (label, text) rows and the label counts of all rows;
    None if a class is missing."""
    toxic = [t.lower() for k, t in sample if k == 1]
    ordinary = [t.lower() for k, t in sample if k == 0]
    if len(toxic) < 4 or len(ordinary) < 4:
        return None
    # two thirds train the dictionaries, the rest the curve
    learn = lambda x: [t for i, t in enumerate(x) if i % 3]
    held = lambda x: [t for i, t in enumerate(x) if i % 3 == 0]
    around = fragments(learn(toxic), learn(ordinary))
    base = trained(BASE_BYTES, [w for t in learn(ordinary) for w in windows(t.encode("utf-8"))])
    size = max(TOXIC_BYTES, sum(map(len, set(around))))
    specific = completed(trained(size, around), around) if around else b""
    model = {"toxic": specific + base, "ordinary": base}
    scorer = Scorer(model)
    texts = held(toxic) + held(ordinary)
    x = np.array([scorer.features(t) for t in texts])
    y = np.r_[np.ones(len(held(toxic))), np.zeros(len(held(ordinary)))]
    model["mean"], model["scale"] = x.mean(0), x.std(0) + 1e-6
    a = np.c_[(x - model["mean"]) / model["scale"], np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(100):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w)),
                               a.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    model["weights"] = w[:-1]
    # from the sample's class share to that of all labelled rows
    model["bias"] = float(w[-1] + math.log(n_toxic / n_ordinary) - math.log(y.sum() / (len(y) - y.sum())))
    return model


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict | None, float]:
    """Model and share of toxic labels, from labelled rows outside the held-out
    fold (crc32 of the id as text divisible by five). Ids are sampled from the
    labels alone, so only a bounded list of ids meets the documents."""
    rows = (labels.filter(id_remainder(5) != 0)
            .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
            .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).dropDuplicates())
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        return None, float(n1 > 0)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return fit(sampled_texts(rows, "toxic", counts, texts, SAMPLE, LONGEST), n1, n0), n1 / (n1 + n0)


def scored(docs: DataFrame, model: dict | None, share: float, name: str = "score") -> DataFrame:
    """``docs`` (columns of simple types, one of them text) plus a score column."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # dictionaries of fixed size
    at = docs.columns.index("text")

    def run(rows):
        scorer = Scorer(held.value) if held.value else None
        for row in rows:
            yield (*row, scorer.score(row[at] or "") if scorer else share)

    return mapped_more(docs, run, f"{name} double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model, share = learn(docs, labels)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(narrow, model, share).select(
        "doc_id", (id_remainder(5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text is not predicted to be toxic."""
    model, share = learn(docs, labels)
    return scored(docs, model, share, "_toxicity").filter("_toxicity < 0.5").drop("_toxicity")
