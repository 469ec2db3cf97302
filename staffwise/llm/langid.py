"""Language identification by nearest centroid.

A text's character n-grams (one to three code points of the lower-cased text,
with a space for whatever is not a letter) are counted in DIMENSIONS hashed cells, damped and weighted by inverse
document frequency, and normalised. Each language has several centroids from
spherical k-means over its sample; a text gets the language of the centroid
with the largest cosine. It is marked rejected where that cosine is below
what its language's own sample reaches.

Fitting uses a bounded sample (SAMPLE texts per language, of at most LONGEST
characters) on the driver; prediction is one pass without a shuffle. Long
texts are counted in blocks of BLOCK characters that overlap by two.

Defined results: a null text or one without a letter is ``und`` with score
0.0; where no language was learned every text is ``und``; repeated rows get a
prediction each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import mapped
from .common import id_remainder, labelled_sample, ship

SAMPLE = 400          # texts per language at most
LONGEST = 20_000      # characters of a sampled text at most
DIMENSIONS = 4096
CENTROIDS = 4
BLOCK = 1 << 20
MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint32)
SHIFT = np.uint32(32 - 12)
OTHER = re.compile(r"[\W\d_]+")


def counts(text: str) -> np.ndarray:
    """Hashed counts of one-, two- and three-character n-grams; whatever is not
    a letter counts as one space."""
    text = OTHER.sub(" ", text.lower())
    out = np.zeros(DIMENSIONS, np.float64)
    for at in range(0, max(1, len(text)), BLOCK):
        # two characters before the block complete the n-grams that reach into it
        left = max(0, at - 2)
        c = np.frombuffer(text[left:at + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")
        with np.errstate(over="ignore"):
            h = (c + np.uint32(1)) * MULTIPLIERS[0]
            for n in range(3):
                if n:
                    h = (h[:-1] ^ (c[n:] * MULTIPLIERS[n])) * MULTIPLIERS[0]
                done = max(0, at - left - n)  # n-grams that the block before has counted
                out += np.bincount((h[done:] >> SHIFT).astype(np.int64), minlength=DIMENSIONS)
                if len(c) <= n + 1:
                    break
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def vector(text: str, weights: np.ndarray) -> np.ndarray:
    return unit(np.log1p(counts(text)) * weights)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from spread-out rows, until the cosines stop growing."""
    picked = [0]
    while len(picked) < min(k, len(x)):
        near = (x @ x[picked].T).max(1)
        picked.append(int(np.argmin(near)))
    centres, reached = x[picked], -1.0
    while True:
        near = x @ centres.T
        own, total = near.argmax(1), float(near.max(1).sum())
        if total <= reached + 1e-9:
            return centres
        reached = total
        centres = unit(np.array([x[own == i].sum(0) if (own == i).any() else centres[i]
                                 for i in range(len(centres))]))


def fit(sample: list[tuple[str, str]]) -> dict | None:
    sample = [(k, t) for k, t in sample if has_letter(t)]
    if not sample:
        return None
    raw = np.array([counts(t) for _, t in sample])
    seen = (raw > 0).sum(0)
    weights = np.log((1 + len(raw)) / (1 + seen)) + 0.1
    x = unit(np.log1p(raw) * weights)
    names = np.array([k for k, _ in sample])
    centres, owners, least = [], [], {}
    for k in sorted(set(names.tolist())):
        own = clusters(x[names == k], CENTROIDS)
        centres.append(own)
        owners += [k] * len(own)
        # the cosine that all but one in a hundred of its sample reach, less a margin
        least[k] = 0.8 * float(np.quantile((x[names == k] @ own.T).max(1), 0.01))
    return {"weights": weights, "centres": np.concatenate(centres), "owners": owners, "least": least}


def predict(model: dict | None, text: str | None) -> tuple[str, float, bool]:
    """(language, cosine, rejected)."""
    if model is None or text is None or not has_letter(text):
        return "und", 0.0, True
    near = model["centres"] @ vector(text, model["weights"])
    best = int(np.argmax(near))
    language, score = model["owners"][best], float(min(1.0, max(0.0, near[best])))
    return language, score, score < model["least"][language]


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected. Learns from
    text and lang of documents outside the held-out fold."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.filter(id_remainder(3) != 1).select("text", F.col("lang").cast("string").alias("lang"))
    model = spark.sparkContext.broadcast(fit(labelled_sample(rows, "lang", SAMPLE, LONGEST)))

    def run(texts):
        for doc, text in texts:
            yield doc, *predict(model.value, text)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(narrow, run, "doc_id long, lang_pred string, score double, rejected boolean").select(
        "doc_id", (id_remainder(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
