"""Fingerprints against exact Jaccard similarity and a plain ordering."""

import hashlib
import random

from staffwise.llm import fingerprint as G
from staffwise.llm.shingles import shingle_hashes

SCHEMA = "doc_id long, text string, stretch string, guard string, top string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "s", "g", "t") for d, t in rows], SCHEMA)


def expected(rows):
    rows = sorted(((d, t or "") for d, t in rows),
                  key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        e = G.edited(t, nxt)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), G.fingerprint(t).hex(),
                    G.fingerprint(e).hex(), G.likeness(G.fingerprint(t), G.fingerprint(e)),
                    G.likeness(G.fingerprint(t), G.fingerprint(nxt))))
    return out


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def check(spark, rows):
    got = sorted(map(tuple, G.with_next(frame(spark, rows)).collect()), key=key)
    assert got == sorted(expected(rows), key=key)


def test_order_ties_nulls_and_small_tables(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    rows = [(i * 37 % 1009, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(5, "tie"), (5, "tie"), (5, None), (2 ** 60, "big"), (-7, ""), (None, "n1"), (None, None)]
    check(spark, rows)
    check(spark, [(1, "only one document here it is")])
    check(spark, [(1, "aaa bbb ccc"), (2, "ddd eee fff ggg hhh iii")])
    assert G.with_next(frame(spark, [])).count() == 0


def test_query_on_sample_tables(spark):
    from staffwise.llm.queries import op8_document_fingerprints
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, op8_document_fingerprints(spark, sf).collect()))
    assert got == sorted(expected(rows))


def test_likeness_estimates_jaccard():
    rng = random.Random(9)
    errors = []
    for _ in range(60):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(30, 900))]
        other = list(words)
        for _ in range(rng.randint(0, len(words) // 6)):
            other[rng.randrange(len(other))] = f"x{rng.randint(0, 10**6)}"
        a, b = " ".join(words), " ".join(other)
        x, y = set(shingle_hashes(a, 5).tolist()), set(shingle_hashes(b, 5).tolist())
        errors.append(G.likeness(G.fingerprint(a), G.fingerprint(b)) - len(x & y) / len(x | y))
    assert max(map(abs, errors)) < 0.12 and abs(sum(errors)) / len(errors) < 0.02


def test_likeness_ends():
    a = G.fingerprint("one two three four five six")
    assert G.likeness(a, a) == 1.0 and G.likeness(a, b"") == 0.0 and G.likeness(b"", b"") == 1.0
    assert G.likeness(a, G.fingerprint("totally different words stand in this place")) < 0.2
