"""Mixing of sources against plain Python and by its guarantees."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from staffwise.llm import mixing as M

SCHEMA = ("doc_id long, text string, source string, size string, target string, id string, row string, "
          "`key` string, hash string, `_range` string, copies string, `a.b` string")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, *"abcdefghi") for d, t, s in rows], SCHEMA)


def plain_targets(sizes):
    """Sharing out again and again until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    out, open_, rest = {}, set(names), float(sum(sizes.values()))
    while True:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / w > M.MOST * sizes[s]}
        if not over:
            return out | {s: rest * weight[s] / w for s in open_}
        for s in over:
            out[s] = float(M.MOST * sizes[s])
        open_ -= over
        rest = sum(sizes.values()) - sum(out.values())
        if not open_:
            return out


def words(n):
    return " ".join(["wort"] * n)


ROWS = ([(i, words(1 + i * i % 97), "hot") for i in range(600)]
        + [(1000 + i, words(3 + i % 11), f"s{i % 7}") for i in range(300)]
        + [(2000, words(5000), "s3"), (2001, words(2), "tiny"), (2002, None, "blank"), (2003, "\x0b \n\t", "blank"),
           (2004, "", None), (2005, words(40), None), (None, words(7), "s1"), (None, None, "s1"),
           (7, words(9), "s2"), (7, words(9), "s2"), (7, words(9), "s2"), (2006, "  a b c d  ", "")])


def test_mix(spark):
    got = M.mix(frame(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    assert {r["doc_id"]: r["size"] for r in got if r["doc_id"] in (2002, 2003, 2004, 2006)} == \
        {2002: 0, 2003: 0, 2004: 0, 2006: 2}
    sizes, longest, taken, target = Counter(), Counter(), Counter(), {}
    of = defaultdict(list)
    for d, t, s in ROWS:
        n = len((t or "").encode().split())
        sizes[s] += n
        longest[s] = max(longest[s], n)
        of[d, n].append(s)
    expected = plain_targets(sizes)
    for r in got:
        s = of[r["doc_id"], r["size"]].pop()
        assert r["source_size"] == sizes[s]
        target[s] = r["target"]
        taken[s] += r["taken"]
        assert r["taken"] <= M.MOST * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        if r["size"]:
            assert math.floor(expected[s] / sizes[s]) <= r["taken"] // r["size"] <= math.ceil(expected[s] / sizes[s])
    assert target == pytest.approx(expected)
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert target["tiny"] == 6 and taken["tiny"] == 6 and target["blank"] == 0
    for s in sizes:  # one document more or less, whatever the number of documents
        assert abs(taken[s] - expected[s]) <= longest[s]
    assert abs(taken["hot"] / expected["hot"] - 1) < 0.01


def test_one_document_for_each_integer_crossed(spark):
    """The rule itself, by plain Python over sorted documents."""
    import hashlib
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    got = {r["doc_id"]: r["taken"] for r in M.mix(frame(spark, ROWS)).filter("doc_id < 600 and doc_id <> 7").collect()}
    sizes = Counter()
    for _, t, s in ROWS:
        sizes[s] += len((t or "").encode().split())
    rate = plain_targets(sizes)["hot"] / sizes["hot"]
    hot = []
    for d, t, s in ROWS:
        if s == "hot":
            n, lot = len(t.split()), md5(f"mix{d}")
            hot.append((lot[0] >= "8", -n if lot[0] >= "8" else n, lot, d, n))
    at = int(md5("mixshot")[:10], 16) / M.UNIT
    for _, _, _, d, n in sorted(hot):
        after = at + rate
        if d != 7:
            assert got[d] == n * (math.floor(after) - math.floor(at))
        at = after


def test_reruns_and_partitions_agree(spark):
    a = sorted(M.mix(frame(spark, ROWS).repartition(7)).collect(), key=str)
    b = sorted(M.mix(frame(spark, ROWS).repartition(2, "text")).collect(), key=str)
    c = M.mix(frame(spark, ROWS), seed="other").collect()
    assert a == b and sorted(c, key=str) != a


def test_mixed_emits_the_rows_it_counts(spark):
    docs = frame(spark, ROWS)
    out = M.mixed(docs)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    words_out = out.select("doc_id", M.n_words(F.col("text")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"))
    got = {r["doc_id"]: r["n"] for r in words_out.collect() if r["n"]}
    counted = Counter()
    for r in M.mix(docs).collect():
        counted[r["doc_id"]] += r["taken"]
    assert got == {k: v for k, v in counted.items() if v}


def test_empty_and_blank_tables(spark):
    assert M.mix(frame(spark, []).filter("doc_id = 1")).collect() == []
    assert M.mixed(frame(spark, [])).collect() == []
    rows = M.mix(frame(spark, [(1, None, None), (2, "", "a")])).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in rows) == \
        [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_words_of_very_long_texts(spark):
    long = spark.range(1).select(F.concat(F.repeat(F.lit(" "), 300_000), F.repeat(F.lit("ab \t\n"), 200_000),
                                          F.repeat(F.lit("x"), 400_000)).alias("t"))
    assert long.select(M.n_words(F.col("t"))).first()[0] == 200_001
    blank = spark.range(1).select(F.repeat(F.lit("\x0c "), 500_000).alias("t"))
    assert blank.select(M.n_words(F.col("t"))).first()[0] == 0
