"""Candidate pairs, the ratio and the components against brute force."""

import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from staffwise.operators import normalize as N
from staffwise.operators import similarity as S
from staffwise.operators.components import components

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789eee   "


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        cur = [i]
        for j, d in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    return prev[-1]


def _text(rng, least, most, letters):
    return "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))


def _changed(rng, text, changes, letters):
    out = list(text)
    for _ in range(rng.randint(0, changes)):
        i = rng.randint(0, len(out))
        out[i:i + rng.randint(0, 3)] = _text(rng, 0, 3, letters)
    return "".join(out)


def test_ratio_equals_the_standard_library(spark):
    rng = random.Random(5)
    pairs = [("", ""), ("a", ""), ("", "b"), ("tide", "diet"), ("diet", "tide"), ("日本語x", "本語y🙂"), ("aaa", "aa"),
             ("x" * 250, "x" * 240), ("ab" * 150, "ba" * 130), ("q" * 199, "q" * 200)]
    for _ in range(700):
        a = _text(rng, 0, 25, "abcde é")
        pairs.append((a, _changed(rng, a, 8, "abcdé")))
    for _ in range(25):  # from 200 characters on popular ones start no block
        a = _text(rng, 150, 330, LETTERS)
        pairs.append((a, _changed(rng, a, 60, "abcdé e")))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["r"] for r in df.select("i", S.ratcliff_ratio("a", "b").alias("r")).collect()}
    assert [(p, got[i]) for i, p in enumerate(pairs) if got[i] != ratio(*p)] == []
    null = spark.sql("select cast(null as string) as a, 'x' as b")
    assert null.select(S.ratcliff_ratio("a", "b").alias("r"), S.ratcliff_ratio("b", "a").alias("s")).first()[:] == (None, None)


def job_titles():
    first = ["Senior", "Junior", "Assistant", "Deputy", "Night", "Day", "Chief", "Lead", "Trainee", "Relief"]
    second = ["Kitchen", "Laundry", "Security", "Reservation", "Banquet", "Purchasing", "Maintenance", "Pastry",
              "Front Desk", "Housekeeping", "Pool", "Garden"]
    third = ["Manager", "Supervisor", "Attendant", "Clerk", "Officer", "Technician"]
    return [" ".join(x) for x in itertools.product(first, second, third)][:444]


def test_candidates_miss_no_pair_and_few_are_scored(spark):
    titles = job_titles()
    df = spark.createDataFrame([("positions", t) for t in titles], "kind string, cleaned string")
    x = df.select("kind", F.col("cleaned").alias("x"))
    met = S.candidates(x, x.withColumnRenamed("x", "y"), "ratcliff", 0.78, ordered=True)
    every = len(titles) * (len(titles) - 1) // 2
    want = {(a, b) for a, b in itertools.combinations(sorted(titles), 2) if max(ratio(a, b), ratio(b, a)) >= 0.78}
    got = {(r["a"], r["b"]) for r in N.similar_pairs(df).collect()}
    assert got == want and len(want) > 300
    assert S.near(met, "ratcliff", 0.78).count() < 0.05 * every


@pytest.mark.parametrize("mode", ["ratcliff", "levenshtein"])
def test_short_and_odd_names(spark, mode):
    rng = random.Random(9)
    names = {"a", "A", "é", "🙂", "aa", "ab", "ba", "aab", "", " ", "x" * 40, "x" * 33, "日本", "日本語"}
    for _ in range(90):
        t = _text(rng, 1, 12, "abc d")
        names |= {t, _changed(rng, t, 3, "abx")}
    names = sorted(names)
    df = spark.createDataFrame([("k", t) for t in names], "kind string, cleaned string")
    score = (lambda a, b: max(ratio(a, b), ratio(b, a))) if mode == "ratcliff" else \
        (lambda a, b: 1 - edits(a, b) / max(len(a), len(b)))
    want = {(a, b) for a, b in itertools.combinations([n for n in names if n], 2) if score(a, b) >= 0.78}
    assert {(r["a"], r["b"]) for r in N.similar_pairs(df, mode=mode).collect()} == want and len(want) > 10


def test_a_cell_of_thousands_of_characters(spark, registry):
    rng = random.Random(2)
    long = _text(rng, 5000, 5000, LETTERS)
    values = [long, _changed(rng, long, 40, "abc"), "Kitchn"]
    got = {r["value"]: r for r in N.normalize_values(spark.createDataFrame(
        [("departments", v) for v in values], "kind string, value string"), registry, cluster=True).collect()}
    assert got["Kitchn"]["canonical"] == "Kitchen"
    # so long that every character is popular: nothing matches
    assert all(got[v]["canonical"] == got[v]["cleaned"] and got[v]["step"] == "none" for v in values[:2])


def _components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, a, b in edges:
        a, b = find((k, a)), find((k, b))
        root[max(a, b)] = min(a, b)
    return {x: find(x)[1] for x in root}


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.choice("pq"), f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(260)]
    edges += [("p", "hub", f"leaf{i}") for i in range(500)] + [("q", "a", "a"), ("q", "b", "a"), ("q", "a", "b")]
    got = components(spark.createDataFrame(edges, "kind string, a string, b string"), ("kind",)).collect()
    assert {(r["kind"], r["node"]): r["component"] for r in got} == _components(edges) and len(got) == len(_components(edges))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    from staffwise.operators import components as C
    rounds = []
    stars = C._stars
    monkeypatch.setattr(C, "_stars", lambda *a: rounds.append(1) or stars(*a))
    got = C.components(spark.createDataFrame([(i, i + 1) for i in range(9_999)], "a long, b long"))
    assert got.select("component").distinct().count() == 1 and got.count() == 10_000
    assert len(rounds) <= 17
