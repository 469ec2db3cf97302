"""Normalization (C1-C7) fixtures."""

import pytest
from pyspark.sql import functions as F

from staffwise.functions.columns import clean_name
from staffwise.operators import normalize as N


def _map(spark, registry, kind, values, mode="ratcliff"):
    v = spark.createDataFrame([(kind, x) for x in values], "kind string, value string")
    return {x["value"]: x for x in N.normalize_values(v, registry, mode=mode).collect()}


def test_clean_title_case(spark):
    df = spark.createDataFrame([("f&b",), ("o'neil  kOT",), ("  house   keeping ",)], "v string")
    out = [x[0] for x in df.select(clean_name("v")).collect()]
    assert out == ["F&B", "O'Neil Kot", "House Keeping"]


def test_steps(spark, registry):
    m = _map(spark, registry, "departments", ["kot", "hr", "front desk", "Admin", "Kitch", "Kitchn"])
    assert (m["kot"]["canonical"], m["kot"]["step"]) == ("KOT", "exact")
    assert (m["hr"]["canonical"], m["hr"]["step"]) == ("Human Resources", "alias")
    assert (m["front desk"]["canonical"], m["front desk"]["step"]) == ("Front Office", "alias")
    assert (m["Admin"]["canonical"], m["Admin"]["step"]) == ("Administration", "alias")
    assert (m["Kitch"]["canonical"], m["Kitch"]["step"]) == ("Kitchen", "prefix")
    assert m["Kitchn"]["canonical"] == "Kitchen" and m["Kitchn"]["score"] == pytest.approx(0.923, abs=1e-3)


def test_ratcliff_scores(spark, registry):
    m = _map(spark, registry, "positions", ["Stewart", "Security Gaurd", "House Keeping"])
    assert m["Stewart"]["canonical"] == "Steward" and m["Stewart"]["score"] == pytest.approx(0.857, abs=1e-3)
    assert m["Security Gaurd"]["canonical"] == "Security Guard"
    assert m["Security Gaurd"]["score"] == pytest.approx(0.929, abs=1e-3)
    # the alias wins over a fuzzy hit and leaves a value outside the registry
    assert (m["House Keeping"]["canonical"], m["House Keeping"]["step"]) == ("Housekeeping", "alias")


def test_levenshtein_mode(spark, registry):
    m = _map(spark, registry, "departments", ["Kitchenn", "Zzz"], mode="levenshtein")
    assert m["Kitchenn"]["canonical"] == "Kitchen" and m["Kitchenn"]["step"] == "fuzzy"
    assert (m["Zzz"]["canonical"], m["Zzz"]["step"]) == ("Zzz", "none")


def test_cluster_against_brute_force(spark):
    """Pigeonhole candidate pairs equal all-pairs brute force."""
    import itertools

    vals = ["Dept Q3", "Dept Q4", "Dept Q44", "Chinese Thai", "Chinese Thaii", "Xy", "Xz",
            "Night Crew", "Nite Crew", "Alpha", "Alphabet", "Pastry Kitchen", "Pastry Kitchn"]
    df = spark.createDataFrame([("departments", v) for v in vals], "kind string, cleaned string")
    got = {(x["a"], x["b"]) for x in N.similar_pairs(df, mode="levenshtein").collect()}

    def lev(a, b):
        prev = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            cur = [i]
            for j, cb in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
            prev = cur
        return prev[-1]

    want = {tuple(sorted((a, b))) for a, b in itertools.combinations(vals, 2)
            if 1 - lev(a, b) / max(len(a), len(b)) >= 0.78}
    assert got == want
    cl = {x["cleaned"]: x["cluster"] for x in N.cluster_values(df, mode="levenshtein").collect()}
    assert cl["Dept Q3"] == cl["Dept Q4"] == cl["Dept Q44"] == "Dept Q44"
    assert cl["Chinese Thai"] == "Chinese Thaii"
    assert cl["Alpha"] == "Alpha"


def _names(n):
    import random
    rng = random.Random(4)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 14))).strip() or "a" for _ in range(n)]
    out = set(base)
    for v in base:
        w = list(v)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(w) + 1)
            w[i:i + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
        out.add("".join(w).strip() or "b")
    return sorted(out)


def test_ratcliff_candidates_miss_no_pair(spark):
    import difflib
    import itertools
    vals = _names(140)
    got = {(x["a"], x["b"]) for x in N.similar_pairs(
        spark.createDataFrame([("departments", v) for v in vals], "kind string, cleaned string")).collect()}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {(a, b) for a, b in itertools.combinations(vals, 2) if max(ratio(a, b), ratio(b, a)) >= 0.78}
    assert got == want and len(want) > 50


def test_ratcliff_is_the_default(spark, registry):
    m = _map(spark, registry, "positions", ["Chf"])
    assert (m["Chf"]["canonical"], m["Chf"]["step"]) == ("Chef", "fuzzy")


def test_long_chains_of_similar_names_are_one_cluster(spark):
    vals = ["a" * i + "b" * (70 - i) for i in range(0, 70)]
    cl = N.cluster_values(spark.createDataFrame([("departments", v) for v in vals], "kind string, cleaned string"))
    assert cl.select("cluster").distinct().count() == 1
