"""Whitening against exact sums and a plain eigendecomposition."""

import math

import numpy as np
import pytest

from staffwise.llm import whitening as W

SCHEMA = ("vec_id long, embedding array<float>, label int, x string, part string, n string, component string,"
          " `row` string")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, *"abcde") for i, v in rows], SCHEMA)


def vectors(n=400, d=12, seed=2):
    rng = np.random.default_rng(seed)
    return (rng.normal(0, 0.2, (n, d)) @ np.diag(np.linspace(0.3, 2, d))
            + rng.normal(0, 1, d)).astype(np.float32)


def plain(rows):
    """Expected rows by exact whole numbers and numpy's eigh."""
    kept = [(i, [float(np.float32(c)) for c in v]) for i, v in rows
            if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(i, tuple(math.floor(64 * c) + 1000000 for c in v)) for i, v in kept]
    fitted = sorted(set(x for _, x in whole))
    n, sums = len(fitted), [sum(c) for c in zip(*fitted)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fitted])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    return whole, n, sums, e[::-1], u[:, ::-1], v


def check(rows, got, k=16):
    whole, n, sums, e, u, v = plain(rows)
    k = min(k, len(e))
    assert len(got) == k * len(whole)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    expected = {}
    for i, x in whole:
        expected.setdefault((i, sum((n * c - s) ** 2 for c, s in zip(x, sums))), []).append(x)
    assert set(by) == set(expected)
    assert {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    signs = {}
    for key, xs in expected.items():
        mine = sorted(by[key], key=lambda r: r["component"])
        assert sorted(r["component"] for r in mine) == sorted(list(range(1, k + 1)) * len(xs))
        if len(set(xs)) > 1:
            continue
        c = np.array([(n * c - s) / n for c, s in zip(xs[0], sums)])
        for r in mine:
            j = r["component"] - 1
            w = c @ u[:, j] / math.sqrt(e[j])
            if abs(w) > 1e-3:
                assert signs.setdefault(j, math.copysign(1, w * r["whitened"])) == math.copysign(1, w * r["whitened"])
            assert abs(abs(w) - abs(r["whitened"])) < 1e-7
            assert r["explained"] == pytest.approx(e[j] / np.trace(v), rel=1e-9)


def test_whitened_against_exact_sums(spark):
    x = vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(i, x[0].tolist()) for i in range(1000, 1300)]  # a hot vector counts once
    rows += [(5, x[7].tolist()), (None, x[8].tolist()), (2000, None), (2001, []), (2002, [None] * 12),
             (2003, [float("nan")] + [0.0] * 11), (2004, [float("inf")] + [0.0] * 11), (2005, x[9].tolist())]
    check(rows, W.whitened(frame(spark, rows).repartition(5)).collect())


def test_more_dimensions_than_components(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(150, 30, 4))]
    check(rows, W.whitened(frame(spark, rows)).collect())


def test_supplied_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    check(rows, W.whitened(table).collect())


def test_no_vectors_or_no_variance(spark):
    assert W.whitened(frame(spark, [])).collect() == []
    assert W.whitened(frame(spark, [(1, None)])).collect() == []
    assert W.whitened(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect() == []
    with pytest.raises(ValueError):
        W.whitened(frame(spark, [(1, [0.5]), (2, [0.5, 1.0])]))


def test_directions_without_variance_are_left_out(spark):
    x = vectors(60, 3)
    rows = [(i, [a, b, a, 0.0, b]) for i, (a, b, _) in enumerate(x.tolist())]
    got = W.whitened(frame(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2} and got[0]["identity_error"] < 1e-9


def test_huge_entries(spark):
    rows = [(i, [float(10 ** i), float(i), -3e38]) for i in range(1, 30)]
    got = W.whitened(frame(spark, rows)).collect()
    assert len(got) % 29 == 0 and all(math.isfinite(r["whitened"]) for r in got)
    assert {r["deviation"] for r in got} == {None}


@pytest.mark.parametrize("d, n", [(1, 30), (2, 50), (7, 200), (33, 90), (16, 5)])
def test_rank_one_updates_alone(d, n):
    """The spectrum before any refinement; whole-number vectors with ties."""
    rng = np.random.default_rng(d)
    x = rng.integers(-3, 4, (n, d)) + 1000000
    x[: n // 3, d // 2:] = 1000000
    a, b = W.Spectrum(x[0]), W.Spectrum(x[n // 2])
    for row in x[:n // 2]:
        a.take(row)
    for row in x[n // 2:]:
        b.take(row)
    a.add(W.Spectrum.of(dict(zip([f.split(" ")[0] for f in W.SPECTRUM.split(", ")], b.row(0)))))
    c = x - x.mean(axis=0)
    m = c.T @ c
    assert a.n == n and ((a.high << 32) + a.low == x.sum(axis=0)).all()
    assert np.allclose(a.origin + a.mean, x.mean(axis=0), rtol=0, atol=1e-9)
    scale = max(1.0, np.abs(m).max())
    assert np.abs(a.vectors.T @ a.vectors - np.eye(d)).max() < 1e-12
    assert np.abs(a.vectors @ np.diag(a.values) @ a.vectors.T - m).max() < 1e-11 * scale
    assert np.abs(np.sort(a.values) - np.linalg.eigvalsh(m)).max() < 1e-11 * scale


def test_secular_roots_near_poles():
    d = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-13, 5.0])
    z = np.array([1e-7, 1.0, 1e-6, 0.5, 1e-8])
    near, away = W.secular_roots(d, z, 2.0)
    roots = d[near] - away[np.arange(5), near]
    assert (np.diff(roots) > 0).all() and (roots >= d).all() and (roots[:-1] <= d[1:]).all()
    f = 1 + (2.0 * z * z / away).sum(axis=1)
    assert (np.abs(f) <= 1e-12 * (1 + np.abs(2.0 * z * z / away).sum(axis=1))).all()
