"""Whitening: the spectrum against numpy's, exact sums, and the query's columns against a plain computation."""

import math
from fractions import Fraction

import numpy as np
import pytest

from fathomgrid.llm import whitening

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("kind", ["random", "equal values", "low rank", "identity", "zero", "close values"])
@pytest.mark.parametrize("n", [1, 2, 7, 64, 130])
def test_spectrum(kind, n):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    values = {
        "random": rng.exponential(size=n),
        "equal values": np.array([5.0, 5, 3, 3, 3, 1] * n)[:n],
        "low rank": np.append(rng.exponential(size=max(1, n // 4)), np.zeros(n))[:n],
        "identity": np.full(n, 3.0),
        "zero": np.zeros(n),
        "close values": 1 + 1e-9 * np.arange(n),
    }[kind]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, vectors = whitening.spectrum(a, 16)
    k, scale = min(16, n), max(1e-300, np.abs(values).max())
    assert np.abs(found - np.sort(np.linalg.eigvalsh(a))[::-1][:k]).max() <= 1e-13 * scale
    assert np.abs(a @ vectors - vectors * found).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() <= 1e-13


def plain(rows, d):
    """Everything by the definition: (n, S, covariance, fit list, x of the usable rows)."""
    usable = {}
    for at, (vec_id, v) in enumerate(rows):
        if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v):
            usable[at] = (vec_id, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v))
    fit = sorted({x for _, x in usable.values()})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = [[Fraction(n * a - b, n) for a, b in zip(x, s, strict=True)] for x in fit]
    cov = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(d)] for i in range(d)])
    return n, s, cov, fit, list(usable.values())


def compare(out, rows, d):
    n, s, cov, fit, usable = plain(rows, d)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(16, d)
    assert len(out) == k * len(usable)
    by = {}
    for r in out:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    signs = {}
    for vec_id, x in usable:
        deviation = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        found = by[vec_id, deviation]
        y = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)])
        for c in range(k):
            r = found[c + 1][0]
            assert r["n"] == n and abs(r["explained"] - values[c] / np.trace(cov)) <= 1e-10 and r["identity_error"] <= 1e-9
            want = float(y @ vectors[:, c]) / math.sqrt(values[c])
            if abs(want) > 1e-3:
                sign = signs.setdefault(c, np.sign(want * r["whitened"]))
                assert math.isclose(sign * r["whitened"], want, rel_tol=1e-7, abs_tol=1e-7)


def test_query_on_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(150).collect()]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, x string, n double")
    compare(whitening.whitened(df).collect(), rows, 64)


def test_few_dimensions_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(0, 3, 3) * (5, 1, 0.2)]) for i in range(60)]
    rows += [(0, rows[0][1]), (None, rows[1][1]), (7, None), (8, []), (9, [1.0, None, 2.0]), (10, [1.0, float("nan"), 2.0]), (11, [float("inf"), 0.0, 0.0]), (12, [1.0, 2.0]), (13, [-0.0, 1e-9, -1e-9])] + [(14, [1.0, 2.0, 3.0])] * 50
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, component int").repartition(7)
    out = whitening.whitened(df).collect()
    compare(out, rows, 3)
    again = whitening.whitened(df.repartition(2)).collect()
    key = lambda r: (repr(r["vec_id"]), r["component"], r["deviation"], r["whitened"])
    assert sorted(map(key, out)) == sorted(map(key, again))  # the same bits for any partitions


def test_huge_entries_and_no_variance(spark):
    rows = [(0, [1e300, 1.0]), (1, [-1e300, 1.0]), (2, [1e9, 1.0]), (3, [3e9, 1.0])]
    out = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 8 and all(math.isfinite(r["whitened"]) and r["identity_error"] < 1e-4 for r in out)
    assert {r["whitened"] for r in out if r["component"] == 2} == {0.0}
    assert any(r["deviation"] is None for r in out)
    one = whitening.whitened(spark.createDataFrame([(5, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")).collect()
    assert len(one) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one} == {(1, 0, 0.0, 0.0)}


def test_empty(spark):
    for rows in ([], [(1, None), (2, [float("nan")])]):
        out = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_products_are_exact_for_large_numbers(spark):
    rng = np.random.default_rng(6)
    x = [[int(v) for v in r] for r in rng.integers(-(1 << 40), 1 << 40, (30, 3))]
    fit = spark.createDataFrame([(r,) for r in x], "x array<long>").repartition(4)
    assert whitening.sums(fit) == [sum(r[i] for r in x) for i in range(3)]
    assert whitening.products(fit, [1, 2, 3]) == {(i, j): sum((r[i] - i - 1) * (r[j] - j - 1) for r in x) for i in range(3) for j in range(i, 3)}
