"""Grouped k-means against a plain one from the same first centres, and the strip."""

import numpy as np
from pyspark.sql import functions as F

from fathomgrid.operators import colors


def plain(points, weights, centers):
    for _ in range(colors.ROUNDS):
        own = ((points[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        after = np.array([np.average(points[own == c], axis=0, weights=weights[own == c]) if (own == c).any() else centers[c] for c in range(len(centers))])
        if np.allclose(after, centers, rtol=0, atol=0):
            break
        centers = after
    d2 = ((points[:, None] - centers[None]) ** 2).sum(2)
    own = d2.argmin(1)
    return centers, own, float((d2.min(1) * weights).sum())


def test_grouped_rounds_equal_plain_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(int(p), *map(int, np.clip(rng.normal(rng.choice([40, 120, 220]), 12, 3), 0, 255))) for p in range(6) for _ in range(400)]
    rows += [(7, 10, 20, 30)] * 5 + [(8, 1, 2, 3), (8, 200, 0, 0), (9, None, 1, 1)]
    pixels = spark.createDataFrame(rows, "picture int, r int, g int, b int").repartition(5)
    counts = colors.color_counts(pixels, "picture")
    firsts = {(r["picture"], r["start"]): np.array([list(c) for c in r["centers"]]) for r in colors.first_centers(counts, "picture").collect()}
    assert all(len(c) == colors.CLUSTERS for c in firsts.values()) and len(firsts) == 8 * colors.STARTS
    found = {r["picture"]: np.array([r["r"], r["g"], r["b"]]) for r in colors.backgrounds(counts, "picture").collect()}
    assert set(found) == {*range(6), 7, 8}
    for p, center in found.items():
        own = [r for r in counts.where(F.col("picture") == p).collect()]
        points, weights = np.array([[r["r"], r["g"], r["b"]] for r in own], float), np.array([r["n"] for r in own], float)
        runs = [plain(points, weights, firsts[p, s]) for s in range(colors.STARTS)]
        best = min(range(len(runs)), key=lambda s: (round(runs[s][2], 6), s))
        centers, which, _ = runs[best]
        assert np.allclose(center, centers[np.bincount(which, weights, len(centers)).argmax()], atol=1e-9)
    again = {r["picture"]: (r["r"], r["g"], r["b"]) for r in colors.backgrounds(colors.color_counts(pixels.repartition(2), "picture"), "picture").collect()}
    assert all(np.array_equal(again[p], c) for p, c in found.items())
    assert colors.backgrounds(counts.limit(0), "picture").count() == 0


def test_strip(spark):
    pixels = spark.createDataFrame([(1, 0, 10, 10, 10), (1, 1, 13, 14, 10), (1, 2, 16, 10, 10), (2, 0, 10, 10, 10), (1, 3, None, 1, 1)], "picture int, x int, r int, g int, b int")
    back = spark.createDataFrame([(1, 10.0, 10.0, 10.0)], "picture int, r double, g double, b double")
    out = {(r["picture"], r["x"]): (r["r"], r["g"], r["b"]) for r in colors.stripped(pixels, back, "picture", 5.0).collect()}
    assert out == {(1, 0): (0, 0, 0), (1, 1): (0, 0, 0), (1, 2): (16, 10, 10), (2, 0): (10, 10, 10), (1, 3): (None, 1, 1)}


def test_small_pictures_settle_in_tasks_as_large_ones_do_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(p, *map(int, rng.integers(0, 256, 3))) for p, n in (("a", 40), ("b", 300), ("c", 6), ("d", 1)) for _ in range(n)]
    counts = colors.color_counts(spark.createDataFrame(rows, "picture string, r int, g long, b int"), "picture").repartition(3)
    stored, kept = [], colors.kept
    monkeypatch.setattr(colors, "kept", lambda df, name: stored.append(name) or kept(df, name))
    found = {r["picture"]: r for r in colors.backgrounds(counts, "picture").collect()}
    assert found.keys() == set("abcd") and len(stored) <= 2  # not one table for each round
    monkeypatch.setattr(colors, "SMALL", 30)
    assert {r["picture"]: r for r in colors.backgrounds(counts, "picture").collect()} == found and len(stored) > 8
