"""What must not grow faster than its input: plans and results on inputs with large groups."""

import random

import pytest
from pyspark.sql import functions as F

from fathomgrid.operators import asof, frames, masks, regions
from fathomgrid.plans import pictures, queries  # noqa: F401
from fathomgrid.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_frames_get_counts_not_arrays(spark):
    found = QUERIES["detections_to_frames"](spark, SF)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    paths = {r["p"] for r in spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_orderkey % 700 as p").distinct().collect()}
    assert all((r["n"] is None) == (r["event_id"] % 900 not in paths) for r in found.collect())


def _frames(spark):
    """Screens and fans of an hour in which all rows of some streams lie, with many of equal time, and of a sparse day."""
    rows = [(i, 1000 * (i // 3), i % 5) for i in range(6000)] + [(6000 + i, (1 + i) * asof.HOUR * 3 + i, i % 7) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t long, n long")
    return df.where("id % 3 = 0"), df.where("id % 3 > 0").withColumn("stream", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))


@pytest.mark.parametrize("tie", ["later", "earlier"])
def test_no_window_looks_on_to_the_end(spark, tie):
    """Such a window is computed anew for each row: the square of a bucket's rows, and of a stream's buckets."""
    screen, fan = _frames(spark)
    found = frames.groups(screen, fan, ["a", "b", "c"], tie)
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    cands = {s: sorted((r["t"], r["id"]) for r in fan.where(F.col("stream") == s).collect()) for s in "ab"}
    got = found.collect()
    assert len(got) == 3 * screen.count()
    for r in got:
        if r["stream"] == "c":
            assert r["found_id"] is None
            continue
        gap, t = min((abs(t - r["screen_t"]), t) for t, _ in cands[r["stream"]])
        if tie == "later" and (gap, r["screen_t"] + gap) in {(abs(t - r["screen_t"]), t) for t, _ in cands[r["stream"]]}:
            t = r["screen_t"] + gap
        same = [i for at, i in cands[r["stream"]] if at == t]
        assert r["found_id"] == (max(same) if tie == "later" and t < r["screen_t"] else min(same))


def test_reports_from_one_row_equal_grouped_ones(spark):
    screen, fan = _frames(spark)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    one, grouped = frames.reported(screen, fan, ["a", "b", "c"], tolerance=5000), frames.report(frames.groups(screen, fan, ["a", "b", "c"], tolerance=5000), ["a", "b", "c"])
    assert sorted(map(str, one.select(*grouped.columns).collect())) == sorted(map(str, grouped.collect()))
    assert plan(QUERIES["frame_group_counts"](spark, SF)).count("Generate") < plan(frames.report(frames.groups(screen, fan, ["a"]), ["a"])).count("Generate")


def _region_of(pixels):
    """The least code of the pixels that touch, by picture, by search."""
    left, out = set(pixels), {}
    for start in sorted(pixels):
        todo = [start] if start in left else []
        left.discard(start)
        while todo:
            p, y, x = todo.pop()
            out[p, y, x] = start[1] * regions.ROW + start[2]
            near = {(p, y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & left
            left -= near
            todo += near
    return out


@pytest.mark.parametrize(("band", "small"), [(64, 1 << 20), (3, 1 << 20), (3, 1)])
def test_regions_take_no_rounds_in_a_band(spark, monkeypatch, band, small):
    rng = random.Random(3)
    snake = {("s", y, x) for y in range(40) for x in range(12) if y % 2 == 0 or x == (0 if y % 4 == 1 else 11)}
    pixels = snake | {(p, rng.randrange(30), rng.randrange(25)) for p in "ab" for _ in range(280)} | {("far", y, (1 << 19) + y) for y in range(5)}
    df = spark.createDataFrame([(*p, float(p[1])) for p in pixels], "pair string, y long, x int, u double").repartition(3)
    stored, kept = [], regions.kept
    monkeypatch.setattr(regions, "kept", lambda df, name: stored.append(name) or kept(df, name))
    monkeypatch.setattr(regions, "BAND", band)
    monkeypatch.setattr(regions, "SMALL", small)
    found = regions.labelled(df, ["pair"])
    assert found.columns == ["pair", "y", "x", "u", "region"] and found.schema["x"] == df.schema["x"]
    assert {(r["pair"], r["y"], r["x"]): r["region"] for r in found.collect()} == _region_of(pixels)
    assert band < 64 or len(stored) <= 2
    assert regions.labelled(df.limit(0), ["pair"]).isEmpty()


def test_partners_are_those_of_footprints(spark):
    rng = random.Random(4)
    pixels = {(p, s, rng.randrange(30), rng.randrange(30)) for p in "ab" for s in ("target", "render") for _ in range(160)}
    df = regions.labelled(spark.createDataFrame([(*p, rng.random()) for p in pixels], "pair string, side string, y long, x long, u double"), masks.BY)
    big, parts = masks.large(df, masks.components(df, [0.5]), 3)
    assert "share" not in parts.columns and sorted(map(str, masks.without_small(df, 3).select(*df.columns).collect())) == sorted(map(str, big.select(*df.columns).collect()))
    feet = masks.footprints(big, 2)
    rows = big.collect()
    near = {(a["pair"], a["region"], b["y"], b["x"], b["region"], b["u"]) for a in rows for b in rows if a["pair"] == b["pair"] and a["side"] == "target" and b["side"] == "render" and (b["y"] - a["y"], b["x"] - a["x"]) in set(regions.disk_offsets(2))}
    assert sorted(tuple(r) for r in feet.collect()) == sorted((p, t, r, u) for p, t, _, _, r, u in near)
    assert sorted(map(str, masks.clusters(masks.partners(big, 2)).collect())) == sorted(map(str, masks.clusters(feet).collect()))
    plan = QUERIES["component_clusters"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan  # places aren't spread one by one
