"""Kernels against plain definitions: alignment, rasters, the temporal filter, masks, palettes, detection, sources."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomgrid.functions import scalars
from fathomgrid.operators import asof, detect, fold, frames, masks, palette, raster, regions, sweep
from fathomgrid.sources import ranges, records, sinks


@pytest.mark.parametrize("tie", ["later", "earlier"])
def test_nearest_equals_a_scan(spark, tie):
    rng = random.Random(1)
    drivers = [(i, rng.randrange(0, 400)) for i in range(60)] + [(60, 10), (61, 5000)]
    cands = [(s, rng.randrange(50, 350), 100 * k + i) for k, s in enumerate("ab") for i in range(40)] + [("a", 8, 900), ("a", 12, 901), ("a", 8, 902)]
    out = asof.nearest(spark.createDataFrame(drivers, "n int, t long"), spark.createDataFrame(cands, "stream string, t long, id long"), ["a", "b", "c"], tie, bucket=37).collect()
    assert len(out) == 3 * len(drivers)
    for r in out:
        t, own = r["driver"]["t"], sorted((c[1], c[2]) for c in cands if c[0] == r["stream"])
        if not own:
            assert r["found"] is None
            continue
        if tie == "earlier":
            best = min(range(len(own)), key=lambda i: (abs(own[i][0] - t), i))
        else:
            i = next((i for i, c in enumerate(own) if c[0] >= t), len(own))
            best = i - 1 if i == len(own) or i > 0 and t - own[i - 1][0] < own[i][0] - t else i
        assert (r["found"]["t"], r["found"]["id"]) == own[best] and r["gap"] == abs(own[best][0] - t)


def test_nearest_tolerance_and_ranks(spark):
    d = spark.createDataFrame([(1, 100), (2, 500), (3, None)], "n int, t long")
    c = spark.createDataFrame([("a", 130, 7)], "stream string, t long, id long")
    out = {r["driver"]["n"]: r for r in asof.nearest(d, c, ["a"], tolerance=50).collect()}
    assert out[1]["found"]["id"] == 7 and out[2]["found"] is None and 3 not in out
    rows = [(i, random.Random(i).randrange(1000)) for i in range(200)]
    got = {r["id"]: r["rank"] for r in asof.ranked(spark.createDataFrame(rows, "id long, t long"), [], bucket=50).collect()}
    assert got == {i: k for k, (_, i) in enumerate(sorted((t, i) for i, t in rows))}


def test_upper_median(spark):
    for values, want in (([1, 2, 3, 4], 3), ([1, 2, 3], 2), ([5], 5), ([1, 1, 9, 9], 9)):
        assert spark.createDataFrame([(v,) for v in values], "v long").select(scalars.upper_median("v")).first()[0] == want


def test_scalars(spark):
    df = spark.createDataFrame([("12_340", "weak ", "2024-01-02T03-04-05-9Z"), ("bad", "nope", "x"), ("1", "STRONG", "2024-01-02T03-04-05Z"), ("1_x", "off", "")], "k string, l string, s string")
    b, s = scalars.cell_key(df["k"])
    rows = df.select(b, s, scalars.blend_of(df["l"]), scalars.render_time(df["s"])).collect()
    assert [tuple(r[:3]) for r in rows] == [(12, 340, 0.5), (None, None, 1.0), (None, None, 0.12), (None, None, 1.0)]
    assert rows[0][3] == datetime(2024, 1, 2, 3, 4, 5, 900000) and rows[1][3] is None and rows[2][3] == datetime(2024, 1, 2, 3, 4, 5)
    assert [scalars.gray_floor(x) for x in (-96, -100, -120, -64, 0)] == [29, 0, 0, 255, 255]


AZ, AMPS = [-15.0, -5.0, 5.0, 15.0], {"0_3": -6000.0, "1_5": -5000.0, "2_2": -7500.0, "bad": 1.0, "9_1": -6000.0, "1_99": -6000.0, "3_7": -9000.0}


def test_cells():
    b, s, v = raster.cells_of(AMPS, 4, 8, 0.0)
    assert list(zip(b.tolist(), s.tolist(), strict=True)) == [(0, 3), (1, 5), (2, 2)]
    assert v[1] == 1.0 and math.isclose(v[0], (-6000 * scalars.DB_PER_COUNT + 100) / 36)


def test_sector_kernel_equals_pixel_rule():
    got = raster.signal_of(AZ, 8, 0.5, 0.9, AMPS, 40, raster.Style(kernel="cell"))
    w, edges = raster.window_of(np.array(AZ), 8, 0.5, 0.9), raster.edges_of(np.array(AZ))
    b, s, v = raster.cells_of(AMPS, 4, 8, 0.0)
    for py in range(40):
        for px in range(40):
            y, x = w.min_h + px / 40 * w.span_h, w.max_v - py / 40 * w.span_v
            r, a = math.hypot(x, y), math.degrees(math.atan2(y, x))
            best = max((n for i, k, n in zip(b, s, v, strict=True) if (k + 0.5) * 0.45 <= r < (k + 1.5) * 0.45 and edges[i] <= a < edges[i + 1]), default=0)
            assert got[py, px] == (int(best * 255 + 0.5) if best > 0.03 else 0)


def test_bilinear_kernel_equals_pixel_rule():
    got = raster.signal_of(AZ, 8, 0.5, 0.9, AMPS, 40, raster.Style(kernel="bilinear"))
    w, grid = raster.window_of(np.array(AZ), 8, 0.5, 0.9), np.zeros((4, 8))
    for b, s, v in zip(*raster.cells_of(AMPS, 4, 8, 0.0), strict=True):
        grid[b, s] = v
    for py in range(40):
        for px in range(40):
            y, x = w.min_h + px / 40 * w.span_h, w.max_v - py / 40 * w.span_v
            at, a, v = math.hypot(x, y) / 0.45 - 1, math.degrees(math.atan2(y, x)), 0.0
            if 0 <= at <= 7 and AZ[0] <= a <= AZ[-1]:
                k = max(1, next(i for i in range(4) if AZ[i] >= a))
                f, s0 = (a - AZ[k - 1]) / 10, int(at)
                row = grid[k - 1] * (1 - f) + grid[k] * f
                v = row[s0] * (1 - at + s0) + row[min(7, s0 + 1)] * (at - s0)
            assert abs(int(got[py, px]) - (int(v * 255 + 0.5) if v > 0.03 else 0)) <= 1


def test_bell_kernel_and_order():
    a = raster.signal_of(AZ, 8, 0.5, 0.9, AMPS, 64)
    b = raster.signal_of(AZ, 8, 0.5, 0.9, dict(reversed(AMPS.items())), 64)
    assert (a == b).all() and a.max() == 255
    assert np.allclose(raster.bell(np.array([0.0, 1.0, 4.0, 9.0, 20.0])), [1, math.exp(-0.5), math.exp(-2), 0, 0], atol=1e-4)
    assert raster.signal_of([3.0], 4, 1.0, 1.0, {}, 16).max() == 0
    assert (raster.peaks_only(np.array([[1.0, 2, 2, 1, 0, 3]]), 1) == [[0, 2, 2, 0, 0, 3]]).all()
    with pytest.raises(ValueError):
        raster.Style(kernel="square")
    style, unknown = raster.style_of('{"splatKernel": "cell", "dbOffset": 2.5, "dbMin": -90}')
    assert style.kernel == "cell" and style.db_offset == 2.5 and unknown == ["dbMin"]
    assert raster.ramp_table()[[0, 255]].tolist() == [[0, 0, 0], [110, 0, 0]]


def test_filter():
    w = raster.window_of(np.array(AZ), 8, 0.5, 0.9)
    pose = fold.Pose(44.0, -63.0, 10.0, w)
    px, py = fold.source_pixels(pose, pose, 8)
    assert np.allclose(px[0], np.arange(8) + 0.5) and np.allclose(py[:, 0], np.arange(8) + 0.5)
    now, past = np.full((8, 8), 100, np.uint8), np.full((8, 8), 200, np.uint8)
    out = fold.blended(now, pose, past, pose, 0.25)
    assert (out[:7, :7] == 175).all() and (out[7] == 100).all()  # the last row has no past half a pixel on
    assert (fold.blended(now, pose, past, pose, 0.25, 0.0)[1:7, 1:7] == 175).all()
    far = fold.Pose(45.0, -63.0, 10.0, w)
    assert (fold.blended(now, far, past, pose, 0.25) == 100).all()
    assert fold.blended(now, pose, None, None, 0.25) is now


def test_filter_does_not_depend_on_partitions(spark):
    import pandas as pd

    rng = np.random.default_rng(1)
    w = raster.window_of(np.array(AZ), 8, 0.5, 0.9)
    rows = pd.DataFrame([{"stream": s, "t": t, "ping": t, "latitude": 44.0, "longitude": -63.0, "heading": float(t), "signal": rng.integers(0, 255, 64, dtype=np.uint8).tobytes(), "min_h": w.min_h, "span_h": w.span_h, "max_v": w.max_v, "span_v": w.span_v} for s in "ab" for t in range(6)])
    one = fold.filtered(spark.createDataFrame(rows), "weak").collect()
    two = fold.filtered(spark.createDataFrame(rows.sample(frac=1, random_state=2)).repartition(5), "weak").collect()
    assert {(r["stream"], r["t"]): bytes(r["signal"]) for r in one} == {(r["stream"], r["t"]): bytes(r["signal"]) for r in two}


def test_spread_and_regions(spark):
    rng = np.random.default_rng(3)
    pictures = [rng.random((13, 17)) < 0.3 for _ in range(20)]
    rows = [(k, int(y), int(x)) for k, m in enumerate(pictures) for y, x in zip(*np.nonzero(m), strict=True)]
    pixels = spark.createDataFrame(rows, "pair int, y int, x int")
    wide = {tuple(r) for r in regions.spread(pixels, ["pair"], 2).collect()}
    assert wide == {(k, y + dy, x + dx) for k, y, x in rows for dy in range(-2, 3) for dx in range(-2, 3) if abs(dx) <= round((4 - dy * dy) ** 0.5)}
    found = {(r["pair"], r["y"], r["x"]): r["region"] for r in regions.labelled(pixels, ["pair"]).collect()}
    assert len(found) == len(rows)
    left = set(found)
    seen = set()
    while left:
        start = left.pop()
        stack, group = [start], {start}
        while stack:
            k, y, x = stack.pop()
            near = {(k, y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & left
            left -= near
            group |= near
            stack += near
        assert len({found[p] for p in group}) == 1
        seen.add((start[0], found[start]))
        assert found[start] == min(y * regions.ROW + x for _, y, x in group)
    assert len(seen) == len({(k, r) for (k, _, _), r in found.items()})
    assert regions.labelled(pixels.limit(0), ["pair"]).count() == 0


def _sides(spark, target, render):
    rows = [("p", s, int(y), int(x), float(v[y, x]) / 255) for s, v in (("target", target), ("render", render)) for y, x in zip(*np.nonzero(v), strict=True)]
    pixels = spark.createDataFrame(rows, "pair string, side string, y int, x int, u double")
    mask = masks.matched(regions.labelled(masks.masked(pixels, 0.1, 0.9, 60, 60), masks.BY), masks.TOLERANCE)
    big, parts = masks.large(mask, masks.components(mask, [0.6]))
    return pixels, mask, parts, masks.footprints(big)


def test_matching(spark):
    image = np.zeros((60, 60), np.uint8)
    image[20:26, 20:26] = 128
    image[40:44, 30:36] = 200
    _, mask, parts, feet = _sides(spark, image, image)
    assert mask.where("side = 'target' and matched").count() == 60
    assert [r["delta_db"] for r in masks.deltas(parts, feet, [0.6]).collect()] == [0, 0]
    assert [(r["targets"], r["renders"]) for r in masks.clusters(feet).collect()] == [(1, 1), (1, 1)]
    pixels, mask, parts, feet = _sides(spark, image, np.zeros_like(image))
    assert mask.where("matched").isEmpty() and masks.clusters(feet).isEmpty()
    states = {r["band"]: r["silent"] for r in masks.unmatched_states(mask, pixels, [0.6], 0.1, 0.9).collect()}
    assert states == {0: 36, 1: 24}
    wide = np.zeros((60, 60), np.uint8)
    wide[20:26, 14:32] = 128
    two = np.zeros((60, 60), np.uint8)
    two[20:26, 14:20] = two[20:26, 26:32] = 128
    for target, render, want in ((two, wide, 0.5), (wide, two, 2.0)):
        assert masks.fragmentation(masks.clusters(_sides(spark, target, render)[3])).first()["fragmentation"] == want


def test_palette(spark):
    schema = "p int, idx int, r double, g double, b double"
    colors = [(0, 0, 255)] * 60 + [(0, 255, 0)] * 60 + [(255, 255, 0)] * 60 + [(255, 0, 0)] * 76
    rows = [(1, i, *map(float, c)) for i, c in enumerate(colors)] + [(2, i, 7.0, 7.0, 7.0) for i in range(256)]
    table = spark.createDataFrame(rows, schema)
    found = {}
    for r in palette.bands(table, ["p"], 0.1, 0.95).orderBy("p", "band").collect():
        found.setdefault(r["p"], []).append(r)
    assert [r["name"] for r in found[1]] == ["blue", "green", "yellow", "red"] and not found[1][0]["invertible"]
    assert [r["name"] for r in found[2]] == ["q1", "q2", "q3", "q4"]
    passed = {r["idx"] for r in table.where("p = 1").where(palette.gate(F.col("r"), F.col("g"), F.col("b"))).collect()}
    assert {100, 150, 250} <= passed and 0 not in passed
    ramp = spark.createDataFrame([(i, float(i), float(i), float(i)) for i in range(256)], "idx int, r double, g double, b double")
    points = spark.createDataFrame([(1, 10.0, 10.0, 10.0), (2, 255.0, 0.0, 0.0)], "k int, r double, g double, b double")
    assert {r["k"]: r["gray"] for r in palette.inverted(points, ramp).collect()} == {1: 10, 2: 0}
    with pytest.raises(ValueError):
        palette.nearest_color(points, spark.range(5000).selectExpr("id as idx", "1.0 as r", "1.0 as g", "1.0 as b"), ["r", "g", "b"])
    pure = spark.createDataFrame([(255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)], "r int, g int, b int")
    assert {tuple(r) for r in pure.select(*palette.hsv(F.col("r"), F.col("g"), F.col("b"))).collect()} == {(0, 255, 255), (60, 255, 255), (120, 255, 255), (0, 0, 0)}


def test_legend_bar(spark):
    screen = np.zeros((200, 400, 3), np.uint8)
    hues = np.linspace(0, 1, 200)
    screen[195:199, 50:250] = (np.stack([np.abs(hues * 6 - 3) - 1, 2 - np.abs(hues * 6 - 2), 2 - np.abs(hues * 6 - 4)], 1).clip(0, 1) * 255).astype(np.uint8)
    rows = [("a", 200, 400, screen.tobytes()), ("none", 100, 100, bytes(30_000))]
    out = palette.bars(spark.createDataFrame(rows, "path string, height int, width int, pixels binary")).orderBy("idx").collect()
    assert len(out) == 256 and {r["path"] for r in out} == {"a"}
    want = screen[196, 50:250].astype(int)
    for r in out:
        assert np.abs(np.array([r["r"], r["g"], r["b"]]) - want[round(r["idx"] * 199 / 255)]).max() < 20


def test_pictures_on_another_grid(spark):
    rng = np.random.default_rng(6)
    image = rng.integers(0, 2, (12, 18)) * rng.random((12, 18))
    rows = [(int(y), int(x), float(image[y, x])) for y, x in zip(*np.nonzero(image), strict=True)]
    out = np.zeros((4, 6))
    for r in regions.regridded(spark.createDataFrame(rows, "y int, x int, u double"), [], (12, 18), (4, 6)).collect():
        out[r["y"], r["x"]] = r["u"]
    assert np.allclose(out, image.reshape(4, 3, 6, 3).mean((1, 3)))
    data = rng.integers(0, 3, (5, 7), dtype=np.uint8)
    pixels = regions.pixel_rows(spark.createDataFrame([(1, data.tobytes())], "k int, d binary"), ["k"], "d", F.lit(7)).collect()
    assert {(r["y"], r["x"], r["c0"]) for r in pixels} == {(int(y), int(x), int(data[y, x])) for y, x in zip(*np.nonzero(data), strict=True)}


def test_ramp_goes_on_below_its_first_stop():
    table = raster.ramp_table([(0.5, 100, 0, 50), (0.75, 150, 50, 50), (1.0, 200, 100, 50)])
    assert table[0].tolist() == [0, 0, 50] and table[255].tolist() == [200, 100, 50]
    assert 40 <= table[64][0] <= 60


def test_metric_files(spark, tmp_path):
    sinks.write_metrics(spark.createDataFrame([("x", 1.5), ("y", None)], "name string, emd double"), str(tmp_path))
    assert spark.read.json(str(tmp_path / "metrics_json")).count() == spark.read.csv(str(tmp_path / "metrics_csv"), header=True).count() == 2


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"type": "binary", "path": "a.jpg", "timeCaptured": "2024-01-01T00:00:00Z", "componentName": "c0"}, {"type": "tabular", "path": "b.json", "timeCaptured": "2024-01-01T00:00:01.5Z", "resourceName": "f1"}, {"type": "binary", "path": "a.jpg", "timeCaptured": "2025-01-01T00:00:00Z", "componentName": "c1"}]')
    m = records.manifest(spark, str(tmp_path / "m.json"))
    assert {(r["path"], r["component"]) for r in m.collect()} == {("a.jpg", "c0"), ("b.json", None)}
    assert [r["path"] for r in frames.screens(m, ["c0", "c1"]).collect()] == ["a.jpg"]
    assert [(r["path"], r["t"] % 10_000_000) for r in frames.renders(m, ["f1"]).collect()] == [("b.png", 1_500_000)]


def test_detection(spark):
    image = np.full((60, 80, 3), 30, np.uint8)
    image[20:30, 20:40] = [250, 200, 10]
    out = detect.stripped(image, 60)
    assert (out[0, 0] == 0).all() and (out[25, 30] == image[25, 30]).all()
    assert detect.scaled(image, 60, 80).tolist() == image.tolist()
    rows = spark.createDataFrame([("a", 60, 80, image.tobytes()), ("a", 60, 80, image.tobytes()), ("b", 60, 80, b"bad")], "path string, height int, width int, pixels binary")

    def factory():
        return lambda p: (np.array([[0, 0, p.shape[1], p.shape[0] / 2], [1, 1, 2, 2]]), np.array([2.0, 7.0]), np.array([0.9, 0.6]))

    got = {r["path"]: r["detections"] for r in detect.detected(rows, factory, ["rock", "fish"], 30, 40, 0.6, soft=True).collect()}
    assert got["b"] is None
    assert [(d["class_name"], round(d["confidence"], 3), d["y_max"]) for d in got["a"]][0] == ("fish", 0.9, 0.5)
    assert got["a"][1]["class_name"] == "7"


def test_records_and_manifest(spark, tmp_path):
    import json

    readings = {"ping_number": 5, "latitude": 1.0, "longitude": 2.0, "heading_deg": 3.0, "n_beams": 4, "n_samples": 8, "range_per_sample": 0.5, "cos_tilt": 0.9, "az_sorted": AZ, "min_amp": -9000, "amps": AMPS}
    for name, n in (("a.json", 4), ("empty.json", 0)):
        (tmp_path / name).write_text(json.dumps({"resourceName": "fan_1", "timeCaptured": "2024-01-01T00:00:00.5Z", "payload": {"readings": readings | {"n_beams": n}}}))
    (tmp_path / "bad.json").write_text("{nope")
    good, bad = records.read_records(spark, str(tmp_path))
    pings = records.pings(good)
    assert pings.count() == 1 and bad.count() == 1
    assert sorted((r["beam"], r["sample"]) for r in records.cells(pings).collect()) == [(0, 3), (1, 5), (2, 2), (3, 7)]
    shown = raster.rendered(pings, 16).first()
    assert len(shown["signal"]) == 256 and max(shown["signal"]) > 0
    states = {r["id"]: r["state"] for r in records.unmatched(spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("b",), ("c",)], "id string")).collect()}
    assert states == {"a": "missing", "c": "unrequested"}


def test_png_reads_back(spark, tmp_path):
    gray = np.arange(64, dtype=np.uint8).reshape(8, 8)
    color = np.stack([gray, 255 - gray, gray], 2)
    (tmp_path / "g.png").write_bytes(sinks.png(gray))
    (tmp_path / "c.png").write_bytes(sinks.png(color))
    (tmp_path / "_debug.png").write_bytes(sinks.png(gray))
    got = {r["path"][-5:]: r for r in records.images(spark, str(tmp_path)).collect()}
    assert set(got) == {"g.png", "c.png"}
    assert bytes(got["c.png"]["pixels"]) == color.tobytes() and bytes(got["g.png"]["pixels"]) == np.repeat(gray[..., None], 3, 2).tobytes()


def _client(stream, start, end, closed):
    if end - start > timedelta(minutes=2):
        raise ranges.TooLarge
    out, t = [], datetime(2024, 1, 1)
    while t <= end:
        if start <= t < end or closed and t == end:
            out.append((stream, t.isoformat()))
        t += timedelta(minutes=1)
    return out


def test_time_range_source(spark, monkeypatch):
    import sys

    sys.modules["range_client"] = sys.modules[__name__]
    ranges.register(spark)
    reader = ranges._Reader({"client": "range_client:_client", "streams": "a,b", "start": "2024-01-01T00:00:00", "end": "2024-01-01T00:12:00"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == len(set(rows)) == 26
    with pytest.raises(ValueError):
        ranges.checked(datetime(2024, 1, 2), datetime(2024, 1, 1))
    with pytest.raises(ValueError):
        ranges.checked(datetime(2024, 1, 1), datetime(2024, 1, 9))


def test_sweeps(spark):
    g = sweep.grid(spark, {"a": [1, 2], "b": ["x"]})
    assert sorted(r["name"] for r in g.collect()) == ["a1_bx", "a2_bx"]
    assert sweep.grid(spark, {"a": [1, 2]}, spark.createDataFrame([("a1",)], "name string")).count() == 1
    runs = spark.createDataFrame([("p", 1.004, 2.0), ("q", 0.996, 1.0), ("r", 2.0, 0.1)], "name string, coverage double, emd double")
    assert [r["name"] for r in sweep.ranked(runs).collect()] == ["q", "p", "r"]
    frames = spark.createDataFrame([(i, i, i % 7, i % 5) for i in range(20)], "frame long, t long, misses int, phantoms int")
    assert {r["frame"]: r["label"] for r in sweep.worst_and_spread(frames).collect()}[6] == "miss"
