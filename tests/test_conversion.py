"""Scan conversion as a relation against the kernels that draw single pictures."""

import numpy as np
import pytest

from fathomgrid.operators import conversion, raster

FANS = {
    "fan": ([-15.0, -5.0, 5.0, 15.0], 8),
    "ring": ([-170.0, -100.0, -30.0, 40.0, 110.0, 165.0], 10),
    "one beam": ([3.0], 6),
}


@pytest.mark.parametrize("kernel", ["bilinear", "cell"])
def test_relation_equals_kernels(spark, kernel):
    rng, size = np.random.default_rng(2), 40
    pings, cells, want = [], [], {}
    for k, (name, (az, samples)) in enumerate(FANS.items()):
        pings.append((name, az, samples, 0.5, 0.9))
        for frame in (k, 10 + k):
            amps = {f"{b}_{s}": float(rng.uniform(-8400, -5300)) for b in range(len(az)) for s in range(samples) if rng.random() < 0.5}
            b, s, v = raster.cells_of(amps, len(az), samples, 0.0)
            cells += [(frame, name, int(x), int(y), float(z)) for x, y, z in zip(b, s, v, strict=True)] + [(frame, name, 99, 0, 1.0), (frame, name, 0, 99, 1.0), (frame, name, 0, 0, None), (frame, name, 0, 0, 0.0)]
            want[frame] = raster.signal_of(az, samples, 0.5, 0.9, amps, size, raster.Style(kernel=kernel))
    geo = conversion.geometries(spark.createDataFrame(pings * 2, "fan string, beams array<double>, samples int, per_sample double, cos_tilt double"), "fan")
    assert geo.count() == 3
    rows = spark.createDataFrame(cells, "frame int, fan string, beam int, sample int, v double").repartition(3)
    maps = (conversion.taps if kernel == "bilinear" else conversion.sectors)(geo, "fan", size)
    out = conversion.converted(rows, maps, ["frame"], "fan", kernel == "cell")
    found = {frame: np.zeros((size, size), int) for frame in want}
    for r in out.select("frame", "py", "px", conversion.gray(out["value"], 0.03).alias("gray")).collect():
        found[r["frame"]][r["py"], r["px"]] = r["gray"]
    for frame, picture in want.items():
        off = np.abs(found[frame] - picture.astype(int))
        assert picture.max() > 0 and off.max() <= 1 or (off > 1).mean() < 0.005, (frame, (off > 1).sum())  # borders of sectors may round to either side
    assert conversion.converted(rows.limit(0), maps, ["frame"], "fan").count() == 0
