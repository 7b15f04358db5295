"""Scan conversion as a relation: the cells of sparse polar grids, joined with the pixels that they show in.

Where a pixel looks depends on a fan's geometry alone, and there are few of those: `taps` works out once for each geometry
which cells a pixel takes and with which weights, as rows. A picture is then an equi-join of cells with taps by geometry,
beam and sample, and sums (or the greatest) by pixel. Cells that aren't there count as zero by being absent; pixels without a
value have no row.

Defined cases: cells beyond a geometry's beams or samples show nowhere. Of a fan of over 300 degrees the last beam and the
first are neighbours across the seam. Nulls show nowhere. Several rows of one cell should be one before: they add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry

#: Degrees of a fan from which it is closed.
CLOSED = 300.0


def geometries(pings: DataFrame, by: str) -> DataFrame:
    """by, beams, samples, step (ground range of a sample), min_h, span_h, max_v, span_v: the distinct geometries of pings
    (by, beams, samples, per_sample, cos_tilt)."""
    step = F.col("per_sample") * F.col("cos_tilt")
    found = pings.select(by, "beams", "samples", step.alias("step"), geometry.extent(geometry.az_edges(F.col("beams")), F.col("samples") * step).alias("w")).distinct()
    return found.select(by, "beams", "samples", "step", "w.*")


def _pixels(geometries: DataFrame, size: int) -> DataFrame:
    """geometries with py, px and the polar place of each pixel: r, and a in degrees."""
    every = F.sequence(F.lit(0), F.lit(size - 1))
    rows = geometries.withColumn("py", F.explode(every)).withColumn("px", F.explode(every))
    lateral = F.col("min_h") + F.col("px") / size * F.col("span_h")
    forward = F.col("max_v") - F.col("py") / size * F.col("span_v")
    return rows.withColumns({"r": F.hypot(lateral, forward), "a": F.degrees(F.atan2(lateral, forward))})


def taps(geometries: DataFrame, by: str, size: int) -> DataFrame:
    """by, py, px, beam, sample, weight: the up to four cells between which a pixel lies, bilinear in beam and sample."""
    n, beam = F.size("beams"), lambda i: F.get("beams", i)
    first, last = beam(F.lit(0)), beam(n - 1)
    p = _pixels(geometries, size).withColumns({"at": F.col("r") / F.col("step") - 1, "a": first + F.pmod(F.col("a") - first, F.lit(360.0))})
    p = p.withColumn("seam", F.col("a") > last).where((F.col("at") >= 0) & (F.col("at") <= F.col("samples") - 1) & (~F.col("seam") | (last - first > CLOSED)))
    after = F.size(F.filter("beams", lambda x: x < F.col("a")))
    p = p.withColumns({"b0": F.when(F.col("seam"), n - 1).otherwise(F.greatest(after - 1, F.lit(0))), "b1": F.when(F.col("seam"), 0).otherwise(F.least(after, n - 1)), "s0": F.floor("at").cast("int")})
    gap = F.when(F.col("seam"), first + 360 - last).otherwise(beam(F.col("b1")) - beam(F.col("b0")))
    fb = F.when((gap > 0) & (F.col("b0") != F.col("b1")), (F.col("a") - beam(F.col("b0"))) / gap).otherwise(0.0)
    p = p.withColumns({"fb": fb, "fs": F.col("at") - F.col("s0"), "s1": F.least(F.col("s0") + 1, F.col("samples") - 1)})
    tap = lambda b, s, w: F.struct(F.col(b).alias("beam"), F.col(s).alias("sample"), w.alias("weight"))
    fb, fs = F.col("fb"), F.col("fs")
    four = F.array(tap("b0", "s0", (1 - fb) * (1 - fs)), tap("b0", "s1", (1 - fb) * fs), tap("b1", "s0", fb * (1 - fs)), tap("b1", "s1", fb * fs))
    return p.select(by, "py", "px", F.explode(four).alias("t")).select(by, "py", "px", "t.*").where("weight > 0")


def sectors(geometries: DataFrame, by: str, size: int) -> DataFrame:
    """by, py, px, beam, sample, weight (1): the cells in whose sector a pixel lies, half a sample around each range and up to
    the edges between beams."""
    p = _pixels(geometries, size).withColumns({"edges": geometry.az_edges(F.col("beams")), "sample": F.floor(F.col("r") / F.col("step") - 0.5).cast("int")})
    edge = lambda i: F.get("edges", i)

    def holds(i: Column) -> Column:
        low, high = F.least(edge(i), edge(i + 1)), F.greatest(edge(i), edge(i + 1))
        turned = F.col("a") - F.round((F.col("a") - (low + high) / 2) / 360) * 360
        return (turned >= low) & (turned < high)

    inside = p.where((F.col("sample") >= 0) & (F.col("sample") < F.col("samples")))
    beams = F.filter(F.sequence(F.lit(0), F.size("beams") - 1), holds)
    return inside.select(by, "py", "px", F.explode(beams).alias("beam"), "sample", F.lit(1.0).alias("weight"))


def converted(cells: DataFrame, taps: DataFrame, frame: list[str], by: str, most: bool = False) -> DataFrame:
    """frame, py, px, value of cells (frame, by, beam, sample, v) with v over zero: the weighted sums of taps, or the greatest."""
    shown = cells.where("v > 0").join(taps, [by, "beam", "sample"])
    part = F.col("v") * F.col("weight")
    return shown.groupBy(*frame, "py", "px").agg((F.max(part) if most else F.sum(part)).alias("value"))


def gray(value: Column, threshold: float = 0.0) -> Column:
    """The gray level of a value: 0 unless over the threshold."""
    return F.when(value > threshold, F.floor(F.least(value, F.lit(1.0)) * 255 + 0.5)).otherwise(0).cast("int")
