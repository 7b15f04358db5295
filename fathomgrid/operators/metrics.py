"""Distribution metrics: fixed-bin histograms, earth mover's distance, coverage, bands, shift sweeps, angular profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import gray_floor
from ..sources.shared import kept
from .quantiles import quantiles

BINS = 72
LEVELS = 256
N_THETA = 256


def bin_of(u: Column, low: float, high: float, bins: int = BINS) -> Column:
    """The 0-based bin of values within [low, high]; the last bin is closed. Null outside."""
    k = F.floor((u - low) * bins / (high - low)).cast("int")
    return F.when(u.between(low, high), F.least(k, F.lit(bins - 1)))


def histogram(df: DataFrame, by: list[str], value: Column, low: float, high: float, bins: int = BINS) -> DataFrame:
    """by, bin, n of all bins that hold values."""
    return df.select(*by, bin_of(value, low, high, bins).alias("bin")).where("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"))


def dense(hist: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """hist with a row for every bin of every group."""
    every = hist.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(hist, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def level_histogram(df: DataFrame, by: list[str], level: Column) -> DataFrame:
    """by, bin, n of all 256 levels."""
    return dense(df.select(*by, level.cast("int").alias("bin")).where("bin between 0 and 255").groupBy(*by, "bin").agg(F.count("*").alias("n")), by, LEVELS)


def emd(a: DataFrame, b: DataFrame, by: list[str], width: float) -> DataFrame:
    """by, emd: the sum over bins of the distance of both cumulated shares, times the bin width. Both sides are dense
    histograms (by, bin, n); NaN where a side has no mass."""
    joined = a.select(*by, "bin", F.col("n").alias("na")).join(b.select(*by, "bin", F.col("n").alias("nb")), [*by, "bin"], "full").fillna(0, ["na", "nb"])
    group = Window.partitionBy(*by)
    up = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = lambda k: F.sum(k).over(up) / F.nullif(F.sum(k).over(group), F.lit(0))
    gaps = joined.withColumn("gap", F.abs(share("na") - share("nb")))
    return gaps.groupBy(*by).agg((F.coalesce(F.sum("gap"), F.lit(math.nan)) * width).alias("emd"))


def weighted_mean(hist: DataFrame, by: list[str], low: float, width: float) -> DataFrame:
    """by, mean: of the bins' centres, weighted by n."""
    return hist.groupBy(*by).agg((F.sum((F.col("bin") + 0.5) * width * F.col("n")) / F.nullif(F.sum("n"), F.lit(0)) + low).alias("mean"))


def in_disk(x: Column, y: Column, height: float, width: float, rim: float = 0.97) -> Column:
    """Whether a pixel lies in the disk around the centre that reaches to `rim` of the shorter half side."""
    cy, cx, r = (height - 1) / 2, (width - 1) / 2, min(height, width) / 2 * rim
    return (y - cy) * (y - cy) + (x - cx) * (x - cx) <= r * r


def coverage(pixels: DataFrame, by: list[str], size: float, low: float, high: float, rim: float = 0.97) -> DataFrame:
    """by, disk_px, gate_px, coverage, fill: of pixels (x, y, u): those in the disk, those of them in the gate, the share,
    and the largest distance of a nonzero pixel from the centre by half the size."""
    half = (size - 1) / 2
    distance = F.sqrt((F.col("x") - half) * (F.col("x") - half) + (F.col("y") - half) * (F.col("y") - half)) / (size / 2)
    disk = in_disk(F.col("x"), F.col("y"), size, size, rim)
    gate = disk & F.col("u").between(low, high)
    out = pixels.groupBy(*by).agg(F.count_if(disk).alias("disk_px"), F.count_if(gate).alias("gate_px"), F.max(F.when(F.col("u") > 0, distance)).alias("fill"))
    return out.withColumn("coverage", F.col("gate_px") / F.nullif("disk_px", F.lit(0)))


def band_of(u: Column, edges: list[float]) -> Column:
    """How many inner edges a value has reached: 0 for the first band."""
    return sum((F.when(u >= e, 1).otherwise(0) for e in edges), F.lit(0))


def band_quantiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, p25, p50, p75, p90: exact, interpolated; a group's values are never in one task."""
    return quantiles(df, by, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})


def shift_sweep(a: DataFrame, b: DataFrame, shifts: list[int]) -> DataFrame:
    """shift, emd (in levels), log_ratio: b's level histogram moved by each shift against a's (dense; columns bin, n).
    Mass that leaves the levels is lost; log_ratio is the distance of the logarithm of both masses' ratio from 0."""
    moved = b.withColumn("shift", F.explode(F.array(*map(F.lit, shifts)))).select("shift", (F.col("bin") + F.col("shift")).alias("bin"), "n").where(F.col("bin").between(0, LEVELS - 1))
    both = a.withColumn("shift", F.explode(F.array(*map(F.lit, shifts)))).select("shift", "bin", F.col("n").alias("na")).join(moved.withColumnRenamed("n", "nb"), ["shift", "bin"], "left").fillna(0, ["nb"])
    distance = emd(both.select("shift", "bin", F.col("na").alias("n")), both.select("shift", "bin", F.col("nb").alias("n")), ["shift"], 1.0)
    mass = both.where("bin > 0").groupBy("shift").agg(F.abs(F.log(F.nullif(F.sum("nb"), F.lit(0)) / F.nullif(F.sum("na"), F.lit(0)))).alias("log_ratio"))
    return distance.join(mass, "shift")


def angular_profile(pixels: DataFrame, by: list[str], cx: float, cy: float, bins: int = N_THETA) -> DataFrame:
    """by, bin, mass: sums of u by angle, clockwise from up, of pixels (x, y, u)."""
    theta = F.atan2(F.col("x") - cx, -(F.col("y") - cy))
    k = (F.floor((theta + math.pi) / (2 * math.pi) * bins) % bins).cast("int")
    return pixels.select(*by, k.alias("bin"), "u").groupBy(*by, "bin").agg(F.sum("u").alias("mass"))


def enough(pixels: DataFrame, by: list[str], least: int = 200) -> DataFrame:
    """by of the groups of at least so many pixels."""
    return pixels.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(*by)


def circular_peaks(a: DataFrame, b: DataFrame, by: list[str], bins: int = N_THETA) -> DataFrame:
    """by, offset_deg, peak: the turn of b's profile (by, bin, mass) that fits a's best, clockwise in (-180, 180], and the
    normalised correlation there; the least turn of equals to nine places. Profiles may lack empty bins; without variance
    on a side offset_deg is null and peak 0.

    All pairs of a group's bins meet, a fixed number; a turn's products are summed as they come."""

    def centred(profile: DataFrame, name: str) -> DataFrame:
        full = dense(profile.select(*by, "bin", F.col("mass").alias("n")), by, bins)
        return full.select(*by, F.col("bin").alias(f"bin_{name}"), (F.col("n") - F.avg("n").over(Window.partitionBy(*by))).alias(name))

    x, y = centred(a, "x"), centred(b, "y")
    norms = x.groupBy(*by).agg(F.sum(F.col("x") * F.col("x")).alias("xx")).join(y.groupBy(*by).agg(F.sum(F.col("y") * F.col("y")).alias("yy")), by)
    turn = F.pmod(F.col("bin_x") - F.col("bin_y"), F.lit(bins))
    sums = x.join(y, by).groupBy(*by, turn.alias("turn")).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    scale = F.sqrt(F.col("xx") * F.col("yy"))
    rated = sums.join(norms, by).select(*by, "turn", F.when(scale > 0, F.round(F.col("xy") / scale, 9)).alias("c"))
    best = rated.groupBy(*by).agg(F.max_by("turn", F.struct("c", -F.col("turn"))).alias("turn"), F.max("c").alias("c"))
    degrees = F.when(F.col("turn") <= bins // 2, F.col("turn")).otherwise(F.col("turn") - bins) * (360.0 / bins)
    return best.select(*by, F.when(F.col("c").isNotNull(), degrees).alias("offset_deg"), F.coalesce("c", F.lit(0.0)).alias("peak"))


def over_cutoffs(pixels: DataFrame, by: list[str], cutoffs: list[float]) -> DataFrame:
    """by, cutoff (dB), kept_px, mass: of pixels (gray), those at a cutoff's gray value and over, and their sum, for each."""
    table = F.array(*(F.struct(F.lit(float(c)).alias("cutoff"), F.lit(gray_floor(c)).alias("least")) for c in cutoffs))
    rows = pixels.select(*by, "gray", F.explode(table).alias("c"))
    kept = F.col("gray") >= F.col("c.least")
    return rows.groupBy(*by, F.col("c.cutoff").alias("cutoff")).agg(F.count_if(kept).alias("kept_px"), F.coalesce(F.sum(F.when(kept, F.col("gray"))), F.lit(0)).alias("mass"))


def radial_peaks(cells: DataFrame, by: list[str], window: int, value: str = "v", sample: str = "s") -> DataFrame:
    """The cells that no cell within `window` samples on the same beam exceeds; equal neighbours all stay."""
    near = Window.partitionBy(*by).orderBy(sample).rangeBetween(-window, window)
    return cells.withColumn("__top", F.max(value).over(near)).where(F.col(value) >= F.col("__top")).drop("__top")


def correlated(df: DataFrame, x: str, y: str, peak: str) -> DataFrame:
    """n, median_offset, offset_std, corr: of rows whose peak is at least the median's, the correlation of x and y (null for
    two rows or fewer)."""
    middle = quantiles(df, [], peak, {"m": 0.5}).select("m").crossJoin(quantiles(df, [], y, {"median_offset": 0.5}).select("median_offset")).crossJoin(df.agg(F.stddev_pop(y).alias("offset_std")))
    middle = kept(middle, "middle")
    good = df.crossJoin(F.broadcast(middle.select("m"))).where(F.col(peak) >= F.col("m")).agg(F.count("*").alias("n"), F.corr(x, y).alias("c"))
    return good.crossJoin(F.broadcast(middle)).select("n", "median_offset", "offset_std", F.when(F.col("n") > 2, F.col("c")).alias("corr"))
