"""Background colours of many pictures at once: seeded k-means as grouped rounds over colour counts, and stripping.

A picture is its distinct colours with their numbers of pixels. Pictures of up to SMALL colours are dealt out sorted, and a
task takes one after the other through all of its rounds. Larger ones go through a round together: each colour finds the nearest
of its group's k centres, an array that is joined to it, and grouped sums make the next centres; groups whose centres stay the
same leave the rounds. First centres are drawn by hashed exponential races, which give the odds of k-means++ and the same draws
whatever the partitions and on both ways.

Defined cases: ties between centres go to the first; a centre without colours stays where it is; with fewer colours than
centres some centres coincide. Of equally good starts the first is taken, of equally large clusters the first. A picture
without a whole colour has no background. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType, StructField, StructType

from ..sources.shared import kept
from .grouped import whole_groups

CLUSTERS, ROUNDS, STARTS = 5, 50, 4
RGB = ("r", "g", "b")
#: Colours up to which a picture is held by one task.
SMALL = 1 << 16
_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def color_counts(pixels: DataFrame, by: str) -> DataFrame:
    """by, r, g, b, n: distinct colours of pixel rows (by, r, g, b) with a whole colour."""
    return pixels.where("r is not null and g is not null and b is not null").groupBy(by, *RGB).agg(F.count("*").alias("n"))


def _distance(center: Column) -> Column:
    return sum(((F.col(c) - center[c]) * (F.col(c) - center[c]) for c in RGB), F.lit(0.0))


def _race(weight: Column, *more: Column) -> Column:
    """The least of these is a row drawn with odds in proportion to weight; rows without weight come last."""
    u = (F.pmod(F.xxhash64(*more, *RGB), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40) + 2)
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(1e300) - F.log(u))


def first_centers(counts: DataFrame, by: str, k: int = CLUSTERS, starts: int = STARTS, seed: int = 0) -> DataFrame:
    """by, start, centers (array of k colours) of counts (by, r, g, b, n): each centre is drawn by number of pixels times the
    squared distance from those before."""
    rows = counts.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    color = F.struct(*(F.col(c).cast("double").alias(c) for c in RGB))
    drawn = lambda weight, j: F.min_by(color, F.struct(_race(weight, F.lit(seed), F.col(by), F.col("start"), F.lit(j)), color)).alias("next")
    centers = kept(rows.groupBy(by, "start").agg(drawn(F.col("n"), 0)).select(by, "start", F.array("next").alias("centers")), "centers")
    for j in range(1, k):
        near = rows.join(centers, [by, "start"]).withColumn("d2", F.array_min(F.transform("centers", _distance)))
        more = near.groupBy(by, "start").agg(drawn(F.col("n") * F.col("d2"), j))
        centers = kept(centers.join(more, [by, "start"]).select(by, "start", F.concat("centers", F.array("next")).alias("centers")), "centers")
    return centers


def _assigned(rows: DataFrame, centers: DataFrame, by: str) -> DataFrame:
    """rows (by, r, g, b, n) of each start with own, the place of the nearest centre, and d2."""
    near = rows.join(centers, by).withColumn("distances", F.transform("centers", _distance))
    return near.withColumn("d2", F.array_min("distances")).withColumn("own", (F.array_position("distances", F.col("d2")) - 1).cast("int")).drop("distances")


def settled(counts: DataFrame, centers: DataFrame, by: str, rounds: int = ROUNDS) -> DataFrame:
    """by, start, centers after at most so many rounds: each centre is the mean of the pixels that are nearest to it."""
    done = centers.limit(0)
    for _ in range(rounds):
        own = _assigned(counts, centers, by).groupBy(by, "start", "own").agg(F.sum("n").alias("m"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in RGB))
        means = own.groupBy(by, "start").agg(F.map_from_entries(F.collect_list(F.struct("own", F.struct(*((F.col(c) / F.col("m")).alias(c) for c in RGB))))).alias("means"))  # k at most
        moved = F.transform("centers", lambda x, i: F.coalesce(F.element_at("means", i), x))
        after = kept(centers.join(means, [by, "start"]).select(by, "start", F.col("centers").alias("before"), moved.alias("centers")), "centers")
        done = done.union(after.where(F.col("before") == F.col("centers")).select(by, "start", "centers"))
        centers = after.where(F.col("before") != F.col("centers")).select(by, "start", "centers")
        if centers.isEmpty():
            return done
    return done.union(centers)


def _by_rounds(counts: DataFrame, by: str, k: int, starts: int, rounds: int, seed: int) -> DataFrame:
    """The backgrounds of pictures of any size."""
    centers = kept(settled(counts, first_centers(counts, by, k, starts, seed), by, rounds), "centers")
    own = _assigned(counts, centers, by).groupBy(by, "start", "own").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("d2")).alias("cost"))
    best = own.groupBy(by, "start").agg(F.round(F.sum("cost"), 6).alias("cost"), F.max_by("own", F.struct("m", -F.col("own"))).alias("own"))
    best = best.groupBy(by).agg(F.min_by(F.struct("start", "own"), F.struct("cost", "start")).alias("best")).select(by, "best.*")
    return best.join(centers, [by, "start"]).select(by, F.get("centers", F.col("own")).alias("c")).select(by, *(F.col(f"c.{c}").alias(c) for c in RGB))


def _hashed(seed: np.ndarray, values: np.ndarray) -> np.ndarray:
    """xxhash64 of numbers as the function of that name goes on from the columns before (`seed`)."""
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    if values.dtype.kind == "f":
        values = (values + 0).view(np.int32 if values.itemsize == 4 else np.int64)
    if values.itemsize == 8:
        h = seed + _P[4] + np.uint64(8) ^ turned(values.view(np.uint64) * _P[1], 31) * _P[0]
        h = turned(h, 27) * _P[0] + _P[3]
    else:
        h = seed + _P[4] + np.uint64(4) ^ values.astype(np.int32).view(np.uint32).astype(np.uint64) * _P[0]
        h = turned(h, 23) * _P[1] + _P[2]
    h = (h ^ h >> np.uint64(33)) * _P[1]
    h = (h ^ h >> np.uint64(29)) * _P[2]
    return h ^ h >> np.uint64(32)


def _background(key: np.uint64, colors: list[np.ndarray], n: np.ndarray, k: int, starts: int, rounds: int) -> np.ndarray:
    """The background of one picture of sorted colours; key is the hash of the seed and the picture."""
    points = np.array(colors, np.float64)

    def far(centers: np.ndarray) -> np.ndarray:
        """The squared distance of each centre (a row) from each colour."""
        out = np.zeros((len(centers), len(n)))
        for p, c in zip(points, centers.T, strict=True):
            d = p - c[:, None]
            d *= d
            out += d
        return out

    first = _hashed(np.full(starts, key), np.arange(starts, dtype=np.int32))
    centers, d2 = np.empty((starts, k, 3)), np.ones((starts, 1))
    for j in range(k):
        h = _hashed(first, np.full(starts, j, np.int32))[:, None]
        for c in colors:
            h = _hashed(h, c[None])
        race = -np.log(((h & np.uint64((1 << 40) - 1)) + np.uint64(1)) / float((1 << 40) + 2))
        weight = n * d2
        race = np.where(weight > 0, race / np.where(weight > 0, weight, 1), 1e300)
        centers[:, j] = points.T[race.argmin(1)]
        d2 = far(centers[:, j]) if j == 0 else np.minimum(d2, far(centers[:, j]))

    def assigned(centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of the nearest centre, the squared distances, and the sums of each centre's pixels and their colours."""
        d2 = far(centers.reshape(-1, 3)).reshape(len(centers), k, -1)
        own = d2.argmin(1)
        return own, d2, (own[:, None] == places).astype(np.float64) @ mass

    active, places, mass = np.arange(starts), np.arange(k)[:, None], np.vstack([n, points * n]).T
    for _ in range(rounds):
        before = centers[active]
        total = assigned(before)[2]
        m = total[..., :1]
        after = np.where(m > 0, total[..., 1:] / np.maximum(m, 1), before)
        centers[active] = after
        active = active[(after != before).any((1, 2))]
        if not len(active):
            break
    own, d2, total = assigned(centers)
    best = np.round((n * d2.min(1)).sum(1), 6).argmin()
    return centers[best, total[best, :, 0].argmax()]


def _by_tasks(counts: DataFrame, by: str, k: int, starts: int, rounds: int, seed: int) -> DataFrame:
    """The backgrounds of pictures whose colours a task can hold. No more than a batch and a picture is held."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in whole_groups(batches, 1):
            key, *colors, n = (c.to_numpy() for c in rows.columns[1:])
            cuts = [*begins.tolist(), rows.num_rows]
            found = np.array([_background(key[a].astype(np.uint64), [c[a:b] for c in colors], n[a:b].astype(np.float64), k, starts, rounds) for a, b in pairwise(cuts)])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(begins)), *(pa.array(found[:, i]) for i in range(3))], names=[by, *RGB])

    rows = counts.select(by, F.xxhash64(F.lit(seed), F.col(by)).alias("__key"), *RGB, "n").repartition(by).sortWithinPartitions(by, *RGB)
    return rows.mapInArrow(settle, StructType([counts.schema[by], *(StructField(c, DoubleType()) for c in RGB)]))


def backgrounds(counts: DataFrame, by: str, k: int = CLUSTERS, starts: int = STARTS, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """by, r, g, b: of each picture the centre of the cluster with the most pixels, at the best of the starts."""
    counts = kept(counts.where(F.col(by).isNotNull()), "colors")
    if not all(isinstance(counts.schema[c].dataType, (IntegralType, FloatType, DoubleType)) for c in RGB):
        return _by_rounds(counts, by, k, starts, rounds, seed)
    large = kept(counts.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select(by), "large")
    if large.isEmpty():
        return _by_tasks(counts, by, k, starts, rounds, seed)
    few, many = (kept(counts.join(large, by, how), "colors") for how in ("left_anti", "left_semi"))
    return _by_tasks(few, by, k, starts, rounds, seed).union(_by_rounds(many, by, k, starts, rounds, seed))


def stripped(pixels: DataFrame, backgrounds: DataFrame, by: str, distance: float) -> DataFrame:
    """pixels (by, ..., r, g, b) in black where their colour is within `distance` of their picture's background (by, r, g, b);
    pictures without one stay as they are."""
    back = backgrounds.select(by, *(F.col(c).alias(f"__{c}") for c in RGB))
    joined = pixels.join(back, by, "left")
    near = F.coalesce(sum(((F.col(c) - F.col(f"__{c}")) * (F.col(c) - F.col(f"__{c}")) for c in RGB), F.lit(0.0)) <= distance * distance, F.lit(False))
    return joined.select(*(F.when(near, F.lit(0).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in RGB else F.col(f.name) for f in pixels.schema))
