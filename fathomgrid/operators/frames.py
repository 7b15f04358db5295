"""Frames of screens and fans: collection from a manifest, groups by nearest time, counts, reports' rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros, seconds3, with_extension
from .asof import aligned, late, nearest, ranked, since_previous
from .quantiles import at_ranks


def screens(manifest: DataFrame, components: list[str], files: DataFrame | None = None) -> DataFrame:
    """path, t of the binary entries of the screen's components, of files that exist."""
    out = manifest.where((F.col("type") == "binary") & F.col("component").isin(components)).select("path", micros(F.to_timestamp("captured")).alias("t"))
    return out if files is None else out.join(files.select("path").distinct(), "path", "left_semi")


def renders(manifest: DataFrame, fans: list[str], files: DataFrame | None = None, ext: str = ".png") -> DataFrame:
    """stream, path, t of the tabular entries of the fans, with the path of their picture; those without a picture go."""
    out = manifest.where((F.col("type") == "tabular") & F.col("resource").isin(fans)).select(F.col("resource").alias("stream"), with_extension(F.col("path"), ext).alias("path"), micros(F.to_timestamp("captured")).alias("t"))
    return out if files is None else out.join(files.select("path").distinct(), "path", "left_semi")


def half_of(fan: Column) -> Column:
    """The half of the screen that shows a fan: left for a horizontal one that isn't among the third heads, else right."""
    return F.when(fan.startswith("horizontal-h") & ~fan.startswith("horizontal-h3"), "left").otherwise("right")


def beside(videos: DataFrame, screen: str) -> DataFrame:
    """screen, other: the screen's video with each other one (metadata only, one row for each video)."""
    return videos.where(F.col("video") != screen).select(F.lit(screen).alias("screen"), F.col("video").alias("other")).distinct()


def with_detections(frames: DataFrame, detected: DataFrame, *columns: str) -> DataFrame:
    """frames with the detections of their path, which many frames may share; null where a path has none. With `columns` these
    are joined instead: what is counted of detections is counted once for each path, so that no frame carries their array."""
    return frames.join(detected.select("path", *(columns or ["detections"])), "path", "left")


def first_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in that order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def groups(screen: DataFrame, fan: DataFrame, streams: list[str], tie: str = "later", tolerance: int | None = None) -> DataFrame:
    """screen_id, screen_t, screen_count, group_index, stream, found_id, found_count, delta_s: each screen frame (id, t, n)
    with each fan's nearest frame (stream, id, t, n)."""
    numbered = ranked(screen.select("id", "t", "n"), [], name="group_index")
    met = nearest(numbered, fan.select("stream", "id", "t", "n"), streams, tie, tolerance)
    return met.select(F.col("driver.id").alias("screen_id"), F.col("driver.t").alias("screen_t"), F.col("driver.n").alias("screen_count"), F.col("driver.group_index").alias("group_index"), "stream", F.col("found.id").alias("found_id"), F.col("found.n").alias("found_count"), seconds3(F.col("gap")).alias("delta_s"))


def report(found: DataFrame, streams: list[str]) -> DataFrame:
    """One row for each group: columns <stream>_count and <stream>_delta_s, and fan_sum over the fans that are there."""
    aggs = [F.max(F.when(F.col("stream") == s, F.col(c))).alias(f"{s}_{k}") for s in streams for c, k in (("found_count", "count"), ("delta_s", "delta_s"))]
    return found.groupBy("group_index", "screen_id", "screen_t", "screen_count").agg(*aggs, F.coalesce(F.sum("found_count"), F.lit(0)).alias("fan_sum"))


def reported(screen: DataFrame, fan: DataFrame, streams: list[str], tie: str = "later", tolerance: int | None = None) -> DataFrame:
    """The report of the groups of screen and fan frames; a group's fans come in one row, so that none are brought together again."""
    met = aligned(ranked(screen.select("id", "t", "n"), [], name="group_index"), fan.select("stream", "id", "t", "n"), streams, tie, tolerance)
    group = [F.col(f"driver.{c}").alias(name) for c, name in (("group_index", "group_index"), ("id", "screen_id"), ("t", "screen_t"), ("n", "screen_count"))]
    count = lambda i: F.col("met")[i]["found"]["n"]
    each = [c for i, s in enumerate(streams) for c in (count(i).alias(f"{s}_count"), seconds3(F.col("met")[i]["gap"]).alias(f"{s}_delta_s"))]
    return met.select(*group, *each, sum((F.coalesce(count(i), F.lit(0)) for i in range(len(streams))), F.lit(0).cast("long")).alias("fan_sum"))


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("groups"), F.coalesce(F.sum("screen_count"), F.lit(0)).alias("screen_total"), F.coalesce(F.sum("fan_sum"), F.lit(0)).alias("fan_total"))


def per_stream(fan: DataFrame, streams: list[str]) -> DataFrame:
    """stream, frames: every stream, also those without a frame."""
    names = fan.sparkSession.createDataFrame([(s,) for s in streams], "stream string")
    return F.broadcast(names).join(fan.groupBy("stream").agg(F.count("*").alias("frames")), "stream", "left").select("stream", F.coalesce("frames", F.lit(0)).alias("frames"))


def intervals(frames: DataFrame, by: str = "stream") -> DataFrame:
    """by, interval (microseconds): the upper median of the times between neighbouring frames; a second for one frame."""
    found = at_ranks(since_previous(frames, by), [by], "since", F.floor(F.col("n") / 2)).select(F.col(by).alias("__by"), "value")
    every = frames.select(by).distinct()
    return every.join(found, every[by].eqNullSafe(found["__by"]), "left").select(by, F.coalesce("value", F.lit(1_000_000)).cast("long").alias("interval"))


def skewed(found: DataFrame, interval: DataFrame) -> DataFrame:
    """found with skewed: whether its delta is over one and a half of the screen's usual interval (a table of one row)."""
    return found.crossJoin(F.broadcast(interval.select("interval"))).withColumn("skewed", F.coalesce(late(F.col("delta_s"), F.col("interval") / 1e6), F.lit(False))).drop("interval")
