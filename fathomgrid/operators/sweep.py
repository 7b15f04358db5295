"""Parameter sweeps: the grid of settings, and the ranking of their results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, values: dict[str, list], done: DataFrame | None = None) -> DataFrame:
    """One row for each choice of values, named by them; without those in done (name)."""
    tables = [spark.createDataFrame([(v,) for v in vs], [k]) for k, vs in values.items()]
    out = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), tables)
    out = out.withColumn("name", F.concat_ws("_", *(F.concat(F.lit(k), F.col(k).cast("string")) for k in values)))
    return out if done is None else out.join(done, "name", "left_anti")


def ranked(runs: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """runs (name, coverage, emd) with coverage rounded to two places (halves to even), best first: by the distance of the
    rounded coverage's logarithm from 0, then by emd. With `other` (name, ...), its columns where it has the name."""
    if other is not None:
        runs = runs.join(other, "name", "left")
    r = runs.withColumn("coverage", F.bround("coverage", 2))
    return r.orderBy(F.abs(F.log(F.nullif("coverage", F.lit(0)))).asc_nulls_last(), "emd", "name")


def by_match(runs: DataFrame) -> DataFrame:
    """runs (name, match_t, match_r) with their mean, best first."""
    return runs.withColumn("mean_match", (F.col("match_t") + F.col("match_r")) / 2).orderBy(F.desc("mean_match"), "name")


def worst_and_spread(frames: DataFrame, worst: int = 2, spread: int = 4) -> DataFrame:
    """frame, label: the frames of most misses and most phantoms (`worst` of each), and `spread` evenly spaced in time of the
    rest of the order; a frame has its first label. frames: frame, t, misses, phantoms."""
    miss = frames.orderBy(F.desc("misses"), "t").limit(worst).select("frame", F.lit("miss").alias("label"), F.lit(0).alias("k"))
    phantom = frames.orderBy(F.desc("phantoms"), "t").limit(worst).select("frame", F.lit("phantom").alias("label"), F.lit(1).alias("k"))
    n = frames.count()
    from .asof import ranked as ranks

    wanted = sorted({round(i * (n - 1) / max(1, spread - 1)) for i in range(spread)}) if n else []
    even = ranks(frames.withColumnRenamed("frame", "id"), []).where(F.col("rank").isin(wanted)).select(F.col("id").alias("frame"), F.lit("even").alias("label"), F.lit(2).alias("k"))
    return miss.union(phantom).union(even).groupBy("frame").agg(F.min_by("label", "k").alias("label"))
