"""Nearest-time alignment, ranks and differences along time, without a task that holds a whole stream.

Time is cut into buckets. What a bucket needs from others (the last row before it, the first after it, the rows before
it) is a table of one row for each stream and bucket; rows then meet in windows of one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def nearest(drivers: DataFrame, candidates: DataFrame, streams: list[str], tie: str = "later", tolerance: int | None = None, bucket: int = HOUR) -> DataFrame:
    """For each row of drivers and each of `streams`: driver (struct), stream, found (struct of the nearest candidate in
    time or null), gap (microseconds or null).

    drivers have t (microseconds); candidates have stream, t and id, which orders rows of equal time. Ties in distance go
    to the later or the earlier candidate; of candidates of equal time before the driver, `later` takes the last and
    `earlier` the first, after it both take the first. With `tolerance`, farther candidates count as none. Drivers without
    candidates stay; null times are nobody's neighbour.
    """
    return aligned(drivers, candidates, streams, tie, tolerance, bucket).select("driver", F.explode("met").alias("m")).select("driver", "m.*")


def aligned(drivers: DataFrame, candidates: DataFrame, streams: list[str], tie: str = "later", tolerance: int | None = None, bucket: int = HOUR) -> DataFrame:
    """driver, met (array of stream, found and gap, in the order of `streams`): what `nearest` finds, by driver."""
    number = F.floor(F.col("t") / F.lit(bucket)).cast("long")
    d = drivers.where("t is not null").select(F.struct("*").alias("driver"), "t", number.alias("bucket"))
    c = candidates.where(F.col("stream").isin(streams) & F.col("t").isNotNull())
    c = c.select("stream", "t", number.alias("bucket"), F.struct(*c.columns).alias("found"))
    ends = _ends(c, tie)
    places = ends.withColumn("wanted", F.lit(False)).unionByName(d.select("bucket").distinct().select("bucket", F.explode(F.array(*map(F.lit, streams))).alias("stream"), F.lit(True).alias("wanted")), allowMissingColumns=True)
    # both windows look back only: one that looks on to the end is computed anew for each row
    along = lambda *order: Window.partitionBy("stream").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carried = places.groupBy("stream", "bucket").agg(F.first("first", True).alias("first"), F.first("last", True).alias("last"), F.max("wanted").alias("wanted"))
    carried = carried.withColumn("before", F.last("last", True).over(along("bucket"))).withColumn("after", F.last("first", True).over(along(F.desc("bucket"))))
    carried = carried.where("wanted").select("stream", "bucket", F.explode(F.array("before", "after")).alias("found")).where("found is not null")
    rows = c.unionByName(carried.select("stream", F.col("found.t").alias("t"), "bucket", "found")).unionByName(d, allowMissingColumns=True)
    # all streams of a bucket lie in one window, so that a driver is there once; at equal times it comes before the candidates
    # on the way up and after them on the way down
    is_driver, at = F.col("driver").isNotNull(), F.col("found.id")
    up = Window.partitionBy("bucket").orderBy("t", F.desc(is_driver), at.desc() if tie == "earlier" else at.asc())
    down = Window.partitionBy("bucket").orderBy(F.desc("t"), is_driver, at.desc())
    latest = lambda w, s: F.last(F.when(F.col("stream") == s, F.col("found")), True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.select("driver", "t", *(latest(w, s).alias(f"{k}_{i}") for k, w in (("before", up), ("after", down)) for i, s in enumerate(streams))).where("driver is not null")

    def of(i: int) -> Column:
        before, after = F.col(f"before_{i}"), F.col(f"after_{i}")
        back, on = F.col("t") - before["t"], after["t"] - F.col("t")
        found = F.when(after.isNull() | F.coalesce(back <= on if tie == "earlier" else back < on, F.lit(False)), before).otherwise(after)
        gap = F.abs(F.col("t") - found["t"])
        near = F.lit(True) if tolerance is None else F.coalesce(gap <= tolerance, F.lit(False))
        return F.struct(F.lit(streams[i]).alias("stream"), F.when(near, found).alias("found"), F.when(near, gap).alias("gap"))

    return rows.select("driver", F.array(*map(of, range(len(streams)))).alias("met"))


def _ends(c: DataFrame, tie: str) -> DataFrame:
    """stream, bucket, first, last: the first and the last candidate of each bucket; of those of equal time the first by id, or
    the last one for `last` unless the tie goes to the earlier. Times are found first, as their extremes need no sort."""
    times = c.groupBy("stream", "bucket").agg(F.min("t").alias("__from"), F.max("t").alias("__to"))
    rows = c.join(times, ["stream", "bucket"]).where(F.col("t").isin(F.col("__from"), F.col("__to")))
    of, at = lambda k: F.when(F.col("t") == F.col(k), F.col("found")), F.col("found.id")
    first, last = F.when(of("__from").isNotNull(), at), F.when(of("__to").isNotNull(), at)
    return rows.groupBy("stream", "bucket").agg(F.min_by(of("__from"), first).alias("first"), (F.min_by if tie == "earlier" else F.max_by)(of("__to"), last).alias("last"))


def ranked(df: DataFrame, by: list[str], t: str = "t", then: str = "id", bucket: int = HOUR, name: str = "rank") -> DataFrame:
    """df with its 0-based rank by (t, then) among rows of equal `by` (which may be empty)."""
    number = F.floor(F.col(t) / F.lit(bucket)).cast("long")
    df = df.withColumn("__bucket", number)
    keys = by or [F.lit(0).alias("__all")]
    counts = df.groupBy(*keys, "__bucket").agg(F.count("*").alias("n"))
    along = Window.partitionBy(*(by or ["__all"])).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("__base", F.coalesce(F.sum("n").over(along), F.lit(0))).select(*by, "__bucket", "__base")
    inside = Window.partitionBy(*by, "__bucket").orderBy(t, then)
    return df.join(base, [*by, "__bucket"]).withColumn(name, F.row_number().over(inside) - 1 + F.col("__base")).drop("__bucket", "__base")


def since_previous(df: DataFrame, by: str, t: str = "t", bucket: int = HOUR) -> DataFrame:
    """df with `since`: t less that of the row before in the same `by`; null for the first."""
    number = F.floor(F.col(t) / F.lit(bucket)).cast("long")
    df = df.withColumn("__bucket", number)
    last = df.groupBy(by, "__bucket").agg(F.max(t).alias("__last"))
    before = last.withColumn("__before", F.lag("__last").over(Window.partitionBy(by).orderBy("__bucket"))).drop("__last")
    inside = Window.partitionBy(by, "__bucket").orderBy(t)
    return df.join(before, [by, "__bucket"]).withColumn("since", F.col(t) - F.coalesce(F.lag(t).over(inside), F.col("__before"))).drop("__bucket", "__before")


def late(gap: Column, interval: Column) -> Column:
    """Whether a gap is over one and a half times the usual interval."""
    return gap > interval * 1.5
