"""Ordered folds over streams of readings, as batch jobs and with Structured Streaming.

A scalar exponential fold can be cut into time buckets, as a bucket maps what comes in linearly to what goes out: buckets
are folded in parallel from zero, then one row for each bucket is chained, then buckets are folded again from their true
beginning. The streaming form holds rows until the watermark, so that it
gives the same results whatever the order in which rows come in time (see `ordered`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered

HOUR = 3_600_000_000


def smoothed(rows: DataFrame, share: float, bucket: int = HOUR) -> DataFrame:
    """rows (stream, t, id, x) with y: share * x + (1 - share) * the y before in the stream's order of (t, id); the first
    y is x. Rows without x leave y as it is."""
    rows = rows.withColumn("bucket", F.floor(F.col("t") / F.lit(bucket)).cast("long"))
    kept = rows.where("x is not null")
    # of a bucket: the factor of what comes in, and what it adds; rows in order from last to first
    parts = kept.groupBy("stream", "bucket").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("t", "id", "x"))).alias("rows"))
    added = F.aggregate("rows", F.lit(0.0), lambda y, r: F.lit(share) * r["x"] + F.lit(1 - share) * y)
    parts = parts.select("stream", "bucket", "n", added.alias("added"), F.get("rows", F.lit(0))["x"].alias("first"))

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group, y, out = group.sort_values("bucket"), None, []
        for r in group.itertuples():
            y = r.first if y is None else y
            out.append(y)
            y = r.added + (1 - share) ** r.n * y
        return group[["stream", "bucket"]].assign(start=out)

    kind = rows.schema["stream"].dataType.simpleString()
    starts = parts.groupBy("stream").applyInPandas(chain, f"stream {kind}, bucket long, start double")
    names = [f.name for f in rows.schema if f.name != "bucket"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "bucket") + ", y double"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, y = None, None
        for batch in batches:
            out = []
            for stream, number, start, x in zip(batch["stream"], batch["bucket"], batch["start"], batch["x"], strict=True):
                if (stream, number) != place:
                    place, y = (stream, number), start
                y = share * x + (1 - share) * y
                out.append(y)
            yield batch[names].assign(y=out)

    dealt = kept.join(starts, ["stream", "bucket"]).repartition("stream", "bucket").sortWithinPartitions("stream", "bucket", "t", "id")
    return dealt.mapInPandas(fold, schema)


def smoothed_stream(rows: DataFrame, share: float, late: str = "10 minutes", initial: DataFrame | None = None, slot: int = ordered.SLOT) -> DataFrame:
    """A streaming DataFrame's rows (stream string, t long, id long, x double) with y, in order of time, once the watermark has
    passed them. initial: the last rows of a fold to go on from (stream, t, id, y). Needs the RocksDB state store."""
    return ordered.folded_stream(rows, ordered.Smooth(share), "y double", late, initial, slot)


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def tumbling(rows: DataFrame, ts: str, width: str, late: str, by: list[str]) -> DataFrame:
    """by, start, n, mean of x in windows of event time; late rows are waited for. Works on streams and tables."""
    marked = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return marked.groupBy(*by, F.window(ts, width)).agg(F.count("*").alias("n"), F.avg("x").alias("mean")).select(*by, F.col("window.start").alias("start"), "n", "mean")
