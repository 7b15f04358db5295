"""Sinks: pictures as PNG, reports as CSV and JSON, playback documents."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit picture, gray (h x w) or colour (h x w x 3 or 4), as PNG."""
    h, w = pixels.shape[:2]
    kind = 0 if pixels.ndim == 2 else {3: 2, 4: 6}[pixels.shape[2]]

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    rows = np.pad(np.ascontiguousarray(pixels, np.uint8).reshape(h, -1), ((0, 0), (1, 0)))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def with_png(pictures: DataFrame, signal: str = "signal", ramp: list | None = None) -> DataFrame:
    """pictures with signal_png and color_png of a square signal column."""
    from ..operators.raster import ramp_table

    table = ramp_table(ramp)

    @F.pandas_udf("struct<signal_png: binary, color_png: binary>")
    def encode(data: pd.Series) -> pd.DataFrame:
        out = []
        for d in data:
            p = np.frombuffer(d, np.uint8)
            p = p.reshape(int(len(p) ** 0.5), -1)
            out.append((png(p), png(table[p])))
        return pd.DataFrame(out, columns=["signal_png", "color_png"])

    return pictures.withColumn("__png", encode(signal)).select("*", "__png.*").drop("__png")


def counts_rows(report: DataFrame, streams: list[str]) -> DataFrame:
    """A report's columns in the order of its CSV, deltas with three places, nothing where a fan is absent."""
    delta = lambda s: F.when(F.col(f"{s}_delta_s").isNotNull(), F.format_string("%.3f", F.col(f"{s}_delta_s"))).alias(f"{s}_delta_s")
    return report.select("group_index", "screen_id", "screen_count", *(x for s in streams for x in (F.col(f"{s}_count"), delta(s))), "fan_sum")


def write_counts(report: DataFrame, streams: list[str], path: str) -> bool:
    """CSV and JSON of a report, unless it has no group. Whether it was written."""
    if report.isEmpty():
        return False
    counts_rows(report, streams).write.mode("overwrite").csv(f"{path}/counts_csv", header=True, emptyValue="")
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/counts_json")
    return True


def write_metrics(metrics: DataFrame, path: str) -> None:
    """CSV and JSON of a table of metrics."""
    metrics.write.mode("overwrite").csv(f"{path}/metrics_csv", header=True, emptyValue="")
    metrics.write.mode("overwrite").json(f"{path}/metrics_json")


def playback(readings: DataFrame, images: DataFrame, sonar: DataFrame) -> DataFrame:
    """One row for each entry of a playback document: kind, ts, and its JSON; documents are written in order of kind and ts
    by the reader's choice of partitions, so that no task gathers all pictures."""
    entry = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("ts"), F.to_json(F.struct("*")).alias("entry"))
    return entry(readings, "readings").union(entry(images, "images")).union(entry(sonar, "sonarFrames"))


def data_url(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(data))
