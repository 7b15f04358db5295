"""The temporal filter: each ping of a stream is blended with the stream's filtered past, moved into the ping's window.

The fold is ordered and keeps one picture per stream. In batch, rows are dealt by stream and sorted by time within
partitions, and state is reset where the stream changes, so that no group is gathered in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.scalars import BLEND, METERS_PER_DEGREE, gray_floor
from .raster import Window, _round


@dataclass
class Pose:
    lat: float
    lon: float
    heading: float
    window: Window


def source_pixels(past: Pose, now: Pose, size: int, center: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel of `now` the column and row in `past`'s picture of the same place on the ground. Pixels are followed
    from their centre, though pictures are sampled at whole numbers; `center` 0 follows them from there."""
    lateral, forward = now.window.axes(size, center)
    y, x = np.meshgrid(lateral, forward)
    s, c = np.sin(np.radians(now.heading)), np.cos(np.radians(now.heading))
    east = x * s + y * c + (now.lon - past.lon) * METERS_PER_DEGREE * np.cos(np.radians((past.lat + now.lat) / 2))
    north = x * c - y * s + (now.lat - past.lat) * METERS_PER_DEGREE
    s, c = np.sin(np.radians(past.heading)), np.cos(np.radians(past.heading))
    y, x = east * c - north * s, east * s + north * c
    w = past.window
    return (y - w.min_h) / w.span_h * size, (w.max_v - x) / w.span_v * size


def sampled(picture: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear samples, and whether they lie in the picture."""
    top = len(picture) - 1
    inside = (px >= 0) & (py >= 0) & (px <= top) & (py <= top)
    px, py = np.where(inside, px, 0), np.where(inside, py, 0)
    x0, y0 = np.floor(px).astype(np.int64), np.floor(py).astype(np.int64)
    x1, y1 = np.minimum(x0 + 1, top), np.minimum(y0 + 1, top)
    p, fx, fy = picture.astype(np.float64), px - x0, py - y0
    upper = p[y0, x0] + (p[y0, x1] - p[y0, x0]) * fx
    lower = p[y1, x0] + (p[y1, x1] - p[y1, x0]) * fx
    return upper + (lower - upper) * fy, inside


def blended(now: np.ndarray, pose: Pose, past: np.ndarray | None, past_pose: Pose | None, share: float, center: float = 0.5) -> np.ndarray:
    """The filtered picture. Where the past has no data, the present stands for it."""
    if past is None or share >= 1:
        return now
    old, inside = sampled(past, *source_pixels(past_pose, pose, len(now), center))
    fresh = now.astype(np.float64)
    return _round(share * fresh + (1 - share) * np.where(inside, old, fresh)).astype(np.uint8)


def pose_of(row) -> Pose:
    return Pose(row.latitude, row.longitude, row.heading, Window(row.min_h, row.span_h, row.max_v, row.span_v))


def filtered(pictures: DataFrame, level: str = "medium", floor_db: float | None = None, center: float = 0.5) -> DataFrame:
    """pictures (stream, t, ping, latitude, longitude, heading, signal, window columns, and others) with the signal
    filtered along each stream's time. With floor_db, gray values under it are 0 in what is returned, not in the past."""
    share = BLEND.get(level.strip().lower(), 1.0)
    cut = 0 if floor_db is None else gray_floor(floor_db)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = past = past_pose = None
        for batch in batches:
            out = []
            for row in batch.itertuples():
                if row.stream != stream:
                    stream, past, past_pose = row.stream, None, None
                now, pose = np.frombuffer(row.signal, np.uint8), pose_of(row)
                now = now.reshape(int(len(now) ** 0.5), -1)
                past, past_pose = blended(now, pose, past, past_pose, share, center), pose
                out.append(np.where(past >= cut, past, 0).astype(np.uint8).tobytes())
            yield batch.assign(signal=out)

    return pictures.repartition("stream").sortWithinPartitions("stream", "t", "ping").mapInPandas(fold, pictures.schema)
