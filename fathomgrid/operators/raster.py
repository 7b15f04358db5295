"""Rendering of sparse polar grids to gray signal images, in Arrow batches of a few pings.

A ping row has beams (sorted azimuths in degrees), samples, per_sample, cos_tilt and cells (key `beam_sample` to
amplitude). Three kernels: `gauss` adds an anisotropic bell for each cell, `cell` fills the cell's polar sector with the
largest value, `bilinear` looks up each pixel's place in the polar grid. Cells with bad keys or outside the grid are
skipped by all kernels, and cells are taken in order, so that results don't depend on a map's order.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DB_MIN, DB_PER_COUNT, DB_SPAN

SIZE = 1024
KERNELS = ("gauss", "cell", "bilinear")
# The default colour ramp (position, red, green, blue).
RAMP = [(0.00, 0, 0, 0), (0.11, 0, 0, 200), (0.22, 0, 100, 255), (0.33, 0, 220, 220), (0.44, 0, 220, 80), (0.56, 170, 230, 0), (0.67, 255, 220, 0), (0.78, 255, 130, 0), (0.89, 230, 30, 0), (1.00, 110, 0, 0)]
#: Squared distance, in sigmas, from which the bell is cut off, and steps of its table.
BELL_END, BELL_STEPS = 9.0, 4096
COLOR_STEPS = 4096
_KEY = re.compile(r"[+-]?\d+_[+-]?\d+")


@dataclass(frozen=True)
class Style:
    """How a ping is drawn. The names of a preset's JSON fields are those of `PRESET`."""

    range_sigma: float = 1.5
    arc_sigma: float = 0.5
    threshold: float = 0.03
    kernel: str = "gauss"
    peak_window: int = 0
    db_offset: float = 0.0
    floor_db: float | None = None
    ramp: list[tuple[float, float, float, float]] = field(default_factory=lambda: RAMP)

    def __post_init__(self):
        if self.kernel not in KERNELS:
            raise ValueError(f"unknown kernel {self.kernel!r}: one of {', '.join(KERNELS)}")


# The fields of a preset file.
PRESET = {"heatmapRangeSigmaFactor": "range_sigma", "heatmapArcSigmaFactor": "arc_sigma", "heatmapMinThreshold": "threshold", "splatKernel": "kernel", "radialPeakWindow": "peak_window", "dbOffset": "db_offset", "signalFloorDB": "floor_db"}


def style_of(preset: str) -> tuple[Style, list[str]]:
    """The default style with a preset's JSON laid over it, and the fields that it has and nobody knows."""
    given = json.loads(preset)
    values = {PRESET[k]: v for k, v in given.items() if k in PRESET and not (k == "splatKernel" and not v)}
    stops = [(s["t"], s["r"], s["g"], s["b"]) for s in given.get("colorStops") or []]
    if len(stops) >= 2:
        values["ramp"] = stops
    return Style(**values), sorted(k for k in given if k not in PRESET and k != "colorStops")


def edges_of(az: np.ndarray) -> np.ndarray:
    if len(az) == 1:
        return np.array([az[0] - 1, az[0] + 1])
    half = np.diff(az) / 2
    return np.concatenate(([az[0] - half[0]], az[:-1] + half, [az[-1] + half[-1]]))


@dataclass
class Window:
    """What a picture shows: lateral from min_h over span_h, forward from max_v down over span_v."""

    min_h: float
    span_h: float
    max_v: float
    span_v: float

    def axes(self, size: int, shift: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Lateral by column, forward by row."""
        at = (np.arange(size) + shift) / size
        return self.min_h + at * self.span_h, self.max_v - at * self.span_v


def window_of(az: np.ndarray, samples: int, per_sample: float, cos_tilt: float) -> Window:
    a = np.radians(edges_of(az))
    reach = np.array([0.0, samples * per_sample])
    x, y = np.outer(reach, np.cos(a)) * cos_tilt, np.outer(reach, np.sin(a)) * cos_tilt
    span = lambda v: float(np.ptp(v)) if np.ptp(v) >= 1e-6 else 1.0
    return Window(float(y.min()), span(y), float(x.max()), span(x))


def cells_of(amps: dict[str, float], beams: int, samples: int, offset: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beams, samples and values in (0, 1] of the cells that show, in order."""
    found = []
    for key, v in amps.items():
        if v is None or not _KEY.fullmatch(key):
            continue
        b, s = map(int, key.split("_"))
        norm = (float(v) * DB_PER_COUNT + offset - DB_MIN) / DB_SPAN
        if 0 <= b < beams and 0 <= s < samples and norm > 0:
            found.append((b, s, min(norm, 1.0)))
    b, s, v = zip(*sorted(found), strict=True) if found else ((), (), ())
    return np.array(b, np.int64), np.array(s, np.int64), np.array(v, np.float64)


_BELL = np.exp(-np.arange(BELL_STEPS + 1) / BELL_STEPS * BELL_END / 2)


def bell(d2: np.ndarray) -> np.ndarray:
    at = np.minimum(d2, BELL_END) * (BELL_STEPS / BELL_END)
    i = np.minimum(at.astype(np.int64), BELL_STEPS - 1)
    return np.where(d2 >= BELL_END, 0.0, _BELL[i] + (at - i) * (_BELL[i + 1] - _BELL[i]))


def _round(x):
    """Halves away from zero, for values from 0 on."""
    return np.floor(x + 0.5)


def _bells(heat, cells, az, edges, window, size, rps, cos_tilt, style) -> None:
    mh, mv = window.span_h / size, window.span_v / size
    width = rps * cos_tilt
    for b, s, v in zip(*cells, strict=True):
        a = math.radians(az[b])
        sin, cos = math.sin(a), math.cos(a)
        r = (s + 1) * rps * cos_tilt
        sr = width * style.range_sigma
        sa = max(r * math.radians(abs(edges[b + 1] - edges[b])), width) * style.arc_sigma
        radius = math.ceil(3 * max(sr, sa) / min(mh, mv))
        ix = int(math.floor((r * sin - window.min_h) / window.span_h * size + 0.5))
        iy = int(math.floor((window.max_v - r * cos) / window.span_v * size + 0.5))
        x0, x1, y0, y1 = max(ix - radius, 0), min(ix + radius, size - 1), max(iy - radius, 0), min(iy + radius, size - 1)
        if x0 > x1 or y0 > y1:
            continue
        dx, dy = np.arange(x0, x1 + 1)[None, :] - ix, np.arange(y0, y1 + 1)[:, None] - iy
        along, across = (dx * (mh * sin) - dy * (mv * cos)) / sr, (dx * (mh * cos) + dy * (mv * sin)) / sa
        heat[y0 : y1 + 1, x0 : x1 + 1] += v * bell(along * along + across * across)


def _sectors(heat, cells, edges, window, size, rps, cos_tilt) -> None:
    lateral, forward = window.axes(size)
    for b, s, v in zip(*cells, strict=True):
        r0, r1 = (s + 0.5) * rps * cos_tilt, (s + 1.5) * rps * cos_tilt
        a0, a1 = sorted((edges[b], edges[b + 1]))
        a = np.radians([a0, a1])
        px = (np.outer([r0, r1], np.sin(a)) - window.min_h) / window.span_h * size
        py = (window.max_v - np.outer([r0, r1], np.cos(a))) / window.span_v * size
        x0, x1 = max(math.floor(px.min()) - 1, 0), min(math.ceil(px.max()) + 1, size - 1)
        y0, y1 = max(math.floor(py.min()) - 1, 0), min(math.ceil(py.max()) + 1, size - 1)
        if x0 > x1 or y0 > y1:
            continue
        y, x = lateral[None, x0 : x1 + 1], forward[y0 : y1 + 1, None]
        r, angle = np.hypot(x, y), np.degrees(np.arctan2(y, x))
        angle = angle - 360 * np.round((angle - (a0 + a1) / 2) / 360)
        inside = (r >= r0) & (r < r1) & (angle >= a0) & (angle < a1)
        part = heat[y0 : y1 + 1, x0 : x1 + 1]
        part[inside] = np.maximum(part[inside], v)


def peaks_only(grid: np.ndarray, window: int) -> np.ndarray:
    """Values that nothing within `window` samples on their beam exceeds."""
    padded = np.pad(grid, ((0, 0), (window, window)))
    top = np.max([padded[:, d : d + grid.shape[1]] for d in range(2 * window + 1)], axis=0)
    return np.where(grid >= top, grid, 0.0)


def _converted(heat, cells, az, samples, window, size, rps, style) -> None:
    grid = np.zeros((len(az), samples))
    grid[cells[0], cells[1]] = cells[2]
    if style.peak_window > 0:
        grid = peaks_only(grid, style.peak_window)
    lateral, forward = window.axes(size)
    y, x = np.meshgrid(lateral, forward)
    at = np.hypot(x, y) / rps - 1
    a = np.degrees(np.arctan2(y, x))
    a = az[0] + np.mod(a - az[0], 360.0)
    a = np.where(a >= az[0] + 360, a - 360, a)
    last, around = az[-1], az[-1] - az[0] > 300
    shown = (at >= 0) & (at <= samples - 1) & ((a <= last) | around)
    at, a = at[shown], a[shown]
    j = np.searchsorted(az, a, "left")
    seam = a > last
    b1 = np.where(seam, 0, np.minimum(j, len(az) - 1))
    b0 = np.where(seam, len(az) - 1, np.maximum(j - 1, 0))
    gap = np.where(seam, az[0] + 360 - last, az[b1] - az[b0])
    fb = np.divide(a - az[b0], gap, out=np.zeros_like(a), where=(gap > 0) & (b0 != b1))
    s0 = at.astype(np.int64)
    fs, s1 = at - s0, np.minimum(s0 + 1, samples - 1)
    low, high = (grid[b, s0] * (1 - fs) + grid[b, s1] * fs for b in (b0, b1))
    heat[shown] = low * (1 - fb) + high * fb


def signal_of(az: list[float], samples: int, per_sample: float, cos_tilt: float, amps: dict[str, float], size: int = SIZE, style: Style | None = None) -> np.ndarray:
    """The gray image (size x size, uint8) of one ping."""
    style, size = style or Style(), size or SIZE
    az = np.asarray(az, np.float64)
    window, edges = window_of(az, samples, per_sample, cos_tilt), edges_of(az)
    cells = cells_of(amps, len(az), samples, style.db_offset)
    heat = np.zeros((size, size))
    if style.kernel == "gauss":
        _bells(heat, cells, az, edges, window, size, per_sample, cos_tilt, style)
    elif style.kernel == "cell":
        _sectors(heat, cells, edges, window, size, per_sample, cos_tilt)
    else:
        _converted(heat, cells, az, samples, window, size, per_sample * cos_tilt, style)
    heat = np.minimum(heat, 1.0)
    return np.where(heat > style.threshold, _round(heat * 255), 0).astype(np.uint8)


def ramp_table(ramp: list[tuple[float, float, float, float]] | None = None) -> np.ndarray:
    """The colour (red, green, blue) of each gray value."""
    stops = np.array(ramp if ramp and len(ramp) >= 2 else RAMP, np.float64)
    t = (np.arange(256) / 255 * COLOR_STEPS).astype(np.int64) / COLOR_STEPS
    out = np.stack([np.interp(t, stops[:, 0], stops[:, k]) for k in (1, 2, 3)], 1)
    # before the first stop the ramp goes on along its first piece
    before = t < stops[0, 0]
    slope = (stops[1, 1:] - stops[0, 1:]) / (stops[1, 0] - stops[0, 0])
    out[before] = stops[0, 1:] + (t[before] - stops[0, 0])[:, None] * slope
    return _round(out).clip(0, 255).astype(np.uint8)


def rendered(pings: DataFrame, size: int = SIZE, style: Style | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of pings (all but the cells by default), with signal (size * size bytes), and the window's
    min_h, span_h, max_v, span_v. Pings without beams or samples go."""
    style = style or Style()
    keep = keep or [c for c in pings.columns if c != "cells"]
    wanted = pings.where((F.size("beams") > 0) & (F.col("samples") > 0))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pings.select(*keep).schema)

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 8):  # a picture takes far more than its cells
                part = batch.iloc[a : a + 8]
                windows = [window_of(np.asarray(r.beams), r.samples, r.per_sample, r.cos_tilt) for r in part.itertuples()]
                pictures = [signal_of(r.beams, r.samples, r.per_sample, r.cos_tilt, r.cells or {}, size, style).tobytes() for r in part.itertuples()]
                yield part[keep].assign(signal=pictures, **{f.name: [getattr(w, f.name) for w in windows] for f in fields(Window)})

    return wanted.mapInPandas(render, f"{schema}, signal binary, min_h double, span_h double, max_v double, span_v double")


def colored(signal: bytes, ramp: list[tuple[float, float, float, float]] | None = None) -> np.ndarray:
    """n x 3 colours of a signal image's pixels."""
    return ramp_table(ramp)[np.frombuffer(signal, np.uint8)]
