"""Fan geometry and poses as expressions on columns. Azimuths are degrees clockwise from the boresight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import METERS_PER_DEGREE


def az_edges(az: Column) -> Column:
    """The n + 1 edges around n sorted beam centres: halfway between neighbours, mirrored at the ends; +-1 for one beam."""
    n = F.size(az)
    at = lambda i: F.element_at(az, i)
    inner = F.transform(F.sequence(F.lit(1), n - 1), lambda i: at(i) + (at(i + 1) - at(i)) / 2)
    first, last = at(F.lit(1)) - (at(F.lit(2)) - at(F.lit(1))) / 2, at(n) + (at(n) - at(n - 1)) / 2
    return F.when(n > 1, F.concat(F.array(first), inner, F.array(last))).when(n == 1, F.array(at(F.lit(1)) - 1, at(F.lit(1)) + 1))


def extent(edges: Column, reach: Column) -> Column:
    """struct(min_h, span_h, max_v, span_v) of a fan with these edges (degrees) and ground reach: lateral and forward
    bounds over the edges at ranges 0 and reach; a span under 1e-6 counts as 1."""
    y = F.transform(edges, lambda a: reach * F.sin(F.radians(a)))
    x = F.transform(edges, lambda a: reach * F.cos(F.radians(a)))
    low = lambda v: F.least(F.lit(0.0), F.array_min(v))
    high = lambda v: F.greatest(F.lit(0.0), F.array_max(v))
    span = lambda v: F.when(high(v) - low(v) < 1e-6, F.lit(1.0)).otherwise(high(v) - low(v))
    return F.struct(low(y).alias("min_h"), span(y).alias("span_h"), high(x).alias("max_v"), span(x).alias("span_v"))


def ground_range(sample: Column, per_sample: Column, cos_tilt: Column) -> Column:
    """Of a sample's centre."""
    return (sample + 1) * per_sample * cos_tilt


def lateral_forward(r: Column, az: Column) -> tuple[Column, Column]:
    return r * F.sin(F.radians(az)), r * F.cos(F.radians(az))


def to_pixel(lateral: Column, forward: Column, window: Column, size: Column) -> tuple[Column, Column]:
    return (lateral - window["min_h"]) / window["span_h"] * size, (window["max_v"] - forward) / window["span_v"] * size


def to_world(lateral: Column, forward: Column, heading: Column) -> tuple[Column, Column]:
    """East and north of the sensor."""
    s, c = F.sin(F.radians(heading)), F.cos(F.radians(heading))
    return forward * s + lateral * c, forward * c - lateral * s


def from_world(east: Column, north: Column, heading: Column) -> tuple[Column, Column]:
    s, c = F.sin(F.radians(heading)), F.cos(F.radians(heading))
    return east * c - north * s, east * s + north * c


def offset_meters(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> tuple[Column, Column]:
    """East and north of the second position from the first, on a plane; good under a kilometre."""
    return (lon1 - lon0) * METERS_PER_DEGREE * F.cos(F.radians((lat0 + lat1) / 2)), (lat1 - lat0) * METERS_PER_DEGREE
