"""Scalar expressions: amplitude and intensity scales, names, paths, times, rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the sensor's encoding and of the display window.
DB_PER_COUNT = 10.0 * math.log10(2) / 256.0
DB_MIN, DB_MAX = -100.0, -64.0
DB_SPAN = DB_MAX - DB_MIN
METERS_PER_DEGREE = 111320.0

#: Share of the new frame in the temporal filter, by level.
BLEND = {"off": 1.0, "weak": 0.5, "medium": 0.25, "strong": 0.12}


def db_of_count(count: Column, offset: float = 0.0) -> Column:
    return count.cast("double") * F.lit(DB_PER_COUNT) + F.lit(offset)


def unit_of_db(db: Column) -> Column:
    """Intensity in display units; up to 0 at the window's bottom, 1 at its top and beyond."""
    return F.least((db - DB_MIN) / DB_SPAN, F.lit(1.0))


def db_of_unit(u: Column) -> Column:
    return u * DB_SPAN + DB_MIN


def gray_floor(db: float) -> int:
    """The gray value under which pixels are noise for a floor in dB; 0 turns the floor off."""
    return max(0, min(255, math.ceil((db - DB_MIN) / DB_SPAN * 255.0)))


def floored(gray: Column, db: float) -> Column:
    return F.when(gray >= gray_floor(db), gray).otherwise(0)


def cell_key(key: Column) -> tuple[Column, Column]:
    """Beam and sample of a key like `12_340`; both null where the key isn't of that form."""
    form = r"^([+-]?\d+)_([+-]?\d+)$"
    part = lambda i: F.nullif(F.regexp_extract(key, form, i), F.lit("")).try_cast("int")
    return part(1), part(2)


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)


def safe_name(name: Column) -> Column:
    return F.translate(name, "/\\: ", "____")


def safe_time(text: Column) -> Column:
    return F.translate(text, ":. /", "--_-")


def blend_of(level: Column) -> Column:
    name = F.lower(F.trim(level))
    out = F.lit(BLEND["off"])
    for k, v in BLEND.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def mime_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "png", "image/png").otherwise("application/octet-stream")


def base_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(base_of(path), r"\.[^.]*$", "")


def with_extension(path: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(ext))


def id_suffix(identity: Column) -> Column:
    return F.substring(F.substring_index(identity, "/", -1), 1, 12)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without a zone (taken as UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds3(micro: Column) -> Column:
    """Seconds to three places, halves away from zero."""
    return F.round(micro / 1000.0) / 1000.0


def upper_median(name: str) -> Column:
    """Aggregate: the value of index n // 2 in sorted order of column `name`, the upper one of the two in the middle."""
    return F.expr(f"percentile_disc(0.500000000001D) within group (order by {name})")


def hue_name(h: Column) -> Column:
    """Coarse name of a hue in [0, 180)."""
    return F.when((h < 12) | (h >= 140), "red").when(h < 25, "orange").when(h < 40, "yellow").when(h < 100, "green").otherwise("blue")


def screen_time(name: Column) -> Column:
    """The timestamp in a capture folder's name: what stands before a `+`, in ISO form."""
    return F.to_timestamp(F.split_part(name, F.lit("+"), F.lit(1)))


def render_time(stem: Column) -> Column:
    """The timestamp in a rendered frame's stem, with 0 to 9 digits of a second's fraction; null where there is none."""
    form = r"^(\d{4}-\d{2}-\d{2})T(\d{2})-(\d{2})-(\d{2})(?:-(\d{1,9}))?Z"
    g = lambda i: F.regexp_extract(stem, form, i)
    whole = F.concat(g(1), F.lit(" "), g(2), F.lit(":"), g(3), F.lit(":"), g(4), F.lit("."), F.rpad(g(5), 6, "0"))
    return F.when(stem.rlike(form), F.try_to_timestamp(whole))
