"""Connected regions of pixels: runs of pixels in a row, links between runs of neighbouring rows, least labels.

Pixels are rows (by, y, x), of which there is none where a picture is silent. `by` names the columns that tell pictures
apart. A region's number is the code of its first run in reading order. Pictures are cut into bands of rows, each labelled
inside a task; what touches across bands is joined. Graphs of up to SMALL links are solved inside a task too, larger ones by
rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import kept
from .grouped import least_reached, whole_groups

#: A pixel's code is its row times this plus its column.
ROW = 1 << 20
#: Rows of a band; links up to which a graph is held by one task.
BAND, SMALL = 64, 1 << 20


def runs(pixels: DataFrame, by: list[str], y: str = "y", x: str = "x") -> DataFrame:
    """pixels with run, the column where the run of neighbouring pixels begins that each is in."""
    w = Window.partitionBy(*by, y).orderBy(x)
    begins = F.when(F.col(x) - F.lag(x).over(w) == 1, F.lit(None)).otherwise(F.col(x))
    return pixels.withColumn("__begin", begins).withColumn("run", F.last("__begin", ignorenulls=True).over(w)).drop("__begin")


def _regions(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.RecordBatch]:
    """Sorted pixels (by, band, y, x, ...) with the code of the first run that their run is linked to inside the band."""
    for rows, begins in whole_groups(batches, by + 1):
        y, x = (rows.column(by + k).to_numpy().astype(np.int64) for k in (1, 2))
        fresh = np.zeros(len(y), bool)
        fresh[begins] = True
        line = fresh.copy()  # where a row of pixels begins
        line[1:] |= y[1:] != y[:-1]
        begin = line.copy()
        begin[1:] |= x[1:] - x[:-1] > 1
        at = np.flatnonzero(begin)
        run, end = np.cumsum(begin) - 1, np.append(at[1:], len(x)) - 1
        # places along all rows of pixels, one after the other, with a gap between them
        row, wide = np.cumsum(line) - 1, x.max() - x.min() + 4
        place = row * wide + x - x.min()
        lines = np.flatnonzero(line)
        below = np.zeros(len(lines), bool)
        below[1:] = (y[lines[1:]] == y[lines[:-1]] + 1) & ~fresh[lines[1:]]
        some = np.flatnonzero(below[row[at]])
        low = np.searchsorted(place[end], place[at[some]] - wide - 1)
        n = np.maximum(np.searchsorted(place[at], place[end[some]] - wide + 1, "right") - low, 0)
        above = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        first = least_reached(len(at), above, np.repeat(some, n))
        code = (y[at] * ROW + x[at])[first[run]]
        yield pa.RecordBatch.from_arrays([*rows.columns[:by], *rows.columns[by + 1 :], pa.array(code)], names=[*rows.schema.names[:by], *rows.schema.names[by + 1 :], "region"])


def labelled(pixels: DataFrame, by: list[str]) -> DataFrame:
    """pixels with region, stored: pixels that touch, corners included, have the same."""
    more = [c for c in pixels.columns if c not in (*by, "y", "x")]
    whole = pixels.where(" and ".join(f"{c} is not null" for c in (*by, "y", "x"))).select(*by, F.floor(F.col("y") / BAND).alias("__band"), "y", "x", *more)
    schema = StructType([*(pixels.schema[c] for c in (*by, "y", "x", *more)), StructField("region", LongType())])
    rows = kept(whole.repartition(*by, "__band").sortWithinPartitions(*by, "__band", "y", "x").mapInArrow(lambda batches: _regions(batches, len(by)), schema), "regions")
    edge = lambda k: rows.where(F.pmod("y", F.lit(BAND)) == k)
    above = edge(BAND - 1).select(*by, (F.col("y") + 1).alias("y"), F.explode(F.array(*(F.col("x") + d for d in (-1, 0, 1)))).alias("x"), F.col("region").alias("a"))
    links = kept(edge(0).select(*by, "y", "x", F.col("region").alias("b")).join(above, [*by, "y", "x"]).select(*by, "a", "b").distinct(), "links")
    if not links.isEmpty():
        found = linked(links, by).withColumnRenamed("node", "region")
        rows = kept(rows.join(found, [*by, "region"], "left").withColumn("region", F.coalesce("component", "region")), "regions")
    return rows.select(*pixels.columns, "region")


def linked(links: DataFrame, by: list[str]) -> DataFrame:
    """by, node, component of the nodes of links (by, a, b): the least node that links reach within a picture."""
    links = kept(links.where(" and ".join(f"{c} is not null" for c in by)).select(*by, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "links")
    large = kept(links.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select(*by), "large")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in whole_groups(batches, len(by)):
            own = np.zeros(rows.num_rows, np.int64)
            own[begins[1:]] = 1
            group = np.tile(np.cumsum(own), 2)
            node = np.concatenate([rows.column(len(by) + k).to_numpy() for k in (0, 1)])
            order = np.lexsort((node, group))
            new = np.ones(len(order), bool)
            new[1:] = (node[order[1:]] != node[order[:-1]]) | (group[order[1:]] != group[order[:-1]])
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(new) - 1
            a, b = np.split(place, 2)
            once = order[new]
            first = least_reached(len(once), a, b)
            picture = pa.array(begins[group[once]])
            yield pa.RecordBatch.from_arrays([*(c.take(picture) for c in rows.columns[: len(by)]), pa.array(node[once]), pa.array(node[once][first])], names=[*by, "node", "component"])

    def by_tasks(few: DataFrame) -> DataFrame:
        schema = StructType([*(few.schema[c] for c in by), StructField("node", LongType()), StructField("component", LongType())])
        return few.repartition(*by).sortWithinPartitions(*by).mapInArrow(solve, schema)

    if large.isEmpty():
        return by_tasks(links)
    few, many = (links.join(large, by, how) for how in ("left_anti", "left_semi"))
    ends = many.select(*by, F.col("a").alias("node")).union(many.select(*by, "b"))
    return by_tasks(few).unionByName(connected(ends, many, by))


def connected(nodes: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """by, node, component of nodes (by, node): the least node that links (by, a, b) reach within a picture.

    In each round a node takes the least label of its neighbours, and then its label's label."""
    both = kept(links.select(*by, "a", "b").union(links.select(*by, "b", "a")).distinct(), "links")
    labels = kept(nodes.select(*by, "node", F.col("node").alias("component")).distinct(), "labels")
    while True:
        offers = both.join(labels.withColumnRenamed("node", "b"), [*by, "b"]).groupBy(*by, F.col("a").alias("node")).agg(F.min("component").alias("offer"))
        lower = labels.join(offers, [*by, "node"], "left").select(*by, "node", F.col("component").alias("was"), F.coalesce(F.least("component", "offer"), "component").alias("component"))
        roots = labels.select(*by, F.col("node").alias("component"), F.col("component").alias("root"))
        after = kept(lower.join(roots, [*by, "component"]).select(*by, "node", "was", F.least("component", "root").alias("component")), "labels")
        labels = after.drop("was")
        if after.where("component < was").isEmpty():
            return labels


def half_widths(radius: int) -> list[tuple[int, int]]:
    """(dy, half) of a round kernel: how far the ellipse reaches to either side in each row, rounded."""
    return [(dy, round((radius * radius - dy * dy) ** 0.5)) for dy in range(-radius, radius + 1)]


def disk_offsets(radius: int) -> list[tuple[int, int]]:
    """(dy, dx) of the kernel's places."""
    return [(dy, dx) for dy, half in half_widths(radius) for dx in range(-half, half + 1)]


def reaches(pixels: DataFrame, by: list[str], radius: int) -> DataFrame:
    """by, y, from, to: for each run of pixels and row of the round kernel the places that it reaches."""
    whole = runs(pixels.select(*by, "y", "x"), by).groupBy(*by, "y", "run").agg(F.max("x").alias("to"))
    rows = F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("run") - half).alias("from"), (F.col("to") + half).alias("to")) for dy, half in half_widths(radius)))
    return whole.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def spread(pixels: DataFrame, by: list[str], radius: int) -> DataFrame:
    """The distinct places (by, y, x) within the round kernel of a pixel. Runs of pixels are spread, not single ones: a place
    comes once for each of the kernel's rows that reach it."""
    return reaches(pixels, by, radius).select(*by, "y", F.explode(F.sequence("from", "to")).alias("x")).distinct()


def pixel_rows(pictures: DataFrame, keep: list[str], column: str, width: Column, channels: int = 1) -> DataFrame:
    """keep, y, x, and c0 (c1, c2) of the bytes of a binary column of pictures, row by row, without pixels that are all 0."""
    at = F.posexplode(F.sequence(F.lit(1), F.length(column), F.lit(channels)))
    rows = pictures.select(*keep, F.col(column).alias("__data"), width.alias("__width"), at.alias("__i", "__at"))
    value = lambda k: F.conv(F.hex(F.substring(F.col("__data"), F.col("__at") + k, F.lit(1))), 16, 10).cast("int")
    out = rows.select(*keep, F.floor(F.col("__i") / F.col("__width")).cast("int").alias("y"), (F.col("__i") % F.col("__width")).cast("int").alias("x"), *(value(k).alias(f"c{k}") for k in range(channels)))
    return out.where(" or ".join(f"c{k} > 0" for k in range(channels)))


def regridded(pixels: DataFrame, by: list[str], old: tuple[int, int], new: tuple[int, int], value: str = "u") -> DataFrame:
    """by, y, x and value on another grid (rows, columns): each new pixel is the mean of the area it covers, where places
    without a row count as 0."""

    def covered(at: str, n: int, m: int) -> Column:
        low, high = F.col(at) * m / n, (F.col(at) + 1) * m / n
        cells = F.sequence(F.floor(low).cast("int"), (F.ceil(high) - 1).cast("int"))
        return F.transform(cells, lambda k: F.struct(k.alias("at"), (F.least(high, k + 1) - F.greatest(low, k.cast("double"))).alias("share")))

    rows = pixels.select(*by, value, "x", F.explode(covered("y", old[0], new[0])).alias("r")).select(*by, value, "r", F.explode(covered("x", old[1], new[1])).alias("c"))
    return rows.groupBy(*by, F.col("r.at").alias("y"), F.col("c.at").alias("x")).agg(F.sum(F.col(value) * F.col("r.share") * F.col("c.share")).alias(value))
