"""Exact order statistics of many groups at once, by radix counts.

Values become whole numbers of the same order. In each of three rounds the rows that may still hold a wanted rank are
counted by their next bits; running sums of the counts tell which bits hold the rank. So what is shuffled are counts, added
up before the shuffle, and a window holds counts of one group and one prefix; no task holds a group's values, however many
they are. A group of any share of the rows costs as many counts as it has different prefixes.

Defined cases: nulls don't count; NaN comes after all numbers; -0.0 is 0.0. A group without a value has no row in `at_ranks`,
and nulls with a count of 0 in `quantiles`. Ties are values like others. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType

from ..sources.shared import kept

#: Bits that are left after each round.
LEFT = (64, 42, 20, 0)
_LOW = -(1 << 63)


@F.arrow_udf(LongType())
def _ordered(values: pa.Array) -> pa.Array:
    """Whole numbers that are ordered as the doubles are."""
    x = values.to_numpy(zero_copy_only=False) + 0.0
    bits = x.view(np.int64)
    return pa.array(np.where(np.isnan(x), np.int64(0x7FF8 << 48), np.where(bits < 0, np.int64(_LOW) - bits, bits)))


@F.arrow_udf(DoubleType())
def _double(keys: pa.Array) -> pa.Array:
    bits = keys.to_numpy(zero_copy_only=False)
    return pa.array(np.where(bits < 0, np.int64(_LOW) - bits, bits).view(np.float64))


def _key(df: DataFrame, value: str) -> Column:
    """A long that is ordered, as an unsigned number, as the values are."""
    floating = isinstance(df.schema[value].dataType, (DoubleType, FloatType))
    signed = _ordered(F.col(value).cast("double")) if floating else F.col(value).cast("long")
    return signed.bitwiseXOR(F.lit(_LOW))


def _keyed(df: DataFrame, by: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """by, key of the rows with a value, stored, and by, n: how many each group has."""
    rows = kept(df.where(F.col(value).isNotNull()).select(*by, _key(df, value).alias("key")), "keys")
    return rows, rows.groupBy(*by).agg(F.count("*").alias("n"))


def _at(rows: DataFrame, by: list[str], targets: DataFrame) -> DataFrame:
    """targets (by, rank) with the key at that 0-based rank of its group."""
    same = lambda a, b, more: [a[c].eqNullSafe(b[c]) for c in (*by, *more)]
    left = targets.select(*by, "rank", F.col("rank").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    for before, after in pairwise(LEFT):
        prefix = F.shiftrightunsigned("key", before) if before < 64 else F.lit(0).cast("long")
        counts = rows.withColumn("prefix", prefix)
        if before < 64:
            active = left.select(*by, "prefix").distinct()
            counts = counts.join(active, same(counts, active, ["prefix"]), "left_semi")
        counts = counts.groupBy(*by, "prefix", F.shiftrightunsigned("key", after).alias("next")).agg(F.count("*").alias("n"))
        # unsigned order: all prefixes but the last round's have less than 64 bits, and those compare as signed after a flip
        order = F.col("next").bitwiseXOR(F.lit(_LOW)) if not after else F.col("next")
        up = Window.partitionBy(*by, "prefix").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("upto", F.sum("n").over(up))
        within = (left["rest"] < counts["upto"]) & (left["rest"] >= counts["upto"] - counts["n"])
        found = left.join(counts, [*same(left, counts, ["prefix"]), within])
        left = kept(found.select(*(left[c] for c in by), left["rank"], (left["rest"] - counts["upto"] + counts["n"]).alias("rest"), counts["next"].alias("prefix")), "ranks")
    return left.select(*by, "rank", F.col("prefix").bitwiseXOR(F.lit(_LOW)).alias("key"))


def at_ranks(df: DataFrame, by: list[str], value: str, rank: Column) -> DataFrame:
    """by, n, rank, value: of each group the value at a 0-based rank, an expression of its number of values n. Without `by`,
    all rows are one group."""
    if not by:
        return at_ranks(df.withColumn("__all", F.lit(0)), ["__all"], value, rank).drop("__all")
    rows, sizes = _keyed(df, by, value)
    sizes = kept(sizes.withColumn("rank", rank.cast("long")), "sizes")
    found = _at(rows, by, sizes.select(*by, "rank"))
    floating = isinstance(df.schema[value].dataType, (DoubleType, FloatType))
    found = found.withColumn("value", _double("key") if floating else F.col("key")).drop("key")
    return sizes.join(found.drop("rank"), [sizes[c].eqNullSafe(found[c]) for c in by], "inner").select(*(sizes[c] for c in by), "n", "rank", "value")


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, n, and a column for each share: the value at that share of the way from the least to the greatest, interpolated.
    Without `by`, all rows are one group."""
    if not by:
        return quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, shares).drop("__all")
    keyed = df.select(*by, F.col(value).cast("double").alias("__v"))
    rows, sizes = _keyed(keyed, by, "__v")
    sizes = kept(sizes, "sizes")
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    ends = F.array(*(end(place(p)).cast("long") for p in shares.values() for end in (F.floor, F.ceil)))
    found = _at(rows, by, sizes.select(*by, F.explode(F.array_distinct(ends)).alias("rank")))
    values = found.select(*by, "rank", _double("key").alias("v"))
    groups = values.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    every = keyed.select(*by).distinct()
    sizes = sizes.join(groups, [sizes[c].eqNullSafe(groups[c]) for c in by]).select(*(sizes[c] for c in by), "n", "at")
    out = every.join(sizes, [every[c].eqNullSafe(sizes[c]) for c in by], "left").select(*(every[c] for c in by), F.coalesce("n", F.lit(0)).alias("n"), "at")

    def between(p: float) -> Column:
        low, high = (end(place(p)).cast("long") for end in (F.floor, F.ceil))
        a, b = F.element_at("at", low), F.element_at("at", high)
        return F.when(a == b, a).otherwise((high - place(p)) * a + (place(p) - low) * b)

    return out.select(*by, "n", *(between(p).alias(name) for name, p in shares.items()))
