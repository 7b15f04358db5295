"""Order statistics by radix counts against sorting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomgrid.operators import quantiles


def groups(kind):
    rng = random.Random(3)
    make = {
        "doubles": lambda: rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-300), rng.gauss(0, 1e300), 0.0, -0.0, 5.0, math.inf, -math.inf]),
        "longs": lambda: rng.choice([rng.randrange(-5, 5), rng.randrange(-(1 << 63), 1 << 63), (1 << 63) - 1, -(1 << 63)]),
        "ties": lambda: rng.randrange(3),
    }[kind]
    return [(g, make()) for g, n in (("a", 1), ("b", 2), ("c", 500), ("d", 37), (None, 60)) for _ in range(n)] + [("c", None), ("e", None)]


@pytest.mark.parametrize("kind", ["doubles", "longs", "ties"])
def test_ranks_equal_sorting(spark, kind):
    rows = groups(kind)
    df = spark.createDataFrame(rows, f"g string, x {'double' if kind == 'doubles' else 'long'}").repartition(5)
    for rank, plain in ((F.floor(F.col("n") / 2), lambda n: n // 2), (F.lit(0), lambda n: 0), (F.col("n") - 1, lambda n: n - 1)):
        got = {r["g"]: (r["n"], r["value"]) for r in quantiles.at_ranks(df, ["g"], "x", rank).collect()}
        for g in ("a", "b", "c", "d", None):
            own = sorted(x for k, x in rows if k == g and x is not None)
            assert got[g] == (len(own), own[plain(len(own))])
        assert "e" not in got


def test_quantiles_equal_numpy(spark):
    rows = [(g, k, x) for k, (g, x) in enumerate(groups("doubles")) if x is None or abs(x) < 1e100]
    df = spark.createDataFrame(rows, "g string, k long, x double")
    got = {r["g"]: r for r in quantiles.quantiles(df, ["g"], "x", {"low": 0.25, "mid": 0.5, "high": 0.9}).collect()}
    for g in {r[0] for r in rows}:
        own = [x for k, _, x in rows if k == g and x is not None]
        assert got[g]["n"] == len(own)
        for name, p in (("low", 25), ("mid", 50), ("high", 90)):
            assert got[g][name] is None if not own else math.isclose(got[g][name], np.percentile(own, p), rel_tol=1e-12, abs_tol=1e-12)
    whole = quantiles.quantiles(df, [], "x", {"mid": 0.5}).first()
    assert math.isclose(whole["mid"], np.median([x for *_, x in rows if x is not None]), rel_tol=1e-12)
    nan = spark.createDataFrame([(1.0,), (math.nan,), (2.0,)], "x double")
    assert quantiles.at_ranks(nan, [], "x", F.lit(1)).first()["value"] == 2.0 and math.isnan(quantiles.at_ranks(nan, [], "x", F.lit(2)).first()["value"])


def test_empty(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert quantiles.quantiles(df, ["g"], "x", {"mid": 0.5}).count() == 0 and quantiles.at_ranks(df, ["g"], "x", F.lit(0)).count() == 0


def test_no_task_gathers_a_group(spark):
    """Ten groups' values are counted in the map stage: what is shuffled is bounded by prefixes, not rows."""
    df = spark.range(200_000, numPartitions=4).select((F.col("id") % 2).alias("g"), (F.col("id") % 50).cast("double").alias("x"))
    found = quantiles.quantiles(df, ["g"], "x", {"mid": 0.5})
    plan = found._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower() and "collect_list(x" not in plan
    assert {r["g"]: r["mid"] for r in found.collect()} == {0: 24.0, 1: 25.0}
