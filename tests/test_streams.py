"""Streams: late rows, restarts, folds that go on from a batch job's result, large keys."""

import random

import pytest
from pyspark.sql import functions as F

from fathomgrid.operators import asof
from fathomgrid.streaming import folds, nearest, ordered
from tests.stream_helpers import Counted

SCHEMA = "stream string, t long, id long, x double"
SECOND = 1_000_000
END = (None, 1 << 52, None, None)


def write(spark, path, rows):
    """One more file of the stream."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def source(spark, path, files=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(str(path))


def run(spark, rows, path, sink=None):
    spark.conf.set(*folds.STATE_STORE)
    out = rows.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    job = (out.foreachBatch(sink) if sink else out.format("parquet").option("path", f"{path}/out")).start()
    job.awaitTermination()


def result(spark, path):
    return {(r["stream"], r["id"]): r["y"] for r in spark.read.parquet(f"{path}/out").collect()}


def plain(rows, share, start=None):
    y, out = dict(start or {}), {}
    for stream, t, i, x in sorted((r for r in rows if r[3] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        y[stream] = x if stream not in y else share * x + (1 - share) * y[stream]
        out[stream, i] = y[stream]
    return out


def same(a, b):
    return a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in b)


@pytest.fixture
def rows():
    rng = random.Random(5)
    out = [(rng.choice(["a", "b", "c", None]), rng.randrange(0, 4000) * SECOND, i, rng.random()) for i in range(800)]
    return out + [("a", 77 * SECOND, 900 + i, float(i)) for i in range(5)] + [("b", 5 * SECOND, 950, None)]  # equal times, a null


def test_late_rows_are_folded_in_their_order(spark, tmp_path, rows):
    rng = random.Random(6)
    arrival = sorted(rows, key=lambda r: r[1] + rng.randrange(0, 300) * SECOND)  # up to five minutes late
    for k in range(0, len(arrival), 150):
        write(spark, tmp_path / "in", arrival[k : k + 150])
    write(spark, tmp_path / "in", [END])
    run(spark, folds.smoothed_stream(source(spark, tmp_path / "in"), 0.25, "5 minutes", slot=60 * SECOND), tmp_path)
    want = {(r["stream"], r["id"]): r["y"] for r in folds.smoothed(spark.createDataFrame(rows, SCHEMA).where("stream is not null"), 0.25).collect()}
    found = result(spark, tmp_path)
    assert same(found, plain(rows, 0.25)) and same({k: v for k, v in found.items() if k[0]}, want)


def test_rows_that_come_too_late_are_dropped_and_others_held(spark, tmp_path):
    write(spark, tmp_path / "in", [("a", 1000 * SECOND, 1, 1.0), ("a", 10 * SECOND, 2, 2.0)])
    write(spark, tmp_path / "in", [("a", 1100 * SECOND, 3, 3.0)])
    stream = lambda: folds.smoothed_stream(source(spark, tmp_path / "in"), 0.5, "100 seconds", slot=10 * SECOND)
    run(spark, stream(), tmp_path)
    assert result(spark, tmp_path) == {("a", 2): 2.0}  # 1000 s is held, as its slot ends with 1010
    write(spark, tmp_path / "in", [("a", 20 * SECOND, 4, 9.0), ("a", 1005 * SECOND, 5, 5.0)])  # the first is too late
    write(spark, tmp_path / "in", [END])
    run(spark, stream(), tmp_path)
    assert result(spark, tmp_path) == {("a", 2): 2.0, ("a", 1): 1.5, ("a", 5): 3.25, ("a", 3): 3.125}


def test_a_killed_stream_goes_on_with_its_state(spark, tmp_path, rows):
    ordered_rows = sorted(rows, key=lambda r: r[1])
    for k in range(0, len(ordered_rows), 200):
        write(spark, tmp_path / "in", ordered_rows[k : k + 200])
    write(spark, tmp_path / "in", [END])
    stream = lambda: folds.smoothed_stream(source(spark, tmp_path / "in"), 0.25, "1 second", slot=60 * SECOND)
    runs = []

    def sink(batch, number):
        if number == 3 and len(runs) == 1:
            raise RuntimeError("killed")
        batch.write.mode("overwrite").parquet(f"{tmp_path}/batches/{number}")  # by number: a batch that runs again replaces itself

    for _ in range(3):
        runs.append(0)
        try:
            run(spark, stream(), tmp_path, sink)
        except Exception as e:
            assert "killed" in str(e) and len(runs) == 1
    found = {(r["stream"], r["id"]): r["y"] for r in spark.read.parquet(f"{tmp_path}/batches/*").collect()}
    assert same(found, plain(rows, 0.25))


def test_a_stream_goes_on_from_a_batch_result(spark, tmp_path, rows):
    first = [r for r in rows if r[1] < 2000 * SECOND and r[0]]
    then = [r for r in rows if r[1] >= 2000 * SECOND]
    batch = folds.smoothed(spark.createDataFrame(first, SCHEMA), 0.25)
    start = ordered.last_rows(batch)
    write(spark, tmp_path / "in", then + [("a", 3 * SECOND, 990, 5.0)])  # before the batch's last row of its stream: too late
    write(spark, tmp_path / "in", [END])
    run(spark, folds.smoothed_stream(source(spark, tmp_path / "in"), 0.25, "1 hour", start, 60 * SECOND), tmp_path)
    known = {(r["stream"], r["id"]): r["y"] for r in batch.collect()}
    assert same(known | result(spark, tmp_path), plain([r for r in rows if r[0]] + [r for r in then if r[0] is None], 0.25))


def test_a_key_of_a_million_rows_is_folded_by_slots(spark, tmp_path):
    n, slot = 1_000_000, 20_000
    path = tmp_path / "in"
    spark.range(n, numPartitions=1).select(F.lit("a").alias("stream"), (F.col("id") * 1000 + slot * 1000).alias("t"), "id", (F.col("id") % 10).cast("double").alias("x")).write.parquet(str(path))
    write(spark, path, [END])
    stream = ordered.folded_stream(source(spark, path, 10), Counted(0.5, slot), "y double", "1 minute", slot=slot * 1000)
    run(spark, stream, tmp_path)
    out = spark.read.parquet(f"{tmp_path}/out")
    y = 0.0
    for i in range(200):  # as good as the whole sum, since older rows weigh less than a double holds
        y = 0.5 * ((n - 200 + i) % 10) + 0.5 * y
    assert out.count() == n and abs(out.where(F.col("id") == n - 1).first()["y"] - y) < 1e-12


@pytest.mark.parametrize("tie", ["later", "earlier"])
def test_nearest_of_two_streams_equals_the_batch_form(spark, tmp_path, tie):
    rng = random.Random(8)
    drivers = [(None, rng.randrange(1, 3000) * SECOND, i, 0.0) for i in range(120)] + [(None, 500 * SECOND, 200, 0.0)]
    cands = [(rng.choice("ab"), rng.randrange(1, 300) * 10 * SECOND, 1000 + i, 0.0) for i in range(150)] + [("a", 490 * SECOND, 2000, 0.0), ("a", 510 * SECOND, 2001, 0.0), ("a", 490 * SECOND, 2002, 0.0), ("x", 5 * SECOND, 2003, 0.0)]
    late = lambda rows: sorted(rows, key=lambda r: r[1] + rng.randrange(0, 120) * SECOND)
    for name, rows in (("d", late(drivers)), ("c", late(cands))):
        for k in range(0, len(rows), 40):
            write(spark, tmp_path / name, rows[k : k + 40])
        write(spark, tmp_path / name, [("a", 1 << 52, None, None)])
    tolerance = 25 * SECOND
    met = nearest.nearest_stream(source(spark, tmp_path / "d"), source(spark, tmp_path / "c"), ["a", "b", "c"], tolerance, tie, "2 minutes", 60 * SECOND)
    run(spark, met, tmp_path)
    batch = asof.nearest(spark.createDataFrame(drivers, SCHEMA).drop("stream", "x"), spark.createDataFrame(cands, SCHEMA), ["a", "b", "c"], tie, tolerance)
    want = sorted((r["stream"], r["driver"]["id"], r["found"]["id"] if r["found"] else -1) for r in batch.collect())
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r["stream"], r["id"], -1 if r["found_id"] is None else r["found_id"]) for r in found) == want
    assert len([x for x in want if x[2] >= 0]) > 100
