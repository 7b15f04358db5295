"""Sources and sinks of their own: page streams, range scans with pushed filters, pictures, playback documents."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomgrid.sources import pages, ranges, records, sinks, writers


def stream(spark, path, client="read", resources="a,b", span=1, once=True):
    rows = spark.readStream.format("pages").options(client=f"tests.pages_client:{client}", resources=resources, schema="stream string, n int", ledger=f"{path}/ledger", pages=span).load()
    out = rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    job = (out.trigger(once=True) if once else out.trigger(processingTime="0 seconds")).start()
    return job


def test_page_stream_goes_on_after_a_restart(spark, tmp_path):
    ranges.register(spark)
    for _ in range(4):  # each start reads a page of each resource, from where the one before stopped
        stream(spark, tmp_path).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", 1), ("a", 2), ("a", 3), ("b", 9)]
    stream(spark, tmp_path).awaitTermination()  # nothing more
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_page_spans_are_read_in_tasks_without_loss(spark, tmp_path):
    from tests.pages_client import MANY

    ranges.register(spark)
    for _ in range(2):
        stream(spark, tmp_path, "many", "x,y,z", 300).awaitTermination()
    job = stream(spark, tmp_path, "many", "x,y,z", 300, once=False)  # a restart goes on to the end
    job.processAllAvailable()
    job.stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.distinct().count() == 6 * MANY


def test_a_span_that_runs_again_begins_and_ends_alike(tmp_path, monkeypatch):
    import pyspark

    class Task:
        def taskAttemptId(self):
            return 7

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: Task()))
    reader = pages._Pages({"client": "tests.pages_client:read", "resources": "a,b", "ledger": str(tmp_path), "pages": "2"})
    assert reader.latestOffset() == {"a": 1, "b": 1}
    for _ in range(2):
        assert [list(reader.read(p)) for p in reader.partitions(reader.initialOffset(), {"a": 1, "b": 1})] == [[("a", 1), ("a", 2), ("a", 3)], [("b", 9)]]
    assert reader.latestOffset() == {"a": 2, "b": 1}
    assert [list(reader.read(p)) for p in reader.partitions({"a": 1, "b": 1}, {"a": 2, "b": 1})] == [[]]
    assert reader.latestOffset() == {"a": 2, "b": 1} and not [f for _, _, fs in os.walk(tmp_path) for f in fs if "." in f]


@pytest.mark.parametrize(("condition", "windows"), [("true", 24), ("stream = 'b'", 12), ("stream in ('a', 'c') and ts >= timestamp '2024-01-01 00:31:00'", 6), ("ts < timestamp '2024-01-01 00:05:00' and ts > timestamp '2024-01-01 00:02:00'", 4), ("ts = timestamp '2024-01-01 01:00:00'", 2), ("stream = 'x'", 0), ("minute(ts) = 7", 24)])
def test_filters_leave_out_windows(spark, condition, windows):
    ranges.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        read = lambda: spark.read.format("time_range").options(client="tests.pages_client:window", streams="a,b", start="2024-01-01T00:00:00", end="2024-01-01T01:00:00", schema="stream string, ts timestamp, by string").load()
        found = read().where(condition)
        assert found.rdd.getNumPartitions() == windows or not windows and found.rdd.getNumPartitions() <= 1
        rows, whole = found.collect(), read().collect()
        assert len(rows) == len(set(rows)) and sorted(rows) == sorted(spark.createDataFrame(whole, read().schema).where(condition).collect())
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def files_in(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if not f.endswith(".crc"))


def test_pictures_round_trip(spark, tmp_path):
    ranges.register(spark)
    rng = np.random.default_rng(1)
    signals = [(f"fan_{i % 3}/{i:03d}.json", rng.integers(0, 256, 64, dtype=np.uint8).tobytes()) for i in range(40)]
    rows = sinks.with_png(spark.createDataFrame(signals, "path string, signal binary").repartition(5))
    writers.write_pictures(rows, str(tmp_path / "out"))
    assert len(files_in(tmp_path / "out")) == 81 and "_SUCCESS" in files_in(tmp_path / "out")
    got = {r["path"].split("/signal/")[1]: bytes(r["pixels"])[::3] for r in records.images(spark, str(tmp_path / "out" / "signal")).collect()}
    assert got == {p.replace(".json", ".png"): s for p, s in signals}
    with pytest.raises(Exception, match="there already"):
        writers.write_pictures(rows, str(tmp_path / "out"))
    writers.write_pictures(rows.where("path like 'fan_1%'"), str(tmp_path / "out"), "overwrite")
    assert len(files_in(tmp_path / "out")) == 2 * sum(p.startswith("fan_1") for p, _ in signals) + 1
    writers.write_pictures(rows.limit(0), str(tmp_path / "none"))
    assert files_in(tmp_path / "none") == ["_SUCCESS"]


@pytest.mark.parametrize("bad", ["/etc/x", "../x", "a/../../x", None, "a/0.png"])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad):
    ranges.register(spark)
    rows = spark.createDataFrame([(f"a/{i}.png", b"x" * i) for i in range(30)] + [(bad, b"y")], "path string, data binary").repartition(4)
    with pytest.raises(Exception):
        rows.write.format("pictures").mode("append").save(str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") or files_in(tmp_path / "out") == []

    @F.udf("binary")
    def broken(i):
        if i == 17:
            raise RuntimeError("lost")
        return b"z"

    with pytest.raises(Exception, match="lost"):
        spark.range(30).select(F.concat(F.lit("b/"), F.col("id").cast("string")).alias("path"), broken("id").alias("data")).repartition(3).write.format("pictures").mode("append").save(str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") or files_in(tmp_path / "out") == []


def test_playback_documents_round_trip(spark, tmp_path):
    ranges.register(spark)
    readings = spark.range(300).select((F.col("id") * 7 % 101).alias("ts"), F.col("id").alias("marker_id"), F.lit("é\"\n").alias("note"))
    images = spark.range(50).select((F.col("id") * 2).alias("ts"), F.lit("image/png").alias("mime"), F.base64(F.repeat(F.lit("x"), F.col("id").cast("int") * 20).cast("binary")).alias("data"))
    sonar = spark.range(20).select(F.lit(40).cast("long").alias("ts"), F.col("id").alias("n"))  # many of one time
    entries = sinks.playback(readings, images, sonar)
    writers.write_playback(entries, str(tmp_path / "out"), 3000)
    got = writers.read_playback(spark, str(tmp_path / "out")).collect()
    key = lambda r: (r["kind"], json.dumps(json.loads(r["entry"]), sort_keys=True))
    assert sorted(map(key, got)) == sorted(map(key, entries.collect()))
    names = [f for f in files_in(tmp_path / "out") if f != "_SUCCESS"]
    assert len(names) > 10 and all(os.path.getsize(tmp_path / "out" / f) <= 3000 for f in names)
    times = [[json.loads(e)["ts"] for r in got if r["file"] == f for e in [r["entry"]]] for f in names]
    assert all(max(a) <= min(b) for a, b in zip(times, times[1:]))  # documents follow each other in time
    for f in names:
        document = json.loads((tmp_path / "out" / f).read_text())
        assert list(document) == list(writers.KINDS) and all([x["ts"] for x in v] == sorted(x["ts"] for x in v) for v in document.values())
    writers.write_playback(entries, str(tmp_path / "one"))
    assert files_in(tmp_path / "one") == ["_SUCCESS", "part-00000-00000.json"]
    writers.write_playback(entries.limit(0), str(tmp_path / "none"))
    assert files_in(tmp_path / "none") == ["_SUCCESS"]
