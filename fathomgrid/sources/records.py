"""Ping, marker and manifest records: typed readers and the extraction of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import cell_key, micros

READINGS = T.StructType(
    [
        T.StructField("ping_number", T.LongType()),
        *(T.StructField(n, T.DoubleType()) for n in ("latitude", "longitude", "heading_deg", "ping_range", "ping_tilt")),
        T.StructField("n_beams", T.DoubleType()),
        T.StructField("n_samples", T.DoubleType()),
        *(T.StructField(n, T.DoubleType()) for n in ("range_per_sample", "cos_tilt")),
        T.StructField("az_sorted", T.ArrayType(T.DoubleType())),
        T.StructField("min_amp", T.FloatType()),
        T.StructField("amps", T.MapType(T.StringType(), T.FloatType())),
    ]
)
RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("resourceName", "timeCaptured", "partId", "resourceSubtype", "methodName", "timeSynced")] + [T.StructField("payload", T.StructType([T.StructField("readings", READINGS)]))])
MANIFEST = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "path", "timeCaptured", "resourceName", "componentName")])


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records of all .json files under a folder, one object each, and those that can't be read (path, text)."""
    schema = T.StructType([*RECORD.fields, T.StructField("_bad", T.StringType())])
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = files.select(F.col("_metadata.file_path").alias("path"), "value", parsed.alias("r"))
    whole = F.col("r").isNotNull() & F.col("r._bad").isNull()
    return rows.where(whole).select("path", *(F.col(f"r.{f.name}").alias(f.name) for f in RECORD)), rows.where(~whole).select("path", F.col("value").alias("text"))


def pings(records: DataFrame) -> DataFrame:
    """stream, t, ping, latitude, longitude, heading, beams, samples, per_sample, cos_tilt, cells of records with beams and
    samples. Numbers may be whole or not."""
    r = F.col("payload.readings")
    out = records.select(
        F.col("resourceName").alias("stream"),
        micros(F.to_timestamp("timeCaptured")).alias("t"),
        r["ping_number"].alias("ping"),
        r["latitude"].alias("latitude"),
        r["longitude"].alias("longitude"),
        r["heading_deg"].alias("heading"),
        r["az_sorted"].alias("beams"),
        r["n_samples"].cast("int").alias("samples"),
        r["range_per_sample"].alias("per_sample"),
        r["cos_tilt"].alias("cos_tilt"),
        r["amps"].alias("cells"),
        r["n_beams"].alias("n"),
    )
    return out.where("n > 0 and samples > 0 and size(beams) > 0").drop("n")


def cells(pings: DataFrame) -> DataFrame:
    """stream, t, ping, beam, sample, amp of each cell with a good key inside its grid."""
    out = pings.select("stream", "t", "ping", F.size("beams").alias("n"), "samples", F.explode("cells").alias("key", "amp"))
    beam, sample = cell_key(F.col("key"))
    out = out.withColumns({"beam": beam, "sample": sample})
    return out.where("beam between 0 and n - 1 and sample between 0 and samples - 1").drop("n", "samples", "key")


def markers(documents: DataFrame) -> DataFrame:
    """marker_id, latitude, longitude, depth, is_synthetic, ts (milliseconds) of marker documents (ordinal, data: JSON text,
    received: timestamp). Readings may stand under `readings` or by themselves; rows without a numeric position go; a missing
    ts is the time received; a missing id is `reading-<ordinal>`."""
    texts = T.StructType([T.StructField(n, T.StringType()) for n in ("marker_id", "latitude", "longitude", "depth", "is_synthetic", "ts")])
    parsed = documents.withColumn("__d", F.from_json("data", T.StructType([T.StructField("readings", texts), *texts.fields])))
    r = parsed.select("ordinal", "received", F.coalesce("__d.readings", F.struct(*(F.col(f"__d.{n}") for n in texts.names))).alias("r")).select("ordinal", "received", "r.*")
    number = lambda k: F.col(k).try_cast("double")
    out = r.select(
        F.coalesce(F.nullif("marker_id", F.lit("")), F.concat(F.lit("reading-"), F.col("ordinal").cast("string"))).alias("marker_id"),
        number("latitude").alias("latitude"),
        number("longitude").alias("longitude"),
        number("depth").alias("depth"),
        F.coalesce(F.col("is_synthetic").try_cast("boolean"), F.lit(False)).alias("is_synthetic"),
        F.coalesce(number("ts").cast("long"), F.unix_millis(F.col("received").cast("timestamp"))).alias("ts"),
    )
    return out.where("latitude is not null and longitude is not null")


def in_range(df: DataFrame, t: str, start: str, end: str) -> DataFrame:
    """Rows with start <= t <= end; pushed down to the scan."""
    return df.where((F.col(t) >= F.lit(start).cast(df.schema[t].dataType)) & (F.col(t) <= F.lit(end).cast(df.schema[t].dataType)))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a folder's manifests, files of a JSON array or of one object a line: the columns of MANIFEST as type,
    path, captured, resource, component, each path once: the first by file and place."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at"))
    return entries(rows.select(F.struct("__file", "__at").alias("arrival"), *MANIFEST.names))


def entries(rows: DataFrame) -> DataFrame:
    """type, path, captured, resource, component of manifest rows (the columns of MANIFEST and arrival), each path once: the
    first to arrive. An aggregate, so that a much-repeated path isn't gathered in one task."""
    first = rows.groupBy("path").agg(F.min_by(F.struct("type", F.col("timeCaptured").alias("captured"), F.col("resourceName").alias("resource"), F.col("componentName").alias("component")), "arrival").alias("e"))
    return first.select("e.type", "path", "e.captured", "e.resource", "e.component")


def owners(parts: DataFrame, known: DataFrame) -> DataFrame:
    """parts (part_id) with robot_id and location_id of known (part_id, robot_id, location_id); null for unknown ones. Spark
    broadcasts `known` if it is small."""
    return parts.join(known, "part_id", "left")


def new_files(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """wanted less those whose path is present."""
    return wanted.join(present.select("path").distinct(), "path", "left_anti")


def unmatched(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """id, state of ids that were requested and not returned (missing), or returned and not requested (unrequested)."""
    a, b = requested.select("id", F.lit(True).alias("a")).distinct(), returned.select("id", F.lit(True).alias("b")).distinct()
    return a.join(b, "id", "full").where("a is null or b is null").select("id", F.when(F.col("b").isNull(), "missing").otherwise("unrequested").alias("state"))


def labels(spark: SparkSession, path: str) -> list[str]:
    """A label file's lines without blanks around them and without empty ones: a small file, read whole."""
    return [t for r in spark.read.text(path).collect() if (t := r["value"].strip())]


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, pixels (rgb bytes) of the pictures under a folder, by Spark's image reader. Those of
    names that begin with `_` stay out. One that can't be read has a height of -1 and no pixels."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}").load(path).select("image.*")

    def turn(batches):
        import numpy as np

        for batch in batches:
            out = []
            for data, h, w, c in zip(batch["data"], batch["height"], batch["width"], batch["nChannels"], strict=True):
                if h < 0:
                    out.append(None)
                    continue
                p = np.frombuffer(data, np.uint8).reshape(h, w, c)
                out.append((p[..., 2::-1] if c >= 3 else np.repeat(p, 3, 2)).tobytes())
            yield batch[["origin", "height", "width"]].rename(columns={"origin": "path"}).assign(pixels=out)

    return rows.mapInPandas(turn, "path string, height int, width int, pixels binary").where(~F.col("path").rlike("/_[^/]*(/|$)"))
