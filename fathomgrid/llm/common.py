"""Helpers shared by the corpus operators: reading, durable intermediate tables, and text as numpy arrays."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Bytes of text that the numpy kernels take at a time, so that their temporary arrays stay small.
CHUNK = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as a table in the shared folder and read back: lost executors then cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables that `stored` has written and that nothing reads any more."""
    for table in tables:
        hadoop = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        hadoop.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def cleaned(spark: SparkSession) -> None:
    """Lets Spark's cleaner see which shuffles no plan refers to any more, so that their files go from the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() for small tables."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Words of 64 bits that `likely_in` marks ids in.
MARKS = 1 << 18


def likely_in(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """df and __likely: true where the key is among the only column of ids, by name any, and hardly ever elsewhere.

    A key sets one bit of its hash; the table of words is broadcast and has MARKS rows at most, whatever the sizes are. Rows
    without a bit need not be shuffled for an exact join."""
    (field,) = ids.schema.fields
    of = lambda c: F.xxhash64(c.cast(field.dataType))
    word, bit = (lambda h: F.pmod(h, F.lit(MARKS))), (lambda h: F.shiftrightunsigned(h, 58).cast("int"))
    marks = ids.select(of(F.col(field.name)).alias("h")).select(word(F.col("h")).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("h"))).alias("__bit"))
    marks = marks.groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    found = df.withColumn("__word", word(of(F.col(key)))).join(F.broadcast(marks), "__word", "left")
    own = F.call_function("shiftright", "__bits", bit(of(F.col(key))))
    return found.withColumn("__likely", F.coalesce(own.bitwiseAND(1) == 1, F.lit(False))).drop("__word", "__bits")


def only(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose key is likely among ids: for the side of a join that most rows don't take part in."""
    return likely_in(df, key, ids).where("__likely").drop("__likely")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves the remainder `fold`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def strings(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row offsets and UTF-8 bytes of a string column; nulls are empty."""
    if pa.types.is_large_string(array.type):
        array = array.cast(pa.string())
    if array.null_count:
        array = array.fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def text_chunks(array: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets, code points) for runs of rows of about `limit` bytes, or one longer row."""
    offsets, data = strings(array)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        chunk = data[offsets[row] : offsets[end]]
        at = offsets[row : end + 1] - offsets[row]
        if chunk.size and chunk.max() >= 128:
            starts = np.concatenate(([0], np.cumsum((chunk & 0xC0) != 0x80)))
            at = starts[at]
            points = np.frombuffer(chunk.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        else:
            points = chunk.astype(np.uint32)
        yield row, end, at, points
        row = end


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the integers between neighbouring offsets."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def word_bytes(text: bytes | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text's UTF-8, with A-Z lower-cased; bytes are parted at just these blanks."""
    return text.lower().split() if text else []


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8."""
    return column.cast(pa.binary()).to_pylist()
