"""Sinks that lay out files: pictures under their paths, and playback documents of bounded size.

A task writes into a folder of its own below the target; only when all tasks have ended are its files moved to their places
and is `_SUCCESS` written. If a task or the move fails, the folders go, and nothing of the job is left. Files are reached
through their file system's own library, so that targets may be in shared stores.

Defined cases: an empty table writes `_SUCCESS` alone. A path that is absolute or leads out of the target, a null path or
data, and two rows of one path fail the job. `overwrite` replaces all that lies in the target, `append` adds to it and fails
if a file is there already.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes of a playback document, at most, unless a single entry is longer.
CAP = 64 << 20
KINDS = ("readings", "images", "sonarFrames")


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Wrote(WriterCommitMessage):
    folder: str
    files: int


class Staged(DataSourceArrowWriter):
    """A writer whose tasks give out (path, bytes) by `laid_out`."""

    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite, self.options = options["path"].rstrip("/"), overwrite, options
        self.job = f"_staging-{uuid.uuid4().hex}"
        files, root = _files(self.root)
        # made here and by no task, so that a task that is still at work when the job has failed can't bring it back
        files.create_dir(f"{root}/{self.job}", recursive=True)

    def laid_out(self, batches: Iterator[pa.RecordBatch], part: int) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, root = _files(self.root)
        folder, made, n = f"{root}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}", {""}, 0
        files.create_dir(folder, recursive=False)
        for path, data in self.laid_out(iterator, task.partitionId()):
            if not path or path.startswith("/") or ".." in path.split("/") or data is None:
                raise ValueError(f"not a file below the target: {path}")
            steps = path.split("/")[:-1]
            for below in ("/".join(steps[: k + 1]) for k in range(len(steps))):
                if below not in made:
                    files.create_dir(f"{folder}/{below}", recursive=False)
                    made.add(below)
            with files.open_output_stream(f"{folder}/{path}") as f:
                f.write(data)
            n += 1
        return Wrote(folder, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        files, root = _files(self.root)
        moves: dict[str, str] = {}
        for m in messages:
            found = files.get_file_info(fs.FileSelector(m.folder, recursive=True, allow_not_found=True)) if m else []
            for x in found:
                if x.is_file and moves.setdefault(f"{root}{x.path[len(m.folder) :]}", x.path) != x.path:
                    raise ValueError(f"two rows of one path: {x.path}")
        if sum(m.files for m in messages if m) != len(moves):
            raise ValueError("two rows of one path in a task")
        there = [x for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.base_name != self.job]
        if self.overwrite:
            for x in there:
                files.delete_file(x.path) if x.is_file else files.delete_dir(x.path)
        else:
            taken = [x.path for k in range(0, len(moves), 1000) for x in files.get_file_info(list(moves)[k : k + 1000]) if x.type != fs.FileType.NotFound]
            if taken:
                raise ValueError(f"there already: {taken[0]}")
        for folder in {posixpath.dirname(x) for x in moves} | {root}:
            files.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(32) as pool:
            list(pool.map(lambda x: files.move(x[1], x[0]), moves.items()))
        self._clear()
        with files.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        files, root = _files(self.root)
        for last in [False] * 50 + [True]:  # a task that is still at work may add a file meanwhile
            if files.get_file_info(f"{root}/{self.job}").type == fs.FileType.NotFound:
                return
            try:
                files.delete_dir(f"{root}/{self.job}")
            except OSError:
                if last:
                    raise
                time.sleep(0.1)


class _Pictures(Staged):
    def laid_out(self, batches, part):
        for batch in batches:
            yield from zip(batch.column("path").to_pylist(), batch.column("data").to_pylist(), strict=True)


class PictureSink(DataSource):
    """Writes rows (path: below the target, data: binary) as files."""

    @classmethod
    def name(cls) -> str:
        return "pictures"

    def writer(self, schema, overwrite: bool) -> Staged:
        if not {"path", "data"} <= set(schema.names):
            raise ValueError("columns path and data are needed")
        return _Pictures(dict(self.options), overwrite)


class _Playback(Staged):
    def laid_out(self, batches, part):
        cap, number = int(self.options.get("cap", CAP)), 0
        held: dict[str, list[str]] = {k: [] for k in KINDS}
        size = empty = len(_document(held))
        for batch in batches:
            for kind, entry in zip(batch.column("kind").to_pylist(), batch.column("entry").to_pylist(), strict=True):
                more = len(entry.encode()) + 1
                if size + more > cap and size > empty:
                    yield f"part-{part:05d}-{number:05d}.json", _document(held)
                    held, size, number = {k: [] for k in KINDS}, empty, number + 1
                held[kind].append(entry)
                size += more
        if size > empty:
            yield f"part-{part:05d}-{number:05d}.json", _document(held)


def _document(entries: dict[str, list[str]]) -> bytes:
    return ("{" + ",".join(f"{json.dumps(k)}:[{','.join(v)}]" for k, v in entries.items()) + "}").encode()


class PlaybackSink(DataSource):
    """Writes rows (kind, entry: JSON), in their order in each partition, as documents of all three kinds. Option cap: bytes."""

    @classmethod
    def name(cls) -> str:
        return "playback"

    def writer(self, schema, overwrite: bool) -> Staged:
        if not {"kind", "entry"} <= set(schema.names):
            raise ValueError("columns kind and entry are needed")
        return _Playback(dict(self.options), overwrite)


def write_pictures(pictures: DataFrame, path: str, mode: str = "append") -> None:
    """pictures (path of the record below its folder, signal_png, color_png) as files: both kinds in a folder of their own,
    under the record's path with the ending of pictures. Rows without a picture of a kind give no file of it."""
    name = F.regexp_replace("path", r"\.json$", "")
    rows = pictures.select(F.explode(F.array(*(F.struct(F.concat(F.lit(f"{folder}/"), name, F.lit(".png")).alias("path"), F.col(c).alias("data")) for folder, c in (("images", "color_png"), ("signal", "signal_png"))))).alias("f"))
    rows.select("f.*").where("data is not null").write.format("pictures").mode(mode).save(path)


def write_playback(entries: DataFrame, path: str, cap: int = CAP, mode: str = "append") -> None:
    """entries (kind, ts, entry: JSON) as documents in the order of ts: documents of one name follow those of a lesser name,
    and each holds what the cap allows. Entries of one time may be many: they are dealt by a hash."""
    total = entries.agg(F.sum(F.octet_length("entry"))).first()[0] or 0
    ranges = max(1, -(-total // (4 * cap)))
    rows = entries.withColumn("__h", F.xxhash64("kind", "entry"))
    dealt = rows.repartitionByRange(ranges, "ts", "__h").sortWithinPartitions("ts", "__h")
    dealt.select("kind", "entry").write.format("playback").option("cap", cap).mode(mode).save(path)


def read_playback(spark: SparkSession, path: str) -> DataFrame:
    """file, kind, place, entry (JSON) of all documents below a folder."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", ", ".join(f"{k} array<string>" for k in KINDS)).alias("d"))
    return files.select("file", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"d.{k}").alias("entries")) for k in KINDS))).alias("k")).select("file", "k.kind", F.posexplode("k.entries").alias("place", "entry"))
