"""Time-range scans: windows of a request, and a data source that reads each (stream, window) as a partition."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .pages import PageSource
from .writers import PictureSink, PlaybackSink

#: Longest request, usual window, and the shortest that a window is halved to.
LONGEST, WINDOW, SHORTEST = timedelta(days=3), timedelta(minutes=5), timedelta(seconds=30)


def checked(start: datetime, end: datetime, longest: timedelta = LONGEST) -> tuple[datetime, datetime]:
    if start is None or end is None:
        raise ValueError("both bounds are needed")
    if end < start:
        raise ValueError("the end is before the start")
    if end - start > longest:
        raise ValueError(f"the range is longer than {longest}")
    return start, end


def windows(spans: DataFrame, minutes: int = 5) -> DataFrame:
    """spans (start, end) with day, window_start, window_end, last: for each UTC day the windows from the request's or the
    day's begin on, cut at the request's and the day's end. Half open, but for the last."""
    step = F.expr(f"interval {minutes} minutes")
    days = spans.withColumn("day", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))))
    first = F.greatest(F.col("start"), F.col("day").cast(spans.schema["start"].dataType))
    limit = F.least(F.col("end"), F.date_add("day", 1).cast(spans.schema["end"].dataType))
    parts = days.withColumns({"first": first, "limit": limit}).withColumn("window_start", F.explode(F.sequence("first", "limit", step)))
    parts = parts.where((F.col("window_start") < F.col("limit")) | ((F.col("window_start") == F.col("end")) & (F.col("first") == F.col("limit"))))
    parts = parts.withColumn("window_end", F.least(F.col("window_start") + step, F.col("limit")))
    return parts.withColumn("last", F.col("window_end") == F.col("end")).drop("first", "limit")


class _Part(InputPartition):
    def __init__(self, stream: str, start: datetime, end: datetime, last: bool):
        super().__init__((stream, start.isoformat(), end.isoformat(), last))


class TooLarge(Exception):
    """What a client raises when a window holds more than it can give at once."""


class RangeSource(DataSource):
    """Options: client (`module:function`, called as function(stream, start, end, closed) -> rows), streams (comma), start,
    end (ISO), schema, stream_column and time_column (`stream` and `ts`). A window that is too large is halved down to half a
    minute; any other failure fails the task. With spark.sql.python.filterPushdown.enabled, comparisons of both columns with
    constants leave out streams and windows before anything is fetched; Spark still applies them to what is read."""

    @classmethod
    def name(cls) -> str:
        return "time_range"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _naive(value) -> datetime | None:
    """A pushed constant as a UTC time without zone, as clients get; None if it isn't a time."""
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value)
        except ValueError:
            return None
    if not isinstance(value, datetime):
        return None
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        self.low: datetime | None = None
        self.high: datetime | None = None
        self.streams = list(dict.fromkeys(self.options["streams"].split(",")))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows streams and times by what is compared with a constant; all filters are given back, to be applied to rows."""
        stream, time = (self.options.get(k, d) for k, d in (("stream_column", "stream"), ("time_column", "ts")))
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == (stream,) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.streams = [s for s in self.streams if s in wanted]
            at = _naive(f.value) if column == (time,) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) else None
            if at and not isinstance(f, (LessThan, LessThanOrEqual)):
                self.low = max(self.low, at) if self.low else at
            if at and not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.high = min(self.high, at) if self.high else at
            yield f

    def partitions(self) -> list[InputPartition]:
        start, end = checked(*(datetime.fromisoformat(self.options[k]) for k in ("start", "end")))
        spans, at = [], start
        while True:
            to = min(at + WINDOW, end)
            # windows are half open but for the last, which holds its end
            if (self.high is None or at <= self.high) and (self.low is None or self.low < to or to == end and self.low == end):
                spans.append((at, to, to == end))
            if to == end:
                break
            at = to
        return [_Part(stream, *span) for stream in self.streams for span in spans]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if partition is None:  # no window is left, and Spark runs one task for nothing
            return
        stream, start, end, last = partition.value
        module, _, function = self.options["client"].partition(":")
        yield from self._window(getattr(import_module(module), function), stream, datetime.fromisoformat(start), datetime.fromisoformat(end), last)

    def _window(self, client, stream: str, start: datetime, end: datetime, last: bool) -> Iterator[tuple]:
        try:
            rows = client(stream, start, end, last)
        except TooLarge:
            if end - start <= SHORTEST:
                raise
            middle = start + (end - start) / 2
            yield from self._window(client, stream, start, middle, False)
            yield from self._window(client, stream, middle, end, last)
            return
        yield from rows


def register(spark: SparkSession) -> None:
    for source in (RangeSource, PageSource, PictureSink, PlaybackSink):
        spark.dataSource.register(source)


def envelope(df: DataFrame, t: str, start, end, pad: str = "5 minutes") -> DataFrame:
    """One row (low, high): the least and greatest t, padded, within the request; without rows the request itself."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    margin = F.expr(f"interval {pad}")
    return df.agg(F.min(t).alias("a"), F.max(t).alias("b")).select(F.coalesce(F.greatest(F.col("a") - margin, lo), lo).alias("low"), F.coalesce(F.least(F.col("b") + margin, hi), hi).alias("high"))
