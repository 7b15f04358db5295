"""Nearest-time alignment of two streams: a driver is given out with its nearest candidate once the watermark has passed its
slot and the tolerance, when no nearer one can come.

Both sides lie in state by slots of time, as Arrow messages. A driver's slot is settled by a timer at its end and the
tolerance; a candidate's slot goes when no driver that could still be settled reaches it. So state holds some slots and twice
the tolerance of each stream, and a task the rows of a slot with the candidates around it. The watermark is the lesser of both sides', so
that a side that lags behind isn't late.

Defined cases: ties in distance go to the later or the earlier candidate; of candidates of equal time before the driver
`later` takes the last by id and `earlier` the first, after it both take the first, as in `operators.asof`. A driver without a
candidate within the tolerance comes out with none. Rows without a time are nobody's. Rows behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ordered import SLOT


def _found(times: np.ndarray, ids: np.ndarray, targets: np.ndarray, tie: str, tolerance: int) -> np.ndarray:
    """The place of each target's candidate among those sorted by (time, id), or -1."""
    if not len(times):
        return np.full(len(targets), -1)
    after = np.searchsorted(times, targets)
    before = after - 1
    if tie == "earlier":
        before = np.where(before >= 0, np.searchsorted(times, times[np.maximum(before, 0)]), -1)
    far = np.int64(1) << 62
    back = np.where(before >= 0, targets - times[np.maximum(before, 0)], far)
    on = np.where(after < len(times), times[np.minimum(after, len(times) - 1)] - targets, far)
    best = np.where(back <= on if tie == "earlier" else back < on, before, after)
    return np.where(np.minimum(back, on) <= tolerance, best, -1)


class Nearest(StatefulProcessor):
    def __init__(self, tie: str, tolerance: int, slot: int):
        self.tie, self.tolerance, self.slot = tie, tolerance, slot
        #: Milliseconds after a slot's end at which its drivers are settled, and its candidates not needed any more.
        self.settle = -(-tolerance // 1000)
        self.forget = 2 * self.settle + slot // 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "driver boolean, slot long, part long", "rows binary")
        self.parts = handle.getMapState("parts", "driver boolean, slot long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch[batch["id"].notna()]
            for (driver, slot), some in batch.groupby([batch["driver"], batch["t"] // self.slot]):
                place = (bool(driver), int(slot))
                n = self.parts.getValue(place)[0] if self.parts.containsKey(place) else 0
                if not n:
                    self.handle.registerTimer((place[1] + 1) * self.slot // 1000 + (self.settle if driver else self.forget))
                sink = pa.BufferOutputStream()
                table = pa.Table.from_pandas(some[["t", "id"]].astype("int64"), preserve_index=False)
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table)
                self.rows.updateValue((*place, n), (sink.getvalue().to_pybytes(),))
                self.parts.updateValue(place, (n + 1,))
        yield from ()

    def _held(self, driver: bool, slot: int) -> list[pd.DataFrame]:
        n = self.parts.getValue((driver, slot))[0] if self.parts.containsKey((driver, slot)) else 0
        return [pa.ipc.open_stream(self.rows.getValue((driver, slot, k))[0]).read_pandas() for k in range(n)]

    def _forgotten(self, driver: bool, slot: int) -> None:
        if self.parts.containsKey((driver, slot)):
            for k in range(self.parts.getValue((driver, slot))[0]):
                self.rows.removeKey((driver, slot, k))
            self.parts.removeKey((driver, slot))

    def _slot_of(self, expiry: int, after: int) -> int | None:
        """The slot that a timer at this many milliseconds after its end stands for, if any."""
        end = (expiry - after) * 1000
        return end // self.slot - 1 if end % self.slot == 0 else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expiry = expiredTimerInfo.getExpiryTimeInMs()
        slot = self._slot_of(expiry, self.settle)
        drivers = self._held(True, slot) if slot is not None else []
        if drivers:
            d = pd.concat(drivers).sort_values(["t", "id"], kind="stable", ignore_index=True)
            near = range((slot * self.slot - self.tolerance) // self.slot, ((slot + 1) * self.slot - 1 + self.tolerance) // self.slot + 1)
            found = [x for s in near for x in self._held(False, s)]
            c = pd.concat(found).sort_values(["t", "id"], kind="stable", ignore_index=True) if found else pd.DataFrame({"t": np.zeros(0, np.int64), "id": np.zeros(0, np.int64)})
            t, i = c["t"].to_numpy(), c["id"].to_numpy()
            at = _found(t, i, d["t"].to_numpy(), self.tie, self.tolerance)
            met = pd.Series(at >= 0)
            at = np.maximum(at, 0)
            pick = lambda x: pd.Series(x[at] if len(x) else np.zeros(len(at), np.int64), dtype="Int64").where(met)
            yield pd.DataFrame({"stream": pd.Series([key[0]] * len(d), dtype=object), "t": d["t"], "id": d["id"], "found_t": pick(t), "found_id": pick(i)})
            self._forgotten(True, slot)
        slot = self._slot_of(expiry, self.forget)
        if slot is not None:
            self._forgotten(False, slot)

    def close(self) -> None:
        pass


def nearest_stream(drivers: DataFrame, candidates: DataFrame, streams: list[str], tolerance: int, tie: str = "later", late: str = "10 minutes", slot: int = SLOT) -> DataFrame:
    """stream, t, id, found_t, found_id: of each row of the streaming drivers (t, id) and each of `streams` the nearest of the
    streaming candidates (stream, t, id) within the tolerance (microseconds), or nulls. Needs the RocksDB state store."""
    d = drivers.select("t", "id", F.explode(F.array(*map(F.lit, streams))).alias("stream")).where("t is not null")
    c = candidates.where(F.col("stream").isin(streams) & F.col("t").isNotNull()).select("t", "id", "stream")
    sides = [x.withColumn("driver", F.lit(k)).withColumn("__ts", F.timestamp_micros("t")).withWatermark("__ts", late) for k, x in ((True, d), (False, c))]
    both = sides[0].unionByName(sides[1])
    return both.groupBy("stream").transformWithStateInPandas(Nearest(tie, tolerance, slot), "stream string, t long, id long, found_t long, found_id long", "append", "eventtime")
