"""Folds in order of event time over streams whose rows come late: rows are held until the watermark has passed their slot
of time, then they are folded in order and given out.

A slot's rows lie in state as Arrow messages, one for each batch of rows that brought some, so that neither a micro-batch nor
what is held of a key is ever in memory as a whole: only one slot's rows are, when its timer fires. Rows that come after
their slot was given out are too late and dropped. What a fold knows is one value of state for each key, which may start
from a batch job's result and which a restarted stream finds in its checkpoint.

Defined cases: rows of equal time are folded in order of id; rows with a null x are ignored, and so may close a stream by a
late time alone. A null key is a key of its own. Rows of times at or before those of the initial state are too late,
as are those of 1970's first instant and before, where watermarks begin.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Microseconds of a slot.
SLOT = 3_600_000_000


class Smooth:
    """share * x + (1 - share) * the y before; the first y is x."""

    def __init__(self, share: float):
        self.share = share

    def folded(self, saved: bytes | None, rows: pd.DataFrame) -> tuple[bytes, pd.DataFrame]:
        y = struct.unpack("<d", saved)[0] if saved else None
        out = []
        for x in rows["x"].tolist():
            y = x if y is None else self.share * x + (1 - self.share) * y
            out.append(y)
        return struct.pack("<d", y), rows.assign(y=out)

    @staticmethod
    def saved(row: pd.Series) -> bytes:
        return struct.pack("<d", row["y"])


class Ordered(StatefulProcessor):
    """fold: an object with folded(saved, rows in order) -> (saved, rows) and saved(row of the initial state)."""

    def __init__(self, fold, names: list[str], slot: int):
        self.fold, self.names, self.slot = fold, names, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "slot long, part long", "rows binary")
        self.parts = handle.getMapState("parts", "slot long", "n long")
        #: What the fold knows, and the (t, id) that it has come to.
        self.state = handle.getValueState("state", "saved binary, t long, id long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        last = initialState.sort_values(["t", "id"]).iloc[-1]
        self.state.update((self.fold.saved(last), int(last["t"]), int(last["id"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        for batch in rows:
            batch = batch[batch["x"].notna()]
            if known:
                batch = batch[(batch["t"] > known[1]) | (batch["t"] == known[1]) & (batch["id"] > known[2])]
            for slot, some in batch.groupby(batch["t"] // self.slot):
                slot = int(slot)
                n = self.parts.getValue((slot,))[0] if self.parts.containsKey((slot,)) else 0
                if not n:
                    self.handle.registerTimer((slot + 1) * self.slot // 1000)
                sink = pa.BufferOutputStream()
                table = pa.Table.from_pandas(some[self.names], preserve_index=False)
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table)
                self.held.updateValue((slot, n), (sink.getvalue().to_pybytes(),))
                self.parts.updateValue((slot,), (n + 1,))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slot = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.slot - 1
        if not self.parts.containsKey((slot,)):
            return
        found = []
        for n in range(self.parts.getValue((slot,))[0]):
            found.append(pa.ipc.open_stream(self.held.getValue((slot, n))[0]).read_pandas())
            self.held.removeKey((slot, n))
        self.parts.removeKey((slot,))
        rows = pd.concat(found).sort_values(["t", "id"], kind="stable", ignore_index=True)
        known = self.state.get() if self.state.exists() else None
        if known and rows["t"].iloc[0] < known[1]:
            raise RuntimeError("timers must come in order of time")
        saved, rows = self.fold.folded(known[0] if known else None, rows)
        self.state.update((saved, int(rows["t"].iloc[-1]), int(rows["id"].iloc[-1])))
        yield rows

    def close(self) -> None:
        pass


def folded_stream(rows: DataFrame, fold, added: str, late: str = "10 minutes", initial: DataFrame | None = None, slot: int = SLOT) -> DataFrame:
    """A streaming DataFrame's rows (stream, t: microseconds, id: long, x, ...) with the columns `added` (DDL) of the fold, in
    order of (t, id) within each stream, once the watermark, `late` behind the latest t, has passed their slot.

    initial: the fold's beginning by stream (stream, t, id, and what fold.saved reads), such as a batch job's last rows.
    Needs the RocksDB state store; slot: whole milliseconds, in microseconds."""
    names = rows.columns
    marked = rows.withColumn("__ts", F.timestamp_micros("t")).withWatermark("__ts", late)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {added}"
    return marked.groupBy("stream").transformWithStateInPandas(Ordered(fold, names, slot), schema, "append", "eventtime", initial.groupBy("stream") if initial is not None else None)


def last_rows(folded: DataFrame) -> DataFrame:
    """The last row by (t, id) of each stream: what a stream can go on from."""
    names = [c for c in folded.columns if c != "stream"]
    last = folded.groupBy("stream").agg(F.max_by(F.struct(*names), F.struct("t", "id")).alias("last"))
    return last.select("stream", *(F.col(f"last.{c}").alias(c) for c in names))
