"""Best-fit packing of documents into sequences of a fixed number of tokens, in bulk-synchronous supersteps.

Documents are tokenised and cut into pieces; only those over the capacity are cut. Pieces go by classes, from large to small:
those of which a sequence holds one, two, three, and all smaller ones. In a superstep Spark sorts a class's open pieces and the gaps that
may hold them by size, from large to small, into ranges, whose borders come from counts by size. Each task sweeps over its
range: a piece takes the smallest gap passed so far that is still free, its successor among the gaps. What a range leaves
over, pieces without a gap and gaps without a piece, is carried down to the ranges of smaller sizes: the tasks' counts of
both settle which ranks of pieces meet which ranks of gaps, and a join by rank matches them. Then all gaps shrink at once,
and what found no gap waits for the next superstep.

A gap of twice the largest open size and more takes a run of small pieces in one superstep: pieces and gaps are laid out
along lines, by sums over their ranges, and a piece goes to the gap on whose part of the line it begins; that part is shorter
than the gap by a piece less one, so that what begins there fits. Sequences open only when no gap holds an open piece, as
many as the rest's tokens need at least. Every superstep's outcome is a stored table; the driver sees counts by size and by
task only.

Defined cases: a null or empty text is a document of no tokens but the separator. A text of any length is cut and packed
whole. Pieces of equal length are ordered by number. Repeated rows and ids are packed one by one. An empty table gives an
empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Codec, Words, byte_alphabet, codec, default_path, split
from .common import n_partitions, stored

CAPACITY = 2048
SEPARATOR = 0
#: Words whose ids a worker keeps, about 200 bytes each.
WORDS = 250_000
#: Pieces of which a sequence holds at least so many are laid into gaps by runs.
CLASS = 4


class _Ids:
    """A text's ids as unsigned 32-bit little-endian bytes. New pieces go through the tokenizer library's own model."""

    def __init__(self, c: Codec):
        self.codec = c
        self.letters = byte_alphabet()
        self.tokenize = c.library.model.tokenize
        self.pieces = Words(self.piece)
        self.words = Words(self.make, WORDS)

    def piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join([self.letters[b] for b in piece.encode()])
        ids = [t.id for t in self.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def make(self, word: str) -> bytes:
        if word.isalpha():
            return self.piece(word)
        return b"".join(map(self.pieces.__getitem__, split(word)))

    def of(self, text: str | None) -> bytes:
        words = self.codec.plain_words(text) if text else []
        if words is None:
            return np.array(self.codec.ids(text), "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, words))


_KNOWN: dict[str, _Ids] = {}


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), and a number for each piece."""
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([SEPARATOR], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _KNOWN.setdefault(path, _Ids(codec(path)))
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                data = memoryview(ids_of.of(text.as_py()) + end)
                n = len(data) >> 2
                for k, a in enumerate(range(0, n, capacity)):
                    part = data[4 * a : 4 * min(n, a + capacity)]
                    size = len(part) >> 2
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.arange(number, number + len(row)))]
            number += len(row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "number"]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=names + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, number long" + ", ids array<int>" * with_ids)


#: Rows of a range, at least; with more rows than that for each shuffle partition, ranges grow.
RANGE = 1 << 14
#: Kinds of rows that a sweep gives out: a gap and a piece left over, a match, and a task's counts.
GAP, PIECE, MATCH, COUNTS = range(4)
_SWEPT = "kind int, number long, size int, sequence long, gap int, part int, place long, total long, least int, largest int, most int"


def matches(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of matched gaps and pieces in a run from large to small sizes: like brackets, each piece takes the last gap
    before it that is free."""
    depth = np.cumsum(np.where(is_gap, 1, -1))
    level = np.where(is_gap, depth, depth + 1)
    order = np.argsort(level, kind="stable")
    a, b = order[:-1], order[1:]
    met = (level[a] == level[b]) & is_gap[a] & ~is_gap[b]
    return a[met], b[met]


def swept(pieces: DataFrame, gaps: DataFrame) -> DataFrame:
    """The outcome of each range's sweep over pieces (number, size) and gaps (sequence, gap), as rows of _SWEPT.

    `place` is a left-over piece's rank in its range from the largest on, a left-over gap's from the smallest on. A task's
    counts are those of left-over pieces, their tokens, least and largest size, left-over gaps and matches, and the largest gap
    that it leaves. A task holds a range as three numbers a row."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        columns = [np.concatenate(c) for c in zip(*([x.to_numpy() for x in b.columns] for b in batches), strict=True)]
        if not columns:
            return
        size, kind, number = columns
        is_gap = kind == GAP
        a, b = matches(is_gap)
        free, open_ = is_gap.copy(), ~is_gap
        free[a] = open_[b] = False
        free, open_ = np.flatnonzero(free), np.flatnonzero(open_)

        def rows(kind: int, n: int, number, size, sequence, gap, place, total=None, least=None, largest=None, most=None) -> pa.RecordBatch:
            fill = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, kind), pa.int32()), fill(number, pa.int64()), fill(size, pa.int32()), fill(sequence, pa.int64()), fill(gap, pa.int32()), pa.array(np.full(n, part), pa.int32()), fill(place, pa.int64()), fill(total, pa.int64()), fill(least, pa.int32()), fill(largest, pa.int32()), fill(most, pa.int32())],
                names=["kind", "number", "size", "sequence", "gap", "part", "place", "total", "least", "largest", "most"],
            )

        yield rows(MATCH, len(a), number[b], size[b], number[a], size[a], None)
        yield rows(PIECE, len(open_), number[open_], size[open_], None, None, np.arange(len(open_)))
        yield rows(GAP, len(free), None, None, number[free], size[free], np.arange(len(free))[::-1].copy())
        widest = max(int((size[a] - size[b]).max(initial=0)), int(size[free].max(initial=0)))
        yield rows(COUNTS, 1, [len(open_)], None, [len(free)], None, [len(a)], [int(size[open_].sum(dtype=np.int64))], [int(size[open_].min(initial=1 << 30))], [int(size[open_].max(initial=0))], [widest])

    return _dealt(pieces, gaps).mapInArrow(sweep, _SWEPT)


def _dealt(pieces: DataFrame, gaps: DataFrame) -> DataFrame:
    """size, kind, number of pieces and gaps, range-sorted from large to small sizes."""
    items = pieces.select("size", F.lit(PIECE).alias("kind"), "number").union(gaps.select("gap", F.lit(GAP), "sequence"))
    table, ranges = _ranges(items)
    part = F.col("first") + F.pmod(F.xxhash64("number"), F.col("ranges"))
    dealt = items.join(table, ["size", "kind"]).select("size", "kind", "number", part.cast("int").alias("part"))
    return dealt.repartitionById(ranges, F.col("part")).sortWithinPartitions(F.desc("size"), "kind", "number").select("size", "kind", "number")


def filled(pieces: DataFrame, gaps: DataFrame, largest: int, capacity: int, each: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, tuple[int, int, int, int]]:
    """Runs of pieces (number, size) of `largest` or less in gaps (sequence, gap) of twice that and more: the matches (number,
    size, sequence, gap: what of it is left when the piece comes), the gaps that are left, the pieces that are left, and these
    pieces' tokens, number, least and largest size.

    Both are laid out along lines, the largest pieces and the smallest gaps first. A gap's part of its line is the gap less `largest` and one more, so
    each but the last that pieces reach has a piece that begins there, and all that do fit. With `each`, lines count pieces:
    a gap, of so many times `largest` and more, takes so many."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ends = TaskContext.get().partitionId(), np.zeros(2, np.int64)
        names = ["kind", "number", "size", "part", "at", "pieces", "gaps", "last"]
        last = 0
        for batch in batches:
            size, kind, number = (c.to_numpy() for c in batch.columns)
            is_gap = kind == GAP
            lengths = np.where(is_gap, each or size - largest + 1, 1 if each else size).astype(np.int64)
            at = np.empty(len(size), np.int64)
            for k, own in enumerate((~is_gap, is_gap)):
                upto = np.cumsum(lengths[own])
                at[own] = ends[k] + upto - lengths[own]
                ends[k] += int(upto[-1]) if len(upto) else 0
            last = int(size[~is_gap][-1]) if (~is_gap).any() else last
            none = pa.nulls(len(size), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(number), pa.array(size, pa.int32()), pa.array(np.full(len(size), part), pa.int32()), pa.array(at), none, none, none], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([COUNTS], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.array(ends[:1]), pa.array(ends[1:]), pa.array([last])], names=names)

    step = stored(_dealt(pieces, gaps).mapInArrow(lay, "kind int, number long, size int, part int, at long, pieces long, gaps long, last long"), "laid")
    counts = sorted((r["part"], r["pieces"], r["gaps"], r["last"]) for r in step.where(F.col("kind") == COUNTS).collect())
    offsets, sums = ({}, {}), [0, 0]
    for part, *totals, _ in counts:
        for k in (0, 1):
            offsets[k][part] = sums[k]
            sums[k] += totals[k]
    tail = 1 if each else next(c[3] for c in reversed(counts) if c[1])
    x = step.where(F.col("kind") == PIECE).select("number", "size", (F.col("at") + _by_part(offsets[0])).alias("x"))
    y = step.where(F.col("kind") == GAP).select(F.col("number").alias("sequence"), F.col("size").alias("gap"), (F.lit(sums[1]) - F.col("at") - _by_part(offsets[1])).alias("to"))
    y = y.withColumn("y", F.col("to") - (F.lit(each) if each else F.col("gap") - largest + 1))
    bucket = lambda c: F.floor(c / F.lit(capacity)).cast("long")
    placed = x.where(F.col("x") < sums[1]).withColumn("bucket", bucket(F.col("x")))
    lines = y.where(F.col("y") <= sums[0] - tail).withColumn("bucket", F.explode(F.sequence(bucket(F.col("y")), bucket(F.col("to") - 1))))
    met = placed.join(lines, "bucket").where((F.col("x") >= F.col("y")) & (F.col("x") < F.col("to")))
    own = Window.partitionBy("sequence")  # of pieces that one gap holds
    before = F.coalesce(F.sum("size").over(own.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = met.select("number", "size", "sequence", (F.col("gap") - before).alias("gap"), (F.col("gap") - F.sum("size").over(own)).alias("left"))
    met = stored(met.select("number", "size", "sequence", F.col("gap").cast("int").alias("gap"), F.col("left").cast("int").alias("left")), "filled")
    left = met.select("sequence", F.col("left").alias("gap")).distinct().union(y.where(F.col("y") > sums[0] - tail).select("sequence", "gap"))
    rest = x.where(F.col("x") >= sums[1]).select("number", "size")
    known = rest.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.coalesce(F.min("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first() if sums[0] > sums[1] else (0, 0, 0, 0)
    return met.drop("left"), left.where("gap > 0"), rest, tuple(known)


def _ranges(items: DataFrame) -> tuple[DataFrame, int]:
    """The first range of each (size, kind) and over how many it goes, two rows for each size at most; the number of ranges.

    Ranges hold about equally many rows, from large to small sizes. Rows of a size that fills more than one are dealt to
    them by number."""
    spark = items.sparkSession
    found = sorted(((-r["size"], r["kind"], r["n"]) for r in items.groupBy("size", "kind").agg(F.count("*").alias("n")).collect()))
    total = sum(n for _, _, n in found)
    rows, at, out = max(RANGE, -(-total // n_partitions(spark))), 0, []
    for size, kind, n in found:
        out.append((-size, kind, at // rows, -(-n // rows)))
        at += n
    ranges = max((first + n for _, _, first, n in out), default=1)
    return F.broadcast(spark.createDataFrame(out, "size int, kind int, first int, ranges int")), ranges


def carried(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which left-over pieces meet which left-over gaps of larger ranges, from counts (part, pieces, gaps) in the order of
    ranges: (part of the pieces, their first place, part of the gaps, their first place, how many)."""
    out, stack = [], []
    for part, pieces, gaps in counts:
        at = 0
        while at < pieces and stack:
            other, first, n = stack.pop()
            k = min(n, pieces - at)
            out.append((part, at, other, first, k))
            at += k
            if n > k:
                stack.append((other, first + k, n - k))
        if gaps:
            stack.append((part, 0, gaps))
    return out


def _met(step: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """number, size, sequence, gap of the matches that are carried over borders of ranges; `runs` are of the order of the
    number of tasks."""
    spark = step.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(runs)], "run int, of long, piece_from long, gap_of long, gap_from long, n long"))

    def ranked(kind: int, of: str, first: str, *columns: str) -> DataFrame:
        rank = F.col("place") - F.col(first)
        return step.where(F.col("kind") == kind).join(table, (F.col("part") == F.col(of)) & rank.between(0, F.col("n") - 1)).select("run", rank.alias("rank"), *columns)

    return ranked(PIECE, "of", "piece_from", "number", "size").join(ranked(GAP, "gap_of", "gap_from", "sequence", "gap"), ["run", "rank"]).select("number", "size", "sequence", "gap")


def _by_part(values: dict[int, int]) -> Column:
    """A number for each row by its part, 0 for parts without one."""
    known = {k: v for k, v in values.items() if v}
    if not known:
        return F.lit(0)
    table = F.create_map(*(F.lit(x) for k, v in known.items() for x in (k, v)))
    return F.coalesce(F.element_at(table, F.col("part")), F.lit(0))


class _Open:
    """The open pieces of a class and the gaps that may hold them, and what has been placed so far."""

    def __init__(self, capacity: int, nothing: DataFrame):
        self.capacity, self.supersteps, self.opened = capacity, 0, 0
        self.out: list[DataFrame] = []
        self.pieces = nothing
        self.gaps = nothing.sparkSession.createDataFrame([], "sequence long, gap int")
        self.tokens = self.count = self.least = self.largest = 0
        #: No gap is larger.
        self.widest = capacity

    def fill(self) -> bool:
        """Lays runs of pieces into the gaps of at least twice the largest size, or pairs and threes into those that hold any such,
        if there are gaps like that."""
        each = self.each if self.largest * CLASS > self.capacity else 0
        wide = (each or 2) * self.largest
        if self.widest < wide or self.gaps.where(F.col("gap") >= wide).isEmpty():
            return False
        met, left, self.pieces, (self.tokens, self.count, self.least, self.largest) = filled(self.pieces, self.gaps.where(F.col("gap") >= wide), self.largest, self.capacity, each)
        self.widest = self.capacity if each or not self.count else wide - 1  # with pieces left over, every wide gap is filled
        self.out.append(met)
        self.gaps = self._few(self.gaps.where(F.col("gap") < wide).union(left))
        self.supersteps += 1
        return True

    def _few(self, table: DataFrame) -> DataFrame:
        """The table stored in few files, as supersteps are many and their tables small."""
        return stored(table.coalesce(n_partitions(table.sparkSession) // 8 + 1), "gaps")

    def sweep(self) -> bool:
        """One superstep of single matches; whether another may match more."""
        spark = self.gaps.sparkSession
        step = stored(swept(self.pieces, self.gaps.where(F.col("gap") >= self.least)), "sweep")
        counts = sorted((r["part"], r["number"], r["sequence"], r["place"], r["total"], r["least"], r["most"], r["largest"]) for r in step.where(F.col("kind") == COUNTS).collect())
        runs = carried([c[:3] for c in counts])
        met = stored(_met(step, runs).coalesce(n_partitions(spark) // 8 + 1), "carried") if runs else None
        n_met = sum(c[3] for c in counts) + sum(r[4] for r in runs)
        gone, used = Counter(), Counter()
        for part, _, other, _, n in runs:
            gone[part] += n
            used[other] += n
        new = [step.where(F.col("kind") == MATCH).select("number", "size", "sequence", "gap"), *([met] if met is not None else [])]
        narrow = self.gaps.where(F.col("gap") < self.least)
        left = step.where((F.col("kind") == GAP) & (F.col("place") >= _by_part(used))).select("sequence", "gap")
        for x in new:
            left = left.union(x.select("sequence", (F.col("gap") - F.col("size")).alias("gap")).where("gap > 0"))
        self.out += new
        self.gaps = self._few(left.union(narrow))
        self.pieces = step.where((F.col("kind") == PIECE) & (F.col("place") >= _by_part(gone))).select("number", "size")
        self.count = sum(c[1] for c in counts) - sum(gone.values())
        self.tokens = sum(c[4] for c in counts)
        self.least = min((c[5] for c in counts if c[1] > gone[c[0]]), default=self.least)
        self.largest = max((c[7] for c in counts if c[1] > gone[c[0]]), default=self.largest)
        self.widest = max(c[6] for c in counts)  # what is carried shrinks gaps of these
        if runs and self.count:
            self.tokens = self.pieces.agg(F.sum("size")).first()[0]
        self.supersteps += 1
        # gaps of the same range that stayed free are smaller than what was left over, but those of larger ones may not be
        return bool(n_met and self.count and (runs or max(c[6] for c in counts) >= self.least))

    def open(self) -> None:
        """Opens as many sequences as the open pieces need at least: any two or three of up to a half or a third of the capacity
        fit, and no more; smaller ones need what their tokens do."""
        many = self.largest * CLASS > self.capacity
        need = -(-self.count // self.each) if many else -(-self.tokens // self.capacity)
        fresh = self.gaps.sparkSession.range(need).select((-1 - F.lit(self.opened) - F.col("id")).alias("sequence"), F.lit(self.capacity).alias("gap"))
        self.opened += need
        self.gaps = self.gaps.union(fresh)
        self.widest = self.capacity

    def place(self, pieces: DataFrame, sizes: dict[int, int], each: int) -> None:
        """Places all pieces of a class; sizes: how many there are of each; each: how many of the largest a sequence holds."""
        self.each = each
        self.pieces, self.count, self.tokens = pieces, sum(sizes.values()), sum(s * n for s, n in sizes.items())
        self.least, self.largest, self.widest = min(sizes), max(sizes), self.capacity
        while self.count:
            if not self.fill() and not self.sweep() and self.count:
                self.open()


def placed(sizes: DataFrame, capacity: int = CAPACITY, watch: Callable[[int], None] | None = None) -> DataFrame:
    """number, sequence_id, offset of each piece of a stored table (number, size). A sequence that a piece of over half the
    capacity opens has its number, others have negative ones. watch: is told the number of supersteps."""
    known = {r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()}
    state = _Open(capacity, sizes.limit(0))
    alone = sizes.where(F.col("size") > capacity // 2).select("number", "size", F.col("number").alias("sequence"), F.lit(capacity).alias("gap"))
    state.out.append(alone)
    state.gaps = state.gaps.union(alone.select("sequence", (F.col("gap") - F.col("size")).alias("gap")).where("gap > 0"))
    # those of which a sequence holds two, three, and more
    ends = [capacity // 2, capacity // 3, capacity // CLASS, 0]
    for high, low in pairwise(ends):
        own = {s: n for s, n in known.items() if low < s <= high}
        if own:
            state.place(sizes.where((F.col("size") > low) & (F.col("size") <= high)), own, capacity // high)
    if watch:
        watch(state.supersteps)
    result = sizes.limit(0).select("number", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    for x in state.out:
        result = result.union(x.select("number", F.col("sequence").alias("sequence_id"), (capacity - F.col("gap")).cast("long").alias("offset")))
    return result


def packed(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of a stored table of pieces with sequence_id and offset instead of number."""
    places = placed(table.select("number", F.col("length").cast("int").alias("size")), capacity)
    return table.join(places, "number").drop("number")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset of each piece of docs."""
    return packed(stored(pieces(docs, path, capacity, with_ids), "pieces"), capacity)
