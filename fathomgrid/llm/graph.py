"""Links between members of postings, and connected components by minimum labels with pointer jumping. All rounds are joins
and grouped minima."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, dropped, stored

#: Members over which a posting isn't joined in full at once.
LARGE = 64
#: Share of comparisons that must link, or no further round is tried.
FEW = 0.1


def components(links: DataFrame) -> DataFrame:
    """node, component for the nodes of links (a, b, both long): component is the smallest node that can be reached.

    Links with a null end or from a node to itself add nothing. Without links the result is empty. The number of rounds
    grows with the logarithm of the longest path; each round's labels are checkpointed. Minima are combined before they
    are shuffled; lookups are plain joins of two shuffles, whose hot nodes and components Spark splits at run time.
    """
    links = links.where("a != b").select("a", "b")
    both = checkpointed(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    moved = not labels.isEmpty()
    while moved:
        offers = both.withColumnRenamed("a", "node").join(labels, "node").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("offer"))
        lower = labels.join(offers, "node").select("node", F.col("component").alias("was"), F.least("component", "offer").alias("component"))
        over = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        after = checkpointed(lower.join(over, "component").select("node", "was", F.least("component", "next").alias("component")))
        moved = not after.where("component < was").isEmpty()
        labels = after.drop("was")
    return labels


def met_in_postings(rows: DataFrame, extra: str = "", good: Callable[[tuple, tuple], np.ndarray] | None = None) -> DataFrame:
    """a, b of members that meet in a posting of up to LARGE members; key, a and the extra columns, with b null, of members
    of larger ones. rows: key, id (both long), then the columns that `extra` declares, all numbers.

    good: whether pairs are worth a look, from the extra columns of both. Postings come sorted, one after the other; of a
    large one no more than a batch is held."""
    names = [x.split()[0] for x in extra.split(",") if x]
    fields = ["key", "a", "b", *names]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * (2 + len(names))
        kinds: list[pa.DataType] = []
        over = None  # the key of a posting already known to be large
        for batch in chain(batches, (None,)):
            if batch is not None:
                kinds = [batch.schema.field(x).type for x in names]
                held = [np.concatenate((h, c.to_numpy().astype(np.int64))) for h, c in zip(held, batch.columns, strict=True)]
            key = held[0]
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            lengths = np.diff(np.append(starts, len(key)))
            big = lengths > LARGE
            if over is not None and key[0] == over:
                big[0] = True
            whole = np.ones(len(starts), bool)
            whole[-1] = batch is None or bool(big[-1])  # else the last posting may go on
            large = np.repeat(big, lengths)
            if large.any():
                some = [h[large] for h in held]
                yield pa.RecordBatch.from_arrays([pa.array(some[0]), pa.array(some[1]), pa.nulls(len(some[0]), pa.int64()), *(pa.array(x, k) for x, k in zip(some[2:], kinds, strict=True))], names=fields)
            over = key[-1] if big[-1] else None
            ids = held[1]
            for size in np.unique(lengths[whole & ~big & (lengths > 1)]):
                first = starts[whole & ~big & (lengths == size)]
                i, j = np.triu_indices(size, 1)
                step = max(1, (1 << 18) // len(i))
                for k in range(0, len(first), step):
                    x = (first[k : k + step, None] + i).ravel()
                    y = (first[k : k + step, None] + j).ravel()
                    near = ids[x] != ids[y]
                    if good:
                        near &= good(tuple(h[x] for h in held[2:]), tuple(h[y] for h in held[2:]))
                    a, b = ids[x[near]], ids[y[near]]
                    none = pa.nulls(len(a), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *(none.cast(k) for k in kinds)], names=fields)
            held = [h[len(key) if whole[-1] else starts[-1] :] for h in held]

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(meet, f"key long, a long, b long{', ' * bool(extra)}{extra}")


def starred_in_postings(rows: DataFrame) -> DataFrame:
    """key, a, before, b (a <= before < b): in each posting of rows (key, id, both long) a row for each member but the
    smallest, with the smallest and the one before it, so that pairs grow with the members. Postings of any size are read
    batch by batch."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)  # key, smallest and last id of the posting that may go on
        for batch in batches:
            key, b = (np.concatenate((h, c.to_numpy())) for h, c in zip(held[[0, 2]], batch.columns, strict=True))
            begins = np.append(True, key[1:] != key[:-1])[: len(key)]
            least = np.append(held[1], b[held.shape[1] :])[begins][np.cumsum(begins) - 1]
            before = np.append(b[:1], b[:-1])
            star = ~begins & (b != before)
            yield pa.RecordBatch.from_arrays([pa.array(x[star]) for x in (key, least, before, b)], names=["key", "a", "before", "b"])
            held = np.array([key[-1:], least[-1:], b[-1:]])

    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(meet, "key long, a long, before long, b long")


def tallied_pairs(met: DataFrame, tally: Column) -> DataFrame:
    """a, b and the tally over the postings in which they meet, from a stored table of `starred_in_postings`."""
    pairs = met.select("key", "a", "b").union(met.where("before != a").select("key", F.col("before").alias("a"), "b"))
    return pairs.groupBy("a", "b").agg(tally)


def contracted(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) between the components of their ends, each once. labels: node, component; other nodes are their own."""
    a, b = (labels.select(F.col("node").alias(k), F.col("component").alias(f"{k}_c")) for k in "ab")
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))
    return ends.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked_in_postings(large: DataFrame, links: DataFrame, extra: list[str], near: Callable[[dict, dict], Column], verify: Callable[[DataFrame], DataFrame], last: DataFrame | None = None, last_near: Callable[[dict, dict], Column] | None = None) -> DataFrame:
    """links (a, b) and more of them, between members of the large postings (key, id, extra columns), enough to have the same
    components as all verified pairs of members for which `near` holds of the extra columns.

    In each round the members outside a posting's largest component are compared with one member of it, a different one
    for each posting and round, until a round links few of them; then only the pairs are left that no links join yet, and
    these are all verified. Between rounds only the components that new links join are labelled anew.
    last (id, more columns), last_near: wide columns that only the last step looks at, so that rounds don't carry them, and what
    must hold of them besides.
    """
    columns = ["id", *extra]
    own, other = {k: F.col(k) for k in extra}, {k: F.col(f"x_{k}") for k in extra}
    pair = [F.least("x_id", "id").alias("a"), F.greatest("x_id", "id").alias("b")]
    labels = components(links).withColumnRenamed("node", "id")
    state = stored(large.join(labels, "id", "left").select("key", *columns, F.coalesce("component", "id").alias("c")), "large")
    for turn in count():
        shares = state.groupBy("key", "c").agg(F.count("*").alias("members"), F.min_by(F.struct(*columns), F.xxhash64("key", "id", F.lit(turn))).alias("one"))
        main = shares.groupBy("key").agg(F.max_by(F.struct("c", "one"), F.struct("members", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        main = checkpointed(main.select("key", F.col("main.c").alias("main"), *(F.col(f"main.one.{k}").alias(f"x_{k}") for k in columns)))
        offers = state.join(main, "key").where((F.col("c") != F.col("main")) & (F.col("id") != F.col("x_id")) & near(other, own)).select(*pair).distinct()
        offers = stored(offers, "offers")
        found = verify(offers)
        if found.count() <= FEW * offers.count():
            break
        links = links.union(found)
        of = state.select("id", "c").distinct()
        joined = found.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        moved = components(joined).toDF("c", "root")
        before, state = state, stored(state.join(moved, "c", "left").select("key", *columns, F.coalesce("root", "c").alias("c")), "large")
        dropped(before)
    links = links.union(found)
    own_c = state.select(F.col("id").alias("node"), F.col("c").alias("component")).distinct()
    rest = state.join(main.select("key", "main"), "key").where("c != main")
    both = near(other, own)
    if last is not None:
        wide = [k for k in last.columns if k != "id"]
        in_mixed = state.join(rest.select("key").distinct(), "key", "left_semi")
        rest, state = rest.join(last, "id"), in_mixed.join(last, "id")
        columns = [*columns, *wide]
        both &= last_near({k: F.col(f"x_{k}") for k in wide}, {k: F.col(k) for k in wide})
    rest = rest.select("key", *(F.col(k).alias(f"x_{k}") for k in (*columns, "c")))
    apart = rest.join(state, "key").where((F.col("x_c") != F.col("c")) & both).select(*pair).distinct()
    return links.union(contracted(verify(apart), own_c))
