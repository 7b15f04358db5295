"""Document fingerprints by randomised edit embedding.

A pointer walks over a text's characters; at step j it stays or moves on, as a table of shared random bits says for j and
the character under it. The characters passed, step by step, are the embedded string: texts at a small edit distance get
strings at a small Hamming distance, as the walks meet again after an edit. A fingerprint samples the embedded string at
each 2**level-th step, four bits of the character each; the level grows with the length, so that some hundred samples
cover the whole text, and the samples of a level contain those of the next. Likeness is the share of equal samples.

`classes` bands fingerprints by sampled digits. Places are drawn over a span of samples; a fingerprint has bands for the
longest two spans that it fills, at its own level and, near the upper end of a level, at the next, so that two fingerprints
whose numbers of samples are within a fifth share a span and all of its places. In a band each member meets the smallest
and the one before it; of all that it meets it is compared with the smallest and with the one of most bands. Then come all
members of a small band that these links haven't joined.
In a large one they are compared with one member, another for each band and round, until a round links no more; what is
left apart there is compared pair by pair if 64 sampled bits of both are near enough. Likeness verifies each pair.

Walks of many texts advance together in numpy; the last and longest ones go on alone. Equal texts have equal fingerprints.

Defined cases: a null or empty text has the fingerprint of no samples, which is like itself (1) and unlike others (0).
Null ids come after all others; rows of equal id are ordered by text. The document next to the last is the first, so that
a single document is next to itself. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cleaned, dropped, likely_in, n_partitions, only, stored
from .graph import components, contracted, linked_in_postings, met_in_postings, starred_in_postings, tallied_pairs

SAMPLES = 512
#: Steps after which the shared random bits repeat.
PERIOD = 4096
#: Characters that are walked together, about.
GROUP = 3_000_000
#: Walks that are too few to go on together.
FEW = 40

_rng = np.random.default_rng(20240229)
#: 1 where the walk moves on, by step and character code; code 0 ends a text, and there it stays.
MOVES = _rng.integers(0, 2, (PERIOD, 256), dtype=np.uint8)
MOVES[:, 0] = 0
_ROWS = [r.tobytes() for r in MOVES]
_NIBBLES = _rng.integers(0, 16, 256, dtype=np.uint8)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)[_NIBBLES]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes 1 to 255 of all characters, each text followed by a 0; where texts begin."""
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = ((points * np.uint32(0x9E3779B1)) >> np.uint32(15)) % np.uint32(255) + np.uint32(1)
    codes = codes.astype(np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    codes[begins[1:] - 1] = 0
    return codes, begins[:-1]


def level_of(n: int) -> int:
    return max(0, (2 * n - 1).bit_length() - (SAMPLES - 1).bit_length()) if n else 0


def _alone(codes: bytes, at: int, step: int, level: int, out: list[int]) -> None:
    """Goes on with one walk from a step that is sampled."""
    rows, stride = _ROWS, 1 << level
    while c := codes[at]:
        out.append(c)
        k = step % PERIOD
        if stride <= PERIOD - k:
            for row in rows[k : k + stride]:
                at += row[codes[at]]
        else:
            for j in range(step, step + stride):
                at += rows[j % PERIOD][codes[at]]
        step += stride


def _fingerprints(texts: list[str]) -> list[str]:
    codes, begins = _codes(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    levels = np.array([level_of(int(n)) for n in lengths], np.int64)
    order = np.lexsort((lengths, levels))[::-1]  # by level from high to low
    order = order[lengths[order] > 0]
    room = 2 * SAMPLES
    samples = np.zeros((len(texts), room), np.uint8)
    rest: dict[int, list[int]] = {}
    at, step = begins[order], 0
    block = 1 << int(levels.max()) if len(levels) else 1
    while len(order):
        here = levels[order]
        first = np.searchsorted(-here, -np.arange(64), "left").tolist()  # by v: the first text whose level is v or less
        if len(order) <= FEW and step % block == 0:
            for i, a in zip(order.tolist(), at.tolist(), strict=True):
                _alone(codes[begins[i] : begins[i] + lengths[i] + 1].tobytes(), a - int(begins[i]), step, int(levels[i]), rest.setdefault(i, []))
            break
        for _ in range(64):
            c = codes.take(at)
            a = first[min(63, (step & -step).bit_length() - 1)] if step else 0
            if a < len(order):
                slot = step >> here[a:]
                who = order[a:]
                fits = slot < room
                if not fits.all():
                    who, slot, cut = who[fits], slot[fits], c[a:][fits]
                else:
                    cut = c[a:]
                samples[who, slot] = cut
            at += MOVES[step % PERIOD].take(c)
            step += 1
        going = codes.take(at) > 0
        if not going.all():
            order, at = order[going], at[going]
    taken = (samples > 0).argmin(1)
    full = samples.all(1)
    out = []
    hexed = _HEX[samples]
    for i, level in enumerate(levels.tolist()):
        n = room if full[i] else int(taken[i])
        more = _HEX[np.array(rest[i], np.uint8)].tobytes().decode() if i in rest else ""
        out.append(f"{level:x}:" + hexed[i, :n].tobytes().decode() + more)
    return out


def fingerprints_of(texts: list[str | None]) -> list[str]:
    """The fingerprint of each text: the level in hexadecimal, a colon, and a hexadecimal digit for each sample."""
    texts, out, a = [t or "" for t in texts], [], 0
    while a < len(texts):
        b, n = a, 0
        while b < len(texts) and (b == a or n + len(texts[b]) <= GROUP):
            n += len(texts[b])
            b += 1
        out += _fingerprints(texts[a:b])
        a = b
    return out


def likeness(a: str, b: str) -> float:
    """The share of equal samples, at the coarser of both levels."""
    if a == b:
        return 1.0
    (i, x), (j, y) = a.split(":"), b.split(":")
    i, j = int(i, 16), int(j, 16)
    if i < j:
        x = x[:: 1 << (j - i)]
    elif j < i:
        y = y[:: 1 << (i - j)]
    n = max(len(x), len(y))
    m = min(len(x), len(y))
    if not m:
        return 0.0
    x, y = np.frombuffer(x[:m].encode(), np.uint8), np.frombuffer(y[:m].encode(), np.uint8)
    return int((x == y).sum()) / n


def edited(text: str, following: str) -> str:
    """The last half of the text's characters replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, ghost, doc_id, text) in parts that are runs of descending doc_id, sorted; one part to a partition.

    A part ends at a row of an id that was drawn as a border; the border rows, one id for each part, come once more as
    the ghost at the end of the part before, so that each row's next document is in its own part.
    """
    n = n_partitions(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    drawn = docs.select(F.percentile_approx(key, [i / n for i in range(1, n + 1)], 10_000).alias("at"), F.max(key).alias("top")).first()
    borders = sorted({*(drawn["at"] or []), *([] if drawn["top"] is None else [drawn["top"]])})
    ends = np.array(borders, np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            part = np.searchsorted(ends, keys, "left")
            ghosts = np.flatnonzero(ends[part] == keys)
            rows = np.concatenate((np.arange(len(keys)), ghosts))
            to = np.concatenate((part, (part[ghosts] + 1) % len(ends))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.arange(len(rows)) >= len(keys)), batch.column(1).take(pa.array(rows)), batch.column(2).take(pa.array(rows))], names=["part", "ghost", "doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select(key.alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(deal, f"part int, ghost boolean, doc_id {kind}, text string")
    return dealt.repartitionById(max(1, len(borders)), F.col("part")).sortWithinPartitions("part", "ghost", F.desc_nulls_last("doc_id"), "text")


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows whose next is not known yet: one at most
        for batch in batches:
            rows = held + list(zip(batch.column("ghost").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True))
            held = rows[-1:]
            a = 0
            while a < len(rows) - 1:
                b, n = a + 1, len(rows[a][2])
                while b < len(rows) - 1 and n + len(rows[b][2]) <= GROUP // 2:
                    n += len(rows[b][2])
                    b += 1
                some = rows[a : b + 1]
                if some[0][0]:  # only ghosts come now
                    break
                texts = [r[2] for r in some]
                edits = [edited(t, u) for t, u in zip(texts, texts[1:], strict=False)]
                prints = fingerprints_of(texts + edits)
                own, other = prints[: len(texts)], prints[len(texts) :]
                some = [r for r in some[:-1] if not r[0]]
                k = len(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[1] for r in some], batch.schema.field("doc_id").type),
                        pa.array([len(t) for t in texts[:k]], pa.int64()),
                        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edits[:k]]),
                        pa.array(own[:k]),
                        pa.array(other[:k]),
                        pa.array([likeness(x, y) for x, y in zip(own[:k], other[:k], strict=True)], pa.float64()),
                        pa.array([likeness(x, y) for x, y in zip(own[:k], own[1 : k + 1], strict=True)], pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
                a = b

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_next(docs).mapInArrow(compare, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(batch.column(1).to_pylist()), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(walk, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


#: Bands of a span, and sampled digits in each.
BANDS, DIGITS = 12, 8
#: Each span is so much longer than the one before.
GROWTH = 1.25
#: Samples from which a fingerprint has bands at the next level as well.
UPPER = 0.7 * SAMPLES
#: Of 64 sampled bits so many may differ in a pair from a large band: at a likeness of 0.8 it is 7 on average, and over
#: this in one pair of a million.
NEAR_BITS = 22
SPANS = [max(1, math.floor(GROWTH**k)) for k in range(64)]


@cache
def places(span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of each band's digits in a span, and those of 64 sampled bits with their shifts."""
    rng = random.Random(span)
    n = SPANS[span]
    digits = min(DIGITS, n // 2 + 1)
    bands = np.array([sorted(rng.sample(range(n), digits)) for _ in range(BANDS)])
    return bands, np.array([rng.randrange(n) for _ in range(64)]), np.array([rng.randrange(4) for _ in range(64)], np.uint8)


def spans(fingerprint: str) -> list[tuple[int, int, np.ndarray]]:
    """(level, span, digits) of the spans that a fingerprint has bands for."""
    level, digits = fingerprint.split(":")
    x = np.frombuffer(digits.encode(), np.uint8)
    out = []
    for more in (0, 1) if len(x) >= UPPER else (0,):
        x = x[:: 1 + more]
        top = int(np.searchsorted(SPANS, len(x), "right")) - 1  # spans of one length, of short texts, are one
        top = SPANS.index(SPANS[top]) if len(x) else -1
        out += [(int(level, 16) + more, k, x) for k in {top, SPANS.index(SPANS[top - 1]) if top > 0 else top} if k >= 0]
    return out


def bands(fingerprint: str) -> list[int]:
    """A key for each band: 48 bits of a hash, then the level and the span."""
    out = []
    for level, span, x in spans(fingerprint):
        of = (level << 6 | span) & 0x7FFF
        for k, row in enumerate(x[places(span)[0]]):
            out.append((xxhash.xxh64_intdigest(row.tobytes(), level << 12 | span << 6 | k) >> 16) << 15 | of)
    return out


def sampled_bits(fingerprint: str, key: int) -> int:
    """64 sampled bits of a fingerprint at the level and span of a key, as a signed number."""
    of, (level, span) = key & 0x7FFF, (key >> 6 & 0x1FF, key & 0x3F)
    x = next(x for i, k, x in spans(fingerprint) if (i << 6 | k) & 0x7FFF == of)
    _, at, shifts = places(span)
    digit = np.where(x[at] > 57, x[at] - 87, x[at] - 48)
    return int(np.packbits((digit >> shifts) & 1).view(">i8")[0])


def classes(table: DataFrame, least: float = 0.8) -> DataFrame:
    """fingerprint, class_id, id (its smallest doc_id), n (its rows) of each distinct fingerprint of a stored table (doc_id,
    fingerprint): the class is the smallest doc_id that is reached through pairs of likeness `least` or more that share a band."""
    owners = stored(table.groupBy("fingerprint").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "owners")
    cleaned(table.sparkSession)
    known = owners.where("id is not null").select("fingerprint", "id")
    verify = lambda p: _verified(p, known, least)
    rows = known.withColumn("c", F.col("id")).mapInArrow(_spread, "key long, id long, c long").select("key", "id")
    met = stored(starred_in_postings(rows), "met")
    cleaned(table.sparkSession)
    first = tallied_pairs(met, F.count("*").alias("n")).groupBy("b").agg(F.min("a").alias("x"), F.max_by("a", F.struct("n", -F.col("a"))).alias("y"))
    links = verify(first.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), "b"))
    dropped(met)
    labels = components(links)
    labelled = _labelled(known, labels).select("fingerprint", "id", F.col("component").alias("c"))
    rows = labelled.mapInArrow(_spread, "key long, id long, c long")
    met = stored(met_in_postings(rows, "c long", lambda x, y: x[0] != y[0]), "met")
    cleaned(table.sparkSession)
    large = met.where("b is null").select("key", F.col("a").alias("id"))
    links = links.union(contracted(verify(met.where("b is not null").select("a", "b").distinct()), labels))
    if not large.isEmpty():
        large = stored(large.join(known, "id").mapInArrow(_with_bits, "key long, id long, bits long"), "large")
        links = linked_in_postings(large, links, ["bits"], lambda x, y: F.bit_count(x["bits"].bitwiseXOR(y["bits"])) <= NEAR_BITS, verify)
    return _labelled(owners, components(links)).select("fingerprint", F.col("component").alias("class_id"), "id", "n")


def _labelled(owners: DataFrame, labels: DataFrame) -> DataFrame:
    """owners and the component of their ids, which is the id itself for those that no link reaches."""
    marked = likely_in(owners, "id", labels.select("node"))
    alone = marked.where("not __likely").withColumn("component", F.col("id"))
    rest = marked.where("__likely").join(labels, F.col("id") == labels["node"], "left").drop("node").withColumn("component", F.coalesce("component", "id"))
    return alone.unionByName(rest).drop("__likely")


def _with_class(table: DataFrame, least: float) -> DataFrame:
    """A stored table (doc_id, fingerprint, more columns) and class_id. Rows alone in their class aren't shuffled for it."""
    found = classes(table.select("doc_id", "fingerprint"), least)
    shared = stored(found.where("n > 1 or not class_id <=> id").select("fingerprint", "class_id"), "shared")
    cleaned(table.sparkSession)
    marked = likely_in(table, "fingerprint", shared.select("fingerprint"))
    alone = marked.where("not __likely").withColumn("class_id", F.col("doc_id").cast("long"))
    rest = marked.where("__likely").join(shared, "fingerprint", "left").withColumn("class_id", F.coalesce("class_id", F.col("doc_id").cast("long")))
    return alone.unionByName(rest).select(*table.columns, "class_id")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [bands(x) for x in batch.column("fingerprint").to_pylist()]
        rows = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array([x for k in keys for x in k], pa.int64()), *(batch.column(c).take(pa.array(rows)) for c in ("id", "c"))], names=["key", "id", "c"])


def _with_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sampled_bits(x, k) for x, k in zip(batch.column("fingerprint").to_pylist(), batch.column("key").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(found, pa.int64())], names=["key", "id", "bits"])


def _verified(pairs: DataFrame, owners: DataFrame, least: float) -> DataFrame:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [likeness(x, y) >= least for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = stored(pairs.select("a", "b"), "pairs")
    left, right = (only(owners, "id", pairs.select(k)).select(F.col("id").alias(k), F.col("fingerprint").alias(v)) for k, v in ("ax", "by"))
    out = stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "verified")
    dropped(pairs)
    cleaned(out.sparkSession)
    return out


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, class_id of each row, as `classes` finds them."""
    table = stored(fingerprint_table(docs), "fingerprints")
    return _with_class(table, least).select("doc_id", "class_id")


def fingerprinted(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The columns of `compared`, and class_id."""
    table = stored(compared(docs), "compared")
    cleaned(docs.sparkSession)
    return _with_class(table, least)
