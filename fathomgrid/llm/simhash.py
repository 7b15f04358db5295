"""Near-duplicates by SimHash and a byte-position inverted index with count filtering.

`linked` is exact: all texts whose 64-bit fingerprints differ in few bits are linked. Two fingerprints that differ in
at most d bits agree in at least 8 - d of their bytes, place by place. A posting of one byte place would hold a 256th of
all texts, so postings are by four byte places at once: for each two of the four pairs of neighbouring places, as two
bits can spoil two pairs at most. The byte places of all postings in which a pair meets are tallied, and of the places
that no posting speaks for those that agree; pairs that reach the guaranteed minimum of 8 - d stay, and their bits are
compared. Postings are joined only while small. The members of a large
posting are linked exactly by another way: each member stands at its fingerprint and at every fingerprint one bit away;
members that meet at a place differ in two bits at most, so a star to the smallest of them gives the same components as
all their pairs.

`near_duplicates` links texts whose word shingles have a Jaccard similarity of 0.8 or more, and is exact as well. Wide
fingerprints of 64 bytes stand in postings by three byte places each; the byte places that a pair shares are tallied, pairs
with enough of them stay, and the similarity of their sets is checked. Fingerprints find nearly all links; what they leave
apart is looked for once more in postings of the rarest shingles of each text (prefix filter), with filters by size, place
and parity, before the same check.

Defined cases: null and empty texts have no shingle and the fingerprint zero, linked like any other. A text of fewer
words than a shingle has one shingle. A null id never names a component unless all ids are null. Equal texts have equal
fingerprints. A text of any length is read whole. A bit set in just half of the hashes is 0. Repeated rows are members like
others. Rows that share an id are taken together: what links one of their texts links the id. `near_duplicates` takes ids
that are whole numbers. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import checkpointed, cleaned, dropped, likely_in, only, stored, utf8, word_bytes
from .graph import LARGE, components, linked_in_postings, met_in_postings, starred_in_postings, tallied_pairs

SEED = 42
#: Differing bits at which fingerprints still link. The choice of blocks and the stars are made for two.
BITS = 2


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of `size` words joined by blanks, repeats included; of all words if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    k = min(size, len(words)) - 1
    return np.array([digest(whole[a : b - 1], SEED) for a, b in zip(starts, ends[k:], strict=False)], np.uint64)


def majority(hashes: np.ndarray, width: int = 1) -> bytes:
    """The fingerprint: a bit is 1 if it is set in over half of the hashes. Wider ones mix each hash again. Little-endian."""
    out = b""
    for k in range(width):
        if k:
            hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes ^= hashes >> np.uint64(32)
        ones = np.zeros(64, np.int64)
        for a in range(0, len(hashes), 1 << 14):
            ones += np.unpackbits(hashes[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        out += np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, bits (the 64-bit fingerprint as a long) of each row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [int.from_bytes(majority(shingle_hashes(word_bytes(t), words)), "little", signed=True) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int64())], names=["doc_id", "bits"])

    return docs.select("doc_id", "text").mapInArrow(hashed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, bits long")


def _byte(x: Column, k: int) -> Column:
    return F.shiftrightunsigned(x, 8 * k).bitwiseAND(0xFF)


def tally(x: Column, y: Column, places: Column) -> Column:
    """How many bytes agree, place by place: those at `places`, known from postings, and of the others those found equal."""
    apart = x.bitwiseXOR(y)
    others = [F.when((places.bitwiseAND(1 << k) == 0) & (_byte(apart, k) == 0), 1).otherwise(0) for k in range(8)]
    return sum(others, F.bit_count(places))


def links(bits: DataFrame) -> DataFrame:
    """a, b: links between the distinct values of `bits` that differ in one or two bits, enough of them to have the
    same components as all such links."""
    distinct = checkpointed(bits.select("bits").where("bits is not null").distinct())
    # 2 differing bits leave two of four blocks of two bytes untouched
    choices = [0b11 << (2 * i) | 0b11 << (2 * j) for i, j in combinations(range(4), 2)]  # of byte places
    masks = [sum(0xFF << (8 * k) for k in range(8) if c >> k & 1) for c in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(c).alias("places"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for c, m in zip(choices, signed, strict=True)))
    postings = distinct.select("bits", F.explode(keys).alias("p")).select("bits", "p.places", "p.key")
    sizes = postings.groupBy("places", "key").agg(F.count("*").alias("members")).where("members > 1")
    postings = stored(postings.join(sizes, ["places", "key"]), "postings")
    small = postings.where(F.col("members") <= LARGE)
    x = small.select("places", "key", F.col("bits").alias("a"))
    y = small.select("places", "key", F.col("bits").alias("b"))
    met = x.join(y, ["places", "key"]).where("a < b").groupBy("a", "b").agg(F.bit_or("places").alias("places"))
    pairs = met.where((tally(F.col("a"), F.col("b"), F.col("places")) >= 8 - BITS) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)).select("a", "b")
    members = postings.where(F.col("members") > LARGE).select("bits").distinct()
    flips = [1 << k if k < 63 else -(1 << 63) for k in range(64)]
    places = members.select("bits", F.explode(F.array("bits", *(F.col("bits").bitwiseXOR(F.lit(m)) for m in flips))).alias("place"))
    first = places.groupBy("place").agg(F.min("bits").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = places.join(first, "place").where("bits != a").select("a", F.col("bits").alias("b"))
    return pairs.union(stars).distinct()


def linked(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of each row: fingerprints link at two or fewer differing bits."""
    bits = stored(fingerprints(docs, words), "fingerprints")
    owners = bits.groupBy("bits").agg(F.min("doc_id").alias("first"))
    labels = components(links(bits))
    named = labels.join(owners, labels["node"] == owners["bits"]).select("node", "component", "first")
    lowest = named.groupBy("component").agg(F.min("first").alias("lowest"))
    found = checkpointed(named.join(lowest, "component").select("node", "lowest"))
    ids = owners.join(found, owners["bits"] == found["node"], "left").select("bits", F.coalesce("lowest", "first").alias("component_id"))
    ids = stored(ids, "components")  # both sides of the last join are plain shuffles, so that Spark can split a hot fingerprint
    return bits.join(ids, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


#: Of `near_duplicates`: words in a shingle, and the buckets by whose counts shingles are ordered.
WORDS, ORDER_BUCKETS = 5, 1 << 18
#: Its fingerprints: words in a shingle, longs, choices of three byte places that postings are by, and bytes that the
#: fingerprints of a pair share at least. Of random pairs of check_s 99.9 % share three at most, of its
#: 9,011 alike pairs all share 16.
PRINT_WORDS, PRINT, SHARED = 2, 8, 12
_rng = np.random.default_rng(1)
CHOICES = np.array([_rng.choice(8 * PRINT, 3, replace=False) for _ in range(64)])
#: Longs of parities of a text's shingles: they rule out most unlike pairs of large postings, and no alike one.
PARITY = 8


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 18)).astype(np.int64)


def _frequencies(docs: DataFrame, words: int) -> np.ndarray:
    """How many texts' shingles fall into each bucket. It only orders shingles, so that buckets may be shared."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(ORDER_BUCKETS, np.int64)
        for batch in batches:
            found = [_bucket(np.unique(shingle_hashes(word_bytes(t), words))) for t in utf8(batch.column(0))]
            if found:
                tally += np.bincount(np.concatenate(found), minlength=ORDER_BUCKETS)
        at = np.flatnonzero(tally)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(tally[at], pa.int64())})

    rows = docs.select("text").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ORDER_BUCKETS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def prefix_length(n: int, least: float) -> int:
    """Of n ordered shingles, so many of the first that a set of similarity `least` or more has one of them in its own prefix."""
    return n - math.ceil(least * n - 1e-9) + 1


def _sketches(docs: DataFrame, words: int, least: float) -> DataFrame:
    """doc_id, same (128-bit digest of the lower-cased words), n (distinct shingles), prefix (the rarest of them), parity (of
    the shingles in each of 64 * PARITY buckets, as bits), print (the fingerprint)."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, words))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        for batch in batches:
            same, n, prefix, parity, prints = [], [], [], [], []
            for t in utf8(batch.column(1)):
                w = word_bytes(t)
                hashes = np.unique(shingle_hashes(w, words))
                same.append(xxhash.xxh3_128_digest(b"\n".join(w)))
                n.append(len(hashes))
                order = np.argsort(frequency[_bucket(hashes)], kind="stable")[: prefix_length(len(hashes), least)] if len(hashes) else []
                prefix.append(hashes[order].view(np.int64) if len(hashes) else hashes.view(np.int64))
                parity.append(parities(hashes))
                prints.append(np.frombuffer(majority(shingle_hashes(w, PRINT_WORDS), PRINT), np.int64))
            longs = (pa.array(x, pa.list_(pa.int64())) for x in (prefix, parity, prints))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(n, pa.int32()), *longs], names=["doc_id", "same", "n", "prefix", "parity", "print"])

    return docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, same binary, n int, prefix array<long>, parity array<long>, print array<long>")


def by_fingerprint(prints: DataFrame) -> DataFrame:
    """a, b (a < b) of a stored table (id, print): pairs that meet in a posting and share SHARED bytes or more.

    In a posting each member meets the smallest and the one before it, so that pairs grow with the members."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(1).flatten().to_numpy().view(np.uint8).reshape(-1, 8 * PRINT)
            keys = np.full((len(bits), len(CHOICES)), np.arange(len(CHOICES), dtype=np.int64))
            for k in range(CHOICES.shape[1]):
                keys = keys << 8 | bits[:, CHOICES[:, k]]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(len(bits)), len(CHOICES))))], names=["key", "id"])

    masks = np.array([sum(1 << int(k) for k in c) for c in CHOICES], np.uint64).view(np.int64).tolist()
    met = stored(starred_in_postings(prints.select("id", "print").mapInArrow(posted, "key long, id long")), "met")
    cleaned(prints.sparkSession)
    places = F.get(F.array(*map(F.lit, masks)), F.shiftright("key", 8 * CHOICES.shape[1]).cast("int"))
    met = tallied_pairs(met, F.bit_or(places).alias("places"))
    x, y = (prints.select(F.col("id").alias(k), F.col("print").alias(f"{k}_print")) for k in "ab")
    byte = lambda k: F.shiftrightunsigned("places", 8 * k).bitwiseAND(0xFF)
    shared = sum((tally(F.get("a_print", F.lit(k)), F.get("b_print", F.lit(k)), byte(k)) for k in range(PRINT)), F.lit(0))
    return met.join(x, "a").join(y, "b").where(shared >= SHARED).select("a", "b")


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY buckets whether it holds an odd number of the hashes, as bits of PARITY longs. Two sets differ
    by as many members at least as their bits do."""
    odd = np.bincount((hashes & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _parities_allow(least: float, n: Column, m: Column, x: Column, y: Column) -> Column:
    """Whether sets of n and m shingles with these parities can have similarity `least`."""
    apart = sum((F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(PARITY)), F.lit(0))
    return apart * (1 + least) <= (1 - least) * (n + m) + 1e-6


def _reach(least: float, n, m, i, j, lesser, greater):
    """Whether sets of n and m shingles whose first common one is at the places i and j can have similarity `least`."""
    return (lesser(n, m) >= least * greater(n, m) - 1e-6) & ((1 + least) * lesser(n - i, m - j) >= least * (n + m) - 1e-6)


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, shingles (sorted distinct hashes) of the rows of the given ids."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(word_bytes(t), words)).view(np.int64) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    some = only(docs.select("doc_id", "text"), "doc_id", ids)
    return some.join(ids, some["doc_id"] == ids["id"], "left_semi").mapInArrow(hashed, "id long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    pairs = stored(pairs.select("a", "b").distinct(), "compared")
    left, right = (only(sets, "id", pairs.select(k)).select(F.col("id").alias(k), F.col("shingles").alias(f"{k}_set")) for k in "ab")
    common = F.size(F.array_intersect("a_set", "b_set"))
    alike = pairs.join(left, "a").join(right, "b").where(common >= least * (F.size("a_set") + F.size("b_set") - common))
    out = stored(alike.select("a", "b"), "verified")
    dropped(pairs)
    cleaned(pairs.sparkSession)
    return out


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs whose ends links haven't joined."""
    labels = components(links)
    a, b = (labels.select(F.col("node").alias(k), F.col("component").alias(f"{k}_c")) for k in "ab")
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("a_c", "a") != F.coalesce("b_c", "b")).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links among candidate pairs (a < b, stored), enough of them to have the same components as all.

    Sets travel with the pairs that are compared, so first each text meets its smallest partner only; of the other pairs
    those are compared whose ends these links haven't joined."""
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = _verified(first, sets, least)
    rest = _apart(pairs, links).join(first, ["a", "b"], "left_anti")
    return links.union(_verified(rest, sets, least))


def _similar(docs: DataFrame, owners: DataFrame, words: int, least: float) -> DataFrame:
    """node, component of the links between texts of similarity `least` or more.

    Fingerprints find nearly all of them. Two such texts share a shingle of their prefixes, so that each pair meets in a
    posting of shingles as well, and no link is lost."""
    prints = stored(owners.select("id", "n", "parity", "print"), "prints")
    m = prints.select("id", F.col("n").alias("m"), "parity")
    ends = [m.select(*(F.col(c).alias(f"{k}_{c}") for c in m.columns)) for k in "ab"]
    odd = lambda x, y: _parities_allow(least, x["m"], y["m"], x["parity"], y["parity"])

    def allowed(p: DataFrame) -> DataFrame:
        p = p.join(ends[0], F.col("a") == F.col("a_id")).join(ends[1], F.col("b") == F.col("b_id"))
        return p.where(odd(*({c: F.col(f"{k}_{c}") for c in ("m", "parity")} for k in "ab"))).select("a", "b")

    alike = stored(allowed(by_fingerprint(prints)), "alike")
    cleaned(docs.sparkSession)
    rows = owners.select("id", "n", F.posexplode("prefix").alias("place", "key")).select("key", "id", "place", "n")
    met = met_in_postings(rows, "place int, n int", lambda x, y: _reach(least, x[1], y[1], x[0], y[0], np.minimum, np.maximum))
    met = stored(met, "met")
    cleaned(docs.sparkSession)
    large = stored(met.where("b is null").select("key", F.col("a").alias("id"), "place", "n"), "large")
    pairs = stored(allowed(met.where("b is not null").select("a", "b").distinct()), "candidates")
    dropped(met)
    cleaned(docs.sparkSession)
    ids = pairs.union(alike).select(F.explode(F.array("a", "b")).alias("id")).union(large.select("id")).distinct()
    sets = stored(_sets(docs, ids, words), "sets")
    links = _linked(alike, sets, least)
    missed = stored(_apart(pairs, links), "missed")
    links = links.union(_linked(missed, sets, least))
    cleaned(docs.sparkSession)
    if not large.isEmpty():
        near = lambda x, y: _reach(least, x["n"], y["n"], x["place"], y["place"], F.least, F.greatest)
        links = linked_in_postings(large, links, ["place", "n"], near, lambda p: _verified(allowed(p), sets, least), m, odd)
    labels = components(links)
    dropped(large, prints, alike, pairs, missed, sets)
    cleaned(docs.sparkSession)
    return labels


def near_duplicates(docs: DataFrame, words: int = WORDS, least: float = 0.8) -> DataFrame:
    """doc_id, component_id, same: texts are linked if their words are equal, or if their sets of word shingles have a Jaccard
    similarity of `least` or more; component_id is the smallest doc_id that links reach.

    Rows whose doc_id is null get the component of their equals, or null.
    """
    sketches = stored(_sketches(docs, words, least), "sketches")
    table = stored(sketches.select("doc_id", "same", "n"), "texts")
    owners = stored(table.where("n > 0").groupBy("same").agg(F.min("doc_id").alias("id")).where("id is not null"), "owners")
    prefixes = sketches.withColumnRenamed("doc_id", "id").join(owners, ["same", "id"]).dropDuplicates(["same", "id"])
    labels = _similar(docs, prefixes, words, least)
    dropped(sketches)
    named = owners.join(labels, owners["id"] == labels["node"], "left").select("same", F.coalesce("component", "id").alias("component_id"))
    empty = table.where("n = 0").groupBy("same").agg(F.min("doc_id").alias("component_id"))
    return table.join(stored(named.union(empty), "components"), "same", "left").select("doc_id", "component_id", "same")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, less all but one of each group of near-duplicates: that of the smallest doc_id.

    Rows that share an id stay or go together. A row without an id goes if its text equals one that has an id.
    """
    found = near_duplicates(docs)
    away = stored(found.where("doc_id != component_id").select("doc_id").distinct(), "away")
    cleaned(docs.sparkSession)
    marked = likely_in(docs, "doc_id", away)  # rows that surely stay aren't shuffled
    kept = marked.where("not __likely").unionByName(marked.where("__likely").join(away, "doc_id", "left_anti"))
    if not docs.schema["doc_id"].nullable or docs.where("doc_id is null").isEmpty():
        return kept.select(*docs.columns)
    digests = found.where("doc_id is not null").select(F.hex("same").alias("__same")).distinct()
    nameless = _with_digest(docs.where("doc_id is null")).join(digests, "__same", "left_anti")
    return kept.where("doc_id is not null").select(*docs.columns).unionByName(nameless.dropDuplicates(["__same"]).select(*docs.columns))


def _with_digest(docs: DataFrame) -> DataFrame:
    """docs and __same, the digest of a text's words in hexadecimal."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [xxhash.xxh3_128_digest(b"\n".join(word_bytes(t))).hex().upper() for t in utf8(batch.column("text"))]
            yield batch.append_column("__same", pa.array(same, pa.string()))

    return docs.mapInArrow(digest, StructType([*docs.schema.fields, StructField("__same", StringType())]))
