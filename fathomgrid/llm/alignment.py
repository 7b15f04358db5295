"""Cross-tokenizer alignment with an identity-map fast path.

Tokens of A (byte-level) and B (pieces) for the same bytes are cut into groups wherever both end. A group of one token each
holds tokens of the same bytes; a table from A's ids to the B ids of the same bytes tells such pairs, and a vector as long
as A's vocabulary counts the documents that hold them. Only pairs of other groups are shuffled: each block of texts, a
bounded run of a task's rows, gives its distinct pairs and their numbers of documents, which are added up by pair; each
block gets back the totals of its own pairs, and its documents their sums. So what is shuffled grows with the pairs of
blocks, not of documents, and only vectors of A's vocabulary are broadcast.

Text is encoded by its distinct segments, cut where a blank or line end follows something that isn't one: neither
tokenizer has tokens across such places, as is checked for B's pieces; A's splitting pattern ends its pieces there. A
segment's groups and links are worked out once for all its copies among some MB of text.

Defined cases: a null or empty text, or one whose pieces don't spell it (B takes U+2581 for a blank), has no tokens: zeros
and an empty string. Strings of special tokens are plain text. A text of any length is read to its end, in parts. Repeated
rows are documents of their own; null and repeated ids are ordinary values. Pairs with equal counts are all the best of
their A id. An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import stored, sums

#: Characters of texts that are encoded at a time, that one call of B's library gets, and of a block.
PART, CALL, BLOCK = 1 << 21, 1 << 16, 1 << 23
#: Distinct segments whose groups a worker keeps.
KNOWN = 250_000
#: A segment: blanks, then all up to a blank or line end that follows something else.
_SEGMENT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
DOC, PAIR, SAME = range(3)


class Tokenizers:
    """Both tokenizers of a worker, the bytes of their tokens, and the B id of each A id's bytes (or -1)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self._encode_a, a_bytes = _byte_level(a_path)
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        b_bytes = [bytes([int(x[3:-1], 16)]) if self._b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        #: Whether B has no token across the cuts between segments.
        self.cuts = not any("\n" in x or "▁" in x.lstrip("▁") for i, x in enumerate(names) if not self._b.is_byte(i))
        self.bytes = a_bytes, b_bytes
        self.lengths = tuple(np.array([len(x) for x in side], np.int64) for side in self.bytes)
        self.sizes = len(a_bytes), len(b_bytes)
        of = {x: i for i, x in reversed(list(enumerate(b_bytes))) if not (self._b.is_byte(i) or self._b.is_control(i) or self._b.is_unknown(i))}
        self.same = np.array([of.get(x, -1) for x in a_bytes], np.int64)
        #: Decimal ids with what follows them: a comma, or a bar after a group's last A, a semicolon after its last B.
        self.strings = [f"{i}{end}".encode() for n, ends in zip(self.sizes, (",|", ",;"), strict=True) for end in ends for i in range(n)]
        self.widths = np.array([len(x) for x in self.strings], np.int64)

    def _alone(self, segment: str) -> tuple[list[int], list[int]]:
        """Ids of one segment. B puts a blank before what it gets, so it gets a filler, or all but the first blank of a whole text."""
        b = self._b.encode("a" + segment)[1:] if self.cuts else self._b.encode(segment[1:])
        return self._encode_a([segment])[0], b

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids and B's ids of all segments, in which order of the segments, their lengths in bytes, and which of them a
        side doesn't spell. Of those both sides have no ids, and the length is 0."""
        data = [x.encode() for x in segments]
        size = np.array(list(map(len, data)), np.int64)
        whole = [i for i, x in enumerate(segments) if self.cuts and not x[-1].isspace()]
        alone = sorted(set(range(len(segments))) - set(whole))
        order = np.array(whole + alone, np.int64)
        runs, run, n = [], [" a"], 0  # a filler before each run, so that B's blank stands before it
        for i in whole:
            if n > CALL:
                runs.append("".join(run))
                run, n = [" a"], 0
            run.append(segments[i])
            n += len(segments[i])
        runs.append("".join(run))
        ids_a, ids_b = self._encode_a(runs), self._b.encode([x[1:] for x in runs], num_threads=1)
        fits = all(self.bytes[0][x[0]] == self.bytes[1][y[0]] == b" a" for x, y in zip(ids_a, ids_b, strict=True))
        ids_a, ids_b = [x[1:] for x in ids_a], [x[1:] for x in ids_b]
        spelt = b"".join([data[i] for i in whole]) if fits else b""
        fits = fits and all(b"".join(map(side.__getitem__, chain.from_iterable(found))) == spelt for side, found in zip(self.bytes, (ids_a, ids_b), strict=True))
        if not fits:  # some segment isn't spelt by its pieces: find out which
            order, alone, ids_a, ids_b = np.arange(len(segments)), range(len(segments)), [], []
        bad = np.zeros(len(segments), bool)
        for i in alone:
            a, b = self._alone(segments[i])
            if any(b"".join([side[t] for t in ids]) != data[i] for side, ids in zip(self.bytes, (a, b), strict=True)):
                bad[i], size[i], a, b = True, 0, [], []
            ids_a.append(a)
            ids_b.append(b)
        a, b = (np.array(list(chain.from_iterable(ids)), np.int64) for ids in (ids_a, ids_b))
        return a, b, order, size, bad


def _byte_level(path: str):
    """An encoder of lists of texts and the bytes of each id, for a byte-level tokenizer file.

    Where the ids of merges are their ranks, as usual, the rank library is many times faster than the file's own and gives the same ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    added = {x["content"] for x in spec["added_tokens"]}
    names = [""] * (max([*vocabulary.values(), *(x["id"] for x in spec["added_tokens"])]) + 1)
    for name, i in vocabulary.items():
        names[i] = name
    ids = [x["content"].encode() if x["content"] in added else b"" for x in spec["added_tokens"]]
    spelt = [bytes([byte_of[c] for c in x]) if x not in added else x.encode() for x in names]
    for x, content in zip(spec["added_tokens"], ids, strict=True):
        spelt[x["id"]] = content
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in merges]
    pre = spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["model"].get("ignore_merges")
    if plain and all(vocabulary.get(x + y) == 256 + k for k, (x, y) in enumerate(merges)):
        import public_tokenizers
        import tiktoken

        ranks = {spelt[i]: i for x, i in vocabulary.items() if x not in added}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return (lambda texts: [encoding.encode_to_numpy(x, disallowed_special=()).tolist() for x in texts]), spelt
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return (lambda texts: [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]), spelt


@lru_cache(2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


class Groups:
    """Groups, links and texts of distinct segments."""

    def __init__(self, t: Tokenizers, segments: list[str]):
        a, b, order, size, self.bad = t.encode(segments)
        n = len(segments)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        ends_a, ends_b = np.cumsum(t.lengths[0][a]), np.cumsum(t.lengths[1][b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        of_a, of_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        in_a, in_b = np.bincount(of_a, minlength=len(ends)), np.bincount(of_b, minlength=len(ends))
        segment = np.searchsorted(np.cumsum(size[order]), ends)
        #: By segment: tokens of A and B, groups, links.
        self.numbers = np.stack([np.bincount(segment, w, n).astype(np.int64)[back] for w in (in_a, in_b, np.ones(len(ends)), in_a * in_b)], 1)
        # distinct pairs of each group with their numbers, which are products of the ids' numbers in the group
        (ga, ia, ka), (gb, ib, kb) = (_distinct(g, ids, m) for g, ids, m in ((of_a, a, t.sizes[0]), (of_b, b, t.sizes[1])))
        many = np.bincount(gb, minlength=len(ends))
        first = np.cumsum(many) - many
        wide = many[ga]
        at = np.repeat(first[ga] - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
        self.keys, self.times = np.repeat(ia, wide) * t.sizes[1] + ib[at], np.repeat(ka, wide) * kb[at]
        pairs = np.bincount(np.repeat(segment[ga], wide), minlength=n)
        #: Where each segment's pairs begin, and how many they are.
        self.first, self.pairs = (np.cumsum(pairs) - pairs)[back], pairs[back]
        # in the string, a group's A tokens come before its B tokens
        last_a, last_b = (np.append(g[1:] != g[:-1], np.ones(min(1, len(g)), bool)) for g in (of_a, of_b))
        place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[of_a]
        place_b = np.arange(len(b)) + np.cumsum(in_a)[of_b]
        string = np.empty(len(a) + len(b), np.int64)
        string[place_a] = a + t.sizes[0] * last_a
        string[place_b] = 2 * t.sizes[0] + b + t.sizes[1] * last_b
        whole = b"".join(map(t.strings.__getitem__, string.tolist()))
        stop = np.concatenate(([0], np.cumsum(t.widths[string])))[np.concatenate(([0], np.cumsum(np.bincount(segment, in_a + in_b, n).astype(np.int64))))]
        self.strings = [whole[x:y] for x, y in zip(stop[:-1][back].tolist(), stop[1:][back].tolist(), strict=True)]

    def extend(self, more: Groups) -> None:
        more.first += len(self.keys)
        for name in ("bad", "numbers", "keys", "times", "first", "pairs"):
            setattr(self, name, np.concatenate((getattr(self, name), getattr(more, name))))
        self.strings += more.strings


class Segments:
    """The segments that a worker has met, up to about KNOWN of them, and their groups."""

    def __init__(self, t: Tokenizers):
        self.t = t
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = defaultdict(count().__next__)
        self.groups = Groups(self.t, [])

    def codes(self, texts: list[str]) -> list[list[int]]:
        """The numbers of the segments of each text; all are known to `groups` then."""
        if len(self.index) > KNOWN:
            self.clear()
        known = len(self.index)
        lists = [list(map(self.index.__getitem__, _SEGMENT.findall(x) if self.t.cuts else [x])) for x in texts]
        if len(self.index) > known:
            self.groups.extend(Groups(self.t, list(islice(self.index, known, None))))
        return lists


def _distinct(group: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id and number of each distinct id of each group."""
    found, number = np.unique(group * size + ids, return_counts=True)
    return found // size, found % size, number


def _parts(texts: list[str | None], cuts: bool) -> Iterator[list[tuple[int, str]]]:
    """Runs of (row, text with a blank before it) of about PART characters; a longer text comes in parts, if it can be cut."""
    run, n = [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        text, at = " " + text, 0
        while at < len(text):
            cut = _CUT.search(text, at + PART) if cuts and len(text) - at > PART else None
            end = cut.start() if cut else len(text)
            run.append((row, text[at:end]))
            n += end - at
            at = end
            if n >= PART:
                yield run
                run, n = [], 0
    if run:
        yield run


def _merged(row: np.ndarray, key: np.ndarray, times: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key), sorted, with the sums of times."""
    found, which = np.unique(row * most + key, return_inverse=True)
    return found // most, found % most, np.bincount(which, times, len(found)).astype(np.int64)


class Block:
    """Documents of a block: numbers, digests, and distinct pairs with their links."""

    def __init__(self, segments: Segments, texts: list[str | None]):
        t = segments.t
        n, most = len(texts), t.sizes[0] * t.sizes[1]
        numbers = np.zeros((4, n), np.int64)
        digests = [hashlib.sha256() for _ in range(n)]
        pending = [b""] * n
        bad = np.zeros(n, bool)
        found = []
        for run in _parts(texts, t.cuts):
            lists = segments.codes([x for _, x in run])
            g = segments.groups
            rows = np.array([r for r, _ in run], np.int64)
            size = np.array([len(x) for x in lists], np.int64)
            codes = np.array(list(chain.from_iterable(lists)), np.int64)
            row = np.repeat(rows, size)
            for k in range(4):
                numbers[k] += np.bincount(row, g.numbers[codes, k], n).astype(np.int64)
            bad[row[g.bad[codes]]] = True
            for r, x in zip(rows.tolist(), lists, strict=True):
                digests[r].update(pending[r])
                text = b"".join(map(g.strings.__getitem__, x))
                digests[r].update(text[:-1])
                pending[r] = text[-1:]
            at, code, k = _merged(row, codes, np.ones(len(codes)), len(segments.index))
            many = g.pairs[code]
            place = np.repeat(g.first[code] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            found.append(_merged(np.repeat(at, many), g.keys[place], np.repeat(k, many) * g.times[place], most))
        row, key, times = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        if len(row) and (row[1:] < row[:-1]).any() or len(found) > 1:
            row, key, times = _merged(row, key, times, most)  # texts that came in parts
        good = ~bad[row]
        row, self.key, self.times = row[good], key[good], times[good]
        #: Where each document's pairs begin and end.
        self.at = np.searchsorted(row, np.arange(n + 1))
        numbers[:, bad] = 0
        self.numbers = numbers
        self.digests = [d.hexdigest() if k else "" for d, k in zip(digests, numbers[0].tolist(), strict=True)]


_COLUMNS = ["kind", "block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times", "code", "a", "b", "docs"]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of three kinds: documents with their numbers, and pairs as codes; the pairs of each block with their codes and
    numbers of documents; for each A id the number of a task's documents that hold it with the B id of the same bytes.

    The code of a pair of the same bytes is its A id; other pairs of a block are numbered from the size of A's vocabulary on."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a_path, b_path)
        segments = Segments(t)
        n_a, n_b = t.sizes
        block = TaskContext.get().partitionId() << 32
        same = np.zeros(n_a, np.int64)
        id_type = pa.null()

        def rows(kind: int, n: int, **columns: pa.Array) -> pa.RecordBatch:
            types = {"kind": pa.int32(), "doc_id": id_type, "groups_sha256": pa.string(), "codes": pa.list_(pa.int32()), "times": pa.list_(pa.int64()), "code": pa.int32(), "a": pa.int32(), "b": pa.int32()}
            columns |= {"kind": pa.array(np.full(n, kind), pa.int32()), "block": pa.array(np.full(n, block))}
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, types.get(c, pa.int64()))) for c in _COLUMNS], names=_COLUMNS)

        def closed(ids: list[pa.Array], texts: list[str | None]) -> Iterator[pa.RecordBatch]:
            x = Block(segments, texts)
            a, b = x.key // n_b, x.key % n_b
            fast = t.same[a] == b
            np.add(same, np.bincount(a[fast], minlength=n_a), out=same)
            pairs, which, number = np.unique(x.key[~fast], return_inverse=True, return_counts=True)
            codes = a.copy()
            codes[~fast] = n_a + which
            at = pa.array(x.at, pa.int32())
            numbers = dict(zip(_COLUMNS[3:7], map(pa.array, x.numbers), strict=True))
            yield rows(DOC, len(texts), doc_id=pa.concat_arrays(ids), groups_sha256=pa.array(x.digests), codes=pa.ListArray.from_arrays(at, pa.array(codes, pa.int32())), times=pa.ListArray.from_arrays(at, pa.array(x.times)), **numbers)
            yield rows(PAIR, len(pairs), code=pa.array(np.arange(n_a, n_a + len(pairs)), pa.int32()), a=pa.array(pairs // n_b, pa.int32()), b=pa.array(pairs % n_b, pa.int32()), docs=pa.array(number))

        ids: list[pa.Array] = []
        texts: list[str | None] = []
        size = 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            start = 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                texts.append(text)
                size += len(text or "")
                if size >= BLOCK:
                    yield from closed([*ids, batch.column(0).slice(start, i + 1 - start)], texts)
                    block += 1
                    ids, texts, size, start = [], [], 0, i + 1
            ids.append(batch.column(0).slice(start))
        if texts:
            yield from closed(ids, texts)
        held = np.flatnonzero(same)
        if len(held):
            yield rows(SAME, len(held), a=pa.array(held, pa.int32()), docs=pa.array(same[held]))

    return docs.select("doc_id", "text").mapInArrow(align, f"kind int, block long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<int>, times array<long>, code int, a int, b int, docs long")


def _vector(rows: DataFrame, n: int) -> np.ndarray:
    """The values of rows (a, value), one for each A id at most, as a vector."""
    found = rows.toArrow()
    out = np.zeros(n, np.int64)
    out[found.column("a").to_numpy()] = found.column("value").to_numpy()
    return out


def linked(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs (doc_id, text)."""
    import public_tokenizers

    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as f:
        spec = json.load(f)
    n = max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])]) + 1
    table = stored(aligned(docs, a_path, b_path), "aligned")
    pairs = table.where(F.col("kind") == PAIR).select("block", "code", "a", "b", "docs")
    totals = stored(pairs.groupBy("a", "b").agg(F.sum("docs").alias("total")), "pairs")
    same = _vector(table.where(F.col("kind") == SAME).groupBy("a").agg(F.sum("docs").alias("value")).select("a", "value"), n)
    best = np.maximum(same, _vector(totals.groupBy("a").agg(F.max("total").alias("value")).select("a", "value"), n))
    shared = spark.sparkContext.broadcast((same, best))
    counted = pairs.drop("docs").join(totals, ["a", "b"]).select(F.col("block").alias("of"), "code", "a", "total")
    numbers = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    texts = table.where(F.col("kind") == DOC).select("block", *numbers, "groups_sha256", "codes", "times")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        same, best = shared.value
        n = len(same)
        code, a, total = (right.column(c).to_numpy() for c in ("code", "a", "total"))
        count, is_best = np.concatenate((same, np.zeros(len(code), np.int64))), np.concatenate((same == best, np.zeros(len(code), bool)))
        count[code] = total
        is_best[code] = total == best[a]
        codes, times = left.column("codes").combine_chunks(), left.column("times").combine_chunks()
        at = codes.offsets.to_numpy().astype(np.int64)
        codes, times = codes.values.to_numpy()[at[0] : at[-1]], times.values.to_numpy()[times.offsets[0].as_py() : times.offsets[-1].as_py()]
        at = at - at[0]
        return pa.table([*(left.column(c) for c in numbers), pa.array(sums(times * is_best[codes], at)), pa.array(sums(times * count[codes], at)), left.column("groups_sha256")], names=[*numbers, "n_best", "count_sum", "groups_sha256"])

    return texts.groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(add, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
