"""Byte-pair encoding and decoding by tree concatenation.

Text is normalised and split as the tokenizer file says; each piece is then encoded. A long piece is halved until its
parts are short, the parts are encoded, and neighbours are joined: tokens around a join are encoded again in a window
that grows until both of its ends agree with the tokens outside. Agreement is exact: a token sequence is the encoding of
its text if and only if every two neighbours alone encode to themselves. Texts over LONG code points are cut into
blocks that Spark encodes in parallel, and the blocks of a text are joined in the same way. A text with characters that
aren't plain is cut before small and capital letters that follow a blank, where nothing that the file does to text reaches
across; what is plain between such cuts is cut further.

Defined cases: null and empty texts have no ids. A text of any length is encoded whole. Repeated rows are encoded each. An
empty table gives an empty result. Ties between merges are the file's: the lowest rank, then the leftmost. Special tokens' strings in a text become their ids. Equal texts have
equal ids. Other columns of docs are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions

#: Symbols that are merged at once; longer pieces are halved.
LEAF = 48
NEVER = 1 << 30
#: Code points over which a text is cut into blocks that are encoded in parallel.
LONG = 1 << 20
BLOCK = 1 << 17
#: Words whose encodings a worker keeps.
CACHE = 100_000

#: Characters for which Python's lower() and splitting equal the file's normaliser, other than blanks.
_PLAIN = re.compile(r"[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\xff]|<\|")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
#: The pieces of a lower-cased plain word.
split = _PIECE.findall
#: Where a text can be cut whatever its characters: after a blank and before a letter of ASCII.
_SAFE = re.compile(r"(?<=[\t\n\x0b\x0c\r\x20])(?=[A-Za-z])")
_SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Words(dict):
    """What `make` gives for a word, kept for up to `size` words that came more than once and nearly as many that came once;
    either part starts anew when it is full."""

    def __init__(self, make: Callable, size: int = CACHE):
        self.make, self.size, self.once = make, size, {}

    def __missing__(self, word):
        found = self.once.pop(word, None)
        if found is not None:
            if len(self) >= self.size:
                self.once = dict(self)
                self.clear()
            self[word] = found
            return found
        found = self.make(word)
        if len(word) <= 200:
            if len(self.once) >= self.size * 4 // 5:
                self.once.clear()
            self.once[word] = found
        return found


class Codec:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)  # normalises and splits texts with characters that aren't plain
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.names = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks: dict[tuple[int, int], int] = {}
        self.results: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), rank)
            self.results.append(self.vocab[a + b])
        letters = byte_alphabet()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.agrees = lru_cache(1 << 16)(self._agrees)
        self.symbols = lru_cache(1 << 16)(self._symbols)
        self.words = Words(self.word_ids)
        self.bodies = Words(lambda piece: tuple(self.piece_ids(piece.encode())))

    # pieces

    def _symbols(self, token: int) -> tuple[int, ...]:
        """The symbols that a token is merged from."""
        name = self.names[token]
        if name.endswith(self.end) and len(name) > len(self.end):
            data = [self.byte_of[c] for c in name[: -len(self.end)]]
            return (*(self.inner[b] for b in data[:-1]), self.last[data[-1]])
        return tuple(self.inner[self.byte_of[c]] for c in name)

    def merged(self, symbols: list[int]) -> list[int]:
        """The leftmost pair of lowest rank is merged until none is left."""
        if len(symbols) > 4 * LEAF:
            return self._merged_by_heap(symbols)
        symbols, get = list(symbols), self.ranks.get
        ranks = [get(p, NEVER) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks and (lowest := min(ranks)) != NEVER:
            at = ranks.index(lowest)
            symbols[at : at + 2] = (self.results[lowest],)
            del ranks[at]
            if at:
                ranks[at - 1] = get((symbols[at - 1], symbols[at]), NEVER)
            if at < len(ranks):
                ranks[at] = get((symbols[at], symbols[at + 1]), NEVER)
        return symbols

    def _merged_by_heap(self, symbols: list[int]) -> list[int]:
        """The same for many symbols, in about linear time: pairs wait in a heap, and symbols know their neighbours."""
        symbols, n = list(symbols), len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.ranks.get((symbols[i], symbols[i + 1]), NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n or self.ranks.get((symbols[i], symbols[j])) != rank:
                continue  # one of the pair has been merged with another since
            symbols[i], symbols[j] = self.results[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (r := self.ranks.get((symbols[a], symbols[b]), NEVER)) != NEVER:
                    heapq.heappush(heap, (r, a))
        return [x for x in symbols if x >= 0]

    def _agrees(self, a: int, b: int) -> bool:
        return self.merged([*self.symbols(a), *self.symbols(b)]) == [a, b]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the text of two encodings. Both lists are used up."""
        if not left or not right:
            return left or right
        if self.agrees(left[-1], right[0]):
            left.extend(right)
            return left
        size = 1
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            window = self.merged([s for t in (*left[a:], *right[:b]) for s in self.symbols(t)])
            if (a == 0 or self.agrees(left[a - 1], window[0])) and (b == len(right) or self.agrees(window[-1], right[b])):
                left[a:] = window
                left.extend(right[b:])
                return left
            size *= 2

    def encoded(self, symbols: list[int]) -> list[int]:
        """The tokens of one piece."""
        if len(symbols) <= LEAF:
            return self.merged(symbols)
        return self.tree([self.merged(symbols[i : i + LEAF]) for i in range(0, len(symbols), LEAF)])

    def tree(self, level: list[list[int]]) -> list[int]:
        """The encoding of one piece from those of its parts, joined pair by pair."""
        while len(level) > 1:
            level = [self.joined(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def piece_ids(self, data: bytes, ends: bool = True) -> list[int]:
        symbols = [self.inner[b] for b in data]
        if ends and symbols:
            symbols[-1] = self.last[data[-1]]
        return self.encoded(symbols)

    # texts

    def word_ids(self, word: str) -> tuple[int, ...] | list[int]:
        """Of a lower-cased run of plain characters without blanks."""
        pieces, get = split(word), self.bodies.__getitem__
        return get(pieces[0]) if len(pieces) == 1 else [i for p in pieces for i in get(p)]

    def plain_words(self, text: str) -> list[str] | None:
        """The words whose ids, one after the other, are the text's; None if the text isn't that plain."""
        return None if _PLAIN.search(text) else text.lower().split()

    def pieces(self, text: str) -> Iterator[int | bytes]:
        """Pieces of any text, and the ids of special tokens in it."""
        for part in _SPECIAL.split(text):
            if part in self.special:
                yield self.special[part]
            elif part:
                for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    yield bytes(self.byte_of[c] for c in piece)

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        words = self.plain_words(text)
        if words is not None:
            return [i for w in words for i in self.words[w]]
        return [i for p in self.pieces(text) for i in ([p] if isinstance(p, int) else self.piece_ids(p))]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by blanks, as the file names no decoder."""
        return " ".join([self.names[i] for i in ids])


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


class Digests:
    """For a word: its ids in decimal, its tokens' strings, and the number of ids."""

    def __init__(self, c: Codec):
        self.codec = c
        self.words = Words(self.make)

    def make(self, word: str) -> tuple[str, str, int]:
        ids = self.codec.word_ids(word)
        return " ".join(map(str, ids)), self.codec.decode(ids), len(ids)

    def of(self, text: str | None) -> tuple[int, str, str]:
        words = self.codec.plain_words(text) if text else []
        if words is None:
            return self.of_ids(self.codec.ids(text))
        get = self.words.__getitem__
        found = [get(w) for w in words]
        return self.hashed(sum([x[2] for x in found]), " ".join([x[0] for x in found]), " ".join([x[1] for x in found]))

    def of_ids(self, ids: list[int]) -> tuple[int, str, str]:
        return self.hashed(len(ids), " ".join(map(str, ids)), self.codec.decode(ids))

    @staticmethod
    def hashed(n: int, ids: str, decoded: str) -> tuple[int, str, str]:
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@lru_cache(4)
def digests_of(path: str) -> Digests:
    return Digests(codec(path))


def ids_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of each row."""
    path = path or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.ids(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def decoded_table(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: what each row's ids decode to."""
    path = path or default_path()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, text string")


def parts(text: str, size: int = BLOCK) -> Iterator[tuple[str, bool, bool]]:
    """A plain lower-case text in parts of about `size`: runs of whole pieces, and slices of pieces that are longer.
    With each part whether it goes on from the one before, and whether the next goes on from it."""
    at = None
    for m in _PIECE.finditer(text):
        a, b = m.span()
        if at is not None and (b - at > size or b - a > size):
            yield text[at:a], False, False
            at = None
        if b - a > size:
            for i in range(a, b, size):
                yield text[i : min(b, i + size)], i > a, i + size < b
        elif at is None:
            at = a
    if at is not None:
        yield text[at:], False, False


def any_parts(text: str, size: int = BLOCK) -> Iterator[tuple[str, bool, bool]]:
    """The parts of any text, as of `parts`: runs between safe cuts that aren't plain are parts as they are."""
    if not _PLAIN.search(text):
        yield from parts(text.lower(), size)
        return
    at = 0
    cuts = [m.start() for m in _SAFE.finditer(text)]
    for k, cut in enumerate([*cuts, len(text)]):
        following = cuts[k + 1] if k + 1 < len(cuts) else len(text)
        if cut == len(text) or following - at > size and cut > at:
            run = text[at:cut]
            at = cut
            if run:
                yield from [(run, False, False)] if _PLAIN.search(run) else parts(run.lower(), size)


def _long_digests(docs: DataFrame, path: str, block: int) -> DataFrame:
    """Digest columns of texts over LONG: their parts are encoded in parallel and joined again.

    A row is known by a number that Spark gives it; the parts of a text, which came in one row, meet in one group.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    part_type = f"doc_id {kind}, key long, part int, after boolean, before boolean"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for k, (part, after, before) in enumerate(any_parts(text, block)):
                    yield pa.RecordBatch.from_arrays([pa.array([doc], batch.schema.field(0).type), pa.array([key], pa.int64()), pa.array([k], pa.int32()), pa.array([after]), pa.array([before]), pa.array([part], pa.string())], names=["doc_id", "key", "part", "after", "before", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [c.piece_ids(text.encode(), ends=not before) if after or before else c.ids(text) for text, after, before in zip(*(batch.column(n).to_pylist() for n in ("text", "after", "before")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "ids"])

    def join(group: pa.Table) -> pa.Table:
        d, ids, level = digests_of(path), [], []
        for row in sorted(group.to_pylist(), key=lambda r: r["part"]):
            level.append(row["ids"])
            if not row["before"]:  # the end of a piece: its slices are joined as a tree
                ids += d.codec.tree(level)
                level = []
        n, hashed, decoded = d.of_ids(ids)
        return pa.table({"doc_id": group["doc_id"].slice(0, 1), "n_tokens": pa.array([n], pa.int64()), "ids_sha256": [hashed], "decoded_sha256": [decoded]})

    cuts = docs.select("doc_id", F.monotonically_increasing_id().alias("key"), "text").mapInArrow(cut, f"{part_type}, text string")
    encoded = cuts.repartition(n_partitions(docs.sparkSession), "key", "part").mapInArrow(encode, f"{part_type}, ids array<int>")
    return encoded.groupBy("key").applyInArrow(join, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def digests(docs: DataFrame, path: str | None = None, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = digests_of(path)
        for batch in batches:
            rows = [d.of(t.as_py()) for t in batch.column(1)]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select("doc_id", "text")
    over = F.coalesce(F.length("text") > long, F.lit(False))
    short = docs.where(~over).mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return short.unionByName(_long_digests(docs.where(over), path, block))
