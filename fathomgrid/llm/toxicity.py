"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A word is the bag of its character n-grams (2 to 5, with its borders), each hashed to an embedding. The mean of a word's
embeddings goes through a linear softmax of two classes, and a text is toxic unless all of its distinct words are clean:
its score is one less the product of the words' probabilities of being clean. So a toxic word counts alike in a text of
any length, and a word never seen, such as a misspelling or another ending, shares the vectors of its n-grams. Embeddings
and softmax are trained together in numpy by AdaGrad on a bounded sample of labelled rows: by a hash of the id the first
MAX_TOXIC toxic and MAX_CLEAN clean ones, as far as they have no more than MAX_WORDS / 2 distinct words for each label.

Words are runs of letters, digits and all characters beyond ASCII that aren't blank; a mark of ASCII is part of a word
between two of these. Small and capital letters of Latin-1 are the same. Weights and logarithms are fixed-point integers,
so that a text's score doesn't depend on what else is in its batch, and equal texts have equal scores.

Defined cases: a null or empty text, or one without a word, scores 0. A text of any length is read to its end; a word of
over PART characters counts as several. Rows without a label, or whose label is null, teach nothing; of several labels for
an id the highest holds, and of several rows with one id the least text teaches. Repeated rows are scored each. Unless both
labels occur among the rows to learn from, every score is 0. A null id is an ordinary value, not held out. An empty table gives
an empty result. Other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_fold, stored, text_chunks

ORDERS = (2, 3, 4, 5)
BUCKETS = 1 << 17
SIZE = 8
#: Labelled rows, and distinct words of all of them together, that are learnt from at most.
MAX_TOXIC, MAX_CLEAN, MAX_WORDS = 3_000, 6_000, 2_000_000
#: Rows that training sees, each of the sample equally often and once at least; rows of a step, and its rate.
VISITS, ROWS, RATE = 30_000, 32, 0.1
#: A word's log-odds before anything is learnt.
BIAS = -6.0
#: Score from which a text is predicted to be toxic.
TOXIC = 0.7
#: Characters of a text that are read at a time.
PART = 1 << 18
WEIGHT, LOG = 1 << 18, 1 << 32
_MIX = np.uint32(0x9E3779B1)
_BLANKS = np.array([0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


class Bags:
    """The words of some rows and the buckets of their n-grams. rows: offsets into points."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        at = np.arange(len(points)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
        text = np.full(len(points) + n + 1, 32, np.uint32)  # a blank around every row
        capital = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
        text[at] = points + capital * np.uint32(32)
        letter = (text >= 128) | ((text >= 48) & (text <= 57)) | ((text >= 97) & (text <= 122))
        letter &= ~np.isin(text, _BLANKS)
        mark = (text > 32) & (text < 127)
        inside = letter.copy()
        inside[1:-1] |= mark[1:-1] & letter[:-2] & letter[2:]
        text[~inside] = 32
        self.text, self.inside = text, inside
        edge = np.diff(inside.astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        #: The row of each word.
        self.rows = np.searchsorted(offsets[1:] + np.arange(1, n + 1), self.starts, "right")

    def __len__(self) -> int:
        return len(self.starts)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order, the bucket of the n-gram that starts at each character, and whether it is one of a word's."""
        rolled, whole = self.text, np.ones(len(self.text), bool)
        for n in range(2, max(ORDERS) + 1):
            m = len(self.text) - n + 1
            if m <= 0:
                return
            rolled = rolled * np.uint32(1_000_003)
            rolled[:m] += self.text[n - 1 :]
            if n > 2:
                whole[:m] &= self.inside[n - 2 : n - 2 + m]
            if n in ORDERS:
                good = whole[:m].copy()
                if n == 2:
                    good &= self.inside[:m] | self.inside[1:]
                yield ((rolled[:m] + np.uint32(n)) * _MIX) >> np.uint32(32 - BUCKETS.bit_length() + 1), good

    def hashes(self) -> np.ndarray:
        """A hash of each word."""
        with np.errstate(over="ignore"):
            size = self.ends - self.starts
            powers = np.cumprod(np.full(max(1, int(size.max(initial=0))), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
            place = np.arange(len(self.text)) - np.repeat(np.append(0, self.starts), np.diff(np.concatenate(([0], self.starts, [len(self.text)]))))
            mixed = (self.text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.where(self.inside, powers[np.minimum(place, len(powers) - 1)], np.uint64(0))
            return np.add.reduceat(mixed, self.starts)

    def words(self) -> list[str]:
        text = self.text.tobytes().decode("utf-32-le")
        return [text[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]


class Model:
    """Fixed-point log-odds of each bucket, and of a word before its n-grams; none if nothing was learnt."""

    def __init__(self, weights: np.ndarray | None = None, bias: float = 0.0):
        self.weights = None if weights is None else np.append(np.round(weights.astype(np.float64) * WEIGHT).astype(np.int64), 0)
        self.bias = float(bias)

    def log_odds(self, bags: Bags) -> np.ndarray:
        """The log-odds of each word."""
        total, count = np.zeros(len(bags.text), np.int64), np.zeros(len(bags.text), np.int64)
        for bucket, good in bags.grams():
            total[: len(bucket)] += self.weights[np.where(good, bucket, BUCKETS)]
            count[: len(bucket)] += good
        return np.add.reduceat(total, bags.starts - 1) / (np.add.reduceat(count, bags.starts - 1) * float(WEIGHT)) + self.bias

    def scores(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each row; one row may be longer than PART."""
        n = len(offsets) - 1
        if self.weights is None:
            return np.zeros(n)
        found = []
        for a, b, one in parts(points, offsets):
            bags = Bags(points[a:b], offsets if not one else np.array([0, b - a]))
            if len(bags):
                clean = np.round(np.logaddexp(0, np.minimum(self.log_odds(bags), 60)) * LOG).astype(np.int64)
                found.append((bags.rows, bags.hashes(), clean))
        out = np.zeros(n)
        if found:
            rows, hashes, clean = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((hashes, rows))
            rows, hashes, clean = rows[order], hashes[order], clean[order]
            first = np.append(True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1]))
            rows, clean = rows[first], clean[first]
            starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            out[rows[starts]] = -np.expm1(-np.add.reduceat(clean, starts) / LOG)
        return out


def parts(points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """All rows at once, or runs of one long row, cut at a blank if there is one, and whether they are such."""
    if len(offsets) > 2 or len(points) <= PART:
        yield 0, len(points), False
        return
    at = 0
    while at < len(points):
        end = min(at + PART, len(points))
        if end < len(points):
            blank = np.flatnonzero(points[at:end] <= 32)
            end = at + int(blank[-1]) + 1 if len(blank) else end
        yield at, end, True
        at = end


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, words of the labelled rows to learn from: bounded by MAX_TOXIC, MAX_CLEAN and MAX_WORDS."""
    known = labels.where(F.col("toxic").isNotNull() & ~in_fold(F.col("doc_id"), 3, 1)).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    known = known.join(docs.where(F.col("text").isNotNull()).select("doc_id").distinct(), "doc_id").withColumn("order", F.xxhash64("doc_id"))
    taken = [known.where(kind).orderBy("order", "doc_id").limit(most) for kind, most in ((F.col("toxic"), MAX_TOXIC), (~F.col("toxic"), MAX_CLEAN))]
    taken = stored(taken[0].union(taken[1]), "labelled")
    texts = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").groupBy("doc_id", "toxic", "order").agg(F.min("text").alias("text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, at, points in text_chunks(batch.column("text")):
                rows: list[set[str]] = [set() for _ in at[1:]]
                for a, b, one in parts(points, at):
                    x = Bags(points[a:b], at if not one else np.array([0, b - a]))
                    for row, word in zip(x.rows.tolist(), x.words(), strict=True):
                        rows[row].add(word)
                found += map(sorted, rows)
            words = pa.array(found, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("order"), pa.array([len(x) for x in found], pa.int64()), words], names=["toxic", "order", "n", "words"])

    rows = stored(texts.select("toxic", "order", "text").mapInArrow(bags, "toxic boolean, order long, n long, words array<string>"), "bags")
    run = Window.partitionBy("toxic").orderBy("order", "n").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("so_far", F.sum("n").over(run)).where(F.col("so_far") <= MAX_WORDS // 2).select("toxic", "words").orderBy("toxic", "order")


def train(toxic: np.ndarray, texts: list[list[str]], seed: int = 0) -> Model:
    """The model of texts given as their distinct words."""
    keep = [i for i, x in enumerate(texts) if x]
    toxic, texts = toxic[keep], [texts[i] for i in keep]
    if len(np.unique(toxic)) < 2:
        return Model()
    index: dict[str, int] = {}
    lists = [np.array([index.setdefault(w, len(index)) for w in x], np.int64) for x in texts]
    points = np.frombuffer(" ".join(index).encode("utf-32-le"), np.uint32)
    bags = Bags(points, np.array([0, len(points)]))
    owner = (np.cumsum(np.bincount(bags.starts, minlength=len(bags.text))) - 1).astype(np.int32)
    owner = np.where(bags.inside, owner, np.append(owner[1:], owner[-1:]))  # a blank is of the word after it, where it begins a gram
    size = sum(np.bincount(owner[: len(good)][good], minlength=len(index)) for _, good in bags.grams())
    start = np.cumsum(size) - size
    grams, filled = np.empty(int(size.sum()), np.int32), start.copy()
    for bucket, good in bags.grams():  # each order gives its grams in the order of words
        word = owner[: len(good)][good]
        n = np.bincount(word, minlength=len(index))
        grams[np.arange(len(word)) + (filled - (np.cumsum(n) - n))[word]] = bucket[good]
        filled += n

    rng = np.random.default_rng(seed)
    vectors, out, bias = rng.normal(0, 0.3, (BUCKETS, SIZE)), rng.normal(0, 1, (SIZE, 2)), np.array([0, BIAS])
    sums = [np.full(x.shape, 1e-6) for x in (vectors, out, bias)]
    for _ in range(-(-VISITS // len(lists))):
        order = rng.permutation(len(lists))
        for k in range(0, len(order), ROWS):
            some = order[k : k + ROWS]
            row = np.repeat(np.arange(len(some)), [len(lists[i]) for i in some])
            types, which = np.unique(np.concatenate([lists[i] for i in some]), return_inverse=True)
            n = size[types]
            at = np.cumsum(n) - n
            gram = grams[np.repeat(start[types] - at, n) + np.arange(n.sum())]
            mean = np.add.reduceat(vectors[gram], at, axis=0) / n[:, None]
            z = mean @ out + bias
            odds = z[:, 1] - z[:, 0]
            clean = np.bincount(row, np.logaddexp(0, odds)[which], len(some))  # less the logarithm of the probability that all words are clean
            slope = np.where(toxic[some], -np.exp(-clean) / np.maximum(-np.expm1(-clean), 1e-6), 1.0) / len(some)
            g = np.bincount(which, slope[row], len(types)) / (1 + np.exp(-np.maximum(odds, -500)))
            g = np.stack((-g, g), 1)
            back = g @ out.T / n[:, None]
            used, of = np.unique(gram, return_inverse=True)
            word = np.repeat(np.arange(len(types)), n)
            steps = (np.stack([np.bincount(of, back[word, j], len(used)) for j in range(SIZE)], 1), mean.T @ g, g.sum(0))
            for value, total, place, step in zip((vectors, out, bias), sums, (used, slice(None), slice(None)), steps, strict=True):
                total[place] += step**2
                value[place] -= RATE * step / np.sqrt(total[place])
    return Model(vectors @ (out[:, 1] - out[:, 0]), bias[1] - bias[0])


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample of the labelled rows outside the held-out fold."""
    rows = sample(docs, labels).toArrow()
    return train(np.array(rows.column("toxic").to_pylist(), bool), rows.column("words").to_pylist())


def scored(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text), learning from labels (doc_id, toxic)."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.scores(points, at) for _, _, at, points in text_chunks(batch.column(2))]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= TOXIC).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "text").mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
