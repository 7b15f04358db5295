"""Quality by importance resampling: hashed n-gram generative models of target and raw text, sampled by Gumbel top-k.

A text's weight is the log-ratio of its probability under the target model (labelled good texts) and the raw model (all
texts). Features are hashed n-grams of shapes: of six classes of characters (small and capital letters, digits, blanks,
line ends, each mark for itself), and of neighbouring words by their lengths, where a word followed by itself is a feature
of its own. A second pair of models has hashed words, each once for a text: those that the target lacks count against it,
and if any do, the text's weight is the lesser of both. So that the labelled sample's mixture of languages doesn't count as
quality, words are counted for each predicted language, and the raw counts of each are weighed by the target's share of
it. Words whose counts may differ by chance have no weight.
The sample holds as many texts as the weights expect to be target-like, and takes those of highest weight plus Gumbel
noise. The noise is a hash of id and text, so a sample can be repeated. The cut is found by an exact radix search over
counts; texts with the very same key at the cut stay together.

Defined cases: a null text counts as empty; an empty text has no feature and weight 0. A text of any length is read to its
end. Repeated rows share their noise, so they stay or go together. Null ids are ordinary values. If no label marks a good text, every weight is 0 and all
rows stay. An empty table gives an empty result. Other columns of docs are carried by `keep_good`; clashing names in
labels don't matter, since only its id and label columns are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import language
from .common import CHUNK, stored, strings, sums, text_chunks

BUCKETS = 1 << 16
SCALE = 1 << 16
#: Labelled rows that the target model is fitted on, at most: those whose ids have the lowest hashes.
MAX_LABELLED = 20_000
#: Added to each weight in nats: what a text must fall short of the target by, to be expected outside of it.
MARGIN = 4.0
#: Characters in an n-gram.
ORDER = 6
#: Buckets of words; standard errors that the target must lack of a bucket, and the share that it may have at most, for the
#: bucket to have weight. With less, the many small chance differences of a large vocabulary add up in long texts.
WORDS = 1 << 16
ERRORS, LACKING = 5.0, 0.25


def _shapes() -> np.ndarray:
    """A class below 64 for each byte: bytes of characters beyond ASCII are small letters."""
    out = np.ones(256, np.uint8)
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 3
    out[:33] = 4
    out[10] = 5
    out[marks] = 6 + np.arange(len(marks))
    return out


SHAPES = _shapes()
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = np.uint64(0x100000001B3)
_SHIFT = np.uint64(64 - 15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE, np.uint64)
        up[0] = 1
        down = np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Two pairs (buckets, offsets by row): of shapes of characters in the lower half of the buckets, of word pairs in the upper."""
    letters, x = data.astype(np.uint64), SHAPES[data].astype(np.uint64)
    if len(x) < ORDER:
        grams, inside = np.zeros(0, np.int32), np.zeros(0, bool)
    else:
        n = len(x) - ORDER + 1
        rolled = x[:n].copy()
        for k in range(1, ORDER):
            rolled |= x[k : k + n] << np.uint64(6 * k)
        grams = ((rolled * _MIX) >> _SHIFT).astype(np.int32)
        inside = np.ones(n, bool)
        for k in range(1, ORDER):
            last = offsets[1:] - k
            inside[last[(last >= 0) & (last < n)]] = False
    lengths = np.minimum(offsets, len(grams))
    places = np.concatenate(([0], np.cumsum(inside)))[lengths]
    grams = grams[inside]

    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([True], blank))[:-1] | edge[:-1]
    starts = np.flatnonzero(~blank & before) if len(data) else np.zeros(0, np.int64)
    after = np.concatenate((blank, [True]))[1:] | edge[1:]
    ends = np.flatnonzero(~blank & after) + 1 if len(data) else np.zeros(0, np.int64)
    if len(data) > len(_CACHE[0]):
        _CACHE[:] = _powers(len(data) + 1)
    up, down = _CACHE
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((letters + np.uint64(1)) * up[: len(x)])))
    words = (total[ends] - total[starts]) * down[starts]
    rows = np.searchsorted(offsets, starts, "right")
    pair = rows[1:] == rows[:-1]
    a, b = words[:-1][pair], words[1:][pair]
    sizes = np.minimum(ends - starts, 24).astype(np.uint64)
    mixed = ((sizes[:-1][pair] * _PAIR + sizes[1:][pair]) * _MIX) >> _SHIFT
    pairs = np.where(a == b, 0, mixed).astype(np.int32) + (BUCKETS >> 1)
    return (grams, places), (pairs, np.searchsorted(rows[:-1][pair], np.arange(len(offsets)), "right"))


def _letters() -> np.ndarray:
    """Small letters, digits and bytes beyond ASCII as they are, capital letters as small ones, all else 0."""
    out = np.array([b if b > 127 or chr(b).isalnum() else 0 for b in range(256)], np.uint8)
    out[ord("A") : ord("Z") + 1] += 32
    return out


LETTERS = _letters()


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets by row) of the distinct words of each row: runs of letters and digits, A-Z as small letters."""
    x = LETTERS[data]
    edge = np.zeros(len(x) + 1, bool)
    edge[offsets] = True
    inside = x > 0
    starts = np.flatnonzero(inside & (~np.concatenate(([False], inside))[:-1] | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate((inside, [False]))[1:] | edge[1:])) + 1
    if len(x) > len(_CACHE[0]):
        _CACHE[:] = _powers(len(x) + 1)
    up, down = _CACHE
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x.astype(np.uint64) * up[: len(x)])))
    mixed = ((total[ends] - total[starts]) * down[starts] * _MIX) >> np.uint64(64 - 16)
    rows = np.searchsorted(offsets, starts, "right") - 1
    found = np.unique((rows << 16) | mixed.astype(np.int64))
    return (found & (WORDS - 1)).astype(np.int32), np.searchsorted(found, np.arange(len(offsets)) << 16)


_CACHE: list[np.ndarray] = list(_powers(CHUNK + 1))


def _chunks(array: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    offsets, data = strings(array)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def feature_counts(docs: DataFrame, model: language.Model) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket of shapes, and of words by predicted language, occurs in all texts: partial counts by task,
    summed by Spark; BUCKETS numbers and WORDS for each language come back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size = BUCKETS + WORDS * max(1, len(model.langs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tally = np.zeros(size, np.int64)
        for batch in batches:
            for (_, _, data, offsets), (_, _, at, points) in zip(_chunks(batch.column(0)), text_chunks(batch.column(0)), strict=True):
                for found, _ in features(data, offsets):
                    tally[:BUCKETS] += np.bincount(found, minlength=BUCKETS)
                words, places = word_buckets(data, offsets)
                spoken = language.totals(m, points, at).argmax(1) if m.langs else np.zeros(len(at) - 1, np.int64)
                np.add.at(tally, BUCKETS + np.repeat(spoken, np.diff(places)) * WORDS + words, 1)
        at = np.flatnonzero(tally)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(tally[at], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out[:BUCKETS], out[BUCKETS:].reshape(-1, WORDS)


def labelled_good(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """The texts of at most `bound` labelled rows that are good and not toxic. Their ids are a bounded broadcast."""
    ids = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id")
    n = ids.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    if n > bound:  # a little more than the bound by hash, then the lowest of these
        ids = ids.where(draw < int((1 << 40) * min(1.0, 1.05 * bound / n)))
    ids = ids.distinct().orderBy(draw, "doc_id").limit(bound)
    return docs.join(F.broadcast(ids), "doc_id", "left_semi")


def log_ratios(target: np.ndarray, raw: np.ndarray, evidence: float = 4.0) -> np.ndarray:
    """Fixed-point log-ratios by bucket, each half of the buckets a distribution of its own. `evidence` counts are added to
    both what the target has and what it would have at the raw share, so that rare buckets have ratios near 1."""
    out = np.zeros(BUCKETS, np.int64)
    if not target.sum():
        return out
    for part in (slice(0, BUCKETS >> 1), slice(BUCKETS >> 1, BUCKETS)):
        expected = raw[part] * (target[part].sum() / max(1, raw[part].sum()))
        out[part] = np.round(np.log((target[part] + evidence) / (expected + evidence)) * SCALE)
    return out


def word_ratios(target: np.ndarray, raw: np.ndarray, evidence: float = 0.5) -> np.ndarray:
    """Fixed-point log-ratios, 0 at most, of words from counts by language and bucket. What the target would have is the sum
    of each language's raw counts at the target's share of that language."""
    out = np.zeros(WORDS, np.int64)
    if not target.sum():
        return out
    expected = (raw * (target.sum(1) / np.maximum(1, raw.sum(1)))[:, None]).sum(0)
    found = target.sum(0)
    sure = (expected - found >= ERRORS * np.sqrt(expected + 1)) & (found <= LACKING * expected)
    out[sure] = np.round(np.log((found + evidence) / (expected + evidence)) * SCALE)[sure]
    return np.minimum(out, 0)


def fitted(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Fixed-point log-ratios by bucket: of shapes, then of words."""
    model = language.train(docs) if "lang" in docs.columns else language.Model([], np.zeros((language.BUCKETS, 0), np.int64))
    target, target_words = feature_counts(labelled_good(docs, labels), model)
    raw, raw_words = feature_counts(docs, model)
    return np.concatenate((log_ratios(target, raw), word_ratios(target_words, raw_words)))


def weighed(docs: DataFrame, ratios: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns `keep`, and log_weight (nats) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    kept = docs.select(*keep)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for row, end, data, offsets in _chunks(batch.column(batch.num_columns - 1)):
                for found, at in features(data, offsets):
                    out[row:end] += sums(table[found], at)
                found, at = word_buckets(data, offsets)
                against = sums(table[BUCKETS + found], at)
                out[row:end] = np.where(against < 0, np.minimum(out[row:end], against), out[row:end])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out / SCALE, pa.float64())], names=[*batch.schema.names[:-1], "log_weight"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(weigh, f"{schema}log_weight double")


def _keyed(weights: DataFrame) -> DataFrame:
    """weights with noisy_weight, and __key: the same as fixed-point digits, so that a cut can be found digit by digit."""
    uniform = (F.shiftrightunsigned("draw", 11) + 0.5) / float(1 << 53)
    noisy = F.col("log_weight") - F.log(-F.log(uniform))
    digits = F.round(F.least(F.greatest(noisy, F.lit(-(2.0**30))), F.lit(2.0**30)) * SCALE).cast("long") + (1 << 47)
    return weights.withColumns({"noisy_weight": noisy, "__key": digits})


def cut(weights: DataFrame, margin: float = MARGIN, size: int | None = None) -> tuple[int, int]:
    """The lowest key of the `size` rows of highest log_weight plus Gumbel noise, and `size`. By default `size` is the sum
    of the chances that a row is target-like, the logistic function of its log_weight plus `margin`.

    The noise comes from the column `draw`, a hash. All counts are sums by Spark; the driver gets at most 65,536 of
    them at a time.
    """
    if size is None:
        odds = F.least(F.greatest(F.col("log_weight") + margin, F.lit(-500.0)), F.lit(500.0))
        size = int(weights.agg(F.coalesce(F.round(F.sum(1 / (1 + F.exp(-odds)))), F.lit(0.0))).first()[0])
    keyed = _keyed(weights)
    low = above = 0  # the digits of the cut found so far; how many rows are surely over it
    for shift in (32, 16, 0):
        part = keyed if shift == 32 else keyed.where(F.shiftright("__key", shift + 16) == low >> (shift + 16))
        digit = F.shiftright("__key", shift).bitwiseAND(0xFFFF)
        counts = sorted(((r["d"], r["n"]) for r in part.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for d, n in counts:
            if above + n >= size or d == counts[-1][0]:
                low |= d << shift
                break
            above += n
    return low, size


def resampled(weights: DataFrame, margin: float = MARGIN, size: int | None = None) -> DataFrame:
    """weights with noisy_weight and kept, whether the row is in the sample of `cut`."""
    low, size = cut(weights, margin, size)
    return _keyed(weights).withColumn("kept", (F.col("__key") >= low) & F.lit(size > 0)).drop("__key")


def _draw() -> Column:
    """A row's random draw: a hash of its id and text."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))


def classified(docs: DataFrame, labels: DataFrame, keep: list[str], margin: float = MARGIN) -> DataFrame:
    """The columns `keep`, log_weight, noisy_weight, kept for each row of docs."""
    ratios = fitted(docs, labels)
    rows = docs.select(*keep, _draw().alias("draw"), "text")
    weights = stored(weighed(rows, ratios, [*keep, "draw"]), "weights")
    return resampled(weights, margin).drop("draw")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight, noisy_weight, kept."""
    return classified(docs, labels, ["doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are sampled, with all their columns. Only weights are kept between the passes over texts."""
    ratios = fitted(docs, labels)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _draw().alias("draw"), "text")
    weights = weighed(rows, ratios, ["row", "draw"])
    low, size = cut(stored(weights.select("log_weight", "draw"), "weights"))
    return _keyed(weights).where((F.col("__key") >= low) & F.lit(size > 0)).select("row.*")
