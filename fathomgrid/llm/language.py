"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting and scoring run in Arrow batches inside Spark tasks; Spark shuffles and sums the counts. The matrix of
log-probabilities (buckets x languages) has a fixed number of buckets and is broadcast; languages are the MOST labels with
the most texts, so that dirty labels can't swell it. Weights are fixed-point integers, so that a text's score doesn't
depend on what else is in its batch.

Defined cases: a null or empty text, or one without a letter, is `und` with score 0. A text of any length is read to its
end. Rows whose label is null, or not among the MOST, teach nothing. With no labelled row at all, or an empty table, every
text is `und`. Of equally likely languages the first by name is predicted; labels of equally many texts are taken by name.
Repeated rows teach each. `keep_known` also takes a text for unknown that is less likely
in its best language than that language's own n-grams are by FLOOR nats a gram. Texts under SHORT characters are too short
for that, and keep their best language. Equal texts get equal results. Columns besides the named
ones are ignored by `predict` and carried by `keep_known`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_fold, text_chunks

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SCALE = 1 << 16
UNKNOWN = "und"
#: Languages that are learnt, at most.
MOST = 256
#: Nats for each n-gram that a text may fall short of its language's expected log-likelihood, and characters to be judged by it.
FLOOR, SHORT = 1.3, 30
_MIX = np.uint32(0x9E3779B1)


def gram_buckets(points: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """For each order n the bucket of the n-gram that starts at each place, or `buckets` where it would leave its row."""
    low = points + ((points >= 65) & (points <= 90)).astype(np.uint32) * np.uint32(32)
    rolled = low
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for n in ORDERS:
        if n > 1:
            rolled = rolled * np.uint32(1_000_003)
            rolled[: len(low) - n + 1] += low[n - 1 :]
        bucket = (((rolled + np.uint32(n)) * _MIX) >> shift).astype(np.int32)
        for k in range(1, n):
            last = offsets[1:] - k
            bucket[last[last >= offsets[:-1]]] = buckets
        yield bucket


def languages(docs: DataFrame, most: int = MOST) -> list[str]:
    """The labels with the most texts, `most` of them or fewer."""
    counts = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).groupBy("lang").agg(F.count("*").alias("n"))
    return sorted(r["lang"] for r in counts.orderBy(F.desc("n"), "lang").limit(most).collect())


def gram_counts(docs: DataFrame, langs: list[str], buckets: int = BUCKETS) -> DataFrame:
    """lang, bucket, n: n-gram counts of all texts with one of the labels."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for row, end, at, points in text_chunks(batch.column("text")):
                names, which = np.unique(langs[row:end].astype(str), return_inverse=True)
                of = np.repeat(which.astype(np.int32) * (buckets + 1), np.diff(at))
                found = np.zeros(len(names) * (buckets + 1), np.int64)
                for bucket in gram_buckets(points, at, buckets):
                    found += np.bincount(of + bucket, minlength=len(found))
                for i, name in enumerate(names):
                    tallies[name] = tallies.get(name, 0) + found[i * (buckets + 1) :][:buckets]
        for name, tally in tallies.items():
            at = np.flatnonzero(tally)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(tally[at], pa.int64())})

    labelled = docs.where(F.col("lang").isin(langs) & F.col("text").isNotNull()).select("text", "lang")
    return labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages, and fixed-point log-probabilities by bucket and language."""

    def __init__(self, langs: list[str], counts: np.ndarray, alpha: float = 0.5):
        self.langs = langs
        smooth = counts.astype(np.float64) + alpha
        logs = np.round(np.log(smooth / smooth.sum(0)) * SCALE).astype(np.int32)
        #: By language and bucket; the last bucket, of n-grams that leave their row, weighs nothing.
        self.weights = np.pad(logs.T, ((0, 0), (0, 1)))
        #: The expected weight of an n-gram of each language.
        self.expected = (smooth / smooth.sum(0) * logs).sum(0)


def train(docs: DataFrame, buckets: int = BUCKETS) -> Model:
    """The model of all rows with text and lang. One column of `buckets` numbers for each language comes to the driver."""
    langs = languages(docs)
    if not langs:
        return Model([], np.zeros((buckets, 0), np.int64))
    rows = gram_counts(docs, langs, buckets).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("found")).collect()
    rows.sort(key=lambda r: r["lang"])
    counts = np.zeros((buckets, len(rows)), np.int64)
    for i, r in enumerate(rows):
        pairs = np.array([(x["bucket"], x["n"]) for x in r["found"]], np.int64)
        counts[pairs[:, 0], i] = pairs[:, 1]
    return Model([r["lang"] for r in rows], counts)


def totals(model: Model, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fixed-point log-likelihoods, rows x languages."""
    out = np.zeros((len(offsets) - 1, len(model.langs)), np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if not len(full):
        return out
    for bucket in gram_buckets(points, offsets, model.weights.shape[1] - 1):
        for k, weights in enumerate(model.weights):
            out[full, k] += np.add.reduceat(weights.take(bucket), offsets[full], dtype=np.int64)
    return out


def scored(texts: list[str | None], totals: np.ndarray, langs: list[str]) -> tuple[list[str], list[float]]:
    names, scores = [], []
    for text, row in zip(texts, totals, strict=True):
        if not langs or not text or not any(map(str.isalpha, text)):
            names.append(UNKNOWN)
            scores.append(0.0)
            continue
        best = int(row.argmax())
        names.append(langs[best])
        scores.append(float(1 / np.exp(np.maximum((row - row[best]) / SCALE, -700)).sum()))
    return names, scores


def foreign(model: Model, totals: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row is too unlikely, even in its best language, to be in a language of the model."""
    size = np.diff(offsets)
    if not model.langs:
        return np.ones(len(size), bool)
    grams = sum(np.maximum(size - n + 1, 0) for n in ORDERS)
    floor = (model.expected - FLOOR * SCALE)[totals.argmax(1)]
    return (size >= SHORT) & (totals.max(1) < floor * grams)


def predict(docs: DataFrame, model: Model, keep: list[Column | str]) -> DataFrame:
    """The columns `keep`, then lang_pred and score (the posterior under equal priors) for each row of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, scores = [], []
            texts = batch.column(batch.num_columns - 1)
            for row, end, at, points in text_chunks(texts):
                a, b = scored(texts.slice(row, end - row).to_pylist(), totals(m, points, at), m.langs)
                names += a
                scores += b
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(score, f"{schema}, lang_pred string, score double" if schema else "lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows outside the held-out fold only."""
    held = in_fold(F.col("doc_id"), 4, 2)
    return predict(docs, train(docs.where(~held)), ["doc_id", held.alias("held_out")])


def keep_known(docs: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """The rows of docs whose predicted language is known, likely enough and, if given, one of `languages`. All columns stay."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs.where(~in_fold(F.col("doc_id"), 4, 2))))
    wanted = set(languages) if languages else None

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts, mask = batch.column("text"), []
            for row, end, at, points in text_chunks(texts):
                found = totals(m, points, at)
                names, _ = scored(texts.slice(row, end - row).to_pylist(), found, m.langs)
                mask += [x != UNKNOWN and not f and (wanted is None or x in wanted) for x, f in zip(names, foreign(m, found, at).tolist(), strict=True)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
