"""Language-model scoring: a log-bilinear neural model of tokens, trained in numpy with noise-contrastive estimation.

The vocabulary is the most frequent tokens. To normalise it exactly at a bounded price it is parted into classes: the most
frequent tokens and the end are classes of their own, the others are grouped by their endings. The vectors of the CONTEXT
tokens before, weighted by place, add up to a predicted vector. Its products with all class vectors give the class's
probability, those with the vectors of the class's tokens the token's: matrix products and two softmaxes for a batch of
places. Tokens outside of the vocabulary have classes by their last two characters, beside the others in the first softmax;
such a token's probability is its class's times its smoothed share of the class's counts. So all probabilities of a place
sum to one.

Counts are grouped sums by Spark. Texts are split into numbered tokens once, and the table of numbers is stored. Training
is data-parallel: in each round every task goes over its share of the texts, and Spark averages the tasks' parameters, each
row by how often the task has touched it; each text is learnt from in one round, so that all are. What comes to the driver
is a parameter table of fixed size, and a HEAD of frequent tokens' counts of bounded size; the counts of other tokens are
joined to the texts that hold them.

A probability doesn't depend on what else is in a batch: factors of products are whole numbers of a grid, so small that
their sums are exact in any order; everything else goes row by row, and the logarithms are added as integers; so equal texts
have equal scores. The parameters depend on how the input is
split into partitions, as each task takes its own steps; the same files give the same model.

Defined cases: a null or empty text is the end token alone. A text of any length is scored whole. Repeated rows are scored
alike and learnt from each. A null id is learnt from. Ties of counts are ordered by token. With nothing to learn from, or an
empty table, all counts are zero and the model is uniform over its classes. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Words
from .common import checkpointed, in_fold, stored, strings, utf8, word_bytes

#: Stands for the end of a text; a blank, so that no word equals it.
END = b" "
#: Tokens with vectors; those of them that are classes of their own, with the end; groups that hold the others; and classes
#: by ending of the tokens outside of the vocabulary, the last of which is of all other endings.
VOCABULARY, SINGLE, GROUPS, ENDINGS = 1 << 14, 64, 64, 32
CLASSES = SINGLE + GROUPS + ENDINGS
#: Numbers in a vector, tokens of context.
SIZE, CONTEXT = 20, 5
#: Noise draws for a batch of classes, and for each token of a group.
NOISE, TOKEN_NOISE = 24, 4
BATCH = 1024
ROUNDS = 3
RATE = 0.12
#: Tokens whose counts are broadcast, at most: the most frequent ones. Of larger numbers are the classes by ending.
HEAD = 1 << 17
#: Fixed-point logarithms count in units of 1 / SHIFT.
SHIFT = 1 << 32
#: Rows of a product.
ROWS = 1024
#: Tokens that are scored together.
TOGETHER = 1 << 16
#: Parameter rows that are averaged together.
BLOCK = 2048


def token_counts(docs: DataFrame) -> DataFrame:
    """token, n: how often each token occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            for text in utf8(batch.column(0)):
                tally.update(word_bytes(text))
                tally[END] += 1
                if len(tally) > 300_000:
                    yield rows(tally)
                    tally = Counter()
        yield rows(tally)

    def rows(tally: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"token": pa.array(tally.keys(), pa.binary()).cast(pa.string()), "n": pa.array(tally.values(), pa.int64())})

    return docs.select("text").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, most: int = HEAD) -> tuple[list[bytes], np.ndarray]:
    """All tokens that occur at least as often as some power of two, the lowest that leaves `most` of them or fewer: the end
    first, then by count; and their counts."""
    steps = [1 << k for k in range(45)]
    row = counts.agg(*(F.sum(F.when(F.col("n") >= s, 1).otherwise(0)).alias(f"s{s}") for s in steps)).first()
    least = next(s for s in steps if (row[f"s{s}"] or 0) < most)
    table = counts.where((F.col("n") >= least) | (F.col("token") == END.decode())).toArrow()
    found = sorted(zip(table["token"].cast(pa.binary()).to_pylist(), table["n"].to_pylist(), strict=True), key=lambda x: (x[0] != END, -x[1], x[0]))
    if not found:
        found = [(END, 0)]
    return [t for t, _ in found], np.array([n for _, n in found], np.int64)


def ending_of(token: bytes) -> bytes:
    """The last two characters."""
    tail = token[-8:]
    return tail[-2:] if tail.isascii() else tail.decode(errors="ignore")[-2:].encode()


class Vocabulary:
    """Numbers, classes and groups of tokens. A token of the head has its place there as number, another one HEAD and the
    number of its ending; one more stands before a text."""

    BEGIN = HEAD + ENDINGS

    def __init__(self, head: list[bytes], counts: np.ndarray):
        self.size = min(VOCABULARY, len(head))
        self.head, self.counts = head, counts
        others = sorted(range(min(SINGLE, self.size), self.size), key=lambda i: (head[i][::-1], i))
        #: The numbers of each group's tokens.
        self.groups = [np.array(g, np.int64) for g in np.array_split(np.array(others, np.int64), GROUPS)]
        self.width = max(len(g) for g in self.groups)
        #: By number: the class (one past all for what stands before a text), and the place in a group.
        self.class_of = np.full(self.BEGIN + 1, CLASSES, np.int16)
        self.class_of[: min(SINGLE, self.size)] = np.arange(min(SINGLE, self.size))
        self.place_of = np.zeros(self.BEGIN + 1, np.int16)
        for k, g in enumerate(self.groups):
            self.class_of[g] = SINGLE + k
            self.place_of[g] = np.arange(len(g))
        self.class_of[HEAD : self.BEGIN] = SINGLE + GROUPS + np.arange(ENDINGS)
        #: By number: the row of the vector that a token has as context.
        self.row_of = np.full(self.BEGIN + 1, self.size + ENDINGS, np.int32)
        self.row_of[: self.size] = np.arange(self.size)
        self.row_of[HEAD : self.BEGIN] = self.size + np.arange(ENDINGS)

    def with_endings(self, endings: list[bytes], n: np.ndarray, v: np.ndarray) -> Vocabulary:
        """Also knows the endings that are classes, and the tokens (n) and distinct tokens (v) of each of their classes."""
        self.endings = {e: i for i, e in enumerate(endings)}
        for i in range(self.size, len(self.head)):
            k = self.ending_of(self.head[i])
            self.class_of[i] = SINGLE + GROUPS + k
            self.row_of[i] = self.size + k
        #: Shares of the classes, and of the tokens in their groups.
        counts = np.concatenate((np.bincount(self.class_of[: self.size], self.counts[: self.size], SINGLE + GROUPS)[: SINGLE + GROUPS], n))
        self.shares = (counts + 0.5) / (counts.sum() + 0.5 * CLASSES)
        self.inside = np.ones((GROUPS, self.width))
        for k, g in enumerate(self.groups):
            self.inside[k, : len(g)] = (self.counts[g] + 0.5) / (self.counts[g].sum() + 0.5 * len(g)) if len(g) else 1
        #: What a token's count plus a half is divided by, in a class by ending.
        self.norms = np.round(np.log10(n + 0.5 * (v + 1)) * SHIFT).astype(np.int64)
        return self

    def ending_of(self, token: bytes) -> int:
        return self.endings.get(ending_of(token), ENDINGS - 1)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The vocabulary of a table of counts; endings are counted over all tokens outside of it."""
    voc = Vocabulary(*head_of(counts))
    inside = set(voc.head[: voc.size])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = Counter(), Counter()
        for batch in batches:
            for t, k in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if t not in inside:
                    n[ending_of(t)] += k
                    v[ending_of(t)] += 1
        yield pa.RecordBatch.from_pydict({"ending": pa.array(n.keys(), pa.binary()), "n": pa.array(n.values(), pa.int64()), "v": pa.array([v[e] for e in n], pa.int64())})

    rows = counts.select("token", "n").mapInArrow(tally, "ending binary, n long, v long").groupBy("ending").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    rows = checkpointed(rows)
    top = rows.orderBy(F.desc("n"), "ending").limit(ENDINGS - 1).collect()
    whole = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n, v = (np.zeros(ENDINGS, np.int64) for _ in "nv")
    for i, r in enumerate(top):
        n[i], v[i] = r["n"], r["v"]
    n[-1], v[-1] = whole["n"] - n.sum(), whole["v"] - v.sum()
    return voc.with_endings([bytes(r["ending"]) for r in top], n, v)


class Model:
    """Parameters as rows of SIZE numbers and a bias: `seen` (tokens as context), `said` (classes), `token` (tokens of
    groups), and `place`, the weights of the context's places by dimension, the nearest first."""

    def __init__(self, voc: Vocabulary, seed: int = 7):
        r = np.random.default_rng(seed)
        self.voc = voc
        parts = {"seen": voc.size + ENDINGS + 1, "said": CLASSES, "token": GROUPS * voc.width, "place": CONTEXT}
        self.rows = r.normal(0, 0.1, (sum(parts.values()), SIZE + 1)).astype(np.float32)
        at = 0
        for name, n in parts.items():
            setattr(self, name, self.rows[at : at + n])
            setattr(self, f"{name}_at", at)
            at += n
        self.seen[:, -1] = 0
        self.said[:, -1] = np.log(voc.shares)
        self.token[:, -1] = np.log(voc.inside).ravel()
        self.place[:] = 1.0 / CONTEXT
        self.place[:, -1] = 0

    def predicted(self, vectors: np.ndarray) -> np.ndarray:
        """The predicted vectors, with a 1 as last column, at the places from CONTEXT on of a run of tokens with the given
        vectors."""
        n = len(vectors) - CONTEXT
        q = vectors[CONTEXT - 1 : CONTEXT - 1 + n] * self.place[0]
        for i in range(1, CONTEXT):
            q += vectors[CONTEXT - 1 - i : CONTEXT - 1 - i + n] * self.place[i]
        q[:, -1] = 1
        return q

    def log_probabilities(self, numbers: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of the tokens of the vocabulary, and of the classes of others, at the places
        from CONTEXT on of a run of tokens; 0 where a text hasn't begun."""
        voc = self.voc
        scale_q, scale_w = self.scales()
        q = np.rint(self.predicted(self.seen[voc.row_of[numbers]]) * scale_q).astype(np.float64)
        own = numbers[CONTEXT:]
        classes = voc.class_of[own].astype(np.int64)
        out = np.zeros(len(own), np.float64)
        product = lambda rows, weights: ((rows @ np.rint(weights * scale_w).astype(np.float64).T) / (scale_q * scale_w)).astype(np.float32)
        for a in range(0, len(own), ROWS):
            out[a : a + ROWS] = _log_softmax(product(q[a : a + ROWS], self.said), np.minimum(classes[a : a + ROWS], CLASSES - 1))
        out[classes == CLASSES] = 0
        grouped = np.flatnonzero((classes >= SINGLE) & (classes < SINGLE + GROUPS))
        grouped = grouped[np.argsort(classes[grouped], kind="stable")]
        ends = np.searchsorted(classes[grouped], np.arange(SINGLE, SINGLE + GROUPS + 1))
        tokens = self.token.reshape(GROUPS, voc.width, SIZE + 1)
        for k in range(GROUPS):
            for a in range(ends[k], ends[k + 1], ROWS):
                at = grouped[a : min(a + ROWS, ends[k + 1])]
                out[at] += _log_softmax(product(q[at], tokens[k, : len(voc.groups[k])]), voc.place_of[own[at]].astype(np.int64))
        return out

    def scales(self) -> tuple[float, float]:
        """Powers of two that make predicted vectors and weights whole numbers of up to 2^23 and 2^24, so that the sum of
        SIZE + 1 products is exact as a double."""
        most = lambda x: float(np.abs(x).max(initial=0))
        q = max(1.0, CONTEXT * most(self.seen) * most(self.place))
        w = max(1.0, most(self.said), most(self.token))
        return 2.0 ** (23 - math.ceil(math.log2(q))), 2.0 ** (24 - math.ceil(math.log2(w)))


def _log_softmax(scores: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of each row the log-probability of one column."""
    scores -= scores.max(1, keepdims=True)
    mine = scores[np.arange(len(own)), own]
    np.exp(scores, out=scores)
    return mine.astype(np.float64) - np.log(scores.sum(1).astype(np.float64))


def learn(model: Model, numbers: np.ndarray, rng: np.random.Generator, squares: np.ndarray, touched: np.ndarray, rate: float) -> None:
    """One pass of noise-contrastive estimation over a run of tokens, with adaptive steps for each row that a batch touches.
    Noise is drawn by the classes' shares, and by the tokens' shares of their group."""
    voc = model.voc
    class_sums, class_logs = np.cumsum(voc.shares), np.log(NOISE * voc.shares).astype(np.float32)
    token_logs = np.log(TOKEN_NOISE * voc.inside).astype(np.float32).ravel()
    draws = _drawn(voc, rng)
    for a in range(0, len(numbers) - CONTEXT, BATCH):
        run = numbers[a : a + BATCH + CONTEXT]
        rows = voc.row_of[run]
        vectors = model.seen[rows]
        q = model.predicted(vectors)
        classes = voc.class_of[run[CONTEXT:]].astype(np.int64)
        real = np.flatnonzero(classes < CLASSES)
        w, x = classes[real], q[real]
        noise = np.minimum(np.searchsorted(class_sums, rng.random(NOISE)), CLASSES - 1)
        own, other = model.said[w], model.said[noise]
        g_own = 1 / (1 + np.exp(np.einsum("ij,ij->i", x, own) - class_logs[w]))
        g_other = -1 / (1 + np.exp(class_logs[noise] - x @ other.T))
        g_x = g_own[:, None] * own + g_other @ other
        at, steps = [model.said_at + w, model.said_at + noise], [g_own[:, None] * x, g_other.T @ x]
        inside = np.flatnonzero((w >= SINGLE) & (w < SINGLE + GROUPS))
        if len(inside):
            group, y = w[inside] - SINGLE, x[inside]
            mine = group * voc.width + voc.place_of[run[CONTEXT:][real[inside]]]
            noise = group[:, None] * voc.width + draws[group[:, None], rng.integers(0, draws.shape[1], (len(inside), TOKEN_NOISE))]
            own, other = model.token[mine], model.token[noise]
            g_own = 1 / (1 + np.exp(np.einsum("ij,ij->i", y, own) - token_logs[mine]))
            g_other = -1 / (1 + np.exp(token_logs[noise] - np.einsum("ij,ikj->ik", y, other)))
            g_x[inside] += g_own[:, None] * own + np.einsum("ik,ikj->ij", g_other, other)
            at += [model.token_at + mine, model.token_at + noise.ravel()]
            steps += [g_own[:, None] * y, (g_other[:, :, None] * y[:, None, :]).reshape(-1, SIZE + 1)]
        g_q = np.zeros_like(q)
        g_q[real] = g_x
        g_q[:, -1] = 0
        back = np.zeros_like(vectors)
        for i in range(CONTEXT):
            before = slice(CONTEXT - 1 - i, CONTEXT - 1 - i + len(q))
            at.append(np.array([model.place_at + i]))
            steps.append(np.einsum("ij,ij->j", g_q, vectors[before])[None] / len(q))
            back[before] += g_q * model.place[i]
        at.append(model.seen_at + rows)
        steps.append(back)
        at, n, steps = _summed(np.concatenate(at), np.concatenate(steps))
        squares[at] += steps * steps
        touched[at] += n
        model.rows[at] += rate * steps / np.sqrt(squares[at])


def _drawn(voc: Vocabulary, rng: np.random.Generator, n: int = 1024) -> np.ndarray:
    """Places drawn by the shares of each group's tokens, to draw noise from."""
    out = np.zeros((GROUPS, n), np.int64)
    for k, g in enumerate(voc.groups):
        if len(g):
            share = np.cumsum(voc.inside[k, : len(g)])
            out[k] = np.minimum(np.searchsorted(share / share[-1], rng.random(n)), len(g) - 1)
    return out


def _summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct places, how often each occurs, and the sums of their rows of values."""
    order = np.argsort(at, kind="stable")
    by = at[order]
    first = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1])))
    return by[first], np.diff(np.append(first, len(by))), np.add.reduceat(values[order], first)


def numbered(docs: DataFrame, voc: Vocabulary, columns: list[Column]) -> DataFrame:
    """The columns, and for each text: key (a number of its own), n_tokens, known and own (of the head's tokens: how many
    were learnt from, and the logarithms of their counts), others (what shares in classes by ending add to the score, less
    that of tokens outside of the head), ids (numbers), words (tokens outside of the head)."""
    shared = docs.sparkSession.sparkContext.broadcast(voc)
    kept = docs.select(*columns)
    names, width = kept.columns, len(columns)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        get = _Numbers(v).__getitem__
        log_of = np.zeros(v.BEGIN + 1, np.int64)
        log_of[: len(v.head)] = np.round(np.log10(v.counts + 0.5) * SHIFT).astype(np.int64)
        known_of = np.zeros(v.BEGIN + 1, np.int64)
        known_of[: len(v.head)] = v.counts > 0
        other_of = np.zeros(v.BEGIN + 1, np.int64)
        rest = np.concatenate((np.arange(v.size, len(v.head)), np.arange(HEAD, v.BEGIN)))
        other_of[rest] = log_of[rest] - v.norms[v.class_of[rest] - SINGLE - GROUPS]
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(width)
            for a, b in _groups(texts):
                some = [word_bytes(t) for t in utf8(texts.slice(a, b - a))]
                flat = []
                for w in some:
                    flat += map(get, w)
                    flat.append(0)
                numbers = np.array(flat, np.int32)
                starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in some])))
                tail = np.flatnonzero(numbers >= HEAD)
                words = [w for ws in some for w in (*ws, END)] if len(tail) else []
                total = lambda table: pa.array(np.add.reduceat(table[numbers], starts[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(a, b - a) for i in range(width)),
                        pa.array(np.arange(row, row + b - a)),
                        pa.array(np.diff(starts)),
                        total(known_of),
                        total(log_of),
                        total(other_of),
                        pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(numbers)),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(tail, starts), pa.int32()), pa.array([words[i] for i in tail.tolist()], pa.binary()).cast(pa.string())),
                    ],
                    names=[*names, "key", "n_tokens", "known", "own", "others", "ids", "words"],
                )
                row += b - a

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    return docs.select(*columns, "text").mapInArrow(number, f"{schema}key long, n_tokens long, known long, own long, others long, ids array<int>, words array<string>")


class _Numbers(dict):
    """Numbers of tokens; those of tokens outside of the head are kept for some time."""

    def __init__(self, voc: Vocabulary):
        super().__init__({t: i for i, t in enumerate(voc.head)})
        self.others = Words(lambda token: HEAD + voc.ending_of(token))

    def __missing__(self, token: bytes) -> int:
        return self.others[token]


def _groups(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `size` bytes, or one longer row."""
    offsets, _ = strings(column)
    a = n = 0
    for i, x in enumerate(np.diff(offsets).tolist()):
        if i > a and n + x > size:
            yield a, i
            a, n = i, 0
        n += x
    if a < len(column):
        yield a, len(column)


def _runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, run, places) for rows of about TOGETHER numbers: each text after CONTEXT marks of a
    beginning; places are those of the texts' tokens."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    numbers = column.values.to_numpy()
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + TOGETHER, "right")) - 1)
        some = numbers[offsets[row] : offsets[end]]
        sizes = np.diff(offsets[row : end + 1])
        places = np.arange(len(some)) + CONTEXT * np.repeat(np.arange(1, end - row + 1), sizes)
        run = np.full(len(some) + CONTEXT * (end - row), Vocabulary.BEGIN, np.int32)
        run[places] = some
        yield row, end, run, places
        row = end


def train(tokens: DataFrame, voc: Vocabulary, rounds: int = ROUNDS) -> Model:
    """The model of all rows of a stored table (key, ids): each in one of `rounds` rounds, by a hash of its key."""
    spark = tokens.sparkSession
    model = Model(voc)
    turn = F.pmod(F.xxhash64("key"), F.lit(rounds))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def fit(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            start, part = shared.value, TaskContext.get().partitionId()
            m = Model(start.voc)
            m.rows[:] = start.rows
            rng = np.random.default_rng(part)
            squares, touched = np.ones_like(m.rows), np.zeros(len(m.rows), np.float32)
            for batch in batches:
                for _, _, run, _ in _runs(batch.column(0)):
                    learn(m, run, rng, squares, touched, RATE / (1 + k))
            for b in range(0, len(m.rows), BLOCK):
                n = touched[b : b + BLOCK]
                if n.any():
                    moved = (m.rows[b : b + BLOCK] - start.rows[b : b + BLOCK]) * n[:, None]
                    yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "salt": pa.array([part % 16], pa.int32()), "moved": [moved.astype(np.float32).tobytes()], "n": [n.tobytes()]})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for b, moved, n in zip(batch.column("block").to_pylist(), batch.column("moved").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    new = [np.frombuffer(moved, np.float32), np.frombuffer(n, np.float32)]
                    sums[b] = [x + y for x, y in zip(sums[b], new, strict=True)] if b in sums else new
            for b, (moved, n) in sums.items():
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "salt": pa.array([0], pa.int32()), "moved": [moved.tobytes()], "n": [n.tobytes()]})

        schema = "block int, salt int, moved binary, n binary"
        found = tokens.where(turn == k).select("ids").mapInArrow(fit, schema)
        # first sixteen sums for each block, then one, in the order of tasks
        for by in (["block", "salt"], ["block"]):
            found = found.repartition(*by).sortWithinPartitions("block", "salt", F.xxhash64("moved")).mapInArrow(add, schema)
        rows = model.rows.copy()
        for r in found.collect():
            n = np.frombuffer(r["n"], np.float32)
            rows[r["block"] : r["block"] + len(n)] += np.frombuffer(r["moved"], np.float32).reshape(len(n), -1) / np.maximum(n, 1)[:, None]
        model = Model(voc)
        model.rows[:] = rows
    return model


def scored(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    spark = docs.sparkSession
    held = in_fold(F.col("doc_id"), 5, 1).alias("held_out")
    counts = stored(token_counts(docs.where(~held) if learn_from is None else learn_from), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens_n, tokens_v = total["n"], total["v"]
    voc = vocabulary(counts)
    tokens = stored(numbered(docs, voc, [F.col("doc_id"), held]), "tokens")
    training = tokens.where("not held_out") if learn_from is None else stored(numbered(learn_from, voc, [F.lit(False).alias("held_out")]), "training")
    model = train(training, voc)
    shared = spark.sparkContext.broadcast(model)

    names = ["doc_id", "held_out", "key", "n_tokens", "known", "own", "others"]
    numbers = tokens.select("ids", *names)
    tail = tokens.select("key", F.explode("words").alias("token")).join(counts, "token", "left")
    log_c = F.round(F.log10(F.coalesce("n", F.lit(0)) + 0.5) * SHIFT).cast("long")
    found = tail.groupBy("key").agg(F.sum(log_c).alias("tail"), F.count("n").alias("tail_known"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbers.drop("ids").schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            offsets = batch.column("ids").offsets.to_numpy()
            sums = [np.zeros(0, np.int64)]
            for a, b, run, places in _runs(batch.column("ids")):
                p = np.round(m.log_probabilities(run)[places - CONTEXT] / np.log(10) * SHIFT).astype(np.int64)
                sums.append(np.add.reduceat(p, offsets[a:b] - offsets[a]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.concatenate(sums))], names=[*names, "neural"])

    whole = numbers.mapInArrow(score, f"{kind}, neural long").join(found, "key", "left")
    mass = F.coalesce("tail", F.lit(0)) + F.col("own")
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens_n).cast("long").alias("train_tokens"),
        (mass / float(SHIFT) - F.col("n_tokens") * float(np.log10(tokens_n + 0.5 * (tokens_v + 1)))).alias("base_score"),
        ((F.coalesce("tail", F.lit(0)) + F.col("others") + F.col("neural")) / float(SHIFT)).alias("score"),
    )
