"""BPE, unigram counts and packing."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from fathomgrid.llm import bpe, packing, token_counts

ODD = ["a", "b", "the", "ing", "'s", "'", "é", "É", "ß", "²", "1", " ", "\n", "\u0301", "中", "İ", "Σ", "\x1c", "\x85", "<|endoftext|>", "<|", "🎉", "\u200d", "…", "_", "\x00", "٣", "ª", "\xa0"]
SCHEMA = "doc_id long, text string, n_tokens string"  # a clashing extra column


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def texts(n=400):
    rng = random.Random(5)
    out = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    out += ["".join(rng.choice("abcdeinrstélt") for _ in range(rng.randint(40, 2000))) for _ in range(60)]
    return out + [c * n for c in ("a", "b!", "é", "aaab") for n in (10, 500, 5000)] + [""]


def test_ids_equal_the_library(library):
    c = bpe.codec(bpe.default_path())
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert c.ids(t) == ids
        assert c.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_tree_joins_are_exact():
    c, rng = bpe.codec(bpe.default_path()), random.Random(6)
    for _ in range(200):
        data = "".join(rng.choice("aeinrstlhd") for _ in range(rng.randint(2, 200))).encode()
        whole = [c.inner[b] for b in data[:-1]] + [c.last[data[-1]]]
        k = rng.randint(1, len(data) - 1)
        assert c.joined(c.merged(whole[:k]), c.merged(whole[k:])) == c.merged(whole)


def test_digests_of_odd_rows_and_blocks(spark, library):
    some = [None, "", *texts(60), "ab " * 50, "x" * 3000 + " don't"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(some)] + [(None, "same", "x"), (None, "same", "x")], SCHEMA)
    for kwargs in ({}, {"long": 50, "block": 40}):
        out = bpe.digests(docs, **kwargs).collect()
        assert len(out) == docs.count()
        for r in out:
            t = "same" if r["doc_id"] is None else some[r["doc_id"]] or ""
            ids = library.encode(t, add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(docs.limit(0)).count() == 0


def test_round_trip_tables(spark, library):
    docs = spark.createDataFrame([(1, "The end, again", "x"), (2, None, "x")], SCHEMA)
    ids = bpe.ids_table(docs)
    back = {r["doc_id"]: r["text"] for r in bpe.decoded_table(ids).collect()}
    assert back == {1: library.decode(library.encode("The end, again", add_special_tokens=False).ids, skip_special_tokens=False), 2: ""}


def test_unigram_counts_equal_the_library(spark):
    t = Tokenizer(models.Unigram(token_counts_vocabulary(), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(7)
    odd = ["a", "b", "the", "ing", "é", "É", " ", "  ", "\n", "中", "İ", "▁", "🎉", "<s>", "<0x0A>", "\x00", "q", "ก"]
    some = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(800)] + [None, "", "word " * 20_000, "x" * 5000]
    docs = spark.createDataFrame([(i, x, "n") for i, x in enumerate(some)], SCHEMA)
    out = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs).collect()}
    assert len(out) == len(some)
    for i, x in enumerate(some):
        assert out[i] == len(t.encode(x or "", add_special_tokens=False).ids)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def token_counts_vocabulary():
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_path())
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


def test_ties_take_the_first_candidate():
    c = token_counts.Counter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("▁ab", -3.0)])
    assert c.best("▁ab") == (-3.0, 1)  # the longest match comes first, equal sums don't replace it


def plain_sweep(is_gap):
    """Pairs of a gap and a piece, by a stack."""
    stack, out = [], []
    for i, g in enumerate(is_gap):
        if g:
            stack.append(i)
        elif stack:
            out.append((stack.pop(), i))
    return sorted(out)


def test_sweeps_over_ranges_with_carried_borders_equal_one_sweep():
    rng = random.Random(8)
    for _ in range(300):
        is_gap = np.array([rng.random() < rng.choice([0.3, 0.5, 0.7]) for _ in range(rng.randint(1, 60))])
        a, b = packing.matches(is_gap)
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == plain_sweep(is_gap)
        cuts = sorted({0, len(is_gap), *(rng.randint(0, len(is_gap)) for _ in range(4))})
        found, left, counts = [], {}, []
        for part, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
            a, b = packing.matches(is_gap[x:y])
            found += zip((a + x).tolist(), (b + x).tolist(), strict=True)
            rest = [i for i in range(x, y) if i - x not in {*a.tolist(), *b.tolist()}]
            left[part] = [i for i in rest if not is_gap[i]], [i for i in rest if is_gap[i]][::-1]
            counts.append((part, *map(len, left[part])))
        for of, at, other, first, n in packing.carried(counts):
            found += [(left[other][1][first + k], left[of][0][at + k]) for k in range(n)]
        assert sorted(found) == plain_sweep(is_gap)


def best_fit_decreasing(sizes, cap):
    import bisect

    gaps = []
    n = 0
    for size in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, size)
        if i == len(gaps):
            n, gap = n + 1, cap
        else:
            gap = gaps.pop(i)
        if gap > size:
            bisect.insort(gaps, gap - size)
    return n


KINDS = {
    "uniform": (512, 700, lambda r: r.randint(1, 512)),
    "large": (512, 700, lambda r: r.randint(150, 280)),
    "small": (512, 700, lambda r: r.choice([1, 2, 3, 5, 40, 300])),
    "equal": (512, 700, lambda r: 171),
    "ones": (2048, 6000, lambda r: 1),
    "20 to 40": (2048, 8000, lambda r: r.randint(20, 40)),
    "50 to 150": (2048, 4000, lambda r: r.randint(50, 150)),
    "100 to 300": (2048, 2000, lambda r: r.randint(100, 300)),
    "third to half": (2048, 1000, lambda r: r.randint(683, 1024)),
    "texts": (2048, 3000, lambda r: int(min(2048, max(1, r.lognormvariate(5.5, 1))))),
    "narrow": (7, 300, lambda r: r.randint(1, 7)),
}


@pytest.mark.parametrize("kind", KINDS)
def test_placed_fills_no_sequence_over_and_nearly_as_few_as_best_fit(spark, kind, monkeypatch):
    monkeypatch.setattr(packing, "RANGE", 300)  # many ranges, with matches over their borders
    rng, (cap, n, draw) = random.Random(9), KINDS[kind]
    sizes = [draw(rng) for _ in range(n)]
    path = f"{spark.conf.get('spark.checkpoint.dir')}/sizes-{kind.replace(' ', '')}"
    spark.createDataFrame(list(enumerate(sizes)), "number long, size int").write.mode("overwrite").parquet(path)
    supersteps: list[int] = []
    out = packing.placed(spark.read.parquet(path), cap, supersteps.append).collect()
    assert sorted(r["number"] for r in out) == list(range(n)) and supersteps[0] <= 40
    seqs: dict = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], sizes[r["number"]]))
    for pieces in seqs.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= cap
    assert len(seqs) <= 1.03 * best_fit_decreasing(sizes, cap) + 1


def test_pack(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(None, None), (70007, ""), (70007, ""), (90009, "word " * 9000)], "doc_id long, text string"))
    out = packing.pack(docs, with_ids=True).toPandas()
    want = sorted([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect())
    got = []
    for _, g in out[out.doc_id != 70007].groupby("doc_id", dropna=False):
        g = g.sort_values("piece")
        assert g.start.tolist() == (g.length.cumsum() - g.length).tolist() and (g.length[:-1] == 2048).all()
        got.append([int(i) for x in g.ids for i in x])
    assert sorted([*got, [0], [0]]) == want
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(out.ids, out.ids_crc32, strict=True))
    out = out.sort_values(["sequence_id", "offset"])
    by = out.groupby("sequence_id")
    assert (out.offset == by.length.cumsum() - out.length).all() and by.length.sum().max() <= 2048
    total = int(out.length.sum())
    assert out.sequence_id.nunique() <= 1.02 * -(-total // 2048) + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_long_texts_of_any_characters_are_cut_and_joined(spark, library):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["a", "Be", "é", "中", "Σ", "'s", "1", "́", "ß", "<|", "x" * 90]) for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 300))) for _ in range(25)] + ["plain words " * 400 + "中 and " + "more plain words " * 400, "中" * 3000]
    for t in texts:
        parts = list(bpe.any_parts(t, 100))
        assert len(parts) > 1 or len(t) < 400 or " " not in t
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in bpe.digests(docs, long=200, block=100).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert (out[i]["n_tokens"], out[i]["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_token_counts_of_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "one two", "x"), (1, "one two", "x"), (None, "one two", "x"), (2, None, "x")], "doc_id long, text string, n_tokens string")
    out = sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(docs).collect()), key=repr)
    n = out[0][1]
    assert n > 0 and out == [(1, n), (1, n), (2, 0), (None, n)]


def test_pack_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", 3), (2, None, 4)], "doc_id long, text string, piece int").selectExpr("*", "1 as number", "2 as size", "'x' as sequence_id")
    assert sorted(r["doc_id"] for r in packing.pack(docs).collect()) == [1, 2]


def test_merging_by_heap_equals_merging_by_scan(monkeypatch):
    c = bpe.codec(bpe.default_path())
    rng = random.Random(12)
    for n in (200, 333, 1000):
        for letters in (b"a", b"ab", b"theinra", bytes(range(256))):
            symbols = [c.inner[rng.choice(letters)] for _ in range(n)]
            by_heap = c.merged(symbols)
            with monkeypatch.context() as m:
                m.setattr(bpe, "LEAF", 10_000)
                assert by_heap == c.merged(symbols)
