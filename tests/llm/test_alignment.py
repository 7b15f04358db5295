"""Cross-tokenizer alignment against a plain definition with the libraries' own encoders."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fathomgrid.llm import alignment

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " ", "\n", " \n a", "a \n", "  two  spaces \n\n x", "\ttab\tx \n", "<|endoftext|> <s> </s> <0x41> a", "a▁b c", "▁", "x" * 3000, "é" * 50 + " ﬁ １ 日本語 ok", "\nstart", "a\r\n b 　 c\xa0 d\x1c e",
    "\x00 z", "don't it's  I'll", "😀 😀x", "the the the", "the the the", "é ́", "   ", "a" + " " * 300 + "b", "1234567 12,5", "ab" * 5000 + " cd",
]


@cache
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    byte_of = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printable)}
    a_bytes = lambda i: bytes(byte_of[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, cache(a_bytes), cache(b_bytes)


def groups(text):
    """The groups of a text as lists of A ids and B ids, by the definition."""
    a, b, a_bytes, b_bytes = libraries()
    if not text:
        return []
    data = (" " + text).encode()
    left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if b"".join(map(a_bytes, left)) != data or b"".join(map(b_bytes, right)) != data:
        return []
    out, i, j, x, y, ga, gb = [], 0, 0, 0, 0, [], []
    while i < len(left) or j < len(right):
        if x <= y and i < len(left):
            ga.append(left[i])
            x += len(a_bytes(left[i]))
            i += 1
        else:
            gb.append(right[j])
            y += len(b_bytes(right[j]))
            j += 1
        if x == y:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def plain(texts):
    found = [groups(t) for t in texts]
    links = [Counter((p, q) for ga, gb in g for p in ga for q in gb) for g in found]
    held = Counter(pair for x in links for pair in x)
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    for g, x in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        yield (
            sum(len(ga) for ga, _ in g), sum(len(gb) for _, gb in g), len(g), sum(x.values()),
            sum(n for (p, q), n in x.items() if held[p, q] == best[p]), sum(n * held[pair] for pair, n in x.items()), hashlib.sha256(text.encode()).hexdigest() if g else "",
        )


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check(spark, texts, parts=3):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(parts)
    out = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.linked(df).collect()}
    assert len(out) == len(texts)
    for i, want in enumerate(plain(texts)):
        assert out[i] == want, (i, texts[i])


def test_equals_the_definition(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(250).collect()]
    check(spark, texts + ODD)


def test_small_blocks_parts_and_calls(spark, monkeypatch):
    # the limits are read in the worker, so the parts run here
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()] + ODD
    t = alignment.tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    usual = alignment.Block(alignment.Segments(t), texts)
    for part, call, known in ((300, 50, 20), (1000, 1 << 16, 100), (1 << 20, 10, 1 << 20)):
        monkeypatch.setattr(alignment, "PART", part)
        monkeypatch.setattr(alignment, "CALL", call)
        monkeypatch.setattr(alignment, "KNOWN", known)
        found = alignment.Block(alignment.Segments(t), texts)
        assert found.digests == usual.digests and (found.numbers == usual.numbers).all()
        assert (found.key == usual.key).all() and (found.times == usual.times).all() and (found.at == usual.at).all()


def test_random_texts(spark):
    rng = random.Random(4)
    letters = ["a", "b", "the", "ing", " ", " ", "\n", "\t", "é", "▁", "'s", "1", "😀", "　", "\xa0", ".", "\r"]
    check(spark, ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 30))) for _ in range(400)], 5)


def test_rank_library_equals_the_file(spark):
    a, *_ = libraries()
    t = alignment.tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = [" " + r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").limit(400).collect()]
    assert t._encode_a(texts) == [x.ids for x in a.encode_batch(texts, add_special_tokens=False)]


def test_empty_extra_columns_and_text_ids(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], SCHEMA)
    assert alignment.linked(docs.limit(0)).count() == 0
    wide = docs.selectExpr("cast(doc_id as string) doc_id", "text", "1 as block", "2 as n_a", "'x' as codes", "3 as `odd name`").union(docs.selectExpr("cast(null as string)", "text", "1", "2", "'x'", "3"))
    out = alignment.linked(wide)
    assert out.columns == ["doc_id", *COLUMNS] and {r["doc_id"]: r["n_links"] for r in out.collect()} == {"1": 2, None: 2}


def test_hot_group_is_not_expanded():
    t = alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    n, two, one, pair = 50_000, t.bytes[0].index(b"ab"), t.bytes[1].index(b"<"), t.bytes[1].index(b"in")
    t.encode = lambda segments: (np.full(n, two), np.array([one, *[pair] * (n - 1), one]), np.arange(1), np.array([2 * n]), np.zeros(1, bool))
    g = alignment.Groups(t, [" x"])  # the two sides end together at the very end only
    assert g.numbers.tolist() == [[n, n + 1, 1, n * (n + 1)]] and sorted(g.times.tolist()) == [2 * n, n * (n - 1)]


@pytest.mark.parametrize("cuts", [True, False])
def test_uncut_texts(cuts, monkeypatch):
    t = alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    usual = alignment.Block(alignment.Segments(t), ODD)
    t.cuts = cuts
    found = alignment.Block(alignment.Segments(t), ODD)
    assert found.digests == usual.digests and (found.key == usual.key).all()
