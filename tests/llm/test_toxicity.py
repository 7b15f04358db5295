"""Toxicity: words and n-grams by plain definition, scores by brute force, held-out accuracy, defined cases."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fathomgrid.llm import toxicity
from fathomgrid.llm.common import text_chunks

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_words(text):
    """Distinct words by the definition."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") else c for c in text)
    letter = lambda c: (ord(c) >= 128 and ord(c) not in toxicity._BLANKS) or c.isascii() and c.isalnum()
    out, word = set(), ""
    for i, c in enumerate(low):
        mark = 32 < ord(c) < 127 and 0 < i < len(low) - 1 and letter(low[i - 1]) and letter(low[i + 1])
        if letter(c) or mark:
            word += c
        elif word:
            out.add(word)
            word = ""
    return out | {word} - {""}


def plain_score(model, text):
    total = 0.0
    for word in plain_words(text):
        padded, grams = f" {word} ", []
        for n in toxicity.ORDERS:
            for k in range(len(padded) - n + 1):
                h = ord(padded[k])
                for c in padded[k + 1 : k + n]:
                    h = (h * 1_000_003 + ord(c)) & 0xFFFFFFFF
                grams.append((((h + n) * 0x9E3779B1) & 0xFFFFFFFF) >> 15)
        z = sum(int(model.weights[g]) for g in grams) / toxicity.WEIGHT / len(grams) + model.bias
        total += math.log1p(math.exp(z)) if z < 60 else z
    return -math.expm1(-total)


@pytest.fixture(scope="module")
def model():
    return toxicity.Model(np.random.default_rng(1).normal(0, 8, toxicity.BUCKETS), -6.0)


def test_scores_equal_brute_force(model):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcÉ é!.'0 \n－×") for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    texts += [None, "", "  \n", "a", "id!ot. don't", "end.", "Ünïcode", "－　x", "word word Word"]
    found = np.concatenate([model.scores(points, at) for _, _, at, points in text_chunks(pa.array(texts), 200)])
    for text, score in zip(texts, found, strict=True):
        assert math.isclose(score, plain_score(model, text or ""), rel_tol=1e-6, abs_tol=1e-8)
    again = np.concatenate([model.scores(points, at) for _, _, at, points in text_chunks(pa.array(texts[::-1]), 1 << 20)])[::-1]
    assert np.array_equal(found, again)  # whatever the batch


def test_long_texts_are_read_in_parts(model, monkeypatch):
    text = " ".join(f"w{i % 700}x" for i in range(3000))
    whole = [model.scores(points, at) for _, _, at, points in text_chunks(pa.array([text]))]
    monkeypatch.setattr(toxicity, "PART", 500)
    assert np.array_equal(np.concatenate(whole), np.concatenate([model.scores(points, at) for _, _, at, points in text_chunks(pa.array([text]))]))
    assert np.isfinite(model.scores(np.full(5000, 97, np.uint32), np.array([0, 5000]))).all()  # one long word


def test_unseen_endings_and_misspellings(monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 9)))
    bad = ["gruzzle" + x for x in ("", "s", "d", "r", "ment", "ing")]
    texts, toxic = [], []
    for i in range(600):
        some = {word() for _ in range(rng.randrange(5, 80))}
        toxic.append(i % 4 == 0)
        texts.append(sorted(some | ({rng.choice(bad)} if toxic[-1] else set())))
    learnt = toxicity.train(np.array(toxic), texts)
    score = lambda t: learnt.scores(*[(p, at) for _, _, at, p in text_chunks(pa.array([t]))][0])[0]
    clean = " ".join(word() for _ in range(300))
    assert score(clean) < 0.5
    for unseen in ("gruzzled!", "gruzzleful", "GRUZZLE", "gruzzlle"):
        assert score(f"{clean} {unseen} {clean}") >= toxicity.TOXIC


def test_held_out_toxic_texts_are_found_and_clean_ones_left(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.scored(docs, labels).collect()
    assert len(out) == docs.count()
    known = {r["doc_id"]: r for r in labels.join(docs.select("doc_id", "lang"), "doc_id").collect()}
    held = [r for r in out if r["held_out"] and r["doc_id"] in known]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in out)
    clean = [r["predicted"] for r in held if known[r["doc_id"]]["toxic"] == 0]
    # English has more than two hundred labelled toxic texts, the others some tens each
    toxic, english = ([r["predicted"] for r in held if known[r["doc_id"]]["toxic"] == 1 and known[r["doc_id"]]["quality"] == 1 and known[r["doc_id"]]["lang"] in langs] for langs in (("de", "en", "es", "fr"), ("en",)))
    assert sum(clean) <= 0.01 * len(clean) and sum(english) >= 0.95 * len(english) > 0 and sum(toxic) >= 0.85 * len(toxic), (sum(clean), sum(english), len(english), sum(toxic), len(toxic))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_text = {}
    for r in out:
        assert by_text.setdefault(texts[r["doc_id"]], r["score"]) == r["score"]


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "VISITS", 200)
    texts = [None, "", " \n", "a good day", "an awful idiot", "x" * 300_000, "an awful idiot", "12 !", "word " * 30_000]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "no id", None, None, None), (3, "a good day", None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i in (4, 6))) for i in range(9)] + [(4, 0, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    wide, odd = docs.selectExpr("*", "1 as score", "2 as toxic", "3 as `odd name`", "4 as words"), labels.selectExpr("*", "'x' as text", "5 as held_out")
    out = toxicity.scored(wide, odd).collect()
    assert len(out) == docs.count()
    by = {r["doc_id"]: r for r in out}
    assert [by[i]["score"] for i in (0, 1, 2)] == [0, 0, 0] and by[None]["held_out"] is False
    none = spark.createDataFrame([], docs.schema)
    assert toxicity.scored(none, labels).count() == 0
    nothing = toxicity.scored(docs, spark.createDataFrame([], labels.schema)).collect()
    assert {r["score"] for r in nothing} == {0.0} and len(nothing) == docs.count()
    assert {r["score"] for r in toxicity.scored(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.scored(docs.selectExpr("cast(doc_id as string) doc_id", "text"), labels.selectExpr("cast(doc_id as string) doc_id", "toxic")).count() == docs.count()


def test_sample_is_bounded(spark, monkeypatch):
    for name, value in (("MAX_TOXIC", 5), ("MAX_CLEAN", 7), ("MAX_WORDS", 60)):
        monkeypatch.setattr(toxicity, name, value)
    docs = spark.createDataFrame([(i, f"w{i} a b c d e", "en", "s", 0) for i in range(100)] + [(0, "again a text", "en", "s", 0)] * 20, SCHEMA)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(100)], "doc_id long, quality int, toxic int")
    rows = toxicity.sample(docs, labels).collect()
    assert sum(r["toxic"] for r in rows) == 5 and sum(not r["toxic"] for r in rows) == 5  # 30 words of 6 each
