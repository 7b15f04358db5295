"""Language identification, quality classifier, language model, quality rules."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fathomgrid.llm import language, lm, quality_classifier, quality_rules
from fathomgrid.llm.common import text_chunks, word_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DOCS = "/root/testdata/sf0.001/documents.parquet"
LABELS = "/root/testdata/sf0.001/labels.parquet"


def rows(texts, lang="en"):
    return [(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \t\n", "a", "the end", "x" * 200_000, "the end", "12 34!", "É", "\u3000 …", "word " * 30_000]
    return spark.createDataFrame(rows(texts) + [(None, "no id", None, None, None), (4, "the end", "en", "s", 7)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language_totals_match_brute_force():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abÉ z.\n"), size=n)) for n in rng.integers(0, 60, 300)] + ["q" * 100_000, ""]
    model = language.Model(["a", "b"], rng.integers(0, 50, (language.BUCKETS, 2)))
    mix = lambda x, n: (((x + n) * 0x9E3779B1) & 0xFFFFFFFF) >> 18
    for row, end, at, points in text_chunks(pa.array(texts)):
        found = language.totals(model, points, at)
        for i in range(row, end):
            low = [ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in texts[i][:500]]
            if len(texts[i]) > 500:
                continue
            want = [0, 0]
            for n in language.ORDERS:
                for k in range(len(low) - n + 1):
                    h = low[k]
                    for c in low[k + 1 : k + n]:
                        h = (h * 1_000_003 + c) & 0xFFFFFFFF
                    for j in (0, 1):
                        want[j] += int(model.weights[j, mix(h, n)])
            assert found[i - row].tolist() == want


def test_language_odd_rows(spark, odd):
    out = {r["doc_id"]: r for r in language.identify(odd).collect()}
    assert len(language.identify(odd).collect()) == odd.count()
    assert out[0]["lang_pred"] == out[1]["lang_pred"] == out[2]["lang_pred"] == out[7]["lang_pred"] == "und"
    assert out[8]["lang_pred"] == "en" and 0 <= out[8]["score"] <= 1
    assert language.identify(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd.withColumn("lang", odd["lang"].substr(9, 1)).drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in language.identify(docs).collect())


def test_keep_known_keeps_columns(spark, odd):
    wide = odd.selectExpr("*", "1 as lang_pred", "2 as score", "3 as `odd name`")
    kept = language.keep_known(wide)
    assert kept.columns == wide.columns
    assert kept.where("text is null or text = ''").count() == 0
    assert kept.where("text = 'the end'").count() == 3


def test_keep_known_drops_unlearnt_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id")
    clean = docs.join(labels, "doc_id")
    kept = language.keep_known(docs).join(labels, "doc_id")
    for lang in ("en", "de", "fr", "es"):
        assert kept.where(f"lang = '{lang}'").count() >= 0.98 * clean.where(f"lang = '{lang}'").count()
    some = docs.selectExpr("doc_id", "text", "case when lang != 'de' then lang end as lang", "lang as spoken").where("length(text) >= 100")
    foreign = some.where("spoken = 'de'")
    assert language.keep_known(some).where("spoken = 'de'").count() <= 0.1 * foreign.count()


def test_quality_features_match_brute_force():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab é\n"), size=n)) for n in rng.integers(0, 40, 200)] + ["dog dog dog", "", "a"]
    for row, end, data, at in quality_classifier._chunks(pa.array(texts)):
        (grams, g), (pairs, p) = quality_classifier.features(data, at)
        for i in range(row, end):
            b = texts[i].encode()
            shape = [int(quality_classifier.SHAPES[x]) for x in b]
            want = [((sum(c << (6 * j) for j, c in enumerate(shape[k : k + 6])) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> 49 for k in range(len(b) - 5)]
            assert grams[g[i - row] : g[i - row + 1]].tolist() == want
            words = b.split()
            got = pairs[p[i - row] : p[i - row + 1]].tolist()
            assert len(got) == max(0, len(words) - 1)
            assert [x == quality_classifier.BUCKETS >> 1 for x in got] == [x == y for x, y in zip(words, words[1:], strict=False)]


def test_quality_cut_is_exact(spark):
    rng = np.random.default_rng(3)
    data = [(float(w), int(d)) for w, d in zip(rng.normal(0, 2, 500), rng.integers(-(1 << 62), 1 << 62, 500), strict=True)]
    weights = spark.createDataFrame(data * 2, "log_weight double, draw long")  # each row twice: ties
    for size in (0, 1, 77, 400, 1000, 5000):
        out = quality_classifier.resampled(weights, size=size).collect()
        order = sorted((r["noisy_weight"] for r in out), reverse=True)
        kept = sorted((r["noisy_weight"] for r in out if r["kept"]), reverse=True)
        n = min(1000, size + size % 2)  # ties at the cut stay together
        assert kept == order[:n]


def test_quality_separates_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality_classifier.classify(docs, labels).join(labels, "doc_id")
    good, bad = out.where("quality = 1 and toxic = 0"), out.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count()
    assert bad.where("kept").count() <= 0.1 * bad.count()


def test_quality_catches_toxic_words(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = quality_classifier.classify(docs, labels).join(labels, "doc_id").where("quality = 1")
    clean, toxic = (out.where(f"toxic = {k}") for k in (0, 1))
    assert toxic.where("not kept").count() >= 0.6 * toxic.count()
    assert clean.where("kept").count() >= 0.99 * clean.count()


def test_quality_words_leave_the_mixture_of_languages_out():
    rng = np.random.default_rng(5)
    raw = rng.integers(0, 400, (2, quality_classifier.WORDS))
    target = np.stack([raw[0] // 2, raw[1] // 20])  # one language ten times rarer in the target
    raw[1, 7], target[:, 7] = 400, 0
    ratios = quality_classifier.word_ratios(target, raw)
    assert ratios[7] < 0 and (ratios < 0).mean() < 0.001


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0), (5, None, None), (7, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(odd, labels).count() == odd.count()
    assert quality_classifier.classify(empty(spark), labels).count() == 0
    none = labels.where("doc_id = 99")
    assert quality_classifier.keep_good(odd, none).count() == odd.count()
    wide = odd.selectExpr("*", "1 as draw", "2 as log_weight", "3 as `__key`", "4 as `row`")
    assert quality_classifier.keep_good(wide, labels).columns == wide.columns


def test_language_model_base_and_normalisation(spark):
    docs = spark.read.parquet(DOCS)
    out = {r["doc_id"]: r for r in lm.scored(docs).collect()}
    words = {r["doc_id"]: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])), None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in words.items():
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in counts for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), abs_tol=1e-5)
    test = [r for i, r in out.items() if held[i]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)


def test_language_model_beats_the_base_by_a_margin(spark):
    out = lm.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert (out["sum(score)"] - out["sum(base_score)"]) / out["sum(n_tokens)"] > 0.1


def plain_vocabulary(counts):
    """A vocabulary of counts by token, with endings counted by plain code."""
    head = sorted(((t, n) for t, n in counts.items()), key=lambda x: (x[0] != lm.END, -x[1], x[0]))
    voc = lm.Vocabulary([t for t, _ in head], np.array([n for _, n in head], np.int64))
    n, v = Counter(), Counter()
    for t, k in head[voc.size :]:
        n[lm.ending_of(t)] += k
        v[lm.ending_of(t)] += 1
    top = sorted(n, key=lambda e: (-n[e], e))[: lm.ENDINGS - 1]
    sums = lambda x: np.array([*(x[e] for e in top), *[0] * (lm.ENDINGS - 1 - len(top)), sum(x.values()) - sum(x[e] for e in top)], np.int64)
    return voc.with_endings(top, sums(n), sums(v))


def small_counts(rng, n=40):
    return {lm.END: 50} | {f"w{k}{rng.choice(list('abc'))}{k % 7}".encode(): int(rng.integers(1, 90)) for k in range(n)}


@pytest.fixture
def small_sizes(monkeypatch):
    for name, size in (("VOCABULARY", 24), ("SINGLE", 5), ("GROUPS", 4), ("ENDINGS", 3), ("CLASSES", 12)):
        monkeypatch.setattr(lm, name, size)
    monkeypatch.setattr(lm.Vocabulary, "BEGIN", lm.HEAD + 3)


def plain_log10(model, tokens):
    """The log10 probability of each token of a text (and its end), by the definition, in float64."""
    voc, rows, total = model.voc, model.rows.astype(np.float64), []
    of = {t: i for i, t in enumerate(voc.head)}
    size = lm.SIZE
    seen = lambda i: rows[i, :size]
    numbers = [voc.BEGIN] * lm.CONTEXT + [of.get(t, lm.HEAD + voc.ending_of(t)) for t in tokens]
    place = rows[model.place_at : model.place_at + lm.CONTEXT, :size]
    for k, t in enumerate(tokens):
        q = sum(place[i] * seen(voc.row_of[numbers[lm.CONTEXT + k - 1 - i]]) for i in range(lm.CONTEXT))
        said = rows[model.said_at : model.said_at + lm.CLASSES]
        scores = said[:, :size] @ q + said[:, size]
        i = numbers[lm.CONTEXT + k]
        c = voc.class_of[i]
        p = scores[c] - np.log(np.exp(scores).sum())
        p /= np.log(10)
        if lm.SINGLE <= c < lm.SINGLE + lm.GROUPS:
            group = voc.groups[c - lm.SINGLE]
            at = model.token_at + (c - lm.SINGLE) * voc.width
            scores = rows[at : at + len(group), :size] @ q + rows[at : at + len(group), size]
            p += (scores[voc.place_of[i]] - np.log(np.exp(scores).sum())) / np.log(10)
        elif c >= lm.SINGLE + lm.GROUPS:
            n = voc.counts[of[t]] if t in of else 0
            p += np.log10(n + 0.5) - voc.norms[c - lm.SINGLE - lm.GROUPS] / lm.SHIFT
        total.append(p)
    return total


def test_language_model_probabilities_sum_to_one(small_sizes):
    rng = np.random.default_rng(1)
    voc = plain_vocabulary(small_counts(rng))
    model = lm.Model(voc)
    model.rows[:] = rng.normal(0, 0.5, model.rows.shape)
    tokens = [*voc.head[1:9], *voc.head[30:33]]
    # all tokens that were counted, and one stranger of each ending, of which there are none or one class
    strangers = {voc.ending_of(e): e for e in [*voc.endings, b"\xff\xff"]}.values()
    for k in (0, 3, 9):
        whole = [*voc.head, *strangers]
        assert math.isclose(sum(10 ** plain_log10(model, [*tokens[:k], t])[k] for t in whole), 1, rel_tol=1e-6)


def test_language_model_equals_the_definition_in_any_batch(small_sizes):
    rng = np.random.default_rng(2)
    voc = plain_vocabulary(small_counts(rng))
    model = lm.Model(voc)
    model.rows[:] = rng.normal(0, 1, model.rows.shape)
    model.rows[model.said_at : model.said_at + lm.CLASSES] *= 30  # far from each other: nothing overflows
    numbers = [rng.integers(0, len(voc.head), rng.integers(1, 400)).astype(np.int32) for _ in range(60)]
    run = lambda texts: np.concatenate([np.concatenate((np.full(lm.CONTEXT, voc.BEGIN, np.int32), t)) for t in texts])
    alone = [model.log_probabilities(run([t]))[: len(t)] for t in numbers]
    together = model.log_probabilities(run(numbers))
    at = 0
    for t, one in zip(numbers, alone, strict=True):
        assert np.array_equal(together[at : at + len(t)], one)  # to the last bit
        at += len(t) + lm.CONTEXT
    assert np.isfinite(together).all()


def test_language_model_scores_equal_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(DOCS).limit(60)
    models = []

    def untrained(tokens, voc):
        model = lm.Model(voc)
        model.rows[:] += np.random.default_rng(3).normal(0, 0.5, model.rows.shape)
        models.append(model)
        return model

    monkeypatch.setattr(lm, "train", untrained)
    monkeypatch.setattr(lm.head_of, "__defaults__", (100,))
    out = {r["doc_id"]: r["score"] for r in lm.scored(docs).collect()}
    texts = {r["doc_id"]: [*word_bytes((r["text"] or "").encode()), lm.END] for r in docs.collect()}
    counts = Counter(t for i, ts in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1 for t in ts)
    voc = models[0].voc
    assert len(voc.head) <= 100 < len(counts)
    # tokens outside of the head have their counts as well
    plain = Counter(counts)
    for i, ts in texts.items():
        want = 0.0
        for t, p in zip(ts, plain_log10(models[0], ts), strict=True):
            want += p
            if t not in voc.head:
                want += math.log10(plain[t] + 0.5) - math.log10(0.5)
        assert math.isclose(out[i], want, rel_tol=1e-5, abs_tol=1e-4)


def test_equal_texts_have_equal_scores(spark):
    docs = spark.read.parquet(f"{DOCS.replace('0.001', '0.01')}")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_text, groups = {}, Counter(texts.values())
    for r in lm.scored(docs).collect():
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["score"])
    assert sum(n > 1 for n in groups.values()) > 20 and all(len(x) == 1 for x in by_text.values())


def test_language_model_learns():
    rng = np.random.default_rng(4)
    voc = plain_vocabulary({lm.END: 1} | {f"t{k:04d}".encode(): 100 for k in range(2000)})
    numbers = np.array([lm.Vocabulary.BEGIN] * lm.CONTEXT + [3, 900, 4, 1500] * 4000, np.int32)
    model = lm.Model(voc)
    before = model.log_probabilities(numbers).mean()
    squares, touched = np.ones_like(model.rows), np.zeros(len(model.rows), np.float32)
    for _ in range(6):
        lm.learn(model, numbers, rng, squares, touched, lm.RATE)
    assert model.log_probabilities(numbers).mean() > before + 4
    assert touched.sum() > 0


def test_language_model_odd_rows(spark, odd):
    out = lm.scored(odd.selectExpr("*", "1 as held_out", "2 as ids", "3 as key", "4 as own"))
    assert out.count() == odd.count()
    r = {x["doc_id"]: x for x in out.collect()}
    assert r[0]["n_tokens"] == r[1]["n_tokens"] == 1 and r[0]["score"] == r[1]["score"]
    assert lm.scored(empty(spark)).count() == 0


def brute_measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {i + k for i, x in enumerate(tri) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_measures(spark, odd):
    texts = ["a b c a b c", "a a a a", "x\nx\n\n x\nx", "a b c d a b c d a", "#*$%&|<> é"] + [r["text"] for r in spark.read.parquet(DOCS).collect()]
    for docs in (spark.createDataFrame(rows(texts), SCHEMA), odd):
        out = quality_rules.judged(docs).join(docs.select("doc_id", "text").distinct(), "doc_id")
        for r in out.collect():
            want = brute_measures(r["text"])
            assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judged(empty(spark)).count() == 0


def test_quality_rules_against_sql(spark):
    import duckdb

    out = [tuple(r) for r in quality_rules.judged(spark.read.parquet(DOCS)).collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DOCS}'")
    assert sorted(out) == sorted(con.execute(quality_rules.oracle_sql()).fetchall())


def test_quality_rules_find_junk(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality_rules.judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").where("not base_failed")
    assert out.where("quality = 1 and not kept").count() <= 2
    assert out.where("quality = 0 and kept").count() <= 0.2 * out.where("quality = 0").count()


def test_languages_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame(rows(["one two three"] * 5, "en") + rows(["un deux trois"] * 4, "fr") + rows(["x y"] * 1, "dirty") + rows(["y z"], "b"), SCHEMA)
    assert language.languages(docs, 3) == ["b", "en", "fr"]
    monkeypatch.setattr(language.languages, "__defaults__", (2,))
    assert language.train(docs).langs == ["en", "fr"]
    out = language.identify(docs.selectExpr("*", "'x' as lang_pred", "1 as held_out", "2 as score")).collect()
    assert len(out) == 11 and {r["lang_pred"] for r in out} <= {"en", "fr"}


def test_quality_rules_with_clashing_columns(spark, odd):
    wide = odd.selectExpr("*", "1 as n_words", "2 as kept", "3 as w", "4 as t")
    assert quality_rules.judged(wide).count() == odd.count()
