"""Fingerprints, SimHash linking, components, URL filters, the pipeline."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash

from fathomgrid.llm import fingerprints, graph, simhash, urls
from fathomgrid.llm.common import likely_in, only, word_bytes

DOCS = "/root/testdata/sf0.001/documents.parquet"


def components_of(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randrange(50, 90), rng.randrange(50, 90)) for _ in range(30)] + [(100, k) for k in range(101, 140)]
    want = components_of(140, pairs)
    out = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs + [(None, 3)], "a long, b long")).collect()}
    assert out == {i: want[i] for i in {x for p in pairs if p[0] != p[1] for x in p}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_equal_brute_force_also_in_large_postings(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    values = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(1) << 63) for _ in range(300)}
    values |= {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    pairs = simhash.links(spark.createDataFrame([(v,) for v in signed], "bits long")).collect()
    at = {v: i for i, v in enumerate(signed)}
    found = [(at[r["a"]], at[r["b"]]) for r in pairs]
    assert all((values[a] ^ values[b]).bit_count() <= 2 for a, b in found)
    brute = [(a, b) for a, b in itertools.combinations(range(len(values)), 2) if (values[a] ^ values[b]).bit_count() <= 2]
    assert components_of(len(values), found) == components_of(len(values), brute)


def plain_fingerprint(text):
    words = word_bytes((text or "").encode())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_query(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text")
    extra = [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "two words"), (None, "one"), (906, "A b\tc"), (907, "a B c"), (None, None)]
    docs = docs.union(spark.createDataFrame(extra, "doc_id long, text string")).selectExpr("*", "1 as bits", "2 as component_id")
    out = simhash.linked(docs).collect()
    assert len(out) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    found = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert all(found[i]["fingerprint"] == f"{p:016x}" for i, p in prints.items())
    ids = sorted(texts)
    want = components_of(len(ids), [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 2])
    assert [found[i]["component_id"] for i in ids] == [ids[k] for k in want]
    assert simhash.linked(docs.limit(0)).count() == 0


def edited_words(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return words


def test_near_duplicates_recall_and_precision(spark):
    rng = random.Random(3)
    rows, group = [], []
    for g in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        rows.append((len(rows), " ".join(words)))
        group.append(g)
        for _ in range(2):  # one word in a hundred differs: a similarity of about 0.9
            rows.append((len(rows), " ".join(edited_words(rng, words, max(1, len(words) // 100)))))
            group.append(g)
    rows += [(None, rows[0][1]), (len(rows), rows[0][1].upper()), (len(rows) + 1, None), (len(rows) + 2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None}
    same = [out[i] == out[3 * group[i]] for i in range(450)]
    assert np.mean(same) >= 0.95
    assert all(group[out[i]] == group[i] for i in range(450))
    assert out[450] == 0 and out[451] == out[452] == 451
    wide = docs.selectExpr("*", "1 as component_id", "2 as same", "3 as id")
    kept = simhash.keep_one(wide)
    assert kept.columns == wide.columns
    stay = [r["doc_id"] for r in kept.collect()]
    assert sorted(stay) == sorted(i for i, c in out.items() if i == c)
    assert simhash.keep_one(wide.limit(0)).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(60):  # similarities around 0.8, beside a third text that is like neither or one of them only
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        texts += [" ".join(words)] + [" ".join(edited_words(rng, words, max(1, len(words) // rng.randint(45, 60)))) for _ in range(3)]
    base = [f"v{rng.randrange(5000)}" for _ in range(150)]
    texts += [" ".join(edited_words(rng, base, rng.randint(2, 4))) for _ in range(160)]  # large postings
    texts += [" ".join([*base[:120], *(f"u{rng.random()}" for _ in range(rng.randint(10, 40)))]) for _ in range(160)]
    rng.shuffle(texts)
    sets = [set(simhash.shingle_hashes(word_bytes(t.encode()), 5).tolist()) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (c := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - c)]
    out = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [out[i] for i in range(len(texts))] == components_of(len(texts), pairs)


def test_near_duplicates_come_from_fingerprints(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for _ in range(100):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(100, 400))]
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate([words, edited_words(rng, words, max(1, len(words) // 70))])]
    rows += [(200 + i, " ".join(edited_words(rng, "a b c d e f g h i j k l m n o p q r s t u v w x y z".split() * 6, 2))) for i in range(100)]
    none = lambda rows, *_: rows.selectExpr("key", "id as a", "cast(null as long) as b", "place", "n").limit(0)
    monkeypatch.setattr(simhash, "met_in_postings", none)  # nothing from the rarest shingles
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(i in kept for i in range(0, 201, 2))
    assert sum(i in kept for i in range(1, 200, 2)) <= 2


def test_members_of_a_fingerprint_posting_meet_over_batches(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, 64, dtype=np.uint8)
    rows = []
    for i in range(300):
        x = base.copy() if i % 3 else rng.integers(0, 256, 64, dtype=np.uint8)
        x[rng.choice(64, 6, replace=False)] ^= 1
        rows.append((i, x.view(np.int64).tolist()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        pairs = [tuple(r) for r in simhash.by_fingerprint(spark.createDataFrame(rows, "id long, print array<long>")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(set(pairs)) == len(pairs) and all(a < b and a % 3 and b % 3 for a, b in pairs)
    assert components_of(300, pairs) == [i if i % 3 == 0 else 1 for i in range(300)]


def test_a_posting_makes_one_row_for_each_member(spark):
    rows = [(k, i) for k in range(3) for i in range(200)] + [(9, 5)]
    met = graph.starred_in_postings(spark.createDataFrame(rows, "key long, id long")).collect()
    assert sorted((r["key"], r["a"], r["before"], r["b"]) for r in met) == [(k, 0, i - 1, i) for k in range(3) for i in range(1, 200)]


def test_rows_that_stay_need_no_shuffle(spark):
    ids = spark.createDataFrame([(i,) for i in range(0, 3000, 10)], "id long")
    docs = spark.range(3000).selectExpr("cast(if(id = 1, null, id) as int) as doc_id", "2 as h", "3 as id")
    out = likely_in(docs, "doc_id", ids).collect()
    assert len(out) == 3000 and all(r["__likely"] for r in out if r["doc_id"] is not None and r["doc_id"] % 10 == 0)
    assert sum(r["__likely"] for r in out) <= 320
    assert only(docs, "doc_id", ids.limit(0)).count() == 0
    texts = spark.createDataFrame([(i, " ".join(f"w{random.Random(i % 290).random()}" for _ in range(50))) for i in range(300)], "doc_id long, text string")
    kept = simhash.keep_one(texts.union(spark.createDataFrame([(None, "some other text")], texts.schema)))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "__word" in plan
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, i) for i in range(290)] + [(True, None)]


def walk(text):
    codes, _ = fingerprints._codes([text])
    level, at, step, out = fingerprints.level_of(len(text)), 0, 0, ""
    while codes[at]:
        if step % (1 << level) == 0:
            out += f"{fingerprints._NIBBLES[codes[at]]:x}"
        at += int(fingerprints.MOVES[step % fingerprints.PERIOD][codes[at]])
        step += 1
    return f"{level:x}:{out}"


def test_fingerprints_equal_a_plain_walk():
    rng = random.Random(4)
    texts = ["", "a", "é" * 300, "x" * 9000] + ["".join(rng.choice("abcdé \n中") for _ in range(rng.randint(0, 3000))) for _ in range(120)]
    assert fingerprints.fingerprints_of(texts) == [walk(t) for t in texts]


def test_fingerprints_are_near_after_edits():
    rng = random.Random(5)
    for n in (100, 1000, 20_000):
        text = "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
        at = rng.randrange(n)
        a, b, c = fingerprints.fingerprints_of([text, text[:at] + "zz" + text[at + 1 :], text[::-1]])
        assert fingerprints.likeness(a, a) == 1
        assert fingerprints.likeness(a, b) > fingerprints.likeness(a, c) + 0.2


@pytest.mark.parametrize("size", [0, 1, 5, 200])
def test_compared_with_the_next(spark, size):
    docs = spark.read.parquet(DOCS).select("doc_id", "text").orderBy("doc_id").limit(size)
    if size == 5:
        docs = docs.union(spark.createDataFrame([(None, "last"), (2, None), (2, "again")], "doc_id long, text string"))
    docs = docs.selectExpr("*", "1 as part", "2 as ghost")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = fingerprints.compared(docs).collect()
    assert len(out) == len(rows)
    want = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), walk(t), walk(e), fingerprints.likeness(walk(t), walk(e)), fingerprints.likeness(walk(t), walk(u))))
    key = lambda r: (r[0] is None, r[0], r[2])
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)


def test_near_duplicates_by_fingerprint(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh ijkl") for _ in range(800)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(20 + i, t[:700] + "?" + t[700:]) for i, t in enumerate(texts)] + [(40, texts[0]), (41, None), (42, "")]
    out = {r["doc_id"]: r["class_id"] for r in fingerprints.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[40] == 0 and out[42] == out[41] == 41
    assert sum(out[20 + i] == i for i in range(20)) >= 19 and all(out[i] == i for i in range(20))


def test_url_filters(spark):
    import duckdb

    pages = "/root/testdata/sf0.01/pages.parquet"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{pages}'")
    assert sorted(map(tuple, urls.judged(spark.read.parquet(pages)).collect())) == sorted(con.execute(urls.oracle_sql()).fetchall())


def test_url_filters_odd_rows(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.COM/en/7x?q#f"), (4, "x://a.com/en/"), (5, "x://com/en/1"), (6, "x://xcom/en/1"), (7, "http://"), (8, "x://b.example.net/de/81"), (8, "x://b.example.net/de/81"), (9, "x://h#/en/"), (10, "x://É.org/es/a/b/c/d/e/f")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "'y' as rest", "1 as n")
    out = {r["page_id"]: r for r in urls.judged(pages).collect()}
    assert urls.judged(pages).count() == len(rows)
    assert [(out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.com", "/en/7x", "example.com/en/7", "allow"), ("a.com", "/en/", "com/en/", "block"), ("com", "/en/1", "com/en/", "block"),
        ("xcom", "/en/1", None, "allow"), ("", "", None, "allow"), ("b.example.net", "/de/81", "example.net/de/8", "block"), ("h", "", None, "allow"),
    ]
    assert urls.judged(pages.limit(0)).count() == 0


def test_url_rules_are_the_contracts(spark):
    import duckdb

    wanted = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    rows = [(1, "x://a.com/en/1"), (2, "x://example.com/en/72"), (3, "x://www.Net.NET/de/8"), (4, "x://example.net/de/7"), (5, "x://a.example.net/de/8"), (6, "x://org/es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = {r["page_id"]: r for r in urls.judged(pages).collect()}
    assert [out[i]["rule"] for i in range(1, 7)] == ["com/en/", "example.com/en/7", "net/de/", "net/de/", "example.net/de/8", "org/es/"]
    assert all(r["verdict"] == wanted[r["rule"]] for r in out.values())
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    assert sorted(con.execute(urls.oracle_sql()).fetchall()) == sorted(map(tuple, out.values()))


def test_url_templates_reject_by_purity(spark):
    rules = [("bad.com", "/x/1", "block"), ("good.com", "/x/1", "allow")]
    rows = [(i, f"http://{h}/x/{100 + i if i % 2 else 200 + i}") for i, h in enumerate(["bad.com", "good.com"] * 40)]
    out = urls.judged(spark.createDataFrame(rows + [(900 + i, f"http://bad.com/x/{i + 2}000") for i in range(3)], "page_id long, url string"), rules).collect()
    assert {r["verdict"] for r in out if r["page_id"] >= 900} <= {"allow", "block"}
    labelled = [(i, f"http://bad.com/x/1{i}") for i in range(30)]
    out = urls.judged(spark.createDataFrame(labelled + [(99, "http://bad.com/x/25")], "page_id long, url string"), rules).collect()
    assert {r["page_id"]: r["verdict"] for r in out}[99] == "block"


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= n
        docs, n = out, out.count()
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == n
    assert len(corpus_pipeline.STAGES) == 4


def test_url_templates_reject_pages_that_no_production_rule_decides(spark):
    rows = [(i, f"http://a.shop.example.com/en/{100 + i}") for i in range(40)]  # blocked by com/en/
    rows += [(100 + i, f"http://a.shop.example.com/{x}/{i}") for i, x in enumerate(["fr", "de", "es"])]  # few labels: the host's purity
    rows += [(200 + i, f"http://fine.example.org/fr/{i}") for i in range(40)]  # no label on the host
    rows += [(300 + i, f"http://big.example.org/{'es' if i < 8 else 'fr'}/{i}") for i in range(300)]  # labels cover a corner only
    out = {r["page_id"]: r for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [out[100 + i]["verdict"] for i in range(3)] == ["block"] * 3 and all(out[100 + i]["rule"] is None for i in range(3))
    assert all(out[200 + i]["verdict"] == "allow" for i in range(40))
    assert all(out[300 + i]["verdict"] == ("block" if i < 8 else "allow") for i in range(300))


def test_url_paths_of_any_length(spark):
    deep = "http://a.net/" + "x/" * 5_000 + "y"
    rows = [(1, deep), (2, deep), (3, "http://a.net/" + "z" * 200_000), (None, deep)]
    out = urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(out) == 4 and {r["verdict"] for r in out} == {"allow"}
    assert len({r["branch"] for r in out}) == 2


def with_edits(rng, text, n):
    chars = list(text)
    for _ in range(n):
        i = rng.randrange(len(chars))
        chars[i : i + 1] = rng.choice(["q", "", chars[i] + "z"])
    return "".join(chars)


@pytest.mark.parametrize("n", [12, 30, 64, 150, 400, 1000, 2300, 5000])
def test_bands_meet_for_alike_fingerprints_of_any_length(n):
    rng = random.Random(n)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    met = alike = 0
    for _ in range(60):
        text = ""
        while len(text) < n:
            text += rng.choice(words) + " "
        for edits in (1, 2, 4, 8):
            a, b = fingerprints.fingerprints_of([text[:n], with_edits(rng, text[:n], max(1, edits * n // 400) if n >= 64 else min(edits, 3))])
            if a != b and fingerprints.likeness(a, b) >= 0.8:
                alike += 1
                met += bool(set(fingerprints.bands(a)) & set(fingerprints.bands(b)))
    assert met >= 0.9 * alike > 10


def test_sampled_bits_are_near_for_alike_fingerprints():
    rng = random.Random(8)
    text = "".join(rng.choice("etaoinshrdlu ") for _ in range(3000))
    a, b, c = fingerprints.fingerprints_of([text, with_edits(rng, text, 4), text[::-1]])
    assert fingerprints.likeness(a, b) >= 0.8
    key = next(iter(set(fingerprints.bands(a)) & set(fingerprints.bands(b))))
    x, y = (fingerprints.sampled_bits(f, key) for f in (a, b))
    assert ((x ^ y) & (1 << 64) - 1).bit_count() <= fingerprints.NEAR_BITS
    assert ((x ^ fingerprints.sampled_bits(c, key)) & (1 << 64) - 1).bit_count() > fingerprints.NEAR_BITS


def test_fingerprint_classes_equal_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    texts = [r["text"] for r in spark.read.parquet(DOCS).limit(60).collect()]
    texts += [with_edits(rng, t, max(1, len(t) // 60)) for t in texts if len(t or "") > 40]
    base = "".join(rng.choice("etaoin shrdlu") for _ in range(600))
    texts += [with_edits(rng, base, rng.randint(3, 12)) for _ in range(90)]  # bands of over 64 members
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, base)], "doc_id long, text string").selectExpr("*", "1 as class_id", "2 as fingerprint", "3 as key")
    rows = fingerprints.fingerprinted(docs).collect()
    assert len(rows) == len(texts) + 1
    found = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None}
    prints = fingerprints.fingerprints_of(texts)
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if fingerprints.likeness(prints[a], prints[b]) >= 0.8]
    want = components_of(len(texts), pairs)
    assert sum(found[i] == want[i] for i in range(len(texts))) >= 0.98 * len(texts)
    assert all(want[found[i]] == want[i] for i in range(len(texts)))  # nothing is joined that isn't alike
    assert fingerprints.fingerprinted(docs.limit(0)).count() == 0


def test_a_group_of_alike_fingerprints_makes_few_links(spark, monkeypatch):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefghij klmnop") for _ in range(600))
    table = [(i, fingerprints.fingerprints_of([with_edits(rng, base, 1)])[0]) for i in range(90)]
    counts, whole = [], fingerprints.components

    def counted(links):
        counts.append(links.count())
        return whole(links)

    monkeypatch.setattr(fingerprints, "components", counted)
    out = fingerprints.classes(spark.createDataFrame(table, "doc_id long, fingerprint string")).collect()
    known = [(x, set(fingerprints.bands(x))) for _, x in table]
    pairs = [(a, b) for a, b in itertools.combinations(range(90), 2) if known[a][1] & known[b][1] and fingerprints.likeness(table[a][1], table[b][1]) >= 0.8]
    found = {r["fingerprint"]: r["class_id"] for r in out}
    assert [found[x] for _, x in table] == components_of(90, pairs)
    distinct = {frozenset((table[a][1], table[b][1])) for a, b in pairs if table[a][1] != table[b][1]}
    assert max(counts) <= len(distinct) / 2, (counts, len(distinct))


def test_links_are_contracted_to_components(spark):
    labels = spark.createDataFrame([(i, i // 10 * 10) for i in range(40)], "node long, component long")
    links = spark.createDataFrame([(a, b) for a in range(10) for b in range(10, 20)] + [(25, 3), (21, 22), (77, 31)], "a long, b long")
    assert sorted(map(tuple, graph.contracted(links, labels).collect())) == [(0, 10), (0, 20), (30, 77)]


def test_links_of_a_group_are_two_for_each_member(spark, monkeypatch):
    rng = random.Random(12)
    base = "".join(rng.choice("abcdefghij klmnop") for _ in range(900))
    texts = [with_edits(rng, base, 4) for _ in range(150)]
    pairs = []
    whole = fingerprints._verified
    monkeypatch.setattr(fingerprints, "_verified", lambda p, *a: pairs.append(p.count()) or whole(p, *a))
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, texts[0]), (None, "alone"), (201, "one more"), (None, None), (202, "")]
    out = fingerprints.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "__word" in plan  # rows alone in their class aren't shuffled
    found = sorted(((r["class_id"], r["n_chars"], r["doc_id"]) for r in out.collect() if r["n_chars"] < 500), key=str)
    assert found == sorted([(None, 5, None), (201, 8, 201), (202, 0, None), (202, 0, 202)], key=str)
    assert 140 <= pairs[0] <= 2 * 149, pairs


def test_parities_never_rule_out_more_than_the_difference():
    rng = np.random.default_rng(10)
    bits = lambda x: int.from_bytes(simhash.parities(x).tobytes(), "little")
    for n in (0, 1, 40, 700):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64))))
        assert (bits(a) ^ bits(b)).bit_count() <= len(np.setxor1d(a, b))
