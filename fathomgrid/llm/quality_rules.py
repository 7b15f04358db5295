"""Quality by weak supervision: rules vote good or bad or abstain, expectation-maximisation estimates how far each can be
trusted, and a text stays by its posterior probability of being good rather than by passing all rules.

Everything is DataFrame and SQL functions. Texts are read once, into measures and votes; votes fall into at most
3 ** (number of rules) patterns, over whose counts the estimation runs as grouped sums. Windows of three words are
compared by 64-bit hashes of their words within a text.

Defined cases: a null or empty text has no words, and fails the base rules as any text of under 50 words. Null ids and
repeated rows are judged like others. A text of any length is measured whole. A posterior probability just at the limit is
good. An empty table gives an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, stored

BLANK = r"[\x20\x09-\x0D]+"
#: Everyday words of a few languages, in lower case: running text has some.
COMMON = ["the", "of", "and", "to", "in", "is", "that", "it", "de", "la", "le", "et", "les", "des", "en", "que", "el", "los", "y", "der", "die", "und", "das", "ist", "zu", "den"]
ROUNDS = 20
#: Starting values: the share of good texts, and how often a good and a bad text gets each vote (good, bad, none). These
#: count as PRIOR texts of each kind beside the data.
GOOD, PRIOR = 0.8, 10.0
START = {"good": (0.70, 0.05, 0.25), "bad": (0.20, 0.50, 0.30)}
VOTES = (("yes", "= 1"), ("no", "= 0"), ("none", "is null"))

#: name: (condition to vote bad, condition to vote good or None), over the measures; neither: abstains.
RULES: dict[str, tuple[str, str | None]] = {
    "symbols": ("n_symbols * 100 > word_chars * 4", None),
    "repeats": ("n_repeat_words * 100 > n_words * 30", "n_repeat_words * 100 <= n_words * 10"),
    "capitals": ("n_capitals * 100 > word_chars * 40", None),
    "lines": ("n_dup_lines * 100 > n_lines * 40", None),
    "words": ("word_chars > n_words * 12 or word_chars < n_words * 2", "word_chars <= n_words * 9 and word_chars >= n_words * 3"),
    "common": ("n_common <= 1", "n_common >= 4"),
}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_common (all long)."""
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    found = found.select(
        "doc_id",
        F.filter(F.split("t", BLANK), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^A-Z]+", "")).alias("n_capitals"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    found = found.select(
        "doc_id",
        F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        "n_capitals",
        F.size(F.array_intersect("w", F.array(*map(F.lit, COMMON)))).alias("n_common"),
        F.when(F.size("w") >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    # most texts repeat no window; the others have theirs sorted, so that equal ones are neighbours
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    found = found.withColumn("s", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    equal = F.filter("s", lambda x, k: ((k > 0) & (F.get("s", k - 1)["h"] == x["h"])) | (F.get("s", k + 1)["h"] == x["h"]))
    found = found.withColumn("at", F.sort_array(F.transform(equal, lambda x: x["i"])))
    covered = F.aggregate("at", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])
    found = found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)))
    return found.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_common")))


def _vote(bad: str, good: str | None) -> str:
    return f"case when {bad} then 0 {f'when {good} then 1 ' if good else ''}end"


def votes(measured: DataFrame, rules: dict[str, tuple[str, str | None]] | None = None) -> DataFrame:
    """measured with a column vote_<rule> for each rule: 1 good, 0 bad, null abstains."""
    return measured.withColumns({f"vote_{k}": F.expr(_vote(*r)) for k, r in (rules or RULES).items()})


def _odds(params: dict[str, float], k: str, vote: str) -> float:
    return math.log(params[f"{k}_good_{vote}"] / params[f"{k}_bad_{vote}"])


def posterior(params: dict[str, float], names: list[str]) -> Column:
    """The probability that a row is good, of its votes."""
    odds = F.lit(math.log(params["good"] / (1 - params["good"])))
    for k in names:
        v = F.col(f"vote_{k}")
        odds = odds + F.when(v == 1, _odds(params, k, "yes")).when(v == 0, _odds(params, k, "no")).otherwise(_odds(params, k, "none"))
    return 1 / (1 + F.exp(-odds))


def estimated(voted: DataFrame, names: list[str] | None = None, rounds: int = ROUNDS) -> dict[str, float]:
    """The share of good texts, and how often good and bad ones get each vote, by expectation-maximisation."""
    names = names or list(RULES)
    patterns = checkpointed(voted.groupBy(*(f"vote_{k}" for k in names)).agg(F.count("*").alias("n")).coalesce(1))
    params = {"good": GOOD} | {f"{k}_{y}_{v}": START[y][i] for k in names for y in START for i, (v, _) in enumerate(VOTES)}
    for _ in range(rounds):
        share = {"good": "n * p", "bad": "n * (1 - p)"}
        wanted = [F.expr("sum(n)").alias("n"), *(F.expr(f"sum({w})").alias(y) for y, w in share.items())]
        wanted += [F.expr(f"sum(case when vote_{k} {test} then {w} else 0.0D end)").alias(f"{k}_{y}_{v}") for k in names for y, w in share.items() for v, test in VOTES]
        r = patterns.withColumn("p", posterior(params, names)).agg(*wanted).first()
        if not r["n"]:
            return params
        params = {"good": (r["good"] + PRIOR * GOOD) / (r["n"] + PRIOR)} | {f"{k}_{y}_{v}": (r[f"{k}_{y}_{v}"] + PRIOR * START[y][i]) / (r[y] + PRIOR) for k in names for y in START for i, (v, _) in enumerate(VOTES)}
    return params


def judged(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, kept and quality_probability of each row."""
    voted = stored(votes(measures(docs)), "votes")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    p = posterior(estimated(voted), list(RULES))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (p >= least)).alias("kept"), F.round(p, 4).alias("quality_probability"))


def _rounds_sql(names: list[str]) -> str:
    """The rounds of `estimated` as a chain of one-row tables e0, e1, ..."""
    odds = "ln(e.good / (1 - e.good))" + "".join(" + case " + " ".join(f"when vote_{k} {test} then ln(e.{k}_good_{v} / e.{k}_bad_{v})" for v, test in VOTES) + " end" for k in names)
    out = f"e0 as (select {GOOD}::double as good" + "".join(f", {START[y][i]}::double as {k}_{y}_{v}" for k in names for y in START for i, (v, _) in enumerate(VOTES)) + ")"
    share = {"good": "p", "bad": "(1 - p)"}
    for i in range(ROUNDS):
        shares = "".join(f", (sum(case when vote_{k} {test} then n * {w} else 0 end) + {PRIOR * START[y][j]}) / (sum(n * {w}) + {PRIOR}) as {k}_{y}_{v}" for k in names for y, w in share.items() for j, (v, test) in enumerate(VOTES))
        out += f",\ne{i + 1} as materialized (select (sum(n * p) + {PRIOR * GOOD}) / (sum(n) + {PRIOR}) as good{shares} from (select patterns.*, 1 / (1 + exp(-({odds}))) as p from patterns, e{i} e))"
    return out + f",\nposterior as (select voted.*, 1 / (1 + exp(-({odds}))) as p from voted, e{ROUNDS} e)"


def oracle_sql() -> str:
    names, blank = list(RULES), r"[\x20\x09-\x0D]+"
    common = ", ".join(f"'{w}'" for w in COMMON)
    cases = ", ".join(f"{_vote(*r)} as vote_{k}" for k, r in RULES.items())
    return f"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), w as (
  select r, doc_id, t, list_filter(regexp_split_to_array(t, '{blank}'), lambda x: x <> '') as w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d
), words as (
  select r, unnest(w) as word, generate_subscripts(w, 1) as i from w
), windows as (
  select r, i, word as a, lead(word) over (partition by r order by i) as b, lead(word, 2) over (partition by r order by i) as c from words
), repeated as (
  select r, i from (select r, i, count(*) over (partition by r, a, b, c) as n from windows where c is not null) where n > 1
), covered as (
  select r, count(distinct i + k) as n from repeated, (select unnest([0, 1, 2]) as k) group by r
), measured as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
         len(lines)::bigint as n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g'))::bigint as n_capitals,
         len(list_intersect(list_distinct(w), [{common}]))::bigint as n_common
  from w left join covered using (r)
), voted as (
  select *, {cases} from measured
), patterns as (
  select {", ".join(f"vote_{k}" for k in names)}, count(*) as n from voted group by all
), {_rounds_sql(names)}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and p >= 0.5 as kept,
       round(p, 4) as quality_probability
from posterior
"""

