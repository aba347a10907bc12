"""Quality rules as a short-circuit cascade.

Each rule rejects a text by a condition on a few measures of it. A rule's cost and what it rejects are estimated on a
sample: all rules' outcomes in one job, and each rule's time in jobs of its own, less the time of reading.
The cascade starts with the rule that rejects most per cost; the next is the best on what is left of the sample, and so
on. A document is judged by one expression in that order which stops at the first rule that rejects it, so costly rules
see only what the cheap ones let through.

The order decides how long it takes and which rule is named, never whether a document is kept. No row is shuffled.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverflux.llm.common import discard, let, materialize, words
from riverflux.llm.mixing import size_of

#: Expected number of rows in the sample.
SAMPLE = 2000
SEED = 42
#: Times that each rule is timed; the shortest counts.
TIMED = 2
#: Least cost of a rule, as a share of the costliest: differences below it are noise of the clock.
LEAST_COST = 0.01
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WORDLESS = r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"
#: Lines end at \n only.
BULLET = r"(?md)^[ \t]*+[-*•‣▪]"
ELLIPSIS = r"(?md)(?:\.\.\.|…)[ \t]*+$"
LINE = r"(?md)^[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D]"


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def repeated_words(text: Column, n: int = 3) -> Column:
    """How many words lie in a window of n words that the text has twice or more.

    Windows are hashed to 64 bits. Equal hashes stand together once they are sorted with their places, and the
    words covered are summed along the sorted places: n log n steps, however often anything is repeated."""

    def covered(h: Column) -> Column:
        def places(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

        steps = lambda at: F.transform(at, lambda a, k: F.least(F.coalesce(F.get(at, k + 1) - a, F.lit(n)), F.lit(n)))
        total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return total(let(let(ordered, places), steps))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
        some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
        return F.when(F.size(w) < n, F.lit(0).cast("long")).otherwise(some)

    return let(words(text), of)


def removed(text: Column, pattern: str) -> Column:
    """How many characters a pattern matches in all."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


#: The measures of a text that is not null; all of them are longs.
MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": size_of,
    "word_chars": lambda t: F.length(F.translate(t, SPACES, "")),
    "n_symbols": lambda t: F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
    "n_lines": lambda t: F.regexp_count(t, F.lit(LINE)),
    "n_dup_lines": lambda t: let(lines_with_words(t), lambda x: F.size(x) - F.size(F.array_distinct(x))),
    "n_repeat_words": repeated_words,
    "n_letterless": lambda t: F.regexp_count(t, F.lit(WORDLESS)),
    "n_upper": lambda t: removed(t, r"\p{Lu}+"),
    "n_lower": lambda t: removed(t, r"\p{Ll}+"),
    "n_bullets": lambda t: F.regexp_count(t, F.lit(BULLET)),
    "n_ellipses": lambda t: F.regexp_count(t, F.lit(ELLIPSIS)),
}
BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Rule(NamedTuple):
    """A text is rejected where fails is true; fails gets a function from a measure's name to its column."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


BASE_RULES = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
)
RULES = (
    *BASE_RULES,
    Rule("word_length", lambda m: (m("word_chars") < 3 * m("n_words")) | (m("word_chars") > 12 * m("n_words"))),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 30 * m("n_lines")),
    Rule("letterless_words", lambda m: 100 * m("n_letterless") > 20 * m("n_words")),
    Rule("shouting", lambda m: m("n_upper") > m("n_lower")),
    Rule("bullets", lambda m: 100 * m("n_bullets") > 90 * m("n_lines")),
    Rule("ellipses", lambda m: 100 * m("n_ellipses") > 30 * m("n_lines")),
)


class Estimate(NamedTuple):
    name: str
    cost: float  # seconds for the sample
    rejected: int  # rows of the sample that the rules before it let through and this one rejects


def condition(rule: Rule, text: Column, measured: dict[str, Column]) -> Column:
    """The rule's condition; measures that are columns already are not computed again."""
    fails = rule.fails(lambda name: measured[name] if name in measured else MEASURES[name](text))
    return F.coalesce(fails, F.lit(False))


def seconds(sample: DataFrame, c: Column) -> float:
    best = float("inf")
    for _ in range(TIMED):
        began = time.perf_counter()
        sample.agg(F.count_if(c)).collect()
        best = min(best, time.perf_counter() - began)
    return best


def arrange(patterns: dict[tuple[bool, ...], int], costs: list[float]) -> list[tuple[int, int]]:
    """(rule, rows it rejects) in the order of the cascade. patterns: how many rows of the sample have these outcomes."""
    left, todo, order = dict(patterns), set(range(len(costs))), []
    while todo:
        rejects = {r: sum(n for p, n in left.items() if p[r]) for r in todo}
        best = min(todo, key=lambda r: (-rejects[r] / costs[r], costs[r], r))
        order.append((best, rejects[best]))
        todo.remove(best)
        left = {p: n for p, n in left.items() if not p[best]}
    return order


def plan_cascade(rows: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", measured: tuple[str, ...] = (), sample: int = SAMPLE) -> list[Estimate]:
    """The rules in the order of the cascade, as estimated on about so many rows (all of a smaller table).

    measured: measures that each row has before the cascade, so that they cost its rules nothing. Rows are drawn one by one, so the sample is of that size
    whatever the texts are. Tests of one rule each, and the patterns of outcomes (one for each row of the sample at
    most), are all that the driver gets."""
    n = rows.count()
    few = rows.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    few = materialize((few.sample(sample / n, SEED) if n > sample else few).repartition(1))  # a single task, so that a job's time is its cost
    drawn = materialize(few.select("text", *[MEASURES[m](F.col("text")).alias(f"m_{m}") for m in measured]))
    at = {name: F.col(f"m_{name}") for name in measured}
    fails = [condition(r, F.col("text"), at) for r in rules]
    outcomes = drawn.select(*[f.alias(f"f{i}") for i, f in enumerate(fails)]).groupBy(*[f"f{i}" for i in range(len(rules))]).count().collect()
    reading = seconds(drawn, F.length("text") < 0)
    costs = [max(seconds(drawn, f) - reading, 0.0) for f in fails]
    least = max(LEAST_COST * max(costs, default=0), 1e-6)
    costs = [max(c, least) for c in costs]
    discard(few, drawn)
    return [Estimate(rules[r].name, costs[r], k) for r, k in arrange({tuple(o[:-1]): o[-1] for o in outcomes}, costs)]


def judge(rows: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", report: tuple[str, ...] = (), keep: tuple[str, ...] = (), sample: int = SAMPLE, plan: list[Estimate] | None = None) -> DataFrame:
    """The columns named in keep, the measures named in report (longs) and rejected_by: the first rule of the cascade that
    rejects the text, null if none does.

    A null text is an empty one. All rows stay, repeated ones too; an empty table gives no rows. Texts are read whole. Columns
    of keep that are called like a measure of report or rejected_by are left out. A plan of plan_cascade saves its estimation.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    clash = {*report, "rejected_by"}
    kept = [c for c in keep if c not in clash]
    base = rows.select(text.alias("text"), F.struct(*[MEASURES[m](text).cast("long").alias(m) for m in report]).alias("m") if report else F.lit(None).alias("m"), F.struct(*[F.col(c) for c in kept]).alias("k") if kept else F.lit(None).alias("k"))
    if plan is None:
        plan = plan_cascade(rows, rules, text_col, report, sample)
    by_name = {r.name: r for r in rules}
    at = {m: F.col("m")[m] for m in report}
    first = F.lit(None).cast("string")
    for e in reversed(plan):
        first = F.when(condition(by_name[e.name], F.col("text"), at), F.lit(e.name)).otherwise(first)
    return base.select(*[F.col("k")[c].alias(c) for c in kept], *[at[m].alias(m) for m in report], first.alias("rejected_by"))


def op12_quality_cascade(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), report=BASE_MEASURES, keep=("doc_id",))
    failed = F.lit(False)
    for r in BASE_RULES:
        failed = failed | condition(r, F.lit(""), {m: F.col(m) for m in BASE_MEASURES})
    return out.select("doc_id", *BASE_MEASURES, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


OP12_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
t AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS k FROM t) WHERE k > 1) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) AS n_letterless, len(regexp_extract_all(text, '\p{Lu}')) AS n_upper, len(regexp_extract_all(text, '\p{Ll}')) AS n_lower,
         len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*•‣▪]'))) AS n_bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t]*$'))) AS n_ellipses
  FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_letterless > 20 * n_words
            OR n_upper > n_lower OR 100 * n_bullets > 90 * n_lines OR 100 * n_ellipses > 30 * n_lines) AS kept
FROM b
"""
