"""Quality rules as a short-circuit cascade [native].

Text statistics are SQL expressions over the whole text. Rules are boolean
expressions (true: reject). On a bounded sample of rows each rule is timed and
its rejection rate counted; the rules are then chained in order of rejection
per cost, so that most rejected rows meet few rules. The order changes the
work, never the verdict: a row is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACE, bound, materialise

SAMPLE_ROWS = 2_000  # bound of the sample the cascade's order is estimated on
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[], Column]  # over the column text and the statistics; true: reject


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words that lie in a 5-word window occurring twice or more."""
    n = F.size(words)
    w = lambda i, k: F.get(words, i + k)
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[w(i, k) for k in range(WINDOW)]))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        # starts ascend; each adds its own words up to the next start
        gaps = F.transform(starts, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1), p + WINDOW) - p))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def starts(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, j: (x["h"] == F.get(ordered, j - 1)["h"])
                         | (x["h"] == F.get(ordered, j + 1)["h"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def count(ws: Column) -> Column:
        ordered = F.array_sort(F.transform(ws, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = bound(ordered, lambda o: bound(starts(o), covered))
        # most texts have no window twice and skip the sort
        return F.when(F.size(F.array_distinct(ws)) < F.size(ws), some).otherwise(F.lit(0))

    return bound(windows, count)


def statistics(text: Column) -> Column:
    """Struct of whole-text statistics; a null or empty text has zeros."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            _repeated(words).cast("long").alias("n_repeat_words"))

    return F.struct(bound(words_of(body), of).alias("w"), bound(lines, lambda ls: F.struct(
        F.size(ls).cast("long").alias("n_lines"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))).alias("l"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Published web-text heuristics, set to leave prose alone."""
    body, n = F.col("text"), F.col("n_words")
    return [
        Rule("symbols", lambda: 10 * F.col("n_symbols") > n),
        Rule("duplicate_lines", lambda: 10 * F.col("n_dup_lines") > 7 * F.col("n_lines")),
        Rule("word_length", lambda: (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("exclamations", lambda: 2 * F.length(F.regexp_replace(body, "[^!]+", "")) > n),
        Rule("ellipses", lambda: 2 * F.regexp_count(body, F.lit(r"(\.\.\.|…)[\x20\x09\x0B-\x0D]*(\n|$)")) > F.col("n_lines") + 1),
        Rule("bullets", lambda: 10 * F.regexp_count(body, F.lit(r"(^|\n)[\x20\x09]*[•◦‣▪*-][\x20\x09]")) > 9 * F.col("n_lines") + 1),
        Rule("letters", lambda: 2 * F.regexp_count(body, F.lit(r"\p{L}[^\x20\x09-\x0D]*")) < n),
    ]


def with_statistics(narrow: DataFrame) -> DataFrame:
    """The statistics as columns beside those of ``narrow`` (which has a
    non-null ``text``)."""
    rows = narrow.withColumn("stats", statistics(F.col("text")))
    return rows.select(*narrow.columns, "stats.w.*", "stats.l.*").withColumn("base_failed", base_failed())


def cascade(texts: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by estimated rejection per second of evaluation.

    The estimate uses a chance sample over all rows of the column ``text``,
    ``sample_rows`` in expectation, with its statistics written once."""
    total = texts.count()
    if not total or len(rules) < 2:
        return list(rules)
    if total > sample_rows:
        texts = texts.sample(sample_rows / total, seed=7)
    sample = materialise(with_statistics(texts.select("text"))).where(~F.col("base_failed"))
    rated = []
    for rule in rules:
        hits = F.count_if(F.coalesce(rule.rejects(), F.lit(False))).alias("hits")
        began = time.perf_counter()
        rejected = sample.agg(hits).first()["hits"]
        cost = max(time.perf_counter() - began, 1e-6)
        rated.append((rejected / cost, -cost, rule))
    return [rule for *_, rule in sorted(rated, key=lambda x: x[:2], reverse=True)]


def rejected_by(ordered: list[Rule]) -> Column:
    """True if a rule rejects; a rule is evaluated only where all before it
    pass."""
    verdict = F.lit(False)
    for rule in reversed(ordered):
        verdict = F.when(F.coalesce(rule.rejects(), F.lit(False)), F.lit(True)).otherwise(verdict)
    return verdict


def _prepared(docs: DataFrame, text: str, rules: list[Rule] | None, sample_rows: int, **named) -> tuple:
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    ordered = cascade(docs.select(body), default_rules() if rules is None else rules, sample_rows)
    return with_statistics(docs.select(*[c.alias(k) for k, c in named.items()], body)), rejected_by(ordered)


def apply_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] | None = None,
                sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, base_failed, kept) of every row.

    base_failed: under ten words, or over 20 % of the words in repeated
    five-word windows. kept: base passed and no rule of the cascade rejects.
    Null and empty texts have zero counts and fail the base; repeated rows
    each get their own row; an empty table gives none. Only the key and the
    text are read, so other columns cannot clash."""
    rows, rejected = _prepared(docs, text, rules, sample_rows, key=F.col(key))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(~rejected)
    return rows.select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "n_lines", "base_failed", kept.alias("kept"))


def keep(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None,
         sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that pass the base checks and every rule, all columns as they
    were (they travel in one struct, so any name is allowed). The verdict is
    computed on the row itself: no join, and repeated rows do no harm."""
    rows, rejected = _prepared(docs, text, rules, sample_rows, row=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return rows.where(~F.col("base_failed")).where(~rejected).select("row.*")
