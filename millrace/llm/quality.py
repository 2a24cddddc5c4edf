"""Quality rules as a short-circuit cascade.

Each rule is a predicate over a text that says whether to reject it. On a bounded sample the cascade measures what a
rule costs, and which texts it rejects; the next rule asked is always the one that rejects most per cost of the texts
that are left then. The first that rejects ends the work on a text. The order changes the cost only, never the verdict.
Everything is a Spark SQL expression.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import hold, release

WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")).cast("long")


def n_symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")


def lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(ws: Column, window: int = 3) -> Column:
    """Words inside a window of so many words that the text has twice or more. Windows are compared by 64-bit hash;
    only texts whose windows are not all different sort them."""

    def covered(positions: Column) -> Column:
        steps = F.transform(positions, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(positions, i + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twins = let(pairs, lambda p: F.filter(F.transform(p, lambda x, i: F.when((x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"]), x["i"])), lambda x: x.isNotNull()))
        return let(F.sort_array(twins), covered)

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(window))))
        return F.when(F.size(w) < window, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h))))

    return let(ws, count).cast("long")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column  # over the text alone; null counts as no


def rules(text: str = "text", counted: bool = False) -> list[Rule]:
    """The production rules. Thresholds reject what can hardly be prose and leave unusual prose alone. counted: the rows
    have the columns of base(), which are used instead of counting again."""
    t = F.coalesce(F.col(text), F.lit(""))
    n, chars, symbols = (F.col(c) if counted else f(t) for c, f in (("n_words", n_words), ("word_chars", word_chars), ("n_symbols", n_symbols)))
    repeated = 100 * F.col("n_repeat_words") > 50 * n if counted else let(words(t), lambda w: 100 * n_repeat_words(w) > 50 * F.size(w))
    if counted:  # lines are only counted where one is repeated
        dup = (F.col("n_dup_lines") > 0) & (100 * F.col("n_dup_lines") > 60 * F.size(lines(t)))
    else:
        dup = let(lines(t), lambda x: 100 * (F.size(x) - F.size(F.array_distinct(x))) > 60 * F.size(x))
    return [
        Rule("few_words", n < 50), Rule("repeated_words", repeated), Rule("symbols", 10 * symbols > 3 * n), Rule("word_length", (chars < 2 * n) | (chars > 20 * n)), Rule("dup_lines", dup),
        Rule("letters", 2 * F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) < chars),
    ]


def sample(docs: DataFrame, most_rows: int = 2_000, seed: int = 42) -> DataFrame:
    """The first most_rows rows of docs (text) by a seeded hash of their text."""
    return docs.select("text").orderBy(F.xxhash64(F.lit(seed), "text")).limit(most_rows).repartition(1)  # what is computed on it stays above the limit


def measure(rows: DataFrame, rules: list[Rule], after: Column | None = None) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) in the order in which they are asked, on a sample that has the columns they read:
    each time the rule with the most rejections per cost among the rows that `after` and the rules before it leave; the
    share is of these. Which rules reject a row is counted by pattern, so the sample is judged once. Without rows, and
    where nothing is rejected any more, the given order stays."""
    held = rows.repartition(1).persist()
    verdicts = [F.coalesce(r.rejects, F.lit(False)) for r in rules]
    try:
        passed = held if after is None else held.filter(~F.coalesce(after, F.lit(False)))
        patterns = [(list(r.v), r.n) for r in passed.groupBy(F.array(*verdicts).alias("v")).agg(F.count("*").alias("n")).collect()]  # at most two to the number of rules
        seconds = []
        for verdict in verdicts:
            counted = passed.agg(F.sum(verdict.cast("long")))
            counted.collect()  # code is compiled and warm before it is timed
            began = time.perf_counter()
            counted.collect()
            seconds.append(max(1e-4, time.perf_counter() - began))
    finally:
        held.unpersist()
    out, left = [], list(range(len(rules)))
    while left:
        total = sum(n for _, n in patterns)
        gone = {i: sum(n for v, n in patterns if v[i]) for i in left}
        best = max(left, key=lambda i: (gone[i] / seconds[i], -i))
        out.append((rules[best], seconds[best], gone[best] / max(total, 1)))
        left.remove(best)
        patterns = [(v, n) for v, n in patterns if not v[best]]
    return out


def cascade(docs: DataFrame, rules: list[Rule], most_rows: int = 2_000, after: Column | None = None, measured: DataFrame | None = None) -> DataFrame:
    """docs (with text) and rejected_by: the name of a rule that rejects the row, or null for rows to keep.

    Which of several rejecting rules is named depends on the measured order; whether one is, does not. after: rows for
    which it is true are taken as rejected ("before") without asking any rule. measured: the rows to measure on, where the
    rules read more than text. Null text is empty; an empty table gives an empty one; a rejected_by in docs is replaced.
    """
    verdict = F.when(after, F.lit("before")) if after is not None else F.when(F.lit(False), F.lit(""))
    for rule, _, _ in measure(sample(docs, most_rows) if measured is None else measured, rules, after):
        verdict = verdict.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name))
    return docs.withColumn("rejected_by", verdict)


def base(docs: DataFrame) -> DataFrame:
    """docs (with text) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed. Null text is empty
    and fails; repeated rows are each judged alike; an empty table gives an empty table."""
    t = F.col("text")
    out = hold(docs, "text").withColumn("_words", words(t)).withColumns({"n_words": F.size("_words").cast("long"), "word_chars": word_chars(t), "n_symbols": n_symbols(t), "n_dup_lines": n_dup_lines(t), "n_repeat_words": n_repeat_words(F.col("_words"))}).drop("_words")
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return release(out, docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
