"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

1. Measures.  Words, lines and the counts that the base rules need are columns of each document;
   windows of three words are sorted as an array of the document's own, so nothing is shuffled.
2. Estimate.  On a sample (``SAMPLE`` documents in expectation, chosen by a hash) each rule is
   run alone: its share of rejections is its selectivity, the time above that of an empty
   aggregation its cost.
3. Order.  Rules go by rejections per second, the highest first; the cascade is one CASE whose
   branches are evaluated in turn until one rejects, so a costly rule sees only what the cheaper
   ones have passed.  The order changes the cost and never the verdict.

Rules and thresholds are those published for web corpora (symbols, word lengths, repeated and
bulleted lines, words with a letter), and one on capitals.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 1000        # documents that costs and selectivities are estimated on, in expectation
SAMPLE_TASKS = 6
RUNS = 3             # of a rule on the sample; the fastest counts
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@dataclass(frozen=True)
class Rule:
    """``fails`` makes the condition that rejects, over ``_text``, ``_words``, ``_lines`` and the measures."""
    name: str
    fails: Callable[[], Column]


RULES = (
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("word_length", lambda: (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 10 * F.col("n_words"))),
    Rule("dup_lines", lambda: 10 * F.col("n_dup_lines") > 3 * F.size("_lines")),
    Rule("words_with_a_letter", lambda: 100 * F.regexp_count("_text", F.lit(r"\p{L}[^\x20\x09-\x0D]*")) < 80 * F.col("n_words")),
    Rule("capitals", lambda: 2 * F.regexp_count("_text", F.lit(r"\p{Lu}")) > F.regexp_count("_text", F.lit(r"\p{L}"))),
    Rule("bullets", lambda: 10 * F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))) > 9 * F.size("_lines")),
    Rule("ellipses", lambda: 10 * F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))) > 3 * F.size("_lines")),
)


def _repeated(windows: Column) -> Column:
    """Pairs of neighbours in sorted ``windows`` that hold the same three words."""
    n = F.size(windows)
    both = F.arrays_zip(F.slice(windows, F.lit(1), n - 1).alias("x"), F.slice(windows, F.lit(2), n - 1).alias("y"))
    return F.filter(both, lambda t: (t["x"]["a"] == t["y"]["a"]) & (t["x"]["b"] == t["y"]["b"]) & (t["x"]["c"] == t["y"]["c"]))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``_doc`` (the columns of ``docs``), ``_text``, ``_words``, ``_lines`` and the measures of each row."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    split = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("_doc"), text.alias("_text"),
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("_words"), F.split(text, "\n").alias("_all"))
    n = F.size("_words")
    part = lambda k, name: F.slice("_words", F.lit(k), n - 2).alias(name)
    windows = F.when(n > 2, F.sort_array(F.arrays_zip(part(1, "a"), part(2, "b"), part(3, "c"), F.sequence(F.lit(0), n - 3).alias("i"))))
    split = split.select("_doc", "_text", "_words", F.filter("_all", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"), windows.alias("_windows"))
    split = split.select("_doc", "_text", "_words", "_lines", F.when(F.size("_windows") > 1, _repeated(F.col("_windows"))).alias("_twins"))
    first = F.array_union(F.transform("_twins", lambda t: t["x"]["i"]), F.transform("_twins", lambda t: t["y"]["i"]))
    split = split.select("_doc", "_text", "_words", "_lines", F.when(F.size("_twins") > 0, first).alias("_first"))
    step = lambda k: F.transform("_first", lambda i: i + k)
    covered = F.size(F.array_union(F.array_union(F.col("_first"), step(1)), step(2)))
    return split.select(
        "_doc", "_text", "_words", "_lines", F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_first").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _fails(rule: Rule) -> Column:
    return F.coalesce(rule.fails(), F.lit(False))


def estimates(sample: DataFrame, rules=RULES) -> dict[str, tuple[float, float]]:
    """{rule: (rejected share, seconds)} on a kept frame of measures; empty frame: nothing is rejected."""
    def seconds(agg: Column) -> tuple[float, int]:
        best, value = float("inf"), 0
        for _ in range(RUNS):
            t = time.perf_counter()
            value = sample.agg(agg).first()[0]
            best = min(best, time.perf_counter() - t)
        return best, value

    idle, rows = seconds(F.count(F.lit(1)))
    out = {}
    for r in rules:
        s, n = seconds(F.count_if(_fails(r)))
        out[r.name] = ((n + 0.5) / (rows + 1), max(s - idle, 1e-4))
    return out


def ordered(rules, found: dict[str, tuple[float, float]]) -> list[Rule]:
    """Rules by rejections per second, the highest first; ties by name."""
    return sorted(rules, key=lambda r: (-found[r.name][0] / found[r.name][1], r.name))


def cascade(rules: list[Rule]) -> Column:
    """True where no rule rejects; a rule is evaluated only where all before it have passed."""
    out = None
    for r in rules:
        out = F.when(_fails(r), False) if out is None else out.when(_fails(r), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judged(docs: DataFrame, text_col: str = "text", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the text, with the measures, ``base_failed`` and ``kept``.

    Words are the runs of characters other than ASCII white space; null text: no words.  A document
    without words fails the base rules.  Rows are judged one by one: null ids, repeated rows and
    ties change nothing, equal texts get equal verdicts.  Columns with the names of the results are
    replaced.  Empty table: empty result.
    """
    docs = docs.drop(*[c for c in RESULTS if c in docs.columns])
    of = max(1, docs.count() // max(1, sample))
    key = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if "map" not in docs.schema[c].dataType.simpleString()])
    chosen = docs.select(text_col).where(F.pmod(key, F.lit(of)) == 0).repartition(SAMPLE_TASKS)
    kept = measured(chosen, text_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        order = ordered(rules, estimates(kept.where(~base_failed()), rules))
    finally:
        kept.unpersist()
    out = measured(docs, text_col).withColumn("base_failed", base_failed())
    return out.select("_doc.*", *RESULTS[:-1], F.when(F.col("base_failed"), False).otherwise(cascade(order)).alias("kept"))
