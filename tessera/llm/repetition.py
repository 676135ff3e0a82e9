"""Repetition inside single documents (p10): one projection of built-in expressions, compiled from a threshold table.

The measures are columns over text; the table of rules names a measure, a comparison and a bound, and is compiled into the projection.
``profile`` selects all measures and the names of the rules a document breaks; ``repeated`` keeps of these the documents that break the
repetition rule.
No user function runs and nothing is shuffled, so the cost is one scan.

A run of five words counts as repeated if the same five words already stood at an earlier position of the document; its
words are repeated words. Null, empty and blank texts, and texts of fewer than five words, have a repeated share of 0.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.chars import plain_text

RUN = 5
# Frequent words without own meaning, English and Persian.
STOP_WORDS = ["the", "be", "to", "of", "and", "that", "have", "with", "a", "in", "is", "و", "در", "به", "از", "که", "را", "با", "است"]


class Rule(NamedTuple):
    """A document breaks the rule if its measure compares so with the bound."""

    name: str
    measure: str
    comparison: str
    bound: float


RULES = (
    Rule("too_short", "n_words", "<", 5),
    Rule("too_long", "n_words", ">", 100_000),
    Rule("short_words", "mean_word_length", "<", 2),
    Rule("long_words", "mean_word_length", ">", 12),
    Rule("symbols", "symbol_share", ">", 0.1),
    Rule("few_stop_words", "stop_word_share", "<", 0.01),
    Rule("bullet_lines", "bullet_line_share", ">", 0.9),
    Rule("ellipsis_lines", "ellipsis_line_share", ">", 0.3),
    Rule("repeated_lines", "repeated_line_share", ">", 0.3),
    Rule("repeated_runs", "repeated_share", ">=", 0.3),
)


def words(text: Column) -> Column:
    """Lower-case runs of letters or digits, digits in ASCII; an empty list for null."""
    return F.coalesce(F.array_remove(F.split(F.lower(plain_text(text)), r"[^\p{L}\p{N}]+"), ""), F.array().cast("array<string>"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def covered_words(hashes: Column) -> Column:
    """Words inside runs whose RUN word hashes already stood earlier; ``hashes`` holds one hash for each word."""
    def starts(placed: Column) -> Column:
        # equal runs stand together once sorted; all but the first of each are repeats
        again = F.transform(placed, lambda x, k: F.when((k > 0) & (x["h"] == F.get(placed, k - 1)["h"]), x["i"]))
        return F.array_sort(F.array_compact(again))

    def cover(at: Column) -> Column:
        # each start covers RUN words, fewer where the next start comes sooner
        steps = F.transform(at, lambda s, k: F.when(k > 0, F.least(F.lit(RUN), s - F.get(at, k - 1))).otherwise(F.lit(RUN)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def counted(run_hashes: Column) -> Column:
        placed = F.array_sort(F.transform(run_hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        covered = _let(placed, lambda p: _let(starts(p), cover))
        return F.when(F.size(F.array_distinct(run_hashes)) < F.size(run_hashes), covered).otherwise(F.lit(0))

    def runs(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - RUN), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(RUN)]))

    return _let(hashes, lambda h: F.when(F.size(h) > RUN, _let(runs(h), counted)).otherwise(F.lit(0)))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Name -> measure over the parts of a text: ``t`` the text, ``w`` its words, ``l`` its non-blank lines.
MEASURES = {
    "n_chars": lambda t, w, l: F.length(t),
    "n_words": lambda t, w, l: F.size(w),
    "n_lines": lambda t, w, l: F.size(l),
    "mean_word_length": lambda t, w, l: _share(F.length(F.array_join(w, "")), F.size(w)),
    "symbol_share": lambda t, w, l: _share(F.regexp_count(t, F.lit(r"#|\.\.\.|…|[\p{So}\p{Sk}]")), F.size(w)),
    "stop_word_share": lambda t, w, l: _share(F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))), F.size(w)),
    "bullet_line_share": lambda t, w, l: _share(F.size(F.filter(l, lambda x: x.rlike(r"^\s*[-*•‣]"))), F.size(l)),
    "ellipsis_line_share": lambda t, w, l: _share(F.size(F.filter(l, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))), F.size(l)),
    "repeated_line_share": lambda t, w, l: _share(F.size(l) - F.size(F.array_distinct(l)), F.size(l)),
    "repeated_share": lambda t, w, l: _share(covered_words(F.transform(w, lambda x: F.xxhash64(x))), F.size(w)),
}
_TESTS = {"<": lambda m, b: m < b, ">": lambda m, b: m > b, ">=": lambda m, b: m >= b, "<=": lambda m, b: m <= b}


def profile(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, names: tuple[str, ...] = tuple(MEASURES)) -> DataFrame:
    """(id, measures..., broken_rules) of every row. Repeated rows give repeated rows; other columns are left out, whatever their names.

    Words and lines are bound once and shared by all measures, the measures once and shared by all rules.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    parts = F.struct(text.alias("t"), words(text).alias("w"), lines.alias("l"))

    def measured(p: Column) -> Column:
        return F.struct(*[MEASURES[n](p["t"], p["w"], p["l"]).alias(n) for n in names])

    def judged(m: Column) -> Column:
        broken = F.array_compact(F.array(*[F.when(_TESTS[r.comparison](m[r.measure], F.lit(float(r.bound))), F.lit(r.name)) for r in rules]))
        return F.struct(*[m[n].alias(n) for n in names], broken.alias("broken_rules"))

    result = _let(parts, lambda p: _let(measured(p), judged))
    return df.select(F.col(id_col), result.alias("_r")).select(id_col, "_r.*")


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id) of the documents that break a rule on repeated runs, out of the projection of the whole table of rules."""
    names = [F.lit(r.name) for r in rules if r.measure == "repeated_share"]
    judged = profile(df, id_col, text_col, rules)
    return judged.filter(F.arrays_overlap("broken_rules", F.array(*names))).select(id_col)
