"""Quality rules: a threshold table compiled into one Spark projection.

Measures and ratios of whole texts are built-in expressions; the table of rules
becomes one boolean expression over them.  No user function, no shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import BLANKS, text_or_empty

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "be", "at", "this",
    "le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "est", "pour", "dans", "par", "sur", "au",
    "der", "die", "das", "und", "den", "dem", "ein", "eine", "ist", "von", "zu", "mit", "auf", "für", "im", "nicht",
    "el", "los", "las", "del", "y", "que", "se", "por", "con", "una", "su", "para", "al", "no", "es", "lo",
)


class Rule(NamedTuple):
    """Keep a text with least <= numerator / denominator <= most (None: open).

    It applies from ``from_words`` words on.
    """

    name: str
    numerator: str
    denominator: str
    least: float | None
    most: float | None
    from_words: int = 0


#: The production thresholds, over the measures of ``measures``.
RULES = (
    Rule("length", "n_words", "one", 10, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None, 50),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("repeat_words", "n_repeat_words", "n_words", None, 0.2),
)


def repeat_words(starts: Column) -> Column:
    """Words covered by windows of ``WINDOW`` words that begin at the sorted ``starts``."""
    following = F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1)))
    steps = F.zip_with(
        starts, following, lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))
    )
    return F.aggregate(steps, F.lit(0), lambda total, n: total + n)


def measures(documents: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the measures of each text, null as empty.

    A window is a text of its own, so equal windows are found by sorting them
    with their positions, and only in texts where some window occurs twice.
    """
    base = documents.select(*keep, text_or_empty().alias("__text"))
    split = base.select(
        *keep,
        "__text",
        F.array_remove(F.split("__text", "[\\x20\\x09-\\x0D]+"), "").alias("__words"),
        F.filter(F.split("__text", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("__lines"),
    )
    n = F.size("__words")
    windows = split.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.translate("__text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(
            n >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), n - (WINDOW - 1)),
                lambda i: F.array_join(F.slice("__words", i, F.lit(WINDOW)), " "),
            ),
        ).alias("__windows"),
    )
    twice = F.size(F.array_distinct("__windows")) < F.size("__windows")
    ordered = windows.withColumn(
        "__ordered",
        F.when(twice, F.array_sort(F.transform("__windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))),
    ).drop("__windows")
    found = F.filter(
        "__ordered",
        lambda e, i: (F.get("__ordered", i - 1)["w"] == e["w"]) | (F.get("__ordered", i + 1)["w"] == e["w"]),
    )
    starts = ordered.withColumn("__starts", F.array_sort(F.transform(found, lambda e: e["i"]))).drop("__ordered")
    return starts.withColumn(
        "n_repeat_words", F.coalesce(repeat_words(F.col("__starts")), F.lit(0)).cast("long")
    ).drop("__starts")


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean: the text passes every rule.  A ratio over 0 passes."""
    kept = F.lit(True)
    for rule in rules:
        top = F.col(rule.numerator).cast("double")
        bottom = F.lit(1.0) if rule.denominator == "one" else F.col(rule.denominator).cast("double")
        fits = F.lit(True)
        if rule.least is not None:
            fits = fits & (top >= F.lit(float(rule.least)) * bottom)
        if rule.most is not None:
            fits = fits & (top <= F.lit(float(rule.most)) * bottom)
        if rule.from_words:
            fits = fits | (F.col("n_words") < rule.from_words)
        kept = kept & fits
    return kept


def judge(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, the four base measures, base_failed and kept.

    Null and empty texts have no words, so they fail the base rule.  Every row
    is judged alone: ties, repeated rows and other columns do not matter, an
    empty table gives no rows.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = measures(documents, "doc_id").withColumn("base_failed", failed)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & compile_rules(rules)).alias("kept"),
    )
