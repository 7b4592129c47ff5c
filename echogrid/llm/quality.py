"""Quality rules: line-first cleaning, in DataFrame expressions only.

Every line of a text is judged by itself: by its punctuation, by signs of
navigation, by boilerplate phrases. Failing lines are removed, and a document
that loses too much of its text by that is rejected. One pass, no shuffle:
each row is judged alone, so no group of rows can become hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, fenced, restored, words

#: A document is rejected if more than this percentage of the characters of its lines is removed.
MAX_LOST_PERCENT = 40
#: Repeated five-word windows may cover at most this percentage of the words.
MAX_REPEAT_PERCENT = 20
MIN_WORDS = 10
WINDOW = 5
SEPARATORS = "|»›·"
SYMBOLS = "#*$%&<>"
SENTENCE_MARK = "[.!?…。:;！？：；؟؛।]"
BOILERPLATE = (
    "lorem ipsum|all rights reserved|(cookie|privacy) policy|terms of (use|service)"
    "|enable javascript|javascript is (disabled|required)|click here|sign up now|subscribe to our|skip to (main )?content"
)


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_fails(line: Column, n_words: Column) -> Column:
    """True for a line that one of the rules removes; lines without words stay.

    Navigation: three or more separators, one for five words at least.
    Symbols: more symbols than words. Shouting: "!!" after half of the words.
    Punctuation: eight words or more without any sentence mark.
    Boilerplate: a known phrase in a line of at most 25 words.
    """
    separators = _count(line, SEPARATORS)
    shouts = F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))
    return (n_words > 0) & (
        ((separators >= 3) & (separators * 5 >= n_words))
        | (_count(line, SYMBOLS) > n_words)
        | ((shouts >= n_words) & (shouts >= 4))
        | ((n_words >= 8) & ~line.rlike(SENTENCE_MARK))
        | ((n_words <= 25) & F.lower(line).rlike(BOILERPLATE))
    )


def judge(df: DataFrame, text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, line_chars,
    base_failed, kept and clean_text to every row; rows are neither dropped nor merged.

    Null and blank texts have no words: base_failed is true, kept false and
    clean_text empty. Very long texts cost n log n. Repeated rows get equal
    results. Input columns named like an output are replaced.
    """
    w = carried(df, t=F.coalesce(df[text], F.lit("")))
    w = w.withColumn("lines", F.split("t", "\n", -1))
    w = w.withColumn("lw", F.transform("lines", words))
    w = w.withColumns(
        {
            "w": F.flatten("lw"),
            "l": F.filter(F.arrays_zip("lines", F.transform("lw", F.size).alias("n")), lambda x: x["n"] > 0),
        }
    )
    w = w.withColumns({"n_words": F.size("w").cast("long"), "fails": F.transform("l", lambda x: line_fails(x["lines"], x["n"]))})
    n = F.size("w")
    # a window is known by the XXH64 of its words
    w = w.withColumn(
        "h",
        F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # sorted (hash, position) only where some window occurs twice
    w = w.withColumn(
        "s",
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
        ),
    )
    # starts of windows that equal their neighbour in that order, ascending
    w = w.withColumn(
        "starts",
        F.array_sort(
            F.filter(
                F.transform(
                    "s",
                    lambda x, i: F.when((x["x"] == F.get("s", i - 1)["x"]) | (x["x"] == F.get("s", i + 1)["x"]), x["i"]),
                ),
                lambda i: i.isNotNull(),
            )
        ),
    )
    covered = F.aggregate(
        F.transform("starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1), p + WINDOW) - p)),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    texts = F.transform("l", lambda x: x["lines"])
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    w = w.withColumns(
        {
            "word_chars": F.length(F.array_join("w", "")).cast("long"),
            "n_symbols": _count(F.col("t"), "#*$%&|<>").cast("long"),
            "n_dup_lines": (F.size("l") - F.size(F.array_distinct(texts))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
            "line_chars": total(F.transform("l", lambda x: F.length(x["lines"]))),
            "lost_chars": total(F.transform("l", lambda x, i: F.when(F.get("fails", i), F.length(x["lines"])).otherwise(0))),
        }
    )
    w = w.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    w = w.withColumns(
        {
            "kept": ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost_percent * F.col("line_chars")),
            "clean_text": F.when(F.col("lost_chars") == 0, F.col("t")).otherwise(
                F.array_join(F.filter("lines", lambda x: ~line_fails(x, F.size(words(x)))), "\n")
            ),
        }
    )
    return restored(
        w, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "lost_chars", "base_failed", "kept", "clean_text"
    )


def clean(df: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The kept documents with their failing lines removed, in the columns of df.

    n_chars, where there is such a column, is counted again.
    """
    judged = judge(carried(df, text=df[text]))
    new = {text: F.col("clean_text")}
    if n_chars and n_chars in df.columns:
        new[n_chars] = F.length("clean_text").cast(df.schema[n_chars].dataType)
    return restored(fenced(judged, F.col("kept")), replace=new)
