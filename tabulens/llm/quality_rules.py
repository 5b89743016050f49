"""Quality rules: a table of thresholds compiled into one projection.

Every signal and every rule is a built-in expression over one row, so a filter by quality is a
single narrow pass over the texts: no shuffle, no Python, and the work per row follows its length
(n log n for the repeated windows). A long document is one array of words in one task.

Defined cases: a null text counts as empty; a text without words has all counts 0 and fails the
base rule; repeated rows and equal ids are judged one by one; extra columns are kept, and an input
column named like a result is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import bind, settled, whole, words

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on are this have from or "
    "de la le les et des un une du en que qui pour par dans sur au ne pas plus "
    "der die und das den von zu mit sich ist im dem nicht ein eine als auch auf für "
    "el los las se del con una su para al lo como más y a"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text when ``low <= part / whole <= high``; a whole of 0 fails a rule with a low."""

    name: str
    part: str
    whole: str
    low: float | None = None
    high: float | None = None


# The table of thresholds; parts and wholes are names of signals.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.04, None),
    Rule("dup_line_share", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_line_share", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_line_share", "n_ellipsis_lines", "n_lines", None, 0.3),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3


def _window_keys(own: Column) -> Column:
    """Sorted numbers, one per window of the words: 32 bits of its hash, then its place."""
    length = F.greatest(F.size(own) - (WINDOW - 1), F.lit(0))
    windows = F.arrays_zip(*(F.slice(own, k + 1, length) for k in range(WINDOW)))
    return F.sort_array(
        F.transform(
            windows,
            lambda x, i: F.shiftleft(F.hash(x).cast("long") + F.lit(2**31), 31).bitwiseOR(i),
        )
    )


def _candidates(keys: Column) -> Column:
    """Places of the windows that share their hash with another: all repeated ones, few others."""

    def same(x: Column, other: Column) -> Column:
        return F.coalesce(F.shiftright(x, 31) == F.shiftright(other, 31), F.lit(False))

    shared = F.filter(
        keys, lambda x, i: same(x, F.get(keys, i - 1)) | same(x, F.get(keys, i + 1))
    )
    return F.transform(shared, lambda x: x.bitwiseAND(2**31 - 1).cast("int"))


def _repeated_words(own: Column, places: Column) -> Column:
    """How many words lie in a window that is found twice or more, by the words themselves."""

    def covered(starts: Column) -> Column:
        # each start, in order, adds the words that the start before it did not reach
        first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            starts,
            first,
            lambda a, x: F.struct(
                x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")
            ),
            lambda a: a["n"],
        )

    def starts(windows: Column) -> Column:
        twice = F.filter(
            windows,
            lambda x, i: x["key"].eqNullSafe(F.get(windows, i - 1)["key"])
            | x["key"].eqNullSafe(F.get(windows, i + 1)["key"]),
        )
        return F.array_sort(F.transform(twice, lambda x: x["at"]))

    keyed = F.transform(
        places,
        lambda i: F.struct(
            F.concat_ws(" ", *(F.get(own, i + k) for k in range(WINDOW))).alias("key"),
            i.alias("at"),
        ),
    )
    return covered(bind(F.sort_array(keyed), starts))


def quality_signals(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the counts that the rules divide: words, symbols, lines, repeats."""
    text = F.col("__llm_text")
    own = F.col("__llm_words")
    lines = F.col("__llm_lines")

    def count(array: Column, test) -> Column:
        return F.size(F.filter(array, test)).cast("long")

    staged = df.withColumn("__llm_text", whole(text_col)).withColumns(
        {
            "__llm_words": words(text),
            "__llm_lines": F.filter(
                F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")
            ),
        }
    )
    staged = staged.withColumn("__llm_keys", _window_keys(own))
    staged = staged.withColumn("__llm_places", _candidates(F.col("__llm_keys")))
    return staged.withColumns(
        {
            "n_words": F.size(own).cast("long"),
            "word_chars": F.length(F.array_join(own, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": _repeated_words(own, F.col("__llm_places")),
            "n_stop_words": count(own, lambda w: w.isin(*STOP_WORDS)),
            "n_bullet_lines": count(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•")),
            "n_ellipsis_lines": count(
                lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")
            ),
        }
    ).drop("__llm_text", "__llm_words", "__llm_lines", "__llm_keys", "__llm_places")


def _holds(rule: Rule) -> Column:
    part, base = F.col(rule.part), F.col(rule.whole)
    share = F.when(base > 0, part / base)
    tests = []
    if rule.low is not None:
        tests.append(F.coalesce(share >= rule.low, F.lit(False)))
    if rule.high is not None:
        tests.append(F.coalesce(share <= rule.high, F.lit(True)))
    return reduce(lambda a, b: a & b, tests)


def apply_rules(signals: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add base_failed, failed_rules (names of the rules that fail) and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    failed = F.filter(
        F.array(*(F.when(~_holds(r), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull()
    )
    return signals.withColumns({"base_failed": base, "failed_rules": failed}).withColumn(
        "kept", settled(~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def judge(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Signals, failed rules and the verdict ``kept`` for every row."""
    return apply_rules(quality_signals(df, text_col), rules)
