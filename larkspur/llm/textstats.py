"""Statistics of whole texts as native Spark columns.

Words are maximal runs outside space, tab, line feed, vertical tab, form feed and carriage
return.  A null text has no words; every statistic of it is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body``, inside one expression."""
    return F.transform(F.array(value), body)[0]


def count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more; ``hashes`` by start."""

    def covered(ordered: Column) -> Column:
        twin = lambda e, j: (e["h"] == F.get(ordered, j - 1)["h"]) | (e["h"] == F.get(ordered, j + 1)["h"])
        starts = F.sort_array(F.transform(F.filter(ordered, lambda e, j: F.coalesce(twin(e, j), F.lit(False))), lambda e: e["i"]))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"))
        none = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, none, step, lambda a: a["n"])

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, covered)).otherwise(F.lit(0))


def with_text_stats(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and the statistics n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_chars_all, n_upper, n_digits, n_marks, n_distinct_words (all long).

    Windows are compared by a 64-bit hash of their five words; within one text of a million
    words a false repeat has a chance below one in ten million.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(*keep, text.alias("__t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("__w"))
    t, w, n = F.col("__t"), F.col("__w"), F.size("__w")
    at = lambda i, k: F.get(w, i + k)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    hashed = base.select(
        *keep,
        "__t",
        "__w",
        F.when(n > WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("__h"),
        lines.alias("__l"),
    )
    stats = {
        "n_words": n,
        "word_chars": F.length(F.translate(t, BLANKS, "")),
        "n_symbols": count_of(t, SYMBOLS),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": repeated_words(F.col("__h")),
        "n_lines": F.size("__l"),
        "n_chars_all": F.length(t),
        "n_upper": F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", "")),
        "n_digits": count_of(t, "0123456789"),
        "n_marks": count_of(t, "!?.,;:"),
        "n_distinct_words": F.size(F.array_distinct("__w")),
    }
    return hashed.select(*keep, *[c.cast("long").alias(k) for k, c in stats.items()])
